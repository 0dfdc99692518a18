"""Outside services by use case: a registry that hands the engine what is plugged in, and offline defaults."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

# The use cases.
USE_CASES = ("summarization", "grading", "generation")
_registry: dict[str, Callable[[], Any]] = {}


def register(use_case: str, make: Callable[[], Any]) -> None:
    """``make`` builds the service for a use case; it is called once per lookup, on the driver or in a task."""
    if use_case not in USE_CASES:
        raise ValueError(f"no such use case: {use_case}; there are {', '.join(USE_CASES)}")
    _registry[use_case] = make


def forget(use_case: str) -> None:
    """Back to the offline default."""
    _registry.pop(use_case, None)


def provider(use_case: str) -> Any | None:
    """The service for a use case, or None: the engine then takes its offline default."""
    if use_case not in USE_CASES:
        raise ValueError(f"no such use case: {use_case}; there are {', '.join(USE_CASES)}")
    return _registry[use_case]() if use_case in _registry else None


def text_of(response: Any) -> str:
    """The text of a service's answer: a string, or a list of blocks whose ``text`` parts are joined; stripped."""
    if isinstance(response, list):
        return "".join(str(b.get("text", "")) for b in response if isinstance(b, dict)).strip()
    return str(response).strip()
