"""Errors of the ingestion as values and rows."""

from __future__ import annotations

import contextlib
import traceback
from collections.abc import Iterator
from dataclasses import dataclass


@dataclass
class StageError(Exception):
    """What failed, where, on which file."""

    stage: str
    file_name: str | None
    original_error: str
    error_file: str | None = None
    line_number: int | None = None
    function_name: str | None = None

    def __str__(self) -> str:
        return f"[{self.stage}] {self.file_name or '-'}: {self.original_error} ({self.error_file}:{self.line_number} in {self.function_name})"

    def row(self) -> tuple:
        return self.stage, self.file_name, self.original_error, self.error_file, self.line_number, self.function_name


@contextlib.contextmanager
def stage(name: str, file_name: str | None = None) -> Iterator[None]:
    """Turns any error inside into a StageError that knows its innermost frame."""
    try:
        yield
    except StageError:
        raise
    except Exception as e:
        frame = traceback.extract_tb(e.__traceback__)[-1]
        raise StageError(name, file_name, f"{type(e).__name__}: {e}", frame.filename.rpartition("/")[2], frame.lineno, frame.name) from e
