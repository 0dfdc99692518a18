"""Rule-based redaction: each entity becomes its name in angle brackets; the leftmost, longest match wins.

Persons need a recogniser: a gazetteer by default (``Gazetteer``), anything with the same interface otherwise. A
gazetteer knows the names it lists and no others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE = r"(\+[0-9]{1,3}[ .-])?(\([0-9]{3}\) |\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b"
CARD = r"\b[0-9]{4}([ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}\b"


def redact_email(c: Column) -> Column:
    # Without an at sign the pattern would only try every start of every long run of letters.
    return F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL, "<EMAIL_ADDRESS>")).otherwise(c)


def redact_ssn(c: Column) -> Column:
    return F.regexp_replace(c, SSN, "<US_SSN>")


def redact_phone(c: Column) -> Column:
    return F.regexp_replace(c, PHONE, "<PHONE_NUMBER>")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of card numbers."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def redact_card(c: Column) -> Column:
    """Runs of 13 to 19 digits that pass the check sum; others stay."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(CARD), 0)), lambda x: F.length(F.regexp_replace(x, "[ -]", "")).between(13, 19) & luhn(F.regexp_replace(x, "[ -]", "")))
    longest = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(found) > 0, F.aggregate(longest, c, lambda acc, x: F.replace(acc, x, F.lit("<CREDIT_CARD>")))).otherwise(c)


class Recogniser(Protocol):
    """Finds persons in texts: for each text, (start, end) pairs."""

    def persons(self, texts: list[str]) -> list[list[tuple[int, int]]]: ...


class Gazetteer:
    """A given name and a family name side by side, of which one at least is listed."""

    def __init__(self, given: Iterable[str], family: Iterable[str] = ()):
        g, f, word = "|".join(map(re.escape, given)) or r"(?!)", "|".join(map(re.escape, family)) or r"(?!)", r"[A-Z][^\W\d_]+"
        self.rx = re.compile(rf"\b(?:(?:{g})(?: [A-Z]\.)? {word}|{word}(?: [A-Z]\.)? (?:{f})|(?:{f}), {word})\b")

    def persons(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        return [[m.span() for m in self.rx.finditer(t)] for t in texts]


def redact_person(c: Column, recogniser: Recogniser) -> Column:
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t or "" for t in s]
            out = []
            for t, spans, given in zip(texts, recogniser.persons(texts), s):
                for a, b in sorted(spans, reverse=True):
                    t = t[:a] + "<PERSON>" + t[b:]
                out.append(None if given is None else t)
            yield pd.Series(out, dtype=object)

    return run(c)


#: Entities and their redactors in the order they are applied.
ENTITIES = {"EMAIL_ADDRESS": redact_email, "US_SSN": redact_ssn, "CREDIT_CARD": redact_card, "PHONE_NUMBER": redact_phone}


def steps(recogniser: Recogniser | None = None, entities: Iterable[str] = (*ENTITIES, "PERSON")) -> list[Callable[[Column], Column]]:
    """The redactors of the chosen entities in order; persons only with a recogniser."""
    wanted = set(entities)
    if unknown := wanted - {*ENTITIES, "PERSON"}:
        raise ValueError(f"no such entity: {sorted(unknown)}")
    out = [step for name, step in ENTITIES.items() if name in wanted]
    return out + [lambda c: redact_person(c, recogniser)] if "PERSON" in wanted and recogniser else out


def redact(c: Column, recogniser: Recogniser | None = None, entities: Iterable[str] = (*ENTITIES, "PERSON")) -> Column:
    """The chosen entities redacted; null comes out empty."""
    for step in steps(recogniser, entities):
        c = step(c)
    return F.coalesce(c, F.lit(""))
