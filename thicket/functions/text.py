"""Cleaning and normalisation of Markdown text as column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.functions import patterns as P


def clean_symbol_lines(c: Column) -> Column:
    """Without lines of symbols only (pipe rows stay); a run of them may span lines, and must end with a newline."""
    return P.remove(c, P.SYMBOL_LINES)


def clean_page_markers(c: Column) -> Column:
    return P.remove(c, P.PAGE_MARKERS)


def clean_images(c: Column) -> Column:
    return P.remove(c, P.IMAGES)


def clean_tags(c: Column) -> Column:
    return P.remove(c, P.TAGS)


def clean_nul(c: Column) -> Column:
    return F.replace(c, F.lit(P.NUL), F.lit(""))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, P.BLANK_RUN, "\n\n")


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: The cleaning, step by step; null comes out empty.
CLEAN = (clean_symbol_lines, clean_page_markers, clean_images, clean_tags, clean_nul, collapse_newlines, P.strip, empty_if_null)


def clean(c: Column) -> Column:
    for step in CLEAN:
        c = step(c)
    return c


def staged(df: DataFrame, column: str, *steps: Callable[[Column], Column]) -> DataFrame:
    """The steps on one column, each in a projection of its own.

    A step may use its input more than once (is it ASCII? then as it is, else ...). As one nested expression that would
    compute all steps before it once more per use; Catalyst leaves projections apart where merging would do that.
    """
    for step in steps:
        df = df.withColumn(column, step(F.col(column)))
    return df


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility composition. Nothing built in does it; rows of ASCII don't go through Python's work."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def strip_invisible(c: Column) -> Column:
    for z in P.ZERO_WIDTH:
        c = F.replace(c, F.lit(z), F.lit(""))
    return F.replace(c, F.lit(" "), F.lit(" "))


def ligatures(c: Column) -> Column:
    for seen, meant in P.LIGATURES.items():
        c = F.replace(c, F.lit(seen), F.lit(meant))
    return c


def dehyphenate(c: Column) -> Column:
    return F.regexp_replace(c, P.BROKEN_WORD, "$1$2")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, P.SPACES, " ")


#: The normalisation, step by step.
NORMALISE = (nfkc, strip_invisible, ligatures, dehyphenate, collapse_spaces, collapse_newlines, P.strip)


def normalise(c: Column) -> Column:
    for step in NORMALISE:
        c = step(c)
    return c
