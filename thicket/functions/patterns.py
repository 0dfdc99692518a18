"""Character classes and patterns with Unicode meaning on the JVM.

Java's \\w, \\W and \\s are ASCII only by default and would damage text in other languages; the classes here spell out
what a Unicode-aware engine means. The patterns of the cleaning and normalisation steps are fixed values: what they
remove is part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# The steps of the cleaning, in their order.
SYMBOL_LINES = rf"(?md)^(?!{SPACE}*+\|.*\|{SPACE}*$){NOT_WORD}+$\n"
PAGE_MARKERS = rf"(?imud)^{SPACE}*(page{SPACE}+\p{{Nd}}+{SPACE}+of{SPACE}+\p{{Nd}}+|-{SPACE}*\p{{Nd}}+{SPACE}*-){SPACE}*$"
IMAGES = r"(?d)!\[.*?\]\(.*?\)"
TAGS = r"<[^>]+>"
NUL = "\x00"
BLANK_RUN = r"\n{3,}"

# The steps of the normalisation.
ZERO_WIDTH = ("​", "﻿")
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "œ": "oe", "æ": "ae"}
BROKEN_WORD = r"([a-zA-Z]+)-\n([a-zA-Z]+)"
SPACES = r"[ \t]+"


def strip(c: Column) -> Column:
    """Both ends without Unicode white space (``trim`` knows only the plain space)."""
    return F.regexp_replace(F.regexp_replace(c, rf"^{SPACE}++", ""), rf"{SPACE}+\z", "")


def remove(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")
