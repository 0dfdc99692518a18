"""Problem 3: splitting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over the last 16 characters gives every position a value that depends on nothing else. Within the span
a piece may end in, the landmark is the position of the least value; it snaps to the nearest natural boundary of the
span (end of a paragraph, line or sentence; else a space; else the landmark itself). Since neither looks beyond the
span, an edit alters the pieces around it, and cuts fall into step again at the next shared landmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SENTENCE = re.compile(r"[.!?。！？…][\"'”’)\]]*\s+")
_GLUE = re.compile("[̀-ͯ‌‍︀-️]")


def landmarks(codes: np.ndarray) -> np.ndarray:
    """A hash for every cut position 0..n, of the WIDTH characters before it."""
    h = np.zeros(len(codes) + 1, np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    factor = np.uint64(1)
    for k in range(min(WIDTH, len(codes))):
        h[k + 1 :] += c[: len(codes) - k] * factor
        factor = np.uint64((int(factor) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def boundaries(text: str, codes: np.ndarray) -> np.ndarray:
    """2: a cut here follows a paragraph, line or sentence; 1: a space; 0: nothing; -1: it would part a character from its marks."""
    n = len(text)
    rank = np.zeros(n + 1, np.int8)
    space = np.isin(codes, np.array([9, 10, 11, 12, 13, 32, 0xA0, 0x2007, 0x2009, 0x202F, 0x3000], codes.dtype))
    rank[1:][space] = 1
    rank[1:][codes == 10] = 2
    for m in _SENTENCE.finditer(text):
        rank[m.end()] = 2
    rank[1:n][space[:-1] & space[1:]] = 0  # not inside a run of spaces: after it
    if not text.isascii():
        for m in _GLUE.finditer(text):
            rank[m.start()] = -1
    return rank


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of the pieces. Each but the first begins exactly ``overlap`` characters before the end of the one before."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    core = limit - overlap
    least = max(1, core // 4)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    h, rank = landmarks(codes), boundaries(text, codes)
    out, start = [], 0
    while True:
        most = start + (core if out else limit)
        begin = max(0, start - overlap) if out else 0
        if most >= n:
            out.append((begin, n))
            return out
        low = start + (least if out else max(least, overlap))
        span = rank[low : most + 1]
        mark = int(np.argmin(h[low : most + 1]))
        for want in (2, 1):
            at = np.flatnonzero(span == want)
            if len(at):
                cut = low + int(at[np.argmin(np.abs(at - mark))])
                break
        else:
            free = np.flatnonzero(span >= 0)
            cut = low + (int(free[np.argmin(np.abs(free - mark))]) if len(free) else mark)
        out.append((begin, cut))
        start = cut


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """(row_key, piece_no, pieces, start_pos, piece): the text whole if it has at most ``limit`` characters, else its pieces.

    Characters are Unicode code points; positions start at 1. The pieces, without the overlap each shares with the one
    before, make up the text again. Null and empty texts have no pieces. Repeated rows are split each. A text of any
    length is split in one pass of linear cost. An empty table gives no rows. Other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    base = df.select(F.col(f"`{key}`").alias("row_key"), F.col(f"`{text}`").alias("t")).where("t <> ''")
    kind = base.schema["row_key"].dataType.simpleString()
    whole = base.where(F.char_length("t") <= limit).select("row_key", F.lit(1).alias("piece_no"), F.lit(1).alias("pieces"), F.lit(1).alias("start_pos"), F.col("t").alias("piece"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["row_key"], pdf["t"]):
                spans = cuts(t, limit, overlap)
                rows += [(k, i, len(spans), a + 1, t[a:b]) for i, (a, b) in enumerate(spans, 1)]
            yield pd.DataFrame(rows, columns=["row_key", "piece_no", "pieces", "start_pos", "piece"])

    long = base.where(F.char_length("t") > limit).mapInPandas(run, f"row_key {kind}, piece_no int, pieces int, start_pos int, piece string")
    return whole.unionByName(long)
