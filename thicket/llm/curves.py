"""Problem 4: the most similar vectors of every vector, by shifted space-filling curves.

Every vector is normalised, rotated and projected to a few dimensions, shifted, and given its position on a Hilbert
curve, under several rotations and shifts. Each ordering is range-partitioned and sorted by Spark; every row is compared
with the rows in a window behind it (8-bit codes travel with the keys, so no join is needed), windows reach over the
partitions' borders, and the candidates of all orderings are merged and reranked with the exact cosine.

Vectors stored more than once are one point of the curve, with their number of copies as weight: a third of all rows
may hold one vector without filling a window. Distinct vectors can crowd one place all the same; a row with so many
candidates that windows may have left some out (CROWDED) is compared with all rows instead, tile by tile, and gets its
exact nearest ones. That is quadratic in the crowded rows, and nothing where there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.session import cut

DIMS, BITS = 10, 6
CURVES, WINDOW = 16, 40
#: Rows with this share of a window as candidates, over all orderings, are finished exactly.
CROWDED = 0.5
#: Keys that a task of the sweep holds, on average.
PART = 500_000
#: Rows of either side that a task of the exact pass compares.
BLOCK = 16_384
#: What 8-bit codes may lose of a cosine.
SLACK = 0.02


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points (n x dims) with coordinates below 2**bits; dims * bits at most 63."""
    x = x.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection(size: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotation (size x DIMS, orthonormal columns) and the shift of one ordering; fixed by the curve's number."""
    rng = np.random.default_rng(7919 * curve + size)
    rot, _ = np.linalg.qr(rng.standard_normal((size, min(DIMS, size))))
    return rot.astype(np.float32), rng.random(rot.shape[1]).astype(np.float32)


def _keys(size: int, curves: int):
    frames = [projection(size, c) for c in range(curves)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            code = np.rint(x / np.abs(x).max(1, keepdims=True) * 127).astype(np.int8)
            code = [r.tobytes() for r in code]
            ids = pdf["id"].to_numpy()
            for c, (rot, shift) in enumerate(frames):
                y = x @ rot * np.float32(np.sqrt(size) / 8)  # a random direction gives a normal value of deviation 1/8
                cell = np.clip((y + 0.5 + shift / 4 - 0.125) * (1 << BITS), 0, (1 << BITS) - 1)
                yield pd.DataFrame({"curve": np.int32(c), "key": hilbert(cell, BITS), "id": ids, "code": code})

    return run


def _windows(size: int, window: int, least: float):
    """Sorted partitions -> candidate pairs, and the rows at either end of the partition (a is null) for the border pass."""

    def compare(curve, ids, x, old):
        """Pairs of each row with the ``window`` rows before it; rows before ``old`` have been compared."""
        out = []
        for o in range(1, min(window, len(ids) - 1) + 1):
            lo = max(old, o)
            cos = np.einsum("ij,ij->i", x[lo:], x[lo - o : len(x) - o])
            ok = (cos >= least) & (curve[lo:] == curve[lo - o : len(x) - o])
            if ok.any():
                out.append((ids[lo:][ok], ids[lo - o : len(x) - o][ok]))
        if not out:
            return None
        a, b = np.concatenate([p for p, _ in out]), np.concatenate([q for _, q in out])
        return np.minimum(a, b), np.maximum(a, b)

    def unit(codes):
        x = np.frombuffer(b"".join(codes), np.int8).reshape(-1, size).astype(np.float32)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def ends(pdf, border, side):
        return pd.DataFrame({"a": pd.array([None] * len(pdf), "Int64"), "b": pdf["id"].to_numpy(), "border": border, "side": side, "place": np.arange(len(pdf)), "curve": pdf["curve"].to_numpy(), "code": pdf["code"].to_numpy()})

    def pairs(found):
        a, b = found
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": b, "border": -1, "side": 0, "place": 0, "curve": 0, "code": None})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        tail, head = None, 0
        for pdf in batches:
            if head < window and len(pdf):
                first = pdf.iloc[: window - head]
                yield ends(first, part, 1).assign(place=np.arange(head, head + len(first)))
                head += len(first)
            old = 0 if tail is None else len(tail)
            pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            if not len(pdf):
                continue
            if (found := compare(pdf["curve"].to_numpy(), pdf["id"].to_numpy(), unit(pdf["code"]), old)) is not None:
                yield pairs(found)
            tail = pdf.iloc[-window:]
        if tail is not None:
            yield ends(tail, part + 1, 0)

    def border(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "place"])
        curve, ids, x, side = pdf["curve"].to_numpy(), pdf["b"].to_numpy(), unit(pdf["code"]), pdf["side"].to_numpy()
        found = compare(curve, ids, x, int((side == 0).sum()))
        return pairs(found)[["a", "b"]].astype("int64") if found is not None else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return run, border


def usable(df: DataFrame, row_id: str, vector: str, size: int) -> DataFrame:
    """(id, v) of the rows that take part: id not null; vector of ``size`` finite values, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where("id is not null")
    return rows.where((F.size("v") == size) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


class Neighbours:
    """members: (id, rep); points: (id, copies, v) of the representatives; close: (a, b, c9), a < b, cosine in 1e-9.

    Of crowded points, ``close`` has the ``k`` nearest (ties included) for certain, and not all others.
    """

    def __init__(self, members: DataFrame, points: DataFrame, close: DataFrame, k: int):
        self.members, self.points, self.close, self.k = members, points, close, k


def nearest(some: DataFrame, points: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of the rows of ``some`` with their k most similar points of a cosine of at least ``least``.

    Exact, ties at the k-th place included. Both are (id, v) and laid in blocks by hash; every pair of blocks is a task.
    """
    rows, cols = (max(1, -(-x.count() // BLOCK)) for x in (some, points))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = some.select("id", "v", place(rows).alias("row")).select("id", "v", "row", every(cols).alias("col"))
    c = points.select("id", "v", place(cols).alias("col")).select("id", "v", every(rows).alias("row"), "col")

    def unit(vs: pd.Series) -> np.ndarray:
        x = np.stack(vs.to_numpy()).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((3, 0), np.int64)]
        if len(a) and len(b):
            y, other = unit(b["v"]), b["id"].to_numpy()
            for at in range(0, len(a), 256):
                own = a["id"].to_numpy()[at : at + 256]
                s = unit(a["v"].iloc[at : at + 256]) @ y.T
                s[own[:, None] == other] = -2
                low = np.full(len(own), least) if len(other) <= k else np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
                i, j = np.nonzero(s >= low[:, None] - 2e-9)  # the rerank decides
                out.append(np.stack([own[i], other[j], np.rint(s[i, j] * 1e9).astype(np.int64)]))
        i, j, s = np.concatenate(out, axis=1)
        return pd.DataFrame({"a": i, "b": j, "s": s})

    found = q.groupBy("row", "col").cogroup(c.groupBy("row", "col")).applyInPandas(best, "a long, b long, s long")
    n = F.row_number().over(Window.partitionBy("a").orderBy(F.col("s").desc()))
    kth = F.max(F.when(F.col("n") == k, F.col("s"))).over(Window.partitionBy("a"))
    kept = found.withColumn("n", n).withColumn("kth", kth).where("kth is null or s >= kth - 2")
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def close_vectors(df: DataFrame, row_id: str, vector: str, size: int = 64, least: float = 0.9, curves: int = CURVES, window: int = WINDOW, k: int = 10) -> Neighbours:
    """Pairs of vectors with a cosine of at least ``least`` that some ordering brings into one window; of rows in crowded
    places, the pairs with their ``k`` nearest.

    Null ids, null vectors, vectors of another length, all zero, or holding a null, NaN or infinity take no part.
    Repeated rows and equal vectors are one point. Ties keep all. An empty table gives empty results. Other columns
    are not read.
    """
    base = usable(df, row_id, vector, size)
    rows = base.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    points = cut(rows.groupBy("h1", "h2").agg(F.min_by(F.struct("id", "v"), "id").alias("r"), F.count_distinct("id").alias("copies")).select("h1", "h2", "r.id", "copies", "r.v"))
    members = rows.select("id", "h1", "h2").distinct().join(points.select("h1", "h2", F.col("id").alias("rep")), ["h1", "h2"]).select("id", "rep")
    keyed = points.select("id", "v").mapInPandas(_keys(size, curves), "curve int, key long, id long, code binary")
    run, border = _windows(size, window, least - SLACK)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-points.count() * curves // PART))
    swept = cut(keyed.repartitionByRange(parts, "curve", "key").sortWithinPartitions("curve", "key").mapInPandas(run, "a long, b long, border int, side int, place int, curve int, code binary"))
    over = swept.where("a is null").groupBy("border").applyInPandas(border, "a long, b long")
    found = cut(swept.where("a is not null").select("a", "b").unionByName(over).where("a <> b").distinct())
    vec = points.select("id", "v")
    full = found.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count().where(F.col("count") >= CROWDED * window)
    crowded = cut(vec.join(full.select("id"), "id", "left_semi"))
    if not crowded.isEmpty():
        found = found.unionByName(nearest(crowded, vec, k, least)).distinct()
    both = found.join(vec.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vec.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    return Neighbours(members, points, cut(both.mapInPandas(_rerank(least), "a long, b long, c9 long")), k)


def _rerank(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, y = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in ("va", "vb"))
            cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            ok = cos >= least
            yield pd.DataFrame({"a": pdf["a"][ok], "b": pdf["b"][ok], "c9": np.rint(cos[ok] * 1e9).astype(np.int64)})

    return run


def mutual(found: Neighbours, k: int = 10) -> DataFrame:
    """Pairs (id_a, id_b) of rows, each among the other's k most similar (ties at the k-th place all count).

    A row's place counts the rows that are strictly more similar, copies included. Cosines equal to nine places tie.
    Copies of one vector tie at the first place.
    """
    if k > found.k:
        raise ValueError(f"the {found.k} nearest were looked for, not {k}")
    copies = found.points.select("id", "copies")
    sided = found.close.unionByName(found.close.select(F.col("b").alias("a"), F.col("a").alias("b"), "c9"))
    weighed = sided.join(copies.select(F.col("id").alias("b"), F.col("copies").alias("nb")), "b").join(copies.select(F.col("id").alias("a"), F.col("copies").alias("na")), "a")
    above = Window.partitionBy("a").orderBy(F.col("c9").desc()).rangeBetween(Window.unboundedPreceding, -1)
    near = weighed.withColumn("above", F.coalesce(F.sum("nb").over(above), F.lit(0)) + F.col("na") - 1).where(F.col("above") < k)
    both = near.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).groupBy("x", "y").count().where("count = 2").select("x", "y")
    m = found.members
    ma, mb = m.select(F.col("rep").alias("x"), F.col("id").alias("i")), m.select(F.col("rep").alias("y"), F.col("id").alias("j"))
    linked = both.join(ma, "x").join(mb, "y").select("i", "j")
    twins = ma.join(mb, F.col("x") == F.col("y")).where("i < j").select("i", "j")
    return linked.unionByName(twins).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()
