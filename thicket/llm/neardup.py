"""Problem 1: near-duplicate records, by a Gray-order hierarchical index over similarity-preserving fingerprints.

Fingerprint. Every row's bag of words becomes 230 slots, each the least element of the bag under one random order. All
words weigh alike, however many rows hold them, so two slots agree with a probability equal to the multiset Jaccard
similarity itself (weights would let a pair of similarity 0.7 fall to any value, when a class of near-copies makes what
its members share common). What recall rests on, masks and radius, so follows from the threshold for every pair.

Index. An upper node of the index is a pattern shared under a mask: 46 masks of five slots each. Pairs that meet in a
node without being alike grow with the square of the table, so their share decides the time: rows that share a sixth of
their words meet with 46 x 0.17^5, a 16th of what 20 masks of three slots would give at the same recall. Rows below a
node are sorted by the Gray rank of their residual code (one bit of each of 192 slots); runs of that order form lower
nodes, which hold the bits common to all below (AND/OR masks). Searching a node with itself descends pairs of lower
nodes, adding up the differences of the bits that are fixed on both sides, and drops a pair of whole groups as soon as
the sum exceeds the radius; groups that are left are compared as wholes. Pairs within the radius must pass a bound that
no linked pair fails: the words' counts in 64 bins allow at most so many words in common. What is left is checked
against the exact multiset Jaccard similarity.

Partitioning. Exact copies (equal bags) are collapsed to a representative first. Nodes are spread by hash; a node with
more rows than ``node_rows`` is cut into blocks, and every pair of blocks is a task of its own, so that a pattern
that a third of the rows share neither lands in one task nor loses a pair. The sizes of such nodes are estimated from
a share of the rows: they decide how the work is dealt out, never what is compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.unify import consistent_form
from thicket.session import cut, spread

SLOTS, PER_MASK = 230, 5
MASKS = SLOTS // PER_MASK
#: Bits of the residual code, and the radius in it. Pairs of similarity 0.7 differ in 29 bits, give or take 4.9.
BITS, RADIUS = 192, 47
#: Bins of the counts of words, of four bits each; 15 stands for 15 or more.
BINS = 64
#: Nodes to be cut into blocks whose table (12 bytes each) is still broadcast.
HOT = 500_000
#: Bytes that are kept of an element's hash: two bags of 60 words take different words for one with 60 x 60 / 2^48.
KEPT = 6
#: Rows that a node of ``node_rows`` has in the share from which sizes are estimated.
SEEN = 128
_WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LEAF = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The position of a code word in the reflected Gray sequence."""
    x = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, occurrence hash, row) of every word, sorted by row and hash. The k-th copy of a word is an element of its own."""
    words = [_WORD.findall(t.lower()) for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.array([w for ws in words for w in ws], dtype=object)
    row = np.repeat(np.arange(len(texts)), n)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), row
    h = pd.util.hash_array(flat, categorize=True)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    occ = (np.arange(len(h)) - first).astype(np.uint64)
    return h, _mix(h + occ * np.uint64(0x9E3779B97F4A7C15)), row


def slots(e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The slots of every row (SLOTS x rows): the least element under each order, mixed so that every bit of it counts."""
    odd = _mix(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).astype(np.uint32) | np.uint32(1)
    short, under = (e >> np.uint64(16)).astype(np.uint32), np.empty(len(e), np.uint32)
    out = np.empty((SLOTS, len(starts)), np.uint32)
    for j in range(SLOTS):
        np.multiply(short, odd[j], out=under)  # elements are hashes already: an odd factor gives another order of them
        np.minimum.reduceat(under, starts, out=out[j])
    out ^= odd[SLOTS:, None]
    for factor in (0x7FEB352D, 0x846CA68B):
        out ^= out >> np.uint32(16)
        out *= np.uint32(factor)
    return out ^ (out >> np.uint32(15))


def residual(s: np.ndarray) -> list[np.ndarray]:
    """The residual code: a bit of each of the first BITS slots, in words of 64 bits."""
    bits = np.packbits((s[:BITS] & np.uint32(1)).astype(np.uint8).T, axis=1)
    return list(np.ascontiguousarray(bits).view(np.uint64).T)


def patterns(s: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The nodes of every row (rows x MASKS), of rows of one kind only: the kind is the lowest bit."""
    odd = _mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)
    same = (s * odd[:, None]).reshape(MASKS, PER_MASK, -1).sum(1, dtype=np.uint64)
    same = _mix(same ^ _mix(np.arange(1, MASKS + 1, dtype=np.uint64))[:, None])
    return ((same & ~np.uint64(1)) | kind.astype(np.uint64)).T.astype(np.int64)


def counts(e: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of every row in BINS bins, up to 15 each, in four words of 64 bits."""
    at = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(e)]))
    n = np.minimum(np.bincount(at * BINS + (e % np.uint64(BINS)).astype(np.int64), minlength=len(starts) * BINS), 15).astype(np.uint8).reshape(-1, BINS)
    return np.ascontiguousarray(n[:, ::2] | (n[:, 1::2] << 4)).view(np.int64)


def may_agree(c: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows may reach the threshold by their counts; false only where they can't."""
    b = np.ascontiguousarray(c).view(np.uint8)
    out = np.empty(len(x), bool)
    for at in range(0, len(x), 50_000):
        u, v = b[x[at : at + 50_000]], b[y[at : at + 50_000]]
        low, high = np.minimum(u & 15, v & 15), np.minimum(u >> 4, v >> 4)
        both = low.sum(1, dtype=np.int64) + high.sum(1, dtype=np.int64)
        every = sum(z.sum(1, dtype=np.int64) for z in (u & 15, u >> 4, v & 15, v >> 4)) - both
        out[at : at + 50_000] = (both >= threshold * every - 1e-6) | (low == 15).any(1) | (high == 15).any(1)
    return out


def _bagged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows with words -> their bags, and a key of kind and bag whose lowest bit is the kind."""
    for whole in batches:
        for at in range(0, len(whole), 1500):
            pdf = whole.iloc[at : at + 1500]
            h, e, row = bags(pdf["canonical"].tolist())
            if not len(h):
                continue
            ends = np.r_[np.flatnonzero(row[1:] != row[:-1]) + 1, len(row)]
            starts = np.r_[0, ends[:-1]]
            e &= np.uint64((1 << 8 * KEPT) - 1)
            own = [np.sort(e[a:b]).view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes() for a, b in zip(starts, ends)]
            kind = pdf["kind"].to_numpy()[row[starts]].astype(np.int64)
            key = np.frombuffer(b"".join(hashlib.md5(x).digest()[:8] for x in own), np.int64)
            yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy()[row[starts]], "key": (key & ~1) | kind, "bag": own})


def _elements(own: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all bags, one bag after the other, and where each begins."""
    kept = np.frombuffer(b"".join(own), np.uint8).reshape(-1, KEPT)
    whole = np.zeros((len(kept), 8), np.uint8)
    whole[:, :KEPT] = kept
    return whole.view(np.uint64).ravel(), np.cumsum([0, *map(len, own)])[:-1] // KEPT


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Representatives -> a row for each of their nodes."""
    for whole in batches:
        for at in range(0, len(whole), 1500):
            pdf = whole.iloc[at : at + 1500]
            s = slots(*_elements(pdf["bag"]))
            key = pdf["key"].to_numpy()
            first, *more = residual(s)
            words = [gray_rank(first), *more]
            yield pd.DataFrame({"node": patterns(s, key & 1).ravel(), "id": np.repeat(key, MASKS), **{f"w{k}": np.repeat(w.astype(np.int64), MASKS) for k, w in enumerate(words)}})


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _differ(words: list[np.ndarray], x, y) -> np.ndarray:
    """Bits in which rows x and rows y differ."""
    return sum(_popcount(r[x] ^ r[y]) for r in words)


def search_node(r1: np.ndarray, r2: np.ndarray, radius: int, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i < j) of rows sorted by Gray rank that differ in at most ``radius`` bits, by descending the index."""
    words, n = [r1, r2, *more], len(r1)
    if n <= _LEAF * 2:
        i, j = np.triu_indices(n, 1)
        near = _differ(words, i, j) <= radius
        return i[near], j[near]
    starts = np.arange(0, n, _LEAF)
    fixed = []
    for r in words:
        ones, some = np.bitwise_and.reduceat(r, starts), np.bitwise_or.reduceat(r, starts)
        fixed.append((ones, ~(ones ^ some)))
    level = [(fixed, starts)]
    while len(level[-1][1]) > _LEAF:  # upper levels
        f, st = level[-1]
        up = np.arange(0, len(st), _LEAF)
        nf = []
        for ones, mask in f:
            o, s = np.bitwise_and.reduceat(ones, up), np.bitwise_or.reduceat(ones, up)
            nf.append((o, np.bitwise_and.reduceat(mask, up) & ~(o ^ s)))
        level.append((nf, up))
    groups = [np.r_[r, np.zeros(-n % _LEAF, r.dtype)].reshape(-1, _LEAF) for r in words]
    left, right = [], []

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 256):
            u, v = a[at : at + 256], b[at : at + 256]
            bits = sum(np.bitwise_count(r[u][:, :, None] ^ r[v][:, None, :]) for r in groups)  # of bytes: at most 64 a word
            pair, x, y = np.nonzero(bits <= radius)
            x, y = u[pair] * _LEAF + x, v[pair] * _LEAF + y
            ok = (x < y) & (y < n)
            left.append(x[ok])
            right.append(y[ok])

    def descend(depth: int, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 4096):  # bounds what is held at once, however large the node
            u, v = a[at : at + 4096], b[at : at + 4096]
            keep = sum(_popcount((ones[u] ^ ones[v]) & mask[u] & mask[v]) for ones, mask in level[depth][0]) <= radius
            u, v = u[keep], v[keep]
            if not depth:
                compare(u, v)
                continue
            x = np.repeat(u[:, None] * _LEAF + np.arange(_LEAF), _LEAF, axis=1).ravel()
            y = np.tile(v[:, None] * _LEAF + np.arange(_LEAF), (1, _LEAF)).ravel()
            ok = (x <= y) & (y < len(level[depth - 1][1]))
            descend(depth - 1, x[ok], y[ok])

    descend(len(level) - 1, *np.triu_indices(len(level[-1][1]), 0))
    return np.concatenate(left), np.concatenate(right)


def _search(radius: int):
    """Partitions sorted by place (a node, or a pair of its blocks) and Gray rank -> pairs within the radius."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame | None:
        place, side, ids = (pdf[c].to_numpy() for c in ("place", "side", "id"))
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        size = np.diff(np.r_[starts, len(place)])
        words = [pdf[f"w{k}"].to_numpy().astype(np.uint64) for k in range(BITS // 64)]
        words[0] = gray_code(words[0])
        left, right = [], []
        for n in np.unique(size[(size > 1) & (size <= 2 * _LEAF)]):
            st = starts[size == n]
            i, j = np.triu_indices(n, 1)
            x, y = (st[:, None] + i).ravel(), (st[:, None] + j).ravel()
            near = _differ(words, x, y) <= radius
            left.append(x[near])
            right.append(y[near])
        for st, n in zip(starts[size > 2 * _LEAF], size[size > 2 * _LEAF]):
            r1, r2, *more = (w[st : st + n] for w in words)
            i, j = search_node(r1, r2, radius, *more)
            left.append(st + i)
            right.append(st + j)
        if not left:
            return None
        x, y = np.concatenate(left), np.concatenate(right)
        cross = (side[x] < 0) | (side[x] != side[y])
        a, b = ids[x[cross]], ids[y[cross]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the last place so far, which may go on
        for pdf in batches:
            if not len(pdf):
                continue
            place = pdf["place"].to_numpy()
            if held and place[-1] == held[0]["place"].iat[0]:
                held.append(pdf)
                continue
            cutoff = int(np.searchsorted(place, place[-1]))
            if (out := pairs(pd.concat([*held, pdf.iloc[:cutoff]], ignore_index=True))) is not None:
                yield out
            held = [pdf.iloc[cutoff:]]
        if held and (out := pairs(pd.concat(held, ignore_index=True))) is not None:
            yield out

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            n = len(pdf)
            e, starts = _elements(pd.concat([pdf["bag_a"], pdf["bag_b"]]))
            own = np.split(e, starts[1:])
            sim = np.zeros(n)
            for k in np.flatnonzero(may_agree(counts(e, starts), np.arange(n), np.arange(n, 2 * n), threshold)):
                both = np.concatenate([own[k], own[n + k]])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())  # elements of one bag are distinct
                sim[k] = same / (len(both) - same)
            ok = sim >= threshold
            a, b = pdf["rep_a"][ok], pdf["rep_b"][ok]
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": sim[ok]})

    return run


class Links:
    """members: (row_id, rep) of every row with words; links: (a, b, similarity) of linked representatives, a < b."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links


def near_duplicates(df: DataFrame, row_id: str, text: str, kind: str | None = None, threshold: float = 0.7, radius: int = RADIUS, node_rows: int = 16_384) -> Links:
    """Rows whose words agree to at least ``threshold`` (multiset Jaccard), within one ``kind``.

    Words: lower-cased runs of letters and digits, of the consistent form of the text (problem 5). Null or empty texts
    and texts without words take no part; rows with a null id take no part; a null kind is the kind false. Rows with
    equal bags share a representative (the least id). A row that repeats whole counts once. Very long texts are
    processed whole. An empty table gives empty results. Other columns are not read.
    """
    base = df.select(F.col(f"`{row_id}`").cast("long").alias("row_id"), (F.coalesce(F.col(f"`{kind}`"), F.lit(False)) if kind else F.lit(False)).cast("int").alias("kind"), F.col(f"`{text}`").alias("t")).where("row_id is not null and t <> ''")
    base = spread(base)
    form = consistent_form(base, ["row_id", "kind"], "t")
    rows = cut(form.mapInPandas(_bagged, "row_id long, key long, bag binary"))
    # A join, not a window: copies of one text, however many, are never put together in a task.
    least = rows.groupBy("key").agg(F.min("row_id").alias("rep"))
    members = rows.select("row_id", "key").distinct().join(least, "key")
    # The same columns and the same filter (that of the joins) in all three uses, so that the bags are shuffled once.
    reps = rows.where("key is not null").groupBy("key").agg(F.min("row_id").alias("rep"), F.first("bag").alias("bag"))
    index = "node long, id long, " + ", ".join(f"w{k} long" for k in range(BITS // 64))
    words = [f"w{k}" for k in range(BITS // 64)]
    share = max(1, node_rows // SEEN)
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).dropDuplicates(["key"]).select("key", "bag")
    size = F.count(F.lit(1)) * share
    hot = cut(some.mapInPandas(_nodes, index).groupBy("node").agg(size.alias("size")).where(F.col("size") > node_rows).select("node", F.ceil(F.col("size") / node_rows).cast("int").alias("n")))
    some_hot = hot.limit(HOT + 1).count()
    flat = reps.mapInPandas(_nodes, index)
    whole = flat.select(F.lit(-1).cast("byte").alias("side"), F.col("node").alias("place"), "id", *words)  # what is alike first, as it compresses better
    if some_hot:
        few = some_hot <= HOT  # then their table is small enough to be sent to all; else the rows go to it
        bi, bj = F.least("blk", "other"), F.greatest("blk", "other")
        place = F.xxhash64("node", bi, bj).bitwiseAND(F.lit(-2)).bitwiseOR(F.col("node").bitwiseAND(F.lit(1)))
        placed = (
            flat.join(F.broadcast(hot) if few else hot.hint("merge"), "node", "left")
            .withColumn("n", F.coalesce("n", F.lit(1)))
            .withColumn("blk", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .select(F.when(bi == bj, -1).otherwise((F.col("blk") == bi).cast("int")).cast("byte").alias("side"), F.when(F.col("n") == 1, F.col("node")).otherwise(place).alias("place"), "id", *words)
        )
    else:
        placed = whole
    found = placed.repartition("place").sortWithinPartitions("place", "w0").mapInPandas(_search(radius), "a long, b long").distinct()
    side = lambda s: reps.select(F.col("key").alias(s), F.col("rep").alias(f"rep_{s}"), F.col("bag").alias(f"bag_{s}"))
    links = found.join(side("a"), "a").join(side("b"), "b").mapInPandas(_verify(threshold), "a long, b long, similarity double")
    return Links(members.select("row_id", "rep"), cut(links.where("a < b").dropDuplicates(["a", "b"])))


def pairs(found: Links) -> DataFrame:
    """Every pair (id_a, id_b) of rows: linked representatives and exact copies, joined with the membership."""
    m = found.members
    a, b = m.select(F.col("row_id").alias("x"), F.col("rep").alias("a")), m.select(F.col("row_id").alias("y"), F.col("rep").alias("b"))
    linked = found.links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    copies = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return linked.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(found: Links, rounds: int = 60) -> DataFrame:
    """(row_id, class_id, links): connected classes of near-duplicates; links counts a row's linked texts.

    Least-label propagation with pointer jumping; every round is written to the shared checkpoint folder. Rounds grow
    with the logarithm of a class's diameter; the loop ends when nothing changes.
    """
    e = found.links.select("a", "b")
    edges = cut(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")))
    for _ in range(rounds):
        near = edges.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        low = label.join(near, "a").select("a", F.least("l", "m").alias("m"), F.col("l").alias("old"))
        jump = low.join(low.select(F.col("a").alias("m"), F.col("m").alias("mm")), "m", "left")
        new = cut(jump.select("a", F.least("m", F.coalesce("mm", "m")).alias("l"), "old"))
        moved = new.where("l <> old").limit(1).count()
        label = new.select("a", "l")
        if not moved:
            break
    else:
        raise RuntimeError("classes did not settle; raise rounds")
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    reps = label.join(degree, "a").select(F.col("a").alias("rep"), F.col("l"), "links")
    return found.members.join(reps, "rep", "left").select("row_id", F.coalesce("l", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
