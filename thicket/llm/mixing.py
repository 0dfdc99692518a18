"""Problem 8: mixing sources to target weights, by Sainte-Lague apportionment.

The target total is cut into equal blocks of tokens. Blocks are awarded one by one to the source with the highest
quotient share / (2 * blocks + 1), a source that its documents can't fill any more (repeats included) leaving the
contest; the quota of a source is then apportioned over its shards in the same way. Documents are spread over shards by
a seeded hash, and within a shard and source a seeded order, cut at the quota, says which are taken once more.

Only sums per shard and source reach the driver (shards x sources, both parameters of fixed size), and every document
finds its number of copies from the running sum of its own shard and source.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts that a source's documents are hashed into, and blocks of the whole mixture.
SHARDS, BLOCKS = 64, 20_000
SEED = 17
#: Rows of a shard's slice, give or take: what one task puts in order.
SLICE_ROWS = 200_000


def sainte_lague(weights: dict, seats: int, most: dict) -> dict:
    """Seats by highest quotients weight / (2 s + 1); nobody gets more than ``most``; ties by the order of the keys."""
    won = {k: 0 for k in weights}
    heap = [(-w, i, k) for i, (k, w) in enumerate(sorted(weights.items(), key=lambda x: str(x[0]))) if w > 0 and most[k] > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i, k = heapq.heappop(heap)
        won[k] += 1
        seats -= 1
        if won[k] < most[k]:
            heapq.heappush(heap, (-weights[k] / (2 * won[k] + 1), i, k))
    return won


def short_of(weights: dict, total: float, most: dict, block: int) -> dict[str, bool]:
    """Which sources leave the contest while their quotient is still the highest.

    The contest for the blocks of the whole size, in which nobody is full, awards every source what its weight is due; a
    source that is due more blocks than it can fill would have left at a quotient above the last one that wins a block.
    Weights needn't add up to one: what they leave is a party of its own, what they exceed more seats.
    """
    every = sum(weights.values())
    rest = {} if every >= 1 else {None: 1 - every}
    seats = round(total * max(1.0, every) / block)
    due = sainte_lague({**weights, **rest}, seats, {k: seats for k in (*weights, *rest)})
    return {s: due[s] * block > most[s] for s in weights}


def mix(sizes: DataFrame, targets: DataFrame, shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) from (doc_id, tokens, source) and (source, target_share, max_repeats).

    selection: (doc_id, source, shard, tokens, copies), copies >= 1. shares: a row per target with what it has
    (available), its most (available x max_repeats), what it was given, target and actual share, and short: whether
    the contest for the size of all documents with a source is due to give it more than its most (``short_of``; exact
    but for a block, a 20,000th of the whole).
    Sources compare in lower case without outer spaces; documents with a null or empty source, or of no tokens, take
    no part; those of sources without target only count in the total. Repeated rows count each. A target listed twice
    is an error. Empty tables: no selection, shares null.
    """
    norm = lambda c: F.lower(F.trim(c))
    wanted = {r["s"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select(norm("source").alias("s"), "target_share", "max_repeats").where("s <> ''").collect()}  # a row per source
    if len(wanted) != targets.where(F.trim("source") != "").count():
        raise ValueError("a source has two targets")
    docs = sizes.select("doc_id", F.col("tokens").cast("long").alias("tokens"), norm("source").alias("source")).where("source <> '' and tokens > 0")
    place = docs.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(shards)).cast("int"))
    total, n = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    targeted = place.where(F.col("source").isin(list(wanted)))
    have = {(r["source"], r["shard"]): int(r["t"]) for r in targeted.groupBy("source", "shard").agg(F.sum("tokens").alias("t")).collect()}  # shards x sources
    block = max(1, -(-total // blocks))
    held = {s: sum(t for (x, _), t in have.items() if x == s) for s in wanted}
    room = {(s, h): t * wanted[s][1] // block for (s, h), t in have.items()}
    most = {s: sum(r for (x, _), r in room.items() if x == s) for s in wanted}
    quota = sainte_lague({s: w for s, (w, _) in wanted.items()}, total // block, most)
    need: dict = {}
    for s, q in quota.items():
        own = {k: t for k, t in have.items() if k[0] == s}
        if q == most[s]:  # all it may give, what is less than a block included
            need |= {k: t * wanted[s][1] for k, t in own.items()}
        else:
            need |= {k: n * block for k, n in sainte_lague(own, q, {k: room[k] for k in own}).items()}
    spark = sizes.sparkSession
    quotas = spark.createDataFrame([(s, h, n, have[s, h]) for (s, h), n in need.items() if n], "source string, shard int, need long, held long")
    # A shard's order is cut into slices, so many that one is a task's work whatever the size of a source: a document's
    # place is the sum of the slices before and the running sum within its own.
    slices = max(1, -(-n // (shards * SLICE_ROWS)))
    sliced = targeted.withColumn("slice", F.least(F.floor((F.col("order") / float(2**64) + 0.5) * slices), F.lit(slices - 1)).cast("int"))
    own = ["source", "shard", "slice"]
    within = F.sum("tokens").over(Window.partitionBy(*own).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    run = sliced.withColumn("before", F.coalesce(within, F.lit(0)))
    if slices > 1:
        ahead = F.sum("t").over(Window.partitionBy("source", "shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
        sums = sliced.groupBy(*own).agg(F.sum("tokens").alias("t")).select(*own, F.coalesce(ahead, F.lit(0)).alias("ahead"))
        run = run.join(sums, own).withColumn("before", F.col("before") + F.col("ahead"))
    run = run.join(F.broadcast(quotas), ["source", "shard"])  # shards x sources rows
    copies = F.floor(F.col("need") / F.col("held")) + F.when(F.col("before") < F.col("need") % F.col("held"), 1).otherwise(0)
    selection = run.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "shard", "tokens", "copies")
    lacks = short_of({s: w for s, (w, _) in wanted.items()}, total, {s: held[s] * m for s, (_, m) in wanted.items()}, block)
    base = spark.createDataFrame([(s, w, m, held[s], held[s] * m, lacks[s]) for s, (w, m) in sorted(wanted.items())], "source string, target_share double, max_repeats int, available long, most long, short boolean")
    given = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("given"), F.max("copies").alias("copies"))
    all_given = given.agg(F.sum("given").alias("all"))
    shares = base.join(given, "source", "left").join(F.broadcast(all_given), F.lit(True), "left").select(  # one row
        "source", "target_share", "max_repeats", "available", "most", F.coalesce("given", F.lit(0)).alias("given"), F.coalesce("copies", F.lit(0)).alias("copies"), F.round(F.coalesce("given", F.lit(0)) / F.col("all"), 6).alias("actual_share"), "short"
    )
    return selection, shares
