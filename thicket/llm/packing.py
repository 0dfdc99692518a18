"""Problem 7: filling containers of fixed capacity, by linear grouping.

Only the histogram of sizes reaches the driver: at most ``capacity`` rows, whatever the corpus. There,

1. large sizes (over ``capacity / SMALL``) are put into groups of equal cardinality, each rounded up to its largest;
2. the few rounded sizes are packed by configurations, found by column generation on the cutting-stock relaxation,
   rounded down, the rest first-fit;
3. the actual sizes take the places of the rounded ones, which leaves containers of a few kinds, each kind with its
   count and room;
4. small sizes, largest first, go to the kind with the least sufficient room, and open containers where none is left.

The plan is a table of runs: items of one size with ranks lo..hi fill containers from one number on, so many each.
Documents get their rank within their size in parallel (a salted count, so that one size may hold a third of all rows)
and find their container by a search in the runs.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sizes over capacity / SMALL are large; GROUPS groups of equal cardinality; SALT parts of the rank of one size.
SMALL, GROUPS, SALT = 6, 48, 64

Run = tuple[int, int, int, int, int]  # size, first rank, number of items, first container, items in each


def _best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    low = int(sizes.min())
    for c in range(low, capacity + 1):
        fit = c - sizes
        gain = np.where(fit >= 0, best[np.maximum(fit, 0)] + value, -1.0)
        k = int(gain.argmax())
        best[c], last[c] = (gain[k], k) if gain[k] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    count, c = np.zeros(len(sizes), int), capacity
    while c >= low:
        if last[c] < 0:
            c -= 1
        else:
            count[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(best[capacity]), count


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """[(items of each size, containers)] that cover the demand exactly: the relaxation rounded down, the rest first-fit decreasing."""
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(40 * n):
        worth, column = _best_configuration(sizes, np.linalg.solve(basis.T, np.ones(n)), capacity)
        if worth <= 1 + 1e-7:
            break
        x, d = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis, column.astype(float))
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, demand.astype(float))
    left, out = demand.copy(), []
    for k in range(n):
        column = basis[:, k].round().astype(int)
        times = int(max(0, np.floor(x[k] + 1e-9)))
        if column.any():
            times = min([times, *(left[column > 0] // column[column > 0])])
        if times:
            out.append((column, int(times)))
            left = left - column * times
    while left.any():  # a few containers per configuration at most
        column, room = np.zeros(n, int), capacity
        for k in np.argsort(-sizes):
            column[k] = min(left[k], room // sizes[k])
            room -= column[k] * int(sizes[k])
        times = int((left[column > 0] // column[column > 0]).min())
        out.append((column, times))
        left = left - column * times
    return out


class _Rooms:
    """Containers by the room that is left in them: room -> ranges of container numbers."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []

    def add(self, room: int, start: int, count: int) -> None:
        if count > 0 and room > 0:
            if not self.by.get(room):
                bisect.insort(self.rooms, room)
            self.by[room].append((start, count))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """A range with the least room of at least ``size``."""
        i = bisect.bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        start, count = self.by[room].pop()
        if not self.by[room]:
            del self.rooms[i]
        return room, start, count


def plan(hist: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place every item of the histogram (size -> number), and the number of containers."""
    runs: list[Run] = []
    used: dict[int, int] = defaultdict(int)
    rooms, opened = _Rooms(), 0
    large = sorted((s for s in hist if s > capacity // SMALL), reverse=True)
    if large:
        total = sum(hist[s] for s in large)
        per = max(1, -(-total // GROUPS))
        groups: list[list[list[int]]] = []  # of [size, number], sizes falling
        room = 0
        for s in large:
            n = hist[s]
            while n:
                if not room:
                    groups.append([])
                    room = per
                m = min(n, room)
                groups[-1].append([s, m])
                n -= m
                room -= m
        merged: dict[int, list[list[int]]] = defaultdict(list)
        for g in groups:
            merged[g[0][0]] += g
        tops = np.array(sorted(merged, reverse=True))
        demand = np.array([sum(m for _, m in merged[t]) for t in tops])
        for column, times in configurations(tops, demand, capacity):
            done = 0
            while done < times:  # containers alike in every actual size
                step, room, taken = times - done, capacity, []
                for k in np.flatnonzero(column):
                    stock, need = merged[tops[k]], int(column[k])
                    if stock[0][1] >= need:
                        step = min(step, stock[0][1] // need)
                        taken.append([(stock[0][0], need)])
                    else:  # a container over a change of size
                        step, mixed, i = 1, [], 0
                        while need:
                            m = min(need, stock[i][1])
                            mixed.append((stock[i][0], m))
                            need -= m
                            i += 1
                        taken.append(mixed)
                for k, mixed in zip(np.flatnonzero(column), taken):
                    stock = merged[tops[k]]
                    for s, m in mixed:
                        runs.append((s, used[s], m * step, opened, m))
                        used[s] += m * step
                        stock[0][1] -= m * step
                        room -= s * m
                        if not stock[0][1]:
                            stock.pop(0)
                rooms.add(room, opened, step)
                opened += step
                done += step
    for s in sorted((s for s in hist if 0 < s <= capacity // SMALL), reverse=True):
        left = hist[s]
        while left:
            got = rooms.take(s)
            if got is None:
                room, start, count = capacity, opened, -(-left // (capacity // s))
                opened += count
            else:
                room, start, count = got
            each = room // s
            full = min(count, left // each)
            if full:
                runs.append((s, used[s], full * each, start, each))
                used[s] += full * each
                left -= full * each
                rooms.add(room - each * s, start, full)
            if left and full < count:
                runs.append((s, used[s], left, start + full, left))
                used[s] += left
                rooms.add(room - left * s, start + full, 1)
                left, full = 0, full + 1
            rooms.add(room, start + full, count - full)
    return runs, opened


def _place(runs: list[Run]):
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    keys = (table[:, 0] << 40) | table[:, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rank = pdf["rank"].to_numpy(np.int64)
            r = table[np.searchsorted(keys, (pdf["tokens"].to_numpy(np.int64) << 40) | rank, side="right") - 1]
            yield pdf.assign(container=r[:, 3] + (rank - r[:, 1]) // r[:, 4])[["doc_id", "piece_no", "pieces", "tokens", "container"]]

    return run


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, pieces, tokens, container): every document of (doc_id, tokens) in a container of the capacity.

    A document over the capacity is cut into full pieces, each a container of its own, and a rest that is packed as an
    item; no other is cut. Documents of null or no size take no part. Repeated rows are packed each. Ties in size are
    taken in the order of the ids. An empty table gives no rows. Container numbers start at 0, full pieces after them.
    """
    if not 0 < capacity < 1 << 22:
        raise ValueError("the capacity must be positive and below 4,194,304")
    base = sizes.select("doc_id", F.col("tokens").cast("long").alias("size")).where("size > 0")
    pieces = base.select("doc_id", F.ceil(F.col("size") / capacity).cast("int").alias("pieces"), "size")
    full = pieces.where(F.col("size") >= capacity).select("doc_id", "pieces", F.explode(F.sequence(F.lit(1), F.floor(F.col("size") / capacity).cast("int"))).alias("piece_no"), F.lit(capacity).cast("long").alias("tokens"))
    rest = pieces.where(F.col("size") % capacity > 0).select("doc_id", "pieces", F.col("pieces").alias("piece_no"), (F.col("size") % capacity).alias("tokens")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    part = rest.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("n"))
    hist = {int(r["tokens"]): int(r["n"]) for r in part.groupBy("tokens").agg(F.sum("n").alias("n")).collect()}  # below capacity rows
    runs, opened = plan(hist, capacity)
    before = part.withColumn("off", F.sum("n").over(Window.partitionBy("tokens").orderBy("salt")) - F.col("n")).select("tokens", "salt", "off")
    own = F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = rest.withColumn("own", own).join(before, ["tokens", "salt"]).select("doc_id", "piece_no", "pieces", "tokens", (F.col("own") + F.col("off")).cast("long").alias("rank"))
    key = sizes.schema["doc_id"].dataType.simpleString()
    placed = ranked.mapInPandas(_place(runs), f"doc_id {key}, piece_no int, pieces int, tokens long, container long") if runs else rest.select("doc_id", "piece_no", "pieces", "tokens", F.lit(0).cast("long").alias("container"))
    alone = full.select("doc_id", "piece_no", "pieces", "tokens", (F.lit(opened) + F.monotonically_increasing_id()).alias("container"))
    return placed.unionByName(alone)


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of room that is filled."""
    c = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    out = c.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.max("t").alias("fullest"))
    return out.select("*", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.when(F.col("containers") > 0, F.round(F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6)).alias("filled"))
