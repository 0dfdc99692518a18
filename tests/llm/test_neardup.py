"""Problem 1 against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from thicket.llm import neardup as N


def words(n, rng):
    common = "the of and to in is it for on with".split()
    return [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(4000)}" for _ in range(n)]


def corpus(seed=5):
    rng = random.Random(seed)
    rows = []
    for g in range(60):
        base = words(rng.randint(20, 90), rng)
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.randrange(max(1, len(own) // 9))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                rng.shuffle(own)
            rows.append((len(rows) + 1, " ".join(own).capitalize() + ".", g % 3 == 0))
    rows += [(len(rows) + 1, rows[0][1], rows[0][2]), (len(rows) + 2, rows[0][1], not rows[0][2])]
    return rows


def brute(rows, t):
    bag = {i: Counter(re.findall(r"[^\W_]+", x.lower())) for i, x, _ in rows}
    kind = {i: k for i, _, k in rows}
    ids, out = sorted(bag), set()
    for a in ids:
        for b in ids:
            if a < b and kind[a] == kind[b] and bag[a] and sum((bag[a] & bag[b]).values()) >= t * sum((bag[a] | bag[b]).values()):
                out.add((a, b))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "row_id long, t string, digest boolean")
    return N.near_duplicates(df, "row_id", "t", "digest", 0.7, **kw)


@pytest.mark.parametrize("node_rows, hot", [(2048, 500_000), (3, 500_000), (3, 0)])
def test_all_pairs(spark, monkeypatch, node_rows, hot):
    monkeypatch.setattr(N, "HOT", hot)
    rows = corpus()
    want = brute(rows, 0.7)
    got = {tuple(r) for r in N.pairs(run(spark, rows, node_rows=node_rows)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 50


def test_class_of_near_copies_that_is_a_third_of_all_rows(spark):
    rng = random.Random(3)
    base, rows = words(70, rng), []
    for i in range(900):
        own = list(base) if i % 3 == 0 else words(70, rng)
        if i % 3 == 0:
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(70)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), False))
    want = brute(rows, 0.7)
    got = {tuple(r) for r in N.pairs(run(spark, rows, node_rows=64)).collect()}
    assert len(want) > 40_000 and got <= want and len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("edits", [(5, 6), (8, 12)])
def test_hot_class_with_many_edits(spark, edits):
    """A third of all rows are edited copies of one text: what they share is common, their edits are not."""
    rng = random.Random(17)
    base, rows = [f"b{k}" for k in range(70 if edits[1] < 8 else 140)], []
    for i in range(450):
        own = list(base) if i % 3 == 0 else words(70, rng)
        if i % 3 == 0:
            for k in rng.sample(range(len(own)), rng.randint(*edits)):
                own[k] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), False))
    want = brute(rows, 0.7)
    got = {tuple(r) for r in N.pairs(run(spark, rows)).collect()}
    assert len(want) > 2_000 and got <= want and len(got) >= 0.99 * len(want)


def test_classes(spark):
    rows = corpus(8)
    links = run(spark, rows)
    pairs = {tuple(r) for r in N.pairs(links).collect()}
    parent = {i: i for i, _, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {r["row_id"]: r["class_id"] for r in N.groups(links).collect()} == {i: root(i) for i, _, _ in rows}


def test_edges(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(1, same, False), (2, "Оne twο three four five six seven eight nine ten!", False), (3, None, False), (4, "", False), (5, "... --", False), (None, same, False), (6, same, None), (7, same, True), (8, "a " * 50_000, False), (9, "a " * 50_001, False), (1, same, False)]
    got = {tuple(r) for r in N.pairs(run(spark, rows)).collect()}
    assert got == {(1, 2), (1, 6), (2, 6), (8, 9)}
    assert N.pairs(run(spark, rows[:0])).count() == 0 and N.groups(run(spark, rows[:0])).count() == 0


def test_repeats_count(spark):
    rows = [(1, "a a a b", False), (2, "a a b", False), (3, "a b", False)]
    assert {tuple(r) for r in N.pairs(run(spark, rows)).collect()} == {(1, 2)}


def test_counts_never_drop_a_linked_pair():
    rng = random.Random(9)
    rows = corpus(4) + [(10_000 + n, "a " * n + " ".join(words(20, rng)), False) for n in (10, 14, 15, 16, 20, 300, 301)]
    _, e, row = N.bags([t for _, t, _ in rows])
    c = N.counts(e, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
    x, y = np.triu_indices(len(rows), 1)
    may = {(rows[i][0], rows[j][0]) for i, j, m in zip(x, y, N.may_agree(c, x, y, 0.7)) if m}
    assert brute([(i, t, False) for i, t, _ in rows], 0.7) <= {(min(p), max(p)) for p in may} and len(may) < len(x) / 10


def test_gray_order():
    x = np.arange(1 << 12, dtype=np.uint64)
    g = N.gray_code(x)
    assert (N.gray_rank(g) == x).all() and (np.bitwise_count(g[1:] ^ g[:-1]) == 1).all()


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 40, dtype=np.uint64)
    r1 = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 60, 40, dtype=np.uint64)) for _ in range(12)])
    r1 = r1[np.argsort(N.gray_rank(r1))]
    r2 = rng.integers(0, 1 << 60, len(r1), dtype=np.uint64) & np.uint64(0xF)
    for radius in (0, 3, 12, 40):
        i, j = N.search_node(r1, r2, radius)
        a, b = np.triu_indices(len(r1), 1)
        near = np.bitwise_count(r1[a] ^ r1[b]).astype(int) + np.bitwise_count(r2[a] ^ r2[b]) <= radius
        assert set(zip(i.tolist(), j.tolist())) == set(zip(a[near].tolist(), b[near].tolist()))


def test_rows_that_are_not_alike_seldom_meet():
    """Such pairs grow with the square of the table, so their share decides whether large tables end in time."""
    assert N.MASKS * 0.2**N.PER_MASK < 0.02 and (1 - 0.7**N.PER_MASK) ** N.MASKS < 3e-4
    rng = random.Random(31)
    _, e, row = N.bags([" ".join(f"w{rng.randrange(120)}" for _ in range(60)) for _ in range(1500)])
    nodes = N.patterns(N.slots(e, np.flatnonzero(np.r_[True, row[1:] != row[:-1]])), np.zeros(1500, np.int64))
    _, size = np.unique(nodes, return_counts=True)
    assert (size * (size - 1) // 2).sum() < 0.05 * 1500 * 1499 / 2


def test_pairs_at_the_threshold_meet():
    rng, texts = random.Random(12), []
    for k in range(3000):  # 70 words in common of 100 or fewer
        both, own = [f"b{k}x{i}" for i in range(70)], rng.randint(24, 30)
        first = rng.randint(0, own)
        texts += [" ".join(both + [f"u{k}x{i}" for i in range(first)]), " ".join(both + [f"v{k}x{i}" for i in range(own - first)])]
    _, e, row = N.bags(texts)
    s = N.slots(e, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
    nodes, words = N.patterns(s, np.zeros(len(texts), np.int64)), N.residual(s)
    meet = (nodes[::2] == nodes[1::2]).any(1)
    near = sum(np.bitwise_count(w[::2] ^ w[1::2]).astype(int) for w in words) <= N.RADIUS
    assert (meet & near).mean() > 0.998


@pytest.mark.parametrize("n", [40, 300, 1000])
def test_index_of_more_words_finds_what_a_scan_finds(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 63, (3, 20), dtype=np.uint64)[:, rng.integers(0, 20, n)]
    words = [w ^ (np.uint64(1) << rng.integers(0, 63, n, dtype=np.uint64)) for w in base]
    words = [w[np.argsort(N.gray_rank(words[0]))] for w in words]
    a, b = np.triu_indices(n, 1)
    bits = sum(np.bitwise_count(w[a] ^ w[b]).astype(int) for w in words)
    for radius in (0, 5, 90, 192):
        i, j = N.search_node(words[0], words[1], radius, words[2])
        assert len(i) == (bits <= radius).sum() and set(zip(i.tolist(), j.tolist())) == set(zip(a[bits <= radius].tolist(), b[bits <= radius].tolist()))


def test_blocks_from_estimated_sizes_lose_nothing(spark):
    rng = random.Random(8)
    base, rows = words(60, rng), []
    for i in range(700):
        own = list(base)
        for k in rng.sample(range(60), rng.randint(1, 9)):
            own[k] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(own), i % 7 == 0))
    found = [{tuple(r) for r in N.pairs(run(spark, rows, **kw)).collect()} for kw in ({}, {"node_rows": 2 * N.SEEN})]
    assert found[0] == found[1] and len(found[0]) > 100_000
