"""Problem 3: exact round trips, sizes, boundaries, and that edits stay local."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.llm import chunker as C


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \ńé\U0001f600", max_size=900), st.integers(8, 90), st.integers(0, 40))
def test_round_trip(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    spans = C.cuts(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(0 <= b - a <= limit for a, b in spans)
    assert text[: spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:]) == text
    assert all(y[0] == x[1] - overlap and y[1] > x[1] for x, y in zip(spans, spans[1:]))


def prose(seed, n=400):
    rng = random.Random(seed)
    return " ".join(" ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(4, 11))).capitalize() + "." for _ in range(n))


def test_natural_boundaries():
    text = prose(1)
    ends = [text[b - 2 : b] for _, b in C.cuts(text, 400, 100)[:-1]]
    assert sum(e == ". " for e in ends) >= 0.95 * len(ends)


def test_edits_stay_local():
    text = prose(2)
    at = len(text) // 2
    edited = text[:at] + " An inserted sentence of some words." + text[at:]
    a = {text[x:y] for x, y in C.cuts(text, 400, 0)}
    b = {edited[x:y] for x, y in C.cuts(edited, 400, 0)}
    assert len(b - a) <= 6 and len(a) > 60


def test_no_boundary_at_all():
    assert all(b - a <= 100 for a, b in C.cuts("x" * 1000, 100, 10))


def test_marks_stay_with_their_letter():
    text = "é" * 300
    assert all(text[b : b + 1] != "́" for _, b in C.cuts(text, 50, 5)[:-1])


def test_table(spark):
    long = prose(3, 3000)
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "short", 1), (4, "x" * 21, 1), (5, long, 1), (5, long, 1)], "id long, t string, piece_no int")
    rows = C.split_oversized(df, "id", "t", 20, 5).collect()
    by = {}
    for r in rows:
        by.setdefault(r["row_key"], []).append(r)
    assert set(by) == {3, 4, 5} and len(by[3]) == 1 and len(by[4]) == 2 and by[5][0]["pieces"] * 2 == len(by[5])
    assert all(len(r["piece"]) <= 20 and long[r["start_pos"] - 1 :].startswith(r["piece"]) for r in by[5])
    assert C.split_oversized(df.where("false"), "id", "t", 20, 5).count() == 0
    with pytest.raises(ValueError):
        C.split_oversized(df, "id", "t", 20, 20)
