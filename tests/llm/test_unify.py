"""Problem 5 against Python's own Unicode functions and by hand."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from thicket.llm import lookalikes as L
from thicket.llm import unify


def forms(spark, texts, extra=""):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return {r["k"]: r["canonical"] for r in unify.consistent_form(df, ["k"], "t").collect()}


SAME = [
    ("ｆｕｌｌ ｗｉｄｔｈ １２", "full width 12"), ("oﬃce ﬁle", "office file"), ("раураl", "paypal"), ("été", "été"), ("a b c d", "a b c d"), ("non‑breaking‐hyphen", "non-breaking-hyphen"),
    ("in​vis⁠i­ble﻿", "invisible"), ("q̣̇", "q̣̇"), ("q̣̇", "q̣̇"), ("Å", "Å"), ("𝐛𝐨𝐥𝐝", "bold"), ("Ωµ²½…", "Ωμ²½…"), ("Склад", "Склад"), ("Cклад", "Склад"), ("NUL\x00", "NUL"),
    ("e​́", "é"), ("́start", "́start"), ("한국어", "한국어"), ("naïve café", "naïve café"), ("ё", "ë"),
]


def test_by_hand(spark):
    assert forms(spark, [a for a, _ in SAME]) == {i: b for i, (_, b) in enumerate(SAME)}


def test_different_stay_different(spark):
    texts = ["Case", "case", "cafe", "café", "1", "¹", "a-b", "a–b", "a.b", "a,b", ""]
    out = forms(spark, texts)
    assert len(set(out.values())) == len(texts)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abEȩ̣́́̈üñ -1åṩ", max_size=25), min_size=5, max_size=40))
def test_composition_is_nfc(spark, texts):
    assert forms(spark, texts) == {i: unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}


def test_settled(spark):
    texts = [a for a, _ in SAME]
    once = forms(spark, texts)
    assert forms(spark, [once[i] for i in range(len(texts))]) == once


def test_edges(spark):
    long = "ｌong é words " * 20_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "​", "z"), (4, long, "w"), (None, "ａ", "v"), (5, "ａ", "u"), (5, "ａ", "u")], "k long, t string, __s string")
    rows = unify.consistent_form(df, ["k"], "t").collect()
    out = {r["k"]: r["canonical"] for r in rows}
    assert out[1] is None and out[2] == "" and out[3] == "" and out[4] == long.replace("ｌ", "l") and out[None] == "a" and out[5] == "a"
    assert unify.consistent_form(df.where("false"), ["k"], "t").count() == 0


def test_pairs(spark):
    df = spark.createDataFrame([(1, "pay"), (2, "рау"), (3, "pay"), (4, "Pay"), (5, "ｐay"), (6, None), (7, ""), (None, "pay")], "id long, t string")
    assert sorted(map(tuple, unify.same_look_pairs(df, "id", "t").collect())) == [(1, 2), (1, 5), (2, 3), (2, 5), (3, 5)]
    assert unify.same_look_pairs(df.where("false"), "id", "t").count() == 0


@pytest.mark.parametrize("ctx", ["latin", "cyrillic", "greek"])
def test_tables_settle(ctx):
    for ch, meant in L.CONTEXTS[ctx].items():
        assert L.decompose(meant, L.CONTEXTS[ctx]) == meant, ch
