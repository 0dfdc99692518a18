"""Problem 9: measures against plain Python, and bands of texts that differ clearly."""

import math
import random
import re
from collections import Counter

from thicket.llm import readability as R

EASY, HARD = "the cat sat on a mat and it is red now".split(), "notwithstanding interdisciplinary characterisation presupposes methodological considerations regarding operationalisation".split()


def text(words, per, rng, n=90):
    out = []
    while sum(map(len, out)) < n:
        out.append([rng.choice(words) for _ in range(per)])
    return " ".join(" ".join(s).capitalize() + "." for s in out)


def corpus():
    rng = random.Random(4)
    rows = [(i, text(EASY, 6, rng)) for i in range(40)] + [(100 + i, text(EASY[:6] + HARD, 25, rng)) for i in range(40)]
    return rows


def test_measures(spark):
    rows = [*corpus(), (500, None), (501, ""), (502, "12 34."), (503, "One\n\n- two\n- three"), (504, "Ärger: über 3 Übel!")]
    df = spark.createDataFrame(rows, "doc_id long, t string")
    got = {r["doc_id"]: r for r in R.measures(df, "doc_id", "t").collect()}
    words = {i: re.findall(r"[^\W\d_]+", t.lower()) for i, t in rows if t}
    count = Counter(w for ws in words.values() for w in ws)
    rank = {w: sum(1 for m in count.values() if m >= n) for w, n in count.items()}
    assert set(got) == {i for i, w in words.items() if w}
    for i, r in got.items():
        own = sorted(rank[w] for w in words[i])
        assert r["coverage_rank"] == own[math.ceil(0.5 * len(own)) - 1] and r["words"] == len(own)
        assert abs(r["sentence"] - math.log(r["sentence_words"])) < 1e-5 and r["language"] == "other"
    assert abs(got[503]["sentence_words"] - 1) < 1e-9


def test_languages(spark):
    """Words rank within their language; documents without a code get the language whose frequent words they hold."""
    rows = [(i, "the cat and the dog", "en") for i in range(60)] + [(100 + i, "der Hund und der Vogel", ["de", "DE-at", " De "][i % 3]) for i in range(30)]
    rows += [(200, "und der Hund der Vogel", None), (201, "the dog", "und"), (202, "zzz", "xx?"), (203, "ett ord", "sv")]
    df = spark.createDataFrame(rows, "doc_id long, t string, lang string")
    got = {r["doc_id"]: r for r in R.measures(df, "doc_id", "t", "lang").collect()}
    assert [got[i]["language"] for i in (0, 101, 102, 200, 201, 202, 203)] == ["en", "de", "de", "de", "en", "en", "other"]
    assert got[0]["coverage_rank"] == got[1]["coverage_rank"] and got[101]["coverage_rank"] == 4
    assert len(got) == len(rows)


def test_calibration_by_language(spark):
    """Bands lie elsewhere in another language, and what raters a band off leave there is no band."""
    rng = random.Random(5)
    rows, labels = [], []
    for lang, shift in (("en", 0.0), ("de", -1.5)):
        for i in range(80):
            band = 1 if i % 2 else 4
            key = i + (0 if lang == "en" else 1000)
            rows.append((key, lang, 3.0 + shift + band / 2 + rng.gauss(0, 0.1), 2.0 + rng.gauss(0, 0.3)))
            if i < 40:
                labels.append((key, 3 if band == 4 and i == 0 else band))
    m = spark.createDataFrame(rows, "doc_id long, language string, coverage double, sentence double")
    got = {r["doc_id"]: r["band"] for r in R.levels(m, spark.createDataFrame(labels, "doc_id long, band int")).collect()}
    assert all(got[k] == (1 if k % 2 else 4) for k in got) and len(got) == 160
    few = spark.createDataFrame([x for x in labels if x[0] < 1000], "doc_id long, band int")
    assert len({r["band"] for r in R.levels(m, few).where("language = 'de'").collect()}) == 1  # by the ratings of all: wrong there, but defined


def test_rare_words_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(R, "HEAD", 5)
    df = spark.createDataFrame(corpus(), "doc_id long, t string")
    few = {r["doc_id"]: r["coverage_rank"] for r in R.measures(df, "doc_id", "t").collect()}
    monkeypatch.setattr(R, "HEAD", 20_000)
    assert few == {r["doc_id"]: r["coverage_rank"] for r in R.measures(df, "doc_id", "t").collect()}


def test_bands(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, t string")
    rng = random.Random(9)
    truth = {i: 1 if i < 100 else 4 for i, _ in rows}
    labels = [(i, "a", b if rng.random() > 0.15 else {1: 2, 4: 3}[b]) for i, b in truth.items() if i % 2] + [(1, "b", None), (9999, "b", 3)]
    ld = spark.createDataFrame(labels, "doc_id long, rater string, band int")
    m = R.measures(df, "doc_id", "t")
    got = {r["doc_id"]: r["band"] for r in R.levels(m, ld).collect()}
    assert all((got[i] >= 3) == (b == 4) for i, b in truth.items())
    assert all(r["band"] is None for r in R.levels(m, ld.where("false")).collect())
    assert R.levels(R.measures(df.where("false"), "doc_id", "t"), ld).count() == 0
