"""Embedding, index operations and search."""

import numpy as np
from pyspark.sql import functions as F

from thicket.operators import retrieval, vectors


def index(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>")


def test_upsert_delete_verify(spark):
    old = index(spark, [("a", [1.0]), ("b", [2.0])])
    new = vectors.upsert(old, index(spark, [("b", [9.0]), ("c", [3.0]), ("d", None)]))
    assert {r[0]: r[1] for r in new.collect()} == {"a": [1.0], "b": [9.0], "c": [3.0]}
    assert sorted(r[0] for r in vectors.delete(new, index(spark, [("a", None), ("x", None)])).collect()) == ["b", "c"]
    ask = index(spark, [("a", None), ("d", None)])
    assert tuple(vectors.verify(ask, new, "chunk_id").first()) == (2, 1, False)
    assert tuple(vectors.verify(ask, new, "chunk_id", sample=1).first()) == (1, 1, True)
    assert tuple(vectors.verify(index(spark, []), new, "chunk_id").first()) == (0, 0, False)


def test_failed_batch_keeps_rows(spark):
    class Embedder:
        def embed(self, texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(10)], "i int, t string").coalesce(1)
    out = {r["i"]: (r["embedding"], r["embed_error"]) for r in vectors.embed(df, "t", Embedder(), batch=2).collect()}
    assert len(out) == 10 and out[3] == (None, "RuntimeError: no") and out[2][0] is None and out[9] == ([9.0], None)


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "Alpha beta beta"), (2, "beta ALPHA, beta!"), (3, "..."), (4, None)], "i int, t string")
    for dim in (16, 300):
        out = {r["i"]: r["embedding"] for r in vectors.hash_embedding(df, "i", "t", dim=dim).collect()}
        assert sorted(out) == [1, 2, 3] and out[1] == out[2] and len(out[1]) == dim and not any(out[3])
        assert abs(np.linalg.norm(out[1]) - 1) < 1e-9


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<float>, b array<float>")
    assert [None if r[0] is None else round(r[0], 6) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None, None]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[7] = x[11]  # a tie
    corpus = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0])], "id long, v array<double>")
    found = vectors.top_k(corpus.where("id < 20"), corpus, 5, 8, tile=64)
    got = {(r["query_id"], r["rank"]): r["id"] for r in found.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    assert got == {(q, k + 1): int(i) for q in range(20) for k, i in enumerate(np.lexsort((np.arange(300), -s[q]))[:5])}
    assert vectors.top_k(corpus.where("false"), corpus, 5, 8).count() == 0 and vectors.top_k(corpus, corpus.where("false"), 5, 8).count() == 0


def test_query_loop(spark):
    v = lambda rows: spark.createDataFrame(rows, "id long, v array<double>")
    queries, main, second = v([(1, [1.0, 0.0]), (2, [0.0, 1.0])]), v([(10, [1.0, 0.1]), (11, [-1.0, 0.0])]), v([(50, [0.0, 1.0])])
    graded = retrieval.grade(vectors.top_k(queries, main, 2, 2), 0.6)
    routed = retrieval.route(graded)
    assert {r["query_id"]: r["route"] for r in routed.collect()} == {1: "generate", 2: "fallback"}
    hits = retrieval.fallback(queries, routed, graded, second, 2, 2)
    assert sorted((r["query_id"], r["origin"], r["id"]) for r in hits.collect()) == [(1, "primary", 10), (2, "secondary", 50)]
    text = spark.createDataFrame([(10, "ten"), (50, "fifty")], "id long, text string")
    assert {r["query_id"]: r["context"] for r in retrieval.context(hits, text).collect()} == {1: "ten", 2: "fifty"}


def test_answers(spark):
    class Echo:
        def generate(self, questions, contexts):
            if "fail" in questions:
                raise RuntimeError("no")
            return [f"{q}: {c}" for q, c in zip(questions, contexts)]

    ctx = spark.createDataFrame([(1, "one")], "query_id long, context string")
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "fail")], "id long, question string")
    out = {r["query_id"]: (r["answer"], r["error"]) for r in retrieval.answer(ctx, q, Echo(), batch=1).collect()}
    assert out == {1: ("a: one", None), 2: ("b: ", None), 3: (None, "RuntimeError: no")}


def test_grader(spark):
    class Long:
        def relevant(self, questions, texts):
            if "fail" in questions:
                raise RuntimeError("no")
            return [len(t) > 2 for t in texts]

    hits = spark.createDataFrame([(1, 0.1, "q", "text"), (2, 0.9, "q", "t"), (3, 0.9, "fail", "t")], "id long, score double, question string, text string").repartition(3, "id")
    per = lambda **kw: {r["id"]: r["relevant"] for r in retrieval.grade_texts(hits, "question", "text", **kw).collect()}
    assert per()[1] is False and per()[2] is True
    assert {r["id"]: r["relevant"] for r in retrieval.grade_texts(hits.where("question = 'q'"), "question", "text", Long()).collect()} == {1: True, 2: False}
    assert {r["id"]: r["relevant"] for r in retrieval.grade_texts(hits.where("question = 'fail'"), "question", "text", Long()).collect()} == {3: True}


def test_providers():
    import pytest

    from thicket.plans import providers

    assert providers.provider("grading") is None
    providers.register("grading", lambda: "service")
    assert providers.provider("grading") == "service"
    providers.forget("grading")
    assert providers.provider("grading") is None
    with pytest.raises(ValueError):
        providers.provider("painting")
    assert providers.text_of([{"text": " a"}, "x", {"text": "b "}, {}]) == "ab" and providers.text_of(" s ") == "s"
