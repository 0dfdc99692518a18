"""Change detection, ledger, gates."""

import datetime as dt

from thicket.operators import changes as C
from thicket.operators import gates

H1, H2 = "1" * 64, "2" * 64


def tables(spark, ledger, disk):
    return spark.createDataFrame(disk, "file_name string, content_hash string"), spark.createDataFrame(ledger, "file_name string, content_hash string, chunk_count int")


def test_classes(spark):
    disk, ledger = tables(
        spark,
        [("same.pdf", H1, 3), ("edited.pdf", H1, 3), ("gone.pdf", H1, 2), ("gone0.pdf", H1, 0), ("broken.pdf", "error: no access", 1), ("kept.txt", H1, 1)],
        [("new.pdf", H1), ("same.pdf", H1), ("edited.pdf", H2), ("UPPER.PDF", H1), ("a.txt", H1), ("broken.pdf", "error: no access"), ("kept.txt", H1), ("noext", H1)],
    )
    c = C.classify(disk, ledger)
    assert {r["file_name"]: r["change"] for r in c.collect()} == {
        "new.pdf": "new", "UPPER.PDF": "new", "same.pdf": "unchanged", "edited.pdf": "modified", "gone.pdf": "deleted", "gone0.pdf": "deleted",
        "a.txt": "ignored", "noext": "ignored", "kept.txt": "ignored", "broken.pdf": "modified",
    }
    assert sorted(r["chunk_id"] for r in C.stale_ids(c).collect()) == ["broken.pdf::1", "edited.pdf::1", "edited.pdf::2", "edited.pdf::3", "gone.pdf::1", "gone.pdf::2"]
    todo = C.pending(c, spark.createDataFrame([("new.pdf",)], "file_name string"), spark.createDataFrame([("broken.pdf",)], "file_name string"))
    assert sorted(r["file_name"] for r in todo.collect()) == ["UPPER.PDF", "edited.pdf"]


def test_upsert_and_delete(spark):
    t0, t1 = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
    s = "file_name string, content_hash string, status string, chunk_count int, last_indexed_at timestamp"
    ledger = spark.createDataFrame([("a", H1, "indexed", 1, t1), ("b", H1, "indexed", 1, t0)], s)
    new = C.ledger_upsert(ledger, spark.createDataFrame([("a", H2, "indexed", 5, t0), ("c", H1, "indexed", 2, None), ("c", H2, "indexed", 3, t0)], s))
    assert {r["file_name"]: (r["content_hash"], r["chunk_count"]) for r in new.collect()} == {"a": (H2, 5), "b": (H1, 1), "c": (H2, 3)}
    left = C.ledger_delete(new, spark.createDataFrame([("b",), ("zzz",)], "file_name string"))
    assert sorted(r["file_name"] for r in left.collect()) == ["a", "c"]
    found = C.ledger_lookup(spark.createDataFrame([("a",), ("q",)], "file_name string"), ledger).collect()
    assert {r["file_name"]: r["ledger_chunks"] for r in found} == {"a": 1, "q": None}


def test_attempts(spark):
    e = spark.createDataFrame([("a", "load", 1), ("a", "load", 3), ("b", None, 2)], "file_name string, stage string, attempt int")
    assert sorted(map(tuple, C.attempts(e).collect())) == [("a", "load", 2, 3), ("b", "unknown", 1, 2)]
    earlier = spark.createDataFrame([("z",), ("a",)], "file_name string")
    assert sorted(r[0] for r in C.exhausted(e, earlier).collect()) == ["a", "z"]


def test_latest(spark):
    t = dt.datetime(2026, 1, 1)
    d = spark.createDataFrame([(1, "a", t), (2, "a", t), (3, "a", None), (4, "b", None)], "load_id long, file_name string, loaded_at timestamp")
    assert sorted((r["file_name"], r["load_id"]) for r in C.latest(d).collect()) == [("a", 2), ("b", 4)]


def test_hash(spark):
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(C.content_hash(df["t"])).collect()] == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", None]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "content_to_embed string, embedding array<float>, metadata struct<file_name:string,is_table_summary:boolean>")


def test_gates(spark):
    good = chunks(spark, [("some text", [1.0], ("f", None)), ("a summary of it", [1.0], ("f", True))])
    assert gates.gate_chunks(good).first()["decision"] == "embed" and gates.gate_embeddings(good).first()["decision"] == "index"
    short = chunks(spark, [("too short", None, ("f", True)), ("  ", [1.0], ("g", None)), (None, [1.0], ("g", None))])
    assert gates.gate_chunks(short).first()["malformed"] == 3 and gates.gate_embeddings(short).first()["decision"] == "retry"
    none = chunks(spark, [])
    assert gates.gate_chunks(none).first()["decision"] == "retry" and gates.gate_embeddings(none).first()["decision"] == "retry"
    h = spark.createDataFrame([("f", H1), ("none", H2)], "file_name string, content_hash string")
    assert {r["file_name"]: r["chunk_count"] for r in gates.chunks_per_file(good, h).collect()} == {"f": 2, "none": 0}


def test_gate_load(spark):
    f = lambda *x: spark.createDataFrame([(i,) for i in x], "file_name string")
    a = spark.createDataFrame([("b", 3), ("c", 1)], "file_name string, attempt int")
    assert gates.gate_load(f("a", "b", "c"), f("a"), a, 3).first()["decision"] == "retry"
    assert gates.gate_load(f("a", "b"), f("a"), a, 3).first()["decision"] == "split"
    assert gates.gate_load(f("b"), f(), a, 3).first()["decision"] == "exit"
