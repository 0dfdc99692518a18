"""Files, converters, versioned tables and the whole ingestion through its states."""

import io
import zipfile

import pytest

from thicket.plans.errors import StageError, stage
from thicket.plans.ingestion import Ingestion
from thicket.sources import converters, files, store

HTML = "<html><head><title>t</title><script>x()</script></head><body><nav>menu</nav><h1>Title</h1><p>One <b>two</b>\n three &amp; four</p><ul><li>a</li><li>b</li></ul><table><tr><th>k</th><th>v|w</th></tr><tr><td>1</td></tr></table><pre>a  b\nc</pre><footer>f</footer></body></html>"
MARKDOWN = "# Title\n\nOne two three & four\n\n- a\n- b\n\n| k | v\\|w |\n| --- | --- |\n| 1 |  |\n\n```\na  b\nc\n```"


def docx(*paragraphs, table=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table or [])
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}{'<w:tbl>' + rows + '</w:tbl>' if rows else ''}</w:body></w:document>")
    return b.getvalue()


def test_converters():
    assert converters.html_to_markdown(HTML) == MARKDOWN
    assert converters.docx_to_markdown(docx(("Heading1", "T"), ("Normal", "body"), ("ListBullet", "x"), table=[["a", "b"], ["1", "2"]])) == "# T\n\nbody\n\n- x\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert converters.html_to_markdown("") == "" and converters.html_to_markdown("plain") == "plain"


def test_scan_and_quarantine(spark, tmp_path):
    (tmp_path / "a b+c.HTML").write_text(HTML)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.html").write_text(HTML)
    found = files.scan(spark, str(tmp_path))
    assert sorted(r["file_name"] for r in found.select("file_name").collect()) == ["a b+c.HTML", "bad.docx", "x.pdf"]
    good, bad = files.load(found)
    assert [(r["file_name"], r["markdown_content"]) for r in good.collect()] == [("a b+c.HTML", MARKDOWN)]
    assert sorted(r["file_name"] for r in bad.collect()) == ["bad.docx", "x.pdf"]


def test_store(spark, tmp_path):
    s = store.vector_index(spark, str(tmp_path / "ix"), 1)
    assert s.read().count() == 0 and s.settings() == {"dimension": 1, "metric": "cosine"}
    row = [("a::1", "text", "t", "t", ("a", False, False, None, None), [1.0])]
    for n in range(3):
        s.write(s.read().unionByName(spark.createDataFrame(row, store.CHUNKS)))
    assert s.read().count() == 3 and store.vector_index(spark, str(tmp_path / "ix"), 1).version() == 3
    with pytest.raises(ValueError):
        store.vector_index(spark, str(tmp_path / "ix"), 65)


@pytest.mark.parametrize("gone", ["NEXT", "CURRENT.3"])
def test_store_survives_a_crash(spark, tmp_path, gone):
    """Between the data and the pointer, and between the pointer and the removal of the one before."""
    s = store.ledger(spark, str(tmp_path / "l"))
    rec = lambda n: spark.createDataFrame([(n, "h", "indexed", 1, None)], store.LEDGER)
    for n in ("a", "b", "c"):
        s.change(rec(n), lambda old: old.unionByName(rec(n)))
    if gone == "NEXT":
        (tmp_path / "l" / "NEXT").write_text("{half")
        (tmp_path / "l" / "v4").mkdir()
    else:
        (tmp_path / "l" / gone).unlink()
    again = store.ledger(spark, str(tmp_path / "l"))
    assert {r["file_name"] for r in again.read().collect()} == ({"a", "b", "c"} if gone == "NEXT" else {"a", "b"})
    again.change(rec("d"), lambda old: old.unionByName(rec("d")))
    assert {r["file_name"] for r in again.read().collect()} == ({"a", "b", "c", "d"} if gone == "NEXT" else {"a", "b", "d"})


def test_store_is_not_created_over_data(spark, tmp_path):
    s = store.ledger(spark, str(tmp_path / "l"))
    s.write(spark.createDataFrame([("a", "h", "indexed", 1, None)], store.LEDGER))
    for p in (tmp_path / "l").glob("CURRENT.*"):
        p.unlink()
    with pytest.raises(RuntimeError):
        store.ledger(spark, str(tmp_path / "l"))


def test_store_touches_named_parts_only(spark, tmp_path):
    s = store.ledger(spark, str(tmp_path / "l"), parts=16)
    frame = lambda names: spark.createDataFrame([(n, "h", "indexed", 1, None) for n in names], store.LEDGER)
    s.write(frame([f"f{i}" for i in range(40)]))
    s.change(frame(["f7"]).select("file_name"), lambda old: old.where("file_name <> 'f7'"))
    assert {r["file_name"] for r in s.read().collect()} == {f"f{i}" for i in range(40)} - {"f7"}
    assert len([p for p in (tmp_path / "l" / "v2").glob("part=*")]) <= 1
    with pytest.raises(ValueError):
        s.change(frame(["f7"]).select("file_name"), lambda old: frame([f"g{i}" for i in range(40)]))
    assert s.read().count() == 39


def test_vectors_of_another_dimension_are_refused(spark, tmp_path):
    s = store.vector_index(spark, str(tmp_path / "ix"), 2)
    row = lambda v: spark.createDataFrame([("a::1", "text", "t", "t", ("a", False, False, None, None), v)], store.CHUNKS)
    s.write(row([1.0, 2.0]))
    with pytest.raises(Exception, match="in an index of 2"):
        s.write(row([1.0]))
    assert s.read().count() == 1


def rows(s):
    return {r["chunk_id"] for r in s.read().collect()}


def test_states(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ledger, index = store.ledger(spark, str(tmp_path / "ledger")), store.vector_index(spark, str(tmp_path / "index"), 64)
    run = lambda **kw: Ingestion(spark, ledger, index, **kw).run(str(folder))
    table = "<table><tr><td>a</td></tr><tr><td>1</td></tr></table>"
    (folder / "a.html").write_text(f"<h1>A</h1><p>text</p>{table}<p>tail</p>")
    (folder / "b.html").write_text("<p>b</p>")
    (folder / "c.pdf").write_bytes(b"%PDF")
    first = run()
    assert first.status == "INDEXED" and first.changes == {"new": 3} and [f for f, _ in first.failed] == ["c.pdf"] and first.retries == {"load": 2}
    assert rows(index) == {"a.html::1", "a.html::2", "a.html::3", "b.html::1"}
    assert {r["file_name"]: r["chunk_count"] for r in ledger.read().collect()} == {"a.html": 3, "b.html": 1}
    assert all(r["raw_payload"] and len(r["embedding"]) == 64 for r in index.read().collect())

    (folder / "c.pdf").unlink()
    assert run().status == "END"  # unchanged

    (folder / "a.html").write_text("<p>short</p>")
    (folder / "b.html").unlink()
    again = run()
    assert again.changes == {"modified": 1, "deleted": 1} and rows(index) == {"a.html::1"}
    assert {r["file_name"]: r["chunk_count"] for r in ledger.read().collect()} == {"a.html": 1}

    (folder / "a.html").unlink()
    (folder / "empty.html").write_text("<p></p>")
    gone = run()
    assert gone.status == "CHUNKS_FAILED" and gone.chunks == 0


def test_failed_reload_keeps_vectors(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ledger, index = store.ledger(spark, str(tmp_path / "l")), store.vector_index(spark, str(tmp_path / "i"), 64)
    (folder / "a.docx").write_bytes(docx(("Normal", "hello")))
    (folder / "b.html").write_text("<p>b</p>")
    Ingestion(spark, ledger, index).run(str(folder))
    (folder / "a.docx").write_bytes(b"broken")
    (folder / "b.html").write_text("<p>changed</p>")
    out = Ingestion(spark, ledger, index).run(str(folder))
    assert [f for f, _ in out.failed] == ["a.docx"] and rows(index) == {"a.docx::1", "b.html::1"}
    assert Ingestion(spark, ledger, index).run(str(folder)).changes == {"modified": 1, "unchanged": 1}  # tried again next time


@pytest.mark.parametrize("name, content, status", [("c.pdf", b"%PDF", "LOAD_FAILED"), ("empty.html", b"<p></p>", "CHUNKS_FAILED")])
def test_deleted_files_go_when_nothing_loads(spark, tmp_path, name, content, status):
    folder = tmp_path / "in"
    folder.mkdir()
    ledger, index = store.ledger(spark, str(tmp_path / "l")), store.vector_index(spark, str(tmp_path / "i"), 64)
    (folder / "a.html").write_text("<p>a</p>")
    (folder / "b.html").write_text("<p>b</p>")
    Ingestion(spark, ledger, index).run(str(folder))
    (folder / "a.html").unlink()
    (folder / name).write_bytes(content)
    assert Ingestion(spark, ledger, index).run(str(folder)).status == status
    assert rows(index) == {"b.html::1"} and [r["file_name"] for r in ledger.read().collect()] == ["b.html"]


def test_names_with_signs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ledger, index, seen = store.ledger(spark, str(tmp_path / "l")), store.vector_index(spark, str(tmp_path / "i"), 64), store.seen(spark, str(tmp_path / "s"))
    for name in ("a+b.html", "c d.html", "e%2Bf.html", "[g]{h}.html"):
        (folder / name).write_text(f"<p>{name}</p>")
    run = lambda: Ingestion(spark, ledger, index, seen=seen).run(str(folder))
    assert run().changes == {"new": 4}
    assert rows(index) == {"a+b.html::1", "c d.html::1", "e%2Bf.html::1", "[g]{h}.html::1"}
    assert run().changes == {"unchanged": 4}
    (folder / "a+b.html").write_text("<p>other</p>")
    (folder / "c d.html").unlink()
    assert run().changes == {"unchanged": 2, "modified": 1, "deleted": 1}
    assert {r["chunk_id"]: r["raw_payload"] for r in index.read().collect()}["a+b.html::1"] == "other"


def test_seen_files_are_not_opened(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    ledger, index, seen = store.ledger(spark, str(tmp_path / "l")), store.vector_index(spark, str(tmp_path / "i"), 64), store.seen(spark, str(tmp_path / "s"))
    (folder / "a.html").write_text("<p>a</p>")
    (folder / "b.html").write_text("<p>b</p>")
    Ingestion(spark, ledger, index, seen=seen).run(str(folder))
    (folder / "a.html").chmod(0)  # not readable any more, unless by the superuser
    (folder / "b.html").write_text("<p>longer</p>")
    out = Ingestion(spark, ledger, index, seen=seen).run(str(folder))
    assert out.changes == {"unchanged": 1, "modified": 1} and seen.read().count() == 2 and rows(index) == {"a.html::1", "b.html::1"}


def test_a_table_that_fails_holds_up_its_file_only(spark, tmp_path):
    from thicket.plans import providers

    class Fails:
        def summaries(self, tables):
            if any("bad" in t for t in tables):
                raise RuntimeError("no")
            return [f"a summary of {len(t)}" for t in tables]

    folder = tmp_path / "in"
    folder.mkdir()
    ledger, index = store.ledger(spark, str(tmp_path / "l")), store.vector_index(spark, str(tmp_path / "i"), 64)
    for name in ("good", "bad"):
        (folder / f"{name}.html").write_text(f"<p>text</p><table><tr><td>{name}</td></tr><tr><td>1</td></tr></table>")
    providers.register("summarization", Fails)
    try:
        out = Ingestion(spark, ledger, index).run(str(folder))
    finally:
        providers.forget("summarization")
    assert out.status == "INDEXED" and out.failed == [("bad.html", "malformed chunks")] and out.retries == {"split": 3}
    assert rows(index) == {"good.html::1", "good.html::2"} and [r["file_name"] for r in ledger.read().collect()] == ["good.html"]
    assert any(r["content_to_embed"].startswith("a summary of") for r in index.read().collect())


def test_embedding_retries_are_bounded(spark, tmp_path):
    class Never:
        def embed(self, texts):
            raise RuntimeError("down")

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.html").write_text("<p>b</p>")
    ledger, index = store.ledger(spark, str(tmp_path / "l")), store.vector_index(spark, str(tmp_path / "i"), 64)
    out = Ingestion(spark, ledger, index, embedder=Never()).run(str(folder))
    assert out.status == "EMBEDDINGS_FAILED" and out.retries == {"embed": 2} and ledger.read().count() == 0


def test_redaction_is_an_option(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.html").write_text("<p>mail a@b.example now</p>")
    ledger, index = store.ledger(spark, str(tmp_path / "l")), store.vector_index(spark, str(tmp_path / "i"), 64)
    Ingestion(spark, ledger, index, normalise_and_redact=True).run(str(folder))
    assert index.read().first()["raw_payload"] == "mail <EMAIL_ADDRESS> now"


def test_watch(spark, tmp_path):
    from thicket.streaming.arrivals import watch

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.html").write_text("<p>b</p>")
    ledger, index = store.ledger(spark, str(tmp_path / "l")), store.vector_index(spark, str(tmp_path / "i"), 64)
    watch(spark, str(folder), Ingestion(spark, ledger, index), str(tmp_path / "cp")).awaitTermination(120)
    assert rows(index) == {"b.html::1"}


def test_stage_error():
    with pytest.raises(StageError) as e, stage("load", "a.pdf"):
        int("x")
    assert e.value.stage == "load" and e.value.function_name == "test_stage_error" and "ValueError" in e.value.original_error
