"""Headings, tables, segments and chunks."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.operators import markdown as M

PROPAGATE = [
    ("# Pumps\n## Seals\n### Rings\nGrease them twice a year.", "# Pumps\n\n## Seals\n\n### Rings\n\n**[Context: Pumps > Seals > Rings]**\nGrease them twice a year."),
    ("## Night shift\nCount the keys.\n\n# Gate\nLock it.", "## Night shift\n\n**[Context: Night shift]**\nCount the keys.\n\n# Gate\n\n**[Context: Gate]**\nLock it."),
    ("lead\n\nmore\n# A\n### C\nx\n## B\ny", "lead\nmore\n\n# A\n\n### C\n\n**[Context: A > C]**\nx\n\n## B\n\n**[Context: A > B]**\ny"),
    ("#NoSpace\n####### seven\n # indented", "#NoSpace\n####### seven\n # indented"),
    ("", ""),
]
T1 = "| a | b |\n|---|---|\n| 1 | 2 |"


def docs(spark, texts):
    return spark.createDataFrame([(f"f{i:03}", t) for i, t in enumerate(texts)], "file_name string, t string")


def test_propagate(spark):
    out = M.propagate(docs(spark, [a for a, _ in PROPAGATE]), "file_name", "t").orderBy("file_name").collect()
    assert [r["markdown"] for r in out] == [b for _, b in PROPAGATE]


def test_empty_title_stays_open(spark):
    line = M.lines(docs(spark, ["# \n## B\nx"]), "file_name", "t")
    assert [r["breadcrumb"] for r in M.breadcrumbs(line, "file_name").orderBy("pos").collect()] == ["", " > B", " > B"]


def chunked(spark, text, **kw):
    rows = M.chunks(docs(spark, [text]), "file_name", "t", **kw).collect()
    return sorted(rows, key=lambda r: int(r["chunk_id"].split("::")[1]))


def test_table_between_text(spark):
    a, b, c = chunked(spark, f"# T\n\n**[Context: T]**\n{T1}\ntail")
    assert (a["chunk_id"], a["chunk_type"], a["raw_payload"]) == ("f000::1", "text", "# T\n\n**[Context: T]**")
    assert (b["chunk_type"], b["raw_payload"], b["metadata"]["table_columns"], b["metadata"]["has_table"], b["metadata"]["is_table_summary"]) == ("table summary", T1, ["a", "b"], True, True)
    assert (c["chunk_id"], c["raw_payload"], c["metadata"]["is_table_summary"], c["metadata"]["table_columns"]) == ("f000::3", "tail", None, None)


def test_tables_over_blank_lines_are_one(spark):
    (t,) = chunked(spark, "| a |\n|---|\n| 1 |\n\n| b |\n|---|\n| 2 |")
    assert t["metadata"]["table_columns"] == ["a"] and t["raw_payload"].endswith("| 2 |")


def test_cut_row(spark):
    a, b = chunked(spark, "| a | b |\n|---|---|\n| 1 | 2")
    assert a["raw_payload"] == "| a | b |\n|---|---|\n| 1 |" and (b["chunk_type"], b["raw_payload"]) == ("text", "2")


def test_no_rows_no_table(spark):
    (t,) = chunked(spark, "| a |\n|---|")
    assert t["chunk_type"] == "text"


def test_blank_header(spark):
    assert chunked(spark, "|  | b |\n|---|---|\n| 1 | 2 |")[0]["metadata"]["table_columns"] == ["b"]


def test_nothing(spark):
    assert chunked(spark, "") == [] and chunked(spark, None) == [] and chunked(spark, " \n\n ") == []


def test_long_table(spark):
    rows = "\n".join(f"| {i} | x |" for i in range(20_000))
    t, end = chunked(spark, f"| a | b |\n|---|---|\n{rows}\nend")
    assert t["raw_payload"].count("\n") == 20_001 and end["raw_payload"] == "end"


def test_code_flag(spark):
    a, b = chunked(spark, f"```python\nx\n```\n{T1}")
    assert a["metadata"]["has_code_block"] is True and b["metadata"]["has_code_block"] is False


def test_summariser(spark):
    class Upper:
        def summaries(self, tables):
            return [t.upper() for t in tables]

    assert chunked(spark, T1, summariser=Upper())[0]["content_to_embed"] == T1.upper()
    assert chunked(spark, T1)[0]["content_to_embed"] == "Table with columns a, b; 1 rows."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from([" ", "\n", "\n\n", "  "])), max_size=40), st.integers(5, 60), st.integers(0, 4))
def test_split_text(parts, size, overlap):
    text, n = "", 0
    for length, sep in parts:  # every character but white space occurs once
        text += "".join(chr(0x4E00 + n + i) for i in range(length)) + sep
        n += length
    out = M.split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() and c in text for c in out)
    at = 0
    for c in out:
        own = [ord(x) - 0x4E00 for x in c if not x.isspace()]
        assert at - overlap <= own[0] <= at and own[-1] >= at
        at = own[-1] + 1
    assert at == n


def test_split_text_leaves_out_what_is_overlap_only():
    text = "  " + "abcdefghijklmnopqr" + "  " + " s"
    assert [c for c in M.split_text("a" + "  " + "bcdefghijklmnopqrs" + " " + "t" + " ", 23, 2)] == ["a  bcdefghijklmnopqrs t"]
    assert M.split_text(text, 23, 2)[-1].endswith("s") and M.split_text("   ", 2, 1) == []


def test_chunk_sizes(spark):
    random.seed(1)
    text = " ".join("".join(random.choices("abcdef", k=random.randint(1, 12))) for _ in range(900))
    rows = chunked(spark, text)
    assert len(rows) > 10 and all(len(r["raw_payload"]) <= 400 for r in rows)
    assert [r["chunk_id"] for r in rows] == [f"f000::{i + 1}" for i in range(len(rows))]


def test_lines(spark):
    out = M.lines(docs(spark, ["a\n\nb\n", "", None]), "file_name", "t").groupBy("file_name").agg(F.count("*").alias("n")).orderBy("file_name").collect()
    assert [r["n"] for r in out] == [4, 1]
