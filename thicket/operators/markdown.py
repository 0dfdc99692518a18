"""Markdown documents as lines: headings, breadcrumbs, blocks, pipe tables, segments and chunks.

Everything sequential in a document (which headings are open, which lines make a table) is a window over its lines. All
windows of one document share the same partitioning, so the lines of a document are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from thicket.functions import patterns as P
from thicket.functions.text import CLEAN, staged

# What a heading, a table row and a separator are, and how a context line reads.
HEADING = rf"(?d)^(#{{1,6}}){P.SPACE}+(.*)$"
ROW = rf"(?d)^{P.SPACE}*\|[^\n]+\|{P.SPACE}*$"
SEPARATOR = rf"(?d)^{P.SPACE}*\|[\s:|\-]*\|{P.SPACE}*$"
CONTEXT = ("**[Context: ", "]**")
JOINER = " > "
LEVELS = range(1, 7)
#: Sizes of text chunks and their overlap; batches. Fixed values.
CHUNK_SIZE, CHUNK_OVERLAP = 400, 200


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line), positions from 0; trailing empty lines count; null texts have none."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def headings(line: DataFrame) -> DataFrame:
    """Adds level (0: no heading) and title. A heading starts in the first column, one to six hashes and a space."""
    hashes = F.length(F.regexp_extract("line", HEADING, 1))
    return line.withColumn("level", hashes).withColumn("title", F.when(hashes > 0, P.strip(F.regexp_extract("line", HEADING, 2))))


def breadcrumbs(line: DataFrame, key: str) -> DataFrame:
    """Adds level, title and breadcrumb: the titles of the open headings, outermost first.

    The last heading of every level so far is open unless one of a lower level came after it.
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = headings(line)
    last = [F.last(F.when(F.col("level") == k, F.struct("pos", "title")), ignorenulls=True).over(w).alias(f"__h{k}") for k in LEVELS]
    seen = h.select("*", *last)
    open_titles = []
    for k in LEVELS:
        at = F.col(f"__h{k}.pos")
        lower = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"__h{j}.pos"), F.lit(-1)) for j in LEVELS if j < k]) if k > 1 else F.lit(-1)
        open_titles.append(F.when(at > lower, F.col(f"__h{k}.title")))
    crumb = F.array_join(F.filter(F.array(*open_titles), lambda x: x.isNotNull()), JOINER)
    return seen.withColumn("breadcrumb", crumb).drop(*[f"__h{k}" for k in LEVELS])


def blocks(line: DataFrame, key: str, keep_first: bool = False) -> DataFrame:
    """(key, block, level, breadcrumb, body): a heading, or the lines up to the next one without blank ones.

    ``keep_first`` keeps the first line even if blank, so that every document has a block (an empty one, if need be).
    """
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_heading = F.col("level") > 0
    crumbed = breadcrumbs(line, key).where(is_heading | (P.strip(F.col("line")) != "") | ((F.col("pos") == 0) & F.lit(keep_first)))
    start = is_heading | (F.coalesce(F.lag("level").over(Window.partitionBy(key).orderBy("pos")), F.lit(1)) > 0)
    numbered = crumbed.withColumn("block", F.sum(start.cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy(key, "block").agg(F.max("level").alias("level"), F.min_by("breadcrumb", "pos").alias("breadcrumb"), P.strip(body).alias("body"))


def propagate(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, markdown): every block of text under headings begins with a line that names the open headings.

    Blocks are set apart by a blank line; blank lines inside a block are gone. An empty text stays empty.
    """
    b = blocks(lines(df, key, text), key, keep_first=True)
    shown = F.when((F.col("level") == 0) & (F.col("breadcrumb") != "") & (F.col("body") != ""), F.concat(F.lit(CONTEXT[0]), "breadcrumb", F.lit(CONTEXT[1] + "\n"), "body")).otherwise(F.col("body"))
    parts = F.array_sort(F.collect_list(F.struct("block", shown.alias("s"), ((F.col("body") != "") | (F.col("level") > 0)).alias("there"))))
    return b.groupBy(key).agg(F.array_join(F.transform(F.filter(parts, lambda x: x["there"]), lambda x: x["s"]), "\n\n").alias("markdown"))


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, segment, is_table, body): tables and the text between them, in order, stripped, empty ones left out.

    A table is a row with pipes at both ends, a separator, and rows (at least one); blank lines between them belong to it.
    A row that goes on after its last pipe ends the table there: the rest is text.
    """
    k = f"`{key}`"
    by, then = f"over (partition by {k} order by pos)", f"over (partition by {k} order by pos, half)"
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row, sep = F.col("line").rlike(ROW), F.col("line").rlike(SEPARATOR)
    cut = ~row & F.col("line").rlike(rf"^{P.SPACE}*\|[^\n]+\|")
    # Only filled lines decide (blank ones are null here); blank lines go with the table they stand in.
    filled = P.strip(F.col("line")) != ""
    marked = lines(df, key, text).select(key, "pos", "line", filled.alias("filled"), *[F.when(filled, c).alias(n) for n, c in (("row", row), ("sep", sep), ("cut", cut))])
    ahead = marked.select("*", F.expr(f"lead(sep, 1) ignore nulls {by}").alias("s1"), F.expr(f"lead(row or cut, 2) ignore nulls {by}").alias("r2"), F.expr(f"lag(cut, 1) ignore nulls {by}").alias("c0"))
    rowish = F.col("row") | F.col("cut")
    apart = F.coalesce(~rowish | F.col("c0"), ~rowish, F.lit(False))
    run = ahead.withColumn("gap", F.sum(apart.cast("int")).over(upto))  # rows between two gaps stand together
    head = F.col("row") & F.coalesce("s1", F.lit(False)) & F.coalesce("r2", F.lit(False))
    within = Window.partitionBy(key, "gap").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = run.withColumn("at", F.first(F.when(head, F.col("pos")), ignorenulls=True).over(within)).withColumn("at", F.when(rowish, F.col("at")))
    # A row that goes on after its last pipe: the table's part and the rest become lines of their own.
    kept, rest = F.regexp_extract("line", rf"^({P.SPACE}*\|[^\n]+\|)", 1), F.regexp_replace("line", rf"^{P.SPACE}*\|[^\n]+\|", "")
    part = lambda n, line, at: F.struct(F.lit(n).alias("half"), line.alias("line"), at.alias("at"))
    halves = F.when(F.col("at").isNotNull() & F.col("cut"), F.array(part(0, kept, F.col("at")), part(1, rest, F.lit(None).cast("int")))).otherwise(F.array(part(0, F.col("line"), F.col("at"))))
    split = inside.select(key, "pos", "filled", F.explode(halves).alias("x")).select(key, "pos", "filled", "x.*")
    known = "case when filled then coalesce(at, -1) end"
    around = split.select("*", F.expr(f"lag({known}, 1) ignore nulls {then}").alias("b"), F.expr(f"lead({known}, 1) ignore nulls {then}").alias("f"))
    placed = around.withColumn("at", F.when(F.col("filled"), F.coalesce("at", F.lit(-1))).when((F.col("b") == F.col("f")) & (F.col("b") >= 0), F.col("b")).otherwise(-1))
    order = Window.partitionBy(key).orderBy("pos", "half")
    change = F.coalesce(F.lag("at").over(order) != F.col("at"), F.lit(True))
    numbered = placed.withColumn("n", F.sum(change.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    body = P.strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "half", "line"))), lambda x: x["line"]), "\n"))
    made = numbered.groupBy(key, "n").agg((F.first("at") >= 0).alias("is_table"), body.alias("body")).where("body <> ''")
    return made.select(key, F.row_number().over(Window.partitionBy(key).orderBy("n")).alias("segment"), "is_table", "body")


def table_columns(table: Column) -> Column:
    """The column names of a table: its first line cut at the pipes, stripped, empty ones left out."""
    first = F.split(P.strip(table), "\n", 2)[0]
    return F.filter(F.transform(F.split(first, r"\|", -1), P.strip), lambda x: x != "")


class Summariser(Protocol):
    """Describes tables; None for a table it can't describe."""

    def summaries(self, tables: list[str]) -> list[str | None]: ...


def table_summary(table: Column) -> Column:
    """The offline default: the columns and the number of rows. At least ten characters, as the chunk gate asks."""
    rows = F.size(F.filter(F.split(P.strip(table), "\n", -1), lambda x: P.strip(x) != "")) - 2
    return F.concat(F.lit("Table with columns "), F.array_join(table_columns(table), ", "), F.lit("; "), rows.cast("string"), F.lit(" rows."))


def _each(summariser: Summariser, tables: list[str]) -> list[str | None]:
    """Summaries of a batch; where the batch fails, table by table, None for those that fail alone too."""
    try:
        got = list(summariser.summaries(tables))
        if len(got) == len(tables):
            return got
    except Exception:  # found table by table
        pass
    if len(tables) < 2:
        return [None] * len(tables)
    return [x for t in tables for x in _each(summariser, [t])]


def summarise(df: DataFrame, table: str, out: str, summariser: Summariser | None = None) -> DataFrame:
    """Adds a summary of the tables: the offline default, or a summariser's, loaded once per task and called by batch.

    A table that fails has a null summary, and holds up no other.
    """
    if summariser is None:
        return df.withColumn(out, table_summary(F.col(table)))

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got = iter(_each(summariser, [t for t in s if t is not None]))
            yield pd.Series([None if t is None else next(got) for t in s], dtype=object)

    return df.withColumn(out, run(F.col(table)))


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Chunks of at most ``size`` characters: cut at the first separator that occurs, pieces over the size at the next one.

    A separator stays at the start of the piece after it. Pieces are gathered up to the size; a chunk begins with the last
    pieces of the one before, up to ``overlap`` characters. Chunks are stripped; those that would hold nothing but blanks
    beside their overlap are left out.
    """
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep:
        first, *others = text.split(sep)
        pieces = [p for p in (first, *(sep + o for o in others)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    held: list[str] = []
    length, fresh = 0, False

    def flush() -> None:
        nonlocal fresh
        if fresh:
            out.append("".join(held).strip())
        fresh = False

    for piece in pieces:
        if len(piece) > size and finer:
            flush()
            held, length = [], 0
            out += split_text(piece, size, overlap, finer)
            continue
        if held and length + len(piece) > size:
            flush()
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
        fresh = fresh or not piece.isspace()
    flush()
    return out


def text_chunks(df: DataFrame, body: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Explodes the body into (piece, chunk), pieces from 1; a body within the size is its own chunk and stays in the JVM."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_text(t, size, overlap) if t is not None else None)

    short = F.length(body) <= size
    cut = F.when(short, F.array(P.strip(F.col(body)))).otherwise(run(F.when(~short, F.col(body))))
    return df.select("*", F.posexplode(F.filter(cut, lambda x: x != "")).alias("piece", "chunk")).withColumn("piece", F.col("piece") + 1)


def has_code_block(c: Column) -> Column:
    return F.contains(c, F.lit("```"))


def chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, summariser: Summariser | None = None) -> DataFrame:
    """Documents to chunks: chunk_id, chunk_type, content_to_embed, raw_payload, metadata.

    Numbers run from 1 over the tables and pieces of text of a document; a table is one chunk, its summary is what gets
    embedded. A null key is an error of the caller and gives no chunks.
    """
    seg = segments(df.where(F.col(key).isNotNull()), key, text)
    prose = text_chunks(seg.where("not is_table"), "body", size, overlap).select(key, "segment", "piece", F.col("chunk").alias("content"), F.col("chunk").alias("raw"), F.lit(False).alias("is_table"))
    tables = summarise(seg.where("is_table"), "body", "content", summariser).select(key, "segment", F.lit(1).alias("piece"), "content", F.col("body").alias("raw"), F.lit(True).alias("is_table"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("segment", "piece"))
    t = F.col("is_table")
    meta = F.struct(
        F.col(key).alias("file_name"), t.alias("has_table"), (~t & has_code_block(F.col("raw"))).alias("has_code_block"), F.when(t, table_columns(F.col("raw"))).alias("table_columns"), F.when(t, True).alias("is_table_summary")
    )
    return prose.unionByName(tables).select(
        F.concat_ws("::", F.col(key), n.cast("string")).alias("chunk_id"), F.when(t, "table summary").otherwise("text").alias("chunk_type"), F.col("content").alias("content_to_embed"), F.col("raw").alias("raw_payload"), meta.alias("metadata")
    )


def prepared(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, markdown): cleaned and with headings propagated, as the ingestion does before it splits."""
    return propagate(staged(df.select(key, F.col(text).alias("__clean")), "__clean", *CLEAN), key, "__clean")
