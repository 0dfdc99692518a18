"""All queries of the core by name. Each reads whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thicket.functions import patterns as P
from thicket.functions import redaction, text
from thicket.operators import changes, gates, markdown, retrieval, vectors
from thicket.plans.oracle import SQL
from thicket.session import spread
from thicket.sources import files
from thicket.sources.tables import table

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]
DIM, K = 64, 5


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "loaded_docs").select("load_id", F.col("markdown_content").alias("t"))


def _on_text(*steps: Callable, null_too: bool = False) -> Query:
    """Text steps over all loaded documents."""

    def run(s: SparkSession, d: str) -> DataFrame:
        out = text.staged(spread(_docs(s, d)), "t", *steps).withColumnRenamed("t", "text")
        return out if null_too else out.where(F.col("text").isNotNull())

    return run


# Change detection and ledger.


def _classified(s: SparkSession, d: str) -> DataFrame:
    return changes.classify(table(s, d, "disk_files"), table(s, d, "ledger"))


def _of(change: str) -> Query:
    return lambda s, d: _classified(s, d).where(F.col("change") == change).select("file_name")


def cdc_classify(s: SparkSession, d: str) -> DataFrame:
    return _classified(s, d).select("file_name", "change")


def stale_ids(s: SparkSession, d: str) -> DataFrame:
    return changes.stale_ids(_classified(s, d))


def _loaded(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "loaded_docs").where("markdown_content is not null").select("file_name").distinct()


def _load_errors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pipeline_errors").where("stage = 'load'")


def cdc_pending(s: SparkSession, d: str) -> DataFrame:
    return changes.pending(_classified(s, d), _loaded(s, d), changes.exhausted(_load_errors(s, d)))


def retry_counts(s: SparkSession, d: str) -> DataFrame:
    return changes.attempts(table(s, d, "pipeline_errors")).withColumn("failures", F.col("failures").cast("long"))


def retry_exhausted(s: SparkSession, d: str) -> DataFrame:
    return changes.exhausted(table(s, d, "pipeline_errors"))


def doc_latest(s: SparkSession, d: str) -> DataFrame:
    return changes.latest(table(s, d, "loaded_docs").select("load_id", "file_name", "loaded_at")).select("file_name", "load_id")


def content_hash(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("load_id", changes.content_hash(F.col("t")).alias("content_hash"))


def ledger_lookup(s: SparkSession, d: str) -> DataFrame:
    return changes.ledger_lookup(table(s, d, "disk_files").select("file_name"), table(s, d, "ledger"))


def _changed(s: SparkSession, d: str) -> DataFrame:
    todo = _classified(s, d).where(F.col("change").isin("new", "modified")).select("file_name", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    return todo.join(table(s, d, "disk_files"), "file_name").select("file_name", "content_hash", F.lit("indexed").alias("status"), "chunk_count", F.col("modified_at").alias("last_indexed_at"))


def ledger_upsert(s: SparkSession, d: str) -> DataFrame:
    return changes.ledger_upsert(table(s, d, "ledger"), _changed(s, d))


def ledger_delete(s: SparkSession, d: str) -> DataFrame:
    return changes.ledger_delete(table(s, d, "ledger"), _of("deleted")(s, d))


def ledger_names(s: SparkSession, d: str) -> DataFrame:
    return changes.ledger_names(table(s, d, "ledger"))


# Vector index: what was in time makes the index, what landed a day late or more the next batch.


def _emitted(s: SparkSession, d: str, late: bool) -> DataFrame:
    day = F.col("landed_at") - F.col("created_at") >= F.expr("interval 1 day")
    rows = table(s, d, "chunks").where(day if late else ~day)
    w = Window.partitionBy("chunk_id").orderBy(F.col("created_at").desc(), F.col("row_id").desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("chunk_id", "row_id", "embedding")


def _index(s: SparkSession, d: str) -> DataFrame:
    return _emitted(s, d, late=False).where("embedding is not null")


def vector_upsert(s: SparkSession, d: str) -> DataFrame:
    return vectors.upsert(_index(s, d), _emitted(s, d, late=True)).select("chunk_id", "row_id")


def vector_delete(s: SparkSession, d: str) -> DataFrame:
    return vectors.delete(_index(s, d), stale_ids(s, d)).select("chunk_id", "row_id")


def verify_sample(s: SparkSession, d: str) -> DataFrame:
    return vectors.verify(_emitted(s, d, late=True).where("embedding is not null").select("row_id", "chunk_id"), _index(s, d), "row_id")


def verify_all(s: SparkSession, d: str) -> DataFrame:
    return vectors.verify(_emitted(s, d, late=True).where("embedding is not null").select("row_id", "chunk_id"), _index(s, d), "row_id", sample=None)


# Conversion.


def html_markdown(s: SparkSession, d: str) -> DataFrame:
    """Documents as pages of HTML (source as heading, text as paragraph), converted as the ingestion does."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><h1>"), safe(F.col("source")), F.lit("</h1><p>"), safe(F.col("text")), F.lit("</p></body></html>"))
    made = spread(table(s, d, "documents")).select(F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("file_name"), F.encode(page, "UTF-8").alias("content"))
    return files.convert(made).select("file_name", F.col("markdown_content").alias("markdown"))


# Headings and tables.


def _lines(s: SparkSession, d: str) -> DataFrame:
    return markdown.lines(_docs(s, d), "load_id", "t")


def md_lines(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d)


def md_headings(s: SparkSession, d: str) -> DataFrame:
    return markdown.headings(_lines(s, d)).where("level > 0").select("load_id", "pos", "level", "title")


def breadcrumbs(s: SparkSession, d: str) -> DataFrame:
    return markdown.breadcrumbs(_lines(s, d), "load_id").select("load_id", "pos", "breadcrumb")


def md_blocks(s: SparkSession, d: str) -> DataFrame:
    return markdown.blocks(_lines(s, d), "load_id").select("load_id", "block", "breadcrumb", "body")


def propagate_headers(s: SparkSession, d: str) -> DataFrame:
    return markdown.propagate(_docs(s, d), "load_id", "t")


def _segments(s: SparkSession, d: str) -> DataFrame:
    return markdown.segments(_docs(s, d), "load_id", "t")


def md_segments(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d)


def _numbered_tables(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("load_id").orderBy("segment"))
    return _segments(s, d).where("is_table").select("load_id", n.alias("table_no"), F.col("body"))


def md_tables(s: SparkSession, d: str) -> DataFrame:
    return _numbered_tables(s, d)


def table_columns(s: SparkSession, d: str) -> DataFrame:
    return _numbered_tables(s, d).select("load_id", "table_no", F.array_join(markdown.table_columns(F.col("body")), "|").alias("columns"))


def table_summary(s: SparkSession, d: str) -> DataFrame:
    return markdown.summarise(_numbered_tables(s, d), "body", "summary").select("load_id", "table_no", "summary")


def has_code_block(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("row_id", F.coalesce(markdown.has_code_block(F.col("raw_payload")), F.lit(False)).alias("has_code_block"))


def chunk_metadata(s: SparkSession, d: str) -> DataFrame:
    m = "metadata"
    return table(s, d, "chunks").select(
        "row_id", F.col(f"{m}.file_name").alias("file_name"), F.coalesce(f"{m}.is_table_summary", F.lit(False)).alias("is_table"), F.when(F.col(f"{m}.is_table_summary"), "table summary").otherwise("text").alias("chunk_type"),
        F.array_join(F.when(F.col(f"{m}.is_table_summary"), markdown.table_columns(F.col("raw_payload"))), "|").alias("columns"),
    )


def text_chunks(s: SparkSession, d: str) -> DataFrame:
    return markdown.text_chunks(_segments(s, d).where("not is_table"), "body").select("load_id", "segment", "piece", "chunk")


def _latest_docs(s: SparkSession, d: str) -> DataFrame:
    full = table(s, d, "loaded_docs").where("markdown_content is not null").select("load_id", "file_name", "loaded_at", "markdown_content")
    return changes.latest(full)


def chunk_ids(s: SparkSession, d: str) -> DataFrame:
    """The whole way from a file's last load to its chunks: clean, propagate, split, number."""
    return markdown.chunks(markdown.prepared(_latest_docs(s, d), "file_name", "markdown_content"), "file_name", "markdown").select("chunk_id", "chunk_type", "content_to_embed", "raw_payload")


def preprocess_full(s: SparkSession, d: str) -> DataFrame:
    names = {k: [r["name"] for r in table(s, d, "known_names").where(F.col("kind") == k).collect()] for k in ("given", "family")}  # a fixed list
    gaz = redaction.Gazetteer(names["given"], names["family"])
    return text.staged(spread(_docs(s, d)), "t", *text.CLEAN, *text.NORMALISE, *redaction.steps(gaz), text.empty_if_null).withColumnRenamed("t", "text")


# Embedding and search.


def hash_embedding(s: SparkSession, d: str) -> DataFrame:
    e = vectors.hash_embedding(spread(table(s, d, "chunks").select("row_id", "content_to_embed")), "row_id", "content_to_embed", dim=DIM).select("row_id", F.posexplode("embedding").alias("slot", "w"))
    return e.where("w <> 0").select("row_id", "slot", F.round("w", 9).alias("weight"))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select(F.col("row_id").alias("id"), F.col("embedding").alias("v")).where(vectors.usable("v", DIM))


def cosine_pairs(s: SparkSession, d: str) -> DataFrame:
    """Cosine between the emissions of a chunk."""
    c = table(s, d, "chunks").where(vectors.usable("embedding", DIM)).select("chunk_id", "row_id", "embedding")
    a, b = c.select("chunk_id", F.col("row_id").alias("id_a"), F.col("embedding").alias("va")), c.select("chunk_id", F.col("row_id").alias("id_b"), F.col("embedding").alias("vb"))
    return a.join(b, "chunk_id").where("id_a < id_b").select("chunk_id", "id_a", "id_b", F.round(vectors.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    """The k chunks nearest to every 50th row (the stated set of searches), itself left out."""
    v = _vectors(s, d)
    hit = vectors.top_k(v.where("id % 50 = 0"), v, K + 1, DIM).where("query_id <> id")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K)


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def grade_relevance(s: SparkSession, d: str) -> DataFrame:
    return retrieval.grade(_hits(s, d)).select("query_id", "id", "relevant")


def route(s: SparkSession, d: str) -> DataFrame:
    return retrieval.route(retrieval.grade(_hits(s, d))).select("query_id", F.round("best", 6).alias("best"), "relevant", "route")


def _sources(s: SparkSession, d: str) -> DataFrame:
    graded = retrieval.grade(_hits(s, d))
    second = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.fallback(_vectors(s, d), retrieval.route(graded), graded, second, K, DIM)


def fallback_union(s: SparkSession, d: str) -> DataFrame:
    return _sources(s, d).select("query_id", "origin", "id", "rank")


def context_assembly(s: SparkSession, d: str) -> DataFrame:
    hits = retrieval.grade(_hits(s, d)).where("relevant")
    return retrieval.context(hits, table(s, d, "chunks").select(F.col("row_id").alias("id"), F.col("raw_payload").alias("text")))


# Gates.


def gate_load(s: SparkSession, d: str) -> DataFrame:
    wanted = table(s, d, "disk_files").where(changes.accepted("file_name"))
    return gates.gate_load(wanted, _loaded(s, d), _load_errors(s, d).select("file_name", "attempt"), changes.MAX_ATTEMPTS)


def gate_chunks(s: SparkSession, d: str) -> DataFrame:
    return gates.gate_chunks(table(s, d, "chunks"))


def gate_embeddings(s: SparkSession, d: str) -> DataFrame:
    return gates.gate_embeddings(table(s, d, "chunks"))


def chunks_per_file(s: SparkSession, d: str) -> DataFrame:
    return gates.chunks_per_file(table(s, d, "chunks"), table(s, d, "disk_files"))


def error_report(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "pipeline_errors")
    return e.groupBy(F.coalesce("stage", F.lit("unknown")).alias("stage"), "error_file", "function_name").agg(F.count(F.lit(1)).alias("errors"), F.count_distinct("file_name").alias("files"), F.max("occurred_at").alias("last_at"))


QUERIES: dict[str, Query] = {
    "cdc_classify": cdc_classify, "cdc_new": _of("new"), "cdc_modified": _of("modified"), "cdc_unchanged": _of("unchanged"), "cdc_deleted": _of("deleted"), "stale_ids": stale_ids, "cdc_pending": cdc_pending,
    "retry_counts": retry_counts, "retry_exhausted": retry_exhausted, "doc_latest": doc_latest, "content_hash": content_hash,
    "ledger_lookup": ledger_lookup, "ledger_upsert": ledger_upsert, "ledger_delete": ledger_delete, "ledger_names": ledger_names,
    "vector_upsert": vector_upsert, "vector_delete": vector_delete, "verify_sample": verify_sample, "verify_all": verify_all,
    "clean_symbol_lines": _on_text(text.clean_symbol_lines), "clean_page_markers": _on_text(text.clean_page_markers), "clean_images": _on_text(text.clean_images), "clean_tags": _on_text(text.clean_tags), "clean_nul": _on_text(text.clean_nul),
    "collapse_newlines": _on_text(text.collapse_newlines), "strip_text": _on_text(P.strip), "clean_full": _on_text(*text.CLEAN, null_too=True),
    "nfkc": _on_text(text.nfkc), "strip_invisible": _on_text(text.strip_invisible), "ligatures": _on_text(text.ligatures), "dehyphenate": _on_text(text.dehyphenate), "collapse_spaces": _on_text(text.collapse_spaces), "normalise_full": _on_text(*text.NORMALISE),
    "pii_email": _on_text(redaction.redact_email), "pii_ssn": _on_text(redaction.redact_ssn), "pii_phone": _on_text(redaction.redact_phone), "pii_card": _on_text(redaction.redact_card), "preprocess_full": preprocess_full,
    "html_markdown": html_markdown,
    "md_lines": md_lines, "md_headings": md_headings, "breadcrumbs": breadcrumbs, "md_blocks": md_blocks, "propagate_headers": propagate_headers,
    "md_segments": md_segments, "md_tables": md_tables, "table_columns": table_columns, "table_summary": table_summary, "text_chunks": text_chunks, "chunk_ids": chunk_ids, "has_code_block": has_code_block, "chunk_metadata": chunk_metadata,
    "hash_embedding": hash_embedding, "cosine_pairs": cosine_pairs, "vector_topk": vector_topk,
    "grade_relevance": grade_relevance, "route": route, "fallback_union": fallback_union, "context_assembly": context_assembly,
    "gate_load": gate_load, "gate_chunks": gate_chunks, "gate_embeddings": gate_embeddings, "chunks_per_file": chunks_per_file, "error_report": error_report,
}
