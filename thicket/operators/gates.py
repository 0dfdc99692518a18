"""Quality gates: pure predicates over what a stage made. A gate reads; committing is a stage of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the shortest summary that passes.
MIN_SUMMARY = 10


def gate_load(wanted: DataFrame, loaded: DataFrame, attempts: DataFrame, most: int) -> DataFrame:
    """One row: files, loaded, retryable, decision. Retry while a file is neither loaded nor out of attempts; exit without documents."""
    w = wanted.select("file_name").distinct()
    left = w.join(loaded.select("file_name").distinct().withColumn("__l", F.lit(1)), "file_name", "left").join(attempts.groupBy("file_name").agg(F.max("attempt").alias("__a")), "file_name", "left")
    n = left.agg(F.count(F.lit(1)).alias("files"), F.count("__l").alias("loaded"), F.coalesce(F.sum((F.col("__l").isNull() & (F.coalesce("__a", F.lit(0)) < most)).cast("long")), F.lit(0)).alias("retryable"))
    return n.withColumn("decision", F.when(F.col("retryable") > 0, "retry").when(F.col("loaded") == 0, "exit").otherwise("split"))


def malformed(chunks: DataFrame) -> DataFrame:
    """Chunks that fail the gate: blank content, or a table summary under ten characters."""
    text = F.trim(F.coalesce("content_to_embed", F.lit("")))
    table = F.coalesce(F.col("metadata.is_table_summary"), F.lit(False))
    return chunks.where((text == "") | (table & (F.length(text) < MIN_SUMMARY)))


def gate_chunks(chunks: DataFrame) -> DataFrame:
    """One row: chunks, malformed, decision: retry without chunks or with malformed ones, else embed."""
    n = chunks.agg(F.count(F.lit(1)).alias("chunks")).join(malformed(chunks).agg(F.count(F.lit(1)).alias("malformed")), F.lit(True))
    return n.withColumn("decision", F.when((F.col("chunks") == 0) | (F.col("malformed") > 0), "retry").otherwise("embed"))


def gate_embeddings(chunks: DataFrame) -> DataFrame:
    """One row: chunks, embedded, decision: retry while a chunk has no embedding. Its caller counts embedding attempts."""
    n = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"))
    return n.withColumn("decision", F.when((F.col("chunks") == 0) | (F.col("chunks") > F.col("embedded")), "retry").otherwise("index"))


def chunks_per_file(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """(file_name, content_hash, chunk_count) to be committed: files with a known hash; those without chunks count 0."""
    n = chunks.groupBy(F.col("metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("n"))
    return hashes.select("file_name", "content_hash").join(n, "file_name", "left").select("file_name", "content_hash", F.coalesce("n", F.lit(0)).cast("long").alias("chunk_count"))
