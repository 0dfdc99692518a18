"""Change detection between the files on disk and the ledger, and the bookkeeping around it.

Everything is keyed joins: no lookup per row, no state on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Accepted suffixes and the number of attempts.
SUFFIXES = ("pdf", "html", "docx")
MAX_ATTEMPTS = 3
_HASH = "^[0-9a-f]{64}$"


def accepted(file_name: Column | str) -> Column:
    """Whether a file's suffix, in any case, is one that can be ingested."""
    return F.lower(F.regexp_extract(file_name, r"\.([^.]+)$", 1)).isin(*SUFFIXES)


def content_hash(content: Column) -> Column:
    """SHA-256 in hex of bytes or text; null for null, never an error message."""
    return F.sha2(content.cast("binary"), 256)


def classify(disk: DataFrame, ledger: DataFrame) -> DataFrame:
    """(file_name, change, chunk_count) of every file: new, modified, unchanged, deleted, or ignored.

    deleted: in the ledger, not on disk under any suffix. ignored: on disk with a suffix that is not accepted. A hash that
    is no hash (an error message stored in its place) never makes a file unchanged. One full outer join.
    """
    d = disk.select("file_name", F.col("content_hash").alias("__d"), F.lit(True).alias("__on"))
    g = ledger.select("file_name", F.col("content_hash").alias("__g"), "chunk_count", F.lit(True).alias("__in"))
    change = (
        F.when(F.col("__on").isNull(), "deleted")
        .when(~accepted("file_name"), "ignored")
        .when(F.col("__in").isNull(), "new")
        .when(F.col("__d").rlike(_HASH) & (F.col("__d") == F.col("__g")), "unchanged")
        .otherwise("modified")
    )
    return d.join(g, "file_name", "full_outer").select("file_name", change.alias("change"), "chunk_count")


def stale_ids(classified: DataFrame) -> DataFrame:
    """(file_name, chunk_id) of the vectors that deleted and modified files leave: name::1 to name::chunk_count."""
    gone = classified.where(F.col("change").isin("deleted", "modified") & (F.col("chunk_count") > 0))
    return gone.select("file_name", F.explode(F.sequence(F.lit(1), "chunk_count")).alias("n")).select("file_name", F.concat_ws("::", "file_name", F.col("n").cast("string")).alias("chunk_id"))


def pending(classified: DataFrame, loaded: DataFrame, failed: DataFrame) -> DataFrame:
    """Files to load: new or modified, not loaded yet and not given up."""
    todo = classified.where(F.col("change").isin("new", "modified")).select("file_name")
    return todo.join(loaded.select("file_name"), "file_name", "left_anti").join(failed.select("file_name"), "file_name", "left_anti")


def attempts(errors: DataFrame) -> DataFrame:
    """(file_name, stage, failures, last_attempt) from the log of failures; a null stage is unknown."""
    return errors.groupBy("file_name", F.coalesce("stage", F.lit("unknown")).alias("stage")).agg(F.count(F.lit(1)).alias("failures"), F.max("attempt").alias("last_attempt"))


def exhausted(errors: DataFrame, earlier: DataFrame | None = None, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Files given up: a stage failed at its last attempt, now or earlier."""
    now = errors.where(F.col("attempt") >= most).select("file_name")
    return (now if earlier is None else now.unionByName(earlier.select("file_name"))).distinct()


def latest(loads: DataFrame) -> DataFrame:
    """The last load of every file (by time, then by id); later loads replace earlier ones."""
    w = Window.partitionBy("file_name").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("load_id").desc())
    return loads.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


# The ledger: a table with a row per file.


def ledger_lookup(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every file with its record, or nulls."""
    g = ledger.select("file_name", F.col("content_hash").alias("ledger_hash"), F.col("status").alias("ledger_status"), F.col("chunk_count").alias("ledger_chunks"))
    return files.join(g, "file_name", "left")


def ledger_upsert(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger with the changes in it; the latest change of a file wins, a tie goes to the greater hash."""
    cols = ["file_name", "content_hash", "status", "chunk_count", "last_indexed_at"]
    both = ledger.select(*cols, F.lit(0).alias("__v")).unionByName(changes.select(*cols, F.lit(1).alias("__v")))
    w = Window.partitionBy("file_name").orderBy(F.col("__v").desc(), F.col("last_indexed_at").desc_nulls_last(), F.col("content_hash").desc())
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*cols)


def ledger_delete(ledger: DataFrame, names: DataFrame) -> DataFrame:
    return ledger.join(names.select("file_name"), "file_name", "left_anti")


def ledger_names(ledger: DataFrame) -> DataFrame:
    return ledger.select("file_name")
