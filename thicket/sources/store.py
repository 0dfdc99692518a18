"""Versioned tables on plain Parquet: ledger and vector index.

A table is cut into parts by a hash of the file name. A change writes new versions of the parts it touches beside the old
ones, then a new pointer that names the version of every part, so readers see all of a change or nothing, and untouched
parts are neither read nor written. Pointers are files of their own, CURRENT.<version>, of which the highest counts; none is
removed before a higher one stands, so a crash at any point leaves the table as it was before or after the change.
A version is written by one driver at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = T.StructType(
    [T.StructField("file_name", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("status", T.StringType()), T.StructField("chunk_count", T.IntegerType()), T.StructField("last_indexed_at", T.TimestampType())]
)
SEEN = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("modified_at", T.TimestampType())])
METADATA = T.StructType(
    [T.StructField("file_name", T.StringType()), T.StructField("has_table", T.BooleanType()), T.StructField("has_code_block", T.BooleanType()), T.StructField("table_columns", T.ArrayType(T.StringType())), T.StructField("is_table_summary", T.BooleanType())]
)
CHUNKS = T.StructType(
    [T.StructField("chunk_id", T.StringType()), T.StructField("chunk_type", T.StringType()), T.StructField("content_to_embed", T.StringType()), T.StructField("raw_payload", T.StringType()), T.StructField("metadata", METADATA), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)


class Store:
    """A table at ``path``, on any file system Spark can reach. ``name`` is the column (or field) of the file name.

    ``parts`` is fixed when the table is created; so many that a part is written comfortably by a task or a few.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, settings: dict | None = None, name: str = "file_name", parts: int = 64):
        self.spark, self.path, self.schema, self.name = spark, path.rstrip("/"), schema, name
        jvm = spark.sparkContext._jvm
        self._path = lambda p="": jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}" if p else self.path)
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.version() is None:  # create once
            if any(n.startswith("v") for n in self._names()):
                raise RuntimeError(f"{path} holds versions but no pointer to one; it is not overwritten")
            self._point({"version": 0, "settings": settings or {}, "parts": parts, "at": {}})
        elif settings and self.settings() != settings:
            raise ValueError(f"{path} exists with other settings: {self.settings()}")

    def _names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path())] if self._fs.exists(self._path()) else []

    def _pointer(self, back: int = 0) -> dict | None:
        """The pointer in force, or one of those before it."""
        known = sorted((int(n[8:]) for n in self._names() if n.startswith("CURRENT.") and n[8:].isdigit()), reverse=True)
        if len(known) <= back:
            return None
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.path}/CURRENT.{known[back]}").first()[1])

    def _point(self, pointer: dict) -> None:
        """Written beside and renamed, so that a pointer is never half there."""
        out = self._fs.create(self._path("NEXT"), True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        if not self._fs.rename(self._path("NEXT"), self._path(f"CURRENT.{pointer['version']}")):
            raise RuntimeError(f"another writer made version {pointer['version']} of {self.path}")

    def version(self) -> int | None:
        now = self._pointer()
        return None if now is None else now["version"]

    def settings(self) -> dict:
        return (self._pointer() or {}).get("settings", {})

    def _part(self, name: str, parts: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(name), F.lit(""))), F.lit(parts)).cast("int")

    def _read(self, at: dict[str, int]) -> DataFrame:
        folders = [f"{self.path}/v{v}/part={p}" for p, v in sorted(at.items())]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._pointer()["at"])

    def _checked(self, df: DataFrame) -> DataFrame:
        return df

    def write(self, df: DataFrame) -> None:
        """Replaces the whole table."""
        self._write(df, None)

    def change(self, files: DataFrame, how: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the parts that hold ``files`` (file_name) by ``how`` of them, which may add rows of these files only."""
        now = self._pointer()
        touched = {str(r["p"]) for r in files.select(self._part("file_name", now["parts"]).alias("p")).distinct().collect()}  # at most ``parts``
        if touched:
            self._write(how(self._read({p: v for p, v in now["at"].items() if p in touched})), touched)

    def _write(self, df: DataFrame, touched: set[str] | None) -> None:
        now, before = self._pointer(), self._pointer(1)
        nxt = now["version"] + 1
        placed = self._checked(df.select(*self.schema.names)).withColumn("part", self._part(self.name, now["parts"]))
        placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/v{nxt}")
        made = {f.getPath().getName()[5:] for f in self._fs.listStatus(self._path(f"v{nxt}")) if f.getPath().getName().startswith("part=")}
        if touched is not None and not made <= touched:
            self._fs.delete(self._path(f"v{nxt}"), True)
            raise ValueError("a change may add rows of the files it names only")
        kept = {} if touched is None else {p: v for p, v in now["at"].items() if p not in touched}
        self._point({**now, "version": nxt, "at": {**kept, **{p: nxt for p in made}}})
        if before is not None:  # what only the pointer before the last one used
            for p, v in before["at"].items():
                if now["at"].get(p) != v:
                    self._fs.delete(self._path(f"v{v}/part={p}"), True)
            self._fs.delete(self._path(f"CURRENT.{before['version']}"), False)


class VectorIndex(Store):
    """A table of chunks that takes vectors of its own dimension only."""

    def _checked(self, df: DataFrame) -> DataFrame:
        dim = int(self.settings()["dimension"])
        wrong = F.concat(F.lit("vector of "), F.size("embedding").cast("string"), F.lit(f" values in an index of {dim}: "), F.col("chunk_id"))
        fits = F.col("embedding").isNull() | (F.size("embedding") == dim)
        return df.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(wrong).cast(self.schema["embedding"].dataType)))


def ledger(spark: SparkSession, path: str, parts: int = 8) -> Store:
    return Store(spark, path, LEDGER, parts=parts)


def vector_index(spark: SparkSession, path: str, dimension: int, metric: str = "cosine", parts: int = 64) -> VectorIndex:
    """The index holds texts beside the vectors, so that retrieved rows can be read. Created once with its dimension."""
    return VectorIndex(spark, path, CHUNKS, {"dimension": dimension, "metric": metric}, name="metadata.file_name", parts=parts)


def seen(spark: SparkSession, path: str, parts: int = 8) -> Store:
    """What files looked like when they were last hashed: an option of the ingestion."""
    return Store(spark, path, SEEN, parts=parts)
