"""Files of a folder: scan, hash, conversion with a quarantine for what fails."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators.changes import accepted, content_hash
from thicket.sources.converters import Converter, StandardConverter


#: Files that are opened by their paths, rather than found by a scan of all.
OPENED = 1000


def name_of(path: str = "path") -> Column:
    """A file's name: the last part of its path, which Spark reports as it is stored, signs and all."""
    return F.regexp_extract(path, r"([^/]+)$", 1)


def listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_name, path, length, modified) of all files there, accepted or not; nothing is opened."""
    return spark.read.format("binaryFile").load(paths).select(name_of().alias("file_name"), "path", "length", F.col("modificationTime").alias("modified"))


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file_name, path, length, modified, content) of the accepted files of a folder (not of folders in it), a file, or a list.

    Content is read only by plans that use it. Spark's file source doesn't list files of no bytes.
    """
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(name_of().alias("file_name"), "path", "length", F.col("modificationTime").alias("modified"), "content").where(accepted("file_name"))


def among(spark: SparkSession, files: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of a scan whose names are among ``names``. Up to OPENED files are opened by path and no others; more by a join."""
    paths = [r["path"] for r in files.select("path", "file_name").join(names.select("file_name"), "file_name", "left_semi").select("path").limit(OPENED + 1).collect()]
    if not paths:
        return files.where("false")
    if len(paths) > OPENED:
        return files.join(names.select("file_name"), "file_name", "left_semi")
    return scan(spark, [re.sub(r"([\\\[\]{}*?^])", r"\\\1", p) for p in paths])


def hashed(files: DataFrame) -> DataFrame:
    """(file_name, content_hash, size_bytes, modified_at)."""
    return files.select("file_name", content_hash(F.col("content")).alias("content_hash"), F.col("length").alias("size_bytes"), F.col("modified").alias("modified_at"))


def convert(files: DataFrame, converter: Converter | None = None) -> DataFrame:
    """(file_name, markdown_content, error): a file that fails has a null text and its error, and holds up no other."""
    use = converter or StandardConverter()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["file_name"], pdf["content"]):
                try:
                    rows.append((name, use.convert(name, bytes(content)), None))
                except Exception as e:  # one file's failure is its own
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["file_name", "markdown_content", "error"])

    return files.select("file_name", "content").mapInPandas(run, "file_name string, markdown_content string, error string")


def load(files: DataFrame, converter: Converter | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine) of a conversion."""
    both = convert(files, converter)
    return both.where("error is null").select("file_name", "markdown_content"), both.where("error is not null").select("file_name", "error")
