"""Embedding and the vector index: default embedding, upsert, delete, verification, cosine and top-k search."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Dimension and metric of the production index, batch of the embedder, sample of the verification.
INDEX_DIMENSION, METRIC = 3072, "cosine"
EMBED_BATCH = 100
VERIFY_SAMPLE = 50
#: Rows in a tile of the search.
TILE = 4096


class Embedder(Protocol):
    """Embeds a batch of texts; None where one failed."""

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


def embed(df: DataFrame, text: str, embedder: Embedder, batch: int = EMBED_BATCH, delay: float = 0.0) -> DataFrame:
    """Adds embedding and embed_error. A batch that fails gives null embeddings and its error; no row is lost.

    ``delay`` seconds pass between two batches of a task: the rate of a task. Coalesce the input to bound the tasks.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embed_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                if delay and at:
                    time.sleep(delay)
                part = pdf.iloc[at : at + batch].copy()
                try:
                    vectors, error = embedder.embed(part[text].tolist()), None
                    if len(vectors) != len(part):
                        raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                except Exception as e:  # the batch failed, not the job
                    vectors, error = [None] * len(part), f"{type(e).__name__}: {e}"
                part["embedding"], part["embed_error"] = pd.Series(vectors, index=part.index, dtype=object), error
                yield part

    return df.mapInPandas(run, schema)


def hash_embedding(df: DataFrame, key: str, text: str, out: str = "embedding", dim: int = 64) -> DataFrame:
    """(key, out), the offline default: signed feature hashing of the words (by MD5), scaled to length one; zeros for no words.

    Words are added up per key and value of the vector on the map side, so a text crosses the network as a few sums. Null
    texts have no row; rows that repeat a key are embedded together.
    """
    base = df.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.array(F.lit(None).cast("string")))).alias("w"))
    h = base.select(key, F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long").alias("h"))
    slot, sign = F.floor(F.col("h") / 2) % dim, F.when(F.col("h") % 2 == 0, 1).otherwise(-1)
    per = h.groupBy(key, slot.alias("__i")).agg(F.sum(sign).alias("__x")).groupBy(key).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("__i", "__x")), lambda e: e["__i"].isNotNull())).alias("__m"))
    summed = per.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("__m", i.cast("long")), F.lit(0))).alias("__s"))
    n = summed.withColumn("__n", F.sqrt(F.aggregate("__s", F.lit(0.0), lambda a, x: a + x * x)))
    return n.select(key, F.transform("__s", lambda x: F.when(F.col("__n") > 0, x / F.col("__n")).otherwise(F.lit(0.0))).alias(out))


def usable(vector: Column | str, dim: int) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce((F.size(v) == dim) & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a side is null or all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def upsert(index: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index with the batch's rows in place of older ones of the same key; rows without embedding are left out."""
    new = batch.where(F.col("embedding").isNotNull())
    return index.join(new.select(key), key, "left_anti").unionByName(new.select(*index.columns))


def delete(index: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return index.join(ids.select(key), key, "left_anti")


def verify(ids: DataFrame, index: DataFrame, order: str, key: str = "chunk_id", sample: int | None = VERIFY_SAMPLE) -> DataFrame:
    """One row: asked, found, verified. The first ``sample`` ids in order are looked up; None looks up all. No ids: not verified."""
    asked = ids if sample is None else ids.orderBy(order, key).limit(sample)
    hit = asked.join(index.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    n = hit.agg(F.count(F.lit(1)).alias("asked"), F.count("__hit").alias("found"))
    return n.select("asked", "found", ((F.col("asked") > 0) & (F.col("found") >= F.col("asked"))).alias("verified"))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, dim: int, tile: int = TILE) -> DataFrame:
    """(query_id, id, score, rank): the k rows of highest cosine for every query, ties by id; queries and corpus have (id, v).

    Both sides are laid in blocks by hash, a task compares a block of queries with a tile of the corpus and keeps the k best
    of each query, and these are merged. Three shuffles: queries times tiles, corpus times blocks of queries, and k rows per
    query and tile. Nothing is broadcast, and a task holds one tile and one block, however many queries there are.
    """
    wanted, known = queries.where(usable("v", dim)), corpus.where(usable("v", dim))
    tiles, blocks = max(1, -(-known.count() // tile)), max(1, -(-wanted.count() // tile))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = F.col("v").cast("array<double>").alias("v")
    c = known.select(place(tiles).alias("tile"), "id", v, every(blocks).alias("block"))
    q = wanted.select(place(blocks).alias("block"), F.col("id").alias("query_id"), v, every(tiles).alias("tile"))

    def unit(vs: pd.Series) -> np.ndarray:
        x = np.stack(vs.to_numpy())
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("id")
            y, ids = unit(b["v"]), b["id"].to_numpy()
            for at in range(0, len(a), 512):
                part = a.iloc[at : at + 512]
                s = np.round(unit(part["v"]) @ y.T, 9)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), top.shape[1]), "id": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = q.groupBy("tile", "block").cogroup(c.groupBy("tile", "block")).applyInPandas(best, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
