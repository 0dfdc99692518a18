"""The documented query loop: retrieve, grade, route, fall back, assemble the context. Answers are a pluggable step."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.operators.vectors import top_k
from thicket.plans import providers

#: Our choices: how many chunks are retrieved and the cosine from which one is relevant.
K, RELEVANT = 5, 0.6


class Generator(Protocol):
    """Answers a question from its context."""

    def generate(self, questions: list[str], contexts: list[str]) -> list[str]: ...


class Grader(Protocol):
    """Says of (question, text) pairs whether the text helps to answer the question."""

    def relevant(self, questions: list[str], texts: list[str]) -> list[bool]: ...


def grade(hits: DataFrame, least: float = RELEVANT) -> DataFrame:
    """Adds relevant: whether a retrieved row is similar enough; the offline default."""
    return hits.withColumn("relevant", F.col("score") >= least)


def grade_texts(hits: DataFrame, question: str, text: str, grader: Grader | None = None, least: float = RELEVANT) -> DataFrame:
    """Adds relevant, said by a grader, given or registered for "grading"; by the score where there is none.

    A batch that fails is graded by the score, too.
    """
    asked = grader or providers.provider("grading")
    if asked is None:
        return grade(hits, least)
    schema = T.StructType([*hits.schema.fields, T.StructField("relevant", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                said = list(asked.relevant(pdf[question].tolist(), pdf[text].tolist()))
                if len(said) != len(pdf):
                    raise ValueError("answers are missing")
            except Exception:  # this batch only
                said = (pdf["score"] >= least).tolist()
            yield pdf.assign(relevant=said)

    return hits.mapInPandas(run, schema)


def route(graded: DataFrame) -> DataFrame:
    """(query_id, best, relevant, route): generate with a relevant row, else fallback."""
    n = graded.groupBy("query_id").agg(F.max("score").alias("best"), F.sum(F.col("relevant").cast("long")).alias("relevant"))
    return n.withColumn("route", F.when(F.col("relevant") > 0, "generate").otherwise("fallback"))


def fallback(queries: DataFrame, routed: DataFrame, graded: DataFrame, secondary: DataFrame, k: int, dim: int) -> DataFrame:
    """(query_id, origin, id, score, rank): relevant rows of the routed-to-generate queries, and for the rest the secondary corpus."""
    kept = graded.where("relevant").select("query_id", F.lit("primary").alias("origin"), "id", "score", "rank")
    lost = queries.join(routed.where("route = 'fallback'").select(F.col("query_id").alias("id")), "id", "left_semi")
    other = top_k(lost, secondary, k, dim).select("query_id", F.lit("secondary").alias("origin"), "id", "score", "rank")
    return kept.unionByName(other)


def context(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, parts, context): the texts (id, text) of a query's hits in order of rank, blank lines between."""
    joined = hits.join(texts, "id")
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return joined.groupBy("query_id").agg(F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("context"))


def answer(contexts: DataFrame, questions: DataFrame, generator: Generator | None = None, batch: int = 16) -> DataFrame:
    """(query_id, answer, error): a generator's answers to (id, question) from their contexts, batch by batch.

    Without a generator, the one registered for "generation" is asked; it is an error if there is none.
    A batch that fails gives null answers with its error; queries without context are asked with an empty one.
    """
    generator = generator or providers.provider("generation")
    if generator is None:
        raise ValueError("no generator is given or registered")
    asked = questions.select(F.col("id").alias("query_id"), "question").join(contexts.select("query_id", "context"), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                try:
                    said, error = generator.generate(part["question"].tolist(), part["context"].tolist()), None
                except Exception as e:  # this batch only
                    said, error = [None] * len(part), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy(), "answer": pd.Series(said, dtype=object), "error": error})

    return asked.mapInPandas(run, "query_id long, answer string, error string")
