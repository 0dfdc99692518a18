"""The ingestion: detect changes, load, split, embed, index, verify, commit; each stage behind a gate with bounded retries.

The driver holds counters and a status, never rows. What a stage makes is written once (to the shared checkpoint
folder), so a gate that counts it, and the stage after, don't make it again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import redaction
from thicket.functions.redaction import Recogniser
from thicket.functions.text import CLEAN, NORMALISE, empty_if_null, staged
from thicket.operators import changes, gates, markdown, vectors
from thicket.plans import providers
from thicket.plans.errors import stage
from thicket.session import cut
from thicket.sources import files as F_
from thicket.sources.converters import Converter
from thicket.sources.store import Store


@dataclass
class Outcome:
    """How an ingestion went."""

    status: str = "INIT"
    changes: dict[str, int] = field(default_factory=dict)
    retries: dict[str, int] = field(default_factory=dict)
    chunks: int = 0
    malformed: int = 0
    failed: list[tuple[str, str]] = field(default_factory=list)  # a bounded report: at most REPORT files
    steps: list[str] = field(default_factory=list)


REPORT = 100


class HashEmbedder:
    """The offline default embedder marker: embedding by a column function, without Python."""

    def __init__(self, dim: int = 64):
        self.dim = dim


@dataclass
class Ingestion:
    spark: SparkSession
    ledger: Store
    index: Store
    converter: Converter | None = None
    #: None takes what is registered for "summarization", or else the offline default.
    summariser: markdown.Summariser | None = None
    embedder: vectors.Embedder | HashEmbedder = field(default_factory=HashEmbedder)
    recogniser: Recogniser | None = None
    #: Where given, files of the length and time they were last hashed at keep that hash and aren't opened again.
    seen: Store | None = None
    #: Off by default: the production flow cleans and propagates headings only.
    normalise_and_redact: bool = False
    attempts: int = changes.MAX_ATTEMPTS
    on_step: Callable[[str], None] | None = None

    def _step(self, out: Outcome, status: str) -> None:
        out.status = status
        out.steps.append(status)
        if self.on_step:
            self.on_step(status)

    def _load(self, todo: DataFrame, out: Outcome) -> tuple[DataFrame, DataFrame]:
        """Documents and what failed for good; only failed files are tried again."""
        done, left = None, todo
        for n in range(self.attempts):
            both = cut(F_.convert(left, self.converter))
            good = both.where("error is null")
            done = good if done is None else done.unionByName(good)
            bad = both.where("error is not null")
            if bad.isEmpty() or n == self.attempts - 1:
                return done.select("file_name", "markdown_content"), bad.select("file_name", "error")
            out.retries["load"] = n + 1
            left = F_.among(self.spark, todo, bad)
        raise AssertionError("unreachable")

    def _hashed(self, found: DataFrame) -> DataFrame:
        """(file_name, content_hash, size_bytes, modified_at) of all accepted files."""
        if self.seen is None:
            return cut(F_.hashed(found))
        known = self.seen.read().select("file_name", "content_hash", F.col("size_bytes").alias("length"), F.col("modified_at").alias("modified"))
        names = found.select("file_name", "length", "modified")  # without content: nothing is opened
        same = cut(names.join(known, ["file_name", "length", "modified"]).select("file_name", "content_hash", F.col("length").alias("size_bytes"), F.col("modified").alias("modified_at")))
        fresh = cut(F_.hashed(F_.among(self.spark, found, names.join(same, "file_name", "left_anti"))))
        self.seen.change(fresh.select("file_name"), lambda old: old.join(fresh, "file_name", "left_anti").unionByName(fresh))
        return same.unionByName(fresh)

    def _split(self, docs: DataFrame, summariser: markdown.Summariser | None) -> DataFrame:
        steps = [*CLEAN, *NORMALISE, *redaction.steps(self.recogniser), empty_if_null] if self.normalise_and_redact else CLEAN
        enriched = markdown.propagate(staged(docs.select("file_name", F.col("markdown_content").alias("t")), "t", *steps), "file_name", "t")
        return markdown.chunks(enriched, "file_name", "markdown", summariser=summariser)

    def _embed(self, chunks: DataFrame) -> DataFrame:
        if isinstance(self.embedder, HashEmbedder):
            made = vectors.hash_embedding(chunks, "chunk_id", "content_to_embed", dim=self.embedder.dim)
            return chunks.join(made, "chunk_id", "left").withColumn("embedding", F.col("embedding").cast("array<float>")).select(*chunks.columns, "embedding")
        return vectors.embed(chunks, "content_to_embed", self.embedder).drop("embed_error")

    def run(self, folder: str) -> Outcome:
        out = Outcome()
        with stage("detect"):
            found = F_.scan(self.spark, folder)
            every = F_.listed(self.spark, folder).select("file_name")
            now = self._hashed(found)
            ledger = self.ledger.read()
            classed = cut(changes.classify(every.join(now, "file_name", "left").select("file_name", "content_hash"), ledger))
            out.changes = {r["change"]: r["count"] for r in classed.groupBy("change").count().collect()}
            todo = F_.among(self.spark, found, classed.where(F.col("change").isin("new", "modified")))
        stale = changes.stale_ids(classed)
        deleted = classed.where("change = 'deleted'").select("file_name")
        if out.changes.get("deleted"):
            with stage("delete"):  # before loading, which may end the run; the ledger comes last here too
                self.index.change(deleted, lambda old: vectors.delete(old, stale.join(deleted, "file_name", "left_semi")))
                self.ledger.change(deleted, lambda old: changes.ledger_delete(old, deleted))
        if not out.changes.get("new", 0) + out.changes.get("modified", 0):
            self._step(out, "END")
            return out
        with stage("load"):
            docs, bad = self._load(todo, out)
            out.failed = [(r["file_name"], r["error"]) for r in bad.orderBy("file_name").limit(REPORT).collect()]
        if docs.isEmpty():
            self._step(out, "LOAD_FAILED")
            return out
        self._step(out, "DOCS_LOADED")
        summariser = self.summariser or providers.provider("summarization")
        with stage("split"):
            for n in range(self.attempts):
                chunks = cut(self._split(docs, summariser))
                g = gates.gate_chunks(chunks).first()
                out.chunks, out.malformed = g["chunks"], g["malformed"]
                if g["decision"] == "embed":
                    break
                out.retries["split"] = n + 1
                if summariser is None:
                    break  # nothing that could come out otherwise
            if out.malformed:  # their files stay as they were and come again next time; the others go on
                bad = cut(gates.malformed(chunks).select(F.col("metadata.file_name").alias("file_name")).distinct())
                out.failed += [(r["file_name"], "malformed chunks") for r in bad.orderBy("file_name").limit(REPORT - len(out.failed)).collect()]
                chunks = cut(chunks.where(F.col("metadata.file_name").isNotNull()).withColumn("file_name", F.col("metadata.file_name")).join(bad, "file_name", "left_anti").drop("file_name"))
                docs = docs.join(bad, "file_name", "left_anti")
                out.chunks = chunks.count()
            if not out.chunks:
                self._step(out, "CHUNKS_FAILED")
                return out
        self._step(out, "CHUNKS_CREATED")
        with stage("embed"):
            embedded = cut(self._embed(chunks))
            for n in range(self.attempts - 1):  # its own counter; only chunks without an embedding go again
                if gates.gate_embeddings(embedded).first()["decision"] == "index":
                    break
                out.retries["embed"] = n + 1
                embedded = cut(embedded.where("embedding is not null").unionByName(self._embed(embedded.where("embedding is null").drop("embedding")).select(*embedded.columns)))
            if gates.gate_embeddings(embedded).first()["decision"] != "index":
                self._step(out, "EMBEDDINGS_FAILED")
                return out
        self._step(out, "EMBEDDINGS_GENERATED")
        with stage("index"):
            loaded = docs.select("file_name")
            gone = stale.join(loaded, "file_name", "left_semi")  # a file that failed keeps its vectors
            self.index.change(loaded, lambda old: vectors.upsert(vectors.delete(old, gone), embedded))
            check = vectors.verify(embedded.select("chunk_id"), self.index.read(), "chunk_id", sample=None).first()
            if not check["verified"]:
                self._step(out, "INDEXING_FAILED")
                return out
        with stage("commit"):  # the ledger comes last, so a crash before it leads to the same work again
            counts = gates.chunks_per_file(embedded, now.join(loaded, "file_name", "left_semi"))
            rows = counts.select("file_name", "content_hash", F.lit("indexed").alias("status"), F.col("chunk_count").cast("int").alias("chunk_count"), F.current_timestamp().alias("last_indexed_at"))
            self.ledger.change(loaded, lambda old: changes.ledger_upsert(old, rows))
        self._step(out, "INDEXED")
        return out
