"""The engine: build an index, ingest files, answer questions, list documents.

Every call is a batch: one plan for all files, or for all questions.
"""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.clients import ChatCompletions, Client
from lodestone.functions.identity import document_id, point_id
from lodestone.models import Embedder, HashedWords
from lodestone.operators import answer, chunking, latent, rerank, retrieval, verify
from lodestone.plans.segments import Segments
from lodestone.plans.store import Store, checked_vectors, complete, merge_existing_wins
from lodestone.session import drop_stash, stash
from lodestone.sources import files as sources


class EngineError(RuntimeError):
    """The engine's state does not allow what was asked."""


@dataclass(frozen=True)
class EngineConfig:
    """Where data lie and how candidates are ranked. many_parts: segments of like size from which they are merged."""

    store_path: str
    data_path: str = "data/raw"
    candidate_k: int = 20
    rrf_k: int = 60
    retrieval_weight: float = 0.5
    reranker_weight: float = 0.5
    context_k: int = 5
    log_level: str = "INFO"
    bm25: retrieval.Bm25 = retrieval.Bm25()
    many_parts: int = 8
    model_url: str = "http://localhost:1234/v1"
    model_name: str = ""

    @staticmethod
    def from_env(store_path: str | None = None, environ: Mapping[str, str] | None = None) -> EngineConfig:
        """The configuration that environment variables give; a store path that is passed comes first."""
        get = (os.environ if environ is None else environ).get
        store = store_path or get("LODESTONE_STORE_PATH")
        if not store:
            raise EngineError("no store path: pass one or set LODESTONE_STORE_PATH")
        own = EngineConfig(store)
        named = {"data_path": "DATA_PATH", "log_level": "LOG_LEVEL", "model_url": "LM_STUDIO_BASE_URL", "model_name": "LM_STUDIO_MODEL"}
        return replace(own, **{name: value for name, variable in named.items() if (value := get(variable))})

    def client(self) -> ChatCompletions | None:
        """The chat model that is configured, if any."""
        return ChatCompletions(self.model_name, self.model_url) if self.model_name else None


class JsonLines(logging.Formatter):
    """A log record as one JSON line: timestamp, level, logger, event and what was passed as fields."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat()
        row = {"timestamp": at, "level": record.levelname, "logger": record.name, "event": record.getMessage()}
        return json.dumps(row | getattr(record, "fields", {}), ensure_ascii=False, default=str)


def configure_logging(level: str = "INFO") -> logging.Logger:
    """The package's logger with a single JSON handler."""
    logger = logging.getLogger("lodestone")
    handler = logging.StreamHandler()
    handler.setFormatter(JsonLines())
    logger.handlers, logger.propagate = [handler], False
    logger.setLevel(level)
    return logger


@dataclass
class Timer:
    """Mean milliseconds of what was timed; 0 if nothing was."""

    times: list[float] = field(default_factory=list)

    def run(self, work):
        start = time.perf_counter()
        try:
            return work()
        finally:
            self.times.append(1000 * (time.perf_counter() - start))

    @property
    def average_ms(self) -> float:
        return sum(self.times) / len(self.times) if self.times else 0.0


class Engine:
    def __init__(
        self, spark: SparkSession, config: EngineConfig, embedder: Embedder | None = None,
        pair_score: rerank.PairScore = rerank.overlap, verdict: verify.Verdict = verify.overlap_verdict, generator=None,
        client: Client | None = None, payload: dict[str, Column] | None = None, learned: latent.Settings | None = None,
    ) -> None:
        """client: a model that generates, finds claims and verifies; payload: further (or other) payload fields of vectors.

        learned: without an embedder, one is fitted to the chunks by build_index, or by
        the first ingest, and stored; later ingests use it as it is.
        """
        self.spark, self.config, self.store = spark, config, Store(spark, config.store_path)
        self.learned = learned if embedder is None else None
        self._given, self._fitted = embedder or HashedWords(), (None, None)
        self.client = client
        self.pair_score, self.verdict = pair_score, verdict
        self.generator = answer.generator(client) if generator is None and client is not None else generator
        self.payload = payload or {}
        self.segments = Segments(self.store, schemas.of("CHUNK"), self._vectors, config.bm25, config.many_parts)
        self.log = logging.getLogger("lodestone.engine")

    # -------------------------------------------------------------- tables

    @property
    def embedder(self) -> Embedder:
        """The embedder that was passed, or the one that the store holds."""
        if self.learned is None:
            return self._given
        paths, model = self._fitted
        if (now := self.store.current().get("embedder")) and now != paths:
            model = latent.LatentWords.of(self.store.read("embedder"))
            self._fitted = now, model
        if model is None:
            raise EngineError("no embedder is fitted yet; build the index or ingest files first")
        return model

    def _fit(self, chunks: DataFrame) -> dict[str, DataFrame]:
        """The table of an embedder fitted to chunks, to be committed with their vectors."""
        if self.learned is None:
            return {}
        model = latent.fit(chunks, self.learned)
        self._fitted = self.store.current().get("embedder"), model
        return {"embedder": model.table()}

    def chunks(self) -> DataFrame:
        return self.segments.chunks()

    def registry(self) -> DataFrame:
        return self.store.read("registry", schemas.of("REGISTRY_ROW"))

    def list_documents(self) -> DataFrame:
        return self.registry()

    def find_document(self, document_id: str) -> DataFrame:
        """The registry's first row with this id."""
        return self.registry().where(F.col("document_id") == document_id).orderBy("ingested_at").limit(1)

    def _chunked(self, files: DataFrame) -> DataFrame:
        documents = sources.documents(files)
        return chunking.route(documents)

    def _vectors(self, chunks: DataFrame) -> DataFrame:
        fields = {n: F.col(n).cast("string") for n in ("chunk_id", "source", "file_type", "chunk_index", "chunking_strategy")}
        fields |= {n: c.cast("string") for n, c in self.payload.items()}
        payload = F.map_from_arrays(F.array(*[F.lit(n) for n in fields]), F.array(*fields.values()))
        rows = chunks.select(
            "chunk_id", point_id("chunk_id").alias("point_id"), self.embedder.embed(F.col("text")).alias("embedding"),
            payload.alias("payload"),
        )
        return checked_vectors(rows, self.embedder.model.dimension)

    def _registered(self, files: DataFrame, chunks: DataFrame) -> DataFrame:
        """Registry rows of files (path, content, extension) from their chunks."""
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
        counted = chunks.groupBy("source").agg(
            F.count(F.lit(1)).cast("int").alias("chunk_count"), F.collect_set("chunking_strategy").alias("_s")
        )
        named = files.select(
            document_id("content").alias("document_id"), sources.plain_path(F.col("path")).alias("source"),
            F.substring("extension", 2, 10).alias("file_type"),
        )
        strategy = F.when(F.size("_s") == 1, F.get("_s", F.lit(0))).otherwise("mixed")
        rows = named.join(counted, "source", "left").withColumn(
            "chunk_count", F.coalesce("chunk_count", F.raise_error(F.concat(F.lit("no chunks for "), F.col("source"))).cast("int"))
        )
        return rows.select(
            "document_id", sources.name_of(F.col("source")).alias("filename"), "file_type", "chunk_count",
            now.alias("ingested_at"), strategy.alias("chunking_strategy"),
        )

    # -------------------------------------------------------------- writing

    def build_index(self, folder: str | None = None) -> int:
        """Replace everything by the index of a folder's files; how many chunks there are."""
        files = sources.scan(self.spark, folder or self.config.data_path)
        if files.isEmpty():
            raise EngineError("no supported files")
        chunks = stash(self._chunked(files), "chunks")  # files are read and cut once
        registry = self._registered(files, chunks)
        try:
            self.segments.replace_all(chunks, {"registry": registry, **self._fit(chunks)})
        finally:
            self._fitted = None, None  # what a failed commit was to store is not used
        drop_stash(chunks)
        count = self.chunks().count()
        self.log.info("index_built", extra={"fields": {"chunks": count}})
        return count

    def rebuild_vectors(self, rebuild: bool = False) -> bool:
        """Build the vectors of the stored chunks, unless those that are stored are complete; whether they were built."""
        if not rebuild and self.store.labels("vectors") and complete(self.segments.vector_rows(), self.chunks()):
            return False
        self.segments.build_vectors()
        if not complete(self.segments.vector_rows(), self.chunks()):
            raise EngineError("not every chunk has a vector")
        return True

    def bootstrap_registry(self, folder: str | None = None) -> DataFrame:
        """Register a folder's files whose chunks are stored and that aren't registered yet."""
        files = sources.scan(self.spark, folder or self.config.data_path)
        new = files.withColumn("document_id", document_id("content")).join(self.registry(), "document_id", "left_anti")
        rows = self._registered(new, self.chunks())
        self.store.commit({"registry": merge_existing_wins(self.registry(), rows, "document_id")})
        return self.registry()

    def ingest(self, uploads: DataFrame) -> DataFrame:
        """Add files (filename, content); their registry rows, with `duplicate` for those known before.

        Only the basename of a filename counts. An unsupported type or an empty
        file is an error, and then nothing is added. Of equal files in one batch the
        first by name is added. The registry row is part of the same commit as
        the chunks, postings and vectors.
        """
        name = F.regexp_replace(F.regexp_replace("filename", r"\\", "/"), r"(?s)\A.*/", "")
        rows = uploads.select(name.alias("filename"), "content", document_id("content").alias("document_id"))
        rows = rows.withColumn("extension", sources.extension(F.col("filename")))
        bad = rows.where(~F.col("extension").isin(*sources.SUPPORTED) | (F.length("content") == 0)).limit(1).collect()
        if bad:
            empty = bad[0]["extension"] in sources.SUPPORTED
            raise sources.SourceError("the file is empty" if empty else f"unsupported file type {bad[0]['extension']!r}")
        base = self.store.version()
        known = self.registry().withColumn("duplicate", F.lit(True))
        first = F.row_number().over(Window.partitionBy("document_id").orderBy("filename"))
        new = rows.join(known, "document_id", "left_anti").withColumn("_n", first).where("_n = 1").drop("_n")
        files = new.select(F.concat("document_id", F.lit("_"), "filename").alias("path"), "content", "extension")
        if not files.isEmpty():
            chunks = stash(self._chunked(files), "chunks")
            added = self._registered(files, chunks)
            self._add(chunks, added, base)
        asked = rows.select("document_id").distinct()
        before = known.join(asked, "document_id", "left_semi")
        fresh = self.registry().join(asked, "document_id", "left_semi").join(known, "document_id", "left_anti")
        return before.unionByName(fresh.withColumn("duplicate", F.lit(False)))

    def _add(self, chunks: DataFrame, registry: DataFrame, base: int | None = None) -> None:
        """Chunks, vectors and postings as a segment, and registry rows, in one commit.

        No stored posting is read. Chunks that are stored already replace the old
        ones. Segments of like size are merged when there are many.
        """
        try:
            first = self._fit(chunks) if "embedder" not in self.store.current() else {}
            self.segments.add(chunks, {"registry": registry, **first}, base)
        finally:
            self._fitted = None, None
        self.segments.compact()
        if self.store.parts("registry") >= self.config.many_parts:
            self.store.compact(["registry"])

    # -------------------------------------------------------------- answering

    def lexical_index(self) -> retrieval.LexicalIndex:
        return self.segments.index()

    def retrieve(self, questions: DataFrame, where: DataFrame | None = None) -> DataFrame:
        """Hybrid candidates of questions (query_id, text). where: the chunk_ids that may be found."""
        lexical = retrieval.bm25(self.lexical_index(), questions, self.config.candidate_k, where, fill_zero=True)
        vectors = self.segments.vector_rows().withColumn("position", F.col("chunk_id"))
        if where is not None:
            vectors = vectors.join(where, "chunk_id", "left_semi")
        asked = questions.select("query_id", self.embedder.embed(F.col("text")).alias("embedding"))
        dense = retrieval.dense(vectors, asked, self.config.candidate_k)
        return retrieval.hybrid(lexical, dense, self.config.rrf_k, self.config.candidate_k)

    def _ranked(self, questions: DataFrame, chunks: DataFrame) -> DataFrame:
        c = self.config
        weights = (c.retrieval_weight, c.reranker_weight)
        return rerank.two_stage(
            self.retrieve(questions), questions, chunks, c.candidate_k, c.context_k, True, self.pair_score, weights, c.rrf_k
        )

    def ask(self, questions: DataFrame) -> DataFrame:
        """Questions (query_id, text) with answer, citations, checks, decision and final answer."""
        if "chunks" not in self.store.current():
            raise EngineError("the index is empty; build it or ingest files first")
        checked = rerank.reject_blank(questions, "text")
        chunks = self.chunks()
        ranked = self._ranked(checked, chunks).join(chunks.select("chunk_id", "source", "file_type", "metadata"), "chunk_id")
        blocks = answer.context_blocks(ranked, self.config.context_k)
        prompts = answer.prompts(answer.contexts(blocks, checked), checked)
        answers = stash(answer.cited(answer.generate(prompts, self.generator)), "answers")  # generated once
        return verify.verify(answers, self.verdict, self.client)

    def evidence(self, questions: DataFrame) -> DataFrame:
        """Each chunk of a question's context with its retrieval, reranker and final rank and score."""
        checked = rerank.reject_blank(questions, "text")
        chunks = self.chunks()
        return self._ranked(checked, chunks).join(chunks.select("chunk_id", "source", "file_type"), "chunk_id").select(
            "query_id", F.substring("chunk_id", 1, 12).alias("chunk"), "source", "file_type", "retrieval_rank", "retrieval_score",
            "reranked_rank", "reranker_score", "final_rank", "final_score",
        )

    def trace(self, questions: DataFrame) -> DataFrame:
        """Each candidate with its fused, dense and lexical rank and score (null where it was not found)."""
        of = lambda n, f: F.try_element_at("sources", F.lit(n))[f].alias(f"{n}_{f}")
        return self.retrieve(questions).select(
            "query_id", F.substring("chunk_id", 1, 12).alias("chunk"), F.col("rank"), F.col("score").alias("rrf_score"),
            of("dense", "rank"), of("dense", "score"), of("bm25", "rank"), of("bm25", "score"),
        )
