"""Interfaces to encoders and rerankers: models are injected, batches go through Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POOL = 50
PROFILES = ("lexical", "semantic")


@dataclass(frozen=True)
class Stack:
    """What an index was built with; results of different stacks are not compared."""

    profile: str
    embedding_model: str
    reranker_model: str

    def __post_init__(self) -> None:
        if self.profile not in PROFILES:
            raise ValueError(f"unknown retrieval profile {self.profile!r}")

    @property
    def fingerprint(self) -> str:
        return "|".join((self.profile, self.embedding_model, self.reranker_model))

    def require(self, fingerprint: str) -> None:
        if fingerprint != self.fingerprint:
            raise ValueError(f"built with {fingerprint}, not with {self.fingerprint}")


def _encode(make: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str, size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()  # once a task
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vecs = model([prefix + (t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vecs, pa.list_(pa.float64()))], names=["id", "vec"])

    return work


def encode(texts: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = "", batch: int = 256) -> DataFrame:
    """(id, vec) of texts (id, text) by an encoder that make() loads on the worker; prefix tells queries from documents."""
    return texts.select(F.col("id").cast("bigint"), "text").mapInArrow(_encode(make, prefix, batch), "id bigint, vec array<double>")


def _score(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            q, t = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("query", "text"))
            scores = model([(a or "", b or "") for a, b in zip(q, t)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(scores, pa.float64())], names=["query_id", "doc_id", "rank", "score"])

    return work


def rerank(hits: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], k: int, pool: int = POOL) -> DataFrame:
    """The first pool of each query's hits (query_id, doc_id, rank, query, text) ordered by a pair model: best score
    first, then the rank they came with; k of them with their new rank."""
    scored = hits.where(F.col("rank") < pool).select(F.col("query_id").cast("bigint"), F.col("doc_id").cast("bigint"), F.col("rank").cast("int"), "query", "text").mapInArrow(_score(make), "query_id bigint, doc_id bigint, rank int, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).select("query_id", "doc_id", (F.col("_rn") - 1).alias("rank"), "score")
