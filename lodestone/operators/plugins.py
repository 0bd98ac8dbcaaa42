"""Plug-ins: encoders, pair scorers, processors, retriever factories, measures of a catalogue of collections."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BM25, QLDirichlet
from ..storage import stored
from .index import BowIndex
from .ranking import ranked, replay

#: Rows that an adapter hands over at once.
BUFFER = 64


class Encoder(Protocol):
    """Texts to rows of vectors. It is pickled to the workers; ``setup``, if it has one, runs there once a task."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    """Scores of query and document texts, pair by pair."""

    def score(self, queries: list[str], documents: list[str]) -> np.ndarray: ...


class Retriever(Protocol):
    """Topics ``(qid, text)`` to a ranked run ``(qid, doc_id, score, rank)``."""

    def __call__(self, topics: DataFrame) -> DataFrame: ...


class RetrieverFactory(Protocol):
    """A collection of documents to a retriever over it."""

    def __call__(self, documents: DataFrame) -> Retriever: ...


@dataclass
class Hooks:
    """Functions called with a plug-in on the worker before and after its ``setup``."""

    before: list[Callable] = field(default_factory=list)
    after: list[Callable] = field(default_factory=list)

    def prepare(self, plugin) -> None:
        for f in self.before:
            f(plugin)
        getattr(plugin, "setup", lambda: None)()
        for f in self.after:
            f(plugin)


def encoded(df: DataFrame, ident: str, text: str, encoder: Encoder, hooks: Hooks | None = None, size: int = BUFFER) -> DataFrame:
    """``id, vec`` of every text by a plugged encoder, ``size`` texts at a time; null text is empty."""
    hooks = hooks or Hooks()

    def run(batches):
        hooks.prepare(encoder)
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                x = np.asarray(encoder.encode([t or "" for t in part.column(1).to_pylist()]), np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vec"])

    return df.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {df.schema[ident].dataType.simpleString()}, vec array<double>")


def pair_scores(pairs: DataFrame, scorer: PairScorer, query: str = "query", document: str = "document", hooks: Hooks | None = None, size: int = BUFFER) -> DataFrame:
    """``pairs`` with ``score`` by a plugged scorer of text pairs, across queries, ``size`` pairs at a time."""
    hooks = hooks or Hooks()
    rows = pairs.drop("score")
    names, at = rows.columns, (rows.columns.index(query), rows.columns.index(document))

    def run(batches):
        hooks.prepare(scorer)
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                q, d = ([t or "" for t in part.column(k).to_pylist()] for k in at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.asarray(scorer.score(q, d), np.float64))], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, score double")


def scored_retriever(documents: DataFrame, first: Retriever, scorer: PairScorer, k: int | None = None) -> Retriever:
    """Two stages: a first retriever, then a plugged scorer over its candidates' texts."""

    def search(topics: DataFrame) -> DataFrame:
        run = first(topics).select("qid", "doc_id").join(topics.select("qid", F.col("text").alias("query")), "qid")
        run = run.join(documents.select("doc_id", F.col("text").alias("document")), "doc_id")
        return ranked(pair_scores(run, scorer).select("qid", "doc_id", "score"), k)

    return search


def per_collection(build: Callable[[DataFrame], object]) -> Callable[[DataFrame], object]:
    """``build`` called once for each collection, which is known by its plan."""
    known: dict[tuple[str, int], object] = {}

    @functools.wraps(build)
    def once(documents: DataFrame):
        key = (documents.sparkSession.sparkContext.applicationId, documents.semanticHash())
        if key not in known:
            known[key] = build(documents)
        return known[key]

    return once


@functools.singledispatch
def searcher(model, index: BowIndex, k: int) -> Retriever:
    """A retriever of the kind that the model's type calls for; further types are registered on this function."""
    raise TypeError(f"no retriever for {type(model).__name__}")


@searcher.register(BM25)
@searcher.register(QLDirichlet)
def _(model, index: BowIndex, k: int) -> Retriever:
    return lambda topics: index.search(topics, model, k)


def retriever(build_index: Callable[[DataFrame], BowIndex], documents: DataFrame, model: object, k: int = 1500) -> Retriever:
    """The retriever of a model over the index that ``build_index`` gives for the documents."""
    return searcher(model, build_index(documents), k)


class RunRetrievers:
    """Stored runs by key: a retriever of the run of a dataset, looked up by its key, else by its id."""

    def __init__(self, runs: dict[str, DataFrame] | None = None):
        self.runs = dict(runs or {})

    def add_run(self, key: str, run: DataFrame) -> RunRetrievers:
        self.runs[key] = run
        return self

    def __call__(self, key: str, dataset_id: str | None = None, k: int | None = None) -> Retriever:
        run = self.runs.get(key, self.runs.get(dataset_id))
        if run is None:
            raise KeyError(f"no run for {key!r} or {dataset_id!r}")
        return lambda topics: replay(run, topics, k)


class Catalogue:
    """Collections by name; a collection is prepared once in a session and then read from where it was written."""

    def __init__(self):
        self.makers: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def add(self, name: str, make: Callable[[SparkSession], DataFrame]) -> Catalogue:
        self.makers[name] = make
        return self

    def prepare(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.makers:
            raise KeyError(f"no collection {name!r}")
        return spark.read.parquet(stored(spark, "collection", name, lambda path: self.makers[name](spark).write.parquet(path)))


Processor = Callable[[DataFrame], DataFrame | None]


def processed(df: DataFrame, processors: Iterable[Processor]) -> DataFrame:
    """The processors one after the other; one that returns None keeps the rows as they are."""
    for f in processors:
        out = f(df)
        df = df if out is None else out
    return df


def buffered(df: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, size: int = BUFFER) -> DataFrame:
    """``work`` on runs of exactly ``size`` rows of each partition, and on what is left at its end."""

    def run(batches):
        kept, n = [], 0
        for b in batches:
            while n + b.num_rows >= size:
                yield from work(pa.Table.from_batches([*kept, b.slice(0, size - n)])).to_batches()
                b, kept, n = b.slice(size - n), [], 0
            if b.num_rows:
                kept.append(b)
                n += b.num_rows
        if kept:
            yield from work(pa.Table.from_batches(kept)).to_batches()

    return df.mapInArrow(run, schema)


def process_members(samples: DataFrame, ident: str, members: str, key: str, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Puts ``process``, a function of distinct ``(key)`` rows to ``(key, value)``, to the members of all samples at once.

    ``members`` is an array column of keys; the result has ``ident`` and ``values`` in the members' order.
    Members that ``process`` leaves out have a null value.
    """
    rows = samples.select(ident, F.posexplode(members).alias("_pos", key))
    done = process(rows.select(key).distinct()).select(key, F.col("value").alias("_value"))
    rows = rows.join(done, key, "left").groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("_pos", "_value"))).alias("_all"))
    return rows.select(ident, F.transform("_all", lambda x: x["_value"]).alias("values"))


def each(df: DataFrame, effect: Callable[[pa.RecordBatch], None]) -> DataFrame:
    """The rows as they are, after ``effect`` has seen each batch of them on the worker."""

    def run(batches):
        for b in batches:
            effect(b)
            yield b

    return df.mapInArrow(run, df.schema)
