"""Rank, cut, replay and hydrate runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import RUN, require_columns


def ranked(run: DataFrame, k: int | None = None, by: str = "qid") -> DataFrame:
    """Adds ``rank`` by (rounded score descending, doc_id) within ``by``; keeps the first ``k``.

    Scores are rounded to 6 digits first, so that ties do not hang on the order of summation.
    """
    run = require_columns(run, (by, *RUN[1:])).withColumn("score", F.round("score", 6))
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc_id")
    out = run.withColumn("rank", F.row_number().over(order))
    return (out.where(F.col("rank") <= k) if k else out).withColumn("rank", F.col("rank").cast("bigint"))


def unique_run(run: DataFrame) -> DataFrame:
    """One row per (qid, doc_id): of repeated rows the greatest score."""
    return run.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))


def replay(run: DataFrame, topics: DataFrame, k: int | None = None) -> DataFrame:
    """A stored run as a retriever: the topics' rows of the run, ranked; topics without rows give none."""
    return ranked(run.join(topics.select("qid").distinct(), "qid", "left_semi"), k)


def hydrated(run: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds the documents' texts; ids that the store lacks are left out."""
    return run.join(documents.select("doc_id", "text"), "doc_id")


def full_retriever(topics: DataFrame, documents: DataFrame) -> DataFrame:
    """Every document for every topic, score 0, ranked by id. The topics are the stated query set."""
    return ranked(topics.select("qid").crossJoin(documents.select("doc_id")).withColumn("score", F.lit(0.0)))


def rerank(run: DataFrame, score: Column, k: int | None = None) -> DataFrame:
    """Second stage: rows of a first stage (with whatever columns ``score`` needs) scored anew, ranked and cut."""
    return ranked(run.withColumn("score", score), k)


def duo_rerank(run: DataFrame, preference: Column, k: int | None = None, columns=()) -> DataFrame:
    """Scores all ordered pairs of a topic's candidates and sums over the second document.

    ``preference`` reads the columns of the first as they are and of the second with the suffix ``_2``.
    Candidates are a first stage's top-k, so the pairs per topic are bounded.
    """
    left = run.select("qid", "doc_id", *columns)
    right = run.select("qid", F.col("doc_id").alias("doc_id_2"), *[F.col(c).alias(f"{c}_2") for c in columns])
    pairs = left.join(right, "qid").where("doc_id <> doc_id_2")
    return ranked(pairs.groupBy("qid", "doc_id").agg(F.sum(preference).alias("score")), k)


def document_subset(documents: DataFrame, ids: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Documents of an id list ``(ord, doc_id)``, in its order; optionally a slice start <= ord < stop."""
    ids = ids.where(F.col("ord") >= start) if start else ids
    ids = ids.where(F.col("ord") < stop) if stop is not None else ids
    return documents.join(ids.select("doc_id", "ord"), "doc_id")


def batches(df: DataFrame, order: str, n: int) -> DataFrame:
    """Adds ``batch``: numbers of groups of ``n`` rows in the order of a dense integer column."""
    return df.withColumn("batch", F.floor(F.col(order) / n).cast("bigint"))


def full_batches(df: DataFrame, order: str, n: int) -> DataFrame:
    """``batches`` without a last one that has fewer than ``n`` rows."""
    last = F.broadcast(df.agg(F.max(order).alias("_last")))  # one row
    return batches(df, order, n).crossJoin(last).where(F.col("batch") < F.floor((F.col("_last") + 1) / n)).drop("_last")
