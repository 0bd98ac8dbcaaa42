"""Folds, subsets and sub-collections of test collections; document samplers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hashed_order
from ..schema import Adhoc


def topic_fold(topics: DataFrame, ids: DataFrame) -> DataFrame:
    return topics.join(ids.select("qid").distinct(), "qid", "left_semi")


qrels_fold = topic_fold


def fold(dataset: Adhoc, ids: DataFrame) -> Adhoc:
    """Topics and judgements restricted to the ids; the documents stay."""
    return Adhoc(dataset.documents, topic_fold(dataset.topics, ids), qrels_fold(dataset.qrels, ids))


def fold_sizes(sizes: list[float], n: int) -> list[int]:
    """Counts, or shares that sum to 1 (within 1e-6), as counts; shares are rounded half to even."""
    if abs(sum(sizes) - 1) < 1e-6:
        return [round(s * n) for s in sizes]
    return [int(s) for s in sizes]


def random_fold(topics: DataFrame, sizes: list[float], seed: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """``qid, fold``: topics dealt out in hashed order by cumulative sizes, without the excluded ones.

    The order is a total one over the topics, so it runs in one task; topic sets are small tables.
    """
    if exclude is not None:
        topics = topics.join(exclude.select("qid").distinct(), "qid", "left_anti")
    n = topics.count()
    counts = fold_sizes(sizes, n)
    if any(c <= 0 for c in counts):
        raise ValueError(f"empty fold among {counts}")
    pos = F.row_number().over(Window.orderBy(hashed_order(seed, F.col("qid").cast("string")), "qid")) - 1
    rows = topics.select("qid").withColumn("_p", pos)
    number: Column = F.lit(None).cast("bigint")
    start = 0
    for i, c in enumerate(counts):
        stop = n if i == len(counts) - 1 and abs(sum(sizes) - 1) < 1e-6 else start + c
        number = F.when((F.col("_p") >= start) & (F.col("_p") < stop), F.lit(i).cast("bigint")).otherwise(number)
        start = stop
    return rows.withColumn("fold", number).where("fold is not null").drop("_p")


def concatenated(datasets: list[Adhoc]) -> Adhoc:
    """Union of topics and judgements over one document collection; judgements of kept topics only."""
    topics, qrels = datasets[0].topics, datasets[0].qrels
    for d in datasets[1:]:
        topics, qrels = topics.unionByName(d.topics), qrels.unionByName(d.qrels)
    return Adhoc(datasets[0].documents, topics, qrels_fold(qrels, topics))


def retriever_collection(qrels: DataFrame, run: DataFrame, threshold: int = 0) -> DataFrame:
    """``doc_id``: judged documents, both sides of ``threshold``, and retrieved ones, of topics with judgements."""
    relevant, other = qrels.where(F.col("rel") > threshold), qrels.where(F.col("rel") <= threshold)
    found = run.join(qrels.select("qid").distinct(), "qid", "left_semi")
    return relevant.select("doc_id").union(other.select("doc_id")).union(found.select("doc_id")).distinct()


def head_documents(documents: DataFrame, max_count: int | None = None, ratio: float | None = None) -> DataFrame:
    """The first documents by id: ``int(min(max_count, ratio * all))`` of them."""
    n = documents.count()
    take = int(min(max_count if max_count is not None else n, (ratio if ratio is not None else 1.0) * n))
    return documents.orderBy("doc_id").limit(take)


def random_documents(documents: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` documents without replacement, the first in hashed order."""
    return documents.orderBy(hashed_order(seed, F.col("doc_id").cast("string")), "doc_id").limit(n)


def numbered(documents: DataFrame) -> DataFrame:
    """Adds the dense internal number ``doc_ix`` by id, without gathering the rows in one task.

    Ranges of ids are counted first; a row's number is its range's offset plus its place within.
    """
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.repartitionByRange(n, "doc_id").withColumn("_part", F.spark_partition_id())
    counts = rows.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("_part", before.alias("_start")))  # a row per partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy("doc_id")) - 1
    return rows.join(starts, "_part").withColumn("doc_ix", (F.col("_start") + place).cast("bigint")).drop("_part", "_start")


def range_scan(documents: DataFrame, after: int = -1, max_docs: int | None = None) -> DataFrame:
    """Documents with ``after < doc_ix < max_docs``: where an interrupted build goes on."""
    rows = documents.where(F.col("doc_ix") > after)
    return rows.where(F.col("doc_ix") < max_docs) if max_docs is not None else rows


def span_pairs(documents: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``doc_id, span_q, span_p, neg_id, span_n``: two adjacent spans of a document and one of the next document.

    A span starts at a space at or before a hashed offset, is cut back to its last space and is at most
    ``size`` characters; documents without room for two spans give none. The next document is the next in
    a hashed order within one of 64 hashed groups, so no task orders all documents; behind a group's last
    comes its first. A document alone in its group gives none.
    """
    length = F.length("text")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    rows = documents.where(length >= 2 * size).withColumn("_o", F.pmod(u, length - 2 * size + 1).cast("int"))

    def snapped(start):
        piece = F.substr("text", start + 1, F.lit(size))
        back = F.locate(" ", F.reverse(piece))
        return F.trim(F.when(back > 0, F.substr(piece, F.lit(1), F.lit(size) - back)).otherwise(piece))

    rows = rows.select("doc_id", snapped(F.col("_o")).alias("span_q"), snapped(F.col("_o") + size).alias("span_p"), u.alias("_u")).where("span_q <> '' and span_p <> ''")
    nxt = Window.partitionBy(F.pmod("_u", F.lit(64))).orderBy("_u", "doc_id")
    whole = nxt.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(nxt), F.first(c).over(whole))
    rows = rows.withColumn("neg_id", after("doc_id")).withColumn("span_n", after("span_q"))
    return rows.where("neg_id <> doc_id").drop("_u")


def span_batches(spans: DataFrame, size: int) -> DataFrame:
    """``batch, row, col, doc_id, other_id, relevance``: each first span against all second spans of its batch, 1 for its own.

    Batches are ``size`` documents each in the order of ids, numbered by ``numbered``.
    """
    rows = numbered(spans).select("doc_id", F.floor(F.col("doc_ix") / size).alias("batch"), (F.col("doc_ix") % size).alias("row"))
    other = rows.select("batch", F.col("row").alias("col"), F.col("doc_id").alias("other_id"))
    return rows.join(other, "batch").select("batch", "row", "col", "doc_id", "other_id", F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0).alias("relevance"))
