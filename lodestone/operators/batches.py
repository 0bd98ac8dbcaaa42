"""Batches of training samples: shards, epochs, collated inputs and teacher matrices, and the algebra of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard(samples: DataFrame, number: int, shards: int, ordinal: str = "ordinal") -> DataFrame:
    """Every ``shards``-th sample from ``number`` on, by a dense ordinal."""
    return samples.where(F.pmod(F.col(ordinal), F.lit(shards)) == number)


def repeated(samples: DataFrame, times: int, ordinal: str = "ordinal") -> DataFrame:
    """The samples ``times`` over, with ``epoch`` and ordinals that go on from epoch to epoch."""
    n = samples.count()
    rows = samples.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.withColumn(ordinal, F.col(ordinal) + F.col("epoch") * n)


def _in_order(order: str, value: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def collate_pairs(triplets: DataFrame, size: int, ordinal: str = "ordinal") -> DataFrame:
    """``batch, topics, positives, negatives``: parallel arrays of ``size`` triplets each, in the order of the ordinal."""
    rows = triplets.withColumn("batch", F.floor(F.col(ordinal) / size))
    return rows.groupBy("batch").agg(_in_order(ordinal, F.col("qid")).alias("topics"), _in_order(ordinal, F.col("pos_id")).alias("positives"), _in_order(ordinal, F.col("neg_id")).alias("negatives"))


def batch_pairs(batches: DataFrame) -> DataFrame:
    """``batch, place, topic_index, document_index`` of collated pairs: the positives' block, then the negatives'.

    Document indexes count through the positives and go on through the negatives.
    """
    n = F.size("topics")
    rows = batches.select("batch", n.alias("n"), F.explode(F.sequence(F.lit(0), 2 * n - 1)).alias("place"))
    return rows.select("batch", "place", (F.col("place") % F.col("n")).alias("topic_index"), F.col("place").alias("document_index"))


def unique_members(batches: DataFrame) -> DataFrame:
    """``batch, unique_topics, unique_documents`` of collated pairs, sorted."""
    return batches.select("batch", F.array_sort(F.array_distinct("topics")).alias("unique_topics"), F.array_sort(F.array_distinct(F.concat("positives", "negatives"))).alias("unique_documents"))


def collate_teacher_pairs(triplets: DataFrame, size: int, ordinal: str = "ordinal") -> DataFrame:
    """Collated pairs with ``teacher``, a row of (positive's, negative's) score for each triplet."""
    rows = triplets.withColumn("batch", F.floor(F.col(ordinal) / size))
    teacher = _in_order(ordinal, F.array(F.col("pos_score").cast("double"), F.col("neg_score").cast("double"))).alias("teacher")
    return collate_pairs(triplets, size, ordinal).join(rows.groupBy("batch").agg(teacher), "batch")


def collate_lists(lists: DataFrame, size: int, ordinal: str = "ordinal") -> DataFrame:
    """``batch, topics, documents, teacher`` from ``(ordinal, qid, docs array of (doc_id, score))``.

    ``topics`` repeats each topic for each of its documents; ``teacher`` has a row of scores for each list.
    All lists of a batch must be as long as its first.
    """
    rows = lists.withColumn("batch", F.floor(F.col(ordinal) / size))
    topic = F.transform("docs", lambda d: F.col("qid"))
    out = rows.groupBy("batch").agg(
        F.flatten(_in_order(ordinal, topic)).alias("topics"),
        F.flatten(_in_order(ordinal, F.transform("docs", lambda d: d["doc_id"]))).alias("documents"),
        _in_order(ordinal, F.transform("docs", lambda d: d["score"].cast("double"))).alias("teacher"),
    )
    same = F.forall("teacher", lambda r: F.size(r) == F.size(F.col("teacher")[0]))
    return out.withColumn("teacher", F.when(same, F.col("teacher")).otherwise(F.raise_error(F.lit("lists of one batch differ in length"))))


def with_members(samples: DataFrame, column: str, values: Column) -> DataFrame:
    """Samples with one of their members (topic, positive, negative, documents) put in another form."""
    return samples.withColumn(column, values)
