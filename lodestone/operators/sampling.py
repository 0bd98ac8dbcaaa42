"""Training samples: labelled candidates, hard negatives, triplets, lists; all draws are hashed and repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import hashed_order, hashed_unit
from .ranking import ranked


def labelled(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Retrieved documents with their grade, 0 where unjudged, for topics with judgements."""
    rows = ranked(run).join(qrels.select("qid").distinct(), "qid", "left_semi")
    return rows.join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def model_samples(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``qid, doc_id, score, rel, positive``: judged positives (score 0) and retrieved documents that are not relevant.

    Topics without positives or without negatives are left out.
    """
    pos = qrels.where("rel > 0").select("qid", "doc_id", F.lit(0.0).alias("score"), "rel", F.lit(True).alias("positive"))
    neg = labelled(run, qrels).where("rel <= 0").select("qid", "doc_id", "score", "rel", F.lit(False).alias("positive"))
    both = pos.select("qid").distinct().join(neg.select("qid").distinct(), "qid")
    return pos.unionByName(neg).join(both, "qid", "left_semi")


def hard_negatives(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """``qid, positives, negatives``: retrieved documents by grade, in rank order, of topics with both."""
    rows = labelled(run, qrels)
    side = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("rank", "doc_id")))), lambda x: x["doc_id"])
    out = rows.groupBy("qid").agg(side(F.col("rel") > 0).alias("positives"), side(F.col("rel") <= 0).alias("negatives"))
    return out.where((F.size("positives") > 0) & (F.size("negatives") > 0))


def numbered_sides(samples: DataFrame) -> DataFrame:
    """Adds the ordinal ``i`` within (qid, positive) and the side's size ``n``; sides are as long as first-stage lists."""
    w = Window.partitionBy("qid", "positive")
    return samples.withColumn("i", F.row_number().over(w.orderBy("doc_id")) - 1).withColumn("n", F.count("*").over(w))


def draw(n: Column, *parts) -> Column:
    """A hashed index below ``n``."""
    return F.floor(hashed_unit(*parts) * n).cast("int")


def pairwise_triplets(samples: DataFrame, per_topic: int, seed: int = 0) -> DataFrame:
    """``qid, ordinal, pos_id, neg_id``: uniform positive and negative for each of ``per_topic`` ordinals."""
    rows = numbered_sides(samples)
    side = lambda p, name: rows.where(F.col("positive") == p).select("qid", F.col("i"), F.col("doc_id").alias(name))
    sizes = rows.groupBy("qid").agg(F.max(F.when(F.col("positive"), F.col("n"))).alias("np"), F.max(F.when(~F.col("positive"), F.col("n"))).alias("nn"))
    want = sizes.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(per_topic - 1))))
    want = want.select("qid", "ordinal", draw(F.col("np"), seed, "p", F.col("qid"), F.col("ordinal")).alias("ip"), draw(F.col("nn"), seed, "n", F.col("qid"), F.col("ordinal")).alias("i_n"))
    out = want.join(side(True, "pos_id").withColumnRenamed("i", "ip"), ["qid", "ip"]).join(side(False, "neg_id").withColumnRenamed("i", "i_n"), ["qid", "i_n"])
    return out.select("qid", F.col("ordinal").cast("bigint").alias("ordinal"), "pos_id", "neg_id")


def pointwise(samples: DataFrame, n: int, ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """``ordinal, qid, doc_id, rel``: of each ordinal a positive with probability ``ratio``, else a negative, uniform over all records.

    Records get their number per hashed cell and cell offsets, so no task orders all records.
    """
    rows = samples.withColumn("_c", F.pmod(F.xxhash64("qid", "doc_id"), F.lit(256)).cast("int"))
    cells = rows.groupBy("positive", "_c").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("positive").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = F.broadcast(cells.select("positive", "_c", before.alias("_b")))  # at most 512 rows
    place = F.row_number().over(Window.partitionBy("positive", "_c").orderBy("qid", "doc_id")) - 1
    rows = rows.join(cells, ["positive", "_c"]).withColumn("i", F.col("_b") + place)
    totals = {r["positive"]: r["count"] for r in samples.groupBy("positive").count().collect()}
    spark = samples.sparkSession
    want = spark.range(n).select(F.col("id").alias("ordinal"), (hashed_unit(seed, "side", F.col("id")) < ratio).alias("positive"))
    size = F.when(F.col("positive"), F.lit(totals.get(True, 0))).otherwise(F.lit(totals.get(False, 0)))
    want = want.withColumn("i", F.floor(hashed_unit(seed, "pick", F.col("ordinal")) * size))
    return want.join(rows, ["positive", "i"]).select("ordinal", "qid", "doc_id", "rel")


def in_batch_matrix(triplets: DataFrame, batch: int) -> DataFrame:
    """``batch, row, col, relevance``: each query against the batch's positives, then its negatives; 1 on the diagonal.

    ``triplets`` has a dense ``ordinal``; a batch is a stated, bounded number of rows.
    """
    rows = triplets.select(F.floor(F.col("ordinal") / batch).alias("batch"), F.pmod("ordinal", F.lit(batch)).alias("row"), "qid", "pos_id", "neg_id")
    size = F.count("*").over(Window.partitionBy("batch"))
    docs = rows.withColumn("n", size).select("batch", F.inline(F.array(F.struct(F.col("row").alias("col"), F.col("pos_id").alias("doc_id")), F.struct((F.col("row") + F.col("n")).alias("col"), F.col("neg_id").alias("doc_id")))))
    return rows.select("batch", "row", "qid").join(docs, "batch").select("batch", "row", "col", "qid", "doc_id", F.when(F.col("row") == F.col("col"), 1.0).otherwise(0.0).alias("relevance"))


def listwise_negatives(samples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``qid, pos, doc_id, label``: the first positive and ``k - 1`` negatives drawn with replacement."""
    rows = numbered_sides(samples)
    first = rows.where("positive and i = 0").select("qid", F.lit(0).cast("bigint").alias("pos"), "doc_id", F.lit(1).alias("label"))
    negs = rows.where("not positive")
    want = negs.where("i = 0").select("qid", "n", F.explode(F.sequence(F.lit(1), F.lit(k - 1))).alias("pos"))
    want = want.select("qid", "pos", draw(F.col("n"), seed, F.col("qid"), F.col("pos")).alias("i"))
    drawn = want.join(negs.select("qid", "i", "doc_id"), ["qid", "i"]).select("qid", F.col("pos").cast("bigint").alias("pos"), "doc_id", F.lit(0).alias("label"))
    return first.unionByName(drawn.join(first.select("qid"), "qid", "left_semi"))


def triplets_from_lists(samples: DataFrame, algorithm: str, pool: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``sample, qid, pos_id, neg_id`` from ``(sample, queries, pos_ids, neg_ids map)``: one hashed pick of each.

    ``random`` draws from ``pool(ix, doc_id)`` with dense ``ix``; a draw of the positive itself moves on by one.
    """
    pick = lambda arr, tag: F.element_at(arr, (F.floor(hashed_unit(seed, tag, F.col("sample")) * F.size(arr)) + 1).cast("int"))
    rows = samples.where((F.size("queries") > 0) & (F.size("pos_ids") > 0)).withColumn("qid", pick(F.col("queries"), "q")).withColumn("pos_id", pick(F.col("pos_ids"), "p"))
    if algorithm != "random":
        negs = F.col("neg_ids")[algorithm]
        return rows.where(F.size(negs) > 0).select("sample", "qid", "pos_id", pick(negs, "n").alias("neg_id"))
    n = pool.count()
    rows = rows.withColumn("ix", F.floor(hashed_unit(seed, "n", F.col("sample")) * n).cast("bigint"))
    one = rows.join(pool, "ix")
    clash = one.where("doc_id = pos_id").drop("doc_id").withColumn("ix", F.pmod(F.col("ix") + 1, F.lit(n))).join(pool, "ix")
    return one.where("doc_id <> pos_id").unionByName(clash).select("sample", "qid", "pos_id", F.col("doc_id").alias("neg_id"))


def teacher_triplets(triplets: DataFrame, scores: DataFrame) -> DataFrame:
    """Triplets with the teacher's scores of both documents."""
    s = lambda d, n: scores.select("qid", F.col("doc_id").alias(d), F.col("score").alias(n))
    return triplets.join(s("pos_id", "pos_score"), ["qid", "pos_id"]).join(s("neg_id", "neg_score"), ["qid", "neg_id"])


def graded_pairs(lists: DataFrame) -> DataFrame:
    """``qid, a, b``: pairs of one list in which a's grade is higher. Lists are bounded by their first stage."""
    b = lists.select("qid", F.col("doc_id").alias("b"), F.col("rel").alias("_rb"), F.col("score").alias("score_b"))
    return lists.withColumnRenamed("doc_id", "a").join(b, "qid").where(F.col("rel") > F.col("_rb")).select("qid", "a", "b", "score", "score_b")


def hydrate_triplets(triplets: DataFrame, topics: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts for query, positive and negative; rows whose ids a store lacks are left out."""
    d = lambda key, name: documents.select(F.col("doc_id").alias(key), F.col("text").alias(name))
    return triplets.join(topics.select("qid", F.col("text").alias("query")), "qid").join(d("pos_id", "positive"), "pos_id").join(d("neg_id", "negative"), "neg_id")


def epoch_order(samples: DataFrame, key: str, seed: int, epoch: int) -> DataFrame:
    """One pass over a sample table in an order that (seed, epoch) fix."""
    return samples.orderBy(hashed_order(seed, epoch, F.col(key).cast("string")), key)


def resume(samples: DataFrame, ordinal: str, done: int) -> DataFrame:
    """Samples behind the checkpointed ordinal."""
    return samples.where(F.col(ordinal) > done)
