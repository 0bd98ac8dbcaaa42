"""Ranking losses as aggregates over sample tables; a linear pairwise ranker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import log_softmax, sigmoid


def _one(df: DataFrame, value) -> DataFrame:
    return df.agg(F.round(value, 6).alias("loss"))


def delta_mse(pairs: DataFrame) -> DataFrame:
    """Mean squared difference of the score margins of student and teacher."""
    return _one(pairs, F.avg(F.pow((F.col("pos_score") - F.col("neg_score")) - (F.col("pos_teacher") - F.col("neg_teacher")), 2)))


def kl_divergence(pairs: DataFrame) -> DataFrame:
    """Mean Kullback-Leibler divergence of the student's from the teacher's distribution over each pair."""
    t, s = sigmoid(F.col("pos_teacher") - F.col("neg_teacher")), F.col("pos_score") - F.col("neg_score")
    log_p, log_n = -F.log1p(F.exp(-s)), -F.log1p(F.exp(s))
    return _one(pairs, F.avg(t * (F.log(t) - log_p) + (1 - t) * (F.log(1 - t) - log_n)))


def ranknet(lists: DataFrame) -> DataFrame:
    """Mean ``ln(1 + exp(-(s_i - s_j)))`` over pairs of a list in which i's grade is higher."""
    from .sampling import graded_pairs

    return _one(graded_pairs(lists), F.avg(F.log1p(F.exp(-(F.col("score") - F.col("score_b"))))))


def adr_mse(lists: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Mean squared difference of soft ranks by score and ranks by grade, discounted by log2(rank + 1)."""
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    rows = lists.withColumn("r", F.row_number().over(order))
    other = lists.select("qid", F.col("doc_id").alias("o"), F.col("score").alias("so"))
    soft = rows.join(other, "qid").groupBy("qid", "doc_id", "r").agg((1 + F.sum(F.when(F.col("o") != F.col("doc_id"), sigmoid((F.col("so") - F.col("score")) / temperature)).otherwise(0.0))).alias("soft"))
    return _one(soft, F.avg(F.pow(F.col("soft") - F.col("r"), 2) / F.log2(F.col("r") + 1)))


def softmax_cross_entropy(lists: DataFrame) -> DataFrame:
    """Per list the negative logsumexp of ``log_softmax(s) + 1 - 1 / rel`` (rel 0 as 1e-8); the mean over lists."""
    w = Window.partitionBy("qid")
    x = log_softmax(F.col("score"), w) + 1 - 1 / F.greatest(F.col("rel").cast("double"), F.lit(1e-8))
    rows = lists.withColumn("x", x)
    rows = rows.withColumn("m", F.max("x").over(w))
    per = rows.groupBy("qid").agg((F.max("m") + F.log(F.sum(F.exp(F.col("x") - F.col("m"))))).alias("l"))
    return _one(per, -F.avg("l"))


def info_nce(lists: DataFrame) -> DataFrame:
    """Cross entropy against a uniform target over a list's positives; lists without any are left out."""
    w = Window.partitionBy("qid")
    rows = lists.withColumn("lp", log_softmax(F.col("score"), w))
    per = rows.where("rel > 0").groupBy("qid").agg((-F.avg("lp")).alias("l"))
    return _one(per, F.avg("l"))


def binary_cross_entropy(lists: DataFrame) -> DataFrame:
    """Logistic loss per document."""
    s, y = F.col("score"), (F.col("rel") > 0).cast("double")
    return _one(lists, F.avg(F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s)))))


def hinge(lists: DataFrame, margin: float = 1.0) -> DataFrame:
    """Mean hinge over all pairs of a positive and a negative of a list."""
    neg = lists.where("rel <= 0").select("qid", F.col("score").alias("sn"))
    return _one(lists.where("rel > 0").join(neg, "qid"), F.avg(F.greatest(F.lit(0.0), margin - F.col("score") + F.col("sn"))))


def linear_ranker(pairs: DataFrame, features: list[str], max_iter: int = 20):
    """Weights of a linear scorer: logistic regression on feature differences, both orders of each pair."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    diff = [(F.col(f"pos_{f}") - F.col(f"neg_{f}")).alias(f) for f in features]
    rows = pairs.select(*diff, F.lit(1.0).alias("label")).union(pairs.select(*[(-F.col(f"pos_{f}") + F.col(f"neg_{f}")).alias(f) for f in features], F.lit(0.0)))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return LogisticRegression(maxIter=max_iter, fitIntercept=False, regParam=1e-6).fit(rows).coefficients.toArray()
