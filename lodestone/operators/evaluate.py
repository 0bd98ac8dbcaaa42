"""Measures of runs against judgements, comparison tables, validation over epochs, representation statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_MEASURES, QRELS, RUN, Measure, require_columns
from .ranking import ranked, unique_run


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Ranked run with ``rel`` (0 where unjudged), of the topics that have judgements."""
    require_columns(run, RUN), require_columns(qrels, QRELS)
    rows = ranked(unique_run(run)).join(qrels.select("qid").distinct(), "qid", "left_semi")
    return rows.join(qrels, ["qid", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def _totals(qrels: DataFrame, measures) -> DataFrame:
    """Per topic, relevant documents of each least grade (``total_1`` ...) and ideal gains of each cutoff."""
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    rows = qrels.withColumn("_r", F.row_number().over(order))
    gain = F.when(F.col("rel") > 0, F.col("rel") / F.log2(F.col("_r") + 1))
    out = [F.count_if(F.col("rel") >= g).alias(f"total_{g}") for g in sorted({m.rel for m in measures})]
    out += [F.sum(F.when(F.col("_r") <= c, gain) if c else gain).alias(f"ideal_{c or 'all'}") for c in sorted({m.cutoff or 0 for m in measures if m.name == "nDCG"})]
    return rows.groupBy("qid").agg(*out)


#: Measure name -> function of (measure, hit, within the cutoff) to the aggregate of a topic's ranked rows. Further
#: measures are added here; columns are ``rank``, ``rel`` and ``hits_g``, the hits of grade g so far.
AGGREGATES = {
    "P": lambda m, hit, inside: F.count_if(hit & inside) / m.cutoff,
    "R": lambda m, hit, inside: F.try_divide(F.count_if(hit & inside).cast("double"), F.first(f"total_{m.rel}")),
    "Success": lambda m, hit, inside: F.max((hit & inside).cast("double")),
    "RR": lambda m, hit, inside: 1 / F.min(F.when(hit & inside, F.col("rank"))),
    "AP": lambda m, hit, inside: F.try_divide(F.sum(F.when(hit & inside, F.col(f"hits_{m.rel}") / F.col("rank"))), F.first(f"total_{m.rel}")),
    "nDCG": lambda m, hit, inside: F.try_divide(F.sum(F.when(inside, F.greatest(F.col("rel"), F.lit(0)) / F.log2(F.col("rank") + 1))), F.first(f"ideal_{m.cutoff or 'all'}")),
}


def register_measure(name: str, aggregate) -> None:
    """Adds a measure: see ``AGGREGATES``."""
    AGGREGATES[name] = aggregate


def per_query(run: DataFrame, qrels: DataFrame, measures: tuple[Measure, ...] = DEFAULT_MEASURES) -> DataFrame:
    """``qid, measure, value`` for every judged topic; a topic without retrieved documents has 0.

    Grades are relevant from ``measure.rel`` on. AP and R divide by all relevant judged documents, P by its
    cutoff, nDCG by the ideal order of all judged documents; a topic with nothing relevant has 0. All
    measures come from one aggregation of the ranked run.
    """
    for m in measures:
        if m.name not in AGGREGATES:
            raise ValueError(f"unknown measure {m.name}")
        if m.name == "P" and not m.cutoff:
            raise ValueError("P needs a cutoff")
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    totals = _totals(qrels, measures)
    rows = judged(run, qrels)
    rows = rows.withColumns({f"hits_{g}": F.count_if(F.col("rel") >= g).over(upto) for g in sorted({m.rel for m in measures if m.name == "AP"})}).join(totals, "qid")
    values = [AGGREGATES[m.name](m, F.col("rel") >= m.rel, (F.col("rank") <= m.cutoff) if m.cutoff else F.lit(True)).cast("double").alias(f"v{i}") for i, m in enumerate(measures)]
    wide = totals.select("qid").join(rows.groupBy("qid").agg(*values), "qid", "left")
    long = F.array(*[F.struct(F.lit(m.label).alias("measure"), F.round(F.coalesce(F.col(f"v{i}"), F.lit(0.0)), 6).alias("value")) for i, m in enumerate(measures)])
    return wide.select("qid", F.inline(long))


def aggregated(detail: DataFrame) -> DataFrame:
    """``measure, value``: the mean over judged topics."""
    return detail.groupBy("measure").agg(F.round(F.avg("value"), 6).alias("value"))


def evaluate(run: DataFrame, qrels: DataFrame, measures=DEFAULT_MEASURES, details: bool = False):
    detail = per_query(run, qrels, measures)
    return (aggregated(detail), detail) if details else aggregated(detail)


def comparison(results: dict[str, DataFrame], measures: tuple[Measure, ...]) -> DataFrame:
    """One row per tag and one column per measure from aggregated results."""
    rows = None
    for tag, df in sorted(results.items()):
        part = df.withColumn("tag", F.lit(tag))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("tag").pivot("measure", sorted(m.label for m in measures)).agg(F.first("value"))


def collection(results: dict[str, DataFrame]) -> DataFrame:
    """Union of per-dataset tables with the dataset's name."""
    out = None
    for name, df in sorted(results.items()):
        part = df.withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def early_stopping(history: DataFrame, warmup: int, patience: int) -> DataFrame:
    """``(run, epoch, measure, value)`` with ``best``, ``improved``, ``since`` and ``stop``.

    A value improves if strictly greater than all before, counted from epoch ``warmup`` on. A run stops when
    no measure has improved for ``patience`` epochs.
    """
    rows = history.where(F.col("epoch") >= warmup)
    order = Window.partitionBy("run", "measure").orderBy("epoch")
    before = F.max("value").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("improved", before.isNull() | (F.col("value") > before))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("best", F.max("value").over(upto)).withColumn("_at", F.max(F.when(F.col("improved"), F.col("epoch"))).over(upto))
    latest = F.max("_at").over(Window.partitionBy("run", "epoch"))
    return rows.withColumn("since", F.col("epoch") - latest).withColumn("stop", F.col("since") >= patience).drop("_at")


@dataclass(frozen=True)
class Validation:
    """Settings of a validation: its tag, every how many epochs, and what early stopping asks for."""

    tag: str = "val"
    interval: int = 1
    warmup: int = 0
    patience: int = 0


def validated_epochs(history: DataFrame, settings: Validation) -> DataFrame:
    """The rows of the epochs that are validated: every ``interval``-th."""
    return history.where(F.col("epoch") % settings.interval == 0)


def best_epochs(history: DataFrame, settings: Validation) -> DataFrame:
    """``tag, run, measure, epoch, value``: the first epoch, from the warm-up on, with a measure's greatest value."""
    rows = validated_epochs(history, settings).where(F.col("epoch") >= settings.warmup)
    best = rows.groupBy("run", "measure").agg(F.max(F.struct("value", (-F.col("epoch")).alias("e"))).alias("b"))
    return best.select(F.lit(settings.tag).alias("tag"), "run", "measure", (-F.col("b.e")).alias("epoch"), F.col("b.value").alias("value"))


def aggregated_validation(history: DataFrame) -> DataFrame:
    """``run, epoch, value``: mean over measures of their best values so far."""
    upto = Window.partitionBy("run", "measure").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best", F.max("value").over(upto)).groupBy("run", "epoch").agg(F.round(F.avg("best"), 6).alias("value"))


def splade(logits: DataFrame, how: str = "max") -> DataFrame:
    """``doc_id, term, w`` from ``(doc_id, pos, term, logit, mask)``: log1p of relu, by maximum or by sum over positions."""
    act = F.greatest(F.col("logit").cast("double"), F.lit(0.0)) * F.col("mask").cast("double")
    w = F.log1p(F.max(act)) if how == "max" else F.sum(F.log1p(act))
    return logits.groupBy("doc_id", "term").agg(w.alias("w"))


def flops(weights: DataFrame, rows: int | None = None) -> DataFrame:
    """One row: the sum over terms of the squared mean weight."""
    n = F.lit(rows) if rows else F.lit(weights.select("doc_id").distinct().count())
    return weights.groupBy("term").agg((F.sum("w") / n).alias("m")).agg(F.round(F.sum(F.col("m") * F.col("m")), 6).alias("flops"))


def quadratic_ramp(step, warmup: int, low: float, high: float):
    """Regulariser weight: ``(step / warmup) ** 2`` of the way from ``low`` to ``high``, then ``high``."""
    ratio = F.when((F.lit(warmup) <= 0) | (step >= warmup), F.lit(1.0)).otherwise(F.pow(step / F.lit(float(max(warmup, 1))), 2))
    return low + ratio * (high - low)


def representation_statistics(queries: DataFrame, documents: DataFrame, vocabulary: int) -> DataFrame:
    """One row: mean overlap cost, and shares of non-zero weights of queries and documents."""

    def active(df, name):
        return df.where("w > 0").groupBy("term").agg(F.count("*").alias(name))

    nq, nd = queries.select("doc_id").distinct().count(), documents.select("doc_id").distinct().count()
    both = active(queries, "a").join(active(documents, "b"), "term", "full")
    both = both.select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    v = float(vocabulary)
    return both.agg(
        F.round(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)) / v / v, 6).alias("qdflops"),
        F.round(F.coalesce(F.sum("a"), F.lit(0)) / (nq * v), 6).alias("sparsity_q"),
        F.round(F.coalesce(F.sum("b"), F.lit(0)) / (nd * v), 6).alias("sparsity_d"),
    )


def saturation(weights: DataFrame, tops=(1, 5, 10, 20)) -> DataFrame:
    """``top, rate``: the lower median of the ``top`` highest shares of rows in which a term is active."""
    n = weights.select("doc_id").distinct().count()
    rates = weights.where("w > 0").groupBy("term").agg((F.count("*") / n).alias("rate")).orderBy(F.desc("rate"), "term").limit(max(tops))
    rates = rates.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("rate"), "term")))  # max(tops) rows
    rows = rates.withColumn("top", F.explode(F.array(*map(F.lit, tops)))).where("_r <= top")
    return rows.groupBy("top").agg(F.round(F.expr("percentile_disc(0.5) within group (order by rate)"), 6).alias("rate")).withColumn("top", F.col("top").cast("bigint"))


def pairwise_accuracy(pairs: DataFrame) -> DataFrame:
    """One row: the share of pairs whose positive scores higher."""
    return pairs.agg(F.round(F.avg((F.col("pos_score") > F.col("neg_score")).cast("double")), 6).alias("accuracy"))
