"""Operator 6, mixing sources to target weights: temperature mixing realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

#: Bisection halvings; 60 reach the spacing of doubles on [0, 1].
HALVINGS = 60
#: Exponents tried in one pass over a table of sources, and passes: 31 ** 12 is about 2 ** 60.
GRID, PASSES = 31, 12
#: Blocks that a source is cut into at the most.
MAX_BLOCKS = 4096
#: Tables of sources are broadcast up to so many rows.
BROADCAST_SOURCES = 100_000


def weights_at(tokens: dict, alpha: float) -> dict:
    """Normalised ``share ** alpha`` per source."""
    raw = {s: (t / sum(tokens.values())) ** alpha for s, t in tokens.items()}
    return {s: w / sum(raw.values()) for s, w in raw.items()}


def repetitions(tokens: dict, alpha: float) -> float:
    """Epochs of the most repeated source when the least repeated one is read once."""
    w = weights_at(tokens, alpha)
    ratio = [w[s] / tokens[s] for s in tokens]
    return max(ratio) / min(ratio)


def entropy(tokens: dict, alpha: float) -> float:
    return -sum(w * math.log(w) for w in weights_at(tokens, alpha).values() if w > 0)


def solve_alpha(tokens: dict, max_repeat: float | None = None, target_entropy: float | None = None) -> float:
    """Bisects the exponent on [0, 1].

    With ``max_repeat``: the smallest exponent whose most repeated source stays within that many epochs.
    With ``target_entropy`` (nats): the largest exponent whose weights still have that entropy; 0 if none has.
    """
    if max_repeat is not None:
        ok = lambda a: repetitions(tokens, a) <= max_repeat  # noqa: E731  holds from some exponent on
        low, high = 0.0, 1.0
        if ok(low):
            return 0.0
        for _ in range(HALVINGS):
            mid = (low + high) / 2
            low, high = (low, mid) if ok(mid) else (mid, high)
        return high
    ok = lambda a: entropy(tokens, a) >= target_entropy  # noqa: E731  holds up to some exponent
    low, high = 0.0, 1.0
    if ok(high):
        return 1.0
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def _hash32(*parts: Column) -> Column:
    """32 bits of md5 as a long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def token_count(text: Column) -> Column:
    """Tokens as runs of characters between single spaces: one pass of byte operations, no expression engine."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("bigint")


def entropy_alpha(shares: DataFrame, target: float) -> float:
    """``solve_alpha`` with a target entropy over a table of shares ``p``: each pass tries GRID exponents at once."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        at = [low + (high - low) * (i + 1) / GRID for i in range(GRID)]
        sums = shares.agg(*[f for i, a in enumerate(at) for f in (F.sum(F.pow("p", F.lit(a))).alias(f"z{i}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"d{i}"))]).first()
        reached = [math.log(sums[f"z{i}"]) - a * sums[f"d{i}"] / sums[f"z{i}"] >= target for i, a in enumerate(at)]
        k = sum(reached)  # entropy falls as the exponent grows
        if k == GRID:
            return high
        low, high = (at[k - 1] if k else low), at[k]
    return low


def mix_sources(docs: DataFrame, max_repeat: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, block_tokens: int = 65_536, seed: int = 13) -> DataFrame:
    """Rows of ``docs`` with ``mix_tokens``, ``mix_block``, ``mix_copies`` and ``mix_orders``.

    Sources weigh ``share ** alpha``. The budget in tokens (default: the least with which the least repeated
    source is read once whole) is divided by weight. A source's documents are dealt by hash into blocks of
    about ``block_tokens``, but at most MAX_BLOCKS of them, so that the blocks of one source can be ordered in
    one task; its quota is so many whole epochs, then the blocks of one more epoch in hashed order, and of
    the block on the border the documents, in hashed order, that still fit. ``mix_copies`` is how often the
    mix holds the row; ``mix_orders`` gives for each epoch the place of its block in that epoch's permutation.

    Tokens are the runs of characters between single spaces. Null source is a source of its own; null and
    empty texts weigh nothing and are held once per whole epoch; a document longer than what is left of the
    border block is skipped with all behind it. Sources without tokens get one epoch. Rows that share a
    doc_id are held alike; null ids count as one id. Columns of ``docs`` with the names of those added are replaced. Only tables of sources and blocks are
    aggregated, on the executors; the rows themselves are not shuffled unless the block table is too large
    for Spark to broadcast.
    """
    added = ("mix_tokens", "mix_block", "mix_copies", "mix_orders")
    own = [c for c in docs.columns if c not in added]
    key = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))
    doc_key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # the documents' own columns ride in a struct, so that their names meet none of those below
    rows = docs.select(F.struct(*own).alias("_row"), token_count(F.coalesce("text", F.lit(""))).alias("mix_tokens"), key.alias("_key"), _hash32(F.lit(seed), doc_key).alias("_h"), F.coalesce("doc_id", F.lit(-(1 << 62))).alias("_id"))
    # fine blocks first, so that one scan gives sources and blocks
    cells = materialise(rows.groupBy("_key", F.pmod("_h", F.lit(MAX_BLOCKS)).alias("cell")).agg(F.sum("mix_tokens").alias("tokens")), "mix-cells")
    sources = materialise(cells.groupBy("_key").agg(F.sum("tokens").alias("t")), "mix-sources")
    facts = sources.where("t > 0").agg(F.sum("t").alias("all"), F.min("t").alias("least"), F.max("t").alias("most")).first()
    everything = facts["all"] or 1
    share = F.col("t") / F.lit(float(everything))
    if not facts["all"]:
        alpha = 1.0
    elif max_repeat is not None:
        # only the largest and the least share decide about repetitions
        alpha = solve_alpha({"least": facts["least"], "most": facts["most"]}, max_repeat)
    else:
        alpha = entropy_alpha(sources.where("t > 0").select(share.alias("p")), target_entropy)
    raw = F.when(F.col("t") > 0, F.pow(share, F.lit(alpha))).otherwise(0.0)
    norm = (sources.agg(F.sum(raw)).first()[0] or 1.0) if facts["all"] else 1.0
    weight = raw / F.lit(norm)
    total = budget if budget is not None else (sources.where("t > 0").agg(F.max(F.col("t") / weight)).first()[0] or 0)
    quota = F.when(F.col("t") > 0, F.round(weight * F.lit(float(total))).cast("bigint")).otherwise(F.col("t"))
    most = MAX_BLOCKS.bit_length() - 1
    nb = F.expr(f"shiftleft(1, cast(greatest(0, least({most}, ceil(log2(greatest(1.0d, t / {float(block_tokens)!r}d))))) as int))")
    sources = materialise(sources.select("_key", "t", quota.alias("quota"), nb.alias("nb")), "mix-plan")
    few = broadcast_if_small(sources, sources.count(), BROADCAST_SOURCES)
    blocks = cells.join(few, "_key").groupBy("_key", "t", "quota", "nb", F.pmod("cell", "nb").alias("mix_block")).agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.withColumn("epochs", F.expr("case when t = 0 then 1L else quota div t end")).withColumn("rest", F.expr("case when t = 0 then 0L else quota % t end"))
    # a permutation of the source's blocks for each epoch, the last one cut off by the budget
    turns = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs"))))
    order = Window.partitionBy("_key", "epoch").orderBy(_hash32(F.lit(seed), "_key", "epoch", "mix_block"), "mix_block")
    turns = turns.withColumn("place", F.row_number().over(order) - 1).withColumn("ahead", F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.max(F.when(F.col("epoch") == F.col("epochs"), F.col("rest") - F.col("ahead")))
    blocks = turns.groupBy("_key", "mix_block", "epochs", "tokens").agg(last.alias("left"), F.transform(F.sort_array(F.collect_list(F.struct("epoch", "place"))), lambda x: x["place"].cast("bigint")).alias("mix_orders"))
    blocks = blocks.select("_key", "mix_block", "epochs", F.when(F.col("left") >= F.col("tokens"), "whole").when(F.col("left") > 0, "border").otherwise("none").alias("state"), "left", "mix_orders")
    blocks = materialise(blocks, "mix-blocks")
    nb = broadcast_if_small(sources.select("_key", "nb"), sources.count(), BROADCAST_SOURCES)
    out = rows.join(nb, "_key").withColumn("mix_block", F.pmod("_h", F.col("nb"))).drop("nb")
    out = out.join(blocks, ["_key", "mix_block"])
    # the border blocks alone, at most one per source
    edge = rows.select("_key", "_h", "_id", "mix_tokens").join(nb, "_key").select("_key", F.pmod("_h", F.col("nb")).alias("mix_block"), "_h", "_id", "mix_tokens")
    edge = edge.join(blocks.where("state = 'border'").select("_key", "mix_block", "left"), ["_key", "mix_block"]).groupBy("_key", "mix_block", "left", "_h", "_id").agg(F.sum("mix_tokens").alias("mix_tokens"))
    fill = Window.partitionBy("_key", "mix_block").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = materialise(edge.withColumn("upto", F.sum("mix_tokens").over(fill)).where("upto <= left").select("_key", "_h", "_id", F.lit(1).alias("fits")), "mix-edge")
    out = out.join(edge, ["_key", "_h", "_id"], "left")
    copies = F.col("epochs") + F.when(F.col("state") == "whole", 1).when(F.col("state") == "border", F.coalesce("fits", F.lit(0))).otherwise(0)
    return out.select("_row.*", "mix_tokens", "mix_block", copies.cast("bigint").alias("mix_copies"), "mix_orders")


def realise(mixed: DataFrame) -> DataFrame:
    """One row per copy, with ``mix_epoch`` from 0 and ``mix_order``, its block's place in the epoch's permutation.

    Reading the rows by (mix_epoch, mix_order) reads the block permutations.
    """
    own = [c for c in mixed.columns if c not in ("mix_copies", "mix_orders", "mix_epoch", "mix_order")]
    rows = mixed.where("mix_copies > 0").select(*own, "mix_orders", F.explode(F.sequence(F.lit(0), (F.col("mix_copies") - 1).cast("int"))).alias("mix_epoch"))
    return rows.select(*own, "mix_epoch", F.col("mix_orders")[F.col("mix_epoch")].alias("mix_order"))


def op6_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of ``documents``: one row per document copy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return realise(mix_sources(docs)).select("doc_id", "source", "mix_tokens", "mix_block", F.col("mix_epoch").cast("bigint").alias("mix_epoch"), "mix_order")


_ORACLE = """
with recursive r as (select doc_id, source, coalesce('s:' || source, 'null') k, (case when length(text) > 0 then length(text) - length(replace(text, ' ', '')) + 1 else 0 end)::bigint tk,
    ('0x' || substr(md5('13:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint h from documents),
s as (select k, sum(tk)::bigint t from r group by k),
live as (select k, t, t / (select sum(t) from s)::double p from s where t > 0),
spread as (select max(p) / min(p) q from live),
bis(i, lo, hi) as (select 0, 0.0::double, 1.0::double union all
  select i + 1, case when pow(q, 1 - (lo + hi) / 2) <= 2.0 then lo else (lo + hi) / 2 end, case when pow(q, 1 - (lo + hi) / 2) <= 2.0 then (lo + hi) / 2 else hi end from bis, spread where i < 60),
a as (select case when (select q from spread) <= 2.0 then 0.0 else (select hi from bis where i = 60) end al),
w as (select k, t, pow(p, al) / (select sum(pow(p, al)) from live, a) w from live, a),
q as (select s.k, s.t, coalesce(round(w.w * (select max(t / w) from w))::bigint, 0) quota,
   (1::bigint << greatest(0, least(12, ceil(log2(greatest(1, s.t / 65536.0)))))::int) nb from s left join w using (k)),
b as (select r.k, q.t, q.quota, r.h % q.nb blk, sum(tk)::bigint tk, case when q.t = 0 then 1 else q.quota // q.t end ep, case when q.t = 0 then 0 else q.quota % q.t end rest
  from r join q using (k) group by all),
o as (select *, rest - coalesce(sum(tk) over (partition by k order by ('0x' || substr(md5('13:' || k || ':' || ep || ':' || blk), 1, 8))::bigint, blk rows between unbounded preceding and 1 preceding), 0) lft from b),
d as (select r.*, o.blk, o.ep, o.lft, o.tk btk, sum(r.tk) over (partition by r.k, o.blk order by r.h, r.doc_id rows unbounded preceding) upto
  from r join q using (k) join o on o.k = r.k and o.blk = r.h % q.nb),
c as (select *, (ep + case when lft >= btk then 1 when lft > 0 and upto <= lft then 1 else 0 end)::bigint n from d),
x as (select k, doc_id, source, tk, blk, unnest(range(n)) e from c where n > 0),
pl as (select k, blk, e, row_number() over (partition by k, e order by ('0x' || substr(md5('13:' || k || ':' || e || ':' || blk), 1, 8))::bigint, blk) - 1 place from (select k, blk, unnest(range(ep + 1)) e from o))
select doc_id, source, tk mix_tokens, blk::bigint mix_block, e::bigint mix_epoch, place::bigint mix_order from x join pl using (k, blk, e)"""

QUERIES = {"op6_temperature_mixing": op6_temperature_mixing}
ORACLES = {"op6_temperature_mixing": _ORACLE}
