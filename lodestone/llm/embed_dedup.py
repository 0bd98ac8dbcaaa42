"""Operator 8, embedding near-dedup: a pivot-permutation index whose prefixes lose no link, with verified links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise

COSINE = 0.98
#: Reference points of a dimension: at most so many, one for each BLOCK vectors of its largest label.
PIVOTS = 1024
#: Vectors that the pivots are picked from, by their distance from those already picked.
SAMPLE = 4096
#: Homes or visitors of an inverted list that one task compares at once.
BLOCK = 1024
#: Linked unit vectors are at most so far apart; the slack is for rounding.
REACH = (2 - 2 * COSINE) ** 0.5 + 1e-6


def _separated(x: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the unit rows of ``x``, each the farthest from those picked before it."""
    picked, nearest = [0], x @ x[0]
    while len(picked) < min(n, len(x)):
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    return x[picked]


def _permute(pivots):
    """Rows of representatives with ``home``, the nearest pivot, and ``visits``, the pivots of a lower number that
    may be the home of a linked vector.

    For a linked pair x, y and pivots p, q: (x - y)(p - q) <= REACH |p - q|. If p is the home of x, then
    yp >= yq - REACH |p - q| for each q, so y visits p or has it as home; a pair thus meets once, in one list.
    """

    def run(batches):
        p = pivots.value
        apart = {d: REACH * np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) + 1e-9 for d, x in p.items()}
        for b in batches:
            dims = np.diff(b.column(2).offsets.to_numpy())
            flat = b.column(2).values.to_numpy(zero_copy_only=False)
            offsets = b.column(2).offsets.to_numpy()
            home, visits = np.zeros(b.num_rows, np.int32), [[]] * b.num_rows
            for d in np.unique(dims):
                rows, piv = np.flatnonzero(dims == d), p[int(d)]
                x = np.stack([flat[offsets[r] : offsets[r] + d] for r in rows]).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                dots = x @ piv.T
                home[rows] = h = np.argmax(dots, axis=1)
                may = dots >= dots[np.arange(len(h)), h][:, None] - apart[int(d)][h]
                may &= np.arange(len(piv)) < h[:, None]
                for r, m in zip(rows.tolist(), may, strict=True):
                    visits[r] = np.flatnonzero(m).tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(visits, pa.list_(pa.int32()))], names=[*b.schema.names, "home", "visits"])

    return run


def _links(key, table):
    """Links of one pair of blocks of an inverted list: partial link counts, and a forest that keeps components."""
    ids, side, mult = table["rep"].to_numpy(), table["side"].to_numpy(), table["copies"].to_numpy()
    diagonal = key[3].as_py() == key[4].as_py()
    x = np.asarray(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
    norm = np.sqrt((x * x).sum(axis=1))
    a = np.flatnonzero(side == 0)
    b = a if diagonal else np.flatnonzero(side == 1)
    linked = np.zeros((len(a), len(b)), bool)
    for s in range(0, len(a), 256):
        rows = a[s : s + 256]
        cosine = (x[rows] @ x[b].T) / (norm[rows, None] * norm[b])
        linked[s : s + 256] = cosine >= COSINE
        # close to the bound the order of summation decides: those pairs are summed one by one
        r, c = np.nonzero(np.abs(cosine - COSINE) < 1e-12)
        i, j = rows[r], b[c]
        linked[s + r, c] = (x[i] * x[j]).sum(axis=1) / (norm[i] * norm[j]) >= COSINE
    if diagonal:
        np.fill_diagonal(linked, False)
    count = np.zeros(len(ids), np.int64)
    for s in range(0, len(a), 256):
        count[a[s : s + 256]] = linked[s : s + 256] @ mult[b]
    if not diagonal:
        count[b] = linked.T @ mult[a]
    # a tree for each component: breadth first, each vector of ``a`` spreads once
    u, v, free, left = [], [], np.ones(len(b), bool), np.ones(len(a), bool)
    for root in range(len(a)):
        todo = [root] if left[root] else []
        left[root] = False
        while todo:
            k = todo.pop()
            new = np.flatnonzero(linked[k] & free)
            free[new] = False
            u += [a[k]] * len(new)
            v += b[new].tolist()
            if diagonal:
                more = new[left[new]]
            else:
                more = np.flatnonzero(linked[:, new].any(axis=1) & left) if len(new) else new
                u += [b[new[np.argmax(linked[m, new])]] for m in more]
                v += a[more].tolist()
            left[more] = False
            todo += more.tolist()
    n, u, v = np.flatnonzero(count), np.array(u, np.int64), np.array(v, np.int64)
    out = [np.r_[ids[n], ids[u]], np.r_[np.full(len(n), -1), ids[v]], np.r_[count[n], np.zeros(len(u), np.int64)]]
    return pa.Table.from_arrays([pa.array(o.astype(np.int64)) for o in out], names=["rep", "other", "links"])


def dedup_embeddings(vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, embedding, label)``.

    Rows link when their labels are equal and not null and the cosine is COSINE or more. Null, empty and
    zero vectors and vectors with null or non-finite components link with nothing, nor do vectors of
    different dimension. Equal vectors of a label form one representative, so copies make no pairs; repeated
    rows of one vec_id count as copies. Representatives meet in the inverted lists of their pivots (see
    ``_permute``; no link is lost) and are verified in double precision. Long lists are split into pairs of
    blocks. The pivots are well separated vectors of a sample by hash; every vector is indexed.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("label"), v.cast("array<double>").alias("v"))
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(good, F.transform("v", lambda x: x + F.lit(0.0))))
    hashed = rows.withColumn("vh", F.when(F.col("v").isNotNull(), F.xxhash64("label", F.size("v"), "v")))
    # the vector itself is a key beside its hash, so hash collisions join nothing
    reps = materialise(hashed.where("v is not null").groupBy("label", "vh", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.max("vec_id").alias("top")), "reps")
    pivots = {}
    groups = reps.groupBy("label", F.size("v").alias("d")).count()
    for r in groups.groupBy("d").agg(F.max("count").alias("n")).collect():
        picked = reps.where(F.size("v") == r["d"]).select("v", F.xxhash64("v", F.lit(7)).alias("h")).orderBy("h").limit(SAMPLE).collect()
        p = np.array([x["v"] for x in picked])
        pivots[r["d"]] = _separated(p / np.linalg.norm(p, axis=1, keepdims=True), min(PIVOTS, -(-r["n"] // BLOCK)))
    shared = spark.sparkContext.broadcast(pivots)
    kind = reps.schema["label"].dataType.simpleString()
    indexed = materialise(reps.select("rep", "copies", "v", "label").mapInArrow(_permute(shared), f"rep bigint, copies bigint, v array<double>, label {kind}, home int, visits array<int>"), "pivots")
    lists = indexed.withColumn("d", F.size("v")).withColumn("p", F.explode(F.concat(F.array("home"), "visits"))).withColumn("at_home", F.col("p") == F.col("home")).drop("home", "visits")
    # vectors of one label and dimension only meet each other; visitors of a list meet its homes
    sizes = lists.groupBy("label", "d", "p").agg(*(F.ceil(F.count(F.when(c, 1)) / BLOCK).cast("int").alias(n) for c, n in ((F.col("at_home"), "nh"), (~F.col("at_home"), "nv"))))
    cut = lists.join(sizes.where("nh > 0"), ["label", "d", "p"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.when(F.col("at_home"), F.col("nh")).otherwise(F.col("nv"))).cast("int"))
    homes = F.sequence(F.lit(0), F.col("nh") - 1)
    meet = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    mine, zero, one = F.col("mine"), F.lit(0), F.lit(1)
    others = F.when(F.col("nv") > 0, F.transform(F.sequence(zero, F.col("nv") - 1), lambda o: meet(mine, F.col("nh") + o, zero))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    inside = F.transform(homes, lambda o: meet(F.least(mine, o), F.greatest(mine, o), F.when(mine <= o, zero).otherwise(one)))
    pairs = F.when(F.col("at_home"), F.concat(inside, others)).otherwise(F.transform(homes, lambda o: meet(o, F.col("nh") + mine, one)))
    cut = cut.select("label", "d", "p", "rep", "copies", "v", F.inline(pairs))
    found = cut.groupBy("label", "d", "p", "i", "j").applyInArrow(_links, "rep bigint, other bigint, links bigint")
    found = materialise(found, "links")
    counts = found.where("other < 0").groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("other >= 0").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    info = reps.select("label", "vh", "v", "rep", "copies").join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("label", "vh", F.col("v").alias("rv"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "rep").alias("c"))
    out = hashed.alias("a").join(info.alias("b"), (F.col("a.label") == F.col("b.label")) & (F.col("a.vh") == F.col("b.vh")) & (F.col("a.v") == F.col("b.rv")), "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings."""
    return dedup_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ORACLE = """
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: x::double) v from embeddings),
g as (select * from e where label is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from g a join g b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.98),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select vec_id, (select count(*) from l where l.a = e.vec_id)::bigint n_links, least(vec_id, coalesce((select min(b) from r where r.a = e.vec_id), vec_id))::bigint component_id,
  vec_id = least(vec_id, coalesce((select min(b) from r where r.a = e.vec_id), vec_id)) kept from e"""

QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
ORACLES = {"op8_embedding_dedup": _ORACLE}
