"""Training samples and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets as C
from ..operators import evaluate as E
from ..operators import losses as L
from ..operators import sampling as M
from ..operators.index import doc_lengths
from . import fixtures as X
from .fixtures import unit

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _samples(s, d):
    return M.model_samples(X.bm25(s, d, 50).drop("rank"), X.qrels(s, d))


_LABELLED = f"{X.sql_bm25(50)}, {X.SQL_QRELS}, lab as (select r.qid, doc_id, score, rank, coalesce(rel, 0)::int rel from run r left join qrels using (qid, doc_id) where r.qid in (select qid from qrels))"
_SAMPLES = f"""{_LABELLED}, s0 as (select qid, doc_id, 0.0::double score, rel, true positive from qrels where rel > 0 union all select qid, doc_id, score, rel, false from lab where rel <= 0),
s as (select * from s0 where qid in (select qid from s0 where positive) and qid in (select qid from s0 where not positive)),
o as (select *, row_number() over (partition by qid, positive order by doc_id) - 1 i, count(*) over (partition by qid, positive) n from s)"""
register("model_samples", _samples, f"with {_SAMPLES} select * from s")
register(
    "hard_negatives",
    lambda s, d: M.hard_negatives(X.bm25(s, d, 50).drop("rank"), X.qrels(s, d)).select("qid", F.array_join(F.col("positives").cast("array<string>"), " ").alias("p"), F.array_join(F.col("negatives").cast("array<string>"), " ").alias("n")),
    f"with {_LABELLED} select qid, string_agg(doc_id::varchar, ' ' order by rank) filter (rel > 0) p, string_agg(doc_id::varchar, ' ' order by rank) filter (rel <= 0) n from lab group by qid having count(*) filter (rel > 0) > 0 and count(*) filter (rel <= 0) > 0",
)
register(
    "pointwise_sample",
    lambda s, d: M.pointwise(_samples(s, d), 500, 0.5, 11).select("ordinal", (F.col("rel") > 0).alias("positive")),
    f"select i ordinal, {unit('11', chr(39) + 'side' + chr(39), 'i')} < 0.5 positive from range(500) t(i)",
)
_TRIPLETS = f"""{_SAMPLES}, z as (select qid, max(n) filter (positive) np, max(n) filter (not positive) nn from o group by qid),
k as (select qid, ordinal, floor({unit('4', "'p'", 'qid', 'ordinal')} * np) ip, floor({unit('4', "'n'", 'qid', 'ordinal')} * nn) im from z, range(8) t(ordinal)),
tr as (select k.qid, ordinal, a.doc_id pos_id, b.doc_id neg_id from k join o a on a.qid = k.qid and a.positive and a.i = ip join o b on b.qid = k.qid and not b.positive and b.i = im)"""
_triplets = lambda s, d: M.pairwise_triplets(_samples(s, d), 8, 4)
register("pairwise_triplets", _triplets, f"with {_TRIPLETS} select * from tr")


def _in_batch(s, d):
    one = _triplets(s, d).where("ordinal = 0").select(F.col("qid").alias("ordinal"), "qid", "pos_id", "neg_id")
    return M.in_batch_matrix(one, 8)


register(
    "inbatch_matrix",
    _in_batch,
    f"""with {_TRIPLETS}, r as (select qid // 8 batch, qid % 8 as row, qid, pos_id, neg_id, count(*) over (partition by qid // 8) n from tr where ordinal = 0),
c as (select batch, row as col, pos_id doc_id from r union all select batch, row + n, neg_id from r)
select r.batch, row, col, qid, doc_id, case when row = col then 1.0 else 0.0 end::double relevance from r join c using (batch)""",
)
register(
    "listwise_negatives",
    lambda s, d: M.listwise_negatives(_samples(s, d), 8, 6),
    f"""with {_SAMPLES}, f as (select qid, doc_id from o where positive and i = 0), n1 as (select qid, n from o where not positive and i = 0)
select qid, 0::bigint pos, doc_id, 1::int as label from f union all
select n1.qid, pos, o.doc_id, 0 from n1 cross join range(1, 8) t(pos) join o on o.qid = n1.qid and not o.positive and o.i = floor({unit('6', 'n1.qid', 'pos')} * n1.n) where n1.qid in (select qid from f)""",
)


def _lists(s, d):
    """First-stage lists with grades and scores, scaled down."""
    return M.labelled(X.bm25(s, d, 20).drop("rank"), X.qrels(s, d)).select("qid", "doc_id", (F.col("score") / 10).alias("score"), "rel")


_LISTS = f"{X.sql_bm25(20)}, {X.SQL_QRELS}, li as (select r.qid, doc_id, score / 10 score, coalesce(rel, 0)::int rel from run r left join qrels using (qid, doc_id) where r.qid in (select qid from qrels))"
register("graded_pairs", lambda s, d: M.graded_pairs(_lists(s, d)), f"with {_LISTS} select a.qid, a.doc_id a, b.doc_id b, a.score, b.score score_b from li a join li b using (qid) where a.rel > b.rel")


def _teacher(s, d):
    t = _triplets(s, d)
    ids = t.select("qid", F.explode(F.array("pos_id", "neg_id")).alias("doc_id")).distinct()
    scores = ids.join(doc_lengths(X.documents(s, d)), "doc_id").select("qid", "doc_id", (F.lit(100.0) / (F.col("dl") + 10)).alias("score"))
    return M.teacher_triplets(t, scores)


_TEACHER = f"{_TRIPLETS}, te as (select tr.*, 100.0::double / (a.dl + 10) pos_score, 100.0::double / (b.dl + 10) neg_score from tr join dl a on a.doc_id = pos_id join dl b on b.doc_id = neg_id)"
register("teacher_triplets", lambda s, d: _teacher(s, d).withColumns({c: F.round(c, 6) for c in ("pos_score", "neg_score")}), f"with {_TEACHER} select qid, ordinal, pos_id, neg_id, round(pos_score, 6) pos_score, round(neg_score, 6) neg_score from te")
register("hydrated_triplets", lambda s, d: M.hydrate_triplets(_triplets(s, d), X.topics(s, d), X.documents(s, d)), f'with {_TRIPLETS} select tr.*, b.text as "query", x.text positive, y.text negative from tr join benchmark b on b.item_id = qid join documents x on x.doc_id = pos_id join documents y on y.doc_id = neg_id')
register("span_pairs", lambda s, d: C.span_pairs(X.documents(s, d), 120, 2))


def _distilled(s, d):
    """Pairs with student scores from ids and teacher scores from lengths."""
    t = _teacher(s, d).withColumnsRenamed({"pos_score": "pos_teacher", "neg_score": "neg_teacher"})
    return t.withColumns({"pos_score": (F.col("pos_id") % 7) / 7.0, "neg_score": (F.col("neg_id") % 7) / 7.0})


_DISTILLED = f"{_TEACHER}, di as (select pos_score pt, neg_score nt, (pos_id % 7) / 7.0::double ps, (neg_id % 7) / 7.0::double ns from te)"
register("loss_delta_mse", lambda s, d: L.delta_mse(_distilled(s, d)), f"with {_DISTILLED} select round(avg(pow((ps - ns) - (pt - nt), 2)), 6) loss from di")
register(
    "loss_kl",
    lambda s, d: L.kl_divergence(_distilled(s, d)),
    f"with {_DISTILLED}, kd as (select 1 / (1 + exp(-(pt - nt))) t, ps - ns x from di) select round(avg(t * (ln(t) + ln(1 + exp(-x))) + (1 - t) * (ln(1 - t) + ln(1 + exp(x)))), 6) loss from kd",
)
register("pairwise_accuracy", lambda s, d: E.pairwise_accuracy(_distilled(s, d)), f"with {_DISTILLED} select round(avg((ps > ns)::int), 6) accuracy from di")
register("loss_ranknet", lambda s, d: L.ranknet(_lists(s, d)), f"with {_LISTS} select round(avg(ln(1 + exp(-(a.score - b.score)))), 6) loss from li a join li b using (qid) where a.rel > b.rel")
register(
    "loss_adr_mse",
    lambda s, d: L.adr_mse(_lists(s, d)),
    f"""with {_LISTS}, r as (select *, row_number() over (partition by qid order by rel desc, doc_id) r from li),
x as (select a.qid, a.doc_id, r, 1 + sum(case when a.doc_id <> b.doc_id then 1 / (1 + exp(-(b.score - a.score))) else 0.0 end) soft from r a join li b using (qid) group by all)
select round(avg(pow(soft - r, 2) / log2(r + 1)), 6) loss from x""",
)
_LOGSOFT = f"{_LISTS}, ls as (select *, score - ln(sum(exp(score)) over (partition by qid)) lp from li)"
register(
    "loss_softmax_ce",
    lambda s, d: L.softmax_cross_entropy(_lists(s, d)),
    f"with {_LOGSOFT}, x as (select qid, lp + 1 - 1 / greatest(rel::double, 1e-8) x from ls), m as (select qid, x, max(x) over (partition by qid) m from x), l as (select qid, max(m) + ln(sum(exp(x - m))) l from m group by qid) select round(-avg(l), 6) loss from l",
)
register("loss_infonce", lambda s, d: L.info_nce(_lists(s, d)), f"with {_LOGSOFT}, l as (select qid, -avg(lp) l from ls where rel > 0 group by qid) select round(avg(l), 6) loss from l")
register("loss_bce", lambda s, d: L.binary_cross_entropy(_lists(s, d)), f"with {_LISTS} select round(avg(greatest(score, 0) - score * (rel > 0)::int + ln(1 + exp(-abs(score)))), 6) loss from li")
register("loss_hinge", lambda s, d: L.hinge(_lists(s, d)), f"with {_LISTS} select round(avg(greatest(0, 1 - a.score + b.score)), 6) loss from li a join li b using (qid) where a.rel > 0 and b.rel <= 0")


def _ranker(s, d):
    t = _teacher(s, d).withColumnsRenamed({"pos_score": "pos_length", "neg_score": "neg_length"})
    t = t.withColumns({"pos_id7": F.col("pos_id") % 7, "neg_id7": F.col("neg_id") % 7})
    w = L.linear_ranker(t, ["length", "id7"])
    return s.createDataFrame([("length", float(w[0])), ("id7", float(w[1]))], "feature string, weight double")


register("linear_pairwise_ranker", _ranker)
