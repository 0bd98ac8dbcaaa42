"""First-stage retrieval, runs, re-ranking and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import evaluate as E
from ..operators import index as I
from ..operators import ranking as R
from ..schema import BM25, QLDirichlet, nDCG
from ..schema import AP, P, RR, Success
from ..schema import R as Recall
from . import fixtures as X

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_RUN = "select qid, doc_id, score, rank from run"
register("bm25_top10", lambda s, d: X.bm25(s, d, 10), f"with {X.sql_bm25(10)} {_RUN}")
register("bm25_k12_b75", lambda s, d: X.index(s, d).search(X.topics(s, d), BM25(1.2, 0.75), 10), f"with {X.sql_bm25(10, 1.2, 0.75)} {_RUN}")
register(
    "qld_top10",
    lambda s, d: X.index(s, d).search(X.topics(s, d), QLDirichlet(1000.0), 10),
    f"""with {X.SQL_DOCS}, {X.SQL_TOPICS}, r as (select q.qid, p.doc_id, round(sum(qtf * greatest(0.0, ln(1 + tf / (1000.0 * cf / total)) + ln(1000.0 / (dl + 1000.0)))), 6) score
 from q join lx using (term) join p using (term) join dl using (doc_id), st group by all)
select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from r) where rank <= 10""",
)
register("tokenize_ascii", lambda s, d: X.documents(s, d).select("doc_id", F.array_join(T.tokens("text"), " ").alias("toks"), F.size(T.tokens("text")).cast("bigint").alias("n")), f"select doc_id, array_to_string({X.TOK}, ' ') toks, len({X.TOK})::bigint n from documents")
_WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
register("tokenize_word", lambda s, d: X.documents(s, d).select("doc_id", F.array_join(T.word_tokens("text"), " ").alias("toks"), F.size(T.word_tokens("text")).cast("bigint").alias("n")), f"select doc_id, array_to_string({_WORDS}, ' ') toks, len({_WORDS})::bigint n from documents")
register("doc_lengths", lambda s, d: I.doc_lengths(X.documents(s, d)), f"with {X.SQL_DOCS} select * from dl")
register("lexicon_df_cf", lambda s, d: I.lexicon(I.postings(X.documents(s, d))), f"with {X.SQL_DOCS} select term, df, cf from lx")
register("postings", lambda s, d: I.postings(X.documents(s, d)), f"with {X.SQL_DOCS} select term, doc_id, tf from p")
register("index_statistics", lambda s, d: X.index(s, d).statistics().select("n_docs", "total", F.round("avgdl", 6).alias("avgdl")), f"with {X.SQL_DOCS} select n n_docs, total::bigint total, round(avgdl, 6) avgdl from st")
_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
register(
    "stop_words",
    lambda s, d: X.documents(s, d).select("doc_id", F.array_join(T.without_stop_words(T.tokens("text")), " ").alias("toks")),
    f"select doc_id, array_to_string(list_filter({X.TOK}, lambda x: x not in ({_STOPS})), ' ') toks from documents",
)
register("stemmed_lexicon", lambda s, d: I.lexicon(I.postings(X.documents(s, d), I.Analyzer(T.STOP_WORDS, "porter"))))
register("run_hydrated", lambda s, d: R.hydrated(X.bm25(s, d, 10), X.documents(s, d)), f"with {X.sql_bm25(10)} select qid, doc_id, score, rank, text from run join documents using (doc_id)")
register(
    "run_replay",
    lambda s, d: R.replay(X.bm25(s, d, 50).select("qid", "doc_id", "score"), X.topics(s, d), 5),
    f"with {X.sql_bm25(5)} {_RUN}",
)
register("full_retriever", lambda s, d: R.full_retriever(X.topics(s, d), X.documents(s, d)), "select item_id qid, doc_id, 0.0::double score, row_number() over (partition by item_id order by doc_id) rank from benchmark, documents")


def _overlap(s, d):
    run = X.bm25(s, d, 50).drop("score", "rank").join(X.documents(s, d), "doc_id").join(X.topics(s, d).withColumnRenamed("text", "query"), "qid")
    q, t = F.array_distinct(T.tokens("query")), F.array_distinct(T.tokens("text"))
    return R.rerank(run, F.size(F.array_intersect(q, t)) / F.size(q), 10).select("qid", "doc_id", "score", "rank")


_SQL_OVERLAP = f"""o as (select r.qid, r.doc_id, round(len(list_intersect(list_distinct({X.TOK.replace('text', 'b.text')}), list_distinct({X.TOK.replace('text', 'e.text')}))) / len(list_distinct({X.TOK.replace('text', 'b.text')})), 6) score
  from run r join documents e using (doc_id) join benchmark b on b.item_id = r.qid)"""
_TOP = "select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from {t}) where rank <= {k}"
register("two_stage_overlap", _overlap, f"with {X.sql_bm25(50)}, {_SQL_OVERLAP} {_TOP.format(t='o', k=10)}")


def _duo(s, d):
    run = X.bm25(s, d, 20).join(I.doc_lengths(X.documents(s, d)), "doc_id").select("qid", "doc_id", F.col("score").alias("s"), "dl")
    preference = V.sigmoid(F.col("s") - F.col("s_2")) + F.when(F.col("dl") < F.col("dl_2"), 0.25).otherwise(0.0)
    return R.duo_rerank(run, preference, 10, ("s", "dl"))


register(
    "duo_rerank",
    _duo,
    f"""with {X.sql_bm25(20)}, c as (select run.*, dl from run join dl using (doc_id)),
o as (select a.qid, a.doc_id, round(sum(1 / (1 + exp(-(a.score - b.score))) + case when a.dl < b.dl then 0.25 else 0.0 end), 6) score from c a join c b on a.qid = b.qid and a.doc_id <> b.doc_id group by all) {_TOP.format(t='o', k=10)}""",
)
register(
    "random_scorer",
    lambda s, d: R.rerank(X.bm25(s, d, 50).select("qid", "doc_id"), V.hashed_unit(7, F.col("qid"), F.col("doc_id")), 10),
    f"with {X.sql_bm25(50)}, o as (select qid, doc_id, round({X.unit('7', 'qid', 'doc_id')}, 6) score from run) {_TOP.format(t='o', k=10)}",
)


def sql_measure(m: str, rel: int = 1, k: int | None = None, run: str = "run") -> str:
    """Per-query value of one measure over CTEs ``run`` and ``qrels``, as (qid, value)."""
    cut = f" and rank <= {k}" if k else ""
    j = f"(select r.qid, r.rank, coalesce(x.rel, 0) rel from {run} r left join qrels x using (qid, doc_id))"
    total = f"(select count(*) from qrels y where y.qid = t.qid and y.rel >= {rel})"
    value = {
        "P": f"(select count(*) from {j} j where j.qid = t.qid and rel >= {rel}{cut}) / {k or 1}.0",
        "R": f"(select count(*) from {j} j where j.qid = t.qid and rel >= {rel}{cut}) / nullif({total}, 0)::double",
        "Success": f"(select max(case when rel >= {rel} then 1.0 else 0.0 end) from {j} j where j.qid = t.qid{cut})",
        "RR": f"1 / (select min(rank) from {j} j where j.qid = t.qid and rel >= {rel}{cut})::double",
        "AP": f"(select sum(n / rank) from (select rank, count(*) over (order by rank) n from {j} j where j.qid = t.qid and rel >= {rel}{cut})) / nullif({total}, 0)::double",
        "nDCG": f"(select sum(rel / log2(rank + 1)) from {j} j where j.qid = t.qid{cut}) / (select sum(rel / log2(i + 1)) from (select rel, row_number() over (order by rel desc, doc_id) i from qrels y where y.qid = t.qid and rel > 0) {'where i <= ' + str(k) if k else ''})",
    }[m]
    return f"select qid, round(coalesce({value}, 0)::double, 6) as value from (select distinct qid from qrels) t"


def _measured(measures):
    return lambda s, d: E.per_query(X.bm25(s, d, 100), X.qrels(s, d), measures)


def _sql_measured(measures) -> str:
    parts = " union all ".join(f"select qid, '{m.label}' measure, value from ({sql_measure(m.name, m.rel, m.cutoff)})" for m in measures)
    return f"with {X.sql_bm25(100)}, {X.SQL_QRELS} {parts}"


for _name, _ms in {
    "eval_ap": (AP, AP @ 10),
    "eval_p_at": (P @ 5, P @ 20, P(2) @ 10),
    "eval_recall_at": (Recall @ 10, Recall(2) @ 100),
    "eval_rr": (RR, RR @ 10, RR(2)),
    "eval_ndcg_at": (nDCG, nDCG @ 10),
    "eval_success_at": (Success @ 1, Success(2) @ 5),
    "eval_detail": (AP, P @ 20, nDCG, nDCG @ 20, RR),
}.items():
    register(_name, _measured(_ms), _sql_measured(_ms))
_DEFAULT = (AP, P @ 20, nDCG, nDCG @ 20, RR)
register("eval_aggregate", lambda s, d: E.evaluate(X.bm25(s, d, 100), X.qrels(s, d), _DEFAULT), f"select measure, round(avg(value), 6) as value from ({_sql_measured(_DEFAULT)}) group by measure")


def _results(s, d, measures):
    q = X.qrels(s, d)
    a, b = X.bm25(s, d, 100), X.index(s, d).search(X.topics(s, d), BM25(1.2, 0.75), 100)
    return {"bm25": E.evaluate(a, q, measures), "bm25_k12": E.evaluate(b, q, measures)}


_TWO = (P @ 10, RR)
_SQL_TWO = f"""with {X.sql_bm25(100)}, other_s as (select q.qid, p.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) score
  from q join lx using (term) join p using (term) join dl using (doc_id), st group by all),
other as (select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from other_s) where rank <= 100), {X.SQL_QRELS},
a as (select 'bm25' tag, (select round(avg(value), 6) from ({sql_measure('P', 1, 10)})) x, (select round(avg(value), 6) from ({sql_measure('RR')})) y
  union all select 'bm25_k12', (select round(avg(value), 6) from ({sql_measure('P', 1, 10, 'other')})), (select round(avg(value), 6) from ({sql_measure('RR', 1, None, 'other')})))"""
register("eval_compare_pivot", lambda s, d: E.comparison(_results(s, d, _TWO), _TWO).select("tag", F.col("`P@10`").alias("p_10"), F.col("RR").alias("rr")), f"{_SQL_TWO} select tag, x p_10, y rr from a")
register("eval_collection_union", lambda s, d: E.collection(_results(s, d, _TWO)), f"{_SQL_TWO} select tag dataset, 'P@10' measure, x as value from a union all select tag, 'RR', y from a")


def _history(s, d):
    """Events by hour as epochs: one run per event type, measures from the values."""
    ev = X.table(s, d, "events").select(F.col("event_type").alias("run"), F.floor(F.unix_timestamp("ts") / 3600).alias("hour"), "value")
    rows = ev.groupBy("run", "hour").agg(F.round(F.max("value"), 6).alias("hi"), F.round(F.min("value"), 6).alias("lo"))
    first = rows.groupBy("run").agg(F.min("hour").alias("h0"))
    rows = rows.join(first, "run").withColumn("epoch", (F.col("hour") - F.col("h0")).cast("bigint"))
    return rows.select("run", "epoch", F.expr("stack(2, 'hi', hi, 'lo', lo) as (measure, value)"))


_SQL_HISTORY = """e as (select event_type run, floor(epoch(ts) / 3600)::bigint hr, max(value) hi, min(value) lo from events group by all),
h0 as (select *, hr - min(hr) over (partition by run) epoch from e),
h as (select run, epoch, 'hi' measure, round(hi, 6) as value from h0 union all select run, epoch, 'lo', round(lo, 6) from h0)"""
register(
    "early_stopping",
    lambda s, d: E.early_stopping(_history(s, d), 2, 5).withColumn("since", F.col("since").cast("bigint")),
    f"""with {_SQL_HISTORY}, a as (select *, max(value) over (partition by run, measure order by epoch rows between unbounded preceding and 1 preceding) b from h where epoch >= 2),
i as (select run, epoch, measure, value, b is null or value > b improved, greatest(value, coalesce(b, value)) best from a),
l as (select *, max(case when improved then epoch end) over (partition by run, measure order by epoch rows unbounded preceding) at_ from i),
z as (select *, epoch - max(at_) over (partition by run, epoch) since from l)
select run, epoch, measure, value, improved, best, since, since >= 5 stop from z""",
)
register(
    "aggregated_validation",
    lambda s, d: E.aggregated_validation(_history(s, d)),
    f"with {_SQL_HISTORY}, b as (select run, epoch, max(value) over (partition by run, measure order by epoch rows unbounded preceding) best from h) select run, epoch, round(avg(best), 6) as value from b group by all",
)
