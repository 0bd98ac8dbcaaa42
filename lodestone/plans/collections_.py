"""Folds, subsets and sub-collections; file formats read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as S
from ..operators import datasets as C
from ..operators import ranking as R
from ..operators.index import small
from ..schema import Adhoc
from ..storage import scratch
from . import fixtures as X

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _ids(s, d):
    """Topics with a graded document among the judged ones: ids of a fold."""
    return X.qrels(s, d).where("rel = 2").select("qid").distinct()


def _adhoc(s, d):
    return Adhoc(X.documents(s, d), X.topics(s, d), X.qrels(s, d))


_IDS = f"{X.SQL_QRELS}, ids as (select distinct qid from qrels where rel = 2)"
register("topic_fold", lambda s, d: C.topic_fold(X.topics(s, d), _ids(s, d)), f"with {_IDS} select item_id qid, text from benchmark where item_id in (select qid from ids)")
register("qrels_fold", lambda s, d: C.fold(_adhoc(s, d), _ids(s, d)).qrels, f"with {_IDS} select * from qrels where qid in (select qid from ids)")
_ORD = "row_number() over (order by md5('{seed}:' || item_id), item_id) - 1 p, count(*) over () n"
_FRACTION = f"a as (select item_id qid, {_ORD.format(seed=5)} from benchmark)"
register("random_fold", lambda s, d: C.random_fold(X.topics(s, d), [10, 5], 3), f"with a as (select item_id qid, {_ORD.format(seed=3)} from benchmark) select qid, (case when p < 10 then 0 else 1 end)::bigint fold from a where p < 15")
register(
    "random_fold_fraction",
    lambda s, d: C.random_fold(X.topics(s, d), [0.5, 0.3, 0.2], 5),
    f"with {_FRACTION} select qid, (case when p < round_even(n * 0.5, 0) then 0 when p < round_even(n * 0.5, 0) + round_even(n * 0.3, 0) then 1 else 2 end)::bigint fold from a",
)
register(
    "fold_exclude",
    lambda s, d: C.random_fold(X.topics(s, d), [0.5, 0.5], 5, C.random_fold(X.topics(s, d), [10], 3)),
    f"""with x as (select item_id qid, {_ORD.format(seed=3)} from benchmark), b as (select item_id from benchmark where item_id not in (select qid from x where p < 10)),
a as (select item_id qid, {_ORD.format(seed=5)} from b) select qid, (case when p < round_even(n * 0.5, 0) then 0 else 1 end)::bigint fold from a""",
)


def _concat(s, d):
    folds, data = C.random_fold(X.topics(s, d), [10, 5, 5], 3), _adhoc(s, d)
    part = lambda i: C.fold(data, folds.where(F.col("fold") == i))
    return C.concatenated([part(0), part(2)]).qrels


register("concat_folds", _concat, f"with {X.SQL_QRELS}, a as (select item_id qid, {_ORD.format(seed=3)} from benchmark) select * from qrels where qid in (select qid from a where p < 10 or (p >= 15 and p < 20))")
register(
    "doc_subset",
    lambda s, d: R.document_subset(X.documents(s, d), X.table(s, d, "labels").where("quality = 1").select("doc_id", F.col("doc_id").alias("ord"))),
    "select doc_id, text, doc_id ord from documents join labels using (doc_id) where quality = 1",
)
register("retriever_based_collection", lambda s, d: C.retriever_collection(X.qrels(s, d), X.bm25(s, d, 20), 0), f"with {X.sql_bm25(20)}, {X.SQL_QRELS} select doc_id from qrels union select doc_id from run where qid in (select qid from qrels)")
register("head_docs", lambda s, d: C.head_documents(X.documents(s, d), 500, 0.25).select("doc_id"), "select doc_id from documents order by doc_id limit (select least(500, floor(0.25 * count(*)))::bigint from documents)")
register("random_docs", lambda s, d: C.random_documents(X.documents(s, d), 100, 9).select("doc_id"), "select doc_id from documents order by md5('9:' || doc_id), doc_id limit 100")
register("numbered_docs", lambda s, d: C.numbered(X.documents(s, d)).select("doc_id", "doc_ix"), "select doc_id, row_number() over (order by doc_id) - 1 doc_ix from documents")
register("except_topics", lambda s, d: X.topics(s, d).select("qid").exceptAll(_ids(s, d)), f"with {_IDS} select item_id qid from benchmark where item_id not in (select qid from ids)")
register("intersect_pairs", lambda s, d: X.qrels(s, d).select("qid", "doc_id").intersect(X.bm25(s, d, 100).select("qid", "doc_id")), f"with {X.sql_bm25(100)}, {X.SQL_QRELS} select qid, doc_id from qrels intersect select qid, doc_id from run")
register("batch_numbers", lambda s, d: R.batches(C.numbered(X.documents(s, d)), "doc_ix", 64).groupBy("batch").agg(F.count("*").alias("n")), "select i // 64 batch, count(*) n from (select row_number() over (order by doc_id) - 1 i from documents) group by 1")


def _through(write, read, name):
    def query(s, d):
        path = scratch(s, name)
        write(s, d, path)
        return read(s, path)

    return query


_RUN10 = f"with {X.sql_bm25(10)}"
register("trec_run_round_trip", _through(lambda s, d, p: S.write_run(X.bm25(s, d, 10), p), S.read_run, "run"), f"{_RUN10} select qid::varchar qid, doc_id::varchar doc_id, rank, score from run")
register("trec_qrels_round_trip", _through(lambda s, d, p: S.write_qrels(X.qrels(s, d), p), S.read_qrels, "qrels"), f"with {X.SQL_QRELS} select qid::varchar qid, doc_id::varchar doc_id, rel from qrels")
register("topics_tsv_round_trip", _through(lambda s, d, p: S.write_topics(X.topics(s, d), p), S.read_topics, "topics"), r"select item_id::varchar qid, regexp_replace(text, '[\t\r\n]', ' ', 'g') as text from benchmark")
register("contents_jsonl_round_trip", _through(lambda s, d, p: S.write_contents(X.documents(s, d), p), lambda s, p: s.read.schema("id string, contents string").json(p), "contents"), "select doc_id::varchar id, text contents from documents")
register(
    "distillation_lists_round_trip",
    _through(lambda s, d, p: S.write_run(X.bm25(s, d, 10), p), lambda s, p: S.read_distillation_lists(s, p, 5).select("qid", F.posexplode("docs").alias("i", "x")).select("qid", F.col("i").cast("bigint").alias("i"), F.col("x.score").alias("score")), "lists"),
    f"{_RUN10} select qid::varchar qid, rank - 1 i, score from run where rank <= 5",
)
register("metric_lines", lambda s, d: S.metric_lines(X.qrels(s, d).groupBy("qid").agg(F.avg("rel").alias("value")).select(F.lit("mean_rel").alias("measure"), F.col("qid").alias("scope"), "value")), f"with {X.SQL_QRELS} select format('{{:25s}} {{:10s}} {{:.4f}}', 'mean_rel', qid::varchar, avg(rel)) as value from qrels group by qid")


def _pairwise_json(s, d):
    conv = X.table(s, d, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("role") == "user", F.col("turn").cast("string")))).alias("queries"),
        F.sort_array(F.collect_set(F.when(F.col("role") == "assistant", F.col("turn").cast("string")))).alias("pos_ids"),
    )
    return conv.select("queries", "pos_ids", F.create_map(F.lit("next"), F.array((F.col("conv_id") + 1).cast("string"))).alias("neg_ids"))


register(
    "jsonl_pairwise_round_trip",
    _through(lambda s, d, p: S.write_jsonl(_pairwise_json(s, d), p), lambda s, p: S.read_jsonl_pairwise(s, p).select(F.array_join("queries", " ").alias("q"), F.array_join("pos_ids", " ").alias("p"), F.col("neg_ids")["next"][0].alias("n")), "jsonl"),
    """select coalesce(string_agg(distinct turn::varchar, ' ' order by turn::varchar) filter (role = 'user'), '') q, coalesce(string_agg(distinct turn::varchar, ' ' order by turn::varchar) filter (role = 'assistant'), '') p,
 (conv_id + 1)::varchar n from conversations group by conv_id""",
)


def _stream(s, d):
    from .. import streaming

    index = scratch(s, "stream-index")
    streaming.ingest(s, d, "doc_id bigint, text string, lang string, source string, n_chars bigint", index, "documents.parquet")
    return streaming.open_index(s, index).postings


register("streamed_postings", _stream, f"with {X.SQL_DOCS} select term, doc_id, tf from p")


def _windows(s, d):
    from ..streaming import running_counts

    return running_counts(X.table(s, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n")


register("running_counts", _windows, "select (floor(epoch(ts) / 3600) * 3600)::bigint as start, event_type, count(*) n from events group by all")
register("all_pairs_small", lambda s, d: X.table(s, d, "nation").select("n_nationkey").crossJoin(small(X.table(s, d, "region").select("r_regionkey"))), "select n_nationkey, r_regionkey from nation, region")
