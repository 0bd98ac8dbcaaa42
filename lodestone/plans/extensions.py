"""Plug-ins, sample batches, pooling, model presets, validation settings and the remaining formats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import sources as S
from .. import streaming
from ..functions import text as T
from ..functions import tokenizers_ as K
from ..operators import align as A
from ..operators import batches as B
from ..operators import datasets as C
from ..operators import dense as D
from ..operators import evaluate as E
from ..operators import index as I
from ..operators import plugins as G
from ..operators import sampling as M
from ..operators.presets import PRESETS, represented
from ..schema import BM25
from ..storage import scratch
from . import fixtures as X
from .ranking import _SQL_HISTORY, _history
from .representation import _TOP, _queries, _tokens
from .samples import _TRIPLETS, _samples, _triplets

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


class Lengths:
    """A built-in encoder and pair scorer: counts of characters, spaces and two letters."""

    def encode(self, texts):
        return np.array([[len(t), t.count(" "), t.count("a"), t.count("e")] for t in texts], np.float64).reshape(-1, 4)

    def score(self, queries, documents):
        return np.array([(q.count("a") + 1) / (d.count("a") + 1) for q, d in zip(queries, documents, strict=True)])


def _count(c, x):
    return f"(length({c}) - length(replace({c}, '{x}', '')))"


register(
    "plugged_encoder",
    lambda s, d: G.encoded(X.documents(s, d), "doc_id", "text", Lengths()).select("id", *[F.col("vec")[i].cast("bigint").alias(f"c{i}") for i in range(4)]),
    f"select doc_id id, length(text)::bigint c0, {_count('text', ' ')}::bigint c1, {_count('text', 'a')}::bigint c2, {_count('text', 'e')}::bigint c3 from documents",
)


def _plugged(s, d):
    first = G.retriever(lambda docs: X.index(s, d), X.documents(s, d), BM25(), 30)
    return G.scored_retriever(X.documents(s, d), first, Lengths(), 5)(X.topics(s, d))


register(
    "plugged_pair_scorer",
    _plugged,
    f"with {X.sql_bm25(30)}, o as (select qid, doc_id, round(({_count('b.text', 'a')} + 1)::double / ({_count('e.text', 'a')} + 1), 6) score from run join documents e using (doc_id) join benchmark b on b.item_id = qid) {_TOP.format(t='o', k=5)}",
)
register(
    "run_retrievers",
    lambda s, d: G.RunRetrievers().add_run("all", X.bm25(s, d, 20).drop("rank"))("other", "all", 3)(X.topics(s, d)),
    f"with {X.sql_bm25(3)} select qid, doc_id, score, rank from run",
)


def _catalogue(s, d):
    made = G.Catalogue().add(f"half {d}", lambda spark: X.documents(spark, d).where("doc_id % 2 = 0"))
    return made.prepare(s, f"half {d}").select("doc_id", F.length("text").cast("bigint").alias("n"))


register("prepared_collection", _catalogue, "select doc_id, length(text)::bigint n from documents where doc_id % 2 = 0")
register(
    "processor_chain",
    lambda s, d: G.processed(X.documents(s, d), [lambda df: df.where("doc_id > 10"), lambda df: None, lambda df: df.select("doc_id", F.reverse(F.substring("text", 1, 20)).alias("head"))]),
    "select doc_id, reverse(substr(text, 1, 20)) head from documents where doc_id > 10",
)


def _doubled(table):
    import pyarrow.compute as pc

    return table.set_column(1, "n", pc.multiply(table["n"], 2))


register("buffered_batches", lambda s, d: G.buffered(X.table(s, d, "documents").select("doc_id", F.col("n_chars").alias("n")), _doubled, "doc_id bigint, n bigint", 64), "select doc_id, n_chars * 2 n from documents")


def _members(s, d):
    run = X.bm25(s, d, 10).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
    lengths = lambda ids: ids.join(X.table(s, d, "documents").select("doc_id", F.col("n_chars").alias("value")), "doc_id")
    return G.process_members(run, "qid", "docs", "doc_id", lengths).select("qid", F.array_join(F.col("values").cast("array<string>"), " ").alias("sizes"))


register("processed_members", _members, f"with {X.sql_bm25(10)} select qid, string_agg(n_chars::varchar, ' ' order by rank) sizes from run join documents using (doc_id) group by qid")

# sample batches: one triplet for each topic, numbered in the order of topics
_NUMBERED = f"{_TRIPLETS}, tn as (select qid, pos_id, neg_id, row_number() over (order by qid, ordinal) - 1 ordinal from tr where ordinal < 2)"


def _numbered(s, d):
    rows = _triplets(s, d).where("ordinal < 2").select("qid", "pos_id", "neg_id", (F.col("qid") * 2 + F.col("ordinal")).alias("doc_id"))
    return C.numbered(rows).withColumnRenamed("doc_ix", "ordinal").drop("doc_id")


_text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
_COLLATED = "cb as (select ordinal // 16 batch, list(qid order by ordinal) topics, list(pos_id order by ordinal) positives, list(neg_id order by ordinal) negatives from tn group by 1)"
_sql_text = lambda c: f"array_to_string({c}, ' ') {c}"
register("sample_shard", lambda s, d: B.shard(_numbered(s, d), 1, 3), f"with {_NUMBERED} select * from tn where ordinal % 3 = 1")
register("sample_epochs", lambda s, d: B.repeated(_numbered(s, d), 3).select("ordinal", "qid", F.col("epoch").cast("bigint").alias("epoch")), f"with {_NUMBERED} select ordinal + e * (select count(*) from tn) ordinal, qid, e epoch from tn, range(3) t(e)")
register("collated_pairs", lambda s, d: B.collate_pairs(_numbered(s, d), 16).select("batch", _text("topics"), _text("positives"), _text("negatives")), f"with {_NUMBERED}, {_COLLATED} select batch, {_sql_text('topics')}, {_sql_text('positives')}, {_sql_text('negatives')} from cb")
register("batch_pair_indexes", lambda s, d: B.batch_pairs(B.collate_pairs(_numbered(s, d), 16)).select(*[F.col(c).cast("bigint").alias(c) for c in ("batch", "place", "topic_index", "document_index")]), f"with {_NUMBERED}, {_COLLATED}, x as (select batch, len(topics) n, unnest(range(2 * len(topics))) place from cb) select batch, place, place % n topic_index, place document_index from x")
register(
    "batch_unique_members",
    lambda s, d: B.unique_members(B.collate_pairs(_numbered(s, d), 16)).select("batch", _text("unique_topics"), _text("unique_documents")),
    f"with {_NUMBERED}, {_COLLATED} select batch, array_to_string(list_sort(list_distinct(topics)), ' ') unique_topics, array_to_string(list_sort(list_distinct(list_concat(positives, negatives))), ' ') unique_documents from cb",
)


def _teacher(s, d):
    scores = _samples(s, d).select("qid", "doc_id", F.col("score"))
    return B.collate_teacher_pairs(M.teacher_triplets(_numbered(s, d), scores), 16).select("batch", F.array_join(F.flatten(F.transform("teacher", lambda r: F.transform(r, lambda x: F.round(x * 1000000).cast("bigint").cast("string")))), " ").alias("teacher"))


register(
    "collated_teacher_pairs",
    _teacher,
    f"with {_NUMBERED}, ts as (select ordinal, a.score p, b.score n from tn join s a on a.qid = tn.qid and a.doc_id = pos_id join s b on b.qid = tn.qid and b.doc_id = neg_id) select ordinal // 16 batch, string_agg(round(p * 1000000)::bigint::varchar || ' ' || round(n * 1000000)::bigint::varchar, ' ' order by ordinal) teacher from ts group by 1",
)


def _lists(s, d):
    docs = F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["score"].alias("score")))
    lists = X.bm25(s, d, 5).groupBy("qid").agg(docs.alias("docs"))
    out = B.collate_lists(lists.withColumn("ordinal", F.col("qid")), 8)
    return out.select("batch", _text("topics"), _text("documents"), F.array_join(F.transform(F.flatten("teacher"), lambda x: F.round(x * 1000000).cast("bigint").cast("string")), " ").alias("teacher"))


register(
    "collated_lists",
    _lists,
    f"with {X.sql_bm25(5)} select qid // 8 batch, string_agg(qid::varchar, ' ' order by qid, rank) topics, string_agg(doc_id::varchar, ' ' order by qid, rank) documents, string_agg(round(score * 1000000)::bigint::varchar, ' ' order by qid, rank) teacher from run group by 1",
)
register(
    "samples_with_members",
    lambda s, d: B.with_members(_numbered(s, d), "pos_id", F.concat(F.lit("D"), F.col("pos_id").cast("string"))).select("ordinal", "pos_id"),
    f"with {_NUMBERED} select ordinal, 'D' || pos_id pos_id from tn",
)

# pooling
_SQL_TOK = f"{X.SQL_VEC}, t as (select doc_id, i, vec[8 * i + 1:8 * i + 8] x from v, range(0, 8) r(i))"
_cells = lambda df: df.select("id", F.posexplode("vec").alias("i", "x")).select("id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))
register("pooled_mean", lambda s, d: _cells(K.mean_pooled(_tokens(s, d))), f"with {_SQL_TOK} select doc_id id, j i, round(avg(x[j + 1]), 6) x from t, range(8) u(j) group by all")
register("pooled_first", lambda s, d: _cells(K.first_pooled(_tokens(s, d))), f"with {_SQL_TOK} select doc_id id, j i, round(x[j + 1], 6) x from t, range(8) u(j) where t.i = 0")
register("pooled_all", lambda s, d: K.all_pooled(_tokens(s, d)).select("id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("vec")[0].cast("double"), 6).alias("x")), f"with {_SQL_TOK} select doc_id id, i pos, round(x[1], 6) x from t")


def _lexicon_ids(s, d):
    terms = I.lexicon(I.postings(X.documents(s, d))).select(F.col("term").alias("doc_id"))
    return C.numbered(terms).select(F.col("doc_id").alias("tok"), F.col("doc_ix").alias("id"))


register("lexicon_ids", _lexicon_ids, f"with {X.SQL_DOCS} select term tok, row_number() over (order by term) - 1 id from lx")
register("max_lengths", lambda s, d: X.topics(s, d).select("qid", F.lit(K.max_length(None)).alias("plain"), F.lit(K.max_length(None, 300)).alias("limited"), F.lit(K.max_length(200, 300)).alias("wanted")), "select item_id qid, 512 plain, 300 limited, 200 wanted from benchmark")

# learned-sparse presets over the built-in encoder: every token has logit 1
for _name, _p in PRESETS.items():
    _how = "max(1.0)" if _p.how == "max" else "count(*)::double"
    _doc = f"dw as (select doc_id, term, {_how} * ln(2) w from (select doc_id, unnest(({X.TOK})[1:{_p.document_length}]) term from documents) group by all)"
    _qry = f"qz as (select item_id qid, term, {'1.0' if _p.one_hot_query else _how + ' * ln(2)'} w from (select item_id, unnest(({X.TOK})[1:{_p.query_length}]) term from benchmark) group by all)"
    register(
        f"preset_{_name}",
        lambda s, d, p=_p: I.sparse_search(represented(X.topics(s, d), "qid", p, query=True), represented(X.documents(s, d), "doc_id", p), 10),
        f"with {_doc}, {_qry}, o as (select qid, doc_id, round(sum(qz.w * dw.w), 6) score from qz join dw using (term) group by all) {_TOP.format(t='o', k=10)}",
    )

# validation settings and side files
_SETTINGS = E.Validation("dev", 2, 2)
_SQL_BEST = f"with {_SQL_HISTORY}, r as (select *, row_number() over (partition by run, measure order by value desc, epoch) i from h where epoch % 2 = 0 and epoch >= 2)"


def _best(s, d):
    path = scratch(s, "best")
    S.write_side_file(E.best_epochs(_history(s, d), _SETTINGS), path)
    return S.read_side_file(s, path, "tag string, run string, measure string, epoch bigint, value double")


register("validation_best", _best, f"{_SQL_BEST} select 'dev' tag, run, measure, epoch, value from r where i = 1")
register("ramp", lambda s, d: s.range(0, 50).select("id", F.round(E.quadratic_ramp(F.col("id"), 20, 0.0, 3.0), 6).alias("w")), "select i id, round(case when i >= 20 then 3.0 else 3.0 * pow(i / 20.0, 2) end, 6)::double w from range(50) t(i)")

# formats and views
_path = lambda write, read, name: lambda s, d: (lambda p: (write(s, d, p), read(s, p))[1])(scratch(s, name))
register(
    "hard_negatives_round_trip",
    _path(lambda s, d, p: S.write_hard_negatives(M.hard_negatives(X.bm25(s, d, 50).drop("rank"), X.qrels(s, d)), p), lambda s, p: S.read_hard_negatives(s, p).select(F.col("queries")[0].alias("qid"), F.array_join("pos_ids", " ").alias("p"), F.array_join(F.col("neg_ids")["default"], " ").alias("n")), "hard"),
    f"with {X.sql_bm25(50)}, {X.SQL_QRELS}, lab as (select r.qid, doc_id, rank, coalesce(rel, 0)::int rel from run r left join qrels using (qid, doc_id) where r.qid in (select qid from qrels)) select qid::varchar qid, string_agg(doc_id::varchar, ' ' order by rank) filter (rel > 0) p, string_agg(doc_id::varchar, ' ' order by rank) filter (rel <= 0) n from lab group by qid having count(*) filter (rel > 0) > 0 and count(*) filter (rel <= 0) > 0",
)
register(
    "scored_pairs_round_trip",
    _path(lambda s, d, p: S.write_sv(M.teacher_triplets(_numbered(s, d), _samples(s, d).select("qid", "doc_id", "score")).select("qid", "pos_id", "pos_score", "neg_id", "neg_score"), p), S.read_scored_pairs, "scored"),
    f"with {_NUMBERED} select tn.qid::varchar qid, pos_id::varchar pos_id, a.score pos_score, neg_id::varchar neg_id, b.score neg_score from tn join s a on a.qid = tn.qid and a.doc_id = pos_id join s b on b.qid = tn.qid and b.doc_id = neg_id",
)
register("id_list_round_trip", _path(lambda s, d, p: S.write_sv(X.topics(s, d).select("qid"), p), S.read_id_list, "ids"), "select item_id::varchar id from benchmark")
register("range_scan", lambda s, d: C.range_scan(C.numbered(X.documents(s, d)), 49, 150).select("doc_id", "doc_ix"), "select * from (select doc_id, row_number() over (order by doc_id) - 1 doc_ix from documents) where doc_ix > 49 and doc_ix < 150")
register("doc_subset_slice", lambda s, d: X.R.document_subset(X.documents(s, d), X.table(s, d, "labels").select("doc_id", F.col("doc_id").alias("ord")), 20, 90).select("doc_id", "ord"), "select doc_id, doc_id ord from documents join labels using (doc_id) where doc_id >= 20 and doc_id < 90")
register("batches_full", lambda s, d: X.R.full_batches(C.numbered(X.documents(s, d)).select("doc_id", "doc_ix"), "doc_ix", 64).groupBy("batch").agg(F.count("*").alias("n")), "select i // 64 batch, count(*) n from (select row_number() over (order by doc_id) - 1 i from documents) group by 1 having count(*) = 64")
register("prefixed_slices", lambda s, d: X.topics(s, d).select("qid", T.prefixed("text", "query: ").alias("p"), F.array_join(T.optional_slice(T.tokens("text"), 2, 5), " ").alias("mid"), F.size(T.optional_slice(T.tokens("text"), 3, None)).cast("bigint").alias("rest")), f"select item_id qid, 'query: ' || text p, array_to_string(({X.TOK})[3:5], ' ') mid, greatest(0, len({X.TOK}) - 3)::bigint rest from benchmark")
register("resumed_epoch", lambda s, d: M.resume(M.epoch_order(_numbered(s, d), "ordinal", 3, 1), "ordinal", 9).select("ordinal", "qid"), f"with {_NUMBERED} select ordinal, qid from tn where ordinal > 9")
register("all_token_matches", lambda s, d: A.token_matches(A.positioned(X.topics(s, d), "qid", T.tokens("text")), A.positioned(X.table(s, d, "pages").select("page_id", "url"), "page_id", T.tokens("url"))).select("qid", "doc_id", F.col("q_pos").cast("bigint").alias("q_pos"), F.col("d_pos").cast("bigint").alias("d_pos")), f"with a as (select item_id qid, unnest({X.TOK}) t, generate_subscripts({X.TOK}, 1) - 1 i from benchmark), b as (select page_id doc_id, unnest({X.TOK.replace('text', 'url')}) t, generate_subscripts({X.TOK.replace('text', 'url')}, 1) - 1 j from pages) select qid, doc_id, i::bigint q_pos, j::bigint d_pos from a join b using (t)")
register("except_documents", lambda s, d: X.documents(s, d).select("doc_id").exceptAll(X.table(s, d, "labels").select("doc_id")), "select doc_id from documents where doc_id not in (select doc_id from labels)")
register("pointwise_picks", lambda s, d: M.pointwise(_samples(s, d), 500, 0.5, 11).join(_samples(s, d).select("qid", "doc_id"), ["qid", "doc_id"], "left_semi").agg(F.count("*").alias("n")), "select 500::bigint n")


def _vector_stream(s, d):
    """The vectors come as files; all lists are probed, so the result is the exact one."""
    folder, index = scratch(s, "vector-files"), scratch(s, "vector-index")
    X.vectors(s, d).select("doc_id", F.col("vec").cast("array<double>").alias("vec")).repartition(2).write.parquet(folder)
    cents = [r["vec"] for r in X.vectors(s, d).orderBy("doc_id").limit(8).collect()]
    streaming.ingest_vectors(s, folder, "doc_id bigint, vec array<double>", cents, index)
    return D.ivf_search(_queries(s, d).where("qid % 50 = 0"), streaming.open_vectors(s, index), cents, 10, 8)


register("streamed_vectors", _vector_stream, f"with {X.SQL_VEC}, o as (select a.doc_id qid, b.doc_id, round(list_inner_product(a.vec, b.vec), 6) score from v a, v b where a.doc_id % 50 = 0) {_TOP.format(t='o', k=10)}")
