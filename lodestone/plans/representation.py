"""Learned-sparse, dense and late-interaction retrieval; representation statistics; token-level functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import align as A
from ..operators import dense as D
from ..operators import evaluate as E
from ..operators import index as I
from ..operators import ranking as R
from ..schema import P
from . import fixtures as X

QUERIES, ORACLES = {}, {}


def register(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


_W = f"with {X.SQL_DOCS}, {X.SQL_TOPICS}, {X.SQL_W}"
_TOP = "select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from {t}) where rank <= {k}"
_DOT = "o as (select qid, doc_id, round(sum(qw.w * w.w), 6) score from qw join w using (term) group by all)"
register("sparse_dot_top10", lambda s, d: I.sparse_search(X.query_weights(s, d), X.weights(s, d), 10), f"{_W}, {_DOT} {_TOP.format(t='o', k=10)}")
register(
    "sparse_beta_pruned",
    lambda s, d: I.sparse_search(I.beta_pruned(X.query_weights(s, d), 0.5), X.weights(s, d), 10),
    f"""{_W}, b as (select *, row_number() over (partition by qid order by w desc, term) r, count(*) over (partition by qid) n from qw),
o as (select qid, doc_id, round(sum(b.w * w.w), 6) score from b join w using (term) where r <= ceil(n * 0.5) group by all) {_TOP.format(t='o', k=10)}""",
)
register("blockmax_exact", lambda s, d: X.block_index(s, d).search(X.query_weights(s, d), 10), f"{_W}, {_DOT} {_TOP.format(t='o', k=10)}")
register("blockmax_pruned", lambda s, d: X.block_index(s, d).search(X.query_weights(s, d), 10, alpha=0.6))
register("block_bounds", lambda s, d: X.block_index(s, d).bounds.withColumn("bound", F.round("bound", 6)), f"{_W} select term, doc_id // 64 block, round(max(w), 6) bound from w group by all")


def _logits(s, d):
    rows = X.vectors(s, d).select("doc_id", F.posexplode("vec").alias("i", "logit"))
    return rows.select("doc_id", F.floor(F.col("i") / 8).cast("int").alias("pos"), (F.col("i") % 8).alias("term"), "logit", F.lit(1).alias("mask"))


_LOGITS = "lo as (select vec_id doc_id, (i - 1) // 8 pos, ((i - 1) % 8)::int term, embedding[i]::double logit from embeddings, range(1, 65) t(i))"
register("splade_max", lambda s, d: E.splade(_logits(s, d), "max").withColumn("w", F.round("w", 6)), f"with {_LOGITS} select doc_id, term, round(ln(1 + max(greatest(logit, 0))), 6) w from lo group by all")
register("splade_sum", lambda s, d: E.splade(_logits(s, d), "sum").withColumn("w", F.round("w", 6)), f"with {_LOGITS} select doc_id, term, round(sum(ln(1 + greatest(logit, 0))), 6) w from lo group by all")
register("flops_reg", lambda s, d: E.flops(X.weights(s, d)), f"{_W}, m as (select sum(w) / (select count(distinct doc_id) from w) m from w group by term) select round(sum(m * m), 6) flops from m")


def _sparsity(s, d):
    q = X.query_weights(s, d).withColumnRenamed("qid", "doc_id")
    return E.representation_statistics(q, X.weights(s, d), 30_000)


register(
    "sparsity_stats",
    _sparsity,
    f"""{_W}, a as (select term, count(*) a from qw where w > 0 group by term), b as (select term, count(*) b from w where w > 0 group by term), j as (select coalesce(a, 0) a, coalesce(b, 0) b from a full join b using (term))
select round(sum(a * b) / 30000.0 / 30000.0, 6) qdflops, round(sum(a) / ((select count(distinct qid) from qw) * 30000.0), 6) sparsity_q, round(sum(b) / ((select count(distinct doc_id) from w) * 30000.0), 6) sparsity_d from j""",
)
register(
    "saturation",
    lambda s, d: E.saturation(X.weights(s, d)),
    f"""{_W}, r as (select count(*) / (select count(distinct doc_id) from w)::double rate, row_number() over (order by count(*) desc, term) i from w where w > 0 group by term)
select k::bigint top, round(quantile_disc(rate, 0.5), 6) rate from r, (values (1), (5), (10), (20)) t(k) where i <= k group by k""",
)


def _queries(s, d):
    return X.vectors(s, d).select(F.col("doc_id").alias("qid"), "vec")


_DENSE = f"with {X.SQL_VEC}, o as (select a.doc_id qid, b.doc_id, round(list_inner_product(a.vec, b.vec), 6) score from v a, v b)"
_COS = f"with {X.SQL_VEC}, o as (select a.doc_id qid, b.doc_id, round(list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))), 6) score from v a, v b)"
register("dense_flat_top10", lambda s, d: D.dense_search(_queries(s, d), X.vectors(s, d), 10), f"{_DENSE} {_TOP.format(t='o', k=10)}")
register("dense_cosine_top10", lambda s, d: D.dense_search(_queries(s, d), X.vectors(s, d), 10, cosine=True), f"{_COS} {_TOP.format(t='o', k=10)}")
register("l2_normalize", lambda s, d: X.vectors(s, d).select("doc_id", F.posexplode(V.normalised("vec")).alias("i", "x")).select("doc_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x")), f"with {X.SQL_VEC} select doc_id, (i - 1)::bigint i, round(vec[i] / sqrt(list_inner_product(vec, vec)), 6) x from v, range(1, 65) t(i)")


def _label_eval(s, d):
    q = X.vectors(s, d).select(F.col("doc_id").alias("qid"), F.col("label").alias("ql"))
    run = D.dense_search(_queries(s, d), X.vectors(s, d), 11).where("qid <> doc_id").select("qid", "doc_id", "score")
    hits = run.join(q, "qid").join(X.vectors(s, d).select("doc_id", "label"), "doc_id").where("ql = label").select("qid", "doc_id", F.lit(1).alias("rel"))
    judged = q.select("qid", F.lit(-1).cast("bigint").alias("doc_id"), F.lit(0).alias("rel"))
    return E.per_query(run, hits.union(judged), (P @ 10,))


register(
    "dense_eval_label",
    _label_eval,
    f"""{_DENSE}, r as ({_TOP.format(t='o', k=11)}), n as (select r.*, row_number() over (partition by qid order by score desc, doc_id) i from r where qid <> doc_id)
select a.doc_id qid, 'P@10' measure, round((select count(*) from n join v b on b.doc_id = n.doc_id where n.qid = a.doc_id and i <= 10 and b.label = a.label) / 10.0, 6)::double as value from v a""",
)


def _hash_vectors(df, ident):
    """Eight hashed-bag dimensions of a text's tokens: a deterministic built-in encoder."""
    rows = df.select(F.col(ident).alias("id"), F.explode(T.tokens("text")).alias("t"))
    slot = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 1), 16, 10).cast("int")
    counts = rows.groupBy("id").agg(*[F.count_if(slot % 8 == i).cast("double").alias(f"c{i}") for i in range(8)])
    return counts.select("id", F.array(*[f"c{i}" for i in range(8)]).alias("vec"))


def _full_rescorer(s, d):
    q = _hash_vectors(X.topics(s, d), "qid").withColumnRenamed("id", "qid")
    docs = _hash_vectors(X.documents(s, d), "doc_id").withColumnRenamed("id", "doc_id")
    n = X.table(s, d, "documents").count()
    return D.dense_search(q, docs, n, cosine=True)


def _sql_hash(name, ident, source):
    slots = ", ".join(f"count(*) filter (('0x' || substr(md5(t), 1, 1))::int % 8 = {i})::double" for i in range(8))
    return f"{name} as (select id, [{slots}] vec from (select {ident} id, unnest({X.TOK}) t from {source}) group by id)"


_SQL_HASHED = f"{_sql_hash('hq', 'item_id', 'benchmark')}, {_sql_hash('hd', 'doc_id', 'documents')}"
_HCOS = "round(list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))), 6)"
register("full_rescorer", _full_rescorer, f"with {_SQL_HASHED} select a.id qid, b.id doc_id, {_HCOS} score, row_number() over (partition by a.id order by {_HCOS} desc, b.id) rank from hq a, hd b")


def _two_stage_dense(s, d):
    q = _hash_vectors(X.topics(s, d), "qid").select(F.col("id").alias("qid"), F.col("vec").alias("qv"))
    v = _hash_vectors(X.documents(s, d), "doc_id").select(F.col("id").alias("doc_id"), F.col("vec").alias("dv"))
    run = X.bm25(s, d, 50).select("qid", "doc_id").join(q, "qid").join(v, "doc_id")
    return R.rerank(run, V.cosine("qv", "dv"), 10).select("qid", "doc_id", "score", "rank")


register("two_stage_dense", _two_stage_dense, f"with {X.sql_bm25(50)}, {_SQL_HASHED}, o as (select r.qid, r.doc_id, {_HCOS} score from run r join hq a on a.id = r.qid join hd b on b.id = r.doc_id) {_TOP.format(t='o', k=10)}")


def _tokens(s, d):
    return D.token_vectors(X.vectors(s, d), "doc_id", "vec", 8, 8)


def _maxsim(s, d):
    toks = D.token_arrays(_tokens(s, d))
    return D.max_sim_search(toks, toks, 10)


_MAXSIM = f"""with {X.SQL_VEC}, t as (select doc_id, i, vec[8 * i + 1:8 * i + 8] x from v, range(0, 8) r(i)),
m as (select a.doc_id qid, b.doc_id, a.i, max(list_inner_product(a.x, b.x)) m from t a, t b group by all), o as (select qid, doc_id, round(sum(m), 6) score from m group by all)"""
register("maxsim_top10", _maxsim, f"{_MAXSIM} {_TOP.format(t='o', k=10)}")


def _maxsim_pairs(s, d):
    toks = D.token_arrays(_tokens(s, d), maxlen=6)
    nxt = toks.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("toks").alias("ot"))
    return toks.join(nxt, "id").select("id", "other", F.round(D.max_sim(F.col("toks"), F.col("ot")), 6).alias("score"))


register(
    "maxsim_pairs",
    _maxsim_pairs,
    f"""with {X.SQL_VEC}, t as (select doc_id, i, vec[8 * i + 1:8 * i + 8] x from v, range(0, 6) r(i)),
m as (select a.doc_id id, b.doc_id other, a.i, max(list_inner_product(a.x, b.x)) m from t a join t b on b.doc_id = a.doc_id + 1 group by all) select id, other, round(sum(m), 6) score from m group by all""",
)


def _ivf(s, d):
    index, cents = D.ivf_index(X.vectors(s, d), 10)
    return D.ivf_search(_queries(s, d), index, cents, 10, 8)


def _late(s, d):
    index, cents = D.late_interaction_index(_tokens(s, d), 8)
    return D.late_interaction_search(_tokens(s, d), index, cents, 10, 2)


register("dense_ivf", _ivf)
register("dense_lsh", lambda s, d: D.lsh_search(_queries(s, d), X.vectors(s, d)))
register("late_interaction_ivf", _late)


def _pairs(s, d):
    """Each user turn with the next turn, as query and document tokens."""
    t = X.table(s, d, "conversations").select("conv_id", "turn", "role", T.tokens("text").alias("toks"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("toks").alias("dt"))
    return t.where("role = 'user'").select("conv_id", "turn", F.col("toks").alias("qt")).join(nxt, ["conv_id", "turn"])


_SQL_PAIRS = f"cp as (select a.conv_id, a.turn, {X.TOK.replace('text', 'a.text')} qt, {X.TOK.replace('text', 'b.text')} dt from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1 where a.role = 'user')"


def _truncation(s, d):
    q, t = T.truncate_pair("qt", "dt", 30, 60, 64)
    return _pairs(s, d).select("conv_id", "turn", F.array_join(q, " ").alias("query"), F.array_join(t, " ").alias("document"))


register(
    "pair_truncation",
    _truncation,
    f"""with {_SQL_PAIRS}, c as (select conv_id, turn, qt[1:30] q, dt[1:60] d from cp), k as (select *, greatest(0, least(len(d), 61 - len(q))) kd from c)
select conv_id, turn, array_to_string(q[1:least(len(q), 61 - kd)], ' ') as query, array_to_string(d[1:kd], ' ') as document from k""",
)
register("prompt_format", lambda s, d: _pairs(s, d).select("conv_id", "turn", T.prompt("qt", "dt", 10, 20).alias("prompt")), f"with {_SQL_PAIRS} select conv_id, turn, 'Query: ' || array_to_string(qt[1:10], ' ') || ' Document: ' || array_to_string(dt[1:20], ' ') || ' Relevant:' prompt from cp")
register("one_hot", lambda s, d: X.documents(s, d).select("doc_id", F.explode(T.one_hot(T.tokens("text"), 64)).alias("term")).withColumn("w", F.lit(1.0)), f"select doc_id, unnest(list_distinct(({X.TOK})[1:64])) term, 1.0::double w from documents")
register(
    "pad_mask",
    lambda s, d: X.topics(s, d).select("qid", F.array_join(T.pad(T.tokens("text"), 40, "[PAD]"), " ").alias("padded"), F.size(F.filter(T.length_mask(F.least(F.size(T.tokens("text")), F.lit(40)), 40), lambda m: m)).cast("bigint").alias("n")),
    f"select item_id qid, array_to_string(list_concat(({X.TOK})[1:40], list_transform(range(0, greatest(0, 40 - len({X.TOK}))), lambda i: '[PAD]')), ' ') padded, least(40, len({X.TOK}))::bigint n from benchmark",
)


def _matches(s, d):
    q = A.positioned(X.topics(s, d).join(X.bm25(s, d, 3).select("qid").distinct(), "qid"), "qid", T.tokens("text"))
    docs = A.positioned(X.documents(s, d).join(X.bm25(s, d, 3).select("doc_id").distinct(), "doc_id"), "doc_id", T.tokens("text"))
    return A.token_matches(q, docs, False).select("qid", "doc_id", F.col("q_pos").cast("bigint").alias("q_pos"), F.col("d_pos").cast("bigint").alias("d_pos"))


register(
    "token_matches",
    _matches,
    f"""with {X.sql_bm25(3)}, a as (select item_id qid, unnest({X.TOK}) t, generate_subscripts({X.TOK}, 1) - 1 i from benchmark where item_id in (select qid from run)),
b as (select doc_id, unnest({X.TOK}) t, generate_subscripts({X.TOK}, 1) - 1 j from documents where doc_id in (select doc_id from run))
select qid, doc_id, i::bigint q_pos, min(j)::bigint d_pos from a join b using (t) group by all""",
)


def _alignment(s, d):
    words = A.token_offsets(X.topics(s, d), "qid", "text")
    blocks = X.topics(s, d).select(F.col("qid").alias("id"), F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 6).cast("int"))).alias("n"))
    blocks = blocks.select("id", "n", (F.col("n") * 6).alias("start"), (F.col("n") * 6 + 6).alias("stop"))
    out = A.interval_alignment(words, blocks)
    return out.select("id", F.col("key").cast("bigint").alias("key"), F.col("n").cast("bigint").alias("n"))


_WRD = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"
register(
    "token_alignment",
    _alignment,
    rf"""with w as (select item_id id, {_WRD} ws, string_split_regex(text, '[\p{{L}}\p{{N}}_]+') gs from benchmark),
e as (select id, unnest(range(0, len(ws))) k, ws, gs from w),
o as (select id, k, list_sum(list_transform(gs[1:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:k], lambda x: length(x))), 0) at_ from e)
select id, k::bigint as key, (at_ // 6)::bigint n from o""",
)
register(
    "carry_forward",
    lambda s, d: A.carry_forward(X.table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("title")), "user_id", "event_id", "title"),
    "select user_id, event_id, last_value(case when event_type = 'view' then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) title from events",
)
