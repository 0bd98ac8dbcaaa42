"""The provided tables in their roles: documents, topics, judgements, vectors, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking as R  # noqa: F401
from ..operators.index import BlockIndex, BowIndex, postings, small
from ..schema import BM25
from ..storage import stored


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def topics(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def qrels(spark, d) -> DataFrame:
    """Wide synthetic judgements: a seventeenth of all (topic, document) pairs, grades 0 to 2; the two meet on a class of 17."""
    docs = documents(spark, d).select("doc_id", F.pmod(F.col("doc_id") * 7, F.lit(17)).alias("_c"))
    tops = topics(spark, d).select("qid", F.pmod(-F.col("qid") * 13, F.lit(17)).alias("_c"))
    return docs.join(small(tops), "_c").select("qid", "doc_id", ((F.col("doc_id") + F.col("qid")) % 3).cast("int").alias("rel"))


def index(spark, d) -> BowIndex:
    """The stored index of the documents, built once in a session."""
    return BowIndex.load(spark, stored(spark, "bow-index", d, BowIndex.build(documents(spark, d)).save))


def bm25(spark, d, k=100) -> DataFrame:
    return index(spark, d).search(topics(spark, d), BM25(), k)


def weights(spark, d) -> DataFrame:
    """Learned-sparse stand-in: log1p of term frequency per document, from the stored postings."""
    return index(spark, d).postings.select("doc_id", "term", F.log1p(F.col("tf").cast("double")).alias("w"))


def block_index(spark, d) -> BlockIndex:
    return BlockIndex.load(spark, stored(spark, "block-index", d, BlockIndex.build(weights(spark, d)).save))


def query_weights(spark, d) -> DataFrame:
    rows = postings(topics(spark, d).withColumnRenamed("qid", "doc_id"))
    return rows.select(F.col("doc_id").alias("qid"), "term", F.log1p(F.col("tf").cast("double")).alias("w"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")


#: The same roles as SQL, to be put behind ``with``.
TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
SQL_DOCS = f"""dl as (select doc_id, len({TOK})::bigint dl from documents), pt as (select doc_id, unnest({TOK}) term from documents),
p as (select term, doc_id, count(*) tf from pt group by all), lx as (select term, count(*) df, sum(tf)::bigint cf from p group by term),
st as (select count(*) n, avg(dl) avgdl, sum(dl) total from dl)"""
SQL_TOPICS = f"""tt as (select item_id qid, unnest({TOK}) term from benchmark), q as (select qid, term, count(*) qtf from tt group by all)"""


def sql_bm25(k: int, k1: float = 0.9, b: float = 0.4, name: str = "run") -> str:
    return f"""{SQL_DOCS}, {SQL_TOPICS},
{name}_s as (select q.qid, p.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) score
  from q join lx using (term) join p using (term) join dl using (doc_id), st group by all),
{name} as (select * from (select qid, doc_id, score, row_number() over (partition by qid order by score desc, doc_id) rank from {name}_s) where rank <= {k})"""


SQL_QRELS = "qrels as (select item_id qid, doc_id, ((doc_id + item_id) % 3)::int rel from documents, benchmark where (doc_id * 7 + item_id * 13) % 17 = 0)"
SQL_W = "w as (select doc_id, term, ln(1 + tf::double) w from p), qw as (select qid, term, ln(1 + qtf::double) w from q)"
SQL_VEC = "v as (select vec_id doc_id, list_transform(embedding, lambda x: x::double) vec, label from embeddings)"


def unit(*parts: str) -> str:
    """SQL for the hashed number in [0, 1) of the parts."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::bigint::double / 4294967296.0)"
