"""The corpus pipeline: classifier, near-duplicate removal, decontamination, source mixing, token ids.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame that is
written as Parquet and read again for the next; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, scratch_dir
from lodestone.llm.decontaminate import match_benchmark
from lodestone.llm.jaccard_join import similar_documents
from lodestone.llm.mixing import mix_sources, realise
from lodestone.llm.quality import score_documents, train
from lodestone.llm.tokens_out import digest_tokens, read_tokens, tokenizer_file, write_tokens

#: Ids that a membership table may have to be broadcast (about 40 MB of the driver's heap).
BROADCAST_IDS = 1_000_000


#: Tells rows apart inside a stage.
ROW = "_pipeline_row"


def _rows(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a number of its own for each row in ROW, and whether that is the doc_id itself.

    Where an id is null or occurs twice, the rows are written out with numbers, so that copies under one id
    are decided one by one.
    """
    docs = docs.drop(ROW)
    same = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if same.isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("bigint")), True
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows"), False


def _without(rows: DataFrame, gone: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``rows`` but for those whose numbers are in ``gone``; the numbers are broadcast only up to a counted bound."""
    gone = materialise(gone.distinct(), name)
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ROW, "left_anti").select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold."""
    columns = docs.columns
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = {c: f"_pipeline_{c}" for c in columns if c in ("score", "predicted", "held_out")}  # not to be overwritten
    scored = score_documents(docs.withColumnsRenamed(own), model, keep_text=True).where("predicted = 1")
    return scored.select(*[F.col(own.get(c, c)).alias(c) for c in columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id (null ids last), of each group of near-duplicates."""
    rows, plain = _rows(docs)
    groups = similar_documents(rows.select(F.col(ROW).alias("doc_id"), "text"))
    if plain:
        gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(ROW))
    else:
        groups = materialise(groups.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW), "pipeline-groups")
        first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", ROW)).alias("m"))
        gone = groups.join(first, "component_id").where(F.col(ROW) != F.col(f"m.{ROW}")).select(ROW)
    return _without(rows, gone, docs.columns, "dropped-near")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate; every row is judged by its own text."""
    rows, _ = _rows(docs)
    hits = match_benchmark(rows.select(F.col(ROW).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, hits.where("contaminated").select(F.col("doc_id").alias(ROW)), docs.columns, "dropped-benchmark")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of smaller sources up to twice, by temperature mixing."""
    return realise(mix_sources(docs)).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all copies, written as Parquet lists and read back as one row per document copy."""
    path = scratch_dir(spark, "pipeline-tokens")
    write_tokens(docs, path, tokenizer_file())
    return digest_tokens(read_tokens(spark, path))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("token ids", token_stage),
]

#: The classifier and the tokenizer cannot be stated in SQL; the whole is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = materialise(stage(spark, out, sf_dir), "pipeline")
    return out
