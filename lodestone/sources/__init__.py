"""Readers and writers of ranking data: TSV, TREC, JSON lines, id lists, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JSONL_PAIRWISE = "queries array<string>, pos_ids array<string>, neg_ids map<string, array<string>>"


def read_sv(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """Lines cut at ``sep``, without quoting or escapes; missing fields are null."""
    parts = F.split(F.regexp_replace("value", "[\r\n]+$", ""), "\\Q" + sep + "\\E", -1)
    return spark.read.text(path).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def write_sv(df: DataFrame, path: str, sep: str = "\t") -> None:
    """One line per row, fields joined by ``sep``; null is an empty field."""
    df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.text(path)


def write_topics(topics: DataFrame, path: str) -> None:
    """``qid <tab> text``; tabs and line ends in texts become spaces."""
    write_sv(topics.select("qid", F.regexp_replace("text", "[\t\r\n]", " ").alias("text")), path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return read_sv(spark, path, ["qid", "text"])


def write_qrels(qrels: DataFrame, path: str) -> None:
    """TREC judgements: ``qid 0 doc_id rel``."""
    qrels.select(F.format_string("%s 0 %s %d", F.col("qid").cast("string"), F.col("doc_id").cast("string"), "rel").alias("value")).write.text(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("qid"), p[2].alias("doc_id"), p[3].cast("int").alias("rel"))


def write_run(run: DataFrame, path: str, tag: str = "lodestone") -> None:
    """TREC run: ``qid Q0 doc_id rank score tag``, sorted within files."""
    rows = run.repartitionByRange("qid").sortWithinPartitions("qid", "rank")
    rows.select(F.format_string("%s Q0 %s %d %.6f " + tag, F.col("qid").cast("string"), F.col("doc_id").cast("string"), "rank", F.col("score").cast("double")).alias("value")).write.text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(p[0].alias("qid"), p[2].alias("doc_id"), p[3].cast("bigint").alias("rank"), p[4].cast("double").alias("score"))


def metric_lines(detail: DataFrame) -> DataFrame:
    """``value``: measure in 25 columns, scope in 10, value with 4 digits."""
    return detail.select(F.format_string("%-25s %-10s %.4f", "measure", F.col("scope").cast("string"), "value").alias("value"))


def read_jsonl_pairwise(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JSONL_PAIRWISE).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def read_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    """``qid <tab> positives: <tab> ids <tab> negatives: <tab> ids``, as the pairwise schema with algorithm ``default``."""
    ids = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    rows = read_sv(spark, path, ["qid", "_p", "pos", "_n", "neg"])
    return rows.select(F.array("qid").alias("queries"), ids(F.col("pos")).alias("pos_ids"), F.create_map(F.lit("default"), ids(F.col("neg"))).alias("neg_ids"))


def write_hard_negatives(mined: DataFrame, path: str) -> None:
    write_sv(mined.select("qid", F.lit("positives:").alias("p"), F.array_join(F.col("positives").cast("array<string>"), " ").alias("pos"), F.lit("negatives:").alias("n"), F.array_join(F.col("negatives").cast("array<string>"), " ").alias("neg")), path)


def read_scored_pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = read_sv(spark, path, ["qid", "pos_id", "pos_score", "neg_id", "neg_score"])
    return rows.withColumns({c: F.col(c).cast("double") for c in ("pos_score", "neg_score")})


def read_distillation_lists(spark: SparkSession, path: str, top_k: int | None = None) -> DataFrame:
    """``qid, docs``: the teacher's lists of a TREC file, best first, at most ``top_k``."""
    rows = read_run(spark, path).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))).alias("d"))
    docs = F.transform("d", lambda x: F.struct(x["doc_id"].alias("doc_id"), (-x["s"]).alias("score")))
    return rows.select("qid", (F.slice(docs, 1, top_k) if top_k else docs).alias("docs"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; blank lines are no ids."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def write_contents(documents: DataFrame, path: str) -> None:
    """``{"id", "contents"}`` lines, as external indexers read them."""
    write_jsonl(documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contents")), path)


def read_topic_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached samples whose topic stands in its first row only: file, line, title, doc_id, score, rel."""
    from ..operators.align import carry_forward

    rows = spark.read.schema("line bigint, title string, doc_id string, score double, rel int").option("sep", "\t").csv(path).withColumn("file", F.input_file_name())
    return carry_forward(rows, "file", "line", "title")


def write_side_file(df: DataFrame, path: str) -> None:
    """A small table, such as best metrics or an index's parameters, as one JSON-lines file."""
    write_jsonl(df.coalesce(1), path)


def read_side_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def markdown(table: DataFrame, limit: int = 1000) -> str:
    """A result table as markdown, built on the driver; a table with more than ``limit`` rows is an error."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write the table with write_csv instead")
    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def write_csv(table: DataFrame, path: str) -> None:
    table.coalesce(1).write.option("header", True).csv(path)  # result tables: a row per model
