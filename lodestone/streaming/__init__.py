"""Incremental ingestion of documents into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import BowIndex, doc_lengths, postings
from ..schema import Analyzer


def _stream(spark: SparkSession, source: str, schema: str, names: str) -> DataFrame:
    """The files called ``names`` under ``source``; where folders directly in it are called so (tables of part files), their files."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{source}/{names}")
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    stream = spark.readStream.schema(schema)
    if any(x.isDirectory() for x in found or ()):
        return stream.parquet(f"{source}/{{{names}}}")  # a pattern: a single file is then no base path
    return stream.option("pathGlobFilter", names).parquet(source)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def ingest(spark: SparkSession, source: str, schema: str, index: str, names: str = "*.parquet", analyzer: Analyzer | None = None) -> None:
    """Appends postings and lengths of all files called ``names`` and not seen yet under ``source``; stops when there are none.

    Each micro-batch writes into a folder named by its number and overwrites it when retried, and offsets
    live in the index's checkpoint, so an interrupted build resumes without doubling documents. A table may be one
    file or a folder of part files; without any the index is empty.
    """

    def append(batch: DataFrame, number: int) -> None:
        postings(batch, analyzer).write.mode("overwrite").parquet(f"{index}/postings/batch={number}")
        doc_lengths(batch, analyzer).write.mode("overwrite").parquet(f"{index}/lengths/batch={number}")

    stream = _stream(spark, source, schema, names)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{index}/_checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, f"{index}/postings"):
        append(spark.createDataFrame([], schema), -1)


def open_index(spark: SparkSession, index: str, analyzer: Analyzer | None = None) -> BowIndex:
    """The index over all batches ingested so far."""
    read = lambda part: spark.read.parquet(f"{index}/{part}").drop("batch")
    return BowIndex(read("postings"), read("lengths"), analyzer or Analyzer())


def running_counts(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events per type in tumbling windows; on a stream, rows later than ``late`` are let go."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    win = F.window("ts", f"{minutes} minutes")
    return rows.groupBy(win, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def ingest_vectors(spark: SparkSession, source: str, schema: str, centroids: list, index: str, names: str = "*.parquet") -> None:
    """Appends the vectors ``(doc_id, vec)`` of files not seen yet to an index with fixed centroids: each goes to its nearest list."""
    cents = spark.createDataFrame(list(enumerate(centroids)), "list int, center array<double>")

    def append(batch: DataFrame, number: int) -> None:
        nearest(batch, cents).write.mode("overwrite").partitionBy("list").parquet(f"{index}/vectors/batch={number}")

    stream = _stream(spark, source, schema, names)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{index}/_checkpoint").trigger(availableNow=True).start().awaitTermination()


def nearest(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """``vectors`` with ``list``, the nearest of the broadcast centroids; of equally near ones the least."""
    dist = lambda c: F.aggregate(F.zip_with("vec", c["center"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    table = F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct("list", "center"))).alias("_cents")))  # one row
    rows = vectors.crossJoin(table)
    best = F.array_min(F.transform("_cents", lambda c: F.struct(dist(c).alias("d"), c["list"].alias("list"))))
    return rows.withColumn("list", best["list"]).drop("_cents")


def open_vectors(spark: SparkSession, index: str) -> DataFrame:
    return spark.read.parquet(f"{index}/vectors").drop("batch")
