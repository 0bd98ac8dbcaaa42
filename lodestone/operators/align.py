"""Token matching and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positioned(df: DataFrame, ident: str, toks) -> DataFrame:
    """``id, pos, tok``."""
    return df.select(F.col(ident).alias("id"), F.posexplode(toks).alias("pos", "tok"))


def token_matches(query_tokens: DataFrame, document_tokens: DataFrame, all_matches: bool = True) -> DataFrame:
    """``qid, doc_id, q_pos, d_pos``: equal tokens; without ``all_matches`` the first document position alone."""
    q = query_tokens.select(F.col("id").alias("qid"), F.col("pos").alias("q_pos"), "tok")
    d = document_tokens.select(F.col("id").alias("doc_id"), F.col("pos").alias("d_pos"), "tok")
    rows = q.join(d, "tok").select("qid", "doc_id", "q_pos", "d_pos")
    return rows if all_matches else rows.groupBy("qid", "doc_id", "q_pos").agg(F.min("d_pos").alias("d_pos"))


def token_offsets(texts: DataFrame, ident: str = "id", text: str = "text") -> DataFrame:
    """``id, n, tok, start, stop`` of Unicode words; places follow from the lengths of words and gaps."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    gaps = F.split(F.col(text), r"[\p{L}\p{N}_]+", -1)
    rows = texts.select(F.col(ident).alias("id"), F.posexplode(F.arrays_zip(words.alias("w"), F.slice(gaps, F.lit(1), F.size(words)).alias("g"))).alias("n", "x"))
    rows = rows.select("id", "n", F.col("x.w").alias("tok"), F.length("x.w").alias("lw"), F.length("x.g").alias("lg"))
    upto = F.sum(F.col("lw") + F.col("lg")).over(Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("id", "n", "tok", (upto - F.col("lw")).alias("start"), upto.alias("stop"))


def interval_alignment(keys: DataFrame, tokens: DataFrame, width: int = 64) -> DataFrame:
    """``id, key, n``: the token whose [start, stop) holds each key's start.

    Both sides meet on buckets of ``width`` characters; a token is dealt to all buckets it covers.
    """
    k = keys.select("id", F.col("n").alias("key"), F.col("start").alias("at")).withColumn("_b", F.floor(F.col("at") / width))
    t = tokens.select("id", "n", "start", "stop").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    return k.join(t, ["id", "_b"]).where("start <= at and at < stop").select("id", "key", "n")


def unaligned(keys: DataFrame, aligned: DataFrame) -> DataFrame:
    """Keys that no token holds; an aligner that needs all raises if there is any."""
    return keys.join(aligned.select("id", F.col("key").alias("n")), ["id", "n"], "left_anti")


def carry_forward(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Fills nulls of ``value`` with the last one before, within ``by`` (for example one file)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
