"""Subword tokenizers and pooling of token vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_LENGTH = 512


def max_length(wanted: int | None, limit: int | None = None) -> int:
    """The wanted length, by default DEFAULT_MAX_LENGTH, but no more than the model's limit."""
    n = wanted if wanted is not None else DEFAULT_MAX_LENGTH
    return min(n, limit) if limit is not None else n


def subwords(df: DataFrame, ident: str, text, file: str, maxlen: int | None = None, limit: int | None = None, separator: str | None = None) -> DataFrame:
    """``id, ids, n``: token ids of a text by a tokenizer file, cut to ``max_length``; null text has none.

    ``text`` is a column or expression. With ``separator`` it is an array of texts, which are joined by it.
    """
    column = F.col(text) if isinstance(text, str) else text
    column = F.array_join(column, separator) if separator is not None else column
    most = max_length(maxlen, limit)

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(file)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [e.ids[:most] for e in t.encode_batch_fast([x or "" for x in part.column(1).to_pylist()], add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(np.array([len(x) for x in ids], np.int64))], names=["id", "ids", "n"])

    return df.select(F.col(ident).alias("id"), column.alias("text")).mapInArrow(run, f"id {df.schema[ident].dataType.simpleString()}, ids array<int>, n bigint")


def mean_pooled(tokens: DataFrame) -> DataFrame:
    """``id, vec``: the mean over all positions of ``(id, pos, vec)``, filling included."""
    cells = tokens.select("id", F.posexplode("vec").alias("i", "x")).groupBy("id", "i").agg(F.avg("x").alias("m"))
    return cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c")).select("id", F.transform("c", lambda x: x["m"]).alias("vec"))


def first_pooled(tokens: DataFrame) -> DataFrame:
    """``id, vec``: the vector at position 0."""
    return tokens.where("pos = 0").select("id", "vec")


def all_pooled(tokens: DataFrame) -> DataFrame:
    """``id, pos, vec``: the vectors of all positions that the mask keeps."""
    return tokens.where("mask").select("id", "pos", "vec")
