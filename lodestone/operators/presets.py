"""Presets of learned-sparse models: how texts are cut, aggregated, and whether queries are expanded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluate import splade


@dataclass(frozen=True)
class SparsePreset:
    how: str
    one_hot_query: bool = False
    document_length: int = 200
    query_length: int = 30


PRESETS = {"splade_v1": SparsePreset("sum"), "splade_v2_max": SparsePreset("max"), "splade_v2_doc": SparsePreset("max", one_hot_query=True)}


def token_logits(texts: DataFrame, ident: str, length: int) -> DataFrame:
    """The built-in encoder: logit 1 for each of the first ``length`` tokens at its own place; a model's logits go in the same columns."""
    toks = F.slice(T.tokens("text"), 1, length)
    return texts.select(F.col(ident).alias("doc_id"), F.posexplode(toks).alias("pos", "term")).withColumns({"logit": F.lit(1.0), "mask": F.lit(1)})


def represented(texts: DataFrame, ident: str, preset: SparsePreset, query: bool = False, encode=token_logits) -> DataFrame:
    """``ident, term, w`` under a preset; ``encode`` gives ``(doc_id, pos, term, logit, mask)``."""
    length = preset.query_length if query else preset.document_length
    logits = encode(texts, ident, length)
    weights = logits.select("doc_id", "term").distinct().withColumn("w", F.lit(1.0)) if query and preset.one_hot_query else splade(logits, preset.how)
    return weights.withColumnRenamed("doc_id", ident)
