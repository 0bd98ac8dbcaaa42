"""Schemas of the engine's tables, checks, and small value classes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame

TOPICS = ("qid", "text")
DOCUMENTS = ("doc_id", "text")
QRELS = ("qid", "doc_id", "rel")
RUN = ("qid", "doc_id", "score")
#: Rows up to which a topic-sized table is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def require_columns(df: DataFrame, names) -> DataFrame:
    """``df`` itself; ValueError names the columns that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


@dataclass(frozen=True)
class Adhoc:
    """A test collection: documents, topics and judgements."""

    documents: DataFrame
    topics: DataFrame
    qrels: DataFrame


@dataclass(frozen=True)
class BM25:
    k1: float = 0.9
    b: float = 0.4


@dataclass(frozen=True)
class QLDirichlet:
    mu: float = 1000.0


@dataclass(frozen=True)
class Measure:
    """A measure with its least relevant grade and cutoff; ``measure @ k`` sets the cutoff."""

    name: str
    rel: int = 1
    cutoff: int | None = None

    def __matmul__(self, k: int) -> Measure:
        return Measure(self.name, self.rel, k)

    def __call__(self, rel: int) -> Measure:
        return Measure(self.name, rel, self.cutoff)

    @property
    def label(self) -> str:
        grade = f"(rel={self.rel})" if self.rel != 1 else ""
        return f"{self.name}{grade}" + (f"@{self.cutoff}" if self.cutoff else "")


AP, P, R, RR, nDCG, Success = (Measure(n) for n in ("AP", "P", "R", "RR", "nDCG", "Success"))
DEFAULT_MEASURES = (AP, P @ 20, nDCG, nDCG @ 20, RR)


@dataclass
class Analyzer:
    """Text analysis of an index: word pattern, possessives, stop words, stemming. Part of the index's identity."""

    stop_words: tuple[str, ...] = ()
    stem: str | None = None
    unicode: bool = False
    possessive: bool = False


def identity(params: dict) -> str:
    """Directory name of an artefact: a hash of the parameters that define its contents."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:24]
