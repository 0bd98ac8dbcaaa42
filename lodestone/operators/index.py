"""Inverted indexes as tables: bag of words, learned sparse, block maxima; and search over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schema import BM25, BROADCAST_ROWS, Analyzer, QLDirichlet
from ..storage import materialise
from .ranking import ranked


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``limit`` rows; counting stops there."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def analysed(text, analyzer: Analyzer | None = None) -> Column:
    """Token array of a text under an analyzer."""
    analyzer = analyzer or Analyzer()
    if analyzer.possessive:
        text = T.without_possessive(text)
    toks = T.word_tokens(F.lower(text if isinstance(text, Column) else F.col(text))) if analyzer.unicode else T.tokens(text)
    if analyzer.stop_words:
        toks = T.without_stop_words(toks, analyzer.stop_words)
    return T.stemmed(toks, analyzer.stem) if analyzer.stem else toks


def postings(documents: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """``term, doc_id, tf``."""
    return documents.select("doc_id", F.explode(analysed("text", analyzer)).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def doc_lengths(documents: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """``doc_id, dl``: tokens per document; no shuffle."""
    return documents.select("doc_id", F.size(analysed("text", analyzer)).cast("bigint").alias("dl"))


def lexicon(post: DataFrame) -> DataFrame:
    """``term, df, cf``."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def posted(tokens: DataFrame) -> DataFrame:
    """``term, doc_id, dl, tf`` from ``(doc_id, dl, toks)``: postings that carry their document's length."""
    return tokens.select("doc_id", "dl", F.explode("toks").alias("term")).groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


@dataclass(frozen=True)
class BowIndex:
    """Bag-of-words index: postings, document lengths and, once it is stored, lexicon and collection statistics.

    An index that is built but not saved answers from ``tokens``: only the topics' terms are aggregated then.
    """

    postings: DataFrame
    lengths: DataFrame
    analyzer: Analyzer
    tokens: DataFrame | None = None
    terms: DataFrame | None = None
    totals: DataFrame | None = None

    @classmethod
    def build(cls, documents: DataFrame, analyzer: Analyzer | None = None, max_docs: int | None = None) -> BowIndex:
        """Over all documents, or the ``max_docs`` with the smallest ids."""
        if max_docs is not None:
            documents = documents.orderBy("doc_id").limit(max_docs)
        tokens = documents.select("doc_id", analysed("text", analyzer).alias("toks")).select("doc_id", F.size("toks").cast("bigint").alias("dl"), "toks")
        return cls(posted(tokens), tokens.select("doc_id", "dl"), analyzer or Analyzer(), tokens)

    def save(self, path: str) -> None:
        """Postings clustered by term, so that a term's list lies in few files with narrow statistics.

        The lexicon is counted from the written postings, and the statistics from the written lengths.
        """
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")
        lexicon(spark.read.parquet(f"{path}/postings")).write.parquet(f"{path}/lexicon")
        collection_statistics(spark.read.parquet(f"{path}/lengths")).write.parquet(f"{path}/statistics")

    @classmethod
    def load(cls, spark: SparkSession, path: str, analyzer: Analyzer | None = None) -> BowIndex:
        read = lambda part: spark.read.parquet(f"{path}/{part}")
        return cls(read("postings"), read("lengths"), analyzer or Analyzer(), None, read("lexicon"), read("statistics"))

    def statistics(self) -> DataFrame:
        """One row: documents, total tokens, mean length."""
        return self.totals if self.totals is not None else collection_statistics(self.lengths)

    def _hits(self, wanted: DataFrame) -> DataFrame:
        """The wanted terms' postings with document lengths."""
        if self.tokens is not None:
            rows = self.tokens.select("doc_id", "dl", F.explode("toks").alias("term")).join(wanted, "term", "left_semi")
            return rows.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
        rows = self.postings.join(wanted, "term", "left_semi")
        return rows if "dl" in rows.columns else rows.join(self.lengths, "doc_id")

    def search(self, topics: DataFrame, model: BM25 | QLDirichlet | None = None, k: int | None = 10) -> DataFrame:
        """Top-k run of all topics ``(qid, text)`` at once; topics whose terms the index lacks give no rows."""
        model = model or BM25()
        terms = topics.select("qid", F.explode(analysed("text", self.analyzer)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
        wanted = terms.select("term").distinct()
        few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        hint = F.broadcast if few else (lambda df: df)
        hits = self._hits(hint(wanted))
        lex = self.terms.join(hint(wanted), "term", "left_semi") if self.terms is not None else lexicon(hits)
        s = F.broadcast(self.statistics())  # one row
        rows = hits.join(hint(terms.join(lex, "term")), "term").crossJoin(s)
        if isinstance(model, BM25):
            idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
            w = F.col("qtf") * idf * F.col("tf") / (F.col("tf") + model.k1 * (1 - model.b + model.b * F.col("dl") / F.col("avgdl")))
        elif isinstance(model, QLDirichlet):
            w = F.col("qtf") * F.greatest(F.lit(0.0), F.log(1 + F.col("tf") / (model.mu * F.col("cf") / F.col("total"))) + F.log(model.mu / (F.col("dl") + model.mu)))
        else:
            raise ValueError(f"no scoring for {model}")
        return ranked(rows.groupBy("qid", "doc_id").agg(F.sum(w).alias("score")), k)

    def search_text(self, text: str, model: BM25 | QLDirichlet | None = None, k: int | None = 10) -> DataFrame:
        """Top-k of one topic given as a plain string: ``doc_id, score, rank``."""
        topic = self.lengths.sparkSession.createDataFrame([(0, text)], "qid int, text string")
        return self.search(topic, model, k).drop("qid")


def collection_statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.sum("dl").alias("total"), F.avg("dl").alias("avgdl"))


def sparse_search(query_weights: DataFrame, weights: DataFrame, k: int | None = 10) -> DataFrame:
    """Exact inner product of ``(qid, term, w)`` with ``(doc_id, term, w)``, ranked."""
    q = query_weights.select("qid", "term", F.col("w").alias("qw"))
    return ranked(small(q).join(weights, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score")), k)


def beta_pruned(query_weights: DataFrame, beta: float) -> DataFrame:
    """The ``ceil(beta * n)`` heaviest of each query's n terms; beta 1 keeps all."""
    w = Window.partitionBy("qid")
    order = w.orderBy(F.desc("w"), "term")
    return query_weights.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(w)).where(F.col("_r") <= F.ceil(F.col("_n") * beta)).drop("_r", "_n")


def block_bounds(weights: DataFrame, block: int) -> DataFrame:
    """``term, block, bound``: the largest weight of a term in each block of document ids."""
    return weights.groupBy("term", F.floor(F.col("doc_id") / block).alias("block")).agg(F.max("w").alias("bound"))


@dataclass(frozen=True)
class BlockIndex:
    """Impact postings by block of document ids, ``term, block, doc_id, w``, with the bounds of each block beside them."""

    weights: DataFrame
    bounds: DataFrame
    block: int

    @classmethod
    def build(cls, weights: DataFrame, block: int = 64, max_postings: int | None = None) -> BlockIndex:
        """From ``(doc_id, term, w)``; ``max_postings`` keeps the heaviest of each term."""
        if max_postings is not None:
            heaviest = Window.partitionBy("term").orderBy(F.desc("w"), "doc_id")
            weights = weights.withColumn("_r", F.row_number().over(heaviest)).where(F.col("_r") <= max_postings).drop("_r")
        rows = weights.select("term", F.floor(F.col("doc_id") / block).alias("block"), "doc_id", "w")
        return cls(rows, block_bounds(weights, block), block)

    def save(self, path: str) -> None:
        """Written once, sorted by term and block; the bounds are taken from what was written."""
        spark = self.weights.sparkSession
        self.weights.repartitionByRange("term").sortWithinPartitions("term", "block", "doc_id").write.parquet(f"{path}/weights")
        block_bounds(spark.read.parquet(f"{path}/weights"), self.block).write.parquet(f"{path}/bounds")

    @classmethod
    def load(cls, spark: SparkSession, path: str, block: int = 64) -> BlockIndex:
        return cls(spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/bounds"), block)

    def compressed(self, levels: int = 256) -> BlockIndex:
        """Weights and bounds as whole numbers below ``levels``, rounded up on a scale up to the largest weight."""
        top = F.broadcast(self.bounds.agg(F.max("bound").alias("_top")))  # one row
        scale = lambda df, c: df.crossJoin(top).withColumn(c, F.ceil(F.col(c) * (levels - 1) / F.col("_top")).cast("double")).drop("_top")
        return BlockIndex(scale(self.weights, "w"), scale(self.bounds, "bound"), self.block)

    def search(self, query_weights: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
        """Block-max pruning: score the best blocks first, then only blocks whose bound reaches the k-th score.

        ``alpha`` scales the bounds; 1 is exact, less prunes more. Scores are sums of non-negative products.
        """
        q = small(query_weights.select("qid", "term", F.col("w").alias("qw")))
        bounds = q.join(self.bounds, "term").groupBy("qid", "block").agg(F.sum(F.col("qw") * F.col("bound")).alias("ub"))
        bounds = materialise(bounds, "block-bounds")
        first = bounds.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ub"), "block"))).where(F.col("_r") <= max(1, -(-2 * k // self.block)))
        rows = self.weights.join(q, "term")

        def scored(blocks):
            return ranked(rows.join(small(blocks.select("qid", "block")), ["qid", "block"], "left_semi").groupBy("qid", "doc_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score")), k)

        threshold = materialise(scored(first).where(F.col("rank") == k).select("qid", F.col("score").alias("theta")), "block-thresholds")
        keep = bounds.join(threshold, "qid", "left").where(F.col("theta").isNull() | (F.col("ub") * alpha >= F.col("theta") - 1e-6))
        return scored(keep)


def block_max_search(query_weights: DataFrame, weights: DataFrame, k: int, block: int = 64, alpha: float = 1.0) -> DataFrame:
    """``BlockIndex.search`` over weights that are not stored."""
    return BlockIndex.build(weights, block).search(query_weights, k, alpha)
