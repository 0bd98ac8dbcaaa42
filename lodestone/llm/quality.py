"""Operator 3, quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_spans, lean, text_batches, word_spans

WORD_BITS = 15
STRUCTURE_BINS = 16
#: Share-like statistics of a text, each cut into STRUCTURE_BINS one-hot bins.
STATISTICS = ("letters", "upper", "digits", "marks", "spaces", "new_lines", "word_length", "distinct_words", "most_frequent_word", "adjacent_repeats", "letterless_words", "marked_words")
#: Metadata: the logarithm of the length, and how the stated length compares with the text's.
METADATA = ("log_length", "stated_length")
N_FEATURES = (1 << WORD_BITS) + STRUCTURE_BINS * (len(STATISTICS) + len(METADATA))
THRESHOLD = 0.7
#: Bytes of texts whose features are computed together.
RUN_BYTES = 1 << 19

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
_CODES = np.arange(256)
_LETTER = ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_MARK = (_CODES >= 33) & (_CODES < 128) & ~_LETTER & ~_DIGIT
_PLAIN_MARK = np.isin(_CODES, [33, 39, 44, 45, 46, 58, 59, 63])
_ODD_MARK = _MARK & ~_PLAIN_MARK
_FOLD = np.where(_UPPER, _CODES + 32, _CODES).astype(np.uint8).tobytes()


def features(texts: list, stated: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text, sorted feature numbers and values.

    Words (lower-cased, between white space) are hashed to 2**WORD_BITS; their values are counts, scaled to
    length 1. Statistics and metadata are one-hot bins with value 0.5.
    """
    idx, val = [], []
    base = 1 << WORD_BITS
    for first, run in text_batches(texts, RUN_BYTES):
        joined = b" ".join(run) + b" "  # every text is followed by one space
        raw = np.frombuffer(joined, np.uint8)
        _, starts, ends = word_spans(joined, _SEPARATORS)
        low = np.frombuffer(joined.translate(_FOLD), np.uint8)
        hashes = hash_spans(low, starts, ends)
        begin = np.cumsum([0] + [len(b) + 1 for b in run])
        sums = {k: np.add.reduceat(m[raw], begin[:-1], dtype=np.int64) for k, m in (("letters", _LETTER), ("upper", _UPPER), ("digits", _DIGIT), ("marks", _ODD_MARK), ("spaces", _SEPARATORS), ("new_lines", _CODES == 10))}
        sums["spaces"] -= 1
        lettered, marked = (np.logical_or.reduceat(m[raw], starts) if len(starts) else np.empty(0, bool) for m in (_LETTER, _ODD_MARK))
        cut = np.searchsorted(starts, begin)
        for k, b in enumerate(run):
            n, a, z = len(b), cut[k], cut[k + 1]
            h, words = hashes[a:z], z - a
            one = max(n, 1)
            per = {name: s[k] / one for name, s in sums.items()}
            number, count = np.unique(h, return_counts=True)
            w = max(words, 1)
            stats = [
                per["letters"], per["upper"] / max(per["letters"], 1e-9), per["digits"] * 4, per["marks"] * 4, per["spaces"], per["new_lines"] * 8,
                (ends[a:z] - starts[a:z]).sum() / w / 16, len(number) / w, (count.max() if words else 0) / w * 2,
                (h[1:] == h[:-1]).sum() / w, 1 - lettered[a:z].sum() / w, marked[a:z].sum() / w,
            ]
            said = stated[first + k]
            meta = [np.log2(n + 1) / 24, 1.0 if said is None else min(1.0, (said + 1) / (n + 1) / 2)]
            bins = np.minimum((np.clip(np.array(stats + meta, float), 0, 1) * STRUCTURE_BINS).astype(np.int64), STRUCTURE_BINS - 1)
            slots, where = np.unique((number & np.uint64(base - 1)).astype(np.int64), return_inverse=True)
            tf = np.bincount(where, weights=count, minlength=len(slots)) if len(slots) else np.empty(0)
            tf = tf / np.sqrt((tf * tf).sum()) if len(slots) else tf
            idx.append(np.r_[slots, base + np.arange(len(bins)) * STRUCTURE_BINS + bins].astype(np.int32))
            val.append(np.r_[tf, np.full(len(bins), 0.5)].astype(np.float32))
    return idx, val


@dataclass
class FactorisationMachine:
    """``bias + <w, x> + sum over pairs of <V_i, V_j> x_i x_j``, through the logistic function."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, idx: list[np.ndarray], val: list[np.ndarray]) -> np.ndarray:
        """Linear time in the non-zeros: half of (sum of V x) squared less the sum of (V x) squared, per factor."""
        if not idx:
            return np.empty(0)
        flat, x = np.concatenate(idx), np.concatenate(val).astype(np.float64)
        at = np.cumsum([0] + [len(i) for i in idx[:-1]])
        vx = self.v[flat] * x[:, None]
        s = np.add.reduceat(vx, at)
        return self.bias + np.add.reduceat(self.w[flat] * x, at) + 0.5 * (s * s - np.add.reduceat(vx * vx, at)).sum(axis=1)

    def scores(self, idx, val) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(idx, val), -30, 30)))


def fit(idx: list[np.ndarray], val: list[np.ndarray], y: np.ndarray, factors: int = 6, epochs: int = 6, rate: float = 0.05, decay: float = 1e-5, seed: int = 5) -> FactorisationMachine:
    """Adagrad on the logistic loss; the same rows in the same order give the same model. No rows: score 0.5."""
    rng = np.random.default_rng(seed)
    fm = FactorisationMachine(0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, factors)))
    gb, gw, gv = 1.0, np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, factors), 1e-2)
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 64):
            rows = order[k : k + 64]
            flat, x = np.concatenate([idx[i] for i in rows]), np.concatenate([val[i] for i in rows]).astype(np.float64)
            size = np.array([len(idx[i]) for i in rows])
            at = np.cumsum(size) - size
            vx = fm.v[flat] * x[:, None]
            s = np.add.reduceat(vx, at)
            margin = fm.bias + np.add.reduceat(fm.w[flat] * x, at) + 0.5 * (s * s - np.add.reduceat(vx * vx, at)).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]
            e = np.repeat(error, size)
            seen, where = np.unique(flat, return_inverse=True)
            dw = np.bincount(where, weights=e * x, minlength=len(seen)) / len(rows) + decay * fm.w[seen]
            each = (e * x)[:, None] * (np.repeat(s, size, axis=0) - vx)
            dv = np.stack([np.bincount(where, weights=each[:, f], minlength=len(seen)) for f in range(factors)], axis=1) / len(rows) + decay * fm.v[seen]
            gb += error.mean() ** 2
            gw[seen] += dw * dw
            gv[seen] += dv * dv
            fm.bias -= rate * error.mean() / gb**0.5
            fm.w[seen] -= rate * dw / np.sqrt(gw[seen])
            fm.v[seen] -= rate * dv / np.sqrt(gv[seen])
    return fm


def held_out():
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)


def _featuriser(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("idx", pa.list_(pa.int32())), ("val", pa.list_(pa.float32()))])
    for b in batches:
        idx, val = features(b.column(1).to_pylist(), b.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], schema=schema)


def _stated(docs: DataFrame):
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("bigint").alias("n_chars")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> FactorisationMachine:
    """Fits on at most ``max_rows`` labelled rows outside the held-out fold, drawn by a hash of doc_id.

    Labels other than 0 and 1 and null ids are left out; of several labels of one id the smallest counts;
    of several texts of one id the smallest. The sample is bounded, so it may be broadcast and collected.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", _stated(docs)).join(F.broadcast(sample), "doc_id")
    # one row per id, so that the fit is bounded however often an id occurs
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars", "quality")).alias("m")).select("doc_id", "m.text", "m.n_chars", "m.quality")
    got = rows.mapInArrow(lean(_featuriser), "doc_id bigint, quality int, idx array<int>, val array<float>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy())
    idx, val, y = [x.values.to_numpy(zero_copy_only=False) for x in got["idx"]], [x.values.to_numpy(zero_copy_only=False) for x in got["val"]], got["quality"].to_numpy()
    return fit([idx[i] for i in order], [val[i] for i in order], y[order].astype(float))


def _scorer(model):
    def run(batches):
        fm = model.value
        for b in batches:
            got = np.empty(b.num_rows)
            for i in range(0, b.num_rows, 256):
                got[i : i + 256] = fm.scores(*features(b.column(1).slice(i, 256).to_pylist(), b.column(2).slice(i, 256).to_pylist()))
            extra = [b.column(k) for k in range(3, b.num_columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *extra, pa.array(got)], names=[*b.schema.names, "score"])

    return run


def score_documents(docs: DataFrame, model: FactorisationMachine, keep_text: bool = False) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text; null counts as empty, repeated rows all stay.

    With ``keep_text`` the documents' own columns come along (a clashing ``score`` is replaced).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # N_FEATURES * (factors + 1) doubles, a fixed size
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars", "score", "predicted", "held_out")] if keep_text else []
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", _stated(docs), *extra)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    if not keep_text:
        out = rows.mapInArrow(lean(_scores_only(_scorer(shared))), "doc_id bigint, score double")
    else:
        out = rows.mapInArrow(lean(_scorer(shared)), f"{schema}, score double")
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _scores_only(scorer):
    def run(batches):
        for b in scorer(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.num_columns - 1)], names=["doc_id", "score"])

    return run


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
