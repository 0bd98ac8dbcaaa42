"""Operator 7, benchmark decontamination: a positional inverted index in shards, stored, then asked for test windows.

``build_index`` writes a row for each shard of documents: its documents, and for every term its postings, the
ascending positions of the term in the shard. ``search_index`` reads the shards back where they lie. A window of
a test item starts from the postings of its rarest term in the shard; the list of the next rarest, adjusted by
offset, is intersected with what is left, and so on. Nothing but hits is ever moved between tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_spans, lean, scratch_dir, word_spans

WINDOW = 13
#: Test items that are searched for in one pass over the index.
BLOCK_ITEMS = 20_000
#: Distinct test terms up to which an index is kept to these; with more it holds all terms.
MAX_TERMS = 4_000_000
#: Bytes of texts in one shard, and test items whose terms are hashed at once.
SHARD_BYTES = 2_000_000
#: Candidate positions checked at once.
CANDIDATES = 1 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Byte map: A-Z to a-z, all other ASCII but digits and letters to a space; bytes over 0x7F stay.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or c in _KEEP else 32) for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[32] = True
#: Writer settings of an index: version 2 pages delta-code the ascending positions.
PARQUET = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(16 << 20), "compression": "zstd"}
INDEX = "shard bigint, doc_ids array<bigint>, n_words array<int>, terms array<bigint>, counts array<int>, positions array<int>"


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def term_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of the texts behind each other, and how many words each text has."""
    joined = b" ".join(texts).translate(FOLD)
    raw, starts, ends = word_spans(joined, _SPACE)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hash_spans(raw, starts, ends).view(np.int64), np.diff(np.searchsorted(starts, begin))


def _lists(values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _indexer(terms):
    """Index rows of a task's documents; with ``terms`` (sorted hashes) only these are indexed."""
    schema = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))])

    def run(batches):
        from pyspark import TaskContext

        number, known = TaskContext.get().partitionId() << 32, terms.value if terms is not None else None
        for b in batches:
            stops = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(stops, (stops[i - 1] if i else 0) + SHARD_BYTES, side="right")))
                h, n = term_numbers([x or b"" for x in b.column(1).slice(i, j - i).cast(pa.binary()).to_pylist()])
                begin = np.cumsum(n + 1) - (n + 1)  # a gap between documents that no term fills
                at = np.arange(len(h)) + np.repeat(begin - (np.cumsum(n) - n), n)
                if known is not None:
                    place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                    hit = known[place] == h if len(known) else np.zeros(len(h), bool)
                    h, at = h[hit], at[hit]
                order = np.argsort(h, kind="stable")
                found, counts = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([number]), _lists(b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False) if not b.column(0).null_count else b.column(0).slice(i, j - i), pa.int64()), _lists(n, pa.int32()), _lists(found, pa.int64()), _lists(counts, pa.int32()), _lists(at[order], pa.int32())], schema=schema)
                number += 1
                i = j

    return run


def build_index(docs: DataFrame, path: str, terms: np.ndarray | None = None) -> None:
    """Writes the index of ``docs(doc_id, text)`` as Parquet, a row per shard of about SHARD_BYTES of texts.

    A longer text is a shard alone. Null and empty texts are documents without words; repeated rows and null
    ids are documents of their own; further columns are ignored; an empty table gives an index without rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(terms) if terms is not None else None
    docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lean(_indexer(shared)), INDEX).write.options(**PARQUET).parquet(path)


class TestWindows:
    """The windows of one block of test items as rows of term numbers into the sorted hashes ``terms``."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        h, n = term_numbers([(t or "").encode("utf-8", "surrogatepass") for _, t in items])
        self.terms, numbers = np.unique(h, return_inverse=True)
        found: dict[tuple[int, ...], set[str]] = {}
        for (item, _), a, k in zip(items, (np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
            ids, size = numbers[a : a + k].tolist(), min(window, k)
            for i in range(k - size + 1 if size else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.length = np.array([len(x) for x in found], np.int64)
        self.windows = np.full((len(found), window), -1, np.int64)
        for k, x in enumerate(found):
            self.windows[k, : len(x)] = x


class Shard:
    """One row of the index: postings by term number of a block of test windows."""

    def __init__(self, test: TestWindows, n_words: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        self.test, self.begin = test, np.cumsum(n_words + 1) - (n_words + 1)
        self.size = int((n_words + 1).sum()) + 1
        first = np.cumsum(counts) - counts
        place = np.minimum(np.searchsorted(terms, test.terms), max(len(terms) - 1, 0))
        here = terms[place] == test.terms if len(terms) else np.zeros(len(test.terms), bool)
        self.first, self.count = np.where(here, first[place] if len(terms) else 0, 0), np.where(here, counts[place] if len(terms) else 0, 0)
        self.positions = positions
        # all postings in one ascending array: the list's number, then the position
        self.keys = np.repeat(np.arange(len(terms)), counts) * self.size + positions
        self.list = place

    def phrases(self):
        """Yields (window number, start, end) arrays of all exact occurrences."""
        test = self.test
        if not len(test.windows) or not len(self.positions):
            return
        freq = np.append(self.count, 1 << 60)  # padding counts as most frequent
        per = freq[test.windows]
        live = np.flatnonzero(per.min(axis=1) > 0)
        ranks = np.argsort(per[live], axis=1, kind="stable")
        sizes = per[live, ranks[:, 0]] if len(live) else np.empty(0, np.int64)
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(CANDIDATES, sizes.sum() + CANDIDATES, CANDIDATES))
        for a, b in zip([0, *(cuts + 1)], cuts + 1, strict=False):
            part, rank, size = live[a:b], ranks[a:b], sizes[a:b]
            if not len(part):
                continue
            which = np.repeat(np.arange(len(part)), size)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
            rare = rank[:, 0]
            start = self.positions[self.first[test.windows[part, rare]][which] + inside] - rare[which]
            which, start = which[start >= 0], start[start >= 0]
            for j in range(1, test.windows.shape[1]):
                if not len(which):
                    break
                off = rank[which, j]
                pad = off >= test.length[part][which]
                key = self.list[test.windows[part[which], off]] * self.size + start + off
                good = pad | (self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key)
                which, start = which[good], start[good]
            if len(which):
                yield part[which], start, start + test.length[part[which]]

    def near(self, slop: int):
        """Yields (window number, start, end): all the window's terms in order in one document, with at most ``slop`` other words between."""
        test = self.test
        for k, row in enumerate(test.windows):
            terms = row[: test.length[k]]
            if not (self.count[terms] > 0).all():
                continue
            lists = [self.positions[self.first[t] : self.first[t] + self.count[t]] for t in terms]
            ends = starts = lists[0]
            for x in lists[1:]:
                nxt = np.searchsorted(x, ends, side="right")
                ok = nxt < len(x)
                starts, ends = starts[ok], x[nxt[ok]]
                keep = (ends - starts < len(terms) + slop) & (self.document(starts) == self.document(ends))
                starts, ends = starts[keep], ends[keep]
            if len(starts):
                yield np.full(len(starts), k), starts, ends + 1

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, side="right") - 1


_HITS = pa.schema([("shard", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("items", pa.list_(pa.string()))])
HITS = "shard bigint, place int, doc_id bigint, n_words bigint, spans array<struct<s: bigint, e: bigint>>, items array<string>"


def _searcher(block, slop: int | None, whole: bool):
    """A row per document of each shard, or only per document with hits; ``spans`` are disjoint ranges of words."""

    def run(batches):
        test = block.value
        for b in batches:
            for r in range(b.num_rows):
                number, docs, n, terms, counts, positions = (b.column(c)[r] for c in range(6))
                docs = docs.values
                n, terms, counts, positions = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in (n, terms, counts, positions))
                shard = Shard(test, n, terms, counts, positions)
                cover = np.zeros(shard.size + 1, np.int32)
                found: dict[int, set[str]] = {}
                for k, start, end in shard.phrases() if slop is None else shard.near(slop):
                    np.add.at(cover, start, 1)
                    np.add.at(cover, end, -1)
                    for d, w in set(zip(shard.document(start).tolist(), k.tolist(), strict=True)):
                        found.setdefault(d, set()).update(test.items[w])
                edge = np.diff(np.r_[0, (np.cumsum(cover) > 0).astype(np.int8), 0])
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                kept = np.arange(len(n)) if whole else np.array(sorted(found), np.int64)
                of = shard.document(starts)
                a, z = np.searchsorted(of, kept), np.searchsorted(of, kept, side="right")
                spans = [[{"s": int(x), "e": int(y)} for x, y in zip(starts[i:j] - shard.begin[d], ends[i:j] - shard.begin[d], strict=True)] for d, i, j in zip(kept.tolist(), a.tolist(), z.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), number.as_py(), np.int64)), pa.array(kept.astype(np.int32)), docs.take(pa.array(kept)), pa.array(n[kept]), pa.array(spans, _HITS.field("spans").type), pa.array([sorted(found.get(d, ())) for d in kept.tolist()], pa.list_(pa.string()))], schema=_HITS)

    return run


def search_index(spark: SparkSession, path: str, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Per indexed document ``doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated``; see ``match_benchmark``.

    The test items are sent out in blocks of BLOCK_ITEMS; each block passes over the stored index for itself,
    and documents hit in several blocks are put together from their spans.
    """
    test = benchmark.select(F.col("item_id").cast("string"), "text").where("item_id is not null")
    parts, index, out = max(1, -(-test.count() // BLOCK_ITEMS)), spark.read.schema(INDEX).parquet(path), None
    for k in range(parts):
        rows = test.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else test
        block = spark.sparkContext.broadcast(TestWindows([tuple(r) for r in rows.orderBy("item_id").collect()], window))
        part = index.mapInArrow(lean(_searcher(block, slop, k == 0)), HITS)
        out = part if out is None else out.union(part)
    if parts > 1:
        out = out.groupBy("shard", "place").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans in order: each counts from where those before it end
    union = "aggregate(spans, named_struct('n', 0L, 'upto', 0L), (a, x) -> named_struct('n', a.n + greatest(0L, x.e - greatest(x.s, a.upto)), 'upto', greatest(a.upto, x.e)), a -> a.n)"
    out = out.select("doc_id", "n_words", F.expr(union).alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "items")
    return out.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _term_table(batches):
    for b in batches:
        h, _ = term_numbers([x or b"" for x in b.column(0).cast(pa.binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(h))], names=["term"])


def test_terms(benchmark: DataFrame) -> np.ndarray | None:
    """Sorted hashes of all terms of the test items, or None where there are more than MAX_TERMS."""
    terms = benchmark.where("item_id is not null").select("text").mapInArrow(lean(_term_table), "term bigint").distinct().limit(MAX_TERMS + 1).toArrow()
    return None if terms.num_rows > MAX_TERMS else np.sort(terms["term"].to_numpy())


test_terms.__test__ = False


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """Per document: words, words inside occurrences of test windows, the items found, and whether it is contaminated.

    The documents' index, kept to the terms of the test items, is written to the shared folder, then searched
    (see ``search_index``). ``slop`` asks for proximity instead of exact phrases: the words of a window in order,
    in one document, with at most so many others between; all words of such a match count as hit. Null and
    empty texts have no words and no hits; items without words find nothing; equal items are all reported;
    repeated rows answer each for itself; an empty test set contaminates nothing; further columns are ignored.
    """
    path = scratch_dir(docs.sparkSession, "positional-index")
    build_index(docs, path, test_terms(benchmark))
    return search_index(docs.sparkSession, path, benchmark, window, slop)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    out = match_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_ORACLE = r"""
with w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) ws from documents),
i as (select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[]) ws from benchmark),
iw as (select item_id, least(13, len(ws)) n, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda s: array_to_string(ws[s:s + least(13, len(ws)) - 1], ' '))) g from i where len(ws) > 0),
lens as (select distinct n from iw),
dw as (select doc_id, n, unnest(range(1, len(ws) - n + 2)) s, unnest(list_transform(range(1, len(ws) - n + 2), lambda s: array_to_string(ws[s:s + n - 1], ' '))) g from w, lens where len(ws) >= n),
m as (select doc_id, s, n, item_id from dw join iw using (n, g)),
h as (select doc_id, count(distinct p)::bigint n_hit from (select doc_id, unnest(range(s, s + n)) p from m) group by doc_id),
t as (select doc_id, count(distinct item_id)::bigint n_items, sha256(string_agg(distinct item_id::varchar, ',' order by item_id::varchar)) sh from m group by doc_id)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(sh, sha256('')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from w left join h using (doc_id) left join t using (doc_id)"""

QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES = {"op7_decontamination": _ORACLE}
