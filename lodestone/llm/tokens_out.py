"""Operator 5, token-ID output: Parquet list columns with chosen encodings, row groups and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_spans, kept, lean, return_memory, scratch_dir

END_ID = 2
#: Distinct chunks that a worker keeps, about 40 bytes each; beyond it the less useful half goes.
CACHE = 800_000
#: New chunks encoded in one string; longer strings take more time a chunk.
TOGETHER = 100
#: Bytes of texts that are encoded together.
RUN_BYTES = 1 << 20
#: Writer settings: version 2 pages give delta encoding where a dictionary stops paying; page indexes are always written.
PARQUET = {"parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "2000", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "compression": "zstd"}


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ASCII = np.arange(256)
_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122) & (_ASCII < 128)
_PUNCTUATION = (_ASCII > 32) & (_ASCII < 127) & ~_LETTER & ~((_ASCII >= 48) & (_ASCII <= 57))
#: Sets the hashes of chunks apart that no space leads.
_BARE = np.uint64(0xC2B2AE3D27D4EB4F)


class _Chunks:
    """Known chunks by hash: where their ids lie in ``ids`` and how many; ``UNSAFE`` ones are not encoded alone."""

    UNSAFE = -1

    def __init__(self):
        self.hash, self.at, self.n, self.used = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.times = np.empty(0, np.uint8)  # how often asked for, 3 at the most
        self.ids, self.clock = np.empty(0, np.uint32), 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 where unknown."""
        if not len(self.hash):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.hash, wanted), len(self.hash) - 1)
        return np.where(self.hash[at] == wanted, at, -1)

    def add(self, new: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        if len(self.hash) + len(new) > CACHE:
            self._shrink()
        order = np.argsort(new)
        at = (np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0) + len(self.ids))[order]
        place = np.searchsorted(self.hash, new[order])
        self.hash, self.at, self.n = np.insert(self.hash, place, new[order]), np.insert(self.at, place, at), np.insert(self.n, place, n[order])
        self.used, self.times = np.insert(self.used, place, self.clock), np.insert(self.times, place, 1)
        self.ids = np.concatenate([self.ids, ids])

    def _shrink(self) -> None:
        # often or lately used ones stay, and what the texts at hand need, which the present clock marks
        worth = self.times + 2 * (self.used > self.clock - 8)
        keep = self.used == self.clock
        keep[np.lexsort((self.used, worth))[len(worth) // 2 :]] = True
        self.ids = self.ids[_ranges(self.at[keep], np.maximum(self.n[keep], 0))]
        self.hash, self.n, self.used, self.times = self.hash[keep], self.n[keep], self.used[keep], self.times[keep]
        self.at = np.cumsum(np.maximum(self.n, 0)) - np.maximum(self.n, 0)
        return_memory()


def _ranges(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... n[0] of them, then those of at[1] and so on."""
    n = n.astype(np.int64)
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class CachedEncoder:
    """Token numbers of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``.

    The pre-tokenizer never joins text across a single space between two other characters, and it leads
    the next piece with that space. So a text is cut at spaces, and each chunk is encoded once while it is
    known; new chunks are encoded together, and the tokens that start with a space say where each begins.
    Where the pre-tokenizer is the byte-level one with its own pattern, texts are cut at further places that
    it never joins: before ASCII punctuation behind a letter, and around a single line feed (``_cuts``).
    Chunks that no space leads are told apart, and encoded together with line feeds between them.
    Texts with neighbouring white space at a cut or a possible special token are encoded whole. Chunks are
    known by a 64-bit hash of their bytes (see ``hash_spans``).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), _Chunks()
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True) + 1, bool)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        for piece, i in vocabulary.items():
            self.spaced[i] = piece.startswith("\u0120")  # the byte-level alphabet's space
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = tuple({b"<|", *(c.encode() for c in contents if "<|" not in c)})
        own = self.tokenizer.pre_tokenizer
        self.fine = isinstance(own, pre_tokenizers.ByteLevel) and own.use_regex and not own.add_prefix_space and self.tokenizer.normalizer is None
        self.line_feed = vocabulary.get("\u010a")  # in the byte-level alphabet

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unsafe(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunks: list[bytes]) -> np.ndarray:
        """Chunks that are empty, begin or end in white space, or may hold a special token."""
        if not len(raw):
            return np.ones(len(chunks), bool)
        first, last = raw[np.minimum(starts, len(raw) - 1)], raw[ends - 1]
        odd = (ends <= starts) | _WHITE[first] | _WHITE[last]
        # white space beyond ASCII: by the first byte of the first character, by the last byte but one of the last
        beyond = np.isin(first, (0xC2, 0xE1, 0xE2, 0xE3)) | ((last > 127) & np.isin(raw[ends - 2], (0xC2, 0x80, 0x81, 0x9A)))
        for k in np.flatnonzero(~odd & beyond).tolist():
            text = chunks[k].decode("utf-8", "surrogatepass")
            odd[k] = text[0].isspace() or text[-1].isspace()
        for m in self.marks:
            for k in [k for k, c in enumerate(chunks) if m in c]:
                odd[k] = True
        return odd

    def _cuts(self, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Places inside texts, besides spaces, at which the byte-level pattern always ends a piece; ``edges`` are the texts' ends.

        Behind a letter, ASCII punctuation starts a piece; a line feed between two characters that are not
        white space is a piece. Letters are those of ASCII and of U+00C0 to U+00FF; others are left uncut.
        """
        if len(raw) < 3:
            return np.empty(0, np.int64)
        letter, kind = _LETTER[raw], _PUNCTUATION[raw]
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        before = np.flatnonzero(letter[:-1] & kind[1:]) + 1
        feeds = np.flatnonzero(raw[1:-1] == 10) + 1
        ahead, behind = raw[feeds + 1], raw[feeds - 1]
        feeds = feeds[(behind > 32) & (behind < 127) & (((ahead > 32) & (ahead < 127)) | (ahead == 0xC3))]
        outer = np.zeros(len(raw) + 1, bool)
        outer[edges] = True
        before, feeds = before[~outer[before]], feeds[~(outer[feeds] | outer[feeds + 1])]
        return np.sort(np.r_[before, feeds, feeds + 1])

    def _learn(self, hashes: np.ndarray, odd: np.ndarray, bare: np.ndarray, chunks: list[bytes]) -> None:
        """Adds new chunks, those that are not odd in runs of TOGETHER; a space leads all but the bare ones."""
        n, ids = np.full(len(chunks), _Chunks.UNSAFE, np.int32), [np.empty(0, np.uint32)]
        alone = bare & (np.array([b"\n" in c for c in chunks], bool) if self.line_feed is not None else True)
        groups = np.flatnonzero(~odd & ~bare), np.flatnonzero(~odd & bare & ~alone), np.flatnonzero(~odd & alone)
        for lead, good in zip((" ", "\n", ""), groups, strict=True):
            for i in range(0, len(good), TOGETHER):
                mine, at = good[i : i + TOGETHER], ()
                part = [chunks[k].decode("utf-8", "surrogatepass") for k in mine.tolist()]
                if lead:
                    got = self._ids([lead + lead.join(part)])[0]
                    at = np.flatnonzero(self.spaced[got] if lead == " " else got == self.line_feed)
                if len(at) == len(part):
                    n[mine] = np.diff(np.r_[at, len(got)]) - (lead == "\n")
                    ids.append(got if lead == " " else got[got != self.line_feed])
                else:
                    each = self._ids([lead.strip("\n") + c for c in part])
                    n[mine] = [len(x) for x in each]
                    ids += each
        order = np.r_[(*groups, np.flatnonzero(odd))]
        self.known.add(hashes[order], n[order], np.concatenate(ids))

    def flat(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) behind each other, each with ``end_id`` if given, and how many each has."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        stops = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[stops[0] : stops[-1]] if data is not None else np.empty(0, np.uint8)
        begin, stop, bytes_ = stops[:-1] - stops[0], stops[1:] - stops[0], raw.tobytes()
        spaces = np.flatnonzero(raw == 32)
        # a mark could be cut in two, so that only whole chunks tell it
        cuts = self._cuts(raw, np.r_[begin, stop]) if self.fine and not any(m in bytes_ for m in self.marks) else np.empty(0, np.int64)
        # pieces between the cuts, at least one a text; both are in order, so the k-th start belongs to the k-th end
        starts, ends = np.sort(np.r_[begin, spaces + 1, cuts]), np.sort(np.r_[stop, spaces, cuts])
        between = np.sort(np.r_[spaces, cuts])
        pieces = np.searchsorted(between, stop) - np.searchsorted(between, begin) + 1
        head = np.cumsum(pieces) - pieces
        bare = np.zeros(len(starts), bool)  # no space leads them
        bare[head] = True
        bare[np.searchsorted(starts, cuts)] = True
        group, hashes = pd.factorize(hash_spans(raw, starts, ends) ^ np.where(bare, _BARE, np.uint64(0)))  # distinct chunks
        some = np.empty(len(hashes), np.int64)
        some[group[::-1]] = np.arange(len(starts))[::-1]  # where each occurs first
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes, some, group = hashes[order], some[order], rank[group]
        known = self.known
        known.clock += 1
        place = known.find(hashes)
        known.used[place[place >= 0]] = known.clock
        known.times[place[place >= 0]] = np.minimum(known.times[place[place >= 0]] + 1, 3)
        new = np.flatnonzero(place < 0)
        if len(new):
            s, e, b = starts[some[new]], ends[some[new]], bare[some[new]]
            chunks = [bytes_[a:z] for a, z in zip(s.tolist(), e.tolist(), strict=True)]
            feed = b & np.array([c == b"\n" for c in chunks], bool)  # a piece of its own wherever it is a bare chunk
            self._learn(hashes[new], self._unsafe(raw, s, e, chunks) & ~feed, b, chunks)
            place = known.find(hashes)
        place = place[group]
        n, at = known.n[place].astype(np.int64), known.at[place]
        odd = np.logical_or.reduceat(n < 0, head)  # whole texts
        own = self._ids([texts[i].as_py() for i in np.flatnonzero(odd).tolist()])
        n[np.repeat(odd, pieces)] = 0
        size = np.array([len(x) for x in own], np.int64)
        n[head[odd]], at[head[odd]] = size, len(known.ids) + np.cumsum(size) - size
        store = [known.ids, *own]
        if end_id is not None:
            last = head + pieces
            at, n = np.insert(at, last, len(known.ids) + int(size.sum())), np.insert(n, last, 1)
            store.append(np.array([end_id], np.uint32))
            head = head + np.arange(len(head))
        out = np.concatenate(store)[_ranges(at, n)]
        return out, np.add.reduceat(n, head)

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, n = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]


def encoder(path: str) -> CachedEncoder:
    """One encoder per worker and vocabulary file."""
    return kept(("encoder", path), lambda: CachedEncoder(path))


def _encode(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for b in batches:
            texts = pc.fill_null(b.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(texts):
                before = int(ends[i - 1]) if i else 0
                j = max(i + 1, int(np.searchsorted(ends, before + RUN_BYTES, side="right")))
                flat, n = enc.flat(texts.slice(i, j - i), end_id)
                stops = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(at + stops - n), pa.array(n), lists], schema=schema)
                at += int(stops[-1])
                i = j

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> None:
    """Writes ``(doc_id, part, local_start, n_tokens, ids)`` in ascending doc_id order, one file per range of ids.

    Null texts are empty and hold the end id alone. Null doc_ids come first; rows with equal doc_id follow
    each other in the order of their texts, all kept. Further columns are ignored. Ranges are drawn from the
    ids alone, so a frequent id or source is no bottleneck unless one doc_id repeats. An empty table writes
    files without rows.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(lean(_encode(tokenizer_path, end_id), keeps=True), "doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>").write.options(**PARQUET).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files with ``start``, the count of all ids before the document. Filters on doc_id reach the page indexes."""
    files = spark.read.schema("doc_id bigint, part int, local_start bigint, n_tokens bigint, ids array<int>").parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return files.join(F.broadcast(sums), "part").withColumn("start", F.col("before") + F.col("local_start")).drop("before", "local_start", "part")


def _digest(batches):
    for b in batches:
        ids, n = b.column(3), b.num_rows
        flat, stops = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[stops[i] : stops[i + 1]].data) for i in range(n)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest_tokens(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of what ``read_tokens`` gives."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(lean(_digest), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; a parameter of everything here."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_token_ids(spark, sf_dir: str, tokenizer: Callable[[], str] = tokenizer_file) -> DataFrame:
    """All documents as token ids, written to shared scratch and read back."""
    path = scratch_dir(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer())
    return digest_tokens(read_tokens(spark, path))


QUERIES = {"op5_token_ids": op5_token_ids}
ORACLES: dict[str, str] = {}
