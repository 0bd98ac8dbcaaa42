"""Operator 9, n-gram Jaccard join: universe partition, pigeonhole signatures, exact verification.

Two sets with Jaccard similarity of 3/4 or more differ in at most (|x| + |y|) / 7 elements. The universe of
shingles is cut by hash into segments, as many as the size band needs; sets that differ in at most h elements
agree on at least one of any h + 1 segments that are not empty. A set is indexed, in its own band's partition
and as the larger side in the band below, by

* the first h + 1 of its segments, when enough of them hold only shingles that are not popular;
* else all those segments together with their one-deletion neighbourhoods, in which a segment of two or more
  elements accounts for two differences;
* and only where this still does not add up to h + 1, by segments of popular shingles, least popular first.

Popular shingles (counted over all documents) cost most as signatures, hence the allocation. Which shingles
count as popular changes the cost alone: the order is the same for all sets, and so no pair is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, hash_spans, lean, materialise, mix, return_memory, strings, text_batches, word_spans

N = 5
#: Similarity PART / WHOLE.
PART, WHOLE = 75, 100
#: A shingle is popular from so many documents on; tasks report those they meet LOCAL times or more.
POPULAR, LOCAL = 64, 3
#: Bound of the broadcast table of popular shingles; beyond it the less frequent of them are treated as others.
MAX_POPULAR = 1_000_000
#: Signature lists with more members emit a star and are completed in a second round.
SMALL = 12
#: Documents of a block of the second round.
BLOCK = 512
#: Rows of the blocks that are handled in one call, on average.
GROUP = 16_384
#: Groups of equal sets with so many rows may be joined by broadcast, and how many such groups there can be.
HOT, HOT_GROUPS = 1024, 1_000_000
#: Lists with so many members are joined by broadcast, all others by shuffling.
LONG = 1024
#: Id tables are broadcast up to so many rows (about 40 MB of the driver's heap), those of two columns up to half of it.
BROADCAST_IDS = 1_000_000
#: Shingles for each partition of signatures, at the most on average: what one call of ``_meet`` holds.
PARTITION = 2_000_000
#: Bytes of sketches that are compared at once.
CELLS = 1 << 22
#: A signature that so many documents share is hot: its list is never gathered. Hot ones are broadcast, MAX_HOT at the
#: most; beyond it the shorter of their lists are gathered like all others.
HOT_LIST, MAX_HOT = 1 << 16, 1_000_000
#: Documents in one row of a long list's members.
CHUNK = 1 << 17

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP, _SEED = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_SEED2 = np.uint64(0xE7037ED1A0B428DB)


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's N-word shingles; of fewer words, one hash of the whole."""
    out = []
    for _, run in text_batches(texts):
        joined = b" ".join(run).translate(_FOLD)
        raw, starts, ends = word_spans(joined, _SPACES)
        words = hash_spans(raw, starts, ends)
        begin = np.cumsum([0] + [len(b) + 1 for b in run])
        cut = np.searchsorted(starts, begin)
        with np.errstate(over="ignore"):
            full = np.zeros(max(0, len(words) - N + 1), np.uint64)
            for j in range(N if len(full) else 0):
                full = full * _STEP + words[j : len(words) - N + 1 + j]
            full = mix(full)
            for k in range(len(run)):
                a, z = cut[k], cut[k + 1]
                if z - a >= N:
                    out.append(np.unique(full[a : z - N + 1]))
                elif z > a:
                    h = np.uint64(z - a) * _SEED
                    for w in words[a:z]:
                        h = h * _STEP + w
                    out.append(mix(np.array([h], np.uint64)))
                else:
                    out.append(np.empty(0, np.uint64))
    return out


def _bands() -> np.ndarray:
    b = [1]
    while b[-1] < 1 << 40:
        b.append(max(b[-1] + 1, b[-1] * 16 // 9))
    return np.array(b, np.int64)


BANDS = _bands()


def _segments(band: int) -> int:
    """Segments of a band's partition: on average about two shingles each, more segments for small sets."""
    most = int(BANDS[band + 1]) - 1
    return 2 * most if most < 48 else -(-9 * most // 20)


def signatures(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """All signatures of the set ``h`` (sorted, distinct); ``level`` is 0, or 1 and more by popularity."""
    s = len(h)
    if not s:
        return np.empty(0, np.uint64)
    band = int(np.searchsorted(BANDS, s, side="right")) - 1
    roles = [(band, (s + 4 * s // 3) // 7)]
    if band and 3 * s <= 4 * (below := int(BANDS[band]) - 1):
        roles.append((band - 1, (s + below) // 7))
    out = []
    with np.errstate(over="ignore"):
        token = mix(h * _STEP + _SEED)
        for k, most in roles:
            m, need = _segments(k), most + 1
            salt = np.uint64(k + 1) * _SEED
            key = level * m + (mix(h ^ salt) % np.uint64(m)).astype(np.int64)
            order = np.argsort(key, kind="stable")
            key, mine = key[order], token[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, s])
            total, tag = np.add.reduceat(mine, first), key[first].astype(np.uint64) * _STEP + salt
            sig = mix(total + tag)
            rare = int(np.searchsorted(key[first], m))
            if rare >= need:
                out.append(sig[:need])
                continue
            out.append(sig[:rare])
            n = int(size[:rare].sum())
            group = np.repeat(np.arange(rare), size[:rare])
            some = size[group] > 1
            out.append(mix(total[group][some] - mine[:n][some] + tag[group][some]))
            short = need - int(np.minimum(size[:rare], 2).sum())
            if short > 0:
                out.append(sig[rare : rare + short])
                if len(sig) - rare < short:  # only sets that run out of segments meet here, by single shingles
                    out.append(mix(mine[:need] + salt + np.uint64(1)))
    return np.unique(np.concatenate(out))


def _sketch(s: np.ndarray) -> bytes:
    """Parities of the counts of hashes per class: as many classes as the power of two from twice the set's size on."""
    m = 1 << max(6, int(2 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8)).tobytes()


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) with classes put together until they are ``width`` bytes long."""
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def _near(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """False where more classes differ in parity than the n / 7 elements a linked pair of n in all may differ in.

    An element in one set alone changes one class, so no link is lost; the longer sketches are folded.
    """
    width = min(x.shape[1], y.shape[1])
    x, y = (np.ascontiguousarray(_folded(z, width)).view(np.uint64) for z in (x, y))
    return 7 * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= n


_PASS1 = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("key2", pa.int64()), ("sketch", pa.binary())])


def _pass1(batches):
    """A row per document (n, a 128-bit key and the sketch of its set); and rows of kind 1: shingles met LOCAL times or more in the task's batch."""
    for b in batches:
        sets = shingle_sets(strings(b.column(2)))
        with np.errstate(over="ignore"):
            key, key2 = (np.array([mix(s * m + _STEP).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for m in (_SEED, _SEED2))
        n = np.array([len(s) for s in sets], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), b.column(0), b.column(1), pa.array(n), pa.array(key), pa.array(key2), pa.array([_sketch(s) for s in sets], pa.binary())], schema=_PASS1)
        if sets and n.sum():
            every = np.concatenate(sets)
            every.sort()
            ahead, last = every[: len(every) - LOCAL + 1], every[LOCAL - 1 :]
            got = np.unique(ahead[ahead[: len(last)] == last]) if len(every) >= LOCAL else every[:0]
            times, got = np.searchsorted(every, got, "right") - np.searchsorted(every, got), got.view(np.int64)
            none = pa.nulls(len(got), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(got), np.int32)), none, none, pa.array(times.astype(np.int64)), pa.array(got), none, pa.nulls(len(got), pa.binary())], schema=_PASS1)


def _pass2(popular, parts: int):
    """Signatures of each batch as one row per partition: 32 bits per signature, and which document it is of."""
    schema = pa.schema([("p", pa.int32()), ("sigs", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])

    def run(batches):
        known, levels = popular.value
        for b in batches:
            sets = shingle_sets(strings(b.column(2)))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(s) for s in sets], np.int32)
            each = []
            for s in sets:
                level = np.zeros(len(s), np.int64)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    level = np.where(known[at] == s, levels[at], 0)
                each.append(signatures(s, level))
            if not each or not sum(map(len, each)):
                continue
            doc = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
            sig = np.concatenate(each)
            part = ((sig >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, low, doc = part[order], sig[order].astype(np.uint32), doc[order]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = []
            for a, z in zip(first, np.r_[first[1:], len(part)], strict=True):
                here, local = np.unique(doc[a:z], return_inverse=True)
                small = np.uint16 if len(here) < 1 << 16 else np.uint32
                rows.append((int(part[a]), low[a:z].tobytes(), local.astype(small).tobytes(), ids[here].tobytes(), sizes[here].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _fits(a, b):
    return WHOLE * np.minimum(a, b).astype(np.int64) >= PART * np.maximum(a, b).astype(np.int64)


def _often(batches):
    """Signatures that LOCAL documents or more of one batch share, and how many do."""
    for b in batches:
        for p, sigs in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            got, n = np.unique(np.frombuffer(sigs.as_buffer(), np.uint32), return_counts=True)
            got, n = got[n >= LOCAL], n[n >= LOCAL]
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(_named(p, got)), pa.array(n)], names=["sig", "n"])


def _named(p: int, sigs: np.ndarray) -> np.ndarray:
    """One number for a partition and the 32 bits of a signature in it."""
    return (np.int64(p) << np.int64(32)) | sigs.astype(np.int64)


def _cold(hot):
    """The rows of ``_pass2`` without the hot signatures."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                sigs, docs = np.frombuffer(r["sigs"], np.uint32), np.frombuffer(r["docs"], _index_type(r))
                keep = ~np.isin(_named(r["p"], sigs), hot.value)
                if keep.any():
                    rows.append({**r, "sigs": sigs[keep].tobytes(), "docs": docs[keep].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return run


_HOT = pa.schema([("sig", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("k", pa.int64()), ("sum", pa.int64()), ("least", pa.int64()), ("n", pa.int32())])


def _hot_rows(hot):
    """Of each row of ``_pass2``, the documents of each hot signature: their ids and sizes, a sum over them and the smallest id."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                sigs, docs = np.frombuffer(r["sigs"], np.uint32), np.frombuffer(r["docs"], _index_type(r))
                ids, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int32)
                names = _named(r["p"], sigs)
                at = np.flatnonzero(np.isin(names, hot.value))
                at = at[np.argsort(names[at], kind="stable")]
                for part in np.split(at, np.flatnonzero(np.diff(names[at])) + 1) if len(at) else ():
                    mine, size = ids[docs[part]], sizes[docs[part]]
                    low = int(mine.argmin())
                    total = int(mix(mine.view(np.uint64) ^ _SEED).sum(dtype=np.uint64).view(np.int64))
                    rows.append((int(names[part[0]]), mine.tobytes(), size.tobytes(), len(mine), total, int(mine[low]), int(size[low])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _HOT.types, strict=True)], schema=_HOT)

    return run


def _index_type(row: dict):
    """How the documents of a row of ``_pass2`` are numbered."""
    return np.uint16 if len(row["ids"]) // 8 < 1 << 16 else np.uint32


def _stars(batches):
    """Candidate pairs of each document of a hot list with the list's smallest one."""
    for b in batches:
        for r in b.to_pylist():
            ids, sizes = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["sizes"], np.int32)
            ids = np.unique(ids[_fits(sizes, np.int32(r["n"])) & (ids != r["least"])])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["least"])), pa.array(ids)], names=["a", "b"])


def _split_hot(spark: SparkSession, blobs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The written rows of ``_pass2`` without hot signatures, and the lists of these in rows of a batch each, or None.

    Hot signatures are counted over all documents, as far as batches hold them LOCAL times. Of lists with the
    same members one stays.
    """
    counts = blobs.select("p", "sigs").mapInArrow(lean(_often), "sig bigint, n bigint").groupBy("sig").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= HOT_LIST).orderBy(F.desc("n"), "sig").limit(MAX_HOT).toArrow()  # bounded by MAX_HOT
    if not len(top):
        return blobs, None
    hot = spark.sparkContext.broadcast(np.sort(top["sig"].to_numpy()))
    rows = materialise(blobs.mapInArrow(lean(_hot_rows(hot)), "sig bigint, ids binary, sizes binary, k bigint, sum bigint, least bigint, n int"), "jaccard-hot")
    lists = rows.groupBy("sig").agg(F.min(F.struct("least", "n")).alias("m"), F.sum("k").alias("k"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    lists = lists.groupBy("k", "sum").agg(F.min(F.struct("sig", "m")).alias("s")).select("s.sig", "s.m.least", "s.m.n")
    rows = rows.select("sig", "ids", "sizes").join(F.broadcast(lists), "sig")  # MAX_HOT lists at the most
    return blobs.mapInArrow(lean(_cold(hot)), blobs.schema), rows


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("list", pa.int64()), ("chunk", pa.int32()), ("members", pa.binary())])


def _meet(small: int):
    """Candidate pairs of one partition's signature lists; lists over ``small`` give a star and, in chunks, their members."""

    def meet(key, table):
        sig, doc, ids, sizes, base = [], [], [], [], 0
        for r in table.to_pylist():
            n = len(r["ids"]) // 8
            d = np.frombuffer(r["docs"], _index_type(r))
            sig.append(np.frombuffer(r["sigs"], np.uint32))
            doc.append(d.astype(np.int64) + base)
            ids.append(np.frombuffer(r["ids"], np.int64))
            sizes.append(np.frombuffer(r["sizes"], np.int32))
            base += n
        sig, doc, ids, sizes = map(np.concatenate, (sig, doc, ids, sizes))
        order = np.lexsort((ids[doc], sig))
        sig, doc = sig[order], doc[order]
        keep = np.r_[True, (sig[1:] != sig[:-1]) | (ids[doc[1:]] != ids[doc[:-1]])]
        sig, doc = sig[keep], doc[keep]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[first, len(sig)])
        left, right = [], []
        for k in range(2, small + 1):
            at = first[size == k]
            if len(at):
                i, j = np.triu_indices(k, 1)
                left.append(doc[at[:, None] + i].ravel())
                right.append(doc[at[:, None] + j].ravel())
        large = {}
        for at, k in zip(first[size > small], size[size > small], strict=True):
            x = doc[at : at + k]
            members = ids[x].tobytes()
            if members not in large:
                large[members] = None
                left.append(np.repeat(x[:1], k - 1))
                right.append(x[1:])
        pairs = np.empty((0, 2), np.int64)
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            ok = _fits(sizes[a], sizes[b])
            pairs = np.stack([ids[a[ok]], ids[b[ok]]], axis=1)
            if len(pairs):
                pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
                pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]]
        rows = []
        for x in large:
            name = int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
            rows += [(name, k // (8 * CHUNK), x[k : k + 8 * CHUNK]) for k in range(0, len(x), 8 * CHUNK)]
        n, m = len(pairs), len(rows)
        del sig, doc, ids, sizes, order, keep, first, size, left, right, large
        return_memory()
        columns = [pa.concat_arrays([pa.array(pairs[:, c]), pa.nulls(m, pa.int64())]) for c in (0, 1)]
        columns += [pa.concat_arrays([pa.nulls(n, t), pa.array([r[c] for r in rows], t)]) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
        return pa.Table.from_arrays(columns, schema=_FOUND)

    return meet


def _set_rows(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(strings(b.column(1)))], pa.binary())], names=["doc_id", "set"])


def _by_width(sketches: list):
    """Sketches by their length in bytes: which they are, and a matrix of them."""
    widths = np.array([len(x) for x in sketches])
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        yield at, np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint8).reshape(len(at), w)


def _sketched(batches):
    """Drops pairs whose sketches rule a link out."""
    for b in batches:
        xs, ys, n = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_numpy()
        ok = np.zeros(b.num_rows, bool)
        for at, x in _by_width(xs):
            for inner, y in _by_width([ys[i] for i in at.tolist()]):
                ok[at[inner]] = _near(x[inner], y, n[at[inner]])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))


def _verify(batches):
    for b in batches:
        ok = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(WHOLE * both >= PART * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _crosses(table):
    """``_cross`` of each block of the lists in ``table``, which holds whole blocks."""
    columns = [table[c].to_numpy() for c in ("list", "x", "y")]
    order = np.lexsort(columns[::-1])
    table = table.take(order).combine_chunks()
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])
    parts = [_cross(table.slice(a, z - a)) for a, z in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True)]
    pairs = np.unique(np.concatenate(parts), axis=0)
    del table, columns, parts
    return_memory()
    return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _cross(table) -> np.ndarray:
    """Of one block of a large list, the pairs of its asking documents with its others, as far as sketches allow."""
    ids, comp, size, asks = (table[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "comp", "n", "asks"))
    groups = list(_by_width(table["sketch"].to_pylist()))
    left, right = [], []
    for at, x in groups:
        mine, x = at[asks[at]], x[asks[at]]
        for other, y in groups:
            theirs, width = other[~asks[other]], min(x.shape[1], y.shape[1])
            if not len(mine) or not len(theirs) or max(x.shape[1], y.shape[1]) > 4 * width:
                continue
            y64 = np.ascontiguousarray(_folded(y[~asks[other]], width)).view(np.uint64)
            step = max(1, CELLS // (len(theirs) * width))
            for k in range(0, len(mine), step):
                i = mine[k : k + step, None]
                x64 = np.ascontiguousarray(_folded(x[k : k + step], width)).view(np.uint64)
                ok = (comp[i] != comp[theirs]) & _fits(size[i], size[theirs])
                ok &= 7 * np.bitwise_count(x64[:, None] ^ y64).sum(axis=2, dtype=np.int64) <= size[i] + size[theirs]
                r, c = np.nonzero(ok)
                left.append(i[r, 0])
                right.append(theirs[c])
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        i, j = ids[i], ids[j]
        return np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1)
    return np.empty((0, 2), np.int64)


def _of_lists(members: DataFrame, lists: DataFrame) -> DataFrame:
    """The join on ``list``: the lists of LONG members or more are broadcast, so that those of one list stay spread over tasks.

    There is at most one such list for LONG rows of ``members``. All others are small enough for one task, and
    are shuffled: nothing that grows with the number of lists is gathered by the driver.
    """
    lists = lists.withColumn("_long", F.col("all") >= LONG).drop("all")
    short = members.join(lists.where("not _long").hint("merge"), "list")
    return members.join(F.broadcast(lists.where("_long")), "list").union(short).drop("_long")


def _open_lists(members: DataFrame) -> DataFrame:
    """The lists that are not one component yet: the largest component of each, and into how many blocks it is cut.

    Documents outside the largest component ask, all are asked. Counts are partially aggregated per list and component.
    """
    sizes = members.groupBy("list", "comp").agg(F.count("*").alias("k"))
    lists = sizes.groupBy("list").agg(F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("all")).where("m.k < all")
    cut = lambda n: F.ceil(n / BLOCK).cast("int")
    lists = lists.select("list", F.col("m.comp").alias("main"), F.col("all"), (F.col("all") - F.col("m.k")).alias("asking"))
    lists = lists.select("list", "main", "all", "asking", cut(F.col("all")).alias("others"), cut(F.col("asking")).alias("askers"))
    return lists.select("list", "main", "all", "others", "askers", (F.col("all") * F.col("askers") + F.col("asking") * F.col("others")).alias("rows"))


def _blocks(rows: DataFrame) -> DataFrame:
    """The members of open lists dealt out for `_cross`: a row per block of a list that a document takes part in.

    Askers and asked are cut by hash into blocks of about BLOCK documents; every block of askers meets every
    block of the list, whatever the list's length.
    """
    rows = rows.withColumn("at", F.xxhash64("doc_id"))
    own = lambda n: F.pmod("at", F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["list", "doc_id", "comp", "n", "sketch"]
    asked = rows.select(*kept, F.lit(False).alias("asks"), each("askers").alias("x"), own("others").alias("y"))
    asking = rows.where("comp <> main").select(*kept, F.lit(True).alias("asks"), own("askers").alias("x"), each("others").alias("y"))
    return asked.union(asking)


def _verified(docs: DataFrame, info: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of ``(a, b)`` that are links: by sketch first, then on the sets of the documents that remain.

    Documents that share a doc_id can give the same link several times.
    """
    sketch = info.where("n > 0").select("doc_id", "n", "sketch")
    x = sketch.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    y = sketch.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    near = pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("n"))
    near = materialise(near.mapInArrow(lean(_sketched), "a bigint, b bigint").distinct(), "jaccard-near")
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id"))
    if 2 * near.count() <= BROADCAST_IDS:
        few = F.broadcast(ids)
    else:
        ids = materialise(ids.distinct(), "jaccard-ids")
        few = broadcast_if_small(ids, ids.count(), BROADCAST_IDS)
    # not written out: both sides of the joins below read one and the same exchange of the sets
    sets = docs.select(F.col("doc_id").cast("bigint"), "text").join(few, "doc_id", "left_semi").mapInArrow(lean(_set_rows), "doc_id bigint, set binary")
    x, y = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("xa")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("xb"))
    return materialise(near.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(lean(_verify), "a bigint, b bigint"), "jaccard-links")


def _copies(info: DataFrame) -> DataFrame:
    """``doc_id, th, rep`` of documents whose set equals that of a smaller doc_id: the smallest stands for all.

    Groups of HOT rows or more, and of at least a HOT_GROUPS-th of all rows, are joined by broadcast: there are
    at most HOT_GROUPS of them. All others are small enough for one task, and their rows alone are shuffled.
    """
    same = info.where("n > 0 and doc_id is not null").groupBy("key", "key2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"), F.count("*").alias("k"))
    same = materialise(same.where("rep <> top").drop("top"), "jaccard-same")
    bar = max(HOT, -(-info.count() // HOT_GROUPS))
    hot, on = F.broadcast(same.where(F.col("k") >= bar)), ["key", "key2", "n"]
    rows = info.select("doc_id", "th", *on)
    both = rows.join(hot, on).union(rows.join(hot, on, "left_anti").join(same.where(F.col("k") < bar), on))
    return both.where("doc_id <> rep").select("doc_id", "th", "rep")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row of ``docs(doc_id, text)``.

    Documents link when 100 * intersection >= 75 * union of their sets of five-word shingles (words between
    the white space of ASCII, A-Z lower-cased); component_id is the smallest doc_id reachable. Null, empty
    and blank texts have an empty set, link with nothing and are their own component; a null doc_id has a
    null component. Rows that share a doc_id are one node with the links of all. Equal sets are collapsed to
    their smallest doc_id before anything is paired. Further columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    info = materialise(rows.mapInArrow(lean(_pass1), "kind int, doc_id bigint, th bigint, n bigint, key bigint, key2 bigint, sketch binary"), "jaccard-info")
    counts = info.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= POPULAR)
    top = counts.orderBy(F.desc("n"), "key").limit(MAX_POPULAR).toArrow()  # bounded by MAX_POPULAR
    known, times = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(known)
    popular = spark.sparkContext.broadcast((known[order], np.log2(np.maximum(times[order], 1)).astype(np.int64)))
    info = info.where("kind = 0").drop("kind")
    copies = materialise(_copies(info), "jaccard-copies")
    ids = broadcast_if_small(copies.select("doc_id", "th"), copies.count(), BROADCAST_IDS // 2)
    alone = rows.where("doc_id is not null").join(ids, ["doc_id", "th"], "left_anti")
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    blobs = alone.select("doc_id", "th", "text").mapInArrow(lean(_pass2(popular, parts)), "p int, sigs binary, docs binary, ids binary, sizes binary")
    hot = None
    if len(times) and times.max() >= HOT_LIST:  # a signature is no more frequent than its shingles
        blobs, hot = _split_hot(spark, materialise(blobs, "jaccard-signatures"))
    found = materialise(blobs.groupBy("p").applyInArrow(_meet(SMALL), "a bigint, b bigint, list bigint, chunk int, members binary"), "jaccard-found")
    pairs = found.where("a is not null").select("a", "b")
    if hot is not None:
        pairs = pairs.union(hot.mapInArrow(lean(_stars), "a bigint, b bigint"))
    links = _verified(docs, info, pairs.distinct())
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    twins = copies.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    comps = connected_components(edges.union(twins))
    # second round: large lists that are not one component yet
    large = found.where("members is not null").select("list", "chunk", "members").dropDuplicates(["list", "chunk"])
    if hot is not None:
        large = large.union(hot.select("sig", F.lit(0), "ids"))
    if not large.isEmpty():
        comps = materialise(comps, "jaccard-comps")
        members = large.mapInArrow(lean(_members), "list bigint, doc_id bigint").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("list", "doc_id", F.coalesce("component_id", "doc_id").alias("comp"))
        members = materialise(members, "jaccard-members")
        open_ = materialise(_open_lists(members), "jaccard-lists")
        if not open_.isEmpty():
            members = materialise(_of_lists(members, open_.drop("rows")), "jaccard-open")
            sizes = info.where("n > 0").select("doc_id", "n", "sketch").distinct()
            rows = open_.agg(F.sum("rows")).first()[0]
            blocks = _blocks(members.join(sizes, "doc_id"))
            blocks = blocks.withColumn("g", F.pmod(F.xxhash64("list", "x", "y"), F.lit(-(-rows // GROUP))))
            pairs = blocks.groupBy("g").applyInArrow(_crosses, "a bigint, b bigint").distinct()
            more = _verified(docs, info, materialise(pairs, "jaccard-cross"))
            stars = comps.where("node <> component_id").select(F.col("node").alias("u"), F.col("component_id").alias("v"))
            comps = connected_components(stars.union(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    out = info.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _members(batches):
    for b in batches:
        for key, m in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            ids = np.frombuffer(m, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), pa.array(ids)], names=["list", "doc_id"])


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_ORACLE = r"""
with recursive w as (select doc_id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), []::varchar[]) ws from documents),
s as (select doc_id, list_distinct(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else []::varchar[] end) g from w),
e as (select doc_id, md5(unnest(g)) t from s), n as (select doc_id, len(g) n from s),
i as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.t = b.t and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
z as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from z union select r.a, z.b from r join z on r.b = z.a)
select n.doc_id, n.n::bigint n_shingles, least(n.doc_id, coalesce(m, n.doc_id))::bigint component_id from n left join (select a, min(b) m from r group by a) q on q.a = n.doc_id"""

QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLES = {"op9_jaccard_join": _ORACLE}
