"""Shared pieces of the training-data operators: shared scratch folders, word hashing, components."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise
from ..storage import scratch as scratch_dir

__all__ = ["broadcast_if_small", "connected_components", "hash_spans", "kept", "lean", "materialise", "mix", "return_memory", "scratch_dir", "strings", "text_batches", "word_spans"]

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_KEEP_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast hint only when the counted ``rows`` stay within ``limit``; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX1
        x = (x ^ (x >> np.uint64(27))) * MIX2
        return x ^ (x >> np.uint64(31))


def return_memory() -> None:
    """Hands freed memory back to the system: workers live on between tasks, beside the executor's JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


_KEPT: dict = {}


def kept(name, build):
    """What ``build()`` gave, kept by this worker until a task that keeps nothing runs on it."""
    if name not in _KEPT:
        _KEPT[name] = build()
    return _KEPT[name]


def lean(run, keeps: bool = False):
    """The batch function ``run``, returning freed memory when its task ends; what other tasks kept goes first."""

    def batches_of(batches):
        if not keeps:
            _KEPT.clear()
        try:
            yield from run(batches)
        finally:
            return_memory()

    return batches_of


def word_spans(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as an array, and the start and end of each maximal run of bytes that ``separators`` (256 booleans) lacks."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~separators[raw]
    edge = np.diff(inside)
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: So many bytes of a span are hashed together with those of others.
MANY_BYTES = 1024


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: eight bytes at a time go through a bijective mixer, all spans at once.

    Spans of equal length that differ in a single block never collide; others as chance has it, whatever
    their bytes. A hash depends on the span's bytes and length alone.

    >>> raw = np.frombuffer(b"ab ab", np.uint8)
    >>> h = hash_spans(raw, np.array([0, 3]), np.array([2, 5]))
    >>> bool(h[0] == h[1])
    True
    """
    n = ends - starts
    with np.errstate(over="ignore"):
        out = mix(n.astype(np.uint64) * MIX1 + BASE)
        live, at = np.flatnonzero(n > 0), 0
        if len(live):
            padded = np.zeros(len(raw) + 8, np.uint8)
            padded[: len(raw)] = raw
            words = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        while len(live):
            if at == MANY_BYTES:  # the rest of very long spans, one by one
                for k in live.tolist():
                    rest = hashlib.blake2b(raw[starts[k] + at : ends[k]].tobytes(), digest_size=8).digest()
                    out[k : k + 1] = mix(out[k : k + 1] ^ np.frombuffer(rest, "<u8"))
                break
            left = n[live] - at
            block = words[starts[live] + at] & _KEEP_BYTES[np.minimum(left, 8)]
            out[live] = mix((out[live] ^ block) * BASE + MIX2)
            at += 8
            live = live[left > 8]
    return out


def strings(column, rows: int = 256):
    """The values of an Arrow column, turned into Python strings ``rows`` at a time."""
    for i in range(0, len(column), rows):
        yield from column.slice(i, rows).to_pylist()


def text_batches(texts, limit: int = 1 << 19):
    """Runs of texts whose bytes stay near ``limit``, as (first index, list of bytes); one long text is a run alone."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        b = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if run and size + len(b) > limit:
            yield first, run
            run, size, first = [], 0, i
        run.append(b)
        size += len(b) + 1
    if run:
        yield first, run


def _forest(batches):
    """Spanning forest of the edges of one partition as (node, smallest node) rows: memory is one partition's nodes."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, z = find(u), find(v)
            if a != z:
                parent[max(a, z)] = min(a, z)
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    for i in range(0, len(rows), 100_000):
        part = rows[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and the smallest node that each reaches: larger roots hook to their smallest neighbour."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


#: Forests of so many edges (16 bytes each) are finished on the driver; a step of their own over the cluster costs more.
FEW_EDGES = 500_000


def connected_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """``(node, component_id)`` for every node of the ``(u, v)`` edges; component_id is the smallest node reachable.

    Each partition first shrinks its edges to a forest. Forests of ``few`` edges in all, at the most, are finished
    on the driver. Of more, alternating large-star and small-star steps (minimum per node, partially aggregated
    before the shuffle) run until nothing changes; every step is a table in the shared folder. Null ends and
    self-loops are ignored; no edges give no rows.
    """
    import pyarrow as pa

    spark = edges.sparkSession
    forest = edges.selectExpr("cast(u as bigint) u", "cast(v as bigint) v").where("u is not null and v is not null and u <> v")
    now = materialise(forest.mapInArrow(lean(_forest), "u bigint, v bigint"), "cc-forest")
    if now.count() <= few:
        got = now.toArrow()  # bounded by few
        return spark.createDataFrame(pa.table(dict(zip(("node", "component_id"), _roots(got["u"].to_numpy(), got["v"].to_numpy()), strict=True))))
    now = materialise(now.distinct(), "cc")

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: both sides of the join are then plain exchanges, and the rows of a hub can be split
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "cc-large")
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = materialise(small.where("u <> v").distinct(), "cc")
        after = state(now)
        if after == before:
            break
        before = after
    stars = now.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("node"), "component_id")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return spark.createDataFrame([], stars.schema) if not before[0] else stars.union(roots).dropDuplicates(["node"])


