"""Pairs of items that share a place and graphs of many links, as packed arrays: a shuffle carries a few compressed bytes for each record in place of a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.util import materialize, shuffle_width

#: Pairs that one task lists at most, but for a single item's; that also bounds what it holds. Records that are packed, listed or sorted at once.
PAIRS, CHUNK = 24_000_000, 3_000_000
#: Bins of item numbers among which the pairs are shared out.
BINS = 4096
_PACK = pa.schema([("bucket", pa.int32()), ("lists", pa.int32()), ("entries", pa.int32()), ("blob", pa.binary()), ("sizes", pa.binary()), ("vals", pa.binary())])


def pack(x: np.ndarray, kind: str) -> bytes:
    """x as planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(x, kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices first, first + 1, ... of each span, one span after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - end + size, size)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, item, value) of the entries, by list and item."""
    x = b.column(0)
    of = np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy()))
    e = x.flatten()
    item, value = e.field(0).to_numpy(zero_copy_only=False), e.field(1).to_numpy(zero_copy_only=False)
    o = np.lexsort((item, of))
    return of[o], item[o], value[o]


def _ends(of: np.ndarray) -> np.ndarray:
    """For each entry the place behind its list; lists are neighbours."""
    return np.searchsorted(of, of, "right")


def list_sums(lists: DataFrame) -> DataFrame:
    """(id, s, ss, pairs) of lists (entries array<struct<id int, value double>>): each item's sums, and its pairs with greater items of the same lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, item, value = _flat(b)
            if len(item):
                ids, at = np.unique(item, return_inverse=True)
                later = _ends(of) - np.arange(len(of)) - 1
                yield pa.record_batch([pa.array(ids, pa.int32()), *(pa.array(np.bincount(at, w)) for w in (value, value * value, later))], ["id", "s", "ss", "pairs"])

    sums = lists.mapInArrow(run, "id int, s double, ss double, pairs double")
    return sums.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("s", "ss", "pairs")])


def cuts_of(work: DataFrame, n: int) -> np.ndarray:
    """First ids of ranges of 0 .. n-1 with about equal sums of work (id, pairs): a range for each task, fewer for little work, more where a range would have over PAIRS."""
    wide = -(-n // BINS)
    at = {r.k: r.w for r in work.groupBy(F.floor(F.col("id") / wide).alias("k")).agg(F.sum("pairs").alias("w")).collect()}
    w = np.array([at.get(k, 0.0) for k in range(-(-n // wide))])
    done, ranges = np.cumsum(w), int(max(min(shuffle_width(work.sparkSession), np.ceil(w.sum() / (PAIRS / 32))), np.ceil(w.sum() / PAIRS)))
    first = np.searchsorted(done, done[-1] * np.arange(1, ranges) / ranges, "right") if len(w) else []
    return np.unique(np.concatenate([[0], np.asarray(first, np.int64) * wide]).clip(0, max(0, n - 1)))


def pair_sums(lists: DataFrame, cuts: np.ndarray, n: int, out: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """out(a, b, shared, xy) of all pairs a < b of items 0 .. n-1 that share a list: the number of lists and the sum of products.

    The task of a range of items gets, of each list, the part from its first item in the range on; it lists the pairs a few million at a time.
    """
    cuts = np.append(cuts, n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            of, item, value = _flat(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            bucket = np.searchsorted(cuts, item, "right") - 1
            end, at = _ends(of), np.arange(len(of))
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])
            first = at[new & (at + 1 < end)]
            first = first[np.argsort(bucket[first], kind="stable")]
            size = end[first] - first
            for f, k in zip(*(np.split(x, np.flatnonzero(np.diff(bucket[first])) + 1) for x in (first, size)), strict=True):
                if len(f):
                    i = spans(f, k)
                    yield pa.RecordBatch.from_pydict({"bucket": [int(bucket[f[0]])], "lists": [len(k)], "entries": [len(i)], "blob": [pack(np.diff(item[i], prepend=0), "<i4")], "sizes": [pack(k, "<i4")], "vals": [pack(value[i], "<f8")]}, _PACK)

        size = 0
        for b in batches:
            held.append(b)
            size += len(b.column(0).flatten())
            if size >= CHUNK // 4:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches for x in b.to_pylist()]
        for bucket in sorted({x["bucket"] for x in got}):
            own = [x for x in got if x["bucket"] == bucket]
            item = np.concatenate([np.cumsum(unpack(x["blob"], x["entries"], "<i4"), dtype=np.int32) for x in own])
            value = np.concatenate([unpack(x["vals"], x["entries"], "<f8") for x in own])
            size = np.concatenate([unpack(x["sizes"], x["lists"], "<i4") for x in own])
            later = np.repeat(np.cumsum(size), size) - np.arange(len(item)) - 1
            a = np.flatnonzero((item < cuts[bucket + 1]) & (later > 0))
            a = a[np.argsort(item[a], kind="stable")]
            later = later[a]
            yield from _count(item, value, a, later, n, out)

    sent = lists.mapInArrow(send, "bucket int, lists int, entries int, blob binary, sizes binary, vals binary")
    return sent.repartitionById(len(cuts) - 1, "bucket").mapInArrow(count, schema)


def _count(item, value, a, later, n, out) -> Iterator[pa.RecordBatch]:
    done, at = np.cumsum(later), 0
    rest = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CHUNK, "right")))
        k = later[at:to]
        x, y = np.repeat(a[at:to], k), spans(a[at:to] + 1, k)
        lo, hi = int(item[a[at]]), int(item[a[to - 1]])
        if len(rest[0]):
            lo = min(lo, int(rest[0][0] // n))
        b0, b1 = int(item[y].min()), int(item[y].max())
        if len(rest[0]):
            b0, b1 = min(b0, int((rest[0] % n).min())), max(b1, int((rest[0] % n).max()))
        wide = b1 - b0 + 1
        key = (item[x].astype(np.int64) - lo) * wide + (item[y] - b0)
        xy = value[x] * value[y]
        rk = (rest[0] // n - lo) * wide + (rest[0] % n - b0)
        cells = (hi - lo + 1) * wide
        if cells <= 8 * len(key):
            c, s = np.bincount(key, minlength=cells).astype(np.float64), np.bincount(key, xy, minlength=cells)
            c[rk] += rest[1]
            s[rk] += rest[2]
            key = np.flatnonzero(c)
            c, s = c[key], s[key]
        else:
            key, c, s = np.concatenate([rk, key]), np.concatenate([rest[1], np.ones(len(key))]), np.concatenate([rest[2], xy])
            o = np.argsort(key, kind="stable")
            key = key[o]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, c, s = key[start], np.add.reduceat(c[o], start), np.add.reduceat(s[o], start)
        i, j = key // wide + lo, key % wide + b0
        keep = len(i) if to == len(a) or item[a[to]] != hi else int(np.searchsorted(i, hi))  # the last item's pairs may go on
        rest = (i[keep:] * n + j[keep:], c[keep:], s[keep:])
        if keep:
            yield out(i[:keep], j[:keep], c[:keep], s[:keep])
        at = to


def number(df: DataFrame, col: str) -> DataFrame:
    """(col, id) of its values but NULL: numbers 0 .. n-1 in their order."""
    from locusmill.operators.stats import global_rank

    r = global_rank(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], "id")
    return materialize(r.select(col, (F.col("id") - 1).cast("int").alias("id")), "numbers")



_LINKS = "n int, u binary, v binary, w binary"
_SENT = "bucket int, n int, u binary, v binary, w binary"


def _packed(bucket: int | None, u: np.ndarray, v: np.ndarray, w: np.ndarray | None) -> pa.RecordBatch:
    x = {"n": [len(u)], "u": [pack(np.diff(u, prepend=0), "<i4")], "v": [pack(np.diff(v, prepend=0), "<i4")], "w": [b"" if w is None else pack(w, "<f8")]}
    return pa.RecordBatch.from_pydict(x if bucket is None else {"bucket": pa.array([bucket], pa.int32()), **x}, pa.schema([("bucket", pa.int32())] * (bucket is not None) + [("n", pa.int32()), *[(c, pa.binary()) for c in "uvw"]]))


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(u, v, w) of each packed record of `links`, by u and v; w is None without weights."""
    for x in b.to_pylist():
        u, v = (np.cumsum(unpack(x[c], x["n"], "<i4"), dtype=np.int64) for c in "uv")
        yield u, v, unpack(x["w"], x["n"], "<f8") if x["w"] else None


def pairs_of(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(u, v, w) of plain columns, the third of which may be missing."""
    c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
    yield c[0].astype(np.int64), c[1].astype(np.int64), c[2] if len(c) > 2 else None


def links(df: DataFrame, cuts: np.ndarray, n: int, read: Callable = pairs_of) -> DataFrame:
    """Packed links of nodes 0 .. n-1: read(batch) gives (u, v, w) arrays of df's batches. A link comes once, with the sum of its weights; a range of `cuts` is one task's, a node's links are in one record."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            u, v, w = merged(held, n)
            at = np.searchsorted(u, np.append(cuts, n))
            for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if i < j:
                    yield _packed(k, u[i:j], v[i:j], None if w is None else w[i:j])

        for b in batches:
            for x in read(b):
                if len(x[0]):
                    held.append(x)
                    size += len(x[0])
            if size >= CHUNK // 3:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {}
        for b in batches:
            for k, x in zip(b.column("bucket").to_pylist(), unpacked(b), strict=True):
                got.setdefault(k, []).append(x)
        for k in sorted(got):
            u, v, w = merged(got.pop(k), n)
            i = 0
            while i < len(u):
                j = int(np.searchsorted(u, u[min(len(u) - 1, i + CHUNK // 3)], "left"))
                j = len(u) if i + CHUNK // 3 >= len(u) else j if j > i else int(np.searchsorted(u, u[i], "right"))
                yield _packed(None, u[i:j], v[i:j], None if w is None else w[i:j])
                i = j

    return materialize(df.mapInArrow(send, _SENT).repartitionById(len(cuts), "bucket").mapInArrow(meet, _LINKS), "links")


def merged(parts: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    u, v = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
    key = u * n + v
    if parts[0][2] is None:
        key = np.unique(key)
        return key // n, key % n, None
    w = np.concatenate([x[2] for x in parts])
    o = np.argsort(key, kind="stable")
    key = key[o]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start] // n, key[start] % n, np.add.reduceat(w[o], start)


def node_sums(graph: DataFrame, n: int, fn: Callable, kind: str = "double") -> np.ndarray:
    """Sums by node over the packed records: fn(u, v, w) gives (nodes, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in unpacked(b):
                i, y = fn(*x)
                yield pa.record_batch([pa.array(i, pa.int32()), pa.array(y).cast(pa.float64() if kind == "double" else pa.int64())], ["id", "x"])

    t = graph.mapInArrow(run, f"id int, x {kind}").groupBy("id").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(n, np.float64 if kind == "double" else np.int64)
    out[t.column("id").to_numpy()] = t.column("x").to_numpy()
    return out


def even_cuts(work: np.ndarray, parts: int) -> np.ndarray:
    """First nodes of at most `parts` ranges with about equal sums of work."""
    done = np.cumsum(work)
    return np.unique(np.append(0, np.searchsorted(done, done[-1] * np.arange(1, parts) / parts, "right")).clip(0, len(work) - 1))


def forest(edges: DataFrame, size: int = CHUNK // 3) -> DataFrame:
    """Fewer edges (a, b) that join the same nodes: of each `size` edges, every node's with the least of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            names = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]).combine_chunks().dictionary_encode()
            code = names.indices.to_numpy()
            u, v = code[: t.num_rows], code[t.num_rows :]
            part = np.arange(len(names.dictionary))
            while True:
                x, y = part[u], part[v]
                if (x == y).all():
                    break
                np.minimum.at(part, np.maximum(x, y), np.minimum(x, y))
                while (part != part[part]).any():
                    part = part[part]
            own = np.flatnonzero(part != np.arange(len(part)))
            yield pa.record_batch([names.dictionary.take(pa.array(own)), names.dictionary.take(pa.array(part[own]))], ["a", "b"])

        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= size:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    kind = edges.schema["a"].dataType.simpleString()
    e = edges.select("a", "b").where("a <> b")
    return materialize(e.mapInArrow(run, f"a {kind}, b {kind}"), "forest")
