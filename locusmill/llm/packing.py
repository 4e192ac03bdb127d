"""Whole documents into containers of fixed capacity, neighbours along a space-filling curve together."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.tokens import RANKS, with_token_counts
from locusmill.util import materialize

#: Documents that a task packs, and neighbours along the curve that are packed together.
TASK_DOCS, BLOCK = 12_500, 2_048


def hilbert_key(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points (rows) with integer coordinates in [0, 2^bits), after Skilling's transpose form."""
    x = coords.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(hit, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Packer:
    """Best fit over containers that stay open from block to block; each block's items come in decreasing size."""

    def __init__(self, capacity: int, most_open: int = 512) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.made = 0
        self.open: list[tuple[int, int]] = []  # (room, container), sorted

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def add(self, sizes: list[int]) -> list[list[tuple[int, int, int]]]:
        """For each item the pieces (container, from, to). An item within the capacity is one piece."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
        rest = []
        for i, n in enumerate(sizes):
            at = 0
            while n - at > self.capacity:
                out[i].append((self.new(), at, at + self.capacity))
                at += self.capacity
            rest.append((n - at, i, at))
        for n, i, at in sorted(rest, key=lambda x: (-x[0], x[1])):
            j = bisect.bisect_left(self.open, (n, -1))
            room, box = self.open.pop(j) if j < len(self.open) else (self.capacity, self.new())
            out[i].append((box, at, at + n))
            if room > n:
                bisect.insort(self.open, (room - n, box))
        if len(self.open) > self.most_open:  # the fullest close first
            self.open = self.open[-self.most_open :]
        return out


def pack(docs: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", path: str = RANKS, dims: int = 4, bits: int = 12) -> DataFrame:
    """Pieces of documents in containers: pack_name, container_id, key, piece_no, token_from, token_to, for every row of `limits` (pack_name, capacity_tokens).

    Hashed token-set vectors are projected to `dims` dimensions, scaled by the collection's mean and deviation, and ordered along a Hilbert curve;
    tasks take stretches of the curve and pack neighbouring documents. Only a document longer than the capacity is cut, into full pieces and one rest, which
    shares a container. A document without tokens is a piece of size 0. Equal documents have equal keys and are spread by their id. Limits without a capacity or
    with one below 1 are left out; limits are settings, a few rows. An empty collection gives no rows.
    """
    spark = docs.sparkSession
    boxes = [(r.pack_name, int(r.capacity_tokens)) for r in limits.collect() if r.capacity_tokens and r.capacity_tokens > 0]
    kind = docs.schema[key].dataType.simpleString()
    sized = materialize(with_token_counts(docs, text, [key], path, dims), "sized")
    stats = sized.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("vec")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("m", F.mean), ("s", F.stddev_pop))]).first()
    parts = max(1, -(-stats.n // TASK_DOCS))
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(dims)])
    dev = np.array([stats[f"s{i}"] or 1.0 for i in range(dims)])

    def curve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.array(b.column(2).to_pylist(), np.float64).reshape(b.num_rows, dims)
            z = 1 / (1 + np.exp(-1.702 * (v - mean) / dev))
            h = hilbert_key(np.clip(z * (1 << bits), 0, (1 << bits) - 1), bits)
            yield pa.RecordBatch.from_pydict({key: b.column(0), "n_tokens": b.column(1), "h": pa.array(h)})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packers = [(name, Packer(c)) for name, c in boxes]
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                sizes = part.column(1).to_pylist()
                for name, p in packers:
                    got = p.add(sizes)
                    rows = [(i, k, *piece) for i, pieces in enumerate(got) for k, piece in enumerate(pieces)]
                    at, no, box, lo_t, hi_t = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
                    yield pa.RecordBatch.from_pydict(
                        {
                            "pack_name": pa.array([name] * len(at), pa.string()),
                            "container_id": pa.array(base + box),
                            key: part.column(0).take(pa.array(at)),
                            "piece_no": pa.array(no.astype(np.int32)),
                            "token_from": pa.array(lo_t),
                            "token_to": pa.array(hi_t),
                        }
                    )

    along = sized.mapInArrow(curve, f"`{key}` {kind}, n_tokens bigint, h bigint").withColumn("_x", F.xxhash64(key))
    along = along.repartitionByRange(parts, "h", "_x").sortWithinPartitions("h", "_x").select(key, "n_tokens")
    return along.mapInArrow(fill, f"pack_name string, container_id bigint, `{key}` {kind}, piece_no int, token_from bigint, token_to bigint")


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per pack: containers, tokens, unused tokens and the share of space used."""
    lim = limits.select("pack_name", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    per = packed.groupBy("pack_name", "container_id").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("t")).groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return per.join(F.broadcast(lim), "pack_name").select("pack_name", "capacity_tokens", "containers", "tokens", (room - F.col("tokens")).alias("unused"), F.round(F.col("tokens") / room, 6).alias("used_share"))
