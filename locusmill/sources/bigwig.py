"""bigWig files: a Spark data source that reads their runs in parallel, and a writer of uncondensed files.

`spark.dataSource.register(BigWigSource)`, then `spark.read.format("bigwig").load(path)` gives (chrom, start, end, value). Each partition reads a share of the file's index
leaves. Only the full-resolution data are read; written files have no zoom levels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Magic numbers of the file, the name tree and the index.
FILE, NAMES, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0


class Header:
    def __init__(self, f) -> None:
        raw = f.read(64)
        self.order = "<" if struct.unpack("<I", raw[:4])[0] == FILE else ">"
        if struct.unpack(self.order + "I", raw[:4])[0] != FILE:
            raise ValueError("not a bigWig file")
        _, _, self.zooms, self.names_at, self.data_at, self.index_at = struct.unpack(self.order + "IHHQQQ", raw[:32])
        self.packed = struct.unpack(self.order + "I", raw[52:56])[0] > 0


def names(f, h: Header) -> dict[int, tuple[str, int]]:
    """id -> (name, length) of the chromosomes."""
    f.seek(h.names_at)
    _, _, key, _, _, _ = struct.unpack(h.order + "IIIIQQ", f.read(32))
    out: dict[int, tuple[str, int]] = {}
    todo = [h.names_at + 32]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack(h.order + "BBH", f.read(4))
        for _ in range(n):
            name = f.read(key).rstrip(b"\0").decode()
            if leaf:
                i, size = struct.unpack(h.order + "II", f.read(8))
                out[i] = (name, size)
            else:
                todo.append(struct.unpack(h.order + "Q", f.read(8))[0])
    return out


def blocks(f, h: Header) -> list[tuple[int, int]]:
    """(offset, size) of all data blocks, from the index's leaves."""
    out, todo = [], [h.index_at + 48]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack(h.order + "BBH", f.read(4))
        raw = f.read(n * (32 if leaf else 24))
        for i in range(n):
            if leaf:
                out.append(struct.unpack_from(h.order + "QQ", raw, i * 32 + 16))
            else:
                todo.append(struct.unpack_from(h.order + "Q", raw, i * 24 + 16)[0])
    return sorted(out)


def runs(data: bytes, order: str) -> Iterator[tuple[int, int, int, float]]:
    """(chromosome id, start, end, value) of a block: runs, or values at single or regular places."""
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(order + "IIIIIBBH", data)
    for i in range(n):
        if kind == 1:
            s, e, v = struct.unpack_from(order + "IIf", data, 24 + 12 * i)
        elif kind == 2:
            s, v = struct.unpack_from(order + "If", data, 24 + 8 * i)
            e = s + span
        else:
            v = struct.unpack_from(order + "f", data, 24 + 4 * i)[0]
            s = start + i * step
            e = s + span
        yield chrom, s, e, v


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chrom string, start bigint, end bigint, value float"

    def reader(self, schema) -> DataSourceReader:
        return BigWigReader(self.options["path"].removeprefix("file:"), int(self.options.get("blocksPerPartition", "2000")))


class BigWigReader(DataSourceReader):
    def __init__(self, path: str, share: int) -> None:
        self.path, self.share = path, share

    def partitions(self) -> list[InputPartition]:
        with open(self.path, "rb") as f:
            b = blocks(f, Header(f))
        return [InputPartition(b[i : i + self.share]) for i in range(0, max(1, len(b)), self.share)]

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            h = Header(f)
            known = names(f, h)
            for at, size in partition.value:
                f.seek(at)
                raw = f.read(size)
                for c, s, e, v in runs(zlib.decompress(raw) if h.packed else raw, h.order):
                    yield known[c][0], s, e, v


def write_bigwig(df: DataFrame, sizes: DataFrame, path: str, items: int = 1024, fan: int = 256) -> None:
    """A bigWig file of disjoint runs (chrom, start, end, value) on chromosomes of sizes (chrom, length).

    The format is one sorted file, so the driver writes it, from an iterator over sorted partitions; it holds one partition and the index (32 bytes for `items` runs).
    """
    chroms = [(r.chrom, r.length) for r in sizes.orderBy("chrom").collect()]
    ids = {c: i for i, (c, _) in enumerate(chroms)}
    key = max([1, *(len(c.encode()) for c in ids)])
    rows = df.where(F.col("chrom").isin(list(ids))).select("chrom", "start", "end", F.col("value").cast("float").alias("value")).orderBy("chrom", "start").toLocalIterator(prefetchPartitions=False)
    leaves: list[tuple[int, int, int, int, int]] = []
    most, count = 0, 0
    low, high, total, square, covered = float("inf"), float("-inf"), 0.0, 0.0, 0
    with open(path, "wb") as f:
        f.write(b"\0" * 64)
        summary_at = f.tell()
        f.write(b"\0" * 40)
        names_at = f.tell()
        f.write(struct.pack("<IIIIQQ", NAMES, max(1, len(chroms)), key, 8, len(chroms), 0) + struct.pack("<BBH", 1, 0, len(chroms)))
        for c, n in chroms:
            f.write(c.encode().ljust(key, b"\0") + struct.pack("<II", ids[c], n))
        data_at = f.tell()
        f.write(struct.pack("<Q", 0))
        held: list[tuple[int, int, float]] = []
        chrom = None

        def flush() -> None:
            nonlocal most, count, held
            if held:
                raw = struct.pack("<IIIIIBBH", ids[chrom], held[0][0], held[-1][1], 0, 0, 1, 0, len(held)) + b"".join(struct.pack("<IIf", *x) for x in held)
                most = max(most, len(raw))
                at = f.tell()
                f.write(zlib.compress(raw))
                leaves.append((ids[chrom], held[0][0], held[-1][1], at, f.tell() - at))
                count += 1
                held = []

        for r in rows:
            if r.chrom != chrom or len(held) == items:
                flush()
                chrom = r.chrom
            held.append((r.start, r.end, r.value))
            w = r.end - r.start
            low, high, total, square, covered = min(low, r.value), max(high, r.value), total + r.value * w, square + r.value**2 * w, covered + w
        flush()
        index_at = f.tell()
        first, last = (leaves[0], leaves[-1]) if leaves else ((0, 0, 0, 0, 0),) * 2
        f.write(struct.pack("<IIQIIIIQII", INDEX, fan, len(leaves), first[0], first[1], last[0], last[2], index_at, items, 0))
        # levels from the root: every node's place follows from the number of nodes before it
        levels = [[(x[0], x[1], x[0], x[2], x[3], x[4]) for x in leaves]]
        while len(levels[-1]) > fan:
            up = levels[-1]
            levels.append([(g[0][0], g[0][1], g[-1][2], g[-1][3], 0, 0) for g in (up[i : i + fan] for i in range(0, len(up), fan))])
        at = f.tell()
        for depth in range(len(levels) - 1, -1, -1):
            entries = levels[depth]
            leaf = depth == 0
            nodes = [entries[i : i + fan] for i in range(0, len(entries), fan)] or [[]]
            width = 4 + fan * (32 if leaf else 24)
            below = at + len(nodes) * width
            down = 4 + fan * (32 if depth == 1 else 24)
            child = 0
            for node in nodes:
                raw = struct.pack("<BBH", leaf, 0, len(node))
                for e in node:
                    if leaf:
                        raw += struct.pack("<IIIIQQ", *e)
                    else:
                        raw += struct.pack("<IIIIQ", *e[:4], below + child * down)
                        child += 1
                f.write(raw.ljust(width, b"\0"))
            at = below
        f.write(struct.pack("<I", FILE))
        f.seek(data_at)
        f.write(struct.pack("<Q", count))
        f.seek(summary_at)
        f.write(struct.pack("<Qdddd", covered, low if covered else 0.0, high if covered else 0.0, total, square))
        f.seek(0)
        f.write(struct.pack("<IHHQQQHHQQIQ", FILE, 4, 0, names_at, data_at, index_at, 0, 0, 0, summary_at, most, 0))
