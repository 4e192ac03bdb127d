"""Continuous periods and gaps of many intervals per entity, by canonical dyadic blocks.

An integer interval is a union of canonical dyadic blocks [i * 2^l, (i + 1) * 2^l), two per level at most. Over the intervals of an entity,
blocks below a block that is present are dropped, sibling pairs are replaced by their parent level by level, and what is left is
coalesced where one block ends where the next begins.

Distribution: entities with few rows (all but `hot`) are processed whole, many to an Arrow chunk. Entities with more rows than a bound are cut
along the axis into tiles that are themselves dyadic blocks; stretches inside of a tile are final, and only the first and last of each tile go on to a
second pass. A tile can't hold more stretches than half its length, and each map task combines its own rows of a hot tile first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.util import group_codes, key_chunks, keyed

TILE_BITS = 20
HOT_ROWS = 200_000
HOT_MOST = 100_000


def dyadic_blocks(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the sorted unique (group, index) of the canonical blocks of the half-open intervals, start >= 0."""
    levels = []
    g, s, e = group, start.copy(), end.copy()
    while len(g):
        odd_s, odd_e = (s & 1) == 1, (e & 1) == 1
        gi = np.concatenate([g[odd_s], g[odd_e]])
        ix = np.concatenate([s[odd_s], e[odd_e] - 1])
        if len(gi):
            o = np.lexsort((ix, gi))
            gi, ix = gi[o], ix[o]
            new = np.ones(len(gi), bool)
            new[1:] = (gi[1:] != gi[:-1]) | (ix[1:] != ix[:-1])
            gi, ix = gi[new], ix[new]
        levels.append((gi, ix))
        s, e = (s + odd_s) >> 1, e >> 1
        live = s < e
        g, s, e = g[live], s[live], e[live]
    return levels


def union_of_blocks(levels: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches (group, start, end), sorted, of the blocks' union."""
    empty = np.zeros(0, np.int64)
    kept: list[tuple[np.ndarray, np.ndarray, int]] = []
    # sibling pairs upward: both halves present means that the parent is
    carry_g, carry_i = empty, empty
    merged = []
    for level, (g, i) in enumerate(levels):
        if len(carry_g):
            g, i = np.concatenate([g, carry_g]), np.concatenate([i, carry_i])
            o = np.lexsort((i, g))
            g, i = g[o], i[o]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (i[1:] != i[:-1])
            g, i = g[new], i[new]
        pair = np.zeros(len(g), bool)
        if len(g) > 1:
            pair[:-1] = (g[1:] == g[:-1]) & ((i[:-1] & 1) == 0) & (i[1:] == i[:-1] + 1)
        carry_g, carry_i = g[pair], i[pair] >> 1
        drop = pair.copy()
        drop[1:] |= pair[:-1]
        merged.append((g[~drop], i[~drop], level))
    level = len(levels)
    while len(carry_g):
        pair = np.zeros(len(carry_g), bool)
        pair[:-1] = (carry_g[1:] == carry_g[:-1]) & ((carry_i[:-1] & 1) == 0) & (carry_i[1:] == carry_i[:-1] + 1)
        drop = pair.copy()
        drop[1:] |= pair[:-1]
        merged.append((carry_g[~drop], carry_i[~drop], level))
        carry_g, carry_i, level = carry_g[pair], carry_i[pair] >> 1, level + 1
    # from the top: blocks below a kept block are covered by it
    cg, cs, ce = empty, empty, empty
    for g, i, level in reversed(merged):
        if not len(g):
            continue
        s = i << level
        if len(cg):
            at = _last_at_or_before(cg, cs, g, s)
            covered = (at >= 0) & (cg[at] == g) & (ce[at] > s)
            g, s = g[~covered], s[~covered]
        kept.append((g, s, level))
        if len(g):
            cg, cs, ce = _coalesce(np.concatenate([cg, g]), np.concatenate([cs, s]), np.concatenate([ce, s + (1 << level)]))
    return cg, cs, ce


def _last_at_or_before(g: np.ndarray, s: np.ndarray, qg: np.ndarray, qs: np.ndarray) -> np.ndarray:
    """Index of the last (g, s) <= (qg, qs) in sorted pairs, -1 if none."""
    n = len(g)
    o = np.lexsort((np.r_[np.zeros(n, np.int8), np.ones(len(qg), np.int8)], np.r_[s, qs], np.r_[g, qg]))
    before = np.cumsum(o < n)
    out = np.empty(len(qg), np.int64)
    q = o >= n
    out[o[q] - n] = before[q] - 1
    return out


def _coalesce(g: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted stretches of disjoint blocks, joined where one ends where the next begins."""
    o = np.lexsort((s, g))
    g, s, e = g[o], s[o], e[o]
    head = np.ones(len(g), bool)
    head[1:] = (g[1:] != g[:-1]) | (s[1:] != e[:-1])
    at = np.flatnonzero(head)
    last = np.r_[at[1:], len(g)] - 1
    return g[at], s[at], e[last]


def stretches(g: np.ndarray, s: np.ndarray, e: np.ndarray, hi_start: np.ndarray, lo_end: np.ndarray):
    """Maximal stretches of intervals or of partial stretches: (group, start, end, hi_start, lo_end, n).

    hi_start: the greatest start and lo_end: the least end of an original interval in it. A stretch is made of one distinct interval exactly
    if hi_start is its start and lo_end its end; both merge by max and min.
    """
    cg, cs, ce = union_of_blocks(dyadic_blocks(g, s, e))
    at = _last_at_or_before(cg, cs, g, s)
    hi = np.full(len(cg), np.iinfo(np.int64).min)
    lo = np.full(len(cg), np.iinfo(np.int64).max)
    np.maximum.at(hi, at, hi_start)
    np.minimum.at(lo, at, lo_end)
    return cg, cs, ce, hi, lo, np.bincount(at, minlength=len(cg))


def _rows(keys: dict[str, tuple[pa.DataType, list]], kind: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = {n: pa.array(v, t) if not isinstance(v, pa.Array) else v for n, (t, v) in keys.items()}
    return pa.RecordBatch.from_pydict(names | {"kind": pa.array(kind).cast(pa.string())} | {n: pa.array(v, pa.int64()) for n, v in cols.items()})


def _emit(t: pa.Table, first: np.ndarray, keys: list[str], g, s, e, hi, lo, edges: bool, between: int = 0) -> Iterator[pa.RecordBatch]:
    """Covered stretches and gaps. With edges, a group's first and last stretch come out as `edge`, to be joined with those of the neighbouring tiles."""
    take = lambda gi: {k: (None, t.column(k).take(pa.array(first[gi])).combine_chunks()) for k in keys}
    n = len(g)
    if not n:
        return
    opens = np.ones(n, bool)
    opens[1:] = g[1:] != g[:-1]
    closes = np.r_[opens[1:], True]
    edge = (opens | closes) if edges else np.zeros(n, bool)
    kind = np.where(edge, "edge", np.where((hi != s) | (lo != e), "covered", "single"))
    yield _rows(take(g), kind, {"start": s, "end": e, "hi_start": hi, "lo_end": lo})
    gap = ~opens
    if between:  # holes inside of a tile came out with it
        gap[1:] &= ((e[:-1] - 1) >> between) != (s[1:] >> between)
    if gap.any():
        a, b = e[np.flatnonzero(gap) - 1], s[gap]
        yield _rows(take(g[gap]), np.full(gap.sum(), "gap"), {"start": a, "end": b, "hi_start": a, "lo_end": b})


def _np(t: pa.Table, c: str) -> np.ndarray:
    return t.column(c).to_numpy()


def _chunk(t: pa.Table, keys: list[str], edges: bool, extra: list[str] = []) -> Iterator[pa.RecordBatch]:  # noqa: B006
    g, first = group_codes(t, [*keys, *extra])
    s, e = _np(t, "start"), _np(t, "end")
    hi, lo = (_np(t, "hi_start"), _np(t, "lo_end")) if "hi_start" in t.column_names else (s, e)
    cg, cs, ce, h, w, _ = stretches(g, s, e, hi, lo)
    yield from _emit(t, first, keys, cg, cs, ce, h, w, edges)


def periods(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, tile_bits: int = TILE_BITS) -> DataFrame:
    """Per entity (`keys`) the maximal covered stretches and the gaps between neighbouring ones of half-open integer intervals `start`, `end`.

    Result: keys, kind, start, end. kind is `covered` for a stretch of at least two different intervals, `single` for one that is a single
    distinct interval (repeated or not), `gap` for the hole between two neighbouring stretches. Intervals that touch are continuous.
    Rows with a null or negative start, a null end or start >= end are left out; NULL keys are values like others; empty input gives no rows.
    Extra columns are ignored. Coordinates up to 2^62.
    """
    spark = df.sparkSession
    src = df.where((F.col("start") >= 0) & (F.col("start") < F.col("end"))).select(*keys, F.col("start").cast("bigint"), F.col("end").cast("bigint"))
    fields = {f.name: f.dataType.simpleString() for f in src.schema}
    out_schema = ", ".join([f"`{k}` {fields[k]}" for k in keys] + ["kind string", "start bigint", "end bigint", "hi_start bigint", "lo_end bigint"])

    # the entities with most rows beyond the bound; any that HOT_MOST leaves out has under 1 / HOT_MOST of all rows
    counts = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = counts.orderBy(F.desc("_n")).limit(HOT_MOST).collect()
    whole = lambda batches: (b for t in key_chunks(batches) for b in _chunk(t, keys, False))
    if not hot:
        return keyed(src, keys).mapInArrow(whole, out_schema).select(*keys, "kind", "start", "end")
    marks = F.broadcast(spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], ", ".join(f"`_m{i}` {fields[k]}" for i, k in enumerate(keys))))
    same = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_m{i}"))
        same = c if same is None else same & c
    cold = keyed(src.join(marks, same, "left_anti"), keys).mapInArrow(whole, out_schema)

    # tiles are so wide that cutting at their borders gives at most 8 pieces a row on the average, however long single intervals are
    widths = range(tile_bits, 62, 4)
    cuts = src.join(marks, same, "left_semi").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.shiftright(F.col("end") - 1, b) - F.shiftright("start", b)).cast("double")).alias(f"b{b}") for b in widths]).first()
    tile_bits = next((b for b in widths if (cuts[f"b{b}"] or 0) <= 8 * cuts.n), 62)

    # hot entities, level 1: the rows of each map task, cut at tile borders and combined where they are read
    size = 1 << tile_bits
    mid = ", ".join([f"`{k}` {fields[k]}" for k in keys] + ["tile bigint", "start bigint", "end bigint", "hi_start bigint", "lo_end bigint"])
    pieces = src.join(marks, same, "left_semi").select(
        *keys,
        F.explode(F.sequence(F.shiftright("start", tile_bits), F.shiftright(F.col("end") - 1, tile_bits))).alias("tile"),
        F.col("start").alias("hi_start"),
        F.col("end").alias("lo_end"),
    ).select(*keys, "tile", F.greatest("hi_start", F.col("tile") * size).alias("start"), F.least("lo_end", (F.col("tile") + 1) * size).alias("end"), "hi_start", "lo_end")

    def local(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 400_000:
                yield from _combined(pa.Table.from_batches(held), keys)
                held, n = [], 0
        if n:
            yield from _combined(pa.Table.from_batches(held), keys)

    # level 2: a tile's states; level 3: the first and last stretches of an entity's tiles
    in_tile = lambda batches: (b for t in key_chunks(batches) for b in _chunk(t, keys, True, ["tile"]))
    tiles = keyed(pieces.mapInArrow(local, mid), [*keys, "tile"]).mapInArrow(in_tile, out_schema)
    spread = tiles.withColumn("_part", F.when(F.col("kind") == "edge", F.lit(-1)).otherwise(F.pmod(F.xxhash64("start", "end"), F.lit(1024)).cast("int")))

    def join_edges(batches):
        for t in key_chunks(batches):
            done = t.filter(pc.not_equal(t.column("kind"), "edge"))
            yield from done.select([*keys, "kind", "start", "end", "hi_start", "lo_end"]).to_batches()
            rest = t.filter(pc.equal(t.column("kind"), "edge"))
            if rest.num_rows:
                yield from _edges(rest, keys, tile_bits)

    ends = keyed(spread, [*keys, "_part"]).mapInArrow(join_edges, out_schema)
    return cold.unionByName(ends).select(*keys, "kind", "start", "end")


def _combined(t: pa.Table, keys: list[str]) -> Iterator[pa.RecordBatch]:
    g, first = group_codes(t, [*keys, "tile"])
    cg, cs, ce, hi, lo, _ = stretches(g, _np(t, "start"), _np(t, "end"), _np(t, "hi_start"), _np(t, "lo_end"))
    at = pa.array(first[cg])
    cols = {k: t.column(k).take(at).combine_chunks() for k in [*keys, "tile"]}
    yield pa.RecordBatch.from_pydict(cols | {n: pa.array(v) for n, v in (("start", cs), ("end", ce), ("hi_start", hi), ("lo_end", lo))})


def _edges(t: pa.Table, keys: list[str], tile_bits: int) -> Iterator[pa.RecordBatch]:
    """Edges of an entity in order: those that meet are one stretch, and a hole between two tiles is a gap."""
    g, first = group_codes(t, keys)
    s, e, hi, lo = (_np(t, c) for c in ("start", "end", "hi_start", "lo_end"))
    cg, cs, ce, h, w, _ = stretches(g, s, e, hi, lo)
    yield from _emit(t, first, keys, cg, cs, ce, h, w, False, tile_bits)
