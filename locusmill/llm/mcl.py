"""Clusters of mutually similar records by Markov clustering of a similarity graph, level by level.

A level's graph links each record to its most similar ones above the threshold. Its column-stochastic flow matrix is squared, inflated and pruned in turn
until it hardly changes; a column's strongest row is the attractor that its record belongs to. Flow on a sparse graph leaves large clusters in several parts,
so the graph is contracted to the attractors, with the summed weight of the links between their parts, and flows again until no link is left between
two parts. Attractors that are still similar although no link of the sparse graph joins their parts start another level. A column never has more than
`entries` rows, so squaring makes at most entries^2 products for a record, however large its cluster.
Flow never leaves a connected part of the graph. So parts are found first, mostly within a shard of the index, and each part of up to LOCAL_ROWS records flows
through all its rounds and levels in one task, without a shuffle or a written table for each round; larger parts go round by round through all tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.llm.hnsw import matrix, neighbour_lists, usable_vectors
from locusmill.operators.network import components
from locusmill.util import free, key_chunks, keyed, mark, materialize, shuffle_width, small

#: Rows kept of a column, inflation, least share of a column's strongest row that is kept, rounds, and how far below 1 a converged column's strongest flow may be
#: (also the chaos below which columns have stopped).
ENTRIES, INFLATION, PRUNE, ROUNDS, STILL = 16, 2.0, 0.01, 10, 0.02
#: Records of a part up to which it flows in one task, and up to which as a dense matrix; links between shards up to which the driver joins their parts.
LOCAL_ROWS, DENSE_ROWS, DRIVER_LINKS = 50_000, 512, 2_000_000

_COLUMN = "id bigint, rows array<bigint>, flow array<float>, chaos double"


def _columns(col: np.ndarray, row: np.ndarray, v: np.ndarray, entries: int | None, inflation: float, prune: float) -> Iterator[pa.RecordBatch]:
    """Columns out of (column, row, value): equal places summed, inflated, pruned to the strongest rows, scaled to sum 1."""
    o = np.lexsort((row, col))
    col, row, v = col[o], row[o], v[o]
    new = np.ones(len(col), bool)
    new[1:] = (col[1:] != col[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    v = np.add.reduceat(v, at) if len(at) else v
    col, row = col[at], row[at]
    v = v**inflation
    o = np.lexsort((row, -v, col))
    col, row, v = col[o], row[o], v[o]
    first = np.ones(len(col), bool)
    first[1:] = col[1:] != col[:-1]
    start = np.flatnonzero(first)
    of = np.cumsum(first) - 1
    keep = v >= prune * v[start[of]]
    if entries is not None:
        keep &= np.arange(len(col)) - start[of] < entries
    col, row, v, of = col[keep], row[keep], v[keep], of[keep]
    v = v / np.bincount(of, v)[of]
    n = np.bincount(of)
    offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
    begin = np.r_[0, np.cumsum(n)[:-1]]
    chaos = v[begin] - np.bincount(of, v * v)
    yield pa.RecordBatch.from_pydict(
        {
            "id": pa.array(col[begin]),
            "rows": pa.ListArray.from_arrays(offsets, pa.array(row)),
            "flow": pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.float32))),
            "chaos": pa.array(chaos),
        }
    )


def _strongest(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.Table]:
    """Of the links (a, b, w) of some 200 000 rows at a time the `entries` strongest of each a, so that a node with very many links sends few to its column's task."""

    def cut(held: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(held)
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
        o = np.lexsort((b, -w, a))
        first = np.ones(len(o), bool)
        first[1:] = a[o][1:] != a[o][:-1]
        at = np.arange(len(o))
        return t.take(pa.array(o[at - np.maximum.accumulate(np.where(first, at, 0)) < entries]))

    held, n = [], 0
    for x in batches:
        held.append(x)
        n += x.num_rows
        if n >= 200_000:
            yield cut(held)
            held, n = [], 0
    if n:
        yield cut(held)


def _ends(ptr: DataFrame) -> DataFrame:
    """(id, attractor, flow): attractor pointers followed to the end. Of two nodes that are each other's attractor the lesser is the attractor of both; nodes on a longer loop are their own."""
    out, before = materialize(ptr, "attractors"), None
    while True:
        up = out.select(F.col("id").alias("attractor"), F.col("attractor").alias("_up"))
        step = out.join(up, "attractor").select("id", F.when(F.col("_up") == F.col("id"), F.least("id", "attractor")).otherwise(F.col("_up")).alias("_new"), "attractor", "flow")
        step = materialize(step, "attractors")
        moved = step.where("_new <> attractor").count()
        if moved and moved == before:
            return step.select("id", F.when(F.col("_new") == F.col("attractor"), F.col("_new")).otherwise(F.col("id")).alias("attractor"), "flow")
        out, before = step.select("id", F.col("_new").alias("attractor"), "flow"), moved
        if not moved:
            return out


def markov_clusters(edges: DataFrame, entries: int | None = ENTRIES, inflation: float = INFLATION, prune: float = PRUNE, rounds: int = ROUNDS, loops: bool = True) -> DataFrame:
    """(id, attractor, flow, inflow) of every node of a weighted graph (a, b, w), w > 0, ids BIGINT. Edges count in both directions, repeated ones by their greatest weight.

    A node without edges isn't in the result. attractor is the row with the strongest flow of the node's column (the least id among equals), followed to the end; the
    attractor of an attractor is itself. flow is the column's share that goes to its strongest row, inflow what all columns together send to the node after the
    first squaring. Columns that have converged aren't squared again; one that hasn't after `rounds` takes the strongest row that it has (its flow then is well
    below 1). With entries None columns are whole, with prune 0 besides the flow is exact. loops = False leaves out self-loops, and with rounds = 0 each node then
    goes to its strongest neighbour.
    """
    both = edges.where((F.col("a") != F.col("b")) & (F.col("w") > 0)).select("a", "b", F.col("w").cast("double").alias("w"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    if entries is not None:
        both = both.mapInArrow(lambda batches: (b for t in _strongest(batches, entries) for b in t.to_batches()), "a bigint, b bigint, w double")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_chunks(batches):
            a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "w"))
            if loops:  # a self-loop as strong as the column's strongest edge
                node, of = np.unique(a, return_inverse=True)
                best = np.zeros(len(node))
                np.maximum.at(best, of, w)
                a, b, w = np.r_[a, node], np.r_[b, node], np.r_[w, best]
            yield from _columns(a, b, w, entries, 1.0, 0.0)

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_chunks(batches, 100_000):
            rows, flow = t.column("rows").combine_chunks(), t.column("flow").combine_chunks()
            n = np.diff(rows.offsets.to_numpy())
            v = flow.flatten().to_numpy().astype(np.float64) * np.repeat(t.column("v").to_numpy(), n)
            yield from _columns(np.repeat(t.column("c").to_numpy(), n), rows.flatten().to_numpy(), v, entries, inflation, prune)

    since = mark()
    m = materialize(keyed(both, ["a"]).mapInArrow(start, _COLUMN), "flow")
    done: list[DataFrame] = []
    open_, inflow = m, None
    for r in range(rounds):
        left = open_.select(F.col("id").alias("c"), F.explode(F.arrays_zip("rows", "flow")).alias("x")).select("c", F.col("x.rows").alias("id"), F.col("x.flow").cast("double").alias("v"))
        whole = m.select("id", "rows", "flow")
        m = materialize(keyed(left.join(whole, "id").select("c", "v", "rows", "flow"), ["c"]).mapInArrow(square, _COLUMN), "flow")
        if r == 0:
            inflow = m.select(F.explode(F.arrays_zip("rows", "flow")).alias("x")).groupBy(F.col("x.rows").alias("id")).agg(F.sum(F.col("x.flow").cast("double")).alias("inflow"))
            inflow = materialize(inflow, "inflow")
        done.append(m.where(F.col("flow")[0] >= 1 - STILL))
        open_ = m.where(F.col("flow")[0] < 1 - STILL)
        m = functools.reduce(DataFrame.unionByName, [*done, open_])
        if not open_.where(F.col("chaos") >= STILL).limit(1).count():
            break
    out = _ends(m.select("id", F.col("rows")[0].alias("attractor"), F.col("flow")[0].cast("double").alias("flow")))
    inflow = out.select("id").limit(0).withColumn("inflow", F.lit(0.0)) if inflow is None else inflow
    out = materialize(out.join(inflow, "id", "left").withColumn("inflow", F.coalesce("inflow", F.lit(0.0))), "attractors")
    free(since, out)
    return out


def _parts(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is connected with by the links (a, b)."""
    part = np.arange(n)
    while True:
        a, b = part[a], part[b]
        apart = a != b
        if not apart.any():
            return part
        a, b = a[apart], b[apart]
        np.minimum.at(part, np.maximum(a, b), np.minimum(a, b))
        while ((up := part[part]) != part).any():
            part = up


def _squared(m: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The inflow of each row after the first of the rounds of flow over m (parts, columns, rows), which is changed in place; empty columns are padding."""
    open_, inflow, live, s = m.any(2), np.zeros(m.shape[:2]), np.arange(len(m)), m.shape[1]
    for r in range(rounds):
        before = m[live]
        p = np.matmul(before, before) ** INFLATION
        p[p < PRUNE * p.max(2, keepdims=True)] = 0
        part, col = np.nonzero((p > 0).sum(2) > ENTRIES)
        if len(part):
            x = p[part, col]
            least = np.partition(x, s - ENTRIES, axis=1)[:, s - ENTRIES, None]
            tie = x == least
            x[(x < least) | (tie & (np.cumsum(tie, axis=1) > ENTRIES - (x > least).sum(1, keepdims=True)))] = 0
            p[part, col] = x
        p /= np.maximum(p.sum(2, keepdims=True), 1e-300)
        p = np.where(open_[live][:, :, None], p.astype(np.float32), before)
        m[live] = p
        if r == 0:
            inflow = p.sum(1)
        top = p.max(2)
        open_[live] &= top < 1 - STILL
        live = live[(open_[live] & (top - (p * p).sum(2) >= STILL)).any(1)]
        if not len(live):
            break
    return inflow


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, row, flow) of a batch of columns."""
    rows = b.column("rows")
    return np.repeat(b.column("id").to_numpy(), np.diff(rows.offsets.to_numpy())), rows.flatten().to_numpy(), b.column("flow").flatten().to_numpy().astype(np.float64)


def _squared_sparse(col: np.ndarray, row: np.ndarray, v: np.ndarray, part: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `_squared`, for entries (column, row, flow) sorted by column; part: of each node. Gives the entries, the strongest of a column first, and the inflow."""
    n = len(part)
    live, open_, inflow = np.ones(n, bool), np.ones(n, bool), np.zeros(n)
    for r in range(rounds):
        count = np.bincount(col, minlength=n)
        first = np.cumsum(count) - count
        todo = np.flatnonzero(live & open_ & (count > 0))
        kept, chaos = ~np.isin(col, todo), np.zeros(n)
        out = [(col[kept], row[kept], v[kept])]
        for lo in range(0, len(todo), 4096):
            c = todo[lo : lo + 4096]
            at = np.repeat(first[c] - np.cumsum(count[c]) + count[c], count[c]) + np.arange(count[c].sum())
            by = count[row[at]]
            to = np.repeat(first[row[at]] - np.cumsum(by) + by, by) + np.arange(by.sum())
            b = next(_columns(np.repeat(col[at], by), row[to], np.repeat(v[at], by) * v[to], ENTRIES, INFLATION, PRUNE))
            chaos[b.column("id").to_numpy()] = b.column("chaos").to_numpy()
            out.append(_lists(b))
        col, row, v = (np.concatenate(x) for x in zip(*out, strict=True))
        o = np.argsort(col, kind="stable")
        col, row, v = col[o], row[o], v[o]
        if r == 0:
            inflow = np.bincount(row, v, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, col, v)
        open_ &= top < 1 - STILL
        live = np.bincount(part, live & open_ & (chaos >= STILL))[part] > 0
        if not live.any():
            break
    return col, row, v, inflow


def _flow(a: np.ndarray, b: np.ndarray, w: np.ndarray, part: np.ndarray, strongest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, its column's strongest row, flow to that, inflow) of the nodes of the links (a, b, w). part: of every node, nodes of a part stand together.
    With `strongest` there is no flow, and each node goes to its strongest neighbour."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    n, (a, b) = len(nodes), np.split(at, 2)
    a, b, w = np.r_[a, b], np.r_[b, a], np.r_[w, w]
    o = np.lexsort((-w, b, a))
    a, b, w = a[o], b[o], w[o]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    a, b, w = a[new], b[new], w[new]
    if strongest:
        col, row, v = _lists(next(_columns(a, b, w, None, 1.0, 0.0)))
        first = np.r_[True, col[1:] != col[:-1]]
        return nodes, row[first], v[first], np.zeros(n)
    best = np.maximum.reduceat(w, np.flatnonzero(np.r_[True, a[1:] != a[:-1]]))
    col, row, v = _lists(next(_columns(np.r_[a, np.arange(n)], np.r_[b, np.arange(n)], np.r_[w, best], ENTRIES, 1.0, 0.0)))
    _, p = np.unique(part[nodes], return_inverse=True)
    size = np.bincount(p)
    start = np.cumsum(size) - size
    to, flow, inflow = np.arange(n), np.ones(n), np.zeros(n)
    large = size[p[col]] > DENSE_ROWS
    if large.any():
        c, r, x, inn = _squared_sparse(col[large], row[large], v[large], p)
        first = np.r_[True, c[1:] != c[:-1]]
        to[c[first]], flow[c[first]] = r[first], x[first]
        inflow += inn
    order = np.argsort(size, kind="stable")
    order = order[size[order] <= DENSE_ROWS]
    begin = np.searchsorted(col, np.r_[np.arange(n), n])
    while len(order):  # parts of about equal size together, a million places or so
        s = size[order]
        some = order[: max(1, int(((np.arange(1, len(s) + 1) * s.astype(np.int64) ** 2 <= 1_000_000) & (s <= 1.5 * s[0] + 4)).sum()))]
        order = order[len(some) :]
        wide, place = int(size[some].max()), np.repeat(np.arange(len(some)), size[some])
        node = np.repeat(start[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(len(place))
        count = begin[node + 1] - begin[node]
        e = np.repeat(begin[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
        m, of = np.zeros((len(some), wide, wide)), np.repeat(place, count)
        m[of, col[e] - start[some][of], row[e] - start[some][of]] = v[e]
        inn, at = _squared(m), node - start[some][place]
        to[node], flow[node], inflow[node] = start[some][place] + m.argmax(2)[place, at], m.max(2)[place, at], inn[place, at]
    return nodes, to, flow, inflow


def _pointer_ends(to: np.ndarray) -> np.ndarray:
    """As `_ends`."""
    own, before = np.arange(len(to)), None
    while True:
        up = to[to]
        new = np.where(up == own, np.minimum(own, to), up)
        moved = int((new != to).sum())
        if moved and moved == before:
            return np.where(new == to, new, own)
        to, before = new, moved
        if not moved:
            return to


def flow_in_parts(a: np.ndarray, b: np.ndarray, w: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, flow, inflow) of every node: `markov_clusters` and contraction in turn until no link (a, b, w) is left between two clusters.

    part: the connected part of each node, ascending and from 0. Each part goes its own way, so the result doesn't depend on which parts come together.
    """
    n = len(part)
    cluster, flow, inflow, level, stuck = np.arange(n), np.ones(n), np.zeros(n), 0, np.zeros(int(part.max(initial=-1)) + 1, bool)
    while len(a):
        to, f, inn = np.arange(n), np.ones(n), np.zeros(n)
        for strongest in (False, True):  # where a flow has merged nothing: once to the strongest neighbour
            some = stuck[part[a]] == strongest
            if some.any():
                nodes, at, x, y = _flow(a[some], b[some], w[some], part, strongest)
                to[nodes], f[nodes], inn[nodes] = nodes[at], x, y
        to = _pointer_ends(to)
        flow, cluster, inflow = flow * f[cluster], to[cluster], inflow if level else inn
        before = np.bincount(part[a], minlength=len(stuck))
        a, b = to[a], to[b]
        between = a != b
        lo, hi = np.minimum(a, b)[between], np.maximum(a, b)[between]
        key, at = np.unique(lo * n + hi, return_inverse=True)
        a, b, w = key // max(n, 1), key % max(n, 1), np.bincount(at, w[between], len(key))
        stuck, level = np.bincount(part[a], minlength=len(stuck)) == before, level + 1
    return cluster, flow, inflow


def _flow_by_rounds(edges: DataFrame) -> DataFrame:
    """(cluster, attractor, _f, _in): as `flow_in_parts`, with a written table for each round; for parts of any size."""
    at = mark()
    edges = materialize(edges, "edges")
    n, level, stuck = edges.count(), 0, False
    step = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct().select("id", F.col("id").alias("cluster"), F.lit(1.0).alias("flow"), F.lit(0.0).alias("inflow"))
    while n:
        flow = {"entries": None, "rounds": 0, "loops": False} if stuck else {}  # a flow that merges nothing: once to the strongest neighbour
        up = markov_clusters(edges, **flow).select(F.col("id").alias("cluster"), "attractor", F.col("flow").alias("_f"), F.col("inflow").alias("_in"))
        first = F.col("inflow") if level else F.coalesce("_in", "inflow")
        step = step.join(up, "cluster", "left").select("id", F.coalesce("attractor", "cluster").alias("cluster"), (F.col("flow") * F.coalesce("_f", F.lit(1.0))).alias("flow"), first.alias("inflow"))
        step = materialize(step, "member")
        up_a, up_b = up.select(F.col("cluster").alias("a"), F.col("attractor").alias("_a")), up.select(F.col("cluster").alias("b"), F.col("attractor").alias("_b"))
        between = edges.join(up_a, "a").join(up_b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "w")
        edges = materialize(between.groupBy("a", "b").agg(F.sum("w").alias("w")), "edges")
        free(at, step, edges)
        left = edges.count()
        stuck, n, level = left == n, left, level + 1
    return step.select(F.col("id").alias("cluster"), F.col("cluster").alias("attractor"), F.col("flow").alias("_f"), F.col("inflow").alias("_in"))


def _flowed(near: DataFrame, k: int, threshold: float, local_rows: int, driver_links: int) -> DataFrame | None:
    """(cluster, attractor, _f, _in): where flow takes every node that has a link of `threshold` in the lists `near` (`neighbour_lists`); None without such links."""
    spark, since = near.sparkSession, mark()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of whole shards, a list for each of their nodes that has or receives any, with the part it belongs to there; nodes of other shards without a list."""
        for t in key_chunks(batches, 30_000, "shard"):
            x = t.column("near").combine_chunks()
            x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
            own, items = t.column("id").to_numpy(), x.flatten()
            a, b, d = np.repeat(own, np.diff(x.offsets.to_numpy())), items.field("id").to_numpy(), items.field("d").to_numpy()
            w = 1 - d * d / 2
            o = np.flatnonzero(w >= threshold)
            o = o[np.lexsort((b[o], d[o], a[o]))]
            a, b, w = a[o], b[o], w[o]
            at = np.arange(len(a))
            new = np.r_[True, a[1:] != a[:-1]][: len(a)]
            ok = at - np.maximum.accumulate(np.where(new, at, 0)) < k
            a, b, w = a[ok], b[ok], w[ok]
            nodes, at = np.unique(np.r_[a, b], return_inverse=True)
            part = nodes[_parts(at[: len(a)], at[len(a) :], len(nodes))]
            here = np.isin(nodes, own)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(at[: len(a)], minlength=len(nodes))[here])].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"id": pa.array(nodes[here]), "part": pa.array(part[here]), "rows": pa.ListArray.from_arrays(offsets, pa.array(b)), "w": pa.ListArray.from_arrays(offsets, pa.array(w))})
            away = int((~here).sum())
            if away:
                yield pa.RecordBatch.from_pydict({"id": pa.array(nodes[~here]), "part": pa.array(part[~here]), "rows": pa.nulls(away, pa.list_(pa.int64())), "w": pa.nulls(away, pa.list_(pa.float64()))})

    lists = near.repartition(shuffle_width(spark), "shard").sortWithinPartitions("shard").mapInArrow(link, "id bigint, part bigint, rows array<bigint>, w array<double>")
    lists = materialize(lists, "lists")
    free(since, lists)
    if not lists.limit(1).count():
        return None
    mine = lists.where(F.col("rows").isNotNull())
    # a node that a shard names besides its own joins the parts that the two shards have for it
    across = lists.where(F.col("rows").isNull()).select("id", F.col("part").alias("a")).join(mine.select("id", "part"), "id", "left").select("a", F.coalesce("part", "id").alias("b")).where("a <> b").distinct()
    across = materialize(across, "across")
    if across.count() <= driver_links:
        t = across.toArrow()
        name, at = np.unique(np.r_[t.column("a").to_numpy(), t.column("b").to_numpy()], return_inverse=True)
        whole = spark.createDataFrame(pa.table({"part": name, "_whole": name[_parts(*np.split(at, 2), len(name))]}))
    else:
        whole = components(across).select(F.col("id").alias("part"), F.col("component").alias("_whole"))
    whole = materialize(whole, "whole")
    mine = mine.join(small(whole), "part", "left").select("id", F.coalesce("_whole", "part").alias("part"), "rows", "w")
    large = mine.groupBy("part").count().where(F.col("count") > local_rows).select("part")
    large = materialize(large, "large")

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_chunks(batches, 20_000):
            rows, w = (pa.concat_arrays([c for c in t.column(x).chunks]) for x in ("rows", "w"))
            n = np.diff(rows.offsets.to_numpy())
            a, of = np.repeat(t.column("id").to_numpy(), n), np.repeat(t.column("part").to_numpy(), n)
            nodes, at = np.unique(np.r_[a, rows.flatten().to_numpy()], return_inverse=True)
            part = np.empty(len(nodes), np.int64)
            part[at] = np.r_[of, of]
            o = np.lexsort((nodes, part))  # by part, then by id
            place = np.empty(len(o), np.int64)
            place[o] = np.arange(len(o))
            nodes, at = nodes[o], place[at]
            cluster, f, inflow = flow_in_parts(at[: len(a)], at[len(a) :], w.flatten().to_numpy(), np.unique(part[o], return_inverse=True)[1])
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(nodes), "attractor": pa.array(nodes[cluster]), "_f": pa.array(f), "_in": pa.array(inflow)})

    out = "cluster bigint, attractor bigint, _f double, _in double"
    if not large.limit(1).count():
        up = materialize(keyed(mine, ["part"]).mapInArrow(flow, out), "flow")
    else:
        up = keyed(mine.join(F.broadcast(large), "part", "left_anti"), ["part"]).mapInArrow(flow, out)
        rest = mine.join(F.broadcast(large), "part", "left_semi").select(F.col("id").alias("a"), F.explode(F.arrays_zip("rows", "w")).alias("x"))
        up = materialize(up.unionByName(_flow_by_rounds(rest.select("a", F.col("x.rows").alias("b"), F.col("x.w").alias("w")))), "flow")
    free(since, up)
    return up


def cluster_members(vectors: DataFrame, threshold: float = 0.8, k: int = 15, local_rows: int = LOCAL_ROWS, driver_links: int = DRIVER_LINKS) -> DataFrame:
    """(id, cluster, flow, inflow): `cluster_vectors` without the similarities. Parts of the graph with more than `local_rows` records flow by rounds through all tasks."""
    since = mark()
    vectors = vectors if getattr(vectors, "_path", None) else materialize(vectors.select("id", "vec"), "unit")
    member = vectors.select("id", F.col("id").alias("cluster"), F.lit(1.0).alias("flow"), F.lit(0.0).alias("inflow"))
    nodes, level = vectors, 0
    while True:
        some = k if level == 0 else min(k, 4)
        up = _flowed(neighbour_lists(nodes, some, reach=(2 - 2 * threshold) ** 0.5), some, threshold, local_rows, driver_links)
        if up is None:
            return member
        first = F.col("inflow") if level else F.coalesce("_in", "inflow")
        member = member.join(up, "cluster", "left").select("id", F.coalesce("attractor", "cluster").alias("cluster"), (F.col("flow") * F.coalesce("_f", F.lit(1.0))).alias("flow"), first.alias("inflow"))
        member = materialize(member, "member")
        nodes = materialize(vectors.join(member.select(F.col("cluster").alias("id")).distinct(), "id").select("id", "vec"), "nodes")
        free(since, vectors, member, nodes)
        level += 1


def cluster_vectors(vectors: DataFrame, threshold: float = 0.8, k: int = 15) -> DataFrame:
    """(id, cluster, similarity, flow, inflow): the cluster of every usable vector (id BIGINT, vec of length 1), named by its representative, the cosine similarity
    to that, the flow that goes from the vector to its representative along the attractors, and the flow that the vector receives.

    A vector without a neighbour above the threshold is a cluster of its own. Equal vectors are alike. An empty table gives no rows. Levels go on until no two
    representatives are `threshold` similar, as far as the index finds them.
    """
    vectors = materialize(vectors.select("id", "vec"), "unit")
    member = cluster_members(vectors, threshold, k)
    centre = vectors.select(F.col("id").alias("cluster"), F.col("vec").alias("_c"))
    both = member.join(vectors, "id").join(centre, "cluster")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("nd,nd->n", matrix(b.column(2)).astype(np.float64), matrix(b.column(3)).astype(np.float64)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "cluster": b.column(1), "similarity": pa.array(s), "flow": b.column(4), "inflow": b.column(5)})

    return both.select("id", "cluster", "vec", "_c", "flow", "inflow").mapInArrow(cosine, "id bigint, cluster bigint, similarity double, flow double, inflow double")


def cluster_report(members: DataFrame, labels: DataFrame | None = None, typical: int = 3) -> DataFrame:
    """Per cluster: size, its `typical` members (the representative, then those that receive the strongest flow) and, from labels (id, label), the most frequent label not NULL.

    Equal flows are ordered by similarity to the representative, then by id. The members wanted are found by an aggregate that keeps `typical` of each task's rows,
    so a cluster of any size is described without its rows being gathered.
    """
    few = members.withColumn("_t", F.pmod(F.xxhash64("id"), F.lit(256))).withColumn("_k", F.struct(F.col("id") != F.col("cluster"), -F.col("inflow"), -F.col("similarity"), "id"))
    few = few.withColumn("_r", F.row_number().over(W.partitionBy("cluster", "_t").orderBy("_k"))).where(F.col("_r") <= typical).groupBy("cluster").agg(F.collect_list("_k").alias("x"))
    few = few.select("cluster", F.transform(F.slice(F.array_sort("x"), 1, typical), lambda x: x["id"]).alias("typical"))
    out = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(few, "cluster")
    if labels is None:
        return out
    votes = members.join(labels, "id").where(F.col("label").isNotNull()).groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
    return out.join(top, "cluster", "left")


def cell_clusters(df: DataFrame, threshold: float = 0.8, k: int = 15) -> DataFrame:
    return cluster_vectors(usable_vectors(df, unit=True), threshold, k)
