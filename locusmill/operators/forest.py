"""Parent-child rows to full hierarchies: loops set apart, then heavy-path decomposition.

All steps are joins and aggregates over (id, pointer) rows, a logarithmic number of them in depth and size:
pointer doubling finds loops and subtree sizes, the heaviest child of each node continues its chain, doubling along chains gives
each node's chain and place in it, and the chains, whose tree is at most log2(n) levels deep, get their prefix from the top down. Each round carries only the
nodes that it still moves. A node's path is its chain's prefix and a slice of the chain; preorder places run along the chains, heavy child first, so a node's
descendants are the interval of places from its own on, and are looked up by these places.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.util import free, mark, materialize


def parent_of(c: Column | str) -> Column:
    """The one id that a parents field names, stray commas, blanks and repeats disregarded; NULL for null, empty or `.`."""
    c = F.col(c) if isinstance(c, str) else c
    ids = F.filter(F.split(c, r"[,\s]+"), lambda x: (x != "") & (x != "."))
    return F.get(ids, F.lit(0))


def links(df: DataFrame, node: Column, parent: Column) -> DataFrame:
    """(id, parent), one row per id. Of repeated rows of an id the least parent named counts; a parent that no row has is none."""
    rows = df.select(node.alias("id"), parent.alias("parent")).where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("parent"))
    have = rows.select(F.col("id").alias("parent"), F.lit(True).alias("_has"))
    return rows.join(have, "parent", "left").select("id", F.when(F.col("_has"), F.col("parent")).alias("parent"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _sized(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(acyclic nodes (id, parent, size), nodes on or below a loop with the loop's least id (id, root_id)) by doubling of ancestor pointers.

    After t rounds an open node points 2^t steps up and counts the descendants less than 2^t steps below it. A node whose pointer leaves its tree is closed: its count
    is put aside, and what open nodes still add to it is put aside as well, so that only open nodes are written again.
    """
    aside = [nodes.where("parent is null").select("id", F.lit(1).cast("bigint").alias("size"))]
    state, closed = nodes.where("parent is not null").select("id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")), False
    left = state.count()
    while left:
        p = state.select(F.col("id").alias("up"), F.col("up").alias("_up"))
        below = state.groupBy("up").agg(F.sum("size").alias("_below")).withColumnRenamed("up", "id")
        step = state.join(p, "up", "left").join(below, "id", "full")
        # a row without `size` is a closed node that open ones add to
        step = materialize(step.select("id", F.col("_up").alias("up"), (F.coalesce("size", F.lit(0)) + F.coalesce("_below", F.lit(0))).alias("size")), "up")
        aside.append(step.where("up is null").select("id", "size"))
        state = step.where("up is not null")
        now = state.count()
        if now == left:  # nothing ended in this round, so the rest leads into loops
            closed = True
            break
        left = now
    size = _union(aside).groupBy("id").agg(F.sum("size").alias("size"))
    if not closed:
        return nodes.join(size, "id"), nodes.select("id", F.col("id").alias("root_id")).limit(0)
    state = state.select("id", "up")
    trees = nodes.join(state.select("id"), "id", "left_anti").join(size, "id")
    return trees, _loops(nodes.join(state.select("id"), "id", "left_semi").select("id", F.col("parent").alias("up"), F.col("id").alias("lo")))


def _loops(state: DataFrame) -> DataFrame:
    """(id, root_id): the least id on the loop that each node leads to. state: id, up (the parent), lo (the node itself).

    Doubling goes on until a round lessens no `lo` and the nodes pointed at don't become fewer. Then the latter are just the nodes on loops, as some node below a loop
    drops out of them in every round before, and the stretches between a loop's pointers cover all of it.
    """
    state = materialize(state, "loop")
    targets = state.select("up").distinct().count()
    while True:
        p = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("lo").alias("_lo"))
        new = materialize(state.join(p, "up").select("id", F.col("_up").alias("up"), F.least("lo", "_lo").alias("lo"), (F.col("_lo") < F.col("lo")).alias("_less")), "loop")
        less = new.where("_less").limit(1).count()
        state, before, targets = new.select("id", "up", "lo"), targets, new.select("up").distinct().count()
        if not less and targets == before:
            break
    on = state.select(F.col("id").alias("up"), F.col("lo").alias("root_id"))
    return state.join(on, "up").select("id", "root_id")


def _resolve(state: DataFrame, name: str) -> DataFrame:
    """(id, top, off): the end of each node's pointer chain `ptr` and the number of steps to it."""
    start = materialize(state.select("id", "ptr", F.when(F.col("ptr").isNull(), F.col("id")).alias("top"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("bigint").alias("off")), name)
    done, todo = [start.where("top is not null")], start.where("top is null")
    while todo.limit(1).count():
        p = _union([*done, todo]).select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("top").alias("_top"), F.col("off").alias("_off"))
        new = todo.join(p, "ptr").select("id", F.col("_ptr").alias("ptr"), F.col("_top").alias("top"), (F.col("off") + F.col("_off")).alias("off"))
        new = materialize(new, name)
        done.append(new.where("top is not null"))
        todo = new.where("top is null")
    return _union(done).select("id", "top", "off")


def hierarchy(df: DataFrame, node: Column, parent: Column, paths: bool = True, places: bool = True, sibling_blocks: int = 64) -> DataFrame:
    """One row per id: node_id, root_id, depth, parent_id, chain_id, chain_pos, size, with `places` pre, and with `paths` path (ids from the root to the node).

    The descendants of a node, itself included, are the rows of the same root with pre in [its pre, its pre + size - 1]. For a node on a loop or below
    one, depth is -1, root_id the least id on that loop, and the other columns are NULL. Rows without an id are left out; a parent
    that no row has is none; repeated rows count once; an empty input gives an empty result.
    """
    since = mark()
    nodes = materialize(links(df, node, parent), "links")
    trees, loops = _sized(nodes)
    trees, loops = materialize(trees, "trees"), materialize(loops, "loops")
    free(since, trees, loops)
    kids = trees.where("parent is not null")
    heavy = kids.groupBy("parent").agg(F.min(F.struct((-F.col("size")).alias("n"), F.col("id").alias("h"))).alias("_m")).select("parent", F.col("_m.h").alias("heavy"), (-F.col("_m.n")).alias("heavy_size"))
    lit = materialize(kids.join(heavy, "parent"), "kids")
    light = lit.where(F.col("id") != F.col("heavy"))
    if places:
        # light children in two steps of prefix sums, so that a parent of very many children isn't one task's work
        light = light.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(sibling_blocks)).cast("int"))
        blocks = light.groupBy("parent", "_b").agg(F.sum("size").alias("_s")).withColumn("_before", F.sum("_s").over(W.partitionBy("parent").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
        inside = F.sum("size").over(W.partitionBy("parent", "_b").orderBy("id").rowsBetween(W.unboundedPreceding, -1))
        light = light.withColumn("_in", inside).join(blocks.select("parent", "_b", "_before"), ["parent", "_b"])
        delta = [(1 + F.col("heavy_size") + F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias("delta")]
    heads = light.select("id", F.col("parent").alias("q"), *(delta if places else []))

    own = lit.select("id", F.when(F.col("id") == F.col("heavy"), F.col("parent")).alias("ptr"))
    chain = _resolve(own.unionByName(trees.where("parent is null").select("id", F.lit(None).cast("string").alias("ptr"))), "chain")
    at = chain.select(F.col("id").alias("q"), F.col("top").alias("on"), F.col("off").alias("q_off"))
    tree = heads.withColumnRenamed("id", "top").join(at, "q").select("top", "on", "q_off", *(["delta"] if places else []))
    roots = trees.where("parent is null").select(F.col("id").alias("top"))
    if paths:
        segs = materialize(chain.groupBy("top").agg(F.transform(F.array_sort(F.collect_list(F.struct("off", "id"))), lambda x: x["id"]).alias("seg")), "segments")
        tree, roots = tree.join(segs, "top"), roots.join(segs, "top")
    tree = materialize(tree, "chains")
    none = F.array().cast("array<string>")
    base = [F.col("top").alias("root_id"), F.lit(0).cast("bigint").alias("base"), *([F.lit(0).cast("bigint").alias("pre0")] if places else [])]
    front = roots.select("top", *base, *([none.alias("prefix"), "seg"] if paths else []))
    done = [front]
    if tree.limit(1).count():
        while True:
            up = front.select(F.col("top").alias("on"), "root_id", F.col("base").alias("_b"), *([F.col("pre0").alias("_p")] if places else []), *([F.col("prefix").alias("_x"), F.col("seg").alias("_s")] if paths else []))
            cols = ["top", "root_id", (F.col("_b") + F.col("q_off") + 1).alias("base")]
            if places:
                cols.append((F.col("_p") + F.col("q_off") + F.col("delta")).alias("pre0"))
            if paths:
                cols += [F.concat("_x", F.slice("_s", F.lit(1), (F.col("q_off") + 1).cast("int"))).alias("prefix"), "seg"]
            front = materialize(tree.join(up, "on").select(*cols), "front")
            if not front.limit(1).count():
                break
            done.append(front)

    full = trees.join(chain, "id").join(_union(done), "top")
    out = [
        F.col("id").alias("node_id"),
        "root_id",
        (F.col("base") + F.col("off")).cast("int").alias("depth"),
        F.col("parent").alias("parent_id"),
        F.col("top").alias("chain_id"),
        F.col("off").alias("chain_pos"),
        "size",
    ]
    if places:
        out.append((F.col("pre0") + F.col("off")).alias("pre"))
    if paths:
        out.append(F.concat("prefix", F.slice("seg", F.lit(1), (F.col("off") + 1).cast("int"))).alias("path"))
    looped = loops.select(F.col("id").alias("node_id"), "root_id", F.lit(-1).alias("depth"))
    return full.select(*out).unionByName(looped, allowMissingColumns=True)


def descendants(tree: DataFrame, block: int = 4096) -> DataFrame:
    """(node_id, descendant_id, steps) of every node and every proper descendant, from `hierarchy(places=True)`; as many rows as all depths together.

    The places of a node's interval are unfolded and joined with the nodes that have them, an equality on (root, place). Intervals are cut into blocks first and
    spread, so that a root of very many descendants isn't unfolded in one task. Nodes on or below loops have no descendants here.
    """
    t = materialize(tree.where("depth >= 0").select("node_id", "root_id", "depth", "pre", "size"), "places")
    wide = t.where("size > 1").select("node_id", "root_id", "depth", (F.col("pre") + F.col("size") - 1).alias("_to"), F.explode(F.sequence(F.col("pre") + 1, F.col("pre") + F.col("size") - 1, F.lit(block).cast("bigint"))).alias("_from"))
    wide = wide.repartition("node_id", "_from")
    each = wide.select("node_id", "root_id", "depth", F.explode(F.sequence("_from", F.least(F.col("_from") + block - 1, "_to"))).alias("pre"))
    of = t.select("root_id", "pre", F.col("node_id").alias("descendant_id"), F.col("depth").alias("_deep"))
    return each.join(of, ["root_id", "pre"]).select("node_id", "descendant_id", (F.col("_deep") - F.col("depth")).alias("steps"))
