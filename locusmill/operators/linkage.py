"""Links between features: peak to gene and peak to peak correlation, per-group markers, motif deviations, background peaks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusmill.operators.stats import bh_fdr, rank_sums, rank_within, seeded, t_test_udf
from locusmill.util import materialize


def _centre(peaks: DataFrame) -> DataFrame:
    return peaks.withColumn("centre", F.floor((F.col("start") + F.col("end")) / 2))


def near_correlations(x: DataFrame, y: DataFrame, left: DataFrame, right: DataFrame, n: int, max_distance: int) -> DataFrame:
    """(chrom, a, b, pos_a, pos_b, correlation, t) of the pairs of left (a, chrom, pos) and right (b, chrom, pos) at most max_distance apart, over n samples: x and y hold the values
    (feature, sample, value) of left's and right's names, absent ones being 0. Pairs without a correlation (a side doesn't vary) are left out.

    Names meet in windows of max_distance along the chromosome: each name of left is in one, each of right in three, as an array of n values, and a window's correlations are a
    product of two matrices, 256 rows at a time. So values are shuffled by name and window, never by pair.
    """
    names = sorted(r[0] for r in x.select("sample").union(y.select("sample")).distinct().collect())
    at = {v: i for i, v in enumerate(names)}

    def vectors(v: DataFrame, places: DataFrame, name: str) -> DataFrame:
        g = v.where(F.col("value") != 0).groupBy(F.col("feature").alias(name)).agg(F.collect_list("sample").alias("s"), F.collect_list(F.col("value").cast("double")).alias("v"))
        return places.select(name, "chrom", F.col("pos").cast("bigint").alias("pos")).join(g, name)

    bin_ = F.floor(F.col("pos") / max(1, max_distance))
    l = vectors(x, left, "a").withColumn("_bin", bin_)  # noqa: E741
    r = vectors(y, right, "b").withColumn("_bin", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)))
    kind_a, kind_b = (t.schema[c].dataType.simpleString() for t, c in ((left, "a"), (right, "b")))
    schema = f"chrom string, a {kind_a}, b {kind_b}, pos_a bigint, pos_b bigint, correlation double"

    def unit(p: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        m = np.zeros((p.num_rows, n))
        for i, (s, v) in enumerate(zip(p.column("s").to_pylist(), p.column("v").to_pylist(), strict=True)):
            m[i, [at[k] for k in s]] = v
        m -= m.mean(1)[:, None]
        size = np.sqrt((m * m).sum(1))
        ok = size > 1e-9
        return m / np.where(ok, size, 1)[:, None], ok

    def one(p: pa.Table, q: pa.Table) -> pa.Table:
        i, j, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if p.num_rows and q.num_rows:
            (a, ok_a), (b, ok_b) = unit(p), unit(q)
            pos_a, pos_b = p.column("pos").to_numpy(), q.column("pos").to_numpy()
            for lo in range(0, len(a), 256):
                x, y = np.nonzero((np.abs(pos_a[lo : lo + 256, None] - pos_b[None]) <= max_distance) & ok_a[lo : lo + 256, None] & ok_b[None])
                c.append((a[lo : lo + 256] @ b.T)[x, y])
                i.append(x + lo)
                j.append(y)
        i, j = pa.array(np.concatenate(i)), pa.array(np.concatenate(j))
        cols = [p.column("chrom").take(i), p.column("a").take(i), q.column("b").take(j), p.column("pos").take(i), q.column("pos").take(j), pa.array(np.clip(np.concatenate(c), -1, 1))]
        return pa.table(cols, names=["chrom", "a", "b", "pos_a", "pos_b", "correlation"])

    c = l.groupBy("chrom", "_bin").cogroup(r.select(F.col("chrom").alias("_c"), "_bin", "b", "pos", "s", "v").groupBy("_c", "_bin")).applyInArrow(one, schema)
    t = F.col("correlation") * F.sqrt(F.lit(float(n - 2)) / F.greatest(1 - F.col("correlation") * F.col("correlation"), F.lit(1e-300)))
    return c.withColumn("t", t)


def peak_to_gene(peak_x: DataFrame, gene_x: DataFrame, peaks: DataFrame, genes: DataFrame, n: int, max_distance: int = 250_000, min_correlation: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """Peaks and genes at most max_distance apart (centre to TSS) with correlated values over n metacells: peak, gene, chrom, tss, distance = centre - tss, correlation, t, p_value, fdr.

    peak_x and gene_x: (feature, sample, value), absent values being 0. Rates are over all pairs in reach, the least |correlation| and alpha are applied after that.
    """
    p, g = _centre(peaks).select(F.col("feature").alias("a"), "chrom", F.col("centre").alias("pos")), genes.select(F.col("gene").alias("b"), "chrom", F.col("tss").alias("pos"))
    c = near_correlations(peak_x, gene_x, p, g, n, max_distance)
    c = c.select(F.col("a").alias("peak"), F.col("b").alias("gene"), "chrom", F.col("pos_b").alias("tss"), (F.col("pos_a") - F.col("pos_b")).alias("distance"), "correlation", "t")
    c = bh_fdr(c.withColumn("p_value", t_test_udf(n - 2)("t")), "p_value")
    return c.where((F.abs("correlation") >= min_correlation) & (F.col("fdr") <= alpha))


def coaccessibility(x: DataFrame, peaks: DataFrame, n: int, max_distance: int = 250_000, min_correlation: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """Pairs of peaks at most max_distance apart (centres; peak_a before peak_b, ties by name) with correlated values over n metacells, as peak_to_gene."""
    p = _centre(peaks).select("feature", "chrom", F.col("centre").alias("pos"))
    c = near_correlations(x, x, p.withColumnRenamed("feature", "a"), p.withColumnRenamed("feature", "b"), n, max_distance)
    c = c.where((F.col("pos_b") > F.col("pos_a")) | ((F.col("pos_b") == F.col("pos_a")) & (F.col("b") > F.col("a"))))
    c = c.select(F.col("a").alias("peak_a"), F.col("b").alias("peak_b"), "chrom", (F.col("pos_b") - F.col("pos_a")).alias("distance"), "correlation", "t")
    c = bh_fdr(c.withColumn("p_value", t_test_udf(n - 2)("t")), "p_value")
    return c.where((F.abs("correlation") >= min_correlation) & (F.col("fdr") <= alpha))


def metacells(near: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(metacell, cell) of n seeds chosen by a hash of the ids of (id, neighbour), each with its neighbours and itself."""
    seeds = near.select("id").distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    m = near.join(F.broadcast(seeds), "id").select(F.col("id").alias("metacell"), F.col("neighbour").alias("cell"))
    return m.unionByName(seeds.select(F.col("id").alias("metacell"), F.col("id").alias("cell")))


def match_background(fg: DataFrame, bg: DataFrame, bias: list[str], k: int = 1, block: int = 256, scaled: bool = False, apart: str | None = None) -> DataFrame:
    """(fg cell, bg cell, rank): for each row of fg (cell, bias...) its k nearest of bg in the standardised bias values, ties by name; a background row may match several.

    Exact. Equal bias values are searched once, and of equal background rows the first k are kept. The rest lies in blocks of about `block` rows along the first bias value (4096 blocks at
    most); a row searches its own block and the next on both sides, and twice as far again until its k-th distance is below that to the nearest block not searched, or all are searched.
    Rows with a bias value that is NULL, NaN or infinite take no part; with fewer than k background rows, all are given. `scaled` values are taken as they are. `match_unique` makes of
    the result one in which no background row comes twice. With `apart`, a column of both tables, a row's partners are only those with another value there (fg and bg may then be one table).
    """
    known = reduce(lambda x, y: x & y, [F.abs(F.col(c).cast("double")) < float("inf") for c in bias])
    side = lambda d, other: d.where(known).select("cell", *bias, (F.col(apart).cast("string") if apart else F.lit(other)).alias("_a"))
    fg, bg = side(fg, "f"), side(bg, "b")
    s = fg.unionByName(bg).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(bias) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    if scaled:
        s = {f"{n}{i}": float(n == "s") for i in range(len(bias)) for n in "ms"}
    z, zs = lambda d, x: d.select("cell", F.col("_a").alias(f"_{x}"), *[((F.col(c) - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) + F.lit(0.0)).alias(f"{x}{i}") for i, c in enumerate(bias)]), [f"z{i}" for i in range(len(bias))]
    a = materialize(z(fg, "z"), "match_fg")
    same = W.partitionBy("_b", *[f"b{i}" for i in range(len(bias))]).orderBy("cell")
    own = ["_z", *zs]
    b = materialize(z(bg, "b").withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k).drop("_r").withColumnRenamed("cell", "bg"), "match_bg")
    m = min(4096, -(-b.count() // block))
    inner = sorted(set(b.approxQuantile("b0", [i / m for i in range(1, m)], 1 / (4 * m)))) if m > 1 else []
    edges, last = np.array([-np.inf, *inner, np.inf]), len(inner)

    @F.pandas_udf(T.IntegerType())
    def at(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges[1:-1], v.to_numpy(float), side="right").astype(np.int32))

    def margin(reach: int):
        """Distance along the first bias value to the nearest block that isn't within reach."""

        @F.pandas_udf(T.DoubleType())
        def f(v: pd.Series, g: pd.Series) -> pd.Series:
            v, g = v.to_numpy(float), g.to_numpy(int)
            return pd.Series(np.minimum(v - edges[np.maximum(g - reach, 0)], edges[np.minimum(g + reach, last) + 1] - v))

        return f

    b = materialize(b.withColumn("_g", at("b0")), "match_blocks")
    sq = lambda c: c * c
    d2 = reduce(lambda x, y: x + y, [sq(F.col(f"z{i}") - F.col(f"b{i}")) for i in range(len(bias))])
    todo, reach, done = a.select(*own).distinct().withColumn("_own", at("z0")), 1, None
    w = W.partitionBy(*own)
    while True:
        q = todo.withColumn("_m", margin(reach)("z0", "_own")).withColumn("_g", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_own") - reach), F.least(F.lit(last), F.col("_own") + reach))))
        r = q.join(b, "_g").where("_z <> _b").withColumn("_d", d2).withColumn("rank", F.row_number().over(w.orderBy("_d", "bg"))).where(F.col("rank") <= k)
        r = r.withColumn("_ok", ((F.count(F.lit(1)).over(w) >= k) & (F.max("_d").over(w) < sq(F.col("_m")))) | (F.col("_m") == float("inf")))
        r = materialize(r.select(*own, "_own", "bg", "rank", "_ok"), "matched")
        ok = r.where("_ok").select(*own, "bg", "rank")
        done = ok if done is None else done.unionByName(ok)
        if reach > last:
            return a.join(done, own).select("cell", "bg", "rank")
        todo = materialize(todo.join(r.where("_ok").select(*own).distinct(), own, "left_anti"), "to_match")
        if todo.isEmpty():
            return a.join(done, own).select("cell", "bg", "rank")
        reach *= 2


def match_unique(near: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(cell, bg, rank) out of near (cell, bg, rank): cells in the order of their names each take the nearest of their candidates that no earlier one took; a cell whose candidates
    are all taken has none. With `by`, columns of near, each of these groups takes turns for itself.

    In rounds: every cell asks for the first candidate that hasn't refused it, and a candidate keeps the first cell by name that asks. All candidates prefer cells in the same order, so
    this ends with just what taking turns gives.
    """
    by = by or []
    cols = [*by, "cell", "bg", "rank"]
    near = materialize(near.select(*cols), "candidates")
    asked = near.where("rank = 1")
    while True:
        first = asked.groupBy(*by, "bg").agg(F.min("cell").alias("_first"))
        asked = materialize(asked.join(first, [*by, "bg"]).select(*cols, (F.col("cell") == F.col("_first")).alias("_kept")), "asked")
        lost = asked.where("not _kept").select(*by, "cell", (F.col("rank") + 1).alias("rank")).join(near, [*by, "cell", "rank"])
        if not lost.limit(1).count():
            return asked.where("_kept").select(*cols)
        asked = asked.where("_kept").select(*cols).unionByName(lost.select(*cols))


def marker_features(x: DataFrame, groups: DataFrame, bias: DataFrame | None = None, k: int = 1, max_cells: int | None = 2000, replace: bool = False, seed: int = 0) -> DataFrame:
    """Per group and feature the rank-sum test of the group's cells against k times as many others, with rates per group.

    groups: (cell, group). With bias (cell, value...) the others are matched in the standardised values (of all cells), each taken once unless `replace`; if none can be matched, and without
    bias, they are all other cells, as many as wanted by a seeded hash. max_cells cells of a group at most are tested, chosen by the hash (a setting of the test; None tests all).
    All groups are tested in one pass over x.
    """
    names = [r[0] for r in groups.select("group").distinct().orderBy("group").collect()]
    cells = materialize(groups.select("cell", "group").withColumn("_h", F.xxhash64("cell", F.lit(seed))), "cells")
    fg = rank_within(cells, ["group"], ["_h", "cell"], "_r")
    fg = materialize((fg if max_cells is None else fg.where(F.col("_r") <= max_cells)).select("cell", "group"), "foreground")
    size = {r.group: r["n"] for r in fg.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [fg.select("group", "cell", F.lit("fg").alias("side"))]
    rest = names
    if bias is not None:
        cols = [c for c in bias.columns if c != "cell"]
        m = bias.join(cells.select("cell"), "cell").agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        z = bias.select("cell", *[((F.col(c) - m[f"m{i}"]) / (m[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(cols)])
        z = materialize(z.join(cells, "cell"), "bias")
        near = match_background(z.join(fg.select("cell"), "cell", "left_semi"), z, cols, k, scaled=True, apart="group")
        near = materialize(near.join(fg, "cell"), "matched")
        taken = near.select("group", "bg").distinct() if replace else match_unique(near, ["group"]).select("group", "bg")
        taken = materialize(taken, "taken")
        parts.append(taken.select("group", F.col("bg").alias("cell"), F.lit("bg").alias("side")))
        found = {r.group for r in taken.select("group").distinct().collect()}
        rest = [g for g in names if g not in found]
    if rest:
        want = F.array(*[F.struct(F.lit(g).alias("_g"), F.lit(k * size[g]).alias("_k")) for g in rest])
        others = cells.select("cell", F.col("group").alias("_own"), "_h", F.inline(want)).where("_own <> _g")
        bg = rank_within(others, ["_g"], ["_h", "cell"], "_r").where("_r <= _k")
        parts.append(bg.select(F.col("_g").alias("group"), "cell", F.lit("bg").alias("side")))
    sides = materialize(reduce(DataFrame.unionByName, parts), "sides")
    return bh_fdr(rank_sums(x, sides), "p_value", by=["group"])


def background_peaks(stats: DataFrame, n: int = 50, bins: int = 25, seed: int = 0) -> DataFrame:
    """(feature, iteration, peer): for every peak of stats (feature, gc, total) n peers of similar GC and log total, drawn with replacement by a seeded hash from its grid cell.

    A grid cell's peaks are numbered, and a draw is a number modulo their count, so no cell is gathered.
    """
    s = stats.agg(F.min("gc").alias("a"), F.max("gc").alias("b"), F.min(F.log1p("total")).alias("c"), F.max(F.log1p("total")).alias("d")).first()
    cell = lambda v, lo, hi: F.least(F.lit(bins - 1), F.floor((v - lo) / ((hi - lo) or 1.0) * bins))
    g = stats.select("feature", cell(F.col("gc"), s.a, s.b).alias("x"), cell(F.log1p("total"), s.c, s.d).alias("y"))
    w = W.partitionBy("x", "y").orderBy("feature")
    g = materialize(g.withColumn("no", F.row_number().over(w) - 1), "grid")
    size = g.groupBy("x", "y").agg(F.count(F.lit(1)).alias("size"))
    d = g.join(F.broadcast(size), ["x", "y"]).withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d = d.select("feature", "iteration", "x", "y", F.pmod(seeded(F.concat_ws(":", "feature", "iteration"), seed), F.col("size")).cast("int").alias("no"))
    return d.join(g.withColumnRenamed("feature", "peer"), ["x", "y", "no"]).select("feature", "iteration", "peer")


#: Rows of (feature, iteration, peer) and of (motif, feature) up to which every task gets them as index arrays.
INDEX_ROWS = 5_000_000


def deviations(x: DataFrame, motifs: DataFrame, peers: DataFrame, index_rows: int = INDEX_ROWS) -> DataFrame:
    """(cell, motif, dev, z): a cell's counts in a motif's peaks against what its depth and the peaks' shares predict, and that scaled by the same of peer peaks.

    x: (cell, feature, value); motifs: (motif, feature); peers: (feature, iteration, peer). Expected E = sum of the peaks' shares of all counts times the cell's
    total; dev = (observed - E) / E; z uses the mean and sample deviation of the peers' summed counts, peak by peak, taken as independent. z is NULL where E or the deviation is 0.

    With up to index_rows rows of peers and of motifs (counted), a cell's counts are gathered once and go through index arrays; beyond that everything is joined by shuffles. Both give the same.
    """
    x = materialize(x.select("cell", "feature", "value"), "x")
    n = peers.agg(F.count_distinct("iteration")).first()[0]
    few = lambda d: d.limit(index_rows + 1).count() <= index_rows
    return (_indexed_deviations if few(peers) and few(motifs) else _joined_deviations)(x, motifs, peers, n)


def _indexed_deviations(x: DataFrame, motifs: DataFrame, peers: DataFrame, n: int) -> DataFrame:
    """Each cell's row is one array; sums over peers go from each peer that has counts to the features that it stands for, and sums over a motif's features follow."""
    kind = x.schema["cell"].dataType.simpleString()
    total = x.agg(F.sum("value").alias("t")).first().t
    named = motifs.join(x.select("feature").distinct(), "feature", "left_semi").select("motif").distinct()
    m, p = motifs.join(named, "motif").select("motif", "feature").toPandas(), peers.select("feature", "peer").toPandas()
    names = pd.unique(pd.concat([m["feature"], p["feature"], p["peer"]]))
    at = pd.Series(np.arange(len(names)), names)
    motif_names, motif_of = np.unique(m["motif"].to_numpy(), return_inverse=True) if len(m) else (np.zeros(0, object), np.zeros(0, np.int64))
    order = np.argsort(motif_of, kind="stable")
    member = at[m["feature"]].to_numpy()[order]
    first = np.searchsorted(motif_of[order], np.arange(len(motif_names)))
    stands = np.argsort(at[p["peer"]].to_numpy(), kind="stable")
    stands_for, of_peer = at[p["feature"]].to_numpy()[stands].astype(np.int32), at[p["peer"]].to_numpy()[stands]
    lo, hi = np.searchsorted(of_peer, np.arange(len(names))), np.searchsorted(of_peer, np.arange(len(names)), side="right")
    # places of the features in the index, as a table that is joined, so that names aren't looked up row by row in Python
    place = x.sparkSession.createDataFrame(pd.DataFrame({"feature": names, "_i": np.arange(len(names), dtype=np.int32)}), f"feature {x.schema['feature'].dataType.simpleString()}, _i int")
    cells = x.join(F.broadcast(place), "feature", "left").groupBy("cell").agg(F.sum("value").cast("double").alias("depth"), F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", F.col("value").cast("double").alias("v")))).alias("x"))
    share = np.zeros(len(names))
    for r in x.join(F.broadcast(place), "feature").groupBy("_i").agg((F.sum("value") / total).alias("share")).toLocalIterator():
        share[r._i] = r.share
    size = len(names)
    expected = np.add.reduceat(share[member], first) if len(first) else np.zeros(0)

    def run(batches):
        for b in batches:
            if not b.num_rows or not len(first):
                continue
            col = b.column(2)
            cuts, flat = col.offsets.to_numpy(), col.flatten()
            idx, val = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            depth = b.column(1).to_numpy()
            dev, z = np.empty((b.num_rows, len(first))), np.empty((b.num_rows, len(first)))
            for i in range(b.num_rows):
                k, v = idx[cuts[i] - cuts[0] : cuts[i + 1] - cuts[0]], val[cuts[i] - cuts[0] : cuts[i + 1] - cuts[0]]
                own = np.bincount(k, v, size)
                count = hi[k] - lo[k]
                to = stands_for[np.repeat(lo[k] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                w = np.repeat(v, count)
                s, ss = np.bincount(to, w, size), np.bincount(to, w * w, size)
                obs, mu, var = (np.add.reduceat(a[member], first) for a in (own, s / n, (ss - s * s / n) / max(1, n - 1)))
                e = expected * depth[i]
                with np.errstate(divide="ignore", invalid="ignore"):
                    dev[i] = np.where(e > 0, (obs - e) / e, np.nan)
                    z[i] = np.where((e > 0) & (var > 0), (obs - mu) / np.sqrt(var), np.nan)
            rows = pa.array(np.repeat(np.arange(b.num_rows), len(first)))
            yield pa.RecordBatch.from_pydict({"cell": b.column(0).take(rows), "motif": pa.array(np.tile(motif_names, b.num_rows), pa.string()), "dev": pa.array(dev.ravel(), from_pandas=True), "z": pa.array(z.ravel(), from_pandas=True)})

    return cells.mapInArrow(run, f"cell {kind}, motif string, dev double, z double")


def _joined_deviations(x: DataFrame, motifs: DataFrame, peers: DataFrame, n: int) -> DataFrame:
    total = x.agg(F.sum("value").alias("t")).first().t
    share = x.groupBy("feature").agg((F.sum("value") / total).alias("share"))
    depth = x.groupBy("cell").agg(F.sum("value").alias("depth"))
    per_motif = motifs.join(share, "feature").groupBy("motif").agg(F.sum("share").alias("share"))
    obs = motifs.join(x, "feature").groupBy("motif", "cell").agg(F.sum("value").alias("obs"))
    # peers' counts per (peak, cell); peers without counts are zeros
    p = peers.join(x.withColumnRenamed("feature", "peer"), "peer").groupBy("feature", "cell").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    p = p.select("feature", "cell", (F.col("s") / n).alias("mu"), ((F.col("ss") - F.col("s") * F.col("s") / n) / max(1, n - 1)).alias("var"))
    bg = motifs.join(p, "feature").groupBy("motif", "cell").agg(F.sum("mu").alias("mu"), F.sum("var").alias("var"))
    # every motif for every cell is the result itself: the motifs are unfolded from one row
    all_motifs = per_motif.agg(F.collect_list(F.struct("motif", "share")).alias("_m"))
    grid = depth.crossJoin(F.broadcast(all_motifs)).select("cell", "depth", F.inline("_m"))
    j = grid.join(obs, ["motif", "cell"], "left").join(bg, ["motif", "cell"], "left").fillna(0, ["obs", "mu", "var"])
    e = F.col("share") * F.col("depth")
    ok = e > 0
    return j.select(
        "cell",
        "motif",
        F.when(ok, (F.col("obs") - e) / e).alias("dev"),
        F.when(ok & (F.col("var") > 0), (F.col("obs") - F.col("mu")) / F.sqrt("var")).alias("z"),
    )


def sampled_deviations(x: DataFrame, motifs: DataFrame, peers: DataFrame) -> DataFrame:
    """(motif, cell, mean, sd) of the peers' summed counts over iterations, each iteration as a whole set of peers."""
    n = peers.agg(F.count_distinct("iteration")).first()[0]
    s = motifs.join(peers, "feature").groupBy("motif", "iteration", F.col("peer").alias("feature")).agg(F.count(F.lit(1)).alias("k"))
    v = s.join(x, "feature").groupBy("motif", "cell", "iteration").agg(F.sum(F.col("k") * F.col("value")).alias("v"))
    a = v.groupBy("motif", "cell").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    return a.select("motif", "cell", (F.col("s") / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - F.col("s") * F.col("s") / n) / max(1, n - 1))).alias("sd"))


def rank_sites(frags: DataFrame, sites: DataFrame, groups: DataFrame, target: str, flank: int = 200) -> DataFrame:
    """sites (feature, chrom, start, end) with the number of cuts of the target group's cells within flank of their middle, most first."""
    from locusmill.operators.intervals import point_join
    from locusmill.operators.qc import cuts

    f = frags.join(groups.where(F.col("group") == target).select("cell"), "cell", "left_semi")
    m = F.floor((F.col("start") + F.col("end")) / 2)
    w = sites.select("feature", "chrom", (m - flank).alias("start"), (m + flank).alias("end"))
    n = point_join(cuts(f), w).groupBy(F.col("r_feature").alias("feature")).agg(F.count(F.lit(1)).alias("cuts"))
    return sites.select("feature").join(n, "feature", "left").fillna(0, ["cuts"]).orderBy(F.desc("cuts"), "feature")
