"""Cell by feature matrices as long tables (cell, feature, value) from fragments: tiles, peaks, genes, gene scores, and the choice of features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.operators.intervals import asof_join, overlap_join, point_join
from locusmill.operators.qc import MITO, cuts
from locusmill.operators.regions import region_label
from locusmill.util import materialize, small


def tile_grid(sizes: DataFrame, width: int) -> DataFrame:
    """(chrom, tile, label) of ceil(length / width) tiles per chromosome; labels have an inclusive end that isn't clipped."""
    n = F.ceil(F.col("length") / width)
    t = sizes.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("tile"))
    return t.withColumn("label", tile_label("chrom", "tile", width))


def tile_label(chrom: str, tile: str, width: int) -> Column:
    return F.concat(F.col(chrom), F.lit(":"), F.col(tile) * width, F.lit("-"), (F.col(tile) + 1) * width - 1)


def tile_matrix(frags: DataFrame, width: int = 500, strategy: str = "insertion", sizes: DataFrame | None = None, mito: tuple[str, ...] = MITO) -> DataFrame:
    """(cell, chrom, tile, value): summed count of fragments by tile. insertion (and paired-insertion) counts the tiles of both cuts once each, fragment every tile touched.

    With sizes (chrom, length), other chromosomes and tiles beyond a chromosome's last are left out.
    """
    a, b = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    where = F.sequence(a, b) if strategy == "fragment" else F.array_distinct(F.array(a, b))
    t = frags.where(~F.col("chrom").isin(*mito)).select("cell", "chrom", "count", F.explode(where).alias("tile"))
    if sizes is not None:
        t = t.join(F.broadcast(sizes.select("chrom", F.ceil(F.col("length") / width).alias("_n"))), "chrom").where(F.col("tile") < F.col("_n"))
    return t.groupBy("cell", "chrom", "tile").agg(F.sum("count").cast("bigint").alias("value"))


def peak_matrix(frags: DataFrame, peaks: DataFrame, strategy: str = "insertion", ceiling: int | None = 4, mito: tuple[str, ...] = MITO) -> DataFrame:
    """(cell, feature, value) over peaks (feature, chrom, start, end), each fragment or cut with weight 1, values up to the ceiling.

    insertion: both cuts, each with the last peak that starts at or before it, if that covers it. fragment: every peak that the fragment overlaps.
    """
    f, p = frags.where(~F.col("chrom").isin(*mito)), peaks.select("feature", "chrom", "start", "end")
    hit = overlap_join(f, p) if strategy == "fragment" else asof_join(cuts(f).select("cell", "chrom", "pos"), p)
    n = F.count(F.lit(1))
    return hit.groupBy("cell", F.col("r_feature").alias("feature")).agg((F.least(n, F.lit(ceiling).cast("bigint")) if ceiling else n).alias("value"))


def gene_windows(genes: DataFrame, up: int = 2000, down: int = 0, body: bool = True) -> DataFrame:
    """(gene, chrom, start, end): gene bodies, or TSS, with up bases before and down bases after by strand (other than + is minus); starts at least 0."""
    plus = F.col("strand") == "+"
    a = F.when(plus, F.col("start") - up).otherwise((F.col("start") if body else F.col("end")) - down)
    b = F.when(plus, (F.col("end") if body else F.col("start")) + down).otherwise(F.col("end") + up)
    return genes.select("gene", "chrom", F.greatest(a, F.lit(0)).alias("start"), b.alias("end"))


def gene_matrix(frags: DataFrame, genes: DataFrame, up: int = 2000, down: int = 0, body: bool = True, mito: tuple[str, ...] = MITO) -> DataFrame:
    """(cell, feature, value): cuts within each gene's window, all genes that a cut lies in counted."""
    c = cuts(frags.where(~F.col("chrom").isin(*mito))).select("cell", "chrom", "pos")
    return point_join(c, gene_windows(genes, up, down, body)).groupBy("cell", F.col("r_gene").alias("feature")).agg(F.count(F.lit(1)).alias("value"))


def gene_domains(genes: DataFrame, tile: int = 500, up: tuple[int, int] = (1000, 100_000), down: tuple[int, int] = (1000, 100_000), body_up: int = 5000, body_down: int = 0, boundaries: bool = True, factor: float = 5.0) -> DataFrame:
    """(gene, chrom, body_lo, body_hi, start, end, weight): extended body, regulatory domain [start, end) up to the neighbouring bodies, and the weight for short genes."""
    plus = F.col("strand") == "+"
    g = genes.select("gene", "chrom", "start", "end", plus.alias("plus"))
    g = g.withColumn("body_lo", F.when(F.col("plus"), F.col("start") - body_up).otherwise(F.col("start") - body_down)).withColumn("body_hi", F.when(F.col("plus"), F.col("end") + body_down).otherwise(F.col("end") + body_up))
    width = F.greatest(F.col("body_hi") - F.col("body_lo"), F.lit(1)).cast("double")
    chrom, order = W.partitionBy("chrom"), W.partitionBy("chrom").orderBy("start", "end", "gene")
    g = g.withColumn("_m", 1 / width)
    spread = F.max("_m").over(chrom) - F.min("_m").over(chrom)
    g = g.withColumn("weight", F.greatest(F.lit(1.0), F.least(F.lit(float(factor)), F.when(spread > 0, 1 + F.col("_m") * (factor - 1) / spread).otherwise(1.0))))
    side = lambda i: (F.when(F.col("plus"), up[i]).otherwise(down[i]), F.when(F.col("plus"), down[i]).otherwise(up[i]))
    (min5, min3), (max5, max3) = side(0), side(1)
    lo, hi = F.col("body_lo") - max5, F.col("body_hi") + max3
    if boundaries:
        lo = F.greatest(lo, F.coalesce(F.lag("body_hi").over(order) + tile, lo))
        hi = F.least(hi, F.coalesce(F.lead("body_lo").over(order) - tile, hi))
    lo = F.greatest(F.least(F.col("body_lo") - min5, lo), F.lit(1))
    hi = F.greatest(F.col("body_hi") + min3, hi)
    return g.withColumn("_lo", lo).withColumn("_hi", hi).select("gene", "chrom", "body_lo", "body_hi", F.col("_lo").alias("start"), F.greatest("_hi", F.col("_lo") + 1).alias("end"), "weight")


def gene_scores(frags: DataFrame, genes: DataFrame, tile: int = 500, ceiling: int | None = 4, scale: float | None = 1e4, log: bool = False, exclude: tuple[str, ...] = ("chrY", "chrM"), **domain) -> DataFrame:
    """(cell, feature, value): tiles of a gene's domain, cuts per tile and cell up to the ceiling, weighted by exp(-distance to the body / 5000) + exp(-1) and for short genes; then scaled per cell."""
    a, b = F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile)
    t = frags.select("cell", "chrom", F.explode(F.array_distinct(F.array(a, b))).alias("tile")).groupBy("cell", "chrom", "tile").agg(F.count(F.lit(1)).alias("n"))
    if ceiling:
        t = t.withColumn("n", F.least("n", F.lit(ceiling)))
    dom = gene_domains(genes.where(~F.col("chrom").isin(*exclude)), tile, **domain)
    # the tiles whose middle lies in a domain are known from the domain, so the weights need no look at the fragments
    half = tile // 2
    at = F.sequence(F.ceil((F.col("start") - half) / tile), F.ceil((F.col("end") - half) / tile) - 1, F.lit(1).cast("bigint"))
    w = dom.where(F.ceil((F.col("start") - half) / tile) < F.ceil((F.col("end") - half) / tile)).withColumn("tile", F.explode(at)).withColumn("pos", F.col("tile") * tile + half)
    x = F.greatest(F.lit(0), F.greatest(F.col("body_lo") - (F.col("pos") + half), F.col("pos") - half - F.col("body_hi")))
    w = w.select("chrom", "tile", F.col("gene").alias("feature"), ((F.exp(-x / 5000.0) + math.exp(-1)) * F.col("weight")).alias("w"))
    s = materialize(t.join(small(w), ["chrom", "tile"]).groupBy("cell", "feature").agg(F.sum(F.col("w") * F.col("n")).alias("value")), "scores")
    if scale:
        s = s.join(s.groupBy("cell").agg(F.sum("value").alias("_t")), "cell").withColumn("value", F.col("value") / F.col("_t") * scale).drop("_t")
    return s.withColumn("value", F.log2(F.col("value") + 1)) if log else s


def features_by_presence(x: DataFrame, n: int) -> DataFrame:
    """Features whose score, cells with a positive value + 1e-6 * total / greatest total, is at least the n-th greatest; ties all stay."""
    s = x.groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("cells"), F.sum("value").alias("total"))
    s = s.crossJoin(s.agg(F.greatest(F.max("total"), F.lit(1)).alias("_m"))).withColumn("score", F.col("cells") + F.lit(1e-6) * F.col("total") / F.col("_m"))
    # the n-th greatest score by a top-n, not by a sort of everything into one task
    cut = s.orderBy(F.desc("score")).limit(n).agg(F.min("score").alias("_cut"))
    return s.crossJoin(F.broadcast(cut)).where(F.col("score") >= F.col("_cut")).select("feature", "cells", "total")


def select_features(x: DataFrame, n: int = 500_000, lower: float = 0.005, upper: float = 0.005, whitelist: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """Features by total: zeros and int(q * features) rows at either end dropped, the n greatest kept; those of the blacklist out, those of the whitelist in (if not 0)."""
    from locusmill.operators.stats import global_rank

    s = x.groupBy("feature").agg(F.sum("value").alias("total")).where(F.col("total") > 0)
    r = global_rank(s, ["total", "feature"])
    k = r.count()
    lo, hi = int(lower * k), k - int(upper * k)
    out = r.where((F.col("rank") > lo) & (F.col("rank") <= hi) & (F.col("rank") > hi - n)).select("feature", "total")
    if blacklist is not None:
        out = out.join(blacklist.select("feature"), "feature", "left_anti")
    if whitelist is not None:
        out = out.unionByName(s.join(whitelist.select("feature"), "feature", "left_semi")).distinct()
    return out


def top_features(x: DataFrame, keep: int, quantile: float = 0.995) -> DataFrame:
    """The `keep` features with the greatest totals, those above the quantile of the totals that aren't 0 left out."""
    s = x.groupBy("feature").agg(F.sum("value").alias("total")).where(F.col("total") > 0)
    q = s.agg(F.percentile("total", F.lit(quantile)).alias("_q"))
    return s.crossJoin(F.broadcast(q)).where(F.col("total") <= F.col("_q")).orderBy(F.desc("total"), "feature").limit(keep).select("feature", "total")


def variable_features(x: DataFrame, clusters: DataFrame, n: int, scale: float = 1e4) -> DataFrame:
    """The n features whose log2(mean + 1) varies most between clusters (cell, cluster): cluster sums scaled to `scale`; clusters without the feature count as 0."""
    c = x.join(clusters, "cell").groupBy("cluster", "feature").agg(F.sum("value").alias("v"))
    tot = c.groupBy("cluster").agg(F.sum("v").alias("t"))
    k = tot.count()
    v = F.log2(F.col("v") / F.col("t") * scale + 1)
    s = c.join(F.broadcast(tot), "cluster").groupBy("feature").agg(F.sum(v).alias("a"), F.sum(v * v).alias("b"))
    var = (F.col("b") - F.col("a") * F.col("a") / k) / max(1, k - 1)
    return s.select("feature", var.alias("variance")).orderBy(F.desc("variance"), "feature").limit(n)


def aggregate_members(x: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(metacell, feature, value): mean over the k member cells of members (metacell, cell), absent values being 0."""
    return members.join(x, "cell").groupBy("metacell", "feature").agg((F.sum("value") / k).alias("value"))


def pseudobulk(x: DataFrame, groups: DataFrame, cpm: float = 1e6) -> DataFrame:
    """(group, feature, value): summed over the cells of groups (cell, group), scaled to `cpm` per group."""
    s = x.join(groups, "cell").groupBy("group", "feature").agg(F.sum("value").alias("v"))
    return s.join(s.groupBy("group").agg(F.sum("v").alias("t")), "group").select("group", "feature", (F.col("v") / F.col("t") * cpm).alias("value"))


def coverage_by_group(frags: DataFrame, groups: DataFrame, cut_sites: bool = False, normalise: bool = True, threshold: float = 0.0, shift: tuple[int, int] = (4, -5), sizes: DataFrame | None = None) -> DataFrame:
    """(group, chrom, start, end, value): coverage runs of the fragments, or of their shifted cut sites, of each group's cells, per million of the group's coverage; values below the threshold are dropped."""
    from locusmill.operators.intervals import coverage_runs

    f = frags.join(groups, "cell")
    if cut_sites:
        f = f.withColumn("start", F.explode(F.array(F.col("start") + shift[0], F.col("end") - 1 + shift[1]))).withColumn("end", F.col("start") + 1).where("start >= 0")
        if sizes is not None:
            f = f.join(F.broadcast(sizes.select("chrom", "length")), "chrom").where("start < length")
    runs = coverage_runs(f, ["group", "chrom"], F.col("count").cast("bigint"))
    if not normalise:
        return runs
    t = runs.groupBy("group").agg(F.sum(F.col("value") * (F.col("end") - F.col("start"))).alias("_t"))
    return runs.join(F.broadcast(t), "group").withColumn("value", F.col("value") * 1e6 / F.col("_t")).where(F.col("value") >= threshold).drop("_t")


def labelled(peaks: DataFrame) -> DataFrame:
    """peaks with `feature`, the label chrom:start-end."""
    return peaks.withColumn("feature", region_label())
