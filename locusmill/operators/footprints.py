"""Footprints of binding sites: cut bias by k-mer, aggregate profiles per motif and group, profiles at several scales, bias-corrected signal and differential binding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusmill.operators.intervals import point_join
from locusmill.operators.motifs import kmers
from locusmill.operators.qc import cuts
from locusmill.operators.signal import edge_centre


def kmer_bias(cut_kmers: DataFrame, genome_kmers: DataFrame, clip: tuple[float, float] = (1e-3, 1e3)) -> DataFrame:
    """(kmer, bias): cuts at a k-mer over those expected from its share of the genome's k-mers; 1 where none are expected. Inputs: (kmer, n)."""
    t = cut_kmers.agg(F.sum("n")).first()[0] or 0
    g = genome_kmers.agg(F.sum("n")).first()[0] or 1
    j = genome_kmers.withColumnRenamed("n", "g").join(cut_kmers, "kmer", "full").fillna(0, ["n", "g"])
    e = F.col("g") * (t / g)
    return j.select("kmer", F.when(e > 0, F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), F.col("n") / e))).otherwise(1.0).alias("bias"))


def kmer_counts(seqs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, n) over all sequences."""
    return seqs.select(F.explode(kmers(seq, k)).alias("kmer")).where("kmer is not null").groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def cut_kmer_counts(cut_sites: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n): the k-mer around each cut (chrom, pos) within sequences (chrom, start, end, seq)."""
    j = point_join(cut_sites, seqs)
    at = F.col("pos") - F.col("r_start") - k // 2
    s = j.where((at >= 0) & (at + k <= F.length("r_seq"))).select(F.upper(F.substr("r_seq", (at + 1).cast("int"), F.lit(k))).alias("kmer"))
    return s.where(F.col("kmer").rlike("^[ACGT]+$")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def footprint_profile(frags: DataFrame, sites: DataFrame, groups: DataFrame, flank: int = 250) -> DataFrame:
    """(motif, group, offset, signal, se, n_sites): mean cuts and its standard error by offset -flank..flank over all sites (motif, chrom, pos, strand) of a motif, flipped on the minus strand, sites without cuts included; offsets without cuts have 0."""
    f = frags.join(groups, "cell")
    s = sites.withColumn("start", F.col("pos") - flank).withColumn("end", F.col("pos") + flank + 1).withColumn("site", F.col("pos")).drop("pos")
    j = point_join(cuts(f).select("group", "chrom", "pos"), s)
    d = F.col("pos") - F.col("r_site")
    off = F.when(F.col("r_strand") == "-", -d).otherwise(d)
    per_site = j.groupBy(F.col("r_motif").alias("motif"), "group", "r_chrom", "r_site", "r_strand", off.alias("offset")).agg(F.count(F.lit(1)).alias("n"))
    a = per_site.groupBy("motif", "group", "offset").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"))
    n = sites.groupBy("motif").agg(F.count(F.lit(1)).alias("n_sites"))
    names = groups.select("group").distinct().agg(F.collect_list("group").alias("_g"))
    grid = n.crossJoin(F.broadcast(names)).select("motif", "n_sites", F.explode("_g").alias("group")).withColumn("offset", F.explode(F.sequence(F.lit(-flank).cast("bigint"), F.lit(flank).cast("bigint"))))
    g = grid.join(a, ["motif", "group", "offset"], "left").fillna(0, ["s", "ss"])
    m = F.col("s") / F.col("n_sites")
    var = (F.col("ss") - F.col("s") * m) / F.greatest(F.col("n_sites") - 1, F.lit(1))
    return g.select("motif", "group", "offset", m.alias("signal"), F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n_sites")).alias("se"), "n_sites")


def normalise_profile(profile: DataFrame, flank: int = 250, width: int = 50, how: str = "divide") -> DataFrame:
    """profile with `norm`: signal over (or less) the mean of the outermost `width` offsets on both sides."""
    m = profile.where(F.abs("offset") > flank - width).groupBy("motif", "group").agg(F.avg("signal").alias("_f"))
    e = F.col("signal") - F.col("_f") if how == "subtract" else F.col("signal") / F.nullif("_f", F.lit(0.0))
    return profile.join(m, ["motif", "group"]).withColumn("norm", e).drop("_f")


def multi_scale(profile: DataFrame, scales: list[int], statistic: str = "log2_odds", pseudo: float = 1.0, power: float = 5.0) -> DataFrame:
    """(motif, group, scale, offset, value) of centre against edge signal around each offset at every scale: log2_ratio, log2_odds, amplitude or pvalue_log10; the mean of the outer quarter is
    taken off, and places with fewer than `power` cuts in the window have 0."""

    def one(p):
        p = p.sort_values("offset")
        x = p["signal"].to_numpy() * p["n_sites"].to_numpy()
        outer = np.abs(p["offset"].to_numpy()) > p["offset"].abs().max() * 0.75
        parts = []
        for s in scales:
            edge, centre, we, wc = edge_centre(x, s)
            me, mc = (edge + pseudo) / we, (centre + pseudo) / wc
            if statistic == "amplitude":
                v = me - mc
            elif statistic == "log2_ratio":
                v = np.log2(me / mc)
            elif statistic == "pvalue_log10":
                n = edge + centre
                q = wc / (we + wc)
                z = (centre - n * q) / np.sqrt(np.maximum(n * q * (1 - q), 1e-9))
                v = -np.log10(np.maximum([0.5 * math.erfc(-t / math.sqrt(2)) for t in z], 1e-20))
            else:
                o = (centre + pseudo) / (edge + pseudo)
                v = -np.log2(o * we / wc)
            v = v - v[outer].mean()
            v = np.where(edge + centre < power, 0.0, v)
            parts.append(pd.DataFrame({"motif": p["motif"].iloc[0], "group": p["group"].iloc[0], "scale": s, "offset": p["offset"].to_numpy(), "value": v}))
        return pd.concat(parts)

    return profile.groupBy("motif", "group").applyInPandas(one, "motif string, group string, scale int, offset bigint, value double")


def footprint_score(ms: DataFrame, near: int = 5, scales: tuple[int, int] = (20, 40)) -> DataFrame:
    """(motif, group, score): mean value at offsets up to `near` and scales within the range."""
    return ms.where((F.abs("offset") <= near) & F.col("scale").between(*scales)).groupBy("motif", "group").agg(F.avg("value").alias("score"))


def corrected_signal(cut_counts: DataFrame, bias: DataFrame, window: int = 100) -> DataFrame:
    """cut_counts (region, pos, n) with bias (region, pos, bias): `expected` = the window's cuts by the place's share of the window's bias, `corrected` = what exceeds it, scaled to the region's cuts."""

    def one(p):
        p = p.sort_values("pos")
        n, b = p["n"].to_numpy(float), p["bias"].to_numpy(float)
        k = np.ones(min(window, len(n)))
        e = np.convolve(n, k, "same") * b / np.maximum(np.convolve(b, k, "same"), 1e-12)
        c = np.maximum(n - e, 0)
        c = c * (n.sum() / c.sum() if c.sum() > 0 else 0)
        return pd.DataFrame({"region": p["region"], "pos": p["pos"], "n": n, "expected": e, "corrected": c})

    return cut_counts.join(bias, ["region", "pos"]).groupBy("region").applyInPandas(one, "region string, pos bigint, n double, expected double, corrected double")


def base_weights(counts: DataFrame, background: DataFrame, pseudo: float = 1.0) -> DataFrame:
    """(pos, base, weight): log2 of (count + pseudo) / (column mean total + 4 pseudo) over the same of the background. Inputs: (pos, base, n)."""

    def share(d, name):
        t = d.groupBy("pos").agg(F.sum("n").alias("t")).agg(F.avg("t")).first()[0] or 0
        return d.select("pos", "base", ((F.col("n") + pseudo) / (t + 4 * pseudo)).alias(name))

    return share(counts, "a").join(share(background, "b"), ["pos", "base"]).select("pos", "base", F.log2(F.col("a") / F.col("b")).alias("weight"))


def pair_counts(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """(m, n, base_m, base_n, count) of all pairs of places m < n of equally long short sequences."""
    a = F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.struct(i.alias("p"), F.upper(F.substr(seq, i, F.lit(1))).alias("b")))
    s = seqs.select(a.alias("a")).select("a", F.explode("a").alias("x")).select("x", F.explode("a").alias("y")).where("x.p < y.p")
    return s.groupBy(F.col("x.p").alias("m"), F.col("y.p").alias("n"), F.col("x.b").alias("base_m"), F.col("y.b").alias("base_n")).agg(F.count(F.lit(1)).alias("count"))


def score_sites(sites: DataFrame, a: str, b: str, threshold: dict[str, float]) -> DataFrame:
    """sites with scores of two conditions rounded and cut at 0, whether each is bound, and log2_fc; sites without a score above 0 are left out."""
    r = lambda c: F.greatest(F.lit(0.0), F.round(c, 5))
    s = sites.withColumn(a, r(a)).withColumn(b, r(b)).where((F.col(a) > 0) | (F.col(b) > 0))
    s = s.withColumn(f"{a}_bound", F.col(a) > threshold[a]).withColumn(f"{b}_bound", F.col(b) > threshold[b])
    return s.withColumn("log2_fc", F.log2((F.col(a) + 0.001) / (F.col(b) + 0.001)))


def differential_binding(sites: DataFrame, background: DataFrame, n: int = 100, seed: int = 1) -> DataFrame:
    """(motif, n, mean, change, p_value): change = (mean log2_fc of a motif's sites - background mean) / mean of both deviations; p by a t-test of n changes simulated from the background's normal distribution."""
    g = background.agg(F.avg("log2_fc").alias("m"), F.stddev_pop("log2_fc").alias("s")).first()
    m0, s0 = g.m or 0.0, g.s or 1.0
    a = sites.groupBy("motif").agg(F.count(F.lit(1)).alias("n"), F.avg("log2_fc").alias("mean"), F.stddev_pop("log2_fc").alias("sd"))
    a = a.withColumn("change", (F.col("mean") - m0) / F.nullif((F.col("sd") + s0) / 2, F.lit(0.0)))

    @F.pandas_udf(T.DoubleType())
    def p(k: pd.Series, change: pd.Series) -> pd.Series:
        from locusmill.operators.stats import t_two_sided

        def one(k, c):
            # the mean and deviation of k normal draws, simulated without drawing k values
            rng = np.random.default_rng(seed)
            k = int(k)
            mean = rng.normal(m0, s0 / math.sqrt(k), n)
            sd = s0 * np.sqrt(rng.chisquare(max(k - 1, 1), n) / max(k, 1))
            x = (mean - m0) / ((sd + s0) / 2)
            t = (x.mean() - c) / (x.std(ddof=1) / math.sqrt(n) or 1e-12)
            return t_two_sided(t, n - 1)

        return pd.Series([None if c is None or c != c else one(a, c) for a, c in zip(k, change, strict=True)], dtype=float)

    return a.select("motif", "n", "mean", "change", p("n", "change").alias("p_value"))


def bound_threshold(scores: DataFrame, col: str, p: float = 0.001) -> float:
    """The score above which a site is bound: the greater component of a two-part mixture of ln scores, at its upper tail of the lesser component."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    d = scores.where(F.col(col) > 0).select(array_to_vector(F.array(F.log(col))).alias("features"))
    m = GaussianMixture(k=2, seed=1).fit(d)
    low = min(m.gaussians, key=lambda g: g.mean[0])
    from statistics import NormalDist

    return float(math.exp(low.mean[0] + NormalDist().inv_cdf(1 - p) * math.sqrt(low.cov.toArray()[0, 0])))


def pair_weights(counts: DataFrame, background: DataFrame) -> DataFrame:
    """(m, n, base_m, base_n, weight) of pair_counts of cuts over those of the background: log2 of their smoothed shares. A pair of places gets max(16, its total) pseudo counts in proportion to its marginals."""

    def share(d, name):
        from pyspark.sql import Window as W

        at = W.partitionBy("m", "n")
        t = F.sum("count").over(at)
        a, b = F.sum("count").over(W.partitionBy("m", "n", "base_m")), F.sum("count").over(W.partitionBy("m", "n", "base_n"))
        extra = F.greatest(F.lit(16), t)
        return d.select("m", "n", "base_m", "base_n", ((F.col("count") + extra * a * b / (t * t)) / (t + extra)).alias(name))

    on = ["m", "n", "base_m", "base_n"]
    return share(counts, "x").join(share(background, "y"), on).select(*on, F.log2(F.col("x") / F.col("y")).alias("weight"))


def region_pvalues(counts: DataFrame, scales: list[int], smooth: int | None = None) -> DataFrame:
    """(region, scale, pos, value) of signal.footprint_pvalues at several scales (the radius of centre and flank) over counts (region, pos, n, bias)."""
    from locusmill.operators.signal import footprint_pvalues

    def one(p):
        p = p.sort_values("pos")
        x, b = p["n"].to_numpy(float), p["bias"].to_numpy(float)
        return pd.concat([pd.DataFrame({"region": p["region"], "scale": s, "pos": p["pos"], "value": footprint_pvalues(x, b, s, s, smooth)}) for s in scales])

    return counts.groupBy("region").applyInPandas(one, "region string, scale int, pos bigint, value double")
