"""Signal tracks as runs (chrom, start, end, value): binned means, matrices around anchors, per-base arrays, rolling and footprint kernels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusmill.operators.intervals import overlap_join


def _mean(j: DataFrame, keys: list[str]) -> DataFrame:
    ov = F.least("end", "r_end") - F.greatest("start", "r_start")
    return j.groupBy(*keys).agg((F.sum(F.col("r_value") * ov) / F.sum(ov)).alias("value"), F.sum(ov).alias("covered"))


def windows(sizes: DataFrame, width: int, step: int | None = None) -> DataFrame:
    """(chrom, start, end) every `step` bases of each chromosome of sizes (chrom, length); the last ones are short."""
    s = sizes.select("chrom", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(step or width).cast("bigint"))).alias("start"))
    return s.select("chrom", "start", F.least(F.col("start") + width, "length").alias("end"))


def score_per_bin(track: DataFrame, bins: DataFrame) -> DataFrame:
    """bins (chrom, start, end) with `value`, the mean over the bases that the track covers, NULL where it covers none."""
    m = _mean(overlap_join(bins.select("chrom", "start", "end").distinct(), track.select("chrom", "start", "end", "value")), ["chrom", "start", "end"])
    return bins.join(m.drop("covered"), ["chrom", "start", "end"], "left")


def score_per_bin_wide(tracks: dict[str, DataFrame], bins: DataFrame) -> DataFrame:
    """bins with one column of means for each track."""
    out = bins
    for name, t in tracks.items():
        out = score_per_bin(t, out).withColumnRenamed("value", name)
    return out


def correlation(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of two columns, absent values being 0."""
    return wide.agg(F.corr(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))).alias("correlation"))


def region_stats(track: DataFrame, regions: DataFrame, key: str, min_length: int = 200) -> DataFrame:
    """(key, mean, min, max, covered) of the track over regions of at least min_length bases; NULL where uncovered."""
    r = regions.where(F.col("end") - F.col("start") >= min_length).select(key, "chrom", "start", "end")
    ov = F.least("end", "r_end") - F.greatest("start", "r_start")
    j = overlap_join(r, track.select("chrom", "start", "end", "value")).groupBy(key).agg((F.sum(F.col("r_value") * ov) / F.sum(ov)).alias("mean"), F.min("r_value").alias("min"), F.max("r_value").alias("max"), F.sum(ov).alias("covered"))
    return r.select(key).join(j, key, "left")


def anchor_window(regions: DataFrame, anchor: str = "center", up: int = 3000, down: int = 3000) -> DataFrame:
    """regions with start, end of the window around an anchor: center, start, end, 5p, 3p (by strand), or body; starts at least 0."""
    minus = F.col("strand") == "-"
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    at = {"center": mid, "start": F.col("start"), "end": F.col("end"), "5p": F.when(minus, F.col("end")).otherwise(F.col("start")), "3p": F.when(minus, F.col("start")).otherwise(F.col("end"))}
    u, d = F.when(minus, down).otherwise(up), F.when(minus, up).otherwise(down)
    a, b = (F.col("start") - u, F.col("end") + d) if anchor == "body" else (at[anchor] - u, at[anchor] + d)
    return regions.withColumn("_a", F.greatest(a, F.lit(0))).withColumn("end", b).withColumn("start", F.col("_a")).drop("_a")


def region_matrix(track: DataFrame, regions: DataFrame, key: str, nbins: int = 100, anchor: str = "center", up: int = 3000, down: int = 3000) -> DataFrame:
    """(key, bin, value) of nbins bins of equal width over each region's window, uncovered bases being 0, bins of minus regions counted from their end.

    A window whose width isn't a multiple of nbins loses its last bases.
    """
    w = anchor_window(regions, anchor, up, down).withColumn("_w", F.floor((F.col("end") - F.col("start")) / nbins)).where("_w > 0")
    b = w.select(key, "chrom", "strand", "_w", F.col("start").alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("_b"))
    b = b.select(key, "chrom", F.when(F.col("strand") == "-", nbins - 1 - F.col("_b")).otherwise(F.col("_b")).alias("bin"), (F.col("_s") + F.col("_b") * F.col("_w")).alias("start"), (F.col("_s") + (F.col("_b") + 1) * F.col("_w")).alias("end"))
    ov = F.least("end", "r_end") - F.greatest("start", "r_start")
    v = overlap_join(b, track.select("chrom", "start", "end", "value")).groupBy(key, "bin").agg((F.sum(F.col("r_value") * ov / (F.col("end") - F.col("start")))).alias("value"))
    return b.select(key, "bin").join(v, [key, "bin"], "left").fillna(0.0, ["value"])


def shifted_matrix(track: DataFrame, regions: DataFrame, key: str, nbins: int = 100, side: str = "5p", shift: int = 2000, up: int = 3000, down: int = 3000) -> DataFrame:
    """region_matrix around a place `shift` bases before the 5p or after the 3p end."""
    minus = F.col("strand") == "-"
    out = F.when(minus, 1).otherwise(-1) * (shift if side == "5p" else -shift)
    at = (F.when(minus, F.col("end")).otherwise(F.col("start")) if side == "5p" else F.when(minus, F.col("start")).otherwise(F.col("end"))) + out
    r = regions.withColumn("_at", at).withColumn("start", F.col("_at")).withColumn("end", F.col("_at")).drop("_at")
    return region_matrix(track, r, key, nbins, "start", up, down)


def mean_profile(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("bin").agg(F.avg("value").alias("value"))


def region_arrays(track: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """(key, signal): per-base values of each region, 0 where uncovered, reversed on the minus strand. Regions are short (some thousand bases)."""
    runs = overlap_join(regions.select(key, "chrom", "start", "end", "strand"), track.select("chrom", "start", "end", "value"))
    g = runs.groupBy(key).agg(F.collect_list(F.struct((F.greatest("start", "r_start") - F.col("start")).alias("a"), (F.least("end", "r_end") - F.col("start")).alias("b"), F.col("r_value").cast("double").alias("v"))).alias("runs"))
    j = regions.select(key, (F.col("end") - F.col("start")).cast("int").alias("n"), (F.col("strand") == "-").alias("minus")).join(g, key, "left")

    def run(parts):
        for p in parts:
            out = []
            for n, minus, runs in zip(p["n"], p["minus"], p["runs"], strict=True):
                x = np.zeros(n)
                for r in runs if runs is not None else []:
                    x[r["a"] : r["b"]] += r["v"]
                out.append(x[::-1] if minus else x)
            yield pd.DataFrame({key: p[key], "signal": out})

    return j.mapInPandas(run, f"`{key}` {regions.schema[key].dataType.simpleString()}, signal array<double>")


# kernels on a single array


def rolling(x: np.ndarray, w: int, how: str) -> np.ndarray:
    """Rolling statistic of full windows, placed at i + w // 2: sum and mean are 0 at the edges; max, min and prod use the part of the window that lies inside."""
    n = len(x)
    if how in ("sum", "mean"):
        out = np.zeros(n)
        if n >= w:
            c = np.r_[0, np.cumsum(x)]
            s = c[w:] - c[:-w]
            out[w // 2 : w // 2 + len(s)] = s / w if how == "mean" else s
        return out
    f = {"max": np.max, "min": np.min, "prod": np.prod}[how]
    return np.array([f(x[max(0, i - w // 2) : min(n, i - w // 2 + w)]) for i in range(n)])


def sliding_sum(x: np.ndarray, w: int) -> np.ndarray:
    """Centred sum with zeros outside: w // 2 places before and w - w // 2 - 1 after."""
    p = np.r_[0, np.cumsum(np.r_[np.zeros(w // 2), x, np.zeros(w - w // 2 - 1)])]
    return p[w:] - p[:-w]


def edge_centre(x: np.ndarray, scale: int, factor: float = 3.0) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(edge sums, centre sums, edge width, centre width): an odd total width of at least scale + 2 around a centre of `scale`."""
    total = max(round(factor * scale), scale + 2)
    total += 1 - total % 2
    centre = sliding_sum(x, scale)
    return sliding_sum(x, total) - centre, centre, total - scale, scale


def half_open_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Sum over the places p - n .. p + n - 1, zeros outside."""
    c = np.r_[0, np.cumsum(np.r_[np.zeros(n), x, np.zeros(n)])]
    return c[2 * n : 2 * n + len(x)] - c[: len(x)]


def window_sums(x: np.ndarray, foot: int, flank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left flank, centre, right flank) sums around each place: a centre of 2 * foot and flanks of 2 * (flank // 2) places next to it, zeros outside."""
    half = flank // 2
    shift, gap = foot + half, np.zeros(foot + half)
    left = half_open_sum(np.r_[gap, x], half)[: len(x)]
    right = half_open_sum(np.r_[x, gap], half)[shift : shift + len(x)]
    return left, half_open_sum(x, foot), right


def footprint_pvalues(cuts: np.ndarray, bias: np.ndarray, foot: int, flank: int, smooth: int | None = None) -> np.ndarray:
    """-log10 of the greater of both sides' probabilities that the centre has as few of the cuts as it has, given the shares of the bias; 0 where a side has no cuts.

    Each place then takes the greatest of the 2 * smooth places from smooth - 1 before to smooth after it, and these are averaged over as many. smooth is foot // 2, at least 1, by
    default; 0 leaves the scores as they are.
    """
    left, mid, right = window_sums(cuts, foot, flank)
    bl, bm, br = window_sums(bias, foot, flank)

    def side(n, b):
        total, share = n + mid, bm / np.maximum(b + bm, 1e-12)
        sd = np.sqrt(np.maximum(total * share * (1 - share), 1e-12))
        z = (mid - total * share) / sd
        return np.where(total >= 1, [0.5 * math.erfc(-v / math.sqrt(2)) for v in z], 1.0)

    s = -np.log10(np.clip(np.maximum(side(left, bl), side(right, br)), 1e-20, 1.0))
    smooth = max(foot // 2, 1) if smooth is None else smooth
    if smooth:
        wide = np.pad(s, (smooth - 1, smooth), constant_values=-np.inf)
        s = half_open_sum(np.lib.stride_tricks.sliding_window_view(wide, 2 * smooth).max(1), smooth) / (2 * smooth)
    return s


def footprint_score(x: np.ndarray, flank: tuple[int, int] = (10, 30), fp: tuple[int, int] = (20, 50)) -> np.ndarray:
    """At each place the greatest over flank and footprint widths of the mean of positive flank signal less the mean of negative centre signal, spread over the footprint."""
    n = len(x)
    pos, neg = np.r_[0, np.cumsum(np.maximum(x, 0))], np.r_[0, np.cumsum(np.minimum(x, 0))]
    out = np.zeros(n)
    for w in range(fp[0], fp[1] + 1):
        for f in range(flank[0], flank[1] + 1):
            total = w + 2 * f
            if total > n:
                break
            i = np.arange(n - total + 1)
            left, right = pos[i + f] - pos[i], pos[i + total] - pos[i + f + w]
            middle = neg[i + f + w] - neg[i + f]
            v = (left + right) / (2 * f) - middle / w
            # the score holds for every place of the footprint
            for k in range(w):
                np.maximum.at(out, i + f + k, v)
    return out


def fos_score(x: np.ndarray, flank: tuple[int, int] = (10, 30), fp: tuple[int, int] = (20, 50)) -> np.ndarray:
    """At each place the greatest over widths of -(C + 1) / (L + 1) - (C + 1) / (R + 1) of mean centre, left and right signal where both flanks exceed the centre; 0 elsewhere."""
    n = len(x)
    c = np.r_[0, np.cumsum(np.maximum(x, 0))]
    best = np.full(n, -np.inf)
    for w in range(fp[0], fp[1] + 1):
        for f in range(flank[0], flank[1] + 1):
            total = w + 2 * f
            if total > n:
                break
            i = np.arange(n - total + 1)
            left, mid, right = (c[i + f] - c[i]) / f, (c[i + f + w] - c[i + f]) / w, (c[i + total] - c[i + f + w]) / f
            v = np.where((left > mid) & (right > mid), -((mid + 1) / (left + 1) + (mid + 1) / (right + 1)), -np.inf)
            np.maximum.at(best, i + f + w // 2, v)
    return np.where(np.isinf(best), 0.0, best + 2)


def preprocess(x: np.ndarray, low: float | None = None, high: float | None = None, absolute: bool = False, smooth: int = 1) -> np.ndarray:
    x = np.nan_to_num(np.asarray(x, float), nan=0.0, posinf=0.0, neginf=0.0)
    x = np.abs(x) if absolute else x
    x = np.clip(x, low if low is not None else -np.inf, high if high is not None else np.inf)
    return rolling(x, smooth, "mean") if smooth > 1 else x


def shuffle_counts(x: np.ndarray, shifts: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """n arrays with each count of x moved by a random one of the shifts; what would leave the array stays at its end."""
    rng = np.random.default_rng(seed)
    at = np.repeat(np.arange(len(x)), np.maximum(x, 0).astype(int))
    out = np.zeros((n, len(x)))
    for k in range(n):
        np.add.at(out[k], np.clip(at + rng.choice(shifts, len(at)), 0, len(x) - 1), 1)
    return out


def array_kernel(col: Column | str, fn, *args) -> Column:
    """A kernel of this module applied to an array column."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(np.asarray(x, float), *args))

    return run(col)


def score_regions(arrays: DataFrame, key: str, methods: tuple[str, ...] = ("flank_depth",), flank=(5, 10), fp=(5, 12)) -> DataFrame:
    """(key, method, score) arrays of region signals by footprint methods: flank_depth, fos, mean or sum."""
    fns = {"flank_depth": lambda x: footprint_score(x, flank, fp), "fos": lambda x: fos_score(x, flank, fp), "mean": lambda x: rolling(x, 50, "mean"), "sum": lambda x: rolling(x, 50, "sum")}
    out = None
    for m in methods:
        a = arrays.select(key, F.lit(m).alias("method"), array_kernel("signal", fns[m]).alias("score"))
        out = a if out is None else out.unionByName(a)
    return out


def rolling_table(df: DataFrame, keys: list[str], pos: str, value: str, before: int, after: int, how: str = "sum") -> DataFrame:
    """Rolling statistic over rows in order of pos within keys (bounded groups)."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return df.withColumn("rolled", f(value).over(W.partitionBy(*keys).orderBy(pos).rowsBetween(-before, after)))


def filter_outliers(arrays: DataFrame, upper: float = 0.99) -> DataFrame:
    """Rows whose greatest signal is at most the given quantile of these."""
    m = F.array_max("signal")
    q = arrays.agg(F.percentile(m, F.lit(upper)).alias("_q"))
    return arrays.crossJoin(F.broadcast(q)).where(m <= F.col("_q")).drop("_q")


def aggregate_profile(track: DataFrame, sites: DataFrame, key: str, flank: int = 60, upper: float | None = 0.99, signed_log: bool = False) -> DataFrame:
    """(offset, value, n): mean signal by offset -flank..flank - 1 of the sites' middles, strands flipped, sites whose greatest signal exceeds the quantile `upper` left out, signed log2 if wanted."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    w = sites.withColumn("_m", mid).withColumn("start", F.col("_m") - flank).withColumn("end", F.col("_m") + flank).drop("_m")
    a = region_arrays(track, w, key)
    a = filter_outliers(a, upper) if upper is not None else a
    v = F.col("v")
    v = F.signum(v) * F.log2(F.abs(v) + 1) if signed_log else v
    return a.select(F.posexplode("signal").alias("p", "v")).groupBy((F.col("p") - flank).alias("offset")).agg(F.avg(v).alias("value"), F.count(F.lit(1)).alias("n"))
