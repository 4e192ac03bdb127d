"""Contacts: pairs to pixels (chrom, bin1 <= bin2, count), decay, coverage, balancing, insulation, pile-ups, saddles, compartments, loops, imputation, embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.util import materialize, small


def barcode_of(read_id: Column | str) -> Column:
    """The last part of a read name after `_`."""
    return F.element_at(F.split(F.col(read_id) if isinstance(read_id, str) else read_id, "_"), -1)


def demux(pairs: DataFrame, groups: DataFrame, keep_rest: bool = False) -> DataFrame:
    """pairs with `group` of their barcode by groups (barcode, group); others are dropped or `_unassigned`. Written with partitionBy("group") it is one folder per group."""
    p = pairs.withColumn("barcode", barcode_of("read_id"))
    j = p.join(small(groups.select("barcode", "group")), "barcode", "left" if keep_rest else "inner")
    return j.withColumn("group", F.coalesce("group", F.lit("_unassigned"))) if keep_rest else j


def pixels(pairs: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, chrom1, chrom2, bin1, bin2, count) with (chrom1, bin1) <= (chrom2, bin2)."""
    a = F.struct(F.col("chrom1").alias("c"), F.floor(F.col("pos1") / width).alias("b"))
    b = F.struct(F.col("chrom2").alias("c"), F.floor(F.col("pos2") / width).alias("b"))
    p = pairs.select(*(keys or []), F.least(a, b).alias("a"), F.greatest(a, b).alias("z"))
    return p.groupBy(*(keys or []), F.col("a.c").alias("chrom1"), F.col("z.c").alias("chrom2"), F.col("a.b").alias("bin1"), F.col("z.b").alias("bin2")).agg(F.count(F.lit(1)).alias("count"))


def cis(px: DataFrame) -> DataFrame:
    return px.where(F.col("chrom1") == F.col("chrom2")).withColumnRenamed("chrom1", "chrom").drop("chrom2")


def both_sides(c: DataFrame, value: str = "count") -> DataFrame:
    """Cis pixels with each off-diagonal one in both directions."""
    keys = [x for x in c.columns if x not in ("bin1", "bin2", value)]
    flip = c.where("bin1 <> bin2").select(*keys, F.col("bin2").alias("bin1"), F.col("bin1").alias("bin2"), value)
    return c.select(*keys, "bin1", "bin2", value).unionByName(flip)


def bin_coverage(c: DataFrame, value: str = "count") -> DataFrame:
    """(chrom, bin, coverage): row sums of the symmetric cis matrix."""
    return both_sides(c, value).groupBy("chrom", F.col("bin1").alias("bin")).agg(F.sum(value).alias("coverage"))


def decay(c: DataFrame, n_bins: DataFrame, value: str = "count") -> DataFrame:
    """(chrom, offset, mean): mean per diagonal of chromosomes with n_bins (chrom, n), empty places being 0."""
    s = c.groupBy("chrom", (F.col("bin2") - F.col("bin1")).alias("offset")).agg(F.sum(value).alias("s"))
    return s.join(F.broadcast(n_bins), "chrom").where(F.col("offset") < F.col("n")).select("chrom", "offset", (F.col("s") / (F.col("n") - F.col("offset"))).alias("mean"))


def observed_over_expected(c: DataFrame, n_bins: DataFrame, value: str = "count") -> DataFrame:
    d = decay(c, n_bins, value)
    return c.withColumn("offset", F.col("bin2") - F.col("bin1")).join(d, ["chrom", "offset"]).withColumn("oe", F.col(value) / F.col("mean")).drop("mean", "offset")


def balance(c: DataFrame, ignore_diags: int = 2, min_nnz: int = 10, mad_max: float = 5.0, tol: float = 1e-5, rounds: int = 50) -> DataFrame:
    """(chrom, bin, weight) such that weighted rows of the symmetric cis matrix sum to 1; NULL for bins with fewer than min_nnz pixels or log coverage beyond mad_max deviations below the median.

    Iterative correction: weights are divided by their bins' relative marginals until these vary less than tol.
    """
    m = both_sides(c.where(F.col("bin2") - F.col("bin1") >= ignore_diags).select("chrom", "bin1", "bin2", F.col("count").cast("double").alias("count")))
    cov = m.groupBy("chrom", F.col("bin1").alias("bin")).agg(F.sum("count").alias("s"), F.count(F.lit(1)).alias("nnz"))
    lg = cov.where("s > 0").withColumn("l", F.log("s"))
    med = lg.groupBy("chrom").agg(F.percentile("l", F.lit(0.5)).alias("med"))
    mad = lg.join(med, "chrom").groupBy("chrom").agg(F.first("med").alias("med"), F.percentile(F.abs(F.col("l") - F.col("med")), F.lit(0.5)).alias("mad"))
    ok = lg.join(mad, "chrom").where((F.col("nnz") >= min_nnz) & (F.col("l") >= F.col("med") - mad_max * F.col("mad"))).select("chrom", "bin")
    w = materialize(ok.withColumn("weight", F.lit(1.0)), "weights")
    m = materialize(m.join(ok.withColumnRenamed("bin", "bin1"), ["chrom", "bin1"], "left_semi").join(ok.withColumnRenamed("bin", "bin2"), ["chrom", "bin2"], "left_semi"), "pixels")
    for _ in range(rounds):
        marg = m.join(w.withColumnsRenamed({"bin": "bin2", "weight": "w2"}), ["chrom", "bin2"]).groupBy("chrom", "bin1").agg(F.sum(F.col("count") * F.col("w2")).alias("s"))
        j = w.select("chrom", "bin", "weight").join(marg.withColumnRenamed("bin1", "bin"), ["chrom", "bin"]).withColumn("s", F.col("s") * F.col("weight"))
        stat = j.groupBy("chrom").agg(F.avg("s").alias("mean"), F.var_pop("s").alias("var"))
        j = j.join(F.broadcast(stat), "chrom")
        # the square root damps the correction, as both sides of a pixel receive it
        w = materialize(j.select("chrom", "bin", (F.col("weight") / F.sqrt(F.col("s") / F.col("mean"))).alias("weight"), (F.col("var") / (F.col("mean") * F.col("mean"))).alias("v"), "mean"), "weights")
        if (w.agg(F.max("v")).first()[0] or 0) < tol:
            break
    done = w.select("chrom", "bin", (F.col("weight") / F.sqrt("mean")).alias("weight"))
    return cov.select("chrom", "bin").join(done, ["chrom", "bin"], "left")


def balanced(c: DataFrame, weights: DataFrame) -> DataFrame:
    w = weights.where("weight is not null")
    a, b = w.withColumnsRenamed({"bin": "bin1", "weight": "w1"}), w.withColumnsRenamed({"bin": "bin2", "weight": "w2"})
    return c.join(a, ["chrom", "bin1"]).join(b, ["chrom", "bin2"]).withColumn("balanced", F.col("count") * F.col("w1") * F.col("w2")).drop("w1", "w2")


def insulation(c: DataFrame, window: int, value: str = "count") -> DataFrame:
    """(chrom, bin, diamond, log2_score): mean of the square of pixels between the `window` bins before and after each bin, and its log2 over the chromosome's mean; local minima with `is_boundary` and strength.

    A pixel falls into the squares of the bins strictly between its two sides, at most 2 * window of them.
    """
    d = c.where((F.col("bin2") - F.col("bin1") >= 2) & (F.col("bin2") - F.col("bin1") <= 2 * window))
    lo, hi = F.greatest(F.col("bin1") + 1, F.col("bin2") - window), F.least(F.col("bin2") - 1, F.col("bin1") + window)
    s = d.where(lo <= hi).select("chrom", F.explode(F.sequence(lo, hi)).alias("bin"), value).groupBy("chrom", "bin").agg((F.sum(value) / (window * window)).alias("diamond"))
    m = s.groupBy("chrom").agg(F.avg("diamond").alias("m"))
    s = s.join(F.broadcast(m), "chrom").withColumn("log2_score", F.log2(F.col("diamond") / F.col("m"))).drop("m")
    w = W.partitionBy("chrom").orderBy("bin")
    low = (F.col("log2_score") < F.lag("log2_score").over(w)) & (F.col("log2_score") <= F.lead("log2_score").over(w))
    depth = F.least(F.max("log2_score").over(w.rowsBetween(-window, 0)), F.max("log2_score").over(w.rowsBetween(0, window))) - F.col("log2_score")
    return s.withColumn("strength", F.when(low, depth)).withColumn("is_boundary", F.coalesce(low & (depth >= 0.2), F.lit(False)))


def tad_boundaries(ins: DataFrame, least: float | None = None) -> DataFrame:
    ok = F.col("is_boundary") if least is None else F.col("strength") >= least
    return ins.where(ok).select("chrom", "bin", "strength").orderBy("chrom", "bin")


def pile_up(oe: DataFrame, features: DataFrame, flank: int) -> DataFrame:
    """(di, dj, value): mean of observed over expected around pairs of bins (chrom, bin1, bin2), empty places being 0."""
    n = features.count()
    f = features.select("chrom", F.col("bin1").alias("f1"), F.col("bin2").alias("f2"))
    grid = f.withColumn("di", F.explode(F.sequence(F.lit(-flank), F.lit(flank)))).withColumn("dj", F.explode(F.sequence(F.lit(-flank), F.lit(flank))))
    j = grid.withColumn("bin1", F.col("f1") + F.col("di")).withColumn("bin2", F.col("f2") + F.col("dj")).join(both_sides(oe.select("chrom", "bin1", "bin2", "oe"), "oe"), ["chrom", "bin1", "bin2"], "left")
    return j.groupBy("di", "dj").agg((F.sum(F.coalesce("oe", F.lit(0.0))) / n).alias("value"))


def saddle(oe: DataFrame, track: DataFrame, n: int = 10) -> DataFrame:
    """(q1, q2, value): mean observed over expected between quantile groups 1..n of a bin track (chrom, bin, value)."""
    e = track.agg(F.percentile("value", F.array(*[F.lit(i / n) for i in range(1, n)])).alias("e")).first().e
    q = sum(((F.col("value") >= float(x)).cast("int") for x in e), F.lit(1))
    t = track.select("chrom", "bin", q.alias("q"))
    j = both_sides(oe.select("chrom", "bin1", "bin2", "oe"), "oe").join(t.withColumnsRenamed({"bin": "bin1", "q": "q1"}), ["chrom", "bin1"]).join(t.withColumnsRenamed({"bin": "bin2", "q": "q2"}), ["chrom", "bin2"])
    return j.groupBy("q1", "q2").agg(F.avg("oe").alias("value"))


def _dense(p: pd.DataFrame, value: str) -> tuple[np.ndarray, int]:
    lo = int(min(p["bin1"].min(), p["bin2"].min()))
    n = int(p["bin2"].max()) - lo + 1
    m = np.zeros((n, n))
    i, j = p["bin1"].to_numpy() - lo, p["bin2"].to_numpy() - lo
    m[i, j] = p[value]
    m[j, i] = p[value]
    return m, lo


def compartments(oe: DataFrame, phase: DataFrame | None = None) -> DataFrame:
    """(chrom, bin, e1): first eigenvector of the correlation of each chromosome's observed over expected rows, turned to agree with a phase track (chrom, bin, phase) if given.

    One dense matrix per chromosome at compartment resolution (a few thousand bins).
    """

    def eig(p):
        m, lo = _dense(p, "oe")
        ok = m.sum(1) > 0
        if ok.sum() < 3:
            return pd.DataFrame({"chrom": pd.Series(dtype="object"), "bin": pd.Series(dtype="int64"), "e1": pd.Series(dtype="float64")})
        x = m[np.ix_(ok, ok)]
        x = x - x.mean(1)[:, None]
        sd = np.sqrt((x * x).sum(1))
        x = x / np.where(sd > 0, sd, 1)[:, None]
        w, v = np.linalg.eigh(x @ x.T)
        e = v[:, -1] * np.sqrt(max(w[-1], 0))
        e = e * np.sign(e[np.abs(e).argmax()])
        return pd.DataFrame({"chrom": p["chrom"].iloc[0], "bin": np.flatnonzero(ok) + lo, "e1": e})

    out = oe.select("chrom", "bin1", "bin2", "oe").groupBy("chrom").applyInPandas(eig, "chrom string, bin bigint, e1 double")
    if phase is None:
        return out
    s = out.join(phase, ["chrom", "bin"]).groupBy("chrom").agg(F.corr("e1", "phase").alias("r"))
    return out.join(F.broadcast(s), "chrom", "left").withColumn("e1", F.when(F.col("r") < 0, -F.col("e1")).otherwise(F.col("e1"))).drop("r")


def loops(c: DataFrame, n_bins: DataFrame, inner: int = 1, outer: int = 3, fold: float = 1.5, least: int = 3, value: str = "count") -> DataFrame:
    """(chrom, bin1, bin2, value, expected, fold): pixels that exceed by `fold` the expected value scaled by their donut neighbourhood and are the greatest there; neighbouring calls are one."""
    d = decay(c, n_bins, value)
    px = c.select("chrom", "bin1", "bin2", F.col(value).cast("double").alias("v"))
    cand = px.where(F.col("v") >= least).where(F.col("bin2") - F.col("bin1") > outer)
    steps = [(i, j) for i in range(-outer, outer + 1) for j in range(-outer, outer + 1) if max(abs(i), abs(j)) > 0]
    offs = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"), F.lit(max(abs(i), abs(j)) > inner).alias("ring")) for i, j in steps])
    a = cand.select("chrom", F.col("bin1").alias("c1"), F.col("bin2").alias("c2"), "v", F.inline(offs))
    a = a.withColumn("bin1", F.col("c1") + F.col("di")).withColumn("bin2", F.col("c2") + F.col("dj")).withColumn("offset", F.col("bin2") - F.col("bin1"))
    a = a.join(px.withColumnRenamed("v", "o"), ["chrom", "bin1", "bin2"], "left").join(F.broadcast(d), ["chrom", "offset"], "left")
    g = a.groupBy("chrom", "c1", "c2", "v").agg(F.sum(F.when(F.col("ring"), F.coalesce("o", F.lit(0.0)))).alias("o"), F.sum(F.when(F.col("ring"), F.coalesce("mean", F.lit(0.0)))).alias("e"), F.max(F.coalesce("o", F.lit(0.0))).alias("top"))
    own = d.select("chrom", F.col("offset").alias("_o"), "mean")
    g = g.withColumn("_o", F.col("c2") - F.col("c1")).join(F.broadcast(own), ["chrom", "_o"])
    exp = F.greatest(F.col("mean") * F.when(F.col("e") > 0, F.col("o") / F.col("e")).otherwise(1.0), F.col("mean"))
    g = g.withColumn("expected", exp).withColumn("fold", F.col("v") / F.col("expected"))
    return g.where((F.col("fold") >= fold) & (F.col("v") >= F.col("top"))).select("chrom", F.col("c1").alias("bin1"), F.col("c2").alias("bin2"), F.col("v").alias("value"), "expected", "fold")


def impute_matrix(c: np.ndarray, pad: int = 1, restart: float = 0.05, top: float = 0.05, log: bool = True) -> np.ndarray:
    """A symmetric contact matrix summed over a box of 2 pad + 1, spread by a random walk that restarts with the given probability, made symmetric, log-scaled by the number of bins
    over the sum of the boxes, and kept where it is among the greatest share `top` of all entries (0 elsewhere)."""
    n = len(c)
    if not n:
        return c.astype(float)
    a = c.astype(float)
    if pad and n > 1:
        edge = np.zeros((n + 1, n + 1))
        edge[1:, 1:] = a.cumsum(0).cumsum(1)
        lo, hi = np.maximum(np.arange(n) - pad, 0), np.minimum(np.arange(n) + pad + 1, n)
        a = edge[hi][:, hi] - edge[lo][:, hi] - edge[hi][:, lo] + edge[lo][:, lo]
    rows = a.sum(1)
    left = np.eye(n) - (1 - restart) * a / np.where(rows > 0, rows, 1)[:, None]
    try:
        q = restart * np.linalg.solve(left, np.eye(n))
    except np.linalg.LinAlgError:
        q = np.linalg.lstsq(left, restart * np.eye(n), rcond=None)[0]
    q = (q + q.T) / 2
    if log:
        q = np.log1p(q * (n / max(a.sum(), 1.0)))
    return np.where(q >= np.quantile(q, 1 - top), q, 0.0) if 0 < top < 1 else q


def impute(c: DataFrame, n_bins: DataFrame | None = None, pad: int = 1, restart: float = 0.05, top: float = 0.05, log: bool = True) -> DataFrame:
    """(cell, chrom, bin1, bin2, value), bin1 <= bin2: the entries above 0 of `impute_matrix` of each cell's chromosome. n_bins (chrom, n) gives the chromosomes' numbers of bins, by
    default up to the last bin of each cell that has contacts. One dense matrix per cell and chromosome."""
    n = c.groupBy("cell", "chrom").agg((F.max(F.greatest("bin1", "bin2")) + 1).alias("_n")) if n_bins is None else n_bins.select("chrom", F.col("n").alias("_n"))

    def one(t):
        m = np.zeros((t.column("_n")[0].as_py(),) * 2)
        i, j = t.column("bin1").to_numpy(), t.column("bin2").to_numpy()
        m[i, j] = m[j, i] = t.column("count").to_numpy()
        m = impute_matrix(m, pad, restart, top, log)
        i, j = np.nonzero(np.triu(m) > 0)
        same = pa.array(np.zeros(len(i), np.int64))
        return pa.table({"cell": t.column("cell").take(same), "chrom": t.column("chrom").take(same), "bin1": i, "bin2": j, "value": m[i, j]})

    c = c.select("cell", "chrom", "bin1", "bin2", "count").join(n, ["cell", "chrom"] if n_bins is None else "chrom")
    return c.groupBy("cell", "chrom").applyInArrow(one, "cell string, chrom string, bin1 bigint, bin2 bigint, value double")


def contact_features(c: DataFrame, value: str = "count") -> DataFrame:
    """(cell, feature, value) of the pixels of cells, log2(value + 1e-9), for an embedding with operators.embed."""
    return c.select("cell", F.concat_ws(":", "chrom", "bin1", "bin2").alias("feature"), F.log2(F.col(value) + 1e-9).alias("value"))


def group_correlation(c: DataFrame, value: str = "count", log: bool = True) -> DataFrame:
    """(a, b, correlation) of groups over the pixels that both have."""
    x = c.select("group", "chrom", "bin1", "bin2", (F.log1p(value) if log else F.col(value).cast("double")).alias("v"))
    j = x.withColumnsRenamed({"group": "a", "v": "va"}).join(x.withColumnsRenamed({"group": "b", "v": "vb"}), ["chrom", "bin1", "bin2"])
    return j.groupBy("a", "b").agg(F.corr("va", "vb").alias("correlation"))


def clean_pairs(pairs: DataFrame, types: tuple[str, ...] = ("UU", "UR", "RU")) -> DataFrame:
    """Distinct pairs by places and strands, of the pair types given if there is such a column."""
    p = pairs.where(F.col("pair_type").isin(*types)) if "pair_type" in pairs.columns else pairs
    return p.dropDuplicates(["chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2"])
