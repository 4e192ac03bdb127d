"""Statistics on long tables: ranks over everything, false discovery rates, scaling, correlation, rank-sum tests, normalisation factors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusmill.util import materialize, shuffle_width


def global_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with the 1-based place of each row in the order of columns. Range partitions are numbered within and offset by the rows before them, so no task sees all rows."""
    parts = shuffle_width(df.sparkSession)
    r = materialize(df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id()), "ranked")
    counts = {x._pid: x["n"] for x in r.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    off, total = [], 0
    for p in sorted(counts):
        off.append((p, total))
        total += counts[p]
    offs = F.broadcast(df.sparkSession.createDataFrame(off, "_pid int, _off bigint"))
    return r.join(offs, "_pid").withColumn(name, F.col("_off") + F.row_number().over(W.partitionBy("_pid").orderBy(*order))).drop("_pid", "_off")


def rank_within(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with the 1-based place of each row among the rows of the same `by`, in the order of columns. Groups may be of any size: rows are numbered by range partitions of all groups
    together, and a group's places begin where its first row is."""
    parts = shuffle_width(df.sparkSession)
    r = materialize(df.repartitionByRange(parts, *by, *order).withColumn("_pid", F.spark_partition_id()), "ranked")
    # a group's rows lie in neighbouring partitions: what earlier ones hold of it is the offset, one row for each group and partition
    n = r.groupBy(*by, "_pid").agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_off", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    n = n.select(F.col("_pid").alias("_p"), "_off", *[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)])
    on = [F.col("_pid") == F.col("_p"), *[F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]]
    inside = F.row_number().over(W.partitionBy("_pid", *by).orderBy(*order))
    return r.withColumn("_in", inside).join(n, on).withColumn(name, F.col("_off") + F.col("_in")).select(*df.columns, name)


def bh_fdr(df: DataFrame, p: str = "p_value", by: list[str] | None = None, name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg rates: the least p * n / rank among the rows with an equal or greater p, at most 1. Rows with NULL p get NULL and don't count.

    With `by`, per group of a bounded number of tests; without, over all rows by range partitions.
    """
    if by:
        w = W.partitionBy(*by, F.col(p).isNull())
        q = F.col(p) * F.count(F.lit(1)).over(w) / F.row_number().over(w.orderBy(p))
        d = df.withColumn("_q", q)
        return d.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_q").over(w.orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, 0))))).drop("_q")
    spark = df.sparkSession
    r = materialize(df.where(F.col(p).isNotNull()).repartitionByRange(shuffle_width(spark), p).withColumn("_pid", F.spark_partition_id()), "fdr")
    per = {x._pid: x["n"] for x in r.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, before, offs = sum(per.values()), 0, []
    for i in sorted(per):
        offs.append((i, before))
        before += per[i]
    o = F.broadcast(spark.createDataFrame(offs, "_pid int, _off bigint"))
    w = W.partitionBy("_pid").orderBy(p)
    q = r.join(o, "_pid").withColumn("_q", F.col(p) * total / (F.col("_off") + F.row_number().over(w)))
    least = {x._pid: x["m"] for x in q.groupBy("_pid").agg(F.min("_q").alias("m")).collect()}
    best, after = 1.0, []
    for i in sorted(least, reverse=True):
        after.append((i, best))
        best = min(best, least[i])
    a = F.broadcast(spark.createDataFrame(after, "_pid int, _after double"))
    down = W.partitionBy("_pid").orderBy(F.desc(p)).rangeBetween(W.unboundedPreceding, 0)
    out = q.join(a, "_pid").withColumn(name, F.least("_after", F.min("_q").over(down))).drop("_pid", "_off", "_q", "_after")
    return out.unionByName(df.where(F.col(p).isNull()), allowMissingColumns=True)


def zscore(df: DataFrame, value: str, by: list[str], name: str = "z") -> DataFrame:
    """(x - mean) / sample deviation per group; a deviation of 0 counts as 1."""
    s = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return df.join(s, by).withColumn(name, (F.col(value) - F.col("_m")) / F.when(F.coalesce("_s", F.lit(0.0)) == 0, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def _sums(x: DataFrame, row: str, col: str) -> DataFrame:
    r = x.groupBy(row).agg(F.sum("value").alias("_r"))
    c = x.groupBy(col).agg(F.sum("value").alias("_c"))
    return x.join(r, row).join(c, col)


def tf_logidf(x: DataFrame, n_rows: int, row: str = "cell", col: str = "feature", scale: float = 1e4) -> DataFrame:
    """ln(1 + x / row sum * ln(1 + N / column sum) * scale) of a long matrix (row, col, value); N is the number of rows of the whole matrix."""
    return _sums(x, row, col).select(row, col, F.log1p(F.col("value") / F.col("_r") * F.log1p(F.lit(float(n_rows)) / F.col("_c")) * scale).alias("value"))


def tf_idf(x: DataFrame, n_rows: int, row: str = "cell", col: str = "feature") -> DataFrame:
    """x / row sum * N / column sum."""
    return _sums(x, row, col).select(row, col, (F.col("value") / F.col("_r") * float(n_rows) / F.col("_c")).alias("value"))


def idf(x: DataFrame, n_rows: int, col: str = "feature") -> DataFrame:
    """ln(N / (1 + rows with a value not 0)) per column."""
    return x.where("value <> 0").groupBy(col).agg(F.count(F.lit(1)).alias("_n")).select(col, F.log(F.lit(float(n_rows)) / (1 + F.col("_n"))).alias("idf"))


def row_normalise(x: DataFrame, row: str = "cell", scale: float = 1e4) -> DataFrame:
    s = x.groupBy(row).agg(F.sum("value").alias("_r"))
    return x.join(s, row).withColumn("value", F.col("value") / F.col("_r") * scale).drop("_r")


def binarize(x: DataFrame) -> DataFrame:
    return x.withColumn("value", (F.col("value") > 0).cast("int"))


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) of the normal distribution."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2)))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * f


def betainc_all(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """betainc at all places of x at once."""
    x = np.clip(np.asarray(x, float), 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    out = np.zeros(len(x))
    for p, q, at, y in ((a, b, ~flip, x), (b, a, flip, 1 - x)):
        y = y[at]
        with np.errstate(divide="ignore"):
            front = np.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones(len(y)), 1 / (1 - (p + q) * y / (p + 1))
        f = d
        for m in range(1, 400):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(d == 0, 1e-300, d)
                c = 1 + num / c
                c = np.where(c == 0, 1e-300, c)
                f = f * c * d
            if (np.abs(1 - c * d) < 1e-15).all():
                break
        out[at] = front * f
    return np.where(flip, 1 - out, out)


def t_two_sided_all(t: np.ndarray, df: float) -> np.ndarray:
    """t_two_sided at all places of t; NaN stays NaN."""
    t = np.asarray(t, float)
    p = np.where(np.isinf(t), 0.0, np.nan)
    ok = np.isfinite(t)
    p[ok] = betainc_all(df / 2, 0.5, df / (df + t[ok] ** 2))
    return p


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return betainc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_test_udf(df: int):
    @F.pandas_udf(T.DoubleType())
    def p(t: pd.Series) -> pd.Series:
        out = t_two_sided_all(t.to_numpy(float, na_value=np.nan), df)
        return pd.Series(out).where(~np.isnan(out), None)

    return p


def log_binom_sf(k: int, n: int, p: float) -> float:
    """ln P(X >= k) of the binomial distribution."""
    if k <= 0:
        return 0.0
    if k > n or p <= 0:
        return -math.inf
    v = betainc(k, n - k + 1, p)
    if v > 1e-290:
        return math.log(v)
    # the leading term with the ratio of its successor
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    q = (n - k) / (k + 1) * p / (1 - p)
    return first - math.log1p(-q) if q < 1 else first


def pearson(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson correlation from sums; NULL if a variance is 0."""
    cov = n * sxy - sx * sy
    den = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.when(den > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / den)))


def correlate_pairs(x: DataFrame, pairs: DataFrame, n: int, item: str = "feature", at: str = "sample") -> DataFrame:
    """pairs (a, b, ...) with `correlation`, `t` and `p_value` of their long vectors (item, at, value) over n places, absent ones being 0.

    Per item sums are aggregated once; the cross sums come from an equi-join on the place, limited to the pairs asked for.
    """
    s = x.groupBy(item).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    a = x.select(F.col(item).alias("a"), at, F.col("value").alias("va"))
    b = x.select(F.col(item).alias("b"), at, F.col("value").alias("vb"))
    cross = pairs.select("a", "b").join(a, "a").join(b, ["b", at]).groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("xy"))
    sa = s.select(F.col(item).alias("a"), F.col("s").alias("sx"), F.col("ss").alias("sxx"))
    sb = s.select(F.col(item).alias("b"), F.col("s").alias("sy"), F.col("ss").alias("syy"))
    j = pairs.join(cross, ["a", "b"], "left").join(sa, "a", "left").join(sb, "b", "left")
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    r = pearson(F.lit(float(n)), z("sx"), z("sy"), z("sxx"), z("syy"), z("xy"))
    j = j.withColumn("correlation", r).drop("xy", "sx", "sxx", "sy", "syy")
    t = F.col("correlation") * F.sqrt(F.lit(float(n - 2)) / F.greatest(1 - F.col("correlation") * F.col("correlation"), F.lit(1e-300)))
    return j.withColumn("t", t).withColumn("p_value", t_test_udf(n - 2)("t"))


def rank_sum(x: DataFrame, sides: DataFrame, eps: float = 1e-6, feature: str = "feature", cell: str = "cell") -> DataFrame:
    """Per feature a rank-sum test of the `fg` cells of sides (cell, side: fg or bg) against the `bg` ones, over long x (cell, feature, value > 0), absent values being 0.

    Result: feature, u, z, p_value, mean_fg, mean_bg, pct_fg, pct_bg, log2_fc. Ties share their average rank and correct the variance; no continuity correction.
    Distinct values of a feature, not its rows, are what is ordered, so zeros are one value with a count.
    """
    return rank_sums(x, sides.withColumn("group", F.lit("")), eps, feature, cell).drop("group")


def rank_sums(x: DataFrame, sides: DataFrame, eps: float = 1e-6, feature: str = "feature", cell: str = "cell") -> DataFrame:
    """rank_sum for several groups in one pass over x: sides (group, cell, side), a cell in any number of groups. Result with `group`; groups are few, their sizes are collected."""
    n = {}
    for r in sides.groupBy("group", "side").agg(F.count(F.lit(1)).alias("n")).collect():
        n.setdefault(r.group, {})[r.side] = r["n"]
    size = F.broadcast(x.sparkSession.createDataFrame([(g, v.get("fg", 0), v.get("bg", 0)) for g, v in n.items()], "group string, n1 bigint, n2 bigint"))
    fg = (F.col("side") == "fg").cast("bigint")
    v = x.where("value <> 0").join(sides.select("group", cell, "side"), cell).groupBy("group", feature, "value").agg(F.sum(fg).alias("f"), F.count(F.lit(1)).alias("c"))
    zero = v.groupBy("group", feature).agg(F.sum("f").alias("_f"), F.sum("c").alias("_c")).join(size, "group")
    zero = zero.select("group", feature, F.lit(0).cast(x.schema["value"].dataType).alias("value"), (F.col("n1") - F.col("_f")).alias("f"), (F.col("n1") + F.col("n2") - F.col("_c")).alias("c"))
    v = v.unionByName(zero)
    w = W.partitionBy("group", feature).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    v = v.withColumn("avg_rank", F.coalesce(F.sum("c").over(w), F.lit(0)) + (F.col("c") + 1) / 2)
    c = F.col("c").cast("double")
    s = v.groupBy("group", feature).agg(
        F.sum(F.col("avg_rank") * F.col("f")).alias("r1"),
        F.sum(c * c * c - c).alias("ties"),
        F.sum(F.col("value") * F.col("f")).alias("s1"),
        F.sum(F.col("value") * (F.col("c") - F.col("f"))).alias("s2"),
        F.sum(F.when(F.col("value") != 0, F.col("f")).otherwise(0)).alias("p1"),
        F.sum(F.when(F.col("value") != 0, F.col("c") - F.col("f")).otherwise(0)).alias("p2"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    tot = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12.0 * (tot + 1 - F.col("ties") / F.greatest(tot * (tot - 1), F.lit(1.0)))
    z = F.when(var > 0, (u - n1 * n2 / 2) / F.sqrt(var)).otherwise(0.0)
    one, two = F.nullif(n1, F.lit(0.0)), F.nullif(n2, F.lit(0.0))
    s = s.join(size, "group").select(
        "group",
        feature,
        u.alias("u"),
        z.alias("z"),
        (F.col("s1") / one).alias("mean_fg"),
        (F.col("s2") / two).alias("mean_bg"),
        (F.col("p1") / one).alias("pct_fg"),
        (F.col("p2") / two).alias("pct_bg"),
    )
    return s.withColumn("p_value", normal_two_sided("z")).withColumn("log2_fc", F.log2((F.col("mean_fg") + eps) / (F.col("mean_bg") + eps)))


def tmm_factors(x: DataFrame, logratio_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """(sample, factor) by trimmed means of M values against the sample whose upper quartile per library size is closest to the mean (the first by name of equals), scaled to a
    geometric mean of 1.

    x: (sample, feature, value); a feature that a sample lacks is 0 there and counts for its upper quartile. A sample that shares fewer than four features with the
    reference, or without counts, has factor 1 before scaling (values within 1e-12 of a quantile count as on it); with fewer than two samples that have counts all factors are 1. Samples are few (a bulk design): each feature is unfolded over them.
    """
    lib = {r["sample"]: r["lib"] or 0 for r in x.groupBy("sample").agg(F.sum("value").alias("lib")).orderBy("sample").collect()}
    spark = x.sparkSession
    libs = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in lib.items()], f"sample {x.schema['sample'].dataType.simpleString()}, lib double"))
    if sum(v > 0 for v in lib.values()) < 2:
        return libs.select("sample", F.lit(1.0).alias("factor"))
    grid = x.select("feature").distinct().select("feature", F.explode(F.array(*map(F.lit, lib))).alias("sample"))
    full = grid.join(x.select("feature", "sample", F.col("value").cast("double").alias("value")), ["feature", "sample"], "left").fillna(0.0, ["value"]).join(libs, "sample")
    full = materialize(full.withColumn("ratio", F.col("value") / F.greatest("lib", F.lit(1.0))), "ratios")
    q = {r["sample"]: r.q for r in full.groupBy("sample").agg(F.percentile("ratio", F.lit(0.75)).alias("q")).collect()}
    mean = sum(q.values()) / len(q)
    ref = min(sorted(q), key=lambda k: abs(q[k] - mean))
    r = full.where((F.col("sample") == ref) & (F.col("value") > 0)).select("feature", F.col("ratio").alias("rr"))
    j = full.where((F.col("value") > 0) & (F.col("sample") != ref)).join(r, "feature")
    j = j.select("sample", F.log2(F.col("ratio") / F.col("rr")).alias("m"), (F.log2(F.col("ratio") * F.col("rr")) / 2).alias("a"))
    t = j.groupBy("sample").agg(F.count(F.lit(1)).alias("k"), *[F.percentile(c, F.lit(v)).alias(n) for c, n, v in (("m", "m0", logratio_trim), ("m", "m1", 1 - logratio_trim), ("a", "a0", sum_trim), ("a", "a1", 1 - sum_trim))])
    kept = j.join(t.where("k >= 4"), "sample").where("m >= m0 - 1e-12 and m <= m1 + 1e-12 and a >= a0 - 1e-12 and a <= a1 + 1e-12").groupBy("sample").agg(F.avg("m").alias("m"))
    f = libs.join(kept, "sample", "left").select("sample", F.pow(F.lit(2.0), F.coalesce("m", F.lit(0.0))).alias("f"))
    geo = f.agg(F.exp(F.avg(F.log("f"))).alias("g"))
    return f.crossJoin(geo).select("sample", (F.col("f") / F.col("g")).alias("factor"))


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, median, std (population), min, max, q25, q75 of finite values per group."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) != float("inf")))
    q = lambda p: F.percentile(value, F.lit(p))
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), q(0.5).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def quantile_normalise(x: DataFrame, column: str = "sample", item: str = "feature") -> DataFrame:
    """Each column's k-th smallest value (equal ones in the order of item) replaced by the mean of all columns' k-th smallest; columns are equally long. A column of any length is ranked by range partitions."""
    r = rank_within(x, [column], ["value", item], "_r")
    return r.join(r.groupBy("_r").agg(F.avg("value").alias("_m")), "_r").withColumn("value", F.col("_m")).drop("_r", "_m")


def sigmoid(x: Column, a: float, b: float, top: float, shift: float) -> Column:
    return top / (1 + F.exp(-b * (x - a))) + shift


def norm_pdf(x: Column, mean: float, std: float, scale: float) -> Column:
    return scale * F.exp(-0.5 * F.pow((x - mean) / std, 2)) / (std * math.sqrt(2 * math.pi))


def relu(x: Column, a: float, b: float) -> Column:
    return F.greatest(F.lit(0.0), a * x + b)


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope = sample covariance / population variance, intercept = mean(y) - slope * mean(x); 0 and 0 below ten rows or without variance."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.covar_samp(x, y).alias("c"), F.var_pop(x).alias("v"), F.avg(x).alias("mx"), F.avg(y).alias("my"))
    ok = (F.col("n") >= 10) & (F.col("v") > 1e-20)
    slope = F.when(ok, F.col("c") / F.col("v")).otherwise(0.0)
    return a.select(slope.alias("slope"), F.when(ok, F.col("my") - slope * F.col("mx")).otherwise(0.0).alias("intercept"))


def closest(values: DataFrame, value: str, x: float) -> DataFrame:
    return values.agg(F.min_by(value, F.struct(F.abs(F.col(value) - x), F.col(value))).alias("closest"))


def ecdf(df: DataFrame, value: str, by: list[str], most: float) -> DataFrame:
    """Share of all rows of a group at or below each distinct value up to `most`."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    c = df.where(F.col(value) <= most).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return c.join(n, by).select(*by, value, (F.sum("_c").over(w) / F.col("_n")).alias("share"))


def volcano(df: DataFrame, lfc: str = "log2FoldChange", padj: str = "padj", alpha: float = 0.05, least: float = 1.0) -> DataFrame:
    """df with `direction`: up, down or ns."""
    sig = (F.col(padj) < alpha) & (F.abs(F.col(lfc)) >= least)
    return df.withColumn("direction", F.when(sig & (F.col(lfc) > 0), "up").when(sig, "down").otherwise("ns"))


def differential(x: DataFrame, meta: DataFrame, treated: str, control: str, min_count: int = 10, min_samples: int = 1) -> DataFrame:
    """Per feature baseMean, log2FoldChange, lfcSE, stat, pvalue, padj of condition `treated` against `control`, for counts x (sample, feature, value) and meta (sample, condition).

    Counts are scaled by library size and TMM factor; a negative binomial model with a dispersion by moments, shrunk to the features' mean, gives a Wald test.
    Features below min_count in total or seen in fewer than min_samples samples are left out.
    """
    spark = x.sparkSession
    seen = x.where("value > 0").groupBy("feature").agg(F.sum("value").alias("t"), F.count(F.lit(1)).alias("k")).where((F.col("t") >= min_count) & (F.col("k") >= min_samples)).select("feature")
    x = materialize(x.join(seen, "feature").join(meta.where(F.col("condition").isin(treated, control)), "sample"), "counts")
    lib = x.groupBy("sample").agg(F.sum("value").alias("lib")).join(tmm_factors(x), "sample").collect()
    eff = {r["sample"]: r["lib"] * r["factor"] for r in lib}
    g = math.exp(sum(map(math.log, eff.values())) / len(eff))
    sf = F.broadcast(spark.createDataFrame([(k, v / g) for k, v in eff.items()], "sample string, sf double"))
    y = x.join(sf, "sample").withColumn("y", F.col("value") / F.col("sf"))
    n = {r.condition: r["n"] for r in x.select("sample", "condition").distinct().groupBy("condition").agg(F.count(F.lit(1)).alias("n")).collect()}
    nt, nc = n.get(treated, 0), n.get(control, 0)
    pick = lambda c, e: F.coalesce(F.sum(F.when(F.col("condition") == c, e)), F.lit(0.0))
    a = y.groupBy("feature").agg(pick(treated, F.col("y")).alias("st"), pick(control, F.col("y")).alias("sc"), pick(treated, F.col("y") ** 2).alias("qt"), pick(control, F.col("y") ** 2).alias("qc"))
    mt, mc = F.col("st") / nt, F.col("sc") / nc
    ss = F.col("qt") - nt * mt * mt + F.col("qc") - nc * mc * mc
    a = a.withColumn("mt", mt).withColumn("mc", mc).withColumn("baseMean", (F.col("st") + F.col("sc")) / (nt + nc)).withColumn("v", ss / max(1, nt + nc - 2))
    a = a.withColumn("disp", F.greatest(F.lit(1e-8), (F.col("v") - F.col("baseMean")) / (F.col("baseMean") ** 2)))
    mean = a.agg(F.avg("disp")).first()[0] or 0.0
    d = (F.col("disp") * (nt + nc - 2) + mean * 10) / (nt + nc + 8)
    half = F.lit(0.5)
    var = (1 / F.greatest("mt", half) + d) / nt + (1 / F.greatest("mc", half) + d) / nc
    a = a.withColumn("log2FoldChange", F.log2((F.col("mt") + 0.125) / (F.col("mc") + 0.125))).withColumn("lfcSE", F.sqrt(var) / math.log(2))
    a = a.withColumn("stat", F.col("log2FoldChange") / F.col("lfcSE")).withColumn("pvalue", normal_two_sided("stat"))
    return bh_fdr(a.select("feature", "baseMean", "log2FoldChange", "lfcSE", "stat", "pvalue"), "pvalue", name="padj")


def seeded(key: Column | str, seed: int) -> Column:
    """A number in [0, 2^60) from the digest of a key and a seed, the same in every engine that knows MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 15), 16, 10).cast("bigint")


def matched_sample(target: DataFrame, pool: DataFrame, n_bins: int = 10, per_bin: int | None = None, log: bool = True, seed: int = 0) -> DataFrame:
    """Rows of pool (id, value) whose values are distributed like target's: bins at the target's percentiles, in each as many as the target has (or per_bin), by a seeded hash of the id."""
    f = (lambda c: F.log1p(c)) if log else (lambda c: c)
    t = target.select(f(F.col("value")).alias("v"))
    edges = t.agg(F.percentile("v", F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])).alias("e")).first().e
    b = lambda c: sum(((c >= F.lit(float(e))).cast("int") for e in edges), F.lit(0))
    need = t.groupBy(b(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("need"))
    lo, hi = t.agg(F.min("v"), F.max("v")).first()
    p = pool.withColumn("_v", f(F.col("value"))).where(F.col("_v").between(lo, hi)).withColumn("bin", b(F.col("_v"))).withColumn("_h", seeded(F.col("id").cast("string"), seed))
    r = rank_within(p.join(F.broadcast(need), "bin"), ["bin"], ["_h", "id"], "_r")
    return r.where(F.col("_r") <= (F.lit(per_bin) if per_bin else F.col("need"))).select("id", "value", "bin")


def down_sample(cells: DataFrame, by: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each group as the smallest has, chosen by a seeded hash."""
    least = cells.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("_n"))
    r = rank_within(cells.withColumn("_h", seeded(key, seed)), [by], ["_h", key], "_r")
    return r.join(F.broadcast(least), F.col("_r") <= F.col("_n")).drop("_r", "_n", "_h")


def pseudo_replicates(cells: DataFrame, n: int, ratio: float, key: str, seed: int = 0) -> DataFrame:
    """n subsets of round(ratio * rows) rows each, by seeded hashes, with `replicate`."""
    total = cells.count()
    reps = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    r = rank_within(reps.withColumn("_h", seeded(F.concat_ws(":", "replicate", key), seed)), ["replicate"], ["_h", key], "_r")
    return r.where(F.col("_r") <= round(ratio * total)).drop("_r", "_h")


def closed_form_doublet(nd: Column, n: Column, rho: float = 0.1, r: float = 2.0, se_rho: float = 0.03) -> tuple[Column, Column]:
    """(score, standard error) of a doublet among n neighbours of which nd are simulated; r simulated for each observed row, rho the expected share."""
    q = (nd + 1) / (n + 2)
    den = 1 - rho - q * (1 - rho - rho / r)
    score = q * rho / r / den
    se_q = F.sqrt(q * (1 - q) / (n + 3))
    se = q * rho / r / (den * den) * F.sqrt(F.pow(se_q / q * (1 - rho), 2) + F.pow(F.lit(se_rho / rho) * (1 - q), 2))
    return score, se


def numpy_bh(p: np.ndarray) -> np.ndarray:
    """The same rates as bh_fdr for an array."""
    o = np.argsort(p, kind="mergesort")
    q = p[o] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[o] = np.minimum(1, np.minimum.accumulate(q[::-1])[::-1])
    return out


def quantile_ratio_factors(x: DataFrame, sample: str = "sample", n: int = 1000) -> DataFrame:
    """(sample, quantile, value, target, ratio): each sample's positive values at n quantiles from 0.05 to 0.99, the mean over samples and its ratio to the sample's, from which scaling curves are fitted."""
    q = [0.05 + 0.94 * i / (n - 1) for i in range(n)]
    a = x.where("value > 0").groupBy(sample).agg(F.percentile("value", F.array(*map(F.lit, q))).alias("v")).select(sample, F.posexplode("v").alias("quantile", "value"))
    t = a.groupBy("quantile").agg(F.avg("value").alias("target"))
    return a.join(F.broadcast(t), "quantile").select(sample, "quantile", "value", "target", (F.col("target") / F.col("value")).alias("ratio"))


def capped_norm(value: Column, low: float, high: float, factor: Column | float) -> Column:
    """value within [low, high], times a factor (a number or a curve such as sigmoid of the value)."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value)) * factor


def is_symmetric(m: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """One row: whether a long matrix (a, b, value), absent entries being 0, equals its transpose."""
    both = m.select("a", "b", "value").unionByName(m.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("value")).alias("value")))
    d = both.groupBy("a", "b").agg(F.abs(F.sum("value")).alias("d"))
    return d.agg((F.coalesce(F.max("d"), F.lit(0.0)) <= tolerance).alias("symmetric"))


def ks_two_sample(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """(d, p_value): greatest distance between two groups' distribution functions and its asymptotic probability. Distinct values are summed along range partitions."""
    from locusmill.operators.intervals import running_sum

    v = df.where(F.col(group).isin(a, b)).groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    v = global_rank(v, ["v"], "r").withColumn("k", F.lit(1))
    n = v.agg(F.sum("na").alias("a"), F.sum("nb").alias("b")).first()
    s = running_sum(v.withColumn("d", F.col("na") / float(n.a or 1) - F.col("nb") / float(n.b or 1)), ["k"], "r", "d")
    d = s.agg(F.max(F.abs("running")).alias("d"))
    en = math.sqrt((n.a or 0) * (n.b or 0) / max(1, (n.a or 0) + (n.b or 0)))
    x = (F.lit(en) + 0.12 + 0.11 / max(en, 1e-9)) * F.col("d")
    terms = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2 * k * k * x * x) for k in range(1, 101)), F.lit(0.0))
    return d.select("d", F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms))).alias("p_value"))
