"""Joins of half-open intervals: overlap, semi, anti, point, as-of, nearest and band, and prefix sums along an axis.

Everything is an equi-join on (chrom, bin): an interval is repeated for each bin of 2^bits positions that it touches, and a pair is kept in the first bin
that both share, so no pair comes out twice. The right side is broadcast if its row count, which is checked, is small. Nothing is partitioned by
chromosome alone where rows are many: running values go by bins first and by the few bins of a chromosome after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.util import small

BITS = 14


def bins(start: Column | str, end: Column | str, bits: int = BITS) -> Column:
    """The bins that [start, end) touches, start < end."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.sequence(F.shiftright(s, bits), F.shiftright(e - 1, bits))


def overlap_join(left: DataFrame, right: DataFrame, how: str = "inner", prefix: str = "r_", bits: int = BITS, slack: int = 0, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Pairs of rows of the same keys with left.start < right.end and left.end > right.start; the right side's columns get `prefix`.

    slack widens the right intervals on both sides for the comparison (a band join); how is inner or left (rows without a partner with NULLs). Empty or reversed
    intervals and NULL coordinates meet nothing.
    """
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns])
    rs, re = F.col(f"{prefix}start") - slack, F.col(f"{prefix}end") + slack
    r = r.where(re > rs).withColumn("_rb", F.explode(bins(rs, re, bits)))
    ok = left.where(F.col("start") < F.col("end")).withColumn("_lb", F.explode(bins("start", "end", bits)))
    on = (F.col("_lb") == F.col("_rb")) & (F.col("start") < re) & (F.col("end") > rs)
    for k in keys:
        on = on & (F.col(k) == F.col(prefix + k))
    hit = ok.join(small(r), on).where(F.col("_lb") == F.greatest(F.shiftright("start", bits), F.shiftright(rs, bits))).drop("_lb", "_rb")
    if how == "inner":
        return hit
    rest = overlap_filter(left, right, anti=True, bits=bits, slack=slack, keys=keys)
    return hit.unionByName(rest, allowMissingColumns=True)


def overlap_filter(left: DataFrame, right: DataFrame, anti: bool = False, bits: int = BITS, slack: int = 0, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Left rows that overlap some right row (semi), or none (anti; rows with NULL coordinates belong to these). Repeated rows stay repeated."""
    place = [*keys, "start", "end"]
    hits = overlap_join(left.select(*place).distinct(), right.select(*place), bits=bits, slack=slack, keys=keys).select(*place).distinct()
    hits = hits.select(*[F.col(c).alias(f"_h_{c}") for c in place])
    on = None
    for c in place:
        x = F.col(c) == F.col(f"_h_{c}")
        on = x if on is None else on & x
    return left.join(hits, on, "left_anti" if anti else "left_semi")


def point_join(points: DataFrame, right: DataFrame, pos: str = "pos", prefix: str = "r_", bits: int = BITS) -> DataFrame:
    """Pairs with right.start <= pos < right.end."""
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).where(F.col(f"{prefix}start") < F.col(f"{prefix}end")).withColumn("_rb", F.explode(bins(f"{prefix}start", f"{prefix}end", bits)))
    on = (F.col("chrom") == F.col(f"{prefix}chrom")) & (F.shiftright(pos, bits) == F.col("_rb")) & (F.col(pos) >= F.col(f"{prefix}start")) & (F.col(pos) < F.col(f"{prefix}end"))
    return points.join(small(r), on).drop("_rb")


def last_started(right: DataFrame, bits: int = 20) -> DataFrame:
    """Intervals trimmed to where they are the last to have started on their chromosome: a point lies in at most one of them, its as-of partner if that still covers it.

    The next start is looked for within bins of starts first, then among the bins' first ones, so no task sees a chromosome's intervals.
    """
    r = right.withColumn("_sb", F.shiftright("start", bits))
    inside = F.lead("start").over(W.partitionBy("chrom", "_sb").orderBy("start", "end"))
    heads = r.groupBy("chrom", "_sb").agg(F.min("start").alias("_next")).withColumn("_next", F.lead("_next").over(W.partitionBy("chrom").orderBy("_sb")))
    r = r.withColumn("_in", inside).join(heads, ["chrom", "_sb"]).withColumn("end", F.least("end", F.coalesce("_in", "_next", "end")))
    return r.select(*right.columns).where(F.col("start") < F.col("end"))


def asof_join(points: DataFrame, right: DataFrame, pos: str = "pos", prefix: str = "r_") -> DataFrame:
    """Each point with the last interval that starts at or before it, if that interval covers it; the partner's `end` comes out untrimmed."""
    r = last_started(right.withColumn("full_end", F.col("end")))
    return point_join(points, r, pos, prefix).withColumn(f"{prefix}end", F.col(f"{prefix}full_end")).drop(f"{prefix}full_end")


def nearest(points: DataFrame, targets: DataFrame, pos: str = "pos", target: str = "at", bits: int = 20) -> DataFrame:
    """points with _left and _right: the last target position at or before and the first after each point on its chromosome, NULL where there is none."""
    t = targets.select("chrom", F.col(target).alias("_t")).where(F.col("_t").isNotNull()).distinct().withColumn("_bin", F.shiftright("_t", bits))
    p = points.withColumn("_bin", F.shiftright(pos, bits))
    per = t.groupBy("chrom", "_bin").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
    per = per.unionByName(p.select("chrom", "_bin").distinct(), allowMissingColumns=True).groupBy("chrom", "_bin").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    by = W.partitionBy("chrom").orderBy("_bin")
    per = per.select(
        "chrom",
        "_bin",
        F.last("_hi", True).over(by.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", True).over(by.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    both = p.withColumn("_t", F.lit(None).cast("bigint")).withColumn("_p", F.col(pos)).unionByName(t.withColumn("_p", F.col("_t")), allowMissingColumns=True)
    inside = W.partitionBy("chrom", "_bin").orderBy("_p", F.col("_t").isNull())
    both = both.withColumn("_l", F.last("_t", True).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("_r", F.first("_t", True).over(inside.rowsBetween(1, W.unboundedFollowing)))
    got = both.where(F.col("_t").isNull() & F.col(pos).isNotNull()).join(per, ["chrom", "_bin"])
    return got.select(*points.columns, F.coalesce("_l", "_before").alias("_left"), F.coalesce("_r", "_after").alias("_right"))


def distance_to_nearest(features: DataFrame, peaks: DataFrame, pos: str = "tss", unit: str = "bp") -> DataFrame:
    """features with `distance` to the nearest peak centre floor((start + end) / 2) of the chromosome; features on chromosomes without peaks are left out. unit: bp or kb."""
    centres = peaks.select("chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("at"))
    n = nearest(features, centres, pos).where(F.col("_left").isNotNull() | F.col("_right").isNotNull())
    d = F.least(F.abs(F.col(pos) - F.col("_left")), F.abs(F.col("_right") - F.col(pos)))
    return n.withColumn("distance", d / 1000 if unit == "kb" else d).drop("_left", "_right")


def filter_distal(peaks: DataFrame, features: DataFrame, min_distance: int = 2500, pos: str = "tss") -> DataFrame:
    """Peaks whose centre is at least min_distance away from every feature of their chromosome, those of chromosomes without features included."""
    p = peaks.withColumn("_c", F.floor((F.col("start") + F.col("end")) / 2))
    n = nearest(p, features.select("chrom", F.col(pos).alias("at")), "_c")
    d = F.least(F.abs(F.col("_c") - F.col("_left")), F.abs(F.col("_right") - F.col("_c")))
    return n.where(d.isNull() | (d >= min_distance)).drop("_c", "_left", "_right")


def classify_by_overlap(sets: dict[str, DataFrame], specific: str = "-specific", sep: str = "/", shared: str = " shared") -> DataFrame:
    """Intervals of the sets in order of priority with a class: those of a set that overlap no earlier set, `X-specific` or `X/Y shared` by the later sets that they overlap."""
    names, out = list(sets), None
    for i, n in enumerate(names):
        d = sets[n].select("chrom", "start", "end")
        for e in names[:i]:
            d = overlap_filter(d, sets[e], anti=True)
        d = d.withColumn("_x", F.array(F.lit(n)))
        for later in names[i + 1 :]:
            hit = overlap_filter(d.select("chrom", "start", "end").distinct(), sets[later]).withColumn("_m", F.lit(later))
            d = d.join(hit, ["chrom", "start", "end"], "left").withColumn("_x", F.when(F.col("_m").isNotNull(), F.array_append("_x", F.col("_m"))).otherwise(F.col("_x"))).drop("_m")
        label = F.when(F.size("_x") > 1, F.concat(F.array_join("_x", sep), F.lit(shared))).otherwise(F.lit(n + specific))
        d = d.withColumn("class", label).drop("_x")
        out = d if out is None else out.unionByName(d)
    return out


def band_join(left: DataFrame, right: DataFrame, pos: str, r_pos: str, reach: int, prefix: str = "r_") -> DataFrame:
    """Pairs on a chromosome with |left.pos - right.pos| <= reach, with the signed `distance` left - right. Bins are as wide as the reach, so a row meets three of them."""
    w = max(1, reach)
    r = right.select(*[F.col(c).alias(prefix + c) for c in right.columns]).withColumn("_rb", F.floor(F.col(prefix + r_pos) / w))
    near = left.withColumn("_lb", F.explode(F.array(*[F.floor(F.col(pos) / w) + i for i in (-1, 0, 1)])))
    d = F.col(pos) - F.col(prefix + r_pos)
    return near.join(small(r), (F.col("chrom") == F.col(f"{prefix}chrom")) & (F.col("_lb") == F.col("_rb")) & (F.abs(d) <= reach)).withColumn("distance", d).drop("_lb", "_rb")


def running_sum(df: DataFrame, keys: list[str], pos: str, value: str, bits: int = 20) -> DataFrame:
    """df (one row per keys and pos) with `running`, the sum of value up to and with the row, and `next_pos`, the following row's pos, both per keys in order of pos.

    Two steps: within bins of 2^bits positions, and over the bins' totals, of which there are few.
    """
    b = df.withColumn("_bin", F.shiftright(pos, bits))
    per = b.groupBy(*keys, "_bin").agg(F.sum(value).alias("_sum"), F.min(pos).alias("_first"))
    by = W.partitionBy(*keys).orderBy("_bin")
    per = per.select(*keys, "_bin", F.sum("_sum").over(by.rowsBetween(W.unboundedPreceding, -1)).alias("_off"), F.lead("_first").over(by).alias("_nxt"))
    inside = W.partitionBy(*keys, "_bin").orderBy(pos)
    b = b.withColumn("running", F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0))).withColumn("next_pos", F.lead(pos).over(inside))
    return b.join(per, [*keys, "_bin"]).withColumn("running", F.col("running") + F.coalesce("_off", F.lit(0))).withColumn("next_pos", F.coalesce("next_pos", "_nxt")).drop("_bin", "_off", "_nxt")


def coverage_runs(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Runs (keys, start, end, value) of the summed weight of intervals, value not 0. Runs end at every interval border; equal neighbours aren't joined."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    ev = df.where(F.col("start") < F.col("end")).select(*keys, F.inline(F.array(F.struct(F.col("start").alias("pos"), w.alias("d")), F.struct(F.col("end").alias("pos"), (-w).alias("d")))))
    # an interval's two borders at one place cancel out but still end a run
    ev = ev.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    runs = running_sum(ev, keys, "pos", "d")
    return runs.where(F.col("next_pos").isNotNull() & (F.col("running") != 0)).select(*keys, F.col("pos").alias("start"), F.col("next_pos").alias("end"), F.col("running").alias("value"))
