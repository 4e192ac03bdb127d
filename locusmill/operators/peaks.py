"""Peak sets: fixed-width merging, peaks reproducible over replicates, thinning, and calling from coverage.

The greedy choices depend on neighbours only, so rows are grouped by the run of overlapping windows that they lie in, not by chromosome.
"""

from __future__ import annotations

import bisect

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusmill.operators.intervals import overlap_join
from locusmill.operators.regions import merge_regions
from locusmill.util import group_codes, key_chunks, keyed


def by_run(df: DataFrame, lo, hi, fold, schema: str) -> DataFrame:
    """fold applied to chunks of rows, each with whole runs of windows [lo, hi) that overlap; column `run` numbers them within a chunk."""
    d = df.withColumn("_o_start", F.col("start")).withColumn("_o_end", F.col("end")).withColumn("_a", lo).withColumn("end", hi).withColumn("start", F.col("_a")).drop("_a")
    runs = merge_regions(d.select("chrom", "start", "end"))
    j = overlap_join(d, runs).withColumn("start", F.col("_o_start")).withColumn("end", F.col("_o_end")).drop("_o_start", "_o_end", "r_end")

    def chunk(batches):
        for t in key_chunks(batches):
            p = t.drop_columns(["_h"]).to_pandas()
            p["run"] = group_codes(t, ["r_chrom", "r_start"])[0]
            out = fold(p)
            if len(out):
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return keyed(j, ["r_chrom", "r_start"]).mapInArrow(chunk, schema)


def merge_peaks(peaks: DataFrame, sizes: DataFrame, half_width: int = 250) -> DataFrame:
    """(chrom, start, end, summit, score): windows of half_width around the summits of peaks (chrom, start, end, summit, score), clamped to the chromosome; by falling score a window
    is kept if it overlaps none kept so far. Ties go to the first summit."""
    s = peaks.join(F.broadcast(sizes.select("chrom", "length")), "chrom")
    s = s.withColumn("_s", F.greatest(F.col("summit") - half_width, F.lit(0))).withColumn("_e", F.least(F.col("summit") + half_width, "length"))
    s = s.select("chrom", F.col("_s").alias("start"), F.col("_e").alias("end"), "summit", F.col("score").cast("double").alias("score")).where("start < end").distinct()

    def fold(p):
        p = p.sort_values(["run", "score", "summit"], ascending=[True, False, True], kind="stable")
        a, b, g = p["start"].tolist(), p["end"].tolist(), p["run"].tolist()
        kept, starts, ends = [], [], []
        for i in range(len(p)):
            if i and g[i] != g[i - 1]:
                starts, ends = [], []
            # kept windows of a run don't overlap, so they stay sorted and only the neighbours matter
            k = bisect.bisect_left(starts, a[i])
            if (k == 0 or ends[k - 1] <= a[i]) and (k == len(starts) or starts[k] >= b[i]):
                starts.insert(k, a[i])
                ends.insert(k, b[i])
                kept.append(i)
        return p.iloc[kept][["chrom", "start", "end", "summit", "score"]]

    return by_run(s, F.col("start"), F.col("end"), fold, "chrom string, start bigint, end bigint, summit bigint, score double")


def reproducible_peaks(peaks: DataFrame, k: int, extend: int = 250) -> DataFrame:
    """(chrom, summit, score, replicates): summits of all replicates (replicate, chrom, summit, score) in groups that reach at most `extend` from their first summit; of groups
    with at least k replicates the summit with the greatest score."""
    d = peaks.withColumn("start", F.col("summit")).withColumn("end", F.col("summit") + 1)

    def fold(p):
        p = p.sort_values(["run", "summit"], kind="stable").reset_index(drop=True)
        ids, first, last = [], None, None
        for r, v in zip(p["run"].tolist(), p["summit"].tolist(), strict=True):
            if r != last or v - first > extend:
                first, last = v, r
                ids.append(len(ids))
            else:
                ids.append(ids[-1])
        p["group"] = ids
        p["replicates"] = p.groupby("group")["replicate"].transform("nunique")
        p = p[p["replicates"] >= k].sort_values(["group", "score", "summit"], ascending=[True, False, True], kind="stable")
        return p.drop_duplicates("group")[["chrom", "summit", "score", "replicates"]].astype({"replicates": "int32"})

    return by_run(d, F.col("summit"), F.col("summit") + extend + 1, fold, "chrom string, summit bigint, score double, replicates int")


def thin_peaks(peaks: DataFrame, size: int) -> DataFrame:
    """(chrom, start, end): in order of their middle, peaks at least `size` from the last one kept."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)

    def fold(p):
        p = p.assign(m=(p["start"] + p["end"]) // 2).sort_values(["run", "m", "start"], kind="stable")
        kept, last, run = [], None, None
        for i, (r, m) in enumerate(zip(p["run"].tolist(), p["m"].tolist(), strict=True)):
            if r != run or m - last >= size:
                kept.append(i)
                last, run = m, r
        return p.iloc[kept][["chrom", "start", "end"]]

    return by_run(peaks.select("chrom", "start", "end"), mid, mid + size, fold, "chrom string, start bigint, end bigint")


def call_peaks(runs: DataFrame, genome: int, fold: float = 5.0, min_width: int = 50, gap: int = 30) -> DataFrame:
    """(chrom, start, end, summit, score): stretches of coverage runs at least `fold` times the mean over the genome's length, joined over gaps of at most `gap`; score is -log10 of the Poisson tail at the summit."""
    lam = (runs.agg(F.sum(F.col("value") * (F.col("end") - F.col("start")))).first()[0] or 0) / genome
    hot = runs.where(F.col("value") >= max(fold * lam, 2))
    s = merge_regions(hot.withColumn("end", F.col("end") + gap).select("chrom", "start", "end"), touching=True).withColumn("end", F.col("end") - gap)
    j = overlap_join(hot, s).groupBy("r_chrom", "r_start", "r_end").agg(F.max(F.struct("value", (-F.col("start")).alias("n"), F.floor((F.col("start") + F.col("end")) / 2).alias("summit"))).alias("x"))

    @F.pandas_udf(T.DoubleType())
    def tail(v: pd.Series) -> pd.Series:
        import math

        def one(k):
            # ln of the Poisson tail by its first terms
            k = int(math.ceil(k))
            t = -lam + k * math.log(max(lam, 1e-12)) - math.lgamma(k + 1)
            s, term = 1.0, 1.0
            for i in range(1, 200):
                term *= lam / (k + i)
                s += term
                if term < 1e-15 * s:
                    break
            return -(t + math.log(s)) / math.log(10)

        return v.astype(float).map(one)

    out = j.select(F.col("r_chrom").alias("chrom"), F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("x.summit").alias("summit"), tail(F.col("x.value").cast("double")).alias("score"))
    return out.where(F.col("end") - F.col("start") >= min_width)
