"""Aligned reads as rows (read_id, flag, chrom, pos, end, mapq, strand, mate_chrom, mate_pos, tlen): filters, cut shifts, fragments, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.operators.intervals import coverage_runs, overlap_filter

PAIRED, UNMAPPED, MATE_UNMAPPED, SECONDARY, DUPLICATE, SUPPLEMENTARY, SECOND = 0x2, 0x4, 0x8, 0x100, 0x400, 0x800, 0x80


def has(flag: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(flag)) != 0


def filter_reads(reads: DataFrame, mapq: int = 30, proper: bool = True, drop_chroms: tuple[str, ...] = ("chrM",), duplicates: bool = True) -> DataFrame:
    """Primary alignments of mapped pairs, by default proper ones, of at least `mapq`, off the chromosomes named, duplicates dropped."""
    ok = ~has(UNMAPPED | MATE_UNMAPPED | SECONDARY | SUPPLEMENTARY | (DUPLICATE if duplicates else 0)) & (F.col("mapq") >= mapq) & ~F.col("chrom").isin(*drop_chroms)
    return reads.where(ok & has(PAIRED) if proper else ok)


def filter_by_regions(reads: DataFrame, regions: DataFrame, include: bool = True, extend: int = 0, mapq: int = 30) -> DataFrame:
    """Mapped reads of at least mapq, without duplicates, that overlap a region (or none)."""
    r = reads.where(~has(UNMAPPED | DUPLICATE) & (F.col("mapq") >= mapq)).withColumn("start", F.col("pos"))
    return overlap_filter(r, regions, anti=not include, slack=extend).drop("start")


def shift_cuts(reads: DataFrame, plus: int = 4, minus: int = -5) -> DataFrame:
    """Reads moved to the cut's middle: forward ones by `plus`, reverse ones by `minus`, places at least 0; mate places and the template length follow."""
    rev = F.col("strand") == "-"
    move = F.when(rev, minus).otherwise(plus)
    mate = F.when(rev, plus).otherwise(minus)
    z = lambda c: F.greatest(c, F.lit(0))
    t = F.when(F.col("tlen") > 0, F.col("tlen") - plus + minus).when(F.col("tlen") < 0, F.col("tlen") + plus - minus).otherwise(F.col("tlen"))
    return reads.withColumns({"end": z(F.col("end") + move), "pos": z(F.col("pos") + move), "mate_pos": z(F.col("mate_pos") + mate), "tlen": t})


def reads_to_fragments(reads: DataFrame, sample: str) -> DataFrame:
    """(chrom, start, end, sample): the span of both mates of a pair on one chromosome, if not empty."""
    p = reads.groupBy("read_id", "chrom").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("start"), F.max("end").alias("end"))
    return p.where((F.col("n") == 2) & (F.col("end") > F.col("start"))).select("chrom", "start", "end", F.lit(sample).alias("sample"))


def reads_to_coverage(reads: DataFrame, scale: str = "cpm", extend: int | None = None) -> DataFrame:
    """Coverage runs of reads, extended to `extend` bases from their 5' end if given: counts, or per million reads (cpm)."""
    r = reads.withColumn("start", F.col("pos"))
    if extend:
        rev = F.col("strand") == "-"
        r = r.withColumns({"start": F.when(rev, F.greatest(F.col("end") - extend, F.lit(0))).otherwise(F.col("pos")), "end": F.when(rev, F.col("end")).otherwise(F.col("pos") + extend)})
    runs = coverage_runs(r, ["chrom"])
    if scale == "none":
        return runs
    n = reads.agg(F.count(F.lit(1)).alias("_n"))
    return runs.crossJoin(F.broadcast(n)).withColumn("value", F.col("value") * 1e6 / F.col("_n")).drop("_n")


def split_by_group(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """reads (with barcode) and their `group` of groups (barcode, group), to be written by group."""
    return reads.join(groups, "barcode")
