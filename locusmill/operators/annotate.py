"""Peaks against genes: overlapping genes, promoter, distal and body windows, and the kind of each peak."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.operators.intervals import overlap_join

KINDS = ("promoter", "body", "down_distal", "up_distal")


def find_genes(peaks: DataFrame, genes: DataFrame, up: int = 5000, down: int = 0) -> DataFrame:
    """(feature, genes): sorted distinct names, joined by `;`, of genes whose body with up and down bases overlaps the peak; intergenic if none, unassigned on a chromosome without genes."""
    plus = F.col("strand") == "+"
    w = genes.select("gene", "chrom", (F.col("start") - F.when(plus, up).otherwise(down)).alias("start"), (F.col("end") + F.when(plus, down).otherwise(up)).alias("end"))
    hit = overlap_join(peaks.select("feature", "chrom", "start", "end"), w).groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("r_gene")), ";").alias("genes"))
    known = genes.select("chrom").distinct().withColumn("_k", F.lit("intergenic"))
    return peaks.select("feature", "chrom").join(F.broadcast(known), "chrom", "left").join(hit, "feature", "left").select("feature", F.coalesce("genes", "_k", F.lit("unassigned")).alias("genes"))


def gene_zones(genes: DataFrame, promoter: tuple[int, int] = (100, 1000), distal: tuple[int, int] = (1000, 200_000)) -> DataFrame:
    """(gene, kind, chrom, start, end): promoter around the TSS, body, and up and down distal windows by strand, clamped to [0, greatest gene end of the chromosome]."""
    ends = genes.groupBy("chrom").agg(F.max("end").alias("_max"))
    g = genes.join(F.broadcast(ends), "chrom").withColumn("t", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))).withColumn("plus", F.col("strand") != "-")
    near, far = distal
    w = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("s"), b.alias("e"))
    t, plus = F.col("t"), F.coalesce("plus", F.lit(True))
    before, after = (t - far, t - near), (t + near, t + far)
    pick = lambda x, y: [F.when(plus, a).otherwise(b) for a, b in zip(x, y, strict=True)]
    zones = F.array(
        w("promoter", *pick((t - promoter[1], t + promoter[0]), (t - promoter[0], t + promoter[1]))),
        w("body", F.col("start"), F.col("end")),
        w("up_distal", *pick(before, after)),
        w("down_distal", *pick(after, before)),
    )
    z = g.select("gene", "chrom", "_max", F.inline(zones))
    return z.select("gene", "kind", "chrom", F.greatest("s", F.lit(0)).alias("start"), F.least("e", "_max").alias("end")).where("start < end")


def annotate_peaks(peaks: DataFrame, genes: DataFrame, share: float = 0.9, **zones) -> DataFrame:
    """Per peak and zone kind the gene of the zone that covers more than `share` of the peak (at least that share of the shorter of both) with the closest middle; and the peak's kind by
    priority promoter, body, down_distal, up_distal, else intergenic. Columns: feature, kind, and one column of gene per zone kind."""
    j = overlap_join(peaks.select("feature", "chrom", "start", "end"), gene_zones(genes, **zones))
    ov = F.least("end", "r_end") - F.greatest("start", "r_start")
    far = F.abs(F.col("start") + F.col("end") - F.col("r_start") - F.col("r_end"))
    best = j.where(ov > share * (F.col("end") - F.col("start"))).groupBy("feature").agg(*[F.min(F.when(F.col("r_kind") == k, F.struct(far.alias("d"), F.col("r_gene").alias("g"))))["g"].alias(k) for k in KINDS])
    out = peaks.select("feature").join(best, "feature", "left")
    kind = F.lit("intergenic")
    for k in reversed(KINDS):
        kind = F.when(F.col(k).isNotNull(), k).otherwise(kind)
    return out.withColumn("kind", kind).withColumn("near_gene", F.coalesce(*KINDS))
