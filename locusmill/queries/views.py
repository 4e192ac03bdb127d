"""Common inputs of the queries and the same as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.operators.clean import clean_chrom, clean_fragments
from locusmill.queries.registry import CLEAN_SQL
from locusmill.util import table


def frags(spark, d):
    """Clean fragments with `cell` = sample#barcode."""
    return clean_fragments(table(spark, d, "fragments")).select(F.concat_ws("#", "sample_id", "barcode").alias("cell"), "chrom", "start", "end", "count")


def peaks(spark, d):
    return table(spark, d, "peaks").select(F.col("label").alias("feature"), clean_chrom("chrom").alias("chrom"), "start", "end", "score")


def genes(spark, d):
    """Gene rows of the annotation, one per gene_id (the first by row_id), with tss."""
    a = table(spark, d, "annotation").where((F.col("feature") == "gene") & F.col("gene_id").isNotNull() & (F.col("start") < F.col("end")))
    g = a.groupBy(F.col("gene_id").alias("gene")).agg(F.min_by(F.struct("seqname", "start", "end", "strand"), "row_id").alias("x")).select("gene", F.col("x.seqname").alias("chrom"), "x.start", "x.end", "x.strand")
    return g.withColumn("tss", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")))


def groups(spark, d):
    """(cell, group): cell type in lower case without outer blanks, of one row per cell, those with a type."""
    c = table(spark, d, "cells").where(F.col("celltype").isNotNull())
    return c.groupBy(F.concat_ws("#", "sample_id", "barcode").alias("cell")).agg(F.min(F.lower(F.trim("celltype"))).alias("group"))


SQL_VIEWS = f"""{CLEAN_SQL},
f as (select sample_id || '#' || barcode as cell, chrom, "start", "end", "count" from clean),
p as (select label as feature, chrom, "start", "end", score from peaks),
g as (select gene_id as gene, seqname as chrom, "start", "end", strand, case when strand = '-' then "end" else "start" end as tss from
  (select *, row_number() over (partition by gene_id order by row_id) as r from annotation where feature = 'gene' and gene_id is not null and "start" < "end") where r = 1),
gr as (select sample_id || '#' || barcode as cell, min(lower(trim(celltype))) as "group" from cells where celltype is not null group by 1)"""
