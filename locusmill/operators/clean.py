"""Cleaning of fragment rows: one spelling of chromosomes, valid coordinates, repeats folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_chrom(c: Column | str) -> Column:
    """One spelling of a chromosome name: outer blanks, case and a missing `chr` disregarded, MT is M. NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    # the usual spelling passes without a string being built; the rest is rewritten
    usual = c.rlike("^chr([0-9XYM]+)$")
    s = F.regexp_replace(F.lower(F.trim(c)), "^chr", "")
    rest = F.when(s == "mt", F.lit("M")).when(s.isin("x", "y", "m"), F.upper(s)).when(s.startswith("un_"), F.concat(F.lit("Un_"), F.substring(s, 4, 1 << 20))).otherwise(s)
    return F.when(usual, c).otherwise(F.concat(F.lit("chr"), rest))


def valid_fragments(df: DataFrame, keep: tuple[str, ...] = ("count",)) -> DataFrame:
    """Rows with a barcode (neither null nor empty) and 0 <= start < end; chrom in one spelling; a null count is 1. Repeats are kept.

    Columns beside sample_id, chrom, start, end, barcode and those in `keep` are dropped.
    """
    ok = (F.col("barcode") != "") & (F.col("start") >= 0) & (F.col("start") < F.col("end"))
    cols = [F.coalesce(F.col(c), F.lit(1)).alias(c) if c == "count" else F.col(c) for c in keep]
    return df.where(ok).select("sample_id", "barcode", clean_chrom("chrom").alias("chrom"), "start", "end", *cols)


def clean_fragments(df: DataFrame) -> DataFrame:
    """Valid fragments, rows that agree in everything but loaded_at folded into one.

    The fold shuffles on all six columns, so that no cell and no chromosome, however large, goes to one task.
    Empty input gives an empty result; NULL sample_id or chrom are values like others.
    """
    return valid_fragments(df).distinct()
