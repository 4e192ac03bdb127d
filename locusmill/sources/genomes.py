"""Chromosome lengths of genome builds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Lengths of GRCh38.
GRCH38 = {
    "chr1": 248956422, "chr2": 242193529, "chr3": 198295559, "chr4": 190214555, "chr5": 181538259, "chr6": 170805979, "chr7": 159345973, "chr8": 145138636, "chr9": 138394717,
    "chr10": 133797422, "chr11": 135086622, "chr12": 133275309, "chr13": 114364328, "chr14": 107043718, "chr15": 101991189, "chr16": 90338345, "chr17": 83257441, "chr18": 80373285,
    "chr19": 58617616, "chr20": 64444167, "chr21": 46709983, "chr22": 50818468, "chrX": 156040895, "chrY": 57227415, "chrM": 16569,
}


def chrom_sizes(spark: SparkSession, sizes: dict[str, int] | None = None) -> DataFrame:
    """(chrom, length) of a build given as a mapping, by default GRCh38. Other builds are read with `read_chrom_sizes`."""
    return spark.createDataFrame(list((sizes or GRCH38).items()), "chrom string, length bigint")
