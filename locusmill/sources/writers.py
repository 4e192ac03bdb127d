"""Writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bed_lines(df: DataFrame, extra: tuple[str, ...] = ("name", "score", "strand")) -> DataFrame:
    """(value): tab-separated BED lines with the extra columns that df has, NULL as `.`."""
    cols = ["chrom", "start", "end", *[c for c in extra if c in df.columns]]
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in cols]).alias("value"))


def write_bed(df: DataFrame, path: str) -> None:
    bed_lines(df).write.mode("overwrite").text(path)


def write_bedgraph(df: DataFrame, path: str) -> None:
    """Runs in order of place, one file per range of the genome."""
    df.select("chrom", "start", "end", "value").repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").csv(path, sep="\t")


def write_groups(df: DataFrame, path: str, by: str = "group", form: str = "csv") -> None:
    """One folder for each group."""
    w = df.write.mode("overwrite").partitionBy(by)
    w.csv(path, sep="\t") if form == "csv" else w.parquet(path)


def write_fragments(df: DataFrame, path: str) -> None:
    """Sorted by place with range partitions, so that row group statistics stand in for an index."""
    df.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.mode("overwrite").parquet(path)


def write_tab(df: DataFrame, path: str, columns: list[str], header: bool = False, compression: str = "none") -> None:
    df.select(*columns).write.mode("overwrite").csv(path, sep="\t", header=header, compression=compression)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made first if it isn't there."""
    jvm = spark._jvm.org.apache.hadoop.fs
    p = jvm.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        save(make(), path)
    return load(spark, path)
