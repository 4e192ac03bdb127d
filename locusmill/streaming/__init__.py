"""Streams of fragments and events: incremental tile counts, windowed aggregates with late data, per-key state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fragment_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def tile_counts(stream: DataFrame, width: int = 5000, time: str = "loaded_at", late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """(window, chrom, tile, reads) per event-time window; rows later than the watermark are dropped by it."""
    s = stream.withWatermark(time, late).withColumn("tile", F.floor(F.col("start") / width))
    return s.groupBy(F.window(time, window), "chrom", "tile").agg(F.sum("count").alias("reads"), F.count(F.lit(1)).alias("n"))


def session_counts(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))


def distinct_stream(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def upsert_totals(batch: DataFrame, path: str, keys: list[str], value: str, batch_id: int) -> None:
    """foreachBatch target: adds a batch's sums to the totals under path, as a folder `v=<batch_id>` of its own; `latest_totals` reads them.

    A batch that comes again after a failure is based on the same earlier version and replaces its own folder, so it counts once. A version counts once its write has
    ended; until then, and if the job dies meanwhile, the one before holds. Versions before the last two are deleted.
    """
    spark = batch.sparkSession
    new = batch.groupBy(*keys).agg(F.sum(value).alias(value))
    done = [v for v in _versions(spark, path) if v < batch_id]
    if done:
        new = spark.read.parquet(f"{path}/v={done[-1]}").unionByName(new).groupBy(*keys).agg(F.sum(value).alias(value))
    new.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
    for v in done[:-1]:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose write has ended, which leaves a file _SUCCESS."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(x.getPath().getParent().getName()[2:]) for x in found or [])


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the last version written by `upsert_totals`."""
    return spark.read.parquet(f"{path}/v={_versions(spark, path)[-1]}")
