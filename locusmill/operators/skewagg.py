"""Per-key aggregates over keys of very uneven size: chunk-local combining and a logarithmic fan-in of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.util import shuffle_width


def tree_aggregate(df: DataFrame, keys: list[str], partials: dict[str, Column], merges: dict[str, str], chunks: int | None = None, fan_in: int = 8) -> DataFrame:
    """Aggregate by `keys` without one reducer receiving all partial states of a key.

    partials: state column -> aggregate over the rows of one chunk; merges: state column -> one of sum, min, max by which states merge.
    A chunk is a share of the input's partitions (`chunks` of them at most, by default a power of fan_in that is at least the number of shuffle partitions). Level 0 combines within a chunk, on the map side as well;
    each further round merges the states of `fan_in` neighbouring chunks, so that a key with any number of rows meets at most
    fan_in x (map-side partials) states in one task, and there are log_fan_in(chunks) rounds over data that shrink each time.

    NULL keys form a group of their own. An empty input gives an empty result. Extra columns are ignored; columns named like the
    internal `_chunk` are not read.
    """
    if chunks is None:
        chunks = fan_in
        while chunks < shuffle_width(df.sparkSession):
            chunks *= fan_in
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    state = df.withColumn("_chunk", F.pmod(F.spark_partition_id(), F.lit(chunks))).groupBy(*keys, "_chunk").agg(*[c.alias(k) for k, c in partials.items()])
    left = chunks
    while left > 1:
        left = -(-left // fan_in)
        state = state.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("int")) if left > 1 else state.drop("_chunk")
        by = [*keys, "_chunk"] if left > 1 else keys
        state = state.groupBy(*by).agg(*[how[merges[k]](k).alias(k) for k in partials])
    return state if chunks > 1 else state.drop("_chunk")


def key_totals(fragments: DataFrame, fields: tuple[str, ...] = ("barcode", "chrom"), fan_in: int = 8, chunks: int | None = None) -> DataFrame:
    """n_fragment and reads (summed count) of every value of each field in each sample, over clean fragments.

    Result: sample_id, key_field, key_value, n_fragment, reads. Rows of all fields are combined in the same tree.
    """
    long = fragments.select(
        "sample_id",
        F.inline(F.array(*[F.struct(F.lit(f).alias("key_field"), F.col(f).alias("key_value")) for f in fields])),
        "count",
    )
    return tree_aggregate(
        long,
        ["sample_id", "key_field", "key_value"],
        {"n_fragment": F.count(F.lit(1)), "reads": F.sum(F.col("count").cast("bigint"))},
        {"n_fragment": "sum", "reads": "sum"},
        chunks,
        fan_in,
    )


def heavy_keys(totals: DataFrame, shares: dict[str, float], total_field: str = "chrom") -> DataFrame:
    """Keys with at least shares[key_field] of their sample's fragments. A sample's fragments are the sum over total_field's keys."""
    per_sample = totals.where(F.col("key_field") == total_field).groupBy("sample_id").agg(F.sum("n_fragment").alias("_all"))
    least = F.coalesce(*[F.when(F.col("key_field") == k, F.lit(round(v * 1_000_000))) for k, v in shares.items()])
    return totals.join(per_sample.withColumnRenamed("sample_id", "_s"), F.col("sample_id").eqNullSafe(F.col("_s")), "inner").where(F.col("n_fragment") * 1_000_000 >= least * F.col("_all")).drop("_s", "_all")
