"""Helpers shared by the operators: written intermediate tables, checked broadcasts, keyed Arrow chunks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows beyond which a table isn't broadcast by `small`.
BROADCAST_ROWS = 200_000

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local master; on a cluster that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
        d = "file://" + tempfile.mkdtemp(prefix="locusmill-")
        spark.conf.set("spark.checkpoint.dir", d)
        _made.append((spark, d))
    return d


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        _drop(spark, path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives the loss of an executor and keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def mark() -> int:
    """A point in the series of written tables, for `free`."""
    return len(_made)


def free(since: int, *keep: DataFrame) -> None:
    """Delete the tables written since `mark()` gave `since`, but for those in `keep`. Only for tables whose every reader has run."""
    kept = {getattr(df, "_path", None) for df in keep}
    rest = [x for x in _made[since:] if x[1] in kept]
    for spark, path in _made[since:]:
        if path not in kept:
            _drop(spark, path)
    _made[since:] = rest


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else df as it is (Spark then shuffles). The count stops at limit + 1 rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(df: DataFrame, keys: list[str], hash_col: str = "_h") -> DataFrame:
    """df distributed by a 64-bit hash of `keys` and sorted by it in each partition, so that `key_chunks` meets every key as a whole."""
    df = df.withColumn(hash_col, F.xxhash64(*keys))
    return df.repartition(shuffle_width(df.sparkSession), hash_col).sortWithinPartitions(hash_col)


def key_chunks(batches: Iterator[pa.RecordBatch], rows: int = 400_000, hash_col: str = "_h") -> Iterator[pa.Table]:
    """Tables of about `rows` rows out of batches sorted by hash_col; all rows of one hash are in the same table."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            h = t.column(hash_col)
            last = h[-1]
            keep = pc.index(h, last).as_py()
            if keep:
                yield t.slice(0, keep)
                t = t.slice(keep)
            held, n = t.to_batches(), t.num_rows
            if not keep:
                rows = max(rows, n * 2)
    if n:
        yield pa.Table.from_batches(held)


def group_codes(t: pa.Table, cols: list[str]):
    """(code of each row's group, row index of each group's first row) over the exact values of cols."""
    import numpy as np

    code = np.zeros(t.num_rows, dtype=np.int64)
    for c in cols:
        d = t.column(c).combine_chunks()
        if isinstance(d, pa.ChunkedArray):
            d = pa.concat_arrays(d.chunks) if d.num_chunks else pa.array([], t.schema.field(c).type)
        e = d.dictionary_encode(null_encoding="encode")
        code = code * max(1, len(e.dictionary)) + e.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    first = np.full(code.max() + 1 if len(code) else 0, -1, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
