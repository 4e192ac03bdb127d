"""How characteristic a term is of a record: graph-of-words degree times rarity in the collection.

In a record's graph two different terms are linked where they occur within a window of each other. A term's weight is the number of its distinct neighbours
instead of its frequency, times ln(records / records with the term). For terms that have a fixed place (peaks on a chromosome) the window is a distance
along that axis; for running text it is a number of tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.operators.clean import clean_chrom
from locusmill.util import BROADCAST_ROWS, materialize

#: Bases within which two peaks of a cell count as neighbours; tokens within which two words do.
PEAK_WINDOW, WORD_WINDOW = 5_000_000, 4
BIN_BITS = 14


def record_terms(fragments: DataFrame, peaks: DataFrame, window: int = PEAK_WINDOW) -> DataFrame:
    """Per cell (sample_id, barcode) and peak that its fragments touch: weight (summed count), total (summed over the cell's peaks), n_fragment (the cell's), degree.

    fragments are clean; a fragment touches a peak of the same chromosome if fragment.start < peak.end and fragment.end > peak.start. A cell without any
    touched peak has one row with peak_id NULL, so that cells can be counted; other cells have none such. Fragments are combined by cell and peak before
    they are shuffled, so a cell never has more rows than there are peaks. degree is the number of the cell's other peaks on the chromosome whose start is at most
    `window` away. Peaks are broadcast if few (checked), else joined by a shuffle on their bins.
    """
    bins = lambda s, e: F.sequence(F.shiftright(s, BIN_BITS), F.shiftright(F.col(e) - 1, BIN_BITS))
    p = peaks.where((F.col("start") >= 0) & (F.col("start") < F.col("end"))).select("peak_id", clean_chrom("chrom").alias("chrom"), "start", "end").distinct()
    p = p.select("peak_id", F.col("chrom").alias("p_chrom"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.explode(bins("start", "end")).alias("p_bin"))
    one_bin = (F.col("bin") == -1) | (F.col("bin") == F.greatest(F.shiftright("start", BIN_BITS), F.shiftright("p_start", BIN_BITS)))
    on = (F.col("key") == F.col("p_chrom")) & (F.col("bin") == F.col("p_bin")) & (F.col("start") < F.col("p_end")) & (F.col("end") > F.col("p_start"))
    f = fragments.select("sample_id", "barcode", "chrom", "start", "end", "count")
    value = [F.sum(F.col("count").cast("bigint")).alias("weight"), F.count(F.lit(1)).alias("n")]
    by = ["sample_id", "barcode", "peak_id", "p_chrom", "p_start"]
    if p.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # one more row, which every fragment meets once: it counts the fragments of cells in the same pass
        every = peaks.sparkSession.range(1).select(F.lit(None).cast(p.schema["peak_id"].dataType).alias("peak_id"), F.lit("*").alias("p_chrom"), F.lit(0).cast("bigint").alias("p_start"), F.lit(1 << 62).alias("p_end"), F.lit(-1).cast("bigint").alias("p_bin"))
        f = f.withColumn("bin", F.explode(F.concat(F.array(F.lit(-1).cast("bigint")), bins("start", "end")))).withColumn("key", F.when(F.col("bin") == -1, F.lit("*")).otherwise(F.col("chrom")))
        agg = f.join(F.broadcast(p.unionByName(every)), on).where(one_bin).groupBy(*by).agg(*value)
    else:
        hit = f.withColumn("bin", F.explode(bins("start", "end"))).withColumn("key", F.col("chrom")).join(p, on).where(one_bin).groupBy(*by).agg(*value)
        cells = f.groupBy("sample_id", "barcode").agg(*value).withColumn("peak_id", F.lit(None).cast(p.schema["peak_id"].dataType)).withColumn("p_chrom", F.lit("*")).withColumn("p_start", F.lit(0).cast("bigint"))
        agg = hit.unionByName(cells)
    cell = W.partitionBy("sample_id", "barcode")
    peak = F.col("peak_id").isNotNull()
    agg = agg.select(
        "sample_id",
        "barcode",
        "peak_id",
        "weight",
        F.sum(F.when(peak, F.col("weight"))).over(cell).alias("total"),
        F.max(F.when(~peak, F.col("n"))).over(cell).alias("n_fragment"),
        F.count(F.lit(1)).over(W.partitionBy("sample_id", "barcode", "p_chrom").orderBy("p_start").rangeBetween(-window, window)).alias("_near"),
    )
    return agg.where(peak | F.col("total").isNull()).select("sample_id", "barcode", "peak_id", "weight", "total", "n_fragment", (F.col("_near") - 1).alias("degree"))


def distinctive(terms: DataFrame, record: list[str], term: str, frequency: Column | None = None) -> DataFrame:
    """terms with records (N), with_term (d), rarity = ln(N / d), score = degree * rarity and, with `frequency`, tf_score = frequency * rarity.

    terms has one row for each record and term, with degree; rows whose term is NULL only count their record. Read twice, so written first.
    """
    terms = materialize(terms, "terms")
    n = terms.select(*record).distinct().count()
    d = terms.where(F.col(term).isNotNull()).groupBy(term).agg(F.count(F.lit(1)).alias("with_term"))
    out = terms.where(F.col(term).isNotNull()).join(d, term).withColumn("records", F.lit(n).cast("bigint")).withColumn("rarity", F.log(F.col("records") / F.col("with_term")))
    out = out.withColumn("score", F.col("degree") * F.col("rarity"))
    return out if frequency is None else out.withColumn("tf_score", frequency * F.col("rarity"))


_WORD = re.compile(r"\w+")


def text_terms(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WORD_WINDOW) -> DataFrame:
    """(key, term, frequency, degree) of the lower-case words of each text: degree is the number of different words at most window - 1 places away.

    Texts are read whole, each within its row; memory is in proportion to a text's distinct word pairs within the window. A NULL text, or one without words,
    has one row with a NULL term.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, term, freq, degree = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                words = _WORD.findall(t.lower()) if t else []
                near: dict[str, set[str]] = {w: set() for w in words}
                for gap in range(1, window):
                    for x, y in zip(words, words[gap:], strict=False):
                        if x != y:
                            near[x].add(y)
                            near[y].add(x)
                count = Counter(words)
                at += [i] * max(1, len(count))
                term += list(count) or [None]
                freq += list(count.values()) or [0]
                degree += [len(near[w]) for w in count] or [0]
            yield pa.RecordBatch.from_pydict({key: b.column(0).take(pa.array(at, pa.int64())), "term": pa.array(term, pa.string()), "frequency": pa.array(freq, pa.int64()), "degree": pa.array(degree, pa.int64())})

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, term string, frequency bigint, degree bigint")
