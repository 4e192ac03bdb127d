"""Per-cell quality measures of fragments (cell, chrom, start, end, count) and the filters on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.operators.intervals import overlap_join

MITO = ("chrM", "M", "chrMT", "MT")


def import_fragments(frags: DataFrame, sizes: DataFrame | None = None, min_fragments: int = 200, whitelist: DataFrame | None = None, mito: tuple[str, ...] = MITO) -> DataFrame:
    """Per cell n_fragment and reads off the mitochondrion, n_mito on it, frac_dup = 1 - n_fragment / reads, frac_mito; cells with at least min_fragments.

    Only chromosomes of sizes (chrom) or the mitochondrion count, and only cells of the whitelist (cell). Rows aren't de-duplicated.
    """
    f = frags
    if whitelist is not None:
        f = f.join(whitelist.select("cell"), "cell", "left_semi")
    m = F.col("chrom").isin(*mito)
    if sizes is not None:
        known = sizes.select(F.col("chrom").alias("_k"))
        f = f.join(F.broadcast(known), F.col("chrom") == F.col("_k"), "left").where(F.col("_k").isNotNull() | m).drop("_k")
    a = f.groupBy("cell").agg(
        F.count_if(~m).alias("n_fragment"),
        F.sum(F.when(~m, F.col("count")).otherwise(0)).cast("bigint").alias("reads"),
        F.count_if(m).alias("n_mito"),
    )
    a = a.where(F.col("n_fragment") >= min_fragments)
    return a.withColumn("frac_dup", F.when(F.col("reads") > 0, 1 - F.col("n_fragment") / F.col("reads")).otherwise(0.0)).withColumn("frac_mito", F.col("n_mito") / F.greatest(F.col("n_fragment") + F.col("n_mito"), F.lit(1)))


def fragment_sizes(frags: DataFrame, most: int = 1000, cells: DataFrame | None = None) -> DataFrame:
    """(size, n) for sizes 0..most, absent ones with 0: fragments by length, longer ones at size 0; lengths below 1 are dropped."""
    f = frags if cells is None else frags.join(cells.select("cell"), "cell", "left_semi")
    w = F.col("end") - F.col("start")
    h = f.where(w > 0).groupBy(F.when(w > most, 0).otherwise(w).cast("bigint").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    return frags.sparkSession.range(most + 1).withColumnRenamed("id", "size").join(F.broadcast(h), "size", "left").select("size", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def nucleosome_signal(frags: DataFrame, free: int = 147, mono: int = 294) -> DataFrame:
    """Per cell fragments with free <= length < mono over those shorter; a cell without shorter ones has one added to both."""
    w = F.col("end") - F.col("start")
    a = frags.groupBy("cell").agg(F.count_if(w < free).alias("nf"), F.count_if((w >= free) & (w < mono)).alias("mono"))
    z = (F.col("nf") == 0).cast("int")
    return a.select("cell", ((F.col("mono") + z) / (F.col("nf") + z)).alias("nucleosome_signal"))


def cuts(frags: DataFrame) -> DataFrame:
    """Both cut sites of each fragment: start and end - 1, as pos."""
    return frags.withColumn("pos", F.explode(F.array(F.col("start"), F.col("end") - 1)))


def tss_profile(frags: DataFrame, tss: DataFrame, up: int = 2000, down: int = 2000) -> DataFrame:
    """(cell, offset, n): cuts by offset 0..up + down from the window's start, over fragments that overlap the window [tss - up, tss + down + 1) of a TSS. Strands aren't flipped."""
    win = tss.select("chrom", (F.col("tss") - up).alias("start"), (F.col("tss") + down + 1).alias("end")).distinct()
    c = cuts(overlap_join(frags, win, slack=0))
    off = F.col("pos") - F.col("r_start")
    return c.where((off >= 0) & (off <= up + down)).groupBy("cell", off.alias("offset")).agg(F.count(F.lit(1)).alias("n"))


def tss_enrichment(profile: DataFrame, width: int = 4001, flank: int = 100, centre: int = 101) -> DataFrame:
    """(cell, tsse): mean cuts of the middle `centre` offsets over those of the first and last `flank`; a flank of 0 counts as the mean flank of all cells."""
    mid = width // 2
    lo = mid - centre // 2
    is_flank = (F.col("offset") < flank) | (F.col("offset") >= width - flank)
    is_mid = (F.col("offset") >= lo) & (F.col("offset") < lo + centre)
    a = profile.groupBy("cell").agg((F.sum(F.when(is_flank, F.col("n")).otherwise(0)) / (2 * flank)).alias("f"), (F.sum(F.when(is_mid, F.col("n")).otherwise(0)) / centre).alias("c"))
    m = a.agg(F.avg("f").alias("m"))
    return a.crossJoin(F.broadcast(m)).select("cell", (F.col("c") / F.nullif(F.when(F.col("f") == 0, F.col("m")).otherwise(F.col("f")), F.lit(0.0))).alias("tsse"))


def library_tsse(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("tsse").alias("library_tsse"))


def filter_cells(cells: DataFrame, min_counts: int | None = None, max_counts: int | None = None, min_tsse: float | None = None) -> DataFrame:
    """Cells within the bounds given; a bound whose column is absent is skipped."""
    p = []
    if min_counts is not None and "n_fragment" in cells.columns:
        p.append(F.col("n_fragment") >= min_counts)
    if max_counts is not None and "n_fragment" in cells.columns:
        p.append(F.col("n_fragment") <= max_counts)
    if min_tsse is not None and "tsse" in cells.columns:
        p.append(F.col("tsse") >= min_tsse)
    return cells.where(reduce(lambda a, b: a & b, p)) if p else cells


def call_cells(cells: DataFrame, min_fragments: int = 1000) -> DataFrame:
    return cells.where(F.col("n_fragment") >= min_fragments)


def qc(cells: DataFrame, fragments: tuple[float, float] = (2000, 100000), tsse: tuple[float, float] = (0.1, 50), nucleosome: float = 4) -> DataFrame:
    """Cells strictly within all bounds; NULL or NaN measures don't reject a cell."""
    bad = [F.col("n_fragment") <= fragments[0], F.col("n_fragment") >= fragments[1]]
    if "tsse" in cells.columns:
        x = F.nanvl(F.col("tsse").cast("double"), F.lit(None).cast("double"))
        bad += [x <= tsse[0], x >= tsse[1]]
    if "nucleosome_signal" in cells.columns:
        bad.append(F.nanvl(F.col("nucleosome_signal").cast("double"), F.lit(None).cast("double")) >= nucleosome)
    return cells.where(~reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in bad]))


def concat_samples(parts: dict[str, DataFrame]) -> DataFrame:
    """Fragments of all samples, barcodes prefixed `sample#`, range partitioned and sorted by place."""
    out = None
    for name, f in parts.items():
        f = f.withColumn("cell", F.concat(F.lit(f"{name}#"), F.col("cell"))).withColumn("sample", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")


def fragment_histogram(frags: DataFrame, cells: DataFrame, chrom: str, start: int, end: int, step: int = 5) -> DataFrame:
    """Lengths by cell of the fragments of a region, in bins of `step`; cells without any have one row with NULLs."""
    f = frags.where((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
    h = f.groupBy("cell", (F.floor((F.col("end") - F.col("start")) / step) * step).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    return cells.select("cell").join(h, "cell", "left")
