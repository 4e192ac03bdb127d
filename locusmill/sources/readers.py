"""Readers. Text formats are read by Spark's own text and CSV sources, so that they are split and parallel where the codec allows it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NARROW_PEAK = "chrom string, start bigint, end bigint, name string, score double, strand string, signalValue double, pValue double, qValue double, peak bigint"
PAIRS = ["read_id", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2"]


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))


def read_fragments(spark: SparkSession, path: str, add_chr: bool = False) -> DataFrame:
    """chrom, start, end, barcode, count of fragment lines. Comments, lines of fewer than four fields and non-numeric places are left out; an absent or non-numeric count is 1."""
    f = _fields(spark, path).where(F.size("f") >= 4)
    i = lambda k: F.get("f", F.lit(k)).try_cast("bigint")
    chrom = F.get("f", F.lit(0))
    if add_chr:
        chrom = F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))
    d = f.select(chrom.alias("chrom"), i(1).alias("start"), i(2).alias("end"), F.get("f", F.lit(3)).alias("barcode"), F.coalesce(i(4), F.lit(1)).alias("count"))
    return d.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def read_fragments_cached(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """The fragments from a parquet copy beside them, made if it is absent or older than the source."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(path), hadoop.Path(f"{cache}/_SUCCESS")
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(b) or fs.getFileStatus(b).getModificationTime() < fs.getFileStatus(a).getModificationTime():
        read_fragments(spark, path).write.mode("overwrite").option("compression", "zstd").parquet(cache)
    return spark.read.parquet(cache)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name, score, strand, extra (array) of BED lines; a line whose start isn't below its end fails the read."""
    f = _fields(spark, path).where(F.get("f", F.lit(1)).rlike(r"^\d+$") & F.get("f", F.lit(2)).rlike(r"^\d+$"))
    g = lambda k: F.get("f", F.lit(k))
    s, e = g(1).cast("bigint"), g(2).cast("bigint")
    s = F.when(s < e, s).otherwise(F.raise_error(F.concat(F.lit("start isn't below end: "), F.array_join("f", " "))).cast("bigint"))
    return f.select(g(0).alias("chrom"), s.alias("start"), e.alias("end"), g(3).alias("name"), g(4).try_cast("double").alias("score"), g(5).alias("strand"), F.slice("f", 7, 1 << 30).alias("extra"))


def read_narrow_peak(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", schema=NARROW_PEAK)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start bigint, end bigint, value double")
    return d.where("start is not null and end is not null")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(spark, path).where(F.size("f") >= 5)
    cols = [F.get("f", F.lit(i)).alias(c) for i, c in enumerate(PAIRS)]
    return f.select(*cols).withColumn("pos1", F.col("pos1").cast("bigint")).withColumn("pos2", F.col("pos2").cast("bigint"))


def _attribute(key: str):
    """The last value of a key in a GTF attribute field."""
    return F.try_element_at(F.regexp_extract_all("attribute", F.lit(rf'(?:^|;)\s*{key}\s+"?([^";]*)"?'), 1), F.lit(-1))


def read_gtf(spark: SparkSession, path: str, attributes: tuple[str, ...] = ("gene_id", "gene_name", "transcript_id"), features: list[str] | None = None, chr_prefix: str | None = None, sources: list[str] | None = None) -> DataFrame:
    """seqname, source, feature, start, end, score, strand, frame, attribute and the attributes named (NULL if absent, the last of repeated ones); lines with unparsable places are left out."""
    names = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attribute"]
    d = _fields(spark, path).where(F.size("f") >= 9).select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)])
    d = d.withColumn("start", F.col("start").try_cast("bigint")).withColumn("end", F.col("end").try_cast("bigint")).where("start is not null and end is not null")
    if features:
        d = d.where(F.col("feature").isin(features))
    if sources:
        d = d.where(F.col("source").isin(sources))
    if chr_prefix:
        d = d.where(F.col("seqname").startswith(chr_prefix))
    for a in attributes:
        v = _attribute(a)
        d = d.withColumn(a, F.nullif(v, F.lit("")))
    return d


def read_features(spark: SparkSession, path: str, feature: str = "transcript", source: str = "HAVANA", chr_prefix: str | None = None) -> DataFrame:
    return read_gtf(spark, path, features=[feature], chr_prefix=chr_prefix, sources=[source]).withColumns({"Chromosome": F.col("seqname"), "Start": F.col("start"), "End": F.col("end")})


def gene_annotation(gtf: DataFrame, feature: str = "gene", biotypes: list[str] | None = ("protein_coding",), exclude: tuple[str, ...] = ("chrM", "chrMT")) -> DataFrame:
    """gene_name, chrom, start, end, strand of gene rows; of a name's rows the longest (then the first by place). Rows with another biotype (column gene_type) are left out, those without one stay."""
    d = gtf.where((F.col("feature") == feature) & F.col("gene_name").isNotNull() & ~F.col("seqname").isin(*exclude))
    if biotypes and "gene_type" in gtf.columns:
        d = d.where(F.col("gene_type").isNull() | F.col("gene_type").isin(*biotypes))
    w = W.partitionBy("gene_name").orderBy(F.desc(F.col("end") - F.col("start")), "seqname", "start")
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("gene_name", F.col("seqname").alias("chrom"), "start", "end", "strand")


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 lines with `attributes` as a map of URL-decoded values."""
    names = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attribute"]
    d = _fields(spark, path).where(F.size("f") >= 9).select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)])
    d = d.withColumn("start", F.col("start").try_cast("bigint")).withColumn("end", F.col("end").try_cast("bigint")).where("start is not null and end is not null")
    parts = F.filter(F.split("attribute", ";"), lambda x: F.instr(x, "=") > 0)
    pairs = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.try_url_decode(F.replace(F.substring_index(x, "=", -1), F.lit("+"), F.lit("%2B"))).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return d.withColumn("attributes", F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])))


def gff_to_gtf(gff: DataFrame) -> DataFrame:
    """GTF rows of GFF3 rows: each row's transcript is the nearest ancestor with a parent of its own or itself, its gene the topmost ancestor; genes and transcripts that have no row are
    made from the span of theirs. Ordered by place with genes before transcripts before the rest."""
    from locusmill.operators.forest import hierarchy

    g = gff.withColumn("id", F.coalesce(F.element_at("attributes", F.lit("ID")), F.concat(F.lit("row:"), F.xxhash64("seqname", "feature", "start", "end", "attribute"))))
    g = g.withColumn("parent", F.explode_outer(F.split(F.element_at("attributes", F.lit("Parent")), ",")))
    h = hierarchy(g, F.col("id"), F.col("parent"), paths=True).select(F.col("node_id").alias("id"), "path", "depth")
    j = g.join(h, "id")
    gene = F.when(F.col("depth") >= 0, F.element_at("path", 1))
    tx = F.when(F.col("depth") >= 1, F.element_at("path", 2))
    rows = j.select("seqname", "source", F.when(F.col("depth") == 0, "gene").when(F.col("depth") == 1, "transcript").otherwise(F.col("feature")).alias("feature"), "start", "end", "score", "strand", "frame", gene.alias("gene_id"), tx.alias("transcript_id"))
    span = [F.min("start").alias("start"), F.max("end").alias("end"), F.first("seqname").alias("seqname"), F.first("source").alias("source"), F.first("strand").alias("strand")]
    have = rows.where("feature = 'gene'").select("gene_id")
    made = rows.where("gene_id is not null").groupBy("gene_id").agg(*span).join(have, "gene_id", "left_anti").withColumn("feature", F.lit("gene"))
    rank = F.when(F.col("feature") == "gene", 0).when(F.col("feature") == "transcript", 1).otherwise(2)
    return rows.unionByName(made, allowMissingColumns=True).orderBy("seqname", "start", "end", rank)


def read_matrix_market(spark: SparkSession, matrix: str, barcodes: str, features: str) -> DataFrame:
    """(cell, feature, value) of a feature by cell matrix file with its name files; feature names are chrom_start_end of the first three fields (or the first field)."""
    lines = spark.read.text(matrix).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    # the first line holds the sizes; an entry that reads the same stays
    head = lines.first().value
    again = lines.where(F.col("value") == head).count() - 1
    rest = lines.where(F.col("value") != head).unionByName(spark.createDataFrame([(head,)] * again, "value string"))
    m = rest.select(F.split(F.trim("value"), r"\s+").alias("f")).select(*[F.get("f", F.lit(i)).cast("double").alias(c) for i, c in enumerate("rcv")])
    names = lambda p: spark.read.text(p).rdd.map(lambda r: r[0]).zipWithIndex().toDF(["line", "i"])
    b = names(barcodes).select((F.col("i") + 1).alias("c"), F.split("line", "\t")[0].alias("cell"))
    f = F.split("line", "\t")
    label = F.when(F.size(f) >= 3, F.array_join(F.slice(f, 1, 3), "_")).otherwise(f[0])
    v = names(features).select((F.col("i") + 1).alias("r"), label.alias("feature"))
    return m.join(b, "c").join(v, "r").select("cell", "feature", F.col("v").alias("value"))


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, length bigint").where("length is not null")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq) of FASTA records. A record is one row, so chromosomes of up to 2 GB fit; the file is split at record heads, not read whole."""
    d = spark.read.text(path, lineSep=">").where("value <> ''")
    lines = F.split("value", "\n")
    return d.select(F.split(F.trim(lines[0]), r"\s+")[0].alias("chrom"), F.regexp_replace(F.array_join(F.slice(lines, 2, 1 << 30), ""), r"\s", "").alias("seq"))


def common_sizes(sizes: list[DataFrame]) -> DataFrame:
    """(chrom, length) in all of the tables, with and without a `chr` prefix being the same."""
    norm = [s.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), "length").distinct() for s in sizes]
    out = norm[0]
    for n in norm[1:]:
        out = out.intersect(n)
    return out.select(F.concat(F.lit("chr"), "chrom").alias("chrom"), "length")
