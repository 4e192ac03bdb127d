"""Queries of sources and sinks: each writes a table in a format, reads it again and is compared with the table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from locusmill import sources as S
from locusmill.operators import network as N
from locusmill.operators import regions as R
from locusmill.queries import views as V
from locusmill.queries.registry import SQL, query
from locusmill.queries.sequence_queries import _SEQ, _seqs, _sites
from locusmill.queries.signal_queries import _PAIRS, _TRACK, _pairs, _sizes, _track
from locusmill.util import shared_dir, table

_W = f"with {V.SQL_VIEWS}"
_FRAGS = _W + ' select chrom, "start", "end", cell as barcode, cast("count" as bigint) as "count" from f'


def _path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _fragment_file(spark, d):
    p = _path(spark, "fragments")
    V.frags(spark, d).select(F.concat_ws("\t", "chrom", "start", "end", "cell", "count").alias("value")).write.option("compression", "gzip").text(p)
    return p


@query("fragments_file", _FRAGS)
def fragments_file(spark, d):
    return S.read_fragments(spark, _fragment_file(spark, d))


@query("fragments_cached", _FRAGS)
def fragments_cached(spark, d):
    return S.read_fragments_cached(spark, _fragment_file(spark, d), _path(spark, "cache"))


@query("fragments_by_place", _W + " select cell, \"start\", \"end\" from f where chrom = 'chr1' and \"start\" < 60000000 and \"end\" > 20000000")
def fragments_by_place(spark, d):
    """The fragments of a stretch, out of files sorted by place, whose statistics let the others be skipped."""
    p = _path(spark, "sorted")
    S.write_fragments(V.frags(spark, d), p)
    return S.load(spark, p).where("chrom = 'chr1' and start < 60000000 and end > 20000000").select("cell", "start", "end")


@query("bed_file", _W + ' select chrom, "start", "end", feature as name, score from p')
def bed_file(spark, d):
    p = _path(spark, "bed")
    S.write_bed(V.peaks(spark, d).withColumnRenamed("feature", "name"), p)
    return S.read_bed(spark, p).select("chrom", "start", "end", "name", "score")


@query("bedgraph_file", _W + _TRACK + ' select chrom, "start", "end", cast(value as double) as value from tr')
def bedgraph_file(spark, d):
    p = _path(spark, "bedgraph")
    S.write_bedgraph(_track(spark, d), p)
    return S.read_bedgraph(spark, p)


@query("bigwig_file", _W + _TRACK + ' select chrom, "start", "end", cast(value as double) as value from tr')
def bigwig_file(spark, d):
    p = _path(spark, "track") + ".bw"
    local = "/" + p.removeprefix("file:").lstrip("/")
    t = _track(spark, d)
    S.write_bigwig(t, t.groupBy("chrom").agg(F.max("end").alias("length")), local)
    spark.dataSource.register(S.BigWigSource)
    return spark.read.format("bigwig").load(local).withColumn("value", F.col("value").cast("double"))


@query("narrow_peak_file", _W + ' select chrom, "start", "end", feature as name, score from p')
def narrow_peak_file(spark, d):
    p = _path(spark, "narrowpeak")
    x = V.peaks(spark, d).withColumns({"strand": F.lit("."), "a": F.lit(1.5), "b": F.lit(2.5), "c": F.lit(-1.0), "peak": F.lit(100)})
    S.write_tab(x, p, ["chrom", "start", "end", "feature", "score", "strand", "a", "b", "c", "peak"])
    return S.read_narrow_peak(spark, p).select("chrom", "start", "end", "name", "score")


@query("pairs_file", _W + _PAIRS.format(w=1) + " select 'r_' || cell as read_id, chrom as chrom1, pos1, chrom as chrom2, pos2 from pr where pos2 is not null")
def pairs_file(spark, d):
    p = _path(spark, "pairs")
    S.write_tab(_pairs(spark, d), p, ["read_id", "chrom1", "pos1", "chrom2", "pos2"])
    return S.read_pairs(spark, p).select("read_id", "chrom1", "pos1", "chrom2", "pos2")


def _gtf(spark, d):
    a = table(spark, d, "annotation")
    at = F.concat_ws(" ", *[F.when(F.col(c) != "", F.concat(F.lit(f'{c} "'), F.col(c), F.lit('";'))) for c in ("gene_id", "transcript_id")])
    p = _path(spark, "gtf")
    dot = lambda c: F.coalesce(F.col(c), F.lit("."))
    a.select(F.concat_ws("\t", "seqname", "source", "feature", "start", "end", F.lit("."), dot("strand"), F.lit("."), at).alias("value")).write.text(p)
    return p


@query("gtf_file", "select seqname, source, feature, \"start\", \"end\", coalesce(strand, '.') as strand, nullif(gene_id, '') as gene_id, nullif(transcript_id, '') as transcript_id from annotation where \"start\" is not null and \"end\" is not null")
def gtf_file(spark, d):
    return S.read_gtf(spark, _gtf(spark, d)).select("seqname", "source", "feature", "start", "end", "strand", "gene_id", "transcript_id")


@query("read_features", "select seqname as \"Chromosome\", \"start\" as \"Start\", \"end\" as \"End\", nullif(gene_id, '') as gene_id from annotation where feature = 'exon' and source = (select min(source) from annotation) and seqname like 'chr1%' and \"start\" is not null and \"end\" is not null")
def read_features(spark, d):
    source = table(spark, d, "annotation").agg(F.min("source")).first()[0]
    return S.read_features(spark, _gtf(spark, d), "exon", source, "chr1").select("Chromosome", "Start", "End", "gene_id")


@query("gff3_file", "select seqname, feature, \"start\", \"end\", coalesce(feature_id, transcript_id, gene_id) as id, nullif(parents, '') as parent from annotation where \"start\" is not null and \"end\" is not null")
def gff3_file(spark, d):
    a = table(spark, d, "annotation")
    own = F.coalesce("feature_id", "transcript_id", "gene_id")
    at = F.concat_ws(";", F.concat(F.lit("ID="), F.replace(F.url_encode(own), F.lit("+"), F.lit("%20"))), F.when(F.col("parents") != "", F.concat(F.lit("Parent="), F.replace(F.url_encode("parents"), F.lit("+"), F.lit("%20")))))
    p = _path(spark, "gff")
    a.select(F.concat_ws("\t", "seqname", "source", "feature", "start", "end", F.lit("."), F.lit("."), F.lit("."), at).alias("value")).write.text(p)
    g = S.read_gff3(spark, p)
    e = lambda k: F.try_element_at("attributes", F.lit(k))
    return g.select("seqname", "feature", "start", "end", e("ID").alias("id"), e("Parent").alias("parent"))


@query("matrix_market_file", "select o_custkey || '' as cell, o_orderpriority as feature, cast(count(*) as double) as value from orders group by 1, 2")
def matrix_market_file(spark, d):
    """Orders of each customer by priority as a feature by cell matrix file with its two name files."""
    from locusmill.operators.stats import global_rank

    x = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("cell"), F.col("o_orderpriority").alias("feature")).agg(F.count(F.lit(1)).alias("value"))
    cells, features = (global_rank(x.select(c).distinct(), [c], f"{c}_no") for c in ("cell", "feature"))
    m, b, f = (_path(spark, n) for n in ("mtx", "barcodes", "features"))
    size = f"{features.count()} {cells.count()} {x.count()}"
    rows = x.join(cells, "cell").join(features, "feature").select(F.concat_ws(" ", "feature_no", "cell_no", "value").alias("value"))
    spark.createDataFrame([("%%MatrixMarket matrix coordinate integer general",), (size,)], "value string").coalesce(1).write.text(m)
    rows.write.mode("append").text(m)
    cells.orderBy("cell_no").select("cell").coalesce(1).write.text(b)
    features.orderBy("feature_no").select("feature").coalesce(1).write.text(f)
    # the head must come first, so the parts go into one order of lines
    one = _path(spark, "mtx-whole")
    lines = spark.read.text(m).withColumn("_k", F.when(F.col("value").startswith("%"), 0).when(F.col("value") == size, 1).otherwise(2))
    lines.orderBy("_k").select("value").coalesce(1).write.text(one)
    return S.read_matrix_market(spark, one, b, f)


@query("fasta_file", _SEQ + " select feature as chrom, seq from sq")
def fasta_file(spark, d):
    s = _seqs(spark, d)
    p = _path(spark, "fasta")
    s.select(F.concat(F.lit(">"), "feature", F.lit(" peak\n"), F.substring("seq", 1, 40), F.lit("\n"), F.substring("seq", 41, 1 << 20)).alias("value")).write.text(p)
    return S.read_fasta(spark, p)


@query("common_sizes", _W + ", a as (select chrom, max(\"end\") as length from p group by 1) select chrom, length from a where length % 2 = 0")
def common_sizes(spark, d):
    """Chromosomes with the same size in two tables, one of which writes them without `chr`."""
    a = _sizes(spark, d)
    b = a.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), F.when(F.col("length") % 2 == 0, F.col("length")).otherwise(F.col("length") + 1).alias("length"))
    return S.common_sizes([a, b])


@query("group_files", _W + ' select "group", chrom, "start", "end" from f join gr on f.cell = gr.cell')
def group_files(spark, d):
    p = _path(spark, "groups")
    S.write_groups(V.frags(spark, d).join(V.groups(spark, d), "cell").select("group", "chrom", "start", "end"), p)
    return spark.read.csv(p, sep="\t", schema="chrom string, start bigint, end bigint, group string").select("group", "chrom", "start", "end")


@query("network_file", SQL["create_network"])
def network_file(spark, d):
    p = _path(spark, "network")
    S.write_tab(N.cooccurrence_network(_sites(spark, d), 0.01, 1), p, ["a", "b", "shared", "correlation"], header=True, compression="gzip")
    return spark.read.csv(p, sep="\t", header=True, schema="a string, b string, shared bigint, correlation double").withColumn("correlation", F.round("correlation", 6))


@query("saved_table", "select p_partkey, p_name, p_retailprice from part")
def saved_table(spark, d):
    p = _path(spark, "saved")
    for _ in range(2):
        t = S.cached(spark, p, lambda: table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"))
    return t


@query("chrom_sizes_file", _W + ' select chrom, max("end") as length from p group by 1')
def chrom_sizes_file(spark, d):
    p = _path(spark, "sizes")
    S.write_tab(_sizes(spark, d), p, ["chrom", "length"])
    return S.read_chrom_sizes(spark, p)


@query("regions_of_chroms", _W + ' select chrom, 0 as "start", max("end") as "end" from p group by 1')
def regions_of_chroms(spark, d):
    return R.from_chrom_lengths(_sizes(spark, d)).select("chrom", F.col("start").cast("int").alias("start"), "end")


_MOTIF_ROWS = _SEQ + ", ct as (select 'm' || (peak_id % 20) as motif, i - 1 as pos, substr(seq, i, 1) as base, count(*) as n from (select peak_id, seq, unnest(range(1, length(seq) + 1)) as i from sq join peaks on peaks.label = sq.feature) group by 1, 2, 3), gd as (select distinct motif, pos, b as base from ct, (values ('A'), ('C'), ('G'), ('T')) t(b)) select gd.motif, cast(gd.pos as int) as pos, gd.base, cast(coalesce(n, 0) as double) as \"count\" from gd left join ct on gd.motif = ct.motif and gd.pos = ct.pos and gd.base = ct.base"


@query("motif_files", _MOTIF_ROWS)
def motif_files(spark, d):
    """Count matrices of twenty motifs through every text format that keeps counts: JASPAR, plain, TRANSFAC and JASPAR again."""
    import numpy as np

    from locusmill.operators import motifs as M

    s = _seqs(spark, d).join(table(spark, d, "peaks").select(F.col("label").alias("feature"), "peak_id"), "feature")
    n = s.select(F.concat(F.lit("m"), F.col("peak_id") % 20).alias("motif"), F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''").groupBy("motif", "pos", "base").count().collect()
    made: dict[str, np.ndarray] = {}
    for r in n:
        made.setdefault(r.motif, np.zeros((4, 64)))["ACGT".index(r.base), r.pos] = r["count"]
    text = M.render([M.Motif(k, k, v) for k, v in made.items()], "jaspar")
    for form in ("pfm", "transfac", "jaspar"):
        text = M.render(M.parse(text), form)
    rows = [(m.id, p, b, float(m.counts[i, p])) for m in M.parse(text) for p in range(m.length) for i, b in enumerate("ACGT")]
    return spark.createDataFrame(rows, "motif string, pos int, base string, count double")
