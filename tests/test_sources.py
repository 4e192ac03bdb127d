from locusmill import sources as S
from locusmill.streaming import latest_totals, tile_counts, upsert_totals


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fragments(spark, tmp_path):
    p = put(tmp_path, "f.tsv", "# c\nchr1\t1\t5\tAA\t3\n2\t4\t9\tBB\nchr1\tx\t5\tAA\t1\nchr1\t1\t5\nchr1\t2\t7\tCC\tz\r\n")
    got = {tuple(r) for r in S.read_fragments(spark, p).collect()}
    assert got == {("chr1", 1, 5, "AA", 3), ("2", 4, 9, "BB", 1), ("chr1", 2, 7, "CC", 1)}
    assert {r.chrom for r in S.read_fragments(spark, p, add_chr=True).collect()} == {"chr1", "chr2"}
    c = S.read_fragments_cached(spark, p, str(tmp_path / "cache"))
    assert c.count() == 3 and S.read_fragments_cached(spark, p, str(tmp_path / "cache")).count() == 3


def test_bed_and_gtf(spark, tmp_path):
    b = S.read_bed(spark, put(tmp_path, "a.bed", "#h\nchr1\t1\t5\tn\t2.5\t-\tq\ttrack x\nchr1\t7\t9\n")).orderBy("start").collect()
    assert b[0].score == 2.5 and b[0].extra == ["q", "track x"] and b[1].name is None
    S.write_bed(S.read_bed(spark, str(tmp_path / "a.bed")), str(tmp_path / "out"))
    assert S.read_bed(spark, str(tmp_path / "out")).count() == 2
    g = put(tmp_path, "a.gtf", 'chr1\tH\tgene\t1\t50\t.\t+\t.\tgene_id "g1"; gene_name "N1"; gene_name "N2";\nchr1\tH\tgene\t1\t90\t.\t-\t.\tgene_id "g2"; gene_name "N2";\nchrM\tH\tgene\t1\t9\t.\t-\t.\tgene_id "g3"; gene_name "M";\nchr1\tH\texon\tx\t9\t.\t-\t.\tgene_id "g2"\n')
    t = S.read_gtf(spark, g)
    assert sorted((r.gene_id, r.gene_name) for r in t.collect()) == [("g1", "N2"), ("g2", "N2"), ("g3", "M")]
    a = S.gene_annotation(t).collect()
    assert [(r.gene_name, r.end, r.strand) for r in a] == [("N2", 90, "-")]


def test_gff3(spark, tmp_path):
    f = put(tmp_path, "a.gff", "##gff\nc\ts\tmRNA\t1\t50\t.\t+\t.\tID=t1;Parent=g1;Note=a%2Cb+c\nc\ts\texon\t1\t20\t.\t+\t.\tID=e1;Parent=t1\nc\ts\tgene\t1\t50\t.\t+\t.\tID=g1\n")
    g = S.read_gff3(spark, f)
    assert {r.attributes.get("Note") for r in g.collect()} == {None, "a,b+c"}
    got = {r.feature: (r.gene_id, r.transcript_id) for r in S.gff_to_gtf(g).collect()}
    assert got == {"gene": ("g1", None), "transcript": ("g1", "t1"), "exon": ("g1", "t1")}


def test_matrix_pairs_fasta(spark, tmp_path):
    m = put(tmp_path, "m.mtx", "%%MatrixMarket\n2 3 3\n1 1 5\n2 3 1\n1 2 2\n")
    b, f = put(tmp_path, "b.tsv", "c1\nc2\nc3\n"), put(tmp_path, "f.tsv", "chr1\t0\t5\nchr2\t1\t6\n")
    got = {tuple(r) for r in S.read_matrix_market(spark, m, b, f).collect()}
    assert got == {("c1", "chr1_0_5", 5.0), ("c3", "chr2_1_6", 1.0), ("c2", "chr1_0_5", 2.0)}
    p = S.read_pairs(spark, put(tmp_path, "x.pairs", "## pairs\nr_A\tchr1\t1\tchr2\t5\t+\t-\n")).first()
    assert (p.read_id, p.pos2, p.strand2) == ("r_A", 5, "-")
    s = {r.chrom: r.seq for r in S.read_fasta(spark, put(tmp_path, "g.fa", ">chr1 d\nACG\nTTA\n>chr2\nGG\n")).collect()}
    assert s == {"chr1": "ACGTTA", "chr2": "GG"}


def test_cached_and_groups(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert S.cached(spark, str(tmp_path / "c"), make).count() == 3 and S.cached(spark, str(tmp_path / "c"), make).count() == 3 and len(calls) == 1
    S.write_groups(spark.range(4).selectExpr("id", "id % 2 as group"), str(tmp_path / "g"))
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.is_dir()) == ["group=0", "group=1"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([("chr1", 10, 2, "2024-01-01 00:01:00"), ("chr1", 20, 3, "2024-01-01 00:02:00"), ("chr1", 9000, 1, "2024-01-01 00:20:00")], "chrom string, start bigint, count int, t string").selectExpr("*", "cast(t as timestamp) as loaded_at").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = tile_counts(src).writeStream.outputMode("complete").format("memory").queryName("tiles_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.tile, r.reads) for r in spark.table("tiles_test").collect()) == [(0, 5), (1, 1)]
    b = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v bigint")
    for i, want in ((0, 3), (1, 6), (1, 6), (2, 9), (2, 9), (3, 12)):  # a batch that comes again counts once
        upsert_totals(b, str(tmp_path / "tot"), ["k"], "v", i)
        assert latest_totals(spark, str(tmp_path / "tot")).first().v == want
    (tmp_path / "tot" / "v=4").mkdir()  # a version whose write hasn't ended
    assert latest_totals(spark, str(tmp_path / "tot")).first().v == 12


def test_package_does_not_need_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent / "locusmill"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(from|import) locusmill\.llm", f.read_text()), f


def test_every_query_with_sql_exists():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_bigwig_round_trip(spark, tmp_path):
    rows = [(c, i * 10, i * 10 + 1 + i % 9, float(i % 50) / 4) for c in ("chr1", "chr2", "chrX") for i in range(700)]
    sizes = spark.createDataFrame([("chr1", 10_000), ("chr2", 9_000), ("chrX", 8_000), ("chrY", 5)], "chrom string, length bigint")
    df = spark.createDataFrame(rows, "chrom string, start bigint, end bigint, value double")
    spark.dataSource.register(S.BigWigSource)
    for items, fan in ((64, 4), (1024, 256)):
        p = str(tmp_path / f"x{items}.bw")
        S.write_bigwig(df, sizes, p, items, fan)
        got = spark.read.format("bigwig").option("blocksPerPartition", 7).load(p).collect()
        assert sorted(map(tuple, got)) == sorted(rows)
    S.write_bigwig(df.limit(0), sizes, str(tmp_path / "e.bw"))
    assert spark.read.format("bigwig").load(str(tmp_path / "e.bw")).count() == 0
    assert S.chrom_sizes(spark).count() == 25
