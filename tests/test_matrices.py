import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.operators import contacts as C
from locusmill.operators import embed as E
from locusmill.operators import linkage as L
from locusmill.operators import matrices as M
from locusmill.operators import motifs as MO
from locusmill.operators import network as N
from locusmill.operators import peaks as P
from locusmill.operators import qc as Q
from locusmill.operators import signal as S
from locusmill.operators import stats as ST

FR = "cell string, chrom string, start bigint, end bigint, count int"


def frags(spark, n=400, seed=0):
    r = random.Random(seed)
    return spark.createDataFrame([(r.choice("abcd"), r.choice(["chr1", "chr2", "chrM"]), s := r.randrange(5000), s + r.randrange(1, 400), r.randrange(1, 4)) for _ in range(n)], FR)


def test_strategies_agree_where_they_must(spark):
    f = frags(spark)
    a = M.tile_matrix(f, 100, "insertion").agg(F.sum("value")).first()[0]
    b = M.tile_matrix(f, 100, "fragment").agg(F.sum("value")).first()[0]
    assert b >= a > 0
    assert M.tile_matrix(f.limit(0)).count() == 0
    p = spark.createDataFrame([("p1", "chr1", 0, 1000), ("p2", "chr1", 500, 2000)], "feature string, chrom string, start bigint, end bigint")
    x = {(r.cell, r.feature): r.value for r in M.peak_matrix(f, p, ceiling=None).collect()}
    want = {}
    for r in f.where("chrom = 'chr1'").collect():
        for pos in (r.start, r.end - 1):
            k = "p2" if 500 <= pos < 2000 else "p1" if pos < 500 else None
            if k:
                want[r.cell, k] = want.get((r.cell, k), 0) + 1
    assert x == want
    assert max(r.value for r in M.peak_matrix(f, p).collect()) <= 4


def test_quality_edges(spark):
    c = spark.createDataFrame([("a", 2000, 1.0, 1.0), ("b", 2001, float("nan"), None), ("c", 5000, 0.1, 1.0), ("d", 5000, 5.0, 4.0)], "cell string, n_fragment bigint, tsse double, nucleosome_signal double")
    assert [r.cell for r in Q.qc(c).collect()] == ["b"]
    assert Q.filter_cells(c.drop("tsse"), min_tsse=9.0).count() == 4
    assert {r.cell for r in Q.filter_cells(c, 2001, 4999).collect()} == {"b"}
    one = spark.createDataFrame([("a", "chr1", 0, 200, 1)], FR)
    assert Q.nucleosome_signal(one).first().nucleosome_signal == 2.0
    h = {r.size: r.n for r in Q.fragment_sizes(spark.createDataFrame([("a", "c", 0, 5, 1), ("a", "c", 0, 5000, 1), ("a", "c", 5, 5, 1)], FR), 10).collect()}
    assert h[5] == 1 and h[0] == 1 and sum(h.values()) == 2 and len(h) == 11


def test_rates_and_ranks(spark):
    r = random.Random(1)
    p = [r.choice([r.random(), 0.5, 0.01]) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(999, None)], "id int, p_value double").repartition(5)
    want = ST.numpy_bh(np.array(p))
    got = {x.id: x.fdr for x in ST.bh_fdr(df).collect()}
    assert got[999] is None and all(got[i] == pytest.approx(w) for i, w in enumerate(want))
    grouped = {x.id: x.fdr for x in ST.bh_fdr(df.withColumn("g", F.lit(1)), by=["g"]).collect()}
    assert all(grouped[i] == pytest.approx(w) for i, w in enumerate(want)) and grouped[999] is None
    assert sorted(x["rank"] for x in ST.global_rank(df, ["id"]).collect()) == list(range(1, 302))


def test_special_functions():
    assert ST.t_two_sided(2.0, 10) == pytest.approx(0.0733880348)
    assert math.exp(ST.log_binom_sf(10, 100, 0.05)) == pytest.approx(0.0281882942)
    assert ST.log_binom_sf(0, 5, 0.1) == 0 and ST.log_binom_sf(6, 5, 0.1) == -math.inf
    assert ST.log_binom_sf(900, 1000, 1e-6) < -10000


def test_rank_sum_of_shifted_values(spark):
    x = spark.createDataFrame([(f"c{i}", "f", float(i)) for i in range(1, 11)], "cell string, feature string, value double")
    s = spark.createDataFrame([(f"c{i}", "fg" if i > 5 else "bg") for i in range(1, 11)] + [("zero", "bg")], "cell string, side string")
    r = ST.rank_sum(x, s).first()
    assert r.u == 30 and r.z > 2.7 and r.p_value < 0.01 and r.pct_fg == 1 and r.pct_bg == pytest.approx(5 / 6)


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.poisson(1, (30, 12)).astype(float)
    x = spark.createDataFrame([(f"c{i:02}", f"f{j:02}", float(a[i, j])) for i in range(30) for j in range(12) if a[i, j]], "cell string, feature string, value double")
    u, v, s = E.gram_svd(x, 5)
    assert s == pytest.approx(np.linalg.svd(a, compute_uv=False)[:5])
    rec = np.zeros((30, 5))
    for r in u.collect():
        rec[int(r.cell[1:])] = r.vec
    vv = {r.feature: r.v for r in v.collect()}
    assert np.abs(a @ np.array([vv[f"f{j:02}"] for j in range(12)]) / s - rec).max() < 1e-8
    p = {r.cell: r.vec for r in E.project(x, v, s).collect()}
    assert np.abs(np.array([p[f"c{i:02}"] for i in range(30)]) - rec).max() < 1e-8
    assert E.drop_depth_dims(u, x.groupBy("cell").agg(F.sum("value").alias("depth"))).count() == 30


def test_communities_of_two_cliques(spark):
    e = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 6) for b in range(g, g + 6) if a != b] + [(0, 10, 0.1), (10, 0, 0.1)]
    got = {r.id: r.community for r in E.communities(spark.createDataFrame(e, "a bigint, b bigint, w double")).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]


def test_correlated_peaks_are_found(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=60)
    vals = {"chr1:0-100": z, "chr1:1000-1100": z * 2 + 1 + rng.normal(size=60) * 0.1, "chr1:2000-2100": rng.normal(size=60)}
    x = spark.createDataFrame([(k, i, float(v)) for k, a in vals.items() for i, v in enumerate(a)], "feature string, sample int, value double")
    p = spark.createDataFrame([(k, "chr1", i * 1000, i * 1000 + 100) for i, k in enumerate(vals)], "feature string, chrom string, start bigint, end bigint")
    got = L.coaccessibility(x, p, 60, 5000, 0.5).collect()
    assert [(r.peak_a, r.peak_b, r.distance) for r in got] == [("chr1:0-100", "chr1:1000-1100", 1000)]
    assert got[0].correlation == pytest.approx(np.corrcoef(vals["chr1:0-100"], vals["chr1:1000-1100"])[0, 1])


def test_sequential_peaks(spark):
    s = spark.createDataFrame([("chr1", 0, 0, 100, 5.0), ("chr1", 0, 0, 250, 9.0), ("chr1", 0, 0, 420, 7.0), ("chr1", 0, 0, 800, 1.0)], "chrom string, start bigint, end bigint, summit bigint, score double")
    z = spark.createDataFrame([("chr1", 10_000)], "chrom string, length bigint")
    assert sorted(r.summit for r in P.merge_peaks(s, z, 100).collect()) == [250, 800]
    reps = spark.createDataFrame([(i, "chr1", v, float(v)) for i, v in [(0, 10), (1, 20), (0, 200), (0, 205), (2, 215), (1, 460)]], "replicate int, chrom string, summit bigint, score double")
    assert sorted((r.summit, r.replicates) for r in P.reproducible_peaks(reps, 2, 30).collect()) == [(20, 2), (215, 2)]
    t = spark.createDataFrame([("chr1", m - 5, m + 5) for m in (10, 15, 30, 31, 50)], "chrom string, start bigint, end bigint")
    assert sorted(r.start + 5 for r in P.thin_peaks(t, 20).collect()) == [10, 30, 50]


def test_kernels():
    x = np.arange(10.0)
    assert S.rolling(x, 3, "sum").tolist() == [0, 3, 6, 9, 12, 15, 18, 21, 24, 0]
    assert S.rolling(x, 3, "max").tolist() == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9]
    assert S.sliding_sum(np.ones(6), 3).tolist() == [2, 3, 3, 3, 3, 2]
    e, c, we, wc = S.edge_centre(np.ones(40), 5)
    assert (we, wc) == (10, 5) and e[20] == 10 and c[20] == 5
    dip = np.r_[np.ones(20) * 5, -np.ones(10), np.ones(20) * 5]
    f = S.footprint_score(dip, (5, 8), (8, 10))
    assert 20 <= f.argmax() < 30 and f.max() == pytest.approx(6)
    assert S.fos_score(np.r_[np.ones(20) * 5, np.zeros(10), np.ones(20) * 5], (5, 8), (8, 10)).argmax() in range(22, 29)
    assert S.shuffle_counts(np.r_[np.zeros(5), 3, np.zeros(5)], np.array([-2, 2]), 4).sum(1).tolist() == [3] * 4


def test_motif_formats_round_trip():
    m = MO.Motif("M1", "name", np.array([[8, 0, 1.0], [1, 9, 1], [0, 0, 1], [1, 1, 7]]))
    for form in ("jaspar", "pfm", "meme", "transfac", "homer"):
        text = MO.render([m, m], form)
        assert MO.guess_format(text) == form
        got = MO.parse(text)
        assert [x.id for x in got] == ["M1", "M1"] and np.abs(got[0].pfm() - m.pfm()).max() < 1e-3
    assert [x.id for x in MO.make_unique([m, m])] == ["M1", "M1_2"]
    assert m.consensus() == "ACT" and m.reverse().consensus() == "AGT" and MO.similarity(m, m) == pytest.approx(1)
    assert len(MO.cluster([m, m, m.reverse()], 0.1)) == 2


def test_cut_off_bounds_the_tail():
    m = MO.Motif("M", "m", np.array([[9, 1, 1, 1, 4.0], [1, 9, 1, 1, 2], [1, 1, 9, 1, 2], [1, 1, 1, 9, 2]]))
    s = m.pssm()
    import itertools

    allw = sorted((sum(s[b, j] for j, b in enumerate(w)) for w in itertools.product(range(4), repeat=5)), reverse=True)
    cut = m.cut_off(0.01)
    assert sum(v >= cut + 0.02 for v in allw) / 1024 <= 0.01 <= (sum(v >= cut - 0.05 for v in allw) + 4) / 1024


def test_scan_and_genome_chunks_agree(spark, tmp_path):
    r = random.Random(2)
    seq = "".join(r.choice("ACGTN") for _ in range(3000))
    lib = [MO.Motif("M", "m", np.array([[9 if b == c else 1.0 for c in "CACGTG"] for b in "ACGT"]), threshold=2.0)]
    g = spark.createDataFrame([("chr1", seq)], "chrom string, seq string")
    whole = {(x.start, x.strand, x.score) for x in MO.scan(g, lib, "chrom", "seq").collect()}
    parts = MO.build_database(g, lib, str(tmp_path / "db"), size=250)
    assert {(x.start, x.strand, x.score) for x in parts.collect()} == whole and len(whole) > 3
    assert MO.build_database(g, lib, str(tmp_path / "db"), size=250).count() == len(whole)


def _shuffled(spark):
    it = spark.sparkContext._jsc.sc().statusStore().executorList(False).iterator()
    n = 0
    while it.hasNext():
        n += it.next().totalShuffleWrite()
    return n


def _dense_sites(spark, terms=120, regions=300):
    """Every term at nearly every region, in two parts that share none."""
    r = random.Random(5)
    rows = [(f"t{i}", 2 * k + i % 2, float(r.randrange(1, 50))) for i in range(terms) for k in range(regions) if r.random() < 0.9]
    return rows, spark.createDataFrame(rows, "term string, region int, score double").repartition(4)


def test_network_moves_no_row_for_each_pair_of_a_region(spark):
    rows, s = _dense_sites(spark)
    before, most = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    got = {(x.a, x.b): (x.correlation, x.shared) for x in N.cooccurrence_network(s, 0.1, 5).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    time.sleep(0.5)
    assert _shuffled(spark) - before < 3_000_000  # rows for pairs and regions took 11.6 MB, packed parts of lists take 0.8 MB
    terms, regions = sorted({x[0] for x in rows}), sorted({x[1] for x in rows})
    m = np.zeros((len(terms), len(regions)))
    for t, k, v in rows:
        m[terms.index(t), regions.index(k)] = v
    c, both = np.corrcoef(m), (m > 0).astype(int) @ (m > 0).astype(int).T
    want = {(terms[i], terms[j]): (c[i, j], both[i, j]) for i in range(len(terms)) for j in range(i + 1, len(terms)) if abs(c[i, j]) >= 0.1 and both[i, j] >= 5}
    assert got.keys() == want.keys() and len(got) > 1000
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in got)


def test_network_degrees_read_their_edges_once(spark):
    n = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    e = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.25)], "a string, b string, w double").mapInArrow(seen, "a string, b string, w double")
    assert {tuple(x) for x in N.degrees(e).collect()} == {("a", 1, 0.5), ("b", 2, 0.75), ("c", 1, 0.25)}
    assert n.value == 2


def test_network_file_is_written_packed(spark, tmp_path):
    from locusmill.sources import writers

    e = spark.createDataFrame([(f"t{i}", f"t{i + 1}", 5, 0.25) for i in range(5000)], "a string, b string, shared bigint, correlation double").coalesce(1)
    sizes = []
    for kind in ("none", "gzip"):
        p = tmp_path / kind
        writers.write_tab(e, str(p), e.columns, header=True, compression=kind)
        sizes.append(sum(x.stat().st_size for x in p.glob("part-*")))
        back = spark.read.csv(str(p), sep="\t", header=True, schema=e.schema)
        assert back.count() == 5000 and not back.exceptAll(e).count()
    assert sizes[1] * 3 < sizes[0]


def test_network_of_odd_sites(spark):
    rows = [("a", 1, 2.0), ("a", 1, 3.0), ("b", 1, 5.0), (None, 1, 9.0), ("a", None, 4.0), ("b", 2, None), ("a", 2, 1.0), ("c", 3, 1.0), (None, 4, 1.0)]
    s = spark.createDataFrame(rows, "term string, region int, score double")
    (x,) = N.cooccurrence_network(s, 0.0, 1).collect()
    # four regions; the scores of a are 3, 1 and 4 (at none), those of b 5 and NULL
    r = (4 * 15 - 8 * 5) / ((4 * 26 - 64) * (4 * 25 - 25)) ** 0.5
    assert (x.a, x.b, x.shared) == ("a", "b", 2) and x.correlation == pytest.approx(r)
    assert N.cooccurrence_network(s.limit(0), 0.0, 1).count() == 0
    few, held = N.TERMS_HELD, N.cooccurrence_network(_dense_sites(spark, 20, 30)[1], 0.05, 2).toPandas()
    try:
        N.TERMS_HELD = 3
        many = N.cooccurrence_network(_dense_sites(spark, 20, 30)[1], 0.05, 2).toPandas()
    finally:
        N.TERMS_HELD = few
    assert held.sort_values(["a", "b"]).round(12).values.tolist() == many.sort_values(["a", "b"]).round(12).values.tolist() and len(held)


def _shuffled_by(spark, fn):
    """What fn gives, and the bytes it shuffles when nothing is broadcast by size, as for large tables."""
    most, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), _shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = fn()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    time.sleep(0.5)
    return got, _shuffled(spark) - before


def _links(nodes=150):
    """Two parts, in which 80 of 100 nodes are linked."""
    r = random.Random(4)
    return [(f"n{i}", f"n{j}") for i in range(nodes) for j in range(i + 2, nodes, 2) if r.random() < 0.8]


def test_network_components_by_a_forest(spark):
    rows = _links()
    e = spark.createDataFrame(rows, "a string, b string").repartition(3)
    assert N.forest(e, 1000).count() < len(rows) // 5
    assert {r.id: r.component for r in N.components(N.forest(e, 1000)).collect()} == {r.id: r.component for r in N.components(e).collect()} == {f"n{i}": f"n{i % 2}" for i in range(150)}
    assert N.components(N.forest(e.limit(0))).count() == 0


def test_network_summary_shuffles_a_forest(spark):
    rows = _links(300)
    e = spark.createDataFrame(rows, "a string, b string").repartition(3)
    e.count()
    x, moved = _shuffled_by(spark, lambda: N.network_summary(e).first())
    assert (x.nodes, x.links, x.components) == (300, len(rows), 2)
    assert moved < 400_000, moved


def test_network_ranks_move_by_node(spark):
    rows = _links()
    e = spark.createDataFrame(rows + [(b, a) for a, b in rows[:50]], "a string, b string").repartition(3)
    got, moved = _shuffled_by(spark, lambda: {r.id: r["rank"] for r in N.pagerank(e, 5).collect()})
    m = np.zeros((150, 150))
    for a, b in rows:
        m[int(a[1:]), int(b[1:])] = m[int(b[1:]), int(a[1:])] = 1
    x = np.full(150, 1 / 150)
    for _ in range(5):
        x = 0.15 / 150 + 0.85 * m @ (x / m.sum(0))
    assert got == {f"n{i}": pytest.approx(x[i]) for i in range(150)}
    assert moved < 400_000, moved


def test_network_triangles_move_by_list(spark):
    rows = _links(200)
    e = spark.createDataFrame(rows, "a string, b string").repartition(3)
    got, moved = _shuffled_by(spark, lambda: {r.id: (r.triangles, r.clustering) for r in N.triangles(e).collect()})
    m = np.zeros((200, 200))
    for a, b in rows:
        m[int(a[1:]), int(b[1:])] = m[int(b[1:]), int(a[1:])] = 1
    t, d = np.diag(m @ m @ m) / 2, m.sum(0)
    assert got == {f"n{i}": (t[i], pytest.approx(t[i] / (d[i] * (d[i] - 1) / 2))) for i in range(200)}
    assert moved < 1_000_000, moved
    few = N.TERMS_HELD
    try:
        N.TERMS_HELD = 3
        assert {r.id: r.triangles for r in N.triangles(e).collect()} == {k: v[0] for k, v in got.items()}
        assert N.pagerank(e, 2).count() == 200
    finally:
        N.TERMS_HELD = few


def test_network_communities_move_by_node(spark):
    r = random.Random(6)
    rows = [(f"n{i}", f"n{j}", r.random() + (i % 5 == j % 5)) for i in range(150) for j in range(i + 1, 150) if r.random() < (0.8 if i % 5 == j % 5 else 0.1)]
    e = spark.createDataFrame(rows, "a string, b string, w double").repartition(3)
    got, moved = _shuffled_by(spark, lambda: {x.id: x.community for x in N.communities(e).collect()})
    want, plain = _shuffled_by(spark, lambda: {x.id: x.community for x in E.communities(e.unionByName(e.selectExpr("b as a", "a as b", "w"))).collect()})
    assert got == want and len(set(got.values())) == 5
    assert moved * 5 < plain, (moved, plain)


def test_network_parts(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    assert {r.id: r.component for r in N.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    t = {r.id: r.triangles for r in N.triangles(e).collect()}
    assert t == {"a": 1, "b": 1, "c": 1, "d": 0, "x": 0, "y": 0}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r.component for r in N.components(chain).collect()} == {0}


def test_contacts(spark):
    r = random.Random(3)
    pairs = spark.createDataFrame([(f"r{i}_{r.choice('AB')}", "chr1", a := r.randrange(40), "chr1", min(39, a + int(r.expovariate(0.3)))) for i in range(3000)], "read_id string, chrom1 string, pos1 bigint, chrom2 string, pos2 bigint")
    px = C.cis(C.pixels(pairs, 1))
    assert px.agg(F.sum("count")).first()[0] == 3000 and px.where("bin1 > bin2").count() == 0
    w = C.balance(px, ignore_diags=0, min_nnz=1)
    b = C.both_sides(C.balanced(px, w), "balanced").groupBy("bin1").agg(F.sum("balanced").alias("s"))
    s = [x.s for x in b.collect()]
    assert max(s) == pytest.approx(1, abs=0.02) and min(s) == pytest.approx(1, abs=0.02)
    d = {x.offset: x["mean"] for x in C.decay(px, spark.createDataFrame([("chr1", 40)], "chrom string, n bigint")).collect()}
    assert d[0] > d[5] > d[15]
    assert C.demux(pairs, spark.createDataFrame([("A", "g")], "barcode string, group string"), True).groupBy("group").count().count() == 2
