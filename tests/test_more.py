import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill import functions as FN
from locusmill import plans
from locusmill.operators import annotate as A
from locusmill.operators import footprints as FP
from locusmill.operators import motifs as MO
from locusmill.operators import reads as R
from locusmill.operators import signal as S
from locusmill.operators import stats as ST


def test_text_helpers(spark):
    assert FN.common_prefix(["abc", "abd", "ab"]) == "ab" and FN.common_prefix([]) == ""
    assert FN.match_names(["s_a1_x", "s_b2_x"], ["q/b2", "q/a1"]) == [("s_a1_x", "q/a1"), ("s_b2_x", "q/b2")]
    d = spark.createDataFrame([("chr1:1,000:2000:50",), ("chr2",)], "r string")
    assert [tuple(x[0]) for x in d.select(FN.user_region("r")).collect()] == [("chr1", 1000, 2000, 50), ("chr2", None, None, None)]
    n = spark.createDataFrame([("1.0", 950), ("x", 12_000), ("2.50", 3_000_000)], "a string, b bigint").select(FN.whole_number("a"), FN.short_length("b"))
    assert [tuple(x) for x in n.collect()] == [("1", "950bp"), ("x", "12kb"), ("2.50", "3Mb")]


def test_window_kernels_brute_force():
    r = np.random.default_rng(0)
    x = r.integers(0, 5, 60).astype(float)
    at = lambda i: x[i] if 0 <= i < 60 else 0.0
    n = 4
    assert S.half_open_sum(x, n).tolist() == [sum(at(i) for i in range(p - n, p + n)) for p in range(60)]
    left, mid, right = S.window_sums(x, 5, 3)
    for p in range(60):
        assert mid[p] == sum(at(i) for i in range(p - 5, p + 5))
        # a flank of 3 is 2 * (3 // 2) wide
        assert left[p] == sum(at(i) for i in range(p - 7, p - 5)) and right[p] == sum(at(i) for i in range(p + 5, p + 7))
    cuts = np.r_[np.ones(20) * 9, np.zeros(10), np.ones(20) * 9]
    s = S.footprint_pvalues(cuts, np.ones(50), 5, 5)
    assert 22 <= s.argmax() <= 28 and s.max() > 3
    raw = S.footprint_pvalues(cuts, np.ones(50), 5, 5, 0)
    top = [max(raw[max(0, i - 1) : i + 3]) for i in range(50)]
    assert s == pytest.approx([sum(top[j] for j in range(i - 2, i + 2) if 0 <= j < 50) / 4 for i in range(50)])
    assert S.footprint_pvalues(np.zeros(30), np.ones(30), 3, 3).max() == 0


def test_sequences_across_pieces(spark):
    r = random.Random(0)
    seq = "".join(r.choice("ACGT") for _ in range((1 << 20) + 500))
    g = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    cut = [("a", "c", (1 << 20) - 30, (1 << 20) + 30), ("b", "c", 5, 9), ("off", "c", (1 << 20) + 490, (1 << 20) + 600), ("neg", "c", -5, 9), ("none", "d", 1, 5)]
    got = {x.feature: x.seq for x in MO.extract_sequences(g, spark.createDataFrame(cut, "feature string, chrom string, start bigint, end bigint")).collect()}
    assert got == {n: seq[s:e] for n, _, s, e in cut[:2]}
    lo = MO.Motif("m", "m", np.array([[9, 0.0], [0, 9], [0, 0], [0, 0]]) + 1).pssm()
    v = MO.sliding_score("ACNAC", lo)
    assert np.isnan(v[[0, 2, 3]]).all() and v[1] == v[4] > 0


def test_pair_weights_of_equal_tables_are_zero(spark):
    c = FP.pair_counts(spark.createDataFrame([(s,) for s in ("ACGT", "AGGT", "TCGA")], "seq string"))
    assert all(abs(r.weight) < 1e-12 for r in FP.pair_weights(c, c).collect())


def test_ks_and_ratio(spark):
    d = spark.createDataFrame([("a", float(i)) for i in range(50)] + [("b", float(i + 25)) for i in range(50)], "g string, v double")
    k = ST.ks_two_sample(d, "v", "g", "a", "b").first()
    assert k.d == pytest.approx(0.5) and k.p_value < 1e-4
    same = ST.ks_two_sample(d.where("g = 'a'").unionByName(d.where("g = 'a'").withColumn("g", F.lit("b"))), "v", "g", "a", "b").first()
    assert same.d == 0 and same.p_value == pytest.approx(1.0)
    q = ST.quantile_ratio_factors(d.select(F.col("g").alias("sample"), F.col("v").alias("value")), n=5)
    assert q.count() == 10


def test_zones_and_annotation(spark):
    g = spark.createDataFrame([("plus", "c", 10_000, 20_000, "+"), ("minus", "c", 400_000, 500_000, "-")], "gene string, chrom string, start bigint, end bigint, strand string")
    z = {(r.gene, r.kind): (r.start, r.end) for r in A.gene_zones(g).collect()}
    assert z["plus", "promoter"] == (9000, 10_100) and z["minus", "promoter"] == (499_900, 500_000) and z["plus", "body"] == (10_000, 20_000)
    assert z["plus", "up_distal"] == (0, 9000) and z["minus", "down_distal"] == (300_000, 499_000)
    p = spark.createDataFrame([("p1", "c", 9500, 9600), ("p2", "c", 15_000, 15_100), ("p3", "d", 1, 5)], "feature string, chrom string, start bigint, end bigint")
    assert {r.feature: (r.kind, r.near_gene) for r in A.annotate_peaks(p, g).collect()} == {"p1": ("promoter", "plus"), "p2": ("body", "plus"), "p3": ("intergenic", None)}


def test_reads(spark):
    rows = [("r1", 99, "c", 100, 140, 60, "+", 160, 100), ("r1", 147, "c", 160, 200, 60, "-", 100, -100), ("r2", 99 + 1024, "c", 1, 41, 60, "+", 9, 48), ("r3", 4, "c", 1, 41, 60, "+", 9, 0), ("r4", 99, "chrM", 1, 41, 60, "+", 9, 48)]
    d = spark.createDataFrame(rows, "read_id string, flag bigint, chrom string, pos bigint, end bigint, mapq bigint, strand string, mate_pos bigint, tlen bigint")
    ok = R.filter_reads(d)
    assert {r.read_id for r in ok.collect()} == {"r1"}
    s = {r.strand: (r.pos, r.end, r.mate_pos, r.tlen) for r in R.shift_cuts(ok).collect()}
    assert s == {"+": (104, 144, 155, 91), "-": (155, 195, 104, -91)}
    assert [(r.start, r.end) for r in R.reads_to_fragments(ok, "x").collect()] == [(100, 200)]
    assert sum(r.value * (r.end - r.start) for r in R.reads_to_coverage(ok, "none", extend=50).collect()) == 100


def test_map_regions_and_plan(spark):
    sizes = spark.createDataFrame([("c", 25)], "chrom string, length bigint")
    no = spark.createDataFrame([("c", 8, 12)], "chrom string, start bigint, end bigint")
    got = plans.map_regions(sizes, lambda c, s, e: {"s": [s], "e": [e]}, "s bigint, e bigint", 10, without=no).collect()
    assert sorted(map(tuple, got)) == [(0, 8), (12, 20), (20, 25)]
    r = random.Random(0)
    f = spark.createDataFrame([(r.choice("ab"), "chr1", s := r.randrange(5000), s + 150, 1) for _ in range(200)], "cell string, chrom string, start bigint, end bigint, count int")
    cells, x = plans.cells_and_tiles(f, 500, 20, 5)
    assert cells.count() == 2 and x.select("feature").distinct().count() >= 5
