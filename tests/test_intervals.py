import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusmill.operators import dyadic
from locusmill.operators import intervals as I
from locusmill.operators import regions as R

SCHEMA = "name string, chrom string, start bigint, end bigint"


def rows(n, seed, most=3000, width=200):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(most)
        out.append((f"n{i}", r.choice(["chr1", "chr2", "chr3"]), s, s + r.randrange(0, width)))
    return out


def brute_stretches(ivs):
    """(start, end, distinct intervals) of touching or overlapping intervals."""
    out = []
    for s, e in sorted(set(ivs)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] + 1)
        else:
            out.append((s, e, 1))
    return out


def expected(data):
    by = {}
    for k, s, e in data:
        if s is not None and e is not None and 0 <= s < e:
            by.setdefault(k, []).append((s, e))
    want = set()
    for k, v in by.items():
        st_ = brute_stretches(v)
        want |= {(k, "covered" if n > 1 else "single", s, e) for s, e, n in st_}
        want |= {(k, "gap", a[1], b[0]) for a, b in zip(st_, st_[1:], strict=False)}
    return want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 300), st.integers(1, 80)), min_size=1, max_size=60))
def test_union_of_dyadic_blocks(data):
    import numpy as np

    g, s, w = (np.array(x, np.int64) for x in zip(*data, strict=True))
    o = np.argsort(g, kind="stable")
    g, s, e = g[o], s[o], (s + w)[o]
    got = list(zip(*(x.tolist() for x in dyadic.union_of_blocks(dyadic.dyadic_blocks(g, s, e))), strict=True))
    want = [(k, a, b) for k in sorted(set(g.tolist())) for a, b, _ in brute_stretches([(x, y) for i, x, y in zip(g.tolist(), s.tolist(), e.tolist(), strict=True) if i == k])]
    assert got == want


def run_periods(spark, data, **kw):
    df = spark.createDataFrame([(k, s, e, "x") for k, s, e in data], "k string, start bigint, end bigint, kind string")
    return [tuple(r) for r in dyadic.periods(df, ["k"], **kw).collect()]


def test_periods_match_brute_force_on_both_paths(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), (s := r.randrange(4000)), s + r.choice([1, 5, 40, 900])) for _ in range(800)]
    data += data[:50] + [("a", None, 5), ("a", 7, None), ("a", 9, 9), ("b", 12, 3), ("b", -5, 8)]
    for kw in ({}, {"hot_rows": 10, "tile_bits": 6}):
        got = run_periods(spark, data, **kw)
        assert len(got) == len(set(got))
        assert set(got) == expected(data)


def test_periods_empty_touching_and_repeats(spark):
    assert run_periods(spark, []) == []
    assert set(run_periods(spark, [("a", 0, 5), ("a", 5, 9)])) == {("a", "covered", 0, 9)}
    assert set(run_periods(spark, [("a", 3, 5)] * 3)) == {("a", "single", 3, 5)}
    big = 1 << 61
    assert set(run_periods(spark, [("a", big, big + 5), ("a", 0, 1)])) == {("a", "single", 0, 1), ("a", "gap", 1, big), ("a", "single", big, big + 5)}


def test_overlap_semi_anti_and_left(spark):
    a, b = rows(150, 2), rows(120, 3)
    x, y = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    pairs = {(p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < p[3] and q[2] < q[3] and p[2] < q[3] and p[3] > q[2]}
    got = [(r.name, r.r_name) for r in I.overlap_join(x, y, bits=6).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    hit = {p for p, _ in pairs}
    assert {r.name for r in I.overlap_filter(x, y).collect()} == hit
    assert {r.name for r in I.overlap_filter(x, y, anti=True).collect()} == {p[0] for p in a} - hit
    left = I.overlap_join(x, y, how="left", bits=6)
    assert {r.name for r in left.where("r_name is null").collect()} == {p[0] for p in a} - hit


def test_nearest_and_asof(spark):
    pts = [(f"p{i}", c, x) for i, (c, x) in enumerate([("chr1", 10), ("chr1", 500), ("chr1", 9000), ("chr2", 5), ("chr9", 1)])]
    t = [("chr1", 40), ("chr1", 5000), ("chr2", 5)]
    n = I.nearest(spark.createDataFrame(pts, "name string, chrom string, pos bigint"), spark.createDataFrame(t, "chrom string, at bigint"), bits=4)
    assert {(r.name, r._left, r._right) for r in n.collect()} == {("p0", None, 40), ("p1", 40, 5000), ("p2", 5000, None), ("p3", 5, None), ("p4", None, None)}


def test_distal_cases(spark):
    peaks = spark.createDataFrame([("chr1", s, s + 100) for s in (100, 5000, 20000)] + [("chrY_weird", 5, 105)], "chrom string, start bigint, end bigint")
    tss = spark.createDataFrame([("chr1", 1000), ("chr1", 30000)], "chrom string, tss bigint")
    assert sorted(r.start for r in I.filter_distal(peaks, tss).collect()) == [5, 5000, 20000]
    f = spark.createDataFrame([("chr1", 500), ("chr1", 9900), ("chr2", 3)], "chrom string, tss bigint")
    p = spark.createDataFrame([("chr1", 100, 200), ("chr1", 1000, 1100), ("chr1", 10000, 10100)], "chrom string, start bigint, end bigint")
    assert sorted(r.distance for r in I.distance_to_nearest(f, p).collect()) == [150, 350]


def test_overlap_classes(spark):
    mk = lambda v: spark.createDataFrame([("chr1", a, b) for a, b in v], "chrom string, start bigint, end bigint")
    a, b, c = mk([(100, 200), (500, 600), (1500, 1600)]), mk([(150, 250), (2000, 2100)]), mk([(1520, 1620), (3000, 3100)])
    got = sorted(r["class"] for r in I.classify_by_overlap({"A": a, "B": b, "C": c}).collect())
    assert got == ["A-specific", "A/B shared", "A/C shared", "B-specific", "C-specific"]


def test_running_sum_and_runs(spark):
    a = rows(200, 5)
    d = spark.createDataFrame(a, SCHEMA)
    got = {(r.chrom, r.start, r.end, r.value) for r in I.coverage_runs(d, ["chrom"]).collect()}
    want = set()
    for c in ("chr1", "chr2", "chr3"):
        v = [(s, e) for _, k, s, e in a if k == c and s < e]
        edges = sorted({x for p in v for x in p})
        for s, e in zip(edges, edges[1:], strict=False):
            n = sum(p[0] <= s and p[1] >= e for p in v)
            if n:
                want.add((c, s, e, n))
    assert got == want


def test_merge_subtract_resolve(spark):
    d = spark.createDataFrame([("chr1", 0, 10), ("chr1", 10, 20), ("chr1", 15, 30), ("chr1", 16, 18)], "chrom string, start bigint, end bigint")
    assert sorted((r.start, r.end) for r in R.merge_regions(d).collect()) == [(0, 10), (10, 30)]
    assert sorted((r.start, r.end) for r in R.merge_regions(d, touching=True).collect()) == [(0, 30)]
    cut = spark.createDataFrame([("chr1", 2, 4), ("chr1", 3, 6), ("chr1", 9, 12), ("chr1", 29, 99)], "chrom string, start bigint, end bigint")
    one = spark.createDataFrame([("x", "chr1", 0, 30), ("y", "chr2", 0, 3), ("z", "chr1", 3, 5)], SCHEMA)
    assert sorted((r.name, r.start, r.end) for r in R.subtract(one, cut).collect()) == [("x", 0, 2), ("x", 6, 9), ("x", 12, 29), ("y", 0, 3)]
    s = spark.createDataFrame([("chr1", 0, 10, 1.0), ("chr1", 5, 15, 3.0), ("chr1", 12, 20, 2.0), ("chr1", 40, 50, 0.0)], "chrom string, start bigint, end bigint, score double")
    assert sorted(r.start for r in R.resolve_overlaps(s).collect()) == [5, 40]


def test_region_arithmetic(spark):
    d = spark.createDataFrame([("a", "chr1", 10, 35, "-")], SCHEMA + ", strand string")
    assert [(r.start, r.end) for r in R.split_regions(d, 10).orderBy("start").collect()] == [(10, 20), (20, 30), (30, 35)]
    sizes = spark.createDataFrame([("chr1", 30)], "chrom string, length bigint")
    assert [(r.start, r.end) for r in R.check_boundary(d, sizes).collect()] == [(10, 30)]
    assert R.check_boundary(d, sizes, "remove").count() == 0
    w = R.set_width(d, 11).first()
    assert w.end - w.start == 11
    p = d.select(R.parse_region(F.lit("chr1-5-9")).alias("x"), R.parse_region(F.lit("bad")).alias("y")).first()
    assert tuple(p.x) == ("chr1", 5, 9) and p.y is None
