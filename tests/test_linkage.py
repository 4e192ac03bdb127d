import random

import numpy as np
import pytest

from locusmill.operators import linkage as L


def distances(fg, bg, bias):
    """Of each cell of fg the distances to all of bg, and the place of each name in bg."""
    v = np.array([x[1:] for x in fg + bg], float)
    m, s = v.mean(0), v.std(0, ddof=1)
    b = (np.array([x[1:] for x in bg], float) - m) / s
    return {name: (((np.array(x) - m) / s - b) ** 2).sum(1) for name, *x in fg}, {x[0]: i for i, x in enumerate(bg)}


@pytest.mark.parametrize("bias,k,n", [(1, 1, 900), (1, 4, 900), (2, 1, 900), (2, 5, 900), (2, 7, 5)])
def test_match_background_is_exact(spark, bias, k, n):
    """Outliers on both sides, whole numbers with ties, several bias values, fewer background rows than k."""
    r = random.Random(bias * 10 + k)
    row = lambda name: (name, *[float(r.randrange(40)) if i == 0 else round(r.gauss(0, 1), 3) for i in range(bias)])
    fg = [row(f"f{i}") for i in range(60)] + [("low", *[-300.0] * bias), ("high", *[500.0] * bias)]
    bg = [row(f"b{i}") for i in range(n)] + [("far", *[-290.0] * bias)]
    cols = [f"x{i}" for i in range(bias)]
    schema = "cell string, " + ", ".join(f"{c} double" for c in cols)
    got = L.match_background(spark.createDataFrame(fg, schema), spark.createDataFrame(bg, schema), cols, k, block=16)
    rows = got.collect()
    d, at = distances(fg, bg, bias)
    by = {name: [at[x.bg] for x in sorted((x for x in rows if x.cell == name), key=lambda x: x["rank"])] for name in d}
    assert len(rows) == len(fg) * min(k, len(bg))
    for name, places in by.items():
        assert len(set(places)) == len(places)
        assert d[name][places] == pytest.approx(np.sort(d[name])[:k], rel=1e-9, abs=1e-9)


def test_match_background_leaves_out_unknown_values(spark):
    fg = spark.createDataFrame([("a", 1.0), ("b", None), ("c", float("nan"))], "cell string, x double")
    bg = spark.createDataFrame([("p", 9.0), ("q", float("inf")), ("r", None)], "cell string, x double")
    assert [tuple(x) for x in L.match_background(fg, bg, ["x"], 2).collect()] == [("a", "p", 1)]
    assert L.match_background(fg, bg.limit(0), ["x"]).count() == 0


def test_match_background_ties_go_by_name(spark):
    fg, bg = [("a", 0.0), ("b", 0.0)], [(n, 0.0) for n in "qpor"] + [("far", 5.0)]
    got = L.match_background(*[spark.createDataFrame(x, "cell string, x double") for x in (fg, bg)], ["x"], 2).collect()
    assert sorted(map(tuple, got)) == [("a", "o", 1), ("a", "p", 2), ("b", "o", 1), ("b", "p", 2)]


@pytest.mark.parametrize("k", [1, 3])
def test_match_unique_takes_turns(spark, k):
    r = random.Random(k)
    near = [(f"c{i:02}", b, j + 1) for i in range(40) for j, b in enumerate(r.sample([f"b{x}" for x in range(25)], k))]
    used, want = set(), {}
    for c in sorted({x[0] for x in near}):
        for _, b, _ in sorted((x for x in near if x[0] == c), key=lambda x: x[2]):
            if b not in used:
                used.add(b)
                want[c] = b
                break
    got = L.match_unique(spark.createDataFrame(near, "cell string, bg string, rank int")).collect()
    assert {x.cell: x.bg for x in got} == want and len(got) == len(want)
    both = spark.createDataFrame([(g, *x) for g in "uv" for x in near], "g string, cell string, bg string, rank int")
    assert sorted((x.g, x.cell, x.bg) for x in L.match_unique(both, ["g"]).collect()) == sorted((g, c, b) for g in "uv" for c, b in want.items())


def test_match_apart(spark):
    rows = [("a", "g", 0.0), ("b", "g", 0.1), ("c", "h", 5.0), ("d", "h", 0.2), ("e", "i", 9.0)]
    d = spark.createDataFrame(rows, "cell string, group string, x double")
    got = {x.cell: x.bg for x in L.match_background(d, d, ["x"], apart="group", block=2).collect()}
    assert got == {"a": "d", "b": "d", "c": "e", "d": "b", "e": "c"}


def test_near_correlations(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(30, 12)) * (r.random((30, 12)) < 0.7)
    x[3] = 2.0
    names = [(f"f{i:02}", "chr1" if i % 3 else "chr2", int(i * 40)) for i in range(30)]
    values = spark.createDataFrame([(f"f{i:02}", f"s{j}", float(x[i, j])) for i in range(30) for j in range(12) if x[i, j]], "feature string, sample string, value double")
    at = spark.createDataFrame(names, "a string, chrom string, pos bigint")
    got = {(q.a, q.b): q.correlation for q in L.near_correlations(values, values, at, at.withColumnRenamed("a", "b"), 12, 200).collect()}
    want = {(a, b): np.corrcoef(x[i], x[j])[0, 1] for i, (a, c, p) in enumerate(names) for j, (b, e, q) in enumerate(names) if c == e and abs(p - q) <= 200 and 3 not in (i, j)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_marker_features_of_all_cells(spark):
    r = random.Random(0)
    cells = [(f"c{i}", "ab"[i % 2]) for i in range(60)]
    x = [(c, "up", 3) for c, g in cells if g == "a"] + [(c, f"n{k}", 1) for c, _ in cells for k in range(5) if r.random() < 0.5]
    bias = spark.createDataFrame([(c, float(r.random())) for c, _ in cells], "cell string, depth double")
    args = spark.createDataFrame(x, "cell string, feature string, value int"), spark.createDataFrame(cells, "cell string, group string")
    for got in (L.marker_features(*args, max_cells=None), L.marker_features(*args, bias, max_cells=None), L.marker_features(*args, bias, replace=True)):
        rows = {(q.group, q.feature): q for q in got.collect()}
        assert rows["a", "up"].fdr < 1e-6 and rows["a", "up"].pct_fg == 1 and rows["a", "up"].pct_bg == 0 and rows["a", "n0"].fdr > 0.01


def test_deviations_by_index_and_by_joins_agree(spark):
    r = random.Random(5)
    x = [(f"c{i}", f"f{k}", r.randrange(1, 4)) for i in range(15) for k in range(30) if r.random() < 0.3] + [("lone", "outside", 2)]
    motifs = [(f"m{k % 4}", f"f{k}") for k in range(30)] + [("m0", "f1"), ("absent", "never")]
    peers = [(f"f{k}", i, f"f{r.randrange(30)}") for k in range(30) for i in range(6)]
    args = [spark.createDataFrame(d, t) for d, t in ((x, "cell string, feature string, value int"), (motifs, "motif string, feature string"), (peers, "feature string, iteration int, peer string"))]
    one, two = ({(q.cell, q.motif): (q.dev, q.z) for q in L.deviations(*args, index_rows=k).collect()} for k in (1000, 10))
    assert set(one) == set(two) and len(one) == 16 * 4
    for k, v in one.items():
        assert [a is None for a in v] == [a is None for a in two[k]] and [a for a in v if a is not None] == pytest.approx([a for a in two[k] if a is not None])
