"""Operators against their definitions, computed plainly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.operators import contacts as C
from locusmill.operators import embed as E
from locusmill.operators import stats as ST


def test_tmm_factors_count_zeros(spark):
    r = np.random.default_rng(3)
    x = r.poisson(r.gamma(0.6, 20, size=(80, 1)) * np.array([1.0, 2.0, 0.5, 1.5]))
    x[:30, 1] = 0  # a sample that lacks many features
    lib = x.sum(0)
    ratio = x / np.maximum(lib, 1)
    q = np.quantile(ratio, 0.75, axis=0)
    ref = int(np.abs(q - q.mean()).argmin())
    f = np.ones(4)
    for j in range(4):
        both = (x[:, j] > 0) & (x[:, ref] > 0)
        if j != ref and both.sum() >= 4:
            m, a = np.log2(ratio[both, j] / ratio[both, ref]), np.log2(ratio[both, j] * ratio[both, ref]) / 2
            (m0, m1), (a0, a1) = np.quantile(m, [0.3, 0.7]), np.quantile(a, [0.05, 0.95])
            f[j] = 2 ** m[(m >= m0) & (m <= m1) & (a >= a0) & (a <= a1)].mean()
    f /= np.exp(np.log(f).mean())
    rows = [(f"s{j}", f"f{i}", float(x[i, j])) for i in range(80) for j in range(4) if x[i, j]]
    got = {g["sample"]: g.factor for g in ST.tmm_factors(spark.createDataFrame(rows, "sample string, feature string, value double")).collect()}
    assert [got[f"s{j}"] for j in range(4)] == pytest.approx(f.tolist(), rel=1e-9)


def test_tmm_factors_with_too_little(spark):
    few = spark.createDataFrame([("a", f"f{i}", 1.0) for i in range(9)] + [("b", f"f{i}", 5.0) for i in range(3)], "sample string, feature string, value double")
    assert [g.factor for g in ST.tmm_factors(few).collect()] == [1.0, 1.0]
    assert [g.factor for g in ST.tmm_factors(few.where("sample = 'a'")).collect()] == [1.0]


def test_planted_differences_rank_first(spark):
    r = np.random.default_rng(0)
    mean = r.gamma(2, 40, size=300)
    up = np.ones((300, 8))
    up[:15, :4], up[15:30, :4] = 4, 0.25
    x = r.poisson(mean[:, None] * up)
    rows = [(f"s{j}", f"f{i}", float(x[i, j])) for i in range(300) for j in range(8) if x[i, j]]
    meta = spark.createDataFrame([(f"s{j}", "t" if j < 4 else "c") for j in range(8)], "sample string, condition string")
    got = ST.differential(spark.createDataFrame(rows, "sample string, feature string, value double"), meta, "t", "c").orderBy("pvalue").limit(30).collect()
    assert sum(int(g.feature[1:]) < 30 for g in got) >= 28
    assert all((g.log2FoldChange > 0) == (int(g.feature[1:]) < 15) for g in got if int(g.feature[1:]) < 30)


def test_rank_within_large_groups(spark):
    d = spark.range(3000).select((F.col("id") % 100 > 65).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("v"), "id").withColumn("g", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("g")))
    got = ST.rank_within(d, ["g"], ["v", "id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(((r.v, r.id), r["rank"]))
    assert len(got) == 3000 and all([k for _, k in sorted(v)] == list(range(1, len(v) + 1)) for v in by.values()) and set(by) == {0, 1, None}
    assert ST.rank_within(d.limit(0), ["g"], ["v"]).count() == 0


def test_singular_values_of_wide_matrices(spark):
    r = np.random.default_rng(8)
    # four blocks of columns, each with one direction, so that the singular values lie apart
    own = np.kron(np.eye(4), r.normal(size=(1, 175)))
    m = (r.normal(size=(60, 4)) * [20, 9, 5, 1] * (r.random((60, 4)) < 0.6)) @ own
    m[m != 0] += r.normal(size=(m != 0).sum()) * 0.01
    x = spark.createDataFrame([(f"c{i}", f"f{j:03}", float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "cell string, feature string, value double")
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    for most in (4000, 100):
        gu, gv, gs = E.gram_svd(x, 3, most_dims=most)
        assert gs == pytest.approx(s[:3], rel=1e-6)
        rows, cols = {q.cell: q.vec for q in gu.collect()}, {q.feature: q.v for q in gv.collect()}
        a, b = np.array([rows[f"c{i}"] for i in range(60)]), np.array([cols[f"f{j:03}"] for j in range(700)])
        assert np.abs(np.sum(a * u[:, :3], 0)) == pytest.approx(1, abs=1e-5) and np.abs(np.sum(b * vt[:3].T, 0)) == pytest.approx(1, abs=1e-5)
        assert (a * gs) @ b.T == pytest.approx((u[:, :3] * s[:3]) @ vt[:3], abs=1e-2)


def test_student_probabilities_at_once():
    t = np.array([0.0, 0.3, -1.2, 2.5, 9.0, -40.0, np.inf, np.nan])
    for df in (1, 3, 10, 250):
        got = ST.t_two_sided_all(t, df)
        assert got[:-1] == pytest.approx([ST.t_two_sided(v, df) for v in t[:-1]], rel=1e-9, abs=1e-300) and np.isnan(got[-1])


def test_imputation_by_definition(spark):
    r = np.random.default_rng(2)
    m = np.triu(r.poisson(0.3, size=(14, 14)))
    m = m + np.triu(m, 1).T
    n = len(m)
    box = np.array([[m[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].sum() for j in range(n)] for i in range(n)], float)
    w = box / np.maximum(box.sum(1), 1e-300)[:, None]
    w[box.sum(1) == 0] = 0
    walk = 0.05 * np.linalg.inv(np.eye(n) - 0.95 * w)
    v = np.log1p((walk + walk.T) / 2 * n / max(box.sum(), 1))
    want = np.where(v >= np.quantile(v, 0.95), v, 0)
    assert C.impute_matrix(m) == pytest.approx(want)
    rows = [("c", "chr1", i, j, int(m[i, j])) for i in range(n) for j in range(i, n) if m[i, j]]
    got = np.zeros((n, n))
    bins = spark.createDataFrame([("chr1", n)], "chrom string, n bigint")
    for x in C.impute(spark.createDataFrame(rows, "cell string, chrom string, bin1 bigint, bin2 bigint, count bigint"), bins).collect():
        got[x.bin1, x.bin2] = x.value
    assert got == pytest.approx(np.triu(want))
    assert C.impute_matrix(np.zeros((3, 3))).max() >= 0 and C.impute_matrix(np.zeros((0, 0))).shape == (0, 0)


@pytest.mark.parametrize("standardize", [True, False])
def test_canonical_directions(spark, standardize):
    r = np.random.default_rng(4)
    base = r.normal(size=(3, 12))
    a, b = np.abs(r.normal(size=(40, 3)) @ base), np.abs(r.normal(size=(25, 3)) @ base)
    a[:, 7] = 1.0  # doesn't vary
    long = lambda m, p: spark.createDataFrame([(f"{p}{i}", f"f{j:02}", float(m[i, j])) for i in range(len(m)) for j in range(m.shape[1])], "cell string, feature string, value double")
    extra = spark.createDataFrame([("x0", "own", 5.0)], "cell string, feature string, value double")
    got = {(g.side, g.cell): np.array(g.vec) for g in E.integrate(long(a, "x").unionByName(extra), long(b, "y"), 3, standardize=standardize, unit=False).collect()}
    scale = lambda m: (m - m.mean(0)) / np.where(m.std(0, ddof=1) > 1e-9, m.std(0, ddof=1), np.inf) if standardize else m
    u, s, vt = np.linalg.svd(scale(a) @ scale(b).T, full_matrices=False)
    left, right = np.array([got["a", f"x{i}"] for i in range(40)]), np.array([got["b", f"y{i}"] for i in range(25)])
    for k in range(3):
        sign = np.sign(left[:, k] @ u[:, k])
        assert left[:, k] * sign == pytest.approx(u[:, k], abs=1e-6) and right[:, k] * sign == pytest.approx(vt[k], abs=1e-6)
    one = E.integrate(long(a, "x"), long(b, "y"), 3).first().vec
    assert np.linalg.norm(one) == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_of_all_rows(spark, metric):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(500, 6)), np.repeat(r.normal(size=(1, 6)), 250, 0)])
    y = x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" else x
    d = 1 - y @ y.T if metric == "cosine" else np.sqrt(np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T, 0))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :5]
    v = spark.createDataFrame([(int(i), q.tolist()) for i, q in enumerate(x)], "id bigint, vec array<double>")
    for cell_rows, probes, least in ((2000, 8, 1.0), (50, 15, 1.0), (50, 6, 0.9)):
        got = {}
        for g in E.all_knn(v, 5, metric, cell_rows=cell_rows, probes=probes).collect():
            got.setdefault(g.id, []).append(g.distance)
        assert len(got) == 750 and all(len(q) == 5 for q in got.values())
        assert np.mean([sorted(q)[j] <= want[i, j] + 1e-6 for i, q in got.items() for j in range(5)]) >= least
    assert E.all_knn(v.limit(0), 5).count() == 0
    assert {g.id for g in E.all_knn(v, 2, query=F.col("id") < 3).collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        E.all_knn(v, 2, "manhattan")
