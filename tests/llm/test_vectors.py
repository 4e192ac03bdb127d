import numpy as np
import pytest

from locusmill.llm import hnsw as H
from locusmill.llm import mcl as M

VEC = "cell_id bigint, vec array<float>, id string"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id bigint, vec array<float>")


def brute(x, k):
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    return [set(np.argsort(r, kind="stable")[:k].tolist()) for r in d]


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(1500, 24)), rng.normal(size=(40, 24)).repeat(40, 0) * 4 + rng.normal(size=(1600, 24)) * 0.3]).astype(np.float32)
    g = H.Graph.load(H.Graph.build(x).dump())
    assert len(g.layers) > 1
    at, d = g.search(x, 11)
    want = brute(x.astype(np.float64), 10)
    hit = sum(len(w & set(a.tolist())) for w, a in zip(want, at, strict=True))
    assert hit / (10 * len(x)) > 0.95
    assert (np.diff(d, axis=1) >= -1e-4).all()


@pytest.mark.parametrize("shard", [100, 5000])
def test_knn_over_shards(spark, shard):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(30, 16)).repeat(30, 0) * 3 + rng.normal(size=(900, 16))).astype(np.float32)
    got = {}
    for r in H.knn(frame(spark, x), 8, shard_rows=shard).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    want = brute(x.astype(np.float64), 8)
    assert all(len(set(v)) == 8 and i not in v for i, v in got.items()) and len(got) == 900
    assert sum(len(want[i] & set(v)) for i, v in got.items()) / 7200 > 0.97


def test_knn_equal_vectors_and_small_tables(spark):
    one = np.ones((300, 4), np.float32)
    got = H.knn(frame(spark, one), 5, shard_rows=40).collect()
    assert len(got) == 1500 and all(r.distance < 1e-3 for r in got)
    assert H.knn(frame(spark, one[:1]), 5).count() == 0
    assert H.knn(frame(spark, one[:0]), 5).count() == 0
    three = H.knn(frame(spark, np.eye(4, dtype=np.float32)[:3]), 5).collect()
    assert len(three) == 6
    near = H.knn(frame(spark, np.array([[0, 0], [0, 1], [9, 9]], np.float32)), 2, reach=2.0).collect()
    assert {(r.id, r.neighbour) for r in near} == {(0, 1), (1, 0)}


def test_usable_vectors(spark):
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [1.0, float("nan")], "a"), (5, [1.0, None], "a"), (6, [], "a"), (None, [1.0, 1.0], "a"), (7, [3.0, 4.0], "a"), (8, [float("inf"), 1.0], "a")]
    u = {r.id: r.vec for r in H.usable_vectors(spark.createDataFrame(rows, VEC)).collect()}
    assert u == {1: [1.0, 2.0], 7: [3.0, 4.0]}
    n = {r.id: r.vec for r in H.usable_vectors(spark.createDataFrame(rows, VEC), unit=True).collect()}
    assert n[7] == pytest.approx([0.6, 0.8])


def test_markov_clusters_on_small_graphs(spark):
    clique = [(a, b, 1.0) for a in range(5) for b in range(a)]
    other = [(a, b, 1.0) for a in range(10, 14) for b in range(10, a)]
    star = [(100, 100 + i, 1.0) for i in range(1, 60)]
    e = spark.createDataFrame([(int(a), int(b), w) for a, b, w in clique + other + [(4, 10, 0.05)] + star + [(7, 7, 1.0)] + clique[:3]], "a bigint, b bigint, w double")
    got = {r.id: r.attractor for r in M.markov_clusters(e).collect()}
    assert {got[i] for i in range(5)} == {got[0]} and {got[i] for i in range(10, 14)} == {got[10]} and got[0] != got[10]
    assert {got[100 + i] for i in range(60)} == {100} and 7 not in got
    assert all(got[v] == v for v in set(got.values()))
    assert M.markov_clusters(e.limit(0)).count() == 0


def test_clusters_of_vectors_are_whole(spark):
    rng = np.random.default_rng(3)
    sizes = [1, 1, 2, 5, 40, 250]
    c = np.linalg.qr(rng.normal(size=(20, 20)))[0][: len(sizes)]
    x = np.concatenate([np.repeat(v[None], n, 0) + rng.normal(size=(n, 20)) * 0.05 for v, n in zip(c, sizes, strict=True)])
    truth = np.repeat(np.arange(len(sizes)), sizes)
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)], "cell_id bigint, vec array<float>")
    out = M.cell_clusters(df)
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(x)
    for k in range(len(sizes)):
        assert len({got[i].cluster for i in np.flatnonzero(truth == k)}) == 1
    assert len({r.cluster for r in got.values()}) == len(sizes)
    assert all(r.similarity > 0.8 and got[r.cluster].cluster == r.cluster for r in got.values())
    labels = spark.createDataFrame([(i, "x" if i % 3 else None) for i in range(len(x))], "id bigint, label string")
    rep = {r.cluster: r for r in M.cluster_report(out, labels).collect()}
    assert sorted(r["size"] for r in rep.values()) == sizes
    assert all(r.typical[0] == c and len(r.typical) == min(3, r["size"]) for c, r in rep.items())
    assert M.cell_clusters(df.limit(0)).count() == 0


def test_usable_row_beside_unusable_ones(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0], "a"), (1, [nan, 1.0], "a"), (2, [inf, 1.0], "b"), (2, [-3.0, 1.0], "b"), (3, [0.0, 0.0], "c"), (3, [-1.0, 0.0], "c"), (3, None, "c"), (4, [nan, 0.0], "d"), (5, [9.0, None], "e"), (5, [4.0, 1.0], "e"), (5, [], "e")]
    assert {r.id: r.vec for r in H.usable_vectors(spark.createDataFrame(rows, VEC)).collect()} == {1: [1.0, 2.0], 2: [-3.0, 1.0], 3: [-1.0, 0.0], 5: [4.0, 1.0]}


def test_copies_grow_with_what_is_asked():
    for shards, per in ((10, 1), (10, 40_000), (1000, 3), (500, 100_000)):
        asked = {i: per + i % 7 for i in range(shards)} | {-1: 0}
        got = H.copies(asked, 4096)
        assert set(got) == set(range(shards)) and min(got.values()) >= 1
        assert sum(got.values()) <= shards + sum(asked.values()) / (H.ASKED_SHARDS * 4096)
        assert all(asked[i] <= n * H.ASKED_SHARDS * 4096 for i, n in got.items())


def test_divide_bounds_shards():
    rng = np.random.default_rng(2)
    cen, size = rng.normal(size=(300, 5)).astype(np.float32), rng.integers(0, 40, 300)
    size[7] = 500
    shard = H._divide(cen, size, [np.arange(200), np.arange(200, 300)], 100)
    assert all(size[shard == g].sum() <= 100 or (shard == g).sum() == 1 for g in np.unique(shard))
    assert not set(shard[:200]) & set(shard[200:])


def test_knn_with_cells_larger_than_shards(spark):
    """Few cells of many vectors, a third of them equal: large cells are refined, equal vectors split by a hash."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(600, 8)), np.repeat(rng.normal(size=(1, 8)), 300, 0)]).astype(np.float32)
    got = {}
    for r in H.knn(frame(spark, x), 6, shard_rows=60, most_cells=3).collect():
        got.setdefault(r.id, []).append((r.neighbour, r.distance))
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, 5]
    assert len(got) == 900 and all(len(v) == 6 for v in got.values())
    assert np.mean([t <= want[i] + 1e-3 for i, v in got.items() for _, t in v]) > 0.97


def test_ends_of_attractor_pointers(spark):
    p = [(1, 2), (2, 3), (3, 3), (4, 5), (5, 4), (6, 7), (7, 8), (8, 6), (9, 4), (10, 1)]
    got = {r.id: r.attractor for r in M._ends(spark.createDataFrame([(a, b, 1.0) for a, b in p], "id bigint, attractor bigint, flow double")).collect()}
    assert {got[i] for i in (1, 2, 3, 10)} == {3} and {got[i] for i in (4, 5, 9)} == {4} and [got[i] for i in (6, 7, 8)] == [6, 7, 8]


def test_typical_members_receive_the_most_flow(spark):
    rows = [(1, 1, 1.0, 1.0, 0.5), (2, 1, 0.99, 1.0, 2.0), (3, 1, 0.9, 1.0, 3.0), (4, 1, 0.95, 1.0, 2.0), (9, 9, 1.0, 1.0, 0.0)]
    m = spark.createDataFrame(rows, "id bigint, cluster bigint, similarity double, flow double, inflow double")
    assert {r.cluster: r.typical for r in M.cluster_report(m).collect()} == {1: [1, 3, 2], 9: [9]}


def test_inflow_and_whole_columns(spark):
    e = spark.createDataFrame([(0, i, 1.0) for i in range(1, 6)] + [(1, 2, 0.9)], "a bigint, b bigint, w double")
    got = {r.id: r for r in M.markov_clusters(e).collect()}
    assert {r.attractor for r in got.values()} == {0} and max(got.values(), key=lambda r: r.inflow).id == 0
    whole = {r.id: r.attractor for r in M.markov_clusters(e, entries=None, prune=0.0).collect()}
    assert set(whole.values()) == {0}
    one = {r.id: r.attractor for r in M.markov_clusters(e, rounds=0, loops=False).collect()}
    assert set(one.values()) == {0}


def test_asked_shards_do_not_grow_with_shards():
    """Over 400 groups of cells a vector asks no more than the most likely ones, and these hold nearly all its neighbours; one without k neighbours so far asks all within reach."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(2000, 30)).repeat(10, 0) + rng.normal(size=(20_000, 30)) * 0.25).astype(np.float32)
    cen = H._fit(x[::5], 800)
    cell, off = H._nearest_cell(x, cen)
    radius = np.zeros(len(cen), np.float32)
    np.maximum.at(radius, cell, off)
    group = np.arange(800) // 2
    q = x[:400]
    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0))
    near = np.argsort(d, axis=1)[:, 1:9]
    kth = d[np.arange(400), near[:, -1]].astype(np.float64)
    kth[0] = np.inf
    row, to = H._within(q, cell[:400], kth, cen, radius, group, 6)
    asked = np.bincount(row, minlength=400)
    assert asked[1:].max() <= 6 and asked[0] == 399 and (to != group[cell[row]]).all()
    got = set(zip(row.tolist(), to.tolist(), strict=True))
    held = [(group[cell[j]] == group[cell[i]]) or (i, group[cell[j]]) in got for i in range(400) for j in near[i]]
    assert np.mean(held) > 0.97


def test_nearer_than_what_is_known():
    """A scanned shard and one searched by its graph give the rows that are nearer than the k-th known ones, also nearly equal ones."""
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(50, 12)).repeat(20, 0) * 3 + rng.normal(size=(1000, 12)) * 0.3).astype(np.float32)
    q = np.concatenate([x[:40] + np.float32(1e-4), x[40:60] + np.float32(90)])
    d = np.sqrt(((q[:, None].astype(np.float64) - x[None]) ** 2).sum(2))
    kth = np.where(np.arange(60) < 40, np.sort(d, axis=1)[:, 4] + 1e-3, 1.0)
    for scan in (16_384, 100):
        H.SCAN_ROWS, before = scan, H.SCAN_ROWS
        try:
            some, at, dd = H._nearer(x, q, 5, kth, 48)
        finally:
            H.SCAN_ROWS = before
        assert some.tolist() == list(range(40))
        want = [set(np.argsort(r)[:5].tolist()) for r in d[:40]]
        assert np.mean([len(w & set(a.tolist())) for w, a in zip(want, at, strict=True)]) > 4.8
        assert (np.sqrt(dd[:, 0]) < 1e-3).all()


def test_vectors_of_small_clusters_ask_few_shards():
    """With a reach, as for clusters, also a vector that has fewer than k neighbours asks no more than the most likely groups."""
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(1500, 24)).repeat(3, 0) + rng.normal(size=(4500, 24)) * 0.05).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    cen = H._fit(x, 300)
    cell, off = H._nearest_cell(x, cen)
    radius = np.zeros(len(cen), np.float32)
    np.maximum.at(radius, cell, off)
    kth = np.full(len(x), 0.4**0.5)
    every, _ = H._within(x, cell, kth, cen, radius, np.arange(300), 300)
    row, to = H._within(x, cell, kth, cen, radius, np.arange(300), 8)
    assert np.bincount(every).max() > 8 >= np.bincount(row).max()
    got = set(zip(row.tolist(), to.tolist(), strict=True))
    held = [cell[i] == cell[j] or (i, int(cell[j])) in got for i in range(len(x)) for j in range(i - i % 3, i - i % 3 + 3)]
    assert np.mean(held) > 0.99


def test_flow_writes_no_table_for_a_round(spark, monkeypatch):
    """Rounds and levels of flow run within tasks: the tables written for a search of neighbours and the flow on it are few, however many rounds the flow takes."""
    rng = np.random.default_rng(12)
    c = np.linalg.qr(rng.normal(size=(16, 16)))[0][:6]
    x = np.concatenate([c.repeat(60, 0) + rng.normal(size=(360, 16)) * 0.07])
    df = spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in enumerate(x)], "cell_id bigint, vec array<float>")
    written, write = [], M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name="t": written.append(name) or write(df, name))
    got = {r.id: r.cluster for r in M.cell_clusters(df).collect()}
    assert len(got) == 360 and all(len({got[i] for i in range(k, k + 60)}) == 1 for k in range(0, 360, 60)) and len(set(got.values())) == 6
    assert len(written) <= 1 + 2 * 8


def test_flow_in_parts_is_that_of_rounds(spark, monkeypatch):
    """Dense, sparse and distributed flow lead every node to the same attractor, with the same flow."""
    rng = np.random.default_rng(13)
    size = np.array([2, 3, 7, 30, 90, 200])
    part = np.repeat(np.arange(len(size)), size)
    start = np.cumsum(size) - size
    links = {}
    for p, (s, n) in enumerate(zip(start, size, strict=True)):
        group = rng.integers(0, max(1, n // 12), n)
        for i in range(1, n):
            links[s + i, s + rng.integers(0, i)] = 0.05 + 0.1 * rng.random()  # a part hangs together
        for i, j in rng.integers(0, n, (8 * n, 2)).tolist():
            if i != j and (group[i] == group[j] or rng.random() < 0.05):
                links[s + i, s + j] = 0.2 + 0.8 * rng.random()
    a, b, w = np.array([i for i, _ in links]), np.array([j for _, j in links]), np.array(list(links.values()))
    cluster, flow, inflow = M.flow_in_parts(a, b, w, part)
    assert all(len(set(cluster[part == p])) == 1 for p in range(len(size)))
    monkeypatch.setattr(M, "DENSE_ROWS", 5)
    sparse = M.flow_in_parts(a, b, w, part)
    assert (sparse[0] == cluster).all() and np.allclose(sparse[1], flow, rtol=1e-4) and np.allclose(sparse[2], inflow, rtol=1e-4)
    whole = M.flow_in_parts(a, b, w, part * 0)
    assert (whole[0] == cluster).all()
    e = spark.createDataFrame([(int(i), int(j), float(x)) for i, j, x in zip(a, b, w, strict=True)], "a bigint, b bigint, w double")
    got = {r.cluster: r for r in M._flow_by_rounds(e).collect()}
    assert [got[i].attractor for i in range(len(part))] == cluster.tolist()
    assert np.allclose([got[i]._in for i in range(len(part))], inflow, rtol=1e-3)


@pytest.mark.parametrize("ways", [{}, {"local_rows": 20, "driver_links": 0}])
def test_parts_over_shards(spark, monkeypatch, ways):
    """Clusters whose links cross the shards, some named only by other shards, come out whole, once for each vector."""
    near = [(1, 0, [(0.1, 3)]), (2, 0, []), (5, 0, [(0.2, 6)]), (3, 1, []), (4, 1, [(0.3, 3)]), (1, 0, [(0.05, 6)]), (6, 2, []), (7, 2, [(0.4, 8), (0.9, 1)]), (8, 2, [(0.4, 7)]), (9, 3, [(0.1, 2)])]
    lists = spark.createDataFrame(near, "id bigint, shard int, near array<struct<d: double, id: bigint>>")
    rows = M._flowed(lists, 15, 0.8, ways.get("local_rows", 2), ways.get("driver_links", 100)).collect()
    got = {r.cluster: r.attractor for r in rows}
    assert len(rows) == len(got) == 9 and len({got[i] for i in (1, 3, 4, 5, 6)}) == 1 and len(set(got.values())) == 3 and got[7] == got[8] and got[2] == got[9]
    rng = np.random.default_rng(14)
    x = rng.normal(size=(60, 24)).repeat(12, 0) + rng.normal(size=(720, 24)) * 0.2
    df = frame(spark, x / np.linalg.norm(x, axis=1)[:, None])
    lists = M.neighbour_lists
    monkeypatch.setattr(M, "neighbour_lists", lambda *a, **b: lists(*a, shard_rows=40, **b))
    member = M.cluster_members(df, 0.8, **ways).collect()
    got = {r.id: r.cluster for r in member}
    assert len(member) == len(got) == 720
    assert [len({got[i] for i in range(k, k + 12)}) for k in range(0, 720, 12)] == [1] * 60 and len(set(got.values())) == 60
