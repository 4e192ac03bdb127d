"""Embeddings and groups of cells: latent semantic indexing, neighbours, label transfer, clustering of graphs and vectors, doublets, joint embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusmill.operators.matrices import top_features, variable_features
from locusmill.operators.stats import tf_idf, tf_logidf
from locusmill.util import materialize, shuffle_width, small

#: Features that a Gram matrix may have: it is summed by partitions and decomposed on the driver. Wider matrices go by power iterations on a block of vectors.
MOST_DIMS = 4000


def _matrix_rows(x: DataFrame, row: str, col: str) -> tuple[DataFrame, list]:
    """(rows (row, i, v) with column numbers and values, written; the columns in order) of a long matrix."""
    spark = x.sparkSession
    cols = [r[0] for r in x.select(col).distinct().orderBy(col).collect()]
    at = small(spark.createDataFrame([(c, i) for i, c in enumerate(cols)], T.StructType([x.schema[col], T.StructField("_i", T.IntegerType())])))
    rows = x.join(at, col).groupBy(row).agg(F.collect_list("_i").alias("i"), F.collect_list(F.col("value").cast("double")).alias("v"))
    return materialize(rows, "rows"), cols


def _gram(rows: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of the rows' outer products, sum of the rows, their number). Each partition sums its own, the partial sums of a matrix row are added by one task of its own, so that
    d rows reach the driver, however many partitions there are."""

    def gram(parts):
        g, t, n = np.zeros((d, d)), np.zeros(d), 0
        for p in parts:
            for lo in range(0, len(p), 1000):
                q = p.iloc[lo : lo + 1000]
                m = np.zeros((len(q), d))
                for j, (i, v) in enumerate(zip(q["i"], q["v"], strict=True)):
                    m[j, i] = v
                g += m.T @ m
                t += m.sum(0)
                n += len(q)
        if n:
            yield pd.DataFrame({"r": np.arange(-2, d), "g": [np.array([float(n)]), t, *g]})

    def add(p):
        return pd.DataFrame({"r": p["r"].iloc[:1], "g": [np.sum(p["g"].to_list(), axis=0)]})

    kind = "r int, g array<double>"
    g, t, n = np.zeros((d, d)), np.zeros(d), 0
    few = rows.select("i", "v").coalesce(shuffle_width(rows.sparkSession))
    for r in few.mapInPandas(gram, kind).groupBy("r").applyInPandas(add, kind).toLocalIterator():
        if r.r >= 0:
            g[r.r] = r.g
        elif r.r == -1:
            t = np.array(r.g)
        else:
            n = int(r.g[0])
    return g, t, n


def _power(rows: DataFrame, v: np.ndarray, block: int = 512) -> np.ndarray:
    """The Gram matrix of the rows times v, without the matrix: each partition sums its rows' share, blocks of columns are added by tasks of their own."""
    d, k = v.shape

    def run(parts):
        out, seen = np.zeros((d, k)), False
        for p in parts:
            for i, x in zip(p["i"], p["v"], strict=True):
                x = np.asarray(x)
                out[i] += np.outer(x, x @ v[i])
                seen = True
        if seen:
            yield pd.DataFrame({"b": np.arange(0, d, block) // block, "g": [out[lo : lo + block].ravel() for lo in range(0, d, block)]})

    def add(p):
        return pd.DataFrame({"b": p["b"].iloc[:1], "g": [np.sum(p["g"].to_list(), axis=0)]})

    kind, out = "b int, g array<double>", np.zeros((d, k))
    for r in rows.select("i", "v").coalesce(shuffle_width(rows.sparkSession)).mapInPandas(run, kind).groupBy("b").applyInPandas(add, kind).toLocalIterator():
        out[r.b * block : r.b * block + block] = np.reshape(r.g, (-1, k))
    return out


def gram_svd(x: DataFrame, k: int, row: str = "cell", col: str = "feature", most_dims: int = MOST_DIMS, rounds: int = 6, seed: int = 1) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Rank-k singular values of a long matrix: (rows (row, vec = U), columns (col, v), s).

    Up to most_dims columns the columns' Gram matrix is summed on the executors, and the driver gets one matrix of columns by columns. A wider matrix goes through `rounds` power
    iterations of k + 10 seeded vectors, of which the driver holds one value for each column; singular values that lie close together are then less exact. Signs: the entry of greatest
    size of each column vector is positive.
    """
    spark = x.sparkSession
    rows, cols = _matrix_rows(x, row, col)
    d = len(cols)
    if d <= most_dims:
        w, v = np.linalg.eigh(_gram(rows, d)[0])
    else:
        v = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, min(d, k + 10))))[0]
        for _ in range(rounds):
            v = np.linalg.qr(_power(rows, v))[0]
        w, e = np.linalg.eigh(v.T @ _power(rows, v))
        v = v @ e
    o = np.argsort(-w)[: min(k, d)]
    s = np.sqrt(np.maximum(w[o], 0))
    v = v[:, o]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(len(o))])
    u = _project_rows(rows, row, v / np.where(s > 0, s, 1), x.schema[row].dataType.simpleString())
    cv = spark.createDataFrame([(c, v[i].tolist()) for i, c in enumerate(cols)], T.StructType([x.schema[col], T.StructField("v", T.ArrayType(T.DoubleType()))]))
    return u, cv, s


def _project_rows(rows: DataFrame, row: str, proj: np.ndarray, kind: str, less: np.ndarray | float = 0.0) -> DataFrame:
    def project(parts):
        for p in parts:
            yield pd.DataFrame({row: p[row], "vec": [np.asarray(vv) @ proj[ii] - less for ii, vv in zip(p["i"], p["v"], strict=True)]})

    return rows.mapInPandas(project, f"`{row}` {kind}, vec array<double>")


def project(x: DataFrame, v: DataFrame, s: np.ndarray, row: str = "cell", col: str = "feature") -> DataFrame:
    """Rows of a long matrix in the space of column vectors v (col, v): sum of value * v / s."""
    k = len(s)
    parts = [F.sum(F.col("value") * F.col("v")[i] / float(s[i] or 1.0)).alias(f"c{i}") for i in range(k)]
    return x.join(v, col).groupBy(row).agg(*parts).select(row, F.array(*[F.col(f"c{i}") for i in range(k)]).alias("vec"))


def scale_dims(u: DataFrame, key: str = "cell", by_row: bool = False) -> DataFrame:
    """vec standardised per dimension (or within each row)."""
    if by_row:
        m = F.aggregate("vec", F.lit(0.0), lambda a, b: a + b) / F.size("vec")
        v = F.aggregate(F.transform("vec", lambda a: (a - m) * (a - m)), F.lit(0.0), lambda a, b: a + b) / (F.size("vec") - 1)
        return u.withColumn("vec", F.transform("vec", lambda a: (a - m) / F.when(v > 0, F.sqrt(v)).otherwise(1.0)))
    k = len(u.first().vec)
    s = u.agg(*[f(F.col("vec")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return u.withColumn("vec", F.array(*[(F.col("vec")[i] - s[f"m{i}"]) / (s[f"s{i}"] or 1.0) for i in range(k)]))


def drop_depth_dims(u: DataFrame, depth: DataFrame, most: float = 0.75, key: str = "cell") -> DataFrame:
    """vec without the dimensions whose correlation with log10(depth + 1) exceeds `most` in size."""
    k = len(u.first().vec)
    c = u.join(depth, key).agg(*[F.corr(F.col("vec")[i], F.log10(F.col("depth") + 1)).alias(f"c{i}") for i in range(k)]).first()
    keep = [i for i in range(k) if c[f"c{i}"] is None or abs(c[f"c{i}"]) <= most] or [0]
    return u.withColumn("vec", F.array(*[F.col("vec")[i] for i in keep]))


def lsi(x: DataFrame, k: int = 20, drop_first: bool = True, flavour: str = "row") -> DataFrame:
    """(cell, vec): TF-IDF, rows scaled to sum 1, log1p(1e4 *), rank-k SVD, z-scores within rows (flavour row) or per dimension (column) or U * s (raw); the first dimension dropped."""
    n = x.select("cell").distinct().count()
    t = tf_idf(x, n)
    r = t.groupBy("cell").agg(F.sum("value").alias("_r"))
    t = t.join(r, "cell").select("cell", "feature", F.log1p(F.col("value") / F.col("_r") * 1e4).alias("value"))
    u, _, s = gram_svd(t, k)
    if flavour == "raw":
        u = u.withColumn("vec", F.array(*[F.col("vec")[i] * float(s[i]) for i in range(len(s))]))
    else:
        u = scale_dims(u, by_row=flavour == "row")
    return u.withColumn("vec", F.slice("vec", 2, len(s))) if drop_first else u


def iterative_lsi(x: DataFrame, k: int = 20, iterations: int = 2, features: int = 2000, resolution: float = 1.0, n_clusters: int = 8, depth_cut: float = 0.75) -> DataFrame:
    """(cell, vec): rounds of TF-logIDF on chosen features, SVD, dimensions that follow depth dropped, z-scores, clustering, and the features most variable between clusters for the next round."""
    b = materialize(x.where("value > 0").select("cell", "feature", F.lit(1.0).alias("value")), "bin")
    n = b.select("cell").distinct().count()
    depth = b.groupBy("cell").agg(F.sum("value").alias("depth"))
    chosen = top_features(b, features).select("feature")
    u = None
    for i in range(iterations):
        t = tf_logidf(b.join(F.broadcast(chosen), "feature"), n)
        u, _, _ = gram_svd(t, k)
        u = materialize(scale_dims(drop_depth_dims(u, depth, depth_cut)), "lsi")
        if i + 1 < iterations:
            chosen = variable_features(b, kmeans(u, n_clusters), features).select("feature")
    return u


def kmeans(vectors: DataFrame, k: int, seed: int = 1, bisecting: bool = False, key: str = "cell") -> DataFrame:
    """(key, cluster) by k-means with scalable starting points, or by bisecting k-means."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.functions import array_to_vector

    d = vectors.select(key, array_to_vector("vec").alias("features"))
    m = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed).fit(d)
    return m.transform(d).select(key, F.col("prediction").alias("cluster"))


def exact_knn(query: DataFrame, reference: DataFrame, k: int, metric: str = "euclidean", drop_self: bool = False, block: int = 2000) -> DataFrame:
    """(id, neighbour, distance, rank) by comparing a stated set of queries with all of the reference, in blocks: each task multiplies its reference rows with a block of queries and
    keeps its best k, so that what is shuffled is k rows for each query and task. metric: euclidean, cosine, manhattan or chebyshev."""
    q = query.select("id", "vec").collect()
    blocks = [([r.id for r in q[i : i + block]], np.array([r.vec for r in q[i : i + block]], np.float64)) for i in range(0, len(q), block)]
    kind = query.schema["id"].dataType.simpleString()

    def dist(a, b):
        if metric == "cosine":
            return 1 - (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
        if metric == "euclidean":
            return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
        f = np.sum if metric == "manhattan" else np.max
        return np.stack([f(np.abs(a[i] - b), axis=1) for i in range(len(a))])

    def run(parts):
        for p in parts:
            b, ids = np.array(p["vec"].tolist(), np.float64), p["id"].to_numpy()
            if not len(ids):
                continue
            for qid, a in blocks:
                d = dist(a, b)
                o = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
                yield pd.DataFrame({"id": np.repeat(np.array(qid, dtype=object), o.shape[1]), "neighbour": ids[o].ravel(), "distance": np.take_along_axis(d, o, 1).ravel()})

    r = reference.select("id", "vec").mapInPandas(run, f"id {kind}, neighbour {kind}, distance double")
    if drop_self:
        r = r.where(F.col("id") != F.col("neighbour"))
    w = W.partitionBy("id").orderBy("distance", "neighbour")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def all_knn(vectors: DataFrame, k: int, metric: str = "euclidean", query: Column | None = None, cell_rows: int = 2000, probes: int = 8, sample_rows: int = 20_000) -> DataFrame:
    """(id, neighbour, distance, rank): the k nearest others of every row of (id, vec) for which `query` holds, among all rows. metric: euclidean or cosine.

    Rows lie in the cell of their nearest centroid (fitted on a bounded sample; every row is indexed), and each is compared with the rows of the `probes` cells nearest to it: exact up to
    `probes` cells of `cell_rows` rows, nearly all neighbours beyond that. A cell of very many rows (equal vectors, say) is cut into pieces by a hash, and what is asked of a piece
    into parts, so that a task never multiplies more than some cell_rows by 8 * cell_rows. The driver holds the centroids, one for each cell_rows rows.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"all_knn knows the metrics euclidean and cosine, not {metric!r}")
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    base = materialize(vectors.select("id", F.col("vec").cast("array<double>").alias("vec"), (F.lit(True) if query is None else query).alias("q")), "vectors")
    n = base.count()

    def unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1)[:, None]
        return x / np.where(size > 0, size, 1) if metric == "cosine" else x

    def rows(p: pd.DataFrame) -> np.ndarray:
        return unit(np.array(p["vec"].tolist(), np.float64).reshape(len(p), -1))

    m = -(-n // sample_rows) or 1
    some = base.where(F.pmod(F.xxhash64("id"), F.lit(m)) == 0).limit(2 * sample_rows).select("vec").toPandas()
    some = some if len(some) else base.limit(1).select("vec").toPandas()
    if not len(some):
        return spark.createDataFrame([], f"id {kind}, neighbour {kind}, distance double, rank int")
    x = rows(some)
    cen = x[np.random.default_rng(7).choice(len(x), min(len(x), -(-n // cell_rows)), replace=False)]
    for _ in range(4 if len(cen) > 1 else 0):
        total, count = np.zeros(cen.shape), np.zeros(len(cen))
        for lo in range(0, len(x), 2000):
            near = ((cen * cen).sum(1)[None] - 2 * x[lo : lo + 2000] @ cen.T).argmin(1)
            np.add.at(total, near, x[lo : lo + 2000])
            np.add.at(count, near, 1)
        cen = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], cen)
    reach = min(probes, len(cen))

    def assign(parts):
        for p in parts:
            if not len(p):
                continue
            v, near = rows(p), []
            for lo in range(0, len(v), max(1, 4_000_000 // len(cen))):
                d = (cen * cen).sum(1)[None] - 2 * v[lo : lo + max(1, 4_000_000 // len(cen))] @ cen.T
                near.append(np.argsort(d, axis=1, kind="stable")[:, :reach])
            yield pd.DataFrame({"id": p["id"], "vec": list(v), "q": p["q"], "cells": list(np.concatenate(near).astype(np.int32))})

    placed = materialize(base.mapInPandas(assign, f"id {kind}, vec array<double>, q boolean, cells array<int>"), "placed")
    size = {r.c: r["n"] for r in placed.groupBy(F.col("cells")[0].alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = {r.c: r["n"] for r in placed.where("q").select(F.explode("cells").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = [(c, max(1, -(-s // (2 * cell_rows))), max(1, -(-asked.get(c, 0) // (8 * cell_rows)))) for c, s in size.items()]
    split = F.broadcast(spark.createDataFrame(split, "cell int, pieces int, parts int"))
    own = placed.select("id", "vec", F.col("cells")[0].alias("cell")).join(split, "cell")
    own = own.select(F.col("id").alias("n_id"), F.col("vec").alias("n_vec"), F.col("cell").alias("n_cell"), F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("n_piece"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("n_part"))
    ask = placed.where("q").select("id", "vec", F.explode("cells").alias("cell")).join(split, "cell")
    ask = ask.select("id", "vec", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part"))

    def compare(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p) and len(q):
            b, ids = np.array(q["n_vec"].tolist()), q["n_id"].to_numpy()
            for lo in range(0, len(p), 1000):
                mine = p.iloc[lo : lo + 1000]
                a = np.array(mine["vec"].tolist())
                d = 1 - a @ b.T if metric == "cosine" else np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
                o = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
                out.append(pd.DataFrame({"id": np.repeat(mine["id"].to_numpy(), o.shape[1]), "neighbour": ids[o].ravel(), "distance": np.take_along_axis(d, o, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "neighbour": [], "distance": []})

    keys = ["cell", "piece", "part"]
    r = ask.groupBy(*keys).cogroup(own.groupBy(*(f"n_{c}" for c in keys))).applyInPandas(compare, f"id {kind}, neighbour {kind}, distance double").where(F.col("id") != F.col("neighbour"))
    w = W.partitionBy("id").orderBy("distance", "neighbour")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def gauss_connectivities(near: DataFrame) -> DataFrame:
    """(a, b, w): exp(-d^2 / 2 s^2) of each neighbour with s the distance of the farthest one, averaged over both directions, absent ones being 0."""
    s = near.groupBy("id").agg(F.max("distance").alias("s"))
    e = near.join(s, "id").select(F.col("id").alias("a"), F.col("neighbour").alias("b"), F.exp(-F.pow("distance", 2) / (2 * F.pow("s", 2))).alias("w"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg((F.sum("w") / 2).alias("w"))


def fuzzy_connectivities(near: DataFrame) -> DataFrame:
    """(a, b, w) of the fuzzy neighbour graph: exp(-(d - nearest) / s) with s such that a row's weights sum to log2 k, and w = x + y - x y over both directions."""
    kind = near.schema["id"].dataType.simpleString()

    def row(p):
        d = p["distance"].to_numpy()
        pos = d[d > 0]
        rho = pos.min() if len(pos) else 0.0
        lo, hi, s, want = 0.0, np.inf, 1.0, np.log2(len(d))
        for _ in range(64):
            t = np.where(d - rho > 0, np.exp(-np.maximum(d - rho, 0) / s), 1.0).sum()
            if abs(t - want) < 1e-5:
                break
            if t > want:
                hi = s
                s = (lo + hi) / 2
            else:
                lo = s
                s = s * 2 if hi == np.inf else (lo + hi) / 2
        return pd.DataFrame({"a": p["id"], "b": p["neighbour"], "w": np.exp(-np.maximum(d - rho, 0) / max(s, 1e-12))})

    e = near.select("id", "neighbour", "distance").groupBy("id").applyInPandas(row, f"a {kind}, b {kind}, w double")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("n"))
    return both.select("a", "b", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))


def transfer_labels(near: DataFrame, labels: DataFrame, weighted: bool = True) -> DataFrame:
    """(id, label, score): the label with the greatest share of a query's neighbours, weighted exp(-d / mean d) of the query's neighbours."""
    m = near.groupBy("id").agg(F.avg("distance").alias("m"))
    w = F.exp(-F.col("distance") / F.greatest("m", F.lit(1e-12))) if weighted else F.lit(1.0)
    v = near.join(m, "id").join(labels.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("id", "label").agg(F.sum(w).alias("v"))
    best = F.min(F.struct((-F.col("v")).alias("n"), "label"))
    return v.groupBy("id").agg(best.alias("x"), F.sum("v").alias("t")).select("id", F.col("x.label").alias("label"), (-F.col("x.n") / F.col("t")).alias("score"))


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 12) -> DataFrame:
    """(id, community) of a weighted undirected graph (a, b, w, both directions) by synchronous local moving on modularity, on aggregated graphs in turn.

    In a round every node looks at its neighbours' communities and takes the one with the greatest gain w(node, c) - resolution * k * K(c) / 2m; only nodes of a
    hash-chosen half move, so that neighbours don't swap places for ever. Then communities become nodes. All steps are joins and aggregates.
    """
    member = None
    graph = materialize(edges.select("a", "b", F.col("w").cast("double").alias("w")).where("w > 0"), "graph")
    kind = graph.schema["a"].dataType.simpleString()
    two_m = graph.agg(F.sum("w")).first()[0]
    if not two_m:
        return edges.sparkSession.createDataFrame([], f"id {kind}, community {kind}")
    for _ in range(6):
        k = graph.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
        lab = materialize(k.select("id", F.col("id").alias("c"), "k"), "labels")
        before = lab.count()
        for r in range(rounds):
            tot = lab.groupBy("c").agg(F.sum("k").alias("all_k"))
            to = graph.where("a <> b").join(lab.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id"), "c").agg(F.sum("w").alias("w"))
            own = lab.select("id", F.col("c").alias("c0"), "k")
            g = to.join(own, "id").join(tot, "c")
            gain = F.col("w") - resolution * F.col("k") * (F.col("all_k") - F.when(F.col("c") == F.col("c0"), F.col("k")).otherwise(0.0)) / two_m
            best = g.withColumn("g", gain).groupBy("id").agg(F.max(F.struct("g", "c")).alias("x"), F.max(F.when(F.col("c") == F.col("c0"), F.col("g"))).alias("g0"))
            stay = F.coalesce("g0", F.lit(0.0))
            move = best.where((F.col("x.g") > stay + 1e-12) & (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0)).select("id", F.col("x.c").alias("c1"))
            new = materialize(lab.join(move, "id", "left").select("id", F.coalesce("c1", "c").alias("c"), "k", F.col("c1").isNotNull().alias("m")), "labels")
            moved = new.where("m").limit(1).count()
            lab = new.drop("m")
            if not moved and r % 2:
                break
        names = lab.select("id", "c")
        member = names.select("id", F.col("c").alias("community")) if member is None else member.join(names.select(F.col("id").alias("community"), F.col("c").alias("_c")), "community").select("id", F.col("_c").alias("community"))
        member = materialize(member, "member")
        if lab.select("c").distinct().count() == before:
            break
        a, b = names.select(F.col("id").alias("a"), F.col("c").alias("ca")), names.select(F.col("id").alias("b"), F.col("c").alias("cb"))
        graph = materialize(graph.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "graph")
    return member


def restrict_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are among nodes (id)."""
    n = nodes.select("id")
    return edges.join(n.withColumnRenamed("id", "a"), "a", "left_semi").join(n.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "w")


def rename_groups(labels: DataFrame, parent: str, sub: str) -> DataFrame:
    """labels with `group`: parent and sub-community joined by a comma."""
    return labels.withColumn("group", F.concat_ws(",", parent, sub))


def simulate_doublets(x: DataFrame, ratio: int = 2, seed: int = 0) -> DataFrame:
    """(cell, feature, value): rows of ratio * cells seeded random pairs of cells, summed. Cells are numbered by range partitions; a pair is two numbers from a hash."""
    from locusmill.operators.stats import global_rank

    ids = materialize(global_rank(x.select("cell").distinct(), ["cell"], "no"), "numbered")
    n = ids.count()
    sim = x.sparkSession.range(n * ratio)
    pick = lambda s: (F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(n)) + 1).alias("no")
    sides = sim.select("id", pick(0)).unionByName(sim.select("id", pick(1)))
    return sides.join(ids, "no").join(x, "cell").groupBy(F.concat(F.lit("sim"), F.col("id")).alias("cell"), "feature").agg(F.sum("value").alias("value"))


def doublet_scores(x: DataFrame, k: int = 15, ratio: int = 2, dims: int = 15, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """(cell, score, se): share of simulated doublets among the neighbours of each cell in the space of idf-weighted, row-scaled counts of both, as a likelihood."""
    from locusmill.operators.stats import closed_form_doublet

    n = x.select("cell").distinct().count()
    both = materialize(x.select("cell", "feature", F.col("value").cast("double").alias("value")).unionByName(simulate_doublets(x, ratio, seed).withColumn("value", F.col("value").cast("double"))), "both")
    idf = x.groupBy("feature").agg(F.log1p(F.lit(float(n)) / F.count(F.lit(1))).alias("i"))
    t = both.join(idf, "feature").withColumn("value", F.col("value") * F.col("i"))
    t = t.join(t.groupBy("cell").agg(F.sum("value").alias("r")), "cell").select("cell", "feature", (F.col("value") / F.col("r")).alias("value"))
    u, _, _ = gram_svd(t, dims)
    u = materialize(u.withColumnRenamed("cell", "id"), "space")
    kk = round(k * (1 + ratio))
    near = all_knn(u, kk, query=~F.col("id").startswith("sim"))
    nd = near.groupBy("id").agg(F.count_if(F.col("neighbour").startswith("sim")).alias("nd"))
    score, se = closed_form_doublet(F.col("nd"), F.lit(float(kk)), rate, float(ratio))
    return nd.select(F.col("id").alias("cell"), score.alias("score"), se.alias("se"))


def doublet_probability(scores: DataFrame, seed: int = 1) -> DataFrame:
    """scores with `probability` of the component with the greater mean of a mixture of two normal distributions, and is_doublet above one half."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = scores.withColumn("features", array_to_vector(F.array("score")))
    m = GaussianMixture(k=2, seed=seed).fit(d)
    top = int(np.argmax([g.mean[0] for g in m.gaussians]))
    p = m.transform(d).withColumn("probability", vector_to_array("probability")[top])
    return p.select(*scores.columns, "probability", (F.col("probability") > 0.5).alias("is_doublet"))


def integrate(x: DataFrame, y: DataFrame, k: int = 30, features: DataFrame | None = None, standardize: bool = True, unit: bool = True) -> DataFrame:
    """(cell, side, vec): the canonical directions of two long matrices over shared features (or those given in `features`): the left and right singular vectors of their cell by cell
    product, side `a` for x and `b` for y, with `unit` each cell's vector scaled to length 1.

    With `standardize` each feature is scaled to mean 0 and sample deviation 1 within its table first (0 where it doesn't vary). Cells without any shared feature are left out, and don't count as rows.
    The product A B' of the tables isn't formed: with the features' matrices P = A'A and Q = B'B and the eigenvectors e of P^1/2 Q P^1/2 with values s^2, the left vectors are A P^-1/2 e and the
    right ones B P^1/2 e / s. Signs as in gram_svd, from A's side. At most MOST_DIMS features.
    """
    f = x.select("feature").distinct().join(y.select("feature").distinct(), "feature")
    f = f if features is None else f.join(features.select("feature").distinct(), "feature")
    f = materialize(f, "shared")
    names = [r[0] for r in f.orderBy("feature").limit(MOST_DIMS + 1).collect()]
    if len(names) > MOST_DIMS:
        raise ValueError(f"more than {MOST_DIMS} shared features: select some first")
    d = len(names)
    side = []
    for t in (x, y):
        rows, cols = _matrix_rows(t.join(F.broadcast(f), "feature"), "cell", "feature")
        g, total, n = _gram(rows, d)
        mean = total / max(n, 1) if standardize else np.zeros(d)
        sd = np.ones(d)
        if standardize:
            var = np.maximum(np.diag(g) - n * mean * mean, 0) / max(n - 1, 1)
            sd = np.where(var > 1e-12, np.sqrt(var), np.inf)
        side.append((rows, mean, sd, (g - n * np.outer(mean, mean)) / np.outer(sd, sd)))
    (ra, ma, sa, p), (rb, mb, sb, q) = side
    w, v = np.linalg.eigh(p)
    w = np.maximum(w, 0)
    ok = w > w.max(initial=0) * 1e-10
    root, inverse = (v * np.sqrt(w)) @ v.T, (v[:, ok] / np.sqrt(w[ok])) @ v[:, ok].T
    s2, e = np.linalg.eigh(root @ q @ root)
    o = np.argsort(-s2)[: min(k, d)]
    o = o[s2[o] > max(s2.max(initial=0), 0) * 1e-12]
    left, right = inverse @ e[:, o], root @ e[:, o] / np.sqrt(s2[o])
    sign = np.sign(left[np.abs(left).argmax(0), np.arange(len(o))]) if d else 1
    out = None
    for name, rows, mean, sd, m in (("a", ra, ma, sa, left), ("b", rb, mb, sb, right)):
        m = m * sign / sd[:, None]
        u = _project_rows(rows, "cell", m, x.schema["cell"].dataType.simpleString(), mean @ m).select("cell", F.lit(name).alias("side"), "vec")
        out = u if out is None else out.unionByName(u)
    if not unit:
        return out
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v)) + 1e-9
    return out.withColumn("vec", F.transform("vec", lambda v: v / norm))


def joint(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("query", "reference")) -> DataFrame:
    """Rows of both tables with `modality`; columns that one lacks are NULL."""
    return a.withColumn("modality", F.lit(names[0])).unionByName(b.withColumn("modality", F.lit(names[1])), allowMissingColumns=True)


def weighted_buckets(points: DataFrame, bucket: str, weight: str = "w") -> DataFrame:
    """Each bucket's weighted mean vector and total weight of points (vec, weight, bucket)."""
    k = len(points.first().vec)
    agg = [(F.sum(F.col("vec")[i] * F.col(weight)) / F.sum(weight)).alias(f"c{i}") for i in range(k)]
    return points.groupBy(bucket).agg(F.sum(weight).alias(weight), *agg).select(bucket, F.array(*[F.col(f"c{i}") for i in range(k)]).alias("vec"), weight)


def row_labels(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with `label`, the same number for equal rows and different ones for others."""
    keys = df.select(*cols).distinct()
    from locusmill.operators.stats import global_rank

    return df.join(global_rank(keys, cols, "label"), cols)
