"""Networks of terms that share regions: edges by correlation, node measures, components and exports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.operators.packed import CHUNK, _packed, cuts_of, even_cuts, forest, links, list_sums, merged, node_sums, number, pair_sums, spans, unpacked
from locusmill.operators.stats import pearson
from locusmill.util import materialize, shuffle_width, small


#: Terms whose sums are held by the driver and by each task; of more terms, all pairs are written and joined with them.
TERMS_HELD = 2_000_000


def cooccurrence_network(sites: DataFrame, threshold: float = 0.5, min_shared: int = 10, method: str = "pearson") -> DataFrame:
    """(a, b, correlation, shared), a < b: terms of sites (term, region, score) whose greatest scores by region correlate at least `threshold` in size and that share min_shared regions, one at least, absent scores being 0.

    Regions are brought together once; their lists of terms then travel packed to the tasks that own the pairs, which sum and judge them, so no pair of a region is ever written.
    """
    spark = sites.sparkSession
    wide = shuffle_width(spark)
    ids = number(sites, "term")
    n_terms = ids.count()
    x = sites.select("term", "region", F.col("score").cast("double").alias("value")).join(small(ids), "term", "left").select("id", "region", "value")
    m = x.repartition(wide, "region").groupBy("id", "region").agg(F.max("value").alias("value"))
    if method == "spearman":
        # average ranks with the zeros as one tie below all
        m = materialize(m, "sites")
        n = m.agg(F.count_distinct("region")).first()[0]
        w = W.partitionBy("id")
        k = F.count(F.lit(1)).over(w)
        tie = F.count(F.lit(1)).over(W.partitionBy("id", "value"))
        rank = (n - k) + F.rank().over(w.orderBy("value")) + (tie - 1) / 2
        m = materialize(m.withColumn("value", rank - ((n - k) + 1) / 2), "ranks")
    entry = F.when(F.col("id").isNotNull(), F.struct("id", F.coalesce("value", F.lit(0.0)).alias("value")))
    lists = materialize(m.where(F.col("region").isNotNull()).groupBy("region").agg(F.collect_list(entry).alias("entries")).select("entries"), "lists")
    n = lists.count()
    # terms at no region have part in the sums only
    off = m.where(F.col("region").isNull() & F.col("id").isNotNull()).select("id", F.col("value").alias("s"), (F.col("value") * F.col("value")).alias("ss"), F.lit(0.0).alias("pairs"))
    sums = materialize(list_sums(lists).unionByName(off).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("s", "ss", "pairs")]), "sums")
    kind = ids.schema["term"].dataType.simpleString()
    if not n_terms or not n:
        return spark.createDataFrame([], f"a {kind}, b {kind}, correlation double, shared bigint")
    cuts = cuts_of(sums, n_terms)
    if n_terms > TERMS_HELD:
        pairs = pair_sums(lists, cuts, n_terms, lambda a, b, c, xy: pa.record_batch([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c).cast(pa.int64()), pa.array(xy)], ["ia", "ib", "shared", "xy"]), "ia int, ib int, shared bigint, xy double")
        t = ids.join(sums.drop("pairs"), "id")
        j = pairs.where(F.col("shared") >= min_shared).join(t.toDF("ia", "a", "sx", "sxx"), "ia").join(t.toDF("ib", "b", "sy", "syy"), "ib")
        r = pearson(F.lit(float(n)), *[F.col(c) for c in ("sx", "sy", "sxx", "syy", "xy")])
        return j.select("a", "b", r.alias("correlation"), "shared").where(F.abs("correlation") >= threshold)
    t = ids.join(sums, "id", "left").orderBy("id").select("term", "s", "ss").toArrow()
    held = spark.sparkContext.broadcast((t.column("term").combine_chunks(), *(t.column(c).fill_null(0.0).to_numpy() for c in ("s", "ss"))))

    def judged(a: np.ndarray, b: np.ndarray, c: np.ndarray, xy: np.ndarray) -> pa.RecordBatch:
        terms, s, ss = held.value
        den = np.sqrt((n * ss[a] - s[a] * s[a]) * (n * ss[b] - s[b] * s[b]))
        with np.errstate(all="ignore"):
            r = np.clip((n * xy - s[a] * s[b]) / den, -1, 1)
            keep = np.flatnonzero((c >= min_shared) & (den > 0) & (np.abs(r) >= threshold))
        return pa.record_batch([terms.take(pa.array(a[keep])), terms.take(pa.array(b[keep])), pa.array(r[keep]), pa.array(c[keep]).cast(pa.int64())], ["a", "b", "correlation", "shared"])

    return pair_sums(lists, cuts, n_terms, judged, f"a {kind}, b {kind}, correlation double, shared bigint")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, strength)."""
    # both ends from one pass over the edges
    b = edges.select(F.explode(F.array("a", "b")).alias("id"), "w")
    return b.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable, by alternating large and small stars, a logarithmic number of rounds; a node of many links sends each link once."""
    e = edges.select("a", "b").where("a <> b")
    nodes = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    cur = materialize(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        nxt = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(nxt, "stars")
        same = nxt.count() == cur.count() and not nxt.exceptAll(cur).limit(1).count()
        cur = nxt
        if same:
            break
    return nodes.join(cur.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def numbered(edges: DataFrame) -> tuple[DataFrame, int]:
    """(a table of the nodes' numbers in their order, how many they are)."""
    ids = number(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumnRenamed("id", "name"), "name")
    return ids, ids.count()


def coded(edges: DataFrame, ids: DataFrame, *more: str) -> DataFrame:
    e = edges.select("a", "b", *more).join(small(ids.toDF("a", "ia")), "a").join(small(ids.toDF("b", "ib")), "b")
    return e.select("ia", "ib", *more)


def packed(edges: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The links of both ends, packed."""

    def both(b: pa.RecordBatch):
        u, v = (x.to_numpy().astype(np.int64) for x in b.columns[:2])
        yield np.concatenate([u, v]), np.concatenate([v, u]), None

    return links(coded(edges, ids), even_cuts(np.ones(n), _parts(edges, n)), n, both)


def _parts(edges: DataFrame, n: int) -> int:
    return min(n, max(shuffle_width(edges.sparkSession), n // 20_000))


def _by_node(u: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    return u[start], np.add.reduceat(y, start)


def named(x: np.ndarray, name: str, ids: DataFrame) -> DataFrame:
    """(id, name) of a value for each number."""
    t = ids.sparkSession.createDataFrame(pa.table({"no": pa.array(np.arange(len(x)), pa.int32()), name: x}))
    return t.join(small(ids.toDF("id", "no")), "no").select("id", name)


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles, clustering) from each node's links towards higher degree (by powers of two, then by name), so that no node lists more than about the root of all links.

    Up to TERMS_HELD nodes, the lists travel packed to the tasks whose nodes link to them; of more nodes they are joined.
    """
    d = materialize(degrees(edges.withColumn("w", F.lit(1.0))).select("id", "degree"), "degrees")
    ids, n = numbered(edges)
    if not 0 < n <= TERMS_HELD:
        return _clustering(d, _joined_triangles(edges, d))
    t = d.join(small(ids.toDF("id", "no")), "id").select("no", "degree").toArrow()
    deg = np.zeros(n, np.int64)
    deg[t.column("no").to_numpy()] = t.column("degree").to_numpy()
    order = np.lexsort((np.arange(n), np.log2(np.maximum(deg, 1)).astype(int)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    cuts = even_cuts(deg[order].astype(float) ** 2, _parts(edges, n))
    held = edges.sparkSession.sparkContext.broadcast(place)

    def both(b: pa.RecordBatch):
        u, v = (held.value[x.to_numpy()] for x in b.columns[:2])
        u, v = u[u != v], v[u != v]
        yield np.concatenate([u, v]), np.concatenate([v, u]), None

    graph = links(coded(edges, ids), cuts, n, both)

    def send(batches):
        """Each node's links upwards, for its own task and those of its links downwards."""
        for b in batches:
            for u, v, _ in unpacked(b):
                up, at = v > u, np.searchsorted(cuts, v, "right") - 1
                own = np.searchsorted(cuts, u[:1], "right")[0] - 1
                x, y = u[up], v[up]
                asked = np.unique(np.concatenate([at[~up] * n + u[~up], own * n + x]))
                node, first = np.unique(x, return_index=True)
                size = np.diff(np.append(first, len(x)))
                task, node_of = asked // n, asked % n
                k = np.searchsorted(node, node_of).clip(0, max(0, len(node) - 1))
                has = node[k] == node_of if len(node) else np.zeros(len(k), bool)
                for to in np.unique(task[has]):
                    i = k[has & (task == to)]
                    s = spans(first[i], size[i])
                    yield _packed(int(to), x[s], y[s], None)

    def count(batches):
        got = {}
        for b in batches:
            for to, x in zip(b.column("bucket").to_pylist(), unpacked(b), strict=True):
                got.setdefault(to, []).append(x)
        for to in sorted(got):
            u, v, _ = merged(got.pop(to), n)
            # the nodes of this task, numbered anew
            nodes, c = np.unique(np.concatenate([u, v]), return_inverse=True)
            u, v = c[: len(u)], c[len(u) :].astype(np.int32)
            first = np.searchsorted(u, np.arange(len(nodes) + 1))
            size, found, mark = np.diff(first), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), bool)
            lo, hi = np.searchsorted(nodes, [cuts[to], cuts[to + 1] if to + 1 < len(cuts) else n])
            for s in range(lo, hi):
                t = v[first[s] : first[s + 1]]
                if len(t) < 2:
                    continue
                mark[t] = True
                done = np.cumsum(size[t])
                for p in np.split(t, np.searchsorted(done, np.arange(CHUNK, done[-1], CHUNK))):
                    p = p[size[p] > 0]
                    if len(p):
                        x = v[spans(first[p], size[p])]
                        hit = mark[x]
                        per = np.add.reduceat(hit, np.cumsum(size[p]) - size[p], dtype=np.int64)
                        found[p] += per
                        found[s] += per.sum()
                        x = x[hit]
                        if len(x):
                            base = x.min()
                            z = np.bincount(x - base)
                            found[base : base + len(z)] += z
                mark[t] = False
            i = np.flatnonzero(found)
            yield pa.record_batch([pa.array(nodes[i], pa.int32()), pa.array(found[i])], ["id", "x"])

    sent = graph.mapInArrow(send, "bucket int, n int, u binary, v binary, w binary").repartitionById(len(cuts), "bucket")
    t = sent.mapInArrow(count, "id int, x bigint").groupBy("id").agg(F.sum("x").alias("x")).toArrow()
    n_of = np.zeros(n, np.int64)
    n_of[order[t.column("id").to_numpy()]] = t.column("x").to_numpy()
    return _clustering(d, named(n_of, "triangles", ids))


def _joined_triangles(edges: DataFrame, k: DataFrame) -> DataFrame:
    e = edges.select("a", "b").distinct()
    o = e.join(k.withColumnsRenamed({"id": "a", "degree": "da"}), "a").join(k.withColumnsRenamed({"id": "b", "degree": "db"}), "b")
    x, y = F.struct("da", "a"), F.struct("db", "b")
    o = o.select(F.when(x < y, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(x < y, F.col("b")).otherwise(F.col("a")).alias("t"))
    t = o.select("s", F.col("t").alias("t1")).join(o.select("s", F.col("t").alias("t2")), "s").where("t1 <> t2").join(o.select(F.col("s").alias("t1"), F.col("t").alias("t2")), ["t1", "t2"])
    return t.select(F.explode(F.array("s", "t1", "t2")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def _clustering(d: DataFrame, n: DataFrame) -> DataFrame:
    j = d.join(n, "id", "left").fillna(0, ["triangles"])
    pairs = F.col("degree") * (F.col("degree") - 1) / 2
    return j.select("id", "degree", "triangles", F.when(pairs > 0, F.col("triangles") / pairs).otherwise(0.0).alias("clustering"))


def network_summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, links, density, components."""
    c = components(forest(edges))
    s = c.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("component").alias("components"))
    return s.crossJoin(edges.agg(F.count(F.lit(1)).alias("links"))).withColumn("density", 2 * F.col("links") / F.nullif(F.col("nodes") * (F.col("nodes") - 1), F.lit(0)))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank) on the undirected graph. Up to TERMS_HELD nodes, tasks keep their nodes' links packed and a round sends the ranks only."""
    ids, n = numbered(edges)
    if 0 < n <= TERMS_HELD:
        graph = packed(edges, ids, n)
        deg = node_sums(graph, n, lambda u, v, w: np.unique(u, return_counts=True), "bigint")
        x = np.full(n, 1.0 / n)
        for _ in range(rounds):
            part = edges.sparkSession.sparkContext.broadcast(x / deg)
            x = (1 - damping) / n + damping * node_sums(graph, n, lambda u, v, w, p=part: _by_node(u, p.value[v]))
            part.unpersist()
        return named(x, "rank", ids)
    b = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    deg = b.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    b = materialize(b.join(deg, "a"), "links")
    n = deg.count()
    r = deg.select(F.col("a").alias("id"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        got = b.join(r.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("rank") / F.col("d")).alias("g"))
        r = materialize(got.select("id", (F.lit((1 - damping) / n) + damping * F.col("g")).alias("rank")), "ranks")
    return r


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 12) -> DataFrame:
    """(id, community) of edges (a, b, w), one direction each: the rounds and levels of `embed.communities` with the links packed and a label for each node on the driver; more than TERMS_HELD nodes go through that."""
    from locusmill.operators import embed

    spark = edges.sparkSession
    edges = edges.where("w > 0")
    ids, n = numbered(edges)
    if not 0 < n <= TERMS_HELD:
        return embed.communities(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), resolution, rounds)

    def both(b: pa.RecordBatch):
        u, v, w = (x.to_numpy() for x in b.columns)
        u, v = u.astype(np.int64), v.astype(np.int64)
        yield np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([w, w]).astype(float)

    cuts = even_cuts(np.ones(n), _parts(edges, n))
    graph = links(coded(edges, ids, "w"), cuts, n, both)
    k = node_sums(graph, n, lambda u, v, w: _by_node(u, w))
    two_m = k.sum()
    # a node moves in the rounds in which its hash is even
    coin = ids.orderBy("id").select(*[(F.pmod(F.xxhash64("name", F.lit(r)), F.lit(2)) == 0).alias(f"r{r}") for r in range(rounds)]).toArrow()
    coin = [coin.column(r).to_numpy() for r in range(rounds)]
    member, alive = np.arange(n), np.ones(n, bool)
    for _ in range(6):
        c = np.arange(n)
        for r in range(rounds):
            held = spark.sparkContext.broadcast((c, k, np.bincount(c, k, minlength=n), coin[r]))

            def moves(batches, held=held):
                c, k, total, now = held.value
                for b in batches:
                    for u, v, w in unpacked(b):
                        x = u != v
                        if not x.any():
                            continue
                        a, to, w = merged([(u[x], c[v[x]], w[x])], n)
                        g = w - resolution * k[a] * (total[to] - np.where(to == c[a], k[a], 0.0)) / two_m
                        own = np.zeros(n)
                        stay = to == c[a]
                        own[a[stay]] = g[stay]
                        o = np.lexsort((to, g, a))
                        last = o[np.append(a[o][1:] != a[o][:-1], True)]
                        last = last[(g[last] > own[a[last]] + 1e-12) & now[a[last]]]
                        yield pa.record_batch([pa.array(a[last], pa.int32()), pa.array(to[last], pa.int32())], ["id", "c"])

            t = graph.mapInArrow(moves, "id int, c int").toArrow()
            c[t.column("id").to_numpy()] = t.column("c").to_numpy()
            held.unpersist()
            if not t.num_rows and r % 2:
                break
        member = c[member]
        left = np.zeros(n, bool)
        left[c[alive]] = True
        if left.sum() == alive.sum():
            break
        held = spark.sparkContext.broadcast(c)

        def joined(b: pa.RecordBatch, held=held):
            for u, v, w in unpacked(b):
                yield held.value[u], held.value[v], w

        graph, alive = links(graph, cuts, n, joined), left
        k = np.bincount(c, k, minlength=n)
    t = named(member.astype(np.int32), "_c", ids)
    return t.join(small(ids.toDF("community", "_n")), F.col("_c") == F.col("_n")).select("id", "community")
