"""Queries of feature links, deviations, neighbours, embeddings and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.operators import embed as E
from locusmill.operators import linkage as L
from locusmill.operators import matrices as M
from locusmill.queries import views as V
from locusmill.queries.matrix_queries import _G, _NM, _PEAKS, _X, _genes, _x
from locusmill.queries.registry import query
from locusmill.util import materialize, table


def _by_group(spark, d):
    """Pseudobulk of cell groups as (feature, sample, value); the groups serve as metacells."""
    return M.pseudobulk(_x(spark, d), V.groups(spark, d)).select("feature", F.col("group").alias("sample"), "value")


_BULK = (
    _X
    + """, pb0 as (select "group" as sample, feature, sum(value) as v from x join gr on x.cell = gr.cell group by 1, 2), pb as (select sample, feature, v / sum(v) over (partition by sample) * 1000000 as v from pb0),
sm as (select distinct sample from pb), pc as (select feature, chrom, ("start" + "end") // 2 as centre from p)
"""
)
_N = "(select count(*) from sm)"


def _corr(pairs: str, a: str, b: str) -> str:
    return f"""pr as ({pairs}), full_ as (select pr.*, sm.sample, coalesce(xa.v, 0) as va, coalesce(xb.v, 0) as vb from pr cross join sm
  left join pb xa on xa.feature = pr.{a} and xa.sample = sm.sample left join pb xb on xb.feature = pr.{b} and xb.sample = sm.sample),
cr as (select {a}, {b}, any_value(distance) as distance, case when var_pop(va) > 1e-9 and var_pop(vb) > 1e-9 then corr(va, vb) end as r from full_ group by 1, 2)"""


@query("coaccessibility", _BULK + ", " + _corr("select l.feature as peak_a, r.feature as peak_b, r.centre - l.centre as distance from pc l join pc r on l.chrom = r.chrom and (r.centre > l.centre or r.centre = l.centre and r.feature > l.feature) and r.centre - l.centre <= 2000000", "peak_a", "peak_b") + " select peak_a, peak_b, distance, round(r, 6) as correlation from cr where r is not null")
def coaccessibility(spark, d):
    x = materialize(_by_group(spark, d), "bulk")
    c = L.coaccessibility(x, V.peaks(spark, d), x.select("sample").distinct().count(), 2_000_000, 0.0, 1.0)
    return c.select("peak_a", "peak_b", "distance", F.round("correlation", 6).alias("correlation"))


@query(
    "peak_to_gene",
    _BULK
    + _G
    + ", gt as (select gene, chrom, case when strand = '-' then \"end\" else \"start\" end as tss from gg), "
    + _corr("select pc.feature as peak, gene, centre - tss as distance from pc join gt on pc.chrom = gt.chrom and abs(centre - tss) <= 1500000", "peak", "gene")
    + " select peak, gene, distance, round(r, 6) as correlation, round(r * sqrt((" + _N + " - 2) / greatest(1 - r * r, 1e-300)), 4) as t from cr where r is not null and 1 - r * r > 1e-9",
)
def peak_to_gene(spark, d):
    """Peaks linked with genes whose own signal is that of the peak a gene was made of."""
    x = materialize(_by_group(spark, d), "bulk")
    g = _genes(spark, d).withColumn("tss", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")))
    c = L.peak_to_gene(x, x, V.peaks(spark, d), g, x.select("sample").distinct().count(), 1_500_000, 0.0, 1.0)
    c = c.where(1 - F.col("correlation") ** 2 > 1e-9)
    return c.select("peak", "gene", "distance", F.round("correlation", 6).alias("correlation"), F.round("t", 4).alias("t"))


@query("aggregate_metacells", _X + ' select "group" as metacell, feature, round(sum(value) / 100, 6) as value from x join gr on x.cell = gr.cell group by 1, 2')
def aggregate(spark, d):
    return M.aggregate_members(_x(spark, d), V.groups(spark, d).withColumnRenamed("group", "metacell"), 100).withColumn("value", F.round("value", 6))


_MOTIFS = ", pk as (select label as feature, peak_id from peaks), mt as (select 'm' || (peak_id % 40) as motif, feature from pk), pe as (select a.feature, i as iteration, b.feature as peer from pk a, range(0, 10) t(i), pk b where b.peak_id = (a.peak_id * 31 + i * 97) % 1200 + 1)"


def _motifs(spark, d):
    p = table(spark, d, "peaks").select(F.col("label").alias("feature"), "peak_id")
    peers = p.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("_p", (F.col("peak_id") * 31 + F.col("iteration") * 97) % 1200 + 1)
    peers = peers.join(p.select(F.col("peak_id").alias("_p"), F.col("feature").alias("peer")), "_p").select("feature", "iteration", "peer")
    return p.select(F.concat(F.lit("m"), F.col("peak_id") % 40).alias("motif"), "feature"), peers


@query(
    "compute_deviations",
    _X
    + _MOTIFS
    + """, tot as (select sum(value) as t from x), sh as (select feature, sum(value) / (select t from tot) as share from x group by 1), dp as (select cell, sum(value) as depth from x group by 1),
pm as (select motif, sum(share) as share from mt join sh on mt.feature = sh.feature group by 1), ob as (select motif, cell, sum(value) as obs from mt join x on mt.feature = x.feature group by 1, 2),
pp as (select pe.feature, cell, sum(value) as s, sum(value * value) as ss from pe join x on x.feature = pe.peer group by 1, 2),
bg as (select motif, cell, sum(s / 10) as mu, sum((ss - s * s / 10) / 9) as var from mt join pp on mt.feature = pp.feature group by 1, 2),
j as (select dp.cell, pm.motif, coalesce(obs, 0) as obs, coalesce(mu, 0) as mu, coalesce(var, 0) as var, share * depth as e from pm cross join dp left join ob on ob.motif = pm.motif and ob.cell = dp.cell left join bg on bg.motif = pm.motif and bg.cell = dp.cell)
select cell, motif, round(case when e > 0 then (obs - e) / e end, 5) + 0.0 as dev, round(case when e > 0 and var > 0 then (obs - mu) / sqrt(var) end, 5) + 0.0 as z from j""",
)
def deviations(spark, d):
    m, peers = _motifs(spark, d)
    return L.deviations(_x(spark, d), m, peers).select("cell", "motif", (F.round("dev", 5) + F.lit(0.0)).alias("dev"), (F.round("z", 5) + F.lit(0.0)).alias("z"))


@query("sample_deviations", _X + _MOTIFS + ", v as (select motif, cell, iteration, sum(value) as v from mt join pe on mt.feature = pe.feature join x on x.feature = pe.peer group by 1, 2, 3), a as (select motif, cell, sum(v) as s, sum(v * v) as ss from v group by 1, 2) select motif, cell, round(s / 10, 5) as mean, round(sqrt(greatest(0, (ss - s * s / 10) / 9)), 5) as sd from a")
def sampled(spark, d):
    m, peers = _motifs(spark, d)
    return L.sampled_deviations(_x(spark, d), m, peers).select("motif", "cell", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


@query(
    "add_background_peaks",
    _X
    + """, sq as (select feature, translate(md5(feature) || md5(feature || 'x'), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from p), st as (select x.feature, cast(sum(value) as bigint) as total, any_value(length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq)) as gc from x join sq on x.feature = sq.feature group by 1),
lm as (select min(gc) as a, max(gc) as b, min(ln(1 + total)) as c, max(ln(1 + total)) as d from st), gd as (select feature, least(24, floor((gc - a) / (b - a) * 25)) as gx, least(24, floor((ln(1 + total) - c) / (d - c) * 25)) as gy from st, lm),
nr as (select *, row_number() over (partition by gx, gy order by feature) - 1 as no, count(*) over (partition by gx, gy) as size from gd), dr as (select feature, i as iteration, gx, gy, ('0x' || substr(md5('0:' || feature || ':' || i), 1, 15))::bigint % size as pick from nr, range(0, 10) t(i))
select dr.feature, cast(iteration as int) as iteration, nr.feature as peer from dr join nr on dr.gx = nr.gx and dr.gy = nr.gy and dr.pick = nr.no""",
)
def background(spark, d):
    """Ten peers of similar GC share and total for every peak with counts."""
    from locusmill.operators.motifs import gc_share
    from locusmill.queries.sequence_queries import _seqs

    gc = _seqs(spark, d).select("feature", gc_share("seq").alias("gc"))
    return L.background_peaks(_x(spark, d).groupBy("feature").agg(F.sum("value").alias("total")).join(gc, "feature"), 10)


def _depths(spark, d):
    from locusmill.operators.qc import import_fragments

    c = import_fragments(V.frags(spark, d), min_fragments=1).select("cell", F.log("n_fragment").alias("depth"))
    return materialize(c.join(V.groups(spark, d), "cell"), "depths")


@query("find_marker_features")
def markers(spark, d):
    """Markers of every group over all its cells, against others matched by depth."""
    c = _depths(spark, d)
    return L.marker_features(_x(spark, d), c.select("cell", "group"), c.select("cell", "depth"), max_cells=None)


_DEPTHS = _NM + """, dp as (select fm.cell, any_value("group") as "group", ln(count(*)) as depth from fm join gr on fm.cell = gr.cell group by 1)"""
_MATCHED = _DEPTHS + """, one as (select min("group") as g from dp), zs as (select cell, "group", (depth - avg(depth) over ()) / stddev_samp(depth) over () as z from dp),
nb as (select a.cell, b.cell as bg, row_number() over (partition by a.cell order by (a.z - b.z) ** 2, b.cell) as r from zs a, zs b, one where a."group" = g and b."group" <> g), nn as (select cell, bg from nb where r = 1)
"""


@query("match_background", _MATCHED + "select cell, bg, 1 as rank from nn")
def match(spark, d):
    """The nearest cell by depth of other groups for every cell of the first group."""
    c = _depths(spark, d)
    one = c.agg(F.min("group")).first()[0]
    return L.match_background(c.where(F.col("group") == one), c.where(F.col("group") != one), ["depth"])


@query("match_background_unique", _MATCHED + "select min(cell) as cell, bg, 1 as rank from nn group by bg")
def match_unique(spark, d):
    """The same, each cell taken once."""
    return L.match_unique(match(spark, d))


@query(
    "find_marker_ranks",
    _DEPTHS
    + _PEAKS
    + """, ms as (select avg(depth) as m, stddev_samp(depth) as s from dp), zs as (select cell, "group", (depth - m) / s as z from dp, ms),
nb as (select a."group" as g, a.cell, b.cell as bg, row_number() over (partition by a.cell order by (a.z - b.z) ** 2, b.cell) as r from zs a join zs b on a."group" <> b."group"), tk as (select distinct g, bg as cell from nb where r = 1),
sd as (select "group" as g, cell, 'fg' as side from dp union all select g, cell, 'bg' from tk), ns as (select g, count(*) filter (side = 'fg') as n1, count(*) filter (side = 'bg') as n2 from sd group by 1),
v1 as (select g, feature, value as v, count(*) filter (side = 'fg') as f, count(*) as c from x join sd on x.cell = sd.cell group by 1, 2, 3), v0 as (select v1.g, feature, 0 as v, any_value(n1) - sum(f) as f, any_value(n1 + n2) - sum(c) as c from v1 join ns on v1.g = ns.g group by 1, 2),
vv as (select * from v1 union all select * from v0), rk as (select *, coalesce(sum(c) over (partition by g, feature order by v rows between unbounded preceding and 1 preceding), 0) + (c + 1) / 2.0 as r from vv),
ag as (select rk.g, feature, any_value(n1) as n1, any_value(n2) as n2, sum(r * f) as r1, sum(c ** 3 - c) as ties, sum(v * f) as s1, sum(v * (c - f)) as s2, coalesce(sum(f) filter (v <> 0), 0) as p1, coalesce(sum(c - f) filter (v <> 0), 0) as p2 from rk join ns on rk.g = ns.g group by 1, 2),
ob as (select *, r1 - n1 * (n1 + 1) / 2.0 as u, n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / greatest((n1 + n2) * (n1 + n2 - 1.0), 1)) as var from ag)
select g as "group", feature, round(u, 4) as u, round(case when var > 0 then (u - n1 * n2 / 2.0) / sqrt(var) else 0 end, 5) + 0.0 as z, round(s1 / n1, 6) as mean_fg, round(s2 / n2, 6) as mean_bg, round(p1 / n1, 6) as pct_fg, round(p2 / n2, 6) as pct_bg, round(log2((s1 / n1 + 1e-6) / (s2 / n2 + 1e-6)), 5) + 0.0 as log2_fc from ob""",
)
def marker_ranks(spark, d):
    """The rank sums behind find_marker_features, without the probabilities, which SQL here lacks."""
    rd = {"u": 4, "mean_fg": 6, "mean_bg": 6, "pct_fg": 6, "pct_bg": 6}
    return markers(spark, d).select("group", "feature", *[F.round(c, k).alias(c) for c, k in rd.items()], *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("z", "log2_fc")])


@query("rank_sites_by_cut_density", _X + """, tg as (select cell from gr where "group" = (select min("group") from gr)), c as (select chrom, unnest(["start", "end" - 1]) as pos from f where cell in (select cell from tg)),
n as (select feature, count(*) as cuts from c join p on c.chrom = p.chrom and pos >= (p."start" + p."end") // 2 - 200 and pos < (p."start" + p."end") // 2 + 200 group by 1) select p.feature, coalesce(cuts, 0) as cuts from p left join n on p.feature = n.feature""")
def rank_sites(spark, d):
    g = V.groups(spark, d)
    return L.rank_sites(V.frags(spark, d), V.peaks(spark, d), g, g.agg(F.min("group")).first()[0])


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


_NEAR = """with q as (select vec_id as id, cast(embedding as double[]) as v from embeddings where vec_id % 20 = 0), r as (select vec_id as neighbour, cast(embedding as double[]) as v from embeddings),
ds as (select q.id, neighbour, {dist} as d from q join r on q.id <> neighbour), nn as (select *, row_number() over (partition by id order by d, neighbour) as rank from ds qualify rank <= 10)
"""


@query("neighbors_exact", _NEAR.format(dist="list_distance(q.v, r.v)") + "select id, neighbour, cast(rank as int) as rank, round(d, 6) as distance from nn")
def near(spark, d):
    """Ten nearest vectors of every vector whose id is divisible by 20, among all."""
    v = _vectors(spark, d)
    return E.exact_knn(v.where("id % 20 = 0"), v, 10, drop_self=True).withColumn("distance", F.round("distance", 6))


def _cosine(spark, d):
    v = _vectors(spark, d)
    return materialize(E.exact_knn(v.where("id % 20 = 0"), v, 10, "cosine", True), "near")


@query(
    "transfer_labels",
    _NEAR.format(dist="list_cosine_distance(q.v, r.v)")
    + ", m as (select id, avg(d) as m from nn group by 1), v as (select nn.id, label, sum(exp(-d / m)) as v from nn join m on nn.id = m.id join embeddings e on e.vec_id = nn.neighbour group by 1, 2) select id, arg_min(label, struct_pack(a := -v, b := label)) as label, round(max(v) / sum(v), 6) as score from v group by 1",
)
def transfer(spark, d):
    lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return E.transfer_labels(_cosine(spark, d), lab).withColumn("score", F.round("score", 6))


@query("connectivities_gauss", _NEAR.format(dist="list_cosine_distance(q.v, r.v)") + ", s as (select id, max(d) as s from nn group by 1), e as (select nn.id as a, neighbour as b, exp(-d * d / (2 * s * s)) as w from nn join s on nn.id = s.id), u as (select * from e union all select b, a, w from e) select a, b, round(sum(w) / 2, 8) as w from u group by 1, 2")
def gauss(spark, d):
    return E.gauss_connectivities(_cosine(spark, d)).withColumn("w", F.round("w", 8))


@query("connectivities_umap")
def fuzzy(spark, d):
    return E.fuzzy_connectivities(_cosine(spark, d))


def _graph(spark, d):
    return materialize(E.gauss_connectivities(E.all_knn(_vectors(spark, d), 10)), "graph")


@query(
    "neighbors_all",
    "with r as (select vec_id as id, cast(embedding as double[]) as v from embeddings), ds as (select a.id, b.id as neighbour, list_distance(a.v, b.v) as d from r a join r b on a.id <> b.id), "
    "nn as (select *, row_number() over (partition by id order by d, neighbour) as rank from ds qualify rank <= 10) select id, neighbour, cast(rank as int) as rank, round(d, 6) as distance from nn",
)
def near_all(spark, d):
    """Ten nearest vectors of every vector, by cells; exact as long as the cells searched hold all vectors, as they do up to 16000."""
    return E.all_knn(_vectors(spark, d), 10).select("id", "neighbour", "rank", F.round("distance", 6).alias("distance"))


@query("leiden")
def leiden(spark, d):
    return E.communities(_graph(spark, d))


@query("leiden_restricted")
def restricted(spark, d):
    lab = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"))
    sub = E.communities(E.restrict_graph(_graph(spark, d), lab.where("label in ('0', '1')")), 1.5).withColumn("sub", F.col("community").cast("string"))
    return E.rename_groups(lab.join(sub, "id"), "label", "sub").select("id", "group")


@query("clusters_kmeans")
def km(spark, d):
    return E.kmeans(_vectors(spark, d).withColumnRenamed("id", "cell"), 8)


@query("clusters_bisecting")
def bkm(spark, d):
    return E.kmeans(_vectors(spark, d).withColumnRenamed("id", "cell"), 8, bisecting=True)


@query("lsi")
def lsi(spark, d):
    return E.lsi(_x(spark, d), 10)


@query("lsi_column_scaled")
def lsi_column(spark, d):
    return E.lsi(_x(spark, d), 10, flavour="column")


@query("iterative_lsi")
def iterative(spark, d):
    return E.iterative_lsi(_x(spark, d), 10, features=800)


@query("scrublet")
def scrublet(spark, d):
    return E.doublet_probability(materialize(E.doublet_scores(_x(spark, d)), "scores"))


@query("integrate")
def integrate(spark, d):
    x = _x(spark, d)
    first = x.agg(F.min(F.split("cell", "#")[0])).first()[0]
    return E.integrate(x.where(F.split("cell", "#")[0] == first), x.where(F.split("cell", "#")[0] != first), 8)


@query("joint_embedding", "select vec_id as id, label, cast(null as double) as value, 'query' as modality from embeddings union all select event_id, null, value, 'reference' from events")
def joint(spark, d):
    a = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return E.joint(a, table(spark, d, "events").select(F.col("event_id").alias("id"), "value"))


@query("weighted_buckets", "select label, round(sum(embedding[1] * (vec_id % 7 + 1)) / sum(vec_id % 7 + 1), 5) as c0, cast(sum(vec_id % 7 + 1) as bigint) as w from embeddings group by 1")
def buckets(spark, d):
    v = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("vec"), (F.col("vec_id") % 7 + 1).alias("w"))
    return E.weighted_buckets(v, "label").select("label", F.round(F.col("vec")[0], 5).alias("c0"), "w")


@query("row_labels", "select l_orderkey, l_returnflag, l_linestatus, dense_rank() over (order by l_returnflag, l_linestatus) as label from lineitem")
def labels(spark, d):
    return E.row_labels(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])
