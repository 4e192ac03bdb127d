"""Queries of tracks, peak sets and contacts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.operators import contacts as C
from locusmill.operators import peaks as P
from locusmill.operators import signal as S
from locusmill.operators.intervals import coverage_runs
from locusmill.queries import views as V
from locusmill.queries.matrix_queries import _G, _genes
from locusmill.queries.registry import query
from locusmill.util import materialize

_W = f"with {V.SQL_VIEWS}"
_TRACK = """, ev as (select chrom, pos, sum(x) as x from (select chrom, "start" as pos, 1 as x from f union all select chrom, "end", -1 from f) group by 1, 2),
r0 as (select chrom, pos as "start", lead(pos) over w as "end", sum(x) over w as value from ev window w as (partition by chrom order by pos)),
tr as (select * from r0 where "end" is not null and value <> 0)
"""


def _track(spark, d):
    return materialize(coverage_runs(V.frags(spark, d), ["chrom"]), "track")


def _sizes(spark, d):
    return V.peaks(spark, d).groupBy("chrom").agg(F.max("end").alias("length"))


@query(
    "score_per_bin",
    _W
    + _TRACK
    + """, s as (select chrom, max("end") as length from p group by 1), b as (select chrom, k as "start", least(k + 100000, length) as "end" from (select chrom, length, unnest(range(0, length, 100000)) as k from s)),
m as (select b.chrom, b."start", b."end", sum(value * (least(b."end", tr."end") - greatest(b."start", tr."start"))) / sum(least(b."end", tr."end") - greatest(b."start", tr."start")) as v from b join tr on b.chrom = tr.chrom and b."start" < tr."end" and b."end" > tr."start" group by 1, 2, 3)
select b.chrom, b."start", b."end", round(v, 6) as value from b left join m on b.chrom = m.chrom and b."start" = m."start" and b."end" = m."end\"""",
)
def per_bin(spark, d):
    return S.score_per_bin(_track(spark, d), S.windows(_sizes(spark, d), 100_000)).withColumn("value", F.round("value", 6))


_RUNS = """, {n}ev as (select chrom, pos, sum(x) as x from (select chrom, "start" as pos, 1 as x from {t} union all select chrom, "end", -1 from {t}) group by 1, 2),
{n}r as (select chrom, pos as s, lead(pos) over w as e, sum(x) over w as v from {n}ev window w as (partition by chrom order by pos)),
{n}m as (select b.chrom, b.s, sum(v * (least(b.e, {n}r.e) - greatest(b.s, {n}r.s))) / sum(least(b.e, {n}r.e) - greatest(b.s, {n}r.s)) as v from b join {n}r on b.chrom = {n}r.chrom and b.s < {n}r.e and b.e > {n}r.s where {n}r.e is not null and v <> 0 group by 1, 2)"""


@query(
    "bigwig_correlation",
    _W
    + """, s as (select chrom, max("end") as length from p group by 1), b as (select chrom, k as s, least(k + 1000000, length) as e from (select chrom, length, unnest(range(0, length, 1000000)) as k from s)),
fo as (select * from f where starts_with(cell, (select min(split_part(cell, '#', 1)) from f)))"""
    + _RUNS.format(n="o_", t="fo")
    + _RUNS.format(n="a_", t="f")
    + " select round(corr(coalesce(o_m.v, 0), coalesce(a_m.v, 0)), 6) as correlation from b left join o_m on b.chrom = o_m.chrom and b.s = o_m.s left join a_m on b.chrom = a_m.chrom and b.s = a_m.s",
)
def track_correlation(spark, d):
    f = V.frags(spark, d)
    first = f.agg(F.min(F.split("cell", "#")[0])).first()[0]
    t = {"one": coverage_runs(f.where(F.col("cell").startswith(first)), ["chrom"]), "all": _track(spark, d)}
    return S.correlation(S.score_per_bin_wide(t, S.windows(_sizes(spark, d), 1_000_000)), "one", "all").withColumn("correlation", F.round("correlation", 6))


@query("gene_expression_from_tracks", _W + _TRACK + ', m as (select feature, sum(value * (least(p."end", tr."end") - greatest(p."start", tr."start"))) / sum(least(p."end", tr."end") - greatest(p."start", tr."start")) as v, max(value) as mx from p join tr on p.chrom = tr.chrom and p."start" < tr."end" and p."end" > tr."start" where p."end" - p."start" >= 200 group by 1) select p.feature, round(v, 6) as mean, cast(mx as bigint) as max from p left join m on p.feature = m.feature where p."end" - p."start" >= 200')
def gene_track(spark, d):
    return S.region_stats(_track(spark, d), V.peaks(spark, d), "feature").select("feature", F.round("mean", 6).alias("mean"), "max")


@query(
    "compute_matrix_region",
    _W
    + _TRACK
    + _G
    + """, w as (select gene, chrom, strand, greatest(("start" + "end") // 2 - 1000, 0) as s, ("start" + "end") // 2 + 1000 as e from gg), b as (select gene, chrom, case when strand = '-' then 19 - k else k end as bin, s + k * ((e - s) // 20) as bs, s + (k + 1) * ((e - s) // 20) as be from (select *, unnest(range(0, 20)) as k from w)),
m as (select gene, bin, sum(value * (least(be, "end") - greatest(bs, "start")) / (be - bs)) as v from b join tr on b.chrom = tr.chrom and bs < "end" and be > "start" group by 1, 2)
select b.gene, cast(b.bin as int) as bin, round(coalesce(v, 0), 6) as value from b left join m on b.gene = m.gene and b.bin = m.bin""",
)
def region_matrix(spark, d):
    return S.region_matrix(_track(spark, d), _genes(spark, d), "gene", 20, "center", 1000, 1000).select("gene", "bin", F.round("value", 6).alias("value"))


@query(
    "compute_matrix_cis",
    _W
    + _TRACK
    + _G
    + """, a as (select gene, chrom, strand, case when strand = '-' then "end" + 500 else "start" - 500 end as spot from gg), w as (select gene, chrom, strand, greatest(spot - 1000, 0) as s, spot + 1000 as e from a),
b as (select gene, chrom, case when strand = '-' then 19 - k else k end as bin, s + k * ((e - s) // 20) as bs, s + (k + 1) * ((e - s) // 20) as be from (select *, unnest(range(0, 20)) as k from w where (e - s) // 20 > 0)),
m as (select gene, bin, sum(value * (least(be, "end") - greatest(bs, "start")) / (be - bs)) as v from b join tr on b.chrom = tr.chrom and bs < "end" and be > "start" group by 1, 2)
select b.gene, cast(b.bin as int) as bin, round(coalesce(v, 0), 6) as value from b left join m on b.gene = m.gene and b.bin = m.bin""",
)
def cis_matrix(spark, d):
    return S.shifted_matrix(_track(spark, d), _genes(spark, d), "gene", 20, "5p", 500, 1000, 1000).select("gene", "bin", F.round("value", 6).alias("value"))


_BASES = _TRACK + """, pv as (select feature, unnest(range(greatest(p."start", tr."start"), least(p."end", tr."end"))) as spot, value from p join tr on p.chrom = tr.chrom and p."start" < tr."end" and p."end" > tr."start"),
ba as (select p.feature, p."start" as s, p."end" as e, k as spot, cast(coalesce(pv.value, 0) as double) as value from (select *, unnest(range("start", "end")) as k from p) p left join pv on pv.feature = p.feature and pv.spot = k)
"""


@query("region_signal", _W + _BASES + " select feature, cast(e - 1 - spot as int) as pos, value from ba")
def signal(spark, d):
    """Per-base values of every peak, read from the minus strand."""
    a = S.region_arrays(_track(spark, d), V.peaks(spark, d).withColumn("strand", F.lit("-")), "feature")
    return a.select("feature", F.posexplode("signal").alias("pos", "value"))


@query("score_bigwig_footprints")
def footprints(spark, d):
    a = S.region_arrays(_track(spark, d), V.peaks(spark, d).withColumn("strand", F.lit("+")), "feature")
    return S.score_regions(a, "feature", ("flank_depth", "fos"))


@query("signal_filter_outliers", _W + _BASES + ", mx as (select feature, max(value) as m from ba group by 1) select feature, cast(spot - s as int) as pos, value from ba where feature in (select feature from mx where m <= (select quantile_cont(m, 0.95) from mx))")
def outliers(spark, d):
    """Per-base values of the peaks whose greatest value is at most the 0.95 quantile of these."""
    a = S.filter_outliers(S.region_arrays(_track(spark, d), V.peaks(spark, d).withColumn("strand", F.lit("+")), "feature"), 0.95)
    return a.select("feature", F.posexplode("signal").alias("pos", "value"))


@query("rolling_sum", "select o_custkey, o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and 1 following), 2) as rolled from orders")
def rolling(spark, d):
    from locusmill.util import table

    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return S.rolling_table(o, ["o_custkey"], "o_orderkey", "o_totalprice", 2, 1).select("o_custkey", "o_orderkey", F.round("rolled", 2).alias("rolled"))


def _summits(spark, d):
    r = _track(spark, d)
    return r.select("chrom", "start", "end", F.col("start").alias("summit"), F.col("value").cast("double").alias("score")).where("value >= 2")


@query("merge_peaks")
def merge_peaks(spark, d):
    return P.merge_peaks(_summits(spark, d), _sizes(spark, d).withColumn("length", F.col("length") + 1_000_000))


@query("reproducible_peaks")
def reproducible(spark, d):
    s = V.frags(spark, d).select(F.pmod(F.xxhash64("cell"), F.lit(4)).alias("replicate"), "chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("summit"), F.col("count").cast("double").alias("score"))
    return P.reproducible_peaks(s, 3)


@query("dedup_peaks")
def thin(spark, d):
    return P.thin_peaks(V.frags(spark, d).select("chrom", "start", "end"), 500)


@query("call_peaks")
def call(spark, d):
    total = _sizes(spark, d).agg(F.sum("length")).first()[0]
    return P.call_peaks(_track(spark, d), total)


def _pairs(spark, d):
    f = V.frags(spark, d)
    w = W.partitionBy("cell", "chrom").orderBy("start", "end", "count")
    p = f.select("cell", "chrom", F.col("start").alias("pos1"), F.lead("start").over(w).alias("pos2")).where("pos2 is not null")
    return p.select(F.concat(F.lit("r_"), "cell").alias("read_id"), "cell", F.col("chrom").alias("chrom1"), "pos1", F.col("chrom").alias("chrom2"), "pos2")


_PAIRS = ', pr as (select cell, chrom, "start" as pos1, lead("start") over (partition by cell, chrom order by "start", "end", "count") as pos2 from f), px as (select chrom, pos1 // {w} as bin1, pos2 // {w} as bin2, count(*) as "count" from pr where pos2 is not null group by 1, 2, 3)'


@query("pairs_to_cool", _W + _PAIRS.format(w=1_000_000) + ' select chrom as chrom1, chrom as chrom2, bin1, bin2, "count" from px')
def pixels(spark, d):
    return C.pixels(_pairs(spark, d), 1_000_000)


def _cis(spark, d, w=1_000_000):
    return materialize(C.cis(C.pixels(_pairs(spark, d), w)), "cis")


def _n(spark, d, w=1_000_000):
    return V.frags(spark, d).groupBy("chrom").agg((F.floor(F.max("start") / w) + 1).alias("n"))


@query("demux_pairs_by_barcode", _W + _PAIRS.format(w=1) + """, gg as (select split_part(cell, '#', 2) as barcode, min("group") as g from gr group by 1) select cell, chrom as chrom1, pos1, pos2, coalesce(gg.g, '_unassigned') as "group" from pr left join gg on split_part(pr.cell, '#', 2) = gg.barcode where pos2 is not null""")
def demux(spark, d):
    g = V.groups(spark, d).groupBy(F.split("cell", "#")[1].alias("barcode")).agg(F.min("group").alias("group"))
    p = _pairs(spark, d).withColumn("read_id", F.concat(F.lit("r1_"), F.split("cell", "#")[1]))
    return C.demux(p, g, True).select("cell", "chrom1", "pos1", "pos2", "group")


_DECAY = _W + _PAIRS.format(w=1_000_000) + ', nb as (select chrom, max("start") // 1000000 + 1 as n from f group by 1), dc as (select px.chrom, bin2 - bin1 as "offset", sum("count") / (any_value(n) - (bin2 - bin1)) as mean from px join nb on px.chrom = nb.chrom where bin2 - bin1 < n group by 1, 2) '


@query("plot_decay_curve", _DECAY + 'select chrom, "offset", round(mean, 6) as mean from dc')
def decay(spark, d):
    return C.decay(_cis(spark, d), _n(spark, d)).withColumn("mean", F.round("mean", 6))


@query("plot_coverage", _W + _PAIRS.format(w=1_000_000) + ' select chrom, bin, cast(sum("count") as bigint) as coverage from (select chrom, bin1 as bin, "count" from px union all select chrom, bin2, "count" from px where bin1 <> bin2) group by 1, 2')
def coverage(spark, d):
    return C.bin_coverage(_cis(spark, d))


@query("observed_over_expected", _DECAY + 'select px.chrom, bin1, bin2, round("count" / mean, 6) as oe from px join dc on px.chrom = dc.chrom and bin2 - bin1 = dc."offset"')
def oe(spark, d):
    return C.observed_over_expected(_cis(spark, d), _n(spark, d)).select("chrom", "bin1", "bin2", F.round("oe", 6).alias("oe"))


@query("balance_cool")
def balance(spark, d):
    return C.balance(_cis(spark, d), 1, 4)


_INSULATION = _W + _PAIRS.format(w=1_000_000) + ', s as (select chrom, unnest(range(greatest(bin1 + 1, bin2 - 5), least(bin2 - 1, bin1 + 5) + 1)) as bin, "count" from px where bin2 - bin1 between 2 and 10), t as (select chrom, bin, sum("count") / 25 as diamond from s group by 1, 2)'


@query("insulation", _INSULATION + ' select chrom, bin, round(diamond, 6) as diamond, round(log2(diamond / avg(diamond) over (partition by chrom)), 6) + 0.0 as log2_score from t')
def insulation(spark, d):
    return C.insulation(_cis(spark, d), 5).select("chrom", "bin", F.round("diamond", 6).alias("diamond"), (F.round("log2_score", 6) + F.lit(0.0)).alias("log2_score"))


@query(
    "tad_boundaries",
    _INSULATION
    + """, u as (select chrom, bin, log2(diamond / avg(diamond) over (partition by chrom)) as v from t), v as (select *, v < lag(v) over w and v <= lead(v) over w as low,
  least(max(v) over (partition by chrom order by bin rows between 5 preceding and current row), max(v) over (partition by chrom order by bin rows between current row and 5 following)) - v as strength from u window w as (partition by chrom order by bin))
select chrom, bin, round(strength, 6) as strength from v where low and strength >= 0.2""",
)
def tads(spark, d):
    return C.tad_boundaries(C.insulation(_cis(spark, d), 5)).withColumn("strength", F.round("strength", 6))


def _oe(spark, d):
    return materialize(C.observed_over_expected(_cis(spark, d), _n(spark, d)), "oe")


_OE = _DECAY.rstrip() + """, oe as (select px.chrom, bin1, bin2, "count", "count" / mean as oe from px join dc on px.chrom = dc.chrom and bin2 - bin1 = dc."offset"),
sy as (select chrom, bin1, bin2, oe from oe union all select chrom, bin2, bin1, oe from oe where bin1 <> bin2)
"""


@query(
    "pileup",
    _OE
    + """, ft as (select chrom, bin1 as f1, bin2 as f2 from oe where "count" >= 2 and bin2 - bin1 > 3), gd as (select ft.*, di, dj from ft, range(-3, 4) a(di), range(-3, 4) b(dj))
select cast(di as int) as di, cast(dj as int) as dj, round(sum(coalesce(oe, 0)) / (select count(*) from ft), 6) as value from gd left join sy on gd.chrom = sy.chrom and f1 + di = bin1 and f2 + dj = bin2 group by 1, 2""",
)
def pileup(spark, d):
    o = _oe(spark, d)
    return C.pile_up(o, o.where("count >= 2 and bin2 - bin1 > 3"), 3).withColumn("value", F.round("value", 6))


@query(
    "saddle",
    _OE
    + """, cv as (select chrom, bin, sum("count") as v from (select chrom, bin1 as bin, "count" from px union all select chrom, bin2, "count" from px where bin1 <> bin2) group by 1, 2), eg as (select unnest(quantile_cont(v, [0.2, 0.4, 0.6, 0.8])) as e from cv),
tk as (select chrom, bin, 1 + (select count(*) from eg where v >= e) as q from cv)
select cast(a.q as int) as q1, cast(b.q as int) as q2, round(avg(oe), 6) as value from sy join tk a on sy.chrom = a.chrom and bin1 = a.bin join tk b on sy.chrom = b.chrom and bin2 = b.bin group by 1, 2""",
)
def saddle(spark, d):
    c = _cis(spark, d)
    return C.saddle(_oe(spark, d), C.bin_coverage(c).select("chrom", "bin", F.col("coverage").cast("double").alias("value")), 5).withColumn("value", F.round("value", 6))


@query("compartments")
def compartments(spark, d):
    return C.compartments(_oe(spark, d))


@query("loops")
def loops(spark, d):
    return C.loops(_cis(spark, d), _n(spark, d), least=5)


def _cell_cis(spark, d, w):
    return materialize(C.cis(C.pixels(_pairs(spark, d), w, ["cell"])), "cellcis")


@query("impute_cells")
def impute(spark, d):
    return C.impute(_cell_cis(spark, d, 5_000_000), _n(spark, d, 5_000_000))


@query("hic_embedding")
def embedding(spark, d):
    from locusmill.operators.embed import gram_svd

    x = C.contact_features(_cell_cis(spark, d, 20_000_000))
    return gram_svd(x, 10)[0]


@query("cluster_correlation", _W + ', pr as (select cell, chrom, "start" as pos1, lead("start") over (partition by cell, chrom order by "start", "end", "count") as pos2 from f), px as (select "group", chrom, pos1 // 5000000 as bin1, pos2 // 5000000 as bin2, ln(1 + count(*)) as v from pr join gr on pr.cell = gr.cell where pos2 is not null group by 1, 2, 3, 4) select a."group" as a, b."group" as b, round(corr(a.v, b.v), 6) as correlation from px a join px b on a.chrom = b.chrom and a.bin1 = b.bin1 and a.bin2 = b.bin2 group by 1, 2')
def correlation(spark, d):
    c = C.cis(C.pixels(_pairs(spark, d).join(V.groups(spark, d), "cell"), 5_000_000, ["group"]))
    return C.group_correlation(materialize(c, "groups")).withColumn("correlation", F.round("correlation", 6))


@query(
    "plot_aggregate",
    _W
    + _TRACK
    + """, st as (select feature, chrom, ("start" + "end") // 2 - 100 as s from p), sb as (select feature, chrom, s, s + k as spot, k from (select *, unnest(range(0, 200)) as k from st)),
sv as (select sb.feature, k - 100 as "offset", coalesce(value, 0) as v from sb left join tr on sb.chrom = tr.chrom and spot >= tr."start" and spot < tr."end"), mx as (select feature, max(v) as m from sv group by 1)
select cast("offset" as int) as "offset", round(avg(v), 6) as value, count(*) as n from sv where feature in (select feature from mx where m <= (select quantile_cont(m, 0.99) from mx)) group by 1""",
)
def aggregate(spark, d):
    p = V.peaks(spark, d).withColumn("strand", F.lit("+"))
    return S.aggregate_profile(_track(spark, d), p, "feature", 100).withColumn("value", F.round("value", 6))


@query("pseudobulk_by_celltype")
def group_maps(spark, d):
    from locusmill.plans import group_contact_maps

    p = _pairs(spark, d).withColumn("read_id", F.concat(F.lit("r_"), F.split("cell", "#")[1]))
    g = V.groups(spark, d).groupBy(F.split("cell", "#")[1].alias("barcode")).agg(F.min(F.when(F.col("group") < "k", "early").otherwise("late")).alias("group"))
    out = None
    for n, m in group_contact_maps(p, g, 10_000_000).items():
        m = m.withColumn("group", F.lit(n))
        out = m if out is None else out.unionByName(m)
    return out


@query("map_regions", "with s as (select chrom, max(\"end\") as n from peaks group by 1) select chrom, k as \"start\", least(k + 5000000, n) - k as width from (select chrom, n, unnest(range(0, n, 5000000)) as k from s)")
def map_regions(spark, d):
    from locusmill.plans import map_regions as run

    return run(_sizes(spark, d), lambda c, s, e: {"chrom": [c], "start": [s], "width": [e - s]}, "chrom string, start bigint, width bigint", 5_000_000)


@query("multi_scale_footprint_region")
def region_pvalues(spark, d):
    from locusmill.operators.footprints import region_pvalues as op
    from locusmill.operators.intervals import point_join
    from locusmill.operators.qc import cuts

    p = V.peaks(spark, d)
    n = point_join(cuts(V.frags(spark, d)).select("chrom", "pos"), p).groupBy(F.col("r_feature").alias("region"), "pos").agg(F.count(F.lit(1)).cast("double").alias("n"))
    place = p.select(F.col("feature").alias("region"), F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return op(place.join(n, ["region", "pos"], "left").fillna(0.0, ["n"]).withColumn("bias", F.lit(1.0)), [5, 10])
