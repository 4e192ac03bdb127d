"""Queries of quality measures, matrices and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.operators import matrices as M
from locusmill.operators import qc as Q
from locusmill.operators import stats as S
from locusmill.queries import views as V
from locusmill.queries.registry import query
from locusmill.util import materialize, table

_W = f"with {V.SQL_VIEWS}"
_MITO = "chrom in ('chrM', 'M', 'chrMT', 'MT')"
_IMPORT = (
    _W
    + f""", q as (select cell, count(*) filter (not {_MITO}) as n_fragment, cast(coalesce(sum("count") filter (not {_MITO}), 0) as bigint) as reads, count(*) filter ({_MITO}) as n_mito from f group by 1)
"""
)


@query("import_fragments", _IMPORT + "select *, round(case when reads > 0 then 1 - n_fragment / reads else 0 end, 9) as frac_dup, round(n_mito / greatest(n_fragment + n_mito, 1), 9) as frac_mito from q where n_fragment >= 20")
def import_fragments(spark, d):
    c = Q.import_fragments(V.frags(spark, d), min_fragments=20)
    return c.withColumn("frac_dup", F.round("frac_dup", 9)).withColumn("frac_mito", F.round("frac_mito", 9))


@query("frag_size_distr", _W + ', h as (select case when "end" - "start" > 1000 then 0 else "end" - "start" end as size, count(*) as n from f group by 1) select i as size, coalesce(n, 0) as n from range(0, 1001) t(i) left join h on h.size = i')
def sizes(spark, d):
    return Q.fragment_sizes(V.frags(spark, d))


_NUC = _W + ', q as (select cell, count(*) filter ("end" - "start" < 147) as nf, count(*) filter ("end" - "start" between 147 and 293) as mono from f group by 1), nuc as (select cell, case when nf = 0 then (mono + 1) / 1.0 else mono / nf end as ns from q) '


@query("nucleosome_signal", _NUC + "select cell, round(ns, 9) as nucleosome_signal from nuc")
def nucleosome(spark, d):
    return Q.nucleosome_signal(V.frags(spark, d)).withColumn("nucleosome_signal", F.round("nucleosome_signal", 9))


# peak middles stand in for TSS, as the annotation's genes have few fragments
_TSS = """, t as (select distinct chrom, ("start" + "end") // 2 - 2000 as s, ("start" + "end") // 2 + 2001 as e from p),
pr as (select cell, pos - s as "offset", count(*) as n from (select cell, s, unnest([f."start", f."end" - 1]) as pos from f join t on f.chrom = t.chrom and f."start" < e and f."end" > s) where pos - s between 0 and 4000 group by 1, 2)
"""


def _profile(spark, d):
    t = V.peaks(spark, d).select("chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("tss"))
    return Q.tss_profile(V.frags(spark, d), t)


@query("tss_profile", _W + _TSS + 'select cell, "offset", n from pr')
def tss_profile(spark, d):
    return _profile(spark, d)


_TSSE = (
    _W
    + _TSS
    + """, q as (select cell, coalesce(sum(n) filter ("offset" < 100 or "offset" >= 3901), 0) / 200.0 as fl, coalesce(sum(n) filter ("offset" between 1950 and 2050), 0) / 101.0 as c from pr group by 1),
e as (select cell, c / (case when fl = 0 then (select avg(fl) from q) else fl end) as tsse from q) """
)


@query("tss_enrichment", _TSSE + "select cell, round(tsse, 6) as tsse from e")
def tsse(spark, d):
    return Q.tss_enrichment(_profile(spark, d)).withColumn("tsse", F.round("tsse", 6))


@query("library_tsse", _TSSE + "select round(avg(tsse), 6) as library_tsse from e")
def library(spark, d):
    return Q.library_tsse(Q.tss_enrichment(_profile(spark, d))).withColumn("library_tsse", F.round("library_tsse", 6))


@query("filter_cells", _IMPORT + "select cell from q where n_fragment >= 20 and n_fragment <= 500")
def filter_cells(spark, d):
    return Q.filter_cells(Q.import_fragments(V.frags(spark, d), min_fragments=1), 20, 500, 1.0).select("cell")


@query("call_cells", _IMPORT + "select cell from q where n_fragment >= 100")
def call_cells(spark, d):
    return Q.call_cells(Q.import_fragments(V.frags(spark, d), min_fragments=1), 100).select("cell")


@query("qc", _NUC + ", fr as (select cell, count(*) filter (not " + _MITO + ") as n from f group by 1) select nuc.cell from nuc join fr on nuc.cell = fr.cell where n > 20 and n < 1000 and ns < 4")
def qc(spark, d):
    f = V.frags(spark, d)
    c = Q.import_fragments(f, min_fragments=0).join(Q.nucleosome_signal(f), "cell")
    return Q.qc(c, (20, 1000)).select("cell")


@query("concat_samples", _W + " select 'lib#' || cell as cell, chrom, \"start\", \"end\", \"count\", 'lib' as sample from f")
def concat(spark, d):
    return Q.concat_samples({"lib": V.frags(spark, d)})


@query("fragment_histogram", _W + ", h as (select cell, (\"end\" - \"start\") // 5 * 5 as length, count(*) as n from f where chrom = 'chrM' and \"start\" < 8000 and \"end\" > 2000 group by 1, 2) select gr.cell, length, n from gr left join h on gr.cell = h.cell")
def histogram(spark, d):
    return Q.fragment_histogram(V.frags(spark, d), V.groups(spark, d), "chrM", 2000, 8000)


_NM = _W + f", fm as (select * from f where not ({_MITO}))"


@query("add_tile_matrix", _NM + ' select cell, chrom, tile, cast(sum("count") as bigint) as value from (select cell, chrom, "count", unnest(list_distinct(["start" // 500, ("end" - 1) // 500])) as tile from fm) group by 1, 2, 3')
def tiles(spark, d):
    return M.tile_matrix(V.frags(spark, d))


@query("add_tile_matrix_fragment", _NM + ' select cell, chrom, tile, cast(sum("count") as bigint) as value from (select cell, chrom, "count", unnest(range("start" // 100, ("end" - 1) // 100 + 1)) as tile from fm) group by 1, 2, 3')
def tiles_fragment(spark, d):
    return M.tile_matrix(V.frags(spark, d), 100, "fragment")


@query("tile_grid", _W + """, s as (select chrom, max("end") as length from p group by 1), t as (select chrom, unnest(range(0, cast(ceil(length / 100000) as bigint))) as tile from s)
select chrom, tile, chrom || ':' || tile * 100000 || '-' || (tile + 1) * 100000 - 1 as label from t""")
def grid(spark, d):
    return M.tile_grid(V.peaks(spark, d).groupBy("chrom").agg(F.max("end").alias("length")), 100_000)


_PEAKS = ", x as (select cell, feature, least(count(*), 4) as value from (select cell, chrom, unnest([\"start\", \"end\" - 1]) as pos from fm) c asof join p on c.chrom = p.chrom and c.pos >= p.\"start\" where pos < p.\"end\" group by 1, 2)"


@query("make_peak_matrix", _NM + _PEAKS + " select * from x")
def peak_matrix(spark, d):
    return M.peak_matrix(V.frags(spark, d), V.peaks(spark, d))


@query("make_peak_matrix_fragment", _NM + ' select cell, feature, least(count(*), 4) as value from fm join p on fm.chrom = p.chrom and fm."start" < p."end" and fm."end" > p."start" group by 1, 2')
def peak_matrix_fragment(spark, d):
    return M.peak_matrix(V.frags(spark, d), V.peaks(spark, d), "fragment")


# genes of the queries on matrices: one for every peak, so that they have fragments
_G = """, gg as (select feature as gene, chrom, "start" - 300 as "start", "end" + 700 as "end", case when ("start" // 7) % 2 = 0 then '+' else '-' end as strand from p)"""


def _genes(spark, d):
    p = V.peaks(spark, d)
    return p.select(F.col("feature").alias("gene"), "chrom", (F.col("start") - 300).alias("start"), (F.col("end") + 700).alias("end"), F.when(F.floor(F.col("start") / 7) % 2 == 0, "+").otherwise("-").alias("strand"))


@query(
    "make_gene_matrix",
    _NM
    + _G
    + """, w as (select gene, chrom, greatest(case when strand = '+' then "start" - 2000 else "start" end, 0) as s, case when strand = '+' then "end" else "end" + 2000 end as e from gg)
select cell, gene as feature, count(*) as value from (select cell, chrom, unnest(["start", "end" - 1]) as pos from fm) c join w on c.chrom = w.chrom and pos >= s and pos < e group by 1, 2""",
)
def gene_matrix(spark, d):
    return M.gene_matrix(V.frags(spark, d), _genes(spark, d))


_DOM = (
    _W
    + _G
    + """, b as (select gene, chrom, "start", "end", strand = '+' as plus, case when strand = '+' then "start" - 5000 else "start" end as body_lo, case when strand = '+' then "end" else "end" + 5000 end as body_hi from gg where chrom not in ('chrY', 'chrM')),
m as (select *, 1.0 / greatest(body_hi - body_lo, 1) as m, lag(body_hi) over w as ph, lead(body_lo) over w as nl from b window w as (partition by chrom order by "start", "end", gene)),
dm as (select gene, chrom, body_lo, body_hi, greatest(1, least(5, case when max(m) over c > min(m) over c then 1 + m * 4 / (max(m) over c - min(m) over c) else 1 end)) as weight,
  greatest(least(body_lo - 1000, greatest(body_lo - 100000, coalesce(ph + 500, body_lo - 100000))), 1) as lo,
  greatest(body_hi + 1000, least(body_hi + 100000, coalesce(nl - 500, body_hi + 100000))) as hi from m window c as (partition by chrom))
"""
)


@query("gene_domains", _DOM + 'select gene, chrom, body_lo, body_hi, lo as "start", greatest(hi, lo + 1) as "end", round(weight, 9) as weight from dm')
def domains(spark, d):
    return M.gene_domains(_genes(spark, d).where("chrom not in ('chrY', 'chrM')")).withColumn("weight", F.round("weight", 9))


@query(
    "add_gene_score_matrix",
    _DOM
    + """, tt as (select cell, chrom, tile, least(count(*), 4) as n from (select cell, chrom, unnest(list_distinct(["start" // 500, ("end" - 1) // 500])) as tile from f) group by 1, 2, 3),
ww as (select t.chrom, tile, gene, (exp(-greatest(0, body_lo - (tile * 500 + 500), tile * 500 - body_hi) / 5000.0) + exp(-1)) * weight as w
  from (select distinct chrom, tile from tt) t join dm on t.chrom = dm.chrom and tile * 500 + 250 >= lo and tile * 500 + 250 < greatest(hi, lo + 1)),
s as (select cell, gene as feature, sum(w * n) as v from tt join ww on tt.chrom = ww.chrom and tt.tile = ww.tile group by 1, 2)
select cell, feature, round(v / sum(v) over (partition by cell) * 10000, 5) as value from s""",
)
def gene_score(spark, d):
    return M.gene_scores(V.frags(spark, d), _genes(spark, d)).withColumn("value", F.round("value", 5))


def _x(spark, d):
    return materialize(M.peak_matrix(V.frags(spark, d), V.peaks(spark, d)), "x")


_X = _NM + _PEAKS


@query("select_features_by_presence", _X + ", s as (select feature, count(*) as cells, cast(sum(value) as bigint) as total from x group by 1), t as (select *, cells + 1e-6 * total / (select max(total) from s) as sc from s) select feature, cells, total from t where sc >= (select min(sc) from (select sc from t order by sc desc limit 300))")
def presence(spark, d):
    return M.features_by_presence(_x(spark, d), 300)


@query("select_features", _X + ", s as (select feature, cast(sum(value) as bigint) as total from x group by 1), r as (select *, row_number() over (order by total, feature) as r, count(*) over () as k from s) select feature, total from r where r > cast(floor(0.005 * k) as int) and r <= k - cast(floor(0.005 * k) as int) and r > k - cast(floor(0.005 * k) as int) - 400")
def select_features(spark, d):
    return M.select_features(_x(spark, d), 400)


@query("select_top_features", _X + ", s as (select feature, cast(sum(value) as bigint) as total from x group by 1) select * from s where total <= (select quantile_cont(total, 0.995) from s) order by total desc, feature limit 200")
def top_features(spark, d):
    return M.top_features(_x(spark, d), 200)


@query(
    "variable_features",
    _X
    + """, c as (select "group", feature, sum(value) as v from x join gr on x.cell = gr.cell group by 1, 2), t as (select "group", sum(v) as t from c group by 1),
s as (select feature, sum(log2(v / t * 10000 + 1)) as a, sum(log2(v / t * 10000 + 1) ** 2) as b from c join t on c."group" = t."group" group by 1), k as (select count(*) as k from t)
select feature, round((b - a * a / k) / (k - 1), 6) as variance from s, k order by (b - a * a / k) / (k - 1) desc, feature limit 150""",
)
def variable(spark, d):
    g = V.groups(spark, d).select("cell", F.col("group").alias("cluster"))
    return M.variable_features(_x(spark, d), g, 150).withColumn("variance", F.round("variance", 6))


@query("pseudobulk", _X + ', s as (select "group", feature, sum(value) as v from x join gr on x.cell = gr.cell group by 1, 2) select "group", feature, round(v / sum(v) over (partition by "group") * 1000000, 4) as value from s')
def pseudobulk(spark, d):
    return M.pseudobulk(_x(spark, d), V.groups(spark, d)).withColumn("value", F.round("value", 4))


@query(
    "pseudobulk_with_fragments",
    _W
    + """, ev as (select "group", chrom, pos, sum(x) as x from (select "group", chrom, "start" as pos, "count" as x from f join gr on f.cell = gr.cell union all select "group", chrom, "end", -"count" from f join gr on f.cell = gr.cell) group by 1, 2, 3),
r as (select "group", chrom, pos as "start", lead(pos) over w as "end", sum(x) over w as value from ev window w as (partition by "group", chrom order by pos)),
k as (select * from r where "end" is not null and value <> 0)
select "group", chrom, "start", "end", round(value * 1000000 / sum(value * ("end" - "start")) over (partition by "group"), 6) as value from k""",
)
def pseudobulk_fragments(spark, d):
    return M.coverage_by_group(V.frags(spark, d), V.groups(spark, d)).withColumn("value", F.round("value", 6))


@query("fragments_to_cutsites", _W + ', c as (select chrom, unnest(["start" + 4, "end" - 6]) as pos, "count" as w from f) select chrom, pos as "start", cast(sum(w) as bigint) as value from c where pos >= 0 group by 1, 2')
def cutsites(spark, d):
    f = V.frags(spark, d).select("chrom", F.explode(F.array(F.col("start") + 4, F.col("end") - 6)).alias("start"), "count")
    return f.where("start >= 0").groupBy("chrom", "start").agg(F.sum("count").cast("bigint").alias("value"))


@query("tf_logidf", _X + ", n as (select count(distinct cell) as n from x), r as (select cell, sum(value) as r from x group by 1), c as (select feature, sum(value) as c from x group by 1) select x.cell, x.feature, round(ln(1 + value / r * ln(1 + n / c) * 10000), 6) as value from x join r on x.cell = r.cell join c on x.feature = c.feature, n")
def tf_logidf(spark, d):
    x = _x(spark, d)
    return S.tf_logidf(x, x.select("cell").distinct().count()).withColumn("value", F.round("value", 6))


@query("tfidf", _X + ", n as (select count(distinct cell) as n from x), r as (select cell, sum(value) as r from x group by 1), c as (select feature, sum(value) as c from x group by 1) select x.cell, x.feature, round(value / r * n / c, 8) as value from x join r on x.cell = r.cell join c on x.feature = c.feature, n")
def tfidf(spark, d):
    x = _x(spark, d)
    return S.tf_idf(x, x.select("cell").distinct().count()).withColumn("value", F.round("value", 8))


@query("idf", _X + ", n as (select count(distinct cell) as n from x) select feature, round(ln(any_value(n) / (1 + count(*))), 8) as idf from x, n group by 1")
def idf(spark, d):
    x = _x(spark, d)
    return S.idf(x, x.select("cell").distinct().count()).withColumn("idf", F.round("idf", 8))


@query("binarize", _X + " select cell, feature, 1 as value from x")
def binarize(spark, d):
    return S.binarize(_x(spark, d))


@query("row_normalise", _X + " select cell, feature, round(value / sum(value) over (partition by cell) * 10000, 6) as value from x")
def row_normalise(spark, d):
    return S.row_normalise(_x(spark, d)).withColumn("value", F.round("value", 6))


@query("zscore_columns", _X + ", s as (select feature, avg(value) as m, stddev_samp(value) as s from x group by 1) select cell, x.feature, round((value - m) / case when coalesce(s, 0) = 0 then 1 else s end, 6) as z from x join s on x.feature = s.feature")
def zscore(spark, d):
    return S.zscore(_x(spark, d), "value", ["feature"]).select("cell", "feature", F.round("z", 6).alias("z"))


@query("global_rank", "select l_orderkey, l_partkey, l_extendedprice, row_number() over (order by l_extendedprice, l_orderkey, l_partkey, l_linenumber, l_quantity, l_suppkey) as rank from lineitem")
def rank(spark, d):
    o = ["l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_suppkey"]
    return S.global_rank(table(spark, d, "lineitem"), o).select("l_orderkey", "l_partkey", "l_extendedprice", "rank")


@query(
    "bh_fdr",
    "with t as (select o_orderkey, (o_orderkey * 7919 % 100003) / 100003.0 as p_value from orders), r as (select *, p_value * count(*) over () / row_number() over (order by p_value, o_orderkey) as q from t) "
    "select o_orderkey, round(p_value, 9) as p_value, round(least(1, min(q) over (order by p_value desc range between unbounded preceding and current row)), 9) as fdr from r",
)
def bh(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 100003 / 100003).alias("p_value"))
    return S.bh_fdr(o).select("o_orderkey", F.round("p_value", 9).alias("p_value"), F.round("fdr", 9).alias("fdr"))


@query("summary_scores", "select l_returnflag, count(*) as n, round(avg(l_quantity), 6) as mean, round(median(l_quantity), 6) as median, round(stddev_pop(l_quantity), 6) as std, min(l_quantity) as min, max(l_quantity) as max, round(quantile_cont(l_quantity, 0.25), 6) as q25, round(quantile_cont(l_quantity, 0.75), 6) as q75 from lineitem group by 1")
def summary(spark, d):
    s = S.summary(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])
    return s.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "min", "max", *[F.round(c, 6).alias(c) for c in ("q25", "q75")])


_SIDES = _X + ", sd as (select cell, case when \"group\" = (select min(\"group\") from gr) then 'fg' else 'bg' end as side from gr)"


def _sides(spark, d):
    g = V.groups(spark, d)
    one = g.agg(F.min("group").alias("_one"))
    return g.crossJoin(F.broadcast(one)).select("cell", F.when(F.col("group") == F.col("_one"), "fg").otherwise("bg").alias("side"))


@query(
    "wilcoxon_group_vs_bg",
    _SIDES
    + """, fs as (select distinct x.feature from x join sd on x.cell = sd.cell), d0 as (select fs.feature, sd.cell, side, coalesce(value, 0) as v from fs cross join sd left join x on x.feature = fs.feature and x.cell = sd.cell),
rk as (select *, rank() over w + (count(*) over (partition by feature, v) - 1) / 2.0 as r, count(*) over (partition by feature, v) as tie, count(*) over (partition by feature) as n from d0 window w as (partition by feature order by v)),
a as (select feature, sum(r) filter (side = 'fg') as r1, count(*) filter (side = 'fg') as n1, count(*) filter (side = 'bg') as n2, any_value(n) as n, sum(tie * tie - 1.0) as ties,
  avg(v) filter (side = 'fg') as m1, avg(v) filter (side = 'bg') as m2, avg((v > 0)::int) filter (side = 'fg') as p1, avg((v > 0)::int) filter (side = 'bg') as p2 from rk group by 1),
b as (select *, r1 - n1 * (n1 + 1) / 2.0 as u, n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1.0))) as var from a)
select feature, round(u, 4) as u, round(case when var > 0 then (u - n1 * n2 / 2.0) / sqrt(var) else 0 end, 5) as z, round(m1, 6) as mean_fg, round(m2, 6) as mean_bg, round(p1, 6) as pct_fg, round(p2, 6) as pct_bg, round(log2((m1 + 1e-6) / (m2 + 1e-6)), 5) as log2_fc from b""",
)
def wilcoxon(spark, d):
    r = S.rank_sum(_x(spark, d), materialize(_sides(spark, d), "sides"))
    rd = {"u": 4, "z": 5, "mean_fg": 6, "mean_bg": 6, "pct_fg": 6, "pct_bg": 6, "log2_fc": 5}
    return r.select("feature", *[F.round(c, k).alias(c) for c, k in rd.items()])


@query("quantile_normalize", "with r as (select l_linenumber, l_orderkey, row_number() over (partition by l_linenumber order by l_extendedprice, l_orderkey, l_partkey) as r, l_extendedprice as v from lineitem), m as (select r, avg(v) as m, count(*) as c from r group by 1) select l_linenumber, l_orderkey, round(m, 4) as value from r join m on r.r = m.r")
def quantile_normalise(spark, d):
    x = table(spark, d, "lineitem").select("l_linenumber", "l_orderkey", F.struct("l_orderkey", "l_partkey").alias("feature"), F.col("l_extendedprice").alias("value"))
    return S.quantile_normalise(x, "l_linenumber").select("l_linenumber", "l_orderkey", F.round("value", 4).alias("value"))


_TMM = """, pb0 as (select "group" as s, feature, sum(value) as v from x join gr on x.cell = gr.cell group by 1, 2), pb as (select s, feature, v / sum(v) over (partition by s) * 1000000 as v from pb0),
lib as (select s, sum(v) as lib from pb group by 1), ft as (select distinct feature from pb),
fl as (select lib.s, ft.feature, coalesce(pb.v, 0) as v, coalesce(pb.v, 0) / greatest(lib, 1) as r from lib cross join ft left join pb on pb.s = lib.s and pb.feature = ft.feature),
qq as (select s, quantile_cont(r, 0.75) as q from fl group by 1), rf as (select s from qq order by abs(q - (select avg(q) from qq)), s limit 1),
lr as (select a.s, log2(a.r / b.r) as m, log2(a.r * b.r) / 2 as a from fl a join fl b on a.feature = b.feature and b.s = (select s from rf) where a.v > 0 and b.v > 0 and a.s <> b.s),
tq as (select s, count(*) as k, quantile_cont(m, 0.3) as m0, quantile_cont(m, 0.7) as m1, quantile_cont(a, 0.05) as a0, quantile_cont(a, 0.95) as a1 from lr group by 1),
kp as (select lr.s, avg(m) as m from lr join tq on lr.s = tq.s where k >= 4 and m >= m0 - 1e-12 and m <= m1 + 1e-12 and a >= a0 - 1e-12 and a <= a1 + 1e-12 group by 1),
nf as (select lib.s, pow(2, coalesce(m, 0)) as f from lib left join kp on lib.s = kp.s)
"""


@query("tmm_norm_factors", _X + _TMM + "select s as sample, round(f / (select exp(avg(ln(f))) from nf), 6) as factor from nf")
def tmm(spark, d):
    b = M.pseudobulk(_x(spark, d), V.groups(spark, d))
    return S.tmm_factors(b.select(F.col("group").alias("sample"), "feature", "value")).withColumn("factor", F.round("factor", 6))


@query("differential_peaks")
def differential(spark, d):
    x = _x(spark, d)
    sample = x.withColumn("sample", F.split("cell", "#")[0]).join(V.groups(spark, d), "cell").withColumn("sample", F.concat_ws("/", "sample", "group"))
    x = sample.groupBy("sample", "feature").agg(F.sum("value").alias("value"))
    meta = sample.select("sample", F.col("group")).distinct()
    names = [r[0] for r in meta.groupBy("group").count().orderBy("group").limit(2).collect()]
    return S.differential(x, meta.withColumnRenamed("group", "condition"), names[0], names[1])


@query("estimate_bias_parameters", "with a as (select count(*) as n, covar_samp(l_quantity, l_extendedprice) as c, var_pop(l_quantity) as v, avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem) select round(c / v, 4) as slope, round(my - c / v * mx, 3) as intercept from a")
def bias_fit(spark, d):
    return S.linear_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query("scalar_shapes", "select p_partkey, round(5 / (1 + exp(-0.1 * (p_size - 20))) + 1, 9) as sig, round(2 * exp(-0.5 * ((p_size - 25) / 4.0) ** 2) / (4 * sqrt(2 * pi())), 9) as pdf, greatest(0, 0.5 * p_size - 3) as relu from part")
def shapes(spark, d):
    x = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(S.sigmoid(x, 20, 0.1, 5.0, 1.0), 9).alias("sig"), F.round(S.norm_pdf(x, 25, 4.0, 2.0), 9).alias("pdf"), S.relu(x, 0.5, -3.0).alias("relu"))


@query("cumulative_distance", "with n as (select n_regionkey, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1), c as (select n_regionkey, floor(c_acctbal / 100) as v, count(*) as c from customer join nation on c_nationkey = n_nationkey where floor(c_acctbal / 100) <= 50 group by 1, 2) select c.n_regionkey, cast(v as bigint) as v, round(sum(c) over (partition by c.n_regionkey order by v) / n, 9) as share from c join n on c.n_regionkey = n.n_regionkey")
def ecdf(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("v", F.floor(F.col("c_acctbal") / 100))
    return S.ecdf(c, "v", ["n_regionkey"], 50).withColumn("share", F.round("share", 9))


@query("volcano", "select p_partkey, case when p_size / 50.0 < 0.05 or p_size / 50.0 < 0.5 and abs(p_retailprice - 1000) >= 100 then case when p_size / 50.0 < 0.5 and abs(p_retailprice - 1000) >= 100 then case when p_retailprice > 1000 then 'up' else 'down' end else 'ns' end else 'ns' end as direction from part")
def volcano(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") - 1000).alias("log2FoldChange"), (F.col("p_size") / 50.0).alias("padj"))
    return S.volcano(p, alpha=0.5, least=100.0).select("p_partkey", "direction")


@query("get_closest", "select p_retailprice as closest from part order by abs(p_retailprice - 1234.5), p_retailprice limit 1")
def closest(spark, d):
    return S.closest(table(spark, d, "part"), "p_retailprice", 1234.5)


def _seeded(key: str, seed: int = 0) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::bigint"


@query(
    "expression_matched_sample",
    f"""with t as (select ln(1 + o_totalprice) as v from orders where o_orderpriority = '1-URGENT'), e as (select unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as e from t),
nd as (select bin, count(*) as need from (select (select count(*) from e where t.v >= e.e) as bin from t) group by 1),
pl as (select o_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_quantity as id, l_extendedprice as value, ln(1 + l_extendedprice) as v from (select *, l_orderkey as o_orderkey from lineitem)),
pb as (select id, value, (select count(*) from e where pl.v >= e.e) as bin from pl where v between (select min(v) from t) and (select max(v) from t)),
rk as (select *, row_number() over (partition by bin order by {_seeded("id")}, id, value) as r from pb)
select id, round(value, 2) as value, cast(rk.bin as int) as bin from rk join nd on rk.bin = nd.bin where r <= need""",
)
def matched(spark, d):
    """Prices of order lines distributed like the totals of urgent orders."""
    t = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_totalprice").alias("value"))
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    m = S.matched_sample(t, table(spark, d, "lineitem").select(key.alias("id"), F.col("l_extendedprice").alias("value")))
    return m.select("id", F.round("value", 2).alias("value"), "bin")


@query("balance_cluster_cells", _W + f', n as (select "group", count(*) as n from gr group by 1), r as (select *, row_number() over (partition by "group" order by {_seeded("cell")}, cell) as r from gr) select cell, "group" from r where r <= (select min(n) from n)')
def balance(spark, d):
    return S.down_sample(V.groups(spark, d), "group", "cell").select("cell", "group")


@query("split_pseudo_replicates", _W + f""", r as (select i as replicate, cell, row_number() over (partition by i order by {_seeded("i || ':' || cell")}, cell) as r from gr, range(0, 3) t(i)) select cast(replicate as int) as replicate, cell from r where r <= round(0.5 * (select count(*) from gr))""")
def replicates(spark, d):
    return S.pseudo_replicates(V.groups(spark, d), 3, 0.5, "cell").select("replicate", "cell")
