"""Queries of the interval joins and region operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.operators import intervals as I
from locusmill.operators import regions as R
from locusmill.queries import views as V
from locusmill.queries.registry import query

_W = f"with {V.SQL_VIEWS}"


@query("overlap_join", _W + ' select f.cell, f.chrom, f."start", f."end", p.feature from f join p on f.chrom = p.chrom and f."start" < p."end" and f."end" > p."start"')
def overlap_join(spark, d):
    return I.overlap_join(V.frags(spark, d), V.peaks(spark, d)).select("cell", "chrom", "start", "end", F.col("r_feature").alias("feature"))


@query("overlap_semi_join", _W + ' select * from f where exists (select 1 from p where f.chrom = p.chrom and f."start" < p."end" and f."end" > p."start")')
def overlap_semi(spark, d):
    return I.overlap_filter(V.frags(spark, d), V.peaks(spark, d))


@query("overlap_anti_join", _W + ' select * from f where not exists (select 1 from p where f.chrom = p.chrom and f."start" < p."end" and f."end" > p."start")')
def overlap_anti(spark, d):
    return I.overlap_filter(V.frags(spark, d), V.peaks(spark, d), anti=True)


@query("overlap_left_join", _W + ' select p.feature, g.gene from p left join g on p.chrom = g.chrom and p."start" < g."end" and p."end" > g."start"')
def overlap_left(spark, d):
    return I.overlap_join(V.peaks(spark, d), V.genes(spark, d).select("chrom", "start", "end", "gene"), how="left").select("feature", F.col("r_gene").alias("gene"))


@query("fetch_regions_to_df", _W + ' select p.feature, f.cell, f."start" - (p."start" + p."end") // 2 as rel_start, f."end" - (p."start" + p."end") // 2 as rel_end from p join f on p.chrom = f.chrom and p."start" - 1000 < f."end" and p."end" + 1000 > f."start"')
def fetch_regions(spark, d):
    mid = F.floor((F.col("r_start") + F.col("r_end")) / 2)
    return I.overlap_join(V.frags(spark, d), V.peaks(spark, d), slack=1000).select(F.col("r_feature").alias("feature"), "cell", (F.col("start") - mid).alias("rel_start"), (F.col("end") - mid).alias("rel_end"))


@query("asof_join", _W + ' select f.cell, f.chrom, f."start" as pos, p.feature, p."start" as p_start from f asof join p on f.chrom = p.chrom and f."start" >= p."start" where f."start" < p."end"')
def asof_join(spark, d):
    pts = V.frags(spark, d).select("cell", "chrom", F.col("start").alias("pos"))
    return I.asof_join(pts, V.peaks(spark, d).select("feature", "chrom", "start", "end")).select("cell", "chrom", "pos", F.col("r_feature").alias("feature"), F.col("r_start").alias("p_start"))


@query("distance_to_nearest_peak", _W + ' select g.gene, min(abs(g.tss - (p."start" + p."end") // 2)) as distance from g join p on g.chrom = p.chrom group by 1')
def nearest(spark, d):
    return I.distance_to_nearest(V.genes(spark, d), V.peaks(spark, d)).select("gene", "distance")


@query("filter_distal_peaks", _W + ' select feature from p where not exists (select 1 from g where g.chrom = p.chrom and abs((p."start" + p."end") // 2 - g.tss) < 2500)')
def distal(spark, d):
    return I.filter_distal(V.peaks(spark, d), V.genes(spark, d)).select("feature")


def _sets(spark, d):
    p, g = V.peaks(spark, d), V.genes(spark, d)
    near = g.select("chrom", (F.col("tss") - 2000).alias("start"), (F.col("tss") + 2000).alias("end"))
    return {"gene": g.select("chrom", "start", "end"), "tss": near, "peak": p.select("chrom", "start", "end")}


@query(
    "classify_peaks_by_overlap",
    _W
    + """, a as (select chrom, "start", "end" from g), b as (select chrom, tss - 2000 as "start", tss + 2000 as "end" from g), c as (select chrom, "start", "end" from p),
a2 as (select a.*, exists (select 1 from b where a.chrom = b.chrom and a."start" < b."end" and a."end" > b."start") as x, exists (select 1 from c where a.chrom = c.chrom and a."start" < c."end" and a."end" > c."start") as y from a),
b2 as (select b.*, exists (select 1 from c where b.chrom = c.chrom and b."start" < c."end" and b."end" > c."start") as y from b where not exists (select 1 from a where a.chrom = b.chrom and a."start" < b."end" and a."end" > b."start"))
select chrom, "start", "end", case when x or y then 'gene' || case when x then '/tss' else '' end || case when y then '/peak' else '' end || ' shared' else 'gene-specific' end as class from a2
union all select chrom, "start", "end", case when y then 'tss/peak shared' else 'tss-specific' end from b2
union all select chrom, "start", "end", 'peak-specific' from c where not exists (select 1 from a where a.chrom = c.chrom and a."start" < c."end" and a."end" > c."start")
  and not exists (select 1 from b where b.chrom = c.chrom and b."start" < c."end" and b."end" > c."start")""",
)
def classify(spark, d):
    return I.classify_by_overlap(_sets(spark, d))


@query(
    "find_genes",
    _W
    + """, w as (select gene, chrom, case when strand = '+' then "start" - 5000 else "start" end as "start", case when strand = '+' then "end" else "end" + 5000 end as "end" from g)
select p.feature, coalesce(string_agg(distinct w.gene, ';' order by w.gene), case when p.chrom in (select chrom from g) then 'intergenic' else 'unassigned' end) as genes
from p left join w on p.chrom = w.chrom and p."start" < w."end" and p."end" > w."start" group by p.feature, p.chrom""",
)
def find_genes(spark, d):
    from locusmill.operators.annotate import find_genes as op

    return op(V.peaks(spark, d), V.genes(spark, d))


@query("band_join", _W + ' select p.feature, g.gene, (p."start" + p."end") // 2 - g.tss as distance from p join g on p.chrom = g.chrom and abs((p."start" + p."end") // 2 - g.tss) <= 250000')
def band(spark, d):
    p = V.peaks(spark, d).withColumn("centre", F.floor((F.col("start") + F.col("end")) / 2))
    return I.band_join(p, V.genes(spark, d).select("chrom", "gene", "tss"), "centre", "tss", 250_000).select("feature", F.col("r_gene").alias("gene"), "distance")


@query(
    "coverage_runs",
    _W
    + """, ev as (select chrom, pos, sum(x) as x from (select chrom, "start" as pos, 1 as x from f union all select chrom, "end", -1 from f) group by 1, 2),
r as (select chrom, pos as "start", lead(pos) over w as "end", sum(x) over w as value from ev window w as (partition by chrom order by pos))
select chrom, "start", "end", cast(value as bigint) as value from r where "end" is not null and value <> 0""",
)
def coverage(spark, d):
    return I.coverage_runs(V.frags(spark, d), ["chrom"])


_ISLANDS = """, m as (select *, max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) as pe from {t}),
i as (select *, sum(case when pe is null or "start" {op} pe then 1 else 0 end) over (partition by chrom order by "start", "end") as isl from m)
select chrom, min("start") as "start", max("end") as "end" from i group by chrom, isl"""


@query("region_merge", _W + _ISLANDS.format(t="g", op=">="))
def merge(spark, d):
    """Genes merged where they overlap; those that only touch stay apart."""
    return R.merge_regions(V.genes(spark, d))


@query("region_merge_touching", _W + _ISLANDS.format(t="g", op=">"))
def merge_touching(spark, d):
    return R.merge_regions(V.genes(spark, d), touching=True)


@query(
    "region_subtract",
    _W
    + """, m as (select *, max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) as pe from p),
i as (select *, sum(case when pe is null or "start" > pe then 1 else 0 end) over (partition by chrom order by "start", "end") as isl from m),
b as (select chrom, min("start") as s, max("end") as e from i group by chrom, isl),
ev as (select gene, g.chrom, greatest(s, "start") as s, least(e, "end") as e, "start" as gs, "end" as ge from g join b on g.chrom = b.chrom and s < "end" and e > "start"),
cuts as (select *, coalesce(lag(e) over (partition by gene order by s), gs) as from_, s as to_ from ev union all
  select gene, chrom, s, e, gs, ge, e, ge from (select gene, chrom, max(s) as s, max(e) as e, gs, ge from ev group by gene, chrom, gs, ge))
select gene, chrom, from_ as "start", to_ as "end" from cuts where from_ < to_
union all select gene, chrom, "start", "end" from g where gene not in (select gene from ev)""",
)
def subtract(spark, d):
    g = V.genes(spark, d).select("gene", "chrom", "start", "end")
    return R.subtract(g, V.peaks(spark, d).select("chrom", "start", "end"))


@query("region_split", _W + ' select gene, chrom, "start" + 1000 * k as "start", least("start" + 1000 * (k + 1), "end") as "end" from (select *, unnest(range(0, ("end" - "start" + 999) // 1000)) as k from g)')
def split(spark, d):
    return R.split_regions(V.genes(spark, d).select("gene", "chrom", "start", "end"), 1000)


@query("region_extend", _W + ' select gene, chrom, "start" - 250 as "start", "end" + 250 as "end" from g')
def extend(spark, d):
    return R.extend(V.genes(spark, d).select("gene", "chrom", "start", "end"), 250)


@query(
    "region_set_width",
    _W + """ select gene, cast(case when strand = '-' then ceil(("start" + "end") / 2) - 250 else floor(("start" + "end") / 2) - 251 end as bigint) as "start",
cast(case when strand = '-' then ceil(("start" + "end") / 2) + 251 else floor(("start" + "end") / 2) + 250 end as bigint) as "end" from g""",
)
def set_width(spark, d):
    return R.set_width(V.genes(spark, d).select("gene", "start", "end", "strand"), 501).select("gene", "start", "end")


@query("region_check_boundary", _W + ', s as (select chrom, max("end") - 5000 as length from g group by 1) select gene, g.chrom, greatest("start", 0) as "start", least("end", length) as "end" from g join s on g.chrom = s.chrom where greatest("start", 0) < least("end", length)')
def boundary(spark, d):
    g = V.genes(spark, d).select("gene", "chrom", "start", "end")
    return R.check_boundary(g, g.groupBy("chrom").agg((F.max("end") - 5000).alias("length")))


@query("region_width_distribution", _W + ' select "end" - "start" as width, count(*) as n from p group by 1')
def widths(spark, d):
    return R.width_distribution(V.peaks(spark, d))


@query("region_keep_chroms", _W + " select feature from p where chrom in ('chr1', 'chr2')")
def keep(spark, d):
    return R.keep_chroms(V.peaks(spark, d), ["chr1", "chr2"]).select("feature")


@query("region_remove_chroms", _W + " select feature from p where chrom not in ('chr1', 'chr2')")
def remove(spark, d):
    return R.remove_chroms(V.peaks(spark, d), ["chr1", "chr2"]).select("feature")


@query("region_loc_sort_head", _W + ' select feature, chrom, "start" from p order by chrom, "start", "end" limit 50')
def head(spark, d):
    """The first 50 peaks by place (a top-k report)."""
    return R.first_regions(V.peaks(spark, d), 50).select("feature", "chrom", "start")


@query("region_score_top", _W + " select feature, score from p where score is not null order by score desc, chrom, \"start\", \"end\" limit 50")
def score_top(spark, d):
    """The 50 peaks with the greatest score (a top-k report)."""
    return R.score_sort(V.peaks(spark, d).where("score is not null")).limit(50).select("feature", "score")


@query("region_chunks", _W + ' select feature, cast((row_number() over (order by chrom, "start", "end") - 1) * 7 // (select count(*) from p) as int) as chunk from p')
def chunk(spark, d):
    return R.chunks(V.peaks(spark, d).select("feature", "chrom", "start", "end"), 7).select("feature", "chunk")


@query("region_remove_duplicates", 'with a as (select distinct seqname as chrom, "start", "end", strand from annotation) select * from a')
def dedup(spark, d):
    from locusmill.util import table

    a = table(spark, d, "annotation").select(F.col("seqname").alias("chrom"), "start", "end", "strand", F.col("row_id").alias("name"))
    return R.remove_duplicates(a).drop("name")


@query("region_get_chroms", _W + " select distinct chrom from p")
def chroms(spark, d):
    return R.chroms_in_order(V.peaks(spark, d), "start")


@query("region_parse_label", "select label, split_part(label, ':', 1) as chrom, cast(regexp_extract(label, ':([0-9]+)-', 1) as bigint) as \"start\", cast(regexp_extract(label, '-([0-9]+)$', 1) as bigint) as \"end\" from peaks")
def parse(spark, d):
    from locusmill.util import table

    return table(spark, d, "peaks").select("label", R.parse_region("label").alias("x")).select("label", "x.*")


def _named(spark, d):
    f = V.frags(spark, d).join(V.groups(spark, d), "cell")
    return f.select(F.col("group").alias("name"), "chrom", "start", "end")


_NAMED = (
    _W
    + """, n as (select "group" as name, chrom, "start", "end" from f join gr on f.cell = gr.cell),
mm as (select *, max("end") over (partition by name, chrom order by "start", "end" rows between unbounded preceding and 1 preceding) as pe from n),
ii as (select *, sum(case when pe is null or "start" >= pe then 1 else 0 end) over (partition by name, chrom order by "start", "end") as isl from mm),
st as (select name, chrom, min("start") as s, max("end") as e from ii group by name, chrom, isl),
ov as (select name, name as other, cast(sum(e - s) as bigint) as bp from st group by 1 union all
  select a.name, b.name, cast(sum(least(a.e, b.e) - greatest(a.s, b.s)) as bigint) from st a join st b on a.chrom = b.chrom and a.s < b.e and a.e > b.s and a.name <> b.name group by 1, 2)
"""
)


@query("region_count_overlaps", _NAMED + "select * from ov")
def count_overlaps(spark, d):
    return R.overlap_totals(_named(spark, d))


@query(
    "region_overlap_distance",
    _NAMED + "select o.name, o.other, round(least(1 - o.bp / a.bp, 1 - o.bp / b.bp), 9) as distance from ov o join ov a on o.name = a.name and a.other = a.name join ov b on o.other = b.name and b.other = b.name where o.name <> o.other",
)
def overlap_distance(spark, d):
    return R.overlap_distance(R.overlap_totals(_named(spark, d))).withColumn("distance", F.round("distance", 9))


@query("region_cluster")
def region_cluster(spark, d):
    return R.cluster_names(R.overlap_distance(R.overlap_totals(_named(spark, d))), 0.95)


@query("region_resolve_overlaps")
def resolve(spark, d):
    g = V.genes(spark, d).select("gene", "chrom", "start", "end", (F.col("end") - F.col("start")).cast("double").alias("score"))
    return R.resolve_overlaps(g)
