"""Queries of aligned reads (two mates made of every fragment) and of plotted relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.operators import reads as A
from locusmill.queries import views as V
from locusmill.queries.registry import query

_R = f"""with {V.SQL_VIEWS}, ff as (select *, cell || ':' || chrom || ':' || "start" || ':' || "end" || ':' || "count" as read_id from f),
rd as (select read_id, chrom, "start" as pos, "start" + 40 as "end", '+' as strand, cast(case when "start" % 7 = 0 then 1024 else 0 end + 99 as bigint) as flag, cast("start" % 60 as bigint) as mapq, "end" - 40 as mate_pos, "end" - "start" as tlen from ff
  union all select read_id, chrom, "end" - 40, "end", '-', cast(case when "start" % 7 = 0 then 1024 else 0 end + 147 as bigint), cast("start" % 60 as bigint), "start", "start" - "end" from ff where "end" >= 40),
ok as (select * from rd where mapq >= 30 and chrom <> 'chrM' and (flag & 1024) = 0)
"""


def _reads(spark, d):
    f = V.frags(spark, d).withColumn("read_id", F.concat_ws(":", "cell", "chrom", "start", "end", "count"))
    dup = F.when(F.col("start") % 7 == 0, 1024).otherwise(0)
    q = (F.col("start") % 60).alias("mapq")
    s, e = F.col("start"), F.col("end")
    one = f.select("read_id", "chrom", s.alias("pos"), (s + 40).alias("end"), F.lit("+").alias("strand"), (dup + 99).alias("flag"), q, (e - 40).alias("mate_pos"), (e - s).alias("tlen"))
    two = f.where("end >= 40").select("read_id", "chrom", (e - 40).alias("pos"), e.alias("end"), F.lit("-").alias("strand"), (dup + 147).alias("flag"), q, s.alias("mate_pos"), (s - e).alias("tlen"))
    return one.unionByName(two)


@query("filter_bam", _R + "select read_id, strand from ok")
def filter_bam(spark, d):
    return A.filter_reads(_reads(spark, d)).select("read_id", "strand")


@query("filter_bam_by_regions", _R + 'select read_id, strand from rd where mapq >= 30 and (flag & 1024) = 0 and exists (select 1 from p where p.chrom = rd.chrom and rd.pos < p."end" and rd."end" > p."start")')
def by_regions(spark, d):
    return A.filter_by_regions(_reads(spark, d), V.peaks(spark, d)).select("read_id", "strand")


@query("shift_atac_bam", _R + "select read_id, strand, greatest(pos + case strand when '+' then 4 else -5 end, 0) as pos, greatest(mate_pos + case strand when '+' then -5 else 4 end, 0) as mate_pos, case when tlen > 0 then tlen - 9 when tlen < 0 then tlen + 9 else 0 end as tlen from ok")
def shift(spark, d):
    return A.shift_cuts(A.filter_reads(_reads(spark, d))).select("read_id", "strand", "pos", "mate_pos", "tlen")


@query("bam_to_frags", _R + "select chrom, min(pos) as \"start\", max(\"end\") as \"end\", 'x' as sample from ok group by read_id, chrom having count(*) = 2 and max(\"end\") > min(pos)")
def to_frags(spark, d):
    return A.reads_to_fragments(A.filter_reads(_reads(spark, d)), "x")


@query("bam_to_bigwig", _R + ', ev as (select chrom, p, sum(x) as x from (select chrom, pos as p, 1 as x from ok union all select chrom, "end", -1 from ok) group by 1, 2), r as (select chrom, p as "start", lead(p) over w as "end", sum(x) over w as v from ev window w as (partition by chrom order by p)) select chrom, "start", "end", round(v * 1000000 / (select count(*) from ok), 6) as value from r where "end" is not null and v <> 0')
def to_coverage(spark, d):
    return A.reads_to_coverage(A.filter_reads(_reads(spark, d))).withColumn("value", F.round("value", 6))


@query("coverage_from_peaks", f"""with {V.SQL_VIEWS}, x as (select f.cell, feature, count(*) as n from f join p on f.chrom = p.chrom and f."start" < p."end" and f."end" > p."start" group by 1, 2),
t as (select cell, sum(n) as t from x group by 1), k as (select "group", count(*) as k from gr group by 1), m as (select gr."group", feature, sum(n * 10000.0 / t) / any_value(k) as v from x join t on x.cell = t.cell join gr on x.cell = gr.cell join k on k."group" = gr."group" group by 1, 2)
select "group", p.chrom, ("start" + "end") // 2 // 1000000 as bin, round(sum(v), 5) as value from m join p on m.feature = p.feature group by 1, 2, 3""")
def coverage_from_peaks(spark, d):
    """Mean normalised counts of groups of cells in bins along the chromosomes."""
    from locusmill.operators.matrices import peak_matrix
    from locusmill.operators.stats import row_normalise

    p = V.peaks(spark, d)
    x = row_normalise(peak_matrix(V.frags(spark, d), p, "fragment", None, ()))
    g = V.groups(spark, d)
    k = g.groupBy("group").agg(F.count(F.lit(1)).alias("k"))
    m = x.join(g, "cell").groupBy("group", "feature").agg(F.sum("value").alias("s")).join(k, "group").withColumn("v", F.col("s") / F.col("k"))
    place = p.select("feature", "chrom", F.floor((F.col("start") + F.col("end")) / 2 / 1_000_000).alias("bin"))
    return m.join(place, "feature").groupBy("group", "chrom", "bin").agg(F.round(F.sum("v"), 5).alias("value"))
