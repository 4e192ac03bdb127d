"""Queries of sequences, motifs, footprints and networks, and of the relational operators that Spark itself supplies.

The tables have no genome, so a peak's sequence here is made of the digest of its label, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.operators import footprints as P
from locusmill.operators import motifs as M
from locusmill.operators import network as N
from locusmill.queries import views as V
from locusmill.queries.registry import SQL, query
from locusmill.util import materialize, table

_W = f"with {V.SQL_VIEWS}"


_SEQ = _W + ", sq as (select feature, chrom, \"start\", \"end\", translate(md5(feature) || md5(feature || 'x'), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq from p)"


def _seqs(spark, d):
    s = F.translate(F.concat(F.md5("feature"), F.md5(F.concat("feature", F.lit("x")))), "0123456789abcdef", "ACGTACGTACGTACGT")
    return V.peaks(spark, d).withColumn("seq", s)


@query("gc_content", _SEQ + " select feature, round(length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq), 9) as gc from sq")
def gc(spark, d):
    return _seqs(spark, d).select("feature", F.round(M.gc_share("seq"), 9).alias("gc"))


@query("reverse_complement", _SEQ + " select feature, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from sq")
def rc(spark, d):
    return _seqs(spark, d).select("feature", M.reverse_complement("seq").alias("rc"))


@query("kmer_counts", _SEQ + " select substr(seq, i, 6) as kmer, count(*) as n from (select seq, unnest(range(1, length(seq) - 4)) as i from sq) where length(substr(seq, i, 6)) = 6 group by 1")
def kmer_counts(spark, d):
    return P.kmer_counts(_seqs(spark, d), 6)


@query("codes_to_kmers", _SEQ + ", k as (select feature, i, substr(seq, i, 3) as k from (select feature, seq, unnest(range(1, 63)) as i from sq)), v as (select feature, i, 16 * (strpos('ACGT', substr(k, 1, 1)) - 1) + 4 * (strpos('ACGT', substr(k, 2, 1)) - 1) + strpos('ACGT', substr(k, 3, 1)) - 1 as code from k) select feature, cast(i - 1 as int) as pos, code from v")
def codes(spark, d):
    return _seqs(spark, d).select("feature", F.posexplode(M.kmers("seq", 3)).alias("pos", "k")).select("feature", "pos", M.kmer_code("k").alias("code"))


_CUTK = ", ct as (select chrom, unnest([\"start\", \"end\" - 1]) as pos from f), ck as (select substr(seq, pos - s.\"start\" - 2, 6) as kmer from ct join sq s on ct.chrom = s.chrom and pos >= s.\"start\" and pos < s.\"end\" where pos - s.\"start\" >= 3 and pos - s.\"start\" + 3 <= 64), cn as (select kmer, count(*) as n from ck group by 1), gk as (select substr(seq, i, 6) as kmer, count(*) as n from (select seq, unnest(range(1, 60)) as i from sq) group by 1)"


@query("compute_tn5_bias_table", _SEQ + _CUTK + " select coalesce(gk.kmer, cn.kmer) as kmer, round(case when coalesce(gk.n, 0) > 0 then greatest(0.001, least(1000, coalesce(cn.n, 0) / (gk.n * ((select sum(n) from cn) / (select sum(n) from gk))))) else 1 end, 6) as bias from gk full join cn on gk.kmer = cn.kmer")
def bias(spark, d):
    from locusmill.operators.qc import cuts

    s = _seqs(spark, d)
    c = P.cut_kmer_counts(cuts(V.frags(spark, d)).select("chrom", "pos"), s.select("chrom", "start", "end", "seq"), 6)
    return P.kmer_bias(c, P.kmer_counts(s, 6)).withColumn("bias", F.round("bias", 6))


_COUNTS = _SEQ + ", ct as (select 'm' || (peak_id % 20) as motif, i - 1 as pos, substr(seq, i, 1) as base, count(*) as n from (select peak_id, seq, unnest(range(1, length(seq) + 1)) as i from sq join peaks on peaks.label = sq.feature) group by 1, 2, 3), gd as (select distinct motif, pos, b as base from ct, (values ('A'), ('C'), ('G'), ('T')) t(b)), pp as (select gd.motif, gd.pos, gd.base, (coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) over (partition by gd.motif, gd.pos) as p from gd left join ct on gd.motif = ct.motif and gd.pos = ct.pos and gd.base = ct.base)"


def _probs(spark, d):
    s = _seqs(spark, d).join(table(spark, d, "peaks").select(F.col("label").alias("feature"), "peak_id"), "feature").select(F.concat(F.lit("m"), F.col("peak_id") % 20).alias("motif"), F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''")
    return M.probabilities(s.groupBy("motif", "pos", "base").agg(F.count(F.lit(1)).alias("count")), ["motif"])


@query("motif_probabilities", _COUNTS + " select motif, cast(pos as int) as pos, base, round(p, 9) as p, round(log2(p / 0.25), 9) + 0.0 as log2_odds from pp")
def probabilities(spark, d):
    return _probs(spark, d).select("motif", "pos", "base", F.round("p", 9).alias("p"), (F.round("log2_odds", 9) + F.lit(0.0)).alias("log2_odds"))


@query("motif_information_content", _COUNTS + " select motif, cast(pos as int) as pos, round(2 + sum(p * log2(p)), 9) as bits from pp group by 1, 2")
def information(spark, d):
    return M.information_table(_probs(spark, d), ["motif"]).withColumn("bits", F.round("bits", 9))


@query("motif_consensus", _COUNTS + ", bb as (select motif, pos, base, p, row_number() over (partition by motif, pos order by p desc, base) as r from pp) select motif, string_agg(case when p >= 0.3 then base else 'N' end, '' order by pos) as consensus from bb where r = 1 group by 1")
def consensus(spark, d):
    return M.consensus_table(_probs(spark, d), ["motif"], 0.3)


def _library():
    import numpy as np

    m = lambda s: np.array([[7.0 if b == c else 1.0 for c in s] for b in "ACGT"])
    return [M.Motif(f"M{i}", s, m(s)) for i, s in enumerate(("ACGTAC", "GGATTA", "TTGCAA", "CACGTG"))]


@query("scan_motif_hits")
def scan(spark, d):
    return M.scan(_seqs(spark, d), _library(), p=1e-3)


@query("query_motif_database", _SEQ + ", hits as (select feature as k, chrom, \"start\" + i - 1 as s, substr(seq, i, 6) as w from (select *, unnest(range(1, 60)) as i from sq)) select distinct p.feature, 'M3' as motif from hits join p on hits.chrom = p.chrom and s < p.\"end\" and s + 6 > p.\"start\" where w = 'CACGTG'")
def database(spark, d):
    s = _seqs(spark, d)
    lib = [x for x in _library() if x.id == "M3"]
    lib[0].threshold = float(lib[0].pssm().max(0).sum()) - 1e-6
    hits = M.scan(s, lib, strands="+", chrom="chrom", start="start")
    return M.query_database(hits, V.peaks(spark, d))


@query("find_motifs_genome")
def enrichment(spark, d):
    s = materialize(_seqs(spark, d), "seqs")
    hits = materialize(M.scan(s, _library(), p=1e-3).select("feature", "motif").distinct(), "hits")
    top = s.where("score > 20").select("feature")
    t, b = hits.join(top, "feature", "left_semi"), hits.join(top, "feature", "left_anti")
    n = top.count()
    return spark.createDataFrame(M.enrichment(t, b, n, s.count() - n))


@query("motif_similarity")
def similarity(spark, d):
    return M.similarity_matrix(spark, _library())


@query("motif_clusters")
def clusters(spark, d):
    rows = [(i, m.id, M.merge(g).consensus()) for i, g in enumerate(M.cluster(_library(), 0.9)) for m in g]
    return spark.createDataFrame(rows, "cluster int, motif string, consensus string")


@query("gc_matched_background", _SEQ.replace('"end", translate', '"end", score as score_, translate') + ", gq as (select feature, score_, least(19, floor(length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq) * 20)) as bin from sq), t as (select bin, count(*) as k from gq where score_ > 20 group by 1), r as (select feature, k, row_number() over (partition by gq.bin order by ('0x' || substr(md5('0:' || feature), 1, 15))::bigint, feature) as r from gq join t on gq.bin = t.bin where score_ <= 20) select feature from r where r <= ceil(k * 200 / (select sum(k) from t))")
def gc_background(spark, d):
    s = _seqs(spark, d)
    return M.gc_matched(s.where("score > 20"), s.where("score <= 20"), 200).select("feature")


_SITES = ", st as (select 'm' || (peak_id % 4) as motif, chrom, (\"start\" + \"end\") // 2 as pos, case when peak_id % 2 = 0 then '+' else '-' end as strand from peaks)"
_PROFILE = _W + _SITES + """, fg as (select "group", chrom, unnest(["start", "end" - 1]) as cut from f join gr on f.cell = gr.cell),
ps as (select motif, "group", st.chrom, pos, case when strand = '-' then pos - cut else cut - pos end as "offset", count(*) as n from fg join st on fg.chrom = st.chrom and cut between pos - 50 and pos + 50 group by 1, 2, 3, 4, 5),
ag as (select motif, "group", "offset", sum(n) as s, sum(n * n) as ss from ps group by 1, 2, 3), ns as (select motif, count(*) as n_sites from st group by 1),
gd as (select motif, n_sites, g."group", o as "offset" from ns, (select distinct "group" from gr) g, range(-50, 51) t(o)),
pf as (select gd.motif, gd."group", gd."offset", coalesce(s, 0) / n_sites as signal, sqrt(greatest((coalesce(ss, 0) - coalesce(s, 0) * coalesce(s, 0) / n_sites) / greatest(n_sites - 1, 1), 0) / n_sites) as se, n_sites from gd left join ag on gd.motif = ag.motif and gd."group" = ag."group" and gd."offset" = ag."offset")
"""


def _sites(spark, d):
    return table(spark, d, "peaks").select(F.concat(F.lit("m"), F.col("peak_id") % 4).alias("motif"), "chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("pos"), F.when(F.col("peak_id") % 2 == 0, "+").otherwise("-").alias("strand"))


def _profile(spark, d):
    return P.footprint_profile(V.frags(spark, d), _sites(spark, d), V.groups(spark, d), 50)


@query("get_footprints", _PROFILE + 'select motif, "group", "offset", round(signal, 6) as signal, round(se, 6) as se, n_sites from pf')
def footprints(spark, d):
    return _profile(spark, d).withColumns({"signal": F.round("signal", 6), "se": F.round("se", 6)})


@query("normalised_footprints", _PROFILE + ', fl as (select motif, "group", avg(signal) as fl from pf where abs("offset") > 40 group by 1, 2) select pf.motif, pf."group", "offset", round(signal / nullif(fl, 0), 5) as norm from pf join fl on pf.motif = fl.motif and pf."group" = fl."group"')
def normalised(spark, d):
    return P.normalise_profile(_profile(spark, d), 50, 10).select("motif", "group", "offset", F.round("norm", 5).alias("norm"))


_SCALES = (5, 9, 15, 21)
_MULTI = _PROFILE + ", " + ", ".join(f"""w{k} as (select motif, "group", {k} as scale, "offset", c, e - c as e from (select motif, "group", "offset",
  sum(signal * n_sites) over (partition by motif, "group" order by "offset" rows between {k // 2} preceding and {k // 2} following) as c, sum(signal * n_sites) over (partition by motif, "group" order by "offset" rows between {3 * k // 2} preceding and {3 * k // 2} following) as e from pf))""" for k in _SCALES) + ", ww as (" + " union all ".join(f"select * from w{k}" for k in _SCALES) + """),
lo as (select *, -log2((c + 1) / (e + 1) * (2 * scale) / scale) as v from ww), fl as (select motif, "group", scale, avg(v) as m from lo where abs("offset") > 50 * 0.75 group by 1, 2, 3),
ms as (select lo.motif, lo."group", lo.scale, "offset", case when e + c < 5 - 1e-9 then 0 else v - m end as value from lo join fl on lo.motif = fl.motif and lo."group" = fl."group" and lo.scale = fl.scale)
"""


@query("multi_scale_footprint", _MULTI + 'select motif, "group", scale, "offset", round(value, 5) + 0.0 as value from ms')
def multi_scale(spark, d):
    return P.multi_scale(_profile(spark, d), list(_SCALES)).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query("footprint_score", _MULTI + 'select motif, "group", round(avg(value), 5) + 0.0 as score from ms where abs("offset") <= 5 and scale between 9 and 21 group by 1, 2')
def footprint_score(spark, d):
    return P.footprint_score(P.multi_scale(_profile(spark, d), list(_SCALES)), 5, (9, 21)).withColumn("score", F.round("score", 5) + F.lit(0.0))


@query(
    "atacorrect",
    _W
    + """, ct as (select chrom, unnest(["start", "end" - 1]) as pos from f), n as (select feature as region, pos, count(*) as n from ct join p on ct.chrom = p.chrom and pos >= p."start" and pos < p."end" group by 1, 2),
pl as (select feature as region, unnest(range("start", "end")) as pos from p), a as (select pl.region, pl.pos, coalesce(n, 0) as n, 1 + pl.pos % 7 as b from pl left join n on pl.region = n.region and pl.pos = n.pos),
e as (select *, sum(n) over w * b / sum(b) over w as e from a window w as (partition by region order by pos rows between 50 preceding and 49 following)),
c as (select *, greatest(n - e, 0) as c from e) select region, pos, cast(n as double) as n, round(e, 6) as expected, round(case when sum(c) over (partition by region) > 0 then c * sum(n) over (partition by region) / sum(c) over (partition by region) else 0 end, 5) + 0.0 as corrected from c""",
)
def corrected(spark, d):
    from locusmill.operators.intervals import point_join
    from locusmill.operators.qc import cuts

    p = V.peaks(spark, d)
    n = point_join(cuts(V.frags(spark, d)).select("chrom", "pos"), p).groupBy(F.col("r_feature").alias("region"), "pos").agg(F.count(F.lit(1)).cast("double").alias("n"))
    place = p.select(F.col("feature").alias("region"), F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    counts = place.join(n, ["region", "pos"], "left").fillna(0.0, ["n"])
    c = P.corrected_signal(counts, place.withColumn("bias", 1.0 + F.col("pos") % 7))
    return c.withColumns({"expected": F.round("expected", 6), "corrected": F.round("corrected", 5) + F.lit(0.0)})


@query("position_weights", _SEQ.replace('"end", translate', '"end", score as score_, translate') + ", a as (select i - 1 as pos, substr(seq, i, 1) as base, count(*) as n from (select seq, unnest(range(1, length(seq) + 1)) as i from sq where score_ > 20) group by 1, 2), b as (select i - 1 as pos, substr(seq, i, 1) as base, count(*) as n from (select seq, unnest(range(1, length(seq) + 1)) as i from sq) group by 1, 2), ta as (select avg(t) as t from (select sum(n) as t from a group by pos)), tb as (select avg(t) as t from (select sum(n) as t from b group by pos)) select cast(a.pos as int) as pos, a.base, round(log2(((a.n + 1) / (ta.t + 4)) / ((b.n + 1) / (tb.t + 4))), 9) + 0.0 as weight from a join b on a.pos = b.pos and a.base = b.base, ta, tb")
def weights(spark, d):
    s = _seqs(spark, d)
    c = lambda x: x.select(F.posexplode(F.split("seq", "")).alias("pos", "base")).where("base <> ''").groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))
    return P.base_weights(c(s.where("score > 20")), c(s)).withColumn("weight", F.round("weight", 9) + F.lit(0.0))


@query("dinucleotide_counts", _SEQ + ", k as (select feature, i, substr(seq, i, 1) as b from (select feature, seq, unnest(range(1, length(seq) + 1)) as i from sq)) select cast(a.i as int) as m, cast(b.i as int) as n, a.b as base_m, b.b as base_n, count(*) as \"count\" from k a join k b on a.feature = b.feature and a.i < b.i group by 1, 2, 3, 4")
def dinucleotides(spark, d):
    return P.pair_counts(_seqs(spark, d))


@query("process_tfbs", _W + ", s as (select peak_id, 'm' || (peak_id % 10) as motif, round(greatest(0, score - 5), 5) as a, round(greatest(0, 40 - score), 5) as b from peaks where score is not null) select peak_id, motif, a, b, a > 10 as a_bound, b > 10 as b_bound, round(log2((a + 0.001) / (b + 0.001)), 6) as log2_fc from s where a > 0 or b > 0")
def tfbs(spark, d):
    return _scored(spark, d).withColumn("log2_fc", F.round("log2_fc", 6))


def _scored(spark, d):
    s = table(spark, d, "peaks").where("score is not null").select("peak_id", F.concat(F.lit("m"), F.col("peak_id") % 10).alias("motif"), (F.col("score") - 5).alias("a"), (40 - F.col("score")).alias("b"))
    return P.score_sites(s, "a", "b", {"a": 10.0, "b": 10.0})


@query("bindetect")
def bindetect(spark, d):
    s = materialize(_scored(spark, d), "sites")
    return P.differential_binding(s, s)


def _sites(spark, d):
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("term"), F.col("l_partkey").alias("region"), F.col("l_quantity").alias("score"))


def _edges(spark, d):
    return materialize(N.cooccurrence_network(_sites(spark, d), 0.01, 1), "edges")


@query("create_network", "with m as (select l_suppkey as t, l_partkey as r, max(l_quantity) as v from lineitem group by 1, 2), n as (select count(distinct r) as n from m), s as (select t, sum(v) as s, sum(v * v) as ss from m group by 1), c as (select 's' || a.t as a, 's' || b.t as b, a.t as ta, b.t as tb, count(*) as shared, sum(a.v * b.v) as xy from m a join m b on a.r = b.r and 's' || a.t < 's' || b.t group by 1, 2, 3, 4), r as (select a, b, shared, (n * xy - x.s * y.s) / sqrt((n * x.ss - x.s * x.s) * (n * y.ss - y.s * y.s)) as r from c join s x on x.t = ta join s y on y.t = tb, n) select a, b, shared, round(r, 6) as correlation from r where abs(r) >= 0.01")
def network(spark, d):
    return N.cooccurrence_network(_sites(spark, d), 0.01, 1).withColumn("correlation", F.round("correlation", 6))


_EDGES = SQL["create_network"].rsplit(" select a, b, shared", 1)[0] + ", ed as (select a, b, shared, r as correlation from r where abs(r) >= 0.01), bo as (select a, b, abs(correlation) as w from ed union all select b, a, abs(correlation) from ed) "
_REACH = "with recursive " + _EDGES.removeprefix("with ") + ", rc as (select distinct a as id, a as o from bo union select rc.id, bo.b from rc join bo on rc.o = bo.a), cm as (select id, min(o) as component from rc group by 1) "


@query("network_degrees", _EDGES + "select a as id, count(*) as degree, round(sum(w), 5) as strength from bo group by 1")
def degrees(spark, d):
    return N.degrees(N.cooccurrence_network(_sites(spark, d), 0.01, 1).withColumn("w", F.abs("correlation"))).withColumn("strength", F.round("strength", 5))


@query("network_components", _REACH + "select * from cm")
def comps(spark, d):
    return N.components(N.forest(N.cooccurrence_network(_sites(spark, d), 0.01, 1)))


@query(
    "network_clustering",
    _EDGES
    + """, dg as (select a as id, count(*) as degree from bo group by 1), tg as (select x.a as id, count(*) as triangles from bo x join bo y on x.a = y.a and x.b < y.b join bo z on z.a = x.b and z.b = y.b group by 1)
select dg.id, degree, coalesce(triangles, 0) as triangles, round(case when degree > 1 then coalesce(triangles, 0) / (degree * (degree - 1) / 2) else 0 end, 9) as clustering from dg left join tg on dg.id = tg.id""",
)
def triangles(spark, d):
    return N.triangles(_edges(spark, d)).withColumn("clustering", F.round("clustering", 9))


@query("network_metrics", _REACH + "select count(*) as nodes, count(distinct component) as components, (select count(*) from ed) as links, round(2 * (select count(*) from ed) / nullif(count(*) * (count(*) - 1), 0), 9) as density from cm")
def metrics(spark, d):
    return N.network_summary(_edges(spark, d)).withColumn("density", F.round("density", 9))


_RANKS = "".join(f", r{k + 1} as materialized (select bo.b as id, 0.15 / n + 0.85 * sum(rank / d) as rank from bo join r{k} on bo.a = r{k}.id join dg on bo.a = dg.a, nn group by bo.b, n)" for k in range(20))


@query("network_centrality", _EDGES + ", dg as (select a, count(*) as d from bo group by 1), nn as (select count(*) as n from dg), r0 as (select a as id, 1 / n as rank from dg, nn)" + _RANKS + " select id, round(rank, 9) as rank from r20")
def centrality(spark, d):
    return N.pagerank(_edges(spark, d)).withColumn("rank", F.round("rank", 9))


# native relational coverage


@query("left_outer_join", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey")
def left_outer(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("full_outer_join", "select s_suppkey, l_orderkey from supplier full join lineitem on s_suppkey = l_suppkey")
def full_outer(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "lineitem"), F.col("s_suppkey") == F.col("l_suppkey"), "full").select("s_suppkey", "l_orderkey")


@query("semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice > 100000)")
def anti(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 100000")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("rollup", "select l_returnflag, l_linestatus, sum(l_quantity) as q from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q"))


@query("cube", "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as s from lineitem group by cube (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("s"))


@query("ranking_windows", "select o_orderkey, rank() over w as r, dense_rank() over w as dr, ntile(4) over (partition by o_orderpriority order by o_totalprice, o_orderkey) as nt from orders window w as (partition by o_orderpriority order by o_totalprice)")
def ranking(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_orderpriority").orderBy("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(W.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey")).alias("nt"))


@query("intersect_except", "select * from (select l_partkey from lineitem where l_quantity < 5 intersect select l_partkey from lineitem where l_quantity > 45) except select p_partkey from part where p_size < 10")
def set_ops(spark, d):
    li = table(spark, d, "lineitem")
    a = li.where("l_quantity < 5").select("l_partkey").intersect(li.where("l_quantity > 45").select("l_partkey"))
    return a.subtract(table(spark, d, "part").where("p_size < 10").select("p_partkey"))


@query("pivot", "select l_returnflag, sum(l_quantity) filter (l_linestatus = 'O') as \"O\", sum(l_quantity) filter (l_linestatus = 'F') as \"F\" from lineitem group by 1")
def pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))


@query("json_and_time", "select date_trunc('day', ts) as day, sum(cast(json_extract_string(props, '$.k') as int)) as k, count(*) as n from events group by 1")
def json(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"))


@query("tumbling_windows", "select time_bucket(interval 6 hours, ts) as ws, event_type, count(*) as n from events group by 1, 2")
def tumbling(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("ws"), "event_type", "n")


@query("session_windows", "with a as (select user_id, ts, case when ts - lag(ts) over w <= interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)), b as (select *, sum(new) over (partition by user_id order by ts) as s from a) select user_id, min(ts) as ws, count(*) as n from b group by user_id, s")
def sessions(spark, d):
    from locusmill.streaming import session_counts

    s = session_counts(table(spark, d, "events"), "user_id", "ts", "6 hours")
    return s.select("user_id", F.col("session_window.start").alias("ws"), "n")


@query("stream_tile_counts", "select chrom, cast(floor(\"start\" / 5000) as bigint) as tile, cast(sum(\"count\") as bigint) as reads from fragments where loaded_at is not null and \"start\" is not null group by 1, 2 having sum(\"count\") is not null")
def stream(spark, d):
    """Tile counts of the fragments read as a stream, each batch's sums added to the totals in a table."""
    import uuid

    from locusmill.streaming import fragment_stream, latest_totals, upsert_totals
    from locusmill.util import shared_dir

    static = table(spark, d, "fragments")
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    src = fragment_stream(spark, f"{d}/fragments.parquet*", static.schema).where("loaded_at is not null and start is not null and count is not null")
    src = src.select("chrom", F.floor(F.col("start") / 5000).alias("tile"), F.col("count").cast("bigint").alias("reads"))
    q = src.writeStream.foreachBatch(lambda b, i: upsert_totals(b, f"{base}/totals", ["chrom", "tile"], "reads", i)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return latest_totals(spark, f"{base}/totals")


@query("scalar_names", "select p_partkey, regexp_replace(p_name, '[^a-zA-Z0-9_.\\-]', '_', 'g') as file, case when p_size * 100000 >= 1000000 then (p_size * 100000 // 1000000) || 'Mb' else (p_size * 100000 // 1000) || 'kb' end as len, split_part(p_name || '___x', '___', 1) as bc from part")
def names(spark, d):
    from locusmill.functions import cell_barcode, file_name, short_length

    return table(spark, d, "part").select("p_partkey", file_name("p_name").alias("file"), short_length(F.col("p_size") * 100000).alias("len"), cell_barcode(F.concat("p_name", F.lit("___x"))).alias("bc"))


_ZONE = """select gene, '{k}' as kind, chrom, greatest({a}, 0) as s, least({b}, mx) as e, mx from gz"""
_ANNOTATED = (
    _W
    + """, gz as (select gene, g.chrom, "start", "end", coalesce(strand <> '-', true) as plus, tss as t, mx from g join (select chrom as c, max("end") as mx from g group by 1) on g.chrom = c), zn as ("""
    + " union all ".join(
        _ZONE.format(k=k, a=a, b=b)
        for k, a, b in (
            ("promoter", "case when plus then t - 1000 else t - 100 end", "case when plus then t + 100 else t + 1000 end"),
            ("body", '"start"', '"end"'),
            ("up_distal", "case when plus then t - 200000 else t + 1000 end", "case when plus then t - 1000 else t + 200000 end"),
            ("down_distal", "case when plus then t + 1000 else t - 200000 end", "case when plus then t + 200000 else t - 1000 end"),
        )
    )
    + """), hz as (select feature, kind, gene, abs(p."start" + p."end" - s - e) as far from p join zn on p.chrom = zn.chrom and p."start" < e and p."end" > s and s < e where least(p."end", e) - greatest(p."start", s) > 0.9 * (p."end" - p."start")),
bz as (select feature, kind, arg_min(gene, struct_pack(a := far, b := gene)) as gene from hz group by 1, 2),
wz as (select feature, max(gene) filter (kind = 'promoter') as promoter, max(gene) filter (kind = 'body') as body, max(gene) filter (kind = 'down_distal') as down_distal, max(gene) filter (kind = 'up_distal') as up_distal from bz group by 1)
select p.feature, promoter, body, down_distal, up_distal, case when promoter is not null then 'promoter' when body is not null then 'body' when down_distal is not null then 'down_distal' when up_distal is not null then 'up_distal' else 'intergenic' end as kind,
coalesce(promoter, body, down_distal, up_distal) as near_gene from p left join wz on p.feature = wz.feature"""
)


@query("annotate_peaks", _ANNOTATED)
def annotate(spark, d):
    from locusmill.operators.annotate import annotate_peaks

    return annotate_peaks(V.peaks(spark, d), V.genes(spark, d))


@query("gene_annotation", "with g as (select *, row_number() over (partition by gene_id order by \"end\" - \"start\" desc, seqname, \"start\") as r from annotation where feature = 'gene' and gene_id is not null and seqname not in ('chrM', 'chrMT')) select gene_id as gene_name, seqname as chrom, \"start\", \"end\" from g where r = 1")
def gene_annotation(spark, d):
    from locusmill.sources import gene_annotation as op

    return op(table(spark, d, "annotation").withColumn("gene_name", F.col("gene_id"))).select("gene_name", "chrom", "start", "end")


@query("extract_peak_sequences", _W + ", gn as (select 'c' || (peak_id % 3) as chrom, string_agg(md5(label), '' order by peak_id) as seq from peaks group by 1), r as (select peak_id, 'c' || (peak_id % 3) as chrom, peak_id * 10 as s, peak_id * 10 + 25 as e from peaks) select peak_id, substr(translate(seq, '0123456789abcdef', 'ACGTACGTACGTACGT'), s + 1, 25) as seq from r join gn on r.chrom = gn.chrom where e <= length(seq)")
def extract(spark, d):
    p = table(spark, d, "peaks").withColumn("chrom", F.concat(F.lit("c"), F.col("peak_id") % 3))
    parts = p.groupBy("chrom").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("peak_id", F.md5("label").alias("m")))), lambda x: x["m"]), "").alias("s"))
    genome = parts.select("chrom", F.translate("s", "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))
    r = p.select("peak_id", "chrom", (F.col("peak_id") * 10).alias("start"), (F.col("peak_id") * 10 + 25).alias("end"))
    return M.extract_sequences(genome, r, key="peak_id").select("peak_id", "seq")


_DW = """, k as (select feature, score_, i, substr(seq, i, 1) as b from (select feature, score_, seq, unnest(range(1, length(seq) + 1)) as i from sq)),
pr as (select a.feature, a.score_, a.i as m, b.i as n, a.b as base_m, b.b as base_n from k a join k b on a.feature = b.feature and a.i < b.i),
"""


def _shares(name, where):
    return f"""{name}c as (select m, n, base_m, base_n, count(*) as c from pr {where} group by 1, 2, 3, 4), {name}t as (select *, sum(c) over (partition by m, n) as t, sum(c) over (partition by m, n, base_m) as a, sum(c) over (partition by m, n, base_n) as b from {name}c),
{name} as (select m, n, base_m, base_n, (c + greatest(16, t) * a * b / (t * t)) / (t + greatest(16, t)) as v from {name}t)"""


@query("dinucleotide_weights", _SEQ.replace('"end", translate', '"end", score as score_, translate') + _DW + _shares("xx", "where score_ > 20") + ", " + _shares("yy", "") + " select cast(xx.m as int) as m, cast(xx.n as int) as n, xx.base_m, xx.base_n, round(log2(xx.v / yy.v), 8) + 0.0 as weight from xx join yy on xx.m = yy.m and xx.n = yy.n and xx.base_m = yy.base_m and xx.base_n = yy.base_n")
def pair_weights(spark, d):
    s = _seqs(spark, d)
    return P.pair_weights(P.pair_counts(s.where("score > 20")), P.pair_counts(s)).withColumn("weight", F.round("weight", 8) + F.lit(0.0))


@query("network_communities")
def network_communities(spark, d):
    return N.communities(_edges(spark, d).select("a", "b", F.abs("correlation").alias("w")))


@query("is_symmetric", "with m as (select l_returnflag as a, l_linestatus as b, sum(l_quantity) as v from lineitem group by 1, 2), u as (select a, b, v from m union all select b, a, -v from m), d as (select a, b, abs(sum(v)) as d from u group by 1, 2) select max(d) <= 1e-9 as symmetric from d")
def symmetric(spark, d):
    from locusmill.operators.stats import is_symmetric

    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.sum("l_quantity").alias("value"))
    return is_symmetric(m)


@query("ks_test", "with g as (select o_orderpriority as g, floor(o_totalprice / 100) as v from orders where o_orderpriority in ('1-URGENT', '5-LOW')), n as (select count(*) filter (g = '1-URGENT') as a, count(*) filter (g = '5-LOW') as b from g), c as (select v, count(*) filter (g = '1-URGENT') as a, count(*) filter (g = '5-LOW') as b from g group by 1), s as (select sum(c.a) over (order by v) / n.a - sum(c.b) over (order by v) / n.b as d from c, n), x as (select max(abs(d)) as d, (sqrt(any_value(a) * any_value(b) / (any_value(a) + any_value(b))) + 0.12 + 0.11 / sqrt(any_value(a) * any_value(b) / (any_value(a) + any_value(b)))) * max(abs(d)) as x from s, n) select round(d, 9) as d, round(case when x < 0.2 then 1 else greatest(0, least(1, (select sum(2 * (-1) ** (k - 1) * exp(-2 * k * k * x * x)) from range(1, 101) t(k)))) end, 9) as p_value from x")
def ks(spark, d):
    from locusmill.operators.stats import ks_two_sample

    o = table(spark, d, "orders").withColumn("v", F.floor(F.col("o_totalprice") / 100))
    return ks_two_sample(o, "v", "o_orderpriority", "1-URGENT", "5-LOW").select(F.round("d", 9).alias("d"), F.round("p_value", 9).alias("p_value"))


@query(
    "quantile_ratio_factors",
    "with v as (select l_returnflag as sample, quantile_cont(l_extendedprice, [" + ", ".join(str(0.05 + 0.94 * i / 99) for i in range(100)) + "]) as v from lineitem where l_extendedprice > 0 group by 1), a as (select sample, unnest(range(0, 100)) as quantile, unnest(v) as value from v), t as (select *, avg(value) over (partition by quantile) as target from a) select sample, cast(quantile as int) as quantile, round(value, 5) as value, round(target, 5) as target, round(target / value, 8) as ratio from t",
)
def ratio_factors(spark, d):
    from locusmill.operators.stats import quantile_ratio_factors as op

    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_extendedprice").alias("value"))
    return op(x, n=100).withColumns({"value": F.round("value", 5), "target": F.round("target", 5), "ratio": F.round("ratio", 8)})
