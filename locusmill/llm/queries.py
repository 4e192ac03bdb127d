"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.llm import distinct, hnsw, lookalike, mcl, mixing, packing, tokens
from locusmill.operators.clean import clean_fragments
from locusmill.queries.registry import CLEAN_SQL
from locusmill.util import materialize, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _peak_terms(spark, d):
    terms = distinct.record_terms(clean_fragments(table(spark, d, "fragments")), table(spark, d, "peaks"))
    return distinct.distinctive(terms, ["sample_id", "barcode"], "peak_id", F.col("weight") / F.col("total"))


_TERMS = f"""with {CLEAN_SQL},
w as (select c.sample_id, c.barcode, p.peak_id, p.chrom, p."start" as p_start, sum(c."count") as weight from clean c join peaks p
  on c.chrom = p.chrom and c."start" < p."end" and c."end" > p."start" group by all),
cells as (select sample_id, barcode, count(*) as n_fragment from clean group by 1, 2),
t as (select *, sum(weight) over (partition by sample_id, barcode) as total,
  count(*) over (partition by sample_id, barcode, chrom order by p_start range between 5000000 preceding and 5000000 following) - 1 as degree from w),
d as (select peak_id, count(*) as with_term from w group by 1),
s as (select t.*, n_fragment, with_term, (select count(*) from cells) as records from t join d on t.peak_id = d.peak_id
  join cells c on t.sample_id = c.sample_id and t.barcode = c.barcode)
"""


@query("p1_found", _TERMS + "select sample_id, barcode, peak_id from s where n_fragment >= 20 and weight / total * ln(records / with_term) >= 1.0")
def p1_found(spark, d):
    return _peak_terms(spark, d).where((F.col("n_fragment") >= 20) & (F.col("tf_score") >= 1.0)).select("sample_id", "barcode", "peak_id")


@query(
    "p1_scores",
    _TERMS
    + """select sample_id, barcode, peak_id, cast(weight as bigint) as weight, degree, with_term, round(degree * ln(records / with_term), 6) as score,
round(weight / total * ln(records / with_term), 6) as tf_score from s""",
)
def p1_scores(spark, d):
    """Every peak that a cell touches, with its graph-of-words score and its frequency score."""
    cols = ["sample_id", "barcode", "peak_id", "weight", "degree", "with_term"]
    return _peak_terms(spark, d).select(*cols, F.round("score", 6).alias("score"), F.round("tf_score", 6).alias("tf_score"))


@query(
    "p1_words",
    r"""with t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents), u as (select doc_id, unnest(w) as term, unnest(range(0, len(w))) as at from t),
f as (select doc_id, term, count(*) as frequency from u group by 1, 2), e as (select distinct a.doc_id, a.term, b.term as other from u a join u b on a.doc_id = b.doc_id and b.at - a.at between 1 and 3 and a.term <> b.term),
g as (select doc_id, term, count(distinct other) as degree from (select * from e union all select doc_id, other, term from e) group by 1, 2), d as (select term, count(*) as n from f group by 1)
select f.doc_id, f.term, frequency, coalesce(degree, 0) as degree, round(coalesce(degree, 0) * ln((select count(*) from documents) / d.n), 6) as score from f join d on f.term = d.term left join g on f.doc_id = g.doc_id and f.term = g.term""",
)
def p1_words(spark, d):
    """Graph-of-words score of every word of every document."""
    t = distinct.text_terms(table(spark, d, "documents"))
    return distinct.distinctive(t, ["doc_id"], "term").select("doc_id", "term", "frequency", "degree", F.round("score", 6).alias("score"))


def _run(spark, d, name):
    return next(r for r in table(spark, d, "neighbors_params").collect() if r.run_name == name)


def _nearest(spark, d):
    p = _run(spark, d, "knn")
    rows = table(spark, d, "cell_vectors").where(F.col("use_rep") == p.use_rep)
    if p.metric not in ("euclidean", "cosine"):
        raise ValueError(f"the index knows the metrics euclidean and cosine, not {p.metric!r}")
    return hnsw.knn(hnsw.usable_vectors(rows, unit=p.metric == "cosine"), p.n_neighbors)


_USABLE = """with v as (select cell_id, any_value(vec)::double[] as vec from cell_vectors where use_rep = '{rep}' and vec is not null and list_sum(list_transform(vec, lambda x: abs(x))) > 0
  and not list_bool_or(list_transform(vec, lambda x: isnan(x))) group by 1)"""


@query(
    "p4_found",
    _USABLE.format(rep="X_pca")
    + """, n as (select a.cell_id as a, b.cell_id as b, row_number() over (partition by a.cell_id order by list_distance(a.vec, b.vec), b.cell_id) as r from v a join v b on a.cell_id <> b.cell_id)
select distinct least(a, b) as cell_a, greatest(a, b) as cell_b from n where r <= 10""",
)
def p4_found(spark, d):
    return hnsw.neighbour_pairs(_nearest(spark, d))


@query("p4_neighbours")
def p4_neighbours(spark, d):
    """The nearest cells of every cell, with distances."""
    return _nearest(spark, d).select(F.col("id").alias("cell_id"), "neighbour", "distance")


def _clusters(spark, d, find=mcl.cluster_vectors):
    p = _run(spark, d, "clusters")
    rows = table(spark, d, "cell_vectors").where(F.col("use_rep") == p.use_rep)
    return find(hnsw.usable_vectors(rows, unit=True), 0.8, p.n_neighbors)


@query("p5_found", _USABLE.format(rep="X_iterative_lsi") + " select a.cell_id as cell_a, b.cell_id as cell_b from v a join v b on a.cell_id < b.cell_id and list_cosine_similarity(a.vec, b.vec) >= 0.8")
def p5_found(spark, d):
    c = _clusters(spark, d, mcl.cluster_members).select("id", "cluster")
    other = c.select(F.col("id").alias("cell_b"), "cluster")
    return c.select(F.col("id").alias("cell_a"), "cluster").join(other, "cluster").where(F.col("cell_a") < F.col("cell_b")).select("cell_a", "cell_b")


@query("p5_clusters")
def p5_clusters(spark, d):
    """Every cluster with its size, most typical cells and prevailing label."""
    p = _run(spark, d, "clusters")
    said = table(spark, d, "cells").select(F.col("cell_id").alias("id"), F.lower(F.trim(p.cluster_key)).alias("label")).distinct()
    return mcl.cluster_report(materialize(_clusters(spark, d), "clusters"), said)


@query("p8_pack")
def p8_pack(spark, d):
    """Every document's place in the containers of each capacity."""
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_limits"))


@query("p8_fill")
def p8_fill(spark, d):
    """Space used in the containers of each capacity."""
    return packing.fill_report(p8_pack(spark, d), table(spark, d, "pack_limits"))


def _sized(spark, d):
    return materialize(tokens.with_token_counts(table(spark, d, "documents"), keep=["doc_id", "source"]), "sized")


@query("p9_mix")
def p9_mix(spark, d):
    """The documents chosen, with their number of repeats."""
    return mixing.mix(_sized(spark, d), table(spark, d, "source_targets"))


@query("p9_shares")
def p9_shares(spark, d):
    """Target and actual share of every source."""
    return mixing.share_report(p9_mix(spark, d), table(spark, d, "source_targets"))


def _wide(spark, d):
    """Twice the budget that the targets fit, so that the exponent has to be bisected."""
    sized, targets = _sized(spark, d), table(spark, d, "source_targets")
    _, base = mixing.draw_plan(sized, targets)
    return mixing.mix(sized, targets, budget=2 * base["budget"])


@query("p9_mix_wide")
def p9_mix_wide(spark, d):
    """The documents chosen for twice that budget: small sources are at their repetition limits, and tempered weights make up for them."""
    return _wide(spark, d)


@query("p9_shares_wide")
def p9_shares_wide(spark, d):
    return mixing.share_report(_wide(spark, d), table(spark, d, "source_targets"))


@query("p9_weights")
def p9_weights(spark, d):
    """Natural and target shares, tempered weights, exponents and entropies for four settings of the mixture."""
    return mixing.weight_report(_sized(spark, d), table(spark, d, "source_targets"))


@query("p10_found")
def p10_found(spark, d):
    return lookalike.look_alike_pairs(table(spark, d, "documents"))


@query("p10_texts")
def p10_texts(spark, d):
    """Every document with its text in one form."""
    return lookalike.one_form(table(spark, d, "documents").select("doc_id", "text"))
