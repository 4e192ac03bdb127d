"""Queries of the general data problems: periods and gaps, failing lines, hierarchies, heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.operators.clean import clean_fragments, valid_fragments
from locusmill.operators.dyadic import periods
from locusmill.operators.forest import hierarchy, parent_of
from locusmill.operators.rejects import parse_fragments
from locusmill.operators.skewagg import heavy_keys, key_totals
from locusmill.queries.registry import CLEAN_SQL, SQL, query
from locusmill.util import materialize, table

CELL = ["sample_id", "barcode", "chrom"]

_STRETCHES = f"""with {CLEAN_SQL},
iv as (select distinct sample_id, barcode, chrom, "start", "end" from clean),
m as (select *, max("end") over (partition by sample_id, barcode, chrom order by "start", "end" rows between unbounded preceding and 1 preceding) as pe from iv),
i as (select *, sum(case when pe is null or "start" > pe then 1 else 0 end) over (partition by sample_id, barcode, chrom order by "start", "end") as isl from m),
st as (select sample_id, barcode, chrom, min("start") as s, max("end") as e, count(*) as n from i group by sample_id, barcode, chrom, isl),
g as (select *, lead(s) over (partition by sample_id, barcode, chrom order by s) as nx from st)
"""


def cell_periods(spark: SparkSession, d: str) -> DataFrame:
    return periods(valid_fragments(table(spark, d, "fragments"), ()), CELL)


@query(
    "p2_found",
    _STRETCHES
    + """select sample_id, barcode, chrom, 'covered' as kind, s as "start", e as "end" from st where n > 1
union all select sample_id, barcode, chrom, 'gap', e, nx from g where nx - e <= 1000""",
)
def p2_found(spark, d):
    return cell_periods(spark, d).where((F.col("kind") == "covered") | ((F.col("kind") == "gap") & (F.col("end") - F.col("start") <= 1000)))


@query(
    "p2_periods",
    _STRETCHES
    + """select sample_id, barcode, chrom, case when n > 1 then 'covered' else 'single' end as kind, s as "start", e as "end" from st
union all select sample_id, barcode, chrom, 'gap', e, nx from g where nx is not null""",
)
def p2_periods(spark, d):
    """All covered stretches and all gaps of every cell and chromosome."""
    return cell_periods(spark, d)


@query("p2_periods_tiled", SQL["p2_periods"])
def p2_periods_tiled(spark, d):
    """The same as p2_periods with a low bound for entities that are cut into tiles, so that the way for very large ones runs on every input."""
    return periods(valid_fragments(table(spark, d, "fragments"), ()), CELL, hot_rows=200)


_PARSED = r"""with l as (select line_id, sample_id, case when right(line, 1) = chr(13) then left(line, length(line) - 1) else line end as t from raw_fragments),
r as (select *, regexp_extract_all(chr(9) || t, '\t("(?:[^"]|"")*"|[^"\t]*)', 1) as q,
  regexp_full_match(t, '(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') as quoted
  from l where t <> '' and left(t, 1) <> '#'),
f as (select line_id, sample_id, quoted, list_transform(q, lambda x: case when left(x, 1) = '"' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end) as f from r),
v as (select *, case when not quoted then 'quoting' when len(f) not in (4, 5) then 'columns'
  when coalesce(regexp_full_match(f[2], '[0-9]+') and regexp_full_match(f[3], '[0-9]+') and regexp_full_match(f[4], '[ACGT]{16}-[0-9]+')
    and try_cast(f[2] as bigint) < try_cast(f[3] as bigint), false) then null else 'value' end as reason from f)
"""


@query("p3_found", _PARSED + "select line_id, reason from v where reason is not null")
def p3_found(spark, d):
    return parse_fragments(table(spark, d, "raw_fragments"), keep=["line_id"]).where(F.col("reason").isNotNull()).select("line_id", "reason")


@query(
    "p3_valid",
    _PARSED
    + """select line_id, sample_id, f[1] as chrom, cast(f[2] as bigint) as "start", cast(f[3] as bigint) as "end", f[4] as barcode,
case when len(f) = 5 and regexp_full_match(f[5], '[0-9]+') then coalesce(try_cast(f[5] as bigint), 1) else 1 end as "count" from v where reason is null""",
)
def p3_valid(spark, d):
    """The valid fragments of the raw lines."""
    return parse_fragments(table(spark, d, "raw_fragments")).where(F.col("reason").isNull()).drop("reason")


_TREE = r"""with recursive n0 as (select coalesce(feature_id, transcript_id, gene_id) as id,
  list_filter(regexp_split_to_array(parents, '[,\s]+'), lambda x: x <> '' and x <> '.')[1] as p from annotation),
n1 as (select id, min(p) as p from n0 where id is not null group by id),
n as (select a.id, b.id as p from n1 a left join n1 b on a.p = b.id),
t as (select id as node_id, id as root_id, 0 as depth, [id] as path from n where p is null
  union all select n.id, t.root_id, t.depth + 1, list_append(t.path, n.id) from t join n on n.p = t.node_id),
u as (select n.id, n.p from n where n.id not in (select node_id from t)),
w as (select id, p as a from u union select w.id, u.p from w join u on w.a = u.id),
cyc as (select id from w where id = a),
lo as (select w.id, min(w.a) as root_id from w join cyc on w.a = cyc.id group by w.id)
"""


def _own():
    return F.coalesce("feature_id", "transcript_id", "gene_id")


@query("p6_found", _TREE + "select node_id, root_id, depth from t union all select id, root_id, -1 from lo")
def p6_found(spark, d):
    return hierarchy(table(spark, d, "annotation"), _own(), parent_of("parents"), paths=False, places=False).select("node_id", "root_id", "depth")


@query(
    "p6_paths",
    _TREE
    + """, sz as (select a as node_id, count(*) as size from (select unnest(path) as a from t) group by 1)
select t.node_id, root_id, depth, array_to_string(path, '/') as path, size from t join sz on t.node_id = sz.node_id""",
)
def p6_paths(spark, d):
    """Path and number of descendants (itself included) of every feature outside of loops."""
    h = hierarchy(table(spark, d, "annotation"), _own(), parent_of("parents"), places=False)
    return h.where("depth >= 0").select("node_id", "root_id", "depth", F.array_join("path", "/").alias("path"), "size")


@query(
    "p6_descendants",
    _TREE + "select path[i] as node_id, node_id as descendant_id, cast(depth + 1 - i as int) as steps from (select *, unnest(range(1, depth + 1)) as i from t)",
)
def p6_descendants(spark, d):
    """Every feature with each of its descendants, looked up by its interval of preorder places."""
    from locusmill.operators.forest import descendants

    return descendants(hierarchy(table(spark, d, "annotation"), _own(), parent_of("parents"), paths=False))


_TOTALS = f"""with {CLEAN_SQL},
k as (select sample_id, 'barcode' as key_field, barcode as key_value, count(*) as n_fragment, cast(sum("count") as bigint) as reads from clean group by 1, 2, 3
  union all select sample_id, 'chrom', chrom, count(*), cast(sum("count") as bigint) from clean group by 1, 2, 3)
"""


@query(
    "p7_found",
    _TOTALS
    + """, a as (select sample_id, count(*) as n from clean group by 1)
select k.sample_id, key_field, key_value from k join a on k.sample_id = a.sample_id
where n_fragment * 1000 >= n * case key_field when 'barcode' then 25 else 120 end""",
)
def p7_found(spark, d):
    totals = materialize(key_totals(clean_fragments(table(spark, d, "fragments"))), "totals")  # read twice
    return heavy_keys(totals, {"barcode": 0.025, "chrom": 0.12}).select("sample_id", "key_field", "key_value")


@query("p7_totals", _TOTALS + "select * from k")
def p7_totals(spark, d):
    """Clean fragments and summed count of every barcode and chromosome of each sample."""
    return key_totals(clean_fragments(table(spark, d, "fragments")))
