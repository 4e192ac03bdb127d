"""Registry of the named queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_CHROM = r"""case when c is null then null else 'chr' || case when c = 'mt' then 'M' when c in ('x', 'y', 'm') then upper(c)
  when left(c, 3) = 'un_' then 'Un_' || substr(c, 4) else c end end"""
#: CTE `clean` for SQL: clean fragments.
CLEAN_SQL = f"""named as (select *, regexp_replace(lower(trim(chrom)), '^chr', '') as c from fragments where barcode <> '' and "start" >= 0 and "start" < "end"),
clean as (select distinct sample_id, barcode, {_CHROM} as chrom, "start", "end", coalesce("count", 1) as "count" from named)"""
