"""The named queries. Importing a module of this package registers its queries."""

from __future__ import annotations

from locusmill.queries import cell_queries, found, interval_queries, matrix_queries, read_queries, sequence_queries, signal_queries, source_queries  # noqa: F401
from locusmill.queries.registry import QUERIES, SQL


def all_queries():
    return dict(QUERIES)


def all_sql():
    return dict(SQL)
