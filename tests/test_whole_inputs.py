"""Queries over all rows and all places, against the SQL and plain counts."""

from collections import Counter
from itertools import combinations

import duckdb
import pytest

import __spark_entry__ as entry
from locusmill.queries.sequence_queries import _seqs
from locusmill.util import table

D = "/root/testdata/sf0.001"


def run(spark, name, d=D):
    return [tuple(r) for r in entry.queries()[name](spark, d).collect()]


def sql(name, d=D):
    c = duckdb.connect()
    for t in ("fragments", "peaks", "annotation", "cells", "lineitem"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    return c.execute(entry.oracle_sql()[name]).fetchall()


def same(a, b):
    """Equal as bags, numbers but for the last rounded digit."""
    assert len(a) == len(b)
    for x, y in zip(sorted(a), sorted(b)):
        assert [v for v in x if not isinstance(v, float)] == [v for v in y if not isinstance(v, float)]
        assert [v for v in x if isinstance(v, float)] == pytest.approx([v for v in y if isinstance(v, float)], abs=2e-4)


def test_quantile_normalize_takes_every_line(spark):
    got = run(spark, "quantile_normalize")
    n = table(spark, D, "lineitem").groupBy("l_linenumber").count().collect()
    assert Counter(r[0] for r in got) == {r.l_linenumber: r["count"] for r in n} and len(n) == 7
    same(got, sql("quantile_normalize"))


@pytest.mark.parametrize("name", ["motif_probabilities", "motif_information_content", "motif_consensus", "position_weights", "dinucleotide_counts"])
def test_sequence_queries_agree_with_sql(spark, name):
    same(run(spark, name), sql(name))


def test_dinucleotides_take_every_pair_of_places(spark):
    want = Counter()
    for r in _seqs(spark, D).select("seq").collect():
        want.update((m + 1, n + 1, r.seq[m], r.seq[n]) for m, n in combinations(range(64), 2))
    assert {r[:4]: r[4] for r in run(spark, "dinucleotide_counts")} == want
    assert len({r[:2] for r in run(spark, "dinucleotide_weights")}) == 2016


def test_motif_places(spark):
    assert {r[1] for r in run(spark, "motif_probabilities")} == set(range(64))
    assert {r[0] for r in run(spark, "position_weights")} == set(range(64))
    assert {len(r[1]) for r in run(spark, "motif_consensus")} == {64}
