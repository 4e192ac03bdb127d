import math
import random
from collections import defaultdict

import numpy as np
import pytest

from locusmill.llm import mixing as X
from locusmill.llm import packing as P
from locusmill.llm import tokens as T

LIMITS = "pack_name string, capacity_tokens int"


def texts(n, seed=0):
    r = random.Random(seed)
    words = ["river", "stone", "Straße", "año", "дом", "letter", "1904", "the", "of"]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 3, 40, 200, 900]))) for _ in range(n)]


def test_tokens_round_trip():
    for t in ["", "a  b\n\n c", "it's <|endoftext|> ok", "日本語 naïve\t\r\n", " " * 300, "don't 12345 !!!   "]:
        assert T.encoder().decode(T.encode(t)) == t
    assert T.encode(None) == []
    import re

    import regex

    p = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    s = " ".join(texts(20)) + "  x \n y'll  "
    assert [m.group() for m in regex.finditer(p, s)] == [m.group() for m in regex.finditer(T.PATTERN, s)]
    assert re is not None


def test_hilbert_is_a_bijection_of_unit_steps():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        g = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        k = P.hilbert_key(g, bits)
        assert sorted(k.tolist()) == list(range(len(g)))
        walk = g[np.argsort(k)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_packing_invariants(spark):
    docs = [(i, t, 1) for i, t in enumerate(texts(300))] + [(1000, None, 1), (1001, "same " * 50, 1), (1002, "same " * 50, 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_tokens int")
    lim = spark.createDataFrame([("a", 64), ("b", 1000), ("none", None)], LIMITS)
    rows = P.pack(df, lim).collect()
    size = {i: len(T.encode(t)) for i, t, _ in docs}
    for name, cap in (("a", 64), ("b", 1000)):
        own = [r for r in rows if r.pack_name == name]
        box, piece = defaultdict(int), defaultdict(list)
        for r in own:
            box[r.container_id] += r.token_to - r.token_from
            piece[r.doc_id].append((r.token_from, r.token_to))
        assert max(box.values()) <= cap
        assert set(piece) == set(size)
        for i, v in piece.items():
            v.sort()
            assert v[0][0] == 0 and v[-1][1] == size[i] and all(a[1] == b[0] for a, b in zip(v, v[1:], strict=False))
            assert len(v) == max(1, -(-size[i] // cap))  # cut only if it must be, and into full pieces
        total = sum(size.values())
        assert total / (cap * len([b for b in box if box[b]])) > 0.95
    assert {r.pack_name for r in rows} == {"a", "b"}
    assert P.pack(df.limit(0), lim).count() == 0
    rep = {r.pack_name: r for r in P.fill_report(P.pack(df, lim), lim).collect()}
    assert rep["a"].tokens == sum(size.values())


def test_temperature_weights():
    w, b, x = X.temperature_weights({"a": 1000, "b": 100, "c": 0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 4, "c": 3})
    assert x == 1 and b == 900 and w["a"] == pytest.approx(5 / 9) and "c" not in w
    w, b, x = X.temperature_weights({"a": 1000, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, budget=1000)
    assert 0 < x < 1 and w["b"] * 1000 <= 201.001 and sum(w.values()) == pytest.approx(1)
    w, _, x = X.temperature_weights({"a": 900, "b": 90, "c": 10}, target_entropy=0.9)
    assert X.entropy(w) == pytest.approx(0.9, abs=1e-6)
    w, _, x = X.temperature_weights({"a": 900, "b": 100}, max_repeats={"a": 1, "b": 3})
    assert w["b"] * 1000 <= 301 and x < 1
    assert X.temperature_weights({}, {"a": 1.0}, {"a": 1})[0] == {}


def test_mix_reaches_shares(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a"] * 6 + ["b"] * 3 + ["c", None, "other"]), r.randrange(0, 60), "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, repeats string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.15, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    out = X.mix(df, t).collect()
    got, size = defaultdict(int), {i: n for i, _, n, _ in rows}
    most = {"a": 1, "b": 2, "c": 3}
    for x in out:
        assert 1 <= x.repeats <= most[x.source] and size[x.doc_id] == x.n_tokens
        got[x.source] += x.repeats * x.n_tokens
    assert len({x.doc_id for x in out}) == len(out)
    total = sum(got.values())
    for k, v in {"a": 0.5, "b": 0.25, "c": 0.15}.items():
        assert got[k] / total == pytest.approx(v / 0.9, abs=0.002)
    rep = {x.source: x for x in X.share_report(X.mix(df, t), t).collect()}
    assert rep["gone"].tokens == 0 and rep["a"].actual_share == pytest.approx(got["a"] / total, abs=1e-5)
    assert X.mix(df.limit(0), t).count() == 0
    assert sorted(map(tuple, X.mix(df, t).collect())) == sorted(map(tuple, X.mix(df.repartition(7), t).collect()))


def test_wider_budgets_and_weights(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a"] * 8 + ["b"] * 2 + ["c"]), r.randrange(5, 60)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 3), ("c", 0.3, 4), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    have = defaultdict(int)
    for _, s, n in rows:
        have[s] += n
    _, base = X.draw_plan(df, t)
    got = defaultdict(int)
    for x in X.mix(df, t, budget=2 * base["budget"]).collect():
        got[x.source] += x.repeats * x.n_tokens
    most = {"a": 2, "b": 3, "c": 4}
    assert all(got[k] <= most[k] * have[k] for k in got)
    w = {(x.setting, x.source): x for x in X.weight_report(df, t).collect()}
    assert w["targets", "a"].exponent == 1 and 0 <= w["wide", "a"].exponent < 1 and 0 < w["entropy", "a"].exponent < 1
    for s in ("targets", "wide", "entropy", "limits"):
        own = {k: x for (q, k), x in w.items() if q == s}
        assert sum(x.weight for x in own.values()) == pytest.approx(1)
        assert own["a"].entropy == pytest.approx(X.entropy({k: x.weight for k, x in own.items()}))
    total = sum(got.values())
    assert all(got[k] / total == pytest.approx(w["wide", k].weight, abs=0.003) for k in most)
    natural = X.entropy({k: n / sum(have.values()) for k, n in have.items()})
    assert w["entropy", "a"].entropy == pytest.approx((natural + math.log(3)) / 2, abs=1e-6)
    assert sorted(map(tuple, X.mix(df, t, blocks=7).collect())) == sorted(map(tuple, X.mix(df.repartition(5), t, blocks=7).collect()))
