"""Records of several sources mixed to target weights, small sources repeated within a limit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.util import materialize, small

#: Blocks of a pass over part of a source, or more, so that a block has about BLOCK_DOCS documents at most.
BLOCKS, BLOCK_DOCS = 4096, 1024


def _normal(w: dict[str, float]) -> dict[str, float]:
    s = sum(w.values())
    return {k: v / s for k, v in w.items()} if s > 0 else {}


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def _bisect(ok, steps: int = 60) -> float:
    """The greatest x in [0, 1] with ok(x), for ok that holds below some point."""
    if ok(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if ok(mid) else (lo, mid)
    return lo


def temperature_weights(
    tokens: dict[str, int],
    target: dict[str, float] | None = None,
    max_repeats: dict[str, int] | None = None,
    budget: int | None = None,
    target_entropy: float | None = None,
) -> tuple[dict[str, float], int, float]:
    """(normalised weights, budget in tokens, exponent) of the sources that have tokens.

    With targets, weights are target^x * natural^(1-x), natural being the sources' own token shares, and x is the greatest exponent in [0, 1] at which no source
    is used more than its max_repeats times; the default budget is the greatest at which the targets themselves hold (x = 1), and a budget beyond what all
    sources can supply is cut to that. A target whose source has no tokens is shared among the others in proportion.
    Without targets, weights are natural^x: x is bisected so that the weights' entropy is the target entropy (at least the natural one, at most that of
    equal weights), or is the smallest exponent that keeps every repetition limit.
    """
    have = {k: n for k, n in tokens.items() if n > 0}
    most = {k: (max_repeats or {}).get(k, 1) for k in have}
    natural = _normal({k: float(n) for k, n in have.items()})
    if target is not None:
        t = _normal({k: target.get(k) or 0.0 for k in have if (target.get(k) or 0) > 0 and most[k] > 0})
        if not t:
            return {}, 0, 1.0
        if budget is None:
            budget = math.floor(min(most[k] * have[k] / v for k, v in t.items()) + 1e-6)
        budget = min(budget, sum(most[k] * have[k] for k in t))
        mix = lambda x: _normal({k: v**x * natural[k] ** (1 - x) for k, v in t.items()})
        fits = lambda w: all(v * budget <= most[k] * have[k] * (1 + 1e-9) + 1 for k, v in w.items())
        x = _bisect(lambda x: fits(mix(x)))
        w = mix(x)
        if not fits(w):  # limits differ so much that no exponent keeps them all: the surplus goes to sources with room
            w = _capped(w, {k: most[k] * have[k] / budget for k in w})
        return w, budget, x
    budget = sum(have.values()) if budget is None else budget
    mix = lambda x: _normal({k: v**x for k, v in natural.items()})
    if target_entropy is not None:
        x = 1 - _bisect(lambda y: entropy(mix(1 - y)) <= target_entropy)
    else:
        x = 1 - _bisect(lambda y: all(v * budget <= most[k] * have[k] + 1 for k, v in mix(1 - y).items()))
    return mix(x), budget, x


def _capped(w: dict[str, float], cap: dict[str, float]) -> dict[str, float]:
    """w with no entry above its cap, the surplus shared in proportion among the entries below theirs."""
    full: set[str] = set()
    while True:
        rest = 1 - sum(cap[k] for k in full)
        free = _normal({k: v for k, v in w.items() if k not in full})
        now = {k: cap[k] if k in full else max(0.0, rest) * free[k] for k in w}
        over = {k for k in free if now[k] > cap[k] * (1 + 1e-12)}
        if not over:
            return now
        full |= over


def draw_plan(sized: DataFrame, targets: DataFrame, budget: int | None = None) -> tuple[dict[str, tuple[int, int]], dict]:
    """({source: (full passes, tokens of the last pass)}, details). Targets are settings, a few rows (source, target_share, max_repeats)."""
    rows = {r.source: r for r in targets.collect() if r.source is not None}
    names = list(rows)
    tokens = {r.source: int(r.n or 0) for r in sized.where(F.col("source").isin(names)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    w, total, x = temperature_weights(tokens, {k: r.target_share for k, r in rows.items()}, {k: int(r.max_repeats or 0) for k, r in rows.items()}, budget)
    plan = {}
    for k, v in w.items():
        b = min(round(v * total), int(rows[k].max_repeats) * tokens[k])
        plan[k] = (b // tokens[k], b % tokens[k])
    return plan, {"tokens": tokens, "budget": total, "exponent": x, "weights": w, "rows": rows}


def mix(sized: DataFrame, targets: DataFrame, key: str = "doc_id", budget: int | None = None, seed: int = 11, blocks: int | None = None) -> DataFrame:
    """The documents chosen: key, source, n_tokens, repeats. sized: key, source, n_tokens (unique key); targets: source, target_share, max_repeats.

    A source's budget is as many full passes over it as fit, and one pass over a part of it. For that pass documents fall into blocks by a hash,
    the blocks are permuted, whole blocks are taken up to the budget, and within the block that crosses it single documents, and one last
    document whose size comes closest to what is missing. A source without a target (or NULL) and documents without tokens are not chosen. The result depends on the keys and the seed alone.
    """
    spark = sized.sparkSession
    plan, _ = draw_plan(sized, targets, budget)
    if not plan:
        return sized.where(F.lit(False)).select(key, "source", "n_tokens", F.lit(1).alias("repeats"))
    if blocks is None:
        blocks = max(BLOCKS, -(-sized.count() // BLOCK_DOCS))
    plans = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in plan.items()], "source string, passes bigint, part bigint"))
    docs = sized.where(F.col("n_tokens") > 0).select(key, "source", "n_tokens").join(plans, "source")
    docs = docs.withColumn("_block", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(blocks)))
    sums = docs.groupBy("source", "part", "_block").agg(F.sum("n_tokens").alias("_n"))
    order = W.partitionBy("source").orderBy(F.xxhash64("_block", "source", F.lit(seed + 1)), "_block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).where(F.col("_before") < F.col("part"))
    sums = small(sums.select("source", "_block", "_before", (F.col("_before") + F.col("_n") <= F.col("part")).alias("_whole")))
    docs = docs.join(sums, ["source", "_block"], "left")
    whole = docs.where(F.coalesce("_whole", F.lit(True))).select(key, "source", "n_tokens", (F.col("passes") + F.col("_whole").isNotNull().cast("int")).alias("repeats"))
    edge = docs.where(~F.col("_whole"))
    in_edge = W.partitionBy("source").orderBy(F.xxhash64(F.col(key), F.lit(seed + 2)), key).rowsBetween(W.unboundedPreceding, 0)
    edge = edge.withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(in_edge)).select(key, "source", "n_tokens", (F.col("passes") + (F.col("_upto") <= F.col("part")).cast("int")).alias("repeats"))
    drawn = materialize(whole.unionByName(edge), "drawn")
    # what is still missing of each source's last pass is made up by the one document left whose size comes closest, if that helps
    short = drawn.join(plans, "source").groupBy("source", "passes").agg((F.first("part") - F.sum(F.col("n_tokens") * (F.col("repeats") - F.col("passes")))).alias("_miss"))
    left = drawn.join(F.broadcast(short), "source").where(F.col("repeats") == F.col("passes"))
    off = F.abs(F.col("n_tokens") - F.col("_miss"))
    best = left.where(off < F.col("_miss")).groupBy("source").agg(F.min(F.struct(off.alias("o"), F.col(key).alias("k")))["k"].alias("_pick"))
    drawn = drawn.join(F.broadcast(best), "source", "left").withColumn("repeats", F.col("repeats") + F.coalesce(F.col(key) == F.col("_pick"), F.lit(False)).cast("int"))
    return drawn.where("repeats > 0").select(key, "source", "n_tokens", F.col("repeats").cast("int").alias("repeats"))


def weight_report(sized: DataFrame, targets: DataFrame, wider: float = 2.0) -> DataFrame:
    """Per setting and source: natural and target share, weight, and the setting's exponent, entropy and budget in tokens.

    The settings: `targets` (the default budget, which the targets themselves fit), `wide` (`wider` times that budget: the exponent is bisected until every repetition limit holds),
    `entropy` (no targets: natural shares tempered until their entropy is halfway to that of equal shares) and `limits` (no targets, the budget of `wide`: the least tempering that keeps
    the repetition limits). Sources without tokens or without a row in targets have no row.
    """
    _, base = draw_plan(sized, targets)
    tokens, rows = base["tokens"], base["rows"]
    have = {k: n for k, n in tokens.items() if n > 0}
    natural = _normal({k: float(n) for k, n in have.items()})
    most = {k: int(rows[k].max_repeats or 0) for k in have}
    target = {k: rows[k].target_share for k in have}
    budget = round(base["budget"] * wider)
    half = (entropy(natural) + math.log(max(1, len(have)))) / 2
    settings = {
        "targets": (base["weights"], base["budget"], base["exponent"]),
        "wide": temperature_weights(tokens, target, most, budget),
        "entropy": temperature_weights(tokens, target_entropy=half),
        "limits": temperature_weights(tokens, max_repeats=most, budget=budget),
    }
    out = [(s, k, natural[k], float(target[k] or 0), float(w.get(k, 0.0)), float(x), entropy(w), int(b)) for s, (w, b, x) in settings.items() for k in sorted(have)]
    kinds = "setting string, source string, natural_share double, target_share double, weight double, exponent double, entropy double, budget bigint"
    return sized.sparkSession.createDataFrame(out, kinds)


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, documents, tokens drawn, greatest number of repeats, and actual_share of all tokens drawn."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["documents", "tokens", "most_repeats"])
    return out.withColumn("actual_share", F.round(F.col("tokens") / F.nullif(F.sum("tokens").over(W.partitionBy()), F.lit(0)), 6))
