import random

from pyspark.sql import functions as F

from locusmill.operators import rejects
from locusmill.operators.clean import clean_chrom, clean_fragments
from locusmill.operators.forest import descendants, hierarchy, parent_of
from locusmill.operators.skewagg import heavy_keys, key_totals, tree_aggregate

BC = "ACGTACGTACGTACGT-1"
FRAG = "sample_id string, chrom string, start bigint, end bigint, barcode string, count int, loaded_at string"


def test_clean_chrom(spark):
    d = spark.createDataFrame([(x,) for x in (" CHR1 ", "1", "MT", "chrm", "x", "UN_a1", None, "chrUn_b7", "chr22")], "c string")
    assert [r[0] for r in d.select(clean_chrom("c")).collect()] == ["chr1", "chr1", "chrM", "chrM", "chrX", "chrUn_a1", None, "chrUn_b7", "chr22"]


def test_clean_fragments_folds_repeats(spark):
    r = [("s", "chr1", 1, 5, "b", 1, "t1"), ("s", "1", 1, 5, "b", None, "t2"), ("s", "chr1", 1, 5, "", 1, "t"), ("s", "chr1", 5, 5, "b", 1, "t"), ("s", "chr1", -1, 5, "b", 1, "t"), ("s", "chr1", None, 5, "b", 1, "t"), (None, "chr1", 1, 5, "b", 2, "t")]
    got = {tuple(x) for x in clean_fragments(spark.createDataFrame(r, FRAG)).collect()}
    assert got == {("s", "b", "chr1", 1, 5, 1), (None, "b", "chr1", 1, 5, 2)}
    assert clean_fragments(spark.createDataFrame([], FRAG)).count() == 0


def test_tree_aggregate_equals_plain(spark):
    k = F.when(F.col("id") < 3000, 0).when(F.col("id") % 7 == 6, None).otherwise(F.col("id") % 7)
    d = spark.range(5000).select(k.alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"), F.lit(1).alias("_chunk"))
    for chunks, fan in ((1, 2), (5, 2), (64, 8), (None, 2)):
        got = tree_aggregate(d.repartition(9), ["k"], {"n": F.count(F.lit(1)), "s": F.sum("v"), "m": F.max("v")}, {"n": "sum", "s": "sum", "m": "max"}, chunks, fan)
        want = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.max("v").alias("m"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert tree_aggregate(d.limit(0), ["k"], {"n": F.count(F.lit(1))}, {"n": "sum"}).count() == 0


def test_heavy_keys(spark):
    rows = [("s", "chr1" if i < 97 else "chr2", i, i + 1, "hot" if i < 60 else f"b{i}", 2, "t") for i in range(100)]
    t = key_totals(clean_fragments(spark.createDataFrame(rows, FRAG)))
    assert {tuple(r) for r in heavy_keys(t, {"barcode": 0.025, "chrom": 0.12}).select("key_field", "key_value", "n_fragment", "reads").collect()} == {("barcode", "hot", 60, 120), ("chrom", "chr1", 97, 194)}


def lines():
    good = f"chr1\t5\t9\t{BC}"
    return [
        (good, None), (good + "\t3", None), (good + "\tx", None), (good + "\r", None), (f'"chr1"\t"5"\t9\t"{BC}"', None), (f'"c\th""r"\t5\t9\t{BC}', None), (f"\t5\t9\t{BC}", None),
        (good + "\t", None), (f"chr1\t9223372036854775806\t9223372036854775807\t{BC}", None), (good + "\t99999999999999999999999", None), ("chré" + good[4:], None),
        (f'"chr1\t5\t9\t{BC}', "quoting"), (f'"chr1"x\t5\t9\t{BC}', "quoting"), (f'ch"r1\t5\t9\t{BC}', "quoting"), (good + '\t"', "quoting"), ('"', "quoting"),
        (f"chr1\t{'0' * 5000}5\t9\t{BC}", None), (good + "\t" + "7" * 5000, None), (f"chr1\t5\t{'9' * 5000}\t{BC}", "value"), (f"chr1\t{'1' * 5000}\t{'9' * 5000}\t{BC}", "value"),
        (f"chr1\t1234567890123456789\t1234567890123456790\t{BC}\t1234567890123456789", None), (good + "\t000000000000000000000002", None),
        ("chr1\t5\t9", "columns"), (good + "\t1\t2", "columns"), ("x", "columns"), (" ", "columns"), ("\r\r", "columns"),
        (f"chr1\t5\t5\t{BC}", "value"), (f"chr1\t-5\t9\t{BC}", "value"), (f"chr1\t+5\t9\t{BC}", "value"), (f"chr1\t 5\t9\t{BC}", "value"), (f"chr1\t٥\t9\t{BC}", "value"), (f"chr1\t\t9\t{BC}", "value"),
        (f"chr1\t5\t9223372036854775808\t{BC}", "value"), ("chr1\t5\t9\tACGT-1", "value"), (good[:-1], "value"), (good + "\n", "value"), (f"chr1\t5\n\t9\t{BC}", "value"), (good.lower(), "value"), (good + "\r\r", "value"),
    ]


def test_reject_reasons(spark):
    cases = lines() + [(f"c{'x' * 200_000}\t5\t9\t{BC}", None)]
    data = [(i, x, "extra", "r") for i, (x, _) in enumerate(cases)] + [(1000, "", "e", "r"), (1001, None, "e", "r"), (1002, "#c", "e", "r"), (1003, "\r", "e", "r")]
    df = spark.createDataFrame(data, "line_id bigint, line string, other string, reason string")
    got = {r.line_id: r for r in rejects.parse_fragments(df).collect()}
    assert {k: r.reason for k, r in got.items()} == {i: y for i, (_, y) in enumerate(cases)}
    assert got[1]["count"] == 3 and got[2]["count"] == 1 and got[5].chrom == 'c\th"r' and got[0].other == "extra"
    ok, bad = rejects.split_rejects(df)
    assert ok.count() == sum(y is None for _, y in cases) and bad.count() == sum(y is not None for _, y in cases)
    assert rejects.parse_fragments(df.limit(0)).count() == 0


def test_columnar_path_agrees_with_strict():
    import pyarrow as pa

    r = random.Random(4)
    pool = [x.removesuffix("\r") for x, _ in lines() if x.removesuffix("\r")] + [f"chr{i}\t{i}\t{i + 9}\t{BC}" for i in range(40)]
    for n in (1, 7, 40, 300):
        ls = [r.choice(pool[-40:]) if r.random() < 0.95 else r.choice(pool) for _ in range(n)]
        at, cols, single = rejects.parse_lines(pa.array(ls), 64)
        got = dict(zip(at.to_pylist(), zip(*(c.to_pylist() for c in cols), strict=True), strict=True)) | {i: v or reason for i, reason, v in single}
        assert got == {i: (v or reason) for i, x in enumerate(ls) for reason, v in [rejects.parse_strict(x)]}


def brute_tree(pairs):
    par = {}
    for i, p in pairs:
        if i is not None:
            par[i] = p if par.get(i) is None else min(x for x in (par[i], p) if x is not None)
    out = {}
    for x in par:
        path, at, y = [], {}, x
        while y not in at:
            at[y] = len(path)
            path.append(y)
            q = par[y]
            if q is None or q not in par:
                out[x] = (y, len(path) - 1, path[::-1])
                break
            y = q
        else:
            out[x] = (min(path[at[y] :]), -1, None)
    return out


def check_tree(spark, pairs):
    df = spark.createDataFrame([(i, p, "x", 1) for i, p in pairs], "id string, p string, depth string, size int")
    h = hierarchy(df, F.col("id"), F.col("p"))
    got = h.collect()
    want = brute_tree(pairs)
    assert {r.node_id: (r.root_id, r.depth, r.path) for r in got} == want and len(got) == len(want)
    pos = {r.node_id: r for r in got if r.depth >= 0}
    for r in pos.values():
        below = {x for x, (_, d, p) in want.items() if d >= 0 and r.node_id in p}
        assert {x.node_id for x in pos.values() if x.root_id == r.root_id and r.pre <= x.pre < r.pre + r.size} == below
    pairs_below = {(a, x): d - i for x, (_, d, p) in want.items() if d > 0 for i, a in enumerate(p[:-1])}
    assert {(r.node_id, r.descendant_id): r.steps for r in descendants(h, 3).collect()} == pairs_below
    bare = hierarchy(df, F.col("id"), F.col("p"), paths=False, places=False)
    assert {r.node_id: (r.root_id, r.depth) for r in bare.collect()} == {k: v[:2] for k, v in want.items()}


def test_hierarchy_random_with_loops(spark):
    r = random.Random(3)
    pairs = [(f"n{i}", f"n{r.randrange(i)}" if i and r.random() < 0.9 else None) for i in range(120)]
    pairs += [("a", "b"), ("b", "c"), ("c", "a"), ("t1", "a"), ("t2", "t1"), ("self", "self"), ("u", "self"), ("n3", None), ("n5", "n4"), (None, "n1"), ("orphan", "missing")]
    check_tree(spark, pairs)


def test_hierarchy_chain_star_and_empty(spark):
    check_tree(spark, [(f"c{i:03}", f"c{i - 1:03}" if i else None) for i in range(70)])
    check_tree(spark, [("root", None)] + [(f"k{i}", "root") for i in range(80)])
    check_tree(spark, [("x", "y"), ("y", "x")])
    check_tree(spark, [(f"l{i:02}", f"l{(i + 1) % 37:02}") for i in range(37)] + [(f"b{i:02}", f"b{i + 1:02}" if i < 29 else "l05") for i in range(30)])
    assert hierarchy(spark.createDataFrame([], "id string, p string"), F.col("id"), F.col("p")).count() == 0


def test_parent_of(spark):
    d = spark.createDataFrame([(x,) for x in (None, "", ".", "a", ",a,", " a , a", "., a")], "p string")
    assert [r[0] for r in d.select(parent_of("p")).collect()] == [None, None, None, "a", "a", "a", "a"]
