"""Region tables (chrom, start, end, name, score, strand): arithmetic, ordering, merging, subtracting, resolving, clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.operators.dyadic import periods
from locusmill.operators.intervals import overlap_join


#: Distances between sets that `cluster_names` takes to the driver.
MOST_PAIRS = 1_000_000

def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def region_label(chrom="chrom", start="start", end="end", strand=None) -> Column:
    """`chrom:start-end`, with `(strand)` if one is given."""
    s = F.concat(_c(chrom), F.lit(":"), _c(start), F.lit("-"), _c(end))
    return s if strand is None else F.concat(s, F.lit("("), _c(strand), F.lit(")"))


def parse_region(c: Column | str) -> Column:
    """Struct (chrom, start, end) of `chrom:start-end` or `chrom-start-end`; NULL where the text is neither."""
    x = F.regexp_replace(_c(c), r"^(.*)[:-](\d+)-(\d+)$", "$1\t$2\t$3")
    p = F.split(x, "\t")
    return F.when(F.size(p) == 3, F.struct(p[0].alias("chrom"), p[1].cast("bigint").alias("start"), p[2].cast("bigint").alias("end")))


def width(df: DataFrame) -> DataFrame:
    return df.withColumn("width", F.col("end") - F.col("start"))


def width_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy((F.col("end") - F.col("start")).alias("width")).agg(F.count(F.lit(1)).alias("n"))


def extend(df: DataFrame, bp: int) -> DataFrame:
    return df.withColumn("start", F.col("start") - bp).withColumn("end", F.col("end") + bp)


def set_width(df: DataFrame, bp: int) -> DataFrame:
    """Regions of bp bases around their middle. The odd base of an odd width lies upstream, by strand."""
    mid = (F.col("start") + F.col("end")) / 2
    up, down = -(-bp // 2), bp // 2
    minus = F.col("strand") == "-"
    s = F.when(minus, F.ceil(mid) - down).otherwise(F.floor(mid) - up)
    e = F.when(minus, F.ceil(mid) + up).otherwise(F.floor(mid) + down)
    return df.withColumn("_s", s).withColumn("end", e).withColumn("start", F.col("_s")).drop("_s")


def split_regions(df: DataFrame, length: int) -> DataFrame:
    """Regions cut into pieces of at most `length`; the last is short."""
    p = df.where(F.col("start") < F.col("end")).withColumn("_s", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(length).cast("bigint"))))
    return p.withColumn("end", F.least(F.col("_s") + length, "end")).withColumn("start", F.col("_s")).drop("_s")


def check_boundary(df: DataFrame, sizes: DataFrame, action: str = "cut") -> DataFrame:
    """Regions within their chromosome of sizes (chrom, length): `cut` trims, `remove` drops those that reach out, `exit` fails. Unknown chromosomes and empty rests are dropped."""
    j = df.join(F.broadcast(sizes.select(F.col("chrom"), F.col("length").alias("_len"))), "chrom")
    inside = (F.col("start") >= 0) & (F.col("end") <= F.col("_len"))
    if action == "remove":
        j = j.where(inside)
    elif action == "exit":
        j = j.withColumn("start", F.when(inside, F.col("start")).otherwise(F.raise_error(F.concat(F.lit("outside of its chromosome: "), region_label()))))
    else:
        j = j.withColumn("start", F.greatest("start", F.lit(0))).withColumn("end", F.least("end", "_len"))
    return j.where(F.col("start") < F.col("end")).select(*df.columns)


def keep_chroms(df: DataFrame, chroms: list[str]) -> DataFrame:
    return df.where(F.col("chrom").isin(chroms))


def remove_chroms(df: DataFrame, chroms: list[str]) -> DataFrame:
    return df.where(~F.col("chrom").isin(chroms))


def from_chrom_lengths(sizes: DataFrame) -> DataFrame:
    return sizes.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("length").cast("bigint").alias("end"))


def chroms_in_order(df: DataFrame, order: str) -> DataFrame:
    """Distinct chromosomes by first appearance in the order of a column."""
    return df.groupBy("chrom").agg(F.min(order).alias("first")).orderBy("first").select("chrom")


def loc_sort(df: DataFrame, contigs: list[str] | None = None) -> DataFrame:
    """By place: contigs in the order given, others before them and by name."""
    if contigs:
        rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(contigs) for x in (c, i)]), F.col("chrom")), F.lit(-1))
        return df.orderBy(rank, "chrom", "start", "end")
    return df.orderBy("chrom", "start", "end")


def score_sort(df: DataFrame, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), "chrom", "start", "end")


def first_regions(df: DataFrame, n: int) -> DataFrame:
    """The first n regions by place."""
    return loc_sort(df).limit(n)


def chunks(df: DataFrame, n: int) -> DataFrame:
    """df with `chunk` 0..n-1: contiguous chunks by place of equal size but for one row. Rows are numbered by range partitions, not in one task."""
    from locusmill.operators.stats import global_rank

    r = global_rank(df, ["chrom", "start", "end"])
    total = r.count()
    return r.withColumn("chunk", F.floor((F.col("rank") - 1) * n / max(1, total)).cast("int")).drop("rank")


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One row per (chrom, start, end, strand), the first by name."""
    w = W.partitionBy("chrom", "start", "end", "strand").orderBy("name")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_regions(df: DataFrame, keys: tuple[str, ...] = ("chrom",), touching: bool = False) -> DataFrame:
    """Union of overlapping regions per keys. Regions that only touch stay apart unless `touching`.

    Without `touching`, stretches are cut where no region spans the border: a border p inside of a stretch at which regions end and begin but which none covers on both
    sides. Doubling all coordinates and shortening each region by half a base makes that the ordinary union.
    """
    if touching:
        return periods(df, list(keys)).where(F.col("kind") != "gap").select(*keys, "start", "end")
    half = df.select(*keys, (F.col("start") * 2).alias("start"), (F.col("end") * 2 - 1).alias("end"))
    return periods(half, list(keys)).where(F.col("kind") != "gap").select(*keys, F.shiftright("start", 1).alias("start"), F.shiftright(F.col("end") + 1, 1).alias("end"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """The parts of a's regions that no region of b covers; a part keeps its region's other columns. Empty parts are dropped.

    b is first merged to disjoint stretches, so that the cuts of a region are ordered and its parts lie between them.
    """
    cuts = merge_regions(b.select("chrom", "start", "end"), touching=True)
    j = overlap_join(a.select("chrom", "start", "end").distinct(), cuts).groupBy("chrom", "start", "end").agg(F.array_sort(F.collect_list(F.struct(F.col("r_start").alias("s"), F.col("r_end").alias("e")))).alias("_c"))
    j = a.join(j, ["chrom", "start", "end"], "left")
    starts = F.concat(F.array("start"), F.transform("_c", lambda x: x["e"]))
    ends = F.concat(F.transform("_c", lambda x: x["s"]), F.array("end"))
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))
    parts = F.when(F.col("_c").isNull(), whole).otherwise(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))))
    return j.withColumn("_p", F.explode(parts)).withColumn("start", F.col("_p.s")).withColumn("end", F.col("_p.e")).where(F.col("start") < F.col("end")).select(*a.columns)


def overlap_totals(df: DataFrame) -> DataFrame:
    """(name, other, bp): total bases of each name (other = name) and bases that each two names share, in both orders. Regions of a name are merged first."""
    m = merge_regions(df, ("name", "chrom"))
    own = m.groupBy("name").agg(F.sum(F.col("end") - F.col("start")).alias("bp")).withColumn("other", F.col("name"))
    p = overlap_join(m, m).where(F.col("name") != F.col("r_name"))
    shared = p.groupBy("name", F.col("r_name").alias("other")).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("bp"))
    return own.select("name", "other", "bp").unionByName(shared.select("name", "other", "bp"))


def overlap_distance(totals: DataFrame) -> DataFrame:
    """(name, other, distance) from overlap_totals: the lesser of 1 - shared / total of the two names. Pairs that share nothing, at distance 1, are left out."""
    own = totals.where(F.col("name") == F.col("other")).select("name", F.col("bp").alias("t"))
    p = totals.where(F.col("name") != F.col("other")).join(own, "name").join(own.select(F.col("name").alias("other"), F.col("t").alias("t2")), "other")
    return p.select("name", "other", F.least(1 - F.col("bp") / F.col("t"), 1 - F.col("bp") / F.col("t2")).alias("distance"))


def cluster_names(distances: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(name, cluster, representative): average-linkage clusters of names, cut at the threshold. It runs on the driver and is meant for a few hundred sets; more than MOST_PAIRS distances are refused."""
    rows = distances.limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} distances between sets: linkage on the driver is for a few hundred sets")
    names = sorted({x for r in rows for x in (r.name, r.other)})
    d = {(r.name, r.other): r.distance for r in rows}
    groups = [[n] for n in names]
    dist = lambda a, b: sum(d.get((x, y), 1.0) for x in a for y in b) / (len(a) * len(b))
    while len(groups) > 1:
        v, i, j = min((dist(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if v > threshold:
            break
        groups[i] += groups.pop(j)
    out = []
    for k, g in enumerate(sorted(map(sorted, groups))):
        rep = min(g, key=lambda x: (sum(d.get((x, y), 1.0) for y in g if y != x), x))
        out += [(n, k, rep) for n in g]
    return distances.sparkSession.createDataFrame(out, "name string, cluster int, representative string")


def resolve_overlaps(df: DataFrame, higher: bool = True, score: str = "score") -> DataFrame:
    """Left to right, of two regions that overlap the one with the worse score goes (of equals the left one), until none overlap.

    Sequential within a run of overlapping regions and independent between runs, so rows are grouped by run (merged stretch), not by chromosome.
    """
    from locusmill.operators.peaks import by_run

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    names = df.columns

    def fold(p):
        p = p.sort_values(["run", "start", "end"], kind="stable")
        g, s, e = p["run"].tolist(), p["start"].tolist(), p["end"].tolist()
        v = (p[score].astype(float) * (1 if higher else -1)).tolist()
        kept: list[int] = []
        for i in range(len(p)):
            drop = False
            while kept and g[kept[-1]] == g[i] and e[kept[-1]] > s[i]:
                if v[kept[-1]] > v[i]:
                    drop = True
                    break
                kept.pop()
            if not drop:
                kept.append(i)
        return p.iloc[kept][names]

    return by_run(df, F.col("start"), F.col("end"), fold, types)
