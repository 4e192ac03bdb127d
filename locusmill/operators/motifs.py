"""Motifs: file formats, matrices, thresholds, scanning, similarity, clustering, enrichment and the hit table.

A motif library is a setting of a few hundred small matrices and lives on the driver; sequences and hits are tables. `long_table` gives a library as rows
(motif, name, pos, base, count) for matrix arithmetic in SQL.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locusmill.operators.intervals import overlap_join
from locusmill.operators.stats import log_binom_sf, numpy_bh, rank_within, seeded

BASES = "ACGT"


@dataclass
class Motif:
    """counts is 4 x length, rows in the order A, C, G, T."""

    id: str
    name: str
    counts: np.ndarray
    bg: np.ndarray = field(default_factory=lambda: np.full(4, 0.25))
    threshold: float | None = None

    @property
    def length(self) -> int:
        return self.counts.shape[1]

    def pfm(self) -> np.ndarray:
        return self.counts / self.counts.sum(0)

    def ppm(self, pseudo: float = 1.0) -> np.ndarray:
        c = self.counts + pseudo
        return c / c.sum(0)

    def pwm(self, pseudo: float = 1.0) -> np.ndarray:
        """log2 of probability over background."""
        return np.log2(self.ppm(pseudo) / self.bg[:, None])

    def pssm(self, ps: float = 0.01) -> np.ndarray:
        """ln of smoothed probability over background."""
        p = self.pfm() + ps * self.bg[:, None]
        return np.nan_to_num(np.log(p / p.sum(0)) - np.log(self.bg[:, None]))

    def bits(self, ps: float = 0.01) -> np.ndarray:
        p = self.pfm()
        return p * (np.log2(p + ps) - np.log2(self.bg[:, None] + ps))

    def information(self) -> np.ndarray:
        p = self.pfm()
        return 2 + np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(0)

    def gc(self) -> float:
        return float((self.pfm()[1] + self.pfm()[2]).mean())

    def consensus(self, least: float = 0.5) -> str:
        p = self.pfm()
        return "".join(BASES[i] if p[i, j] >= least else "N" for j, i in enumerate(p.argmax(0)))

    def reverse(self) -> Motif:
        return Motif(self.id, self.name, self.counts[::-1, ::-1].copy(), self.bg[::-1].copy(), self.threshold)

    def cut_off(self, p: float = 1e-4, ps: float = 0.01, steps: int = 1000) -> float:
        """Least score whose tail probability under the background is at most p, by convolution over scores rounded to 1/steps of their range."""
        m = self.pssm(ps)
        lo, hi = m.min(0).sum(), m.max(0).sum()
        unit = max((hi - lo) / steps, 1e-9)
        dist = np.array([1.0])
        for j in range(self.length):
            k = np.round((m[:, j] - m[:, j].min()) / unit).astype(int)
            new = np.zeros(len(dist) + k.max())
            for b in range(4):
                new[k[b] : k[b] + len(dist)] += self.bg[b] * dist
            dist = new
        tail = dist[::-1].cumsum()[::-1]
        at = np.flatnonzero(tail <= p)
        return float(lo + (at[0] if len(at) else len(dist)) * unit)


# reading and writing


def guess_format(text: str) -> str:
    """jaspar, pfm, meme, transfac or homer."""
    if re.search(r"^MEME version", text, re.M):
        return "meme"
    if re.search(r"^(AC|ID|XX)\b", text, re.M):
        return "transfac"
    if re.search(r"^\s*A\s+\[", text, re.M):
        return "jaspar"
    body = [x for x in text.splitlines() if x and not x.startswith((">", "#"))]
    rows = [len(x.split()) for x in body]
    heads = sum(x.startswith(">") for x in text.splitlines())
    if heads and len(body) == 4 * heads and not (rows and all(r == 4 for r in rows) and "\t" in text.split("\n")[0]):
        return "pfm"
    return "homer" if rows and all(r == 4 for r in rows) else "pfm"


def parse(text: str, form: str | None = None) -> list[Motif]:
    form = form or guess_format(text)
    out: list[Motif] = []
    if form in ("jaspar", "pfm"):
        for part in re.split(r"^>", text, flags=re.M)[1:]:
            head, *rows = [x for x in part.splitlines() if x.strip()]
            ids = head.split(None, 1)
            m = np.array([[float(v) for v in re.findall(r"-?\d+\.?\d*(?:[eE]-?\d+)?", re.sub(r"^\s*[ACGT]\b", "", r))] for r in rows[:4]])
            out.append(Motif(ids[0], ids[1].strip() if len(ids) > 1 else ids[0], m))
    elif form == "meme":
        for part in re.split(r"^MOTIF\s+", text, flags=re.M)[1:]:
            head, *rows = part.splitlines()
            ids = head.split()
            sites = re.search(r"nsites=\s*([\d.]+)", part)
            m = np.array([[float(v) for v in r.split()] for r in rows if re.fullmatch(r"\s*(?:[\d.eE+-]+\s+){3}[\d.eE+-]+\s*", r)]).T
            out.append(Motif(ids[0], ids[1] if len(ids) > 1 else ids[0], m * (float(sites[1]) if sites else 1.0)))
    elif form == "transfac":
        for part in re.split(r"^//\s*$", text, flags=re.M):
            ident = re.search(r"^(?:AC|ID)\s+(\S+)", part, re.M)
            rows = re.findall(r"^\d+\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)\s+([\d.]+)", part, re.M)
            if ident and rows:
                name = re.search(r"^NA\s+(\S+)", part, re.M)
                out.append(Motif(ident[1], name[1] if name else ident[1], np.array(rows, float).T))
    else:
        for part in re.split(r"^>", text, flags=re.M)[1:]:
            head, *rows = [x for x in part.splitlines() if x.strip()]
            h = head.split("\t")
            t = float(h[2]) if len(h) > 2 and re.fullmatch(r"-?[\d.]+", h[2]) else None
            out.append(Motif(h[0], h[1] if len(h) > 1 else h[0], np.array([[float(v) for v in r.split()] for r in rows]).T, threshold=t))
    return out


def render(motifs: list[Motif], form: str = "jaspar") -> str:
    num = lambda v: f"{v:.6g}"
    if form == "meme":
        s = "MEME version 4\n\nALPHABET= ACGT\n\nstrands: + -\n\nBackground letter frequencies\nA 0.25 C 0.25 G 0.25 T 0.25\n\n"
        for m in motifs:
            s += f"MOTIF {m.id} {m.name}\nletter-probability matrix: alength= 4 w= {m.length} nsites= {num(m.counts.sum(0).mean())} E= 0\n"
            s += "".join(" ".join(f"{v:.6f}" for v in col) + "\n" for col in m.pfm().T) + "\n"
        return s
    if form == "transfac":
        return "".join(f"AC {m.id}\nXX\nNA {m.name}\nXX\nP0 A C G T\n" + "".join(f"{j + 1:02d} " + " ".join(map(num, c)) + "\n" for j, c in enumerate(m.counts.T)) + "XX\n//\n" for m in motifs)
    if form == "homer":
        return "".join(f">{m.id}\t{m.name}\t{num(m.threshold or 0.0)}\n" + "".join("\t".join(f"{v:.4f}" for v in c) + "\n" for c in m.pfm().T) for m in motifs)
    row = (lambda b, r: f"{b} [ {' '.join(map(num, r))} ]\n") if form == "jaspar" else (lambda b, r: " ".join(map(num, r)) + "\n")
    return "".join(f">{m.id}\t{m.name}\n" + "".join(row(b, r) for b, r in zip(BASES, m.counts, strict=True)) + "\n" for m in motifs)


def read_motifs(path: str, form: str | None = None) -> list[Motif]:
    with open(path) as f:
        return parse(f.read(), form)


def write_motifs(motifs: list[Motif], path: str, form: str = "jaspar") -> None:
    with open(path, "w") as f:
        f.write(render(motifs, form))


def convert(source: str, target: str, form: str, to: str) -> None:
    write_motifs(read_motifs(source, form), target, to)


def select_motifs(motifs: list[Motif], least: int | None = None, most: int | None = None, min_ic: float | None = None, include: list[str] | None = None, exclude: list[str] | None = None) -> list[Motif]:
    ok = lambda m: (least is None or m.length >= least) and (most is None or m.length <= most) and (min_ic is None or m.information().sum() >= min_ic) and (include is None or m.name in include) and (exclude is None or m.name not in exclude)
    return [m for m in motifs if ok(m)]


def make_unique(motifs: list[Motif]) -> list[Motif]:
    seen: dict[str, int] = {}
    out = []
    for m in motifs:
        n = seen[m.id] = seen.get(m.id, 0) + 1
        out.append(m if n == 1 else Motif(f"{m.id}_{n}", m.name, m.counts, m.bg, m.threshold))
    return out


def prefix(m: Motif, naming: str = "name_id") -> str:
    return re.sub(r"[^\w.+-]", "_", {"name": m.name, "id": m.id, "name_id": f"{m.name}_{m.id}", "id_name": f"{m.id}_{m.name}"}[naming])


def mean_background(motifs: list[Motif]) -> np.ndarray:
    return np.mean([m.bg for m in motifs], axis=0)


def from_sequences(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """(pos, base, count) of equally long sequences."""
    s = seqs.select(F.posexplode(F.split(F.upper(seq), "")).alias("pos", "base")).where("base <> ''")
    return s.groupBy("pos", "base").agg(F.count(F.lit(1)).alias("count"))


def long_table(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    return spark.createDataFrame([(m.id, m.name, j, BASES[i], float(m.counts[i, j])) for m in motifs for j in range(m.length) for i in range(4)], "motif string, name string, pos int, base string, count double")


def probabilities(counts: DataFrame, keys: list[str], pseudo: float = 1.0) -> DataFrame:
    """counts (keys, pos, base, count) with all four bases at each place, `p` = (count + pseudo) / column sum and `log2_odds` against 0.25."""
    grid = counts.select(*keys, "pos").distinct().withColumn("base", F.explode(F.array(*map(F.lit, BASES))))
    c = grid.join(counts, [*keys, "pos", "base"], "left").fillna(0, ["count"])
    p = (F.col("count") + pseudo) / F.sum(F.col("count") + pseudo).over(W.partitionBy(*keys, "pos"))
    return c.withColumn("p", p).withColumn("log2_odds", F.log2(F.col("p") / 0.25))


def information_table(p: DataFrame, keys: list[str]) -> DataFrame:
    return p.groupBy(*keys, "pos").agg((2 + F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p")).otherwise(0.0))).alias("bits"))


def consensus_table(p: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    best = p.groupBy(*keys, "pos").agg(F.min(F.struct((-F.col("p")).alias("n"), "base")).alias("b"))
    letter = F.when(-F.col("b.n") >= least, F.col("b.base")).otherwise("N")
    by = best.select(*keys, F.struct("pos", letter.alias("x")).alias("s"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]), "").alias("consensus")
    return by.groupBy(*keys).agg(one) if keys else by.agg(one)


# sequences


def reverse_complement(c: Column | str) -> Column:
    return F.reverse(F.translate(F.upper(c), "ACGT", "TGCA"))


def gc_share(c: Column | str) -> Column:
    """(G or C + half of the letters other than A, C, G, T) / length."""
    n = F.length(c)
    gc = n - F.length(F.translate(F.upper(c), "GC", ""))
    known = n - F.length(F.translate(F.upper(c), "ACGT", ""))
    return (gc + 0.5 * (n - known)) / n


def kmers(c: Column | str, k: int) -> Column:
    """All k-letter parts of a sequence in order; those with letters other than A, C, G, T are NULL."""
    s = F.upper(c)
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.when(F.substr(s, i, F.lit(k)).rlike("^[ACGT]+$"), F.substr(s, i, F.lit(k)))))


def kmer_code(c: Column | str) -> Column:
    """Base-4 number of a k-mer (A 0, C 1, G 2, T 3), -1 if it has other letters."""
    return F.when(F.col(c).rlike("^[ACGT]+$") if isinstance(c, str) else c.rlike("^[ACGT]+$"), F.conv(F.translate(c, "ACGT", "0123"), 4, 10).cast("bigint")).otherwise(F.lit(-1).cast("bigint"))


def extract_sequences(genome: DataFrame, regions: DataFrame, size: int | None = None, key: str = "feature") -> DataFrame:
    """(key, chrom, start, end, seq) of regions, or of `size` bases around their middles, from sequences (chrom, seq); regions that reach off their chromosome or are more than half unknown are left out.

    A chromosome's sequence is cut into pieces of a megabase first, so that regions are joined with pieces, not with whole chromosomes.
    """
    m = F.floor((F.col("start") + F.col("end")) / 2)
    r = regions if size is None else regions.withColumn("_m", m).withColumn("start", F.col("_m") - size // 2).withColumn("end", F.col("start") + size).drop("_m")
    piece = 1 << 20
    g = chunk_genome(genome, piece, 0).select("chrom", F.col("start").alias("_at"), "seq")
    ok = r.where((F.col("start") >= 0) & (F.col("start") < F.col("end"))).select(key, "chrom", "start", "end")
    j = ok.withColumn("_at", F.explode(F.transform(F.sequence(F.shiftright("start", 20), F.shiftright(F.col("end") - 1, 20)), lambda b: b * piece))).join(g, ["chrom", "_at"])
    a, b = F.greatest("start", "_at"), F.least(F.col("end"), F.col("_at") + piece)
    part = F.struct("_at", F.substr("seq", (a - F.col("_at") + 1).cast("int"), (b - a).cast("int")).alias("s"))
    s = j.groupBy(key, "chrom", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), "").alias("seq"))
    known = F.length("seq") - F.length(F.translate(F.upper("seq"), "ACGT", ""))
    return s.where((F.length("seq") == F.col("end") - F.col("start")) & (known * 2 >= F.length("seq")))


def sliding_score(seq: str, weights: np.ndarray) -> np.ndarray:
    """Score of the window around each place (at its place length // 2), NaN at the edges and where the window has an unknown letter. weights: 4 x length."""
    n, k = len(seq), weights.shape[1]
    out = np.full(n, np.nan)
    s = _scores(encode(seq), weights)
    out[k // 2 : k // 2 + len(s)] = np.where(s < -1e5, np.nan, s)
    return out


def encode(seq: str) -> np.ndarray:
    t = np.full(256, 4, np.int8)
    for i, b in enumerate(BASES):
        t[ord(b)] = t[ord(b.lower())] = i
    return t[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def _scores(codes: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Score of each window of a coded sequence; an unknown letter counts -1e6."""
    ext = np.vstack([lo, np.full(lo.shape[1], -1e6)])
    n = len(codes) - lo.shape[1] + 1
    if n < 1:
        return np.zeros(0)
    s = np.zeros(n)
    for j in range(lo.shape[1]):
        s += ext[codes[j : j + n], j]
    return s


def scan(seqs: DataFrame, motifs: list[Motif], key: str = "feature", seq: str = "seq", p: float = 5e-5, strands: str = "+-", chrom: str | None = None, start: str | None = None) -> DataFrame:
    """Every hit of every motif: key, motif, start, end, strand, score (rounded to 5 places). start is relative to the sequence, or to the `start` column if one is named.

    The cut-off is the motif's own or by tail probability p. Matrices travel with the task, sequences stay where they are. A sequence is scanned whole; a reverse-strand hit is
    given by its leftmost base. NULL and short sequences have no hits.
    """
    lib = [(m.id, m.pssm(), m.reverse().pssm(), m.cut_off(p) if m.threshold is None else m.threshold) for m in motifs]
    cols = [F.col(key).alias("_key"), F.col(seq).alias("_seq")] + [F.col(c).alias(f"_{i}") for i, c in enumerate((chrom, start)) if c]
    kind = seqs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            ids, ss = b.column(0).to_pylist(), b.column(1).to_pylist()
            cs = b.column(2).to_pylist() if chrom else [None] * len(ids)
            st = b.column(b.num_columns - 1).to_pylist() if start else [0] * len(ids)
            for i, s, c, o in zip(ids, ss, cs, st, strict=True):
                if not s:
                    continue
                x = encode(s)
                for m, fwd, rev, cut in lib:
                    for strand, lo in (("+", fwd), ("-", rev)):
                        if strand in strands:
                            v = _scores(x, lo)
                            for a in np.flatnonzero(v >= cut):
                                out.append((i, c, m, int(o + a), int(o + a + lo.shape[1]), strand, round(float(v[a]), 5)))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema=sch, preserve_index=False)

    names = ["_key", "chrom", "motif", "start", "end", "strand", "score"]
    sch = pa.schema([("_key", {"string": pa.string(), "bigint": pa.int64()}[kind]), ("chrom", pa.string()), ("motif", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("strand", pa.string()), ("score", pa.float64())])
    hits = seqs.select(*cols).mapInArrow(run, f"_key {kind}, chrom string, motif string, start bigint, end bigint, strand string, score double")
    return hits.withColumnRenamed("_key", key) if chrom else hits.drop("chrom").withColumnRenamed("_key", key)


def chunk_genome(genome: DataFrame, size: int = 10_000_000, overlap: int = 100) -> DataFrame:
    """(chrom, start, own_end, seq): pieces of chromosome sequences (chrom, seq) with `overlap` further bases. A hit belongs to the piece in which it starts."""
    g = genome.select("chrom", F.col("seq").alias("_s"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.length("seq").cast("bigint") - 1, F.lit(size).cast("bigint"))).alias("start"))
    return g.select("chrom", "start", (F.col("start") + size).alias("own_end"), F.substr("_s", F.col("start").cast("int") + 1, F.lit(size + overlap)).alias("seq"))


def build_database(genome: DataFrame, motifs: list[Motif], path: str, p: float = 5e-5, size: int = 10_000_000) -> DataFrame:
    """The hit table of a genome, one folder per chromosome, with the library's digest beside it; a table whose digest agrees is left as it is."""
    import hashlib

    spark = genome.sparkSession
    digest = hashlib.sha256((render(motifs, "transfac") + f"{p}").encode()).hexdigest()
    try:
        if spark.read.text(f"{path}/_meta").first()[0] == digest:
            return spark.read.parquet(f"{path}/hits")
    except Exception:
        pass
    pieces = chunk_genome(genome, size, max(m.length for m in motifs))
    hits = scan(pieces.withColumn("k", F.concat_ws(":", "chrom", "own_end")), motifs, "k", "seq", p, chrom="chrom", start="start")
    own = F.split("k", ":")[1].cast("bigint")
    hits.where(F.col("start") < own).drop("k").write.mode("overwrite").option("compression", "zstd").partitionBy("chrom").parquet(f"{path}/hits")
    spark.createDataFrame([(digest,)], "d string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")
    return spark.read.parquet(f"{path}/hits")


def query_database(hits: DataFrame, peaks: DataFrame, least: float | None = None) -> DataFrame:
    """Distinct (feature, motif) of hits that overlap a peak."""
    h = hits if least is None else hits.where(F.col("score") >= least)
    return overlap_join(h.select("chrom", "start", "end", "motif"), peaks.select("chrom", "start", "end", "feature")).select(F.col("r_feature").alias("feature"), "motif").distinct()


def hit_positions(hits: DataFrame, peaks: DataFrame | None = None, names: list[str] | None = None, least: float | None = None) -> DataFrame:
    """Hits of the motifs that the names (or their beginnings) stand for, of at least a score, whose middle lies in a peak."""
    h = hits if least is None else hits.where(F.col("score") >= least)
    if names:
        cond = F.lit(False)
        for n in names:
            cond = cond | (F.col("motif") == n) | F.col("motif").startswith(n)
        h = h.where(cond)
    if peaks is None:
        return h
    from locusmill.operators.intervals import point_join

    m = h.withColumn("pos", F.floor((F.col("start") + F.col("end")) / 2))
    return point_join(m, peaks.select("chrom", "start", "end").distinct()).select(*h.columns)


def positions_from_matrix(matrix: DataFrame, peaks: DataFrame) -> DataFrame:
    """Peak middles of each (feature, motif), strand +."""
    return matrix.join(peaks.select("feature", "chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("pos")), "feature").select("motif", "chrom", "pos", F.lit("+").alias("strand"))


def similarity(a: Motif, b: Motif, method: str = "pearson") -> float:
    """Of two motifs padded to the same length with 0.25: pearson, euclidean 1 / (1 + d) or kl 1 / (1 + symmetric divergence)."""
    n = max(a.length, b.length)
    x, y = (np.hstack([m.pfm(), np.full((4, n - m.length), 0.25)]) for m in (a, b))
    if method == "euclidean":
        return float(1 / (1 + np.linalg.norm(x - y)))
    if method == "kl":
        x, y = x + 1e-10, y + 1e-10
        return float(1 / (1 + ((x * np.log(x / y)).sum() + (y * np.log(y / x)).sum()) / 2))
    return float(np.corrcoef(x.ravel(), y.ravel())[0, 1])


def similarity_matrix(spark: SparkSession, motifs: list[Motif], method: str = "pearson") -> DataFrame:
    return spark.createDataFrame([(a.id, b.id, similarity(a, b, method)) for a in motifs for b in motifs], "a string, b string, similarity double")


def cluster(motifs: list[Motif], threshold: float = 0.5, method: str = "pearson") -> list[list[Motif]]:
    """Average-linkage clusters at a distance 1 - similarity of at most the threshold."""
    d = np.array([[1 - similarity(a, b, method) for b in motifs] for a in motifs])
    groups = [[i] for i in range(len(motifs))]
    while len(groups) > 1:
        v, i, j = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if v > threshold:
            break
        groups[i] += groups.pop(j)
    return [[motifs[i] for i in sorted(g)] for g in sorted(groups, key=min)]


def merge(motifs: list[Motif]) -> Motif:
    """The mean of the motifs, each at the shift and strand at which it is most like the first, weighted by its counts."""
    base = motifs[0]
    total, n = base.counts.copy(), base.length
    for m in motifs[1:]:
        best = None
        for x in (m, m.reverse()):
            for s in range(-(x.length - 1), n):
                a, b = max(0, s), min(n, s + x.length)
                if b - a >= min(n, x.length) // 2 + 1:
                    u, v = (total[:, a:b] / total[:, a:b].sum(0)).ravel(), x.pfm()[:, a - s : b - s].ravel()
                    r = np.corrcoef(u, v)[0, 1] * (b - a)
                    if best is None or r > best[0]:
                        best = (r, a, b, x.counts[:, a - s : b - s])
        if best:
            total[:, best[1] : best[2]] += best[3]
    return Motif(base.id, "+".join(m.name for m in motifs), total)


def enrichment(target_hits: DataFrame, bg_hits: DataFrame, n_target: int, n_bg: int) -> pd.DataFrame:
    """Per motif sequences with a hit among targets and background, ln of the binomial tail at the background's rate, and rates by Benjamini-Hochberg, best first. Inputs: distinct (feature, motif)."""
    t = {r.motif: r["n"] for r in target_hits.groupBy("motif").agg(F.count_distinct("feature").alias("n")).collect()}
    b = {r.motif: r["n"] for r in bg_hits.groupBy("motif").agg(F.count_distinct("feature").alias("n")).collect()}
    rows = []
    for m in sorted(set(t) | set(b)):
        rate = max(b.get(m, 0), 1) / max(n_bg, 1)
        rows.append((m, t.get(m, 0), b.get(m, 0), log_binom_sf(t.get(m, 0), n_target, min(rate, 1 - 1e-12))))
    out = pd.DataFrame(rows, columns=["motif", "n_target", "n_bg", "log_p"])
    out["q"] = numpy_bh(np.exp(out["log_p"].to_numpy())) if len(out) else []
    return out.sort_values(["log_p", "motif"]).reset_index(drop=True)


def gc_matched(target: DataFrame, pool: DataFrame, n: int, bins: int = 20, seed: int = 0) -> DataFrame:
    """Rows of pool (feature, seq) with the GC distribution of target (seq) over equal bins, about n in all, by a seeded hash; sequences with over half unknown letters are left out."""
    b = F.least(F.lit(bins - 1), F.floor(gc_share("seq") * bins)).alias("bin")
    t = target.select(b).groupBy("bin").agg(F.count(F.lit(1)).alias("k"))
    total = t.agg(F.sum("k")).first()[0]
    bad = F.length(F.translate(F.upper("seq"), "ACGT", "")) * 2 > F.length("seq")
    p = pool.where(~bad).select("*", b).join(F.broadcast(t), "bin")
    r = rank_within(p.withColumn("_h", seeded("feature", seed)), ["bin"], ["_h", "feature"], "_r")
    return r.where(F.col("_r") <= F.ceil(F.col("k") * n / total)).drop("_r", "_h", "k", "bin")


