"""Column functions in one place."""

from locusmill.operators.clean import clean_chrom  # noqa: F401
from locusmill.operators.contacts import barcode_of  # noqa: F401
from locusmill.operators.forest import parent_of  # noqa: F401
from locusmill.operators.intervals import bins  # noqa: F401
from locusmill.operators.matrices import tile_label  # noqa: F401
from locusmill.operators.motifs import gc_share, kmer_code, kmers, reverse_complement  # noqa: F401
from locusmill.operators.regions import parse_region, region_label  # noqa: F401
from locusmill.operators.stats import norm_pdf, normal_two_sided, pearson, relu, sigmoid  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_barcode(c: Column | str, separator: str = "___") -> Column:
    """A cell name without its sample suffix."""
    return F.substring_index(F.col(c) if isinstance(c, str) else c, separator, 1)


def whole_number(c: Column | str) -> Column:
    """`1.0` as `1`, other texts as they are."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^(-?\d+)\.0+$", "$1")


def file_name(c: Column | str) -> Column:
    """Text as a file name: characters other than letters, digits, `_`, `.`, `-` become `_`."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^\w.\-]", "_")


def short_length(c: Column | str) -> Column:
    """Bases as `950bp`, `12kb`, `3Mb`."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c >= 1_000_000, F.concat((c / 1_000_000).cast("bigint"), F.lit("Mb"))).when(c >= 1000, F.concat((c / 1000).cast("bigint"), F.lit("kb"))).otherwise(F.concat(c.cast("bigint"), F.lit("bp")))


def number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def user_region(c: Column | str) -> Column:
    """Struct (chrom, start, end, tile) of `chrom[:start[:end[:tile]]]`, absent parts NULL; commas in numbers are disregarded."""
    p = F.split(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(","), F.lit("")), "[:]")
    n = lambda i: F.get(p, F.lit(i)).try_cast("bigint")
    return F.struct(p[0].alias("chrom"), n(1).alias("start"), n(2).alias("end"), n(3).alias("tile"))


def common_prefix(texts: list[str]) -> str:
    """The longest prefix of all texts."""
    a, b = (min(texts), max(texts)) if texts else ("", "")
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def match_names(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """For each name of a the names of b that are most like it once each list's common prefix and suffix are taken off."""
    from difflib import SequenceMatcher

    def core(v):
        p, s = len(common_prefix(v)), len(common_prefix([x[::-1] for x in v]))
        return {x: x[p : len(x) - s] or x for x in v}

    ca, cb = core(a), core(b)
    out = []
    for x in a:
        score = {y: SequenceMatcher(None, ca[x], cb[y]).ratio() for y in b}
        best = max(score.values(), default=0)
        out += [(x, y) for y, v in score.items() if v == best and v > 0]
    return out
