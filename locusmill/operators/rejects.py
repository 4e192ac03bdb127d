"""Loading of delimited lines with the failing ones set apart, each with its reason.

Every block of lines is parsed as a whole by columnar kernels, which accept it only if each of its lines is certain to be valid. A block that isn't accepted is
halved again and again until the bad lines stand alone; these go to a strict parser, which gives the reason (or finds a line valid after all, as one with
quoted fields). The columnar path accepts nothing that the strict parser wouldn't, so `parse_strict` alone defines the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
BIGINT_MAX = (1 << 63) - 1
_DIGITS = re.compile(r"[0-9]+", re.ASCII)
_BARCODE = re.compile(r"[ACGT]{16}-[0-9]+", re.ASCII)
#: What the columnar path takes for a valid line: no quotes, numbers that surely fit a BIGINT. `(?s)` lets fields hold line feeds.
_SURE = r'(?s)\A(?P<chrom>[^\t"]*)\t(?P<start>[0-9]{1,18})\t(?P<end>[0-9]{1,18})\t(?P<barcode>[ACGT]{16}-[0-9]+)(?:\t(?P<count>[^\t"]*))?\z'


def split_fields(line: str) -> list[str] | None:
    """Fields of a tab-separated line with doubled quotes inside quoted fields; None if the quoting is broken."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            part, i = [], i + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                part.append(line[i:j])
                if line.startswith('""', j):
                    part.append('"')
                    i = j + 2
                    continue
                i = j + 1
                break
            fields.append("".join(part))
            if i < n and line[i] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = n if j < 0 else j
            if '"' in line[i:j]:
                return None
            fields.append(line[i:j])
            i = j
        if i >= n:
            return fields
        i += 1


def _bigint(digits: str) -> int | None:
    """The number that ASCII digits write, None beyond BIGINT. Digits may be more than Python would convert."""
    digits = digits.lstrip("0") or "0"
    n = int(digits) if len(digits) <= 19 else BIGINT_MAX + 1
    return n if n <= BIGINT_MAX else None


def parse_strict(line: str) -> tuple[str | None, tuple | None]:
    """(reason, None) for a failing line, (None, (chrom, start, end, barcode, count)) for a valid one."""
    f = split_fields(line)
    if f is None:
        return "quoting", None
    if len(f) not in (4, 5):
        return "columns", None
    if not (_DIGITS.fullmatch(f[1]) and _DIGITS.fullmatch(f[2]) and _BARCODE.fullmatch(f[3])):
        return "value", None
    s, e = _bigint(f[1]), _bigint(f[2])
    if s is None or e is None or s >= e:
        return "value", None
    count = _bigint(f[4]) if len(f) == 5 and _DIGITS.fullmatch(f[4]) else 1
    return None, (f[0], s, e, f[3], 1 if count is None else count)


def _columnar(lines: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """(whether each line is surely valid, the columns of those that are) by columnar kernels over all lines at once."""
    got = pc.extract_regex(lines, _SURE)
    ok = pc.is_valid(got)
    cols = got.filter(ok)
    chrom, start, end, barcode, count = (pc.struct_field(cols, n) for n in ("chrom", "start", "end", "barcode", "count"))
    start, end = pc.cast(start, pa.int64()), pc.cast(end, pa.int64())
    # an absent count gives an empty group, which is no number either; longer numbers are left to the strict parser
    number = pc.match_substring_regex(count, r"^[0-9]{1,18}\z")
    count = pc.cast(pc.if_else(number, count, "1"), pa.int64())
    good = pc.and_(pc.less(start, end), pc.or_(number, pc.invert(pc.match_substring_regex(pc.struct_field(cols, "count"), r"^[0-9]+\z"))))
    flags = ok.to_numpy(zero_copy_only=False).copy()
    flags[flags] = good.to_numpy(zero_copy_only=False)
    return flags, [x.filter(good) for x in (chrom, start, end, barcode, count)]


def _bad_lines(ok: np.ndarray, block: int) -> list[int]:
    """Lines that stand alone after halving each block that isn't accepted as a whole."""
    out = []
    for lo in range(0, len(ok), block):
        todo = [(lo, min(lo + block, len(ok)))]
        while todo:
            i, j = todo.pop()
            if ok[i:j].all():
                continue
            if j - i == 1:
                out.append(i)
            else:
                mid = (i + j) // 2
                todo += [(mid, j), (i, mid)]
    return out


def parse_lines(lines: pa.Array, block: int = BLOCK) -> tuple[pa.Array, list[pa.Array], list[tuple[int, str | None, tuple | None]]]:
    """Parse record lines. (positions of the lines that the columnar path accepted, their columns, the strict results of the others)."""
    ok, cols = _columnar(lines)
    single = [(i, *parse_strict(lines[i].as_py())) for i in _bad_lines(ok, block)]
    return pa.array(np.flatnonzero(ok)), cols, single


def parse_fragments(df: DataFrame, line: str = "line", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each record line: `keep` columns, chrom, start, end, barcode, count, and reason (NULL for a valid line; then the parsed columns are set).

    A NULL or empty line (after one trailing carriage return is dropped) and a line beginning with `#` are no records and give no row. Lines may be of any
    length and may contain any character; a line feed inside a line is an ordinary character. `keep` defaults to all other columns; those named like
    a parsed column are left out.
    """
    parsed = ["chrom", "start", "end", "barcode", "count", "reason"]
    keep = [c for c in df.columns if c != line and c not in parsed] if keep is None else keep
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    text = F.regexp_replace(F.col(line), "\r\\z", "")
    src = df.select(*keep, F.when(F.col(line).endswith("\r"), text).otherwise(F.col(line)).alias("_line")).where((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "chrom string, start bigint, end bigint, barcode string, count bigint, reason string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at, cols, single = parse_lines(b.column(b.schema.get_field_index("_line")).cast(pa.string()), block)
            idx = pa.concat_arrays([at.cast(pa.int64()), pa.array([i for i, _, _ in single], pa.int64())])
            rows = [v or (None,) * 5 for _, _, v in single]
            out = {k: b.column(b.schema.get_field_index(k)).take(idx) for k in keep}
            for j, (name, x) in enumerate(zip(parsed, cols, strict=False)):
                out[name] = pa.concat_arrays([x, pa.array([r[j] for r in rows], x.type)])
            out["reason"] = pa.concat_arrays([pa.nulls(len(at), pa.string()), pa.array([r for _, r, _ in single], pa.string())])
            yield pa.RecordBatch.from_pydict(out)

    return src.mapInArrow(run, schema)


def split_rejects(df: DataFrame, line: str = "line", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid fragments, failing lines with reason). Write or cache `parse_fragments` first where both are used, else lines are parsed twice."""
    all_rows = parse_fragments(df, line, keep)
    kept = [c for c in all_rows.columns if c not in ("chrom", "start", "end", "barcode", "count", "reason")]
    return all_rows.where(F.col("reason").isNull()).drop("reason"), all_rows.where(F.col("reason").isNotNull()).select(*kept, "reason")
