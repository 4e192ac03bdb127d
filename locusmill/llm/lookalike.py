"""Texts that look alike brought to one form.

Look-alike classes are the classes of a union-find over code points and strings: full-width and half-width forms, ligatures and their letters, kinds of
space and hyphen, characters without width (the class of the empty string), singleton compatibility letters and letters of another script with the same
shape. A class is represented by its most frequent member in the collection. A text is decomposed, rewritten left to right with the longest match of
an automaton over all members, and composed; composed and combining accents so meet whatever the script of their base.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata as U
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of Latin, Cyrillic, Greek and Armenian with the same shape.
SAME_SHAPE = (
    "aа", "cсϲ", "dԁ", "eе", "gɡ", "hһհ", "iі", "jјϳ", "lӏ", "nո", "oоοօ", "pрρ", "qԛ", "sѕ", "uս", "vνѵ", "wԝ", "xх", "yу",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "FϜ", "GԌ", "HНΗ", "IІΙӀ", "JЈͿ", "KКΚ", "MМΜϺ", "NΝ", "OОΟՕ", "PРΡ", "QԚ", "SЅՏ", "TТΤ", "UՍ", "VѴ", "WԜ", "XХΧ", "YΥҮ", "ZΖ", "ГΓ", "ПΠ", "ФΦ",
)
# Hyphens of various kinds, beside hyphen-minus.
HYPHENS = "˗‐‑‒–⁃−﹣"
# Characters without width that aren't format characters; format characters that have width.
NO_WIDTH = "͏ᅟᅠ឴឵᠋᠌᠍" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
WITH_WIDTH = "؀؁؂؃؄؅۝܏࣢" + "".join(map(chr, [0x110BD, 0x110CD, *range(0x13430, 0x13460)]))


class Union:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


@functools.cache
def classes() -> tuple[tuple[str, ...], ...]:
    """The look-alike classes with at least two members, each sorted. Members are in canonical decomposition."""
    u = Union()
    nfd = functools.partial(U.normalize, "NFD")
    for group in SAME_SHAPE:
        for x in group[1:]:
            u.join(group[0], x)
    for x in HYPHENS:
        u.join("-", x)
    for x in NO_WIDTH:
        u.join("", x)
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        cat = U.category(c)
        if cat in ("Cn", "Cs", "Co", "Cc"):
            continue
        if cat == "Cf":
            if c not in WITH_WIDTH:
                u.join("", c)
            continue
        if cat == "Zs":
            u.join(" ", c)
            continue
        kind, _, to = U.decomposition(c).rpartition("> ")
        if not kind:
            continue
        plain = nfd("".join(chr(int(x, 16)) for x in to.split()))
        if kind in ("<wide", "<narrow") or kind == "<compat" and re.search("LIGATURE|ROMAN NUMERAL", U.name(c, "")) and plain.isalpha():
            u.join(nfd(c), plain)
    got = defaultdict(list)
    for x in list(u.up):
        got[u.find(x)].append(x)
    return tuple(sorted(tuple(sorted(v)) for v in got.values() if len(v) > 1))


def representatives(counts: dict[int, int]) -> dict[str, str]:
    """member -> most frequent member of its class, for all that differ. A string is as frequent as its rarest code point; of equals the first in code point order counts.

    The empty string represents its class. A string represents a class only if each of its letters represents its own.
    """
    single = {}
    for g in classes():
        if "" in g:
            single |= dict.fromkeys(g, "")
        elif all(len(x) == 1 for x in g):
            best = min(g, key=lambda x: (-counts.get(ord(x), 0), x))
            single |= dict.fromkeys(g, best)
    out = dict(single)
    for g in classes():
        if g[0] not in out:
            rewritten = {x: "".join(single.get(c, c) for c in x) for x in g}
            best = min(g, key=lambda x: (-min(counts.get(ord(c), 0) for c in x), -len(x), x))
            out |= dict.fromkeys(g, rewritten[best])
    return {k: v for k, v in out.items() if k and k != v}


class Rewriter:
    """Rewrites texts to one form, given the members to replace."""

    def __init__(self, replace: dict[str, str]) -> None:
        self.auto = ahocorasick.Automaton()
        for k, v in replace.items():
            self.auto.add_word(k, (len(k), v))
        self.auto.make_automaton()
        first = sorted({ord(k[0]) for k in replace})
        spans, i = [], 0
        while i < len(first):
            j = i
            while j + 1 < len(first) and first[j + 1] == first[j] + 1:
                j += 1
            spans.append(f"\\U{first[i]:08x}-\\U{first[j]:08x}")
            i = j + 1
        self.active = re.compile("[" + "".join(spans) + "]") if spans else re.compile(r"(?!)")
        self.ascii = any(x < 128 for x in first)

    def __call__(self, text: str) -> str:
        if text.isascii() and not self.ascii:
            return text
        d = U.normalize("NFD", text)
        if self.active.search(d) is None:
            return U.normalize("NFC", text)
        parts, at = [], 0
        for end, (n, to) in self.auto.iter_long(d):
            parts.append(d[at : end + 1 - n])
            parts.append(to)
            at = end + 1
        parts.append(d[at:])
        return U.normalize("NFC", "".join(parts))


def _texts(b: pa.RecordBatch, c: str) -> list:
    return b.column(b.schema.get_field_index(c)).to_pylist()


def code_point_counts(df: DataFrame, text: str = "text") -> dict[int, int]:
    """How often each member code point of a look-alike class occurs in the collection, decomposed. Bounded by the number of members."""
    wanted = np.array(sorted({ord(c) for g in classes() for x in g for c in x}))
    index = np.full(0x110000, len(wanted), np.int32)
    index[wanted] = np.arange(len(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted) + 1, np.int64)
        for b in batches:
            for t in _texts(b, text):
                if t is None:
                    continue
                if t.isascii():
                    a = np.frombuffer(t.encode("ascii"), np.uint8)
                else:
                    a = np.frombuffer(U.normalize("NFD", t).encode("utf-32-le", "surrogatepass"), np.uint32)
                total += np.bincount(index[a], minlength=len(total))
        at = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_pydict({"cp": pa.array(wanted[at].astype(np.int64)), "n": pa.array(total[at])})

    rows = df.select(text).mapInArrow(run, "cp bigint, n bigint").groupBy("cp").agg(F.sum("n").alias("n")).collect()
    return {r.cp: r.n for r in rows}


def one_form(df: DataFrame, text: str = "text", counts: dict[int, int] | None = None) -> DataFrame:
    """df with `text` in one consistent form. NULL stays NULL, an empty text empty; texts of any length are rewritten whole; all other columns stay.

    Case, accents, line breaks and letters that look alike within a script are left as they are. counts defaults to those of df's own texts.
    """
    replace = representatives(code_point_counts(df, text) if counts is None else counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rw = Rewriter(replace)
        for b in batches:
            i = b.schema.get_field_index(text)
            yield b.set_column(i, b.schema.field(i), pa.array([None if t is None else rw(t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return df.mapInArrow(run, df.schema)


def same_look(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, exact): 128-bit digests of each text's consistent form and of the text itself. Rows with a NULL key or text are left out."""
    replace = representatives(code_point_counts(df, text))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rw = Rewriter(replace)
        digest = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
        for b in batches:
            ts = _texts(b, text)
            exact = [digest(t) for t in ts]
            look = [e if t.isascii() and not rw.ascii else digest(rw(t)) for t, e in zip(ts, exact, strict=True)]
            yield pa.RecordBatch.from_pydict({key: b.column(b.schema.get_field_index(key)), "look": pa.array(look, pa.binary()), "exact": pa.array(exact, pa.binary())})

    return df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).mapInArrow(run, f"`{key}` {kind}, look binary, exact binary")


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: rows whose texts look the same and differ in a character.

    Classes of equal texts are paired first and expanded to their rows last, so that a text stored many times isn't compared with its own copies.
    """
    from locusmill.util import materialize

    looks = materialize(same_look(df, key, text), "looks")
    kinds = looks.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("n"))
    several = kinds.groupBy("look").agg(F.min("exact").alias("a"), F.max("exact").alias("b")).where("a <> b").select("look")
    kinds = materialize(kinds.join(several, "look").select("look", "exact"), "kinds")
    pairs = kinds.withColumnRenamed("exact", "e1").join(kinds.withColumnRenamed("exact", "e2"), "look").where("e1 < e2")
    first = looks.select("look", F.col("exact").alias("e1"), F.col(key).alias("k1"))
    second = looks.select("look", F.col("exact").alias("e2"), F.col(key).alias("k2"))
    both = pairs.join(first, ["look", "e1"]).join(second, ["look", "e2"]).where("k1 <> k2")
    return both.select(F.least("k1", "k2").alias("doc_a"), F.greatest("k1", "k2").alias("doc_b"))
