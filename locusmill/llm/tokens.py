"""Sizes of texts in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the default vocabulary, and the split pattern that goes with it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@functools.cache
def encoder(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = RANKS) -> list[int]:
    return encoder(path).encode_ordinary(text) if text else []


def with_token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = RANKS, dims: int = 0, buckets: int = 4096, seed: int = 7) -> DataFrame:
    """`keep` columns and n_tokens; with dims > 0 also vec, the hashed set of the text's tokens projected to so many dimensions.

    A NULL or empty text has 0 tokens and a zero vector. Texts are encoded whole; text that spells a special token is ordinary text.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "n_tokens bigint", *(["vec array<float>"] if dims else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        if dims:
            rng = np.random.default_rng(seed)
            plane = rng.standard_normal((buckets, dims)).astype(np.float32)
            # a multiplicative hash of the token id gives its bucket
            by_id = plane[(np.arange(enc.n_vocab, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)]
        for b in batches:
            n, vecs = [], []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                ids = enc.encode_ordinary(t) if t else []
                n.append(len(ids))
                if dims:
                    u = np.unique(np.array(ids, np.int64))
                    vecs.append(by_id[u].sum(0) / np.sqrt(len(u)) if len(u) else np.zeros(dims, np.float32))
            out = {k: b.column(b.schema.get_field_index(k)) for k in keep} | {"n_tokens": pa.array(n, pa.int64())}
            if dims:
                out["vec"] = pa.array(vecs, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_pydict(out)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def total_tokens(sized: DataFrame) -> int:
    return sized.agg(F.sum("n_tokens")).first()[0] or 0
