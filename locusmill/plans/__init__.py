"""Compositions of operators: from fragments to cells, peaks, matrices and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from locusmill.operators import embed, matrices, peaks, qc
from locusmill.operators.intervals import coverage_runs
from locusmill.util import materialize


def cells_and_tiles(frags: DataFrame, width: int = 500, min_fragments: int = 20, n_features: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(cells with measures, tile matrix (cell, feature, value) of the features chosen)."""
    cells = materialize(qc.import_fragments(frags, min_fragments=min_fragments).join(qc.nucleosome_signal(frags), "cell"), "cells")
    x = matrices.tile_matrix(frags.join(cells.select("cell"), "cell", "left_semi"), width)
    x = x.select("cell", matrices.tile_label("chrom", "tile", width).alias("feature"), "value")
    x = materialize(x, "tiles")
    return cells, x.join(matrices.features_by_presence(x, n_features).select("feature"), "feature", "left_semi")


def groups_to_peaks(frags: DataFrame, groups: DataFrame, sizes: DataFrame, genome: int, half_width: int = 250) -> DataFrame:
    """Peaks called in all fragments' coverage, merged to fixed windows."""
    runs = materialize(coverage_runs(frags.join(groups, "cell"), ["chrom"]), "runs")
    return peaks.merge_peaks(peaks.call_peaks(runs, genome), sizes, half_width)


def embed_and_cluster(x: DataFrame, k: int = 20, clusters: int = 8) -> DataFrame:
    """(cell, vec, cluster)."""
    u = embed.iterative_lsi(x, k, features=2000)
    return u.join(embed.kmeans(u, clusters), "cell")


def map_regions(sizes: DataFrame, fn, schema: str, width: int = 1_000_000, only: DataFrame | None = None, without: DataFrame | None = None) -> DataFrame:
    """fn(chrom, start, end) -> rows, run over pieces of the genome of at most `width` bases, within `only` and without `without` if given. Pieces are spread over all tasks."""
    import pandas as pd

    from locusmill.operators.regions import from_chrom_lengths, split_regions, subtract
    from locusmill.util import shuffle_width

    w = split_regions(from_chrom_lengths(sizes) if only is None else only.select("chrom", "start", "end"), width)
    if without is not None:
        w = subtract(w, without)

    def run(parts):
        for p in parts:
            for c, s, e in zip(p["chrom"], p["start"], p["end"], strict=True):
                out = fn(c, int(s), int(e))
                yield out if isinstance(out, pd.DataFrame) else pd.DataFrame(out)

    return w.repartition(shuffle_width(sizes.sparkSession)).mapInPandas(run, schema)


def group_contact_maps(pairs: DataFrame, groups: DataFrame, width: int) -> dict[str, DataFrame]:
    """Pixels of the pairs of each group's barcodes, and the weights that balance them."""
    from locusmill.operators import contacts

    p = materialize(contacts.pixels(contacts.demux(pairs, groups), width, ["group"]), "pixels")
    names = [r[0] for r in p.select("group").distinct().collect()]
    return {n: contacts.balanced(c := contacts.cis(p.where(p["group"] == n).drop("group")), contacts.balance(c, 1, 2)) for n in names}
