"""Nearest neighbours of every vector: vectors in shards, each searched by a scan or by a navigable small-world graph with layers, shard results merged.

Vectors belong to the cell of their nearest centroid (fitted on a bounded sample; every vector is indexed), neighbouring cells make a shard of bounded size. A cell
of more vectors than a shard takes gets finer centroids, and what these can't divide (equal vectors) is split by a hash. What other cells ask of a shard is counted,
and the shard is copied once for each bounded part of that, so the bytes moved grow with the vectors and not with their square.
Each vector gets its neighbours in its own shard first; other shards follow only where the distance between the query and one of the shard's cells can be below that
of its k-th neighbour so far, and of these the ASKED_MOST most likely ones, so the work for a vector doesn't grow with the number of shards.
A shard of up to SCAN_ROWS vectors is scanned by matrix products, which is exact and takes less time there than walking a graph. Beyond that a graph is built in
growing batches: candidates come from a beam search over the graph so far and from within the batch, and each node keeps neighbours in different directions.
Layers are flat int32 arrays, -1 where a node has fewer neighbours. All queries of a batch advance through the graph in lock-step, as array operations.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.util import mark, materialize
from locusmill.util import free as free_tables

#: Vectors of a shard (twice as many at most), vectors of a cell, most cells before large ones are refined, vectors in the sample that the cells' centroids are fitted on.
SHARD_ROWS, CELL_ROWS, MOST_CELLS, SAMPLE_ROWS = 4096, 16, 4096, 20_000
#: Vectors in the sample of each centroid of a refined cell, times that large cells are refined, and rows asked of one copy of a shard, in shards.
FINE_ROWS, REFINED, ASKED_SHARDS = 64, 2, 8
LINKS, EF_BUILD, EF_SEARCH = 16, 64, 48
#: Other shards that a vector asks at most, and vectors up to which a shard is scanned.
ASKED_MOST, SCAN_ROWS = 8, 16_384
#: The share of neighbours across a cell's border that the looked-for distance to that border covers, and how many have to be known for that.
CROSSED, CROSSED_ROWS = 0.998, 20_000


def _sq(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each query (row) to its own candidates; inf where the id is -1."""
    g = x[ids]
    g -= q[:, None, :]
    d = np.einsum("amd,amd->am", g, g)
    d[ids < 0] = np.inf
    return d


def _diverse(x: np.ndarray, ids: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (sorted by distance d, -1 padded) up to `most`: first those nearer to the node than to any one kept, then the nearest of the rest."""
    n, c = ids.shape
    out = np.full((n, most), -1, np.int32)
    for lo in range(0, n, 512):
        i, di = ids[lo : lo + 512], d[lo : lo + 512]
        g = x[i]
        nn = np.einsum("amd,amd->am", g, g)
        pair = nn[:, :, None] + nn[:, None, :] - 2 * np.matmul(g, g.transpose(0, 2, 1))
        kept = np.zeros(i.shape, bool)
        count = np.zeros(len(i), np.int32)
        for j in range(c):
            ok = (i[:, j] >= 0) & (count < most) & ~(kept & (pair[:, j, :] < di[:, j, None])).any(1)
            kept[:, j] = ok
            count += ok
        rank = np.where(kept, 0.0, 1.0) * 1e6 + np.arange(c)
        rank[i < 0] = 1e9
        o = np.argsort(rank, axis=1, kind="stable")[:, :most]
        sel = np.take_along_axis(i, o, 1)
        sel[np.take_along_axis(rank, o, 1) >= 1e9] = -1
        out[lo : lo + 512, : sel.shape[1]] = sel
    return out


def _sorted_unique(ids: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row by distance, repeated ids dropped, cut to `most`."""
    o = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(ids, o, 1)
    rep = np.zeros(s.shape, bool)
    rep[:, 1:] = (s[:, 1:] == s[:, :-1]) & (s[:, 1:] >= 0)
    back = np.zeros_like(rep)
    np.put_along_axis(back, o, rep, 1)
    d = np.where(back | (ids < 0), np.inf, d)
    o = np.argsort(d, axis=1, kind="stable")[:, :most]
    d = np.take_along_axis(d, o, 1)
    ids = np.take_along_axis(ids, o, 1)
    return np.where(np.isinf(d), -1, ids), d


def _exact(x: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x[at] its k nearest others among x[at], as ids of x, by blocks of a matrix product."""
    y = x[at]
    nn = np.einsum("nd,nd->n", y, y)
    k = min(k, len(at) - 1)
    ids, ds = np.full((len(at), max(k, 0)), -1, np.int64), np.full((len(at), max(k, 0)), np.inf, np.float32)
    if k < 1:
        return ids, ds
    step = max(64, min(1024, 1_000_000 // len(at)))  # small blocks stay in the processor's cache
    for lo in range(0, len(at), step):
        b = y[lo : lo + step]
        d = b @ (-2 * y.T)
        d += nn[None]
        d += nn[lo : lo + step, None]
        d[np.arange(len(b)), np.arange(lo, lo + len(b))] = np.inf
        o = np.argpartition(d, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(d, o, 1)
        o2 = np.argsort(v, axis=1, kind="stable")
        ids[lo : lo + step] = at[np.take_along_axis(o, o2, 1)]
        ds[lo : lo + step] = np.maximum(np.take_along_axis(v, o2, 1), 0)
    return ids, ds


def _neighbours(x: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its k nearest others: (row numbers, squared distances), -1 and inf where there are fewer."""
    n = len(x)
    at, d = np.full((n, k), -1, np.int64), np.full((n, k), np.inf, np.float32)
    if n > SCAN_ROWS:
        ids, dd = Graph.build(x).search(x, k + 1, ef)
        dd[ids == np.arange(n)[:, None]] = np.inf
    else:
        ids, dd = _exact(x, np.arange(n), k + 4)
    for lo in range(0, n, 512):  # distances from differences, since those from products are inexact for nearly equal vectors
        i = np.where(np.isinf(dd[lo : lo + 512]), -1, ids[lo : lo + 512])
        v = _sq(x, i, x[lo : lo + 512])
        o = np.argsort(v, axis=1, kind="stable")[:, :k]
        v, i = np.take_along_axis(v, o, 1), np.take_along_axis(i, o, 1)
        at[lo : lo + 512, : o.shape[1]], d[lo : lo + 512, : o.shape[1]] = np.where(np.isinf(v), -1, i), v
    return at, d


def _nearer(x: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of q, row numbers, squared distances): the rows of x at most kth from each row of q, the k nearest of them; rows of q without any are left out."""
    upto = np.square(kth) * (1 + 1e-5) + 1e-12
    if len(x) > SCAN_ROWS:
        at, d = Graph.build(x).search(q, k, ef)
        some = np.flatnonzero((d <= upto[:, None]).any(1))
        return some, np.where(d[some] <= upto[some, None], at[some], -1), d[some]
    xx, minus, step = np.square(x).sum(1), -2 * x.T, max(64, 1_000_000 // len(x))
    k, out = min(k, len(x)), []
    for lo in range(0, len(q), step):
        y = q[lo : lo + step]
        d = y @ minus
        d += xx[None]
        yy = np.square(y).sum(1)
        # a little more than upto, since products are inexact
        some = np.flatnonzero(d.min(1) <= upto[lo : lo + step] * 1.001 + 1e-4 * yy - yy)
        i = np.argpartition(d[some], min(k + 3, len(x) - 1), axis=1)[:, : k + 4]
        v = _sq(x, i, y[some])
        o = np.argsort(v, axis=1, kind="stable")[:, :k]
        i, v = np.take_along_axis(i, o, 1), np.take_along_axis(v, o, 1)
        ok = v <= upto[lo + some, None]
        any_ = ok.any(1)
        out.append((lo + some[any_], np.where(ok, i, -1)[any_], v[any_]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _beam(x: np.ndarray, nbr: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Lock-step beam search of a layer: (ids, squared distances), each (queries, ef), sorted. entry: ids (queries, e), -1 padded."""
    n, total = len(q), len(nbr)
    ids_out, d_out = np.full((n, ef), -1, np.int64), np.full((n, ef), np.inf, np.float32)
    step = max(64, min(256, 48_000_000 // max(total, 1)))  # small steps stay in the processor's cache
    for lo in range(0, n, step):
        qq = q[lo : lo + step]
        m = len(qq)
        seen = np.zeros((m, total + 1), bool)  # the last column takes the -1s
        seen[:, -1] = True
        ids, d = _sorted_unique(entry[lo : lo + step].astype(np.int64), _sq(x, entry[lo : lo + step], qq), ef)
        if ids.shape[1] < ef:
            ids = np.pad(ids, ((0, 0), (0, ef - ids.shape[1])), constant_values=-1)
            d = np.pad(d, ((0, 0), (0, ef - d.shape[1])), constant_values=np.inf)
        seen[np.arange(m)[:, None], ids] = True
        done = ids < 0
        live = np.arange(m)
        while len(live):
            i_l, d_l, f_l = ids[live], d[live], done[live]
            first = np.argsort(f_l, axis=1, kind="stable")[:, :wide]  # candidates are sorted, so the first open ones are the best
            go = ~np.take_along_axis(f_l, first, 1)
            node = np.where(go, np.take_along_axis(i_l, first, 1), -1)
            np.put_along_axis(f_l, first, True, 1)
            nb = np.where(node[:, :, None] >= 0, nbr[node], -1).reshape(len(live), -1).astype(np.int64)
            new = ~seen[live[:, None], nb]
            nb = np.where(new, nb, -1)
            # the same neighbour reached from two nodes counts once
            o = np.sort(nb, axis=1)
            rep = (o[:, 1:] == o[:, :-1]) & (o[:, 1:] >= 0)
            o[:, 1:][rep] = -1
            nb = o
            seen[live[:, None], nb] = True
            width = int((nb >= 0).sum(1).max(initial=0))
            if width:
                nb = -np.sort(-nb, axis=1)[:, :width]
                dn = _sq(x, nb, qq[live])
                d_all = np.concatenate([d_l, dn], 1)
                i_all = np.concatenate([i_l, nb], 1)
                f_all = np.concatenate([f_l, nb < 0], 1)
                o = np.argsort(d_all, axis=1, kind="stable")[:, :ef]
                d_l, i_l, f_l = np.take_along_axis(d_all, o, 1), np.take_along_axis(i_all, o, 1), np.take_along_axis(f_all, o, 1)
                f_l |= np.isinf(d_l)
            ids[live], d[live], done[live] = i_l, d_l, f_l
            live = live[~f_l.all(1)]
        ids_out[lo : lo + step], d_out[lo : lo + step] = np.where(np.isinf(d), -1, ids), d
    return ids_out, d_out


class Graph:
    """A layered small-world graph over the rows of x. layers[0] covers all rows; layer l's rows are the first sizes[l] of the build order."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], sizes: list[int], order: np.ndarray) -> None:
        self.x, self.layers, self.sizes, self.order = x, layers, sizes, order

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 0) -> Graph:
        n = len(x)
        order = np.random.default_rng(seed).permutation(n)
        y = np.ascontiguousarray(x[order], np.float32)
        sizes = [n]
        while sizes[-1] > 256:
            sizes.append(max(1, sizes[-1] // links))
        g = cls(y, [np.zeros((0, 0), np.int32)] * len(sizes), sizes, order)
        for level in range(len(sizes) - 1, -1, -1):
            g._layer(level, links * (2 if level == 0 else 1), links, ef)
        return g

    def _layer(self, level: int, most: int, links: int, ef: int) -> None:
        x, n = self.x, self.sizes[level]
        start = n if level == len(self.sizes) - 1 else self.sizes[level + 1]
        nbr = np.full((n, most), -1, np.int32)
        ids, d = _exact(x, np.arange(start), min(ef, 48))
        if ids.shape[1]:
            nbr[:start] = _pad(_diverse(x, ids, d, links), most)
            self._link_back(nbr, np.arange(start), most)
        while start < n:
            stop = min(n, start + min(max(start, 256), 2048))
            new = np.arange(start, stop)
            entry = self._descend(x[new], level)
            i1, d1 = _beam(x, nbr[:start], x[new], entry, ef)
            i2, d2 = _exact(x, new, 16)
            ids, d = _sorted_unique(np.concatenate([i1, i2], 1), np.concatenate([d1, d2], 1), ef)
            nbr[new] = _pad(_diverse(x, ids, d, links), most)
            self._link_back(nbr, new, most)
            start = stop
        self.layers[level] = nbr

    def _link_back(self, nbr: np.ndarray, new: np.ndarray, most: int) -> None:
        """Links from the neighbours of `new` back to it; a node with too many keeps a diverse choice."""
        src = np.repeat(new, nbr.shape[1])
        dst = nbr[new].ravel().astype(np.int64)
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        d = np.einsum("nd,nd->n", self.x[src] - self.x[dst], self.x[src] - self.x[dst])
        o = np.lexsort((d, dst))
        src, dst = src[o], dst[o]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(min(count.max(initial=0), 2 * most))
        place = np.arange(len(dst)) - np.repeat(first, count)
        inn = np.full((len(to), width), -1, np.int64)
        fits = place < width
        inn[np.repeat(np.arange(len(to)), count)[fits], place[fits]] = src[fits]
        for lo in range(0, len(to), 4096):
            t = to[lo : lo + 4096]
            ids = np.concatenate([nbr[t].astype(np.int64), inn[lo : lo + 4096]], 1)
            ids, dd = _sorted_unique(ids, _sq(self.x, ids, self.x[t]), ids.shape[1])
            over = (ids >= 0).sum(1) > most
            nbr[t[~over]] = ids[~over, :most]
            if over.any():
                nbr[t[over]] = _diverse(self.x, ids[over], dd[over], most)

    def _descend(self, q: np.ndarray, level: int, e: int = 8) -> np.ndarray:
        """Entry points into `level`: the best of the layer above, found from the top down. The top layer is scanned."""
        top = len(self.sizes) - 1
        if level == top:
            return np.zeros((len(q), 1), np.int64)
        y = self.x[: self.sizes[top]]
        k = min(e, len(y))
        out = np.empty((len(q), k), np.int64)
        nn = np.einsum("nd,nd->n", y, y)
        for lo in range(0, len(q), 4096):
            dist = nn[None] - 2 * q[lo : lo + 4096] @ y.T
            out[lo : lo + 4096] = np.argpartition(dist, k - 1, axis=1)[:, :k]
        for at in range(top - 1, level, -1):
            out, _ = _beam(self.x, self.layers[at], q, out, max(e, 16))
            out = out[:, :e]
        return out

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers of the k nearest, squared distances), -1 and inf where there are fewer."""
        q = np.ascontiguousarray(q, np.float32)
        if len(self.sizes) == 1:  # a single layer is small enough to scan
            d = np.maximum((q * q).sum(1)[:, None] + (self.x * self.x).sum(1)[None] - 2 * q @ self.x.T, 0)
            i = np.argsort(d, axis=1, kind="stable")[:, :k]
            d = np.take_along_axis(d, i, 1)
            if i.shape[1] < k:
                i, d = np.pad(i, ((0, 0), (0, k - i.shape[1])), constant_values=-1), np.pad(d, ((0, 0), (0, k - d.shape[1])), constant_values=np.inf)
        else:
            i, d = _beam(self.x, self.layers[0], q, self._descend(q, 0), max(ef, k))
            i, d = i[:, :k], d[:, :k]
        return np.where(i >= 0, self.order[i], -1), d

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, x=self.x, sizes=np.array(self.sizes), order=self.order, **{f"l{i}": a for i, a in enumerate(self.layers)})
        return f.getvalue()

    @classmethod
    def load(cls, b: bytes) -> Graph:
        z = np.load(io.BytesIO(b))
        return cls(z["x"], [z[f"l{i}"] for i in range(len(z["sizes"]))], z["sizes"].tolist(), z["order"])


def _pad(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=-1)


def matrix(col) -> np.ndarray:
    """(rows, dimensions) float32 of an Arrow column of equally long lists."""
    c = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    n = len(c)
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def usable_vectors(df: DataFrame, key: str = "cell_id", vec: str = "vec", unit: bool = False) -> DataFrame:
    """(id, vec): one usable vector per key. Left out are NULL keys, NULL or empty vectors, those with a NULL, NaN or infinite entry, and all-zero ones.

    Of a key's repeated rows one is kept. With unit, vectors are scaled to length 1, so that Euclidean order is cosine order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            n = np.diff(v.offsets.to_numpy())
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(n):
                start = np.cumsum(n) - n
                x = x / np.repeat(np.maximum.reduceat(np.abs(x), start), n)
                x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, start)), n)
            offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "vec": pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.float32)))})

    kind = df.schema[key].dataType.simpleString()
    # before the groupBy, since NaN is above all numbers and would hide an id's usable row; NaN < inf is false too
    usable = F.forall(vec, lambda e: F.abs(e) < float("inf")) & F.exists(vec, lambda e: e != 0)
    rows = df.where(F.col(key).isNotNull() & usable).select(F.col(key).alias("id"), F.col(vec).alias("vec")).groupBy("id").agg(F.max("vec").alias("vec"))
    rows = rows.select("id", F.col("vec").cast("array<float>").alias("vec"))
    return rows.mapInArrow(run, f"id {kind}, vec array<float>") if unit else rows


def _fit(x: np.ndarray, c: int, seed: int = 5, rounds: int = 3) -> np.ndarray:
    """c centroids of x by Lloyd's rounds from spread starting points; an empty one moves to a far point."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    cen = x[rng.choice(len(x), c, replace=False)]
    for _ in range(rounds):
        s, n = np.zeros(cen.shape, np.float64), np.zeros(c, np.int64)
        off = np.empty(len(x), np.float32)
        for lo in range(0, len(x), 2000):  # by blocks, so that the driver never holds all distances
            y = x[lo : lo + 2000]
            d = y @ (-2 * cen.T)
            d += (cen * cen).sum(1)[None]
            a = d.argmin(1)
            off[lo : lo + 2000] = d[np.arange(len(y)), a] + (y * y).sum(1)
            np.add.at(s, a, y)
            n += np.bincount(a, minlength=c)
        far = np.argsort(-off)[: (n == 0).sum()]
        cen = (s / np.maximum(n, 1)[:, None]).astype(np.float32)
        cen[n == 0] = x[far]
    return cen


def _divide(cen: np.ndarray, size: np.ndarray, groups: list[np.ndarray], most: int) -> np.ndarray:
    """The shard of each cell: groups of cells are halved across their widest direction until a part has at most `most` vectors or is a single cell."""
    shard, todo, n = np.zeros(len(cen), np.int64), list(groups), 0
    while todo:
        part = todo.pop()
        if len(part) == 1 or size[part].sum() <= most:
            shard[part] = n
            n += 1
            continue
        y = cen[part].astype(np.float64)
        y -= y.mean(0)
        o = np.argsort(y @ np.linalg.eigh(y.T @ y)[1][:, -1], kind="stable")
        upto = np.cumsum(size[part][o])
        cut = min(max(int(np.searchsorted(upto, upto[-1] / 2)), 1), len(part) - 1)
        todo += [part[o[:cut]], part[o[cut:]]]
    return shard


def _nearest_cell(x: np.ndarray, cen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, distance to its centroid) of each row of x."""
    cell, off, cc = np.zeros(len(x), np.int32), np.zeros(len(x)), (cen * cen).sum(1)
    step, minus = max(16, 1_000_000 // len(cen)), -2 * cen.T
    for lo in range(0, len(x), step):
        y = x[lo : lo + step]
        d = y @ minus
        d += cc[None]
        c = d.argmin(1)
        cell[lo : lo + step], off[lo : lo + step] = c, np.linalg.norm(y - cen[c], axis=1)
    return cell, off


def _apart(cen: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the centroids a (rows) and b (columns)."""
    cc = (cen * cen).sum(1)
    return np.sqrt(np.maximum(cc[a][:, None] + cc[b][None] - 2 * cen[a] @ cen[b].T, 1e-12))


def _crossings(x: np.ndarray, cell: np.ndarray, at: np.ndarray, kth: np.ndarray, cen: np.ndarray) -> np.ndarray:
    """Of the neighbours (rows of x, -1 padded) that lie in other cells: how many have the plane between the two cells at each hundredth of kth from the vector."""
    cells, of = np.unique(cell, return_inverse=True)
    d2 = np.square(x).sum(1)[:, None] + np.square(cen[cells]).sum(1)[None] - 2 * x @ cen[cells].T
    row, j = np.nonzero((at >= 0) & (of[at] != of[:, None]) & ((kth > 0) & np.isfinite(kth))[:, None])
    other = of[at[row, j]]
    part = (d2[row, other] - d2[row, of[row]]) / (2 * _apart(cen, cells, cells)[of[row], other] * kth[row])
    return np.bincount(np.clip(np.ceil(part * 100), 0, 100).astype(np.int64), minlength=101)


def _within(x: np.ndarray, cell: np.ndarray, kth: np.ndarray, cen: np.ndarray, radius: np.ndarray, group: np.ndarray, most: int, slack: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(row of x, group): of each row's groups of cells that may have a vector nearer than kth, its own left out, the `most` most likely ones.

    A vector of another cell is behind the plane between the two centroids and within its cell's radius. The smaller that plane's distance in parts of kth, the
    likelier; beyond `slack` parts nothing is looked for. A row without k neighbours so far (infinite kth) asks as many groups as there are.
    """
    o = np.argsort(group, kind="stable")  # the cells of a group stand together
    cen_o, radius_o, first = cen[o], radius[o].astype(np.float32), np.searchsorted(group[o], np.arange(int(group.max()) + 1))
    cc, minus, out = (cen_o * cen_o).sum(1), -2 * cen_o.T, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(16, 500_000 // len(cen))
    for lo in range(0, len(x), step):
        y, c, far = x[lo : lo + step], cell[lo : lo + step], kth[lo : lo + step].astype(np.float32)
        yy = np.square(y).sum(1)
        cells, of = np.unique(c, return_inverse=True)
        half = 0.5 / _apart(cen, cells, o)
        plane = y @ minus
        plane += cc[None]
        beyond = plane >= np.square((radius_o[None] + far[:, None]) * np.float32(1 + 1e-5)) - yy[:, None]
        plane -= (np.square(y - cen[c]).sum(1) - yy)[:, None]
        plane *= half[of]
        plane[beyond] = np.inf
        near = np.minimum.reduceat(plane, first, axis=1)
        near[np.arange(len(y)), group[c]] = np.inf
        ok = near < np.float32(slack) * far[:, None]
        many = np.flatnonzero((ok.sum(1) > most) & np.isfinite(far))
        if len(many):
            ok[many] &= near[many] <= np.partition(near[many], most - 1, axis=1)[:, most - 1 : most]
        row, to = np.nonzero(ok)
        out.append((row + lo, to))
    return np.concatenate([r for r, _ in out]), np.concatenate([t for _, t in out])


def _finer(placed: DataFrame, big: dict[int, int], most: int) -> np.ndarray:
    """Centroids for the cells `big` (cell -> vectors), two for each shard that a cell will make, fitted within each cell on FINE_ROWS vectors a centroid."""
    share = F.broadcast(placed.sparkSession.createDataFrame([(c, -(-2 * n // most), max(1, most // (2 * FINE_ROWS))) for c, n in big.items()], "cell int, _c int, _m int"))
    some = placed.join(share, "cell").where(F.pmod(F.xxhash64("id", F.lit(9)), F.col("_m")) == 0).select("cell", "_c", "vec")

    def fit(t: pa.Table) -> pa.Table:
        x = matrix(t.column("vec"))
        c = _fit(x, min(len(x), t.column("_c")[0].as_py()))
        return pa.table({"c": pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1]), pa.array(c.ravel()))})

    return matrix(some.groupBy("cell").applyInArrow(fit, "c array<float>").toArrow().column("c"))


def copies(asked: dict[int, int], shard_rows: int) -> dict[int, int]:
    """Copies of each asked shard: one for each ASKED_SHARDS * shard_rows rows or part of that, so at most one for each shard and one for each so many rows asked."""
    return {shard: -(-n // (ASKED_SHARDS * shard_rows)) for shard, n in asked.items() if n > 0}


def knn(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH, sample_rows: int = SAMPLE_ROWS, reach: float | None = None, most_cells: int = MOST_CELLS, most_asked: int = ASKED_MOST) -> DataFrame:
    """(id, neighbour, distance): the k nearest other vectors (Euclidean) of every row of (id, vec), nearest first within an id; ids are unique, vectors equally long.

    Approximate: nearly all neighbours are found, see the README for the recall measured. Equal distances are ordered by id. With no more than k other vectors
    all come out; an empty table gives no rows. Equal vectors, however many, are split into shards of bounded size. With `reach` only neighbours at most that far
    away are wanted. A vector with k neighbours in its shard (or with `reach`) asks at most `most_asked` other shards. The driver holds the cells' centroids: up to
    most_cells, and beyond that two for each 2 * shard_rows vectors.
    """
    lists = neighbour_lists(vectors, k, shard_rows, ef, sample_rows, reach, most_cells, most_asked)
    merged = lists.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    best = F.slice(F.array_sort("near"), 1, k)
    return merged.select("id", F.explode(best).alias("x")).select("id", F.col("x.id").alias("neighbour"), F.col("x.d").alias("distance"))


def neighbour_lists(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH, sample_rows: int = SAMPLE_ROWS, reach: float | None = None, most_cells: int = MOST_CELLS, most_asked: int = ASKED_MOST) -> DataFrame:
    """(id, shard, near): what `knn` merges. A row of each vector with its neighbours in its own shard, and one for each other shard that has nearer ones; shard is the vector's own in all of them."""
    spark = vectors.sparkSession
    kind = vectors.schema["id"].dataType.simpleString()
    found = f"id {kind}, shard int, near array<struct<d: double, id: {kind}>>"
    since = mark()
    vectors = vectors if getattr(vectors, "_path", None) and vectors.columns == ["id", "vec"] else materialize(vectors.select("id", "vec"), "vectors")
    n = vectors.count()
    if n < 2:
        return spark.createDataFrame([], found)
    m = -(-n // sample_rows)
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(m)) == 0).limit(2 * sample_rows).select("vec").toArrow()
    sample = matrix((some if some.num_rows else vectors.limit(1).select("vec").toArrow()).column("vec"))
    most = 2 * shard_rows
    # cells are small, so that their bounds are tight; shards are groups of neighbouring cells
    cen = _fit(sample, 1 if n <= shard_rows else min(most_cells, max(1, n // CELL_ROWS), len(sample)))

    def place(cen: np.ndarray) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell, off = _nearest_cell(matrix(b.column(1)), cen)
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "vec": b.column(1), "cell": pa.array(cell), "off": pa.array(off)})

        placed = vectors.mapInArrow(assign, f"id {kind}, vec array<float>, cell int, off double")
        placed = materialize(placed, "placed") if len(cen) > 1 else placed
        radius, size = np.zeros(len(cen), np.float32), np.zeros(len(cen), np.int64)
        t = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("r")).toArrow()
        at = t.column("cell").to_numpy()
        radius[at], size[at] = t.column("r").to_numpy(), t.column("n").to_numpy()
        return placed, radius, size

    placed, radius, size = place(cen)
    for _ in range(REFINED):
        big = {int(c): int(size[c]) for c in np.flatnonzero((size > most) & (radius > 0))}
        if not big:
            break
        cen = np.concatenate([np.delete(cen, list(big), 0), _finer(placed, big, most)])
        placed, radius, size = place(cen)
    mid = _fit(cen, min(len(cen), 256, -(-n // shard_rows)), rounds=8)
    near_mid = _nearest_cell(cen, mid)[0]
    group = _divide(cen, size, [np.flatnonzero(near_mid == g) for g in np.unique(near_mid)], most)
    groups = int(group.max()) + 1
    pieces = np.maximum(1, -(-np.bincount(group, size, groups).astype(np.int64) // most))
    first = np.r_[0, np.cumsum(pieces)[:-1]]
    split = pa.table({"cell": np.arange(len(group), dtype=np.int32), "_first": first[group].astype(np.int32), "_pieces": pieces[group].astype(np.int32)})
    split = F.broadcast(spark.createDataFrame(split))
    placed = placed.join(split, "cell").select("id", "vec", "cell", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_pieces"))).cast("int").alias("shard"))
    placed = materialize(placed, "placed")
    free_tables(since, placed)
    shards = int(pieces.sum())

    near = pa.list_(pa.struct([("d", pa.float64()), ("id", _arrow(kind))]))

    def lists(at: np.ndarray, d: np.ndarray, ok: np.ndarray, ids: pa.Array) -> pa.Array:
        items = pa.StructArray.from_arrays([pa.array(np.sqrt(d[ok]).astype(np.float64)), ids.take(pa.array(at[ok]))], names=["d", "id"])
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ok.sum(1))].astype(np.int32)), items)

    def near_enough(at: np.ndarray, d: np.ndarray) -> np.ndarray:
        return at >= 0 if reach is None else (at >= 0) & (d <= reach * reach * 1.0001)

    def build(t: pa.Table) -> pa.Table:
        """The shard's rows with their neighbours in it, and one row without an id that has the crossings as its vector."""
        x, cell = matrix(t.column("vec")), t.column("cell").to_numpy()
        at, d = _neighbours(x, k, ef)
        rows = t.select(["id", "vec", "cell", "shard"]).append_column("near", lists(at, d, near_enough(at, d), t.column("id").combine_chunks()))
        if shards == 1:
            return rows
        crossed = _crossings(x, cell, at, np.sqrt(d[:, -1]), cen).astype(np.float32)
        last = [pa.array([crossed], pa.list_(pa.float32())).cast(c.type) if c.name == "vec" else pa.nulls(1, c.type) for c in rows.schema]
        return pa.concat_tables([rows, pa.table(last, schema=rows.schema)])

    built = placed.repartition(shards, "shard").groupBy("shard").applyInArrow(build, f"id {kind}, vec array<float>, cell int, shard int, near array<struct<d: double, id: {kind}>>")
    if shards == 1:
        return built.select("id", "shard", "near")
    built = materialize(built, "built")
    free_tables(since, built)
    crossed = np.cumsum(matrix(built.where(F.col("id").isNull()).select("vec").toArrow().column("vec")).sum(0, dtype=np.float64))
    # neighbours that the shards hold in other cells show how far beyond a plane neighbours lie: in many dimensions hardly any is near the end of its reach
    slack = min(1.0, float(np.searchsorted(crossed, CROSSED * crossed[-1])) / 100) if crossed[-1] >= CROSSED_ROWS else 1.0
    farthest = float("inf") if reach is None else float(reach)
    kth = F.when(F.size("near") >= k, F.least(F.element_at("near", k)["d"], F.lit(farthest))).otherwise(F.lit(farthest)).cast("double").alias("kth")
    home = built.where(F.col("id").isNotNull()).select("id", "vec", "cell", "shard", "near", kth)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, cell, shard = matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()
            far = b.column(4).to_numpy(zero_copy_only=False)
            row, to = _within(x, cell, far, cen, radius, group, most_asked, slack)
            split = np.flatnonzero((pieces[group[cell]] > 1) & (far > 0))  # the other pieces of the own cells
            row, to = np.r_[row, split], np.r_[to, group[cell[split]]]
            rep = pieces[to]
            row, to = np.repeat(row, rep), np.repeat(first[to], rep) + (np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep))
            other = to != shard[row]
            yield pa.RecordBatch.from_pydict({"id": b.column(0).take(pa.array(row[other])), "shard": pa.array(to[other].astype(np.int32))})

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of each asking row the neighbours in this shard that are nearer than the ones it has; rows without any are left out."""
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": left.column("id").slice(0, 0), "shard": pa.array([], pa.int32()), "near": pa.array([], near)})
        some, at, d = _nearer(matrix(right.column("_vec")), matrix(left.column("vec")), k, left.column("kth").to_numpy(), ef)
        return pa.table({"id": left.column("id").take(pa.array(some)), "shard": left.column("_own").take(pa.array(some)), "near": lists(at, d, near_enough(at, d), right.column("_id").combine_chunks())})

    asked = home.select("id", "vec", "cell", "shard", "kth").mapInArrow(route, f"id {kind}, shard int")
    asked = materialize(asked, "asked")
    # what is asked of a shard comes in parts of bounded size, each with its own copy of that shard; a shard that nobody asks isn't copied
    parts = copies({r.shard: r["count"] for r in asked.groupBy("shard").count().collect()}, shard_rows)
    parts = F.broadcast(spark.createDataFrame(list(parts.items()), "shard int, _parts int"))
    asked = asked.join(parts, "shard").select("id", "shard", F.pmod(F.xxhash64("id", F.lit(3)), F.col("_parts")).cast("int").alias("part"))
    asked = asked.join(home.select("id", "vec", "kth", F.col("shard").alias("_own")), "id")
    sent = home.select(F.col("id").alias("_id"), F.col("vec").alias("_vec"), "shard").join(parts, "shard").select("_id", "_vec", "shard", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"))
    away = asked.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInArrow(look, found)
    return home.select("id", "shard", "near").unionByName(away)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(cell_a, cell_b), cell_a < cell_b: pairs of which at least one is a neighbour of the other."""
    return near.select(F.least("id", "neighbour").alias("cell_a"), F.greatest("id", "neighbour").alias("cell_b")).distinct()
