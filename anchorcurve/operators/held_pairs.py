"""Pairs of hits that regions hold, summed over subsets of overlapping regions, without a row for each region and hit.

A pair counts once for each region of a subset that holds both hits: the regions that begin by its first place, less
those that end by its second.  So each pair of places is met once, however many regions lie over it, and what is
shuffled are hits and regions, not what lies in each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of a tile, rows that are laid side by side at a time, and cells (subset, pair) that are summed at a time.
TILE, ROWS, CELLS = 1 << 15, 200_000, 2_000_000


def held_pairs(found: DataFrame, memberships: DataFrame, w: int, query=None, motif: str = "motif_idx") -> DataFrame:
    """subset_id, anchor_motif, motif_idx, rel, value of pairs no more than w apart within regions (subset_id, chrom, start,
    end), which are a bag: one that is named twice counts twice.  query: anchors of this motif only."""
    tile = max(TILE, 8 * w)
    whole = dict(found.dtypes)["score"] in ("tinyint", "smallint", "int", "bigint")
    kind, name = ("long", pa.int64()) if whole else ("double", pa.float64())
    names = {c: dict(f.dtypes)[c] for f, c in ((found, motif), (memberships, "subset_id"))}
    at = F.floor(F.col("_p") / tile).cast("long")
    hits = found.where(F.col("chrom").isNotNull()).groupBy("chrom", F.col("center_pos").cast("long").alias("_p"), F.col(motif).alias("_m"))
    hits = hits.agg(F.count("*").alias("_n"), F.sum("score").cast(kind).alias("_v")).where("_p is not null")
    # A tile holds the first places of its pairs; second ones may lie beyond its end.
    hits = hits.withColumn("_t", F.explode(F.when(F.col("_p") - at * tile < w, F.array(at, at - 1)).otherwise(F.array(at))))
    t = F.explode(F.expr(f"sequence(cast(floor(start / {tile}) as long), cast(floor((end - 1) / {tile}) as long))"))
    regions = memberships.where("end > start and chrom is not null").select("subset_id", "chrom", "start", "end", t.alias("_t"))
    # Cut to the tile and its flanks: a region that is wider than w stays so.
    low, high = F.col("_t") * tile - (w + 1), (F.col("_t") + 1) * tile + 2 * w + 2
    regions = regions.groupBy("chrom", "_t", F.col("subset_id").alias("_s"), F.greatest("start", low).cast("long").alias("_p"), F.least("end", high).cast("long").alias("_e")).agg(F.count("*").alias("_n"))
    cols = ["chrom", "_t", "_p", "_e", "_m", "_s", "_n", "_v"]
    rows = hits.select("chrom", "_t", "_p", F.lit(None).cast("long").alias("_e"), "_m", F.lit(None).cast(names["subset_id"]).alias("_s"), "_n", "_v")
    rows = rows.unionByName(regions.select("chrom", "_t", "_p", "_e", F.lit(None).cast(names[motif]).alias("_m"), "_s", "_n", F.lit(None).cast(kind).alias("_v")))
    rows = rows.select(F.col("chrom").cast("string").alias("chrom"), *cols[1:]).repartition("chrom", "_t").sortWithinPartitions("chrom", "_t")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            yield from _tiles(t, tile, w, query, whole, name)

    out = rows.mapInArrow(fn, f"subset_id {names['subset_id']}, anchor_motif {names[motif]}, motif_idx {names[motif]}, rel long, value {kind}")
    return out.groupBy("subset_id", "anchor_motif", "motif_idx", "rel").agg(F.sum("value").alias("value"))


def _changes(t: pa.Table) -> np.ndarray:
    """Where a tile begins, of rows sorted by chromosome and tile."""
    chrom = t["chrom"].combine_chunks().dictionary_encode()
    chrom = pa.concat_arrays(chrom.chunks).indices if isinstance(chrom, pa.ChunkedArray) else chrom.indices
    c, k = chrom.to_numpy(), t["_t"].to_numpy()
    return np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])] if len(c) else np.zeros(0, bool)


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole tiles, of ROWS rows or one tile at least."""
    held: list[pa.RecordBatch] = []
    size, least = 0, ROWS
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size < least:
            continue
        t = pa.Table.from_batches(held)
        last = int(np.flatnonzero(_changes(t))[-1])
        if last:
            yield t.slice(0, last)
            t = t.slice(last)
        held, size = t.to_batches(), t.num_rows
        least = max(ROWS, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def _codes(col: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """(number of each row's value, the values): null is a value as others are."""
    d = col.combine_chunks().dictionary_encode(null_encoding="encode")
    d = pa.concat_arrays(d.chunks) if isinstance(d, pa.ChunkedArray) else d
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _tiles(t: pa.Table, tile: int, w: int, query, whole: bool, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The sums of some tiles, which are laid side by side on one axis, too far apart for pairs across them."""
    number = np.cumsum(_changes(t)) - 1
    place = number * (tile + 4 * w + 8) + (w + 1) + t["_p"].to_numpy() - t["_t"].to_numpy() * tile
    is_hit = t["_e"].is_null().to_numpy()
    if is_hit.all() or not is_hit.any():
        return
    hit = t.filter(pa.array(is_hit))
    o = np.argsort(place[is_hit], kind="stable")
    p = place[is_hit][o]
    code, motifs = _codes(hit["_m"])
    code, n = code[o], hit["_n"].to_numpy()[o]
    v = hit["_v"].fill_null(0).to_numpy()[o]
    anchor = np.ones(len(motifs), bool) if query is None else np.array([m == query for m in motifs], bool)
    n = np.where(anchor[code], n, 0)
    own = hit["_p"].to_numpy()[o] < (hit["_t"].to_numpy()[o] + 1) * tile
    u, first, count = np.unique(p, return_index=True, return_counts=True)
    mem = t.filter(pa.array(~is_hit))
    begin = place[~is_hit]
    end, times = begin + mem["_e"].to_numpy() - mem["_p"].to_numpy(), mem["_n"].to_numpy()
    subset, subsets = _codes(mem["_s"])
    o = np.argsort(subset, kind="stable")
    cut = np.searchsorted(subset[o], np.arange(len(subsets) + 1))
    lists = [o[a:b] for a, b in zip(cut[:-1], cut[1:])]
    block = max(1, CELLS // len(u))
    for s in range(0, len(subsets), block):
        out: list[tuple] = []
        held = _Held(u, [(begin[k], end[k], times[k]) for k in lists[s : s + block]], w)
        for r, i, j in _apart(u, own[first], w):
            most = max(1, CELLS // len(held.wide))
            for a in range(0, len(i), most):
                out += _sums(r, i[a : a + most], j[a : a + most], held, first, count, code, n, v, len(motifs), whole)
        if out:
            k, key, rel, value = (np.concatenate(x) for x in zip(*out))
            a, b = key // len(motifs), key % len(motifs)
            take = lambda values, at: pa.array([values[x] for x in at.tolist()])
            yield pa.RecordBatch.from_arrays([take(subsets, k + s).cast(t.schema.field("_s").type), *(take(motifs, x).cast(t.schema.field("_m").type) for x in (a, b)), pa.array(rel), pa.array(value, kind)], ["subset_id", "anchor_motif", "motif_idx", "rel", "value"])


def _apart(u: np.ndarray, own: np.ndarray, w: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(r, i, j): the places with u[j] = u[i] + r, for each r from 0 to w; u ascends, its values differ."""
    i = np.flatnonzero(own)
    j = i.copy()
    far = np.append(u, np.iinfo(np.int64).max)
    for r in range(w + 1):
        want = u[i] + r
        j += far[j] < want  # one step at most, as places differ
        on = far[j] == want
        if on.any():
            yield r, i[on], j[on]


class _Held:
    """How many regions of each subset hold two places."""

    def __init__(self, u: np.ndarray, regions: list[tuple[np.ndarray, np.ndarray, np.ndarray]], w: int):
        self.u = u
        self.wide = np.zeros((len(regions), len(u)), np.int64)  # regions wider than w that begin by each place
        self.past = np.zeros((len(regions), len(u)), np.int64)  # and those that end by it
        self.narrow = []
        for k, (begin, end, times) in enumerate(regions):
            on = end - begin > w
            self.wide[k], self.past[k] = self._by(begin[on], times[on]), self._by(end[on], times[on])
            if not on.all():
                self.narrow.append((k, begin[~on], end[~on], times[~on]))

    def _by(self, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        o = np.argsort(at, kind="stable")
        return np.append(0, np.cumsum(times[o]))[np.searchsorted(at[o], self.u, side="right")]

    def both(self, r: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """(subset, pair) of places i and j, which lie r apart: no region of r places or fewer holds them."""
        out = self.wide[:, i] - self.past[:, j]
        for k, begin, end, times in self.narrow:
            on = end - begin > r
            if on.any():
                out[k] += self._by(begin[on], times[on])[i] - self._by(end[on], times[on])[j]
        return out


def _sums(r: int, i: np.ndarray, j: np.ndarray, held: _Held, first, count, code, n, v, motifs: int, whole: bool) -> list[tuple]:
    """(subset, anchor's and partner's motif as one number, offset, value) of the pairs of places i and j."""
    regions = held.both(r, i, j)
    on = np.flatnonzero(regions.any(0))
    if not len(on):
        return []
    i, j, regions = i[on], j[on], regions[:, on]
    size = count[i] * count[j]
    pair = np.repeat(np.arange(len(i)), size)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    a, b = first[i][pair] + k // count[j][pair], first[j][pair] + k % count[j][pair]
    out = []
    # At 0 each ordered pair is met by itself; beyond, the second hit is an anchor too.
    for x, y, rel in ((a, b, r), (b, a, -r))[: 2 if r else 1]:
        use = np.flatnonzero(n[x])
        if not len(use):
            continue
        key, value, own = code[x[use]] * motifs + code[y[use]], n[x[use]] * v[y[use]], pair[use]
        o = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.r_[True, key[o][1:] != key[o][:-1]])
        times = regions[:, own[o]]
        total = np.add.reduceat(times * value[o], cut, axis=1)
        s, g = np.nonzero(total if (value > 0).all() else np.add.reduceat(times, cut, axis=1))
        out.append((s, key[o][cut][g], np.full(len(s), rel, np.int64), total[s, g]))
    return out
