"""Many sequences of an Arrow batch as one flat array: scans, windows and sums without a Python loop for each of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..model import BASES

CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(BASES):
    CODE[ord(_b)] = CODE[ord(_b.lower())] = _i

#: Scores held at a time, and the longest kernel that is looked up as a whole.
CELLS, LOOKUP = 8_000_000, 6


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column: one byte a character, ``?`` for those beyond ASCII; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    wide = pa.types.is_large_string(col.type)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, at, data = col.buffers()
    o = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    if (b >= 0x80).any():
        parts = [x.encode("ascii", "replace") for x in col.to_pylist()]
        o = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        b = np.frombuffer(b"".join(parts), np.uint8)
    return o - o[0], b


@dataclass
class Flat:
    """Some rows' sequences: row ``first + i`` has codes[offsets[i] : offsets[i + 1]], and score places at starts[i] and on."""

    first: int
    offsets: np.ndarray
    codes: np.ndarray  # 0 to 3 in the order ACGT, 4 for anything else
    starts: np.ndarray  # where each row's score places begin, and their number at the end
    scores: np.ndarray  # (motif, place)
    row: np.ndarray  # of each place
    p: np.ndarray  # of each place, within its row

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def counts(self) -> np.ndarray:
        """Number of score places of each row."""
        return np.diff(self.starts)

    def groups(self, value: np.ndarray) -> np.ndarray:
        return np.repeat(value, self.counts)


def scan_codes(codes: np.ndarray, kernels: np.ndarray) -> np.ndarray:
    """(motif, place) scores of every place of the flat array, windows across rows too; negative ones become 0."""
    n, (motifs, m, _) = len(codes), kernels.shape
    places = max(0, n - m + 1)
    k = np.concatenate([kernels, np.zeros((motifs, m, 1), np.float32)], 2).astype(np.float32)
    if not places:
        return np.zeros((motifs, 0), np.float32)
    if m <= LOOKUP:
        # Every word of m symbols has its score in a table of 5 ** m.
        table, word = np.zeros((motifs, 1), np.float32), np.zeros(places, np.int32)
        for j in range(m):
            table = (table[:, :, None] + k[:, j, None, :]).reshape(motifs, -1)
            word = word * 5 + codes[j : j + places]
        return np.maximum(table, 0)[:, word]
    x = np.eye(5, 4, dtype=np.float32)[codes]
    windows = np.lib.stride_tricks.sliding_window_view(x, m, axis=0)  # (place, base, offset)
    flat = kernels.transpose(0, 2, 1).reshape(motifs, -1).T.astype(np.float32)
    out = np.empty((places, motifs), np.float32)
    for a in range(0, places, 1 << 16):
        out[a : a + (1 << 16)] = windows[a : a + (1 << 16)].reshape(-1, 4 * m) @ flat
    return np.maximum(out.T, 0)


def scanned(seq: pa.Array, kernels: np.ndarray, cells: int = CELLS) -> Iterator[Flat]:
    """The rows of a column, some at a time: as many as hold ``cells`` scores together, one at least."""
    offsets, data = string_bytes(seq)
    codes = CODE[data]
    for i, j in _portions(offsets, cells // max(1, len(kernels))):
        yield _flat(i, offsets[i : j + 1] - offsets[i], codes[offsets[i] : offsets[j]], kernels)


def _portions(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of rows with ``most`` symbols together, one row at least."""
    i, n, most = 0, len(offsets) - 1, max(1, most)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _flat(first: int, o: np.ndarray, own: np.ndarray, kernels: np.ndarray) -> Flat:
    counts = np.maximum(np.diff(o) - kernels.shape[1] + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(counts)), counts)
    p = np.arange(int(starts[-1])) - np.repeat(starts[:-1], counts)
    scores = scan_codes(own, kernels)[:, o[row] + p] if len(p) else np.zeros((len(kernels), 0), np.float32)
    return Flat(first, o, own, starts, scores, row, p)


def reversed_codes(o: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The codes of each row's reverse complement, in its place."""
    at = np.repeat(o[:-1] + o[1:] - 1, np.diff(o)) - np.arange(len(codes))
    return np.array([3, 2, 1, 0, 4], np.uint8)[codes[at]]


def scanned_both(seq: pa.Array, kernels: np.ndarray, both: bool, cells: int = CELLS) -> Iterator[tuple[Flat, ...]]:
    """As scanned, of each row's strands: the same rows once forward and, with ``both``, once reversed."""
    offsets, data = string_bytes(seq)
    codes = CODE[data]
    for i, j in _portions(offsets, cells // max(1, 2 * len(kernels))):
        o, own = offsets[i : j + 1] - offsets[i], codes[offsets[i] : offsets[j]]
        yield (_flat(i, o, own, kernels), *([_flat(i, o, reversed_codes(o, own), kernels)] if both else []))


def packed(f: Flat) -> pa.Array:
    """The scores of each row: an array for each motif."""
    motifs, n = len(f.scores), len(f.counts)
    out, base, wide = np.empty(f.scores.size, np.float32), f.starts[:-1][f.row] * motifs + f.p, f.counts[f.row]
    for k in range(motifs):
        out[base + k * wide] = f.scores[k]
    inner = np.append(0, np.cumsum(np.repeat(f.counts, motifs)))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * motifs), pa.ListArray.from_arrays(pa.array(inner.astype(np.int32)), pa.array(out)))


def unpacked(col: pa.Array, motifs: int, cells: int = CELLS) -> Iterator[Flat]:
    """What packed was made of, without the sequences; some rows at a time."""
    inner = col.flatten()
    sizes = inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = inner.flatten().to_numpy(zero_copy_only=False)
    counts = sizes[::motifs]
    offsets = np.append(0, np.cumsum(counts))
    for i, j in _portions(offsets, cells // max(1, motifs)):
        own, starts = counts[i:j], offsets[i : j + 1] - offsets[i]
        row = np.repeat(np.arange(j - i), own)
        p = np.arange(int(starts[-1])) - np.repeat(starts[:-1], own)
        base, part = starts[:-1][row] * motifs + p, values[offsets[i] * motifs : offsets[j] * motifs]
        scores = np.stack([part[base + k * own[row]] for k in range(motifs)]) if len(p) else np.zeros((motifs, 0), np.float32)
        yield Flat(i, starts, np.zeros(0, np.uint8), starts, scores, row, p)


def window_sums(values: np.ndarray, at: np.ndarray, group: np.ndarray, groups: int, w: int, weight: np.ndarray | None = None) -> np.ndarray:
    """(group, channel, 2 w + 1): sums of values[channel, at - w .. at + w] over the anchors of each group.

    group ascends.  One gather and one sum for each offset, for all groups at once.  weight: how often an anchor counts.
    """
    out = np.zeros((groups, len(values), 2 * w + 1))
    if not len(at):
        return out
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    own = group[cut]
    for r in range(-w, w + 1):
        x = values[:, at + r]
        out[own, :, r + w] = np.add.reduceat(x if weight is None else x * weight, cut, axis=1, dtype=np.float64).T
    return out


def cell_rows(sums: np.ndarray, keys: list[np.ndarray], w: int) -> list[np.ndarray]:
    """Columns (keys, channel, rel, value) of the cells that aren't zero."""
    g, c, r = np.nonzero(sums)
    return [*(k[g].astype(np.int64) for k in keys), c.astype(np.int64), (r - w).astype(np.int64), sums[g, c, r]]
