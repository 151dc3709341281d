"""Schemas and small driver-side objects of the engine.

Coordinates are 0-based and half open.  Long tables stand for what would be dense tensors: a missing cell is zero.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np

SEQUENCE = "chrom string, chunk_start long, seq string"
SIGNAL = "chrom string, pos long, celltype string, value double"
PEAK = "chrom string, start long, end long"
MEMBERSHIP = "subset_id string, chrom string, start long, end long"
HIT = "chrom string, start_pos long, center_pos long, motif_idx int, strand int, score double"
SCORE = "interval_id long, strand int, motif_idx int, p int, score double"
ANCHOR = "interval_id long, strand int, pos int"
# The published narrowPeak columns.
NARROWPEAK = "chrom string, start long, end long, name string, score double, strand string, signalValue double, pValue double, qValue double, peak long"
BASES = "ACGT"


@dataclass(frozen=True)
class MotifSet:
    """Names, kernels (motif, length, 4 in the order ACGT) and one threshold for each motif."""

    names: list[str]
    kernels: np.ndarray
    thresholds: list[float]
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        k = np.asarray(self.kernels, np.float32)
        if k.ndim != 3 or k.shape[2] != 4 or not len(self.names) == len(k) == len(self.thresholds):
            raise ValueError("kernels must be (motif, length, 4), with one name and one threshold for each motif")
        object.__setattr__(self, "kernels", k)

    @property
    def length(self) -> int:
        return self.kernels.shape[1]

    def take(self, indices: list[int]) -> "MotifSet":
        return MotifSet([self.names[i] for i in indices], self.kernels[indices], [self.thresholds[i] for i in indices], self.meta)

    def center_offsets(self) -> list[int]:
        """Middle of each kernel's active columns, halves to even; half the length where no column is active."""
        out = []
        for k in self.kernels:
            on = np.flatnonzero(np.abs(k).sum(1))
            out.append(int(round((int(on[0]) + int(on[-1])) / 2)) if len(on) else self.length // 2)
        return out

    def fingerprint(self) -> dict[str, str]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"names": sha("\n".join(self.names).encode()), "kernels": sha(self.kernels.tobytes()), "thresholds": sha(np.asarray(self.thresholds, np.float32).tobytes())}
