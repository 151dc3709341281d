"""Quality scores by Bradley-Terry ranking: P(a preferred to b) = sigmoid(s(a) - s(b)), s linear in features.

Pairs of a good and a bad labelled document give feature differences; the logistic loss on them is minimised by
Newton's method with a ridge.  A quantile of the training scores, at the share of bad documents, is the threshold;
scores are mapped to 0..1 so that the threshold falls on ``cut``.

Without a bound on the sample every labelled document is learned from, where it lies: each is compared once with a bar
whose strength is learned too, which a good one beats and a bad one does not (both kinds weigh the same in all), so the
sums of a Newton step are over documents and only they reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import textstats as T


@dataclass
class Ranking:
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the standardised features and of their squares
    threshold: float
    slope: float
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, z * z]) @ self.weights

    def raw_column(self) -> Column:
        """raw as a Spark expression over the feature columns."""
        k, s = len(self.names), F.lit(0.0)
        for i, name in enumerate(self.names):
            z = F.least(F.lit(6.0), F.greatest(F.lit(-6.0), (F.col(name) - float(self.mean[i])) / float(self.scale[i])))
            s = s + z * float(self.weights[i]) + z * z * float(self.weights[k + i])
        return s

    def column(self) -> Column:
        """The score as a Spark expression over the feature columns."""
        s, at = self.raw_column(), np.log(self.cut / (1 - self.cut))
        u = (s - float(self.threshold)) * float(self.slope) + float(at)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.lit(40.0), F.greatest(F.lit(-40.0), u))))


def fit(names: list[str], x: np.ndarray, y: np.ndarray, pairs: int = 20_000, ridge: float = 1e-2, cut: float = 0.3, seed: int = 7) -> Ranking:
    """Learns from features x and labels y.  With one class only, all weights are 0 and every score equals cut."""
    k = len(names)
    mean = x.mean(0) if len(x) else np.zeros(k)
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(k)
    w = np.zeros(2 * k)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    model = Ranking(list(names), mean, scale, w, 0.0, 1.0, cut)
    if not len(good) or not len(bad):
        return model
    rng = np.random.default_rng(seed)
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.hstack([z, z * z])
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        g = d.T @ (p - 1) / pairs + ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(2 * k)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    model.weights = w
    s = model.raw(x)
    # The quantile at the share of bad documents, in the widest gap of scores near it.
    order = np.sort(s)
    at = len(bad)
    lo, hi = max(1, int(at * 0.97)), min(len(s) - 1, int(at * 1.03) + 1)
    best = lo + int(np.argmax(order[lo : hi + 1] - order[lo - 1 : hi])) if hi >= lo else min(at, len(s) - 1)
    model.threshold = float((order[best - 1] + order[best]) / 2) if 0 < best < len(s) else float(np.quantile(s, at / len(s)))
    spread = float(np.median(s[good]) - np.median(s[bad]))
    model.slope = 6.0 / max(spread, 1e-6)
    return model


def _sums(rows: DataFrame, names: list[str], fn) -> np.ndarray:
    """The sum over all rows of fn(x, y), an array for the rows of a batch."""

    def part(batches):
        total = None
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            v = fn(x, b.column("y").to_numpy(zero_copy_only=False))
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])
        C.release()

    return sum(np.frombuffer(r.v) for r in rows.select("y", *names).mapInArrow(part, "v binary").collect())


def _ranks(scored: DataFrame, ranges: dict[str, tuple[str, int, int]], bins: int = 1 << 16) -> dict[str, np.ndarray]:
    """For each name the scores s of ranks lo..hi (from 0) among the rows of a kind (all, or those of one y): a histogram
    finds the bins that hold them, and only distinct scores of those bins reach the driver."""
    low, high = scored.agg(F.min("s"), F.max("s")).first()
    place = F.least(F.lit(bins - 1), F.floor((F.col("s") - low) / max(high - low, 1e-300) * bins)).cast("int")
    scored = scored.select("y", "s", place.alias("bin"))
    counts = np.zeros((2, bins), np.int64)
    for r in scored.groupBy("y", "bin").agg(F.count("*").alias("n")).collect():
        counts[r.y, r.bin] = r.n
    kinds, found, wanted = {"all": [0, 1], "bad": [0], "good": [1]}, {}, F.lit(False)
    for name, (kind, lo, hi) in ranges.items():
        ends = np.cumsum(counts[kinds[kind]].sum(0))
        a, b = (int(np.searchsorted(ends, x, side="right")) for x in (lo, hi))
        found[name] = a, b, int(ends[a - 1]) if a else 0
        wanted = wanted | F.col("bin").between(a, b)
    rows = scored.where(wanted).groupBy("y", "bin", "s").agg(F.count("*").alias("n")).toPandas().sort_values("s")
    out = {}
    for name, (kind, lo, hi) in ranges.items():
        a, b, before = found[name]
        own = rows[rows["bin"].between(a, b) & rows["y"].isin(kinds[kind])]
        out[name] = np.repeat(own["s"].to_numpy(), own["n"].to_numpy())[lo - before : hi - before + 1]
    return out


def fit_all(names: list[str], rows: DataFrame, ridge: float = 1e-2, cut: float = 0.3) -> Ranking:
    """Learns from every row of a table of features and y.  With one class only, all weights are 0 and every score equals cut."""
    k = len(names)
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n, bad, good = sum(counts.values()), counts.get(0, 0), counts.get(1, 0)
    model = Ranking(list(names), np.zeros(k), np.ones(k), np.zeros(2 * k), 0.0, 1.0, cut)
    if not good or not bad:
        return model
    mean = model.mean = _sums(rows, names, lambda x, y: x.sum(0)) / n
    scale = model.scale = np.maximum(np.sqrt(_sums(rows, names, lambda x, y: ((x - mean) ** 2).sum(0)) / n), 1e-3)
    w = np.zeros(2 * k + 1)  # the last is the bar's

    def step(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -6, 6)
        z = np.hstack([z, z * z, np.full((len(z), 1), -1.0)])
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        weight = np.where(y == 1, 0.5 / good, 0.5 / bad)
        return np.concatenate([z.T @ (weight * (p - y)), ((z * (weight * p * (1 - p))[:, None]).T @ z).ravel()])

    keep = np.append(np.full(2 * k, ridge), 1e-9)
    for _ in range(25):
        v = _sums(rows, names, step)
        move = np.linalg.solve(v[2 * k + 1 :].reshape(2 * k + 1, -1) + np.diag(keep), v[: 2 * k + 1] + keep * w)
        w = w - move
        if np.abs(move).max() < 1e-7:
            break
    model.weights = w[:-1]
    # The quantile at the share of bad documents, in the widest gap of scores near it.
    lo, hi = max(1, int(bad * 0.97)), min(n - 1, int(bad * 1.03) + 1)
    got = _ranks(rows.select("y", model.raw_column().alias("s")), {"gap": ("all", lo - 1, hi), "good": ("good", (good - 1) // 2, good // 2), "bad": ("bad", (bad - 1) // 2, bad // 2)})
    best = int(np.argmax(np.diff(got["gap"])))
    model.threshold = float((got["gap"][best] + got["gap"][best + 1]) / 2)
    model.slope = 6.0 / max(float(got["good"].mean() - got["bad"].mean()), 1e-6)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int | None = 20_000, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text", learn: str | None = None, common_sample: int = 1000, pairs: int = 20_000) -> tuple[DataFrame, Ranking]:
    """Per document: id, features, score (0 to 1), predicted (1 if score >= cut); and the model.

    Learned from at most ``sample`` labelled documents, those of least xxhash64(id), by ``pairs`` random pairs of a good
    and a bad one; the common words come from the first ``common_sample`` ids of them.  Where ``sample`` is None, from all
    labelled documents, without pairs among them, and the words of all documents that ``learn`` admits.  Every document is scored on its
    whole text, however long.  Null and empty texts are scored by their features, all 0.  Without labels of both kinds
    every score is ``cut``.  An id with several labels has the greatest.  Repeated rows score alike and are learned from
    once; an empty table gives no rows; other columns don't matter, whatever their names.
    """
    if sample is None:
        table, common = T.learning_table(docs, labels, label, id_col, text_col, learn)
        model = fit_all(T.SHAPE, table, cut=cut)
        C.discard(table)
    else:
        rows, common = T.learning_rows(docs, labels, label, sample, id_col, text_col, learn, common_sample)
        model = fit(T.SHAPE, rows[T.SHAPE].to_numpy(float), rows["y"].to_numpy(int), pairs, cut=cut)
    out = T.with_statistics(docs, id_col, text_col, common).withColumn("score", model.column())
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0)), model
