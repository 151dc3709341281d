"""Curves and their ranking: smoothing, autocorrelation, spectra, heat-map filter, context ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def smooth_array(x: np.ndarray, size: int) -> np.ndarray:
    """Moving average over ``size`` (odd) places, the ends repeated beyond the edges."""
    if size <= 0 or size % 2 == 0:
        raise ValueError("the smoothing window must be positive and odd")
    return np.convolve(np.pad(np.asarray(x, float), size // 2, mode="edge"), np.full(size, 1 / size), mode="valid")


def smooth(curve: Column, size: int) -> Column:
    """smooth_array of an array column.  Vectorised: as a nested lambda it would be evaluated anew for each place."""
    smooth_array(np.zeros(1), size)

    @F.pandas_udf("array<double>")
    def one(c: pd.Series) -> pd.Series:
        return c.map(lambda x: smooth_array(x, size) if len(x) else x)

    return one(curve)


def valid_average(curve: Column, size: int) -> Column:
    """Averages of whole windows only."""

    @F.pandas_udf("array<double>")
    def one(c: pd.Series) -> pd.Series:
        return c.map(lambda x: np.convolve(np.asarray(x, float), np.full(size, 1 / size), mode="valid") if len(x) >= size else np.zeros(0))

    return one(curve)


def autocorrelation(curves: DataFrame, key: str, delays: int) -> DataFrame:
    """key, delay, r: correlation of each curve with itself at delays 1 .. delays - 1; null where one part has no spread.

    Within each curve's array: no row for each place, and no join.  Curves without two places at a delay give no row.
    """
    kind = curves.schema[key].dataType.simpleString()

    def fn(batches):
        for pdf in batches:
            out = []
            for k, c in zip(pdf[key], pdf["curve"]):
                x = np.asarray(c, float)
                for d in range(1, min(delays, len(x))):
                    a, b = x[:-d] - x[:-d].mean(), x[d:] - x[d:].mean()
                    norm = np.sqrt((a @ a) * (b @ b))
                    out.append((k, d, float(a @ b / norm) if norm else None))
            yield pd.DataFrame(out, columns=[key, "delay", "r"]).astype({"r": float})

    return curves.select(key, "curve").mapInPandas(fn, f"{key} {kind}, delay int, r double")


def spectrum(curves: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """key, freq, period, magnitude of each curve's Fourier transform, 0 and n / 2 and beyond left out; top: the strongest."""
    kind = curves.schema[key].dataType.simpleString()

    def fn(batches):
        for pdf in batches:
            out = []
            for k, c in zip(pdf[key], pdf["curve"]):
                a = np.abs(np.fft.fft(np.asarray(c, float)))
                f = np.arange(1, (len(a) + 1) // 2)
                order = f[np.argsort(-a[f], kind="stable")][: top or len(f)]
                out += [(k, int(i), len(a) / int(i), float(a[i])) for i in order]
            yield pd.DataFrame(out, columns=[key, "freq", "period", "magnitude"])

    return curves.select(key, "curve").mapInPandas(fn, f"{key} {kind}, freq long, period double, magnitude double")


def heatmap_rows(curves: DataFrame, least_sum: float = 100.0, times: float = 5.0) -> DataFrame:
    """Curves with a sum above least_sum and a peak above ``times`` sample deviations."""
    s = F.aggregate("curve", F.lit(0.0), lambda a, x: a + x)
    n = F.size("curve")
    var = F.aggregate("curve", F.lit(0.0), lambda a, x: a + (x - s / n) * (x - s / n)) / (n - 1)
    return curves.where((s > least_sum) & (F.array_max("curve") > times * F.sqrt(var)))


def rank_contexts(curves: DataFrame, counts: DataFrame, min_regions: int = 1, size: int = 11) -> DataFrame:
    """Motifs by how much their curves differ between subsets, in shape and in amplitude.

    curves: subset_id, motif_idx, curve; counts: subset_id, n_regions.  A curve is divided by its count, its median
    subtracted, smoothed; amplitude is the greatest absolute value, shape the curve over its Euclidean norm.  Over
    subsets with enough regions and some amplitude: shape_variance is the mean over offsets of the population
    variance, amplitude_spread the population deviation of log1p(amplitude).  Fewer than two subsets: null and 0.
    Ranks share ties; null ranks last; the score is the sum of both ranks.
    """
    from ..sources.folders import cut

    curves = cut(curves, "curves")  # they are read four times below
    missing = curves.select("subset_id").distinct().join(counts, "subset_id", "left_anti").limit(1).count()
    if missing:
        raise ValueError("a subset has no region count")
    c = curves.join(counts, "subset_id").where(F.col("n_regions") >= min_regions)
    kind = curves.schema["motif_idx"].dataType.simpleString()

    def shapes(batches):
        for pdf in batches:
            x = [np.asarray(v, float) / n for v, n in zip(pdf["curve"], pdf["n_regions"])]
            x = [smooth_array(v - np.median(v), size) for v in x]
            amp = [float(np.abs(v).max()) if len(v) else 0.0 for v in x]
            on = [k for k, a in enumerate(amp) if a > 0]
            yield pd.DataFrame({"motif_idx": pdf["motif_idx"].iloc[on].to_numpy(), "amplitude": [amp[k] for k in on], "shape": [x[k] / np.sqrt((x[k] ** 2).sum()) for k in on]})

    c = c.select("motif_idx", "curve", "n_regions").mapInPandas(shapes, f"motif_idx {kind}, amplitude double, shape array<double>")
    per = c.groupBy("motif_idx").agg(F.count("*").alias("n_subsets"), F.stddev_pop(F.log1p("amplitude")).alias("spread"))
    places = c.select("motif_idx", F.posexplode("shape").alias("i", "v")).groupBy("motif_idx", "i").agg(F.var_pop("v").alias("v")).groupBy("motif_idx").agg(F.avg("v").alias("var"))
    every = curves.select("motif_idx").distinct()
    out = every.join(per, "motif_idx", "left").join(places, "motif_idx", "left")
    two = F.coalesce(F.col("n_subsets"), F.lit(0)) >= 2
    out = out.select("motif_idx", F.coalesce("n_subsets", F.lit(0)).alias("n_subsets"), F.when(two, F.col("var")).alias("shape_variance"), F.when(two, F.col("spread")).otherwise(0.0).alias("amplitude_spread"))
    # One row for each motif: the only single-partition windows, as small as the motif set.
    out = out.withColumn("shape_rank", F.rank().over(Window.orderBy(F.desc_nulls_last("shape_variance")))).withColumn("amplitude_rank", F.rank().over(Window.orderBy(F.desc_nulls_last("amplitude_spread"))))
    return out.withColumn("rank_sum", F.col("shape_rank") + F.col("amplitude_rank"))


def top_contexts(ranked: DataFrame, n: int) -> DataFrame:
    return ranked.orderBy("rank_sum", "motif_idx").limit(n)


def pair_curves(curves: DataFrame, pairs: list[tuple[str, str]], names: list[str], w: int) -> DataFrame:
    """anchor, partner, rel, value of the curves (anchor_motif, motif_idx, curve) of named pairs: what a grid of plots shows.

    Unknown names are left out; a known pair without a curve is zero.
    """
    at = {n: i for i, n in enumerate(names)}
    known = [(a, b, at[a], at[b]) for a, b in pairs if a in at and b in at]
    wanted = curves.sparkSession.createDataFrame(known, "anchor string, partner string, anchor_motif long, motif_idx long")
    own = curves.withColumns({c: F.col(c).cast("long") for c in ("anchor_motif", "motif_idx")}).join(F.broadcast(wanted), ["anchor_motif", "motif_idx"], "left_semi")
    rows = wanted.join(own, ["anchor_motif", "motif_idx"], "left").select("anchor", "partner", F.coalesce("curve", F.array_repeat(F.lit(0.0), 2 * w + 1)).alias("curve"))
    return rows.select("anchor", "partner", F.posexplode("curve").alias("i", "value")).select("anchor", "partner", (F.col("i") - w).cast("long").alias("rel"), "value")


def clustered(curves: DataFrame, key: str, most: int = 5000) -> DataFrame:
    """key, place: the order of a heat map's rows, each next to the row most like it (a chain by cosine similarity from
    the row of greatest norm).  A plot holds at most ``most`` rows; more are an error, as no plot can show them."""
    rows = curves.select(key, "curve").orderBy(key).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a heat map of more than {most} rows")
    kind = curves.schema[key].dataType.simpleString()
    x = np.array([np.asarray(c, float) for c in rows["curve"]]) if len(rows) else np.zeros((0, 1))
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    order, left = [], np.ones(len(x), bool)
    while left.any():
        like = unit @ unit[order[-1]] if order else norm
        k = int(np.argmax(np.where(left, like, -np.inf)))
        order.append(k)
        left[k] = False
    return curves.sparkSession.createDataFrame([(rows[key].iloc[k].item() if hasattr(rows[key].iloc[k], "item") else rows[key].iloc[k], i) for i, k in enumerate(order)], f"{key} {kind}, place long")
