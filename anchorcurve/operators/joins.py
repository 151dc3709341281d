"""Range joins on positions as equi-joins on bins.  A pair is found in exactly one bin, so nothing is de-duplicated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, w: int) -> DataFrame:
    """Pairs with equal keys and abs(right_pos - left_pos) <= w.

    Bins of width w: the left row has one bin, the right row goes to its own and both neighbours.  Hot keys spread over
    their bins; what is left of skew is a sort-merge or hash join that adaptive execution may split.
    """
    size = max(1, w)
    at = lambda c: F.floor(F.col(c) / size)
    l = left.withColumn("_bin", at(left_pos))
    r = right.withColumn("_bin", F.explode(F.array(at(right_pos) - 1, at(right_pos), at(right_pos) + 1)))
    # Sizes before an explode or a Python step are guesses: no side is broadcast on their word.
    return l.join(r.hint("merge"), [*keys, "_bin"]).where(F.abs(F.col(right_pos) - F.col(left_pos)) <= w).drop("_bin")


def points_in_intervals(points: DataFrame, intervals: DataFrame, pos: str, size: int, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Pairs with start <= pos < end: an interval goes to every bin of ``size`` that it touches, a point to one."""
    p = points.withColumn("_bin", F.floor(F.col(pos) / size))
    i = intervals.where("end > start").withColumn("_bin", F.explode(F.expr(f"sequence(floor(start / {size}), floor((end - 1) / {size}))")))
    return p.join(i.hint("merge"), [*keys, "_bin"]).where((F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end"))).drop("_bin")
