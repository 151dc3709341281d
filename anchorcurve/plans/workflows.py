"""Composite runs: peak sets, ChIP-Atlas contexts, tiles to hits, full curves for one query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import CANONICAL, context_label, parse_attributes, unquote
from ..model import MotifSet
from ..operators import intervals as I
from ..operators import joins as J
from ..operators import profile as P
from ..operators import scan as S
from ..sources import readers


def peak_set_memberships(sets: dict[str, DataFrame], window: int, min_peaks: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memberships A__minus__B, inventory, union loci) of named interval sets, centred to ``window``."""
    if min_peaks < 0:
        raise ValueError("min_peaks must not be negative")
    named = [I.center_windows(df.select("chrom", "start", "end"), window).distinct().withColumn("name", F.lit(n)) for n, df in sets.items()]
    loci = I.union_loci(reduce(DataFrame.unionByName, named))
    diff = I.set_differences(loci, sorted(sets))
    return I.keep_larger(diff, min_peaks), I.inventory(diff), loci


def context_memberships(rows: DataFrame, by: str, window: int, matching: str | None = None, min_peaks: int = 0, canonical: bool = True) -> DataFrame:
    """subset_id, chrom, start, end of ChIP-Atlas rows: filtered, labelled, counted, centred, each once, in order."""
    rows = rows.withColumn("decoded", unquote(F.col("attributes")))
    rows = rows.where(F.col("decoded").rlike(f"(?i){matching}")) if matching else rows
    rows = rows.where(F.col("chrom").isin(CANONICAL)) if canonical else rows
    rows = rows.withColumn("subset_id", context_label(parse_attributes(F.col("decoded")), by)).where("subset_id is not null and subset_id != ''")
    rows = I.keep_larger(rows, min_peaks)
    return I.center_windows(rows.select("subset_id", "chrom", "start", "end"), window).distinct().orderBy("subset_id", "chrom", "start", "end")


def hits_of_intervals(intervals: DataFrame, motifs: MotifSet, both: bool = True) -> DataFrame:
    """HIT rows of interval_id, chrom, start, seq."""
    return S.scan_hits(intervals, motifs, both)


def prefiltered(strands: DataFrame, motifs: MotifSet, query: int, w: int) -> DataFrame:
    """Strands of the intervals in which the query motif has an anchor: a scan of that motif alone finds them."""
    one = motifs.take([query])
    scores = S.scan_arrow(strands, one, above=max(0.0, float(one.thresholds[0])) if one.thresholds[0] >= 0 else None)
    n = strands.where("strand = 0").select("interval_id", (F.length("seq") - motifs.length + 1).alias("n"))
    anchored = S.anchors(scores, n, 0, float(one.thresholds[0]), w).select("interval_id").distinct()
    return strands.join(anchored, "interval_id", "left_semi")


def dense_contributions(intervals: DataFrame, motifs: MotifSet, w: int, query: int | None = None, both: bool = True) -> DataFrame:
    """chrom, start, end, (anchor_motif,) motif_idx, rel, value of every distinct interval (interval_id, chrom, start, end,
    seq): around the query motif's anchors, or of all pairs.  An interval's rows are made where it lies."""
    return P.interval_profiles(intervals, motifs, w, query, both, ("chrom", "start", "end"))


def full_curves(intervals: DataFrame, memberships: DataFrame, motifs: MotifSet, query: int | None, w: int, both: bool = True, by_pattern: bool = False) -> DataFrame:
    """subset_id, (anchor_motif,) motif_idx, rel, value around the query motif's anchors, or of all pairs.

    A scan of the query alone finds intervals with anchors; only these are scanned with all motifs, each distinct interval
    once, and its profile is added to the subsets that hold it.  by_pattern: the same, as nothing is left to fan out.
    """
    return P.subset_curves(with_subsets(intervals, memberships).select("seq", "subsets"), motifs, w, query, both)


def with_subsets(intervals: DataFrame, memberships: DataFrame) -> DataFrame:
    """The intervals that memberships name, with a column subsets: arrays of subset_id and count."""
    keys = ["chrom", "start", "end"]
    held = P.multiplicities(memberships).groupBy(*keys).agg(F.collect_list(F.struct("subset_id", "count")).alias("subsets"))
    return intervals.join(held, keys)


def block_scores(chunks: DataFrame, chunk: int, intervals: DataFrame, motifs: MotifSet, gap: int, max_span: int | None = None, both: bool = True) -> DataFrame:
    """SCORE rows of intervals (interval_id, chrom, start, end, within their chromosomes), scanned by blocks of near ones.

    A block is fetched and scanned once; each interval takes its own slice, which on the reverse strand is counted from
    the block's end.  The same as scanning each interval by itself.
    """
    return S.unpacked_scores(block_arrays(chunks, chunk, intervals, motifs, gap, max_span, both), len(motifs.names))


def block_arrays(chunks: DataFrame, chunk: int, intervals: DataFrame, motifs: MotifSet, gap: int, max_span: int | None = None, both: bool = True) -> DataFrame:
    """The same as scan_packed's rows, one for each interval and strand: a block comes with its intervals, so what is
    shuffled are sequences and intervals, not scores."""
    blocks = I.numbered(I.coalesce_blocks(intervals, gap, max_span, len(motifs.names), motifs.length)).withColumnRenamed("interval_id", "block")
    fetched = readers.fetch_sequences(chunks, blocks.withColumnRenamed("block", "interval_id"), chunk)
    # An interval lies in the block that covers it; blocks of one chromosome may overlap where a cap cut them.
    inside = J.points_in_intervals(intervals.select("interval_id", "chrom", F.col("start").alias("_s"), F.col("end").alias("_e")), blocks.select("block", "chrom", "start", "end"), "_s", max(1, max_span or 100_000))
    own = inside.where("_e <= end").groupBy("interval_id", "_s", "_e").agg(F.min(F.struct("block", "start", "end")).alias("b"))
    parts = own.groupBy(F.col("b.block").alias("_b")).agg(F.collect_list(F.struct("interval_id", (F.col("_s") - F.col("b.start")).alias("a"), (F.col("_e") - F.col("b.start")).alias("z"))).alias("parts"))
    return S.scan_parts(fetched.join(parts, F.col("interval_id") == F.col("_b")).select("seq", "parts"), motifs, both)


def scores_profile(scores: DataFrame, lengths: DataFrame, motifs: MotifSet, query: int, w: int, per_interval: bool = False) -> DataFrame:
    """(interval_id,) motif_idx, rel, value around the query motif's anchors, from SCORE rows and lengths (interval_id, n)."""
    return P.dense_profile_sql(scores, S.anchors(scores, lengths, query, float(motifs.thresholds[query]), w), w, per_interval)
