"""One entry for all kinds of scans, over regions or whole chromosomes, from sequences or from cached hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MotifSet
from ..operators import intervals as I
from ..operators import profile as P
from ..operators import scan as S
from ..sources import readers, sinks
from . import workflows as W
from .resources import HitCache

KINDS = ("pairs", "target", "sequence", "signal", "signal2d", "max_hits", "sum_hits", "hits")


def check(kind: str, query: int | None, signal, hit_cache) -> None:
    """ValueError for what doesn't go together."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    if (kind == "target") != (query is not None):
        raise ValueError("a query motif belongs to the kind target")
    if kind.startswith("signal") != (signal is not None):
        raise ValueError("a signal belongs to the signal kinds")
    if hit_cache is not None and kind not in ("pairs", "target", "hits"):
        raise ValueError(f"cached hits hold nothing for the kind {kind}")


def intervals_of(chunks: DataFrame, chunk: int, regions: DataFrame | None, segment: int, ext: int = 0, signal: DataFrame | None = None) -> DataFrame:
    """interval_id, chrom, start, end, seq: the regions on known chromosomes (of the signal too), or whole segments of all
    chromosomes, tails dropped and no window across two of them."""
    if regions is None:
        return readers.segments(chunks, segment)
    known = I.common_chromosomes(chunks, signal) if signal is not None else chunks.select("chrom").distinct()
    own = regions.join(known, "chrom", "left_semi")
    return readers.fetch_sequences(chunks, own if "interval_id" in own.columns else I.numbered(own), chunk, ext, strict=True)


def analyze(chunks: DataFrame, chunk: int, motifs: MotifSet, kind: str = "pairs", regions: DataFrame | None = None, w: int = 500, query: int | None = None, signal: DataFrame | None = None, celltypes: list[str] | None = None, segment: int = 2000, both: bool = True, ext: int = 0, hit_cache: HitCache | None = None, output: str | None = None) -> DataFrame:
    """The result of one kind; with output, written under the kind's name with metadata and motif index.

    pairs and target: dense profiles, or sparse ones from cached hits, whose partners are hits.  sequence, signal,
    signal2d: what lies around hits, strands apart.  max_hits, sum_hits: one row an interval and motif.  hits: places.
    """
    check(kind, query, signal, hit_cache)
    if hit_cache is not None:
        spark = chunks.sparkSession
        if bad := hit_cache.mismatches(spark, {"motifs": motifs.fingerprint()}):
            raise ValueError("the cached hits don't fit: " + ", ".join(bad))
        if kind == "hits":
            out = hit_cache.hits(spark)
        else:
            sizes = readers.chromosome_sizes(chunks).select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
            out = hit_cache.profile(sizes if regions is None else regions, w, query)
            out = out.drop("anchor_motif") if kind == "target" else out
    else:
        own = intervals_of(chunks, chunk, regions, segment, ext, signal)
        strands = S.with_strands(own.select("interval_id", "seq"), both)
        if kind in ("pairs", "target"):
            out = P.dense_profile(strands, motifs, w, query)
            out = out.drop("anchor_motif") if kind == "target" else out
        elif kind == "sequence":
            out = P.dense_profile(strands, motifs, w, kind="base")
        elif kind.startswith("signal"):
            names = celltypes or sorted(r.celltype for r in signal.select("celltype").distinct().collect())
            if kind == "signal" and len(names) != 1:
                raise ValueError("the kind signal needs one cell type")
            held = readers.fetch_signal(signal, own, names)
            out = P.dense_profile(S.with_strands(held.select("interval_id", "signal", "seq"), both), motifs, w, kind="signal")
        elif kind == "hits":
            out = W.hits_of_intervals(own, motifs, both).drop("interval_id")
        else:
            forward = S.with_strands(own.select("interval_id", "seq"), False)
            found = S.scan_max(forward, motifs) if kind == "max_hits" else S.scan_sums(forward, motifs).where("score > 0").select("interval_id", "motif_idx", F.lit(-1).alias("rel_pos"), "score")
            out = found.join(own.select("interval_id", "chrom", "start", "end"), "interval_id").drop("interval_id")
    if output and kind in ("pairs", "target", "sequence", "signal", "signal2d"):
        sinks.save_result(out, output, kind, motifs, {"kind": kind, "half_window": w}, motifs.names[query] if query is not None else None)
    elif output:
        out.write.mode("overwrite").parquet(f"{output}/{kind}")
    return out
