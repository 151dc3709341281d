"""Command line: python -m anchorcurve.cli COMMAND ...

Paths are of any store that Spark reads; motif files are those of readers.write_motifs, or local JSON files for motif-info.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.attributes import named_path
from .functions.motifs import resolve_motif, thresholds_of
from .model import MotifSet
from .operators import curves as V
from .operators import intervals as I
from .operators import profile as P
from .plans import analysis as A
from .plans import resources as R
from .plans import workflows as W
from .sources import readers, sinks
from .sources.folders import cut


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="anchorcurve")
    sub = p.add_subparsers(dest="command", required=True)
    # The names of these five commands.
    c = sub.add_parser("compare-peak-sets")
    c.add_argument("sets", nargs="+", help="NAME=PATH")
    c.add_argument("--window", type=int, default=1000)
    c.add_argument("--min-peaks", type=int, default=0)
    c.add_argument("--output", required=True)
    c = sub.add_parser("prepare-chip-atlas-groups")
    c.add_argument("bed")
    c.add_argument("--by", default="celltype")
    c.add_argument("--matching")
    c.add_argument("--window", type=int, default=1000)
    c.add_argument("--min-peaks", type=int, default=0)
    c.add_argument("--output", required=True)
    c = sub.add_parser("profile-peak-groups")
    for x in ("--sequences", "--memberships", "--motifs", "--query", "--output"):
        c.add_argument(x, required=True)
    c.add_argument("--chunk", type=int, default=1_000_000)
    c.add_argument("--half-window", type=int, default=500)
    c.add_argument("--plan-only", action="store_true")
    c.add_argument("--anchor-cache", help="where to keep the query motif's anchors; used again if they fit")
    c = sub.add_parser("rank-context-motifs")
    for x in ("--curves", "--counts", "--output"):
        c.add_argument(x, required=True)
    c.add_argument("--min-regions", type=int, default=1)
    c.add_argument("--smooth", type=int, default=11)
    c.add_argument("--top", type=int)
    c = sub.add_parser("motif-info")
    c.add_argument("motifs")
    c.add_argument("--select")
    c = sub.add_parser("scan", help="one kind of result over regions, or over whole chromosomes without any")
    for x in ("--sequences", "--motifs", "--output"):
        c.add_argument(x, required=True)
    c.add_argument("--kind", choices=A.KINDS, default="pairs")
    for x in ("--regions", "--signal", "--query", "--select", "--hit-cache", "--threshold-key"):
        c.add_argument(x)
    c.add_argument("--celltypes", type=lambda t: t.split(","))
    c.add_argument("--threshold", type=float)
    for x, n in (("--chunk", 1_000_000), ("--half-window", 500), ("--segment", 2000), ("--extension", 0)):
        c.add_argument(x, type=int, default=n)
    c.add_argument("--forward-only", action="store_true")
    c = sub.add_parser("build-hit-cache")
    for x in ("--sequences", "--motifs", "--output"):
        c.add_argument(x, required=True)
    c.add_argument("--regions")
    for x, n in (("--chunk", 1_000_000), ("--tile", 1_000_000), ("--extension", 0), ("--parts", 200)):
        c.add_argument(x, type=int, default=n)
    c.add_argument("--forward-only", action="store_true")
    c = sub.add_parser("query-hits")
    c.add_argument("cache")
    c.add_argument("region", help="CHROM:START-END")
    c.add_argument("--motifs", type=lambda t: [int(x) for x in t.split(",")])
    c.add_argument("--min-score", type=float)
    c.add_argument("--output", required=True)
    return p


def region_of(text: str) -> tuple[str, int, int]:
    """CHROM:START-END."""
    chrom, _, rest = text.rpartition(":")
    start, _, end = rest.partition("-")
    if not chrom or not start.isdigit() or not end.isdigit() or int(end) <= int(start):
        raise ValueError(f"expected CHROM:START-END, got {text!r}")
    return chrom, int(start), int(end)


def _scan(spark: SparkSession, a: argparse.Namespace) -> None:
    m = readers.read_motifs(spark, a.motifs, a.select)
    if a.threshold is not None or a.threshold_key is not None:
        m = MotifSet(m.names, m.kernels, thresholds_of(len(m.names), a.threshold_key, a.threshold, m.meta.get("thresholds"), m.thresholds), m.meta)
    query = resolve_motif(m.names, a.query) if a.query else None
    regions = readers.read_bed(spark, a.regions).distinct() if a.regions else None
    signal = readers.read_signal(spark, a.signal, a.celltypes) if a.signal else None
    A.analyze(readers.read_sequences(spark, a.sequences), a.chunk, m, a.kind, regions, a.half_window, query, signal, a.celltypes, a.segment, not a.forward_only, a.extension, R.HitCache(a.hit_cache) if a.hit_cache else None, a.output)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "motif-info":
        m = readers.load_motifs(a.motifs, a.select)
        for i, (n, t) in enumerate(zip(m.names, m.thresholds)):
            print(i, n, t)
        return 0
    spark = SparkSession.builder.appName("anchorcurve").getOrCreate()
    if a.command == "compare-peak-sets":
        sets = {n: readers.read_bed(spark, f) for n, f in map(named_path, a.sets)}
        for name, df in zip(("memberships", "inventory", "loci"), W.peak_set_memberships(sets, a.window, a.min_peaks)):
            sinks.write_table(df.withColumn("members", F.array_join("members", ",")) if name == "loci" else df, f"{a.output}/{name}")
    elif a.command == "prepare-chip-atlas-groups":
        sinks.write_table(W.context_memberships(readers.read_chip_atlas(spark, a.bed), a.by, a.window, a.matching, a.min_peaks), a.output)
    elif a.command == "profile-peak-groups":
        motifs = readers.read_motifs(spark, a.motifs)
        members = I.valid_memberships(readers.read_memberships(spark, a.memberships))
        R.resource_plan(members, len(motifs.names), a.half_window, False).show(truncate=False)
        if not a.plan_only:
            q = resolve_motif(motifs.names, a.query)
            fetched = cut(readers.fetch_sequences(readers.read_sequences(spark, a.sequences), I.numbered(members), a.chunk), "fetched")
            whole = members.join(fetched.select("chrom", "start", "end"), ["chrom", "start", "end"], "left_semi")
            if a.anchor_cache:
                cache = R.AnchorCache(a.anchor_cache)
                if not cache.fits(spark, motifs, q, a.half_window):
                    cache.build(fetched, motifs, q, a.half_window)
                out = cache.replay(fetched, whole, motifs, q, a.half_window)
            else:
                out = W.full_curves(fetched, whole, motifs, q, a.half_window)
            at = sinks.write_profile(P.to_curves(out, a.half_window, ["subset_id", "motif_idx"]), a.output, {"query": motifs.names[q], "half_window": a.half_window, "motifs": motifs.fingerprint()}, "curves")
            sinks.manifest({"curves": spark.read.parquet(at)}, f"{a.output}/manifest")
    elif a.command == "scan":
        _scan(spark, a)
    elif a.command == "build-hit-cache":
        regions = readers.read_bed(spark, a.regions) if a.regions else None
        R.HitCache(a.output).build(readers.read_sequences(spark, a.sequences), a.chunk, readers.read_motifs(spark, a.motifs), None if a.regions else a.tile, regions, a.extension, not a.forward_only, a.parts)
    elif a.command == "query-hits":
        sinks.write_table(R.HitCache(a.cache).query(spark, *region_of(a.region), a.motifs, a.min_score).orderBy("center_pos", "motif_idx", "strand"), a.output)
    else:
        out = V.rank_contexts(spark.read.parquet(a.curves), spark.read.option("sep", "\t").option("header", True).csv(a.counts).withColumn("n_regions", F.col("n_regions").cast("long")), a.min_regions, a.smooth)
        sinks.write_table(V.top_contexts(out, a.top) if a.top else out, a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
