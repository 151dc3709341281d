"""Readers: BED, narrowPeak, membership tables, motif sets, signals, metric lists, chunked sequences."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import NARROWPEAK, MotifSet
from ..operators.joins import points_in_intervals

NARROWPEAK_KINDS = dict(x.split() for x in NARROWPEAK.split(", "))


def _bed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a BED file's lines (gz by suffix) without blank, comment, track and browser lines."""
    lines = spark.read.text(path).where(~F.col("value").rlike("^\\s*$|^#|^track|^browser"))
    return lines.select(F.split("value", "\t").alias("f"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end of rows with numeric coordinates and end > start."""
    at = lambda i: F.get("f", F.lit(i))
    rows = _bed_lines(spark, path).select(at(0).alias("chrom"), at(1).try_cast("double").cast("long").alias("start"), at(2).try_cast("double").cast("long").alias("end"))
    return rows.where("end > start")


def read_narrowpeak(spark: SparkSession, path: str, half: int = 1000, sample: int | None = None, seed: int = 0) -> DataFrame:
    """BED3+ or narrowPeak rows re-centred to [center - half, center + half) (which may be negative), with length and center.

    sample: at most about so many rows, by a seeded draw.  Fewer than three columns: ValueError.
    """
    lines = _bed_lines(spark, path)
    first = lines.first()
    if first is not None and len(first.f) < 3:
        raise ValueError("a BED file needs three columns at least")
    width = len(first.f) if first is not None else 3
    names = [*list(NARROWPEAK_KINDS)[:width], *(f"extra_{i}" for i in range(width - 10))]
    rows = lines.select(*[F.get("f", F.lit(i)).try_cast(NARROWPEAK_KINDS.get(n, "string")).alias(n) for i, n in enumerate(names)])
    rows = rows.withColumn("length", F.col("end") - F.col("start")).withColumn("center", (F.col("start") + F.col("end")) / 2)
    rows = rows.withColumn("start", (F.col("center") - half).cast("long")).withColumn("end", (F.col("center") + half).cast("long"))
    if sample is not None and (n := rows.count()) > sample:
        rows = rows.sample(fraction=sample / n, seed=seed)
    return rows


def read_chip_atlas(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, attributes (still encoded) of a four-column BED file."""
    at = lambda i: F.get("f", F.lit(i))
    rows = _bed_lines(spark, path).select(at(0).alias("chrom"), at(1).try_cast("bigint").alias("start"), at(2).try_cast("bigint").alias("end"), at(3).alias("attributes"))
    return rows.where("end > start and start >= 0")


def read_memberships(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def read_sequences(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """Chunked sequences; unknown names in chroms are left out.  Nothing left: ValueError."""
    out = spark.read.parquet(path)
    out = out.where(F.col("chrom").isin(chroms)) if chroms else out
    if out.isEmpty():
        raise ValueError("no usable chromosome")
    return out


def read_signal(spark: SparkSession, path: str, celltypes: list[str] | None = None) -> DataFrame:
    """chrom, pos, celltype, value; a table without cell types gets one named ``signal``."""
    out = spark.read.parquet(path)
    if "celltype" not in out.columns:
        out = out.withColumn("celltype", F.lit("signal"))
    return out.where(F.col("celltype").isin(celltypes)) if celltypes else out


def chromosome_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chrom").agg(F.max(F.col("chunk_start") + F.length("seq")).alias("size"))


def fetch_sequences(chunks: DataFrame, regions: DataFrame, chunk: int, ext: int = 0, right_only: bool = False, strict: bool = False) -> DataFrame:
    """interval_id, chrom, start, end, seq of regions (interval_id, chrom, start, end) cut to the chromosome.

    chunk: the length of chunks, which start at its multiples.  ext: wider on both sides, or with right_only at the end
    alone.  Unknown chromosomes and empty results are left out; strict: nothing left is a ValueError.
    """
    r = regions.select("interval_id", "chrom", "start", "end").join(chromosome_sizes(chunks), "chrom")
    start = F.col("start") if right_only else F.col("start") - ext
    r = r.withColumn("start", F.greatest(F.lit(0), start)).withColumn("end", F.least("size", F.col("end") + ext)).where("end > start").drop("size")
    if strict and r.isEmpty():
        raise ValueError("no region lies on a known chromosome")
    r = r.withColumn("k", F.explode(F.expr(f"sequence(cast(floor(start / {chunk}) as long), cast(floor((end - 1) / {chunk}) as long))"))).withColumn("chunk_start", F.col("k") * chunk)
    part = F.substring(F.col("seq"), (F.greatest("start", "chunk_start") - F.col("chunk_start") + 1).cast("int"), (F.least(F.col("end"), F.col("chunk_start") + chunk) - F.greatest("start", "chunk_start")).cast("int"))
    rows = r.join(chunks, ["chrom", "chunk_start"]).select("interval_id", "chrom", "start", "end", F.struct("chunk_start", part.alias("s")).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["s"]), "")
    return rows.groupBy("interval_id", "chrom", "start", "end").agg(joined.alias("seq"))


def fetch_signal(signal: DataFrame, intervals: DataFrame, celltypes: list[str], bin_size: int = 1000) -> DataFrame:
    """The intervals (interval_id, chrom, start, end and other columns) with a column signal: an array of values for each
    cell type, as long as the interval, 0 where the signal has none.

    Only values inside some interval travel; the intervals stay where they are unless they hold any.
    """
    at = intervals.select("interval_id", "chrom", "start", "end").where("end > start")
    inside = points_in_intervals(signal.where(F.col("celltype").isin(celltypes)).select("chrom", "pos", "celltype", "value"), at, "pos", bin_size)
    number = F.create_map(*[F.lit(x) for i, c in enumerate(celltypes) for x in (c, i)])[F.col("celltype")]
    n = (F.col("end") - F.col("start")).cast("long")
    cell = F.struct((number * n + F.col("pos") - F.col("start")).alias("at"), F.col("value").cast("double").alias("value"))
    tracks = inside.where("value is not null").groupBy("interval_id").agg(F.collect_list(cell).alias("_c"))

    @F.pandas_udf("array<double>")
    def laid(at: pd.Series, value: pd.Series, size: pd.Series) -> pd.Series:
        # One after another: the places of each cell type; values of one place are added.
        return pd.Series([np.bincount(a.astype(np.int64), v, k) if a is not None and len(a) else np.zeros(k) for a, v, k in zip(at, value, size)])

    rows = intervals.where("end > start").join(tracks, "interval_id", "left")
    rows = rows.withColumn("_c", laid(F.col("_c.at"), F.col("_c.value"), n * len(celltypes)))
    return rows.withColumn("signal", F.array(*[F.slice("_c", (n * i + 1).cast("int"), n.cast("int")) for i in range(len(celltypes))])).drop("_c")


def segments(chunks: DataFrame, length: int) -> DataFrame:
    """Whole segments of each chunk, tails dropped: interval_id, chrom, start, end, seq.  The ids are running numbers."""
    k = F.explode(F.expr(f"sequence(0L, cast(floor(length(seq) / {length}) as long) - 1)")).alias("k")
    rows = chunks.where(F.length("seq") >= length).select("chrom", "chunk_start", "seq", k)
    rows = rows.select("chrom", (F.col("chunk_start") + F.col("k") * length).alias("start"), F.substring(F.col("seq"), (F.col("k") * length + 1).cast("int"), F.lit(length)).alias("seq"))
    return rows.withColumn("end", F.col("start") + length).withColumn("interval_id", F.monotonically_increasing_id())


def _motif_json(motifs: MotifSet) -> str:
    return json.dumps({"names": motifs.names, "thresholds": motifs.thresholds, "kernels": motifs.kernels.tolist(), "meta": motifs.meta | {"fingerprint": motifs.fingerprint()}})


def _motifs_of(text: str, select: str | None) -> MotifSet:
    from ..functions.motifs import select_motifs

    d = json.loads(text)
    out = MotifSet(d["names"], np.asarray(d["kernels"], np.float32), d["thresholds"], d.get("meta", {}))
    if (was := out.meta.get("fingerprint")) and was != out.fingerprint():
        raise ValueError("the motif file doesn't match its fingerprint")
    return out.take(select_motifs(out.names, select)) if select else out


def save_motifs(motifs: MotifSet, path: str) -> None:
    Path(path).write_text(_motif_json(motifs))


def load_motifs(path: str, select: str | None = None) -> MotifSet:
    """A motif file of the driver's, checked against its own fingerprint; select: see functions.motifs.select_motifs."""
    return _motifs_of(Path(path).read_text(), select)


def write_motifs(spark: SparkSession, motifs: MotifSet, path: str) -> None:
    """The same in any store that Spark writes to."""
    spark.createDataFrame([(_motif_json(motifs),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_motifs(spark: SparkSession, path: str, select: str | None = None) -> MotifSet:
    return _motifs_of(spark.read.text(path).first().value, select)


def read_motif_metrics(spark: SparkSession, path: str) -> DataFrame:
    """tf, name, chipseq, selex from JSON lines with name and nested metrics."""
    rows = spark.read.schema("name string, metrics struct<chipseq:double, selex:double>").json(path)
    return rows.select(F.split("name", "[.]")[0].alias("tf"), "name", F.col("metrics.chipseq").alias("chipseq"), F.col("metrics.selex").alias("selex"))


def motif_table(spark: SparkSession, motifs: MotifSet) -> DataFrame:
    """motif_idx, name, threshold, center, offset, base, weight: the non-zero cells of a motif set's kernels."""
    centers = motifs.center_offsets()
    rows = [(i, n, float(motifs.thresholds[i]), centers[i], j, "ACGT"[b], float(motifs.kernels[i, j, b])) for i, n in enumerate(motifs.names) for j, b in zip(*map(list, np.nonzero(motifs.kernels[i])))]
    return spark.createDataFrame([(i, n, t, c, int(j), b, w) for i, n, t, c, j, b, w in rows], "motif_idx int, name string, threshold double, center int, offset int, base string, weight double")
