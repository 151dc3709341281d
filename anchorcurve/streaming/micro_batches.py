"""Incremental hits: a stream of intervals is scanned batch by batch and appended; replays of a batch overwrite it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MotifSet
from ..plans.workflows import hits_of_intervals


def append_hits(stream: DataFrame, motifs: MotifSet, path: str, checkpoint: str, both: bool = True):
    """Starts a query that writes HIT rows of each micro-batch to path/batch=<id>; running it twice gives the same files."""

    def one(batch: DataFrame, number: int) -> None:
        # A batch may be a few large files: its rows are dealt to all cores before they are scanned.
        dealt = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)
        hits_of_intervals(dealt, motifs, both).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_hit_counts(hits: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Hits per motif and time window of a stream with event time, late rows beyond the watermark dropped."""
    return hits.withWatermark(time, late).groupBy(F.window(time, width), "motif_idx").agg(F.count("*").alias("n_hits"), F.sum("score").alias("score"))
