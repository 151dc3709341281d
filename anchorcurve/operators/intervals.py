"""Interval algebra by window functions: centring, merging, unions, differences, tiles, blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_memberships(df: DataFrame, subset: str = "subset_id") -> DataFrame:
    """Rows with numeric, finite, non-negative starts and ends beyond them; starts and ends become long."""
    names = {c.lower(): c for c in df.columns}
    chrom, start, end = (names.get(a) or names[b] for a, b in (("chrom", "chromosome"), ("start", "start"), ("end", "end")))
    s, e = F.expr(f"try_cast(`{start}` as double)"), F.expr(f"try_cast(`{end}` as double)")
    out = df.select(F.col(subset).cast("string").alias("subset_id"), F.col(chrom).cast("string").alias("chrom"), s.alias("start"), e.alias("end"))
    ok = ~F.isnan("start") & ~F.isnan("end") & (F.abs("start") < float("inf")) & (F.abs("end") < float("inf")) & (F.col("start") >= 0) & (F.col("end") > F.col("start"))
    return out.where(ok).select("subset_id", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def center_windows(df: DataFrame, window: int) -> DataFrame:
    """Windows of fixed width about each interval's centre; at the left edge they move, not shrink."""
    if window <= 0:
        raise ValueError("window must be positive")
    c = F.floor((F.col("start") + F.col("end")) / 2)
    s = F.greatest(F.lit(0), c - window // 2).cast("long")
    return df.withColumn("_s", s).withColumn("start", F.col("_s")).withColumn("end", F.col("_s") + window).drop("_s")


def _islands(df: DataFrame, joins: bool, gap: int = 0, span: int = 1 << 20) -> DataFrame:
    """Adds island: a running number per chromosome.  joins: an interval that only touches the one before joins it.

    Done by ranges of ``span`` starts: what lies before a range comes to it as one number, so no chromosome is one task.
    """
    own = Window.partitionBy("chrom", "_range").orderBy("start", "end")
    ranges = Window.partitionBy("chrom").orderBy("_range")
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_range", F.floor(F.col("start") / span))
    ends = rows.groupBy("chrom", "_range").agg(F.max("end").alias("_most")).select("chrom", "_range", F.max("_most").over(past(ranges)).alias("_far"))
    rows = rows.join(ends, ["chrom", "_range"]).withColumn("_prev", F.greatest(F.max("end").over(past(own)), "_far"))
    new = (F.col("start") > F.col("_prev") + gap) if joins else (F.col("start") >= F.col("_prev") + gap)
    rows = rows.withColumn("_new", F.when(F.col("_prev").isNull() | new, 1).otherwise(0))
    begun = rows.groupBy("chrom", "_range").agg(F.sum("_new").alias("_n")).select("chrom", "_range", F.coalesce(F.sum("_n").over(past(ranges)), F.lit(0)).alias("_before"))
    rows = rows.join(begun, ["chrom", "_range"]).withColumn("island", F.sum("_new").over(own) + F.col("_before"))
    return rows.drop("_range", "_far", "_prev", "_new", "_before")


def merge_touching(df: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """Covered stretches; touching intervals merge.  sizes clamps to chromosome lengths and drops unknown chromosomes."""
    if sizes is not None:
        at = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
        df = df.where(F.col("chrom").isin(list(sizes))).withColumn("start", F.greatest(F.lit(0), "start")).withColumn("end", F.least("end", at[F.col("chrom")]))
    df = df.where("end > start").select("chrom", "start", "end").distinct()
    return _islands(df, True).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end")


def union_loci(df: DataFrame, name: str = "name") -> DataFrame:
    """Loci of overlapping windows of named sets (touching ones stay apart), with the sorted names that reach into each."""
    loci = _islands(df.select(name, "chrom", "start", "end").distinct(), False).groupBy("chrom", "island")
    return loci.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_set(name)).alias("members")).select("chrom", "start", "end", "members")


def set_differences(loci: DataFrame, names: list[str], min_peaks: int = 0) -> DataFrame:
    """Memberships A__minus__B of all ordered pairs of names: loci that A reaches and B doesn't; sets of more than min_peaks."""
    if min_peaks < 0:
        raise ValueError("min_peaks must not be negative")
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in names for b in names if a != b]) if len(names) > 1 else F.array().cast("array<struct<a:string,b:string>>")
    hit = F.filter(pairs, lambda p: F.array_contains("members", p["a"]) & ~F.array_contains("members", p["b"]))
    out = loci.select(F.explode(hit).alias("p"), "chrom", "start", "end").select(F.concat("p.a", F.lit("__minus__"), "p.b").alias("subset_id"), "chrom", "start", "end")
    return keep_larger(out, min_peaks)


def keep_larger(df: DataFrame, n: int, at_least: bool = False, key: str = "subset_id") -> DataFrame:
    """Rows of groups with more than n rows (or n at least): one small aggregate, joined back."""
    if n <= 0:
        return df
    sizes = df.groupBy(key).count().where(F.col("count") >= n if at_least else F.col("count") > n).select(key)
    return df.join(sizes, key, "left_semi")


def inventory(df: DataFrame, key: str = "subset_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_regions"), F.sum(F.col("end") - F.col("start")).alias("n_bp"))


def tiles(sizes: DataFrame, tile: int) -> DataFrame:
    """Tiles of chrom, size: [k t, min((k + 1) t, size))."""
    if tile <= 0:
        raise ValueError("tile must be positive")
    at = F.explode(F.expr(f"sequence(0L, size - 1, {int(tile)}L)")).alias("start")
    return sizes.where("size > 0").select("chrom", "size", at).select("chrom", "start", F.least(F.col("start") + tile, F.col("size")).alias("end"))


def covering_tiles(df: DataFrame, tile: int, flank: int) -> DataFrame:
    """The tiles that intervals touch, once each, with flanked scan bounds."""
    if tile <= 0 or flank < 0:
        raise ValueError("tile must be positive and flank not negative")
    k = F.explode(F.expr(f"sequence(cast(floor(start / {tile}) as long), cast(floor((end - 1) / {tile}) as long))")).alias("k")
    out = df.where("end > start").select("chrom", k).distinct().select("chrom", (F.col("k") * tile).alias("tile_start"), ((F.col("k") + 1) * tile).alias("tile_end"))
    return out.withColumn("scan_start", F.greatest(F.lit(0), F.col("tile_start") - flank)).withColumn("scan_end", F.col("tile_end") + flank)


def extend(df: DataFrame, by: int, sizes: dict[str, int] | None = None, right_only: bool = False) -> DataFrame:
    """Intervals wider by ``by`` on both sides, within their chromosomes; right_only: at their ends alone, starts as they are.

    sizes: a chromosome that it lacks has no bound.  by <= 0: unchanged.
    """
    if by <= 0:
        return df
    end = F.col("end") + by
    if sizes:
        end = F.least(end, F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[F.col("chrom")])
    out = df.withColumn("end", end)
    return out if right_only else out.withColumn("start", F.greatest(F.lit(0), F.col("start") - by))


def numbered(df: DataFrame, keys: tuple[str, ...] = ("chrom", "start", "end"), name: str = "interval_id") -> DataFrame:
    """The distinct keys with a number each, written to the shared folder once, so the numbers are the same in every use."""
    from ..sources.folders import cut

    return cut(df.select(*keys).distinct().withColumn(name, F.monotonically_increasing_id()), "numbered")


def common_chromosomes(*tables: DataFrame) -> DataFrame:
    """The chromosomes that all tables hold."""
    names = [t.select("chrom").where("chrom is not null").distinct() for t in tables]
    out = names[0]
    for n in names[1:]:
        out = out.join(n, "chrom", "left_semi")
    return out


def coalesce_blocks(df: DataFrame, gap: int, max_span: int | None = None, n_motifs: int = 1, motif_length: int = 1, max_bytes: int | None = None, strands: int = 2) -> DataFrame:
    """Blocks of near intervals, greedy by (start, end): joined while the gap, span and score-byte caps hold.

    Islands of the gap rule come from window functions; a cap needs state, so capped islands are walked one at a time
    (an island is what one block could be without caps).
    """
    base = df.select("chrom", "start", "end").distinct()
    islands = _islands(base, True, gap)

    def cost(span: int) -> int:
        return 4 * n_motifs * max(0, span - motif_length + 1) * strands

    if max_span is None and max_bytes is None:
        return islands.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_intervals")).select("chrom", "start", "end", "n_intervals")

    def walk(batches):
        # Islands come one after another, in order; the block that is open may go on in the next batch.
        now: list | None = None
        for b in batches:
            out: list[list] = []
            for chrom, island, s, e in zip(*(b.column(c).to_pylist() for c in ("chrom", "island", "start", "end"))):
                if max_bytes is not None and cost(e - s) > max_bytes:
                    raise ValueError("one interval alone is beyond max_bytes")
                if now is not None and now[0] == chrom and now[1] == island:
                    span = max(now[3], e) - now[2]
                    if s <= now[3] + gap and (max_span is None or span <= max_span) and (max_bytes is None or cost(span) <= max_bytes):
                        now[3] = max(now[3], e)
                        now[4] += 1
                        continue
                if now is not None:
                    out.append(now)
                now = [chrom, island, s, e, 1]
            yield _blocks(out)
        if now is not None:
            yield _blocks([now])

    rows = islands.select(F.col("chrom").cast("string").alias("chrom"), F.col("island").cast("long").alias("island"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    rows = rows.repartition("chrom", "island").sortWithinPartitions("chrom", "island", "start", "end")
    return rows.mapInArrow(walk, "chrom string, start long, end long, n_intervals long")


def _blocks(rows: list[list]) -> pa.RecordBatch:
    chrom, _, start, end, n = zip(*rows) if rows else [()] * 5
    kinds = {"chrom": pa.string(), "start": pa.int64(), "end": pa.int64(), "n_intervals": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((chrom, start, end, n), kinds.values())], list(kinds))
