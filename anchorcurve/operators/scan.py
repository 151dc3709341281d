"""Kernel scans: scores of every position, hits, coordinates, anchors.

scan_columns is built of column expressions only (one higher-order expression for each kernel); scan_arrow does the
same in NumPy for many or long kernels, a batch of sequences at a time.  Both are narrow: a sequence is scored where it
lies.  What is needed by interval only (statistics, maxima, sums, counts) is reduced in the same pass, so no row for
each place ever leaves it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BASES, MotifSet
from .arrays import CODE, Flat, packed, scan_codes, scanned, scanned_both, unpacked


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def one_hot(seq: str) -> np.ndarray:
    return np.eye(5, 4, dtype=np.float32)[CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]]


def scan(seq: str, kernels: np.ndarray) -> np.ndarray:
    """(motif, position) scores: valid cross-correlation, then negative ones to zero."""
    return scan_codes(CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)], kernels)


def with_strands(intervals: DataFrame, both: bool = True) -> DataFrame:
    """interval_id, seq -> interval_id, strand, seq: strand 1 is the reverse complement."""
    fwd = F.struct(F.lit(0).alias("strand"), F.col("seq").alias("seq"))
    rev = F.struct(F.lit(1).alias("strand"), reverse_complement(F.col("seq")).alias("seq"))
    rest = [c for c in intervals.columns if c != "seq"]
    return intervals.select(*rest, F.explode(F.array(fwd, rev) if both else F.array(fwd)).alias("_s")).select(*rest, "_s.strand", "_s.seq")


def scan_columns(strands: DataFrame, motifs: MotifSet) -> DataFrame:
    """SCORE rows with every position, by column expressions."""
    m = motifs.length

    def score(kernel: np.ndarray) -> Column:
        def at(p: Column) -> Column:
            total = F.lit(0.0)
            for j in range(m):
                cell = F.lit(0.0)
                base = F.substring(F.col("_b"), p + j + 1, F.lit(1))
                for b, w in zip(BASES, kernel[j]):
                    if w:
                        cell = F.when(base == F.lit(b.encode()), float(w)).otherwise(cell)
                total = total + cell
            return F.greatest(F.lit(0.0), total)

        return F.transform(F.sequence(F.lit(0), F.length("_b") - m), at)

    each = F.explode(F.array(*[F.struct(F.lit(i).alias("motif_idx"), score(k).alias("s")) for i, k in enumerate(motifs.kernels)])).alias("e")
    # Bytes, one for each symbol: a place in a string is found by walking to it, which makes long sequences quadratic.
    flat = F.upper(F.regexp_replace("seq", "[^\\x00-\\x7F]", "?")).cast("binary")
    rows = strands.where(F.length("seq") >= m).select("interval_id", "strand", flat.alias("_b")).select("interval_id", "strand", each)
    return rows.select("interval_id", "strand", "e.motif_idx", F.posexplode("e.s").alias("p", "score"))


def scan_arrow(strands: DataFrame, motifs: MotifSet, above: float | None = None) -> DataFrame:
    """SCORE rows in NumPy; above: only scores beyond it (0 leaves out zeros)."""
    kernels = motifs.kernels

    def fn(batches):
        for b in batches:
            ids, strand = b.column("interval_id"), np.asarray(b.column("strand"))
            for f in scanned(b.column("seq"), kernels):
                k, at = np.nonzero(f.scores > above) if above is not None else map(np.ravel, np.indices(f.scores.shape))
                row = f.row[at] + f.first
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(strand[row].astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(f.p[at].astype(np.int32)), pa.array(f.scores[k, at].astype(np.float64))], ["interval_id", "strand", "motif_idx", "p", "score"])

    return _scanned(strands).mapInArrow(fn, "interval_id long, strand int, motif_idx int, p int, score double")


def scan_packed(strands: DataFrame, motifs: MotifSet) -> DataFrame:
    """interval_id, strand, scores: SCORE rows as one row for each sequence, an array for each motif, so that what needs
    the scores of one sequence finds them in its row and nothing is shuffled."""
    kernels = motifs.kernels

    def fn(batches):
        for b in batches:
            ids, strand = b.column("interval_id"), b.column("strand")
            for f in scanned(b.column("seq"), kernels):
                n = len(f.counts)
                yield pa.RecordBatch.from_arrays([ids.slice(f.first, n), strand.slice(f.first, n), packed(f)], ["interval_id", "strand", "scores"])

    return _scanned(strands).mapInArrow(fn, "interval_id long, strand int, scores array<array<float>>")


def scan_parts(blocks: DataFrame, motifs: MotifSet, both: bool = True) -> DataFrame:
    """scan_packed's rows of parts (interval_id, a, z: places in seq) of sequences (seq, parts), each of which is scanned
    once.  On the reverse strand a part is counted from the sequence's end."""
    kernels, m = motifs.kernels, motifs.length

    def fn(batches):
        for b in batches:
            held = b.column("parts")
            size = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, begin = held.flatten(), np.append(0, np.cumsum(size))
            ids, a, z = flat.field("interval_id"), *(flat.field(c).to_numpy(zero_copy_only=False) for c in "az")
            for strands in scanned_both(b.column("seq"), kernels, both):
                f = strands[0]
                n = len(f.counts)
                parts = np.arange(begin[f.first], begin[f.first + n])
                row = np.repeat(np.arange(n), size[f.first : f.first + n])
                counts = np.maximum(np.minimum(z[parts], f.lengths[row]) - a[parts] - m + 1, 0)
                starts = np.append(0, np.cumsum(counts))
                at = np.repeat(np.arange(len(parts)), counts)
                p = np.arange(int(starts[-1])) - starts[:-1][at]
                for strand, g in enumerate(strands):
                    first = a[parts] if strand == 0 else f.lengths[row] - z[parts]
                    own = Flat(0, starts, np.zeros(0, np.uint8), starts, g.scores[:, (g.starts[:-1][row] + first)[at] + p], at, p)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(parts)), pa.array(np.full(len(parts), strand, np.int32)), packed(own)], ["interval_id", "strand", "scores"])

    return blocks.mapInArrow(fn, "interval_id long, strand int, scores array<array<float>>")


def unpacked_scores(packed_rows: DataFrame, motifs: int) -> DataFrame:
    """SCORE rows of scan_packed's rows."""

    def fn(batches):
        for b in batches:
            ids, strand = b.column("interval_id"), b.column("strand")
            for f in unpacked(b.column("scores"), motifs, 1 << 20):
                row = pa.array(f.row + f.first)
                for k in range(motifs):
                    yield pa.RecordBatch.from_arrays([ids.take(row), strand.take(row), pa.array(np.full(len(f.row), k, np.int32)), pa.array(f.p.astype(np.int32)), pa.array(f.scores[k].astype(np.float64))], ["interval_id", "strand", "motif_idx", "p", "score"])

    return packed_rows.mapInArrow(fn, "interval_id long, strand int, motif_idx int, p int, score double")


def _scanned(strands: DataFrame) -> DataFrame:
    return strands.select(F.col("interval_id").cast("long").alias("interval_id"), F.col("strand").cast("int").alias("strand"), "seq")


def _reduced(strands: DataFrame, motifs: MotifSet, reduce, schema: str) -> DataFrame:
    """Rows (interval_id, strand, motif_idx, then reduce's columns) of the scanned rows, reduced where they lie.

    reduce(scores, places, starts): columns (motif, row) of float64 or int64, and a mask (motif, row) of cells to keep.
    starts holds only rows with places.
    """
    kernels = motifs.kernels
    names = [x.split()[0] for x in schema.split(", ")]

    def fn(batches):
        for b in batches:
            ids, strand = b.column("interval_id"), np.asarray(b.column("strand"))
            for f in scanned(b.column("seq"), kernels):
                rows = np.flatnonzero(f.counts)
                if not len(rows):
                    continue
                cols, keep = reduce(f.scores, f.p, f.starts[:-1][rows])
                k, at = np.nonzero(keep)
                row = rows[at] + f.first
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(strand[row].astype(np.int32)), pa.array(k.astype(np.int32)), *(pa.array(c[k, at]) for c in cols)], ["interval_id", "strand", "motif_idx", *names])

    return _scanned(strands).mapInArrow(fn, f"interval_id long, strand int, motif_idx int, {schema}")


def scan_statistics(strands: DataFrame, motifs: MotifSet) -> DataFrame:
    """interval_id, strand, motif_idx, n, total, best: places, sum and greatest of the scores."""

    def reduce(x, p, starts):
        n = np.diff(np.r_[starts, x.shape[1]])
        return (np.tile(n, (len(x), 1)), np.add.reduceat(x, starts, axis=1, dtype=np.float64), np.maximum.reduceat(x, starts, axis=1).astype(np.float64)), np.ones((len(x), len(starts)), bool)

    out = _reduced(strands, motifs, reduce, "n long, total double, best double").groupBy("interval_id", "strand", "motif_idx")
    return out.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"))


def scan_max(strands: DataFrame, motifs: MotifSet) -> DataFrame:
    """As max_hits of all scores, reduced in the scan: one row for each sequence, strand and motif is grouped."""
    limits = np.asarray(motifs.thresholds, np.float64)[:, None]

    def reduce(x, p, starts):
        best = np.maximum.reduceat(x, starts, axis=1)
        wide = np.diff(np.r_[starts, x.shape[1]])
        first = np.minimum.reduceat(np.where(x == np.repeat(best, wide, axis=1), p, np.iinfo(np.int64).max), starts, axis=1)
        return (first, best.astype(np.float64)), best > limits

    rows = _reduced(strands, motifs, reduce, "rel_pos long, score double").groupBy("interval_id", "motif_idx")
    best = rows.agg(F.max(F.struct("score", (-F.col("rel_pos")).alias("np"))).alias("b"))
    return best.select("interval_id", "motif_idx", (-F.col("b.np")).cast("int").alias("rel_pos"), F.col("b.score").alias("score"))


def scan_sums(strands: DataFrame, motifs: MotifSet, levels: dict[str, list[float]] | None = None) -> DataFrame:
    """interval_id, motif_idx, level, n_hits, score: number and sum of scores above the thresholds of each level.

    levels: thresholds by name, one for each motif; without it the motifs' own, named ``own``.
    """
    names = list(levels or {"own": motifs.thresholds})
    limits = [np.asarray(v, np.float64)[:, None] for v in (levels or {"own": motifs.thresholds}).values()]

    def reduce(x, p, starts):
        hit = [x > t for t in limits]
        n = [np.add.reduceat(h, starts, axis=1, dtype=np.int64) for h in hit]
        return tuple(n) + tuple(np.add.reduceat(np.where(h, x, 0), starts, axis=1, dtype=np.float64) for h in hit), sum(n) > 0

    schema = ", ".join([f"n{i} long" for i in range(len(names))] + [f"s{i} double" for i in range(len(names))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"n{i}").alias("n_hits"), F.col(f"s{i}").alias("score")) for i, k in enumerate(names)])).alias("e")
    rows = _reduced(strands, motifs, reduce, schema).select("interval_id", "motif_idx", each).select("interval_id", "motif_idx", "e.*").where("n_hits > 0")
    return rows.groupBy("interval_id", "motif_idx", "level").agg(F.sum("n_hits").alias("n_hits"), F.sum("score").alias("score"))


def _per_motif(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("motif_idx") + 1)


def hits(scores: DataFrame, motifs: MotifSet) -> DataFrame:
    """Scores strictly above their motif's threshold."""
    return scores.where(F.col("score") > _per_motif([float(t) for t in motifs.thresholds]))


def hit_positions(found: DataFrame, intervals: DataFrame, motifs: MotifSet) -> DataFrame:
    """HIT rows from scores' hits and intervals (interval_id, chrom, start, length).  Reverse hits get forward coordinates."""
    m, off = motifs.length, _per_motif(motifs.center_offsets())
    rows = found.join(intervals.select("interval_id", "chrom", F.col("start").alias("_at"), "length"), "interval_id")
    fwd = F.col("strand") == 0
    start = F.when(fwd, F.col("_at") + F.col("p")).otherwise(F.col("_at") + F.col("length") - F.col("p") - m)
    center = F.when(fwd, F.col("_at") + F.col("p") + off).otherwise(F.col("_at") + F.col("length") - 1 - F.col("p") - off)
    out = rows.withColumn("start_pos", start.cast("long")).withColumn("center_pos", center.cast("long"))
    return out.where((F.col("start_pos") >= F.col("_at")) & (F.col("start_pos") + m <= F.col("_at") + F.col("length"))).select("interval_id", "chrom", "start_pos", "center_pos", "motif_idx", "strand", "score")


def scan_hits(intervals: DataFrame, motifs: MotifSet, both: bool = True) -> DataFrame:
    """interval_id and HIT rows of intervals (interval_id, chrom, start, seq): scanned and placed in one narrow pass, so
    hits are not joined with their intervals again.  With columns tile_start and tile_end only hits whose centre lies in
    them, as in owned_hits."""
    tiled = "tile_start" in intervals.columns
    kernels, limits = motifs.kernels, np.asarray(motifs.thresholds, np.float64)[:, None]
    m, offsets = motifs.length, np.array(motifs.center_offsets(), np.int64)

    def fn(batches):
        for b in batches:
            ids, chrom = b.column("interval_id"), b.column("chrom")
            strand, begin = np.asarray(b.column("strand")).astype(np.int64), np.asarray(b.column("start")).astype(np.int64)
            for f in scanned(b.column("seq"), kernels):
                k, at = np.nonzero(f.scores > limits)
                own = f.row[at]
                row, size, p = own + f.first, f.lengths[own], f.p[at]
                fwd = strand[row] == 0
                first = begin[row] + np.where(fwd, p, size - p - m)
                center = begin[row] + np.where(fwd, p + offsets[k], size - 1 - p - offsets[k])
                if tiled:
                    lo, hi = (np.asarray(b.column(c)).astype(np.int64)[row] for c in ("tile_start", "tile_end"))
                    on = np.flatnonzero((center >= lo) & (center < hi))
                    k, at, row, first, center = k[on], at[on], row[on], first[on], center[on]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([ids.take(take), chrom.take(take), pa.array(first), pa.array(center), pa.array(k.astype(np.int32)), pa.array(strand[row].astype(np.int32)), pa.array(f.scores[k, at].astype(np.float64))], names)

    names = ["interval_id", "chrom", "start_pos", "center_pos", "motif_idx", "strand", "score"]
    rows = with_strands(intervals.select(F.col("interval_id").cast("long").alias("interval_id"), F.col("chrom").cast("string").alias("chrom"), F.col("start").cast("long").alias("start"), "seq", *(["tile_start", "tile_end"] if tiled else [])), both)
    return rows.mapInArrow(fn, "interval_id long, chrom string, start_pos long, center_pos long, motif_idx int, strand int, score double")


def owned_hits(found: DataFrame, tiles: DataFrame) -> DataFrame:
    """Hits whose centre lies in their own tile (interval_id, tile_start, tile_end): flanks overlap, hits don't repeat."""
    return found.join(tiles.select("interval_id", "tile_start", "tile_end"), "interval_id").where("center_pos >= tile_start and center_pos < tile_end").drop("tile_start", "tile_end")


def anchors(scores: DataFrame, lengths: DataFrame, query: int, threshold: float, w: int) -> DataFrame:
    """ANCHOR rows: the query's hits with a whole window of scores; lengths: interval_id, n (number of score positions)."""
    own = scores.where((F.col("motif_idx") == query) & (F.col("score") > threshold)).join(lengths, "interval_id")
    return own.where(f"n >= {2 * w + 1} and p >= {w} and p < n - {w}").select("interval_id", "strand", F.col("p").alias("pos"))


def max_hits(scores: DataFrame, motifs: MotifSet) -> DataFrame:
    """Greatest score of each (interval, motif), its first place, where it is a hit."""
    best = scores.groupBy("interval_id", "motif_idx").agg(F.max(F.struct("score", (-F.col("p")).alias("np"))).alias("b"))
    return hits(best.select("interval_id", "motif_idx", (-F.col("b.np")).alias("rel_pos"), F.col("b.score").alias("score")), motifs)


def sum_hits(scores: DataFrame, motifs: MotifSet) -> DataFrame:
    out = hits(scores, motifs).groupBy("interval_id", "motif_idx").agg(F.sum("score").alias("score")).where("score > 0")
    return out.select("interval_id", "motif_idx", F.lit(-1).alias("rel_pos"), "score")


def hit_counts(scores: DataFrame, motifs: MotifSet) -> DataFrame:
    return hits(scores, motifs).groupBy("motif_idx").agg(F.count("*").alias("n_hits"))


def query_hits(found: DataFrame, chrom: str, start: int, end: int, motif_idx: list[int] | None = None, min_score: float | None = None) -> DataFrame:
    """Hits with centre in [start, end) and score >= min_score: filters that reach a sorted Parquet table's row groups."""
    out = found.where((F.col("chrom") == chrom) & (F.col("center_pos") >= start) & (F.col("center_pos") < end))
    out = out.where(F.col("motif_idx").isin(motif_idx)) if motif_idx is not None else out
    return out.where(F.col("score") >= min_score) if min_score is not None else out


#: Letters whose hits one file of a hit table holds, about.
FILE_LETTERS = 1 << 22


def write_tile_hits(tiles: DataFrame, motifs: MotifSet, path: str, parts: int, both: bool = True) -> None:
    """The hits of tiles (interval_id, chrom, start, seq, tile_start, tile_end) as write_hits has them: the sequences are
    dealt by ranges, before they are scanned, into parts that follow their letters, ``parts`` at least."""
    letters = tiles.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    dealt = tiles.repartitionByRange(max(parts, -(-letters // FILE_LETTERS)), "chrom", "tile_start")
    found = scan_hits(dealt, motifs, both).drop("interval_id")
    found.sortWithinPartitions("chrom", "center_pos", "motif_idx").write.mode("overwrite").parquet(path)


def write_hits(found: DataFrame, path: str, parts: int) -> None:
    """Range-partitioned and sorted by place, so that range queries prune."""
    found.repartitionByRange(parts, "chrom", "center_pos").sortWithinPartitions("chrom", "center_pos", "motif_idx").write.mode("overwrite").parquet(path)
