"""Profiles: what lies at each offset from each anchor.

Sparse profiles join hits with hits by position; both strands are pooled and partners are hits.  Dense profiles read
the scores around anchors within an interval and strand; partners need no threshold, anchors a whole window.  Offsets
``rel`` are signed.  Sums are of doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import MotifSet
from .arrays import CELLS, Flat, cell_rows, scanned, scanned_both, unpacked
from .arrays import window_sums as sums
from .held_pairs import held_pairs
from .joins import points_in_intervals, range_join

BASE_NAMES = ["A", "C", "G", "T"]


def pair_profile(found: DataFrame, w: int, query=None, keys: tuple[str, ...] = ("chrom",), motif: str = "motif_idx") -> DataFrame:
    """anchor_motif, motif_idx, rel, value (and n_pairs) of hits; query: anchors of this motif only.  Pairs a hit with itself at 0."""
    a = found if query is None else found.where(F.col(motif) == query)
    a = a.select(*keys, F.col(motif).alias("anchor_motif"), F.col("center_pos").alias("_a"))
    b = found.select(*keys, F.col(motif).alias("motif_idx"), F.col("center_pos").alias("_b"), "score")
    pairs = range_join(a, b, list(keys), "_a", "_b", w)
    return pairs.groupBy("anchor_motif", "motif_idx", (F.col("_b") - F.col("_a")).alias("rel")).agg(F.sum("score").alias("value"), F.count("*").alias("n_pairs"))


def region_contributions(found: DataFrame, regions: DataFrame, w: int, query=None, motif: str = "motif_idx", bin_size: int = 1000) -> DataFrame:
    """Per distinct region (chrom, start, end): its hits' pair profile.  Every distinct region is computed once."""
    unique = regions.select("chrom", "start", "end").where("end > start").distinct()
    inside = points_in_intervals(found, unique, "center_pos", bin_size)
    keys = ("chrom", "start", "end")
    a = inside if query is None else inside.where(F.col(motif) == query)
    a = a.select(*keys, F.col(motif).alias("anchor_motif"), F.col("center_pos").alias("_a"))
    b = inside.select(*keys, F.col(motif).alias("motif_idx"), F.col("center_pos").alias("_b"), "score")
    pairs = range_join(a, b, list(keys), "_a", "_b", w)
    return pairs.groupBy(*keys, "anchor_motif", "motif_idx", (F.col("_b") - F.col("_a")).alias("rel")).agg(F.sum("score").alias("value"))


def multiplicities(memberships: DataFrame) -> DataFrame:
    """subset_id, chrom, start, end, count: memberships are a bag, an interval named twice counts twice."""
    return memberships.groupBy("subset_id", "chrom", "start", "end").agg(F.count("*").alias("count"))


def fan_out(contributions: DataFrame, memberships: DataFrame, strict: bool = False) -> DataFrame:
    """Sums contributions of distinct intervals over the subsets that hold them.  strict: an interval without any is an error."""
    m = multiplicities(memberships)
    keys = ["chrom", "start", "end"]
    if strict:
        missing = m.join(contributions.select(*keys).distinct(), keys, "left_anti").limit(1).count()
        if missing:
            raise ValueError("an interval of the memberships has no cached contribution")
    dims = [c for c in contributions.columns if c not in (*keys, "value")]
    return m.join(contributions, keys).groupBy("subset_id", *dims).agg(F.sum(F.col("value") * F.col("count")).alias("value"))


def fan_out_by_pattern(contributions: DataFrame, memberships: DataFrame) -> DataFrame:
    """As fan_out, in two steps: intervals with one and the same vector of subsets are summed before they fan out."""
    keys = ["chrom", "start", "end"]
    pattern = multiplicities(memberships).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("subset_id", "count"))).alias("pattern"))
    dims = [c for c in contributions.columns if c not in (*keys, "value")]
    small = contributions.join(pattern, keys).groupBy("pattern", *dims).agg(F.sum("value").alias("value"))
    return small.select(F.explode("pattern").alias("s"), *dims, "value").groupBy("s.subset_id", *dims).agg(F.sum(F.col("value") * F.col("s.count")).alias("value"))


def subset_profile(found: DataFrame, memberships: DataFrame, w: int, query=None, motif: str = "motif_idx", by_pattern: bool = False, bin_size: int = 1000) -> DataFrame:
    """What fan_out gives of region_contributions, without the pairs of each region: see held_pairs.  by_pattern and
    bin_size steered joins of hits with regions and change nothing now."""
    return held_pairs(found, memberships, w, query, motif)


def dense_profile_sql(scores: DataFrame, anchor_rows: DataFrame, w: int, per_interval: bool = False) -> DataFrame:
    """motif_idx, rel, value around given anchors, by a range join; per_interval keeps interval_id."""
    b = scores.where("score != 0").select("interval_id", "strand", "motif_idx", "p", "score")
    a = anchor_rows.select("interval_id", "strand", *(["anchor_motif"] if "anchor_motif" in anchor_rows.columns else []), "pos")
    pairs = range_join(a, b, ["interval_id", "strand"], "pos", "p", w)
    dims = [*(["interval_id"] if per_interval else []), *(["anchor_motif"] if "anchor_motif" in a.columns else []), "motif_idx"]
    return pairs.groupBy(*dims, (F.col("p") - F.col("pos")).alias("rel")).agg(F.sum("score").alias("value"))


def dense_profile(strands: DataFrame, motifs: MotifSet, w: int, query: int | None = None, kind: str = "score", per_interval: bool = False) -> DataFrame:
    """Scan and accumulate in one narrow pass; what is shuffled is one partial profile for each batch.

    kind ``score``: (anchor_motif,) motif_idx, rel, value, both strands added.  kind ``base``: strand, motif_idx, rel,
    base, value: composition around hits.  kind ``signal``: strand, motif_idx, rel, celltype, value, from a column
    ``signal`` of arrays (one for each cell type, as long as the sequence; not reversed for strand 1).
    per_interval adds interval_id, and each interval its own rows, which leave before the next ones are made.
    For kind ``score`` strands may be scan_packed's rows, whose scores are taken as they are.
    """
    held = "scores" in strands.columns
    kernels, limits, m = motifs.kernels, np.asarray(motifs.thresholds, np.float64)[:, None], motifs.length
    needs = [F.col("interval_id").cast("long").alias("interval_id"), F.col("strand").cast("int").alias("strand"), "scores" if held else "seq"] + (["signal"] if kind == "signal" else [])
    # The window is centred on the kernel's middle: m // 2, or (m - 1) // 2 where the kernel is longer than the window.
    mid = 0 if kind == "score" else m // 2 if 2 * w - m + 1 > 0 else (m - 1) // 2
    names = {"score": ["anchor_motif", "motif_idx"], "base": ["strand", "motif_idx", "channel"], "signal": ["strand", "motif_idx", "channel"]}[kind]
    dims = [*(["interval_id"] if per_interval else []), *names, "rel"]

    def anchors_of(f: Flat) -> tuple[np.ndarray, np.ndarray]:
        """(motif, place) of hits with a whole window, in the order of motifs."""
        x = f.scores > limits
        if query is not None and kind == "score":
            x[np.arange(len(x)) != query] = False
        a, at = np.nonzero(x)
        size = (f.counts if kind == "score" else f.lengths)[f.row[at]]
        p = f.p[at] + mid
        ok = (p >= w) & (p < size - w)
        return a[ok], at[ok]

    def sums_of(f: Flat, signal, a: np.ndarray, at: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        if kind == "score":
            return sums(f.scores, at, group, groups, w)
        row = f.row[at]
        if kind == "base":
            out = np.zeros((groups, 5, 2 * w + 1))
            place = f.offsets[row] + f.p[at] + mid
            for r in range(-w, w + 1):
                out[:, :, r + w] = np.bincount(group * 5 + f.codes[place + r], minlength=groups * 5).reshape(groups, 5)
            return out[:, :4]
        flat, at_row, channels = signal
        out = np.zeros((groups, channels, 2 * w + 1))
        for c in range(channels):
            place = at_row[f.first + row] + c * f.lengths[row] + f.p[at] + mid
            out[:, c] = sums(flat[None], place, group, groups, w)[:, 0]
        return out

    def fn(batches):
        for b in batches:
            ids, strand = np.asarray(b.column("interval_id").fill_null(0)), np.asarray(b.column("strand"))
            signal = _flat_signal(b.column("signal")) if kind == "signal" else None
            total: dict[int, np.ndarray] = {}
            # Cells of one interval's profile bound how many intervals are taken at a time.
            cells = CELLS if not per_interval else max(1, CELLS // (2 * w + 1))
            for f in unpacked(b.column("scores"), len(kernels), cells) if held else scanned(b.column("seq"), kernels, cells):
                a, at = anchors_of(f)
                if not len(a):
                    continue
                if per_interval:
                    yield from _each(f, signal, a, at, ids, strand)
                    continue
                for s in np.unique(strand[f.row[at] + f.first]).tolist() if kind != "score" else [0]:
                    on = slice(None) if kind == "score" else strand[f.row[at] + f.first] == s
                    v = sums_of(f, signal, a[on], at[on], a[on], len(kernels))
                    total[s] = total[s] + v if s in total else v
            for s, v in total.items():
                g = np.arange(len(kernels))
                keys = [g] if kind == "score" else [np.full(len(kernels), s), g]
                yield _batch(cell_rows(v, keys, w), kind)

    def _each(f: Flat, signal, a, at, ids, strand):
        row = f.row[at]
        key = row * len(kernels) + a
        o = np.argsort(key, kind="stable")
        a, at, key = a[o], at[o], key[o]
        known, group = np.unique(key, return_inverse=True)
        most = max(1, CELLS // (len(kernels) * (2 * w + 1)))
        for g in range(0, len(known), most):
            lo, hi = np.searchsorted(group, [g, min(g + most, len(known))])
            v = sums_of(f, signal, a[lo:hi], at[lo:hi], group[lo:hi] - g, min(most, len(known) - g))
            row, motif = known[g : g + most] // len(kernels) + f.first, known[g : g + most] % len(kernels)
            yield _batch(cell_rows(v, [ids[row], motif] if kind == "score" else [ids[row], strand[row], motif], w), kind)

    def _batch(cols: list[np.ndarray], kind: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*dims, "value"])

    partial = strands.select(*needs).mapInArrow(fn, ", ".join(f"{d} long" for d in dims) + ", value double")
    out = partial.groupBy(*dims).agg(F.sum("value").alias("value"))
    if kind == "base":
        out = out.withColumn("base", F.element_at(F.array(*map(F.lit, BASE_NAMES)), (F.col("channel") + 1).cast("int"))).drop("channel")
    return out.withColumnRenamed("channel", "celltype") if kind == "signal" else out


def interval_profiles(intervals: DataFrame, motifs: MotifSet, w: int, query: int | None = None, both: bool = True, keys: tuple[str, ...] = ("interval_id",)) -> DataFrame:
    """keys, (anchor_motif,) motif_idx, rel, value of dense_profile, per interval: both strands of an interval (keys, seq;
    one row each) are scanned in its row, so nothing is shuffled, and its rows leave one after another.

    With a query, only intervals with anchors of it are scanned with all motifs.
    """
    kernels, dims = motifs.kernels, ["motif_idx", "rel"] if query is not None else ["anchor_motif", "motif_idx", "rel"]

    def fn(batches):
        for b in batches:
            for rows, a, at, row, scores in _anchored(b, motifs, w, query, both):
                known, group = np.unique(row * len(kernels) + a, return_inverse=True)
                most = max(1, CELLS // (len(kernels) * (2 * w + 1)))
                for g in range(0, len(known), most):
                    lo, hi = np.searchsorted(group, [g, min(g + most, len(known))])
                    v = sums(scores, at[lo:hi], group[lo:hi] - g, min(most, len(known) - g), w)
                    own, *cols = cell_rows(v, [np.arange(g, g + len(v)), *([] if query is not None else [known[g : g + most] % len(kernels)])], w)
                    take = pa.array(rows[known[own] // len(kernels)])
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in keys), *map(pa.array, cols)], [*keys, *dims, "value"])

    kinds = dict(intervals.dtypes)
    return intervals.select(*keys, "seq").mapInArrow(fn, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{d} long" for d in dims), "value double"]))


def _anchored(b: pa.RecordBatch, motifs: MotifSet, w: int, query: int | None, both: bool):
    """(rows in b, then of each anchor its motif, place, row among these, in the order of rows and motifs, and the scores)."""
    seq, limits = b.column("seq"), np.asarray(motifs.thresholds, np.float64)[:, None]
    rows = np.arange(len(seq))
    if query is not None:  # a scan of the query alone finds the rows that matter
        one, has = motifs.take([query]), np.zeros(len(seq), bool)
        for strands in scanned_both(seq, one.kernels, both):
            for f in strands:
                has[f.first + f.row[(f.scores[0] > limits[query, 0]) & (f.p >= w) & (f.p < f.groups(f.counts) - w)]] = True
        rows = np.flatnonzero(has)
        seq = seq.take(pa.array(rows))
    for strands in scanned_both(seq, motifs.kernels, both, max(1, CELLS // (2 * w + 1))):
        found, past = [], 0
        for f in strands:
            x = (f.scores > limits) & (f.p >= w) & (f.p < f.groups(f.counts) - w)
            if query is not None:
                x[np.arange(len(x)) != query] = False
            a, at = np.nonzero(x)
            found.append((a, at + past, f.row[at]))
            past += f.scores.shape[1]
        a, at, row = (np.concatenate(x) for x in zip(*found))
        o = np.argsort(row * len(limits) + a, kind="stable")
        if len(o):
            yield rows[strands[0].first :], a[o], at[o], row[o], np.concatenate([f.scores for f in strands], axis=1)


def subset_curves(intervals: DataFrame, motifs: MotifSet, w: int, query: int | None = None, both: bool = True) -> DataFrame:
    """subset_id, (anchor_motif,) motif_idx, rel, value of intervals (seq, subsets: an array of subset_id and count).

    What interval_profiles and fan_out give, but an interval's profile is added to its subsets where it is made: one
    partial profile for each batch and subset is shuffled.
    """
    kernels, dims = motifs.kernels, ["motif_idx", "rel"] if query is not None else ["anchor_motif", "motif_idx", "rel"]
    kind = intervals.schema["subsets"].dataType.elementType["subset_id"].dataType.simpleString()

    def fn(batches):
        for b in batches:
            held = b.column("subsets")
            size = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, begin = held.flatten(), np.append(0, np.cumsum(size))
            name = flat.field("subset_id").dictionary_encode(null_encoding="encode")
            which, times = name.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field("count").to_numpy(zero_copy_only=False)
            for rows, a, at, row, scores in _anchored(b, motifs, w, query, both):
                own = rows[row]
                x = np.repeat(np.arange(len(a)), size[own])  # an anchor for each of its interval's subsets
                m = np.arange(len(x)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + begin[own][x]
                key = which[m] * len(kernels) + a[x]
                o = np.argsort(key, kind="stable")
                known, group = np.unique(key[o], return_inverse=True)
                most = max(1, CELLS // (len(kernels) * (2 * w + 1)))
                for g in range(0, len(known), most):
                    lo, hi = np.searchsorted(group, [g, min(g + most, len(known))])
                    v = sums(scores, at[x[o[lo:hi]]], group[lo:hi] - g, min(most, len(known) - g), w, times[m[o[lo:hi]]])
                    got, *cols = cell_rows(v, [np.arange(g, g + len(v)), *([] if query is not None else [known[g : g + most] % len(kernels)])], w)
                    yield pa.RecordBatch.from_arrays([name.dictionary.take(pa.array(known[got] // len(kernels))), *map(pa.array, cols)], ["subset_id", *dims, "value"])

    rows = intervals.select("seq", "subsets").mapInArrow(fn, f"subset_id {kind}, " + ", ".join(f"{d} long" for d in dims) + ", value double")
    return rows.groupBy("subset_id", *dims).agg(F.sum("value").alias("value"))


def anchored_profile(strands: DataFrame, motifs: MotifSet, w: int, per_interval: bool = True) -> DataFrame:
    """(interval_id,) motif_idx, rel, value around given anchors: strands with a column anchors, arrays of score places.

    Places without a whole window are left out.  The scan is that of dense_profile; no hits are looked for.
    """
    kernels = motifs.kernels
    dims = [*(["interval_id"] if per_interval else []), "motif_idx", "rel"]

    def fn(batches):
        for b in batches:
            ids, held = np.asarray(b.column("interval_id").fill_null(0)), b.column("anchors")
            sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            pos = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            for f in scanned(b.column("seq"), kernels, max(1, CELLS // (2 * w + 1))):
                n = len(f.counts)
                row = np.repeat(np.arange(n), sizes[f.first : f.first + n])
                p = pos[begin[f.first] : begin[f.first + n]]
                ok = (p >= w) & (p < f.counts[row] - w)
                row, p = row[ok], p[ok]
                if not len(p):
                    continue
                known, group = np.unique(row, return_inverse=True) if per_interval else (np.zeros(1, np.int64), np.zeros(len(row), np.int64))
                cols = cell_rows(sums(f.scores, f.starts[row] + p, group, len(known), w), [ids[known + f.first]] if per_interval else [], w)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [*dims, "value"])

    rows = strands.select(F.col("interval_id").cast("long").alias("interval_id"), "seq", F.col("anchors").cast("array<long>").alias("anchors"))
    return rows.mapInArrow(fn, ", ".join(f"{d} long" for d in dims) + ", value double").groupBy(*dims).agg(F.sum("value").alias("value"))


def anchored_curves(strands: DataFrame, motifs: MotifSet, w: int) -> DataFrame:
    """subset_id, motif_idx, rel, value around given anchors: strands (seq, anchors) with subsets, as in subset_curves."""
    kernels, kind = motifs.kernels, strands.schema["subsets"].dataType.elementType["subset_id"].dataType.simpleString()

    def fn(batches):
        for b in batches:
            held, own_subsets = b.column("anchors"), b.column("subsets")
            sizes, many = (c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (held, own_subsets))
            pos, flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64), own_subsets.flatten()
            begin, first = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(many))
            name = flat.field("subset_id").dictionary_encode(null_encoding="encode")
            which, times = name.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.field("count").to_numpy(zero_copy_only=False)
            for f in scanned(b.column("seq"), kernels, max(1, CELLS // (2 * w + 1))):
                n = len(f.counts)
                row, p = np.repeat(np.arange(n), sizes[f.first : f.first + n]), pos[begin[f.first] : begin[f.first + n]]
                ok = (p >= w) & (p < f.counts[row] - w)
                row, p = row[ok], p[ok]
                if not len(p):
                    continue
                own = many[row + f.first]
                x = np.repeat(np.arange(len(p)), own)  # an anchor for each of its interval's subsets
                m = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + first[row + f.first][x]
                o = np.argsort(which[m], kind="stable")
                known, group = np.unique(which[m][o], return_inverse=True)
                got, *cols = cell_rows(sums(f.scores, (f.starts[row] + p)[x[o]], group, len(known), w, times[m[o]]), [np.arange(len(known))], w)
                yield pa.RecordBatch.from_arrays([name.dictionary.take(pa.array(known[got])), *map(pa.array, cols)], ["subset_id", "motif_idx", "rel", "value"])

    rows = strands.select("seq", F.col("anchors").cast("array<long>").alias("anchors"), "subsets")
    return rows.mapInArrow(fn, f"subset_id {kind}, motif_idx long, rel long, value double").groupBy("subset_id", "motif_idx", "rel").agg(F.sum("value").alias("value"))


def _flat_signal(col: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, where each row's begin, cell types) of a column of arrays of arrays."""
    inner = col.flatten()
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    channels = int(sizes.max()) if len(sizes) else 0
    lens = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(lens)])
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    return inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64), begin[first], channels


def window_sums(scores: DataFrame, anchor_rows: DataFrame, w: int) -> DataFrame:
    """motif_idx, value: sums over whole windows, from running sums (one scalar for each motif)."""
    from pyspark.sql.window import Window

    run = Window.partitionBy("interval_id", "strand", "motif_idx").orderBy("p")
    c = scores.withColumn("c", F.sum("score").over(run)).select("interval_id", "strand", "motif_idx", "p", "c")
    hi = anchor_rows.select("interval_id", "strand", (F.col("pos") + w).alias("p")).join(c, ["interval_id", "strand", "p"]).select("motif_idx", F.col("c").alias("v"))
    lo = anchor_rows.select("interval_id", "strand", (F.col("pos") - w - 1).alias("p")).join(c, ["interval_id", "strand", "p"]).select("motif_idx", (-F.col("c")).alias("v"))
    return hi.union(lo).groupBy("motif_idx").agg(F.sum("v").alias("value"))


def window_totals(strands: DataFrame, motifs: MotifSet, query: int, w: int) -> DataFrame:
    """motif_idx, value: what window_sums gives around the query motif's anchors, from running sums inside the scan, or
    over scan_packed's rows."""
    held = "scores" in strands.columns
    kernels, limit = motifs.kernels, float(motifs.thresholds[query])

    def fn(batches):
        for b in batches:
            total = np.zeros(len(kernels))
            for f in unpacked(b.column("scores"), len(kernels)) if held else scanned(b.column("seq"), kernels):
                at = np.flatnonzero((f.scores[query] > limit) & (f.p >= w) & (f.p < f.groups(f.counts) - w))
                run = np.concatenate([np.zeros((len(kernels), 1)), np.cumsum(f.scores, axis=1, dtype=np.float64)], 1)
                total += (run[:, at + w + 1] - run[:, at - w]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(kernels), dtype=np.int32)), pa.array(total)], ["motif_idx", "value"])

    return strands.select("scores" if held else "seq").mapInArrow(fn, "motif_idx int, value double").groupBy("motif_idx").agg(F.sum("value").alias("value")).where("value != 0")


def to_curves(profile: DataFrame, w: int, dims: list[str], value: str = "value") -> DataFrame:
    """dims, curve: an array of 2 w + 1 values, 0 where a cell is missing."""
    m = F.map_from_entries(F.collect_list(F.struct(F.col("rel").cast("int"), F.col(value).cast("double"))))
    out = profile.groupBy(*dims).agg(m.alias("_m"))
    return out.select(*dims, F.transform(F.sequence(F.lit(-w), F.lit(w)), lambda r: F.coalesce(F.try_element_at("_m", r), F.lit(0.0))).alias("curve"))
