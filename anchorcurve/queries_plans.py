"""Registered queries of caches, composite runs, rankings and plot frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import curves as V
from .operators import intervals as I
from .operators import profile as P
from .operators import scan as S
from .plans import resources as R
from .plans import workflows as W
from .plans.analysis import analyze
from .queries import _CURVES, _SUBSET, CELLS, HITS, LETTERS, SCORES, THRESHOLDS, _curves, _whole, event_hits, motifs, purchases, query, scores_sql, segment_memberships, sequences, table
from .queries_io import CHUNK, _signal_store, chunks
from .sources import readers, sinks
from .sources.folders import cut, new_path

WIDE = 12

# Hits of every document as a chromosome, both strands, by their centre.
_HITS = f"""{SCORES}, gh AS (SELECT CAST(interval_id AS VARCHAR) AS chrom, CAST(CASE WHEN strand = 0 THEN p ELSE n + 2 - p - 3 END AS BIGINT) AS start_pos, CAST(CASE WHEN strand = 0 THEN p + 1 ELSE n + 2 - 1 - p - 1 END AS BIGINT) AS center_pos,
CAST(motif_idx AS INT) AS motif_idx, CAST(strand AS INT) AS strand, CAST(score AS BIGINT) AS score FROM hs)"""


def _hit_cache(spark, sf_dir, **how):
    c = R.HitCache(new_path(spark, "hits"))
    c.build(chunks(spark, sf_dir), CHUNK, motifs(), parts=8, **how)
    return c


def _hit_rows(df):
    return df.select("chrom", "start_pos", "center_pos", "motif_idx", "strand", F.col("score").cast("long").alias("score"))


@query(f"WITH {_HITS} SELECT * FROM gh")
def hit_cache(spark, sf_dir):
    """A cache of all hits, built by tiles: each hit is owned by the tile of its centre and written once."""
    return _hit_rows(_hit_cache(spark, sf_dir, tile=64).hits(spark))


@query(f"WITH {_HITS}, l AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, length(s) AS n FROM d), r AS (SELECT chrom, 20 AS a, least(n, 120) AS b FROM l UNION ALL SELECT chrom, 100, least(n, 180) FROM l UNION ALL SELECT chrom, 300, least(n, 333) FROM l) SELECT DISTINCT gh.* FROM gh JOIN r ON gh.chrom = r.chrom AND center_pos >= a AND center_pos < b")
def hit_cache_regions(spark, sf_dir):
    """The same of regions, which are merged and cut to their chromosomes first."""
    c = chunks(spark, sf_dir).select("chrom").distinct()
    regions = c.select("chrom", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in ((20, 120), (100, 180), (300, 333))])).alias("r")).select("chrom", "r.*")
    return _hit_rows(_hit_cache(spark, sf_dir, regions=regions).hits(spark))


@query(f"WITH {_HITS} SELECT * FROM gh WHERE chrom = '7' AND center_pos >= 10 AND center_pos < 900 AND motif_idx IN (0, 2) AND score >= 3")
def hit_cache_query(spark, sf_dir):
    """Cached hits of a range, two motifs, an inclusive least score."""
    return _hit_rows(_hit_cache(spark, sf_dir, tile=64).query(spark, "7", 10, 900, [0, 2], 3.0))


@query(f"""WITH {_HITS}, l AS (SELECT CAST(doc_id AS VARCHAR) AS chrom, length(s) AS n FROM d), r AS (SELECT chrom, 0 AS a, 150 AS b, 1 AS c FROM l UNION ALL SELECT chrom, 100, 400, 2 FROM l),
x AS (SELECT gh.*, a, c FROM gh JOIN r ON gh.chrom = r.chrom AND center_pos >= a AND center_pos < b), y AS (SELECT x.*, d FROM x, unnest(range(-20, 21)) AS u(d) WHERE motif_idx = 0),
z AS (SELECT chrom, a, motif_idx, center_pos, sum(score) AS score FROM x GROUP BY ALL)
SELECT CAST(z.motif_idx AS INT) AS motif_idx, CAST(d AS BIGINT) AS rel, CAST(sum(z.score * y.c) AS BIGINT) AS value FROM y JOIN z ON y.chrom = z.chrom AND y.a = z.a AND z.center_pos = y.center_pos + d GROUP BY ALL""")
def hit_cache_profile(spark, sf_dir):
    """A sparse profile around one motif from cached hits, regions with repeats, by the general entry."""
    c = chunks(spark, sf_dir).select("chrom").distinct()
    pairs = ((0, 150), (100, 400), (100, 400))
    regions = c.select("chrom", F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end")) for a, b in pairs])).alias("r")).select("chrom", "r.*")
    out = analyze(chunks(spark, sf_dir), CHUNK, motifs(), "target", regions, 20, 0, hit_cache=_hit_cache(spark, sf_dir, tile=64))
    return _whole(out, "value").withColumn("motif_idx", F.col("motif_idx").cast("int"))


# Two overlapping intervals of each document, the first of which counts twice in its subset.
_IV = f"""SELECT doc_id * 2 + k AS doc_id, substr(s, CASE k WHEN 0 THEN 11 ELSE 61 END, CAST(least(length(s), CASE k WHEN 0 THEN 130 ELSE 260 END) - CASE k WHEN 0 THEN 10 ELSE 60 END AS BIGINT)) AS s FROM ({LETTERS}), unnest(range(0, 2)) AS u(k) WHERE length(s) > CASE k WHEN 0 THEN 10 ELSE 60 END"""
_IV_SCORES = f"""{scores_sql(_IV)}, iv AS (SELECT doc_id AS interval_id, CAST(doc_id // 2 AS VARCHAR) AS chrom, CASE doc_id % 2 WHEN 0 THEN 10 ELSE 60 END AS start, CASE doc_id % 2 WHEN 0 THEN 10 ELSE 60 END + length(s) AS "end" FROM d),
ms AS (SELECT iv.interval_id, source AS subset_id, 2 AS c FROM iv JOIN documents ON documents.doc_id = iv.interval_id // 2 WHERE iv.interval_id % 2 = 0 AND source IS NOT NULL UNION ALL SELECT iv.interval_id, 'L-' || lang, 1 FROM iv JOIN documents ON documents.doc_id = iv.interval_id // 2 WHERE iv.interval_id % 2 = 1 AND lang IS NOT NULL),
an AS (SELECT * FROM hs WHERE n >= {2 * WIDE + 1} AND p >= {WIDE} AND p < n - {WIDE}), nz AS (SELECT * FROM sc WHERE score != 0),
con AS (SELECT a.interval_id, a.motif_idx AS anchor_motif, b.motif_idx, r AS rel, sum(b.score) AS value FROM (SELECT an.*, r FROM an, unnest(range(-{WIDE}, {WIDE + 1})) AS u(r)) a JOIN nz b ON a.interval_id = b.interval_id AND a.strand = b.strand AND b.p = a.p + r GROUP BY ALL)"""


def _intervals(spark, sf_dir):
    """interval_id, chrom, start, end within the documents' letters."""
    d = sequences(spark, sf_dir).select("interval_id", F.length("seq").alias("n"))
    two = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(10).cast("long").alias("start"), F.lit(130).alias("to")), F.struct(F.lit(1).alias("k"), F.lit(60).cast("long").alias("start"), F.lit(260).alias("to")))).alias("x")
    out = d.select("interval_id", "n", two).select((F.col("interval_id") * 2 + F.col("x.k")).cast("long").alias("interval_id"), F.col("interval_id").cast("string").alias("chrom"), "x.start", F.least("n", "x.to").cast("long").alias("end"))
    return out.where("end > start")


def _fetched(spark, sf_dir):
    return cut(readers.fetch_sequences(chunks(spark, sf_dir), _intervals(spark, sf_dir), CHUNK), "fetched")


def _members(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chrom"), "source", "lang")
    m = _intervals(spark, sf_dir).join(d, "chrom")
    first = m.where("interval_id % 2 = 0 and source is not null").select(F.col("source").alias("subset_id"), "chrom", "start", "end")
    return first.unionAll(first).unionAll(m.where("interval_id % 2 = 1 and lang is not null").select(F.concat(F.lit("L-"), "lang").alias("subset_id"), "chrom", "start", "end"))


_ANCHORS = f'WITH {_IV_SCORES} SELECT iv.chrom, CAST(iv.start AS BIGINT) AS start, CAST(iv."end" AS BIGINT) AS "end", CAST(strand AS INT) AS strand, CAST(p AS BIGINT) AS pos FROM an JOIN iv USING (interval_id) WHERE motif_idx = 0'


@query(_ANCHORS)
def anchor_cache(spark, sf_dir):
    """Anchors of one motif in distinct intervals, each scanned by itself."""
    c = R.AnchorCache(new_path(spark, "anchors"))
    c.build(_fetched(spark, sf_dir), motifs(), 0, WIDE)
    return _whole(c.anchors(spark), "pos")


def _tile_cache(spark, sf_dir):
    c = R.AnchorCache(new_path(spark, "anchors"))
    c.build_from_tiles(chunks(spark, sf_dir), CHUNK, _intervals(spark, sf_dir), motifs(), 0, WIDE, 50, 5)
    return c


@query(_ANCHORS)
def anchor_cache_tiles(spark, sf_dir):
    """The same from tiles that the intervals touch, each scanned once, places carried over to the intervals."""
    return _whole(_tile_cache(spark, sf_dir).anchors(spark), "pos")


@query(f'WITH {_IV_SCORES}, c AS (SELECT interval_id, count(*) AS n FROM an WHERE motif_idx = 0 GROUP BY ALL) SELECT iv.chrom, CAST(iv.start AS BIGINT) AS start, CAST(iv."end" AS BIGINT) AS "end", CAST(coalesce(c.n, 0) AS BIGINT) AS n_anchors FROM iv LEFT JOIN c USING (interval_id)')
def anchor_counts(spark, sf_dir):
    """Anchors by interval, none too."""
    return _tile_cache(spark, sf_dir).counts(spark)


_TARGET = f"WITH {_IV_SCORES} SELECT subset_id, CAST(motif_idx AS BIGINT) AS motif_idx, CAST(rel AS BIGINT) AS rel, CAST(sum(value * c) AS BIGINT) AS value FROM con JOIN ms USING (interval_id) WHERE anchor_motif = 0 GROUP BY ALL"


@query(_TARGET)
def anchor_replay(spark, sf_dir):
    """Subset profiles around cached anchors: only intervals with anchors are scanned again."""
    return _whole(_tile_cache(spark, sf_dir).replay(_fetched(spark, sf_dir), _members(spark, sf_dir), motifs(), 0, WIDE), "value")


@query(_TARGET)
def full_curve_reuse(spark, sf_dir):
    """Subset profiles around one motif: prefilter, each interval once, added to its subsets where it lies."""
    return _whole(W.full_curves(_fetched(spark, sf_dir), _members(spark, sf_dir), motifs(), 0, WIDE, by_pattern=True), "value")


@query(f"WITH {_IV_SCORES} SELECT subset_id, CAST(anchor_motif AS BIGINT) AS anchor_motif, CAST(motif_idx AS BIGINT) AS motif_idx, CAST(rel AS BIGINT) AS rel, CAST(sum(value * c) AS BIGINT) AS value FROM con JOIN ms USING (interval_id) GROUP BY ALL")
def dense_subset_pairs(spark, sf_dir):
    """Subset profiles of all pairs."""
    return _whole(W.full_curves(_fetched(spark, sf_dir), _members(spark, sf_dir), motifs(), None, WIDE), "value")


@query(f'WITH {_IV_SCORES} SELECT iv.chrom, CAST(iv.start AS BIGINT) AS start, CAST(iv."end" AS BIGINT) AS "end", CAST(anchor_motif AS BIGINT) AS anchor_motif, CAST(motif_idx AS BIGINT) AS motif_idx, CAST(rel AS BIGINT) AS rel, CAST(value AS BIGINT) AS value FROM con JOIN iv USING (interval_id)')
def interval_contributions(spark, sf_dir):
    """Dense profiles by interval, of all pairs."""
    return _whole(W.dense_contributions(_fetched(spark, sf_dir), motifs(), WIDE), "value")


@query(_TARGET)
def dense_cache_replay(spark, sf_dir):
    """Dense contributions written once, then replayed for memberships; what the cache lacks is zero."""
    c = R.ContributionCache(new_path(spark, "dense"))
    c.build(W.dense_contributions(_fetched(spark, sf_dir), motifs(), WIDE, 0), {"half_window": WIDE})
    return _whole(c.replay(_members(spark, sf_dir), {"half_window": WIDE}), "value")


@query(_SUBSET)
def sparse_cache_replay(spark, sf_dir):
    """Sparse contributions written once, as hits by place and regions, then replayed for memberships."""
    c, m = R.ContributionCache(new_path(spark, "sparse")), segment_memberships(spark, sf_dir)
    c.build_sparse(event_hits(spark, sf_dir), m, 120, {"half_window": 120})
    return c.replay(m, {"half_window": 120})


@query(f'WITH {_IV_SCORES} SELECT interval_id, CAST(strand AS INT) AS strand, CAST(motif_idx AS INT) AS motif_idx, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, CAST(sum(score * (p + 1)) AS BIGINT) AS moment FROM sc GROUP BY ALL')
def block_scores(spark, sf_dir):
    """Scores of intervals, cut from blocks of near intervals that are scanned once."""
    s = W.block_scores(chunks(spark, sf_dir), CHUNK, _intervals(spark, sf_dir), motifs(), 20, 300)
    return s.groupBy("interval_id", "strand", "motif_idx").agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total"), F.sum(F.col("score") * (F.col("p") + 1)).cast("long").alias("moment"))


@query(f"WITH {_IV_SCORES} SELECT count(*) AS n_cells, CAST(0 AS BIGINT) AS n_apart FROM con WHERE anchor_motif = 0")
def provider_check(spark, sf_dir):
    """Profiles from single intervals and from blocks, compared cell by cell."""
    one = P.interval_profiles(_fetched(spark, sf_dir), motifs(), WIDE, 0)
    blocks = W.block_arrays(chunks(spark, sf_dir), CHUNK, _intervals(spark, sf_dir), motifs(), 20, 300)
    block = P.dense_profile(blocks, motifs(), WIDE, 0, per_interval=True)
    return R.compared_profiles(one, block, ["interval_id", "motif_idx", "rel"])


# Whole segments of 80 letters of each chunk of 100: the last 20 letters of a chunk belong to none.
_SEG = f"SELECT doc_id * 100000 + c AS doc_id, substr(s, CAST(c + 1 AS BIGINT), 80) AS s FROM ({LETTERS}), unnest(range(0, length(s), 100)) AS u(c) WHERE c + 80 <= length(s)"
_SEG_SCORES = f"{scores_sql(_SEG)}, nz AS (SELECT * FROM sc WHERE score != 0), a AS (SELECT hs.*, r FROM hs, unnest(range(-10, 11)) AS u(r) WHERE n >= 21 AND p >= 10 AND p < n - 10)"


@query(f"WITH {_SEG_SCORES} SELECT CAST(a.motif_idx AS BIGINT) AS anchor_motif, CAST(b.motif_idx AS BIGINT) AS motif_idx, CAST(r AS BIGINT) AS rel, CAST(sum(b.score) AS BIGINT) AS value FROM a JOIN nz b ON a.interval_id = b.interval_id AND a.strand = b.strand AND b.p = a.p + r GROUP BY ALL")
def chromosome_pairs(spark, sf_dir):
    """Whole chromosomes in segments, tails dropped: all pairs."""
    return _whole(analyze(chunks(spark, sf_dir), CHUNK, motifs(), "pairs", w=10, segment=80), "value")


@query(f"WITH {_SEG_SCORES} SELECT CAST(b.motif_idx AS BIGINT) AS motif_idx, CAST(r AS BIGINT) AS rel, CAST(sum(b.score) AS BIGINT) AS value FROM a JOIN nz b ON a.interval_id = b.interval_id AND a.strand = b.strand AND b.p = a.p + r WHERE a.motif_idx = 1 GROUP BY ALL")
def chromosome_target(spark, sf_dir):
    """The same around one motif, written under its name and read back."""
    path, m = new_path(spark, "analysis"), motifs()
    analyze(chunks(spark, sf_dir), CHUNK, m, "target", w=10, query=1, segment=80, output=path)
    return _whole(spark.read.parquet(f"{path}/{sinks.result_name('target', m.names[1])}"), "value")


def _some_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir).unionByName(spark.createDataFrame([(-1, "unknown", 0, 50)], "interval_id long, chrom string, start long, end long"))


@query(f"WITH {_IV_SCORES} SELECT CAST(a.strand AS BIGINT) AS strand, CAST(a.motif_idx AS BIGINT) AS motif_idx, CAST(r AS BIGINT) AS rel, substr(seq.s, CAST(a.p + 1 + r + 1 AS INT), 1) AS base, count(*) AS value FROM hs a JOIN seq ON a.interval_id = seq.interval_id AND a.strand = seq.strand, unnest(range(-10, 11)) AS u(r) WHERE length(seq.s) >= 21 AND a.p + 1 >= 10 AND a.p + 1 < length(seq.s) - 10 GROUP BY ALL")
def region_bases(spark, sf_dir):
    """Bases around hits of regions; regions on unknown chromosomes are left out."""
    return _whole(analyze(chunks(spark, sf_dir), CHUNK, motifs(), "sequence", _some_intervals(spark, sf_dir), 10), "value")


_FWD = f"{_IV_SCORES}, fwd AS (SELECT * FROM sc WHERE strand = 0)"


@query(f'WITH {_FWD}, b AS (SELECT *, max(score) OVER (PARTITION BY interval_id, motif_idx) AS best FROM fwd), m AS (SELECT interval_id, motif_idx, min(p) AS rel_pos, any_value(best) AS score FROM b JOIN t USING (motif_idx) WHERE score = best AND best > thr GROUP BY ALL) SELECT iv.chrom, CAST(iv.start AS BIGINT) AS start, CAST(iv."end" AS BIGINT) AS "end", CAST(motif_idx AS INT) AS motif_idx, CAST(rel_pos AS INT) AS rel_pos, CAST(score AS BIGINT) AS score FROM m JOIN iv USING (interval_id)')
def region_max_hits(spark, sf_dir):
    """The best hit of each region and motif, by the general entry."""
    return _whole(analyze(chunks(spark, sf_dir), CHUNK, motifs(), "max_hits", _some_intervals(spark, sf_dir)), "score")


@query(f'WITH {_FWD} SELECT iv.chrom, CAST(iv.start AS BIGINT) AS start, CAST(iv."end" AS BIGINT) AS "end", CAST(motif_idx AS INT) AS motif_idx, CAST(-1 AS INT) AS rel_pos, CAST(sum(score) AS BIGINT) AS score FROM hs JOIN iv USING (interval_id) WHERE strand = 0 GROUP BY ALL')
def region_sum_hits(spark, sf_dir):
    """The sum of hits of each region and motif."""
    return _whole(analyze(chunks(spark, sf_dir), CHUNK, motifs(), "sum_hits", _some_intervals(spark, sf_dir)), "score")


@query(f'WITH {_IV_SCORES} SELECT iv.chrom, CAST(iv.start + CASE WHEN strand = 0 THEN p ELSE n + 2 - p - 3 END AS BIGINT) AS start_pos, CAST(iv.start + CASE WHEN strand = 0 THEN p + 1 ELSE n + 2 - 1 - p - 1 END AS BIGINT) AS center_pos, CAST(motif_idx AS INT) AS motif_idx, CAST(strand AS INT) AS strand, CAST(score AS BIGINT) AS score FROM hs JOIN iv USING (interval_id)')
def region_hits(spark, sf_dir):
    """Hits of regions in the chromosomes' coordinates; overlapping regions have theirs each."""
    return _hit_rows(analyze(chunks(spark, sf_dir), CHUNK, motifs(), "hits", _some_intervals(spark, sf_dir)))


@query(f"""WITH {_IV_SCORES} SELECT CAST(a.strand AS BIGINT) AS strand, CAST(a.motif_idx AS BIGINT) AS motif_idx, CAST(r AS BIGINT) AS rel, CAST(c AS BIGINT) AS celltype, CAST(sum(CASE WHEN c = (iv.start + a.p + 1 + r) % 3 THEN iv.start + a.p + 1 + r ELSE 0 END) AS BIGINT) AS value
FROM hs a JOIN iv USING (interval_id), unnest(range(0, 2)) AS v(c), unnest(range(-10, 11)) AS u(r) WHERE a.n + 2 >= 21 AND a.p + 1 >= 10 AND a.p + 1 < a.n + 2 - 10 GROUP BY ALL HAVING value != 0""")
def region_signal(spark, sf_dir):
    """Stored tracks of two cell types around hits of regions."""
    path, c = new_path(spark, "tracks"), chunks(spark, sf_dir)
    place = F.posexplode(F.split("seq", "")).alias("i", "b")
    rows = c.select("chrom", "chunk_start", place).where("b != ''").select("chrom", (F.col("chunk_start") + F.col("i")).alias("pos"))
    rows.withColumn("celltype", F.concat(F.lit("c"), (F.col("pos") % 3).cast("string"))).withColumn("value", F.col("pos").cast("double")).write.parquet(path)
    signal = readers.read_signal(spark, path, ["c0", "c1"])
    return _whole(analyze(c, CHUNK, motifs(), "signal2d", _some_intervals(spark, sf_dir), 10, signal=signal), "value")


@query("SELECT n, bytes_each, dense, share, CAST(floor(4 * dense * share) AS BIGINT) AS sparse, CASE WHEN dense <= 3000000 THEN 'dense' WHEN 4 * dense * 0.02 <= 3000000 THEN 'sparse' ELSE 'none' END AS recommend FROM (SELECT n, CAST(4 * 3 * 25 AS BIGINT) AS bytes_each, CAST(4 * 3 * 25 * n AS BIGINT) AS dense FROM (SELECT unnest([(SELECT count(*) FROM nation), (SELECT count(*) FROM nation) * 1000, (SELECT count(*) FROM nation) * 100000]) AS n)), (VALUES (0.02), (0.2), (0.5)) AS s(share)")
def cache_plan(spark, sf_dir):
    """Sizes of contribution caches, and which kind is advised."""
    n, rows = table(spark, sf_dir, "nation").count(), []
    for k in (n, 1000 * n, 100_000 * n):
        p = R.cache_plan(k, 3, 12, True, 3_000_000)
        rows += [(k, p["bytes_per_interval"], p["dense_bytes"], s, b, p["recommend"]) for s, b in p["sparse_bytes"].items()]
    return spark.createDataFrame(rows, "n long, bytes_each long, dense long, share double, sparse long, recommend string").withColumn("share", F.col("share").cast("decimal(3,2)"))


@query("SELECT * FROM (VALUES ('anchors', 'half_window'), ('anchors', 'query'), ('hits', 'ext'), ('hits', 'unknown'), ('values', 'half_window')) AS t(cache, entry)")
def cache_mismatches(spark, sf_dir):
    """What of their metadata doesn't fit, cache by cache; a missing entry counts."""
    m, other = motifs(), motifs().take([1, 0, 2])
    a, c = _tile_cache(spark, sf_dir), R.ContributionCache(new_path(spark, "values"))
    c.build(spark.createDataFrame([("c", 0, 5, 0, 1, 2.0)], "chrom string, start long, end long, motif_idx int, rel int, value double"), {"half_window": 3})
    found = [("anchors", x) for x in R.mismatches(a.meta(spark), R.AnchorCache.describe(other, 0, WIDE + 1, True))]
    found += [("hits", x) for x in _hit_cache(spark, sf_dir, tile=64).mismatches(spark, R.HitCache.describe(m, 64, 3, True) | {"unknown": 1})]
    found += [("values", x) for x in c.mismatches(spark, {"half_window": 4})]
    return spark.createDataFrame(found, "cache string, entry string")


_CURVE = f"WITH {_CURVES}"
_RANKS = f"""WITH {_CURVES}, ok AS (SELECT subset_id, n_regions FROM cnt WHERE n_regions >= 100),
m AS (SELECT subset_id, motif_idx, n_regions, median(x / n_regions) AS mid FROM cv JOIN ok USING (subset_id) GROUP BY ALL), n AS (SELECT cv.subset_id, cv.motif_idx, rel, x / n_regions - mid AS x FROM cv JOIN m USING (subset_id, motif_idx)),
sm AS (SELECT c.subset_id, c.motif_idx, c.rel, sum(z.x) / 11 AS y FROM n c, unnest(range(-5, 6)) AS u(q), n z WHERE z.subset_id = c.subset_id AND z.motif_idx = c.motif_idx AND z.rel = least(120, greatest(-120, c.rel + q)) GROUP BY ALL),
a AS (SELECT subset_id, motif_idx, max(abs(y)) AS amp, sqrt(sum(y * y)) AS norm FROM sm GROUP BY ALL HAVING max(abs(y)) > 0),
v AS (SELECT motif_idx, avg(v) AS var FROM (SELECT motif_idx, rel, var_pop(y / norm) AS v FROM sm JOIN a USING (subset_id, motif_idx) GROUP BY ALL) GROUP BY ALL), b AS (SELECT motif_idx, count(*) AS n_subsets, stddev_pop(ln(1 + amp)) AS spread FROM a GROUP BY ALL),
e AS (SELECT DISTINCT motif_idx FROM cv),
f AS (SELECT motif_idx, coalesce(n_subsets, 0) AS n_subsets, CASE WHEN n_subsets >= 2 THEN var END AS sv, CASE WHEN n_subsets >= 2 THEN spread ELSE 0 END AS sp FROM e LEFT JOIN b USING (motif_idx) LEFT JOIN v USING (motif_idx)),
r AS (SELECT motif_idx, n_subsets, rank() OVER (ORDER BY sv DESC NULLS LAST) AS shape_rank, rank() OVER (ORDER BY sp DESC NULLS LAST) AS amplitude_rank FROM f)"""


@query(f"{_RANKS} SELECT motif_idx, n_subsets, CAST(shape_rank AS INT) AS shape_rank, CAST(amplitude_rank AS INT) AS amplitude_rank, CAST(shape_rank + amplitude_rank AS INT) AS rank_sum, CAST(row_number() OVER (ORDER BY shape_rank + amplitude_rank, motif_idx) AS INT) AS place FROM r QUALIFY place <= 3")
def context_ranks(spark, sf_dir):
    """The three motifs of least rank sum, of subsets with 100 regions at least."""
    from pyspark.sql.window import Window

    n = segment_memberships(spark, sf_dir).groupBy("subset_id").agg(F.count("*").alias("n_regions"))
    top = V.top_contexts(V.rank_contexts(_curves(spark, sf_dir), n, 100), 3)
    return top.select("motif_idx", "n_subsets", "shape_rank", "amplitude_rank", "rank_sum", F.row_number().over(Window.orderBy("rank_sum", "motif_idx")).alias("place"))


@query(f"{_CURVE} SELECT subset_id, motif_idx, round(sum(x), 3) AS total FROM cv GROUP BY ALL HAVING sum(x) > 100 AND max(x) > 5 * stddev_samp(x)")
def heatmap_filter(spark, sf_dir):
    """Curves worth a row of a heat map."""
    rows = V.heatmap_rows(_curves(spark, sf_dir))
    return rows.select("subset_id", "motif_idx", F.round(F.aggregate("curve", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query(f"WITH {HITS}, s AS (SELECT a.motif_idx AS anchor, b.motif_idx AS partner, b.center_pos - a.center_pos AS rel, CAST(sum(b.score) AS DOUBLE) AS value FROM hit a JOIN hit b ON a.chrom = b.chrom AND b.center_pos BETWEEN a.center_pos - 50 AND a.center_pos + 50 GROUP BY ALL), w(anchor, partner) AS (VALUES ('purchase', 'click'), ('view', 'view')) SELECT w.anchor, w.partner, CAST(r AS BIGINT) AS rel, coalesce(s.value, 0) AS value FROM w, unnest(range(-50, 51)) AS u(r) LEFT JOIN s ON s.anchor = w.anchor AND s.partner = w.partner AND s.rel = r")
def pair_grid(spark, sf_dir):
    """The curves of named pairs, as a grid of plots shows them; unknown names are left out."""
    from .functions.attributes import plot_pairs

    p = P.pair_profile(event_hits(spark, sf_dir), 50)
    names = sorted({"purchase", "click", "view", "signup", "error"})
    at = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    c = P.to_curves(p.select(at[F.col("anchor_motif")].alias("anchor_motif"), at[F.col("motif_idx")].alias("motif_idx"), F.col("rel").cast("int").alias("rel"), "value"), 50, ["anchor_motif", "motif_idx"])
    return V.pair_curves(c, plot_pairs("purchase,click;view, view;nobody,view"), names, 50)


_SETS = f"""{HITS}, sets AS (SELECT DISTINCT motif_idx AS name, chrom, greatest(0, center_pos - 250) AS start, greatest(0, center_pos - 250) + 500 AS "end" FROM hit WHERE motif_idx IN ('purchase', 'signup', 'error') AND score > 10000),
i AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sets),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR start >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end") AS n FROM i),
loci AS (SELECT chrom, min(start) AS start, max("end") AS "end", list_sort(list(DISTINCT name)) AS members FROM g GROUP BY chrom, n),
nm AS (SELECT DISTINCT name FROM sets), df AS (SELECT a.name || '__minus__' || b.name AS subset_id, chrom, start, "end" FROM loci, nm a, nm b WHERE a.name != b.name AND list_contains(members, a.name) AND NOT list_contains(members, b.name))"""


def _peak_sets(spark, sf_dir):
    h = event_hits(spark, sf_dir).where("score > 10000")
    return {n: h.where(F.col("motif_idx") == n).select("chrom", F.col("center_pos").alias("start"), F.col("center_pos").alias("end")) for n in ("purchase", "signup", "error")}


@query(f'WITH {_SETS}, big AS (SELECT subset_id FROM df GROUP BY ALL HAVING count(*) > 60) SELECT * FROM df JOIN big USING (subset_id)')
def compare_peak_sets(spark, sf_dir):
    """Memberships A without B of named sets, sets of more than 60 loci."""
    return W.peak_set_memberships(_peak_sets(spark, sf_dir), 500, 60)[0]


@query(f'WITH {_SETS} SELECT subset_id, count(*) AS n_regions, CAST(sum("end" - start) AS BIGINT) AS n_bp FROM df GROUP BY ALL')
def peak_set_inventory(spark, sf_dir):
    """All differences counted, small ones too."""
    return W.peak_set_memberships(_peak_sets(spark, sf_dir), 500, 60)[1]


@query(f"""WITH {HITS}, z AS (SELECT DISTINCT subset_id, chrom, start, "end" FROM mem) SELECT subset_id, chrom, start, "end", CAST(row_number() OVER (ORDER BY subset_id, chrom, start, "end") AS BIGINT) AS line FROM z""")
def sorted_memberships(spark, sf_dir):
    """Memberships in the order in which they are written, numbered in the written file."""
    path = new_path(spark, "sorted")
    m = segment_memberships(spark, sf_dir).distinct().orderBy("subset_id", "chrom", "start", "end")
    sinks.write_table(m, path)
    rows = spark.read.option("sep", "\t").option("header", True).csv(path).withColumn("line", F.monotonically_increasing_id())
    first = rows.agg(F.min("line")).first()[0] or 0
    return rows.select("subset_id", "chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("line") - first + 1).alias("line"))
