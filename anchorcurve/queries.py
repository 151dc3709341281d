"""The engine's registered queries over the driver's tables, each with its SQL for DuckDB.

Events stand for hits (chromosome: user_id mod 10; place: seconds; motif: event_type; score: cents), documents for
sequences (all their letters a, c, g, t), customers' segments for subsets.  Scores and kernel weights are whole
numbers, so sums are exact in any order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.attributes import parse_attributes
from .model import MotifSet
from .operators import curves as V
from .operators import intervals as I
from .operators import joins as J
from .operators import profile as P
from .operators import scan as S
from .plans import resources as R

# Three small kernels over A, C, G, T: (motif, offset, base, weight), and their thresholds.
CELLS = [(0, 0, "A", 2), (0, 1, "C", 1), (0, 2, "T", 1), (0, 2, "G", -1), (1, 0, "T", 1), (1, 1, "A", 2), (1, 2, "A", 1), (2, 0, "G", 1), (2, 0, "C", -2), (2, 1, "G", 1), (2, 2, "C", 2)]
THRESHOLDS = [2.0, 2.0, 1.0]


def motifs() -> MotifSet:
    k = np.zeros((3, 3, 4), np.float32)
    for m, off, base, w in CELLS:
        k[m, off, "ACGT".index(base)] = w
    return MotifSet(["m0", "m1", "m2"], k, THRESHOLDS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds():
    return F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 10).cast("string").alias("chrom"), _seconds().alias("center_pos"), F.col("event_type").alias("motif_idx"), F.round(F.col("value") * 100).cast("long").alias("score"), "user_id")


def event_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_points(spark, sf_dir).where("score > 2000").drop("user_id")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_points(spark, sf_dir).where("motif_idx = 'purchase'").select("chrom", (F.col("center_pos") - 900).alias("start"), (F.col("center_pos") + 900).alias("end"), "user_id")


def segment_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("subset_id"))
    return purchases(spark, sf_dir).join(c, "user_id").select("subset_id", "chrom", "start", "end")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    seq = F.upper(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^acgt]", ""))
    return d.select(F.col("doc_id").alias("interval_id"), seq.alias("seq"))


def strands(spark: SparkSession, sf_dir: str, both: bool = True) -> DataFrame:
    return S.with_strands(sequences(spark, sf_dir), both)


def _whole(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


HITS = """h AS (SELECT CAST(user_id % 10 AS VARCHAR) AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS center_pos, event_type AS motif_idx, CAST(round(value * 100) AS BIGINT) AS score, user_id FROM events),
hit AS (SELECT * FROM h WHERE score > 2000),
reg AS (SELECT chrom, center_pos - 900 AS start, center_pos + 900 AS "end", user_id FROM h WHERE motif_idx = 'purchase'),
mem AS (SELECT c_mktsegment AS subset_id, chrom, start, "end" FROM reg JOIN customer ON c_custkey = user_id)"""
LETTERS = "SELECT doc_id, upper(regexp_replace(lower(coalesce(text, '')), '[^acgt]', '', 'g')) AS s FROM documents"


def scores_sql(source: str = LETTERS) -> str:
    """CTEs k, t, d, seq, pos, sc (scores) and hs (hits) of the sequences that source gives as doc_id, s."""
    return f"""k(motif_idx, off, base, w) AS (VALUES {", ".join(map(str, CELLS))}),
t(motif_idx, thr) AS (VALUES {", ".join(str((i, x)) for i, x in enumerate(THRESHOLDS))}),
d AS ({source}),
seq AS (SELECT doc_id AS interval_id, 0 AS strand, s FROM d UNION ALL SELECT doc_id, 1, translate(reverse(s), 'ACGT', 'TGCA') FROM d),
pos AS (SELECT interval_id, strand, length(s) - 2 AS n, p, s FROM seq, unnest(range(0, greatest(length(s) - 2, 0))) AS u(p)),
sc AS (SELECT interval_id, strand, n, motif_idx, p, greatest(0, sum(CASE WHEN substr(s, CAST(p + off + 1 AS INT), 1) = base THEN w ELSE 0 END)) AS score FROM pos, k GROUP BY ALL),
hs AS (SELECT sc.* FROM sc JOIN t USING (motif_idx) WHERE score > thr)"""


SCORES = scores_sql()
Q, O = {}, {}  # noqa: E741


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@query(f"WITH {HITS} SELECT a.motif_idx AS anchor_motif, b.motif_idx, b.center_pos - a.center_pos AS rel, CAST(sum(b.score) AS BIGINT) AS value, count(*) AS n_pairs FROM hit a JOIN hit b ON a.chrom = b.chrom AND b.center_pos BETWEEN a.center_pos - 300 AND a.center_pos + 300 GROUP BY ALL")
def pair_profile(spark, sf_dir):
    """Sparse all-to-all profile, half window 300."""
    return P.pair_profile(event_hits(spark, sf_dir), 300)


@query(f"WITH {HITS} SELECT a.motif_idx AS anchor_motif, b.motif_idx, b.center_pos - a.center_pos AS rel, CAST(sum(b.score) AS BIGINT) AS value, count(*) AS n_pairs FROM hit a JOIN hit b ON a.chrom = b.chrom AND b.center_pos BETWEEN a.center_pos - 600 AND a.center_pos + 600 WHERE a.motif_idx = 'purchase' GROUP BY ALL")
def one_to_all_profile(spark, sf_dir):
    """Sparse profile around one motif."""
    return P.pair_profile(event_hits(spark, sf_dir), 600, "purchase")


@query(f"WITH {HITS}, u AS (SELECT DISTINCT chrom, start, \"end\" FROM reg) SELECT u.chrom, u.start, u.\"end\", count(*) AS n_hits, CAST(sum(score) AS BIGINT) AS score FROM u JOIN hit ON hit.chrom = u.chrom AND center_pos >= start AND center_pos < \"end\" WHERE score >= 5000 GROUP BY ALL")
def hits_in_regions(spark, sf_dir):
    """Range query of hits by distinct regions, with an inclusive least score."""
    r = purchases(spark, sf_dir).select("chrom", "start", "end").distinct()
    j = J.points_in_intervals(event_hits(spark, sf_dir).where("score >= 5000"), r, "center_pos", 1800)
    return j.groupBy("chrom", "start", "end").agg(F.count("*").alias("n_hits"), F.sum("score").alias("score"))


_SUBSET = f"""WITH {HITS}, x AS (SELECT row_number() OVER () AS i, * FROM mem), p AS (
SELECT x.i, x.subset_id, hit.motif_idx, hit.center_pos, hit.score FROM x JOIN hit ON x.chrom = hit.chrom AND center_pos >= start AND center_pos < "end")
SELECT a.subset_id, a.motif_idx AS anchor_motif, b.motif_idx, b.center_pos - a.center_pos AS rel, CAST(sum(b.score) AS BIGINT) AS value
FROM p a JOIN p b ON a.i = b.i AND abs(b.center_pos - a.center_pos) <= 120 GROUP BY ALL"""


@query(_SUBSET)
def subset_profile(spark, sf_dir):
    """Profiles by subset over overlapping, repeated regions: each distinct region once, then by multiplicity."""
    return P.subset_profile(event_hits(spark, sf_dir), segment_memberships(spark, sf_dir), 120, bin_size=1800)


@query(_SUBSET)
def subset_profile_patterns(spark, sf_dir):
    """The same through membership patterns."""
    return P.subset_profile(event_hits(spark, sf_dir), segment_memberships(spark, sf_dir), 120, by_pattern=True, bin_size=1800)


@query(_SUBSET.replace("FROM mem)", "FROM (SELECT * FROM mem UNION ALL SELECT * FROM mem))").replace("GROUP BY ALL", "AND a.motif_idx = 'purchase' GROUP BY ALL"))
def subset_profile_dup(spark, sf_dir):
    """Every membership twice, one query motif."""
    m = segment_memberships(spark, sf_dir)
    return P.subset_profile(event_hits(spark, sf_dir), m.unionAll(m), 120, "purchase", bin_size=1800)


def _names(spark, sf_dir) -> list[str]:
    return sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())


def _islands(op: str, src: str) -> str:
    return f"""i AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {src}),
g AS (SELECT *, sum(CASE WHEN pe IS NULL OR start {op} pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end") AS n FROM i)"""


@query(f'WITH {HITS}, u AS (SELECT DISTINCT chrom, start, "end" FROM reg), {_islands(">", "u")} SELECT chrom, min(start) AS start, max("end") AS "end" FROM g GROUP BY chrom, n')
def merge_touching(spark, sf_dir):
    """Coverage of the regions."""
    return I.merge_touching(purchases(spark, sf_dir))


_WIN = f"""{HITS}, win AS (SELECT DISTINCT motif_idx AS name, chrom, greatest(0, center_pos - 200) AS start, greatest(0, center_pos - 200) + 400 AS "end" FROM hit WHERE score > 15000),
{_islands(">=", "win")}, loci AS (SELECT chrom, min(start) AS start, max("end") AS "end", list_sort(list(DISTINCT name)) AS members FROM g GROUP BY chrom, n)"""


def _loci(spark, sf_dir, above: int = 2000):
    """Of hits above ``above``; hits are those above 2000."""
    h = event_hits(spark, sf_dir).where(F.col("score") > above).select(F.col("motif_idx").alias("name"), "chrom", F.col("center_pos").alias("start"), F.col("center_pos").alias("end"))
    return I.union_loci(I.center_windows(h, 400).distinct())


@query(f"WITH {_WIN} SELECT chrom, start, \"end\", array_to_string(members, ',') AS members FROM loci")
def union_loci(spark, sf_dir):
    """Union loci of named, centred windows around strong hits (above 15000)."""
    return _loci(spark, sf_dir, 15000).withColumn("members", F.array_join("members", ","))


@query(f"WITH {_WIN}, n AS (SELECT DISTINCT name FROM win) SELECT a.name || '__minus__' || b.name AS subset_id, chrom, start, \"end\" FROM loci, n a, n b WHERE a.name != b.name AND list_contains(members, a.name) AND NOT list_contains(members, b.name)")
def set_difference(spark, sf_dir):
    """Loci of A without B, for all ordered pairs of sets, from strong hits (above 15000)."""
    return I.set_differences(_loci(spark, sf_dir, 15000), _names(spark, sf_dir))


_WIN_ALL = _WIN.replace(" WHERE score > 15000", "")


@query(f"WITH {_WIN_ALL} SELECT chrom, start, \"end\", array_to_string(members, ',') AS members FROM loci")
def union_loci_all(spark, sf_dir):
    """Union loci around all hits."""
    return _loci(spark, sf_dir).withColumn("members", F.array_join("members", ","))


@query(f"WITH {_WIN_ALL}, n AS (SELECT DISTINCT name FROM win) SELECT a.name || '__minus__' || b.name AS subset_id, chrom, start, \"end\" FROM loci, n a, n b WHERE a.name != b.name AND list_contains(members, a.name) AND NOT list_contains(members, b.name)")
def set_difference_all(spark, sf_dir):
    """Loci of A without B, for all ordered pairs of sets, from all hits."""
    return I.set_differences(_loci(spark, sf_dir), _names(spark, sf_dir))


@query(f"WITH {HITS}, s AS (SELECT chrom, max(center_pos) - min(center_pos) + 1 AS size FROM h GROUP BY chrom) SELECT chrom, CAST(start AS BIGINT) AS start, CAST(least(start + 3600, size) AS BIGINT) AS \"end\" FROM s, unnest(range(0, size, 3600)) AS u(start)")
def tiles(spark, sf_dir):
    """Tiles of each chromosome."""
    return I.tiles(event_points(spark, sf_dir).groupBy("chrom").agg((F.max("center_pos") - F.min("center_pos") + 1).alias("size")), 3600)


@query(f'WITH {HITS}, k AS (SELECT DISTINCT chrom, k FROM reg, unnest(range(CAST(floor(start / 500) AS BIGINT), CAST(floor(("end" - 1) / 500) AS BIGINT) + 1)) AS u(k)) SELECT chrom, k * 500 AS tile_start, (k + 1) * 500 AS tile_end, greatest(0, k * 500 - 30) AS scan_start, (k + 1) * 500 + 30 AS scan_end FROM k')
def covering_tiles(spark, sf_dir):
    """Flanked tiles that the regions touch."""
    return I.covering_tiles(purchases(spark, sf_dir), 500, 30)


@query(f'WITH {HITS} SELECT subset_id, chrom, greatest(0, CAST(floor((start + "end") / 2) AS BIGINT) - 250) AS start, greatest(0, CAST(floor((start + "end") / 2) AS BIGINT) - 250) + 501 AS "end", count(*) AS c FROM mem GROUP BY ALL')
def center_windows(spark, sf_dir):
    """Centred windows of odd width, counted."""
    return I.center_windows(segment_memberships(spark, sf_dir), 501).groupBy("subset_id", "chrom", "start", "end").agg(F.count("*").alias("c"))


@query("""SELECT source AS subset_id, lang AS chrom, CAST(n_chars - 500 AS BIGINT) AS start, CAST(n_chars AS BIGINT) AS "end", count(*) AS c FROM documents WHERE n_chars >= 500 GROUP BY ALL""")
def valid_memberships(spark, sf_dir):
    """Rows with a negative start, or text for a number, are left out."""
    d = table(spark, sf_dir, "documents").where("n_chars is not null").select(F.col("source").alias("subset"), F.col("lang").alias("Chromosome"), (F.col("n_chars") - 500).cast("string").alias("Start"), F.col("n_chars").cast("string").alias("End"))
    bad = d.select("subset", "Chromosome", "Start", F.lit("bad").alias("End"))
    return I.valid_memberships(d.unionAll(bad), "subset").groupBy("subset_id", "chrom", "start", "end").agg(F.count("*").alias("c"))


@query(f'WITH {HITS}, u AS (SELECT chrom, start, "end", count(*) AS c FROM mem GROUP BY ALL) SELECT CAST(sum(c) AS BIGINT) AS n_memberships, count(*) AS n_unique, CAST(sum(c * ("end" - start)) AS BIGINT) AS repeated_bp, CAST(sum("end" - start) AS BIGINT) AS unique_bp, (SELECT count(DISTINCT subset_id) FROM mem) AS n_subsets, CAST(sum(c) - count(*) AS BIGINT) AS n_reused, round(sum(c) / count(*), 6) AS reuse_factor, CAST((SELECT count(DISTINCT subset_id) FROM mem) * 4 * 25 * 241 AS BIGINT) AS result_bytes FROM u')
def resource_plan(spark, sf_dir):
    """Size of a subset run."""
    return R.resource_plan(segment_memberships(spark, sf_dir), 5, 120).withColumn("reuse_factor", F.round("reuse_factor", 6))


@query(f"WITH {SCORES} SELECT interval_id, CAST(strand AS INT) AS strand, CAST(motif_idx AS INT) AS motif_idx, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, CAST(max(score) AS BIGINT) AS best FROM sc GROUP BY ALL")
def scan_scores(spark, sf_dir):
    """Kernel scan by column expressions, both strands, summed by interval."""
    s = S.scan_columns(strands(spark, sf_dir), motifs()).groupBy("interval_id", "strand", "motif_idx")
    return s.agg(F.count("*").alias("n"), F.sum("score").cast("long").alias("total"), F.max("score").cast("long").alias("best"))


@query(f"WITH {SCORES} SELECT interval_id, CAST(strand AS INT) AS strand, CAST(motif_idx AS INT) AS motif_idx, count(*) AS n, CAST(sum(score) AS BIGINT) AS total, CAST(max(score) AS BIGINT) AS best FROM sc GROUP BY ALL")
def scan_scores_arrow(spark, sf_dir):
    """The same scan in NumPy, reduced where the sequences lie."""
    return _whole(S.scan_statistics(strands(spark, sf_dir), motifs()), "total", "best")


@query(f"WITH {SCORES} SELECT CAST(motif_idx AS INT) AS motif_idx, count(*) AS n_hits FROM hs GROUP BY ALL")
def hit_counts(spark, sf_dir):
    return S.scan_sums(strands(spark, sf_dir), motifs()).groupBy("motif_idx").agg(F.sum("n_hits").alias("n_hits"))


_POSITIONS = f"WITH {SCORES} SELECT interval_id, CAST(motif_idx AS INT) AS motif_idx, CAST(strand AS INT) AS strand, CAST(interval_id * 1000 + CASE WHEN strand = 0 THEN p ELSE n + 2 - p - 3 END AS BIGINT) AS start_pos, CAST(interval_id * 1000 + CASE WHEN strand = 0 THEN p + 1 ELSE n + 2 - 1 - p - 1 END AS BIGINT) AS center_pos, CAST(score AS BIGINT) AS score FROM hs"


@query(_POSITIONS + " WHERE score >= 4")
def hit_positions(spark, sf_dir):
    """Genomic coordinates of strong hits (score 4 or more) of both strands; an interval begins at 1000 times its number."""
    return _positions(spark, sf_dir, 4)


@query(_POSITIONS)
def hit_positions_all(spark, sf_dir):
    """The same of all hits above their motif's threshold."""
    return _positions(spark, sf_dir)


def _positions(spark, sf_dir, min_score: float | None = None):
    seqs = sequences(spark, sf_dir).select("interval_id", F.lit("c").alias("chrom"), (F.col("interval_id") * 1000).alias("start"), "seq")
    found = S.scan_hits(seqs, motifs())
    found = found if min_score is None else found.where(F.col("score") >= min_score)
    return _whole(found, "score").drop("chrom")


@query(_POSITIONS)
def hit_positions_joined(spark, sf_dir):
    """The same from score rows, joined with their intervals."""
    seqs = sequences(spark, sf_dir).select("interval_id", F.lit("c").alias("chrom"), (F.col("interval_id") * 1000).alias("start"), F.length("seq").alias("length"))
    return _whole(S.hit_positions(S.hits(S.scan_arrow(strands(spark, sf_dir), motifs(), 0.0), motifs()), seqs, motifs()), "score").drop("chrom")


_MAX = f"WITH {SCORES} SELECT interval_id, CAST(motif_idx AS INT) AS motif_idx, CAST(min(p) AS INT) AS rel_pos, CAST(any_value(best) AS BIGINT) AS score FROM (SELECT *, max(score) OVER (PARTITION BY interval_id, motif_idx) AS best FROM sc WHERE strand = 0) JOIN t USING (motif_idx) WHERE score = best AND best > thr GROUP BY interval_id, motif_idx"


@query(_MAX)
def max_hit_per_region(spark, sf_dir):
    return _whole(S.scan_max(strands(spark, sf_dir, False), motifs()), "score")


@query(f"WITH {SCORES} SELECT interval_id, CAST(motif_idx AS INT) AS motif_idx, CAST(-1 AS INT) AS rel_pos, CAST(sum(score) AS BIGINT) AS score FROM hs WHERE strand = 0 GROUP BY ALL")
def sum_hit_per_region(spark, sf_dir):
    rows = S.scan_sums(strands(spark, sf_dir, False), motifs()).where("score > 0")
    return _whole(rows.select("interval_id", "motif_idx", F.lit(-1).alias("rel_pos"), "score"), "score")


def _dense(where: str, w: int, dims: str) -> str:
    return f"WITH {SCORES}, nz AS (SELECT * FROM sc WHERE score != 0), a AS (SELECT a.*, r FROM hs a, unnest(range(-{w}, {w + 1})) AS u(r) WHERE a.n >= {2 * w + 1} AND a.p >= {w} AND a.p < a.n - {w} {where}) SELECT {dims}, CAST(r AS BIGINT) AS rel, CAST(sum(b.score) AS BIGINT) AS value FROM a JOIN nz b ON a.interval_id = b.interval_id AND a.strand = b.strand AND b.p = a.p + r GROUP BY ALL"


@query(_dense("AND a.motif_idx = 0", 20, "CAST(b.motif_idx AS BIGINT) AS motif_idx"))
def dense_one_to_all(spark, sf_dir):
    """Scores around one kernel's hits: NumPy scan and window sums in one narrow pass."""
    return _whole(P.dense_profile(strands(spark, sf_dir), motifs(), 20, 0).drop("anchor_motif"), "value")


@query(_dense("AND a.motif_idx = 0", 20, "CAST(b.motif_idx AS BIGINT) AS motif_idx"))
def dense_one_to_all_sql(spark, sf_dir):
    """The same in two steps: scores as rows, one a sequence, then the anchors of each row with its scores."""
    packed = S.scan_packed(strands(spark, sf_dir), motifs())
    return _whole(P.dense_profile(packed, motifs(), 20, 0).drop("anchor_motif"), "value")


@query(_dense("", 15, "CAST(a.motif_idx AS BIGINT) AS anchor_motif, CAST(b.motif_idx AS BIGINT) AS motif_idx"))
def dense_all_to_all(spark, sf_dir):
    return _whole(P.dense_profile(strands(spark, sf_dir), motifs(), 15), "value")


@query(f"WITH {SCORES} SELECT CAST(a.strand AS BIGINT) AS strand, CAST(a.motif_idx AS BIGINT) AS motif_idx, CAST(r AS BIGINT) AS rel, substr(seq.s, CAST(a.p + 1 + r + 1 AS INT), 1) AS base, count(*) AS value FROM hs a JOIN seq ON a.interval_id = seq.interval_id AND a.strand = seq.strand, unnest(range(-10, 11)) AS u(r) WHERE length(seq.s) >= 21 AND a.p + 1 >= 10 AND a.p + 1 < length(seq.s) - 10 GROUP BY ALL")
def base_composition(spark, sf_dir):
    """Bases around hits, strands apart."""
    return _whole(P.dense_profile(strands(spark, sf_dir), motifs(), 10, kind="base"), "value")


_SIGNAL = f"WITH {SCORES} SELECT CAST(a.strand AS BIGINT) AS strand, CAST(a.motif_idx AS BIGINT) AS motif_idx, CAST(r AS BIGINT) AS rel, CAST(c AS BIGINT) AS celltype, CAST(sum((a.p + 1 + r) * 7 % (11 + c) + c) AS BIGINT) AS value FROM hs a, unnest(range(0, NC)) AS v(c), unnest(range(-10, 11)) AS u(r) WHERE a.n + 2 >= 21 AND a.p + 1 >= 10 AND a.p + 1 < a.n + 2 - 10 GROUP BY ALL HAVING value != 0"


def _signal(spark, sf_dir, n):
    st = strands(spark, sf_dir)
    place = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)))
    track = lambda c: F.transform(F.slice(place, F.lit(1), F.length("seq")), lambda i: (i * 7 % (11 + c) + c).cast("double"))
    one = [track(c) for c in range(n)]
    return _whole(P.dense_profile(st.withColumn("signal", F.array(*one)), motifs(), 10, kind="signal"), "value")


@query(_SIGNAL.replace("NC", "1"))
def signal_profile(spark, sf_dir):
    """A made-up track, 7 times the place mod 11, around hits."""
    return _signal(spark, sf_dir, 1)


@query(_SIGNAL.replace("NC", "3"))
def signal_profile_2d(spark, sf_dir):
    """Three cell types at once."""
    return _signal(spark, sf_dir, 3)


@query(f"WITH {SCORES} SELECT CAST(b.motif_idx AS INT) AS motif_idx, CAST(sum(b.score) AS BIGINT) AS value FROM (SELECT hs.*, r FROM hs, unnest(range(-20, 21)) AS u(r) WHERE motif_idx = 0 AND n >= 41 AND p >= 20 AND p < n - 20) a JOIN sc b ON a.interval_id = b.interval_id AND a.strand = b.strand AND b.p = a.p + r GROUP BY ALL")
def window_sum_prefix(spark, sf_dir):
    """Whole-window sums by running sums inside the scan."""
    return _whole(P.window_totals(strands(spark, sf_dir), motifs(), 0, 20), "value")


@query(O["window_sum_prefix"])
def window_sum_joined(spark, sf_dir):
    """The same from score rows, one a sequence: running sums of each row, joined with the ends of its anchors' windows."""
    return _whole(P.window_totals(S.scan_packed(strands(spark, sf_dir), motifs()), motifs(), 0, 20), "value")


@query("SELECT source AS subset_id, lang AS chrom, count(*) AS n_regions, CAST(sum(n_chars) AS BIGINT) AS n_bp FROM documents GROUP BY ALL HAVING count(*) > 3")
def inventory(spark, sf_dir):
    """Groups of more than three regions."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("|", "source", "lang").alias("subset_id"), F.lit(0).alias("start"), F.col("n_chars").alias("end"))
    out = I.inventory(I.keep_larger(d, 3))
    return out.select(F.split("subset_id", "\\|")[0].alias("subset_id"), F.split("subset_id", "\\|")[1].alias("chrom"), "n_regions", "n_bp")


@query("SELECT page_id, lower(trim(regexp_extract(kv, '^([^=]*)=', 1))) AS k, trim(regexp_replace(kv, '^[^=]*=', '')) AS v FROM (SELECT page_id, 'Id=' || page_id || ' ' AS kv FROM pages UNION ALL SELECT page_id, ' Url Of=' || coalesce(url, '') FROM pages)")
def context_attributes(spark, sf_dir):
    """Encoded k=v attributes of pages as rows; of a repeated key the last value counts."""
    p = table(spark, sf_dir, "pages")
    enc = F.concat(F.lit("Id=x%20;id="), F.col("page_id").cast("string"), F.lit("%20<br> Url%20Of="), F.coalesce("url", F.lit("")), F.lit(";stray"))
    return p.select("page_id", F.explode(parse_attributes(enc)).alias("k", "v"))


def _curves(spark, sf_dir):
    s = P.subset_profile(event_hits(spark, sf_dir), segment_memberships(spark, sf_dir), 120, "purchase", bin_size=1800)
    return P.to_curves(s.withColumn("rel", F.col("rel").cast("int")), 120, ["subset_id", "motif_idx"])


_GRID = _SUBSET.replace("GROUP BY ALL", "AND a.motif_idx = 'purchase' GROUP BY ALL")
_CURVES = f"s AS ({_GRID}), grid AS (SELECT subset_id, motif_idx, CAST(r AS BIGINT) AS rel FROM (SELECT DISTINCT subset_id, motif_idx FROM s), unnest(range(-120, 121)) AS u(r)), cv AS (SELECT grid.*, CAST(coalesce(s.value, 0) AS DOUBLE) AS x FROM grid LEFT JOIN s USING (subset_id, motif_idx, rel)), cnt AS (WITH {HITS} SELECT subset_id, count(*) AS n_regions FROM mem GROUP BY ALL)"


@query(f"WITH {_CURVES}, n AS (SELECT * FROM cv), sm AS (SELECT c.subset_id, c.motif_idx, c.rel, sum(z.x) / 11 AS y FROM n c, unnest(range(-5, 6)) AS u(q), n z WHERE z.subset_id = c.subset_id AND z.motif_idx = c.motif_idx AND z.rel = least(120, greatest(-120, c.rel + q)) GROUP BY ALL) SELECT subset_id, motif_idx, rel, round(y, 4) AS y FROM sm")
def smooth_profile(spark, sf_dir):
    """Edge-padded moving averages of subset curves."""
    c = _curves(spark, sf_dir).withColumn("curve", V.smooth(F.col("curve"), 11))
    return c.select("subset_id", "motif_idx", F.posexplode("curve").alias("i", "y")).select("subset_id", "motif_idx", (F.col("i") - 120).cast("long").alias("rel"), F.round("y", 4).alias("y"))


@query(f"WITH {_CURVES}, m AS (SELECT subset_id, motif_idx, n_regions, median(x / n_regions) AS mid FROM cv JOIN cnt USING (subset_id) GROUP BY ALL), n AS (SELECT cv.subset_id, cv.motif_idx, rel, x / n_regions - mid AS x FROM cv JOIN m USING (subset_id, motif_idx)), sm AS (SELECT c.subset_id, c.motif_idx, c.rel, sum(z.x) / 11 AS y FROM n c, unnest(range(-5, 6)) AS u(q), n z WHERE z.subset_id = c.subset_id AND z.motif_idx = c.motif_idx AND z.rel = least(120, greatest(-120, c.rel + q)) GROUP BY ALL), a AS (SELECT subset_id, motif_idx, max(abs(y)) AS amp, sqrt(sum(y * y)) AS norm FROM sm GROUP BY ALL HAVING max(abs(y)) > 0), v AS (SELECT motif_idx, avg(v) AS var FROM (SELECT motif_idx, rel, var_pop(y / norm) AS v FROM sm JOIN a USING (subset_id, motif_idx) GROUP BY ALL) GROUP BY ALL), b AS (SELECT motif_idx, count(*) AS n_subsets, stddev_pop(ln(1 + amp)) AS spread FROM a GROUP BY ALL) SELECT motif_idx, n_subsets, round(CASE WHEN n_subsets >= 2 THEN var END, 8) AS shape_variance, round(CASE WHEN n_subsets >= 2 THEN spread ELSE 0 END, 8) AS amplitude_spread FROM v JOIN b USING (motif_idx)")
def context_ranking(spark, sf_dir):
    """How much each motif's curve differs between subsets."""
    n = segment_memberships(spark, sf_dir).groupBy("subset_id").agg(F.count("*").alias("n_regions"))
    r = V.rank_contexts(_curves(spark, sf_dir), n)
    return r.select("motif_idx", "n_subsets", F.round("shape_variance", 8).alias("shape_variance"), F.round("amplitude_spread", 8).alias("amplitude_spread"))


@query("WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)) SELECT a.vec_id, CAST(d AS INT) AS delay, round(corr(a.x, b.x), 6) AS r FROM e a, unnest(range(1, 6)) AS v(d), e b WHERE a.vec_id = b.vec_id AND b.i = a.i + d GROUP BY ALL")
def autocorrelation(spark, sf_dir):
    """Autocorrelation of the embeddings as tracks, delays 1 to 5."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("curve"))
    return V.autocorrelation(e, "vec_id", 6).select("vec_id", "delay", F.round("r", 6).alias("r"))


_DFT = """WITH e AS (SELECT vec_id, len(embedding) AS n, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, unnest(range(0, len(embedding))) AS u(i)),
f AS (SELECT vec_id, n, f, sqrt(power(sum(x * cos(2 * pi() * ((i * f) % n) / n)), 2) + power(sum(x * sin(2 * pi() * ((i * f) % n) / n)), 2)) AS m FROM e, unnest(range(1, (n + 1) // 2)) AS v(f) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY m DESC, f) AS k FROM f)
SELECT vec_id, CAST(f AS BIGINT) AS freq, round(n / f, 6) AS period, round(m, 5) AS magnitude FROM r WHERE k <= 5"""


@query(_DFT)
def power_spectrum(spark, sf_dir):
    """Five strongest frequencies of each embedding."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("curve"))
    return V.spectrum(e, "vec_id", 5).select("vec_id", "freq", F.round("period", 6).alias("period"), F.round("magnitude", 5).alias("magnitude"))


_BLOCKS = f"""WITH RECURSIVE {HITS}, u AS (SELECT DISTINCT chrom, start, "end" FROM reg),
v AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start, "end") AS i FROM u),
w AS (
  SELECT chrom, i, start AS s, "end" AS e, 1 AS block FROM v WHERE i = 1
  UNION ALL SELECT v.chrom, v.i, CASE WHEN v.start <= w.e + 300 AND greatest(w.e, v."end") - w.s <= 7200 THEN w.s ELSE v.start END,
    CASE WHEN v.start <= w.e + 300 AND greatest(w.e, v."end") - w.s <= 7200 THEN greatest(w.e, v."end") ELSE v."end" END,
    CASE WHEN v.start <= w.e + 300 AND greatest(w.e, v."end") - w.s <= 7200 THEN w.block ELSE w.block + 1 END
  FROM w JOIN v ON v.chrom = w.chrom AND v.i = w.i + 1)
SELECT chrom, min(s) AS start, max(e) AS "end", count(*) AS n_intervals FROM w GROUP BY chrom, block"""


@query(_BLOCKS)
def block_coalescing(spark, sf_dir):
    """Greedy blocks with a gap and a cap on their span."""
    return I.coalesce_blocks(purchases(spark, sf_dir), 300, max_span=7200, n_motifs=3, motif_length=3)
