"""Hand-computed cases of the profile engine, and equality of its different paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorcurve.functions.attributes import context_label, named_path, parse_attributes, plot_pairs, threshold_of
from anchorcurve.functions.motifs import resolve_motif, select_motifs
from anchorcurve.model import MotifSet
from anchorcurve.operators import curves as V
from anchorcurve.operators import intervals as I
from anchorcurve.operators import profile as P
from anchorcurve.operators import scan as S
from anchorcurve.plans import resources as R
from anchorcurve.plans import workflows as W
from anchorcurve.sources import readers, sinks


def scores(spark, *rows):
    return spark.createDataFrame([(0, 0, m, p, float(s)) for m, r in enumerate(rows) for p, s in enumerate(r)], "interval_id long, strand int, motif_idx int, p int, score double")


def dense(spark, rows, thresholds, w, query=None):
    s = scores(spark, *rows)
    hit = s.where(F.col("score") > F.element_at(F.array(*map(F.lit, thresholds)), F.col("motif_idx") + 1)).where(f"p >= {w} and p < {len(rows[0]) - w}")
    hit = hit if query is None else hit.where(F.col("motif_idx") == query)
    got = P.dense_profile_sql(s, hit.selectExpr("interval_id", "strand", "motif_idx anchor_motif", "p pos"), w)
    return {(r.anchor_motif, r.motif_idx, r.rel): r.value for r in got.collect()}


def test_dense_all_to_all(spark):
    got = dense(spark, [[0, 1, 0, 2, 0], [2, 0, 3, 0, 4]], [0.5, 1.5], 1)
    assert got == {(0, 0, 0): 3, (0, 1, -1): 5, (0, 1, 1): 7, (1, 0, -1): 1, (1, 0, 1): 2, (1, 1, 0): 3}


def test_threshold_is_strict_and_edges_are_out(spark):
    assert dense(spark, [[0.5, 1, 0, 0.5, 1]], [0.5], 1) == {(0, 0, -1): 0.5, (0, 0, 0): 1}


def hits(spark, rows):
    return spark.createDataFrame([("c", c, m, float(s)) for c, m, s in rows], "chrom string, center_pos long, motif_idx int, score double")


def test_sparse_profile_in_region(spark):
    h = hits(spark, [(10, 0, 1), (11, 1, 2), (12, 0, 3), (20, 1, 4)])
    region = spark.createDataFrame([("c", 9, 13)], "chrom string, start long, end long")
    got = {(r.anchor_motif, r.motif_idx, r.rel): r.value for r in P.region_contributions(h, region, 1).collect()}
    assert got == {(0, 0, 0): 4, (0, 1, -1): 2, (0, 1, 1): 2, (1, 0, -1): 1, (1, 0, 1): 3, (1, 1, 0): 2}


def test_subsets_count_duplicates_and_paths_agree(spark):
    rng = np.random.default_rng(3)
    h = hits(spark, [(int(p), int(m), int(s)) for p, m, s in zip(rng.integers(0, 300, 120), rng.integers(0, 3, 120), rng.integers(1, 9, 120))])
    rows = [("a", "c", 0, 100), ("a", "c", 50, 150), ("b", "c", 50, 150), ("b", "c", 50, 150), ("z", "c", 290, 299)]
    m = spark.createDataFrame(rows, "subset_id string, chrom string, start long, end long")
    key = lambda df: {(r.subset_id, r.anchor_motif, r.motif_idx, r.rel): r.value for r in df.collect()}
    got = key(P.subset_profile(h, m, 7, bin_size=40))
    assert got == key(P.subset_profile(h, m, 7, by_pattern=True, bin_size=64))
    want: dict = {}
    flat = [(r.center_pos, r.motif_idx, r.score) for r in h.collect()]
    for s, _, a, b in rows:
        own = [x for x in flat if a <= x[0] < b]
        for p, i, _ in own:
            for q, j, v in own:
                if abs(q - p) <= 7:
                    want[s, i, j, q - p] = want.get((s, i, j, q - p), 0) + v
    assert got == want
    plan = R.resource_plan(m, 2, 1).first()
    assert (plan.n_subsets, plan.n_memberships, plan.n_unique, plan.n_reused) == (3, 5, 3, 2)
    with pytest.raises(MemoryError):
        R.resource_plan(m, 2, 1, most_bytes=10)
    with pytest.raises(ValueError):
        P.fan_out(P.region_contributions(h.where("center_pos < 200"), m, 7), m, strict=True)


def test_pairs_are_made_once_however_many_regions_hold_them(spark):
    """Regions of all widths, beyond tiles too; what a region holds is never a row of its own."""
    rng = np.random.default_rng(8)
    places = np.r_[rng.integers(-50, 400, 150), 32768 + rng.integers(-60, 60, 60), 65536 + rng.integers(-9, 9, 8)]
    flat = [(int(p), str(rng.integers(0, 3)), int(rng.integers(-2, 9))) for p in places]
    h = spark.createDataFrame([("c", p, m, s) for p, m, s in flat], "chrom string, center_pos long, motif_idx string, score long")
    wide = [("all", "c", -100, 70000)] * 2 + [("tile", "c", 32760, 32780), ("none", "c", 500, 900), ("none", "d", 0, 90)]
    rows = wide + [(f"s{k % 3}", "c", int(a), int(a + rng.integers(1, 60))) for k, a in enumerate(rng.integers(-60, 400, 90))]
    m = spark.createDataFrame(rows, "subset_id string, chrom string, start long, end long")
    for w, query in ((12, None), (5, "1"), (0, None)):
        want: dict = {}
        for s, c, a, b in rows:
            own = [x for x in flat if c == "c" and a <= x[0] < b]
            for p, i, _ in own:
                for q, j, v in own:
                    if abs(q - p) <= w and query in (None, i):
                        want[s, i, j, q - p] = want.get((s, i, j, q - p), 0) + v
        got = P.subset_profile(h, m, w, query)
        assert {(r.subset_id, r.anchor_motif, r.motif_idx, r.rel): r.value for r in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan  # regions are not joined with hits


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_packed_scores_stay_in_their_rows(spark):
    """Window sums and profiles from score rows of whole sequences: as from a row for each place, but nothing is shuffled."""
    rng = np.random.default_rng(4)
    m = MotifSet(["a", "b"], rng.integers(-1, 3, (2, 3, 4)), [2.0, 3.0])
    seqs = spark.createDataFrame([(i, "".join(rng.choice(list("ACGTN"), n))) for i, n in enumerate([0, 2, 3, 40, 90, 7])], "interval_id long, seq string")
    st = S.with_strands(seqs)
    packed, scores = S.scan_packed(st, m), S.scan_arrow(st, m)
    n = seqs.select("interval_id", (F.length("seq") - 2).alias("n"))
    ends = S.anchors(scores, n, 1, 3.0, 4)
    got, own = P.window_totals(packed, m, 1, 4), P.dense_profile(packed, m, 4, 1)
    assert exchanges(got) == exchanges(own) == 1  # of partial sums
    assert {(r.motif_idx, r.value) for r in got.collect()} == {(r.motif_idx, r.value) for r in P.window_sums(scores, ends, 4).collect()}
    assert {(r.motif_idx, r.rel, r.value) for r in own.collect()} == {(r.motif_idx, r.rel, r.value) for r in P.dense_profile_sql(scores, ends, 4).collect()}


def test_interval_profiles_shuffle_no_scores(spark):
    """Profiles of intervals and of subsets, and scores by blocks, leave sequences and scores where they lie."""
    rng = np.random.default_rng(6)
    m = MotifSet(["a", "b"], rng.integers(-1, 3, (2, 3, 4)), [2.0, 3.0])
    own = spark.createDataFrame([(i, "c", i, i + n, "".join(rng.choice(list("ACGTN"), n))) for i, n in enumerate([0, 2, 9, 40, 90, 31])], "interval_id long, chrom string, start long, end long, seq string")
    mem = spark.createDataFrame([(s, "c", i, i + n) for s, i, n in [("x", 3, 40), ("x", 3, 40), ("x", 4, 90), ("y", 4, 90), ("y", 7, 9), (None, 5, 31)]], "subset_id string, chrom string, start long, end long")
    for q, both in ((None, True), (1, True), (0, False)):
        dims = ["motif_idx", "rel"] if q is not None else ["anchor_motif", "motif_idx", "rel"]
        want = P.dense_profile(S.with_strands(own.select("interval_id", "seq"), both), m, 4, q, per_interval=True)
        got = P.interval_profiles(own, m, 4, q, both)
        assert exchanges(got) == 0
        key = lambda df, *k: sorted((tuple(str(r[c]) for c in [*k, *dims]), r.value) for r in df.collect())
        assert key(got, "interval_id") == key(want, "interval_id")
        c = want.join(own.drop("seq"), "interval_id").select("chrom", "start", "end", *dims, "value")
        got = P.subset_curves(W.with_subsets(own, mem), m, 4, q, both)
        assert key(got, "subset_id") == key(P.fan_out(c, mem), "subset_id")


def test_peak_hits_are_stored_by_place(spark, tmp_path):
    """A hit in many peaks is one row of the store; what is read is as in a store by peak.  Numbers go on over ranges of ids."""
    rows = [(k << 18, "c" if k % 3 else "d", 10 * k, 10 * k + 100) for k in range(20)]
    peaks = spark.createDataFrame(rows, "peak_id long, chrom string, start long, end long")
    hits = spark.createDataFrame([(c, p, p % 3, p / 7) for c in "cd" for p in range(-5, 320, 3)], "chrom string, center_pos long, motif_idx int, score double")
    by_place, by_peak = str(tmp_path / "place"), str(tmp_path / "peak")
    inside = sinks.hits_of_peaks(hits, peaks, 25, 64)
    for batch in ("a", "a", "b"):
        sinks.append_place_hits(hits.where((F.col("motif_idx") == 0) == (batch == "a")), by_place, batch)
        sinks.append_peak_hits(inside.where((F.col("motif_idx") == 0) == (batch == "a")).select("peak_id", "motif_idx", "rel_pos", "score"), peaks, by_peak, batch)
    stored, old = spark.read.parquet(by_place), spark.read.parquet(by_peak)
    assert stored.count() == hits.count() < old.count()
    cols = ["peak_id", "chrom", "local_idx", "motif_idx", "rel_pos", "score"]
    got = sinks.hits_of_peaks(stored, sinks.numbered_peaks(peaks), 25)
    assert sorted(got.select(*cols).collect()) == sorted(old.select(*cols).collect())
    known = {r.peak_id: r.local_idx for r in got.collect()}
    for c in "cd":
        assert [known[i] for i, x, _, _ in rows if x == c] == list(range(sum(x == c for _, x, _, _ in rows)))
    args = (peaks, 25, "c", 50, 170, 9.0, [0, 1])
    assert sorted(sinks.absolute_hits_by_place(stored, *args).collect()) == sorted(sinks.absolute_hits(old, *args).collect())


def motif(text, threshold, rows=1):
    k = np.zeros((rows, len(text), 4), np.float32)
    for j, b in enumerate(text):
        k[:, j, "ACGT".index(b)] = 1
    return MotifSet([f"m{i}" for i in range(rows)], k, [threshold] * rows)


def test_scan_paths_agree_and_relu(spark):
    assert S.scan("ACGT", motif("AC", 0).kernels).tolist() == [[2, 0, 0]]
    assert not S.scan("ACGT", -motif("AC", 0).kernels).any()
    rng = np.random.default_rng(1)
    m = MotifSet(["a", "b"], rng.integers(-2, 3, (2, 4, 4)), [1.0, 2.0])
    seqs = spark.createDataFrame([(i, "".join(rng.choice(list("ACGTN"), int(n)))) for i, n in enumerate([0, 3, 4, 30, 77])], "interval_id long, seq string")
    st = S.with_strands(seqs)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(S.scan_columns(st, m)) == key(S.scan_arrow(st, m))
    full = {(r.anchor_motif, r.motif_idx, r.rel): r.value for r in P.dense_profile(st, m, 3).collect()}
    sc = S.scan_arrow(st, m)
    n = seqs.select("interval_id", (F.length("seq") - 3).alias("n"))
    for q in (0, 1):
        by_join = {(q, r.motif_idx, r.rel): r.value for r in P.dense_profile_sql(sc, S.anchors(sc, n, q, m.thresholds[q], 3), 3).collect()}
        assert by_join == {k: v for k, v in full.items() if k[0] == q}


@pytest.mark.parametrize(("seq", "both", "want"), [("AAAAACATCCCC", True, [(5, 6, 0, 1, 3)]), ("AATGCC", False, [(1, 2, 0, 0, 3)]), ("ATGCCATGCCATG", False, [(0, 1, 0, 0, 3), (5, 6, 0, 0, 3), (10, 11, 0, 0, 3)])])
def test_hit_coordinates(spark, seq, both, want):
    df = spark.createDataFrame([(1, "c", 0, seq)], "interval_id long, chrom string, start long, seq string")
    got = W.hits_of_intervals(df, motif("ATG", 2.5), both).select("start_pos", "center_pos", "motif_idx", "strand", "score")
    assert sorted(tuple(map(int, r)) for r in got.collect()) == want


def test_max_and_sum_hits(spark):
    rows = [(10, 0, [0, 2, 2]), (10, 1, [1, 0, 4]), (20, 0, [0.5, 0.5, 0.5]), (20, 1, [3, 1, 0])]
    s = spark.createDataFrame([(i, 0, m, p, float(v)) for i, m, r in rows for p, v in enumerate(r)], "interval_id long, strand int, motif_idx int, p int, score double")
    m = MotifSet(["a", "b"], np.zeros((2, 1, 4)), [1.0, 2.0])
    assert sorted(map(tuple, S.max_hits(s, m).collect())) == [(10, 0, 1, 2.0), (10, 1, 2, 4.0), (20, 1, 0, 3.0)]
    assert sorted(map(tuple, S.sum_hits(s, m).collect())) == [(10, 0, -1, 4.0), (10, 1, -1, 4.0), (20, 1, -1, 3.0)]


def test_signal_and_bases(spark):
    m = MotifSet(["m0", "m1"], np.array([[[1, 0, 0, 0]], [[0, 0, 1, 0]]]), [0.5, 0.5])
    st = spark.createDataFrame([(0, 0, "TAGAT", [[10.0, 20.0, 30.0, 40.0, 50.0]])], "interval_id long, strand int, seq string, signal array<array<double>>")
    got = {(r.motif_idx, r.rel): r.value for r in P.dense_profile(st, m, 1, kind="signal").collect()}
    assert got == {(0, -1): 40, (0, 0): 60, (0, 1): 80, (1, -1): 20, (1, 0): 30, (1, 1): 40}
    got = {(r.motif_idx, r.rel, r.base): r.value for r in P.dense_profile(st, m, 1, kind="base").collect()}
    assert got == {(0, -1, "T"): 1, (0, -1, "G"): 1, (0, 0, "A"): 2, (0, 1, "G"): 1, (0, 1, "T"): 1, (1, -1, "A"): 1, (1, 0, "G"): 1, (1, 1, "A"): 1}


def intervals(spark, *rows):
    return spark.createDataFrame([("chr1", a, b) for a, b in rows], "chrom string, start long, end long")


def test_interval_algebra(spark):
    key = lambda df: sorted((r.start, r.end) for r in df.collect())
    assert key(I.merge_touching(intervals(spark, (0, 5), (5, 9), (12, 13)))) == [(0, 9), (12, 13)]
    sets = {"first": intervals(spark, (100, 200)), "second": intervals(spark, (150, 250)), "third": intervals(spark, (200, 300))}
    members, _, loci = W.peak_set_memberships(sets, 100)
    assert [(r.start, r.end, r.members) for r in loci.collect()] == [(100, 300, ["first", "second", "third"])]
    assert members.isEmpty()
    two = {"a": intervals(spark, (100, 200), (500, 600)), "b": intervals(spark, (150, 250), (900, 1000))}
    assert sorted((r.subset_id, r.start) for r in W.peak_set_memberships(two, 100)[0].collect()) == [("a__minus__b", 500), ("b__minus__a", 900)]
    with pytest.raises(ValueError):
        I.center_windows(two["a"], 0)
    with pytest.raises(ValueError):
        W.peak_set_memberships(two, 100, -1)
    sizes = spark.createDataFrame([("c", 25), ("d", 0)], "chrom string, size long")
    assert key(I.tiles(sizes, 10)) == [(0, 10), (10, 20), (20, 25)]


def test_memberships_and_blocks(spark):
    df = spark.createDataFrame([("s", "c", *x) for x in [("10", "10"), ("20", "19"), ("-1", "5"), ("bad", "30"), ("nan", "3"), ("1.9", "7")]], "subset_id string, Chromosome string, Start string, End string")
    assert [tuple(r) for r in I.valid_memberships(df).collect()] == [("s", "c", 1, 7)]
    three = intervals(spark, (1, 5), (7, 10), (11, 14))
    assert [(r.start, r.end, r.n_intervals) for r in I.coalesce_blocks(three, 3, n_motifs=2, max_bytes=208).collect()] == [(1, 14, 3)]
    assert len(I.coalesce_blocks(three, 3, n_motifs=2, max_bytes=80).collect()) == 3
    with pytest.raises(Exception, match="max_bytes"):
        I.coalesce_blocks(three, 3, n_motifs=2, max_bytes=63).collect()


def test_motif_selection():
    names = ["GATA1.x.1", "GATA1_alt.x.2", "SOX2.y.1", "SOX2.y.2", "MAX.z.1", "CMAX.z.1"]
    assert select_motifs(names, "4,1-2,MAX.z.1,SOX2") == [4, 1, 2, 3]
    assert select_motifs(names, "gata1_A, 5 ,") == [1, 5] and select_motifs(names, "GATA1") == [0, 1]
    assert resolve_motif(names, "cmax") == 5 and resolve_motif(names, "MAX") == 4 and resolve_motif(names, "3") == 3
    for bad in ("2-1", "6", "4-6", "PAX6", "", " , "):
        with pytest.raises(ValueError):
            select_motifs(names, bad)
    for bad in ("SOX2", "6", "PAX6"):
        with pytest.raises(ValueError):
            resolve_motif(names, bad)
    k = np.zeros((1, 7, 4))
    k[0, 2:5, 0] = 1
    assert MotifSet(["m"], k, [0]).center_offsets() == [3]
    assert MotifSet(["m"], np.zeros((1, 7, 4)), [0]).center_offsets() == [3]


def test_contexts(spark, tmp_path):
    enc = ["ID=SRX1;Name=TP53%20(@%20A2780);Title=nutlin", "ID=SRX2;Name=TP53%20(@ SJSA-1);t=Nutlin%3Cbr%3Ecell%20line=x", "ID=SRX3;Name=none;t=other"]
    (tmp_path / "x.bed").write_text("track x\n" + "".join(f"chr1\t{100 + 200 * i}\t{200 + 200 * i}\t{e}\n" for i, e in enumerate(enc)))
    rows = readers.read_chip_atlas(spark, str(tmp_path / "x.bed"))
    got = W.context_memberships(rows, "celltype", 200, "nutlin")
    assert [tuple(r) for r in got.collect()] == [("A2780", "chr1", 50, 250), ("SJSA-1", "chr1", 250, 450)]
    a = spark.createDataFrame([("k=1;K=2;id=50%;x=a+b",)], "t string").select(parse_attributes(F.col("t")).alias("m"))
    assert a.first().m == {"k": "2", "id": "50%", "x": "a+b"}
    assert a.select(context_label(F.col("m"), "attribute:X").alias("l")).first().l == "a+b"
    with pytest.raises(ValueError):
        context_label(F.col("m"), "other")
    assert named_path("a=b=c") == ("a", "b=c") and plot_pairs("a,b;c;d,e") == [("a", "b"), ("d", "e")] and threshold_of("p0.001") == 0.001


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "p.bed").write_text("# x\nchr1\t100\t301\tn\nchr1\t5\t5\tn\n")
    r = readers.read_narrowpeak(spark, str(tmp_path / "p.bed")).first()
    assert (r.start, r.end, r.length, r.center) == (-799, 1200, 201, 200.5)
    assert readers.read_bed(spark, str(tmp_path / "p.bed")).count() == 1
    chunks = spark.createDataFrame([("c", 0, "ACGTA"), ("c", 5, "CCATG"), ("c", 10, "TT")], "chrom string, chunk_start long, seq string")
    regions = spark.createDataFrame([(1, "c", 3, 11), (2, "c", 11, 40), (3, "d", 0, 5)], "interval_id long, chrom string, start long, end long")
    assert {r.interval_id: r.seq for r in readers.fetch_sequences(chunks, regions, 5).collect()} == {1: "TACCATGT", 2: "T"}
    assert sinks.checksum(chunks) == sinks.checksum(chunks.orderBy(F.desc("seq"))) and sinks.checksum(chunks, "none") is None
    m = motif("AC", 1.0, 2)
    readers.save_motifs(m, str(tmp_path / "m.json"))
    assert readers.load_motifs(str(tmp_path / "m.json"), "m1").names == ["m1"]
    cache = R.ContributionCache(str(tmp_path / "cache"))
    c = spark.createDataFrame([("c", 0, 5, 0, 1, 2.0)], "chrom string, start long, end long, motif_idx int, rel int, value double")
    cache.build(c, {"w": 3})
    members = spark.createDataFrame([("s", "c", 0, 5), ("s", "c", 0, 5), ("t", "c", 9, 12)], "subset_id string, chrom string, start long, end long")
    assert [tuple(r) for r in cache.replay(members, {"w": 3}).collect()] == [("s", 0, 1, 4.0)]
    assert cache.mismatches(spark, {"w": 4, "x": 1}) == ["w", "x"]
    with pytest.raises(ValueError):
        cache.replay(members, missing_are_zero=False)


def test_full_curves_and_stream(spark, tmp_path):
    rng = np.random.default_rng(5)
    m = MotifSet(["q", "r"], rng.integers(-1, 3, (2, 3, 4)), [3.0, 2.0])
    seqs = [(i, "c", 100 * i, 100 * i + 60, "".join(rng.choice(list("ACGT"), 60))) for i in range(4)]
    df = spark.createDataFrame(seqs, "interval_id long, chrom string, start long, end long, seq string")
    members = spark.createDataFrame([("a", "c", 0, 60), ("a", "c", 0, 60), ("b", "c", 0, 60), ("b", "c", 200, 260)], "subset_id string, chrom string, start long, end long")
    key = lambda d: {(r.subset_id, r.motif_idx, r.rel): r.value for r in d.collect() if r.value}
    got = key(W.full_curves(df, members, m, 0, 4))
    assert got and got == key(W.full_curves(df, members, m, 0, 4, by_pattern=True))
    per = {r.interval_id: 0 for r in df.collect()}
    want: dict = {}
    for r in P.dense_profile(S.with_strands(df.select("interval_id", "seq")), m, 4, 0, per_interval=True).collect():
        for s, i, n in (("a", 0, 2), ("b", 0, 1), ("b", 2, 1)):
            if r.interval_id == i:
                want[s, r.motif_idx, r.rel] = want.get((s, r.motif_idx, r.rel), 0) + n * r.value
    assert per and got == want
    from anchorcurve.streaming.micro_batches import append_hits

    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    append_hits(stream, m, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    names = ["chrom", "start_pos", "strand", "motif_idx"]
    key = lambda d: sorted(map(tuple, d.select(*names).collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(W.hits_of_intervals(df, m))


def test_curves(spark):
    assert V.smooth_array(np.array([0.0, 3, 0, 0]), 3).tolist() == [1, 1, 1, 0]
    with pytest.raises(ValueError):
        V.smooth_array(np.zeros(3), 2)
    x = np.sin(np.arange(32) * 2 * np.pi / 8)
    c = spark.createDataFrame([(1, x.tolist())], "id int, curve array<double>")
    assert V.spectrum(c, "id", 1).first().period == 8
    got = {r.delay: r.r for r in V.autocorrelation(c, "id", 9).collect()}
    assert got[8] == pytest.approx(1) and got[4] == pytest.approx(-1)
    curves = spark.createDataFrame([("a", 0, [0.0, 9.0, 0.0]), ("b", 0, [9.0, 0.0, 0.0]), ("a", 1, [0.0, 9.0, 0.0]), ("b", 1, [0.0, 9.0, 0.0])], "subset_id string, motif_idx int, curve array<double>")
    n = spark.createDataFrame([("a", 1), ("b", 1)], "subset_id string, n_regions long")
    ranked = V.rank_contexts(curves, n, size=1)
    assert [r.motif_idx for r in V.top_contexts(ranked, 2).collect()] == [0, 1]
    assert {r.motif_idx: r.shape_variance > 0 for r in ranked.collect()} == {0: True, 1: False}
    with pytest.raises(ValueError):
        V.rank_contexts(curves, n.where("subset_id = 'a'"))


def test_registered_queries_match_duckdb(spark):
    import duckdb

    from anchorcurve import queries as Q

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "documents", "customer", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("pair_profile", "subset_profile", "union_loci", "dense_one_to_all", "context_ranking"):
        df, want = Q.Q[name](spark, sf), con.sql(Q.O[name])
        cols = sorted(df.columns)
        assert cols == sorted(want.columns)
        order = [want.columns.index(c) for c in cols]
        assert sorted(str(tuple(r)) for r in df.select(cols).collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall()), name


def test_sequence_queries_scan_whole_texts(spark, tmp_path):
    """All 13 against their SQL, and counts of places by hand."""
    import duckdb

    from anchorcurve import queries as Q

    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("acgtACGT xyz.\n"), n)) for n in (2500, 900, 40, 1)] + [None, "", "x" * 700 + "tactaggc" * 12]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    lengths = [sum(c in "acgt" for c in (t or "").lower()) for t in texts]
    assert lengths[0] > 1200
    got = {(r.interval_id, r.strand, r.motif_idx): r.n for r in Q.Q["scan_scores"](spark, str(tmp_path)).collect()}
    assert got == {(i, s, m): n - 2 for i, n in enumerate(lengths) if n >= 3 for s in (0, 1) for m in range(3)}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = "scan_scores scan_scores_arrow hit_counts hit_positions max_hit_per_region sum_hit_per_region dense_one_to_all dense_one_to_all_sql dense_all_to_all base_composition signal_profile signal_profile_2d window_sum_prefix".split()
    for name in names:
        df, want = Q.Q[name](spark, str(tmp_path)), con.sql(Q.O[name])
        cols = sorted(df.columns)
        order = [want.columns.index(c) for c in cols]
        rows = sorted(str(tuple(r)) for r in df.select(cols).collect())
        assert rows and rows == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall()), name


def test_queries_of_all_hits(spark, tmp_path):
    """The _all queries against their SQL; the strong ones are part of them."""
    import duckdb

    from anchorcurve import queries as Q

    rng = np.random.default_rng(8)
    sf = str(tmp_path)
    spark.createDataFrame([(i, "".join(rng.choice(list("acgt "), 700))) for i in range(3)], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    at = np.sort(rng.integers(0, 60_000, 80)).tolist()
    events = [(int(u), "abc"[int(k)], int(t), float(v)) for u, k, t, v in zip(rng.integers(0, 4, 80), rng.integers(0, 3, 80), at, rng.integers(1, 300, 80))]
    df = spark.createDataFrame(events, "user_id long, event_type string, t long, value double")
    df.select("user_id", "event_type", F.expr("cast(timestamp_seconds(t) as timestamp_ntz)").alias("ts"), "value").write.parquet(f"{sf}/events.parquet")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    con.sql("create table customer (c_custkey bigint, c_mktsegment varchar)")
    out = {}
    for name in ("hit_positions", "union_loci", "set_difference"):
        got = Q.Q[f"{name}_all"](spark, sf)
        want = con.sql(Q.O[f"{name}_all"])
        cols = sorted(got.columns)
        order = [want.columns.index(c) for c in cols]
        out[name] = sorted(str(tuple(r)) for r in got.select(cols).collect())
        assert out[name] and out[name] == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall()), name
    hits, strong = Q.Q["hit_positions_all"](spark, sf), Q.Q["hit_positions"](spark, sf)
    assert {r.score for r in hits.select("score").distinct().collect()} == {2, 3, 4}
    assert strong.count() and not strong.exceptAll(hits).count() and not hits.where("score >= 4").exceptAll(strong).count()


def test_long_kernels_and_batches(spark):
    """Kernels beyond the lookup table, several pieces of a batch, letters beyond ASCII, against one place at a time."""
    from anchorcurve.operators import arrays as A

    rng = np.random.default_rng(11)
    kernels = rng.integers(-2, 3, (3, 9, 4)).astype(np.float32)
    import pyarrow as pa

    seqs = ["".join(rng.choice(list("ACGTN"), int(n))) for n in (0, 8, 9, 40, 200, 3)] + [None, "ACGéACGTACGTAC", "acgtacgtacg"]
    want = {}
    for i, s in enumerate(seqs):
        codes = ["ACGT".find(c.upper()) for c in s or ""]
        for p in range(len(codes) - 8):
            want[i, p] = [max(0.0, float(sum(k[j][codes[p + j]] for j in range(9) if codes[p + j] >= 0))) for k in kernels]
    for cells in (1, 100, 10**6):
        got = {}
        for f in A.scanned(pa.array(seqs), kernels, cells):
            for x in range(len(f.p)):
                got[int(f.row[x]) + f.first, int(f.p[x])] = f.scores[:, x].tolist()
        assert got == want
    m = MotifSet(["a", "b", "c"], kernels, [3.0, 4.0, 2.0])
    st = S.with_strands(spark.createDataFrame([(i, s) for i, s in enumerate(seqs) if s], "interval_id long, seq string"))
    every = S.scan_arrow(st, m)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(S.scan_max(st, m)) == key(S.max_hits(every, m))
    assert key(S.scan_sums(st, m).where("score > 0").select("interval_id", "motif_idx", F.lit(-1), "score")) == key(S.sum_hits(every, m))
    stats = every.groupBy("interval_id", "strand", "motif_idx").agg(F.count("*"), F.sum("score"), F.max("score"))
    assert key(S.scan_statistics(st, m)) == key(stats)
    levels = {(r.motif_idx, r.level): r.n for r in S.scan_sums(st, m, {"low": [1.0] * 3, "high": [5.0] * 3}).groupBy("motif_idx", "level").agg(F.sum("n_hits").alias("n")).collect()}
    assert levels == {(r.motif_idx, k): r.n for k, t in (("low", 1), ("high", 5)) for r in every.where(F.col("score") > t).groupBy("motif_idx").agg(F.count("*").alias("n")).collect()}
