"""Caches, composite runs, sources and the command line on small fixtures; all registered queries against DuckDB."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorcurve import cli
from anchorcurve.functions.motifs import resolve_target, thresholds_of
from anchorcurve.model import MotifSet
from anchorcurve.operators import curves as V
from anchorcurve.operators import intervals as I
from anchorcurve.operators import scan as S
from anchorcurve.plans import analysis as A
from anchorcurve.plans import resources as R
from anchorcurve.plans import workflows as W
from anchorcurve.sources import folders, readers, sinks, zarr

SF = "/root/testdata/sf0.001"
CHUNK = 50


def motifs():
    rng = np.random.default_rng(5)
    return MotifSet(["q.one", "q.two", "r"], rng.integers(-1, 3, (3, 4, 4)), [4.0, 4.0, 5.0])


def store(spark, n=5, size=333, seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        s = "".join(rng.choice(list("ACGT"), size + 17 * c))
        rows += [(f"chr{c}", k, s[k : k + CHUNK]) for k in range(0, len(s), CHUNK)]
    return spark.createDataFrame(rows, "chrom string, chunk_start long, seq string")


def whole(chunks):
    out = {}
    for r in sorted(chunks.collect()):
        out[r.chrom] = out.get(r.chrom, "") + r.seq
    return out


def brute_hits(seqs, m, both=True):
    out = set()
    comp = str.maketrans("ACGT", "TGCA")
    for chrom, s in seqs.items():
        for strand, t in enumerate((s, s[::-1].translate(comp)) if both else (s,)):
            x = S.scan(t, m.kernels)
            for k, p in zip(*np.nonzero(x > np.array(m.thresholds)[:, None])):
                off = m.center_offsets()[k]
                center = p + off if strand == 0 else len(s) - 1 - p - off
                out.add((chrom, int(center), int(k), strand, float(x[k, p])))
    return out


@pytest.mark.parametrize("tile", [7, 64, 1000])
def test_hit_cache(spark, tmp_path, tile):
    chunks, m = store(spark), motifs()
    cache = R.HitCache(str(tmp_path / "c"))
    cache.build(chunks, CHUNK, m, tile=tile, parts=3)
    rows = [(r.chrom, r.center_pos, r.motif_idx, r.strand, r.score) for r in cache.hits(spark).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_hits(whole(chunks), m)
    assert cache.mismatches(spark, R.HitCache.describe(m, tile, 0, True)) == []
    assert cache.mismatches(spark, {"tile": -1, "other": 0}) == ["other", "tile"]
    with pytest.raises(ValueError):
        cache.build(chunks, CHUNK, m)


def test_hit_cache_of_regions(spark, tmp_path):
    chunks, m = store(spark), motifs()
    regions = spark.createDataFrame([("chr0", -20, 40), ("chr0", 30, 90), ("chr1", 300, 9999), ("none", 0, 9)], "chrom string, start long, end long")
    cache = R.HitCache(str(tmp_path / "c"))
    cache.build(chunks, CHUNK, m, regions=regions, parts=2)
    got = {(r.chrom, r.center_pos, r.motif_idx, r.strand, r.score) for r in cache.hits(spark).collect()}
    assert got == {x for x in brute_hits(whole(chunks), m) if x[0] == "chr0" and x[1] < 90 or x[0] == "chr1" and x[1] >= 300}


def regions_of(spark):
    rows = [(i, f"chr{i % 5}", 13 * i, min(13 * i + 60 + i, 333)) for i in range(18)] + [(90, "chr0", 0, 20)]
    return spark.createDataFrame(rows, "interval_id long, chrom string, start long, end long")


@pytest.mark.parametrize("both", [True, False])
def test_anchor_caches_and_replay(spark, tmp_path, both):
    chunks, m, w = store(spark), motifs(), 9
    own = regions_of(spark)
    fetched = readers.fetch_sequences(chunks, own, CHUNK)
    members = own.select(F.concat(F.lit("s"), (F.col("interval_id") % 3).cast("string")).alias("subset_id"), "chrom", "start", "end")
    members = members.unionAll(members.where("subset_id = 's1'"))
    key = lambda d: sorted(map(tuple, d.collect()))
    exact, tiles = R.AnchorCache(str(tmp_path / "e")), R.AnchorCache(str(tmp_path / "t"))
    exact.build(fetched, m, 0, w, both)
    for tile, flank in ((20, 3), (100, 30)):
        tiles.build_from_tiles(chunks, CHUNK, own, m, 0, w, tile, flank, both)
        cols = ["chrom", "start", "end", "strand", "pos"]
        assert key(tiles.anchors(spark).select(cols)) == key(exact.anchors(spark).select(cols)) != []
    counts = {(r.chrom, r.start, r.end): r.n_anchors for r in tiles.counts(spark).collect()}
    assert len(counts) == 19 and counts["chr0", 0, 20] == 0 and sum(counts.values()) == exact.anchors(spark).count()
    want = key(W.full_curves(fetched, members, m, 0, w, both).select("subset_id", "motif_idx", "rel", "value"))
    for cache in (exact, tiles):
        assert cache.fits(spark, m, 0, w, both) and not cache.fits(spark, m, 1, w, both)
        assert key(cache.replay(fetched, members, m, 0, w, both).select("subset_id", "motif_idx", "rel", "value")) == want
    assert not R.AnchorCache(str(tmp_path / "none")).fits(spark, m, 0, w)
    with pytest.raises(ValueError, match="doesn't fit"):
        exact.replay(fetched, members, m, 1, w, both)
    with pytest.raises(ValueError, match="not in the cache"):
        exact.replay(fetched, members.withColumn("end", F.col("end") + 1), m, 0, w, both)
    with pytest.raises(ValueError):
        tiles.build_from_tiles(chunks, CHUNK, own, m, 0, w, 20, 2)


def test_blocks_score_as_intervals_do(spark):
    chunks, m = store(spark), motifs()
    own = regions_of(spark)
    direct = S.scan_arrow(S.with_strands(readers.fetch_sequences(chunks, own, CHUNK).select("interval_id", "seq")), m)
    key = lambda d: sorted(map(tuple, d.select("interval_id", "strand", "motif_idx", "p", "score").collect()))
    want = key(direct)
    for gap, span in ((0, None), (40, 120), (500, 150)):
        assert key(W.block_scores(chunks, CHUNK, own, m, gap, span)) == want


def test_signals_of_intervals(spark):
    sig = spark.createDataFrame([("c", 5, "a", 1.0), ("c", 5, "a", 2.0), ("c", 9, "b", 4.0), ("c", 30, "a", 7.0), ("d", 1, "a", 9.0)], "chrom string, pos long, celltype string, value double")
    iv = spark.createDataFrame([(1, "c", 4, 10, "x"), (2, "c", 9, 12, "y"), (3, "e", 0, 2, "z"), (4, "c", 7, 7, "empty")], "interval_id long, chrom string, start long, end long, seq string")
    got = {r.interval_id: r.signal for r in readers.fetch_signal(sig, iv, ["a", "b"], 4).collect()}
    assert got == {1: [[0, 3, 0, 0, 0, 0], [0, 0, 0, 0, 0, 4]], 2: [[0, 0, 0], [4, 0, 0]], 3: [[0, 0], [0, 0]]}
    assert [r.chrom for r in I.common_chromosomes(sig, iv).collect()] == ["c"]


def test_kinds_and_conflicts(spark, tmp_path):
    chunks, m = store(spark, 2), motifs()
    for bad in ({"kind": "x"}, {"kind": "target"}, {"kind": "pairs", "query": 0}, {"kind": "signal"}, {"kind": "sequence", "hit_cache": R.HitCache("x")}):
        with pytest.raises(ValueError):
            A.analyze(chunks, CHUNK, m, w=5, **bad)
    unknown = spark.createDataFrame([("zz", 0, 9)], "chrom string, start long, end long")
    with pytest.raises(ValueError):
        A.analyze(chunks, CHUNK, m, "hits", unknown, 5)
    out = str(tmp_path / "o")
    got = A.analyze(chunks, CHUNK, m, "pairs", w=5, segment=40, output=out)
    assert got.count() == spark.read.parquet(f"{out}/motif_cooccurrences").count() > 0
    meta = json.loads(spark.read.text(f"{out}/motif_cooccurrences_metadata").first().value)
    assert meta["complete"] and meta["n_motifs"] == 3 and meta["half_window"] == 5
    segs = readers.segments(chunks, 40).collect()
    assert len(segs) == len({r.interval_id for r in segs}) and all(len(r.seq) == 40 == r.end - r.start and r.start % CHUNK == 0 for r in segs)
    assert sinks.save_result(got, None, "pairs", m, {}) is None
    with pytest.raises(ValueError):
        sinks.result_name("target")


def test_thresholds_and_targets():
    keys = {"p0.001": [1, 2]}
    assert thresholds_of(2, "p0.001", 9.0, keys, [5, 6]) == [9.0, 9.0] and thresholds_of(2, "p0.001", None, keys, [5, 6]) == [1.0, 2.0]
    assert thresholds_of(2, "p0.5", None, keys, [5, 6]) == [5.0, 6.0] == thresholds_of(2, annotation=[5, 6])
    for bad in ({}, {"annotation": [1]}, {"key": "p0.5", "by_key": keys}):
        with pytest.raises(ValueError):
            thresholds_of(2, **bad)
    assert resolve_target(["a", "b"], "1") == 1 and resolve_target(["a", "b"], "b") == 1 and resolve_target(["a", "b"], "x", lambda t: 7) == 7


def test_islands_by_ranges(spark):
    """Ranges of a few starts against one window, for both rules and gaps."""
    rng = np.random.default_rng(3)
    rows = [(f"c{int(c)}", int(s), int(s + n)) for c, s, n in zip(rng.integers(0, 2, 200), rng.integers(0, 3000, 200), rng.integers(1, 60, 200))] + [("c0", 10, 2500)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long").distinct()

    def brute(joins, gap):
        out = {}
        for c in ("c0", "c1"):
            far, own = None, []
            for s, e in sorted({(s, e) for x, s, e in rows if x == c}):
                if far is None or (s > far + gap if joins else s >= far + gap):
                    own.append([s, e])
                    far = e
                far = max(far, e)
                own[-1][1] = far
            out[c] = own
        return out

    for joins, gap in ((True, 0), (False, 0), (True, 25)):
        for span in (1, 16, 1 << 20):
            got = I._islands(df, joins, gap, span).groupBy("chrom", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"))
            found = {c: sorted([r.s, r.e] for r in got.collect() if r.chrom == c) for c in ("c0", "c1")}
            assert found == brute(joins, gap), (joins, gap, span)


def test_zarr_stores(spark, tmp_path):
    chunks, path = store(spark, 3), str(tmp_path / "z")
    zarr.write_zarr2(chunks, path, CHUNK)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(zarr.read_zarr2(spark, path)) == key(chunks)
    assert key(zarr.read_zarr2(spark, path, ["chr1", "unknown"])) == key(chunks.where("chrom = 'chr1'"))
    with pytest.raises(ValueError):
        zarr.read_zarr2(spark, path, ["unknown"])
    (tmp_path / "z" / "chrs" / "chr0" / "1.0").unlink()
    assert {r.seq for r in zarr.read_zarr2(spark, path, ["chr0"]).collect() if r.chunk_start == CHUNK} == {"N" * CHUNK}
    # Numbered parts follow each other by number; a track of values.
    for k, x in ((2, [0.0, 1.5]), (10, [2.5]), (1, [3.0, 0.0, 4.0])):
        at = tmp_path / "s" / "chrs" / "c" / f"chunk_{k}"
        at.mkdir(parents=True)
        (at / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [len(x)], "chunks": [len(x)], "dtype": "<f4", "compressor": None, "fill_value": 0, "order": "C", "filters": None}))
        (at / "0").write_bytes(np.array(x, "<f4").tobytes())
    assert key(zarr.read_zarr2(spark, str(tmp_path / "s"), kind="signal")) == [("c", 0, 3.0), ("c", 2, 4.0), ("c", 4, 1.5), ("c", 5, 2.5)]
    t = np.arange(35, dtype=np.float32).reshape(5, 7)
    zarr.write_zarr3(spark, str(tmp_path / "t"), t, [2, 3])
    rows = zarr.read_zarr3(spark, str(tmp_path / "t")).collect()
    assert len(rows) == 35 and all(t[tuple(r["at"])] == r.value for r in rows)
    zarr.write_zarr3(spark, str(tmp_path / "n"), ["x", "ÿé", ""], [2])
    assert key(zarr.read_zarr3(spark, str(tmp_path / "n"))) == [([0], "x"), ([1], "ÿé"), ([2], "")]
    with pytest.raises(ValueError):
        zarr.unpacked(b"", "blosc")


def test_zarr_files_are_left_to_tasks(spark, tmp_path, monkeypatch):
    """Of a store of many chromosomes the driver writes one file and reads none; long arrays are read in parts."""
    chunks, path, put = store(spark, 40, 200), str(tmp_path / "z"), []
    longer = spark.createDataFrame([("long", 10 * k, "ACGTNacgtn"[: 10 if k < 149 else 3]) for k in range(150)], "chrom string, chunk_start long, seq string")
    monkeypatch.setattr(zarr, "_put", lambda spark, path, body: put.append(path))
    monkeypatch.setattr(zarr, "_small_files", None)
    zarr.write_zarr2(chunks, path, CHUNK)
    zarr.write_zarr2(longer, path + "2", 10)
    assert put == [f"{path}/.zgroup", f"{path}2/.zgroup"]
    assert sorted(zarr.read_zarr2(spark, path).collect()) == sorted(chunks.collect())
    assert sorted(map(tuple, zarr.read_zarr2(spark, path + "2").collect())) == sorted((c, k, s.upper()) for c, k, s in longer.collect())


def test_files_of_a_hit_cache_follow_its_letters(spark, tmp_path, monkeypatch):
    """More letters, more files: no task sorts a fixed share of all hits; their ranges don't meet."""
    from anchorcurve.operators import scan

    monkeypatch.setattr(scan, "FILE_LETTERS", 200)
    cache = R.HitCache(str(tmp_path / "h"))
    cache.build(store(spark), CHUNK, motifs(), tile=40, parts=2)
    rows = cache.hits(spark).withColumn("f", F.input_file_name()).groupBy("f").agg(F.min(F.struct("chrom", "center_pos")).alias("a"), F.max(F.struct("chrom", "center_pos")).alias("z")).orderBy("a").collect()
    assert len(rows) > 8 and all(tuple(x.z) < tuple(y.a) for x, y in zip(rows, rows[1:]))


def test_signals_are_laid_without_lookups(spark):
    """Tracks of wide intervals: values of one place are added, and no map is searched for each place."""
    iv = spark.createDataFrame([(1, "c", 5, 4005, "x"), (2, "c", 9000, 9003, "y"), (3, "d", 0, 2, "z")], "interval_id long, chrom string, start long, end long, note string")
    rows = [("c", p, ct, float(p % 7 + k)) for k, ct in enumerate(("a", "b")) for p in range(0, 4100, 2)] + [("c", 6, "a", 5.0), ("c", 6, "other", 1.0), ("c", 8, "b", None)]
    got = readers.fetch_signal(spark.createDataFrame(rows, "chrom string, pos long, celltype string, value double"), iv, ["b", "a"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "try_element_at" not in plan and "map_from_entries" not in plan
    got = {r.note: r.signal for r in got.collect()}
    want = {ct: [sum(v for c, p, t, v in rows if p == q and t == ct and v is not None) for q in range(5, 25)] for ct in "ab"}
    assert [s[:20] for s in got["x"]] == [want["b"], want["a"]] and [len(s) for s in got["x"]] == [4000, 4000]
    assert got["y"] == [[0.0] * 3] * 2 and got["z"] == [[0.0] * 2] * 2


def test_plot_frames(spark):
    c = spark.createDataFrame([(0, 1, [1.0, 2.0, 3.0]), (1, 1, [4.0, 5.0, 6.0])], "anchor_motif int, motif_idx int, curve array<double>")
    got = sorted(map(tuple, V.pair_curves(c, [("a", "b"), ("b", "z"), ("a", "a")], ["a", "b"], 1).collect()))
    assert got == [("a", "a", r, 0.0) for r in (-1, 0, 1)] + [("a", "b", -1, 1.0), ("a", "b", 0, 2.0), ("a", "b", 1, 3.0)]
    rows = spark.createDataFrame([("u", [1.0, 0.0]), ("v", [0.0, 5.0]), ("w", [0.1, 4.0]), ("x", [0.0, 0.0])], "k string, curve array<double>")
    assert [r.k for r in V.clustered(rows, "k").orderBy("place").collect()] == ["v", "w", "u", "x"]
    with pytest.raises(ValueError):
        V.clustered(rows, "k", 2)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Session.conf

    with pytest.raises(RuntimeError, match="checkpoint"):
        folders.shared_root(Session)
    t = folders.cut(spark.range(3).toDF("id"), "test")
    assert t.count() == 3
    folders.discard(t)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(t._anchorcurve_path)


def test_command_line(spark, tmp_path, capsys):
    m, chunks = motifs(), store(spark, 3)
    at = lambda n: str(tmp_path / n)
    chunks.write.parquet(at("seq"))
    readers.write_motifs(spark, m, at("motifs"))
    readers.save_motifs(m, at("motifs.json"))
    assert cli.main(["motif-info", at("motifs.json"), "--select", "q"]) == 0
    assert "q.two" in capsys.readouterr().out
    (tmp_path / "a.bed").write_text("chr0\t10\t110\nchr1\t200\t300\n")
    (tmp_path / "b.bed").write_text("chr0\t50\t150\nchr2\t20\t80\n")
    assert cli.main(["compare-peak-sets", f"a={at('a.bed')}", f"b={at('b.bed')}", "--window", "100", "--output", at("sets")]) == 0
    rows = readers.read_memberships(spark, at("sets/memberships")).collect()
    assert {(r.subset_id, r.chrom) for r in rows} == {("a__minus__b", "chr1"), ("b__minus__a", "chr2")}
    common = ["--sequences", at("seq"), "--chunk", str(CHUNK), "--motifs", at("motifs")]
    groups = ["profile-peak-groups", *common, "--memberships", at("sets/memberships"), "--query", "q.one", "--half-window", "6"]
    assert cli.main([*groups, "--output", at("p0"), "--plan-only"]) == 0 and not (tmp_path / "p0").exists()
    assert cli.main([*groups, "--output", at("p1")]) == 0
    for out in ("p2", "p3"):  # builds the cache, then finds it
        assert cli.main([*groups, "--output", at(out), "--anchor-cache", at("anchors")]) == 0
    key = lambda p: sorted(map(str, spark.read.parquet(f"{at(p)}/curves").collect()))
    assert key("p1") == key("p2") == key("p3") != []
    assert sinks.read_manifest(spark, at("p1/manifest"))["tables"]["curves"]["rows"] == len(key("p1"))
    (tmp_path / "n.tsv").write_text("subset_id\tn_regions\na__minus__b\t1\nb__minus__a\t1\n")
    assert cli.main(["rank-context-motifs", "--curves", at("p1/curves"), "--counts", at("n.tsv"), "--output", at("ranks"), "--smooth", "3", "--top", "2"]) == 0
    assert len(readers.read_memberships(spark, at("ranks")).collect()) <= 2
    (tmp_path / "c.bed").write_text("chr1\t100\t200\tID=SRX5;Name=x%20(@%20K562)\n")
    assert cli.main(["prepare-chip-atlas-groups", at("c.bed"), "--by", "srx", "--window", "50", "--output", at("ctx")]) == 0
    assert [tuple(r) for r in readers.read_memberships(spark, at("ctx")).collect()] == [("SRX5", "chr1", "125", "175")]
    assert cli.main(["build-hit-cache", *common, "--tile", "64", "--parts", "2", "--output", at("hits")]) == 0
    assert cli.main(["query-hits", at("hits"), "chr1:20-220", "--motifs", "0,2", "--min-score", "5", "--output", at("found")]) == 0
    got = {(r.chrom, int(r.center_pos), int(r.motif_idx), int(r.strand), float(r.score)) for r in readers.read_memberships(spark, at("found")).collect()}
    assert got == {x for x in brute_hits(whole(chunks), m) if x[0] == "chr1" and 20 <= x[1] < 220 and x[2] in (0, 2) and x[4] >= 5}
    assert cli.main(["scan", *common, "--kind", "target", "--query", "r", "--regions", at("a.bed"), "--half-window", "4", "--threshold", "3", "--output", at("scan")]) == 0
    assert spark.read.parquet(at("scan/target_r")).count() > 0
    for bad in ("chr1", "chr1:9-3", ":1-2"):
        with pytest.raises(ValueError):
            cli.region_of(bad)


def _names():
    from anchorcurve import queries, queries_io, queries_plans  # noqa: F401

    return sorted(queries.Q)


@pytest.fixture(scope="module")
def duck():
    import os

    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", _names())
def test_query_matches_duckdb(spark, duck, name):
    from anchorcurve import queries as Q

    plain = lambda v: round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v
    df, want = Q.Q[name](spark, SF), duck.sql(Q.O[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(str(tuple(map(plain, r))) for r in df.select(cols).collect()) == sorted(str(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
