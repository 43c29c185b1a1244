"""Properties of the catalogue operators: null rules, positions, components, round trips."""

import random

from pyspark.sql import functions as F

from needledrop.operators import dedupe, evaluate, filters, membership, naming, sync
from needledrop.operators.components import connected_components


def test_null_listing_is_no_evidence(spark):
    tracks = spark.createDataFrame([("/a",), ("/b",)], "path string")
    assert {r["status"] for r in sync.diff_files(None, tracks).collect()} == {"kept"}
    assert {r["status"] for r in sync.diff_files(tracks.limit(0), tracks).collect()} == {"removed"}


def test_prune_needs_a_full_sweep(spark):
    tracks = spark.createDataFrame([("/a/1", "/a"), ("/b/1", "/b")], "path string, library_dir string")
    none = tracks.select("path").limit(0)
    assert sync.prune(tracks, none, "/a", full_sweep=False).count() == 2
    assert [r["path"] for r in sync.prune(tracks, none, "/a", full_sweep=True).collect()] == ["/b/1"]


def test_inside_respects_boundaries(spark):
    df = spark.createDataFrame([("/lib-old/x",), ("/lib/x",)], "path string")
    assert [r["path"] for r in df.filter(sync.inside("/lib", F.col("path"))).collect()] == ["/lib/x"]


def test_ranges_reject_null(spark):
    df = spark.createDataFrame([(None, "1998"), (120.0, None), (120.0, "1998")], "bpm double, year string")
    assert df.filter(filters.TrackFilter(bpm=(120, 120), year=(1998, None)).column()).count() == 1
    assert df.filter(filters.TrackFilter().column()).count() == 3


def test_patch_confidence_follows_tempo(spark):
    tracks = spark.createDataFrame([("/a", 100.0, 0.5, 1)], "path string, bpm double, bpm_confidence double, key_pc int")
    patches = spark.createDataFrame([(1, "/a", 120.0, None, None, False), (2, "/a", None, None, 7, True), (3, "/none", 1.0, 1.0, 1, False)], "seq long, path string, bpm double, bpm_confidence double, key_pc int, waveform boolean")
    assert [tuple(r) for r in sync.apply_patches(tracks, sync.coalesce_patches(patches)).collect()] == [("/a", 120.0, None, 7)]


def test_moves_keep_positions_dense(spark):
    rng = random.Random(3)
    items = [(1, f"p{i}", i) for i in range(30)]
    df = spark.createDataFrame(items, "playlist_id long, path string, position long")
    for anchor in ("p5", None, "p12", "missing"):
        block = [f"p{i}" for i in sorted(rng.sample(range(10, 20), 4))]
        moves = spark.createDataFrame([(1, block, anchor)], "playlist_id long, block array<string>, anchor string")
        got = sorted((r["position"], r["path"]) for r in membership.move_block(df, moves).collect())
        names = [f"p{i}" for i in range(30)]
        if anchor != "missing" and anchor not in block:
            rest = [n for n in names if n not in block]
            at = len(rest) if anchor is None else rest.index(anchor)
            names = rest[:at] + block + rest[at:]
        assert got == list(enumerate(names))


def test_components_do_not_depend_on_edge_order(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40) if i % 10] + [(100, 5), (7, 7), (None, 3)]
    want = None
    for _ in range(2):
        rng.shuffle(edges)
        flipped = [e[::-1] if rng.random() < 0.5 else e for e in edges]
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(flipped, "a long, b long")).collect()}
        assert want is None or got == want
        want = got
    assert want[10] == 1 and want[100] == 1 and want[20] == 11 and want[7] == 1
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_metadata_tier_lengths(spark):
    rows = [("/a", "T", "A", None, "X", 405.0), ("/b", "T", "A", None, "X", 405.0), ("/c", "T", "A", None, "X", 460.0)]
    df = spark.createDataFrame(rows, "path string, title string, artist string, album_artist string, album string, duration_secs double")
    assert [tuple(r) for r in dedupe.metadata_edges(dedupe.candidates(df)).collect()] == [("/a", "/b")]


def test_free_names_avoid_what_is_there(spark):
    wanted = spark.createDataFrame([(f"/in/{i}", "/d", "x", "wav") for i in range(3)], "path string, dir string, stem string, ext string")
    there = spark.createDataFrame([("/d/x.wav",), ("/d/x (4).wav",)], "path string")
    got = [r["target"] for r in naming.free_names(wanted, there).collect()]
    assert len(set(got)) == 3 and not {"/d/x.wav", "/d/x (4).wav"} & set(got)


def test_tempo_verdicts(spark):
    rows = [(128.0, 128.4, "exact"), (128.0, 129.5, "close"), (128.0, 64.0, "octave"), (128.0, 100.0, "wrong"), (128.0, None, "none"), (120.0, 90.0, "octave")]
    df = spark.createDataFrame(rows, "ref double, got double, want string")
    assert all(r["v"] == r["want"] for r in df.select("want", evaluate.tempo_verdict(F.col("got"), F.col("ref")).alias("v")).collect())


def test_entry_imports_without_corpus_operators(spark):
    import __spark_entry__

    assert "r5_group_summary" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_free_names_one_after_the_other(spark):
    """As a folder fills: each row in path order takes the first name that is not there yet."""
    rng = random.Random(8)
    wanted = [(f"/p{i:03d}", f"/d{rng.randrange(2)}", rng.choice(["a", "a", "b", "a (2)", "c (3) x"]), "wav") for i in range(60)]
    there = {"/d0/a.wav", "/d0/a (3).wav", "/d1/a (2).wav", "/d1/b.wav", "/d1/b (5).wav", "/d0/a (2) (2).wav"}
    df = spark.createDataFrame(wanted, "path string, dir string, stem string, ext string")
    got = {r["path"]: r["target"] for r in naming.free_names(df, spark.createDataFrame([(t,) for t in there], "path string")).collect()}
    assert len(got) == 60 and len(set(got.values())) == 60 and not set(got.values()) & there
    held = set(there)
    for path, folder, stem, _ in wanted:
        if stem in ("b", "c (3) x"):  # stems that no other leads to: exactly the names of a loop
            k = next(k for k in range(1, 99) if f"{folder}/{stem}{f' ({k})' if k > 1 else ''}.wav" not in held)
            assert got[path] == f"{folder}/{stem}{f' ({k})' if k > 1 else ''}.wav"
            held.add(got[path])


def brute_segments(x, y):
    """Score and coverage of the segments on all diagonals, place by place."""
    once = lambda f: {v: i for i, v in enumerate(f) if f.count(v) == 1}
    ux, uy = once(x), once(y)
    covered = {}
    for d in range(-len(y) + 1, len(x)):
        votes = sorted(i for v, i in ux.items() if uy.get(v) == i - d)
        runs = []
        for i in votes:
            if runs and i - runs[-1][-1] <= dedupe.GAP_MAX:
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            if len(run) >= dedupe.SEEDS_MIN:
                for i in range(max(run[0] - dedupe.GAP_MAX, d, 0), min(run[-1] + dedupe.GAP_MAX, len(x) - 1, len(y) - 1 + d) + 1):
                    bits = bin(x[i] ^ y[i - d]).count("1")
                    if run[0] <= i <= run[-1] or not bits:
                        at = i if len(x) <= len(y) else i - d
                        covered[at] = min(bits, covered.get(at, 99))
    return (sum(covered.values()) / len(covered), len(covered) / min(len(x), len(y))) if covered else None


def test_content_tier_finds_shifts_and_insertions(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(260)]
    texts = {"base": base, "copy": base, "other": [f"v{rng.randrange(3000)}" for _ in range(260)], "short": base[:2], "empty": []}
    for shift in (1, 4, 17, 50):
        texts[f"front{shift}"] = [f"x{rng.randrange(3000)}" for _ in range(shift)] + base[: 260 - shift]
        texts[f"back{shift}"] = base[shift:] + [f"x{rng.randrange(3000)}" for _ in range(shift)]
    for n in (1, 2, 5, 10, 20):
        texts[f"more{n}"], texts[f"less{n}"] = list(base), list(base)
        for at in sorted(rng.sample(range(260), n), reverse=True):
            texts[f"more{n}"][at:at] = [f"y{rng.randrange(3000)}" for _ in range(rng.randrange(1, 4))]
            del texts[f"less{n}"][at]
    worn = list(base)
    for at in rng.sample(range(260), 20):
        worn[at] = "changed"
    texts["worn"], texts["moved"], texts["repeats"] = worn, base[130:] + base[:130], base + base[:100]
    rows = spark.createDataFrame([(k, " ".join(t), "same old name", 100.0) for k, t in texts.items()], "path string, text string, name string, duration_secs double")
    rows = dedupe.with_fingerprint(rows)
    fp = {r["path"]: r["fp"] for r in rows.collect()}
    work = {(r["a"], r["b"]) for r in dedupe.content_pairs(rows).collect()}
    got = {(r["a"], r["b"]): (r["score"], r["coverage"]) for r in dedupe.content_edges(dedupe.content_pairs(rows), rows).collect()}
    assert got["base", "copy"] == (0.0, 1.0) and not any("other" in pair or "empty" in pair for pair in got)
    assert all(("base", f"{kind}{n}") in got for kind in ("more", "less") for n in (1, 2, 5, 10, 20)) and ("base", "moved") in got and ("base", "worn") in got
    for i, a in enumerate(sorted(fp)):
        for b in sorted(fp)[i + 1 :]:
            x, y = set(fp[a]), set(fp[b])
            named = x and y and "copy" not in (a, b) and len(x & y) * 2 >= min(len(x), len(y))
            assert ((a, b) in work) == bool(named or (a, b) == ("base", "copy")), (a, b)
            best = brute_segments(fp[a], fp[b])
            fits = (a, b) in work and best is not None and best[0] <= dedupe.SCORE_MAX and best[1] >= dedupe.COVERAGE_MIN
            assert ((a, b) in got) == fits, (a, b, best)
            if fits:
                assert abs(got[a, b][0] - best[0]) < 1e-9 and abs(got[a, b][1] - best[1]) < 1e-9


def test_content_work_grows_with_texts(spark):
    rng = random.Random(12)
    common = " ".join(f"common{i}" for i in range(12))
    sizes = []
    for n in (40, 400):
        texts = [common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(n)]
        rows = [(f"{i:04}", t, 100.0) for i, t in enumerate(texts)]
        rows += [(f"{i:04}copy{k}", texts[i], 100.0) for i in range(0, n, 10) for k in range(9)]  # nine copies of every tenth
        rows += [(f"{i:04}near", texts[i] + " end", 100.0) for i in range(5, n, 10)]
        df = dedupe.with_fingerprint(spark.createDataFrame(rows, "path string, text string, duration_secs double"))
        sizes.append(dedupe.content_pairs(df).count())
    assert sizes == [40, 400]  # a link a copy, a pair a near copy


def test_collection_of_any_layout(spark, tmp_path):
    from needledrop.sources import files

    body = """<?xml version="1.0" encoding="UTF-8"?>
<!-- TRACK --><DJ_PLAYLISTS Version="1.0.0">
  <COLLECTION Entries="9">
    <TRACK TrackID="1" Name="a &lt; b > c" AverageBpm="120.00" TotalTime="61" Tonality=" 8A "
           Location="file://localhost/m/One%20%2B+x.aiff">
      <TEMPO Inizio="0.1234" Bpm="119.50" Metro="4/4" Battito="1"/>
      <TEMPO Inizio="9.0" Bpm="120.25"/>
    </TRACK>
    <TRACK
      TrackID='2' AverageBpm='0.00' Location='file://localhost/m/two.mp3'/><TRACK TrackID="3" AverageBpm="90.00" Location="file://localhost/m/three.mp3"></TRACK>
    <TRACK TrackID="4" AverageBpm="90.00" Location=""><TEMPO Inizio="0" Bpm="90"/></TRACK>
    <TRACK TrackID="5" AverageBpm="99.00" Location="file://localhost/n/same.mp3"><TEMPO Bpm="99"/></TRACK>
    <TRACK TrackID="6" AverageBpm="99.00" TotalTime="7" Location="file://localhost/o/same.mp3"><TEMPO Inizio="5" Bpm="99"/></TRACK>
    <TRACK TrackID="7" AverageBpm="99.00" Location="file://localhost/n/odd.mp3"><TEMPO Inizio="1" Bpm="99"/></TRACK>
    <TRACK TrackID="8" AverageBpm="98.00" Location="file://localhost/o/odd.mp3"><TEMPO Inizio="1" Bpm="98"/></TRACK>
    <TRACK TrackID="9" AverageBpm="77.00" Location="file://localhost/m/100%.mp3"><TEMPO Inizio="1" Bpm="77"/></TRACK>
  </COLLECTION>
  <PLAYLISTS><NODE Name="TRACK" Type="1"><TRACK Key="1"/><TRACK Key="2"/></NODE></PLAYLISTS>
</DJ_PLAYLISTS>
"""
    (tmp_path / "c.xml").write_text(body)
    found = files.read_collection(spark, f"file://{tmp_path}/c.xml")
    assert [r["_TrackID"] for r in found.orderBy("place").collect()] == list(range(1, 10)) and found.filter("_TrackID = 1").first()["_Name"] == "a < b > c"
    names = {r["h"]: r["n"] for r in spark.createDataFrame([(n,) for n in ("One ++x.aiff", "same.mp3", "100%.mp3")], "n string").select("n", files.name_hash(F.col("n")).alias("h")).collect()}
    got = {names.get(r["name_hash"]): tuple(r)[1:] for r in files.reference_rows(found).collect()}
    assert got == {"One ++x.aiff": (120.0, 0.75, 61, "8A", 0.1234), "same.mp3": (99.0, 0.0, 0, None, 0.0), "100%.mp3": (77.0, 0.0, 0, None, 1.0)}
    assert {r["reason"]: r["n"] for r in files.dropped_rows(found).collect()} == dict(zip(files.DROPPED, (1, 1, 1, 2, 1), strict=True))
    try:  # cuts in the middle of elements change nothing
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        again = files.read_collection(spark, f"file://{tmp_path}/c.xml")
        assert again.rdd.getNumPartitions() > 5 and [r["_TrackID"] for r in again.orderBy("place").collect()] == list(range(1, 10))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_patches_in_any_order(spark):
    from needledrop.operators import sync as s

    rng = random.Random(10)
    tracks = spark.createDataFrame([(f"/t{i}", float(i), 0.5, i % 12, None, None) for i in range(8)], "path string, bpm double, bpm_confidence double, key_pc int, bpm_seq bigint, key_seq bigint")
    patches = [(n, f"/t{rng.randrange(10)}", rng.choice([None, 90.0 + n]), rng.choice([None, 0.25]), rng.choice([None, n % 12]), False) for n in range(60)]
    results = []
    for order in (list(range(0, 60, 15)), [45, 0, 30, 15]):
        now = tracks
        for at in order:
            batch = spark.createDataFrame(patches[at : at + 15], "seq long, path string, bpm double, bpm_confidence double, key_pc int, waveform boolean")
            now = s.apply_numbered(now, s.numbered_patches(batch))
        results.append(sorted(tuple(r) for r in now.collect()))
    assert results[0] == results[1]
    whole = s.apply_patches(tracks, s.coalesce_patches(spark.createDataFrame(patches, "seq long, path string, bpm double, bpm_confidence double, key_pc int, waveform boolean")))
    assert sorted(tuple(r)[:4] for r in whole.collect()) == [r[:4] for r in results[0]]


def test_log_batches_run_again_and_compact(spark, tmp_path):
    from needledrop.streaming import streams

    rows = lambda *r: spark.createDataFrame(r, "path string, mtime_ms long, size_bytes long")
    log = streams.Log(spark, f"file://{tmp_path}/log", rows(("a", 1, 1)).schema, streams.newest_files)
    assert log.read().count() == 0
    log.put(rows(("/a", 5, 1), ("/b", 7, 1)), 0)
    log.put(rows(("/a", 4, 9)), 1)  # an older version that arrives late
    log.put(rows(("/b", 8, 2)), 2)
    log.put(rows(("/b", 8, 3)), 2)  # the batch runs again
    catalog = spark.createDataFrame([("/a", 5, 1, None), ("/c", 1, 1, None)], "path string, mtime_ms long, size_bytes long, fresh boolean")
    want = [("/a", 5, 1, False), ("/b", 8, 3, True), ("/c", 1, 1, None)]
    assert sorted(tuple(r) for r in streams.arrived(catalog, log).collect()) == want
    begun = log.read()  # a reader from before
    log.compact()
    log.put(rows(("/b", 1, 1)), 2)  # and once more, after it has been put together with others
    assert sorted(tuple(r) for r in streams.arrived(catalog, log).collect()) == want and log.read().count() == 2 and begun.count() == 4


def test_log_of_many_batches_stays_short(spark, tmp_path):
    from needledrop.streaming import streams

    schema = spark.createDataFrame([("a", 1, 1)], "path string, mtime_ms long, size_bytes long").schema
    log = streams.Log(spark, f"file://{tmp_path}/log", schema, lambda rows: streams.newest_batches(rows, "path"), every=10)
    folders = 0
    for i in range(60):
        log.put(spark.createDataFrame([(f"/{i % 7}", i, i)], schema), i)
        folders = max(folders, sum(1 for x in (tmp_path / "log").iterdir() if x.name != "_manifest"))
    assert folders <= 22 and len(list((tmp_path / "log" / "_manifest").glob("[0-9]*"))) <= 3
    assert sorted((r["path"], r["size_bytes"]) for r in log.newest("path").collect()) == [(f"/{k}", max(i for i in range(60) if i % 7 == k)) for k in range(7)]


def test_patch_windows_restart_and_late_rows(spark, tmp_path):
    from datetime import datetime, timezone

    from needledrop.streaming import stateful, streams

    schema = "ts timestamp, path string, seq long, bpm double, bpm_confidence double, key_pc int, waveform boolean"
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc)
    batches = [
        [(at(5), "/a", 2, None, None, 3, False), (at(0), "/a", 1, 100.0, 0.5, None, False), (at(12), "/a", 3, 90.0, None, None, False)],  # out of order
        [(at(9), "/a", 4, 101.0, 0.25, None, True), (at(30), "/b", 5, 1.0, 1.0, 1, None)],
        [(at(1), "/a", 6, 77.0, 1.0, 1, False), (at(60), "/b", 7, None, None, 2, False)],  # the first is late by then
        [(at(100), "/c", 8, 5.0, 1.0, None, False)],
    ]
    late, sizes = 0, []
    for i, rows in enumerate(batches):  # each run takes up the checkpoint of the one before
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame(rows, schema).schema)
        late += stateful.run_with_state(stateful.patch_windows(stream, 10_000, "10 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/checkpoint")
        sizes.append(spark.read.schema(stateful.WINDOW).parquet(f"{tmp_path}/out").count())
    zero = 1_700_000_000_000
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [("/a", zero, 101.0, 0.25, 3, True, 3), ("/a", zero + 12_000, 90.0, None, None, False, 1), ("/b", zero + 30_000, 1.0, 1.0, 1, False, 1), ("/b", zero + 60_000, None, None, 2, False, 1)]
    assert got == want and late == 1 and sizes == [0, 1, 3, 4]


def test_newest_generation_passes_over_older_runs(spark, tmp_path):
    from needledrop.streaming import stateful, streams

    schema = "job string, generation long, done boolean"
    seen = {}
    for rows in ([("x", 1, True), ("y", 4, False), ("x", 1, False)], [("x", 2, True), ("x", 1, True), ("y", 3, True)], [("x", 1, True), ("x", 2, False)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = streams.read_stream(spark, f"{tmp_path}/in", spark.createDataFrame(rows, schema).schema, 100)
        stateful.run_with_state(stateful.newest_generations(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.update({r["job"]: tuple(r)[1:] for r in b.collect()})), f"{tmp_path}/checkpoint")
    assert seen == {"x": (2, 2, 1), "y": (4, 1, 0)}


def test_chunked_frames_equal_rows(spark):
    """Frames cut within chunks and their halo, whatever the sizes; what is shuffled is chunks, not places."""
    from needledrop.operators import signal

    rng = random.Random(5)
    rows = [(s, i, rng.uniform(-1, 1)) for s, n in (("a", 1003), ("b", 64), ("c", 63), ("d", 1), ("e", 200)) for i in range(n)]
    series = spark.createDataFrame(rows, "series_id string, i int, v double")
    for size, width, hop in ((100, 64, 32), (64, 64, 64), (50, 64, 16), (7, 20, 5), (10, 35, 40), (2000, 64, 32)):
        got = {(r["series_id"], r["frame_id"]): r["samples"] for r in signal.chunk_frames(signal.chunks(series, size), size, width, hop).collect()}
        want = {(r["series_id"], r["frame_id"]): r["samples"] for r in signal.frames(series, width, hop).collect()}
        assert got == want and len(want) > 10


def test_features_on_the_track_clock(spark):
    """A pulse of 24 places behind a silent start: the first beat is a place of the whole series, in one scan of the chunks."""
    import math

    from needledrop.operators import signal

    n, period = 1500, 24
    tone = lambda i: math.sin(2 * math.pi * 440 * i / 4096)
    rows = [("pulse", i, (6.0 if i % period == 7 else 0.0) + 0.001 * (i * 7919 % 13)) for i in range(n)] + [("tone", i, tone(i)) for i in range(n)] + [("short", i, float(i % 2)) for i in range(20)]
    series = spark.createDataFrame(rows, "series_id string, i int, v double")
    wanted = spark.createDataFrame([(s, True, True, True, s != "tone") for s in ("pulse", "tone", "short", "missing")], "series_id string, wants_tempo boolean, wants_grid boolean, wants_key boolean, wants_waveform boolean")
    tempo = signal.TempoRange(low=1.2, high=12.0, centre=2.5, width=0.45, least=1.0)
    for start in (0, 100, 101, 1400):  # the last leaves too little, and the excerpt begins at 0
        got = {r["series_id"]: r for r in signal.features(signal.chunks(series, 90), wanted, 1.0, tempo, 6, 6, 48, 90, (start, 900, 300), 4096.0).collect()}
        assert set(got) == {"pulse", "tone", "short", "missing"} and abs(got["pulse"]["bpm"] - 60 / period) < 0.02
        begin = 0 if start == 1400 else start
        # the envelope's first place is the rise to the second sample, and sounds lie ENVELOPE_LAG after it
        assert abs((got["pulse"]["offset"] - begin) - (7 - 1 - begin + signal.ENVELOPE_LAG) % period) < 1.0 and begin <= got["pulse"]["offset"] < begin + period + 1
        assert got["tone"]["key_pc"] is not None and got["tone"]["peaks"] is None and len(got["short"]["peaks"]) == 20 and got["missing"]["peaks"] is None
    parts = signal.feature_parts(signal.chunks(series, 90), wanted, 90, (0, 900, 300), 4096.0, 64, 50)
    assert parts._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1


def test_snapshot_touches_only_folders_that_change(spark, tmp_path):
    from needledrop.sources.snapshots import Snapshot

    schema = "path string, library_dir string, title string"
    rows = [(f"/lib {d}/x=%/{i}", f"/lib {d}/x=%", "old") for d in "abc" for i in range(5)]
    snapshot = Snapshot(spark, f"file://{tmp_path}/s", spark.createDataFrame(rows, schema).schema).create(spark.createDataFrame(rows, schema))
    state = lambda: {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "s").rglob("*.parquet")}
    titles = lambda: sorted((r["path"], r["title"]) for r in snapshot.read().collect())
    before, want = state(), {r[0]: r[2] for r in rows}
    snapshot.upsert(spark.createDataFrame([("/lib a/x=%/1", "/lib a/x=%", "new"), ("/lib a/x=%/9", "/lib a/x=%", "new"), ("/lib d/1", "/lib d", "new")], schema), "path")
    want |= {"/lib a/x=%/1": "new", "/lib a/x=%/9": "new", "/lib d/1": "new"}
    after = state()
    assert titles() == sorted(want.items()) and [k for k in before if before[k] != after[k]] == [k for k in before if "lib a" in k] and len(after) == 4
    plan = snapshot.read("/lib a/x=%")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(library_dir" in plan and snapshot.read("/lib a/x=%").count() == 6
    assert len(snapshot.read("/lib a/x=%").inputFiles()) <= len(snapshot.read().inputFiles())
    keep = spark.createDataFrame([("/lib b/x=%/2",)], "path string")
    snapshot.prune(keep, "/lib b/x=%", full_sweep=False)
    assert titles() == sorted(want.items())
    snapshot.prune(keep, "/lib b/x=%", full_sweep=True)
    snapshot.prune(keep, "/lib d", full_sweep=True)  # nothing is left of this one
    snapshot.delete(spark.createDataFrame([("/lib c/x=%/0", "/lib c/x=%")], "path string, library_dir string"))
    want = {p: t for p, t in want.items() if not p.startswith(("/lib b", "/lib d", "/lib c/x=%/0"))} | {"/lib b/x=%/2": "old"}
    assert titles() == sorted(want.items()) and len(state()) == 3
    snapshot.delete(snapshot.read("/lib c/x=%").select("path", "library_dir"))
    assert len(state()) == 2


def test_folder_links_equal_brute_force(spark):
    rng = random.Random(4)
    for k in (1, 2, 3):
        sets = {f"f{i:02}": {f"g{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randrange(1, 6))} for i in range(40)}
        df = spark.createDataFrame([(g, f) for f, gs in sets.items() for g in gs], "group_id string, folder string")
        got = {r["node"]: r["component"] for r in connected_components(dedupe.folder_links(df, k)).collect()}
        own = {f: f for f in sets}
        for _ in sets:
            for x in sets:
                for y in sets:
                    if x != y and len(sets[x] & sets[y]) >= k:
                        own[x] = own[y] = min(own[x], own[y])
        linked = {x for x in sets for y in sets if x != y and len(sets[x] & sets[y]) >= k}
        assert got == {f: own[f] for f in linked}


def test_folder_links_of_a_very_common_group(spark):
    rows = [("common", f"f{i}") for i in range(10_000)] + [(f"own{i}", f"f{i}") for i in range(10_000)] + [("pair", "f1"), ("pair", "f2")]
    links = dedupe.folder_links(spark.createDataFrame(rows, "group_id string, folder string"), 2)
    assert [tuple(r) for r in links.collect()] == [("f1", "f2")]


def test_inventory_lists_files_at_any_depth(spark, tmp_path):
    from needledrop.sources import files

    for name in ("a.mp3", "x/b.FLAC", "x/y/c.txt", "x/y/z/d.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = {r["path"].removeprefix(f"file:{tmp_path}/"): r["size_bytes"] for r in files.inventory(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.mp3": 5, "x/b.FLAC": 5, "x/y/z/d.wav": 5}
