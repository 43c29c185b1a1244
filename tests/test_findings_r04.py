"""What the findings of round 4 asked for: tasks that hold what they are given, not what they find."""

import os
import random

import pytest
from pyspark.sql import functions as F

from needledrop.operators import dedupe
from needledrop.operators.components import connected_components

SF = "/root/testdata/sf0.001"


def test_a_task_hands_on_its_pairs_in_batches():
    """A thousand equal sets have half a million pairs."""
    import numpy as np
    import pyarrow as pa

    from needledrop.operators import bands

    n = 1000
    table = pa.table({"right": [False] * n, "i": [0] * n, "j": [0] * n, "id": [f"/{k:03}" for k in range(n)], "v": [1.0] * n, "to": [1.0] * n, "set": [["a", "b"]] * n})
    met = bands._met(table, 1.0, lambda n: n, lambda shared, n, m: shared >= np.minimum(n, m))
    batches = list(bands._in_batches(met, table["id"].combine_chunks(), 300))
    assert max(b.num_rows for b in batches) <= 300
    pairs = {(a, b) for x in batches for a, b in zip(x["a"].to_pylist(), x["b"].to_pylist(), strict=True)}
    assert len(pairs) == sum(b.num_rows for b in batches) == n * (n - 1) // 2 and all(a < b for a, b in pairs)


def test_name_components_are_those_of_all_links(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa"]
    name = lambda: rng.choice([None, "", "alpha 12", *(" ".join(rng.sample(words, n)) for n in (1, 2, 5, 7, 7, 8, 8, 8))])
    rows = [(f"/{i:03}", rng.choice([None, *(rng.randrange(320) / 8 for _ in range(9))]), name()) for i in range(400)]
    df = spark.createDataFrame(rows, "path string, duration_secs double, name string")
    links = dedupe.name_edges(df)
    want = {tuple(r) for r in connected_components(links).collect()}
    got = dict(tuple(r) for r in dedupe.name_components(df).collect())
    assert len(want) > 50 and want <= set(got.items())
    alone = {k: v for k, v in got.items() if k not in dict(want)}
    assert alone and all(k == v for k, v in alone.items())  # what has no link is a component of its own


def test_rows_of_one_name_are_one_node(spark, monkeypatch):
    """Two thousand rows of one name and four bands: links between four nodes, not two million pairs."""
    seen = []
    whole = dedupe.overlapping
    monkeypatch.setattr(dedupe, "overlapping", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    df = spark.range(2000).select(F.format_string("/%04d", "id").alias("path"), (F.col("id") % 32 / 8).alias("duration_secs"), F.lit("one name of all").alias("name"))
    parts = {r["component"] for r in dedupe.name_components(df).collect()}
    assert parts == {"/0000"} and seen[0].count() == 3


def test_sets_are_not_sent_to_count_them(spark):
    """One task a band for what has one part, and no shuffle of sets but the one by tasks."""
    from needledrop.operators import bands

    df = spark.range(300).select(F.col("id").cast("string").alias("id"), (F.col("id") % 10).cast("double").alias("v"), F.sequence(F.col("id"), F.col("id") + 50).alias("set"))
    plan = bands._dealt(df, 1.0, 1 << 20)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan.split("BroadcastExchange")[0] and "SortMergeJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_fingerprints_are_made_once_for_the_content_tier(spark, monkeypatch):
    """Its work list and its scores read them from the shared folder."""
    from needledrop.plans import QUERIES

    read = []
    edges = dedupe.content_edges
    monkeypatch.setattr(dedupe, "content_edges", lambda work, rows: read.append(rows) or edges(work, rows))
    assert QUERIES["d7_content_tier"](spark, SF).columns == ["a", "b", "score", "coverage"]
    assert "md5" not in read[0]._jdf.queryExecution().optimizedPlan().toString()


def test_row_hashes_tell_rows_apart_as_grouping_does(spark):
    from needledrop.plans.evaluate_queries import _row_hash

    rows = [(None, "x", None, 0.5), ("x", None, None, 0.5), ("x", "", None, 0.5), ("", "x", None, 0.5), (None, None, 0, 0.0), (None, None, None, 0.0), (None, None, 0, None), ("x", None, 1, 0.0), ("x", None, 1, -0.0), ("xy", "z", 1, 0.0), ("x", "yz", 1, 0.0), (None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:3], "a string, b string, c long, d double")
    assert df.groupBy(*df.columns).count().count() == 11
    by_hash = [r["count"] for r in _row_hash(df).groupBy("h1", "h2").count().collect()]
    assert sorted(by_hash) == sorted(r["count"] for r in df.groupBy(*df.columns).count().collect())


def test_a_document_may_be_stored_in_less_space(spark, tmp_path):
    """The same document, shard after shard, and the same elements when it is read."""
    import gzip
    from pathlib import Path

    from needledrop.sources import files

    line = F.format_string('<TRACK TrackID="%d" Name="track %d" Location="file://localhost/a/%d.wav"/>', "id", "id", "id")
    lines = spark.range(3000).select(F.lit(2).alias("section"), F.col("id").alias("major"), F.lit(0).cast("long").alias("minor"), line.alias("line"))
    files.write_document(lines, f"{tmp_path}/plain")
    files.write_document(lines, f"{tmp_path}/small", "gzip")
    whole = lambda folder: b"".join(p.read_bytes() for p in sorted(Path(folder).glob("part-*")))
    assert gzip.decompress(whole(f"{tmp_path}/small")) == whole(f"{tmp_path}/plain") and len(whole(f"{tmp_path}/small")) * 5 < len(whole(f"{tmp_path}/plain"))
    read = lambda folder: {tuple(r) for r in files.read_collection(spark, folder).select("_TrackID", "_Name", "_Location").collect()}
    assert len(read(f"{tmp_path}/small")) == 3000 and read(f"{tmp_path}/small") == read(f"{tmp_path}/plain")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_rows_of_a_round_trip_are_compared_by_their_hashes(spark):
    from needledrop.plans import QUERIES

    plan = QUERIES["k2_round_trip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [h1" in plan and ".gz" in "".join(f for f in QUERIES["k2_round_trip"](spark, SF).inputFiles())


def test_votes_of_a_pair_are_not_rows(spark):
    """Texts of a pair are compared in one row: nothing is taken apart into rows, so what is shuffled is texts, not their words."""
    fp = spark.createDataFrame([("/a", [1, 2, 3, 4, 5, 6]), ("/b", [9, 1, 2, 3, 4, 5, 7]), ("/c", [6, 5, 4, 3, 2, 1]), ("/d", [2**32 - 1, 0, 2**31])], "id string, fp array<bigint>")
    pairs = spark.createDataFrame([("/a", "/b"), ("/a", "/c"), ("/c", "/d"), ("/d", "/d")], "a string, b string")
    found = dedupe.segment_scores(pairs, fp)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Aggregate" not in plan
    assert {tuple(r) for r in found.collect()} == {("/a", "/b", 0.0, 5 / 6), ("/d", "/d", 0.0, 1.0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["d5_content_work_list", "d6_fingerprint_cache_split"])
def test_content_tier_makes_no_pairs_of_names(spark, monkeypatch, name):
    from needledrop.plans import QUERIES

    def none(*a):
        raise AssertionError("all pairs of the name tier")

    monkeypatch.setattr(dedupe, "name_edges", none)
    assert QUERIES[name](spark, SF).count() > 0


def test_pairs_within_a_component_are_not_made(spark):
    rng = random.Random(6)
    rows = [(f"/{i:03}", rng.randrange(40) / 8, [rng.randrange(12) for _ in range(rng.randrange(1, 6))]) for i in range(150)]
    df = spark.createDataFrame(rows, "path string, duration_secs double, fp array<bigint>")
    parts = spark.createDataFrame([(r[0], f"c{rng.randrange(4)}") for r in rows if rng.random() < 0.8], "node string, component string")
    want = {tuple(r) for r in dedupe.unconnected(dedupe.content_pairs(df), parts).collect()}
    got = [tuple(r) for r in dedupe.content_pairs(df, parts=parts).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want and len(got) < dedupe.content_pairs(df).count()
