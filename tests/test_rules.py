"""Facts of the row rules, input and output."""

import pytest
from pyspark.sql import functions as F

from needledrop.functions import rules, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("Move Your Body (To The Sound) [Club Mix]", "move your body to the sound club mix"), ("  ", ""), ("Äpfel & Öl", "äpfel öl")])
def test_norm_text(spark, raw, want):
    assert one(spark, text.norm_text(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("Z Records - Italo House compiled by Joey Negro", "italo house compiled by joey negro"), ("Solo - One", "solo one")])
def test_norm_album(spark, raw, want):
    assert one(spark, text.norm_album(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("01 Title", "Title"), ("7_x", "x"), ("1999 x", "1999 x"), ("12", "12"), ("123x", "123x")])
def test_strip_track_number(spark, raw, want):
    assert one(spark, text.strip_track_number(F.lit(raw))) == want


@pytest.mark.parametrize("title", ["Some One - Z Records - Italo House Mix - 01 Alone (Paradise Version)", "Alone (Paradise Version)"])
def test_core_title(spark, title):
    got = one(spark, text.core_title(F.lit(title), F.lit("Some One"), F.lit("Z Records - Italo House Mix")))
    assert got in ("alone paradise version", "z records italo house mix 01 alone paradise version")
    mangled = "Some One - Italo House Mix - 01 Alone (Paradise Version)"
    assert one(spark, text.core_title(F.lit(mangled), F.lit("Some One"), F.lit("Z Records - Italo House Mix"))) == "alone paradise version"


def test_token_overlap(spark):
    a, b = (F.array(*map(F.lit, x)) for x in (("alpha", "beta", "gamma"), ("alpha", "beta", "delta")))
    assert one(spark, text.token_overlap(a, b)) == 0.5
    none = F.array().cast("array<string>")
    assert one(spark, text.token_overlap(none, none)) == 0.0


def test_name_tokens(spark):
    assert sorted(one(spark, text.name_tokens(F.lit("01 The Song-b.flac ü")))) == ["song", "the", "ü"]


@pytest.mark.parametrize(("raw", "want"), [("127,6", 127.6), (" 128 ", 128.0), ("0", None), ("-120", None), ("99999", None), ("n/a", None)])
def test_parse_bpm(spark, raw, want):
    assert one(spark, rules.parse_bpm(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [("Am", (9, True)), ("F#m", (6, True)), ("Abm", (8, True)), ("C", (0, False)), ("A minor", (9, True)), ("B♭", (10, False)), ("8A", (9, True)), ("8B", (0, False)), ("13A", None), ("H", None), ("", None), ("Bb", (10, False)), ("Bm", (11, True))])
def test_parse_key(spark, raw, want):
    got = one(spark, rules.parse_key(F.lit(raw)))
    assert (got and (got["pc"], got["minor"])) == want


def test_camelot(spark):
    assert one(spark, rules.camelot_name(F.lit(9), F.lit(True))) == "8A"
    assert one(spark, rules.camelot_name(F.lit(0), F.lit(False))) == "8B"


@pytest.mark.parametrize(("raw", "want"), [("1998", 1998), ("1998-05-01", 1998), ("05/1998", 1998), ("19980501", None), (None, None)])
def test_parse_year(spark, raw, want):
    assert one(spark, text.parse_year(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(("audio", "codes", "compatible"), [
    (("wav", "pcm_s16le", 96000, 16), ["SAMPLE_RATE"], False), (("wav", "pcm_s16le", 0, 16), ["SAMPLE_RATE_UNKNOWN"], True), (("flac", "flac", 44100, 16), ["NEWER_PLAYERS_ONLY"], True),
    (("aiff", "sowt", 44100, 16), ["COMPRESSED_PCM_CONTAINER", "UNSUPPORTED_CODEC"], False), (("wav", "pcm_f32le", 48000, 32), ["BIT_DEPTH"], False), (("mp3", "mp3", 44100, 0), [], True),
])
def test_compatibility(spark, audio, codes, compatible):
    df = spark.createDataFrame([audio], "container string, codec string, sample_rate int, bits_per_sample int").select(rules.compat_issues().alias("i"))
    row = df.select("i.code", rules.is_compatible(F.col("i")).alias("ok")).first()
    assert row["code"] == codes and row["ok"] is compatible


def test_natural_order(spark):
    df = spark.createDataFrame([("EP 10",), ("ep 2",), ("EP 1",)], "x string")
    assert [r["x"] for r in df.orderBy(text.natural_key(F.col("x"))).collect()] == ["EP 1", "ep 2", "EP 10"]


def test_match_key_drops_accents(spark):
    assert one(spark, text.match_key(F.lit("Émile--Été №1"))).startswith("emile ete")


def test_natural_order(spark):
    """As a collator that looks at base letters and numbers has it: accents and case do not tell names apart, numbers of any length do."""
    ranks = [[""], ["10 a"], ["a"], ["a 2", "A 02", "á 2"], ["a 10"], ["a " + "9" * 30], ["a 1" + "0" * 30, "Ä 01" + "0" * 30], ["a 1" + "0" * 29 + "1"], ["ab"], ["Émile", "emile", "EMILE"], ["Zoe", "zoé"]]
    rows = [(i, x) for i, same in enumerate(ranks) for x in same]
    df = spark.createDataFrame(rows, "rank int, name string").withColumn("k", text.natural_key(F.col("name")))
    assert [r["rank"] for r in df.repartition(4).orderBy("k").collect()] == [r[0] for r in rows]
    assert df.groupBy("k").agg(F.count_distinct("rank").alias("n")).filter("n > 1").count() == 0 and df.select("k").distinct().count() == len(ranks)
