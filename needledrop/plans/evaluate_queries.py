"""Queries of evaluation, files, export and round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from needledrop.operators import evaluate
from needledrop.plans.registry import Tables, query
from needledrop.scratch import materialise, scratch_folder
from needledrop.sources import files

_CAM = "case when (({m} + 8) % 12 + 12) % 12 = 0 then 12 else (({m} + 8) % 12 + 12) % 12 end"


def _camelot(pc, minor):
    return _CAM.format(m=f"({pc} - case when {minor} then 9 else 0 end) * 7")


def _key_sql(pc, minor, rpc, rminor):
    n, r = _camelot(pc, minor), _camelot(rpc, rminor)
    return f"case when {pc} is null then 'none' when {pc} = {rpc} and {minor} = {rminor} then 'exact' when {pc} = {rpc} then 'parallel' when {n} = {r} and {minor} <> {rminor} then 'relative' when {minor} = {rminor} and (({n}) - ({r}) + 12) % 12 in (1, 11) then 'fifth' else 'wrong' end"


_RATIO = "(d.bpm / r.bpm)"
_RELATED = " or ".join(f"abs({_RATIO} / {x} - 1.0::double) <= 0.02::double" for x in ("0.25::double", "(1.0::double / 3.0::double)", "0.5::double", "(2.0::double / 3.0::double)", "0.75::double", "(4.0::double / 3.0::double)", "1.5::double", "2.0::double", "3.0::double", "4.0::double"))
_PH = "((d.beat_secs - r.beat_secs) / (60.0::double / r.bpm))"
VIEWS = {
    "ev": f"""
select substr(sha256(string_split(d.path, '/')[-1]), 1, 16) as name_hash, d.path, d.engine, d.bpm, d.confidence, d.decode_ms, d.analyse_ms, d.key_pc, d.key_minor, d.beat_secs, r.bpm as ref_bpm, r.drift as ref_drift, r.key_pc as ref_key_pc, r.key_minor as ref_key_minor,
  case when r.drift <= 0.3 then 'steady' else 'drifting' end as tier,
  case when d.bpm is null then 'none' when abs(d.bpm - r.bpm) <= 0.5 then 'exact' when abs(d.bpm - r.bpm) <= 2.0 then 'close' when {_RELATED} then 'octave' else 'wrong' end as tempo,
  {_key_sql('d.key_pc', 'd.key_minor', 'r.key_pc', 'r.key_minor')} as key, {_PH} - floor({_PH}) as turn, least(turn, 1.0::double - turn) as phase
from detections d join reference r on r.path = d.path""",
    "sides": "select name_hash, ref_bpm, bool_or(tempo in ('exact', 'close')) filter (where engine = 'a') as right_a, bool_or(tempo in ('exact', 'close')) filter (where engine = 'b') as right_b from ev group by all",
}


def ev(name, sql=None):
    return query(name, sql, VIEWS)


def _judged(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return evaluate.judged(t.detections, t.reference)


def _folder(spark, name):
    return f"{scratch_folder(spark)}/{name}/{uuid.uuid4().hex}"


@ev("e1_detections_with_reference", "select name_hash, engine, bpm, ref_bpm from ev where tier = 'steady' order by name_hash, engine limit 1000")
def e1(spark, sf_dir):
    return evaluate.first_by_hash(_judged(spark, sf_dir).filter("tier = 'steady'"), 1000).select("name_hash", "engine", "bpm", "ref_bpm")


@ev("e2_tempo_verdict", "select name_hash, engine, tempo from ev")
def e2(spark, sf_dir):
    return _judged(spark, sf_dir).select("name_hash", "engine", "tempo")


@ev("e3_key_verdict", "select name_hash, engine, key from ev")
def e3(spark, sf_dir):
    return _judged(spark, sf_dir).select("name_hash", "engine", "key")


@ev("e4_tempo_tally", """
select tier, engine, count(*)::bigint as tracks, count(*) filter (where tempo = 'exact')::bigint as exact, count(*) filter (where tempo = 'close')::bigint as "close", count(*) filter (where tempo = 'octave')::bigint as octave,
  count(*) filter (where tempo = 'wrong')::bigint as wrong, count(*) filter (where tempo = 'none')::bigint as "none", round(100.0::double * count(*) filter (where tempo = 'exact') / count(*), 4) as exact_share, avg(confidence) as mean_confidence, avg(decode_ms) as mean_decode_ms, avg(analyse_ms) as mean_analyse_ms,
  count(*) filter (where tempo = 'octave' and not ref_bpm between 70 and 180)::bigint as octave_outside from ev group by all""")
def e4(spark, sf_dir):
    return evaluate.tempo_tally(_judged(spark, sf_dir))


@ev("e5_key_tally", "select tier, engine, " + ", ".join(f"count(*) filter (where key = '{k}')::bigint as k_{k}, round(100.0::double * count(*) filter (where key = '{k}') / count(*), 4) as p_{k}" for k in ("exact", "parallel", "relative", "fifth", "wrong", "none")) + " from ev group by all")
def e5(spark, sf_dir):
    return evaluate.key_tally(_judged(spark, sf_dir))


@ev("e6_phase_report", """
with n as (select *, row_number() over (partition by engine order by phase) as k, count(*) over (partition by engine) as c from ev where phase is not null)
select engine, count(*)::bigint as graded, count(*) filter (where phase <= 0.02)::bigint as within_2, count(*) filter (where phase <= 0.05)::bigint as within_5, count(*) filter (where phase <= 0.1)::bigint as within_10, count(*) filter (where phase <= 0.25)::bigint as within_25,
  round(min(phase) filter (where k = c // 2 + 1), 9) as median from n group by engine""")
def e6(spark, sf_dir):
    return evaluate.phase_report(_judged(spark, sf_dir)).withColumn("median", F.round("median", 9))


@ev("e7_disagreements", "select name_hash, ref_bpm, right_a, right_b from sides where right_a <> right_b order by ref_bpm, name_hash limit 40")
def e7(spark, sf_dir):
    return evaluate.disagreements(_judged(spark, sf_dir), "a", "b").orderBy("ref_bpm", "name_hash").limit(40)


@ev("e7_disagreement_count", "select count(*)::bigint as n from sides where right_a <> right_b")
def e7_count(spark, sf_dir):
    return evaluate.disagreements(_judged(spark, sf_dir), "a", "b").agg(F.count("*").alias("n"))


@ev("e8_wrong_keys", "select name_hash, engine, ((key_pc - ref_key_pc + 12) % 12)::int as semitones from ev where key = 'wrong' order by name_hash, engine limit 20")
def e8(spark, sf_dir):
    return evaluate.wrong_keys(_judged(spark, sf_dir)).orderBy("name_hash", "engine").limit(20).select("name_hash", "engine", F.col("semitones").cast("int").alias("semitones"))


@ev("e9_paired_runs", """
with d as (select count(*) filter (where right_b)::bigint as fixed, count(*) filter (where right_a)::bigint as broke from sides where right_a <> right_b)
select fixed, broke, fixed - broke as net, round(least(1.0, 2 * (select sum(exp(lgamma(fixed + broke + 1) - lgamma(k + 1) - lgamma(fixed + broke - k + 1) - (fixed + broke) * ln(2))) from range(0, 100000) r(k) where k <= least(fixed, broke))), 6) as p from d""")
def e9(spark, sf_dir):
    return evaluate.paired_runs(_judged(spark, sf_dir), "a", "b")


@ev("e10_confidence_buckets", "select engine, least(floor(confidence * 10), 9)::bigint as bucket, count(*)::bigint as tracks, round(100.0::double * count(*) filter (where key = 'exact') / count(*), 4) as exact_share, round(100.0::double * count(*) filter (where key in ('exact', 'relative', 'fifth')) / count(*), 4) as mixable_share from ev group by all")
def e10(spark, sf_dir):
    return evaluate.confidence_buckets(_judged(spark, sf_dir))


@ev("e11_threshold_sweep", "select threshold, count(*) filter (where confidence < threshold and tempo not in ('exact', 'close'))::bigint as wrong_prevented, count(*) filter (where confidence < threshold and tempo in ('exact', 'close'))::bigint as right_lost from ev, (select unnest([0.3::double, 0.4::double, 0.6::double, 0.9::double]) as threshold) where tempo <> 'none' group by threshold")
def e11(spark, sf_dir):
    return evaluate.threshold_sweep(_judged(spark, sf_dir), [0.3, 0.4, 0.6, 0.9])


@ev("e12_agreement_matrix", f"""
with o as (select name_hash, engine, key_pc, key_minor from ev union select name_hash, 'reference', ref_key_pc, ref_key_minor from ev),
v as (select x.engine as "left", y.engine as "right", {_key_sql('x.key_pc', 'x.key_minor', 'y.key_pc', 'y.key_minor')} as v from o x join o y on x.name_hash = y.name_hash and x.engine < y.engine where x.key_pc is not null and y.key_pc is not null)
select "left", "right", count(*)::bigint as tracks, round(100.0::double * count(*) filter (where v = 'exact') / count(*), 4) as exact_share, round(100.0::double * count(*) filter (where v in ('exact', 'relative', 'fifth')) / count(*), 4) as mixable_share from v group by all""")
def e12(spark, sf_dir):
    return evaluate.agreement_matrix(_judged(spark, sf_dir))


@ev("e13_per_track_dump", "select path, engine, tier, tempo, key, round(phase, 9) as phase from ev")
def e13(spark, sf_dir):
    """All verdicts of each track, written as CSV and read back."""
    folder = _folder(spark, "dump")
    _judged(spark, sf_dir).select("path", "engine", "tier", "tempo", "key", F.round("phase", 9).alias("phase")).write.option("header", "true").csv(folder)
    return spark.read.option("header", "true").schema("path string, engine string, tier string, tempo string, key string, phase double").csv(folder)


@ev("x11_phase_error", "select path, engine, round(phase, 9) as error from ev")
def x11(spark, sf_dir):
    return _judged(spark, sf_dir).select("path", "engine", F.round("phase", 9).alias("error"))


@ev("x16_grid_acceptance", "select path, engine, abs(bpm - ref_bpm) <= ref_bpm * 0.005 as grid_holds, bpm is not null and confidence >= 0.3 as may_write from ev")
def x16(spark, sf_dir):
    return _judged(spark, sf_dir).select("path", "engine", (F.abs(F.col("bpm") - F.col("ref_bpm")) <= F.col("ref_bpm") * 0.005).alias("grid_holds"), (F.col("bpm").isNotNull() & (F.col("confidence") >= 0.3)).alias("may_write"))


@ev("a2_file_inventory", r"""
with l as (select case when track_no % 3 = 0 then upper(path) else path end as path, size_bytes from tracks union all select path, size_bytes from doc_candidates)
select path, size_bytes from l where lower(string_split(path, '.')[-1]) in ('aiff', 'aif', 'wav', 'flac', 'alac', 'm4a', 'mp3', 'aac', 'ogg', 'opus', 'wma')""")
def a2(spark, sf_dir):
    """A listing of the catalogue's files, some with extensions in upper case, and of texts."""
    t = Tables(spark, sf_dir)
    listing = t.tracks.select(F.when(F.col("track_no") % 3 == 0, F.upper("path")).otherwise(F.col("path")).alias("path"), "size_bytes").unionByName(t.doc_candidates.select("path", "size_bytes"))
    return files.audio_files(listing)


_LOC = r"'file://localhost' || list_aggregate(list_transform(string_split(path, ''), lambda c: case when regexp_matches(c, '[A-Za-z0-9_.~/,()!+#$@?-]') then c else '%' || hex(c) end), 'string_agg', '')"


def _exported(t: Tables):
    grids = t.reference.select("path", "beat_secs")
    return files.number_by_path(t.catalog.join(grids, "path", "left"))




@ev("f19_location_and_facts", f"""
select path, {_LOC} as location, case container when 'aiff' then 'AIFF File' when 'wav' then 'WAV File' when 'flac' then 'FLAC File' when 'mp3' then 'MP3 File' else 'Unknown' end as kind, round(size_bytes * 8.0::double / duration_secs / 1000.0::double)::bigint as kbps,
  strftime(make_timestamp(download_date * 1000), '%Y-%m-%d') as added, replace(replace(replace(title || ' & <' || artist || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped from tracks""")
def f19(spark, sf_dir):
    t = Tables(spark, sf_dir).tracks
    return t.select(
        "path", files.location_url(F.col("path")).alias("location"), files.kind_of(F.col("container")).alias("kind"), files.bit_rate(F.col("size_bytes"), F.col("duration_secs")).alias("kbps"),
        files.date_of_ms(F.col("download_date")).alias("added"), files.xml_escape(F.concat("title", F.lit(" & <"), "artist", F.lit(">"))).alias("escaped"),
    )


@ev("k1_collection_export", rf"""
select row_number() over (order by c.path)::bigint as track_id, c.path, c.bpm > 0 and r.beat_secs is not null as has_grid, coalesce(title, file_name) as name, printf('%.2f', coalesce(c.bpm, 0.0)) as tempo, try_cast(trim(c.year) as int) as year_number,
  nullif(artist, '') as artist, nullif(album, '') as album, nullif(album_artist, '') as album_artist, nullif(genre, '') as genre, nullif(label, '') as label, case container when 'aiff' then 'AIFF File' when 'wav' then 'WAV File' when 'flac' then 'FLAC File' when 'mp3' then 'MP3 File' else 'Unknown' end as kind,
  round(duration_secs)::bigint as secs, sample_rate, size_bytes, round(size_bytes * 8.0::double / duration_secs / 1000.0::double)::bigint as kbps, track_number, key_name, strftime(make_timestamp(download_date * 1000), '%Y-%m-%d') as added, {_LOC.replace('path', 'c.path')} as location,
  case when c.bpm > 0 then printf('%.3f', r.beat_secs) end as beat
from cat c left join reference r on r.path = c.path""")
def k1(spark, sf_dir):
    """The exported elements, taken apart again natively so that a comparison sees their parts."""
    lines = files.track_lines(_exported(Tables(spark, sf_dir)))

    # an element's attributes have different names and hold no quotes, so all are found in two passes over a line
    found = [F.regexp_extract_all("line", F.lit(r' (\w+)="([^"]*)"'), k) for k in (1, 2)]
    lines = lines.withColumn("found", F.map_from_arrays(*found))

    def part(name: str):
        return F.nullif(F.try_element_at("found", F.lit(name)), F.lit(""))

    texts = {"name": "Name", "tempo": "AverageBpm", "artist": "Artist", "album": "Album", "album_artist": "AlbumArtist", "genre": "Genre", "label": "Label", "kind": "Kind", "key_name": "Tonality", "added": "DateAdded", "location": "Location", "beat": "Inizio"}
    numbers = {"year_number": ("Year", "int"), "secs": ("TotalTime", "bigint"), "sample_rate": ("SampleRate", "int"), "size_bytes": ("Size", "bigint"), "kbps": ("BitRate", "bigint"), "track_number": ("TrackNumber", "int")}
    grid = F.coalesce(F.nullif(F.col("line").contains("<TEMPO "), F.lit(False)), F.lit(False)).alias("has_grid")
    return lines.select("track_id", "path", grid, *[part(n).alias(k) for k, n in texts.items()], *[part(n).cast(kind).alias(k) for k, (n, kind) in numbers.items()])


@ev("k1_document", r"""
with n as (select path, row_number() over (order by path) as track_id from tracks), e as (select i.playlist_id, i.position, n.track_id from playlist_items i join n using (path)),
l as (select 0 as section, 0::bigint as major, 0::bigint as minor, unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<DJ_PLAYLISTS Version="1.0.0">']) as line
  union all select 1, 0, 0, '<COLLECTION Entries="' || count(*) || '">' from tracks union all select 3, 0, 0, '</COLLECTION>'
  union all select 3, 1, 0, '<PLAYLISTS><NODE Type="0" Name="ROOT" Count="' || count(*) || '">' from playlists
  union all select 4, id, -1, '<NODE Name="' || name || '" Type="1" KeyType="0" Entries="' || (select count(*) from e where e.playlist_id = p.id) || '">' from playlists p
  union all select 4, playlist_id, position, '<TRACK Key="' || track_id || '"/>' from e union all select 4, id, 9223372036854775807, '</NODE>' from playlists union all select 5, 0, 0, '</NODE></PLAYLISTS>' union all select 5, 1, 0, '</DJ_PLAYLISTS>')
select section, major, minor, line from l""")
def k1_document(spark, sf_dir):
    """The document around the elements: heads, playlist nodes with their entries, and ends; the elements themselves are compared by K1."""
    t = Tables(spark, sf_dir)
    return files.document_lines(_exported(t), t.playlists, t.playlist_items).filter("section <> 2").select("section", "major", "minor", "line")


@ev("k1_playlist_entries", "select playlist_id, position, row_number::bigint as track_id from playlist_items join (select path, row_number() over (order by path) as row_number from tracks) using (path)")
def k1_entries(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return files.playlist_entries(files.number_by_path(t.tracks), t.playlist_items)


def _row_hash(rows):
    """128 bits of each row, all that is shuffled to compare rows. Hashes skip nulls, so which columns have none is hashed too."""

    def bits(r):
        nulls = sum((F.when(r[c].isNull(), 2**k).otherwise(0) for k, c in enumerate(rows.columns)), F.lit(0))
        return F.struct(F.xxhash64(nulls, r).alias("h1"), F.xxhash64(F.lit(1), nulls, r).alias("h2"))

    return rows.select(F.inline(F.transform(F.array(F.struct(*rows.columns)), bits)))  # in a lambda, so that columns are not computed for each use


@ev("k2_round_trip", "select 0::bigint as missing, 0::bigint as added, count(*)::bigint as rows, (select count(*) from playlist_items join tracks using (path))::bigint as entries from tracks")
def k2(spark, sf_dir):
    """Rows that are written but not read back, in any attribute, and the other way round; and the playlist entries that come back."""
    t = Tables(spark, sf_dir)
    rows = materialise(_exported(t).select(*files.EXPORTED))
    folder = _folder(spark, "collection")
    files.write_document(files.document_lines(rows, t.playlists, t.playlist_items), folder, "gzip")  # a tenth of its size
    raw = files.read_collection(spark, folder)
    back = raw.select(
        F.col("_TrackID").alias("track_id"), files.location_path(F.col("_Location")).alias("path"), F.trim("_Name").alias("name"), F.col("_AverageBpm").alias("bpm"), *[F.trim(f"_{n}").alias(k) for k, n in files.TEXT_ATTRIBUTES.items()],
        *[F.col(f"_{n}").alias(k) for k, n in files.NUMBER_ATTRIBUTES.items()], F.get("TEMPO", F.lit(0))["_Inizio"].alias("beat_secs"),
    )
    facts = files.attributes(rows)
    want = facts.select(
        "track_id", "path", F.trim("name").alias("name"), F.round(F.coalesce("bpm", F.lit(0.0)), 2).alias("bpm"), *[F.nullif(F.trim(k), F.lit("")).alias(k) for k in files.TEXT_ATTRIBUTES],
        *files.NUMBER_ATTRIBUTES, F.when(F.col("bpm") > 0, F.bround("beat_secs", 3)).alias("beat_secs"),
    )
    back = back.select("track_id", "path", "name", "bpm", *[F.nullif(k, F.lit("")).alias(k) for k in files.TEXT_ATTRIBUTES], *files.NUMBER_ATTRIBUTES, "beat_secs")
    entries = spark.read.text(folder).filter("value like '<TRACK Key=%'").agg(F.count("*").alias("entries"))
    sides = _row_hash(want).withColumn("side", F.lit(1)).unionByName(_row_hash(back).withColumn("side", F.lit(-1)))  # each read once
    surplus = sides.groupBy("h1", "h2").agg(F.sum("side").alias("n"), F.count_if(F.col("side") < 0).alias("read"))
    counts = [surplus.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (("missing", F.greatest("n", F.lit(0))), ("added", F.greatest(-F.col("n"), F.lit(0))), ("rows", F.col("read")))]), entries]
    one, out = F.lit(1).alias("one"), None
    for c in counts:  # one row each
        out = c.select("*", one) if out is None else out.join(c.select("*", one), "one")
    return out.drop("one")


#: A collection as other programs write it: elements over several lines, a TEMPO on a line of its own, a second one where a tempo changes, unanalysed and misplaced rows, and names that repeat.
_LAYOUT = r"""
with t as (select path, track_no, string_split(path, '/')[-1] as name, round(bpm, 2) as bpm, track_no % 600 as secs, key_name, beat_secs from cat join (select path as p, beat_secs from reference) r on r.p = path),
x as (select name, track_no, 0 as again, case when track_no % 9 = 4 then 0 else bpm end as bpm, track_no % 7 = 3 as bare, track_no % 10 = 7 as lost, secs, key_name, beat_secs, track_no % 4 = 1 as changes from t
  union all select name, track_no, 1, case when track_no % 3 = 0 then bpm + 1 else bpm end, false, false, secs + 1, key_name, beat_secs, false from t where track_no % 5 = 2),
r as (select *, case when coalesce(bpm, 0) <= 0 then 'no BPM (never analysed)' when bare then 'no grid (BPM from the tag, not from analysis)' when lost then 'no location' end as reason from x),
k as (select *, row_number() over (partition by name order by again, track_no) as place, count(*) over (partition by name) as n, count(distinct bpm) over (partition by name) as tempos from r where reason is null)
"""


def _foreign_collection(t: Tables):
    rows = t.catalog.join(t.reference.select("path", "beat_secs"), "path").select("path", F.col("track_no").alias("no"), F.round("bpm", 2).alias("bpm"), "key_name", "beat_secs")
    rows = materialise(rows)  # read for elements and copies, each by the writer's sampling and sorting
    copies = rows.filter("no % 5 = 2").withColumns({"again": F.lit(1), "bpm": F.when(F.col("no") % 3 == 0, F.col("bpm") + 1).otherwise(F.col("bpm"))})
    first = rows.withColumns({"again": F.lit(0), "bpm": F.when(F.col("no") % 9 == 4, F.lit(0.0)).otherwise(F.col("bpm"))})
    every, once = first.unionByName(copies), F.col("again") == 0
    beat, tempo = F.format_string("%.3f", F.bround(F.coalesce("beat_secs", F.lit(0.0)), 3)), lambda c: F.format_string("%.2f", F.coalesce(c, F.lit(0.0)))
    text = lambda c: files.xml_escape(c)
    place = F.concat(F.lit("file://localhost/other/"), F.col("again").cast("string"), F.replace(files.location_url(F.col("path")), F.lit("file://localhost"), F.lit("")))
    element = F.concat(
        F.lit('    <TRACK TrackID="'), (F.col("no") * 2 + F.col("again")).cast("string"), F.lit('" Name="a > b"\n      Tonality="'), F.coalesce(text(F.col("key_name")), F.lit("")), F.lit('" TotalTime="'), (F.col("no") % 600 + F.col("again")).cast("string"),
        F.lit('"\n      AverageBpm="'), tempo(F.col("bpm")), F.lit('" Location="'), F.when(once & (F.col("no") % 10 == 7), F.lit("")).otherwise(place), F.lit('"'),
        F.when(once & (F.col("no") % 7 == 3), F.lit("/>")).otherwise(F.concat(
            F.lit('>\n      <TEMPO Inizio="'), beat, F.lit('" Bpm="'), tempo(F.col("bpm")), F.lit('" Metro="4/4" Battito="1"/>\n'),
            F.when(once & (F.col("no") % 4 == 1), F.concat(F.lit('      <TEMPO Inizio="60.000" Bpm="'), tempo(F.col("bpm") + 0.5), F.lit('" Metro="4/4" Battito="1"/>\n'))).otherwise(""), F.lit("    </TRACK>"))),
    )
    lines = every.select((F.col("again") + 1).alias("section"), F.col("no").alias("major"), F.lit(0).alias("minor"), element.alias("line"))
    head = '<?xml version="1.0"?>\n<DJ_PLAYLISTS Version="1.0.0">\n  <COLLECTION>'
    tail = '  </COLLECTION>\n  <PLAYLISTS>\n    <NODE Type="1">\n      <TRACK Key="1"/>\n    </NODE>\n  </PLAYLISTS>\n</DJ_PLAYLISTS>'
    ends = t.spark.createDataFrame([(0, 0, 0, head), (3, 0, 0, tail)], "section int, major long, minor int, line string")
    folder = _folder(t.spark, "collection")
    files.write_document(lines.unionByName(ends), folder)
    return files.read_collection(t.spark, folder)


@ev("a5_collection_reader", _LAYOUT + """
select substr(sha256(name), 1, 16) as name_hash, bpm, case when changes then 0.5::double else 0.0 end as drift, secs::bigint as secs, round_even(round_even(beat_secs, 3), 4) as beat_secs, key_name as key from k where place = 1 and tempos = 1""")
def a5(spark, sf_dir):
    return files.reference_rows(_foreign_collection(Tables(spark, sf_dir)))


@ev("a5_dropped_rows", _LAYOUT + """
select reason, count(*)::bigint as n from r where reason is not null group by 1 union all select * from (select 'duplicate filename', count(*)::bigint as n from k where place > 1) where n > 0
union all select * from (select 'duplicate filename, disagreeing BPM', count(distinct name)::bigint as n from k where tempos > 1) where n > 0""")
def a5_dropped(spark, sf_dir):
    return files.dropped_rows(_foreign_collection(Tables(spark, sf_dir)))


@ev("k3_reference_csv", "select substr(sha256(string_split(path, '/')[-1]), 1, 16) as name_hash, bpm, drift, (track_no % 600)::int as secs, case when track_no % 5 > 0 then key_pc::varchar end as key, case when track_no % 7 > 0 then beat_secs end as beat_secs from reference join (select path, track_no from tracks) using (path)")
def k3(spark, sf_dir):
    """The reference written as CSV and read back (A6)."""
    t = Tables(spark, sf_dir)
    from needledrop.functions.text import name_hash

    no = F.col("track_no")
    rows = t.reference.join(t.tracks.select("path", "track_no"), "path").select(name_hash(F.col("path")).alias("name_hash"), "bpm", "drift", (no % 600).cast("int").alias("secs"), F.when(no % 5 > 0, F.col("key_pc").cast("string")).alias("key"), F.when(no % 7 > 0, F.col("beat_secs")).alias("beat_secs"))
    folder = _folder(spark, "reference")
    files.write_reference(rows, folder)
    return files.read_reference(spark, folder)


@ev("a6_reference_reader", "select event_type as name_hash, value as bpm, 0.25::double as drift, (event_id % 600)::int as secs, null::varchar as key, null::double as beat_secs from events where event_id % 4 = 0 and value > 0")
def a6(spark, sf_dir):
    """A CSV of good, short, unreadable and commented lines, written from events."""
    folder, e = _folder(spark, "reference"), Tables(spark, sf_dir).events
    pick, secs = F.col("event_id") % 4, (F.col("event_id") % 600).cast("string")
    good = F.concat_ws(",", "event_type", F.col("value").cast("string"), F.lit("0.25"), secs)
    e.select(F.when(pick == 0, good).when(pick == 1, F.concat(F.lit("# "), good)).when(pick == 2, F.lit("name_sha256,bpm,drift,secs,key,beat_secs")).otherwise(F.col("event_type")).alias("value")).write.text(folder)
    return files.read_reference(spark, folder)


def _blob_words(c):
    """Little-endian unsigned 32-bit numbers of a blob; a rest of under four bytes is dropped."""
    code = F.hex(c)
    n = F.floor(F.length(code) / 8).cast("int")
    pair = lambda i, k: F.substring(code, i * 8 + 2 * k + 1, F.lit(2))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.concat(pair(i, 3), pair(i, 2), pair(i, 1), pair(i, 0)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


@ev("f20_blob_import", r"""
with b as (select item_id, hex(encode(text)) as code from benchmark)
select item_id, list_transform(range(0, length(code) // 8), lambda i: ('0x' || substr(code, (i * 8 + 7)::bigint, 2) || substr(code, (i * 8 + 5)::bigint, 2) || substr(code, (i * 8 + 3)::bigint, 2) || substr(code, (i * 8 + 1)::bigint, 2))::bigint) as words from b""")
def f20(spark, sf_dir):
    return Tables(spark, sf_dir).benchmark.select("item_id", _blob_words(F.col("text").cast("binary")).alias("words"))


@ev("f20_waveform_blob", r"""
with b as (select item_id, hex(encode(text)) as code from benchmark)
select item_id, list_transform(range(0, length(code) // 4), lambda i: round(('0x' || substr(code, (i * 4 + 1)::bigint, 2))::bigint / 255.0::double, 9)) as peak, list_transform(range(0, length(code) // 4), lambda i: round(('0x' || substr(code, (i * 4 + 3)::bigint, 2))::bigint / 255.0::double, 9)) as rms from b""")
def f20_waveform(spark, sf_dir):
    """Pairs of bytes as peaks and loudness from 0 to 1; a last odd byte is dropped."""
    code = F.hex(F.col("text").cast("binary"))
    n = F.floor(F.length(code) / 4).cast("int")

    def side(at: int):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.round(F.conv(F.substring(code, i * 4 + at, F.lit(2)), 16, 10).cast("double") / 255.0, 9))).otherwise(F.array().cast("array<double>"))

    return Tables(spark, sf_dir).benchmark.select("item_id", side(1).alias("peak"), side(3).alias("rms"))
