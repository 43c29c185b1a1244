"""Queries over the catalogue view: scan, filters, sorting, roll-ups and row rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from needledrop.functions import rules, text
from needledrop.operators import catalog, filters, grouping
from needledrop.scratch import scratch_folder
from needledrop.sources.snapshots import Snapshot
from needledrop.plans.registry import Tables, query

ROOT = "/lib"


@query("minimum_slice_albums_needing_work", r"""
select album_key, count(*)::bigint as tracks, sum(duration_secs)::double as total_length, count(*) filter (where not compatible)::bigint as to_convert, count(*) filter (where not complete)::bigint as incomplete
from cat where bpm >= 80 and bpm <= 180 and lower(trim(genre)) in ('1-urgent', '2-high', '3-medium', 'techno') group by album_key having to_convert > 0 or incomplete > 0""")
def minimum_slice(spark, sf_dir):
    rows = filters.filter_tracks(Tables(spark, sf_dir).catalog, filters.TrackFilter(bpm=(80, 180), genres=["1-URGENT", "2-high", "3-medium", "Techno"]))
    albums = grouping.summarize(rows, "album_key").filter("to_convert > 0 or incomplete > 0")
    return albums.select("album_key", "tracks", "total_length", "to_convert", "incomplete").orderBy(F.desc("to_convert"), "album_key")


@query("a1_catalog_scan", "select path, compatible, complete, key_name, camelot, format from cat where library_dir = '/lib/F' and not edited union all select path, compatible, complete, key_name, camelot, format from cat where library_dir = '/lib/F' and edited")
def a1(spark, sf_dir):
    rows = catalog.scan(Tables(spark, sf_dir).catalog, "/lib/F")
    return rows.select("path", "compatible", "complete", "key_name", "camelot", "format").orderBy("path")


@query("a1_snapshot_scan", "select path, title, library_dir from tracks where library_dir = '/lib/F'")
def a1_snapshot(spark, sf_dir):
    """One library of a catalogue that is stored by library: only its folder is read."""
    rows = Tables(spark, sf_dir).tracks.select("path", "title", "library_dir")
    return Snapshot(spark, f"{scratch_folder(spark)}/snapshot/{uuid.uuid4().hex}", rows.schema).create(rows).read("/lib/F")


@query("b2_effective_metadata", "select path, title, artist, album, album_artist, genre, year, track_number, label, bpm, edited from eff")
def b2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return catalog.effective(t.tracks, t.edits).select("path", "title", "artist", "album", "album_artist", "genre", "year", "track_number", "label", "bpm", "edited")


@query("c1_facet_filter", r"""
select path from cat where bpm >= 100 and bpm <= 150 and regexp_extract(trim(year), '(?:^|\D)(\d{4})(?:\D|$)', 1) >= '1993' and lower(trim(genre)) in ('1-urgent', 'techno') and not compatible""")
def c1(spark, sf_dir):
    facets = filters.TrackFilter(bpm=(100, 150), year=(1993, None), genres=["1-urgent ", "TECHNO"], needs_convert=True)
    return filters.filter_tracks(Tables(spark, sf_dir).catalog, facets).select("path")


_HAY = "lower(concat_ws(' ', nullif(title, ''), nullif(artist, ''), nullif(album, ''), nullif(album_artist, ''), nullif(label, ''), nullif(genre, ''), nullif(year, ''), nullif(file_name, '')))"


@query("c2_free_text_search", f"select path from cat where contains({_HAY}, 'r#0000001')")
def c2(spark, sf_dir):
    return Tables(spark, sf_dir).catalog.filter(filters.search_column(" R#0000001 ")).select("path")


@query("c3_filter_and_search", f"select path, title from cat where contains({_HAY}, 'machinery') and bpm is not null and bpm <= 120 and not complete")
def c3(spark, sf_dir):
    return filters.filter_tracks(Tables(spark, sf_dir).catalog, filters.TrackFilter(bpm=(None, 120), incomplete_only=True), "MACHINERY").select("path", "title")


@query("c4_facet_counts", r"""
select count(*)::bigint as total, count(*) filter (where not compatible)::bigint as to_convert, count(*) filter (where not complete)::bigint as incomplete,
  count(*) filter (where purchased)::bigint as purchased, count(*) filter (where not purchased)::bigint as local from (select *, track_no % 50 = 0 as purchased from cat)""")
def c4(spark, sf_dir):
    return filters.facet_counts(Tables(spark, sf_dir).catalog.withColumn("purchased", F.col("track_no") % 50 == 0))


@query("c5_distinct_genres", "select lower(trim(genre)) as folded, arg_min(trim(genre), path) as genre from cat where trim(genre) <> '' group by 1")
def c5(spark, sf_dir):
    return filters.distinct_genres(Tables(spark, sf_dir).catalog).orderBy(text.natural_key(F.col("folded")))


@query("c6_distinct_keys", "select lower(key_name) as folded, arg_min(key_name, path) as key_name, any_value(case when wheel = 0 then 12 else wheel end * 2 + case when key_minor then 0 else 1 end)::int as rank from cat where key_name is not null group by 1")
def c6(spark, sf_dir):
    return filters.distinct_keys(Tables(spark, sf_dir).catalog).orderBy("rank", "key_name")


@query("c7_completeness", "select library_dir, edited, count(*) filter (where complete)::bigint as complete, count(*) filter (where not complete)::bigint as incomplete from cat group by all")
def c7(spark, sf_dir):
    return Tables(spark, sf_dir).catalog.groupBy("library_dir", "edited").agg(F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("incomplete"))


@query("c8_skip_report", "select path, arg_max(event_type, event_id) as reason, max(event_id) as seq from (select *, '/u/' || user_id as path from events where event_type <> 'purchase') group by path")
def c8(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.filter("event_type <> 'purchase'").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("reason"), F.col("event_id").alias("seq"))
    return filters.latest_per_path(rows, "seq", "reason")


@query("c9_top_n_retention", "select event_id, event_type, user_id from events order by event_id desc limit 500")
def c9(spark, sf_dir):
    return filters.newest(Tables(spark, sf_dir).events.select("event_id", "event_type", "user_id"), 500, "event_id")


@query("c9_top_n_per_source", "select event_id, event_type, user_id from events qualify row_number() over (partition by event_type order by event_id desc) <= 20")
def c9b(spark, sf_dir):
    return filters.newest(Tables(spark, sf_dir).events.select("event_id", "event_type", "user_id"), 20, "event_id", "event_type")


@query("c10_event_log_unread", r"""
with log as (select event_id as id, case when event_type = 'click' then 'warning' when event_type = 'view' then 'info' when event_type = 'signup' then 'odd' else 'error' end as raw from events)
select case when raw in ('info', 'warning', 'error') then raw else 'info' end as level, count(*)::bigint as events, count(*) filter (where id > 1000)::bigint as unread, max(greatest(id, 1000))::bigint as seen from log group by 1""")
def c10(spark, sf_dir):
    level = F.when(F.col("event_type") == "click", "warning").when(F.col("event_type") == "view", "info").when(F.col("event_type") == "signup", "odd").otherwise("error")
    log = filters.event_log(Tables(spark, sf_dir).events.select(F.col("event_id").alias("id"), level.alias("level")), seen=1000)
    return log.groupBy("level").agg(F.count("*").alias("events"), F.count_if("unread").alias("unread"), F.max(F.greatest("id", F.lit(1000))).cast("bigint").alias("seen"))


@query("s1_flat_sort", "select path, bpm, row_number() over (order by bpm desc nulls last, path)::bigint as place from cat")
def s1(spark, sf_dir):
    # the place makes the order visible to a comparison
    rows = filters.sort_tracks(Tables(spark, sf_dir).catalog, "bpm", descending=True).select("path", "bpm", "sort_value")
    return filters.number_in_order(rows, F.desc_nulls_last("sort_value"), F.col("path")).select("path", "bpm", "place")


#: Names in which case, accents and numbers of up to 33 digits differ from row to row, and their order by base letters and numbers.
_VARIED = r"""
v as (select path, case track_no % 3 when 0 then replace({0}, 'a', 'á') when 1 then upper({0}) else {0} end || ' ' || track_no % 50 || repeat('0', track_no % 4 * 10) || track_no % 7 as x from cat),
k as (select path, list_aggregate(list_transform(regexp_extract_all(strip_accents(lower(x)), '([0-9]+|[^0-9]+)'), lambda p: case when regexp_matches(p, '^[0-9]+$') then lpad(ltrim(p, '0'), 60, '0') else p end), 'string_agg', '') as sort_key from v)
"""


def _varied(name: Column) -> Column:
    no = F.col("track_no")
    number = F.concat((no % 50).cast("string"), F.repeat(F.lit("0"), (no % 4 * 10).cast("int")), (no % 7).cast("string"))
    return F.concat(F.when(no % 3 == 0, F.replace(name, F.lit("a"), F.lit("á"))).when(no % 3 == 1, F.upper(name)).otherwise(name), F.lit(" "), number)


@query("s2_natural_collation", f"with {_VARIED.format('trim(album_key)')} select path, row_number() over (order by sort_key desc, path)::bigint as place from k")
def s2(spark, sf_dir):
    rows = Tables(spark, sf_dir).catalog.withColumn("album_key", _varied(F.trim("album_key")))
    rows = filters.sort_tracks(rows, "album", descending=True).select("path", "sort_value")
    return filters.number_in_order(rows, F.desc_nulls_last("sort_value"), F.col("path")).select("path", "place")


@query("r1_album_items", r"""
select path, album_key, count(*) over w >= 2 or bool_or(album_tag is not null) over w as is_group, row_number() over (partition by album_key order by coalesce(track_number, 2147483647), path)::bigint as place
from cat window w as (partition by album_key)""")
def r1(spark, sf_dir):
    return grouping.album_items(Tables(spark, sf_dir).catalog).select("path", "album_key", "is_group", "place")


@query("r2_group_numbers", "select album_key, sum(duration_secs)::double as length, max(coalesce(download_date, 0))::bigint as date, round(avg(bpm), 6) as bpm from cat group by album_key")
def r2(spark, sf_dir):
    return grouping.group_numbers(Tables(spark, sf_dir).catalog, "album_key").withColumn("bpm", F.round("bpm", 6))


@query("r3_label_tree", r"""
with x as (select *, coalesce(trim(label), '') as label_key, count(*) over (partition by coalesce(trim(label), ''), album_key) >= 2 or bool_or(album_tag is not null) over (partition by coalesce(trim(label), ''), album_key) as is_group from cat)
select label_key, label_key = '' as comes_last, count(*)::bigint as tracks, count(distinct case when is_group then album_key end)::bigint as albums, count(*) filter (where not is_group)::bigint as loose from x group by 1, 2""")
def r3(spark, sf_dir):
    return grouping.label_summary(Tables(spark, sf_dir).catalog).orderBy("comes_last", text.natural_key(F.col("label_key")))


@query("r3_label_tree_rows", r"""
with x as (select *, coalesce(trim(label), '') as label_key, count(*) over (partition by coalesce(trim(label), ''), album_key) >= 2 or bool_or(album_tag is not null) over (partition by coalesce(trim(label), ''), album_key) as is_group from cat)
select label_key, case when is_group then album_key end as node_album, path, label_key = '' as comes_last from x""")
def r3_rows(spark, sf_dir):
    return grouping.label_tree(Tables(spark, sf_dir).catalog).select("label_key", "node_album", "path", "comes_last")


@query("r4_folder_tree", r"""
with p as (select path, list_filter(string_split(case when starts_with(path, '/lib/') then substr(path, 6) else '' end, '/'), lambda x: x <> '') as parts from tracks),
a as (select path, unnest(range(0, greatest(len(parts) - 1, 0) + 1)) as depth, parts, greatest(len(parts) - 1, 0) as last from p)
select case when depth = 0 then '/lib' else '/lib/' || array_to_string(parts[1:depth], '/') end as folder, min(depth)::int as depth, count(*)::bigint as tracks_below, count(*) filter (where depth = last)::bigint as tracks_direct from a group by 1""")
def r4(spark, sf_dir):
    return grouping.folder_tree(Tables(spark, sf_dir).tracks, ROOT)


@query("r5_group_summary", r"""
select library_dir, label, count(*)::bigint as tracks, sum(duration_secs)::double as total_length, max(download_date)::bigint as newest_date,
  case when count(distinct format) = 1 then min(format) else 'Mixed' end as format,
  case count(distinct nullif(group_artist, '')) when 0 then '' when 1 then min(nullif(group_artist, '')) else 'Various' end as artist, count(distinct album_key)::bigint as albums,
  case when min(bpm) is null then '-' when floor(min(bpm) + 0.5) = floor(max(bpm) + 0.5) then floor(min(bpm) + 0.5)::bigint::varchar else floor(min(bpm) + 0.5)::bigint::varchar || '-' || floor(max(bpm) + 0.5)::bigint::varchar end as bpm,
  count(*) filter (where not compatible)::bigint as to_convert, count(*) filter (where not complete)::bigint as incomplete
from cat group by library_dir, label""")
def r5(spark, sf_dir):
    return grouping.summarize(Tables(spark, sf_dir).catalog, "library_dir", "label")


@query("r6_playlist_groups", r"""
with v as (select path from cat where compatible), i as (select *, count(*) over (partition by playlist_id)::bigint as list_size from playlist_items)
select i.playlist_id::bigint as playlist_id, path, (i.position + 1)::bigint as position, list_size from v join i using (path)
union all select -1, path, null, null from v where path not in (select path from playlist_items)""")
def r6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return grouping.playlist_groups(t.playlist_items.withColumn("playlist_id", F.col("playlist_id").cast("bigint")), t.catalog.filter("compatible"))


@query("r7_playlist_counts", "select p.id, p.name, p.created_ms, count(i.path)::bigint as items from playlists p left join playlist_items i on i.playlist_id = p.id group by all")
def r7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return grouping.playlist_counts(t.playlists, t.playlist_items).orderBy("created_ms", "id")


@query("r8_playlist_paths", "select playlist_id, list(path order by position, path) as paths from playlist_items group by playlist_id")
def r8(spark, sf_dir):
    return grouping.playlist_paths(Tables(spark, sf_dir).playlist_items)


# --- row rules, applied to whole columns ---

_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query("f1_norm_text", f"select path, {_NORM.format('path')} as normal from tracks")
def f1(spark, sf_dir):
    return Tables(spark, sf_dir).tracks.select("path", text.norm_text(F.col("path")).alias("normal"))


_ALBUM_SQL = rf"""
select album, case when instr(album, ' - ') > 0 and len(list_filter(regexp_split_to_array(substr(album, instr(album, ' - ') + 3), '\s+'), lambda w: w <> '')) >= 2
  then {_NORM.format("substr(album, instr(album, ' - ') + 3)")} else {_NORM.format('album')} end as normal, count(*)::bigint as n from (select label || ' - ' || album as album from tracks union all select album from tracks) group by album"""


@query("f2_norm_album", _ALBUM_SQL)
def f2(spark, sf_dir):
    t = Tables(spark, sf_dir).tracks
    both = t.select(F.concat("label", F.lit(" - "), "album").alias("album")).unionByName(t.select("album"))
    return both.groupBy("album").agg(F.count("*").alias("n")).select("album", text.norm_album(F.col("album")).alias("normal"), "n")


@query("f3_strip_track_number", r"select path, case when regexp_matches(ltrim(file_name), '^[0-9]{1,3}[ ._-]') then regexp_replace(ltrim(file_name), '^[0-9]{1,3}[ ._-]+', '') else ltrim(file_name) end as rest from cat")
def f3(spark, sf_dir):
    return Tables(spark, sf_dir).catalog.select("path", text.strip_track_number(F.col("file_name")).alias("rest"))


@query("f4_core_title", rf"select path, {_NORM.format('p_name')} as core from (select t.path, t.title as p_name from tracks t where trim(t.title) <> '')")
def f4(spark, sf_dir):
    t = Tables(spark, sf_dir).tracks.filter(F.trim("title") != "")
    mangled = F.concat_ws(" - ", "artist", F.col("album"), F.concat(F.lpad(F.col("track_number").cast("string"), 2, "0"), F.lit(" "), F.col("title")))
    mangled = F.when(F.col("track_number").isNull(), F.concat_ws(" - ", "artist", "title")).otherwise(mangled)
    return t.select("path", text.core_title(mangled, F.col("artist"), F.col("album")).alias("core"))


_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 2 and not regexp_matches(w, '^\p{{N}}+$') and w not in ('aiff', 'aif', 'wav', 'flac', 'alac', 'm4a', 'mp3', 'aac', 'ogg', 'opus', 'wma')))"


@query("f5_name_tokens", f"select path, list_sort({_TOKENS.format('file_name')}) as tokens from cat")
def f5(spark, sf_dir):
    return Tables(spark, sf_dir).catalog.select("path", F.array_sort(text.name_tokens(F.col("file_name"))).alias("tokens"))


@query("f6_token_overlap", f"""
select path, case when len(list_distinct(a || b)) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(a || b)) end as overlap
from (select path, {_TOKENS.format('file_name')} as a, {_TOKENS.format("coalesce(title, '')")} as b from cat)""")
def f6(spark, sf_dir):
    a, b = text.name_tokens(F.col("file_name")), text.name_tokens(F.coalesce("title", F.lit("")))
    return Tables(spark, sf_dir).catalog.select("path", text.token_overlap(a, b).alias("overlap"))


@query("f7_filename_parts", r"""
select path, try_cast(nullif(regexp_extract(stem, '^([0-9]{1,3})[ ._-]+', 1), '') as int) as number, regexp_replace(stem, '^[0-9]{1,3}[ ._-]+', '') as rest, trim(regexp_replace(trim('(1999) ' || folder), '^[0-9 ()\[\]\-_.]+', '')) as folder
from (select path, regexp_replace(file_name, '\.[^.]*$', '') as stem, string_split(path, '/')[-2] as folder from cat)""")
def f7(spark, sf_dir):
    number, rest = text.split_leading_track(text.stem(F.col("path")))
    return Tables(spark, sf_dir).tracks.select("path", number.alias("number"), rest.alias("rest"), text.clean_folder(F.concat(F.lit("(1999) "), text.folder_name(F.col("path")))).alias("folder"))


@query("f8_compat_rules", r"""
select code, severity, count(*)::bigint as n, count(*) filter (where compatible)::bigint as still_compatible from (
  select compatible, unnest(list_filter([case when w_rate then 'SAMPLE_RATE_UNKNOWN' end, case when e_rate then 'SAMPLE_RATE' end, case when e_container then 'COMPRESSED_PCM_CONTAINER' end,
    case when e_bits then 'BIT_DEPTH' end, case when w_newer then 'NEWER_PLAYERS_ONLY' end, case when e_codec then 'UNSUPPORTED_CODEC' end], lambda x: x is not null)) as code,
    case when code in ('SAMPLE_RATE_UNKNOWN', 'NEWER_PLAYERS_ONLY') then 'warning' else 'error' end as severity from cat) group by code, severity""")
def f8(spark, sf_dir):
    rows = Tables(spark, sf_dir).catalog.select("compatible", F.explode("issues").alias("i"))
    return rows.groupBy(F.col("i.code").alias("code"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"), F.count_if("compatible").alias("still_compatible"))


@query("f9_parse_year", r"select path, try_cast(nullif(regexp_extract(trim(year), '(?:^|\D)(\d{4})(?:\D|$)', 1), '') as int) as parsed from tracks")
def f9(spark, sf_dir):
    return Tables(spark, sf_dir).tracks.select("path", text.parse_year(F.col("year")).alias("parsed"))


@query("f10_parse_key", r"""
select path, case track_no % 5 when 0 then null else key_pc end::int as pc, case track_no % 5 when 0 then null else key_minor end as minor from tracks""")
def f10(spark, sf_dir):
    """Every spelling of a row's key is read back: name, spelled-out mode, wheel, flats, and junk."""
    t = Tables(spark, sf_dir).tracks
    flats = F.element_at(F.array(*map(F.lit, ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"))), F.col("key_pc") + 1)
    name, pick = rules.key_name(F.col("key_pc"), F.col("key_minor")), F.col("track_no") % 5
    spelled = (
        F.when(pick == 0, F.lit("H dorian")).when(pick == 1, name).when(pick == 2, rules.camelot_name(F.col("key_pc"), F.col("key_minor")))
        .when(pick == 3, F.concat(flats, F.when(F.col("key_minor"), " minor").otherwise(" Major"))).otherwise(F.concat(F.lit(" "), flats, F.when(F.col("key_minor"), "m").otherwise("")))
    )
    parsed = t.select("path", rules.parse_key(spelled).alias("k"))
    return parsed.select("path", F.col("k.pc").cast("int").alias("pc"), F.col("k.minor").alias("minor"))


@query("f11_key_names", "select key_name, camelot, count(*)::bigint as n from cat group by all")
def f11(spark, sf_dir):
    return Tables(spark, sf_dir).catalog.groupBy("key_name", "camelot").agg(F.count("*").alias("n"))


@query("f12_parse_bpm", "select path, case when track_no % 4 = 3 or bpm is null or bpm * (1 + track_no % 4 * 3) > 1000 then null else bpm * (1 + track_no % 4 * 3) end as parsed from tracks")
def f12(spark, sf_dir):
    t = Tables(spark, sf_dir).tracks
    raw = F.when(F.col("track_no") % 4 == 3, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.replace((F.col("bpm") * (1 + F.col("track_no") % 4 * 3)).cast("decimal(20,4)").cast("string"), F.lit("."), F.lit(",")), F.lit(" ")))
    return t.select("path", rules.parse_bpm(raw).alias("parsed"))


@query("f13_format_label", "select format, count(*)::bigint as n from cat group by format")
def f13(spark, sf_dir):
    return Tables(spark, sf_dir).catalog.groupBy("format").agg(F.count("*").alias("n"))


@query("f14_status_set", r"""
select path, list_filter([case when not compatible then 'convert' end, case when compatible and (w_rate or w_newer) then 'note' end, case when complete and edited then 'complete' when not complete then 'incomplete' end, case when track_no % 50 = 0 then 'purchased' end], lambda x: x is not null) as status from cat""")
def f14(spark, sf_dir):
    warned = F.exists("issues", lambda i: i["severity"] == "warning")
    return Tables(spark, sf_dir).catalog.select("path", rules.status_set(F.col("compatible"), warned, F.col("edited"), F.col("complete"), F.col("track_no") % 50 == 0).alias("status"))


@query("f15_natural_key", f"with {_VARIED.format('file_name')} select path, row_number() over (order by sort_key, path)::bigint as place from k")
def f15(spark, sf_dir):
    rows = Tables(spark, sf_dir).catalog.select("path", text.natural_key(_varied(F.col("file_name"))).alias("sort_key"))
    return filters.number_in_order(rows, F.col("sort_key"), F.col("path")).select("path", "place")


@query("f16_match_key", r"select doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g')) as match_key from documents")
def f16(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", text.match_key(F.col("text")).alias("match_key"))


@query("f21_name_hash", "select path, substr(sha256(file_name), 1, 16) as name_hash from cat")
def f21(spark, sf_dir):
    return Tables(spark, sf_dir).tracks.select("path", text.name_hash(F.col("path")).alias("name_hash"))
