"""Queries over catalogue maintenance and ordered membership."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from needledrop.functions import rules
from needledrop.operators import membership, sync
from needledrop.operators.catalog import effective
from needledrop.scratch import scratch_folder
from needledrop.sources.snapshots import Snapshot
from needledrop.plans.registry import Tables, query

KEPT = ["path", "library_dir", "mtime_ms", "size_bytes", "title", "artist", "bpm"]


def _disk(t: Tables):
    """What a listing finds: two thirds of the catalogue's files."""
    return t.tracks.filter("track_no % 3 <> 0").select("path", "mtime_ms", "size_bytes")


@query("a3_cached_identities", "select path, mtime_ms, size_bytes from tracks_prev where mtime_ms is not null and size_bytes is not null")
def a3(spark, sf_dir):
    return sync.identities(Tables(spark, sf_dir).tracks_prev)


@query("a4_valid_artifacts", "select a.path, a.mtime_ms, a.size_bytes, a.algo_version from (select path, mtime_ms, size_bytes, (track_no % 3)::int as algo_version from tracks) a join tracks_prev p using (path, mtime_ms, size_bytes) where a.algo_version = 1")
def a4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    artifacts = t.tracks.select("path", "mtime_ms", "size_bytes", (F.col("track_no") % 3).cast("int").alias("algo_version"))
    return sync.valid_artifacts(artifacts, t.tracks_prev, 1).select("path", "mtime_ms", "size_bytes", "algo_version")


@query("b1_upsert", """
select path, library_dir, mtime_ms, size_bytes, title, artist, bpm from tracks where track_no % 2 = 0
union all select path, library_dir, mtime_ms, size_bytes, title, artist, bpm from tracks_prev where path not in (select path from tracks where track_no % 2 = 0)""")
def b1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    now = t.tracks.filter("track_no % 2 = 0")
    batch = now.select(*KEPT, F.lit(2).alias("seq")).unionByName(now.select(*KEPT, F.lit(1).alias("seq")).withColumn("title", F.lit("stale")))
    return sync.upsert(t.tracks_prev.select(*KEPT), batch, "path", seq="seq")


def _snapshot(rows):
    return Snapshot(rows.sparkSession, f"{scratch_folder(rows.sparkSession)}/snapshot/{uuid.uuid4().hex}", rows.schema).create(rows)


@query("b1_snapshot_upsert", """
select path, library_dir, title from tracks where track_no % 2 = 0 and library_dir = '/lib/O' union all select path, library_dir, title from tracks_prev where library_dir <> '/lib/O' or path not in (select path from tracks where track_no % 2 = 0)""")
def b1_snapshot(spark, sf_dir):
    """Rows of one library put into the stored catalogue; the folders of the others are neither read nor written."""
    t = Tables(spark, sf_dir)
    snapshot = _snapshot(t.tracks_prev.select("path", "library_dir", "title"))
    snapshot.upsert(t.tracks.filter("track_no % 2 = 0 and library_dir = '/lib/O'").select("path", "library_dir", "title"), "path")
    return snapshot.read()


@query("b5_snapshot_prune", "select path, library_dir from tracks_prev where library_dir <> '/lib/F' or path in (select path from tracks where track_no % 3 <> 0)")
def b5_snapshot(spark, sf_dir):
    t = Tables(spark, sf_dir)
    snapshot = _snapshot(t.tracks_prev.select("path", "library_dir"))
    snapshot.prune(_disk(t), "/lib/F", full_sweep=True)
    return snapshot.read()


@query("b3_incremental_diff", """
select coalesce(d.path, p.path) as path, case when d.path is null then 'removed' when p.path is null then 'added' else 'kept' end as status
from (select path from tracks where track_no % 3 <> 0) d full join tracks_prev p on d.path = p.path""")
def b3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sync.diff_files(_disk(t), t.tracks_prev)


@query("b4_reuse_or_refresh", """
select d.path, d.mtime_ms, d.size_bytes, not coalesce(c.mtime_ms = d.mtime_ms and c.size_bytes = d.size_bytes, false) as refresh
from (select * from tracks where track_no % 3 <> 0) d left join tracks_prev c on c.path = d.path""")
def b4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sync.reuse_or_refresh(sync.identities(t.tracks_prev), _disk(t))


@query("b5_full_sweep_prune", "select path, library_dir from tracks_prev where library_dir <> '/lib/F' or path in (select path from tracks where track_no % 3 <> 0)")
def b5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sync.prune(t.tracks_prev, _disk(t), "/lib/F", full_sweep=True).select("path", "library_dir")


@query("b6_cascading_delete", """
select playlist_id, path, row_number() over (partition by playlist_id order by position)::bigint - 1 as position from playlist_items where path not in (select path from tracks where track_no % 5 = 1)""")
def b6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return membership.renumber(sync.delete_paths(t.playlist_items, t.tracks.filter("track_no % 5 = 1")))


@query("b7_relocate", """
select path, '/lib/F-new' || substr(path, 7) as target, track_no % 3 <> 1 and track_no % 4 <> 1 as moved from tracks where starts_with(path, '/lib/F/')
union all select '/lib/F-new' || substr(path, 7), null, null from tracks where false""")
def b7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    target = sync.relocated(F.col("path"), "/lib/F", "/lib/F-new")
    listing = t.tracks.filter("track_no % 3 <> 1").select(target.alias("path")).filter("path is not null")
    taken = t.tracks.filter("track_no % 4 = 1").select(target.alias("path")).filter("path is not null")
    return sync.relocation_moves(t.tracks.select("path").unionByName(taken), listing, "/lib/F", "/lib/F-new")


@query("b7_relocate_children", """
select i.playlist_id, case when t.track_no % 3 <> 1 and starts_with(path, '/lib/F/') then '/lib/F-new' || substr(path, 7) else path end as path, i.position from playlist_items i join tracks t using (path)""")
def b7_children(spark, sf_dir):
    t = Tables(spark, sf_dir)
    listing = t.tracks.filter("track_no % 3 <> 1").select(sync.relocated(F.col("path"), "/lib/F", "/lib/F-new").alias("path")).filter("path is not null")
    return sync.move_paths(t.playlist_items, sync.relocation_moves(t.tracks, listing, "/lib/F", "/lib/F-new"))


@query("b8_version_invalidation", "select path, null::bigint as mtime_ms, null::bigint as size_bytes, title from tracks_prev")
def b8(spark, sf_dir):
    return sync.invalidate_on_version_change(Tables(spark, sf_dir).tracks_prev, "3", "4").select("path", "mtime_ms", "size_bytes", "title")


_COALESCED = """
with c as (select path, arg_max(bpm, seq) filter (where bpm is not null) as bpm, arg_max(struct_pack(c := bpm_confidence), seq) filter (where bpm is not null) as conf,
  arg_max(key_pc, seq) filter (where key_pc is not null) as key_pc, bool_or(waveform) as waveform from patches group by path)
"""


@query("b9_apply_patches", _COALESCED + """
select t.path, coalesce(c.bpm, t.bpm) as bpm, case when c.bpm is not null then c.conf.c else t.bpm_confidence end as bpm_confidence, coalesce(c.key_pc, t.key_pc) as key_pc from tracks t left join c using (path)""")
def b9(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sync.apply_patches(t.tracks, sync.coalesce_patches(t.patches)).select("path", "bpm", "bpm_confidence", "key_pc")


@query("b10_build_patch", "select path, round(bpm, 2) as bpm, key_name, camelot from (select path, key_name, camelot from cat) join (select path, bpm * 1.0625 as bpm from tracks where bpm is not null) using (path)")
def b10(spark, sf_dir):
    return sync.build_patch(Tables(spark, sf_dir).tracks.filter("bpm is not null").withColumn("bpm", F.col("bpm") * 1.0625)).select("path", "bpm", "key_name", "camelot")


@query("b11_backlog", """
select path, bpm is null and track_no % 12 <> 0 as wants_tempo, track_no % 4 = 1 and track_no % 8 <> 1 as wants_grid, track_no % 9 = 0 as wants_key, track_no % 3 <> 0 as wants_waveform
from tracks where wants_tempo or wants_grid or wants_key or wants_waveform""")
def b11(spark, sf_dir):
    t, no = Tables(spark, sf_dir), F.col("track_no")
    rows = t.tracks.withColumns({"bpm_absent": no % 12 == 0, "beat_secs": F.when(no % 4 != 1, 0.5), "grid_absent": no % 8 == 1, "key_pc": F.when(no % 9 != 0, F.col("key_pc"))})
    return sync.backlog(rows, t.tracks.filter("track_no % 3 = 0"))


@query("b12_absence_verdict", "select path, case when track_no % 2 = 0 and track_no % 3 = 0 then case when bpm is null then 'v4' end else case when track_no % 5 = 0 then 'v3' end end as mark from tracks")
def b12(spark, sf_dir):
    no = F.col("track_no")
    mark = sync.absence_mark(no % 2 == 0, no % 3 == 0, F.col("bpm"), F.when(no % 5 == 0, "v3"), "v4")
    return Tables(spark, sf_dir).tracks.select("path", mark.alias("mark"))


@query("b13_merge_converted", """
select path, title from tracks where not (track_no % 8 = 3 and track_no % 3 <> 0) union all select replace(path, '.m4a', '.aiff'), title from tracks where track_no % 8 = 3 and track_no % 3 <> 0""")
def b13(spark, sf_dir):
    t = Tables(spark, sf_dir)
    done = t.tracks.filter("track_no % 8 = 3").select(F.col("path").alias("source"), F.replace("path", F.lit(".m4a"), F.lit(".aiff")).alias("output"), (F.col("track_no") % 3 != 0).alias("ok"), "title")
    fresh = done.filter("ok").select(F.col("output").alias("path"), "title")
    return sync.merge_converted(t.tracks.select("path", "title"), done, fresh)


@query("b14_merge_written", "select path, case when track_no % 4 = 0 then upper(artist) else artist end as artist, case when track_no % 4 = 0 then null else genre end as genre from tracks")
def b14(spark, sf_dir):
    t = Tables(spark, sf_dir).tracks.select("path", "artist", "genre", "track_no")
    back = t.filter("track_no % 4 = 0").select("path", F.upper("artist").alias("artist"), F.lit(None).cast("string").alias("genre"))
    return sync.merge_written(t, back).drop("track_no")


@query("b14_write_failures", "select count(*) filter (where track_no % 7 <> 0)::bigint as written, count(*) filter (where track_no % 7 = 0)::bigint as failed, min(case when track_no % 7 = 0 then path end) as first_failed from tracks")
def b14_failures(spark, sf_dir):
    ok = F.col("track_no") % 7 != 0
    return Tables(spark, sf_dir).tracks.agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("failed"), F.min(F.when(~ok, F.col("path"))).alias("first_failed"))


@query("b15_bulk_edit", "select path, title, 'House' as genre, null::varchar as label, year from eff where track_no % 23 = 0 or track_no % 10 = 1")
def b15(spark, sf_dir):
    t = Tables(spark, sf_dir)
    chosen = t.tracks.filter("track_no % 23 = 0 or track_no % 10 = 1")
    return sync.bulk_edit(effective(t.tracks, t.edits), chosen, {"genre": "House", "label": ""}).select("path", "title", "genre", "label", "year")


_UNDO = "path string, title string, genre string"


def _undo(t: Tables):
    writes = t.tracks.filter("track_no % 97 < 5").select((F.col("track_no") % 97).alias("undo_id"), "path")
    return sync.capture_before(t.tracks, writes, ["title", "genre"])


@query("b16_before_images", """
select track_no % 97 as undo_id, count(*)::bigint as items, min(path) as first_path, count(title)::bigint as titled from tracks where track_no % 97 < 5 group by 1""")
def b16(spark, sf_dir):
    groups = _undo(Tables(spark, sf_dir)).withColumn("i", F.from_json("payload", f"array<struct<{_UNDO.replace(' string', ':string')}>>"))
    return groups.select("undo_id", "items", F.array_min("i.path").alias("first_path"), F.size(F.filter("i", lambda x: x["title"].isNotNull())).cast("bigint").alias("titled"))


@query("b17_undo_restore", "select path, case when track_no % 97 = 3 then title else 'changed' end as title, case when track_no % 97 = 3 then genre else 'changed' end as genre from tracks")
def b17(spark, sf_dir):
    t = Tables(spark, sf_dir)
    groups = _undo(t).withColumn("payload", F.when(F.col("undo_id") == 4, "not json").otherwise(F.col("payload")))
    now = t.tracks.select("path", F.lit("changed").alias("title"), F.lit("changed").alias("genre"))
    return sync.overlay(now, sync.latest_undo(groups, f"array<struct<{_UNDO.replace(' string', ':string')}>>"))


@query("b16_undo_retention", "select undo_id, items from (select track_no % 97 as undo_id, count(*)::bigint as items from tracks group by 1) order by undo_id desc limit 20")
def b16_retention(spark, sf_dir):
    t = Tables(spark, sf_dir).tracks
    return sync.retain_undo(sync.capture_before(t, t.select((F.col("track_no") % 97).alias("undo_id"), "path"), ["title"])).select("undo_id", "items")


@query("b17_undo_pop", "select distinct track_no % 97 as undo_id from tracks where track_no % 97 < 3")
def b17_pop(spark, sf_dir):
    """Of groups 0 to 4 the newest is unreadable: 3 is restored, and both go."""
    groups = _undo(Tables(spark, sf_dir)).withColumn("payload", F.when(F.col("undo_id") == 4, "not json").otherwise(F.col("payload")))
    return sync.pop_undo(groups, f"array<struct<{_UNDO.replace(' string', ':string')}>>").select("undo_id")


@query("b18_import_scope", "select path from tracks where starts_with(path, '/lib/O/')")
def b18(spark, sf_dir):
    return Tables(spark, sf_dir).tracks.filter(sync.inside("/lib/O/", F.col("path"))).select("path")


@query("b19_pending_edits", """
select path, case when track_no % 92 = 0 then 'Newer' else 'Edited ' || cast(track_no as varchar) end as title from tracks where track_no % 23 = 0 and track_no % 69 <> 0""")
def b19(spark, sf_dir):
    t = Tables(spark, sf_dir)
    stored = t.edits.select("path", F.to_json(F.struct("title")).alias("payload"))
    newer = t.tracks.filter("track_no % 92 = 0").select("path", F.to_json(F.struct(F.lit("Newer").alias("title"))).alias("payload"))
    broken = t.tracks.filter("track_no % 69 = 0").select("path", F.lit("{broken").alias("payload"))
    rows = sync.upsert(sync.upsert(stored, newer, "path"), broken, "path")
    return rows.select("path", F.from_json("payload", "title string").alias("m")).filter("m.title is not null").select("path", "m.title")


@query("b20_artifact_put", "select path, mtime_ms, (case when track_no % 2 = 0 then 2 else 1 end)::int as algo_version from tracks")
def b20(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old = t.tracks.select("path", "mtime_ms", F.lit(1).alias("algo_version"))
    return sync.upsert(old, t.tracks.filter("track_no % 2 = 0").select("path", "mtime_ms", F.lit(2).alias("algo_version")), "path")


_LISTS = "select playlist_id, list(path order by path desc) as paths from (select playlist_id, path from playlist_items where playlist_id = 2 union all select 5, '/lib/none/' || playlist_id from playlist_items where position = 0 union all select 5, path from playlist_items where position = 1) group by 1"


@query("g1_replace_contents", f"""
with lists as ({_LISTS}), n as (select playlist_id, unnest(paths) as path, generate_subscripts(paths, 1)::bigint - 1 as position from lists)
select playlist_id, path, position from playlist_items where playlist_id not in (2, 5) union all select n.playlist_id, n.path, n.position from n where path in (select path from tracks)""")
def g1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    items = t.playlist_items
    wanted = items.filter("playlist_id = 2").select("playlist_id", "path")
    five = F.lit(5).cast("bigint").alias("playlist_id")
    wanted = wanted.unionByName(items.filter("position = 0").select(five, F.concat(F.lit("/lib/none/"), F.col("playlist_id").cast("string")).alias("path"))).unionByName(items.filter("position = 1").select(five, "path"))
    lists = wanted.groupBy("playlist_id").agg(F.sort_array(F.collect_list("path"), asc=False).alias("paths"))
    return membership.replace_contents(items, lists, t.tracks)


_ADDED = "select track_no % 4 + 1 as playlist_id, path, track_no as ordinal from tracks where track_no % 10 in (2, 3)"


@query("g2_append_new", f"""
with a as ({_ADDED}), f as (select * from a where (playlist_id, path) not in (select playlist_id, path from playlist_items)), n as (select playlist_id, count(*) as n from playlist_items group by 1)
select playlist_id, path, position from playlist_items
union all select f.playlist_id, f.path, coalesce(n.n, 0) + row_number() over (partition by f.playlist_id order by ordinal)::bigint - 1 from f left join n using (playlist_id)""")
def g2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    added = t.tracks.filter("track_no % 10 in (2, 3)").select((F.col("track_no") % 4 + 1).alias("playlist_id"), "path", F.col("track_no").alias("ordinal"))
    return membership.append_new(t.playlist_items, added.unionByName(added.withColumn("ordinal", F.col("ordinal") + 1000000)))


@query("g2_gain_count", f"with a as ({_ADDED}) select playlist_id, count(*)::bigint as gained from a where (playlist_id, path) not in (select playlist_id, path from playlist_items) group by 1")
def g2_gain(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return membership.gained(t.playlist_items, t.tracks.filter("track_no % 10 in (2, 3)").select((F.col("track_no") % 4 + 1).alias("playlist_id"), "path"))


@query("g3_remove_paths", "select playlist_id, path, row_number() over (partition by playlist_id order by position)::bigint - 1 as position from playlist_items where position % 3 <> 1")
def g3(spark, sf_dir):
    items = Tables(spark, sf_dir).playlist_items
    return membership.remove_paths(items, items.filter("position % 3 = 1").select("playlist_id", "path"))


@query("g4_dense_renumber", "select playlist_id, path, row_number() over (partition by playlist_id order by position)::bigint - 1 as position from playlist_items where position % 2 = 0")
def g4(spark, sf_dir):
    return membership.renumber(Tables(spark, sf_dir).playlist_items.filter("position % 2 = 0"))


_MOVED = """
with b as (select *, position between 10 and 14 and playlist_id <> 4 as in_block from playlist_items),
k as (select *, case when in_block and playlist_id = 1 then 1000000000 when in_block and playlist_id = 2 then 3 else position end as major, case when in_block and playlist_id in (1, 2) then 0 else 1 end as minor from b)
select playlist_id, path, row_number() over (partition by playlist_id order by major, minor, position)::bigint - 1 as position from k"""


@query("g5_move_block", _MOVED)
def g5(spark, sf_dir):
    """Playlist 1 moves a block to the end, 2 before position 3, 3 before a member of the block (no change), 4 not at all."""
    items = Tables(spark, sf_dir).playlist_items
    blocks = items.filter("position between 10 and 14 and playlist_id <> 4").groupBy("playlist_id").agg(F.collect_list("path").alias("block"))
    anchor = items.filter("(playlist_id = 2 and position = 3) or (playlist_id = 3 and position = 12)").select("playlist_id", F.col("path").alias("anchor"))
    return membership.move_block(items, blocks.join(anchor, "playlist_id", "left"))


@query("g6_delete_playlists", "select playlist_id, path, position from playlist_items where playlist_id not in (select id from playlists where name in ('BUILDING', 'MACHINERY'))")
def g6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return membership.drop_playlists(t.playlists, t.playlist_items, t.playlists.filter("name in ('BUILDING', 'MACHINERY')"))[1].select("playlist_id", "path", "position")


@query("f17_conversion_plan", r"""
with p as (select *, ['aiff', 'wav', 'flac', 'alac', 'mp3', 'aac'][(track_no % 6) + 1] as target, bits_per_sample > 16 as deep from cat where not compatible)
select path, target, case when sample_rate in (44100, 48000) then sample_rate else 44100 end::int as target_rate,
  case target when 'aiff' then case when deep then 'pcm_s24be' else 'pcm_s16be' end when 'wav' then case when deep then 'pcm_s24le' else 'pcm_s16le' end when 'mp3' then 'libmp3lame' else target end as codec,
  case when target in ('aiff', 'wav', 'flac', 'alac') then case when deep then 24 else 16 end end::int as target_bits, case when target in ('mp3', 'aac') then 320 end::int as kbps,
  regexp_replace(path, '[^/]*$', '') || trim(regexp_replace(regexp_replace(file_name, '\.[^.]*$', ''), '[/\\:*?"<>|\x00-\x1F\x7F]', '_', 'g')) || '.' || case when target in ('alac', 'aac') then 'm4a' else target end as output, output = path as in_place from p""")
def f17(spark, sf_dir):
    rows = Tables(spark, sf_dir).catalog.filter("not compatible")
    target = F.get(F.array(*map(F.lit, rules.TARGET_FORMATS)), (F.col("track_no") % 6).cast("int"))
    return rules.conversion_plan(rows.withColumn("target", target)).select("path", "target", "target_rate", "codec", "target_bits", "kbps", "output", "in_place")


@query("f18_collision_free_names", """
with n as (select path, track_no, regexp_replace(path, '/[^/]*$', '') as dir, 'track-' || (track_no % 50) as stem from tracks), r as (select *, row_number() over (partition by dir, stem order by path) as i from n),
e as (select distinct dir, stem, case when track_no % 3 = 0 then 2 else 1 end as t from n where track_no % 7 = 0), h as (select *, t - row_number() over (partition by dir, stem order by t) as at from e),
k as (select path, r.dir, r.stem, i + count(h.at) as k from r left join h on h.dir = r.dir and h.stem = r.stem and h.at < i group by path, r.dir, r.stem, i)
select path, dir || '/' || stem || case when k > 1 then ' (' || k || ')' else '' end || '.aiff' as target from k""")
def f18(spark, sf_dir):
    from needledrop.functions import text
    from needledrop.operators.naming import free_names

    t = Tables(spark, sf_dir).tracks
    wanted = t.select("path", text.parent_folder(F.col("path")).alias("dir"), F.concat(F.lit("track-"), (F.col("track_no") % 50).cast("string")).alias("stem"), F.lit("aiff").alias("ext"), "track_no")
    number = F.when(F.col("track_no") % 3 == 0, " (2)").otherwise("")
    there = wanted.filter("track_no % 7 = 0").select(F.concat("dir", F.lit("/"), "stem", number, F.lit(".aiff")).alias("path"))
    return free_names(wanted, there).select("path", "target")
