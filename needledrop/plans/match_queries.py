"""Queries of the duplicate search, the matching operators and the JSON sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.operators import dedupe, matching
from needledrop.plans.registry import Tables, query
from needledrop.scratch import materialise, scratch_folder
from needledrop.sources import json_sources

_NORM = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_TOKENS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) >= 2 and not regexp_matches(w, '^\p{{N}}+$') and w not in ('aiff', 'aif', 'wav', 'flac', 'alac', 'm4a', 'mp3', 'aac', 'ogg', 'opus', 'wma')))"
#: Views of the checking SQL.
VIEWS = {
    "band": "select a.path as a, b.path as b from doc_candidates a join doc_candidates b on a.path < b.path and abs(a.duration_secs - b.duration_secs) <= 1.0",
    "toks": f"select path, {_TOKENS.format('name')} as t from doc_candidates",
    "name_links": "select band.a, band.b from band join toks x on x.path = band.a join toks y on y.path = band.b where len(list_intersect(x.t, y.t)) >= 2 and len(list_intersect(x.t, y.t)) / len(list_distinct(x.t || y.t)) >= 0.85",
    "meta_links": r"""
select * from (select lag(path) over w as a, path as b, duration_secs - lag(duration_secs) over w as gap from (
  select path, duration_secs, trim(regexp_replace(lower(coalesce(nullif(trim(album_artist), ''), artist, '')), '[^\p{L}\p{N}]+', ' ', 'g')) as ka,
    trim(regexp_replace(lower(regexp_replace(ltrim(coalesce(title, string_split(path, '/')[-1])), '^[0-9]{1,3}[ ._-]+', '')), '[^\p{L}\p{N}]+', ' ', 'g')) as full_title,
    full_title as kt, artist from tracks)
  where ka <> '' and kt <> '' window w as (partition by ka, kt order by duration_secs, path)) where gap <= 4""",
    "meta_parts": """
select n as node, min(m) as component from (with recursive r as (select a as n, b as m from meta_links union select b, a from meta_links union select r.n, e.m from r join (select a as k, b as m from meta_links union all select b, a from meta_links) e on e.k = r.m)
  select n, m from r union all select distinct n, n from r) group by n""",
    "dup": """
select p.component, t.path, t.size_bytes, min(t.path) over c as group_id, count(*) over c as members,
  first_value(t.path) over (partition by p.component order by t.lossless desc, t.sample_rate desc, t.bits_per_sample desc, t.size_bytes desc, t.path desc) as keep
from tracks t join meta_parts p on p.node = t.path window c as (partition by p.component)""",
}


def dup(name, sql=None):
    return query(name, sql, VIEWS)


def _links(t: Tables):
    return dedupe.metadata_edges(dedupe.candidates(t.tracks))


def _groups(t: Tables):
    rows = t.tracks
    return materialise(dedupe.assemble(rows, dedupe.metadata_components(dedupe.candidates(rows))))


@dup("d1_candidates", "select path, case when trim(title) <> '' then title else string_split(path, '/')[-1] end as name from tracks")
def d1(spark, sf_dir):
    return dedupe.candidates(Tables(spark, sf_dir).tracks).select("path", "name")


@dup("d2_duration_band_pairs", "select a, b from band")
def d2(spark, sf_dir):
    return dedupe.band_pairs(Tables(spark, sf_dir).doc_candidates)


@dup("d3_metadata_tier", "select a, b from meta_links")
def d3(spark, sf_dir):
    return _links(Tables(spark, sf_dir))


@dup("d4_name_tier", "select a, b from name_links")
def d4(spark, sf_dir):
    return dedupe.name_edges(Tables(spark, sf_dir).doc_candidates)


_NAME_PARTS = """with recursive r as (select a as n, b as m from name_links union select b, a from name_links union select r.n, e.m from r join (select a as k, b as m from name_links union all select b, a from name_links) e on e.k = r.m),
parts as (select n as node, least(n, min(m)) as component from r group by n)
"""


#: Fingerprints, one node for each of them and length, pairs that share half of the shorter one's values, and which of these the names have not connected.
_CONTENT = _NAME_PARTS + r""", w as materialized (select path, name, doc_id, duration_secs as v, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from doc_candidates),
f as materialized (select * exclude w, list_transform(range(1, len(w) + 1), lambda i: ('0x' || left(md5(w[i] || ' ' || coalesce(w[i + 1], '')), 8))::bigint) as fp, list_distinct(fp) as s, min(path) over (partition by w, v) as rep from w where len(w) > 0),
near as materialized (select band.a, band.b from band join f x on x.path = band.a join f y on y.path = band.b where x.path = x.rep and y.path = y.rep),
work as materialized (select c.a, c.b from (
  select a, b from near join f x on x.path = a join f y on y.path = b where len(list_intersect(x.s, y.s)) >= ceil(0.5 * least(len(x.s), len(y.s)))
  union all select rep, path from f where path <> rep) c left join parts p on p.node = c.a left join parts q on q.node = c.b where p.component is null or q.component is null or p.component <> q.component)
"""


def _content(t: Tables, stored: bool = False):
    """Documents with fingerprints, ``stored`` where these are read again, and the pairs of them that are left for the content tier."""
    docs = dedupe.with_fingerprint(t.doc_candidates)
    docs = materialise(docs.select("path", "name", "duration_secs", "fp")) if stored else docs
    return docs, dedupe.content_pairs(docs, parts=materialise(dedupe.name_components(t.doc_candidates)))


@dup("d5_content_work_list", _CONTENT + "select a, b from work")
def d5(spark, sf_dir):
    return _content(Tables(spark, sf_dir))[1]


@dup("d6_fingerprint_cache_split", _CONTENT + "select path, doc_id % 3 = 0 as cached from (select a as path from work union select b from work) join doc_candidates using (path)")
def d6(spark, sf_dir):
    docs, work = _content(Tables(spark, sf_dir))
    return dedupe.split_cached(dedupe.files_needed(work), docs.filter("doc_id % 3 = 0"))


@dup("d7_content_tier", _CONTENT + r""",
same as materialized (select a, b from work join f x on x.path = a join f y on y.path = b where x.fp = y.fp),
unequal as materialized (select a, b from work except select a, b from same),
o as materialized (select path, value, min(pos) as pos from (select path, unnest(fp) as value, unnest(range(len(fp))) as pos from f) group by all having count(*) = 1),
n as (select a, b, i, d, sum(case when i - p <= 8 then 0 else 1 end) over (partition by a, b, d order by i) as run from (
  select a, b, x.pos as i, x.pos - y.pos as d, lag(x.pos) over (partition by a, b, x.pos - y.pos order by x.pos) as p from unequal join o x on x.path = a join o y on y.path = b and y.value = x.value)),
g as (select a, b, d, min(i) as i0, max(i) as i1 from n group by a, b, d, run having count(*) >= 3),
e as (select g.a, g.b, d, i0, i1, unnest(range(greatest(i0 - 8, d, 0), least(i1 + 8, len(x.fp) - 1, len(y.fp) - 1 + d) + 1)) as i from g join f x on x.path = g.a join f y on y.path = g.b),
z as (select e.a, e.b, case when len(x.fp) <= len(y.fp) then i else i - d end as pos, min(bit_count(xor(x.fp[i + 1], y.fp[i - d + 1]))) as bits, any_value(least(len(x.fp), len(y.fp))) as shorter
  from e join f x on x.path = e.a join f y on y.path = e.b where i between i0 and i1 or x.fp[i + 1] = y.fp[i - d + 1] group by 1, 2, 3),
sc as (select a, b, avg(bits) as score, count(*) / any_value(shorter) as coverage from z group by a, b union all select a, b, 0, 1 from same)
select a, b, round(score, 6) as score, coverage from (select sc.*, len(list_intersect(x.t, y.t)) / nullif(len(list_distinct(x.t || y.t)), 0) as overlap from sc join toks x on x.path = a join toks y on y.path = b)
where score <= 5 and coverage >= 0.7 and ((score <= 3 and coverage >= 0.9) or coalesce(overlap, 0) >= 0.5)""")
def d7(spark, sf_dir):
    docs, work = _content(Tables(spark, sf_dir), stored=True)
    return dedupe.content_edges(work, docs).withColumn("score", F.round("score", 6))


@dup("d8_connected_components", "select node, component from meta_parts")
def d8(spark, sf_dir):
    """Components of the metadata links; these are runs of bands of lengths, so no rounds over links are needed."""
    return dedupe.metadata_components(dedupe.candidates(Tables(spark, sf_dir).tracks))


@dup("d9_group_assembly", "select group_id, path, size_bytes, keep, members::bigint as members from dup")
def d9(spark, sf_dir):
    return _groups(Tables(spark, sf_dir))


@dup("d10_dismissals", "select group_id, path from dup where group_id not in (select d.group_id from dup d where hash_pick(d.group_id))".replace("hash_pick(d.group_id)", "strlen(d.group_id) % 3 = 0"))
def d10(spark, sf_dir):
    g = _groups(Tables(spark, sf_dir))
    return dedupe.drop_dismissed(g, g.filter("octet_length(group_id) % 3 = 0").select("group_id")).select("group_id", "path")


@dup("d11_result_swap", "select group_id, max(members)::bigint as members from dup group by group_id")
def d11(spark, sf_dir):
    """The new result as it reads back after it has replaced an older one."""
    groups, folder = _groups(Tables(spark, sf_dir)), f"{scratch_folder(spark)}/duplicates/{uuid.uuid4().hex}"
    dedupe.swap_groups(groups.filter("members > 2").withColumn("keep", F.lit("old")), folder)
    kept = dedupe.swap_groups(groups, folder)
    return kept.groupBy("group_id").agg(F.max("members").alias("members"))


@dup("d12_group_pruning", """
with v as (select *, count(*) over (partition by group_id) as n, bool_or(path = keep) over (partition by group_id) as has_keep, min(path) over (partition by group_id) as first_path from dup join (select path as p from tracks where track_no % 4 <> 1) x on x.p = path)
select group_id, path, n::bigint as members, case when has_keep then keep else first_path end as keep from v where n >= 2""")
def d12(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return dedupe.prune_groups(_groups(t), t.tracks.filter("track_no % 4 <> 1")).select("group_id", "path", "members", "keep")


def _scene(t: Tables):
    """Two rips of the same albums: four of five tracks again in a lossy folder, of some albums a few only."""
    base = t.tracks.select("path", "title", "lossless", "size_bytes", "track_no")
    copy = base.filter("track_no % 5 <> 1 and (track_no % 200 > 40 or track_no % 97 = 3)").select(F.replace("path", F.lit("/lib/"), F.lit("/rip/")).alias("path"), F.concat(F.lit("01 "), "title").alias("title"), F.lit(False).alias("lossless"), (F.col("size_bytes") - 1).alias("size_bytes"), "track_no")
    rows = base.unionByName(copy)
    groups = copy.select(F.col("track_no").cast("string").alias("group_id"), F.explode(F.array(F.replace("path", F.lit("/rip/"), F.lit("/lib/")), "path")).alias("path"))
    return rows, groups.join(rows.select("path", "size_bytes"), "path")


_SCENE = r"""
with base as (select path, title, lossless, size_bytes, track_no from tracks),
cp as (select replace(path, '/lib/', '/rip/') as path, '01 ' || title as title, false as lossless, size_bytes - 1 as size_bytes, track_no from base where track_no % 5 <> 1 and (track_no % 200 > 40 or track_no % 97 = 3)),
rws as (select *, regexp_replace(path, '/[^/]*$', '') as folder from (select * from base union all select * from cp)),
g as (select track_no::varchar as group_id, unnest([replace(path, '/rip/', '/lib/'), path]) as path from cp),
m as (select g.group_id, r.path, r.folder, r.lossless, r.title, r.size_bytes from g join rws r using (path)),
l as (select x.folder as a, y.folder as b from m x join m y on x.group_id = y.group_id and x.folder < y.folder group by 1, 2 having count(*) >= 2),
parts as (select a as folder, a as cluster from l union select b, a from l),
facts as (select folder, min(lossless) as lossless, count(distinct path) as n, avg(length(coalesce(title, ''))) as mean_title, sum(size_bytes) as bytes from m group by folder),
k as (select folder, cluster, row_number() over (partition by cluster order by lossless desc, n desc, mean_title, bytes desc, folder) = 1 as keep, n::bigint as tracks from parts join facts using (folder))
"""


@dup("d13_album_clusters", _SCENE + "select folder, cluster, keep, tracks from k")
def d13(spark, sf_dir):
    rows, groups = _scene(Tables(spark, sf_dir))
    return dedupe.album_clusters(groups, rows)


@dup("d14_delete_set", _SCENE + "select distinct m.group_id, m.path, m.size_bytes from m join k using (folder) where not keep")
def d14(spark, sf_dir):
    rows, groups = _scene(Tables(spark, sf_dir))
    return dedupe.delete_set(groups, dedupe.album_clusters(groups, rows))


@dup("d14_savings", "select count(*)::bigint as files, coalesce(sum(size_bytes), 0)::bigint as bytes from dup where path <> keep")
def d14_savings(spark, sf_dir):
    return dedupe.savings(_groups(Tables(spark, sf_dir)))


@dup("d15_lone_groups", _SCENE + "select group_id, path from m where group_id in (select group_id from m where folder not in (select folder from k))")
def d15(spark, sf_dir):
    rows, groups = _scene(Tables(spark, sf_dir))
    return dedupe.lone_groups(groups, dedupe.album_clusters(groups, rows)).select("group_id", "path")


@dup("d16_folders_to_prune", r"select distinct regexp_replace(path, '/[^/]*$', '') as folder from tracks where track_no % 40 < 39 and regexp_replace(path, '/[^/]*$', '') not in (select regexp_replace(path, '/[^/]*$', '') from tracks where track_no % 40 = 39)")
def d16(spark, sf_dir):
    t = Tables(spark, sf_dir).tracks
    return dedupe.folders_to_prune(t.filter("track_no % 40 < 39"), t.filter("track_no % 40 = 39"))


@dup("d17_exclusive_folders", r"""
with p as (select path, track_no % 40 < 39 as hit, list_filter(string_split(substr(path, 6), '/'), lambda x: x <> '') as parts from tracks), a as (select *, unnest(range(0, len(parts))) as depth from p)
select case when depth = 0 then '/lib' else '/lib/' || array_to_string(parts[1:depth], '/') end as folder, count(*)::bigint as files from a group by 1 having bool_and(hit)""")
def d17(spark, sf_dir):
    t = Tables(spark, sf_dir).tracks
    return dedupe.exclusive_folders(t, t.filter("track_no % 40 < 39"), "/lib")


_KEY = r"trim(regexp_replace(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
MATCH_VIEWS = {
    "ck": rf"select path, track_no, {_KEY.format('coalesce(artist, chr(32))')} as a, {_KEY.format(chr(39) + chr(39) + ' || ' + 'regexp_replace(string_split(path, chr(47))[-1], ' + chr(39) + chr(92) + '.[^.]*$' + chr(39) + ', ' + chr(39) + chr(39) + ')')} as k0, {_KEY.format('string_split(path, chr(47))[-2]')} as k1, {_KEY.format('coalesce(album, chr(32))')} as k2, {_KEY.format('coalesce(title, chr(32))')} as k3 from tracks",
    "ik": rf"select item_key, {_KEY.format('title')} as k, {_KEY.format('coalesce(band_name, chr(32))')} as b from purchases",
    "hits": "select distinct path, item_key from ck join ik on k <> '' and (k = k0 or k = k1 or ((k = k2 or k = k3) and (a = '' or b = '' or contains(a, b) or contains(b, a))))",
    "ledger": "select item_key, list(path order by path) as paths from (select case when track_no % 2 = 0 then 'p' || (track_no // 100 * 50) else 'x' || (track_no % 500) end as item_key, path from tracks where track_no % 37 = 0) group by 1",
    "itm": "select item_key, row_number() over (order by item_key)::bigint as ordinal from purchases",
}


def match(name, sql=None):
    return query(name, sql, MATCH_VIEWS)


def _ledger(t: Tables):
    no = F.col("track_no")
    key = F.when(no % 2 == 0, F.concat(F.lit("p"), (F.floor(no / 100) * 50).cast("string"))).otherwise(F.concat(F.lit("x"), (no % 500).cast("string")))
    return t.tracks.filter(no % 37 == 0).select(key.alias("item_key"), "path").groupBy("item_key").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def _items(t: Tables):
    # a purchase list's own order; here it is that of its keys
    return t.purchases.withColumn("ordinal", F.col("item_key"))


@match("m1_purchase_matches", "select path, item_key from hits")
def m1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return matching.purchase_matches(t.tracks, t.purchases)


@match("m2_collection_origins", """
select path, arg_max(item_key, ordinal) as item_key from (select path, item_key from hits union select l.path, l.item_key from (select item_key, unnest(paths) as path from ledger) l join tracks using (path)) join itm using (item_key) group by path""")
def m2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    items = _items(t)
    return matching.track_origins(matching.latest_matches(t.tracks, items), _ledger(t), t.tracks, items)


@match("m2_item_presence", "select item_key, item_key in (select item_key from hits) or item_key in (select item_key from ledger) as present from purchases")
def m2_items(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return matching.item_presence(t.purchases, matching.matched_items(t.tracks, t.purchases), _ledger(t))


@match("m3_prune_ledger", "select item_key, list(path order by path) as paths from (select item_key, unnest(paths) as path from ledger) where path not in (select path from tracks where track_no % 3 = 1) group by 1")
def m3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return matching.prune_ledger(_ledger(t), t.tracks.filter("track_no % 3 = 1"))


#: Rows that are put together in one document: documents stay of one size as the catalogue grows.
PAGE = 500


def _page():
    return F.floor(F.col("track_no") / PAGE).alias("page")


def _releases(t: Tables):
    """Release searches as JSON, pages of a label each, from the catalogue's own rows."""
    rows = t.tracks.filter("label is not null")
    result = F.struct(F.array("album_artist").alias("style"), F.array("genre").alias("genre"), F.substring("year", -4, 4).alias("year"), F.array("artist").alias("label"))
    grouped = rows.groupBy("label", _page()).agg(F.transform(F.array_sort(F.collect_list(F.struct("track_no", result.alias("r")))), lambda x: x["r"]).alias("results"))
    return grouped.select("label", "page", F.to_json(F.struct("results")).alias("json"))


@match("m4_field_suggestions", """
with r as (select *, row_number() over (partition by label order by track_no) as k from tracks where label is not null),
v as (select label, 'genre' as field, 0 as s, k, album_artist as value from r union all select label, 'genre', 1, k, genre from r union all select label, 'year', 0, k, right(year, 4) from r union all select label, 'label', 0, k, artist from r),
f as (select label, field, lower(trim(value)) as folded, min(s * 1000000000000 + k) as rank, arg_min(trim(value), s * 1000000000000 + k) as value from v where trim(value) <> '' group by 1, 2, 3)
select label, field, list(value order by rank) as suggestions from (select * from f qualify row_number() over (partition by label, field order by rank) <= 8) group by 1, 2""")
def m4(spark, sf_dir):
    return matching.first_spellings(json_sources.release_values(_releases(Tables(spark, sf_dir)), "label", order="page"), "label")


def _recordings(t: Tables):
    """Recording searches as JSON, one document a page of rows, from the catalogue's own rows."""
    rows = t.tracks
    tags = F.array(F.struct(F.lit("first").alias("name"), (F.col("track_no") % 3).cast("int").alias("count")), F.struct(F.trim("genre").alias("name"), F.lit(1).alias("count")))
    r = F.struct(
        F.col("track_no").cast("string").alias("id"), "title", F.array(F.struct(F.col("artist").alias("name"))).alias("artist-credit"),
        F.array(F.struct(F.concat(F.lit("r"), F.col("track_no").cast("string")).alias("id"), F.col("album").alias("title"), F.when(F.col("track_no") % 5 > 0, F.lit("1999-01-01")).alias("date"))).alias("releases"),
        tags.alias("tags"), F.when(F.col("track_no") % 7 > 0, (F.col("track_no") % 100).cast("int")).alias("score"),
    )
    return rows.groupBy(_page()).agg(F.collect_list(r).alias("recordings")).select(F.to_json(F.struct("recordings")).alias("json"))


@match("a9_recording_candidates", """
select track_no::varchar as recording_id, title, artist, album, 'r' || track_no as release_id, case when track_no % 5 > 0 then '1999' end as year, case when track_no % 3 = 2 then 'first' else trim(genre) end as genre,
  case when track_no % 7 > 0 then track_no % 100 else 0 end::int as score from tracks""")
def a9(spark, sf_dir):
    return json_sources.recordings(_recordings(Tables(spark, sf_dir)))


@match("m5_candidate_lookup", f"""
with q as (select path, {_NORM.format('title')} as kt, {_NORM.format("case when track_no % 3 = 0 then '' else artist end")} as ka from tracks),
r as (select track_no::varchar as recording_id, case when track_no % 7 > 0 then track_no % 100 else 0 end::int as score, {_NORM.format('title')} as kt, {_NORM.format('artist')} as ka from tracks),
r1 as (select *, row_number() over (partition by kt order by score desc, recording_id) as k from r qualify k <= 5), r2 as (select *, row_number() over (partition by kt, ka order by score desc, recording_id) as k from r qualify k <= 5)
select path, recording_id, score, k::bigint as place from q join r1 on q.kt = r1.kt and q.ka = '' where q.kt <> '' union all select path, recording_id, score, k::bigint from q join r2 on q.kt = r2.kt and q.ka = r2.ka where q.kt <> '' and q.ka <> ''""")
def m5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    queries = t.tracks.select("path", "title", F.when(F.col("track_no") % 3 != 0, F.col("artist")).alias("artist"))
    return matching.lookup_candidates(queries, json_sources.recordings(_recordings(t)))


@match("m6_filename_guess", r"""
select path, (track_no % 20 + 1)::int as guess_number, artist as guess_artist, nullif(trim(regexp_replace(trim(string_split(path, '/')[-2]), '^[0-9 ()\[\]\-_.]+', '')), '') as guess_album,
  regexp_replace(string_split(string_split(path, '/')[-1], ' - ')[3], '\.[^.]*$', '') as guess_title from tracks""")
def m6(spark, sf_dir):
    return matching.guess_from_name(Tables(spark, sf_dir).tracks)


@match("m7_cover_availability", r"""
with i as (select regexp_replace(path, '/[^/]*$', '') as folder, regexp_replace(path, '/[^/]*$', '') || '/' || case track_no % 4 when 0 then 'Cover.JPG' when 1 then 'back.png' when 2 then 'notes.txt' else 'a.jpg' end as file from tracks where track_no % 100 < 2),
c as (select folder, arg_min(file, (case when contains(lower(file), 'cover') then 0 else 1 end)::varchar || file) as cover from i where not file like '%.txt' group by 1)
select path, track_no % 9 = 0 or cover is not null as available, cover from (select *, regexp_replace(path, '/[^/]*$', '') as folder from tracks) left join c using (folder)""")
def m7(spark, sf_dir):
    t, pick = Tables(spark, sf_dir).tracks, F.col("track_no") % 4
    name = F.when(pick == 0, "Cover.JPG").when(pick == 1, "back.png").when(pick == 2, "notes.txt").otherwise("a.jpg")
    inventory = t.filter("track_no % 100 < 2").select(F.concat(text.parent_folder(F.col("path")), F.lit("/"), name).alias("path"))
    return matching.cover_availability(t.withColumn("has_cover", F.col("track_no") % 9 == 0), matching.folder_covers(inventory))


@match("a7_json_snapshot", "select library_dir, count(*)::bigint as tracks, count(*) filter (where track_no % 23 = 0)::bigint as edits, count(*) filter (where track_no % 31 = 0)::bigint as groups, count(bpm)::bigint as with_bpm from tracks group by 1")
def a7(spark, sf_dir):
    """Snapshots written as JSON, pages of a folder each, and their parts counted as they come back."""
    t, no = Tables(spark, sf_dir).tracks, F.col("track_no")
    docs = t.groupBy("library_dir", _page()).agg(
        F.collect_list(F.struct("path", "title", "bpm")).alias("tracks"), F.map_from_entries(F.collect_list(F.when(no % 23 == 0, F.struct("path", F.struct(F.lit("new").alias("title")))))).alias("edits"),
        F.collect_list(F.when(no % 31 == 0, F.struct(F.col("path").alias("id"), F.col("path").alias("keep"), F.array("path").alias("files")))).alias("duplicates"),
    )
    snap = json_sources.snapshot(docs.drop("page").select(F.to_json(F.struct("*")).alias("json")))
    folder = F.concat(F.lit("/lib/"), F.split_part(F.col("path"), F.lit("/"), F.lit(3)))
    tracks = json_sources.snapshot_tracks(snap).groupBy("library_dir").agg(F.count("*").alias("tracks"), F.count("bpm").alias("with_bpm"))
    edits = json_sources.snapshot_edits(snap).groupBy(folder.alias("library_dir")).agg(F.count("*").alias("edits"))
    groups = json_sources.snapshot_groups(snap).withColumnRenamed("id", "path").groupBy(folder.alias("library_dir")).agg(F.count("*").alias("groups"))
    return tracks.join(edits, "library_dir").join(groups, "library_dir").select("library_dir", "tracks", "edits", "groups", "with_bpm")


@match("a8_purchase_ingest", """
select case when track_no % 4 = 0 then 'x' else 'p' end || track_no as item_key, case when track_no % 6 = 0 then album else title end as title, artist as band_name, 'album' as item_type, 'a' || lpad(track_no::varchar, 10, '0') as art,
  case when track_no % 3 = 0 then 'https://shop.example/' || track_no end as page_url from tracks where track_no % 30 <> 6""")
def a8(spark, sf_dir):
    t, no = Tables(spark, sf_dir).tracks, F.col("track_no")
    known = no % 30 != 6
    kind = F.when(no % 4 == 0, "x")
    item = F.struct(
        F.when(known, no).alias("sale_item_id"), kind.alias("sale_item_type"), F.when(no % 6 != 0, F.col("title")).otherwise("").alias("item_title"), F.when(no % 6 == 0, F.col("album")).alias("album_title"),
        F.col("artist").alias("band_name"), F.lit("album").alias("item_type"), no.alias("item_art_id"),
    )
    url = F.when(known & (no % 3 == 0), F.struct(F.concat(F.coalesce(kind, F.lit("p")), no.cast("string")), F.concat(F.lit("https://shop.example/"), no.cast("string"))))
    docs = t.groupBy(_page()).agg(F.collect_list(item).alias("items"), F.map_from_entries(F.collect_list(url)).alias("redownload_urls"))
    return json_sources.purchases(docs.drop("page").select(F.to_json(F.struct("*")).alias("json")))


@match("a10_page_data", """
select page_id, case when page_id % 5 = 0 then null when page_id % 4 < 2 then 'https://shop.example/' || coalesce(url, '') || '?a=1&b=2' when page_id % 4 = 2 then 'mp3-' || page_id end as download, page_id % 5 <> 0 and page_id % 4 < 3 as readable from pages""")
def a10(spark, sf_dir):
    """Pages with their data put into an attribute, escaped as sites do: unreadable in every fifth, without a known format in every fourth."""
    no = F.col("page_id")
    link = F.concat(F.lit("https://shop.example/"), F.coalesce("url", F.lit("")), F.lit("?a=1&b=2"))
    urls = F.when(no % 4 < 2, F.create_map(F.lit("mp3-v0"), F.struct(F.lit("other").alias("url")), F.lit("flac"), F.struct(link.alias("url"))))
    urls = urls.when(no % 4 == 2, F.create_map(F.lit("mp3-v0"), F.struct(F.concat(F.lit("mp3-"), no.cast("string")).alias("url"))))
    urls = urls.otherwise(F.create_map(F.lit("odd"), F.struct(F.lit("x").alias("url"))))
    data = F.to_json(F.struct(F.array(F.struct(urls.alias("downloads"))).alias("digital_items")))
    blob = json_sources.escape(F.when(no % 5 == 0, F.left(data, F.length(data) - 3)).otherwise(data))
    pages = Tables(spark, sf_dir).pages.select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), F.lit('<div data-blob="'), blob, F.lit('"></div>')).alias("html"))
    found = json_sources.page_downloads(pages, ["aiff-lossless", "flac", "mp3-v0"])
    return found.select("page_id", "download", F.col("download").isNotNull().alias("readable"))
