"""Adapter views: catalogue tables derived from the driver tables, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "tracks": r"""
select
  o.o_orderkey as track_no,
  '/lib/' || o.o_orderstatus as library_dir,
  '/lib/' || o.o_orderstatus || '/' || replace(p.p_brand, '#', ' ') || '/' || p.p_type || '/'
    || lpad(cast(o.o_orderkey % 20 + 1 as string), 2, '0') || ' - ' || c.c_name || ' - ' || p.p_name
    || '-' || cast(o.o_orderkey as string) || '.' || case o.o_orderkey % 8 when 0 then 'aiff' when 1 then 'wav'
       when 2 then 'flac' when 3 then 'm4a' when 4 then 'mp3' when 5 then 'm4a' when 6 then 'ogg' else 'aif' end as path,
  case o.o_orderkey % 8 when 0 then 'aiff' when 1 then 'wav' when 2 then 'flac' when 3 then 'mov,mp4,m4a'
       when 4 then 'mp3' when 5 then 'mov,mp4,m4a' when 6 then 'ogg' else 'aiff' end as container,
  case o.o_orderkey % 8 when 0 then 'pcm_s16be' when 1 then 'pcm_s24le' when 2 then 'flac' when 3 then 'alac'
       when 4 then 'mp3' when 5 then 'aac' when 6 then 'vorbis' else 'sowt' end as codec,
  case o.o_orderkey % 7 when 0 then 96000 when 1 then 48000 when 2 then 0 when 3 then 22050 else 44100 end as sample_rate,
  case when o.o_orderkey % 8 in (4, 5, 6) then 0 when o.o_orderkey % 5 = 0 then 32
       when o.o_orderkey % 5 = 1 then 24 else 16 end as bits_per_sample,
  cast(2 as int) as channels,
  cast(60 + cast(floor(o.o_totalprice) as bigint) % 540 as double) as duration_secs,
  o.o_orderkey % 8 in (0, 1, 2, 3, 7) as lossless,
  case when o.o_orderkey % 11 = 0 then null when o.o_orderkey % 13 = 0 then '   ' else p.p_name end as title,
  c.c_name as artist,
  case when o.o_orderkey % 9 = 0 then null else p.p_brand || ' ' || p.p_type end as album,
  case when o.o_orderkey % 4 = 0 then null else c.c_mktsegment end as album_artist,
  case o.o_orderkey % 3 when 0 then upper(o.o_orderpriority) when 1 then lower(o.o_orderpriority)
       else ' ' || o.o_orderpriority || ' ' end as genre,
  case o.o_orderkey % 4 when 0 then cast(year(o.o_orderdate) as string)
       when 1 then cast(year(o.o_orderdate) as string) || '-' || lpad(cast(month(o.o_orderdate) as string), 2, '0') || '-01'
       when 2 then lpad(cast(month(o.o_orderdate) as string), 2, '0') || '/' || cast(year(o.o_orderdate) as string)
       else cast(year(o.o_orderdate) as string) || '0101' end as year,
  case when o.o_orderkey % 17 = 0 then null else cast(o.o_orderkey % 20 + 1 as int) end as track_number,
  case when o.o_orderkey % 10 = 0 then null else n.n_name end as label,
  case when o.o_orderkey % 6 = 0 then null
       else 60 + cast(cast(floor(o.o_totalprice) as bigint) % 561 as double) / 4 end as bpm,
  cast((o.o_orderkey % 100) as double) / 128 as bpm_confidence,
  cast(o.o_orderkey % 12 as int) as key_pc,
  c.c_nationkey % 2 = 0 as key_minor,
  1600000000000 + (o.o_orderkey % 1000) * 86400000 as download_date,
  1700000000000 + o.o_orderkey * 1000 as mtime_ms,
  cast(floor(o.o_totalprice) as bigint) * 100 as size_bytes
from orders o
join customer c on c.c_custkey = o.o_custkey
join part p on p.p_partkey = o.o_orderkey % 200
join nation n on n.n_nationkey = c.c_nationkey
""",
    "tracks_prev": r"""
select path, library_dir,
  case when track_no % 29 = 0 then null else mtime_ms end as mtime_ms,
  case when track_no % 29 = 0 then null when track_no % 5 = 2 then size_bytes + 1 else size_bytes end as size_bytes,
  title, artist, bpm
from tracks where track_no % 7 <> 3
union all
select '/lib/F/gone/' || cast(c_custkey as string) || '.aiff', '/lib/F', cast(1 as bigint), cast(1 as bigint),
  c_name, c_name, cast(null as double)
from customer where c_custkey % 10 = 0
""",
    "edits": r"""
select path, 'Edited ' || cast(track_no as string) as title, artist,
  case when track_no % 46 = 0 then null else 'Edited Album' end as album,
  artist as album_artist, 'Techno' as genre, '2024' as year, track_number, label, cast(128.5 as double) as bpm
from tracks where track_no % 23 = 0
""",
    "patches": r"""
select e.event_id as seq, e.ts, coalesce(t.path, '/lib/unknown/' || cast(e.user_id as string)) as path,
  case when e.event_type in ('view', 'click') then e.value end as bpm,
  case when e.event_type = 'view' then cast(e.event_id % 100 as double) / 128 end as bpm_confidence,
  case when e.event_type = 'signup' then cast(e.event_id % 12 as int) end as key_pc,
  e.event_type = 'purchase' as waveform
from events e left join tracks t on t.track_no = e.user_id and e.user_id % 13 <> 0
""",
    "playlists": r"""
select cast(row_number() over (order by c_mktsegment) as bigint) as id, c_mktsegment as name,
  1700000000000 + cast(row_number() over (order by c_mktsegment) as bigint) as created_ms
from (select distinct c_mktsegment from customer) s
""",
    "playlist_items": r"""
select track_no % 4 + 1 as playlist_id, path,
  cast(row_number() over (partition by track_no % 4 order by track_no % 97, track_no) - 1 as bigint) as position
from tracks where track_no % 10 < 3
""",
    "doc_candidates": r"""
select doc_id, '/docs/' || source || '/' || cast(doc_id as string) || '.txt' as path,
  split_part(text, chr(10), 1) as name, source as artist, lang as album,
  cast(n_chars as double) / 8 as duration_secs, n_chars as size_bytes, text
from documents
""",
    "event_series": r"""
select event_type as series_id, cast((year(ts) * 366 + dayofyear(ts)) * 24 + hour(ts) as int) as bucket,
  cast(count(*) as double) as v
from events group by event_type, cast((year(ts) * 366 + dayofyear(ts)) * 24 + hour(ts) as int)
""",
    "reference": r"""
select path, bpm, cast(track_no % 4 as double) / 4 as drift, key_pc, key_minor,
  cast(track_no % 64 as double) / 128 as beat_secs
from tracks where bpm is not null and track_no % 3 <> 0
""",
    "detections": r"""
select t.path, e.engine,
  case (t.track_no + e.shift) % 9 when 0 then null when 1 then bpm when 2 then bpm + 0.25 when 3 then bpm + 1.5
    when 4 then bpm * 2 when 5 then bpm / 2 when 6 then bpm * 0.75 when 7 then bpm + 7 else bpm * 1.125 end as bpm,
  cast((t.track_no * 7 + e.shift) % 128 as double) / 128 as confidence,
  cast((t.track_no * 13 + e.shift) % 400 as double) as decode_ms, cast((t.track_no * 5 + e.shift) % 90 as double) as analyse_ms,
  case when (t.track_no + e.shift) % 6 = 0 then null
    else cast((t.key_pc + (t.track_no + e.shift) % 6 * 7) % 12 as int) end as key_pc,
  case when (t.track_no + e.shift) % 5 = 0 then not t.key_minor else t.key_minor end as key_minor,
  cast((t.track_no + e.shift) % 64 as double) / 128 as beat_secs
from tracks t cross join (select 'a' as engine, 0 as shift union all select 'b', 4) e
where t.bpm is not null
""",
    "purchases": r"""
select 'p' || cast(track_no as string) as item_key, upper(replace(album, ' ', '--')) as title,
  lower(artist) as band_name, 'album' as item_type
from tracks where track_no % 50 = 0 and album is not null
union all
select 'x' || cast(c_custkey as string), 'Nothing ' || cast(c_custkey as string), c_name, 'track'
from customer where c_custkey % 25 = 0
""",
}


def needed(sql: str, views: dict[str, str]) -> list[str]:
    """The views that ``sql`` names, and those that they name, each after what it needs."""
    out: list[str] = []

    def visit(text: str) -> None:
        for name, body in views.items():
            if name not in out and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                visit(body)
                out.append(name)

    visit(sql)
    return out


def with_views(sql: str, views: dict[str, str] | None = None, first: tuple[str, ...] = ()) -> str:
    """``sql`` behind the common table expressions that it needs."""
    views = views or VIEWS
    parts = [*first, *(f"{n} as ({views[n]})" for n in needed(sql, views))]
    body = sql.strip()
    own = re.match(r"with\s+(recursive\s+)?", body)
    if own:
        start = "with recursive" if own[1] else "with"
        return f"{start} {', '.join([*parts, ''])}{body[own.end():]}"
    return f"with {', '.join(parts)} {body}" if parts else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view over the driver tables in ``sf_dir``."""
    sql = f"select * from {name}"
    text = " ".join([sql, *(VIEWS[n] for n in needed(sql, VIEWS))])
    base = tuple(f"{b} as (select * from parquet.`{sf_dir}/{b}.parquet`)" for b in BASE if re.search(rf"\b(?:from|join)\s+{b}\b", text))
    return spark.sql(with_views(sql, first=base))
