"""Registration of named queries, each with the SQL that it is checked against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from needledrop.operators.catalog import catalog_view
from needledrop.plans import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Views for the checking SQL only, above the adapter views.
CHECK_VIEWS = adapters.VIEWS | {
    # rows with edits laid over them and every derived column
    "cat": r"""
select *, string_split(path, '/')[-1] as file_name, nullif(trim(album), '') as album_tag,
  coalesce(nullif(trim(album), ''), nullif(string_split(path, '/')[-2], ''), '(No album)') as album_key,
  trim(coalesce(album_artist, artist, '')) as group_artist,
  coalesce(trim(title) <> '' and trim(artist) <> '' and trim(album) <> '' and trim(album_artist) <> '', false) as complete,
  (sample_rate <> 0 and sample_rate not in (44100, 48000)) as e_rate, sample_rate = 0 as w_rate,
  ((contains(container, 'aiff') or contains(container, 'wav')) and not starts_with(codec, 'pcm_')) as e_container,
  (starts_with(codec, 'pcm_') and bits_per_sample > 24) as e_bits, codec in ('flac', 'alac') as w_newer,
  not (starts_with(codec, 'pcm_') or codec in ('mp3', 'aac', 'flac', 'alac')) as e_codec,
  not (e_rate or e_container or e_bits or e_codec) as compatible,
  ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][key_pc + 1] || case when key_minor then 'm' else '' end as key_name,
  ((8 + (key_pc - case when key_minor then 9 else 0 end) * 7) % 12 + 12) % 12 as wheel,
  cast(case when wheel = 0 then 12 else wheel end as varchar) || case when key_minor then 'A' else 'B' end as camelot,
  case when starts_with(codec, 'pcm') then case when contains(container, 'aiff') then 'AIFF' when contains(container, 'wav') then 'WAV' else 'PCM' end
    || case when bits_per_sample > 0 then ' ' || cast(bits_per_sample as varchar) || '-bit' else '' end
    when codec in ('flac', 'alac') then upper(codec) || case when bits_per_sample > 0 then ' ' || cast(bits_per_sample as varchar) || '-bit' else '' end
    else upper(codec) end as format
from eff""",
    "eff": r"""
select t.track_no, t.library_dir, t.path, t.container, t.codec, t.sample_rate, t.bits_per_sample, t.channels, t.duration_secs, t.lossless,
  t.bpm_confidence, t.key_pc, t.key_minor, t.download_date, t.mtime_ms, t.size_bytes, e.path is not null as edited,
  case when e.path is not null then e.title else t.title end as title, case when e.path is not null then e.artist else t.artist end as artist,
  case when e.path is not null then e.album else t.album end as album, case when e.path is not null then e.album_artist else t.album_artist end as album_artist,
  case when e.path is not null then e.genre else t.genre end as genre, case when e.path is not null then e.year else t.year end as year,
  case when e.path is not null then e.track_number else t.track_number end as track_number, case when e.path is not null then e.label else t.label end as label,
  case when e.path is not null then e.bpm else t.bpm end as bpm
from tracks t left join edits e on e.path = t.path""",
}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    """Register a (spark, sf_dir) function; ``sql`` may name adapter and check views."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = adapters.with_views(sql, CHECK_VIEWS | (views or {}))
        return f

    return add


class Tables:
    """The adapter views and driver tables of one folder, read on use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in adapters.VIEWS:
            return adapters.view(self.spark, self.sf_dir, name)
        return adapters.table(self.spark, self.sf_dir, name)

    @property
    def catalog(self) -> DataFrame:
        return catalog_view(self.tracks, self.edits)
