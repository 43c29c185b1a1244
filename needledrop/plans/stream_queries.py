"""Streaming queries: tables are split into files, replayed as streams, and compared as batch results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from needledrop.operators import filters, sync
from needledrop.plans.registry import Tables, query
from needledrop.scratch import scratch_folder
from needledrop.streaming import stateful, streams

#: Files, at least, and the batches that they arrive in.
FILES, BATCHES = 6, 3


class Replay:
    """A table as arriving files in ``order``, with folders for a checkpoint and results."""

    def __init__(self, rows: DataFrame, order: str, by_time: bool = False) -> None:
        self.spark = rows.sparkSession
        self.folder = f"{scratch_folder(self.spark)}/stream/{uuid.uuid4().hex}"
        rows.repartitionByRange(max(FILES, self.spark.sparkContext.defaultParallelism), order).write.parquet(f"{self.folder}/in")  # one file a range
        files = streams.data_files(self.spark, f"{self.folder}/in")
        if by_time:
            streams.set_ages(self.spark, files)
        self.stream = streams.read_stream(self.spark, f"{self.folder}/in", rows.schema, -(-len(files) // BATCHES))
        self.checkpoint, self.out = f"{self.folder}/checkpoint", f"{self.folder}/out"

    def log(self, schema: StructType, merge: Callable[[DataFrame], DataFrame] | None = None, every: int = 20) -> streams.Log:
        return streams.Log(self.spark, f"{self.folder}/log", schema, merge, every)


def _patches(t: Tables) -> DataFrame:
    return t.patches.withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_arrival_stream", """
select coalesce(d.path, p.path) as path, coalesce(d.mtime_ms, p.mtime_ms) as mtime_ms, coalesce(d.size_bytes, p.size_bytes) as size_bytes, case when d.path is null then null else not coalesce(d.mtime_ms = p.mtime_ms and d.size_bytes = p.size_bytes, false) end as fresh
from (select * from tracks where track_no % 3 <> 0) d full join tracks_prev p on p.path = d.path""")
def t1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    replay = Replay(t.tracks.filter("track_no % 3 <> 0").select("path", "mtime_ms", "size_bytes"), "path")
    log = replay.log(replay.stream.schema, streams.newest_files, every=2)
    streams.arrivals(replay.stream, log, replay.checkpoint)
    return streams.arrived(t.tracks_prev.select("path", "mtime_ms", "size_bytes", F.lit(None).cast("boolean").alias("fresh")), log)


@query("t1_watch_stream", """
with d as (select path, track_no % 4 as k, mtime_ms, size_bytes from tracks)
select coalesce(d.path, p.path) as path, coalesce(d.mtime_ms, p.mtime_ms) as mtime_ms, coalesce(d.size_bytes, p.size_bytes) as size_bytes, case when d.path is null then null else not coalesce(d.mtime_ms = p.mtime_ms and d.size_bytes = p.size_bytes, false) end as fresh
from (select * from d where k in (0, 2)) d full join tracks_prev p on p.path = d.path where coalesce(d.path, p.path) not in (select path from d where k = 1)""")
def t1_watch(spark, sf_dir):
    """Notices of files that are seen, seen and then gone, or gone and then seen again; a quarter of all has none."""
    t = Tables(spark, sf_dir)
    k, no = F.col("track_no") % 4, F.col("track_no")
    when = lambda seq, there: F.struct(seq.cast("bigint").alias("seq"), "path", F.when(there, F.col("mtime_ms")).alias("mtime_ms"), F.when(there, F.col("size_bytes")).alias("size_bytes"))
    rows = t.tracks.filter(k < 3).select(F.inline(F.array(when(no * 2, k != 2), when(no * 2 + 1, k != 1))))
    replay = Replay(rows, "mtime_ms")  # batches come in any order
    log = replay.log(rows.schema, lambda r: streams.last_notices(r), every=2)
    streams.notices(replay.stream, log, replay.checkpoint)
    return streams.watched(t.tracks_prev.select("path", "mtime_ms", "size_bytes", F.lit(None).cast("boolean").alias("fresh")), log)


@query("t1_notice_bursts", """
with e as (select event_type as library_dir, ts, ts - lag(ts) over (partition by event_type order by ts) as gap from events),
b as (select *, sum(case when gap <= interval 20 minutes then 0 else 1 end) over (partition by library_dir order by ts) as burst from e)
select library_dir, count(*)::bigint as notices, min(ts) as first, max(ts) as last from b group by library_dir, burst having max(ts) + interval 20 minutes <= (select max(ts) from events) - interval 1 day""")
def t1_bursts(spark, sf_dir):
    """Notices within twenty minutes of each other as one burst, once each, as far as the watermark of a day has come."""
    rows = Tables(spark, sf_dir).events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("library_dir"))
    replay = Replay(rows, "ts", by_time=True)
    out = streams.final_rows(streams.bursts(replay.stream, "20 minutes", "1 day"), spark, replay.out, replay.checkpoint, mode="append")
    return out.withColumns({"first": F.col("first").cast("timestamp_ntz"), "last": F.col("last").cast("timestamp_ntz")})


@query("t2_patch_coalescing", """
select time_bucket(interval 6 hours, ts) as window_start, path, arg_max(bpm, seq) filter (where bpm is not null) as bpm, arg_max(key_pc, seq) filter (where key_pc is not null) as key_pc, bool_or(waveform) as waveform from patches group by 1, 2""")
def t2(spark, sf_dir):
    replay = Replay(_patches(Tables(spark, sf_dir)), "seq")
    rows = streams.final_rows(streams.coalesced_patches(replay.stream, "6 hours", "1 day"), spark, replay.out, replay.checkpoint)
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "path", "bpm", "key_pc", "waveform")


@query("t2_patch_windows", """
with recursive p as (select *, epoch_us(ts) // 1000 as ms from patches), w as (select path, min(ms) as s from p group by path union all select w.path, min(p.ms) from w join p on p.path = w.path and p.ms >= w.s + 21600000 group by w.path, w.s)
select w.path, s as start_ms, arg_max(bpm, seq) filter (where bpm is not null) as bpm, arg_max(struct_pack(c := bpm_confidence), seq) filter (where bpm is not null).c as bpm_confidence, arg_max(key_pc, seq) filter (where key_pc is not null) as key_pc, bool_or(waveform) as waveform, count(*)::bigint as patches
from w join p on p.path = w.path and p.ms >= s and p.ms < s + 21600000 where s + 21600000 <= (select max(ms) from p) - 86400000 group by w.path, s""")
def t2_windows(spark, sf_dir):
    """Windows of six hours from a path's first patch, each once, as far as the watermark of a day has come."""
    replay = Replay(_patches(Tables(spark, sf_dir)), "ts", by_time=True)
    stateful.run_with_state(stateful.patch_windows(replay.stream, 21_600_000, "1 day").writeStream.format("parquet").option("path", replay.out), replay.checkpoint)
    return spark.read.parquet(replay.out)


@query("t3_patch_application", """
with c as (select path, arg_max(bpm, seq) filter (where bpm is not null) as bpm, arg_max(struct_pack(c := bpm_confidence), seq) filter (where bpm is not null) as conf, arg_max(key_pc, seq) filter (where key_pc is not null) as key_pc from patches group by path)
select t.path, coalesce(c.bpm, t.bpm) as bpm, case when c.bpm is not null then c.conf.c else t.bpm_confidence end as bpm_confidence, coalesce(c.key_pc, t.key_pc) as key_pc from tracks t left join c using (path)""")
def t3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    replay = Replay(_patches(t), "seq")
    none = F.lit(None).cast("bigint")
    log = replay.log(sync.numbered_patches(_patches(t)).schema, streams.newest_patches)
    streams.log_patches(replay.stream, log, replay.checkpoint)
    return streams.patched(t.tracks.select("path", "bpm", "bpm_confidence", "key_pc", none.alias("bpm_seq"), none.alias("key_seq")), log).drop("bpm_seq", "key_seq")


@query("t4_micro_batch_persistence", "select path, title, true as fresh from tracks where track_no % 4 = 1 union all select path, title, false from tracks_prev where path not in (select path from tracks where track_no % 4 = 1)")
def t4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    replay = Replay(t.tracks.filter("track_no % 4 = 1").select("path", "title", F.lit(True).alias("fresh")), "path")
    log = replay.log(replay.stream.schema, lambda rows: streams.newest_batches(rows, "path"), every=2)
    streams.replacements(replay.stream, log, replay.checkpoint)
    return streams.replaced(t.tracks_prev.select("path", "title", F.lit(False).alias("fresh")), log, "path")


def _progress(t: Tables) -> DataFrame:
    return t.events.select("event_id", (F.floor(F.col("event_id") / 4000)).alias("generation"), F.col("event_type").alias("stage"), (F.col("user_id") % 3 != 0).alias("done"))


@query("t5_progress_by_stage", "select event_id // 4000 as generation, event_type as stage, count(*)::bigint as total, count(*) filter (where user_id % 3 <> 0)::bigint as done, count(*) filter (where user_id % 3 = 0) > 0 as running from events group by 1, 2")
def t5(spark, sf_dir):
    replay = Replay(_progress(Tables(spark, sf_dir)), "event_id")
    return streams.final_rows(streams.progress(replay.stream), spark, replay.out, replay.checkpoint)


@query("t6_superseded_runs", """
with e as (select event_type as job, event_id // 4000 as generation, user_id % 3 <> 0 as done from events), n as (select job, max(generation) as generation from e group by job)
select job, generation, count(*)::bigint as total, count(*) filter (where done)::bigint as done from e join n using (job, generation) group by 1, 2""")
def t6(spark, sf_dir):
    """Counts of each job's newest generation; messages arrive by user, so those of older runs come among them."""
    rows = _progress(Tables(spark, sf_dir)).join(Tables(spark, sf_dir).events.select("event_id", "user_id"), "event_id").select("user_id", F.col("stage").alias("job"), "generation", "done")
    replay = Replay(rows, "user_id")
    log = replay.log(StructType.fromDDL(stateful.NEWEST), lambda rows: streams.newest_batches(rows, "job"))
    writer = stateful.newest_generations(replay.stream).writeStream.outputMode("update").foreachBatch(lambda batch, number: log.put(batch, number))
    stateful.run_with_state(writer, replay.checkpoint)
    return log.newest("job")


@query("t7_event_log_stream", "select event_id as id, event_type as level from events order by event_id desc limit 500")
def t7(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.select(F.col("event_id").alias("id"), F.col("event_type").alias("level"))
    replay = Replay(rows, "id")
    log = replay.log(rows.schema, lambda rows: filters.newest(rows, 500), every=2)
    streams.event_log(replay.stream, log, replay.checkpoint)
    return filters.newest(log.read().drop("batch"), 500)


@query("t8_skip_list_stream", "select '/u/' || user_id as path, arg_max(event_type, event_id) as reason, max(event_id) as seq from events where event_type <> 'purchase' group by 1")
def t8(spark, sf_dir):
    rows = Tables(spark, sf_dir).events.filter("event_type <> 'purchase'").select(F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("reason"), F.col("event_id").alias("seq"))
    replay = Replay(rows, "seq")
    return streams.final_rows(streams.skip_list(replay.stream), spark, replay.out, replay.checkpoint)
