"""Structured Streaming over arrivals, patches, progress and event logs.

State that must outlast a batch is kept as a log in the shared folder: each micro-batch writes what it
changes, as little as its rows tell, under its own number, so a batch that is run again overwrites its own
rows, and no batch rewrites a table. Tables are put together when they are read; logs put their batches together as they grow.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from needledrop.operators import filters, sync
from needledrop.scratch import materialise


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 2) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """The Parquet files of a folder by name, which is the order of the partitions that were written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(f.getPath().toString() for f in found if f.getPath().getName().endswith(".parquet"))


def set_ages(spark: SparkSession, files: list[str]) -> None:
    """Make each file a second younger than the one before: a stream reads files by their age. An error where a file keeps its own age."""
    newest = int(time.time())
    for k, f in enumerate(files):
        path, at = spark._jvm.org.apache.hadoop.fs.Path(f), (newest - len(files) + k) * 1000
        there = path.getFileSystem(spark._jsc.hadoopConfiguration())
        there.setTimes(path, at, -1)
        if there.getFileStatus(path).getModificationTime() != at:
            raise RuntimeError(f"the age of {f} cannot be set")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand all that has arrived to ``each`` batch by batch, then stop."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Log:
    """Rows of micro-batches, with the batch's number, and a manifest that says which folders hold them.

    A batch is written to a folder of its own, then a new version of the manifest names it; a version appears by a rename,
    so a reader sees all of a batch or nothing, and a batch that is run again takes its former place. After ``every``
    batches they are put together by ``merge`` (rows to fewer rows of the same columns) into one folder. What a version no
    longer names is deleted at the next putting together, so a reader that has begun ends undisturbed. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, merge: Callable[[DataFrame], DataFrame] | None = None, every: int = 20) -> None:
        self.spark, self.folder, self.schema, self.merge, self.every = spark, folder, schema, merge, every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        there = self._path(f"{self.folder}/_manifest")
        return sorted(f.getPath().getName() for f in self._files.listStatus(there) if not f.getPath().getName().startswith(".")) if self._files.exists(there) else []

    def manifest(self) -> dict:
        """``upto``: the last batch that is put together in ``base``; ``batches``: the folder of each later one; ``old``: folders to delete."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "upto": -1, "base": None, "batches": {}, "old": []}
        stream = self._files.open(self._path(f"{self.folder}/_manifest/{versions[-1]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        manifest["version"] += 1
        name, hidden = self._path(f"{self.folder}/_manifest/{manifest['version']:012}"), self._path(f"{self.folder}/_manifest/.{uuid.uuid4().hex}")
        out = self._files.create(hidden, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._files.exists(name) or not self._files.rename(hidden, name):
            raise RuntimeError(f"another writer has published version {manifest['version']} of {self.folder}")
        for old in self._versions()[:-3]:
            self._files.delete(self._path(f"{self.folder}/_manifest/{old}"), False)

    def _write(self, rows: DataFrame, kind: str) -> str:
        folder = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return folder

    def put(self, rows: DataFrame, number: int) -> None:
        manifest = self.manifest()
        if number <= manifest["upto"]:
            return  # a batch that is run again after it has been put together with others
        before = manifest["batches"].get(str(number))
        manifest["batches"][str(number)] = self._write(rows.select(*self.schema.names, F.lit(number).cast("bigint").alias("batch")), "batch")
        manifest["old"] += [before] if before else []
        self._publish(manifest)
        if self.merge is not None and len(manifest["batches"]) >= self.every:
            self.compact()

    def read(self) -> DataFrame:
        manifest = self.manifest()
        with_number = StructType([*self.schema.fields, StructField("batch", LongType())])
        folders = [*([manifest["base"]] if manifest["base"] else []), *manifest["batches"].values()]
        return self.spark.read.schema(with_number).parquet(*folders) if folders else self.spark.createDataFrame([], with_number)

    def compact(self) -> None:
        """Put all batches together into one folder."""
        manifest = self.manifest()
        if self.merge is None or not manifest["batches"]:
            return
        upto = max(map(int, manifest["batches"]))
        merged = self.merge(self.read())
        merged = merged if "batch" in merged.columns else merged.withColumn("batch", F.lit(upto).cast("bigint"))
        base = self._write(merged.select(*self.schema.names, "batch"), "base")
        for folder in manifest["old"]:
            self._files.delete(self._path(folder), True)
        old = [*([manifest["base"]] if manifest["base"] else []), *manifest["batches"].values()]
        self._publish(manifest | {"upto": upto, "base": base, "batches": {}, "old": old})

    def newest(self, *key: str) -> DataFrame:
        """The last batch's row of each key."""
        return newest_batches(self.read(), *key).drop("batch")


def newest_batches(rows: DataFrame, *key: str) -> DataFrame:
    """The last batch's row of each key, with its number."""
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    last = rows.groupBy(*key).agg(F.max_by(F.struct("batch", *rest), "batch").alias("r"))
    return last.select(*key, "r.*")


def newest_files(rows: DataFrame) -> DataFrame:
    return sync.last_of_batch(rows, "mtime_ms", "path")


def arrivals(stream: DataFrame, log: Log, checkpoint: str) -> None:
    """Log new files: of several versions of a path the newest, whatever order they arrive in."""
    run_available(stream, lambda batch, number: log.put(newest_files(batch), number), checkpoint)


def arrived(catalog: DataFrame, log: Log) -> DataFrame:
    """The catalogue with what has arrived: what is unknown or changed is refreshed, the rest reused, nothing removed."""
    split = sync.reuse_or_refresh(sync.identities(catalog), newest_files(log.read()).select("path", "mtime_ms", "size_bytes"))
    return sync.upsert(catalog, split.select("path", "mtime_ms", "size_bytes", F.col("refresh").alias("fresh")), "path")


def bursts(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Change notices (ts, library_dir) of a library that follow each other within ``gap``, as one: what a sync answers to."""
    found = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("burst"), "library_dir").agg(F.count("*").alias("notices"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return found.drop("burst")


def last_notices(rows: DataFrame) -> DataFrame:
    return sync.last_of_batch(rows, "seq", "path")


def notices(stream: DataFrame, log: Log, checkpoint: str) -> None:
    """Log the last notice (seq, path, mtime_ms, size_bytes) of each path and batch; one without a time says that the file is gone."""
    run_available(stream, lambda batch, number: log.put(last_notices(batch), number), checkpoint)


def watched(catalog: DataFrame, log: Log) -> DataFrame:
    """The catalogue after all notices, in any order of batches: files that are gone go, new and changed ones are refreshed, the rest stays."""
    last = materialise(last_notices(log.read()).drop("batch"))
    gone = last.filter("mtime_ms is null")
    split = sync.reuse_or_refresh(sync.identities(catalog), last.filter("mtime_ms is not null").select("path", "mtime_ms", "size_bytes"))
    return sync.upsert(sync.delete_paths(catalog, gone), split.select("path", "mtime_ms", "size_bytes", F.col("refresh").alias("fresh")), "path")


def coalesced_patches(stream: DataFrame, window: str, late: str) -> DataFrame:
    """Per path and event-time window the newest tempo, newest key and any waveform flag.

    In append mode a window comes out once, when the watermark has passed it; in complete mode every window
    comes out each time, and none is ever dropped.
    """
    return sync.coalesce_patches(stream.withWatermark("ts", late), F.window("ts", window))


def log_patches(stream: DataFrame, log: Log, checkpoint: str) -> None:
    """Log the newest tempo and key of each path and batch, with their numbers."""
    run_available(stream, lambda batch, number: log.put(sync.numbered_patches(batch), number), checkpoint)


def newest_patches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.max("p_tempo").alias("p_tempo"), F.max("p_key").alias("p_key"))


def patched(tracks: DataFrame, log: Log) -> DataFrame:
    """Rows with bpm_seq and key_seq under all logged patches: unknown paths are dropped, no row goes, and batches may come in any order."""
    return sync.apply_numbered(tracks, newest_patches(log.read()))


def replacements(stream: DataFrame, log: Log, checkpoint: str) -> None:
    """Log rows that replace those of their key."""
    run_available(stream, lambda batch, number: log.put(batch, number), checkpoint)


def replaced(table: DataFrame, log: Log, *key: str) -> DataFrame:
    """The table with the last batch's row of each key."""
    return sync.upsert(table, log.read(), *key, seq="batch")


def progress(stream: DataFrame) -> DataFrame:
    """Done and total by generation and stage, and whether it is still running."""
    counts = stream.groupBy("generation", "stage").agg(F.count("*").alias("total"), F.count_if("done").alias("done"))
    return counts.withColumn("running", F.col("done") < F.col("total"))


def event_log(stream: DataFrame, log: Log, checkpoint: str, keep: int = 500) -> None:
    """Log the newest events of each batch; the newest of all are among them."""
    run_available(stream, lambda batch, number: log.put(filters.newest(batch, keep), number), checkpoint)


def skip_list(stream: DataFrame) -> DataFrame:
    """The latest reason of each path."""
    return stream.groupBy("path").agg(F.max_by("reason", "seq").alias("reason"), F.max("seq").alias("seq"))


def final_rows(aggregate: DataFrame, spark: SparkSession, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregate over all that has arrived and read its last state."""
    aggregate.writeStream.outputMode(mode).foreachBatch(lambda batch, number: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(folder)
