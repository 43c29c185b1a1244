"""Streams with state of their own for each key, in a state store: patch windows and newest generations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PATCH = pa.schema({"path": pa.string(), "at": pa.int64(), "seq": pa.int64(), "bpm": pa.float64(), "bpm_confidence": pa.float64(), "key_pc": pa.int32(), "waveform": pa.bool_()})
WINDOW = "path string, start_ms long, bpm double, bpm_confidence double, key_pc int, waveform boolean, patches long"
NEWEST = "job string, generation long, total long, done long"


#: State is kept by bucket of paths, so calls and look-ups grow with buckets, not with paths or patches.
BUCKETS = 1024


def _packed(patches: pd.DataFrame) -> bytes:
    """Patches as one value of a state: an Arrow stream."""
    table, out = pa.Table.from_pandas(patches[PATCH.names], PATCH, preserve_index=False), pa.BufferOutputStream()
    table = table.set_column(0, "path", table["path"].dictionary_encode())
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(values: list[bytes]) -> pd.DataFrame:
    return pa.concat_tables([pa.ipc.open_stream(v).read_all().cast(PATCH) for v in values]).to_pandas()


def _newest(rows: np.ndarray, window: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Of ``rows``, the one of the highest number in each window, the first of them if there are several."""
    rows = rows[np.lexsort((-rows, seq[rows], window[rows]))]
    return rows[np.diff(window[rows], append=-1) != 0]


def _opening(path: np.ndarray, at: np.ndarray, window_ms: int, until: int) -> np.ndarray:
    """Whether each patch, in order by path and time, opens a window: a path's first one does, then the first behind each
    window. Windows that end after ``until`` are left out, but for the first of them of each path."""
    times = np.unique(at)
    place = path * (len(times) + 1)  # each time has a place, and the end one more, so paths do not run into each other
    behind = np.searchsorted(place + np.searchsorted(times, at), place + np.searchsorted(times, at + window_ms))
    opens, now = np.zeros(len(at), dtype=bool), np.flatnonzero(np.diff(path, prepend=-1))
    while len(now):
        opens[now] = True
        now = now[at[now] + window_ms <= until]
        then = behind[now]
        inside = then < len(at)
        now, then = now[inside], then[inside]
        now = then[path[then] == path[now]]
    return opens


def _closed(patches: pd.DataFrame, window_ms: int, until: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Windows that end by ``until``, with the newest tempo and its confidence, the newest key and any waveform flag; and the patches that still wait."""
    code = pd.factorize(patches["path"], use_na_sentinel=False)[0]
    order = np.lexsort((patches["seq"], patches["at"], code))
    patches, path = patches.take(order), code[order]
    at, seq = patches["at"].to_numpy(), patches["seq"].to_numpy()
    opens = _opening(path, at, window_ms, until)
    starts = np.flatnonzero(opens)
    window = np.cumsum(opens) - 1
    done = at[starts] + window_ms <= until
    tempo, key = (_newest(np.flatnonzero(patches[c].notna().to_numpy() & done[window]), window, seq) for c in ("bpm", "key_pc"))
    found = lambda rows, *names: patches.iloc[rows][list(names)].set_axis(window[rows]).reindex(range(len(starts)))
    out = patches.iloc[starts][["path", "at"]].set_axis(["path", "start_ms"], axis=1).reset_index(drop=True)
    out = pd.concat([out, found(tempo, "bpm", "bpm_confidence"), found(key, "key_pc")], axis=1)
    out["waveform"] = np.logical_or.reduceat(patches["waveform"].to_numpy(dtype=bool), starts)
    out["patches"] = np.diff(starts, append=len(at))
    return out[done], patches[~done[window]]


class PatchWindows(StatefulProcessor):
    """Patches of a bucket of paths that wait for their windows to close.

    A path's window opens with its earliest patch that waits and is handed over as one patch when the watermark has passed
    its end, so the result does not depend on the order in which patches arrive. The bucket's timer is the first such end.
    """

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.first = handle.getListState("waiting", "patches binary"), handle.getValueState("first", "at long")

    def _wait(self, patches: pd.DataFrame) -> None:
        self.waiting.appendValue((_packed(patches),))
        at, before = int(patches["at"].min()), self.first.get()
        if before is None or at < before[0]:
            if before is not None:
                self.handle.deleteTimer(before[0] + self.window_ms)
            self.first.update((at,))
            self.handle.registerTimer(at + self.window_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for patches in rows:
            self._wait(patches)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, rest = _closed(_unpacked([v for (v,) in self.waiting.get()]), self.window_ms, timerValues.getCurrentWatermarkInMs())
        self.waiting.clear()
        self.first.clear()
        if len(rest):
            self._wait(rest)
        yield out


class NewestGeneration(StatefulProcessor):
    """Messages of a job's newest generation: an older run's are passed over, and a newer one's start anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "generation long, total long, done long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)
        newest = max(int(f["generation"].max()) for f in frames)
        before = self.state.get()
        generation, total, done = before if before is not None and before[0] >= newest else (newest, 0, 0)
        for f in frames:
            own = f[f["generation"] == generation]
            total, done = total + len(own), done + int(own["done"].sum())
        self.state.update((generation, total, done))
        yield pd.DataFrame([(key[0], generation, total, done)], columns=["job", "generation", "total", "done"])


def patch_windows(stream: DataFrame, window_ms: int, late: str, buckets: int = BUCKETS) -> DataFrame:
    """One patch for each window of a path, once, behind a watermark of ``late``; later rows are dropped and counted by the query.

    ``buckets`` stays what it was when the checkpoint was new."""
    rows = stream.filter("ts is not null").withWatermark("ts", late).select("path", F.unix_millis("ts").alias("at"), "seq", "bpm", "bpm_confidence", F.col("key_pc").cast("int").alias("key_pc"), F.coalesce("waveform", F.lit(False)).alias("waveform"), "ts")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")).groupBy("bucket").transformWithStateInPandas(statefulProcessor=PatchWindows(window_ms), outputStructType=WINDOW, outputMode="Append", timeMode="EventTime")


def newest_generations(stream: DataFrame) -> DataFrame:
    """(job, generation, total, done) of the newest generation of each ``job``, anew with each batch that has messages of it."""
    return stream.select("job", "generation", "done").groupBy("job").transformWithStateInPandas(statefulProcessor=NewestGeneration(), outputStructType=NEWEST, outputMode="Update", timeMode="None")


def run_with_state(writer, checkpoint: str) -> int:
    """Start a stream writer on a RocksDB state store over all that has arrived; the number of rows that came too late."""
    spark = writer._spark
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
