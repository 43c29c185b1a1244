"""Catalogue maintenance: incremental diffs, snapshot upserts, patches, relocation, undo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside(folder: str, path: Column) -> Column:
    """Whether a path lies in a folder; ``/lib-old`` is not in ``/lib``."""
    return path.startswith(folder.rstrip("/") + "/")


def identities(tracks: DataFrame) -> DataFrame:
    """path, mtime_ms, size_bytes of rows whose identity is known."""
    return tracks.filter("mtime_ms is not null and size_bytes is not null").select("path", "mtime_ms", "size_bytes")


def valid_artifacts(artifacts: DataFrame, tracks: DataFrame, version: int) -> DataFrame:
    """Artifacts whose identity and algorithm version still hold."""
    return artifacts.filter(F.col("algo_version") == version).join(identities(tracks), ["path", "mtime_ms", "size_bytes"], "left_semi")


def last_of_batch(rows: DataFrame, seq: str, *key: str) -> DataFrame:
    """The row of the highest sequence number of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(seq))
    return rows.withColumn("batch_rank", F.row_number().over(w)).filter("batch_rank = 1").drop("batch_rank")


def upsert(old: DataFrame, incoming: DataFrame, *key: str, seq: str | None = None) -> DataFrame:
    """A new snapshot: incoming rows (the last of equal keys) replace, rows not mentioned stay."""
    fresh = last_of_batch(incoming, seq, *key) if seq else incoming
    fresh = fresh.select(*old.columns)
    return old.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh)


def diff_files(disk: DataFrame | None, tracks: DataFrame) -> DataFrame:
    """path and status added / kept / removed. ``None`` for the listing is no evidence: all are kept."""
    have = tracks.select("path", F.lit(True).alias("in_catalog"))
    if disk is None:
        return have.select("path", F.lit("kept").alias("status"))
    both = disk.select("path", F.lit(True).alias("on_disk")).join(have, "path", "full")
    return both.select("path", F.when(F.col("on_disk").isNull(), "removed").when(F.col("in_catalog").isNull(), "added").otherwise("kept").alias("status"))


def reuse_or_refresh(cached: DataFrame, disk: DataFrame) -> DataFrame:
    """Disk rows with ``refresh``: false only where both identities are known and equal."""
    c = cached.select("path", F.col("mtime_ms").alias("c_mtime"), F.col("size_bytes").alias("c_size"))
    same = F.coalesce((F.col("c_mtime") == F.col("mtime_ms")) & (F.col("c_size") == F.col("size_bytes")), F.lit(False))
    return disk.join(c, "path", "left").withColumn("refresh", ~same).drop("c_mtime", "c_size")


def prune(tracks: DataFrame, keep: DataFrame, library_dir: str, full_sweep: bool) -> DataFrame:
    """Drop a folder's rows that a full sweep did not see; other folders, and anything less than a full sweep, lose none."""
    if not full_sweep:
        return tracks
    mine = F.col("library_dir") == library_dir
    return tracks.filter(mine).join(keep.select("path"), "path", "left_semi").unionByName(tracks.filter(~mine))


def delete_paths(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("path"), "path", "left_anti")


def relocated(path: Column, old: str, new: str) -> Column:
    return F.when(inside(old, path), F.concat(F.lit(new.rstrip("/")), F.substring(path, len(old.rstrip("/")) + 1, 1 << 20)))


def relocation_moves(tracks: DataFrame, listing: DataFrame, old: str, new: str) -> DataFrame:
    """path, target and moved for rows under ``old``: moved if the file is there and no row holds its path."""
    rows = tracks.select("path", relocated(F.col("path"), old, new).alias("target")).filter("target is not null")
    there = listing.select(F.col("path").alias("target"), F.lit(True).alias("there")).distinct()
    taken = tracks.select(F.col("path").alias("target"), F.lit(True).alias("taken"))
    return rows.join(there, "target", "left").join(taken, "target", "left").select("path", "target", (F.col("there").isNotNull() & F.col("taken").isNull()).alias("moved"))


def move_paths(table: DataFrame, moves: DataFrame) -> DataFrame:
    """Apply moved rows to a table with ``path``: tracks and every child table alike."""
    m = moves.filter("moved").select("path", "target")
    return table.join(m, "path", "left").withColumn("path", F.coalesce("target", "path")).drop("target").select(*table.columns)


def invalidate_on_version_change(tracks: DataFrame, stored: str | None, current: str) -> DataFrame:
    """Unknown identities for all rows if the version changed; no stored version changes nothing."""
    changed = stored is not None and stored != current
    return tracks.withColumns({c: F.lit(None).cast("bigint") for c in ("mtime_ms", "size_bytes")}) if changed else tracks


def build_patch(analysed: DataFrame) -> DataFrame:
    """Detected values as they are stored: tempo to two decimals, key with its names."""
    from needledrop.functions.rules import camelot_name, key_name

    return analysed.withColumns({"bpm": F.round("bpm", 2), "key_name": key_name(F.col("key_pc"), F.col("key_minor")), "camelot": camelot_name(F.col("key_pc"), F.col("key_minor"))})


def coalesce_patches(patches: DataFrame, *by: Column | str) -> DataFrame:
    """One patch a path (and window): the newest tempo group, the newest key, and any waveform flag."""
    tempo = F.max(F.when(F.col("bpm").isNotNull(), F.struct("seq", "bpm", "bpm_confidence")))
    key = F.max(F.when(F.col("key_pc").isNotNull(), F.struct("seq", "key_pc")))
    rows = patches.groupBy(*by, "path").agg(tempo.alias("tempo"), key.alias("key"), F.bool_or("waveform").alias("waveform"))
    return rows.select(*rows.columns[: len(by)], "path", "tempo.bpm", "tempo.bpm_confidence", "key.key_pc", "waveform")


def numbered_patches(patches: DataFrame) -> DataFrame:
    """One patch a path: the newest tempo group and the newest key, each a struct with its number."""
    tempo = F.max(F.when(F.col("bpm").isNotNull(), F.struct("seq", "bpm", "bpm_confidence")))
    key = F.max(F.when(F.col("key_pc").isNotNull(), F.struct("seq", "key_pc")))
    return patches.groupBy("path").agg(tempo.alias("p_tempo"), key.alias("p_key"))


def apply_numbered(tracks: DataFrame, patches: DataFrame) -> DataFrame:
    """As ``apply_patches`` for rows with bpm_seq and key_seq: a group changes only for a patch of a greater number."""
    j = tracks.join(patches, "path", "left")
    newer = {g: F.col(f"p_{g}").isNotNull() & (F.coalesce(s, F.lit(-(2**63))) < F.col(f"p_{g}.seq")) for g, s in (("tempo", "bpm_seq"), ("key", "key_seq"))}
    fields = {"bpm": ("tempo", "bpm"), "bpm_confidence": ("tempo", "bpm_confidence"), "bpm_seq": ("tempo", "seq"), "key_pc": ("key", "key_pc"), "key_seq": ("key", "seq")}
    return j.select(*[F.when(newer[fields[c][0]], F.col(f"p_{fields[c][0]}.{fields[c][1]}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in tracks.columns])


def apply_patches(tracks: DataFrame, patches: DataFrame) -> DataFrame:
    """Null leaves a field; confidence goes with its tempo even where null; unknown paths are ignored; no row goes."""
    p = patches.select("path", F.col("bpm").alias("p_bpm"), F.col("bpm_confidence").alias("p_conf"), F.col("key_pc").alias("p_key"))
    j = tracks.join(p, "path", "left")
    out = j.withColumns({
        "bpm_confidence": F.when(F.col("p_bpm").isNotNull(), F.col("p_conf")).otherwise(F.col("bpm_confidence")),
        "bpm": F.coalesce("p_bpm", "bpm"),
        "key_pc": F.coalesce("p_key", "key_pc"),
    })
    return out.select(*tracks.columns)


def backlog(tracks: DataFrame, waveforms: DataFrame, force: bool = False) -> DataFrame:
    """Rows that still need a feature: wants_tempo, wants_grid, wants_key, wants_waveform.

    A mark of the current version says that a value was looked for and is not there.
    """
    valid = waveforms.select("path", F.lit(True).alias("has_waveform")).distinct()
    always = F.lit(force)
    flags = {
        "wants_tempo": always | (F.col("bpm").isNull() & ~F.col("bpm_absent")),
        "wants_grid": always | (F.col("beat_secs").isNull() & ~F.col("grid_absent")),
        "wants_key": always | F.col("key_pc").isNull(),
        "wants_waveform": always | F.col("has_waveform").isNull(),
    }
    return tracks.join(valid, "path", "left").withColumns(flags).filter(reduce(Column.__or__, (F.col(f) for f in flags))).select("path", *flags)


def absence_mark(analysed: Column, asked: Column, value: Column, old: Column, version: str) -> Column:
    """The version that found no value; changes only where an analysis came back that was asked for it."""
    return F.when(analysed & asked, F.when(value.isNull(), F.lit(version))).otherwise(old)


def merge_converted(tracks: DataFrame, results: DataFrame, fresh: DataFrame) -> DataFrame:
    """Drop the sources and outputs of successful conversions and append the fresh rows."""
    gone = results.filter("ok").select(F.explode(F.array("source", "output")).alias("path")).distinct()
    return tracks.join(gone, "path", "left_anti").unionByName(fresh.select(*tracks.columns))


def merge_written(tracks: DataFrame, written: DataFrame) -> DataFrame:
    """Rows that came back from a write replace the stored ones."""
    names = [c for c in written.columns if c != "path"]
    back = written.select("path", F.struct(*names).alias("w"))
    j = tracks.join(back, "path", "left")
    return j.select(*[F.when(F.col("w").isNotNull(), F.col(f"w.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in tracks.columns])


def bulk_edit(rows: DataFrame, ids: DataFrame, patch: dict[str, str]) -> DataFrame:
    """Lay the chosen fields over the selected effective rows; an empty text clears."""
    chosen = rows.join(ids.select("path"), "path", "left_semi")
    return chosen.withColumns({k: F.nullif(F.lit(v), F.lit("")).cast(dict(rows.dtypes)[k]) for k, v in patch.items()})


def capture_before(rows: DataFrame, writes: DataFrame, columns: list[str]) -> DataFrame:
    """One group per write: the current values of the rows about to be written, as JSON."""
    before = writes.select("undo_id", "path").join(rows.select("path", *columns), "path")
    items = F.array_sort(F.collect_list(F.struct("path", *columns)))
    return before.groupBy("undo_id").agg(F.to_json(items, {"ignoreNullFields": "false"}).alias("payload"), F.count("*").alias("items"))


def latest_undo(undo: DataFrame, schema: str) -> DataFrame:
    """Items of the newest group with a readable payload that is not empty."""
    parsed = undo.withColumn("items", F.from_json("payload", schema)).filter(F.size("items") > 0)
    newest = parsed.groupBy().agg(F.max_by("items", "undo_id").alias("items"))
    return newest.select(F.inline("items"))


def retain_undo(undo: DataFrame, keep: int = 20) -> DataFrame:
    """The newest ``keep`` groups."""
    newest = undo.select("undo_id").orderBy(F.desc("undo_id")).limit(keep)
    return undo.join(F.broadcast(newest), "undo_id", "left_semi")


def pop_undo(undo: DataFrame, schema: str) -> DataFrame:
    """The groups that stay once the newest readable one has been restored: it goes, and so do newer ones that cannot be read."""
    readable = undo.filter(F.size(F.from_json("payload", schema)) > 0).agg(F.max("undo_id").alias("restored"))
    return undo.join(F.broadcast(readable), F.col("restored").isNotNull() & (F.col("undo_id") >= F.col("restored")), "left_anti")


def overlay(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Put the columns of ``items`` back over the rows of the same path."""
    return merge_written(rows, items)
