"""Ordered membership: playlist contents with dense positions, changed as sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("playlist_id", "path", "position")


def renumber(items: DataFrame, *order: str) -> DataFrame:
    """Positions dense from 0 within each playlist."""
    w = Window.partitionBy("playlist_id").orderBy(*(order or ("position",)))
    return items.withColumn("position", (F.row_number().over(w) - 1).cast("bigint")).select(*COLUMNS)


def replace_contents(items: DataFrame, lists: DataFrame, tracks: DataFrame) -> DataFrame:
    """``lists`` (playlist_id, paths) replaces those playlists; paths not in the catalogue go, their gaps stay."""
    fresh = lists.select("playlist_id", F.posexplode("paths").alias("position", "path")).join(tracks.select("path"), "path", "left_semi")
    kept = items.join(lists.select("playlist_id"), "playlist_id", "left_anti")
    return kept.select(*COLUMNS).unionByName(fresh.select("playlist_id", "path", F.col("position").cast("bigint").alias("position")))


def append_new(items: DataFrame, added: DataFrame) -> DataFrame:
    """Append (playlist_id, path, ordinal) in order, skipping paths that are there and repeats."""
    first = added.groupBy("playlist_id", "path").agg(F.min("ordinal").alias("ordinal")).join(items.select("playlist_id", "path"), ["playlist_id", "path"], "left_anti")
    sizes = items.groupBy("playlist_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("playlist_id").orderBy("ordinal")
    placed = first.withColumn("rank", F.row_number().over(order)).join(sizes, "playlist_id", "left")
    return items.select(*COLUMNS).unionByName(placed.select("playlist_id", "path", (F.coalesce("n", F.lit(0)) + F.col("rank") - 1).cast("bigint").alias("position")))


def gained(items: DataFrame, added: DataFrame) -> DataFrame:
    """How many paths each playlist would gain."""
    fresh = added.select("playlist_id", "path").distinct().join(items.select("playlist_id", "path"), ["playlist_id", "path"], "left_anti")
    return fresh.groupBy("playlist_id").agg(F.count("*").alias("gained"))


def remove_paths(items: DataFrame, gone: DataFrame) -> DataFrame:
    return renumber(items.join(gone, ["playlist_id", "path"], "left_anti"))


def move_block(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Move blocks before anchors, many playlists at once.

    ``moves`` has playlist_id, block (paths) and anchor; a null anchor is the end. An anchor that is
    in the block or unknown leaves the list as it is. The block keeps its own order.
    """
    j = items.join(moves, "playlist_id", "left")
    in_block = F.coalesce(F.array_contains("block", F.col("path")), F.lit(False))
    anchors = items.select("playlist_id", F.col("path").alias("anchor"), F.col("position").alias("anchor_position"))
    j = j.withColumn("in_block", in_block).join(anchors, ["playlist_id", "anchor"], "left")
    valid = F.col("block").isNotNull() & (F.col("anchor").isNull() | (F.col("anchor_position").isNotNull() & ~F.coalesce(F.array_contains("block", F.col("anchor")), F.lit(False))))
    end = F.lit(2**62)
    j = j.withColumns({
        "major": F.when(valid & F.col("in_block"), F.when(F.col("anchor").isNull(), end).otherwise(F.col("anchor_position"))).otherwise(F.col("position")),
        "minor": F.when(valid & F.col("in_block"), 0).otherwise(1),
    })
    return renumber(j, "major", "minor", "position")


def drop_playlists(playlists: DataFrame, items: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Playlists and, with them, their items."""
    return playlists.join(gone.select("id"), "id", "left_anti"), items.join(gone.select(F.col("id").alias("playlist_id")), "playlist_id", "left_anti")
