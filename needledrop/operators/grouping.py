"""Album, label, folder and playlist roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.functions import text

NO_NUMBER = 2**31 - 1


def album_items(catalog: DataFrame) -> DataFrame:
    """Every row with its album group, or none (``is_group`` false), and its place within it by track number."""
    w = Window.partitionBy("album_key")
    grouped = (F.count("*").over(w) >= 2) | F.max(F.col("album_tag").isNotNull()).over(w)
    place = F.row_number().over(w.orderBy(F.coalesce("track_number", F.lit(NO_NUMBER)), "path"))
    return catalog.withColumns({"is_group": grouped, "place": place.cast("bigint")})


def group_numbers(catalog: DataFrame, *by: Column | str) -> DataFrame:
    """Length, newest date (null as 0) and mean tempo of each group."""
    return catalog.groupBy(*by).agg(F.sum("duration_secs").alias("length"), F.max(F.coalesce("download_date", F.lit(0))).alias("date"), F.avg("bpm").alias("bpm"))


def summarize(catalog: DataFrame, *by: Column | str) -> DataFrame:
    """The header of each group: counts, length, dates, shared format and artist, albums, tempo span."""
    artist = F.nullif(F.col("group_artist"), F.lit(""))
    low, high = F.min(F.floor(F.col("bpm") + 0.5)), F.max(F.floor(F.col("bpm") + 0.5))
    return catalog.groupBy(*by).agg(
        F.count("*").alias("tracks"),
        F.sum("duration_secs").alias("total_length"),
        F.max("download_date").alias("newest_date"),
        F.when(F.count_distinct("format") == 1, F.min("format")).otherwise("Mixed").alias("format"),
        F.when(F.count_distinct(artist) == 1, F.min(artist)).when(F.count_distinct(artist) > 1, "Various").otherwise("").alias("artist"),
        F.count_distinct("album_key").alias("albums"),
        F.when(low.isNull(), "-").when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string"))).alias("bpm"),
        F.count_if(~F.col("compatible")).alias("to_convert"),
        F.count_if(~F.col("complete")).alias("incomplete"),
    )


def label_tree(catalog: DataFrame) -> DataFrame:
    """Rows of each label's albums and loose tracks; the empty label comes last.

    Returns label, album (null: loose), path, label_rank_last and the place within the album or
    among the loose rows.
    """
    labelled = catalog.withColumn("label_key", F.coalesce(F.trim("label"), F.lit("")))
    w = Window.partitionBy("label_key", "album_key")
    grouped = labelled.withColumn("is_group", (F.count("*").over(w) >= 2) | F.max(F.col("album_tag").isNotNull()).over(w))
    grouped = grouped.withColumn("node_album", F.when(F.col("is_group"), F.col("album_key")))
    title = text.natural_key(F.trim(F.coalesce("title", "file_name")))
    number = F.when(F.col("is_group"), F.coalesce("track_number", F.lit(NO_NUMBER))).otherwise(0)
    place = F.row_number().over(Window.partitionBy("label_key", "node_album").orderBy(number, title, "path"))
    return grouped.select("label_key", "node_album", "path", (F.col("label_key") == "").alias("comes_last"), place.cast("bigint").alias("place"))


def label_summary(catalog: DataFrame) -> DataFrame:
    """Per label: rows, album groups, loose rows, and whether it is the unknown bucket."""
    rows = label_tree(catalog)
    return rows.groupBy("label_key", "comes_last").agg(F.count("*").alias("tracks"), F.count_distinct("node_album").alias("albums"), F.count_if(F.col("node_album").isNull()).alias("loose"))


def folder_ancestors(catalog: DataFrame, root: str) -> DataFrame:
    """Every row once for each folder from ``root`` down to its own; rows outside the root are in the root only."""
    base = root.rstrip("/")
    inside = F.col("path").startswith(base + "/")
    relative = F.when(inside, F.substring(F.col("path"), len(base) + 2, 1 << 20)).otherwise("")
    parts = F.filter(F.split(relative, "/"), lambda x: x != "")
    depth = F.greatest(F.size(parts) - 1, F.lit(0))
    folders = F.transform(F.sequence(F.lit(0), depth), lambda n: F.concat_ws("/", F.lit(base), F.when(n > 0, F.array_join(F.slice(parts, 1, n), "/"))))
    return catalog.withColumn("ancestors", folders).select("*", F.posexplode("ancestors").alias("depth", "folder"), F.size("ancestors").alias("levels")).drop("ancestors")


def folder_tree(catalog: DataFrame, root: str) -> DataFrame:
    """Per folder: rows below it, rows directly in it, and its parent."""
    rows = folder_ancestors(catalog.select("path"), root)
    own = F.col("depth") == F.col("levels") - 1
    return rows.groupBy("folder").agg(F.min("depth").alias("depth"), F.count("*").alias("tracks_below"), F.count_if(own).alias("tracks_direct"))


def playlist_groups(items: DataFrame, visible: DataFrame) -> DataFrame:
    """Visible rows in each playlist with the position in the whole list, and the rows in none under id -1."""
    placed = items.select("playlist_id", "path", (F.col("position") + 1).alias("position"), F.count("*").over(Window.partitionBy("playlist_id")).alias("list_size"))
    inside = visible.select("path").join(placed, "path").select("playlist_id", "path", "position", "list_size")
    loose = visible.select("path").join(items.select("path"), "path", "left_anti")
    none = F.lit(None).cast("bigint")
    return inside.unionByName(loose.select(F.lit(-1).cast("bigint").alias("playlist_id"), "path", none.alias("position"), none.alias("list_size")))


def playlist_counts(playlists: DataFrame, items: DataFrame) -> DataFrame:
    """All playlists with the number of their items, none as 0."""
    counts = items.groupBy("playlist_id").agg(F.count("*").alias("n"))
    return playlists.join(counts, playlists["id"] == counts["playlist_id"], "left").select("id", "name", "created_ms", F.coalesce("n", F.lit(0)).alias("items"))


def playlist_paths(items: DataFrame) -> DataFrame:
    """Each playlist's paths in order, as one array; a playlist is a user's list, of bounded size."""
    return items.groupBy("playlist_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x["path"]).alias("paths"))
