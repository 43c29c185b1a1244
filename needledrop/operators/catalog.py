"""The catalogue view: stored rows with pending edits laid over them and all derived verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.functions import rules, text

#: The fields of a row's metadata, which a pending edit replaces as a whole.
METADATA = ("title", "artist", "album", "album_artist", "genre", "year", "track_number", "label", "bpm")


def scan(tracks: DataFrame, library_dir: str | None = None) -> DataFrame:
    """Rows of one library folder (a partition filter) or of all; order by path is up to the sink."""
    return tracks if library_dir is None else tracks.filter(F.col("library_dir") == library_dir)


def effective(tracks: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Replace the metadata of edited rows whole, null fields included; adds ``edited``."""
    if edits is None:
        return tracks.withColumn("edited", F.lit(False))
    pending = edits.select(F.col("path").alias("edit_path"), F.struct(*METADATA).alias("edit"))
    joined = tracks.join(pending, F.col("path") == F.col("edit_path"), "left")
    chosen = [F.when(F.col("edit_path").isNotNull(), F.col(f"edit.{m}")).otherwise(F.col(m)).alias(m) for m in METADATA]
    kept = [c for c in tracks.columns if c not in METADATA]
    return joined.select(*kept, *chosen, F.col("edit_path").isNotNull().alias("edited"))


def catalog_view(tracks: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """Effective rows with issues, compatible, complete, album key, key names and format: derived on read, never stored."""
    df = effective(tracks, edits).withColumn("issues", rules.compat_issues())
    return df.withColumns({
        "compatible": rules.is_compatible(F.col("issues")),
        "complete": rules.is_complete(*(F.col(c) for c in METADATA[:4])),
        "file_name": text.file_name(F.col("path")),
        "album_tag": text.blank_to_null(F.col("album")),
        "album_key": F.coalesce(text.blank_to_null(F.col("album")), F.nullif(text.folder_name(F.col("path")), F.lit("")), F.lit("(No album)")),
        "group_artist": F.trim(F.coalesce("album_artist", "artist", F.lit(""))),
        "format": rules.format_label(F.col("codec"), F.col("container"), F.col("bits_per_sample")),
        "key_name": rules.key_name(F.col("key_pc"), F.col("key_minor")),
        "camelot": rules.camelot_name(F.col("key_pc"), F.col("key_minor")),
    })
