"""Facets, search and counts over a catalogue view."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.scratch import materialise


@dataclass
class TrackFilter:
    """Facet parameters: AND between facets, OR within one; ranges are closed and may be half-open."""

    bpm: tuple[float | None, float | None] = (None, None)
    year: tuple[int | None, int | None] = (None, None)
    genres: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    purchased: bool | None = None
    needs_convert: bool = False
    incomplete_only: bool = False

    def column(self) -> Column:
        out = F.lit(True)
        for value, (low, high) in ((F.col("bpm"), self.bpm), (text.parse_year(F.col("year")), self.year)):
            if low is not None or high is not None:
                out = out & value.isNotNull()  # no value is in no range
            if low is not None:
                out = out & (value >= low)
            if high is not None:
                out = out & (value <= high)
        for value, chosen in ((F.col("genre"), self.genres), (F.col("key_name"), self.keys)):
            if chosen:
                out = out & F.coalesce(F.lower(F.trim(value)).isin(*[c.strip().lower() for c in chosen]), F.lit(False))
        if self.purchased is not None:
            out = out & (F.col("purchased") if self.purchased else ~F.col("purchased"))
        if self.needs_convert:
            out = out & ~F.col("compatible")
        if self.incomplete_only:
            out = out & ~F.col("complete")
        return out


def search_column(query: str) -> Column:
    """Substring over the searchable fields joined by spaces, empty ones left out; a match may span fields."""
    q = query.strip().lower()
    if not q:
        return F.lit(True)
    fields = ("title", "artist", "album", "album_artist", "label", "genre", "year", "file_name")
    return F.lower(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in fields])).contains(q)


def filter_tracks(catalog: DataFrame, facets: TrackFilter, query: str = "") -> DataFrame:
    return catalog.filter(facets.column() & search_column(query))


def facet_counts(catalog: DataFrame) -> DataFrame:
    """One row: total, to_convert, incomplete, purchased, local."""
    return catalog.agg(
        F.count("*").alias("total"), F.count_if(~F.col("compatible")).alias("to_convert"), F.count_if(~F.col("complete")).alias("incomplete"),
        F.count_if("purchased").alias("purchased"), F.count_if(~F.col("purchased")).alias("local"),
    )


def distinct_genres(catalog: DataFrame) -> DataFrame:
    """Genres without regard to case, in the spelling of the first path."""
    g = text.blank_to_null(F.col("genre"))
    return catalog.select("path", g.alias("genre")).filter("genre is not null").groupBy(F.lower("genre").alias("folded")).agg(F.min_by("genre", "path").alias("genre"))


def distinct_keys(catalog: DataFrame) -> DataFrame:
    """Key names with their place on the Camelot wheel; unknown ones come last."""
    number, letter = (F.regexp_extract("camelot", r"^(\d{1,2})([AB])$", i) for i in (1, 2))
    rank = F.when(number != "", number.cast("int") * 2 + (letter == "B").cast("int")).otherwise(2**31 - 1)
    named = catalog.filter("key_name is not null").withColumn("rank", rank)
    return named.groupBy(F.lower("key_name").alias("folded")).agg(F.min_by("key_name", "path").alias("key_name"), F.min_by("rank", "path").alias("rank"))


def latest_per_path(rows: DataFrame, seq: str, value: str) -> DataFrame:
    """One row a path: the value of the highest sequence number."""
    return rows.groupBy("path").agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def newest(rows: DataFrame, n: int, by: str = "id", within: str | None = None) -> DataFrame:
    """The newest ``n`` rows, of all or of each ``within``."""
    if within is None:
        return rows.orderBy(F.desc(by)).limit(n)
    return rows.withColumn("newest_rank", F.row_number().over(Window.partitionBy(within).orderBy(F.desc(by)))).filter(F.col("newest_rank") <= n).drop("newest_rank")


def event_log(events: DataFrame, seen: int, known: tuple[str, ...] = ("info", "warning", "error")) -> DataFrame:
    """Events with a level (unknown ones read as info) and whether they are unread; ``seen`` never moves back."""
    return events.withColumns({"level": F.when(F.col("level").isin(*known), F.col("level")).otherwise("info"), "unread": F.col("id") > seen})


def sort_tracks(catalog: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Add ``place``-able sort columns and order; nulls and empty texts come last both ways."""
    value = {
        "title": text.natural_key(F.nullif(F.trim(F.coalesce("title", "file_name")), F.lit(""))),
        "artist": text.natural_key(F.nullif(F.col("group_artist"), F.lit(""))),
        "album": text.natural_key(F.trim("album_key")),
        "length": F.col("duration_secs"),
        "date": F.coalesce("download_date", F.lit(0)),
        "bpm": F.col("bpm"),
    }[key]
    return catalog.withColumn("sort_value", value).orderBy(F.desc_nulls_last("sort_value") if descending else F.asc_nulls_last("sort_value"), "path")


def number_in_order(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Add ``name``, the 1-based place of each row in an order: ranges are numbered apart and moved by the ranges before them."""
    ranged = materialise(rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = ranged.groupBy("range_no").agg(F.count("*").alias("n")).select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = ranged.join(F.broadcast(starts), "range_no").withColumn(name, (F.col("start") + F.row_number().over(Window.partitionBy("range_no").orderBy(*order))).cast("bigint"))
    return numbered.drop("range_no", "start")
