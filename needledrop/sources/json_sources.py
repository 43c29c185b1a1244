"""Nested JSON documents as tables: snapshots, purchases, recordings, release searches, page data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PURCHASES = (
    "items array<struct<sale_item_id:bigint,sale_item_type:string,item_title:string,album_title:string,band_name:string,item_type:string,item_art_id:bigint>>, redownload_urls map<string,string>"
)
RECORDINGS = (
    "recordings array<struct<id:string,title:string,`artist-credit`:array<struct<name:string>>,releases:array<struct<id:string,title:string,date:string>>,"
    "tags:array<struct<name:string,count:int>>,score:int>>"
)
RELEASES = "results array<struct<style:array<string>,genre:array<string>,year:string,label:array<string>>>"
SNAPSHOT = "library_dir string, tracks array<struct<path:string,title:string,bpm:double>>, edits map<string,struct<title:string>>, duplicates array<struct<id:string,keep:string,files:array<string>>>"
#: XML entities, the ampersand last.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def purchases(raw: DataFrame, column: str = "json") -> DataFrame:
    """One row per purchase: key (type, ``p`` by default, and id), title or album title, art and page URL; rows without id go."""
    doc = raw.select(F.from_json(column, PURCHASES).alias("d")).select(F.col("d.redownload_urls").alias("urls"), F.inline("d.items"))
    key = F.concat(F.coalesce("sale_item_type", F.lit("p")), F.col("sale_item_id").cast("string"))
    art = F.concat(F.lit("a"), F.lpad(F.col("item_art_id").cast("string"), 10, "0"))
    rows = doc.filter("sale_item_id is not null").withColumn("item_key", key)
    return rows.select("item_key", F.coalesce(F.nullif("item_title", F.lit("")), "album_title").alias("title"), "band_name", "item_type", art.alias("art"), F.try_element_at("urls", F.col("item_key")).alias("page_url"))


def recordings(raw: DataFrame, column: str = "json") -> DataFrame:
    """Candidates: first credit, first release with its year, and the tag of the highest count (the last among equals)."""
    r = raw.select(F.from_json(column, RECORDINGS).alias("d")).select(F.inline("d.recordings"))
    tags = F.array_max(F.transform("tags", lambda t, i: F.struct(t["count"].alias("n"), i.alias("i"), t["name"].alias("name"))))
    release = F.get("releases", F.lit(0))
    year = F.nullif(F.substring(release["date"], 1, 4), F.lit(""))
    return r.select(
        F.col("id").alias("recording_id"), "title", F.get("artist-credit", F.lit(0))["name"].alias("artist"), release["title"].alias("album"), release["id"].alias("release_id"),
        F.when(F.length(year) == 4, year).alias("year"), tags["name"].alias("genre"), F.coalesce("score", F.lit(0)).alias("score"),
    )


def release_values(raw: DataFrame, key: str, column: str = "json", order: str | None = None) -> DataFrame:
    """(key, field, rank, value) of release searches; styles of all results come before genres.

    A search may come as several documents a key, each of bounded size; ``order`` is their column of page numbers.
    """
    page = F.col(order) if order else F.lit(0)
    r = raw.select(key, page.alias("page"), F.from_json(column, RELEASES).alias("d")).select(key, "page", F.posexplode("d.results").alias("result", "r"))
    parts = (("genre", 0, F.col("r.style")), ("genre", 1, F.col("r.genre")), ("year", 0, F.array("r.year")), ("label", 0, F.col("r.label")))
    fields = F.array(*[F.struct(F.lit(field).alias("field"), F.lit(source).alias("source"), values.alias("v")) for field, source, values in parts])
    v = r.select(key, "page", "result", F.inline(fields)).select(key, "field", "source", "page", "result", F.posexplode("v").alias("pos", "value"))
    return v.filter("value is not null").select(key, "field", F.struct("source", "page", "result", "pos").alias("rank"), "value")


def snapshot(raw: DataFrame, column: str = "json") -> DataFrame:
    return raw.select(F.from_json(column, SNAPSHOT).alias("s")).select("s.*")


def snapshot_tracks(snap: DataFrame) -> DataFrame:
    """Tracks of a snapshot; without a folder there are none."""
    return snap.filter("library_dir is not null").select("library_dir", F.inline("tracks"))


def snapshot_edits(snap: DataFrame) -> DataFrame:
    return snap.select(F.explode("edits").alias("path", "edit")).select("path", "edit.title")


def snapshot_groups(snap: DataFrame) -> DataFrame:
    return snap.select(F.inline("duplicates"))


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def escape(c: Column) -> Column:
    """The text of an attribute's value."""
    for entity, char in (("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def page_attribute(html: Column, attribute: str) -> Column:
    """The unescaped text of the first ``attribute="..."``; null where there is none."""
    return unescape(F.nullif(F.regexp_extract(html, rf'\b{attribute}="([^"]*)"', 1), F.lit("")))


def first_format(downloads: Column, preference: list[str]) -> Column:
    """Of a map of formats, the value of the first preferred one that is there."""
    return F.coalesce(*[F.try_element_at(downloads, F.lit(p)) for p in preference])


PAGE_DATA = "digital_items array<struct<downloads:map<string,struct<url:string>>>>"


def page_downloads(pages: DataFrame, preference: list[str], attribute: str = "data-blob") -> DataFrame:
    """(page_id, data, download): the page's data as text, and its first item's URL in the first preferred format; null where there is none or the data are no JSON."""
    rows = pages.select("page_id", page_attribute(F.col("html"), attribute).alias("data"))
    whole = F.when(F.try_parse_json("data").isNotNull(), F.from_json("data", PAGE_DATA))
    first = F.get(whole["digital_items"], F.lit(0))["downloads"]
    return rows.select("page_id", "data", first_format(F.transform_values(first, lambda _, v: v["url"]), preference).alias("download"))
