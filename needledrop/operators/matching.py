"""Purchases against the catalogue, field suggestions, candidate lookups and covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.scratch import materialise

IMAGES = ("jpg", "jpeg", "png", "webp")
COVER_NAMES = ("cover", "folder", "front", "album", "artwork")


def _catalog_keys(catalog: DataFrame) -> DataFrame:
    """(path, artist_key, key, tied): each row's four keys; a ``tied`` one asks for the artist too. Empty ones are left out.

    Rows of ASCII names, most of all, do not pass through Python.
    """
    raw = {"artist": F.coalesce("artist", F.lit("")), "stem": text.stem(F.col("path")), "folder": text.folder_name(F.col("path")), "album": F.coalesce("album", F.lit("")), "title": F.coalesce("title", F.lit(""))}
    named = catalog.select("path", *[c.alias(f"n_{n}") for n, c in raw.items()])
    plain = text.is_ascii(*[F.col(f"n_{n}") for n in raw])

    def keyed(rows: DataFrame, ascii_only: bool) -> DataFrame:
        keys = [F.struct(text.match_key(F.col(f"n_{n}"), ascii_only).alias("key"), F.lit(n in ("album", "title")).alias("tied")) for n in raw if n != "artist"]
        return rows.select("path", text.match_key(F.col("n_artist"), ascii_only).alias("artist_key"), F.array(*keys).alias("keys"))

    rows = keyed(named.filter(plain), True).unionByName(keyed(named.filter(~plain), False))
    return rows.select("path", "artist_key", F.inline(F.array_distinct("keys"))).filter("key <> ''")


def _item_keys(items: DataFrame, *more: str) -> DataFrame:
    return items.select("item_key", text.match_key(F.col("title")).alias("key"), text.match_key(F.coalesce("band_name", F.lit(""))).alias("band"), *more).filter("key <> ''")


def _parts(c: Column, lengths: Column) -> Column:
    """The different parts of a text that have one of some lengths."""
    starts = lambda n: F.when(n <= F.length(c), F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(lengths, starts)))


def agreeing_artists(artists: DataFrame, bands: DataFrame) -> DataFrame:
    """Distinct (key, artist_key, band) of (key, artist_key) and (key, band) whose names agree: equal, one within the other, or one empty.

    A name within another is one of its parts, so pairs meet in joins on parts of the lengths that the other side of the
    key has; the names of one key are not compared with each other. An empty name is a part of every other.
    """
    a, b = artists.select("key", "artist_key").distinct(), bands.select("key", "band").distinct()

    def within(whole: DataFrame, name: str, part: DataFrame, part_name: str) -> DataFrame:
        lengths = part.groupBy("key").agg(F.collect_set(F.length(part_name)).alias("lengths"))
        cut = whole.join(lengths, "key").select("key", name, F.explode(_parts(F.col(name), F.col("lengths"))).alias(part_name))
        return cut.join(part, ["key", part_name]).select("key", "artist_key", "band")

    return within(a, "artist_key", b, "band").unionByName(within(b, "band", a, "artist_key")).distinct()


def _named_keys(catalog: DataFrame, items: DataFrame, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue keys that some item has, item keys, and the names that agree, written for several uses."""
    keys = materialise(_item_keys(items, *more))
    rows = materialise(_catalog_keys(catalog).join(keys.select("key").distinct(), "key", "left_semi"))
    return rows, keys, materialise(agreeing_artists(rows.filter("tied"), keys))


def purchase_matches(catalog: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct (path, item_key): file stem or folder equals the item's title; or album or title does and the artists agree.

    An OR of equalities would be a nested loop; each row brings its four keys to joins on the title key. Artists agree if
    equal, if either holds the other, or if either is empty; which names do is found once a name, so only rows that match meet.
    """
    rows, keys, agree = _named_keys(catalog, items)
    free = rows.filter("not tied").join(keys, "key").select("path", "item_key")
    tied = rows.filter("tied").join(agree, ["key", "artist_key"]).select("path", "key", "band").join(keys, ["key", "band"]).select("path", "item_key")
    return free.unionByName(tied).distinct()


def matched_items(catalog: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct item_key of ``purchase_matches``, without its pairs."""
    rows, keys, agree = _named_keys(catalog, items)
    free = keys.join(rows.filter("not tied").select("key").distinct(), "key", "left_semi")
    tied = keys.join(agree.select("key", "band").distinct(), ["key", "band"], "left_semi")
    return free.select("item_key").unionByName(tied.select("item_key")).distinct()


def latest_matches(catalog: DataFrame, items: DataFrame) -> DataFrame:
    """(path, item_key): each row's match of the highest ``ordinal``, without its other pairs: the last item of a key, and of a key and artist, is found first."""
    rows, keys, agree = _named_keys(catalog, items, "ordinal")
    last = lambda of, *by: of.groupBy(*by).agg(F.max_by(F.struct("item_key", "ordinal"), "ordinal").alias("m"))
    free = rows.filter("not tied").join(last(keys, "key"), "key").select("path", "m")
    names = agree.join(last(keys, "key", "band"), ["key", "band"]).groupBy("key", "artist_key").agg(F.max_by("m", F.col("m.ordinal")).alias("m"))
    tied = rows.filter("tied").join(names, ["key", "artist_key"]).select("path", "m")
    return free.unionByName(tied).groupBy("path").agg(F.max_by("m", F.col("m.ordinal")).alias("m")).select("path", "m.item_key")


def ledger_rows(ledger: DataFrame) -> DataFrame:
    """(item_key, path) of a ledger with a ``paths`` array."""
    return ledger.select("item_key", F.explode("paths").alias("path"))


def track_origins(matches: DataFrame, ledger: DataFrame, tracks: DataFrame, items: DataFrame) -> DataFrame:
    """Each purchased row's item, of matches (all, or each row's latest) and ledger hits; the later item wins."""
    hits = matches.unionByName(ledger_rows(ledger).join(tracks.select("path"), "path", "left_semi").select("path", "item_key"))
    return hits.join(items.select("item_key", "ordinal"), "item_key").groupBy("path").agg(F.max_by("item_key", "ordinal").alias("item_key"))


def item_presence(items: DataFrame, matches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items with whether they are there: among ``matches`` (of rows, or of items alone), or with a ledger entry that is not empty."""
    there = matches.select("item_key").unionByName(ledger.filter(F.size("paths") > 0).select("item_key")).distinct()
    return items.join(there.withColumn("there", F.lit(True)), "item_key", "left").select("item_key", F.col("there").isNotNull().alias("present"))


def prune_ledger(ledger: DataFrame, deleted: DataFrame) -> DataFrame:
    """Remove deleted paths; entries without paths go."""
    left = ledger.select("item_key", F.posexplode("paths").alias("pos", "path")).join(deleted.select("path"), "path", "left_anti")
    return left.groupBy("item_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("paths"))


def first_spellings(values: DataFrame, key: str, cap: int | None = 8) -> DataFrame:
    """Per key and field: trimmed values without regard to ASCII case, first spelling, in order, ``cap`` at most (the field's own limit).

    ``values`` has key, field, rank (struct of source rank, result and position) and value.
    """
    v = values.withColumn("value", F.trim("value")).filter("value <> ''")
    first = v.groupBy(key, "field", F.translate("value", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("folded")).agg(F.min(F.struct("rank", "value")).alias("first"))
    w = Window.partitionBy(key, "field").orderBy("first.rank")
    kept = first.withColumn("place", F.row_number().over(w))
    if cap is not None:
        kept = kept.filter(F.col("place") <= cap)
    return kept.groupBy(key, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("first.value").alias("value")))), lambda x: x["value"]).alias("suggestions"))


def guess_from_name(tracks: DataFrame) -> DataFrame:
    """track_number, artist, album and title guessed from a file's stem and folder."""
    number, rest = text.split_leading_track(text.stem(F.col("path")))
    rows = tracks.select("path", number.alias("guess_number"), rest.alias("rest")).withColumn("parts", F.split("rest", " - ", -1))
    n, part = F.size("parts"), lambda i: text.blank_to_null(F.get("parts", F.lit(i)))
    title = F.when(n == 1, part(0)).when(n == 2, part(1)).when(n == 3, part(2)).otherwise(text.blank_to_null(F.col("rest")))
    folder = text.blank_to_null(text.clean_folder(text.folder_name(F.col("path"))))
    return rows.select("path", "guess_number", F.when(n.isin(2, 3), part(0)).alias("guess_artist"), F.coalesce(F.when(n == 3, part(1)), folder).alias("guess_album"), title.alias("guess_title"))


def lookup_candidates(queries: DataFrame, recordings: DataFrame, top: int = 5) -> DataFrame:
    """The best ``top`` recordings for each (path, title, artist): equal titles, equal artists where one is given.

    The best of each title, and of each title and artist, are found first, so a query meets ``top`` rows, not all of its title.
    """
    q = queries.select("path", text.norm_text(F.col("title")).alias("k_title"), text.norm_text(F.coalesce("artist", F.lit(""))).alias("k_artist")).filter("k_title <> ''")
    r = recordings.select("recording_id", "score", text.norm_text(F.col("title")).alias("k_title"), text.norm_text(F.coalesce("artist", F.lit(""))).alias("k_artist"))

    def best(*by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("score"), "recording_id")
        return r.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= top).select(*by, "recording_id", "score", "place")

    given = F.col("k_artist") != ""
    hits = q.filter(given).join(best("k_title", "k_artist"), ["k_title", "k_artist"]).select("path", "recording_id", "score", "place")
    return hits.unionByName(q.filter(~given).join(best("k_title"), "k_title").select("path", "recording_id", "score", "place"))


def _extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def folder_covers(inventory: DataFrame) -> DataFrame:
    """Each folder's cover: the first image by path whose name holds a known word, else the first image."""
    images = inventory.filter(_extension(F.col("path")).isin(*IMAGES))
    name, known = F.lower(text.stem(F.col("path"))), F.lit(False)
    for word in COVER_NAMES:
        known = known | name.contains(word)
    return images.groupBy(text.parent_folder(F.col("path")).alias("folder")).agg(F.min(F.struct((~known).alias("other"), "path")).alias("c")).select("folder", F.col("c.path").alias("cover"))


def cover_availability(tracks: DataFrame, covers: DataFrame) -> DataFrame:
    rows = tracks.select("path", "has_cover", text.parent_folder(F.col("path")).alias("folder"))
    return rows.join(covers, "folder", "left").select("path", (F.col("has_cover") | F.col("cover").isNotNull()).alias("available"), "cover")
