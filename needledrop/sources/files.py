"""File inventories, collection XML, reference CSV: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.functions.text import EXTENSIONS, blank_to_null, file_name, name_hash
from needledrop.operators.filters import number_in_order
from needledrop.scratch import materialise

#: Our columns and the attributes of a collection's elements that hold them.
TEXT_ATTRIBUTES = {"artist": "Artist", "album": "Album", "album_artist": "AlbumArtist", "genre": "Genre", "label": "Label", "kind": "Kind", "key_name": "Tonality", "added": "DateAdded"}
NUMBER_ATTRIBUTES = {"secs": "TotalTime", "sample_rate": "SampleRate", "size_bytes": "Size", "kbps": "BitRate", "track_number": "TrackNumber", "year_number": "Year"}
COLLECTION = ", ".join([
    "_TrackID bigint, _Name string, _AverageBpm double, _Location string, TEMPO array<struct<_Inizio:double,_Bpm:double>>",
    *(f"_{n} string" for n in TEXT_ATTRIBUTES.values()), *(f"_{n} bigint" for n in NUMBER_ATTRIBUTES.values()),
])
#: Columns of a numbered row that its element is made of.
EXPORTED = ("track_id", "path", "title", "artist", "album", "album_artist", "genre", "label", "container", "key_name", "download_date", "duration_secs", "size_bytes", "sample_rate", "track_number", "year", "bpm", "beat_secs")
REFERENCE = "name_hash string, bpm double, drift double, secs int, key string, beat_secs double"
#: Bytes that stay as they are in a location, and what kinds of containers are called.
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~/,()!+#$@?"
PLAIN_CLASS = "A-Za-z0-9_.~/,()!+#$@?\\-"
KINDS = {"aiff": "AIFF File", "aif": "AIFF File", "wav": "WAV File", "wave": "WAV File", "mp3": "MP3 File", "flac": "FLAC File", "m4a": "M4A File", "mp4": "M4A File", "aac": "M4A File"}
#: Why an element gives no reference row.
DROPPED = ("no BPM (never analysed)", "no grid (BPM from the tag, not from analysis)", "no location", "duplicate filename", "duplicate filename, disagreeing BPM")
#: The rest of an element's first tag; a quoted value may hold ``>``.
OPEN_TAG = r"""^\s(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+>"""
XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def inventory(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, size_bytes and mtime of the files below a folder with one of the extensions, without regard to case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(folder)
    listed = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    return audio_files(listed, extensions)


def audio_files(listing: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The files of a listing that have one of the extensions, without regard to case."""
    return listing.filter(F.lower(F.substring_index("path", ".", -1)).isin(*extensions))


def location_url(path: Column) -> Column:
    """``file://localhost`` and the path, each byte that is not plain as ``%XX``: plain stretches stay as they are."""
    plain = F.create_map(*[F.lit(x) for c in PLAIN for x in (f"{ord(c):02X}", c)])
    codes = F.regexp_extract_all(F.hex(path.cast("binary")), F.lit("(..)"), 1)
    by_byte = F.array_join(F.transform(codes, lambda h: F.coalesce(F.try_element_at(plain, h), F.concat(F.lit("%"), h))), "")
    runs = F.regexp_extract_all(path, F.lit(f"([{PLAIN_CLASS}]+|[^{PLAIN_CLASS}]+)"), 1)
    by_run = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[{PLAIN_CLASS}]"), r).otherwise(F.regexp_replace(F.hex(r.cast("binary")), "(..)", "%$1"))), "")
    return F.concat(F.lit("file://localhost"), F.when(F.is_valid_utf8(path), by_run).otherwise(by_byte))


def _plus_kept(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("file://localhost"), F.lit("")), F.lit("+"), F.lit("%2B"))


def location_path(url: Column) -> Column:
    return F.url_decode(_plus_kept(url))


def kind_of(container: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.lower(container)), F.lit("Unknown"))


def bit_rate(size: Column, secs: Column) -> Column:
    return F.when(secs > 0, F.round(size * 8.0 / secs / 1000.0).cast("bigint"))


def date_of_ms(ms: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86400000).cast("int")).cast("string")


def xml_escape(c: Column) -> Column:
    for char, entity in XML_ENTITIES:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def number_by_path(tracks: DataFrame) -> DataFrame:
    """Add ``track_id``, 1-based in path order. Only paths are sorted and written on the way."""
    return tracks.join(number_in_order(tracks.select("path"), F.col("path"), name="track_id"), "path")


def attributes(numbered: DataFrame) -> DataFrame:
    """Rows with every attribute of an element under our own name."""
    size, secs = F.col("size_bytes"), F.col("duration_secs")
    return numbered.withColumns({
        "name": F.coalesce("title", file_name(F.col("path"))), "kind": kind_of(F.col("container")), "added": date_of_ms(F.col("download_date")), "secs": F.greatest(F.round(secs), F.lit(0.0)).cast("bigint"),
        "kbps": F.when(size.isNotNull(), bit_rate(size, secs)), "year_number": F.trim("year").try_cast("int").cast("bigint"), "track_number": F.col("track_number").cast("bigint"), "sample_rate": F.col("sample_rate").cast("bigint"),
    })


def track_lines(numbered: DataFrame) -> DataFrame:
    """track_id and the XML element of each row; empty attributes are left out, a tempo with a grid gives a TEMPO child."""

    def attr(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f' {name}="'), xml_escape(value), F.lit('"'))).otherwise("")

    def number(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"')), F.lit(""))

    tempo = F.format_string("%.2f", F.bround(F.coalesce("bpm", F.lit(0.0)), 2))  # ties to even, as printf has them
    grid = F.col("beat_secs").isNotNull() & (F.col("bpm") > 0)
    parts = [number("TrackID", F.col("track_id")), attr("Name", F.col("name"))]
    parts += [attr(n, F.col(k)) for k, n in TEXT_ATTRIBUTES.items()] + [number(n, F.col(k)) for k, n in NUMBER_ATTRIBUTES.items()]
    line = F.concat(
        F.lit("<TRACK"), *parts, number("AverageBpm", tempo), number("Location", location_url(F.col("path"))),
        F.when(grid, F.concat(F.lit('><TEMPO Inizio="'), F.format_string("%.3f", F.bround("beat_secs", 3)), F.lit('" Bpm="'), tempo, F.lit('" Metro="4/4" Battito="1"/></TRACK>'))).otherwise("/>"),
    )
    return attributes(numbered).select("track_id", "path", line.alias("line"))


def document_lines(numbered: DataFrame, playlists: DataFrame, items: DataFrame) -> DataFrame:
    """The whole document as lines (section, major, minor, line) in that order: head, elements, playlist nodes with the entries of exported rows, ends."""
    spark = numbered.sparkSession

    def fixed(section: int, major: int, *lines: str) -> DataFrame:
        return spark.range(len(lines)).select(F.lit(section).alias("section"), F.lit(major).cast("bigint").alias("major"), F.lit(0).cast("bigint").alias("minor"), F.get(F.array(*map(F.lit, lines)), F.col("id").cast("int")).alias("line"))

    def rows(df: DataFrame, section: int, major: Column, minor: Column, line: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), major.cast("bigint").alias("major"), minor.cast("bigint").alias("minor"), line.alias("line"))

    zero, one = F.lit(0), F.lit(1)
    entries = playlist_entries(numbered, items)
    sizes = entries.groupBy(F.col("playlist_id").alias("id")).agg(F.count("*").alias("n"))
    nodes = playlists.join(sizes, "id", "left")
    node = F.concat(F.lit('<NODE Name="'), xml_escape(F.col("name")), F.lit('" Type="1" KeyType="0" Entries="'), F.coalesce("n", F.lit(0)).cast("string"), F.lit('">'))
    last = F.lit(2**63 - 1)
    parts = [
        fixed(0, 0, '<?xml version="1.0" encoding="UTF-8"?>', '<DJ_PLAYLISTS Version="1.0.0">'),
        rows(numbered.agg(F.count("*").alias("n")), 1, zero, zero, F.concat(F.lit('<COLLECTION Entries="'), F.col("n").cast("string"), F.lit('">'))),
        rows(track_lines(numbered), 2, F.col("track_id"), zero, F.col("line")),
        fixed(3, 0, "</COLLECTION>"),
        rows(playlists.agg(F.count("*").alias("n")), 3, one, zero, F.concat(F.lit('<PLAYLISTS><NODE Type="0" Name="ROOT" Count="'), F.col("n").cast("string"), F.lit('">'))),
        rows(nodes, 4, F.col("id"), F.lit(-1), node),
        rows(entries, 4, F.col("playlist_id"), F.col("position"), F.concat(F.lit('<TRACK Key="'), F.col("track_id").cast("string"), F.lit('"/>'))),
        rows(playlists, 4, F.col("id"), last, F.lit("</NODE>")),
        fixed(5, 0, "</NODE></PLAYLISTS>"),
        fixed(5, 1, "</DJ_PLAYLISTS>"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_document(lines: DataFrame, folder: str, compression: str = "none") -> None:
    """The document as text shards, in order: put one after the other they are one file, with ``gzip`` too. A new result replaces an old one."""
    order = ["section", "major", "minor"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(folder, compression=compression)


def playlist_entries(numbered: DataFrame, items: DataFrame) -> DataFrame:
    """Entries of exported rows only: playlist_id, position and track_id."""
    return items.join(numbered.select("path", "track_id"), "path").select("playlist_id", "position", "track_id")


def write_lines(lines: DataFrame, folder: str, order: str = "track_id") -> None:
    """Ordered text shards."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.text(folder)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Elements of collection documents of any layout, with ``place``, their order: a file, its blocks and lines, or a folder of shards.

    Files are cut at each start of an element, wherever it stands, so one file is read by many tasks; an attribute cannot
    hold a ``<``. Playlist entries have the same tag, but no id; elements without an end fall out.
    """
    cut = spark.read.option("lineSep", "<TRACK").text(path)
    opened = F.regexp_extract("value", OPEN_TAG, 0)
    whole = F.when(opened.endswith("/>"), opened).when(F.col("value").contains("</TRACK>"), F.concat(F.substring_index("value", "</TRACK>", 1), F.lit("</TRACK>")))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    elements = cut.select(place.alias("place"), F.when(opened != "", F.concat(F.lit("<TRACK"), whole)).alias("element")).filter("element is not null")
    return elements.select("place", F.from_xml("element", COLLECTION).alias("t")).select("place", "t.*").filter("_TrackID is not null")


def _reasons(collection: DataFrame) -> DataFrame:
    """Elements as reference rows, with the ``reason`` why one is left out by itself."""
    path = F.coalesce(F.try_url_decode(_plus_kept(F.col("_Location"))), _plus_kept(F.col("_Location")), F.lit(""))
    name = file_name(path)
    bpm, grid = F.coalesce("_AverageBpm", F.lit(0.0)), F.coalesce("TEMPO", F.array().cast("array<struct<_Inizio:double,_Bpm:double>>"))
    reason = F.when(bpm <= 0, DROPPED[0]).when(F.size(grid) == 0, DROPPED[1]).when(name == "", DROPPED[2])
    return collection.select(
        "place", reason.alias("reason"), name_hash(path).alias("name_hash"), F.bround(bpm, 2).alias("bpm"), F.bround(F.array_max(grid["_Bpm"]) - F.array_min(grid["_Bpm"]), 2).alias("drift"),
        F.coalesce("_TotalTime", F.lit(0)).alias("secs"), blank_to_null(F.trim("_Tonality")).alias("key"), F.bround(F.coalesce(F.get(grid, F.lit(0))["_Inizio"], F.lit(0.0)), 4).alias("beat_secs"),
    )


def _by_name(reasons: DataFrame) -> DataFrame:
    first = F.min(F.struct("place", "bpm", "drift", "secs", "key", "beat_secs")).alias("r")
    return reasons.filter("reason is null").groupBy("name_hash").agg(first, F.count_distinct("bpm").alias("tempos"), F.count("*").alias("n"))


def reference_rows(collection: DataFrame) -> DataFrame:
    """Reference rows of a collection: a tempo, a grid and a location are needed; of repeated names the first stays, unless their tempos differ."""
    return _by_name(_reasons(collection)).filter("tempos = 1").select("name_hash", "r.bpm", "r.drift", "r.secs", "r.key", "r.beat_secs")


def dropped_rows(collection: DataFrame) -> DataFrame:
    """(reason, n) of the elements that ``reference_rows`` leaves out; a name whose tempos differ counts once beside its repeats."""
    reasons = materialise(_reasons(collection))  # elements are parsed once for both counts
    own = reasons.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    names = _by_name(reasons).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), F.count_if(F.col("tempos") > 1).alias("differing"))
    pair = lambda reason, n: F.struct(F.lit(reason).alias("reason"), F.col(n).alias("n"))
    return own.unionByName(names.select(F.inline(F.array(pair(DROPPED[3], "repeated"), pair(DROPPED[4], "differing")))).filter("n > 0"))


def write_reference(rows: DataFrame, folder: str) -> None:
    """Sorted rows in fixed columns with a header."""
    rows.select("name_hash", "bpm", "drift", "secs", "key", "beat_secs").repartitionByRange("name_hash").sortWithinPartitions("name_hash").write.option("header", "true").csv(folder)


def read_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a reference CSV; comments, headers and unreadable rows fall out, key and beat may be missing."""
    rows = spark.read.option("comment", "#").option("mode", "PERMISSIVE").schema(REFERENCE).csv(folder)
    return rows.filter("name_hash is not null and bpm > 0 and drift is not null and secs is not null")
