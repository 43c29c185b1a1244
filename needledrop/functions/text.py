"""Text rules as native columns: normalisation, names, tokens, years and sort keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: File extensions that name comparison ignores.
EXTENSIONS = ("aiff", "aif", "wav", "flac", "alac", "m4a", "mp3", "aac", "ogg", "opus", "wma")
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a name that only starts with a dot keeps it."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_folder(path: Column) -> Column:
    """The folder part of a path, without the last slash."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def folder_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def norm_text(c: Column) -> Column:
    """Lower case; each run of other than letters and digits is one space."""
    return F.trim(F.regexp_replace(F.lower(c), SEPARATORS, " "))


def norm_album(c: Column) -> Column:
    """``norm_text`` without a ``Label - `` prefix, if at least two words follow it."""
    at = F.locate(" - ", c)
    after = F.substring(c, at + 3, F.length(c))
    words = F.size(F.filter(F.split(after, r"\s+"), lambda w: w != ""))
    return norm_text(F.when((at > 0) & (words >= 2), after).otherwise(c))


def strip_track_number(c: Column) -> Column:
    """Drop one to three leading digits where a space, dot, underscore or dash follows."""
    return F.regexp_replace(F.ltrim(c), r"^[0-9]{1,3}(?![0-9])[ ._-]+", "")


def core_title(title: Column, artist: Column, album: Column) -> Column:
    """The title without leading ``Artist - Album - 01`` segments; the last segment always stays."""
    parts, na, nal = F.split(title, " - ", -1), norm_text(F.coalesce(artist, F.lit(""))), norm_album(F.coalesce(album, F.lit("")))

    def known(x: Column) -> Column:
        return ((na != "") & (norm_text(x) == na)) | ((nal != "") & ((norm_text(x) == nal) | (norm_album(x) == nal)))

    last = F.size(parts)
    start = F.aggregate(
        F.slice(parts, 1, F.greatest(last - 1, F.lit(0))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, x: F.struct((s["n"] + (s["on"] & known(x)).cast("int")).alias("n"), (s["on"] & known(x)).alias("on")),
    )["n"]
    return norm_text(strip_track_number(F.array_join(F.slice(parts, start + 1, F.greatest(last, F.lit(1))), " - ")))


def name_tokens(c: Column) -> Column:
    """Distinct words of two bytes or more that are neither a number nor a file extension."""
    words = F.split(F.lower(c), SEPARATORS)
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.rlike(r"^\p{N}+$") & ~w.isin(*EXTENSIONS)))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def parse_year(c: Column) -> Column:
    """The first run of exactly four digits."""
    return F.nullif(F.regexp_extract(F.trim(c), r"(?:^|\D)(\d{4})(?:\D|$)", 1), F.lit("")).cast("int")


def natural_key(c: Column) -> Column:
    """A sort key in which digit runs of any length count as numbers, and neither case nor accents tell letters apart.

    A number is written behind its length, which is written behind the length of that; leading zeros do not count.
    """
    runs = F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), 1)

    def number(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        n = F.length(digits).cast("string")
        return F.concat(F.length(n).cast("string"), n, digits)

    return F.collate(F.array_join(F.transform(runs, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), ""), "UNICODE_CI_AI")


@F.pandas_udf(StringType())
def _decomposed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.str.normalize("NFKD")


@F.pandas_udf(StringType())
def _composed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.str.normalize("NFC")


def _if_not_ascii(c: Column) -> Column:
    return F.when(~c.rlike(r"^\p{ASCII}*$"), c)


def is_ascii(*columns: Column) -> Column:
    """Whether all of some texts are ASCII; nulls are."""
    return F.concat_ws("", *columns).rlike(r"^\p{ASCII}*$")


def match_key(c: Column, ascii_only: bool = False) -> Column:
    """Lower case, accents dropped, other than letters and digits as single spaces.

    Spark has no Unicode normalisation, so one Arrow UDF decomposes; it gets null in place of ASCII text, and
    is left out where texts are known to be ``ascii_only``.
    """
    plain = c if ascii_only else F.coalesce(_decomposed(_if_not_ascii(c)), c)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), "[̀-ͯ]", ""), r"[^\p{L}\p{N}]+", " "))


def name_hash(path: Column) -> Column:
    """Join key of a file name: 16 hexadecimal digits of the SHA-256 of its composed form."""
    name = file_name(path)
    composed = F.coalesce(_composed(_if_not_ascii(name)), name)
    return F.substring(F.sha2(composed, 256), 1, 16)


def split_leading_track(c: Column) -> tuple[Column, Column]:
    """(track number or null, the rest) of a file stem."""
    number = F.regexp_extract(c, r"^([0-9]{1,3})(?![0-9])[ ._-]+", 1)
    return F.nullif(number, F.lit("")).cast("int"), F.regexp_replace(c, r"^[0-9]{1,3}(?![0-9])[ ._-]+", "")


def clean_folder(c: Column) -> Column:
    """A folder name without leading years, brackets and catalogue numbers."""
    return F.trim(F.regexp_replace(F.trim(c), r"^[0-9 ()\[\]\-_.]+", ""))


def sanitize_name(c: Column) -> Column:
    """Reserved characters and controls of file names as underscores."""
    return F.regexp_replace(c, r'[/\\:*?"<>|\p{Cntrl}]', "_")
