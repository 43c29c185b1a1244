"""Row rules as native columns: compatibility, completeness, keys, tempo and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from needledrop.functions import text
from needledrop.functions.text import blank_to_null

#: Fixed values of the compatibility rules.
SAMPLE_RATES = (44100, 48000)
MAX_BITS = 24
LOSSY_EVERYWHERE = ("mp3", "aac")
NEWER_ONLY = ("flac", "alac")
ISSUES = "struct<code:string,message:string,severity:string>"
#: Pitch names, sharps only, and the pitch classes of natural letters.
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
NATURALS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def _issue(when: Column, code: str, severity: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(severity).alias("severity")))


def compat_issues() -> Column:
    """Array of {code, message, severity} from container, codec, sample_rate and bits_per_sample."""
    container, codec, rate, bits = F.lower("container"), F.lower("codec"), F.col("sample_rate"), F.col("bits_per_sample")
    pcm = codec.startswith("pcm_")
    pcm_container = container.contains("aiff") | container.contains("wav")
    every = F.array(
        _issue(rate == 0, "SAMPLE_RATE_UNKNOWN", "warning", F.lit("The sample rate is not known.")),
        _issue((rate != 0) & ~rate.isin(*SAMPLE_RATES), "SAMPLE_RATE", "error", F.concat(rate.cast("string"), F.lit(" Hz is not playable."))),
        _issue(pcm_container & ~pcm, "COMPRESSED_PCM_CONTAINER", "error", F.concat(container, F.lit(" must hold plain PCM, not "), codec)),
        _issue(pcm & (bits > MAX_BITS), "BIT_DEPTH", "error", F.concat(bits.cast("string"), F.lit(" bits are not playable."))),
        _issue(codec.isin(*NEWER_ONLY), "NEWER_PLAYERS_ONLY", "warning", F.concat(F.upper(codec), F.lit(" plays on newer players only."))),
        _issue(~(pcm | codec.isin(*LOSSY_EVERYWHERE, *NEWER_ONLY)), "UNSUPPORTED_CODEC", "error", F.concat(codec, F.lit(" is not playable."))),
    )
    return F.array_compact(every)


def is_compatible(issues: Column) -> Column:
    return ~F.exists(issues, lambda i: i["severity"] == "error")


def is_complete(title: Column, artist: Column, album: Column, album_artist: Column) -> Column:
    out = F.lit(True)
    for c in (title, artist, album, album_artist):
        out = out & blank_to_null(c).isNotNull()
    return out


def parse_key(raw: Column) -> Column:
    """struct<pc:int, minor:boolean> from ``Am``, ``F#m``, ``A minor`` or ``8A``; null for anything else."""
    text = F.trim(raw)
    number, wheel = F.regexp_extract(text, r"^(\d+)\s*([ABab])$", 1).try_cast("int"), F.upper(F.regexp_extract(text, r"^(\d+)\s*([ABab])$", 2))
    camelot = F.when(number.between(1, 12), F.struct(F.pmod(F.when(wheel == "A", 9).otherwise(0) + 7 * (number - 8), F.lit(12)).alias("pc"), (wheel == "A").alias("minor")))
    spelled = r"(?i)^([A-G])([#♯b♭]?)\s*(m|min|minor|maj|major)?$"
    letter, sign, mode = (F.regexp_extract(text, spelled, i) for i in (1, 2, 3))
    sign = F.when(sign == "B", "").otherwise(sign)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in NATURALS.items() for x in kv]), F.upper(letter))
    named = F.when((letter != "") & (F.regexp_extract(text, spelled, 2) != "B"), F.struct(F.pmod(base + F.when(sign.isin("#", "♯"), 1).when(sign.isin("b", "♭"), -1).otherwise(0), F.lit(12)).alias("pc"), F.lower(mode).isin("m", "min", "minor").alias("minor")))
    return F.when(text.rlike(r"^[0-9]"), camelot).otherwise(named)


def key_name(pc: Column, minor: Column) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, NOTES)), F.pmod(pc, F.lit(12)) + 1), F.when(minor, "m").otherwise(""))


def camelot_number(pc: Column, minor: Column) -> Column:
    n = F.pmod(8 + (pc - F.when(minor, 9).otherwise(0)) * 7, F.lit(12))
    return F.when(n == 0, 12).otherwise(n)


def camelot_name(pc: Column, minor: Column) -> Column:
    return F.concat(camelot_number(pc, minor).cast("string"), F.when(minor, "A").otherwise("B"))


def parse_bpm(raw: Column) -> Column:
    """A tempo with comma or point; null outside 1 to 1000."""
    v = F.replace(F.trim(raw), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(v.between(1, 1000), v)


def format_label(codec: Column, container: Column, bits: Column) -> Column:
    depth = F.when(bits > 0, F.concat(F.lit(" "), bits.cast("string"), F.lit("-bit"))).otherwise("")
    co, ct = F.lower(codec), F.lower(container)
    pcm = F.when(ct.contains("aiff"), "AIFF").when(ct.contains("wav"), "WAV").otherwise("PCM")
    return (
        F.when(co.startswith("pcm"), F.concat(pcm, depth))
        .when(co.isin("flac", "alac"), F.concat(F.upper(co), depth))
        .otherwise(F.upper(codec))
    )


def status_set(compatible: Column, warned: Column, edited: Column, complete: Column, purchased: Column) -> Column:
    return F.array_compact(F.array(
        F.when(~compatible, "convert"),
        F.when(compatible & warned, "note"),
        F.when(complete & edited, "complete").when(~complete, "incomplete"),
        F.when(purchased, "purchased"),
    ))


def target_sample_rate(rate: Column) -> Column:
    return F.when(rate.isin(*SAMPLE_RATES), rate).otherwise(44100)


#: Target formats with extension, codec at 16 and at 24 bits, and kbit/s where they are lossy.
TARGETS = {
    "aiff": ("aiff", "pcm_s16be", "pcm_s24be", None),
    "wav": ("wav", "pcm_s16le", "pcm_s24le", None),
    "flac": ("flac", "flac", "flac", None),
    "alac": ("m4a", "alac", "alac", None),
    "mp3": ("mp3", "libmp3lame", "libmp3lame", 320),
    "aac": ("m4a", "aac", "aac", 320),
}
TARGET_FORMATS = tuple(TARGETS)


def _of_target(target: Column, place: int) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for name, facts in TARGETS.items() for x in (name, facts[place])]), target)


def conversion_plan(rows: DataFrame) -> DataFrame:
    """Add to rows with path, sample_rate, bits_per_sample and ``target`` format: target_rate, codec, target_bits (null if lossy), kbps, output and in_place."""
    path, target, deep = F.col("path"), F.col("target"), F.col("bits_per_sample") > 16
    kbps = _of_target(target, 3)
    output = F.concat(text.parent_folder(path), F.lit("/"), F.trim(text.sanitize_name(text.stem(path))), F.lit("."), _of_target(target, 0))
    return rows.withColumns({
        "target_rate": target_sample_rate(F.col("sample_rate")).cast("int"),
        "codec": F.when(deep, _of_target(target, 2)).otherwise(_of_target(target, 1)),
        "target_bits": F.when(kbps.isNull(), F.when(deep, 24).otherwise(16)),
        "kbps": kbps,
        "output": output,
        "in_place": output == path,
    })
