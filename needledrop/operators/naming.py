"""Names for new files that clash with none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAME = ["dir", "stem", "ext"]


def numbered_name(k: Column) -> Column:
    """``dir/stem.ext`` for 1, ``dir/stem (k).ext`` for others."""
    return F.concat("dir", F.lit("/"), "stem", F.when(k > 1, F.concat(F.lit(" ("), k.cast("string"), F.lit(")"))).otherwise(""), F.lit("."), "ext")


def taken_numbers(paths: DataFrame) -> DataFrame:
    """(dir, stem, ext, taken): every way to read a path as a name with a number, the plain name being number 1."""
    p = F.col("path")
    parts = paths.select(F.regexp_extract(p, r"(?s)^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract(p, r"([^/]*)\.([^./]*)$", 1).alias("base"), F.regexp_extract(p, r"\.([^./]*)$", 1).alias("ext"))
    number = F.regexp_extract("base", r"^.* \(([2-9]|[1-9][0-9]{1,8})\)$", 1)
    plain = parts.select("dir", F.col("base").alias("stem"), "ext", F.lit(1).cast("bigint").alias("taken"))
    other = parts.filter(number != "").select("dir", F.regexp_extract("base", r"^(.*) \([0-9]+\)$", 1).alias("stem"), "ext", number.cast("bigint").alias("taken"))
    return plain.unionByName(other).distinct()


def _first_free(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows with the name of their turn: in path order each takes the first number that is free in its group.

    The i-th free number is i plus the taken numbers t, the j-th of them, for which t - j < i: one window counts them.
    """
    turn = Window.partitionBy(*NAME).orderBy("path")
    rows = wanted.withColumn("at", F.row_number().over(turn).cast("bigint"))
    held = taken_numbers(paths).join(wanted.select(*NAME).distinct(), NAME, "left_semi")
    held = held.select(*NAME, (F.col("taken") - F.row_number().over(Window.partitionBy(*NAME).orderBy("taken"))).alias("at"))
    both = rows.select(*NAME, "at", "path", F.lit(0).alias("held")).unionByName(held.select(*NAME, "at", F.lit(None).cast("string").alias("path"), F.lit(1).alias("held")))
    before = Window.partitionBy(*NAME).orderBy("at", "held").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row comes before what its place equals
    k = F.col("at") + F.sum("held").over(before)
    return both.withColumn("k", k).filter("held = 0").withColumn("target", numbered_name(F.col("k"))).select("path", *NAME, "target")


def free_names(wanted: DataFrame, existing: DataFrame, max_rounds: int = 20) -> DataFrame:
    """Add ``target`` to rows (path, dir, stem, ext): ``stem.ext``, or the first of ``stem (2).ext`` and so on that ``existing`` (path) lacks.

    Names are dealt in path order. Where two stems lead to one name, as ``a (2)`` and the second of ``a``, the
    first path keeps it and the others are dealt again.
    """
    done, rest, held = None, wanted.select("path", *NAME), existing.select("path")
    for _ in range(max_rounds):
        named = _first_free(rest, held).withColumn("first", F.row_number().over(Window.partitionBy("target").orderBy("path")) == 1)
        kept = named.filter("first").drop("first")
        done = kept if done is None else done.unionByName(kept)
        rest = named.filter("not first").select("path", *NAME)
        if rest.isEmpty():
            return done
        held = held.unionByName(kept.select(F.col("target").alias("path")))
    raise RuntimeError("no free names found")
