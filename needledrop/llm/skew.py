"""Joins of rows with a table of one row a key, where one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this part of all rows are looked up in a broadcast table: there are fewer of them than this.
PARTS = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``found``, the struct of the key's other columns in ``table``; null where the table lacks the key.

    ``table`` has one row a key. The rows of frequent keys stay where they are, all others are shuffled by key.
    """
    packed = table.select(key, F.struct(*[c for c in table.columns if c != key]).alias("found"))
    often = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > F.lit(rows.count() // PARTS)).select(key)
    split = rows.join(F.broadcast(packed.join(often, key)), key, "left")
    cold = split.filter("found is null").drop("found").join(packed, key, "left")
    return split.filter("found is not null").unionByName(cold)
