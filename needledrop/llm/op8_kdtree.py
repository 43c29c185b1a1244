"""Sharding by a k-d tree over metadata.

The whole table is one node at first. Every node that stands for more than one shard is
split at a weighted median along its widest metadata dimension; weights are bytes. The
median is found by distributed histograms over an order-preserving key: the bin that holds
it is cut into bins again, so no node's rows ever meet in one task. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.scratch import materialise

#: The order key has 62 bits: 31 of the dimension's place, 31 of a hash that parts equal places. A range of keys is cut into so many bins.
BINS = 256
#: Slots are dealt within (shard, part): at least so many parts, and more where a part would have more rows than this.
PARTS, PART_ROWS = 64, 50_000


def ranked(rows: DataFrame, name: str, code: str) -> DataFrame:
    """Add ``code``, the rank of the string ``name`` among all its distinct values; null counts as empty.

    Distinct values are dealt by ranges and numbered within each, past the counts of the ranges before.
    """
    value = F.coalesce(F.col(name), F.lit(""))
    parts = materialise(rows.select(value.alias("value")).distinct().repartitionByRange("value").select("value", F.spark_partition_id().alias("range")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row a partition
    codes = parts.join(starts, "range").select("value", (F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1).cast("double").alias(code))
    return rows.join(codes, value == codes["value"]).drop("value")


def _place(dim: str, low: float, high: float) -> Column:
    span = high - low
    return F.lit(0).cast("bigint") if not span > 0 else F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(dim) - low) / span)) * (2**31 - 1))


#: Up to so many nodes a table of them is one literal map; more are joined.
LITERAL_NODES = 256


def _looked_up(df: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """Add the columns after ``node`` of a small table to the rows whose shard is its node; null elsewhere."""
    kinds = [c.split() for c in columns.split(", ")]
    if len(rows) <= LITERAL_NODES:
        cells = [x for r in rows for x in (F.lit(r[0]), F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r[1:], kinds, strict=True)]))]
        found = df.withColumn("found", F.try_element_at(F.create_map(*cells), F.col("shard")))
        return found.select("*", *[F.col("found")[n].alias(n) for n, _ in kinds]).drop("found")
    values = ", ".join(f"({', '.join(map(repr, r))})" for r in rows)
    casts = ", ".join(f"cast({n} as {t}) as {n}" for n, t in kinds)
    table = df.sparkSession.sql(f"select node, {casts} from values {values} as t(node, {', '.join(n for n, _ in kinds)})")
    return df.join(F.broadcast(table), F.col("shard") == F.col("node"), "left").drop("node")


def kd_shards(rows: DataFrame, dims: list[str], n_shards: int | None = None, target_bytes: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """Add ``shard`` (0 up to the number of leaves) to rows with ``row_id``, ``size`` and numeric ``dims``.

    The number of leaves is ``n_shards``, or as many as leaves of ``target_bytes`` need. A node of
    an odd number of leaves is split in that proportion. A split's error is at most the
    ``tolerance``-th part of a shard's bytes, or one row where a single row weighs more.
    Null dims count as the smallest value; the split points of all nodes, 40 bytes each, pass
    through the driver.
    """
    names = [f"d{i}" for i in range(len(dims))]
    base = rows.select("*", *[F.coalesce(F.col(d), F.lit(0.0)).cast("double").alias(n) for d, n in zip(dims, names, strict=True)], (F.xxhash64("row_id").bitwiseAND(2**31 - 1)).alias("tie"))
    whole = base.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), *[f(n).alias(f"{k}{n}") for n in names for k, f in (("low", F.min), ("high", F.max))]).first()
    leaves = n_shards or max(1, math.ceil(whole["bytes"] / target_bytes))
    ends = {n: (whole[f"low{n}"] or 0.0, whole[f"high{n}"] or 0.0) for n in names}
    base = base.select("*", *[_place(n, *ends[n]).alias(f"p{n}") for n in names]).drop(*names)
    #: first shard of a node -> (number of its shards)
    nodes = {0: leaves}
    slack = tolerance * whole["bytes"] / leaves

    def key_along() -> Column:
        return F.try_element_at(F.array(*[F.col(f"p{n}") for n in names]), F.col("dim") + 1) * 2**31 + F.col("tie")

    #: written once a level, which keeps the plans of all later passes small
    now = materialise(base.withColumn("shard", F.lit(0)))

    while any(k > 1 for k in nodes.values()):
        spans = now.groupBy("shard").agg(F.sum("size").alias("bytes"), *[(F.max(f"p{n}") - F.min(f"p{n}")).alias(n) for n in names]).collect()
        search = {r["shard"]: {"dim": max(range(len(names)), key=lambda i, r=r: (r[names[i]], -i)), "left": r["bytes"] * (nodes[r["shard"]] // 2) / nodes[r["shard"]]} for r in spans if nodes[r["shard"]] > 1}
        done = {}
        search = {k: v | {"low": 0, "high": 2**62 - 1} for k, v in search.items()}
        while search:
            keyed = _looked_up(now, [(k, v["dim"], v["low"], v["high"]) for k, v in search.items()], "dim int, low bigint, high bigint").withColumn("key", key_along()).filter("key between low and high")
            bins = keyed.groupBy("shard", F.expr(f"(key - low) div ((high - low) div {BINS} + 1)").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"))
            upto = Window.partitionBy("shard").orderBy("bin")
            hit = (
                _looked_up(bins.withColumn("upto", F.sum("bytes").over(upto)), [(k, float(v["left"])) for k, v in search.items()], "goal double")
                .filter(F.col("upto") >= F.col("goal"))
                .groupBy(F.col("shard").alias("node")).agg(F.min_by(F.struct("least", "most", "bytes", "upto"), "bin").alias("hit"))
            )
            for r in hit.collect():
                node, (low, high, weight, end) = r["node"], r["hit"]
                v = search[node]
                v["left"] -= end - weight
                v["low"], v["high"] = low, high
                if weight <= slack or low == high:
                    done[node] = (v["dim"], low if v["left"] < weight / 2 else high + 1)
            search = {k: v for k, v in search.items() if k not in done}
        level = []
        for node, (dim, cut) in done.items():
            half = nodes[node] // 2
            level.append((node, node + half, dim, cut))
            nodes[node], nodes[node + half] = half, nodes[node] - half
        for node in [k for k, v in nodes.items() if v > 1 and k not in done and not any(x[1] == k for x in level)]:
            nodes[node] = 1  # a node without rows has nothing to split
        if level:
            split = _looked_up(now, level, "at int, dim int, cut bigint")
            now = materialise(split.withColumn("shard", F.when(key_along() >= F.col("cut"), F.col("at")).otherwise(F.col("shard"))).drop("at", "dim", "cut"))
    return now.drop("tie", *[f"p{n}" for n in names])


def slots(sharded: DataFrame, n_parts: int = PARTS) -> DataFrame:
    """Add ``slot``: each shard's rows numbered from 0 without gaps, in an order of hashed row_id."""
    parted = sharded.withColumn("part", F.pmod(F.xxhash64("row_id", "text_crc32", "size"), F.lit(n_parts)))
    counts = parted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "part").orderBy("row_id", "size", "text_crc32")
    return parted.join(starts, ["shard", "part"]).withColumn("slot", (F.col("start") + F.row_number().over(order) - 1).cast("bigint")).drop("part", "start")


def shard_documents(docs: DataFrame, n_shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """Put all documents into shards of near equal bytes (law ``bytes``).

    Returns doc_id, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32, law,
    shard, slot, grown_shard (always null: a k-d tree moves rows when it grows), lang and source.
    Rows are single units: equal texts and repeated rows may part. Null doc_id, lang and source
    take part like any other value; a very long text is one row of its size; an empty table gives no rows;
    further columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    meta = materialise(docs.select(F.col("doc_id").alias("row_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source"))
    keyed = ranked(ranked(meta, "lang", "lang_code"), "source", "source_code").select("*", F.log2("size").alias("size_code"), F.col("row_id").cast("double").alias("id_code"))
    placed = kd_shards(keyed, ["lang_code", "source_code", "size_code", "id_code"], n_shards, target_bytes).drop("lang_code", "source_code", "size_code", "id_code")
    most = placed.groupBy("shard").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    return slots(placed, max(PARTS, -(-most // PART_ROWS))).select(
        F.col("row_id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "lang", "source",
    )
