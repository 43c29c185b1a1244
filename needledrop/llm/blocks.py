"""Blocks of documents, and packed messages between blocks and hash buckets.

Operators that compare every text with every other work in turns: each block of documents
sends to each hash bucket one packed message of what it holds there, a bucket answers with
one message to each block concerned. A block is a hash class of document ids, small enough
for a task, so a value that is common all over the corpus is sent at most once by a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE = "block int, bucket int, payload binary"
NAMES = ["block", "bucket", "payload"]
#: Bytes of text in a block. Larger blocks send fewer and larger messages.
BLOCK_BYTES = 6 << 20
#: Pairs that are looked at together in a task.
STEP = 1 << 19


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Numbers of blocks and of buckets: as many as the bytes of all texts need, and some for each shuffle partition."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    needed, partitions = -(-total // block_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(needed, partitions), max(needed, partitions)


def in_blocks(docs: DataFrame, n: int) -> DataFrame:
    """block, doc_id and text as bytes (null: empty) of every row. Rows of one id are in one block, those of none are dealt by text."""
    return docs.select(
        F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n)).cast("int").alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def send_each(blocked: DataFrame, work: Callable[[int, pa.Table], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Messages of every block: ``work(block, rows ordered by doc_id)`` gives (block, bucket, payload)."""

    def run(key, table):
        return messages(work(key[0].as_py(), ordered(table)))

    return blocked.groupBy("block").applyInArrow(run, MESSAGE)


def answer_each(sent: DataFrame, work: Callable[[int, list[tuple[int, bytes]]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """Messages of every bucket: ``work(bucket, [(block, payload)] ordered by block)``."""

    def run(key, table):
        got = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
        return messages(work(key[0].as_py(), got))

    return sent.groupBy("bucket").applyInArrow(run, MESSAGE)


def with_answers(blocked: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, list[tuple[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """``work(block, rows ordered by doc_id, [(bucket, payload)] ordered by bucket)`` for every block with rows."""
    empty = schema_of(schema)

    def run(key, rows, got):
        if not rows.num_rows:
            return empty.empty_table()
        return work(rows.column("block")[0].as_py(), ordered(rows), sorted(zip(got.column("bucket").to_pylist(), got.column("payload").to_pylist(), strict=True)))

    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def ordered(table: pa.Table) -> pa.Table:
    """Rows by doc_id and text, nulls last: the same order each time a block is read."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def binary(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its entries in their order) of each bucket that has any."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and 0 <= bucket.min() and bucket.max() < 1 << 16 else bucket, kind="stable")
    found = bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(found)], strict=True) if len(edges) else ():
        yield int(found[a]), order[a:b]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each with its length in bytes."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], dtype=np.int64).tobytes() + b"".join(parts)


def unpack(payload: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(payload, dtype=np.int64, count=len(types))
    at, out = 8 * len(types), []
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(payload, dtype=t, count=n // np.dtype(t).itemsize, offset=at))
        at += n
    return out


def answer_with(sent: DataFrame, more: DataFrame, work: Callable[[int, list[tuple[int, bytes]], list[tuple[int, bytes]]], list[tuple[int, int, bytes]]]) -> DataFrame:
    """As ``answer_each``, with further messages to the buckets: ``work(bucket, sent, more)``, both ordered by block."""

    def pairs(table: pa.Table) -> list[tuple[int, bytes]]:
        return sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))

    def run(key, first, second):
        bucket = (first if first.num_rows else second).column("bucket")[0].as_py()
        return messages(work(bucket, pairs(first), pairs(second)))

    return sent.groupBy("bucket").cogroup(more.groupBy("bucket")).applyInArrow(run, MESSAGE)


def ranges(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each of ``rows`` with all places from its ``low`` to its ``high``, about ``STEP`` at a time."""
    some = high - low
    rows = rows[some[rows] > 0]
    upto, at = np.cumsum(some[rows]), 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        part = rows[at:end]
        at = end
        for skip in range(0, int(some[part].max()), STEP):
            k = np.clip(some[part] - skip, 0, STEP)
            yield np.repeat(part, k), np.repeat(low[part] + skip - (np.cumsum(k) - k), k) + np.arange(k.sum())
