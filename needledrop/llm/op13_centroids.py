"""Lloyd's rounds on integer vectors, with bounds kept in heaps: only vectors whose bound expires are looked at again.

Vectors lie in blocks, which are packed where they are read. A block keeps a heap for each cluster: an entry is a vector's
gap between the second nearest centroid and its own, raised by the drift that the cluster had accumulated by then. Once the
accumulated drift reaches an entry, the vector is popped and its distances are computed anew, in integers.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needledrop.llm.blocks import pack, unpack
from needledrop.scratch import materialise, scratch_folder

#: Vectors in a block, and bytes of vectors in a bucket of the tables that rounds read.
BLOCK, BUCKET_BYTES = 8192, 64 << 20
#: Scaled components stay below this, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Bounds are floating-point; they are widened by this part.
SLACK = 1e-9
PACKED = "block long, ids binary, vectors binary"
STATE = "block long, sums array<long>, state binary"


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers."""
    v = np.floor(vectors.astype(np.float64) * scale)
    if v.size and np.abs(v).max() >= LARGEST:
        raise ValueError(f"scaled components must lie below {LARGEST}")
    return v.astype(np.int64)


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and the doubles of every vector of ``dims`` components, none of which is null or not finite."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = (F.size("embedding") == dims) & F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return vectors.filter(F.col("embedding").isNotNull() & fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centroid, exact."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        d = vectors - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Block:
    """Clusters, sums and heaps of one block."""

    def __init__(self, vectors: np.ndarray, k: int, state: bytes | None = None, sums: np.ndarray | None = None) -> None:
        self.vectors, self.k = vectors, k
        if state is None:  # nothing is known: every vector expires at once
            self.cluster = np.full(len(vectors), -1, np.int8 if k < 128 else np.int32)
            self.heaps = [(np.full(len(vectors), -np.inf), np.arange(len(vectors), dtype=np.int32))] + [(np.zeros(0), np.zeros(0, np.int32))] * (k - 1)
            self.sums = np.zeros((k, vectors.shape[1] + 1), np.int64)
        else:
            cluster, sizes, keys, members = unpack(state, np.int8 if k < 128 else np.int32, np.int64, np.float64, np.int32)
            self.cluster, at = cluster.copy(), np.cumsum(sizes)[:-1]
            self.heaps = list(zip(np.split(keys, at), np.split(members, at), strict=True))
            self.sums = sums.reshape(k, -1).copy()

    def round(self, centroids: np.ndarray, drift: np.ndarray) -> int:
        """Assign the vectors whose gap the accumulated ``drift`` of their cluster has reached; how many were looked at."""
        heaps: dict[int, list] = {}
        popped: list[int] = []
        for j, (keys, members) in enumerate(self.heaps):
            if len(keys) and keys[0] <= drift[j]:
                heap = heaps[j] = list(zip(keys.tolist(), members.tolist(), strict=True))
                while heap and heap[0][0] <= drift[j]:
                    popped.append(heapq.heappop(heap)[1])
        if not popped:
            return 0
        rows = np.array(popped)
        d = distances(self.vectors[rows], centroids)
        nearest = d.argmin(axis=1)  # the smaller number among equals
        own = np.sqrt(d[np.arange(len(rows)), nearest])
        d[np.arange(len(rows)), nearest] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1)) if self.k > 1 else np.full(len(rows), np.inf)
        keys = second * (1 - SLACK) - own * (1 + SLACK) + drift[nearest]
        moved = np.flatnonzero(nearest != self.cluster[rows])
        counted = np.concatenate((self.vectors[rows[moved]], np.ones((len(moved), 1), np.int64)), axis=1)
        before = self.cluster[rows[moved]]
        for j in range(self.k):
            self.sums[j] += counted[nearest[moved] == j].sum(axis=0) - counted[before == j].sum(axis=0)
        self.cluster[rows] = nearest
        for key, i, j in zip(keys.tolist(), popped, nearest.tolist(), strict=True):
            if j not in heaps:
                heaps[j] = list(zip(*(x.tolist() for x in self.heaps[j]), strict=True))
            heapq.heappush(heaps[j], (key, i))
        for j, heap in heaps.items():
            self.heaps[j] = np.array([h[0] for h in heap]), np.array([h[1] for h in heap], np.int32)
        return len(rows)

    def packed(self) -> bytes:
        keys, members = zip(*self.heaps, strict=True)
        return pack(self.cluster, np.array([len(x) for x in keys], np.int64), np.concatenate(keys), np.concatenate(members).astype(np.int32))


class Drift:
    """Drift of each cluster's gap: how far its own centroid and the fastest other one have come."""

    def __init__(self, k: int) -> None:
        self.total = np.zeros(k)

    def add(self, before: np.ndarray, after: np.ndarray) -> None:
        moved = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        for j in range(len(moved)):
            self.total[j] += moved[j] + np.delete(moved, j).max(initial=0.0)


class Tables:
    """Tables of one run, bucketed by block in the shared folder, so that rounds join them without a shuffle."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.run = spark, buckets, uuid.uuid4().hex

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table = f"needledrop_{self.run}_{name}"
        path = f"{scratch_folder(self.spark)}/needledrop/{table}"
        df.write.option("path", path).bucketBy(self.buckets, "block").sortBy("block").format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def forget(self, name: str) -> None:
        """Drop a table and its files, once the next round's is written."""
        table = f"needledrop_{self.run}_{name}"
        self.spark.sql(f"drop table if exists {table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(self.spark)}/needledrop/{table}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def packed_blocks(rows: DataFrame, dims: int, scale: int, block: int) -> DataFrame:
    """Blocks of up to ``block`` vectors, made where the rows are read, without a shuffle."""

    def run(batches):
        from pyspark import TaskContext

        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block_of(table):
            nonlocal made
            number = (part << 32) + made
            made += 1
            ids = table.column("vec_id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            flat = table.column("x").combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            v = scaled(np.asarray(flat.flatten()).reshape(-1, dims), scale)
            least = next(t for t in (np.int16, np.int32) if not v.size or np.abs(v).max() < np.iinfo(t).max)
            known, value = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
            return pa.record_batch(
                [pa.array([number], pa.int64()), pa.array([pack(value, known)], pa.binary()), pa.array([pack(np.array([np.dtype(least).itemsize]), v.astype(least))], pa.binary())],
                names=["block", "ids", "vectors"],
            )

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block:
                table = pa.Table.from_batches(held)
                yield block_of(table.slice(0, block))
                held, n = table.slice(block).to_batches(), n - block
        if n:
            yield block_of(pa.Table.from_batches(held))

    return rows.mapInArrow(run, PACKED)


def vectors_of(packed: bytes, dims: int) -> np.ndarray:
    size = int(unpack(packed, np.int64, np.int8)[0][0])
    return unpack(packed, np.int64, np.int16 if size == 2 else np.int32)[1].reshape(-1, dims).astype(np.int64)


def seeds(rows: DataFrame, k: int, seed: str, dims: int, scale: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in that order; null ids come last, equal ids by their vectors."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = rows.select(h.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return scaled(np.array([r["x"] for r in chosen]).reshape(-1, dims), scale)


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: str = "3", block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and ``looked_at`` of every usable vector.

    Vectors that are null, have another number of components, or a null or not finite one, take no part. A null vec_id is
    a row like others, but a seed only where ids run out; repeated rows count each for itself; of equally near centroids
    the smaller number wins; with fewer vectors than ``k`` there are so many centroids; an empty table gives none; other
    columns are not looked at. Scaled components of 2^27 or more are an error. ``looked_at`` is the number of exact
    rescans over all rounds, the same in every row. Rounds read the vectors once each and write 13 bytes a vector.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, dims)
    centroids = seeds(rows, k, seed, dims, scale)
    k, schema = len(centroids), "vec_id long, cluster int, distance long"
    if not k:
        return rows.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("looked_at", "long"))])
    total = rows.count()
    buckets = max(1, min(-(-total // block), max(-(-total * dims * 2 // BUCKET_BYTES), 4 * spark.sparkContext.defaultParallelism)))
    tables = Tables(spark, buckets)
    blocks = tables.write(packed_blocks(rows, dims, scale, block), "vectors")
    drift, state, looked = Drift(k), None, 0

    def step(centroids: np.ndarray, total: np.ndarray, before: DataFrame | None, final: bool) -> DataFrame:
        """Every block's next state, or its vectors' rows if ``final``."""

        def one(row: dict) -> pa.RecordBatch:
            v = vectors_of(row["vectors"], dims)
            b = Block(v, k, row["state"], np.array(row["sums"][:-1], np.int64)) if "state" in row else Block(v, k)
            seen = b.round(centroids, total)
            if not final:
                return pa.record_batch([pa.array([row["block"]]), pa.array([[*b.sums.ravel().tolist(), seen]], pa.list_(pa.int64())), pa.array([b.packed()])], names=["block", "sums", "state"])
            ids, known = unpack(row["ids"], np.int64, np.bool_)
            d = v - centroids[b.cluster]
            return pa.record_batch([pa.array(ids, mask=~known), pa.array(b.cluster.astype(np.int32)), pa.array(np.einsum("ij,ij->i", d, d))], names=["vec_id", "cluster", "distance"])

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    yield one(batch.slice(i, 1).to_pylist()[0])

        return (blocks if before is None else blocks.join(before.hint("merge"), "block")).mapInArrow(run, schema if final else STATE)

    for i in range(rounds):
        after = tables.write(step(centroids, drift.total.copy(), state, False), f"round{i}")
        if state is not None:
            tables.forget(f"round{i - 1}")
        state = after
        found = {r["at"]: r["s"] for r in state.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()}
        looked += found.pop(k * (dims + 1))
        sums = np.array([found[j] for j in range(k * (dims + 1))], np.int64).reshape(k, dims + 1)
        moved = np.array([row[:-1] // row[-1] if row[-1] else old for row, old in zip(sums, centroids, strict=True)])
        drift.add(centroids, moved)
        centroids = moved
    out = materialise(step(centroids, drift.total.copy(), state, True))
    if state is not None:
        tables.forget(f"round{rounds - 1}")
    tables.forget("vectors")
    inertia = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(j, inertia.get(j, 0), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("bigint").alias("inertia"), "centroid_sha256", F.lit(looked).cast("bigint").alias("looked_at"))
