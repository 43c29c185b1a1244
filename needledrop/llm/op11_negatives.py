"""Hard negatives of anchors: integer scores of anchor and candidate tiles by Strassen's recursion, and heaps that merge.

Rows lie in blocks, which are packed where they are read. Groups of anchors meet groups of candidate blocks, tile by tile:
once for the best rows of the same label, once for the rows of other labels in the window of each positive. A task keeps a
heap of a few entries for each anchor or window; the heaps of all tasks are merged by rank.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.llm.blocks import pack, unpack
from needledrop.scratch import materialise

#: Rows in a block, rows of one task's group of candidates, anchors in a group, and the sides of a tile.
BLOCK, GROUP, ANCHORS = 4096, 1 << 16, 2048
TILE_ANCHORS, TILE_ROWS = 256, 4096
#: Matrices with a side of at most this are multiplied directly.
LEAF = 8
LEAST = np.iinfo(np.int64).min
PACKED = "block long, n int, anchors int, payload binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by Strassen's seven products; sides that are odd are padded with zeros.

    Sums wrap around at 64 bits, which cancels out: the product is exact wherever it fits 64 bits itself.
    """
    n, k, m = a.shape[0], a.shape[1], b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    a = np.pad(a, ((0, n % 2), (0, k % 2))) if n % 2 or k % 2 else a
    b = np.pad(b, ((0, k % 2), (0, m % 2))) if k % 2 or m % 2 else b
    h, g, w = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :g], a[:h, g:], a[h:, :g], a[h:, g:]
    b11, b12, b21, b22 = b[:g, :w], b[:g, w:], b[g:, :w], b[g:, w:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6, p7 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf), strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * h, 2 * w), np.int64)
    out[:h, :w] = p1 + p4 - p5 + p7
    out[:h, w:] = p3 + p5
    out[h:, :w] = p2 + p4
    out[h:, w:] = p1 - p2 + p3 + p6
    return out[:n, :m]


class Rows:
    """Rows of some blocks: where they lie, ids (``known`` where there is one), labels and vectors padded to one width."""

    def __init__(self, block: np.ndarray, place: np.ndarray, ids: np.ndarray, known: np.ndarray, label: np.ndarray, vectors: np.ndarray) -> None:
        self.block, self.place, self.ids, self.known, self.label, self.vectors = block, place, ids, known, label, vectors

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(*(x[at] for x in (self.block, self.place, self.ids, self.known, self.label, self.vectors)))

    def in_order(self, by_label: bool) -> Rows:
        """In the order in which equal scores rank: by id, nulls last; if so wished, within their labels."""
        order = (self.place, self.block, self.ids, ~self.known)
        return self.take(np.lexsort((*order, self.label) if by_label else order))

    @staticmethod
    def packed(ids: np.ndarray, known: np.ndarray, label: np.ndarray, vectors: np.ndarray, place: np.ndarray) -> bytes:
        top = int(np.abs(vectors).max()) if vectors.size else 0
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if top < np.iinfo(t).max)
        return pack(np.array([vectors.shape[1], np.dtype(kind).itemsize]), ids, known, label, place, vectors.astype(kind))

    @staticmethod
    def of(blocks: list[tuple[int, bytes]]) -> Rows:
        parts = []
        for number, payload in sorted(blocks):
            width, size = unpack(payload, np.int64, *[np.int8] * 5)[0].tolist()
            _, ids, known, label, place, flat = unpack(payload, np.int64, np.int64, np.bool_, np.int64, np.int32, np.dtype(f"i{size}"))
            parts.append(Rows(np.full(len(ids), number), place, ids, known, label, flat.reshape(len(ids), width)))
        width = max(p.vectors.shape[1] for p in parts)
        columns = [[getattr(p, name) for p in parts] for name in ("block", "place", "ids", "known", "label")]
        return Rows(*map(np.concatenate, columns), np.concatenate([np.pad(p.vectors, ((0, 0), (0, width - p.vectors.shape[1]))).astype(np.int64) for p in parts]))


def best(scores: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores of each row that are at least ``least``, the first columns among equals; in no order."""
    if scores.shape[1] > k:
        bound = np.maximum(np.partition(scores, scores.shape[1] - k, axis=1)[:, -k], least)[:, None]
        equal = scores == bound
        return np.nonzero((scores > bound) | (equal & (np.cumsum(equal, axis=1) <= k)))
    return np.nonzero(scores >= least[:, None])


class Heaps:
    """The ``k`` best entries of each of ``n`` heaps, as (score, id, known, block, place) of a row."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.n = k, n
        self.heap, self.score, self.row = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, LEAST + 1)

    def merge(self, heap: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        """Add entries; ``row`` numbers rows in the order in which equal scores rank."""
        heap, score, row = np.concatenate((self.heap, heap)), np.concatenate((self.score, score)), np.concatenate((self.row, row))
        order = np.lexsort((row, -score, heap))
        heap, score, row = heap[order], score[order], row[order]
        first = np.searchsorted(heap, np.arange(self.n))
        keep = np.arange(len(heap)) - first[heap] < self.k
        self.heap, self.score, self.row = heap[keep], score[keep], row[keep]
        full = np.flatnonzero(np.bincount(self.heap, minlength=self.n) == self.k)
        ends = np.searchsorted(self.heap, full, "right") - 1
        self.least[full] = self.score[ends]


def tiles(anchors: Rows, rows: Rows, anchor_range: tuple[int, int], row_range: tuple[int, int]) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores of all pairs of two ranges, a tile at a time."""
    width = max(anchors.vectors.shape[1], rows.vectors.shape[1])
    for c in range(row_range[0], row_range[1], TILE_ROWS):
        cs = slice(c, min(c + TILE_ROWS, row_range[1]))
        right = np.ascontiguousarray(np.pad(rows.vectors[cs], ((0, 0), (0, width - rows.vectors.shape[1]))).T)
        for a in range(anchor_range[0], anchor_range[1], TILE_ANCHORS):
            asl = slice(a, min(a + TILE_ANCHORS, anchor_range[1]))
            yield asl, cs, strassen(np.pad(anchors.vectors[asl], ((0, 0), (0, width - anchors.vectors.shape[1]))), right)


def _edges(label: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(label, first, end) of the runs of sorted labels."""
    values, first = np.unique(label, return_index=True)
    yield from zip(values.tolist(), first.tolist(), [*first[1:].tolist(), len(label)], strict=True)


def positive_heaps(anchors: Rows, rows: Rows, k: int) -> Heaps:
    """The best rows of each anchor's label, without the anchor's own; both sides are in order."""
    heaps, of = Heaps(len(anchors), k), {label: (a, b) for label, a, b in _edges(rows.label)}
    for label, a, b in _edges(anchors.label):
        for asl, cs, scores in tiles(anchors, rows, (a, b), of.get(label, (0, 0))):
            own = (anchors.block[asl, None] == rows.block[None, cs]) & (anchors.place[asl, None] == rows.place[None, cs])
            scores[own] = LEAST
            i, j = best(scores, k, heaps.least[asl])
            heaps.merge(i + asl.start, scores[i, j], j + cs.start)
    return heaps


def window_heaps(anchors: Rows, rows: Rows, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> Heaps:
    """The best rows of other labels within the scores ``low`` to ``high`` of each window, which are in the order of their ``anchor``."""
    heaps = Heaps(len(anchor), k)
    ends = np.searchsorted(anchor, np.arange(len(anchors) + 1))
    for asl, cs, scores in tiles(anchors, rows, (0, len(anchors)), (0, len(rows))):
        scores[anchors.label[asl, None] == rows.label[None, cs]] = LEAST
        turn = np.arange(asl.start, asl.stop)
        for slot in range(int((ends[turn + 1] - ends[turn]).max(initial=0))):
            have = turn[ends[turn] + slot < ends[turn + 1]]
            w = ends[have] + slot
            some = scores[have - asl.start]
            least = np.maximum(low[w], heaps.least[w])
            some = np.where((some <= high[w, None]) & (some >= least[:, None]), some, LEAST)
            hit = np.flatnonzero((some > LEAST).any(axis=1))
            if len(hit):
                i, j = best(some[hit], k, least[hit])
                heaps.merge(w[hit][i], some[hit][i, j], j + cs.start)
    return heaps


def packed_blocks(vectors: DataFrame, anchor: Column, scale: int, block: int) -> DataFrame:
    """Blocks of up to ``block`` usable rows, made where the rows are read: number, rows, anchors among them, and the rows packed."""
    fine = F.forall("embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform("embedding", lambda c: c.cast("double")).alias("x"),
    )

    def run(batches):
        from pyspark import TaskContext

        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block_of(batches):
            nonlocal made
            made += 1
            table = pa.Table.from_batches(batches).to_batches()
            x = [c for b in table for c in [b.column("x")]]
            flat = np.floor(np.concatenate([np.asarray(c.flatten()) for c in x]) * scale)
            length = np.concatenate([np.diff(np.asarray(c.offsets)) for c in x])
            width = int(length.max(initial=0))
            if flat.size and float(np.abs(flat).max()) ** 2 * width >= 2.0**62:
                raise ValueError("scores do not fit 64 bits")
            padded = np.zeros((len(length), width), np.int64)
            padded[np.arange(width) < length[:, None]] = flat.astype(np.int64)

            def column(name):
                return np.concatenate([np.asarray(b.column(name).fill_null(False if name == "anchor" else 0)) for b in table])

            known = np.concatenate([np.asarray(b.column("vec_id").is_valid()) for b in table])
            anchors = column("anchor").astype(bool)
            # anchors first, so that those of a block can be cut off
            order = np.argsort(~anchors, kind="stable")
            payload = Rows.packed(column("vec_id")[order], known[order], column("label")[order], padded[order], np.arange(len(order), dtype=np.int32))
            return pa.record_batch([pa.array([(part << 32) + made]), pa.array([len(order)], pa.int32()), pa.array([int(anchors.sum())], pa.int32()), pa.array([payload], pa.binary())], names=["block", "n", "anchors", "payload"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block:
                table = pa.Table.from_batches(held)
                yield block_of(table.slice(0, block).to_batches())
                held, n = table.slice(block).to_batches(), n - block
        if n:
            yield block_of(held)

    return rows.mapInArrow(run, PACKED)


def anchors_of(blocks: DataFrame) -> DataFrame:
    """block and the packed anchors of every block that has any."""

    def run(batches):
        for batch in batches:
            for number, n, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                r = Rows.of([(number, payload.as_py())]).take(np.arange(n))
                yield pa.record_batch([pa.array([number]), pa.array([Rows.packed(r.ids, r.known, r.label, r.vectors, r.place)], pa.binary())], names=["block", "payload"])

    return blocks.filter("anchors > 0").select("block", "anchors", "payload").mapInArrow(run, "block long, payload binary")


def _meet(anchors: DataFrame, blocks: DataFrame, groups: int, parts: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on every group of anchors with every part of the candidates."""
    left = anchors.withColumns({"g": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"), "h": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    right = blocks.select("block", "payload", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(work, schema)


def _rows(table: pa.Table) -> Rows:
    return Rows.of(list(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True)))


POSITIVES = "anchor_block long, anchor_place int, anchor_id long, positive_score long, positive_id long, block long, place int"
NEGATIVES = "anchor_block long, anchor_place int, slot int, anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long, block long, place int"


def mine_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = BLOCK, group: int = GROUP, anchor_group: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the hard negatives of every anchor's positives.

    Positives of an anchor are the best other rows of its label, negatives of a positive the best rows of other labels with
    scores of ``low`` to ``high`` percent of its own; fewer where there are no more. Rows with a null label or vector, or a
    component that is null or not finite, take no part; vectors of other lengths count as padded with zeros, an empty one has
    the score 0. A null vec_id is no anchor and ranks last among equal scores; a repeated row is another row, and an anchor
    of its own; an empty table gives none; other columns are not looked at. Scores that may pass 62 bits are an error.
    """
    blocks = materialise(packed_blocks(vectors, anchor, scale, block))
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("anchors"), F.lit(0)).alias("anchors")).first()
    groups = max(1, -(-size["anchors"] // anchor_group))
    parts = max(1, -(-size["n"] // group), min(-(-size["n"] // block), -(-2 * blocks.sparkSession.sparkContext.defaultParallelism // groups)))
    anchors = anchors_of(blocks)

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in arrow_positives})
        a, c = _rows(left).in_order(True), _rows(right).in_order(True)
        h = positive_heaps(a, c, positives)
        return pa.table(dict(zip([n for n, _ in arrow_positives], [a.block[h.heap], a.place[h.heap], a.ids[h.heap], h.score, pa.array(c.ids[h.row], mask=~c.known[h.row]), c.block[h.row], c.place[h.row]], strict=True)))

    arrow_positives = _arrow(POSITIVES)
    rank = Window.partitionBy("anchor_block", "anchor_place").orderBy(F.desc("positive_score"), F.col("positive_id").asc_nulls_last(), "block", "place")
    found = _meet(anchors, blocks, groups, parts, find_positives, POSITIVES).withColumn("slot", F.row_number().over(rank)).filter(F.col("slot") <= positives)
    windows = materialise(found.groupBy(F.col("anchor_block").alias("block")).agg(F.collect_list(F.struct("anchor_place", "slot", "positive_id", "positive_score")).alias("windows")))

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in arrow_negatives})
        a, c = _rows(left), _rows(right).in_order(False)
        named = [(b, *(w[k] for k in ("anchor_place", "slot", "positive_id", "positive_score"))) for b, ws in zip(left.column("block").to_pylist(), left.column("windows").to_pylist(), strict=True) for w in ws]
        named.sort(key=lambda w: w[:3])
        place, slot, score = (np.array([w[i] for w in named], np.int64) for i in (1, 2, 4))
        # anchors lie by block and place, and so do windows
        start = dict(zip(*np.unique(a.block, return_index=True), strict=True))
        owner = np.array([start[w[0]] for w in named], np.int64) + place
        whole, rest = score // 100, score % 100
        h = window_heaps(a, c, owner, -((-low * rest) // 100) + low * whole, (high * rest) // 100 + high * whole, negatives)
        of = owner[h.heap]
        positive = pa.array([named[i][3] for i in h.heap.tolist()], pa.int64())
        return pa.table(dict(zip([n for n, _ in arrow_negatives], [a.block[of], a.place[of], slot[h.heap].astype(np.int32), a.ids[of], positive, score[h.heap], h.score, pa.array(c.ids[h.row], mask=~c.known[h.row]), c.block[h.row], c.place[h.row]], strict=True)))

    arrow_negatives = _arrow(NEGATIVES)
    rank = Window.partitionBy("anchor_block", "anchor_place", "slot").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "block", "place")
    out = _meet(anchors.join(windows, "block"), blocks, groups, parts, find_negatives, NEGATIVES).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _arrow(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return [(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))]
