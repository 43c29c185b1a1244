"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of five-word shingles. For each size class documents
are seen as overlapping windows of twice the class's largest size, so an item is never lost
in a long text. Windows and items have a MinHash signature, the least shingle hash of each
bin; one equal entry makes a candidate. Exact shingle containment over the whole document
then decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm import tokens
from needledrop.llm.skew import look_up
from needledrop.scratch import materialise

K = 5
BINS = np.uint64(64)
#: So many items and bytes of their texts are sent to all executors; more meet the documents in a join, behind a map of so many bits (64 MB).
FEW_ITEMS, FEW_BYTES = 10_000, 16 << 20
MAP_BITS = 29
WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7F])+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PAIR = "doc_id bigint, item_id bigint, n_shared bigint, n_shingles bigint"


def exact_shingles(text: str) -> set[tuple[str, ...]]:
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[i : i + K]) for i in range(len(w) - K + 1)}


class Index:
    """Signatures of a block of items: (least hash of a bin) -> items, with their window size."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = items
        entries = []
        for i, (_, text) in enumerate(items):
            data = text.encode()
            word, owner, *_ = tokens.words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)], dtype=np.int64))
            hashes = np.unique(tokens.shingles(word, owner, K)[0])
            if len(hashes):
                size = 1 << (len(hashes) - 1).bit_length()
                _, least = np.unique(hashes % BINS, return_index=True)
                entries += [(int(h), i, size) for h in hashes[least]]
        entries.sort()
        self.keys = np.array([e[0] for e in entries], dtype=np.uint64)
        self.entries = entries
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.keys >> np.uint64(44)] = True

    def candidates(self, hashes: np.ndarray, text: np.ndarray) -> dict[int, set[int]]:
        """Text number -> items one of whose signature entries equals that of a window of the text."""
        found: dict[int, set[int]] = defaultdict(set)
        if not len(self.keys) or not len(hashes):
            return found
        hits = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        left = np.searchsorted(self.keys, hashes[hits], "left")
        hits, left = hits[ok := self.keys[np.minimum(left, len(self.keys) - 1)] == hashes[hits]], left[ok]
        for p, e in zip(hits.tolist(), left.tolist(), strict=True):
            h, owner = hashes[p], int(text[p])
            start, stop = np.searchsorted(text, owner, "left"), np.searchsorted(text, owner, "right")
            while e < len(self.entries) and self.entries[e][0] == h:
                _, item, size = self.entries[e]
                e += 1
                if item in found[owner]:
                    continue
                for w in {(p - start) // size, max(0, (p - start) // size - 1)}:
                    window = hashes[start + w * size : min(stop, start + (w + 2) * size)]
                    if window[window % BINS == h % BINS].min() == h:
                        found[owner].add(item)
                        break
        return found


def leaks_of(index: Index, exact: dict[int, set], column, containment: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shared, shingles of the item) for every leak in an Arrow column of texts as bytes."""
    for at, _, data, offsets in tokens.slices(column):
        word, text, *_ = tokens.words(data, offsets)
        hashes, owner, _ = tokens.shingles(word, text, K)
        for doc, some in index.candidates(hashes, owner).items():
            have = exact_shingles(bytes(data[offsets[doc] : offsets[doc + 1]]).decode("utf-8", "replace"))
            for i in some:
                want = exact.setdefault(i, exact_shingles(index.items[i][1]))
                n = len(want & have)
                if n >= containment * len(want) - 1e-9:
                    yield at + doc, i, n, len(want)


def distinct_items(benchmark: DataFrame) -> tuple[DataFrame, bool]:
    """(number, item_id, text) of the items, rows equal in both once, and whether they are few enough to be sent to all executors."""
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    items = materialise(rows.withColumn("number", F.monotonically_increasing_id()))
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    return items, size["items"] <= FEW_ITEMS and size["bytes"] <= FEW_BYTES


def _search(docs: DataFrame, items: DataFrame, containment: float) -> DataFrame:
    """Leaks by one pass over the documents with the items at hand."""
    shared = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, exact = Index(shared.value), {}
        for batch in batches:
            ids = batch.column(0)
            rows = [(ids[row].as_py(), index.items[i][0], n, size) for row, i, n, size in leaks_of(index, exact, batch.column(1), containment)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["doc_id", "item_id", "n_shared", "n_shingles"])

    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(run, PAIR)


def _salted(hashes: np.ndarray, size: int) -> np.ndarray:
    return tokens.mix(hashes ^ np.uint64(size * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def signature_entries(items: DataFrame) -> DataFrame:
    """(hash, size, number, bit): an item's least hash of each bin, the size of its class and a hash of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, index = batch.column(0).to_numpy(), Index([(0, t) for t in batch.column(1).to_pylist()])
            size, item = np.array([e[2] for e in index.entries], np.int32), np.array([e[1] for e in index.entries], np.int64)
            bit = np.concatenate([_salted(index.keys[size == s], s) for s in np.unique(size).tolist()]) if len(size) else index.keys
            order = np.argsort(size, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(index.keys[order].view(np.int64)), pa.array(size[order]), pa.array(number[item[order]]), pa.array(bit.view(np.int64))], ["hash", "size", "number", "bit"])

    return items.select("number", "text").mapInArrow(run, "hash bigint, size int, number bigint, bit bigint")


def window_entries(texts: DataFrame, sizes: list[int], bits: int, seen: np.ndarray) -> DataFrame:
    """(code, hash, size) of the documents' windows, as far as an item may have the entry: ``seen`` has a bit for each hash of both."""
    shared = texts.sparkSession.sparkContext.broadcast(seen)
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            found = set()
            for at, _, data, offsets in tokens.slices(batch.column(1)):
                word, owner, *_ = tokens.words(data, offsets)
                hashes, text, _ = tokens.shingles(word, owner, K)
                start = np.searchsorted(text, text, "left") if len(text) else text
                stop = np.searchsorted(text, text, "right") if len(text) else text
                for size in sizes:
                    place = _salted(hashes, size) >> shift
                    for p in np.flatnonzero(seen[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).tolist():
                        h, a = hashes[p], int(start[p])
                        for w in {(p - a) // size, max(0, (p - a) // size - 1)}:
                            window = hashes[a + w * size : min(int(stop[p]), a + (w + 2) * size)]
                            if window[window % BINS == h % BINS].min() == h:
                                found.add((at + int(text[p]), int(h.view(np.int64)), size))
                                break
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], ["code", "hash", "size"])

    return texts.select("code", "text").mapInArrow(run, "code string, hash bigint, size int")


def _join(docs: DataFrame, items: DataFrame, containment: float) -> DataFrame:
    """(code, item_id, n_shared, n_shingles) of texts by their MD5 that leak, for a benchmark of any size: entries meet by a join.

    Only a map of bits passes the driver: sixteen an entry, up to ``MAP_BITS``; a fuller map lets more entries through to the join.
    """
    entries = materialise(signature_entries(items))
    facts = entries.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    bits = min(max((16 * facts["n"]).bit_length(), 16), MAP_BITS)
    place = F.shiftrightunsigned("bit", 64 - bits)
    words = entries.groupBy(F.shiftright(place, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(bit, {64 - bits}) & 31 as int))")).alias("bits")).toPandas()
    seen = np.zeros(1 << (bits - 5), np.uint32)
    seen[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    texts = coded(docs).select("code", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    met = window_entries(texts, sorted(facts["sizes"]), bits, seen.astype("<u4").view(np.uint8)).distinct()
    pairs = materialise(met.join(entries, ["hash", "size"]).select("code", "number").distinct())
    wanted = texts.join(pairs.select("code").distinct(), "code", "left_semi").dropDuplicates(["code"])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pairs.count() // FEW_ITEMS))
    part = F.pmod(F.xxhash64("code"), F.lit(parts)).alias("part")

    def run(key, texts: pa.Table, pairs: pa.Table) -> pa.Table:
        have = {c: exact_shingles(t.decode("utf-8", "replace")) for c, t in zip(texts.column("code").to_pylist(), texts.column("text").to_pylist(), strict=True)}
        rows, exact = [], {}
        for code, item, text in zip(*(pairs.column(c).to_pylist() for c in ("code", "item_id", "text")), strict=True):
            want = exact.setdefault(text, exact_shingles(text))
            n = len(want & have[code])
            if n >= containment * len(want) - 1e-9:
                rows.append((code, item, n, len(want)))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["code", "item_id", "n_shared", "n_shingles"])

    named = pairs.join(items, "number").select(part, "code", "item_id", "text")
    return wanted.select(part, "code", "text").groupBy("part").cogroup(named.groupBy("part")).applyInArrow(run, "code string, item_id bigint, n_shared bigint, n_shingles bigint")


def coded(docs: DataFrame) -> DataFrame:
    return docs.withColumn("code", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def find_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id, n_shared, n_shingles) where a document holds that share of an item's shingles.

    ``benchmark`` has item_id and text; rows equal in both count once. Words are lower-cased runs of
    letters and digits. Items or documents of fewer than five words, null ones too, have no shingle
    and match nothing. Repeated document rows give repeated pairs; empty tables give none; further
    columns are ignored. Up to ``FEW_ITEMS`` items of ``FEW_BYTES`` are sent to all executors and looked for in one
    pass over the documents; signatures of more meet those of the documents in a join.
    """
    items, few = distinct_items(benchmark)
    if few:
        return _search(docs, items, containment)
    leaks = materialise(_join(docs, items, containment)).groupBy("code").agg(F.collect_list(F.struct("item_id", "n_shared", "n_shingles")).alias("leaks"))
    rows = coded(docs.select("doc_id", "text")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "code")
    return look_up(rows, materialise(leaks), "code").select("doc_id", F.inline("found.leaks"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item; up to ``FEW_ITEMS`` items without a shuffle of texts.

    Null and short texts leak nothing and stay, as do all rows where the benchmark is empty. Repeated
    rows stay or go together; an empty table gives none; further columns stay, whatever their names.
    """
    items, few = distinct_items(benchmark)
    if not few:
        rows = docs.select(F.struct("*").alias("row"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("code"))
        return rows.join(materialise(_join(docs.select("doc_id", "text"), items, containment)).select("code").distinct(), "code", "left_anti").select("row.*")
    shared, column = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.collect()]), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, exact = Index(shared.value), {}
        for batch in batches:
            text = batch.column(column)
            if text.null_count:
                text = text.fill_null("")
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[row for row, *_ in leaks_of(index, exact, text, containment)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
