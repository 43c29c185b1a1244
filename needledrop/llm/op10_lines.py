"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words are put in one order for the whole corpus, rare ones
first. Two sets of a Jaccard similarity of ``OVER / UNDER`` share a word among the first few of
each (prefix filter), have lengths within that ratio (length filter), and enough words after
the first shared one (positional filter); the parities of hashed word classes bound their
difference further. What passes is verified on the words themselves. A line goes if an
earlier line, by doc_id and place, is equal as a set or as similar as that.

Blocks of texts and buckets of words work in turns. Prefix words go to their buckets with little
beside them, and a bucket names the few whose word another line has under all filters. Only the
lines named are sent in full, once; from then on the texts are not read again until lines are cut
out. A bucket first gives each line the earliest line that passes; only lines that fail the
verification ask for all their candidates, so groups of near copies do not cost all their pairs.
Equal sets count once: only the first line of each set in the corpus takes part in the join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm import blocks, tokens

#: The similarity as a fraction, for exact tests in whole numbers.
OVER, UNDER = 4, 5
#: Smaller sets can only match equal ones.
LEAST = 4
#: Word frequencies are counted in so many hash classes and kept as a byte each: 4 MB are broadcast at any size.
CLASSES = 1 << 22
CHUNK = 1 << 14
#: Different sets with one prefix word that are compared in one place; those of a word with more are dealt over pairs of parts.
HOT = 2048
#: In groups of more lines than the first number, so many earliest lines are tried on all others before all pairs are.
SEVERAL, PIVOTS = 64, 16
#: Classes of words whose parities are kept, in two sizes.
NARROW, WIDE = 64, 256
NO_DOC = np.iinfo(np.int64).max
NEWLINE = 10
RESULT = "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string, removed array<int>"
ROWS = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int32()))])


def word_ranks(docs: DataFrame) -> np.ndarray:
    """A frequency class, about four to an octave, for each hash class of words: one byte each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in tokens.slices(batch.column(0)):
                np.add.at(total, (tokens.words(data, offsets)[0] % np.uint64(CLASSES)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        rows = [(c, blocks.pack((at[i] % CHUNK).astype(np.uint16), total[at[i]])) for c, i in blocks.by_bucket(at // CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "counts"])

    def pack(table):
        n = np.zeros(CHUNK, dtype=np.int64)
        for payload in table.column("counts").to_pylist():
            at, some = blocks.unpack(payload, np.uint16, np.int64)
            n[at] += some
        ranks = np.where(n > 0, np.minimum(255, 1 + 4 * np.log2(np.maximum(n, 1))), 0).astype(np.uint8)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "ranks": pa.array([ranks.tobytes()], pa.binary())})

    text = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = text.mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(pack, "chunk int, ranks binary").collect()
    ranks = np.zeros(CLASSES, dtype=np.uint8)
    for r in rows:
        ranks[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["ranks"], dtype=np.uint8)
    return ranks


class Lines:
    """Lines of texts that lie one after the other, and their word sets."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        breaks = np.flatnonzero(data == NEWLINE) + 1
        doc = np.searchsorted(offsets, breaks - 1, "right") - 1
        #: a text has a first line even if it is empty
        start = np.concatenate([offsets[:-1], breaks])
        owner = np.concatenate([np.arange(len(offsets) - 1), doc])
        order = np.lexsort((start, owner))
        self.start, self.doc = start[order], owner[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True) if len(self.doc) else np.zeros(0, bool)
        after = np.append(self.start[1:] - 1, 0) if len(self.start) else np.zeros(0, np.int64)
        self.stop = np.where(last, offsets[self.doc + 1] if len(self.doc) else 0, after)
        first = np.searchsorted(self.doc, self.doc, "left")
        self.place = np.arange(len(self.doc)) - first

    def with_words(self) -> np.ndarray:
        """Whether each line has a word."""
        upto = np.concatenate(([0], np.cumsum(tokens.LETTERS[self.data])))
        return upto[self.stop] > upto[self.start]

    def sets(self, ranks: np.ndarray, chosen: np.ndarray | None = None) -> "Sets":
        """Word sets of all lines or of the chosen ones."""
        if chosen is None:
            spans, data = np.append(self.start, len(self.data)), self.data
            return Sets(data, spans, ranks, np.arange(len(self.start)))
        parts = [self.data[a:b] for a, b in zip(self.start[chosen].tolist(), self.stop[chosen].tolist(), strict=True)]
        spans = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        return Sets(np.concatenate(parts) if parts else np.zeros(0, np.uint8), spans, ranks, chosen)


class Sets:
    """Distinct words of lines, rare ones first: line, begin, n and the words, for lines with a word."""

    def __init__(self, data: np.ndarray, spans: np.ndarray, ranks: np.ndarray, names: np.ndarray) -> None:
        words, lines = [], []
        at, n = 0, len(spans) - 1
        while at < n:
            end = min(n, max(at + 1, int(np.searchsorted(spans, spans[at] + tokens.SLICE, "right")) - 1))
            # empty spans at the edges of a slice hold no word; a word never crosses a line
            w, owner, *_ = tokens.words(data[spans[at] : spans[end]], spans[at : end + 1] - spans[at])
            words.append(w)
            lines.append(owner + at)
            at = end
        word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        line = np.concatenate(lines) if lines else np.zeros(0, np.int64)
        rank = ranks[(word % np.uint64(CLASSES)).astype(np.int64)]
        if n < 1 << 24:
            key = (line.astype(np.uint64) << np.uint64(40)) | (rank.astype(np.uint64) << np.uint64(32)) | (word >> np.uint64(32))
            order = np.argsort(key)
            key = key[order]
            close = (key[1:] == key[:-1]) & (word[order][1:] != word[order][:-1])
        if n >= 1 << 24 or close.any():
            order = np.lexsort((word, rank, line))
        word, line = word[order], line[order]
        fresh = np.concatenate(([True], (word[1:] != word[:-1]) | (line[1:] != line[:-1]))) if len(word) else np.zeros(0, bool)
        self.word, line = word[fresh], line[fresh]
        self.begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if len(line) else np.zeros(0, np.int64)
        self.n = np.diff(np.append(self.begin, len(line)))
        self.line = names[line[self.begin]] if len(self.begin) else np.zeros(0, np.int64)

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each set in two halves of 64 bits, of which chance makes no two sets share both."""
        if not len(self.begin):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        n = self.n.astype(np.uint64)
        return tokens.mix(np.add.reduceat(tokens.mix(self.word), self.begin) ^ n), tokens.mix(np.add.reduceat(tokens.mix(self.word ^ tokens.BASE), self.begin) + n)

    def parities(self, classes: int) -> np.ndarray:
        """One row of 64-bit numbers a set: the parities of its words in ``classes`` hash classes."""
        high, out = self.word >> np.uint64(50), np.zeros((len(self.n), classes // NARROW), dtype=np.uint64)
        for i in range(classes // NARROW if len(self.n) else 0):
            bit = np.uint64(1) << (self.word >> np.uint64(58))
            out[:, i] = np.bitwise_xor.reduceat(np.where(high % np.uint64(classes // NARROW) == i, bit, np.uint64(0)), self.begin)
        return out

    def prefixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, word, place) of the words of which similar sets share one."""
        size = np.where(self.n >= LEAST, self.n - -(-OVER * self.n // UNDER) + 1, 0)
        owner = np.repeat(np.arange(len(self.n)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return owner, self.word[self.begin[owner] + place], place


def _open(table: pa.Table) -> tuple[np.ndarray, Lines]:
    column = blocks.binary(table, "text")
    ids = np.array([NO_DOC if v is None else v for v in table.column("doc_id").to_pylist()], dtype=np.int64)
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * column.offset).astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return ids, Lines(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def _fresh(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers of one, two or four bytes, as few as all of them need."""
    most = x.max() if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _wide(raw: np.ndarray, count: int) -> np.ndarray:
    return raw.view({1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // count if count else 1]).astype(np.int64)


def _owner(block: int) -> int:
    """The bucket that keeps the lines of a block that were sent in full."""
    return -1 - block


def read_block(block: int, table: pa.Table, ranks: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Each distinct set of the block to the bucket of its code, its prefix words to theirs, which are numbered after those."""
    ids, lines = _open(table)
    sets = lines.sets(ranks)
    one, two = sets.codes()
    order = np.lexsort((np.arange(len(one)), two, one))
    first = np.sort(order[_fresh(one[order], two[order])])
    out, line = [], sets.line[first]
    for b, at in blocks.by_bucket((one[first] % np.uint64(buckets)).astype(np.int64)):
        out.append((block, b, blocks.pack(one[first[at]], two[first[at]], ids[lines.doc[line[at]]], line[at].astype(np.uint32))))
    keep = np.zeros(len(one), dtype=bool)
    keep[first] = True
    owner, word, place = sets.prefixes()
    # a word of a hash class with one occurrence in the corpus is in no other line
    mine = keep[owner] & (ranks[(word % np.uint64(CLASSES)).astype(np.int64)] > 1)
    owner, word, place = owner[mine], word[mine], place[mine]
    parity = sets.parities(NARROW)[:, 0]
    for b, at in blocks.by_bucket((word % np.uint64(buckets)).astype(np.int64)):
        o = owner[at]
        out.append((block, buckets + b, blocks.pack((word[at] >> np.uint64(32)).astype(np.uint32), parity[o], *map(_narrow, (sets.line[o], place[at], sets.n[o])))))
    return out


def first_of_sets(bucket: int, got: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Tell each block which of its sets have no earlier line in another block, and how many blocks have each."""
    parts = [blocks.unpack(p, np.uint64, np.uint64, np.int64, np.uint32) for _, p in got]
    one, two, doc, line = (np.concatenate([p[i] for p in parts]) for i in range(4))
    at = np.repeat(np.arange(len(got)), [len(p[0]) for p in parts])
    order = np.lexsort((line, at, doc, two, one))
    start = np.flatnonzero(_fresh(one[order], two[order]))
    copies, first = np.diff(np.append(start, len(order))), order[start]
    return [(got[i][0], bucket, blocks.pack(line[first[k]], _narrow(copies[k]))) for i, k in blocks.by_bucket(at[first])]


def _within(word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by (word, size): from where and up to where rows have the word and a size within the ratio."""
    group = np.cumsum(_fresh(word)) << 34
    return np.searchsorted(group + n, group - (-n * OVER // UNDER), "left"), np.searchsorted(group + n, group + n * UNDER // OVER, "right")


def _may_match(n: np.ndarray, place: np.ndarray, parity: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs pass the positional filter and the bound on the difference."""
    both = n[i] + n[j]
    ok = np.flatnonzero(np.minimum(n[i] - place[i], n[j] - place[j]) * (OVER + UNDER) >= OVER * both)
    gap = np.bitwise_count(parity[i[ok]] ^ parity[j[ok]]).sum(axis=1, dtype=np.int64)
    return ok[gap * (OVER + UNDER) <= (UNDER - OVER) * both[ok]]


def plausible(bucket: int, got: list[tuple[int, bytes]], most: int) -> list[tuple[int, int, bytes]]:
    """Tell each block which of its prefix entries pass the filters with another line of the word.

    Entries alike in all that is known may be of one set: these are told by their number, so that the block
    sees whether another set is among them. A word of over ``most`` different sets names all its entries, and
    the number of parts that it is dealt over.
    """
    parts = [blocks.unpack(p, np.uint32, np.uint64, np.uint8, np.uint8, np.uint8) for _, p in got]
    at = np.repeat(np.arange(len(got)), [len(p[0]) for p in parts])
    word, parity = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    line, place, n = (np.concatenate([_wide(p[i], len(p[0])) for p in parts]) for i in (2, 3, 4))
    order = np.lexsort((parity, place, n, word))
    fresh = _fresh(*(x[order] for x in (word, n, place, parity)))
    start = np.flatnonzero(fresh)
    alike, w, size, where, bits = np.diff(np.append(start, len(order))), *(x[order[start]] for x in (word, n, place, parity))
    group = np.cumsum(_fresh(w)) - 1
    sets = np.bincount(group)[group]
    found = sets > most
    _, high = _within(w, size)
    some = np.arange(len(w))
    for i, j in blocks.ranges(some, some + 1, np.where(found, 0, high)):
        ok = _may_match(size, where, bits[:, None], i, j)
        found[i[ok]] = found[j[ok]] = True
    entry = np.empty(len(order), dtype=np.int64)
    entry[order] = np.cumsum(fresh) - 1
    told = np.flatnonzero((found | (alike > 1))[entry])
    parts_of, twins = np.where(found, -(-sets // most), 1)[entry], np.where(found, 0, alike)[entry]
    return [(got[i][0], bucket, blocks.pack(line[told[k]].astype(np.uint32), *(_narrow(x[told[k]]) for x in (place, parts_of, twins)))) for i, k in blocks.by_bucket(at[told])]


def send_lines(block: int, table: pa.Table, got: list[tuple[int, bytes]], ranks: np.ndarray, buckets: int) -> pa.Table:
    """The block's lines that were named, in full to their keeper, and their entries to the buckets of the words."""
    ids, lines = _open(table)
    copies = np.zeros(len(lines.start), dtype=np.int64)
    for bucket, payload in got:
        if bucket < buckets:
            line, n = blocks.unpack(payload, np.uint32, np.uint8)
            copies[line] = _wide(n, len(line))
    named = [blocks.unpack(p, np.uint32, np.uint8, np.uint8, np.uint8) for b, p in got if b >= buckets]
    line, place, parts, twins = (np.concatenate([np.zeros(0, np.int64), *(x[i].astype(np.int64) if i == 0 else _wide(x[i], len(x[0])) for x in named)]) for i in range(4))
    keep = (copies[line] > 0) & ((twins == 0) | (twins > copies[line]))
    line, place, parts = line[keep], place[keep], parts[keep]
    sets = lines.sets(ranks, np.unique(line))
    of = np.searchsorted(sets.line, line)
    key = sets.word[sets.begin[of] + place]
    # an entry of a word that is dealt over parts goes to each pair of parts with its own
    own = (tokens.mix(line.astype(np.uint64) ^ tokens.mix(np.full(1, block, np.uint64))) % parts.astype(np.uint64)).astype(np.int64)
    each = np.repeat(np.arange(len(line)), parts)
    other = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
    low, high = np.minimum(own[each], other), np.maximum(own[each], other)
    key = np.where(parts[each] > 1, tokens.mix(key[each] + tokens.BASE * (low * (1 << 24) + high + 1).astype(np.uint64)), key[each])
    side = np.where(low == high, 0, np.where(own[each] == low, 1, 2)).astype(np.uint8)
    side[parts[each] == 1] = 0
    of, place = of[each], place[each]
    wide, target = sets.parities(WIDE), (key % np.uint64(buckets)).astype(np.int64)
    out = [(block, _owner(block), blocks.pack(np.flatnonzero(copies).astype(np.uint32), sets.line.astype(np.uint32), sets.n.astype(np.uint32), sets.word, of.astype(np.uint32), target.astype(np.uint32)))]
    for b, at in blocks.by_bucket(target):
        o = of[at]
        out.append((block, b, blocks.pack(key[at], sets.line[o].astype(np.uint32), ids[lines.doc[sets.line[o]]], side[at], *map(_narrow, (place[at], sets.n[o])), wide[o].ravel())))
    return blocks.messages(out)


class Entries:
    """Prefix entries of a bucket, by word and size."""

    def __init__(self, got: list[tuple[int, bytes]]) -> None:
        parts = [blocks.unpack(p, np.uint64, np.uint32, np.int64, np.uint8, np.uint8, np.uint8, np.uint64) for _, p in got]
        block = np.repeat(np.array([b for b, _ in got], dtype=np.int64), [len(p[0]) for p in parts])
        key, line, doc, side, parity = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 6))
        place, n = (np.concatenate([_wide(p[i], len(p[0])) for p in parts]) for i in (4, 5))
        order = np.lexsort((n, key))
        self.key, self.block, self.line, self.doc, self.side, self.place, self.n = (x[order] for x in (key, block, line.astype(np.int64), doc, side, place, n))
        self.parity = parity.reshape(-1, WIDE // NARROW)[order]
        self.low, self.high = _within(self.key, self.n)
        #: the place of each entry's line in the order of doc_id and place
        self.turn = np.empty(len(order), dtype=np.int64)
        self.turn[np.lexsort((self.line, self.block, self.doc))] = np.arange(len(order))
        self.name = self.block * (1 << 32) + self.line

    def test(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of the pairs where y is earlier and all filters pass."""
        ok = np.flatnonzero((self.turn[y] < self.turn[x]) & (self.name[x] != self.name[y]) & ((self.side[x] == 0) | (self.side[x] != self.side[y])))
        return ok[_may_match(self.n, self.place, self.parity, x[ok], y[ok])]

    def pairs(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, earlier row) for all that pass the filters, some at a time."""
        for x, y in blocks.ranges(rows, self.low, self.high):
            ok = self.test(x, y)
            yield x[ok], y[ok]

    def earliest(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, an earlier row) for each row that has one; the earliest, or the earliest of the pivots of its group."""
        start = np.flatnonzero(_fresh(self.key))
        left, found = np.ones(len(self.key), dtype=bool), []
        for a, b in zip(start.tolist(), np.append(start[1:], len(self.key)).tolist(), strict=True):
            if b - a <= SEVERAL:
                continue
            rows = a + np.argsort(self.turn[a:b])
            for pivot in rows[:PIVOTS]:
                near = rows[(rows >= self.low[pivot]) & (rows < self.high[pivot])]
                hit = near[self.test(near, np.full(len(near), pivot))]
                found.append((hit, np.full(len(hit), pivot)))
                left[hit] = False
                rows = rows[left[rows]]
        best = -np.ones(len(self.key), dtype=np.int64)
        for x, y in self.pairs(np.flatnonzero(left)):
            order = np.lexsort((self.turn[y], x))
            x, y = x[order], y[order]
            x, y = x[fresh := _fresh(x)], y[fresh]
            better = (best[x] < 0) | (self.turn[y] < self.turn[best[x]])
            best[x[better]] = y[better]
        row = np.flatnonzero(best >= 0)
        return np.concatenate([row, *(f[0] for f in found)]), np.concatenate([best[row], *(f[1] for f in found)])

    def asks(self, bucket: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, bytes]]:
        """Ask the keepers of the earlier lines to send their words to those of the later ones."""
        return [(bucket, _owner(int(self.block[y[at[0]]])), blocks.pack(*(v[at].astype(np.uint32) for v in (self.line[y], self.block[x], self.line[x])))) for _, at in blocks.by_bucket(self.block[y])]


def ask_first(bucket: int, got: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    """One earlier candidate of each line."""
    if bucket < 0:
        return []
    e = Entries(got)
    return e.asks(bucket, *e.earliest())


def ask_all(bucket: int, got: list[tuple[int, bytes]], open_lines: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    """All earlier candidates of the lines that are still open."""
    if bucket < 0 or not got or not open_lines:
        return []
    e = Entries(got)
    still = np.concatenate([block * (1 << 32) + np.frombuffer(p, dtype=np.uint32).astype(np.int64) for block, p in open_lines])
    out = []
    for x, y in e.pairs(np.flatnonzero(np.isin(e.name, still))):
        out += e.asks(bucket, x, y)
    return out


class Kept:
    """The lines of a block that were sent in full, and the block's lines that are the first of their sets."""

    def __init__(self, payload: bytes) -> None:
        self.first, self.line, n, self.word, self.of, self.target = blocks.unpack(payload, np.uint32, np.uint32, np.uint32, np.uint64, np.uint32, np.uint32)
        self.n = n.astype(np.int64)
        self.begin = np.cumsum(self.n) - self.n

    def words(self, line: int) -> frozenset:
        i = int(np.searchsorted(self.line, line))
        return frozenset(self.word[self.begin[i] : self.begin[i] + self.n[i]].tolist())


def send_words(bucket: int, got: list[tuple[int, bytes]], asks: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Send the words of the lines asked for, each line once to a block."""
    if bucket >= 0 or not got or not asks:
        return []
    kept = Kept(got[0][1])
    parts = [blocks.unpack(p, np.uint32, np.uint32, np.uint32) for _, p in asks]
    mine, to, line = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3))
    order = np.lexsort((line, mine, to))
    mine, to, line = mine[order], to[order], line[order]
    mine, to, line = mine[fresh := _fresh(mine, to, line)], to[fresh], line[fresh]
    where, out = np.searchsorted(kept.line, mine), []
    for _, at in blocks.by_bucket(to):
        used, index = np.unique(where[at], return_inverse=True)
        size = kept.n[used]
        word = np.repeat(kept.begin[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out.append((got[0][0], _owner(int(to[at[0]])), blocks.pack(size.astype(np.uint32), kept.word[word], index.astype(np.uint32), line[at].astype(np.uint32))))
    return out


def verified(kept: Kept, got: list[bytes]) -> tuple[set[int], set[int]]:
    """Lines with a candidate, and those of them that are similar to one."""
    asked: set[int] = set()
    found: set[int] = set()
    own: dict[int, frozenset] = {}
    for payload in got:
        size, word, index, line = blocks.unpack(payload, np.uint32, np.uint64, np.uint32, np.uint32)
        ends, word = np.cumsum(size.astype(np.int64)).tolist(), word.tolist()
        sizes, other = size.tolist(), {}
        for k, x in zip(index.tolist(), line.tolist(), strict=True):
            asked.add(x)
            if x in found:
                continue
            if x not in own:
                own[x] = kept.words(x)
            if k not in other:
                other[k] = frozenset(word[ends[k] - sizes[k] : ends[k]])
            common = len(own[x] & other[k])
            if common * (OVER + UNDER) >= OVER * (len(own[x]) + len(other[k])):
                found.add(x)
    return asked, found


def send_open(bucket: int, got: list[tuple[int, bytes]], words: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Tell the buckets of its entries each line whose first candidates all failed."""
    if bucket >= 0 or not got or not words:
        return []
    kept = Kept(got[0][1])
    asked, found = verified(kept, [p for _, p in words])
    left = np.isin(kept.line[kept.of], np.array(sorted(asked - found), dtype=np.uint32))
    of, target = kept.of[left], kept.target[left].astype(np.int64)
    return [(got[0][0], int(target[at[0]]), np.unique(kept.line[of[at]]).tobytes()) for _, at in blocks.by_bucket(target)]


def decide(bucket: int, got: list[tuple[int, bytes]], words: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    """To its block: the lines that are the first of their sets, and those of them that are similar to an earlier line."""
    if bucket >= 0 or not got:
        return []
    kept = Kept(got[0][1])
    _, found = verified(kept, [p for _, p in words])
    return [(got[0][0], bucket, blocks.pack(kept.first, np.array(sorted(found), dtype=np.uint32)))]


def remove_lines(table: pa.Table, got: list[tuple[int, bytes]], texts: bool) -> pa.Table:
    """The block's texts without the lines that match earlier ones."""
    ids, lines = _open(table)
    gone = lines.with_words()
    for _, payload in got:
        first, found = blocks.unpack(payload, np.uint32, np.uint32)
        gone[first] = False
        gone[found] = True
    rows = []
    edges = np.searchsorted(lines.doc, np.arange(len(ids) + 1))
    data = lines.data.tobytes()
    for d in range(len(ids)):
        a, b = int(edges[d]), int(edges[d + 1])
        out = gone[a:b]
        kept = b"\n".join(data[lines.start[i] : lines.stop[i]] for i in (a + np.flatnonzero(~out)).tolist()) if out.any() else data[lines.start[a] : lines.stop[b - 1]]
        rows.append((None if ids[d] == NO_DOC else int(ids[d]), b - a, int(out.sum()), hashlib.sha256(kept).hexdigest(), np.flatnonzero(out).tolist(), kept))
    schema = ROWS.append(pa.field("kept", pa.binary())) if texts else ROWS
    return pa.table([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(schema))], schema=schema)


def drop_lines(docs: DataFrame, block_bytes: int = blocks.BLOCK_BYTES, most: int = HOT, texts: bool = True) -> DataFrame:
    """Remove every line to which an earlier line is equal, or similar by ``OVER / UNDER``, as a set of words.

    Returns doc_id, n_lines, n_removed, kept_sha256, removed (places of lines from 0) and, with ``texts``, the
    kept bytes for every row. Words are lower-cased runs of letters and digits; lines without one stay. A
    null text is empty and has one line. Rows of equal doc_id follow each other by text; rows of a null
    id come last, in an order of hashes. Equal sets are told by a hash of 128 bits. An empty table gives no rows; further columns
    are ignored. A very long text is one row of its block; a very long line is a set like others.
    """
    n_blocks, n = blocks.block_count(docs, block_bytes)
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))
    rows = blocks.in_blocks(docs, n_blocks)
    told = blocks.answer_each(blocks.send_each(rows, lambda b, t: read_block(b, t, ranks.value, n)), lambda b, got: first_of_sets(b, got) if b < n else plausible(b, got, most))
    sent = blocks.with_answers(rows, told, lambda b, t, got: send_lines(b, t, got, ranks.value, n), blocks.MESSAGE)
    words = blocks.answer_with(sent, blocks.answer_each(sent, ask_first), send_words)
    still = blocks.answer_with(sent, words, send_open)
    rest = blocks.answer_with(sent, blocks.answer_with(sent, still, ask_all), send_words)
    final = blocks.answer_with(sent, words.unionByName(rest), decide)
    return blocks.with_answers(rows, final, lambda b, t, got: remove_lines(t, got, texts), RESULT + (", kept binary" if texts else ""))
