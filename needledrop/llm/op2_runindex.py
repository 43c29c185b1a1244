"""Exact substring deduplication with a run-length index.

Equal strings of ``width`` bytes have the same minimiser, the least hash of their 16-byte
substrings, so a text falls into fragments, maximal runs of windows with one minimiser, and
fragments can only match within their minimiser's bucket. Only minimisers of two documents
or more go on. A bucket joins its distinct fragments into one text and sorts its suffixes for the
Burrows-Wheeler transform, of which it keeps the suffix positions at the ends of runs. From these
samples alone the matching statistics are streamed: from one sample to the next the preceding
suffix moves by one and the common prefix shrinks by one, so the windows that reach ``width`` are
intervals, one a run at most. They are chained to classes of equal windows, and every class has
its smallest document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from needledrop.llm import blocks
from needledrop.llm.tokens import BASE, SLICE, mix

K = 16
NO_DOC = np.iinfo(np.int64).max
#: A byte that UTF-8 never has ends each fragment.
END = 0xFF
#: Fragments of minimisers with more bytes in the corpus are cut into single windows and dealt by their own hash.
HOT = 2 << 20
#: Bytes of fragments indexed together within a bucket.
INDEX_BYTES = 1 << 20
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary"
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ROWS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(SPAN)), ("kept", pa.binary())])


def window_minimisers(data: np.ndarray, width: int) -> np.ndarray:
    """The minimiser of the window at each start; empty where ``data`` is shorter than a window."""
    n = len(data) - K + 1
    if len(data) < width:
        return np.zeros(0, dtype=np.uint64)
    h, length = data.astype(np.uint64) + np.uint64(1), 1
    while length < K:
        h = h[:-length] * np.uint64(pow(int(BASE), length, 1 << 64)) + h[length:]
        length *= 2
    h = mix(h)
    span, m, have = width - K + 1, h, 1
    while have * 2 <= span:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = span - have
    return np.minimum(m[: n - span + 1], m[rest : rest + n - span + 1])


class Fragments:
    """Fragments of a block's documents: minimiser, place in the joined text, length, document."""

    def __init__(self, table: pa.Table, width: int) -> None:
        column = blocks.binary(table, "text")
        self.ids = np.array([NO_DOC if v is None else v for v in table.column("doc_id").to_pylist()], dtype=np.int64)
        n = len(column)
        self.offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1, offset=4 * column.offset).astype(np.int64) if n else np.zeros(1, np.int64)
        buffer = column.buffers()[2] if n else None
        self.data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
        key, start, size, doc = [], [], [], []
        for d in range(n):
            lo, hi = int(self.offsets[d]), int(self.offsets[d + 1])
            at = lo
            while hi - at >= width:
                end = min(hi, at + SLICE + width - 1)
                m = window_minimisers(self.data[at:end], width)
                first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
                key.append(m[first])
                start.append(at + first)
                size.append(np.diff(np.append(first, len(m))) + width - 1)
                doc.append(np.full(len(first), d, dtype=np.int64))
                at = end - width + 1
        none = [np.zeros(0, dtype=np.int64)]
        self.key = np.concatenate(key or [np.zeros(0, np.uint64)])
        self.start, self.size, self.doc = (np.concatenate(x or none).astype(np.int64) for x in (start, size, doc))


def _split_key(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and 48 further bits that tell a minimiser within it."""
    return (key % np.uint64(n)).astype(np.int64), key >> np.uint64(16)


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), dtype=np.uint8)
    out[:, :6] = x.reshape(-1, 6)
    return out.view("<u8").ravel()


def send_minimisers(block: int, table: pa.Table, width: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Each minimiser of the block once, with a byte: whether several documents have it, and the bytes of its fragments in quarter octaves, rounded up."""
    f = Fragments(table, width)
    order = np.argsort(f.key, kind="stable")
    key, doc = f.key[order], f.ids[f.doc[order]]
    if not len(key):
        return []
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    several = np.add.reduceat(fresh, first) > 1
    octaves = np.ceil(4 * np.log2(np.add.reduceat(f.size[order], first)))
    told = (np.minimum(127, octaves) + 128 * several).astype(np.uint8)
    bucket, rest = _split_key(key[first], buckets)
    return [(block, b, blocks.pack(_six(rest[at]), told[at])) for b, at in blocks.by_bucket(bucket)]


def share_minimisers(bucket: int, got: list[tuple[int, bytes]], most: int = HOT) -> list[tuple[int, int, bytes]]:
    """Tell each block which of its minimisers another document has too, and which of them are hot: of over ``most`` bytes."""
    parts = [blocks.unpack(p, np.uint8, np.uint8) for _, p in got]
    rest = np.concatenate([_from_six(p[0]) for p in parts])
    told = np.concatenate([p[1] for p in parts]).astype(np.int64)
    owner = np.repeat(np.arange(len(got)), [len(p[1]) for p in parts])
    order = np.argsort(rest, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], rest[order][1:] != rest[order][:-1])))
    docs, size = np.add.reduceat(1 + (told[order] >> 7), first), np.add.reduceat(2.0 ** ((told[order] & 127) / 4), first)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    shared, hot = np.zeros(len(rest), dtype=bool), np.zeros(len(rest), dtype=bool)
    shared[order], hot[order] = docs[run] > 1, size[run] > most
    edges = np.searchsorted(owner, np.arange(len(got) + 1))
    out = []
    for i, (block, _) in enumerate(got):
        mine = slice(edges[i], edges[i + 1])
        if shared[mine].any():
            out.append((block, bucket, blocks.pack(_six(rest[mine][shared[mine]]), hot[mine][shared[mine]].astype(np.uint8))))
    return out


class Shared:
    """A block's fragments of shared minimisers, equal ones once, by the bucket that indexes them."""

    def __init__(self, table: pa.Table, got: list[tuple[int, bytes]], width: int, buckets: int) -> None:
        self.f = f = Fragments(table, width)
        bucket, rest = _split_key(f.key, buckets)
        keep, is_hot = np.zeros(len(rest), dtype=bool), np.zeros(len(rest), dtype=bool)
        mine = dict(blocks.by_bucket(bucket))
        for b, payload in got:
            told, hot = blocks.unpack(payload, np.uint8, np.uint8)
            told, at = _from_six(told), mine[b]
            order = np.argsort(told)
            told, hot = told[order], hot[order].astype(bool)
            where = np.minimum(np.searchsorted(told, rest[at]), len(told) - 1)
            keep[at] = told[where] == rest[at]
            is_hot[at] = keep[at] & hot[where]
        place = np.flatnonzero(keep & ~is_hot)
        self.start, self.size, self.doc, self.bucket = f.start[place], f.size[place], f.doc[place], bucket[place]
        if is_hot.any():
            place = np.flatnonzero(is_hot)
            n = f.size[place] - width + 1
            base = np.repeat(f.start[place], n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = base + step
            own = np.array([int.from_bytes(hashlib.blake2b(f.data[s : s + width].tobytes(), digest_size=7).digest()) for s in start.tolist()], dtype=np.int64)
            self.start = np.concatenate([self.start, start])
            self.size = np.concatenate([self.size, np.full(len(start), width)])
            self.doc = np.concatenate([self.doc, np.repeat(f.doc[place], n)])
            self.bucket = np.concatenate([self.bucket, own % buckets])
        #: of each occurrence the number of its distinct fragment within (block, bucket)
        text = f.data.tobytes()
        numbers: dict[int, dict[bytes, int]] = {b: {} for b in np.unique(self.bucket).tolist()}
        self.number = np.empty(len(self.start), dtype=np.int64)
        for i, (b, s, n) in enumerate(zip(self.bucket.tolist(), self.start.tolist(), self.size.tolist(), strict=True)):
            known = numbers[b]
            self.number[i] = known.setdefault(text[s : s + n], len(known))
        self.numbers = numbers


def send_fragments(block: int, table: pa.Table, got: list[tuple[int, bytes]], width: int, buckets: int) -> pa.Table:
    """The block's distinct fragments, each with the smallest of its documents."""
    s = Shared(table, got, width, buckets)
    rows = []
    docs = s.f.ids[s.doc]
    for b, at in blocks.by_bucket(s.bucket):
        known = list(s.numbers[b])
        least = np.full(len(known), NO_DOC, dtype=np.int64)
        np.minimum.at(least, s.number[at], docs[at])
        rows.append((block, b, blocks.pack(np.array([len(k) for k in known], dtype=np.uint32), least, np.frombuffer(b"".join(known), dtype=np.uint8))))
    return blocks.messages(rows)


#: With fewer suffixes than this, two ranks and a place share one 64-bit number, which sorts fastest.
PACKED = 1 << 21


def _sorted_by(rank: np.ndarray, follow: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows`` by (rank, follow, place), with their ranks and follows (-1 or more)."""
    if n < PACKED:
        packed = (rank.astype(np.uint64) << np.uint64(43)) | ((follow + 1).astype(np.uint64) << np.uint64(21)) | rows.astype(np.uint64)
        packed.sort()
        low = np.uint64((1 << 21) - 1)
        return (packed & low).astype(np.int64), (packed >> np.uint64(43)).astype(np.int64), ((packed >> np.uint64(21)) & np.uint64((1 << 22) - 1)).astype(np.int64) - 1
    order = np.lexsort((rows, follow, rank))
    return rows[order], rank[order], follow[order]


def suffix_order(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order; ``left`` is the number of bytes up to and with the end of the fragment, past which no comparison goes (ties: by place)."""
    n, depth = len(text), 5
    padded = np.concatenate([text, np.zeros(depth, dtype=np.uint8)])
    key = text.astype(np.int64)
    for j in range(1, depth):
        key = (key << 8) | (padded[j : j + n] * (left > j))
    if n < PACKED:
        packed = (key.astype(np.uint64) << np.uint64(21)) | np.arange(n, dtype=np.uint64)
        packed.sort()
        order, key = (packed & np.uint64(PACKED - 1)).astype(np.int64), packed >> np.uint64(21)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1])) | (left <= depth)[order]  # a suffix that ended is ordered among its equals by place
    rank = np.empty(n, dtype=np.int32 if n < PACKED else np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=rank.dtype), rank.dtype.type(0)))
    open_at = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(open_at):
        rows = order[open_at]
        follow = np.where(left[rows] > depth, rank[np.minimum(rows + depth, n - 1)], -1)
        rows, head, follow = _sorted_by(rank[rows], follow, rows, n)
        order[open_at] = rows
        fresh = np.concatenate(([True], (head[1:] != head[:-1]) | (follow[1:] != follow[:-1]) | (left[rows][1:] <= depth)))
        rank[rows] = np.maximum.accumulate(np.where(fresh, open_at, 0)).astype(rank.dtype)
        open_at = open_at[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order


class RunIndex:
    """Run ends of the Burrows-Wheeler transform of fragments: the suffix positions there, and their common prefixes."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> None:
        self.width, self.n = width, len(text)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(text))
        order = suffix_order(text, left)
        begins = np.zeros(len(text), dtype=bool)
        begins[starts] = True
        letter = text[order - 1]  # of the first position the last byte: an end, a run of its own as it begins a fragment
        edge = np.concatenate(([True], letter[1:] != letter[:-1]))
        edge |= begins[order]
        edge[1:] |= begins[order[:-1]]
        heads = np.flatnonzero(edge)
        #: suffix positions at the heads of runs and at the ends of the runs before them
        self.head = order[heads]
        self.before = np.concatenate(([-1], order[heads[1:] - 1])) if len(heads) else np.zeros(0, np.int64)
        self.common = self._common_prefix(text, left)

    def _common_prefix(self, text: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Common prefix of each run head with the suffix before it, within both fragments; eight bytes at a time."""
        a, b = self.head, np.maximum(self.before, 0)
        limit = np.where(self.before >= 0, np.minimum(left[a], left[b]) - 1, 0)
        padded = np.concatenate([text, np.zeros(16, dtype=np.uint8)])
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(text) + 8]).view(">u8").ravel().astype(np.uint64)
        out = np.zeros(len(a), dtype=np.int64)
        live = np.flatnonzero(limit > 0)
        while len(live):
            at = out[live]
            x = eight[a[live] + at] ^ eight[b[live] + at]
            same = np.zeros(len(live), dtype=np.int64)
            for k in range(8):
                same += x < np.uint64(1 << (56 - 8 * k))
            out[live] = at + same
            live = live[(x == 0) & (out[live] < limit[live])]
        return np.minimum(out, limit)

    def long_matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of windows that an earlier suffix shares: start, source of the first and length.

        Streamed in text order: from a sample on, the preceding suffix moves along and the common prefix
        shrinks by one a step, up to the next sample. Only samples with a long enough prefix give anything.
        """
        order = np.argsort(self.head)
        head, before, common = self.head[order], self.before[order], self.common[order]
        room = np.diff(np.append(head, self.n))
        size = np.where(before >= 0, np.minimum(common - self.width + 1, room), 0)
        live = size > 0
        return head[live], before[live], size[live]


def least_documents(fragments: list[bytes], docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest document of every window among all the fragments, as runs: runs of each fragment, their lengths and documents."""
    sizes = np.array([len(f) + 1 for f in fragments], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(bytes([END]).join([*fragments, b""]), dtype=np.uint8)
    index = RunIndex(text, starts, sizes, width)
    start, source, size = index.long_matches()
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    live, first = np.repeat(start, size) + step, np.arange(index.n)
    first[live] = np.repeat(source, size) + step
    while len(live):  # to the first suffix of the class of equal windows, doubling the step
        far = first[first[live]]
        moved = far != first[live]
        first[live] = far
        live = live[moved]
    owner = np.repeat(docs, sizes)
    least = np.full(index.n, NO_DOC, dtype=np.int64)
    np.minimum.at(least, first, owner)
    windows = sizes - width
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    found = least[first[at]]
    begins = np.zeros(len(found), dtype=bool)
    begins[np.cumsum(windows) - windows] = True
    head = np.flatnonzero(begins | np.concatenate(([True], found[1:] != found[:-1])))
    counts = np.bincount(np.repeat(np.arange(len(windows)), windows)[head], minlength=len(windows))
    return counts, np.diff(np.append(head, len(found))), found[head]


def index_bucket(bucket: int, got: list[tuple[int, bytes]], width: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Answer each block with the smallest document of every window of its fragments, as runs."""
    known: dict[bytes, int] = {}
    least: list[int] = []
    local = []
    for _, payload in got:
        sizes, docs, data = blocks.unpack(payload, np.uint32, np.int64, np.uint8)
        text, ends = data.tobytes(), np.cumsum(sizes.astype(np.int64))
        numbers = np.empty(len(sizes), dtype=np.int64)
        for i, (end, n, doc) in enumerate(zip(ends.tolist(), sizes.tolist(), docs.tolist(), strict=True)):
            numbers[i] = k = known.setdefault(text[end - n : end], len(known))
            if k == len(least):
                least.append(doc)
            elif doc < least[k]:
                least[k] = doc
        local.append(numbers)
    fragments = list(known)
    docs, order, parts = np.array(least, dtype=np.int64), [], []
    for group in index_groups(fragments, width):
        order += group
        parts.append(least_documents([fragments[i] for i in group], docs[group], width))
    counts, lengths, found = (np.concatenate([p[i] for p in parts]) for i in range(3))
    begin, n_runs = np.empty(len(fragments), dtype=np.int64), np.empty(len(fragments), dtype=np.int64)
    begin[order], n_runs[order] = np.cumsum(counts) - counts, counts
    out = []
    for (block, _), numbers in zip(got, local, strict=True):
        n = n_runs[numbers]
        run = np.repeat(begin[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out.append((block, bucket + buckets, blocks.pack(n.astype(np.uint32), lengths[run].astype(np.uint32), found[run])))
    return out


def index_groups(fragments: list[bytes], width: int) -> list[list[int]]:
    """Fragments of one minimiser together, of some minimisers to a group.

    Where a minimiser has single windows only, as hot ones do, they are distinct and may part.
    """
    key = _first_minimisers(fragments, width)
    order = np.argsort(key, kind="stable")
    size = np.array([len(f) + 1 for f in fragments], dtype=np.int64)[order]
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    single = np.repeat(np.maximum.reduceat(size, first) == width + 1, np.diff(np.append(first, len(order))))
    may_part = single.copy()
    may_part[first] = True
    groups, now, total = [], [], 0
    for i, n, part in zip(order.tolist(), size.tolist(), may_part.tolist(), strict=True):
        if part and total > INDEX_BYTES:
            groups.append(now)
            now, total = [], 0
        now.append(i)
        total += n
    return [*groups, now]


def _first_minimisers(fragments: list[bytes], width: int) -> np.ndarray:
    rows = 1 << 14
    out = []
    for at in range(0, len(fragments), rows):
        head = np.frombuffer(b"".join(f[:width] for f in fragments[at : at + rows]), dtype=np.uint8)
        m = window_minimisers(head, width)
        out.append(m[::width])
    return np.concatenate(out)


def remove_spans(block: int, table: pa.Table, got: list[tuple[int, bytes]], width: int, buckets: int) -> pa.Table:
    """Cut what an earlier document has too out of the block's texts."""
    s = Shared(table, [(b, p) for b, p in got if b < buckets], width, buckets)
    f = s.f
    marks = np.zeros(len(f.data) + 1, dtype=np.int32)
    told = {b - buckets: p for b, p in got if b >= buckets}
    docs = f.ids[s.doc]
    for b, at in blocks.by_bucket(s.bucket):
        counts, lengths, least = blocks.unpack(told[b], np.uint32, np.uint32, np.int64)
        ends = np.cumsum(counts.astype(np.int64))
        n = counts[s.number[at]].astype(np.int64)
        run = np.repeat(ends[s.number[at]] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = lengths[run].astype(np.int64)
        upto = np.cumsum(size) - size
        begin = upto - np.repeat(upto[np.cumsum(n) - n], n) + np.repeat(s.start[at], n)
        hit = least[run] < np.repeat(docs[at], n)
        np.add.at(marks, begin[hit], 1)
        np.add.at(marks, begin[hit] + size[hit] + width - 1, -1)
    cut = np.cumsum(marks[:-1]) > 0
    rows = []
    for d in range(len(f.ids)):
        lo, hi = int(f.offsets[d]), int(f.offsets[d + 1])
        out = cut[lo:hi]
        edge = np.diff(np.concatenate(([0], out.astype(np.int8), [0])))
        kept = f.data[lo:hi][~out].tobytes()
        spans = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        rows.append((None if f.ids[d] == NO_DOC else int(f.ids[d]), hi - lo, int(out.sum()), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
    return pa.table([pa.array([r[i] for r in rows], ROWS.field(i).type) for i in range(len(ROWS))], schema=ROWS)


def drop_repeats(docs: DataFrame, width: int = 50, block_bytes: int = blocks.BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Remove each byte that a ``width``-byte string covers which starts in a document of smaller doc_id too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and the kept bytes for every row.
    A null text is empty; texts shorter than ``width`` stay whole; rows of equal doc_id do not
    match each other; a null doc_id comes after all others; an empty table gives none; further
    columns are ignored. A very long text is one row of its block, and takes part whole.
    """
    blocks_n, n = blocks.block_count(docs, block_bytes)
    rows = blocks.in_blocks(docs, blocks_n)
    told = blocks.answer_each(blocks.send_each(rows, lambda b, t: send_minimisers(b, t, width, n)), lambda b, got: share_minimisers(b, got, hot))
    sent = blocks.with_answers(rows, told, lambda b, t, got: send_fragments(b, t, got, width, n), blocks.MESSAGE)
    found = blocks.answer_each(sent, lambda b, got: index_bucket(b, got, width, n))
    return blocks.with_answers(rows, told.unionByName(found), lambda b, t, got: remove_spans(b, t, got, width, n), RESULT)
