"""Near-duplicate search by Order MinHash.

A text's three-word shingles (a short one's words too) are labelled with their occurrence number. Each of several
sketches takes the labelled shingles of the least hashes and keeps them in their order in
the text, so that agreement follows edit similarity. Texts that share a sketch are linked to
the sketch's first text, and to the first of about their own length; a link stands if the banded
alignment of the words has at most a fifth of the longer text in edits. All other pairs that share
a sketch and are not in one class by then are looked at in a second step, within tasks: the parities
of hashed word classes bound the edits from below, and the few pairs that pass are aligned, so none is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm import blocks, tokens
from needledrop.llm.skew import look_up
from needledrop.operators.components import connected_components
from needledrop.scratch import materialise

#: Words in a shingle.
K = 3
SKETCHES = 40
#: Texts of up to so many words have as many sketches of single words besides, since few edits break all their shingles.
SHORT = 40
#: Shingles kept in one sketch.
KEPT = 2
LAST = np.uint64(2**64 - 1)
WORD = re.compile(rb"(?:[A-Za-z0-9]|[\x80-\xff])+")
#: Members that are aligned with one text in one group; more are dealt over several.
MEMBERS = 256
#: Texts of a key that are looked at in one place in the second step; those of larger keys are dealt over pairs of parts.
HOT = 2048
#: Rows of the second step in a task, and the least bits of a text's signature.
ROWS, BITS = 20_000, 256
#: Bytes of text in a group of alignments.
GROUP_BYTES = 4 << 20
#: Up to so many words an alignment keeps a bit mask of every word.
MASKED = 4096
#: Texts that no id names have nodes from here on, so that the least node of a class is a doc_id where it has one.
STRAY = 1 << 62


def labelled(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each value with its occurrence number within its text, and the text."""
    if not len(value):
        return np.zeros(0, np.uint64), owner
    order, close = None, owner[-1] >= 1 << 16
    if not close:  # text and 48 bits of the value in one number sort fastest
        key = (owner.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16))
        order = np.argsort(key, kind="stable")
        close = ((key[order][1:] == key[order][:-1]) & (value[order][1:] != value[order][:-1])).any()
    if close:
        order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1]))), np.arange(len(v)), 0))
    occurrence = np.empty(len(v), dtype=np.uint64)
    occurrence[order] = np.arange(len(v)) - first
    return tokens.mix(value + occurrence * tokens.BASE), owner


def order_minhash(word: np.ndarray, text: np.ndarray, n_texts: int, sketches: int = SKETCHES, k: int = K) -> list[np.ndarray]:
    """Sketch keys of each text; none for a text of fewer than ``k`` + 1 words."""
    value, owner, _ = tokens.shingles(word, text, k)
    several = np.bincount(owner, minlength=n_texts)[owner] >= KEPT
    value, owner = value[several], owner[several]
    if not len(value):
        return [np.zeros(0, np.int64)] * n_texts
    label, _ = labelled(value, owner)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    sizes = np.diff(np.append(starts, len(owner)))
    group = np.repeat(np.arange(len(starts)), sizes)
    out = np.empty((len(starts), sketches), dtype=np.uint64)
    for j in range(sketches):
        h = tokens.mix(label ^ np.uint64((j + 1) * 0x632BE59BD9B4E019 % 2**64))
        places = []
        for _ in range(KEPT):
            hit = np.flatnonzero(h == np.minimum.reduceat(h, starts)[group])
            place = hit[np.concatenate(([True], group[hit][1:] != group[hit][:-1]))]
            places.append(place)
            h[place] = LAST
        chosen = np.sort(np.stack(places), axis=0)
        key = np.full(len(starts), np.uint64(j + 1000 * (k != K)), dtype=np.uint64)
        for row in chosen:
            key = tokens.mix(key * tokens.BASE + value[row])
        out[:, j] = key
    keys = out.view(np.int64)
    by_text = dict(zip(owner[starts].tolist(), keys, strict=True))
    return [by_text.get(i, np.zeros(0, np.int64)) for i in range(n_texts)]


def sketch_keys(word: np.ndarray, text: np.ndarray, n_texts: int, sketches: int = SKETCHES) -> list[np.ndarray]:
    """Sketch keys of each text, those of single words too where it is short."""
    short = np.bincount(text, minlength=n_texts)[text] <= SHORT
    return [np.concatenate(both) for both in zip(order_minhash(word, text, n_texts, sketches), order_minhash(word[short], text[short], n_texts, sketches, 1), strict=True)]


def signatures(word: np.ndarray, text: np.ndarray, n_texts: int) -> list[bytes]:
    """Per text the parities of its words in hash classes, at least two for each word; half as many classes are the halves laid over each other.

    Words have their occurrence number. An edit takes a word away, brings one or does both, and with it the
    last of its occurrences, so texts of d edits differ in 2 * d parities at most, less one for each word that one is longer.
    """
    word, _ = labelled(word, text)
    edges = np.searchsorted(text, np.arange(n_texts + 1))
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        classes = max(BITS, 1 << (2 * (b - a) - 1).bit_length()) if b > a else BITS
        counts = np.bincount((word[a:b] & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
        out.append(np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes())
    return out


def sketch(docs: DataFrame, sketches: int = SKETCHES) -> DataFrame:
    """doc_id, a 128-bit hash of the text (null: empty), n_words, the sketch keys and the signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column, code = batch.column(0), batch.column(1), batch.column(2)
            for at, end, data, offsets in tokens.slices(column):
                word, text, *_ = tokens.words(data, offsets)
                keys = sketch_keys(word, text, end - at, sketches)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, end - at), code.slice(at, end - at), pa.array(np.bincount(text, minlength=end - at), pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signatures(word, text, end - at), pa.binary())],
                    ["doc_id", "code", "n_words", "keys", "signature"],
                )

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"), F.md5(text).alias("code"))
    return rows.mapInArrow(run, "doc_id bigint, code string, n_words bigint, keys array<bigint>, signature binary")


class Places:
    """Where each word is in a list, as windows of bits; memory grows with the list, not with its square."""

    def __init__(self, a: list) -> None:
        self.at: dict = {}
        for i, x in enumerate(a):
            self.at.setdefault(x, []).append(i)
        # short lists have a mask for each word, long ones only for their most frequent words, 64 at most
        often = 0 if len(a) <= MASKED else len(a) // 64
        self.mask = {x: self._bits(p, 0, len(a)) for x, p in self.at.items() if len(p) > often}

    @staticmethod
    def _bits(places: list[int], start: int, width: int) -> int:
        out = bytearray(width // 8 + 1)
        for p in places:
            out[(p - start) >> 3] |= 1 << ((p - start) & 7)
        return int.from_bytes(out, "little")

    def window(self, x, start: int, width: int, full: int) -> int:
        """Bit i is set where ``x`` is at ``start`` + i."""
        if (mask := self.mask.get(x)) is not None:
            return (mask >> start if start > 0 else mask << -start) & full
        places = self.at.get(x)
        if places is None:
            return 0
        there = places[bisect_left(places, start) : bisect_left(places, start + width)]
        return 1 << (there[0] - start) if len(there) == 1 else self._bits(there, start, width) if there else 0


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences where it is at most ``most``, else ``most`` + 1.

    Only cells within ``most`` of the diagonal are kept, as the bits of two integers that move
    down the diagonal, one step for each element of ``b`` (the bit-parallel band of Hyyrö).
    """
    at, end_a, end_b = 0, len(a), len(b)
    while at < end_a and at < end_b and a[at] == b[at]:
        at += 1
    while end_a > at and end_b > at and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[at:end_a], b[at:end_b]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > most:
        return most + 1
    if not n:
        return m
    band = min(most, m)
    where = Places(a)
    width = 2 * band + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    vp, vn = (full << (width - 1 - band)) & full, 0
    distance, start = band, band + 1 - width
    row = top
    for j, x in enumerate(b):
        eq = where.window(x, start, width, full)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        d0 &= full
        hp = vn | (full ^ (d0 | vp))
        hn = d0 & vp
        if j < m - band:  # down the lowest diagonal of the band
            if not d0 & top:
                distance += 1
            if distance > most + n - j + band:
                return most + 1
        else:  # along the last row
            row >>= 1
            if hp & row:
                distance += 1
            elif hn & row:
                distance -= 1
        half = d0 >> 1
        vp, vn = hn | (full ^ (half | hp)), half & hp
        start += 1
    return distance if distance <= most else most + 1


def alike(a: list, b: list, similarity: float, bag_a: Counter | None = None) -> bool:
    """Whether 1 - edit distance / longer length of two word lists reaches ``similarity``."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    common = sum(((bag_a or Counter(a)) & Counter(b)).values())  # no alignment keeps more words than these
    return longer - common <= most and banded_distance(a, b, most) <= most


def shared_keys(reps: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, c) for each text and sketch key that it shares with another; c is the key's first text."""
    entries = reps.select("doc_id", "n_words", F.explode("keys").alias("key"))
    first = F.min(F.struct("doc_id", "n_words"))
    firsts = entries.groupBy("key").agg(first.alias("c"), F.count("*").alias("n")).filter("n > 1").select("key", "c")
    return entries.join(firsts, "key").select("key", "doc_id", "n_words", "c")


def _within(a: str, b: str, similarity: float):
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def candidate_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Distinct (center, doc_id, n_words) of texts with a sketch in common, lengths within the bound.

    A sketch links each text to its first text and to the first of both pairs of neighbouring length
    classes that hold the text: links grow with the texts, not with their pairs. ``other_pairs`` has the rest.
    """
    step = float(np.log(1 / similarity))
    level = F.floor(F.log("n_words") / step)
    entries = shared.select("key", "doc_id", "n_words", F.explode(F.array(level, level + 1)).alias("class"))
    first = F.min(F.struct("doc_id", "n_words"))
    per_class = entries.groupBy("key", "class").agg(first.alias("c"), F.count("*").alias("n")).filter("n > 1").select("key", "class", "c")
    links = shared.select("c", "doc_id", "n_words").unionByName(entries.join(per_class, ["key", "class"]).select("c", "doc_id", "n_words"))
    links = links.select(F.col("c.doc_id").alias("center"), F.col("c.n_words").alias("center_words"), "doc_id", "n_words").filter("center <> doc_id")
    links = links.filter(_within("n_words", "center_words", similarity))
    return links.select(F.least("center", "doc_id").alias("center"), F.greatest("center", "doc_id").alias("doc_id"), (F.col("n_words") + F.col("center_words")).alias("n_words")).distinct()


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node and other columns) with each node's text as bytes.

    Merged at every size: what is wanted grows with the corpus, so it is not broadcast where it happens to be little.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("first_id"), text.alias("text"), F.md5(text).alias("code"))
    return texts.join(wanted.join(nodes.select("node", "first_id", "code"), "node").hint("merge"), ["first_id", "code"]).drop("first_id", "code")


class Signatures:
    """Signatures of texts as rows of 64-bit numbers, one table for each number of classes."""

    def __init__(self, raw: list[bytes]) -> None:
        size = np.array([8 * len(r) for r in raw], dtype=np.int64)
        self.level = np.round(np.log2(size // BITS)).astype(np.int64)
        self.rows: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        folded = [np.frombuffer(r, dtype=np.uint64) for r in raw]
        for level in range(int(self.level.max()), -1, -1):
            at = np.flatnonzero(self.level >= level)
            words = (BITS << level) // 64
            for i in at.tolist():
                if len(folded[i]) > words:
                    folded[i] = folded[i][:words] ^ folded[i][words:]
            place = np.full(len(raw), -1)
            place[at] = np.arange(len(at))
            self.rows.insert(0, np.stack([folded[i] for i in at.tolist()]))
            self.place.insert(0, place)

    def within(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Places of the pairs that differ in at most ``most`` parities, by the fewest classes and then by all that both have."""
        ok = np.flatnonzero(self._gap(0, x, y) <= most)
        both = np.minimum(self.level[x[ok]], self.level[y[ok]])
        keep = np.ones(len(ok), dtype=bool)
        for level in np.unique(both[both > 0]).tolist():
            at = np.flatnonzero(both == level)
            for some in np.array_split(at, max(1, len(at) * (BITS << level) >> 28)):
                keep[some] = self._gap(level, x[ok[some]], y[ok[some]]) <= most[ok[some]]
        return ok[keep]

    def _gap(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        rows, place = self.rows[level], self.place[level]
        return np.bitwise_count(rows[place[x]] ^ rows[place[y]]).sum(axis=1, dtype=np.int64)


def plausible(table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, words of both) of a bucket's groups that lie in different parts of the texts and can be alike by lengths and signatures.

    A pair comes out of one group only, that of its first sketch in common.
    """
    key, group, ids, n, part, side = (table.column(c).to_numpy() for c in ("key", "group", "doc_id", "n_words", "part", "side"))
    order = np.lexsort((n, group))
    key, group, ids, n, part, side = (v[order] for v in (key, group, ids, n, part, side))
    lists = table.column("keys").to_pylist()
    keys = np.zeros((len(order), max(map(len, lists))), dtype=np.int64)
    given = np.zeros(keys.shape, dtype=bool)
    for i, at in enumerate(order.tolist()):
        keys[i, : len(lists[at])] = lists[at]
        given[i, : len(lists[at])] = True
    raw = table.column("signature").to_pylist()
    signs = Signatures([raw[i] for i in order.tolist()])
    number = np.cumsum(np.concatenate(([0], group[1:] != group[:-1])))
    low = np.searchsorted((number << 34) + n, (number << 34) + np.ceil(similarity * n - 1e-9).astype(np.int64), "left")
    high = np.searchsorted((number << 34) + n, (number << 34) + np.floor(n / similarity + 1e-9).astype(np.int64), "right")
    # every pair of different parts has a member outside its group's largest part
    by_part = np.lexsort((part, number))
    first = np.flatnonzero(np.concatenate(([True], (number[by_part][1:] != number[by_part][:-1]) | (part[by_part][1:] != part[by_part][:-1]))))
    size = np.diff(np.append(first, len(by_part)))
    best = np.lexsort((size, number[by_part[first]]))
    last = np.append(number[by_part[first[best]]][1:] != number[by_part[first[best]]][:-1], True)
    largest = part[by_part[first[best[last]]]][number]
    outside = part != largest
    found = []
    for x, y in blocks.ranges(np.flatnonzero(outside), low, high):
        ok = np.flatnonzero((part[x] != part[y]) & ((side[x] == 0) | (side[x] != side[y])) & (~outside[y] | (ids[x] < ids[y])))
        x, y = x[ok], y[ok]
        ok = signs.within(x, y, 2 * np.floor((1 - similarity) * np.maximum(n[x], n[y]) + 1e-9).astype(np.int64) - np.abs(n[x] - n[y]))
        for some in np.array_split(ok, max(1, len(ok) >> 14)):
            a, b = x[some], y[some]
            first = ((keys[a] == keys[b]) & given[a] & given[b]).argmax(axis=1)
            mine = keys[a, first] == key[a]
            a, b = a[mine], b[mine]
            found.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), n[a] + n[b]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return pairs[0], pairs[1], pairs[2]


def other_pairs(reps: DataFrame, shared: DataFrame, tried: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """All further pairs with a sketch in common that can be alike and that ``classes`` does not join yet.

    A key whose texts are in one class asks nothing, so a large group of copies costs no pairs. The texts of
    mixed keys meet within tasks, and only pairs that pass the bounds on lengths and edits come out. A key of
    over ``HOT`` texts is dealt over tasks, each for a pair of its parts.
    """
    named = materialise(shared.join(classes.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", "n_words", F.coalesce("component", "doc_id").alias("part")))
    mixed = named.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).filter("lo < hi and n > 2")
    members = materialise(named.join(mixed.select("key", F.ceil(F.col("n") / HOT).alias("parts")), "key"))
    sent = members.agg(F.coalesce(F.sum("parts"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sent // ROWS))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("key", "doc_id", "n_words", "part", F.xxhash64("key", low, high).alias("group"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"))
    dealt = dealt.withColumn("bucket", F.pmod("group", F.lit(buckets))).join(reps.select(F.col("node").alias("doc_id"), "signature", "keys"), "doc_id")

    def run(key, table):
        a, b, n = plausible(table, similarity)
        return pa.table({"center": pa.array(a, pa.int64()), "doc_id": pa.array(b, pa.int64()), "n_words": pa.array(n, pa.int64())})

    pairs = dealt.groupBy("bucket").applyInArrow(run, "center bigint, doc_id bigint, n_words bigint")
    return pairs.join(tried.select("center", "doc_id").hint("merge"), ["center", "doc_id"], "left_anti")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose alignment reaches ``similarity``.

    Pairs are dealt by center; a center of many members is dealt over several groups, each of which
    gets the center's text once.
    """
    facts = pairs.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    groups = max(3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-facts["words"] * 7 // GROUP_BYTES))
    sizes = pairs.groupBy("center").agg((F.floor((F.count("*") - 1) / MEMBERS) + 1).alias("parts"))
    dealt = materialise(pairs.join(sizes, "center").select("center", "doc_id", F.pmod(F.xxhash64("center", F.pmod(F.xxhash64("doc_id"), F.col("parts"))), F.lit(groups)).cast("int").alias("group")))
    wanted = dealt.select(F.col("doc_id").alias("node"), "group").unionByName(dealt.select(F.col("center").alias("node"), "group")).distinct()
    there = texts_of(docs, nodes, wanted).select(F.col("group").alias("part"), F.col("node").alias("id"), "text")

    def run(key, rows, links):
        words = {i: [w.lower() for w in WORD.findall(t)] for i, t in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), strict=True)}
        out = []
        center, bag = None, None
        for a, b in sorted(zip(links.column("center").to_pylist(), links.column("doc_id").to_pylist(), strict=True)):
            if a != center:
                center, bag = a, Counter(words[a])
            if alike(words[a], words[b], similarity, bag):
                out.append((a, b))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return there.groupBy("part").cogroup(dealt.groupBy("group")).applyInArrow(run, "a bigint, b bigint")


def text_nodes(facts: DataFrame) -> DataFrame:
    """(code, node, first_id) of each text: its smallest doc_id, of the ids that name it.

    Where rows repeat an id with other texts, the id names the one of the smallest code. A text that no id
    names has a node above all ids, and the smallest of the ids that it is found under.
    """
    ids = facts.filter("doc_id is not null").groupBy("doc_id").agg(F.min("code").alias("code"), F.max("code").alias("last"))
    named = ids.groupBy("code").agg(F.min("doc_id").alias("first_id")).select("code", F.col("first_id").alias("node"), "first_id")
    several = ids.filter("code <> last").select("doc_id", F.col("code").alias("named"))
    stray = facts.join(several, "doc_id").filter("code <> named").groupBy("code").agg(F.min("doc_id").alias("first_id")).join(named.select("code"), "code", "left_anti")
    return named.unionByName(stray.select("code", F.xxhash64("code").bitwiseAND(STRAY - 1).bitwiseOR(STRAY).alias("node"), "first_id"))


def text_classes(docs: DataFrame, similarity: float, sketches: int) -> tuple[DataFrame, DataFrame]:
    """The sketched rows, and (code, node, first_id, component) of each text; component is the least node of its class."""
    facts = materialise(sketch(docs, sketches))
    nodes = materialise(text_nodes(facts))
    reps = materialise(facts.withColumnRenamed("doc_id", "first_id").join(nodes, ["code", "first_id"]).dropDuplicates(["node"]).filter("n_words > 0").select("node", "n_words", "keys", "signature"))
    shared = materialise(shared_keys(reps.select(F.col("node").alias("doc_id"), "n_words", "keys")))
    pairs = materialise(candidate_pairs(shared, similarity))
    edges = materialise(verify(docs, nodes, pairs, similarity))
    classes = materialise(connected_components(edges))
    rest = materialise(other_pairs(reps, shared, pairs, classes, similarity))
    further = materialise(verify(docs, nodes, rest, similarity))
    classes = connected_components(edges.unionByName(further))
    return facts, materialise(nodes.join(classes, "node", "left").select("code", "node", "first_id", F.coalesce("component", "node").alias("component")))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, sketches: int = SKETCHES) -> DataFrame:
    """(doc_id, class_id) of every row; class_id is the smallest doc_id of its group of near copies.

    Equal texts are one text from the start, empty and null ones too. Texts of fewer than five
    words match equal texts only, as an edit is over a fifth of them. Rows that repeat an id with other
    texts are judged each by its own text. Rows with a null id are in no group (null class_id). An empty
    table gives none; further columns are ignored.
    """
    facts, texts = text_classes(docs, similarity, sketches)
    unnamed = texts.filter(F.col("component") >= STRAY).groupBy("component").agg(F.min("first_id").alias("least"))
    labels = materialise(texts.join(unnamed, "component", "left").select("code", F.coalesce("least", "component").alias("class_id")))
    # the rows of a text that a large part of all have are not sent to one task
    return look_up(facts.select("doc_id", "code"), labels, "code").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("found.class_id")).alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = 0.8, sketches: int = SKETCHES) -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies: the text of the smallest doc_id.

    Of rows equal in doc_id and text one stays. Where rows repeat an id with other texts, each text is judged by
    itself, so none is lost that has no near copy. Rows with a null id stay; an empty table gives none; further
    columns stay, whatever their names.
    """
    _, texts = text_classes(docs, similarity, sketches)
    first = texts.filter("node = component").select(F.col("first_id").alias("id"), "code")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("code"))
    kept = rows.join(first.hint("merge"), ["id", "code"], "left_semi").dropDuplicates(["id", "code"])
    return rows.filter("id is null").unionByName(kept).select("row.*")
