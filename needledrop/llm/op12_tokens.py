"""Token counts by a map-side lookup in two tiers: a broadcast table of frequent pieces, and worker caches for all others.

A piece is what the vocabulary's pre-tokens are looked up by: a pre-token of ASCII text in lower case, or a whole
white-space-delimited word that holds other letters, which the library normalises and splits itself. Pre-tokens never
cross white space, so a text has the tokens of its pieces and of the special strings between them, and no piece is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the table of frequent pieces is counted on, and its most entries: its pieces are of up to ``LONGEST`` bytes, so it has at most 2 MB.
SAMPLE_ROWS, ENTRIES, LONGEST = 4096, 1 << 15, 64
#: Pieces that a worker remembers besides; a full cache starts anew.
CACHED = 1 << 18
#: Texts are gone through in stretches of about so many bytes, which end at white space.
STRETCH = 1 << 20
PARTS = 8
GAP = re.compile(rb"[\t-\r ]")
#: How the vocabulary splits text, here for lower-case ASCII.
ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """``text`` in parts that end at white space."""
    at = 0
    while len(text) - at > size:
        gap = GAP.search(text, at + size)
        if not gap:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:] if at else text


class Vocabulary:
    """The library's tokens of pieces and texts."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.no_padding()
        self.library.no_truncation()
        added = self.library.get_added_tokens_decoder().values()
        odd = any(t.single_word or t.lstrip or t.rstrip or t.normalized or GAP.search(t.content.encode()) for t in added)
        pattern, probe = b"|".join(re.escape(t.content.encode()) for t in sorted(added, key=lambda t: -len(t.content))), "It's a 12-word probe, isn't it? We'll see: X2 (3.5)"
        #: Whether this vocabulary splits text as ``ASCII_PIECES`` has it; if not, the library is given whole stretches.
        self.known = not odd and [p.encode() for p in self._split(probe)] == ASCII_PIECES.findall(probe.lower().encode())
        self.special = re.compile(pattern) if pattern else None

    def _split(self, text: str) -> list[str]:
        normal, before = self.library.normalizer, self.library.pre_tokenizer
        normalised = normal.normalize_str(text) if normal else text
        return [p for p, _ in before.pre_tokenize_str(normalised)] if before else [normalised]

    def of_piece(self, piece: bytes) -> int:
        """Tokens of a piece."""
        text = piece.decode("utf-8", "replace")
        # a piece of ASCII is normal already, and splits into itself
        return sum(len(self.library.model.tokenize(p)) for p in self._split(text))

    def of_text(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def pieces(self, text: bytes) -> tuple[Counter, int]:
        """How often each piece occurs in a stretch, and the number of special strings."""
        special = 0
        if self.special and (n := len(self.special.findall(text))):
            special, text = n, self.special.sub(b" ", text)
        if text.isascii():
            return Counter(ASCII_PIECES.findall(text.lower())), special
        words = text.split()
        other = [w for w in words if not w.isascii()]
        count = Counter(ASCII_PIECES.findall(b" ".join([w for w in words if w.isascii()]).lower()))
        count.update(other)
        return count, special


class Counting:
    """Counts of texts in one worker: the frequent pieces first, then what the worker has seen, then the library."""

    def __init__(self, source: str, frequent: tuple[bytes, bytes]) -> None:
        self.vocabulary = Vocabulary(source)
        pieces, lengths = frequent
        self.frequent = dict(zip(pieces.split(b" "), np.frombuffer(lengths, np.uint16).tolist(), strict=True)) if lengths else {}
        self.seen: dict[bytes, int] = {}

    def of_piece(self, piece: bytes) -> int:
        n = self.seen.get(piece)
        if n is None:
            n = self.vocabulary.of_piece(piece)
            if len(piece) <= LONGEST:
                if len(self.seen) >= CACHED:
                    self.seen.clear()
                self.seen[piece] = n
        return n

    def of_text(self, text: bytes) -> int:
        if not self.vocabulary.known:
            return self.vocabulary.of_text(text.decode("utf-8", "replace"))
        total, find = 0, self.frequent.get
        for part in stretches(text):
            count, special = self.vocabulary.pieces(part)
            total += special
            for piece, k in count.items():
                n = find(piece)
                total += k * (self.of_piece(piece) if n is None else n)
        return total


#: The last counter of this worker process: tasks of one job share its caches.
_WORKER: dict[int, Counting] = {}


def counter_of(shared) -> Counting:
    """This worker's counter for a broadcast (number, vocabulary, frequent pieces)."""
    number, source, frequent = shared.value
    if number not in _WORKER:
        _WORKER.clear()
        _WORKER[number] = Counting(source, frequent)
    return _WORKER[number]


def frequent_pieces(docs: DataFrame, source: str, rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> tuple[bytes, bytes]:
    """The most frequent pieces of about ``rows`` rows, chosen by the hash of their doc_id, joined by spaces, and their lengths in tokens.

    Only speed depends on the choice: a piece that is not among them is encoded where it is met. The sample's texts are
    counted in a few tasks, each of which gives its ``entries`` most frequent pieces to the driver.
    """
    chosen = docs.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(rows).agg(F.max("h").alias("h")).first()["h"]
    if chosen is None:
        return b"", b""
    sample = docs.filter(F.xxhash64("doc_id") <= F.lit(chosen)).select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).repartition(PARTS)

    def count(batches):
        words, total = Vocabulary(source), Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in stretches(text.as_py()):
                    total.update({p: n for p, n in words.pieces(part)[0].items() if len(p) <= LONGEST})
                    if len(total) > 16 * entries:
                        total = Counter(dict(total.most_common(4 * entries)))
        top = total.most_common(entries)
        yield pa.record_batch([pa.array([p for p, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    total = Counter()
    for row in sample.mapInArrow(count, "piece binary, n long").collect():
        total[bytes(row["piece"])] += row["n"]
    words = Vocabulary(source)
    top = [p for p, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    return b" ".join(top), np.array([words.of_piece(p) for p in top], np.uint16).tobytes()


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row, by the tokenizer file ``vocabulary``.

    Counts are those of the library's ``encode`` without special tokens at the ends; special strings in a text are one
    token each. A null text is an empty one: 0 bytes, 0 tokens; a null doc_id and repeated rows are rows like others; an
    empty table gives none; other columns are not looked at, whatever their names. Very long texts are gone through in
    stretches of 1 MB that end at white space; bytes that are not UTF-8 count as U+FFFD. The file is read on the driver
    and sent whole (a few MB, its size is fixed); the table of frequent pieces has at most ``entries`` entries of 64 bytes.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    texts = docs.select("doc_id", "text")
    frequent = frequent_pieces(texts, source, sample_rows, entries) if Vocabulary(source).known else (b"", b"")
    shared = docs.sparkSession.sparkContext.broadcast((hash((source, frequent)), source, frequent))

    def count(batches):
        tokens = counter_of(shared)
        for batch in batches:
            n = [tokens.of_text(t.as_py()) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = texts.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
