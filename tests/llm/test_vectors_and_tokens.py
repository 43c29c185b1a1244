"""Hard negatives, token counts and centroids against plain versions."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from needledrop.llm import op11_negatives, op12_tokens, op13_centroids

#: Extra columns whose names clash with those used inside.
VECTORS = "vec_id long, embedding array<float>, label int, block string, payload string, x string, anchor string, n string, cluster string, slot string"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *"abcdefg") for i, v, label in rows], VECTORS).repartition(3)


def odd_vectors(rng, n, dims):
    """Random vectors, copies, ties, and rows that are null, short, empty or not finite."""
    draw = lambda: [float(np.float32(rng.uniform(-1, 1))) for _ in range(dims)]
    rows = [(i, draw(), rng.randrange(4)) for i in range(n)]
    same = draw()
    rows += [(n + i, same, 1) for i in range(n // 3)]  # one vector holds a quarter of all rows
    rows += [(2 * n + i, [0.5] * dims, i % 4) for i in range(10)]
    rows += [(0, *rows[0][1:]), (None, draw(), 2), (None, same, None), (5000, None, 1), (5050, draw()[:-1], 1), (5100, [], 1), (5150, [None, *draw()[1:]], 1), (5200, [float("nan"), *draw()[1:]], 1)]
    rows += [(5250, [float("inf"), *draw()[1:]], 1), (5300, draw(), None)]
    return rows


def test_strassen_is_exact_for_any_sides():
    rng = np.random.default_rng(4)
    for _ in range(100):
        n, k, m = rng.integers(0, 40, 3)
        a, b = rng.integers(-(2**28), 2**28, (n, k)), rng.integers(-(2**28), 2**28, (k, m))
        assert (op11_negatives.strassen(a, b, 2) == a @ b).all()


def brute_negatives(rows, every):
    kept = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64), label) for i, v, label in rows if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    table = np.array([np.pad(v, (0, width - len(v))) for _, v, _ in kept]).reshape(len(kept), width)
    rank = lambda s: sorted(range(len(kept)), key=lambda j: (-s[j], kept[j][0] is None, kept[j][0] or 0))
    out = []
    for a, (i, _, label) in enumerate(kept):
        if i is None or i % every:
            continue
        s = (table @ table[a]).tolist()
        order = rank(s)
        for p in [j for j in order if kept[j][2] == label and j != a][:5]:
            fits = [j for j in order if kept[j][2] != label and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:3]
            out += [(i, kept[p][0], r + 1, kept[j][0], s[p], s[j]) for r, j in enumerate(fits)]
    return sorted(map(repr, out))


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "group": 40, "anchor_group": 5}])
def test_op11_equals_brute_force(spark, sizes):
    rows = odd_vectors(random.Random(3), 120, 9)
    got = op11_negatives.mine_negatives(vectors(spark, rows), F.col("vec_id") % 5 == 0, **sizes).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_negatives(rows, 5) and len(got) > 100


def test_op11_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(op11_negatives, "TILE_ANCHORS", 3)
    monkeypatch.setattr(op11_negatives, "TILE_ROWS", 7)
    rng = np.random.default_rng(1)
    v, label, place = rng.integers(-3, 4, (50, 5)), rng.integers(0, 3, 50), np.arange(50, dtype=np.int32)
    r = op11_negatives.Rows(np.zeros(50, np.int64), place, place.astype(np.int64), np.ones(50, bool), label.astype(np.int64), v.astype(np.int64))
    a, c = r.take(np.arange(0, 50, 4)).in_order(True), r.in_order(True)
    h = op11_negatives.positive_heaps(a, c, 5)
    for i in range(len(a)):
        s = c.vectors @ a.vectors[i]
        want = sorted((-int(s[j]), int(c.ids[j])) for j in range(50) if c.label[j] == a.label[i] and c.ids[j] != a.ids[i])[:5]
        mine = h.heap == i
        assert [(-int(x), int(c.ids[j])) for x, j in zip(h.score[mine], h.row[mine], strict=True)] == want


def test_op11_empty(spark):
    assert op11_negatives.mine_negatives(vectors(spark, [(1, [1.0], 1)]).limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert op11_negatives.mine_negatives(vectors(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.col("vec_id") % 5 == 0).count() == 0


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, np.floor(np.array(v, np.float64) * 1024).astype(np.int64)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"3:{kept[j][0]}".encode()).hexdigest(), kept[j][1].tolist()))
    table, c = np.array([v for _, v in kept]), np.array([kept[j][1] for j in order[:k]])
    to = lambda c: ((table[:, None] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = to(c).argmin(axis=1)
        c = np.array([table[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    d = to(c)
    own, least = d.argmin(axis=1), d.min(axis=1)
    name = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return sorted(repr((i, int(j), int(x), int(least[own == j].sum()), int(least.sum()), name[j])) for (i, _), j, x in zip(kept, own, least, strict=True))


@pytest.mark.parametrize("k, block", [(8, 8192), (5, 17), (1, 40)])
def test_op13_equals_brute_force(spark, k, block):
    rows = odd_vectors(random.Random(8), 150, 6)
    got = op13_centroids.cluster_vectors(vectors(spark, rows), k=k, rounds=6, dims=6, block=block).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == brute_clusters(rows, k, 6, 6)
    assert spark.catalog.listTables() == []


def test_op13_bounds_spare_rescans(spark):
    rng = random.Random(2)
    rows = [(i, [float(i % 4 * 10) + rng.uniform(-1, 1), rng.uniform(-1, 1)], 0) for i in range(400)]
    got = op13_centroids.cluster_vectors(vectors(spark, rows), k=4, rounds=10, dims=2).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == brute_clusters(rows, 4, 10, 2)
    assert got[0]["looked_at"] < 5 * len(rows)  # of 11 scans of all


def test_op13_few_and_no_vectors(spark):
    assert op13_centroids.cluster_vectors(vectors(spark, []).limit(0), dims=3).count() == 0
    got = op13_centroids.cluster_vectors(vectors(spark, [(1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0), (3, [1.0], 0)]), dims=2).collect()
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in got) == [(1, 0, 0), (2, 0, 0)]


ODD = ["a", "B", "J̌", "İ", "Σ", "ΑΣ", "é", "é", "'s", "'T", "'re", "'", "1", "२", "²", "\x1c", "\x85", "\xa0", "　", " ", "\t", "\n", "\x0b", "\x00", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "|>"]
ODD += ["日本", "\U0001f600", "K", "ſ", "ﬁ", "́", "-", "!!", "한", "﻿", "'Ve", "Lorem", "ipsum", "straße"]


def brute_tokens(texts):
    library = Tokenizer.from_file(VOCABULARY)
    return [len(library.encode(t or "", add_special_tokens=False)) for t in texts]


def test_op12_counts_odd_texts(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    counting = op12_tokens.Counting(open(VOCABULARY, encoding="utf-8").read(), (b"a lorem", np.array([1, 2], np.uint16).tobytes()))
    counting.frequent = {p: counting.vocabulary.of_piece(p) for p in counting.frequent}
    monkeypatch.setattr(op12_tokens, "CACHED", 50)  # caches start anew often
    assert [counting.of_text(t.encode()) for t in texts] == brute_tokens(texts)


def test_op12_stretches(monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice(ODD) for _ in range(4000)).encode()
    parts = list(op12_tokens.stretches(text, 50))
    assert b"".join(parts) == text and len(parts) > 20
    counting = op12_tokens.Counting(open(VOCABULARY, encoding="utf-8").read(), (b"", b""))
    assert sum(counting.of_text(p) for p in parts) == counting.of_text(text) == brute_tokens([text.decode()])[0]


@pytest.mark.parametrize("entries", [op12_tokens.ENTRIES, 3, 0])
def test_op12_rows(spark, entries):
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice(["the", "of", "word", "Straße", "x1", "don't", "qzxv"]) for _ in range(rng.randrange(200)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, " \n"), (0, texts[0][1]), (None, "no id"), (None, None), (103, "long word " * 150_000 + "end"), (104, "x" * 100_000), (105, "a " * 2048), (106, "a " * 2049)]
    docs = spark.createDataFrame([(i, t, "n", "p") for i, t in texts], "doc_id long, text string, n_bytes string, piece string").repartition(4)
    got = op12_tokens.count_tokens(docs, VOCABULARY, entries=entries, sample_rows=20).collect()
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(texts, brute_tokens([t for _, t in texts]), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert op12_tokens.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_op12_other_vocabularies(spark):
    """A vocabulary that splits text otherwise is given whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello there, it's 12 o'clock", "", "a<|endoftext|>b  c\n"]
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in op12_tokens.count_tokens(docs, path).collect()}
    assert [got[i] for i in range(3)] == [len(library.encode(t, add_special_tokens=False)) for t in texts]
