"""The corpus operators on small inputs: edge cases, brute force, round trips."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from needledrop.llm import op1_mixture, op2_runindex, op3_rules, op4_decontaminate, op5_orderminhash, op6_compression, op7_warc, op8_kdtree, op9_reputation, op10_lines, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, bucket string, payload string, size string, shard string, tokens string, key string"
WORDS = [f"w{i}x" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text) with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", 1, "b", "c", "d", "e", "f", "g", "h") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared = prose(rng, 30)
    out = [(i, "\n".join(prose(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 8)))) for i in range(40)]
    out += [(50 + i, out[i][1]) for i in range(5)]  # exact copies
    out += [(60 + i, out[i][1] + " tail word") for i in range(5)]  # near copies
    out += [(70 + i, prose(rng, 20) + "\n" + shared + "\n" + prose(rng, 20)) for i in range(6)]
    out += [(80, None), (81, ""), (82, " "), (83, "short"), (84, "é" * 200), (85, "aaaa " * 900), (0, out[0][1]), (None, out[1][1]), (None, None)]
    return out


def brute_spans(rows, width):
    key = lambda i: float("inf") if i is None else i
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            least[w] = min(least.get(w, float("inf")), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        cut = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < key(i):
                cut[k : k + width] = True
        edge = np.diff(np.concatenate(([0], cut.astype(int), [0])))
        kept = np.frombuffer(b, np.uint8)[~cut].tobytes()
        out.append((i, len(b), int(cut.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [op2_runindex.HOT, 2])
def test_op2_equals_brute_force(spark, rows, hot):
    got = op2_runindex.drop_repeats(documents(spark, rows), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_spans(rows, 50)


def test_op2_index_finds_the_least_document():
    rng = random.Random(1)
    for _ in range(20):
        fragments = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 40))) for _ in range(30)})
        docs = np.array([rng.randrange(100) for _ in fragments])
        counts, lengths, found = op2_runindex.least_documents(fragments, docs, 8)
        values, at = np.repeat(found, lengths), 0
        for f in fragments:
            for k in range(len(f) - 7):
                assert values[at] == min(d for g, d in zip(fragments, docs, strict=True) if f[k : k + 8] in g)
                at += 1
        assert len(values) == at and counts.sum() == len(lengths)


def test_op2_index_follows_runs():
    """Copies of one text with single changed letters: samples and matches grow with the changes, not with the copies."""
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcdefgh ") for _ in range(2000))
    sizes = {}
    for copies in (10, 100):
        fragments = [text[:at] + b"X%d" % i + text[at:] for i, at in enumerate(rng.sample(range(2000), copies))]
        length = np.array([len(f) + 1 for f in fragments])
        index = op2_runindex.RunIndex(np.frombuffer(bytes([op2_runindex.END]).join([*fragments, b""]), np.uint8), np.cumsum(length) - length, length, 50)
        start, source, size = index.long_matches()
        sizes[copies] = len(index.head), len(start)
        assert size.sum() > 0.9 * (copies - 1) * 1900
    assert sizes[100][0] < 3 * sizes[10][0] and sizes[100][0] < 0.05 * 200_000 and sizes[100][1] < 2000


@pytest.mark.parametrize("hot", [op2_runindex.HOT, 3000])
def test_op2_one_repeated_letter(spark, hot):
    rows = [(i, "a" * (60 + 7 * i) + ("b" if i % 3 else "")) for i in range(60)] + [(100, "a" * 49), (101, "x" + "a" * 49)]
    got = op2_runindex.drop_repeats(documents(spark, rows), hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == brute_spans(rows, 50)


def test_op2_empty(spark):
    assert op2_runindex.drop_repeats(documents(spark, []).limit(0)).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {k for k, n in Counter(triples).items() if n > 1}
    covered = {i + d for i, x in enumerate(triples) if x in twice for d in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_op3_statistics_equal_brute_force(spark, rows):
    extra = [(200, "a b c a b c\na b\n\n a b\n#*$%&|<>"), (201, "\x0b\x0c x\ty z x y z x y z"), (202, "one two")]
    got = op3_rules.text_statistics(documents(spark, rows + extra)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_statistics(t)) for i, t in rows + extra)


def test_op3_learns_symbols_and_survives_missing_labels(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 80) if i % 4 else " ".join(w + "###" for w in prose(rng, 80).split())) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 110)] + [(None, 1, 0), (5000, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = op3_rules.judge_quality(documents(spark, rows), labels)
    assert all(r["kept"] == (r["doc_id"] % 4 > 0) for r in got.collect())
    none = op3_rules.judge_quality(documents(spark, rows), labels.limit(0))
    assert none.filter("kept <> (not base_failed)").count() == 0
    assert op3_rules.judge_quality(documents(spark, []), labels).count() == 0


def test_op4_finds_short_items_in_long_documents(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, n)) for i, n in enumerate((5, 9, 15, 40, 120))] + [(90, "only four words here"), (91, None), (0, "  ")]
    docs = [(i, prose(rng, 3000)) for i in range(8)]
    for k in range(5):
        w = docs[k][1].split()
        docs[k] = (docs[k][0], " ".join(w[:1500] + items[k][1].upper().split() + w[1500:]))
    docs += [(20, None), (21, ""), (22, items[3][1])]
    got = {(r["doc_id"], r["item_id"]) for r in op4_decontaminate.find_leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(k, k) for k in range(5)} | {(22, 3)}
    kept = op4_decontaminate.drop_leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {5, 6, 7, 20, 21} and kept.columns == documents(spark, docs).columns
    assert op4_decontaminate.find_leaks(documents(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_op5_band_equals_full_table():
    rng = random.Random(4)
    for _ in range(1500):
        a = [rng.randrange(4) for _ in range(rng.randrange(25))]
        b = [x for x in a if rng.random() > 0.2] + [rng.randrange(4) for _ in range(rng.randrange(6))]
        most = rng.randrange(26)
        assert op5_orderminhash.banded_distance(a, b, most) == min(edit_distance(a, b), most + 1)


def test_op5_long_lists_in_bounded_memory():
    """A pair of 60 000 words each: masks of all words would take 225 MB."""
    import tracemalloc

    rng = random.Random(14)
    a = [f"c{rng.randrange(40)}" if rng.random() < 0.4 else f"w{rng.randrange(100_000)}" for _ in range(60_000)]
    b = scattered(rng, a, 3000)
    tracemalloc.start()
    assert op5_orderminhash.alike(a, b, 0.8) and not op5_orderminhash.alike(a, b, 0.99)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_op5_sparse_masks_equal_full_table(monkeypatch):
    monkeypatch.setattr(op5_orderminhash, "MASKED", 3)
    rng = random.Random(15)
    for _ in range(300):
        a = [rng.randrange(30) for _ in range(rng.randrange(90))]
        b = [x for x in a if rng.random() > 0.1] + [rng.randrange(9) for _ in range(rng.randrange(6))]
        most = rng.randrange(40)
        assert op5_orderminhash.banded_distance(a, b, most) == min(edit_distance(a, b), most + 1)


def test_op5_repeated_ids_lose_no_text(spark):
    rng = random.Random(16)
    t, u, v = (prose(rng, 60) for _ in range(3))
    near = " ".join(["changed", *v.split()[1:]])
    docs = [(1, t), (1, u), (2, u), (1, t), (5, v), (5, near + " x"), (6, prose(rng, 50)), (6, prose(rng, 50)), (None, t), (None, None)]
    kept = [r["text"] for r in op5_orderminhash.keep_one(documents(spark, docs)).filter("doc_id is not null").collect()]
    assert sorted(kept) == sorted([t, u, docs[6][1], docs[7][1], v if v in kept else near + " x"])
    got = op5_orderminhash.near_duplicates(documents(spark, docs)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in docs) and {r["class_id"] for r in got if r["doc_id"] == 5} == {5}


def test_words_of_a_long_text_in_pieces(monkeypatch):
    rng = random.Random(17)
    texts = [prose(rng, 40).encode(), b"", b"x" * 100, "é".encode() * 60 + b" end", prose(rng, 9).encode(), b"tail"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = tokens.words(data, offsets)
    for piece in (1, 7, 16, 50):
        monkeypatch.setattr(tokens, "PIECE", piece)
        assert all((x == y).all() for x, y in zip(tokens.words(data, offsets), want, strict=True))


def test_op5_classes(spark):
    rng = random.Random(6)
    base = [prose(rng, 120) for _ in range(6)]
    docs = [(i, t) for i, t in enumerate(base)] + [(10 + i, base[0]) for i in range(30)]
    for i in range(12):
        w = base[1].split()
        w[rng.randrange(len(w))] = "changed"
        docs.append((100 + i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, "two words"), (203, "two words"), (None, base[0]), (3, base[3])]
    got = [(r["doc_id"], r["class_id"]) for r in op5_orderminhash.near_duplicates(documents(spark, docs)).collect()]
    want = Counter({(i, i): 1 for i in range(6)}) + Counter((10 + i, 0) for i in range(30)) + Counter((100 + i, 1) for i in range(12))
    want += Counter([(200, 200), (201, 200), (202, 202), (203, 202), (None, None), (3, 3)])
    assert Counter(got) == want
    kept = sorted(r["doc_id"] for r in op5_orderminhash.keep_one(documents(spark, docs)).filter("doc_id is not null").collect())
    assert kept == [0, 1, 2, 3, 4, 5, 200, 202]
    assert op5_orderminhash.near_duplicates(documents(spark, [])).count() == 0


def brute_classes(docs, similarity=0.8, asked=lambda a, b: True):
    """Classes of (doc_id, text) by aligning all asked pairs with the full table."""
    words = {i: [w.lower() for w in re.findall("[A-Za-z0-9]+", t)] for i, t in docs}
    name = {i: i for i in words}
    for a in sorted(words):
        for b in sorted(words):
            if a < b and asked(a, b) and edit_distance(words[a], words[b]) <= int((1 - similarity) * max(len(words[a]), len(words[b])) + 1e-9):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {i: new if c == old else c for i, c in name.items()}
    return name


@pytest.mark.parametrize("hot", [2048, 3])
def test_op5_pairs_beside_a_dissimilar_centre(spark, monkeypatch, hot):
    """Texts that share a template with a smaller id, too far from it, but near to each other."""
    monkeypatch.setattr(op5_orderminhash, "HOT", hot)
    rng = random.Random(12)
    docs = []
    for family in range(8):
        template = prose(rng, 72)
        docs += [(family * 100 + k, template + " " + prose(rng, 28)) for k in range(3)]
        for k in range(4):
            tail = prose(rng, 28).split()
            docs.append((family * 100 + 10 + 2 * k, template + " " + " ".join(tail)))
            docs.append((family * 100 + 11 + 2 * k, template + " " + " ".join(tail[:18]) + " " + prose(rng, 10)))
    rows = documents(spark, docs)
    keys = {r["doc_id"]: set(r["keys"]) for r in op5_orderminhash.sketch(rows, 2).collect()}
    want = brute_classes(docs, asked=lambda a, b: bool(keys[a] & keys[b]))
    got = {r["doc_id"]: r["class_id"] for r in op5_orderminhash.near_duplicates(rows, sketches=2).collect()}
    assert all(got[i] == got[c] for i, c in want.items()) and len(set(want.values())) < len(docs) - 4
    whole = brute_classes(docs)
    assert all(whole[i] == whole[c] for i, c in got.items())


def scattered(rng, words, edits):
    """Words with so many scattered single-word edits: substitutions, deletions and insertions in turn."""
    out = list(words)
    for n, at in enumerate(sorted(rng.sample(range(len(words)), edits), reverse=True)):
        out[at : at + 1] = [["new"], [], ["new", out[at]]][n % 3]
    return out


@pytest.mark.parametrize("n_words, similarity, least", [(10, 0.8, 0.95), (20, 0.8, 0.95), (45, 0.8, 0.95), (200, 0.8, 0.95), (200, 0.85, 0.99), (200, 0.9, 0.99)])
def test_op5_recall_of_scattered_edits(n_words, similarity, least):
    rng = random.Random(13)
    found = asked = 0
    while asked < 300:
        a = prose(rng, n_words).split()
        b = scattered(rng, a, round(n_words * (1 - similarity)))
        if op5_orderminhash.alike(a, b, 0.8):
            asked += 1
            data = [" ".join(w).encode() for w in (a, b)]
            word, text, *_ = tokens.words(np.frombuffer(b"".join(data), np.uint8), np.array([0, len(data[0]), len(data[0]) + len(data[1])]))
            make = getattr(op5_orderminhash, "sketch_keys", op5_orderminhash.order_minhash)
            found += bool(set(make(word, text, 2)[0]) & set(make(word, text, 2)[1]))
    assert found >= least * asked, found / asked


def test_op6_held_out_accuracy_and_edges(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w.upper() + "$$$" for w in prose(rng, 60).split())) for i in range(300)] + [(900, None), (901, ""), (None, "x")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = op6_compression.classify(documents(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert held and sum(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) / len(held) > 0.95
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    one_class = op6_compression.classify(documents(spark, rows), labels.filter("quality = 1")).collect()
    assert len({r["score"] for r in one_class}) == 1
    kept = op6_compression.keep_good(documents(spark, rows), labels)
    assert kept.columns == documents(spark, rows).columns


def test_op6_fits_on_whole_texts(spark):
    """Texts whose classes differ in head and tail only, 4 KB and more from the middle."""
    rng = random.Random(21)
    ends = [" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "bg"]
    rows = [(i, ends[i % 2] + " " + prose(rng, 2500) + " " + ends[i % 2]) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    got = [r for r in op6_compression.classify(documents(spark, rows), labels).collect() if r["held_out"]]
    assert got and sum(r["predicted"] == r["doc_id"] % 2 for r in got) / len(got) > 0.9


def test_op7_round_trip(spark):
    rng = random.Random(9)
    long = "\r\n\r\nWARC/1.1\r\n" + prose(rng, 900) + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "é" * 700
    pages = [(1, "http://a/", "x"), (2, "http://b/\r\nEvil: 1", "x"), (3, None, long), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n"), (7, "u", long), (8, "u", prose(rng, 5) + "\r\n\r\n"), (2, "http://b/", "x")]
    df = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, chunk int, record string")
    got = op7_warc.round_trip(df, min_bytes=0, chunk_bytes=256).collect()
    assert all(r["intact"] for r in got)
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", 0), i)
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        first = last[h or ""]
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert op7_warc.round_trip(df.limit(0)).count() == 0


def test_op8_shards(spark, rows):
    got = op8_kdtree.shard_documents(documents(spark, rows), n_shards=4).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert op8_kdtree.shard_documents(documents(spark, []), n_shards=4).count() == 0


def test_op8_target_bytes_and_odd_leaves(spark, rows):
    got = op8_kdtree.shard_documents(documents(spark, rows), n_shards=None, target_bytes=5000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    assert len(got) == -(-total // 5000)


RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"))


def test_op7_repeated_rows_are_records_of_their_own(spark):
    """Oversized payloads of one id, of an id with two payloads, and of null ids keep their chunks apart."""
    big, odd = "x" * 700, "z" * 600 + "WARC/1.1\r\nabc"
    rows = [(7, "http://a", big), (7, "http://a", big), (7, "u", big + "y"), (None, None, big), (None, "q", big), (None, None, odd), (None, None, odd), (3, "", ""), (2, None, None), (5, "p", "short")]
    got = op7_warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), 0, 256).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(7, 700, sha(big), "response", None)] * 2 + [(7, 701, sha(big + "y"), "response", None)] + [(None, 700, sha(big), "revisit", 7)] * 2
    want += [(None, len(odd), sha(odd), "response", None)] * 2 + [(3, 0, sha(""), "response", None), (2, 0, sha(""), "revisit", 3), (5, 5, sha("short"), "response", None)]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == Counter(want)
    assert all(r["intact"] for r in got)


def test_op8_median_along_whole_strings(spark):
    """Sources that differ after many bytes are split where half of the bytes lie; equal bytes everywhere else."""
    rows = [(i, "t" * 99, "en", f"https://example.org/{'abcd'[i % 4]}", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")
    got = op8_kdtree.shard_documents(docs, n_shards=2).collect()
    assert {(r["source"][-1], r["shard"]) for r in got} == {("a", 0), ("b", 0), ("c", 1), ("d", 1)}
    rng = random.Random(20)
    rows = [(i, "t" * rng.randrange(0, 400), rng.choice(["en", None, "de"]), f"s{rng.randrange(5)}", 1) for i in range(900)]
    rows += [(5, None, None, None, 1), (5, None, None, None, 1), (None, "x", "en", "s1", 1)]
    for n in (3, 16):
        got = op8_kdtree.shard_documents(spark.createDataFrame(rows, docs.schema), n_shards=n).collect()
        weight = Counter()
        for r in got:
            weight[r["shard"]] += r["size"]
        assert len(got) == len(rows) and len(weight) == n and max(weight.values()) - min(weight.values()) <= 4 * 401
        assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got))) for k in weight)


@pytest.mark.parametrize("containment", [0.8, 0.5])
def test_op4_join_equals_one_pass(spark, monkeypatch, containment):
    """A benchmark of any size by the join of signatures: the rows of the pass that has all items at hand."""
    rng = random.Random(31)
    items = [(i, prose(rng, rng.choice((5, 6, 8, 13, 21, 34, 60)))) for i in range(120)] + [(500, "only four words here"), (501, None), (3, "another text of item number three")]
    docs = []
    for i in range(60):
        w = prose(rng, rng.randrange(5, 900)).split()
        for _ in range(rng.randrange(3)):
            own = items[rng.randrange(120)][1].split()
            for k in rng.sample(range(len(own)), len(own) // 12):
                own[k] = "edited"
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((i, " ".join(w)))
    docs += [(100 + i, docs[i % 7][1]) for i in range(30)] + [(0, docs[1][1]), (None, docs[2][1]), (200, None), (201, "")]
    d, b = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want, kept = ([tuple(r) for r in f(d, b, containment).collect()] for f in (op4_decontaminate.find_leaks, op4_decontaminate.drop_leaks))
    monkeypatch.setattr(op4_decontaminate, "FEW_ITEMS", 50)
    joined = op4_decontaminate.find_leaks(d, b, containment)
    assert sorted(map(repr, map(tuple, joined.collect()))) == sorted(map(repr, want)) and len(want) > 20 and joined.columns == ["doc_id", "item_id", "n_shared", "n_shingles"]
    rest = op4_decontaminate.drop_leaks(d, b, containment)
    assert sorted(map(repr, map(tuple, rest.collect()))) == sorted(map(repr, kept)) and rest.columns == d.columns
    monkeypatch.setattr(op4_decontaminate, "MAP_BITS", 8)  # a full map lets all entries through
    assert sorted(map(repr, map(tuple, op4_decontaminate.find_leaks(d, b, containment).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("n_words", [5, 8, 12, 20, 40, 60, 200])
def test_op4_recall_of_candidates(n_words):
    """Items of which at least four fifths of the shingles are in a long text are candidates there."""
    rng = random.Random(n_words)
    items = [(i, prose(rng, n_words)) for i in range(60)]
    index, found = op4_decontaminate.Index(items), 0
    for i, (_, text) in enumerate(items):
        own = text.split()
        for _ in range((n_words - 4) // 5 // 5):  # an edit takes up to five shingles
            own[rng.randrange(len(own))] = "edited"
        w = prose(rng, 3000).split()
        at = rng.randrange(len(w))
        data = np.frombuffer(" ".join([*w[:at], *own, *w[at:]]).encode(), np.uint8)
        word, owner, *_ = tokens.words(data, np.array([0, len(data)], np.int64))
        hashes, text_no, _ = tokens.shingles(word, owner, op4_decontaminate.K)
        found += i in index.candidates(hashes, text_no)[0]
    assert found >= 0.98 * len(items)


def test_op6_accuracy_on_labels_never_learnt(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = op6_compression.classify(docs, labels).filter("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r["score"] for r in got if r["quality"] == 1], [r["score"] for r in got if r["quality"] == 0]
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.85


def test_op3_list_covers_what_thresholds_can_tell(spark):
    """Two planted reasons for low quality, each a threshold on one ratio, and noise."""
    rng = random.Random(21)
    rows = []
    for _ in range(600):
        a, b = rng.random(), rng.random()
        rows.append((a > 0.9 or b < 0.1, a, b, rng.random()))
    labelled = spark.createDataFrame(rows, "bad boolean, a double, b double, noise double")
    rules = op3_rules.learn_list(labelled, ["a", "b", "noise"])
    got = labelled.withColumn("kept", op3_rules.as_expression(rules)).collect()
    wrong = sum(r["kept"] == r["bad"] for r in got)
    # the best single threshold leaves half of the bad rows
    assert wrong <= 0.03 * len(rows) and {c.name for r in rules for c in r} >= {"a", "b"}


def test_op9_rules_and_shrinkage(spark):
    pages = [(1, "http://EXAMPLE.com/en/x"), (2, "http://www.example.com/en/x?q#f"), (3, "http://a.com"), (4, None), (5, "no scheme"), (6, "http://good.net/"), (7, "http://bad.org/x#y"), (8, "http://new.net/q"), (6, "http://good.net/")]
    pages += [(100 + i, f"http://good.net/{i}") for i in range(60)] + [(200 + i, f"http://bad.org/{i}") for i in range(60)]
    outcomes = spark.createDataFrame([(100 + i, True) for i in range(60)] + [(200 + i, False) for i in range(60)] + [(None, True), (9999, False), (101, None)], "page_id long, good boolean")
    got = {r["page_id"]: r for r in op9_reputation.filter_urls(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, host int"), outcomes, RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in (1, 2)] == [("example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/x", "www.example.com/en/", "allow")]
    assert (got[3]["path"], got[3]["rule"]) == ("", None)
    assert (got[4]["host"], got[5]["host"], got[4]["path"]) == ("", "", "")
    assert got[6]["verdict"] == "allow" and got[7]["verdict"] == "block" and got[8]["bound"] > got[7]["bound"]
    assert op9_reputation.filter_urls(spark.createDataFrame([], "page_id long, url string"), outcomes.limit(0), RULES).count() == 0


LINE_WORD = re.compile(r"(?:[a-z0-9]|[^\x00-\x7f])+")


def brute_lines(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    seen, out = [], []
    for i, t in order:
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(LINE_WORD.findall(line.lower()))
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone.append(k)
            if s:
                seen.append(s)
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        out.append((i, (t or "").count("\n") + 1, len(gone), hashlib.sha256(kept.encode()).hexdigest(), tuple(gone)))
    return Counter(out)


@pytest.mark.parametrize("most", [op10_lines.HOT, 5])
def test_op10_equals_brute_force(spark, rows, most):
    rng = random.Random(11)
    variants = []
    base = prose(rng, 25).split()
    for i in range(40):  # a large group of near copies of one line
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        variants.append((300 + i, prose(rng, 6) + "\n" + " ".join(w) + "\n\n...\n" + prose(rng, 4)))
    both = rows + variants
    got = op10_lines.drop_lines(documents(spark, both), most=most).select("doc_id", "n_lines", "n_removed", "kept_sha256", "removed").collect()
    assert Counter((r[0], r[1], r[2], r[3], tuple(r[4])) for r in got) == brute_lines(both)
    assert op10_lines.drop_lines(documents(spark, [])).count() == 0


def test_op10_many_variants_of_a_template(spark):
    """A family of lines that meet at every prefix word, most of them near the bound, against all pairs."""
    rng = random.Random(22)
    base = [f"v{rng.randrange(10**6)}" for _ in range(24)]
    docs = []
    for i in range(1200):
        w = list(base[: rng.choice([9, 16, 24])])
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    want, seen = set(), []
    for i, t in docs:
        words = set(t.split())
        if any(9 * len(words & o) >= 4 * (len(words) + len(o)) for o in seen):
            want.add(i)
        seen.append(words)
    got = op10_lines.drop_lines(documents(spark, docs), most=300, texts=False).collect()
    assert {r["doc_id"] for r in got if r["n_removed"]} == want and 100 < len(want) < 1150


def test_op9_beta_quantile_equals_integration():
    """Small counts, where a normal approximation is wrong: the quantile of a density added up in fine steps."""
    x = (np.arange(400_000) + 0.5) / 400_000
    for a, b in ((0.8, 0.9), (1.5, 0.7), (2, 3), (9.5, 1.2), (40, 38)):
        density = x ** (a - 1) * (1 - x) ** (b - 1)
        want = x[np.searchsorted(np.cumsum(density) / density.sum(), 0.05)]
        assert abs(op9_reputation.beta_quantile(np.array([a]), np.array([b]), 0.05)[0] - want) < 2e-3
    assert op9_reputation.beta_quantile(np.array([0.0, 3.0]), np.array([2.0, 0.0]), 0.05).tolist() == [0.0, 1.0]


def test_op9_suffix_rules(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.shop.city.xx", "city.xx", "x.co.uk", "one", "", "a.b.ck", "b.ck", "ck", "www.ck", "a.www.ck", "deep.a.b.kobe.jp", "p.city.kobe.jp", "x.kobe.jp", "a.b.c.d.example")], "host string")
    rules = ["city.xx", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "d.example", "c.d.example"]
    want = {
        "a.shop.city.xx": ("city.xx", "shop.city.xx"), "city.xx": ("city.xx", "city.xx"), "x.co.uk": ("uk", "co.uk"), "one": ("one", "one"), "": ("", ""), "a.b.ck": ("b.ck", "a.b.ck"), "b.ck": ("b.ck", "b.ck"), "ck": ("ck", "ck"),
        "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "deep.a.b.kobe.jp": ("b.kobe.jp", "a.b.kobe.jp"), "p.city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "x.kobe.jp": ("x.kobe.jp", "x.kobe.jp"), "a.b.c.d.example": ("c.d.example", "b.c.d.example"),
    }
    for given in (rules, spark.createDataFrame([(r,) for r in [*rules, None]], "rule string")):
        assert {r["host"]: (r["suffix"], r["domain"]) for r in op9_reputation.with_suffixes(hosts, given).collect()} == want


def test_op1_null_sources_have_a_domain_of_their_own(spark):
    from needledrop.llm.queries import domain_of_source

    rows = [(i, "a b c d") for i in range(60)]
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    assert {tuple(r) for r in docs.select(F.col("source").isNull(), domain_of_source()).distinct().collect()} >= {(True, "-")}
    assert not docs.filter("source is null").filter(domain_of_source() != "-").count()
    assert op1_mixture.keep_mixture(docs.withColumn("source", F.lit(None).cast("string")), domain_of_source(), {}, 1.0).count() == 60


def test_op1_ranges_of_ranges_cut_at_the_same_row(spark, monkeypatch):
    rng = random.Random(18)
    docs = documents(spark, [(i, prose(rng, rng.randrange(1, 20))) for i in range(500)] + [(3, "x y")])
    whole = op1_mixture.mix(docs, F.lit("d"), {}, fraction=0.37, max_epochs=1).select("doc_id").collect()
    monkeypatch.setattr(op1_mixture, "RANGES", 4)
    monkeypatch.setattr(op1_mixture, "ORDERED", 2)
    assert Counter(op1_mixture.mix(docs, F.lit("d"), {}, fraction=0.37, max_epochs=1).select("doc_id").collect()) == Counter(whole)


def test_op1_budgets_and_epochs(spark):
    rows = [(i, "a b c d e f g h i j") for i in range(90)] + [(200, None), (201, " "), (0, "a b c d e f g h i j")]
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id") < 10, "small").otherwise(F.col("source")))
    got = op1_mixture.mix(docs, F.lit("d"), {"source": {"small": 9.0}}, fraction=1.0, max_epochs=2, seed=1)
    per = {r["source"]: (r["n"], r["t"]) for r in got.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()}
    assert sum(t for _, t in per.values()) <= 910
    small = [r for r in got.filter("source = 'small'").collect()]
    assert Counter(r["doc_id"] for r in small if r["doc_id"] != 0).most_common(1)[0][1] == 2  # the heavy small source runs two epochs
    assert got.filter("doc_id in (200, 201)").count() == 0
    again = op1_mixture.mix(docs, F.lit("d"), {"source": {"small": 9.0}}, fraction=1.0, max_epochs=2, seed=1)
    assert got.exceptAll(again).count() == 0
    assert op1_mixture.mix(documents(spark, []), F.lit("d"), {}).count() == 0


def test_op1_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("x", "en", "a", 10), ("x", "en", "b", 100), ("x", "de", "c", 100), ("y", "en", "d", 1000)], "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in op1_mixture.leaf_budgets(leaves, 160, 1, {}).collect()}
    assert got == {"a": 10, "b": 30, "c": 40, "d": 80}
    got = {r["source"]: r["budget"] for r in op1_mixture.leaf_budgets(leaves, 600, 1, {}).collect()}
    assert got == {"a": 10, "b": 100, "c": 100, "d": 390}


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = op1_mixture.materialise(out)
        assert 0 < docs.count() <= seen, name
        seen = docs.count()
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert final.count() == seen and final.select("shard").distinct().count() == 16


def brute_share(children, given):
    """Budgets of (name, weight, supply) by raising one level until the money is gone."""
    out, rest = {}, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while rest:
        level = max(given, 0.0) / sum(c[1] for c in rest)
        name, weight, supply = rest[0]
        if supply / weight > level:
            return out | {n: min(s, w * level) for n, w, s in rest}
        out[name] = supply
        given -= supply
        rest = rest[1:]
    return out


def brute_mixture(docs, fraction, seed):
    """Ids that one epoch takes, of (doc_id, text, lang, source)."""
    from needledrop.llm.queries import DOMAINS, MIX_WEIGHTS

    leaf = {}
    for i, t, lang, source in docs:
        number = re.search("[0-9]{1,18}$", source or "")
        key = (DOMAINS[int(number[0]) % 3] if number else "-", lang or "-", source or "-")
        leaf.setdefault(key, []).append((i, len(WORD.findall(t or ""))))
    supply = {k: sum(n for _, n in v) for k, v in leaf.items()}
    given = {(): fraction * sum(supply.values())}
    for depth, level in enumerate(("domain", "lang", "source")):
        now = {}
        for parent in given:
            names = sorted({k[depth] for k in supply if k[:depth] == parent})
            children = [(n, MIX_WEIGHTS.get(level, {}).get(n, 1.0), float(sum(s for k, s in supply.items() if k[: depth + 1] == (*parent, n)))) for n in names]
            now |= {(*parent, n): b for n, b in brute_share(children, given[parent]).items()}
        given = now
    taken = set()
    for key, rows in leaf.items():
        budget, epochs, total = min(int(given[key]), supply[key]), 0, 0
        epochs, rest = divmod(budget, supply[key]) if supply[key] else (0, 0)
        for i, n in sorted(rows, key=lambda r: int(hashlib.md5(f"{seed}:{epochs}:{'-' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16)):
            total += n
            if n and (epochs or total <= rest):
                taken.add(i)
    return taken


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All five stages, each against plain Python over what the stage before has left."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from needledrop.llm.queries import MIX_SEED

    rng = random.Random(19)
    good = [prose(rng, rng.randrange(30, 70)) for _ in range(70)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, good[i]) for i in range(6)]
    for i in range(8):  # near copies
        w = good[10 + i].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w)))
    items = [prose(rng, 14) for _ in range(4)]
    rows += [(300 + i, prose(rng, 20) + " " + items[i % 4] + " " + prose(rng, 20)) for i in range(6)]
    rows += [(400 + i, " ".join(w.upper() + "$$$" for w in prose(rng, 50).split())) for i in range(40)] + [(500, None), (501, ""), (502, "tiny")]
    docs = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src30", None]), len(t or "")) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 400)) for i, *_ in docs if i < 500]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate([*items, "too short"])), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = op6_compression.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    tools = op6_compression.compressor(model["good"]), op6_compression.compressor(model["bad"])
    kept = [d for d in docs if 1 / (1 + np.exp(-(model["slope"] * op6_compression.size_difference((d[1] or "").encode(), *tools) + model["intercept"]))) >= 0.5]
    assert len([d for d in kept if 400 <= d[0] < 500]) < 4 and len([d for d in kept if d[0] < 400]) > 80
    classes = brute_classes([(i, t or "") for i, t, *_ in kept])
    kept = [d for d in kept if classes[d[0]] == d[0]]
    assert not any(100 <= d[0] < 300 for d in kept)
    shingle = lambda t: {tuple(w[i : i + 5]) for w in [LINE_WORD.findall((t or "").lower())] for i in range(len(w) - 4)}
    kept = [d for d in kept if not any(shingle(t) and len(shingle(t) & shingle(d[1])) >= 0.8 * len(shingle(t)) for t in items)]
    assert not any(300 <= d[0] < 400 for d in kept)
    taken = brute_mixture([d[:4] for d in kept], 0.9, MIX_SEED)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(taken) and len(taken) > 30
    text = {d[0]: d[1] or "" for d in docs}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and 0 <= r["shard"] < 16 for r in got)
    for shard in range(16):
        mine = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))


def test_pipeline_stages_on_odd_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, found string, id string, code string"
    odd = [(None, None, None, None, None), (1, None, None, None, 0), (2, "", "en", "src1", 0), (3, "x " * 300_000, None, "src2", 1), (3, "x " * 300_000, None, "src2", 1), (4, "one two three four five six seven", "en", None, 1), (None, "one two three four five six seven", "en", "s", 1)]
    odd = [(*r, "a", "b", "c", "d") for r in odd]
    for rows in ([], odd):
        df = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, sf)
            got = out.collect()
            assert len(got) <= len(rows), name
            if name != "sharding":
                assert out.columns == df.columns, name
    near = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, spark.createDataFrame(odd, schema), sf).collect()
    assert Counter(r["doc_id"] for r in near) == Counter({None: 2, 1: 1, 3: 1, 4: 1})  # 2 is empty as 1 is


def test_very_long_texts(spark):
    """Texts and a page of 300 000 words."""
    rng = random.Random(41)
    many = [f"{rng.randrange(20_000)}x" for _ in range(300_000)]
    long = "\n".join(" ".join(many[i : i + 20]) for i in range(0, len(many), 20))
    tail = "\n" + " ".join(f"tail{i}" for i in range(12))
    rows = [(0, long), (1, long + tail), (2, "a short one"), (3, " ".join(many))]
    docs = documents(spark, rows)
    cut = {r["doc_id"]: r for r in op2_runindex.drop_repeats(docs).select("doc_id", "n_bytes", "n_removed").collect()}
    assert cut[0]["n_removed"] == 0 and cut[1]["n_removed"] == len(long) and cut[2]["n_removed"] == 0 and 0 < cut[3]["n_removed"] < cut[3]["n_bytes"]
    counts = {r["doc_id"]: r for r in op3_rules.text_statistics(docs).collect()}
    assert all(tuple(counts[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_statistics(t) for i, t in rows)
    lines = {r["doc_id"]: r["n_removed"] for r in op10_lines.drop_lines(docs, texts=False).select("doc_id", "n_removed").collect()}
    assert lines == {0: 0, 1: 15_000, 2: 0, 3: 0}
    pages = spark.createDataFrame([(1, "http://a/1", long), (2, "http://a/2", long), (3, "http://a/3", tail)], "page_id long, url string, html string")
    back = {r["page_id"]: r for r in op7_warc.round_trip(pages, min_bytes=0, chunk_bytes=1 << 15).collect()}
    digest = base64.b32encode(hashlib.sha1(long.encode()).digest()).decode()
    assert back[1]["payload_digest"] == back[2]["payload_digest"] == digest and (back[1]["refers_to"], back[2]["refers_to"]) == (2, None) and back[1]["payload_bytes"] == len(long)
