"""A quality classifier that compresses.

Two zstandard dictionaries are built from good and from bad labelled text. A text is
compressed in blocks with either; the difference of the sizes over the text's bytes tells
which side it resembles, and a logistic curve fitted on other labelled rows turns that into
a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are compressed in blocks, so that the dictionaries count all along a long text.
BLOCK = 1024
LEVEL = 3


def held_out(doc_id) -> F.Column:
    """Rows whose labels teach nothing: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def size_difference(text: bytes, good, bad) -> float:
    """(size with the bad dictionary - size with the good one) / bytes; 0 for an empty text."""
    if not text:
        return 0.0
    gap = 0
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        gap += len(bad.compress(block)) - len(good.compress(block))
    return gap / len(text)


def compressor(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the joined texts themselves where there are too few to train on."""
    import zstandard

    samples = [t[at : at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-size:] or b" " * 8


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit by Newton steps, with a little ridge."""
    scale = float(np.abs(x).mean()) or 1.0
    a = np.column_stack([x / scale, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = 3000, sample_blocks: int = 8192, dictionary_bytes: int = 65536) -> dict:
    """Fit on at most ``rows_per_class`` whole rows a class, the smallest by a hash of their id.

    Two thirds of the rows build the dictionaries: each gives one block, and all of them about ``sample_blocks`` further
    ones a class, in proportion to their lengths, by hash all along the texts. One third fits the curve, weighted to the classes' true shares. Its differences come
    from executors; the driver gets the sampled blocks and a few numbers a row.
    """
    known = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    shares = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = None
    for quality in (0, 1):
        some = known.filter(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class)
        picked = some if picked is None else picked.unionByName(some)
    text = F.col("text").cast("binary")
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id").withColumns({"part": F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)), "blocks": F.ceil(F.octet_length("text") / BLOCK)}).filter("blocks > 0")
    facts = rows.groupBy("quality", (F.col("part") == 0).alias("curve")).agg(F.sum("blocks").alias("blocks")).collect()
    if {r["quality"] for r in facts} != {0, 1}:
        share = shares.get(1, 0) / sum(shares.values()) if shares else 1.0
        return {"good": b" " * 8, "bad": b" " * 8, "slope": 0.0, "intercept": 4.0 * (share - 0.5)}
    total = {q: sum(r["blocks"] for r in facts if r["quality"] == q and not r["curve"]) for q in (0, 1)}
    keep = {q: int(2**30 * min(1.0, sample_blocks / max(1, total[q]))) for q in (0, 1)}
    places = rows.filter("part <> 0").withColumn("at", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    own = F.col("at") == F.pmod(F.xxhash64("doc_id", F.lit("own")), F.col("blocks"))  # each row has one block at least
    places = places.filter(own | (F.pmod(F.xxhash64("doc_id", "at"), F.lit(2**30)) < F.when(F.col("quality") == 1, keep[1]).otherwise(keep[0])))
    samples = places.select("quality", "doc_id", "at", F.substring("text", F.col("at") * BLOCK + 1, F.lit(BLOCK)).alias("block")).collect()
    samples = sorted((r["quality"], r["doc_id"], r["at"], bytes(r["block"])) for r in samples)
    good, bad = (build_dictionary([b for q, _, _, b in samples if q == quality], dictionary_bytes) for quality in (1, 0))
    model = {"good": good, "bad": bad, "slope": 0.0, "intercept": 0.0}
    curve = rows.filter("part = 0") if any(r["curve"] for r in facts) else rows
    fitted = sorted((r["doc_id"], r["difference"], r["quality"]) for r in score(curve, model).join(F.broadcast(picked.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")), "doc_id").select("doc_id", "difference", "quality").collect())
    x = np.array([d for _, d, _ in fitted])
    y = np.array([float(q) for _, _, q in fitted])
    n = {q: max(1, int((y == q).sum())) for q in (0, 1)}
    weight = np.array([shares[int(q)] / sum(shares.values()) / n[int(q)] * len(y) for q in y])
    slope, intercept = fit_curve(x, y, weight)
    return model | {"slope": slope, "intercept": intercept}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, difference and score of every whole text; null counts as empty."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressor(model["good"]), compressor(model["bad"])
        for batch in batches:
            gaps = np.array([size_difference(t.as_buffer().to_pybytes() if t.is_valid else b"", *tools) for t in batch.column(1)], dtype=np.float64)
            scores = 1 / (1 + np.exp(-np.clip(model["slope"] * gaps + model["intercept"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gaps), pa.array(scores)], ["doc_id", "difference", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, difference double, score double")


def classify(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """doc_id, held_out, score, predicted and difference for every row of ``docs``.

    Labels come from rows that are not held out; language, source and id are no inputs. Null and
    empty texts get the curve's value at 0. Repeated rows are scored row by row; with one class or
    no labels the score is constant; a very long text is compressed whole, block by block; further columns are ignored.
    """
    model = fit(docs, labels, **fitting)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")


def keep_good(docs: DataFrame, labels: DataFrame, least_score: float = 0.5, **fitting) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least_score``; no shuffle of texts.

    Null and empty texts have the curve's value at 0. Repeated rows stay or go together; with one class
    or no labels the score is constant; an empty table gives none; further columns stay, whatever their names.
    """
    import pyarrow as pa

    model, at = fit(docs, labels, **fitting), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressor(model["good"]), compressor(model["bad"])
        for batch in batches:
            gaps = np.array([size_difference(t.as_buffer().to_pybytes() if t.is_valid else b"", *tools) for t in batch.column(at)], dtype=np.float64)
            scores = 1 / (1 + np.exp(-np.clip(model["slope"] * gaps + model["intercept"], -30, 30)))
            yield batch.filter(pa.array(scores >= least_score))

    return docs.mapInArrow(run, docs.schema)
