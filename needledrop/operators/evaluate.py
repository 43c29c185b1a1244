"""Detections against a reference: verdicts, tallies, paired comparisons, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.functions.rules import camelot_number
from needledrop.functions.text import name_hash

#: Ratios at which a related wrong tempo lands.
RELATED = (0.25, 1 / 3, 0.5, 2 / 3, 0.75, 4 / 3, 1.5, 2.0, 3.0, 4.0)
PHASE_LIMITS = (0.02, 0.05, 0.10, 0.25)


def tempo_verdict(got: Column, reference: Column) -> Column:
    diff, ratio = F.abs(got - reference), got / reference
    related = F.lit(False)
    for r in RELATED:
        related = related | (F.abs(ratio / F.lit(r) - 1.0) <= 0.02)
    return F.when(got.isNull(), "none").when(reference <= 0, "wrong").when(diff <= 0.5, "exact").when(diff <= 2.0, "close").when(related, "octave").otherwise("wrong")


def key_verdict(pc: Column, minor: Column, ref_pc: Column, ref_minor: Column) -> Column:
    n, r = camelot_number(pc, minor), camelot_number(ref_pc, ref_minor)
    step = F.pmod(n - r, F.lit(12))
    return (
        F.when(pc.isNull(), "none").when((pc == ref_pc) & (minor == ref_minor), "exact").when(pc == ref_pc, "parallel")
        .when((n == r) & (minor != ref_minor), "relative").when((minor == ref_minor) & step.isin(1, 11), "fifth").otherwise("wrong")
    )


def phase_error(a: Column, b: Column, bpm: Column) -> Column:
    """Circular distance of two grid phases in beats; 0 where there is no tempo."""
    d = F.pmod((a - b) / (60.0 / bpm), F.lit(1.0))
    return F.when(bpm > 0, F.least(d, 1.0 - d)).otherwise(0.0)


def judged(detections: DataFrame, reference: DataFrame, steady_drift: float = 0.3) -> DataFrame:
    """Detections joined to the reference on the hash of the file name, with tier and all verdicts."""
    d = detections.select(name_hash(F.col("path")).alias("name_hash"), *[c for c in detections.columns])
    r = reference.select(name_hash(F.col("path")).alias("name_hash"), *[F.col(c).alias(f"ref_{c}") for c in ("bpm", "drift", "key_pc", "key_minor", "beat_secs")])
    j = d.join(r, "name_hash")
    return j.withColumns({
        "tier": F.when(F.col("ref_drift") <= steady_drift, "steady").otherwise("drifting"),
        "tempo": tempo_verdict(F.col("bpm"), F.col("ref_bpm")),
        "key": key_verdict(F.col("key_pc"), F.col("key_minor"), F.col("ref_key_pc"), F.col("ref_key_minor")),
        "phase": phase_error(F.col("beat_secs"), F.col("ref_beat_secs"), F.col("ref_bpm")),
    })


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("name_hash", "engine").limit(n)


def _share(c: Column) -> Column:
    return F.round(100.0 * F.try_divide(F.count_if(c), F.count("*")), 4)


def tempo_tally(rows: DataFrame) -> DataFrame:
    """Per tier and engine: verdict counts, shares, mean confidence and times, and octave answers outside 70 to 180."""
    v = {k: F.count_if(F.col("tempo") == k) for k in ("exact", "close", "octave", "wrong", "none")}
    outside = (F.col("tempo") == "octave") & ~F.col("ref_bpm").between(70, 180)
    return rows.groupBy("tier", "engine").agg(F.count("*").alias("tracks"), *[c.alias(k) for k, c in v.items()], _share(F.col("tempo") == "exact").alias("exact_share"), F.avg("confidence").alias("mean_confidence"), F.avg("decode_ms").alias("mean_decode_ms"), F.avg("analyse_ms").alias("mean_analyse_ms"), F.count_if(outside).alias("octave_outside"))


def key_tally(rows: DataFrame) -> DataFrame:
    names = ("exact", "parallel", "relative", "fifth", "wrong", "none")
    return rows.groupBy("tier", "engine").agg(*[F.count_if(F.col("key") == k).alias(f"k_{k}") for k in names], *[_share(F.col("key") == k).alias(f"p_{k}") for k in names])


def phase_report(rows: DataFrame) -> DataFrame:
    """Shares within limits of a beat, and the upper median: the element at place n / 2."""
    e = rows.filter("phase is not null")
    shares = e.groupBy("engine").agg(F.count("*").alias("graded"), *[F.count_if(F.col("phase") <= x).alias(f"within_{round(x * 100)}") for x in PHASE_LIMITS])
    steps = e.groupBy("engine", "phase").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("engine").orderBy("phase")))
    median = steps.join(shares.select("engine", "graded"), "engine").filter(F.col("upto") > F.floor(F.col("graded") / 2)).groupBy("engine").agg(F.min("phase").alias("median"))
    return shares.join(median, "engine")


def right(verdict: Column) -> Column:
    return verdict.isin("exact", "close")


def disagreements(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Tracks that one engine gets right and the other does not."""
    side = rows.groupBy("name_hash", "ref_bpm").agg(F.max(F.when(F.col("engine") == a, right(F.col("tempo")))).alias("right_a"), F.max(F.when(F.col("engine") == b, right(F.col("tempo")))).alias("right_b"))
    return side.filter("right_a <> right_b")


def wrong_keys(rows: DataFrame) -> DataFrame:
    """Outright misses with their distance in semitones."""
    return rows.filter("key = 'wrong'").withColumn("semitones", F.pmod(F.col("key_pc") - F.col("ref_key_pc"), F.lit(12)))


def paired_runs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Tracks that run ``b`` fixed or broke, and the two-sided sign test over them."""
    d = disagreements(rows, a, b).agg(F.count_if("right_b").alias("fixed"), F.count_if("right_a").alias("broke"))
    n, k = F.col("fixed") + F.col("broke"), F.least("fixed", "broke")
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1))),
        F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum")),
        lambda s, i: F.when(i <= k, F.struct((s["term"] + F.log((n - i + 1) / i)).alias("term"), (s["sum"] + F.exp(s["term"] + F.log((n - i + 1) / i))).alias("sum"))).otherwise(s),
    )
    return d.withColumn("net", F.col("fixed") - F.col("broke")).withColumn("p", F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms["sum"])), 6))


def confidence_buckets(rows: DataFrame) -> DataFrame:
    bucket = F.least(F.floor(F.col("confidence") * 10), F.lit(9))
    mixable = F.col("key").isin("exact", "relative", "fifth")
    return rows.groupBy("engine", bucket.alias("bucket")).agg(F.count("*").alias("tracks"), _share(F.col("key") == "exact").alias("exact_share"), _share(mixable).alias("mixable_share"))


def threshold_sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: wrong answers it prevents and right ones it loses; one pass for all of them."""
    cells = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    below = F.col("confidence") < F.col("threshold")
    return rows.filter("tempo <> 'none'").select("tempo", "confidence", cells).groupBy("threshold").agg(F.count_if(below & ~right(F.col("tempo"))).alias("wrong_prevented"), F.count_if(below & right(F.col("tempo"))).alias("right_lost"))


def agreement_matrix(rows: DataFrame) -> DataFrame:
    """Pairs of engines and the reference: share of equal and of mixable keys."""
    own = rows.select("name_hash", "engine", "key_pc", "key_minor").unionByName(rows.select("name_hash", F.lit("reference").alias("engine"), F.col("ref_key_pc").alias("key_pc"), F.col("ref_key_minor").alias("key_minor")).distinct())
    own = own.filter("key_pc is not null")
    x, y = own.alias("x"), own.alias("y")
    j = x.join(y, (F.col("x.name_hash") == F.col("y.name_hash")) & (F.col("x.engine") < F.col("y.engine")))
    v = key_verdict(F.col("x.key_pc"), F.col("x.key_minor"), F.col("y.key_pc"), F.col("y.key_minor"))
    return j.select(F.col("x.engine").alias("left"), F.col("y.engine").alias("right"), v.alias("v")).groupBy("left", "right").agg(F.count("*").alias("tracks"), _share(F.col("v") == "exact").alias("exact_share"), _share(F.col("v").isin("exact", "relative", "fifth")).alias("mixable_share"))
