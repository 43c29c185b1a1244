"""Features of sampled series: onset envelope, tempo, beat phase, chroma, key, waveform.

A series is rows (series_id, i, v), dense in i from 0. Windows run within a series; only the
autocorrelation gathers one, an envelope of some thousand values, into an array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needledrop.scratch import materialise

#: Ratios of a true tempo to the strongest peak.
OCTAVES = (0.25, 1 / 3, 0.5, 2 / 3, 0.75, 1.0, 4 / 3, 1.5, 2.0, 3.0, 4.0)
#: Pitch-class weights of major and minor keys from the tonic, by profile set.
PROFILES = {
    "krumhansl": ((6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88), (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)),
    "temperley": ((0.748, 0.060, 0.488, 0.082, 0.670, 0.460, 0.096, 0.715, 0.104, 0.366, 0.057, 0.400), (0.712, 0.084, 0.474, 0.618, 0.049, 0.460, 0.105, 0.747, 0.404, 0.067, 0.133, 0.330)),
    "shaath": ((6.6, 2.0, 3.5, 2.3, 4.6, 4.0, 2.5, 5.2, 2.4, 3.7, 2.3, 3.4), (6.5, 2.7, 3.5, 5.4, 2.6, 3.5, 2.5, 5.2, 4.0, 2.7, 4.3, 3.2)),
}
#: Gates and where measures count as strong.
MIN_FLUX_SHARE, MIN_FRAMES, MIN_PERIODS = 0.005, 16, 4
MIN_PEAK, STRONG_PEAK = 0.10, 0.50
MIN_RATIO, STRONG_RATIO = 1.30, 3.00
MIN_PHASE_RATIO, STRONG_PHASE_RATIO = 1.25, 3.0
#: Places by which an onset curve runs ahead of its sound, and the lowest and highest note of a chroma.
ENVELOPE_LAG, NOTES = 5.0, (24.0, 96.0)


@dataclass(frozen=True)
class TempoRange:
    """Search range and the preferred tempo; a range that cannot work, or goes below ``least``, falls back to 60 to 200."""

    low: float = 60.0
    high: float = 200.0
    centre: float = 140.0
    width: float = 0.45
    least: float = 20.0

    def usable(self) -> "TempoRange":
        ok = self.low >= self.least and self.high > self.low * 1.05
        return self if ok else TempoRange(centre=self.centre, width=self.width)


def dense(points: DataFrame) -> DataFrame:
    """Series with every place from the first to the last bucket, zero where there was none."""
    ends = points.groupBy("series_id").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = ends.select("series_id", "lo", F.explode(F.sequence("lo", "hi")).alias("bucket"))
    return grid.join(points, ["series_id", "bucket"], "left").select("series_id", (F.col("bucket") - F.col("lo")).alias("i"), F.coalesce("v", F.lit(0.0)).alias("v"))


def excerpt(series: DataFrame, start: int, length: int, least: int) -> DataFrame:
    """``length`` places from ``start``, or from 0 where fewer than ``least`` would remain."""
    n = F.max("i").over(Window.partitionBy("series_id")) + 1
    begin = F.when(n - start < least, 0).otherwise(start)
    return series.withColumn("begin", begin).filter((F.col("i") >= F.col("begin")) & (F.col("i") < F.col("begin") + length)).select("series_id", (F.col("i") - F.col("begin")).alias("i"), "v")


def frames(series: DataFrame, width: int, hop: int) -> DataFrame:
    """(series_id, frame_id, samples): whole frames of ``width`` places, one each ``hop`` places; frame_id is the place of the first.

    Each place goes to the frames that hold it, so a series of any length is never one row.
    """
    n = series.groupBy("series_id").agg((F.max("i") + 1).alias("n"))
    first = F.greatest(F.floor((F.col("i") - width) / hop) + 1, F.lit(0))
    placed = series.join(n, "series_id").withColumn("frame", F.explode(F.sequence(first, F.floor(F.col("i") / hop)))).withColumn("frame_id", F.col("frame") * hop)
    placed = placed.filter((F.col("i") >= F.col("frame_id")) & (F.col("i") < F.col("frame_id") + width) & (F.col("frame_id") + width <= F.col("n")))
    return placed.groupBy("series_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("samples"))


def chunks(series: DataFrame, size: int) -> DataFrame:
    """Rows (series_id, i, v) as (series_id, chunk_no, samples) of ``size`` places each, the last one of what is left."""
    placed = series.groupBy("series_id", F.floor(F.col("i") / size).alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    return placed.select("series_id", "chunk_no", F.transform("s", lambda x: x["v"]).alias("samples"))


def with_halo(pcm: DataFrame, size: int, reach: int) -> DataFrame:
    """Chunks of ``size`` places with ``halo``, the up to ``reach`` places that follow: only the heads of later chunks move to earlier ones."""
    steps = -(-reach // size)
    k = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("k")
    heads = pcm.select("series_id", "chunk_no", k, "samples").select("series_id", (F.col("chunk_no") - F.col("k")).alias("chunk_no"), "k", F.slice("samples", 1, F.least(F.lit(size), F.lit(reach) - (F.col("k") - 1) * size)).alias("head")).filter("chunk_no >= 0")
    if steps == 1:
        halos = heads.select("series_id", "chunk_no", F.col("head").alias("halo"))
    else:
        halos = heads.groupBy("series_id", "chunk_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "head"))), lambda x: x["head"])).alias("halo"))
    return pcm.join(halos, ["series_id", "chunk_no"], "left").withColumn("halo", F.coalesce("halo", F.array().cast(pcm.schema["samples"].dataType)))


def lengths(pcm: DataFrame) -> DataFrame:
    """(series_id, n) of chunked series; only sizes are summed."""
    return pcm.groupBy("series_id").agg(F.sum(F.size("samples")).alias("n"))


def chunk_frames(pcm: DataFrame, size: int, width: int, hop: int) -> DataFrame:
    """The frames of ``frames``, cut within chunks of ``size`` places and their halo: no place moves but to the chunk before."""
    whole = with_halo(pcm, size, width - 1).withColumn("s", F.concat("samples", "halo"))
    base = F.col("chunk_no") * size
    first = F.pmod(-base, F.lit(hop))  # of the chunk's places, the first that starts a frame
    last = F.least(F.size("samples") - 1, F.size("s") - width)
    starts = F.when(first <= last, F.sequence(first, last, F.lit(hop).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    cut = F.transform(starts, lambda o: F.struct((base + o).alias("frame_id"), F.slice("s", (o + 1).cast("int"), width).alias("samples")))
    return whole.select("series_id", F.inline(cut))


def band_class(bin_: Column, width: int, rate: float) -> Column:
    """The pitch class of a spectrum's bin; null outside the notes of a chroma."""
    note = 69.0 + 12.0 * F.log2(bin_ * F.lit(rate / width / 440.0))
    return F.when((bin_ > 0) & note.between(*NOTES), F.pmod(F.round(note).cast("int"), F.lit(12)))


def spectrum(frames: DataFrame, width: int) -> DataFrame:
    """Magnitudes of Hann-windowed frames (series_id, frame_id, samples): series_id, frame_id, bin, mag. The only numeric UDF."""
    import numpy as np
    import pandas as pd

    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                mags = np.abs(np.fft.rfft(np.stack(p["samples"].to_numpy()).astype(float) * window, axis=1))
                yield pd.DataFrame({"series_id": np.repeat(p["series_id"].to_numpy(), mags.shape[1]), "frame_id": np.repeat(p["frame_id"].to_numpy(), mags.shape[1]), "bin": np.tile(np.arange(mags.shape[1]), len(p)), "mag": mags.ravel()})

    return frames.filter(F.size("samples") == width).select("series_id", "frame_id", "samples").mapInPandas(run, "series_id string, frame_id bigint, bin int, mag double")


def onset_envelope(series: DataFrame) -> DataFrame:
    """Rises from place to place; series that hardly rise or are too short go."""
    w = Window.partitionBy("series_id").orderBy("i")
    before = F.lag("v").over(w)
    rises = series.withColumn("rise", F.when(before.isNotNull(), F.greatest(F.col("v") - before, F.lit(0.0))))  # the first place has no rise
    totals = rises.groupBy("series_id").agg(F.sum(F.abs("v")).alias("total"))
    return gated_rises(rises.filter("rise is not null").select("series_id", (F.col("i") - 1).alias("i"), F.col("rise").alias("v")), totals)


def gated_rises(rises: DataFrame, totals: DataFrame) -> DataFrame:
    """Rises (series_id, i, v) of series that rise by enough of their total and are long enough."""
    enough = rises.groupBy("series_id").agg(F.sum("v").alias("rise"), F.count("*").alias("n")).join(totals, "series_id").filter((F.col("n") >= MIN_FRAMES) & (F.col("rise") >= MIN_FLUX_SHARE * F.col("total")))
    return rises.join(enough.select("series_id"), "series_id", "left_semi")


def subtract_moving_mean(series: DataFrame, half: int) -> DataFrame:
    """What stands above the mean of the ``half`` places on either side."""
    w = Window.partitionBy("series_id").orderBy("i").rowsBetween(-half, half)
    return series.withColumn("v", F.greatest(F.col("v") - F.avg("v").over(w), F.lit(0.0)))


def autocorrelation(series: DataFrame, max_lag: int) -> DataFrame:
    """(series_id, lag, acf) and n, the series' length: zero mean, variance one, each lag over its own overlap; constant series go."""
    arrays = series.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("a"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.count("*").alias("n"))
    arrays = arrays.filter("variance > 1.2e-7").withColumn("c", F.transform("a", lambda x: x - F.col("mean"))).drop("a")
    lags = arrays.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("m", (F.col("n") - F.col("lag")).cast("int"))
    products = F.zip_with(F.slice("c", 1, F.greatest("m", F.lit(0))), F.slice("c", F.col("lag") + 1, F.greatest("m", F.lit(0))), lambda x, y: x * y)
    acf = F.aggregate(products, F.lit(0.0), lambda s, x: s + x) / F.col("m") / F.col("variance")
    return lags.select("series_id", "lag", F.when(F.col("m") > 0, acf).otherwise(0.0).alias("acf"), "n")


def pick_peak(acf: DataFrame, min_lag: int, max_lag: int) -> DataFrame:
    """The first highest lag in range with its value, the range's mean, and whether it is convincing; series of under ``MIN_PERIODS`` of the longest lag go."""
    r = acf.filter(F.col("n") >= MIN_PERIODS * max_lag).filter(F.col("lag").between(min_lag, max_lag)).groupBy("series_id").agg(F.max(F.struct("acf", (-F.col("lag")).alias("minus"))).alias("best"), F.avg("acf").alias("mean"))
    peak = F.col("best.acf")
    return r.select("series_id", (-F.col("best.minus")).alias("lag"), peak.alias("peak"), "mean", ((peak >= MIN_PEAK) & (peak >= F.col("mean") * MIN_RATIO)).alias("accepted"))


def refine_peak(acf: DataFrame, peaks: DataFrame) -> DataFrame:
    """Add ``refined``, the lag moved by a parabola through its neighbours, by half a lag at most."""
    w = Window.partitionBy("series_id").orderBy("lag")
    around = acf.withColumns({"y0": F.lag("acf").over(w), "y2": F.lead("acf").over(w)})
    bend = F.col("y0") - 2 * F.col("acf") + F.col("y2")
    delta = F.when(F.abs(bend) >= 1.2e-7, 0.5 * (F.col("y0") - F.col("y2")) / bend)
    return peaks.join(around.select("series_id", "lag", delta.alias("delta")), ["series_id", "lag"]).withColumn("refined", F.col("lag") + F.when(F.abs("delta") <= 0.5, F.col("delta")).otherwise(0.0)).drop("delta")


def fold_octave(peaks: DataFrame, acf: DataFrame, rate: float, tempo: TempoRange) -> DataFrame:
    """(series_id, bpm): of the related tempos in range, that of the best correlation times preference; the first among equals."""
    tempo = tempo.usable()
    ratios = F.explode(F.array(*[F.struct(F.lit(i).alias("order"), F.lit(r).alias("ratio")) for i, r in enumerate(OCTAVES)])).alias("o")
    c = peaks.select("series_id", (60.0 * rate / F.col("refined")).alias("base"), ratios).select("series_id", "base", "o.order", (F.col("base") * F.col("o.ratio")).alias("bpm"))
    c = c.filter(F.col("bpm").between(tempo.low, tempo.high)).withColumn("lag", F.round(rate * 60.0 / F.col("bpm")).cast("int"))
    octaves = F.log2(F.col("bpm") / tempo.centre) / tempo.width
    scored = c.join(acf, ["series_id", "lag"], "left").withColumn("score", F.greatest(F.coalesce("acf", F.lit(0.0)), F.lit(0.0)) * F.exp(-0.5 * octaves * octaves))
    return scored.groupBy("series_id").agg(F.max(F.struct("score", (-F.col("order")).alias("minus"), "bpm")).alias("best")).select("series_id", "best.bpm")


def _span(value: Column, gate: float, strong: float) -> Column:
    return F.least(F.greatest((value - gate) / (strong - gate), F.lit(0.0)), F.lit(1.0))


def tempo_confidence(peak: Column, mean: Column) -> Column:
    ratio = F.when(mean > 0, peak / mean).otherwise(STRONG_RATIO)
    return F.sqrt(_span(peak, MIN_PEAK, STRONG_PEAK) * _span(ratio, MIN_RATIO, STRONG_RATIO))


def beat_phase(envelope: DataFrame, periods: DataFrame, min_beats: int = 8, lag: float = ENVELOPE_LAG) -> DataFrame:
    """(series_id, phase, sum, ratio, accepted, offset, confidence): a comb of ``period`` places laid at each phase; the first best phase.

    ``offset`` is the phase of the sound, ``lag`` places after that of the curve, within the first period.
    """
    n = envelope.groupBy("series_id").agg(F.count("*").alias("n"))
    p = periods.filter("period >= 2").join(n, "series_id").withColumn("beats", F.floor(F.col("n") / F.col("period")).cast("int")).filter(F.col("beats") >= min_beats)
    grid = p.withColumn("phase", F.explode(F.sequence(F.lit(0), F.greatest(F.round("period").cast("int"), F.lit(2)) - 1))).withColumn("beat", F.explode(F.sequence(F.lit(0), F.col("beats") - 1)))
    at = grid.select("series_id", "phase", F.round(F.col("phase") + F.col("period") * F.col("beat")).cast("int").alias("i"))
    sums = at.join(envelope, ["series_id", "i"]).groupBy("series_id", "phase").agg(F.sum("v").alias("s"))
    period = p.select("series_id", "period").distinct()
    best = sums.groupBy("series_id").agg(F.max(F.struct("s", (-F.col("phase")).alias("minus"))).alias("best"), F.avg("s").alias("mean"))
    ratio = F.try_divide("best.s", "mean")
    return best.join(period, "series_id").select(
        "series_id", (-F.col("best.minus")).alias("phase"), F.col("best.s").alias("sum"), ratio.alias("ratio"), F.coalesce(ratio >= MIN_PHASE_RATIO, F.lit(False)).alias("accepted"),
        F.pmod(lag - F.col("best.minus"), F.col("period")).alias("offset"), _span(ratio, MIN_PHASE_RATIO, STRONG_PHASE_RATIO).alias("confidence"),
    )


def chroma(spectra: DataFrame, pitch_class: Column, min_variation: float = 0.10) -> DataFrame:
    """(series_id, pc, weight) of frames (series_id, frame_id, bin, mag): class means, frames scaled to their largest, summed, scaled again; flat series go."""
    return class_weights(spectra.withColumn("pc", pitch_class).filter("pc is not null").groupBy("series_id", "frame_id", "pc").agg(F.avg("mag").alias("m")), min_variation)


def class_weights(classes: DataFrame, min_variation: float = 0.10) -> DataFrame:
    """(series_id, pc, weight) of the class means m of frames."""
    top = F.max("m").over(Window.partitionBy("series_id", "frame_id"))
    summed = classes.withColumn("m", F.when(top > 0, F.col("m") / top).otherwise(0.0)).groupBy("series_id", "pc").agg(F.sum("m").alias("s"))
    whole = Window.partitionBy("series_id")
    scaled = summed.withColumns({"weight": F.col("s") / F.max("s").over(whole), "variation": F.stddev_pop("s").over(whole) / F.avg("s").over(whole)})
    return scaled.filter(F.col("variation") >= min_variation).select("series_id", "pc", "weight")


def match_key(weights: DataFrame, profile: str = "shaath", min_correlation: float = 0.30) -> DataFrame:
    """(series_id, pc, minor, correlation, confidence) of the best of 24 keys; the first among equals."""
    cells = [F.struct(F.lit(i).alias("i"), F.lit(w).alias("major"), F.lit(m).alias("minor")) for i, (w, m) in enumerate(zip(*PROFILES[profile], strict=True))]
    rotated = weights.withColumn("tonic", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("i", F.pmod(F.col("pc") - F.col("tonic"), F.lit(12)))
    both = rotated.withColumn("p", F.element_at(F.array(*cells), F.col("i") + 1))
    scored = both.groupBy("series_id", "tonic").agg(F.corr("weight", "p.major").alias("major"), F.corr("weight", "p.minor").alias("minor"))
    keys = scored.select("series_id", F.inline(F.array(F.struct(F.col("tonic").alias("pc"), F.lit(False).alias("minor"), F.col("major").alias("c")), F.struct(F.col("tonic").alias("pc"), F.lit(True).alias("minor"), F.col("minor").alias("c")))))
    ranked = keys.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("c", (-F.col("pc") * 2 - F.col("minor").cast("int")).alias("order"), "pc", "minor")), asc=False).alias("k"))
    best, second = F.get("k", F.lit(0)), F.get("k", F.lit(1))
    out = ranked.select("series_id", best["pc"].alias("pc"), best["minor"].alias("minor"), best["c"].alias("correlation"), second["c"].alias("second"))
    confidence = F.least(F.greatest((F.col("correlation") - F.col("second")) / F.abs("correlation"), F.lit(0.0)), F.lit(1.0))
    return out.filter(F.col("correlation") >= min_correlation).select("series_id", "pc", "minor", "correlation", confidence.alias("confidence"))


def waveform(series: DataFrame, bins: int) -> DataFrame:
    """(series_id, bin, peak, rms): proportional bins, both scaled by the loudest peak."""
    n = series.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("bins", F.least(F.col("n"), F.lit(bins)))
    j = series.join(n, "series_id")
    # the bin whose start, floor(n * bin / bins), is the last at or before i
    low = F.floor(((F.col("i") + 1) * F.col("bins") - 1) / F.col("n"))
    r = j.withColumn("bin", low.cast("int")).groupBy("series_id", "bin").agg(F.max(F.abs("v")).alias("peak"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    top = F.max("peak").over(Window.partitionBy("series_id"))
    scale = lambda c: F.when(top > 0, F.least(c / top, F.lit(1.0))).otherwise(c)
    return r.select("series_id", "bin", scale(F.col("peak")).alias("peak"), scale(F.col("rms")).alias("rms"))


def feature_parts(pcm: DataFrame, wanted: DataFrame, size: int, cut: tuple[int, int, int], rate: float, width: int, bins: int) -> DataFrame:
    """(series_id, begin, kind, key, value) of all that features are made of, in one pass over the chunks.

    ``cut`` is the excerpt's start, length and least rest, as in ``excerpt``. Kinds: ``rise`` by place of the excerpt, ``total`` of its
    absolute values, ``note``, class means of its frames by frame * 12 + class, and ``peak`` by bin of the whole series.
    """
    import numpy as np
    import pandas as pd

    start, length, least = cut
    n = lengths(pcm).select("series_id", "n", F.when(F.col("n") - start < least, 0).otherwise(start).alias("begin"))
    rows = with_halo(pcm.join(wanted, "series_id"), size, width).join(n, "series_id")
    window, bin_no = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width), np.arange(width // 2 + 1)
    note = 69.0 + 12.0 * np.log2(np.maximum(bin_no, 1) * (rate / width / 440.0))
    class_of = np.where((bin_no > 0) & (note >= NOTES[0]) & (note <= NOTES[1]), np.floor(np.abs(note) + 0.5).astype(int) % 12, -1)
    hop, classes = width // 2, [c for c in range(12) if (class_of == c).any()]

    def parts(r):
        own, base, begin, stop = np.asarray(r.samples, float), r.chunk_no * size, r.begin, min(r.begin + length, r.n)
        s = np.concatenate((own, np.asarray(r.halo, float)))
        if r.wants_tempo or r.wants_grid:
            at = np.arange(max(begin - base, 0), min(len(own), stop - 1 - base))
            yield "rise", base + at - begin, np.maximum(s[at + 1] - s[at], 0.0)
            yield "total", np.zeros(1, int), np.abs(own[max(begin - base, 0) : max(stop - base, 0)]).sum(keepdims=True)
        if r.wants_key and classes:
            first = begin if begin >= base else base + (begin - base) % hop
            at = np.arange(first, min(base + len(own), stop - width + 1), hop)
            if len(at):
                mags = np.abs(np.fft.rfft(np.stack([s[a - base : a - base + width] for a in at]) * window, axis=1))
                for c in classes:
                    yield "note", (at - begin) * 12 + c, mags[:, class_of == c].mean(axis=1)
        if r.wants_waveform and len(own):
            k = min(r.n, bins)
            bin_ = ((base + np.arange(len(own)) + 1) * k - 1) // r.n
            edge = np.flatnonzero(np.diff(bin_, prepend=-1))
            yield "peak", bin_[edge], np.maximum.reduceat(np.abs(own), edge)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                for kind, key, value in parts(r):
                    yield pd.DataFrame({"series_id": r.series_id, "begin": r.begin, "kind": kind, "key": key, "value": value})

    return rows.mapInPandas(run, "series_id string, begin bigint, kind string, key bigint, value double")


def features(pcm: DataFrame, wanted: DataFrame, rate: float, tempo: TempoRange, half: int, min_lag: int, max_lag: int, size: int, cut: tuple[int, int, int], key_rate: float, width: int = 64, bins: int = 50, profile: str = "shaath") -> DataFrame:
    """One row per wanted series: bpm, confidence and offset, key_pc and key_minor, and the waveform's peaks; what is not wanted is null.

    ``pcm`` has chunks of ``size`` places, ``wanted`` series_id and wants_tempo, wants_grid, wants_key and wants_waveform. The
    chunks are read once; what comes of them is one table, of which each feature reads its kind. Tempo, grid and key are
    of the excerpt ``cut``; ``offset``, the first beat, is a place of the whole series. A grid needs a tempo.
    """
    parts = materialise(feature_parts(pcm, wanted, size, cut, key_rate, width, bins), "kind")

    def of(flag: str) -> DataFrame:
        return wanted.filter(flag).select("series_id")

    rises = gated_rises(parts.filter("kind = 'rise'").select("series_id", F.col("key").alias("i"), F.col("value").alias("v")), parts.filter("kind = 'total'").groupBy("series_id").agg(F.sum("value").alias("total")))
    envelope = materialise(subtract_moving_mean(rises, half))
    acf = materialise(autocorrelation(envelope, max_lag + 1))
    peaks = refine_peak(acf, pick_peak(acf, min_lag, max_lag).filter("accepted"))
    bpm = materialise(fold_octave(peaks, acf, rate, tempo).join(peaks.select("series_id", tempo_confidence(F.col("peak"), F.col("mean")).alias("confidence")), "series_id"))
    grid = beat_phase(envelope, bpm.join(of("wants_grid"), "series_id", "left_semi").select("series_id", (rate * 60.0 / F.col("bpm")).alias("period"))).filter("accepted")
    begins = parts.filter("kind = 'total'").groupBy("series_id").agg(F.max("begin").alias("begin"))
    grid = grid.join(begins, "series_id").select("series_id", (F.col("offset") + F.col("begin")).alias("offset"))
    notes = parts.filter("kind = 'note'").select("series_id", F.floor(F.col("key") / 12).alias("frame_id"), (F.col("key") % 12).cast("int").alias("pc"), F.col("value").alias("m"))
    keys = match_key(class_weights(notes), profile)
    peak = parts.filter("kind = 'peak'").groupBy("series_id", F.col("key").alias("bin")).agg(F.max("value").alias("peak"))
    wave = peak.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "peak"))), lambda x: x["peak"]).alias("p")).withColumn("top", F.array_max("p"))
    wave = wave.select("series_id", F.transform("p", lambda x: F.when(F.col("top") > 0, F.least(x / F.col("top"), F.lit(1.0))).otherwise(x)).alias("peaks"))
    out = wanted.select("series_id").join(bpm.join(of("wants_tempo"), "series_id", "left_semi"), "series_id", "left").join(grid, "series_id", "left")
    return out.join(keys.select("series_id", F.col("pc").alias("key_pc"), F.col("minor").alias("key_minor")), "series_id", "left").join(wave, "series_id", "left")
