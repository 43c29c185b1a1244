"""Queries of the series features, over hourly event counts and embedding vectors."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from needledrop.operators import signal
from needledrop.plans.registry import Tables, query

#: Hourly counts as a series of one sample a second: lags of 6 to 48 hours, a day preferred.
RATE, HALF, MIN_LAG, MAX_LAG = 1.0, 6, 6, 48
#: Places in a chunk, and the excerpt of features: start, length and the least that may be left.
CHUNK, CUT = 100, (48, 600, 240)
TEMPO = signal.TempoRange(low=1.2, high=12.0, centre=2.5, width=0.45, least=1.0)
_RATIOS = "[0.25::double, 1.0::double / 3, 0.5::double, 2.0::double / 3, 0.75::double, 1.0::double, 4.0::double / 3, 1.5::double, 2.0::double, 3.0::double, 4.0::double]"
VIEWS = {
    "dense": "select g.series_id, g.b - g.lo as i, coalesce(e.v, 0.0)::double as v from (select series_id, lo, unnest(range(lo, hi + 1)) as b from (select series_id, min(bucket) as lo, max(bucket) as hi from event_series group by 1)) g left join event_series e on e.series_id = g.series_id and e.bucket = g.b",
    "flux": "select series_id, i - 1 as i, f as v from (select *, greatest(v - lag(v) over w, 0.0) as f0, case when lag(v) over w is null then null else f0 end as f from dense window w as (partition by series_id order by i)) where f is not null",
    "env": f"select series_id, i, greatest(v - avg(v) over (partition by series_id order by i rows between {HALF} preceding and {HALF} following), 0.0) as v from flux",
    "cen": "select series_id, i, v - avg(v) over (partition by series_id) as c, var_pop(v) over (partition by series_id) as variance, count(*) over (partition by series_id) as n from env",
    "acf": f"select a.series_id, b.i - a.i as lag, sum(a.c * b.c) / (any_value(a.n) - (b.i - a.i)) / any_value(a.variance) as acf from cen a join cen b on a.series_id = b.series_id and b.i between a.i and a.i + {MAX_LAG + 1} group by 1, 2",
    "peaks": f"select series_id, lag, acf as peak, mean, acf >= 0.1 and acf >= mean * 1.3 as accepted from (select *, avg(acf) over (partition by series_id) as mean, row_number() over (partition by series_id order by acf desc, lag) as k from acf where lag between {MIN_LAG} and {MAX_LAG}) where k = 1 and series_id in (select series_id from env group by 1 having count(*) >= 4 * {MAX_LAG})",
    "refined": "select p.*, p.lag + case when abs(b.y0 - 2 * b.acf + b.y2) >= 1.2e-7 and abs(0.5 * (b.y0 - b.y2) / (b.y0 - 2 * b.acf + b.y2)) <= 0.5 then 0.5 * (b.y0 - b.y2) / (b.y0 - 2 * b.acf + b.y2) else 0 end as refined from peaks p join (select *, lag(acf) over w as y0, lead(acf) over w as y2 from acf window w as (partition by series_id order by lag)) b using (series_id, lag)",
    "folded": f"select series_id, bpm from (select c.*, row_number() over (partition by c.series_id order by greatest(coalesce(a.acf, 0), 0) * exp(-0.5 * pow(log2(bpm / 2.5) / 0.45, 2)) desc, ord) as k from (select series_id, ord, 60.0::double / refined * ratio as bpm from refined, (select unnest({_RATIOS}) as ratio, unnest(range(11)) as ord)) c left join acf a on a.series_id = c.series_id and a.lag = round(60.0 / c.bpm)::int where bpm between 1.2 and 12.0) where k = 1",
    "chr": """
select series_id, pc, s / max(s) over w as weight from (select series_id, pc, sum(m) as s, 1 as one from (select series_id, frame_id, pc, m / max(m) over (partition by series_id, frame_id) as m from (
  select label as series_id, vec_id as frame_id, (round(69 + 12 * log2((k - 1) * (4096.0::double / 128 / 440)))::int % 12)::int as pc, avg(abs(embedding[k]::double)) as m from embeddings, (select unnest(range(2, 65)) as k) where 69 + 12 * log2((k - 1) * (4096.0::double / 128 / 440)) between 24 and 96 group by 1, 2, 3)) group by 1, 2)
window w as (partition by series_id) qualify stddev_pop(s) over w / avg(s) over w >= 0.001""",
}

#: The same views over the excerpt, for the one-pass job.
VIEWS["e_dense"] = f"with n as (select *, max(i) over (partition by series_id) + 1 as n from dense), b as (select *, case when n - {CUT[0]} < {CUT[2]} then 0 else {CUT[0]} end as start from n) select series_id, i - start as i, v, start from b where i >= start and i < start + {CUT[1]}"
for _name in ("flux", "env", "cen", "acf", "peaks", "refined", "folded"):
    VIEWS[f"e_{_name}"] = re.sub(r"\b(from|join) (dense|flux|env|cen|acf|peaks|refined)\b", r"\1 e_\2", VIEWS[_name])


def sig(name, sql=None):
    return query(name, sql, VIEWS)


def _series(spark, sf_dir):
    return signal.dense(Tables(spark, sf_dir).event_series)


def _envelope(spark, sf_dir):
    return signal.subtract_moving_mean(signal.onset_envelope(_series(spark, sf_dir)), HALF)


def _acf(spark, sf_dir):
    return signal.autocorrelation(_envelope(spark, sf_dir), MAX_LAG + 1)


@sig("x1_excerpt", "with n as (select *, max(i) over (partition by series_id) + 1 as n from dense) select series_id, (i - case when n - 30 < 700 then 0 else 30 end)::int as i, v from n where i >= case when n - 30 < 700 then 0 else 30 end and i < case when n - 30 < 700 then 0 else 30 end + 120")
def x1(spark, sf_dir):
    return signal.excerpt(_series(spark, sf_dir), 30, 120, 700)


@sig("x2_framed_spectrum", """
with f as (select a.series_id, a.i as frame_id, b.i - a.i as k, b.v * (0.5 - 0.5 * cos(2 * pi() * (b.i - a.i) / 64)) as s from dense a join dense b on a.series_id = b.series_id and b.i >= a.i and b.i < a.i + 64
  join (select series_id, max(i) + 1 as n from dense group by 1) n on n.series_id = a.series_id where a.i % 32 = 0 and a.i + 64 <= n.n)
select series_id, frame_id::bigint as frame_id, b::int as bin, round(sqrt(pow(sum(s * cos(2 * pi() * b * k / 64)), 2) + pow(sum(s * sin(2 * pi() * b * k / 64)), 2)), 4) as mag from f, (select unnest(range(33)) as b) group by 1, 2, 3""")
def x2(spark, sf_dir):
    return signal.spectrum(signal.chunk_frames(signal.chunks(_series(spark, sf_dir), CHUNK), CHUNK, 64, 32), 64).withColumn("mag", F.round("mag", 4))


@sig("x3_onset_envelope", "select series_id, i::int as i, v from flux")
def x3(spark, sf_dir):
    return signal.onset_envelope(_series(spark, sf_dir))


@sig("x4_moving_mean", "select series_id, i::int as i, round(v, 9) as v from env")
def x4(spark, sf_dir):
    return _envelope(spark, sf_dir).withColumn("v", F.round("v", 9))


@sig("x5_autocorrelation", "select series_id, lag::int as lag, round(acf, 6) as acf from acf")
def x5(spark, sf_dir):
    return _acf(spark, sf_dir).select("series_id", "lag", F.round("acf", 6).alias("acf"))


@sig("x6_peak_pick", "select series_id, lag::int as lag, round(peak, 6) as peak, round(mean, 6) as mean, accepted from peaks")
def x6(spark, sf_dir):
    return signal.pick_peak(_acf(spark, sf_dir), MIN_LAG, MAX_LAG).withColumns({"peak": F.round("peak", 6), "mean": F.round("mean", 6)})


@sig("x7_parabolic_refinement", "select series_id, lag::int as lag, round(refined, 5) as refined from refined")
def x7(spark, sf_dir):
    acf = _acf(spark, sf_dir)
    return signal.refine_peak(acf, signal.pick_peak(acf, MIN_LAG, MAX_LAG)).select("series_id", "lag", F.round("refined", 5).alias("refined"))


@sig("x8_octave_folding", "select series_id, round(bpm, 5) as bpm from folded")
def x8(spark, sf_dir):
    acf = _acf(spark, sf_dir)
    return signal.fold_octave(signal.refine_peak(acf, signal.pick_peak(acf, MIN_LAG, MAX_LAG)), acf, RATE, TEMPO).withColumn("bpm", F.round("bpm", 5))


@sig("x9_tempo_confidence", "select series_id, round(sqrt(least(greatest((peak - 0.1) / 0.4, 0), 1) * least(greatest((case when mean > 0 then peak / mean else 3.0 end - 1.3) / 1.7, 0), 1)), 6) as confidence from peaks")
def x9(spark, sf_dir):
    peaks = signal.pick_peak(_acf(spark, sf_dir), MIN_LAG, MAX_LAG)
    return peaks.select("series_id", F.round(signal.tempo_confidence(F.col("peak"), F.col("mean")), 6).alias("confidence"))


_PHASE = """
with n as (select series_id, count(*) as n from env group by 1), s as (select e.series_id, phase, sum(e.v) as s from n, (select unnest(range(24)) as phase), (select unnest(range(0, 200)) as beat), env e where beat < n // 24 and e.series_id = n.series_id and e.i = phase + 24 * beat group by 1, 2),
r as (select *, avg(s) over (partition by series_id) as mean, row_number() over (partition by series_id order by round(s, 9) desc, phase) as k from s)
select series_id, phase::int as phase, round(s, 6) as "sum", round(s / mean, 6) as ratio, s / mean >= 1.25 as accepted, ((phase + 5) % 24)::double as "offset", round(least(greatest((s / mean - 1.25) / 1.75, 0), 1), 6) as confidence from r where k = 1"""


@sig("x10_beat_phase", _PHASE)
def x10(spark, sf_dir):
    envelope = _envelope(spark, sf_dir)
    periods = envelope.select("series_id").distinct().withColumn("period", F.lit(24.0))
    return signal.beat_phase(envelope, periods).withColumns({"sum": F.round("sum", 6), "ratio": F.round("ratio", 6), "confidence": F.round("confidence", 6)})


def _vectors(spark, sf_dir):
    rows = Tables(spark, sf_dir).embeddings.select(F.col("label").alias("series_id"), F.col("vec_id").alias("frame_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("bin", "mag"))
    return signal.chroma(rows.withColumn("mag", F.abs("mag")), signal.band_class(F.col("bin"), 128, 4096.0), min_variation=0.001)


@sig("x12_chroma", "select series_id, pc, round(weight, 6) as weight from chr")
def x12(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumn("weight", F.round("weight", 6))


_MAJOR, _MINOR = ("[" + ", ".join(f"{x}::double" for x in p) + "]" for p in signal.PROFILES["shaath"])


@sig("x13_key_match", f"""
with s as (select series_id, t, corr(weight, ({_MAJOR})[(pc - t + 12) % 12 + 1]) as a, corr(weight, ({_MINOR})[(pc - t + 12) % 12 + 1]) as b from chr, (select unnest(range(12)) as t) group by 1, 2),
k as (select series_id, t::int as pc, false as minor, a as c from s union all select series_id, t::int, true, b from s),
r as (select *, row_number() over (partition by series_id order by c desc, pc, minor) as place, lead(c) over (partition by series_id order by c desc, pc, minor) as second from k)
select series_id, pc, minor, round(c, 6) as correlation, round(least(greatest((c - second) / abs(c), 0), 1), 5) as confidence from r where place = 1 and c >= 0.05""")
def x13(spark, sf_dir):
    return signal.match_key(_vectors(spark, sf_dir), min_correlation=0.05).withColumns({"correlation": F.round("correlation", 6), "confidence": F.round("confidence", 5)})


@sig("x14_waveform", """
with n as (select series_id, count(*) as n from dense group by 1), b as (select series_id, bin, n * bin // 50 as lo, n * (bin + 1) // 50 as hi from n, (select unnest(range(50)) as bin)),
r as (select series_id, bin, max(abs(v)) as peak, sqrt(avg(v * v)) as rms from b join dense using (series_id) where i >= lo and i < hi group by 1, 2)
select series_id, bin::int as bin, round(least(peak / max(peak) over w, 1), 9) as peak, round(least(rms / max(peak) over w, 1), 9) as rms from r window w as (partition by series_id)""")
def x14(spark, sf_dir):
    return signal.waveform(_series(spark, sf_dir), 50).withColumns({"peak": F.round("peak", 9), "rms": F.round("rms", 9)})


@sig("x15_feature_job", rf"""
with w as (select distinct series_id, series_id <> 'click' as wants_tempo, series_id <> 'view' as wants_grid, series_id not in ('view', 'click') as wants_waveform from dense),
n as (select series_id, count(*) as n from dense group by 1), b as (select series_id, bin, n * bin // 50 as lo, n * (bin + 1) // 50 as hi from n, (select unnest(range(50)) as bin)),
r as (select series_id, bin, max(abs(v)) as peak from b join dense using (series_id) where i >= lo and i < hi group by 1, 2), p as (select series_id, bin, round(least(peak / max(peak) over (partition by series_id), 1), 6) as peak from r),
g as (select series_id, list(peak order by bin) as peaks from p group by 1),
f as (select x.series_id, x.bpm, 60.0 / x.bpm as period, round(sqrt(least(greatest((q.peak - 0.1) / 0.4, 0), 1) * least(greatest((case when q.mean > 0 then q.peak / q.mean else 3.0 end - 1.3) / 1.7, 0), 1)), 6) as confidence
  from e_folded x join e_peaks q on q.series_id = x.series_id and q.accepted),
c as (select f.series_id, period, len, phase, beat from (select f.*, (select count(*) from e_env e where e.series_id = f.series_id) as len from f where period >= 2) f, (select unnest(range(60)) as phase), (select unnest(range(400)) as beat) where phase < greatest(round(period), 2) and beat < floor(len / period) and floor(len / period) >= 8),
s as (select c.series_id, phase, any_value(period) as period, sum(e.v) as s from c join e_env e on e.series_id = c.series_id and e.i = round(phase + period * beat)::bigint group by 1, 2),
k as (select *, avg(s) over (partition by series_id) as mean, row_number() over (partition by series_id order by round(s, 9) desc, phase) as k from s),
o as (select series_id, (phase + 5) - floor((phase + 5) / period) * period + (select any_value(start) from e_dense d where d.series_id = k.series_id) as offset_ from k where k = 1 and s / mean >= 1.25),
d as (select a.series_id, a.i as frame_id, bin, sqrt(pow(sum(b.v * (0.5 - 0.5 * cos(2 * pi() * (b.i - a.i) / 64)) * cos(2 * pi() * bin * (b.i - a.i) / 64)), 2) + pow(sum(b.v * (0.5 - 0.5 * cos(2 * pi() * (b.i - a.i) / 64)) * sin(2 * pi() * bin * (b.i - a.i) / 64)), 2)) as mag
  from e_dense a join e_dense b on a.series_id = b.series_id and b.i >= a.i and b.i < a.i + 64 join (select series_id, max(i) + 1 as len from e_dense group by 1) z on z.series_id = a.series_id, (select unnest(range(1, 33)) as bin) where a.i % 32 = 0 and a.i + 64 <= len group by 1, 2, 3),
m as (select series_id, frame_id, (round(69 + 12 * log2(bin * (4096.0::double / 64 / 440)))::int % 12)::int as pc, avg(mag) as m from d where 69 + 12 * log2(bin * (4096.0::double / 64 / 440)) between 24 and 96 group by 1, 2, 3),
h as (select series_id, pc, sum(m) as s from (select series_id, pc, case when max(m) over (partition by series_id, frame_id) > 0 then m / max(m) over (partition by series_id, frame_id) else 0 end as m from m) group by 1, 2),
v as (select series_id, pc, s / max(s) over (partition by series_id) as weight from h qualify stddev_pop(s) over (partition by series_id) / avg(s) over (partition by series_id) >= 0.10),
t as (select series_id, t, corr(weight, ({_MAJOR})[(pc - t + 12) % 12 + 1]) as a, corr(weight, ({_MINOR})[(pc - t + 12) % 12 + 1]) as b from v, (select unnest(range(12)) as t) group by 1, 2),
y as (select * from (select series_id, t::int as pc, false as minor, a as c from t union all select series_id, t::int, true, b from t) qualify row_number() over (partition by series_id order by c desc, pc, minor) = 1)
select w.series_id, case when wants_tempo then round(f.bpm, 5) end as bpm, case when wants_tempo then f.confidence end as confidence, case when wants_grid then round(o.offset_, 4) end as "offset", y.pc as key_pc, y.minor as key_minor, case when wants_waveform then g.peaks end as peaks
from w left join f using (series_id) left join o using (series_id) left join y on y.series_id = w.series_id and y.c >= 0.30 left join g on g.series_id = w.series_id""")
def x15(spark, sf_dir):
    """Tempo, grid on the clock of the whole series, key and waveform from one pass over chunks; clicks have no tempo of their own, views no grid."""
    series = _series(spark, sf_dir)
    name = F.col("series_id")
    wanted = Tables(spark, sf_dir).event_series.select("series_id").distinct().select("series_id", (name != "click").alias("wants_tempo"), (name != "view").alias("wants_grid"), F.lit(True).alias("wants_key"), (~name.isin("view", "click")).alias("wants_waveform"))
    out = signal.features(signal.chunks(series, CHUNK), wanted, RATE, TEMPO, HALF, MIN_LAG, MAX_LAG, CHUNK, CUT, 4096.0)
    return out.select("series_id", F.round("bpm", 5).alias("bpm"), F.round("confidence", 6).alias("confidence"), F.round("offset", 4).alias("offset"), "key_pc", "key_minor", F.transform("peaks", lambda x: F.round(x, 6)).alias("peaks"))
