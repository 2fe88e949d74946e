"""Queries over spectra, filters, mel features and angles, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from axisflow.functions import samplers
from axisflow.functions import vectors as V
from axisflow.operators import features, spectral

from .registry import _DOT, _X, _t, _vectors, query

#: Periodic windows of n samples at k, in SQL.
HANN = "(0.5e0 - 0.5e0 * cos(2 * pi() * k / {n}))"
BLACKMAN = "(0.42e0 - 0.5e0 * cos(2 * pi() * k / {n}) + 0.08e0 * cos(4 * pi() * k / {n}))"
HAMMING = "(0.54e0 - 0.46e0 * cos(2 * pi() * k / {n}))"


def _stft_sql(size, shift, length, window, before, frames):
    return _X + f""", t AS (SELECT vec_id, f, b, coalesce(CASE WHEN f * {shift} + k - {before} >= 0 THEN x[f * {shift} + k - {before} + 1] END, 0) * {window.format(n=length)} AS v, 2 * pi() * b * k / {size} AS w
  FROM e, range({frames}) q(f), range({size // 2 + 1}) r(b), range({length}) s(k))
SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(b AS INTEGER) AS bin, round(sum(v * cos(w)), 6) + 0e0 AS re, round(-sum(v * sin(w)), 6) + 0e0 AS im FROM t GROUP BY vec_id, f, b"""


def _bins(df, *columns):
    frames = df.select("vec_id", F.posexplode(F.arrays_zip(*columns)).alias("frame", "f"))
    each = frames.select("vec_id", "frame", F.posexplode(F.arrays_zip(*(F.col(f"f.{c}").alias(c) for c in columns))).alias("bin", "v"))
    return each.select("vec_id", "frame", "bin", *((F.round(F.col(f"v.{c}"), 6) + 0.0).alias(c) for c in columns))


def _values(df, column):
    return df.select("vec_id", F.posexplode(column).alias("at", "value")).withColumn("value", F.round("value", 8) + 0.0)


def _cells(df, column, digits=6):
    return df.select("vec_id", F.posexplode(column).alias("frame", "f")).select("vec_id", "frame", F.posexplode("f").alias("at", "value")).withColumn("value", F.round("value", digits) + 0.0)


@query(_stft_sql(16, 4, 16, BLACKMAN, 12, 19))
def stft_full_fading(spark, d):
    return _bins(spectral.stft(_vectors(spark, d), "x", 16, 4), "re", "im")


@query(_stft_sql(16, 5, 12, HAMMING, 3, 13))
def stft_half_fading_short_window(spark, d):
    return _bins(spectral.stft(_vectors(spark, d), "x", 16, 5, "hamming", 12, "half"), "re", "im")


@query(_X + f""", w AS (SELECT k, {BLACKMAN.format(n=16)} AS w FROM range(16) s(k)),
g AS (SELECT a.k, a.w / sum(b.w * b.w) AS dual FROM w a JOIN w b ON (a.k - b.k) % 4 = 0 GROUP BY a.k, a.w),
s AS (SELECT vec_id, f, b, sum(coalesce(CASE WHEN f * 4 + k >= 12 THEN x[f * 4 + k - 11] END, 0) * w * cos(2 * pi() * b * k / 16)) AS re FROM e, range(19) q(f), range(9) r(b), w GROUP BY vec_id, f, b),
y AS (SELECT vec_id, f * 4 + g.k - 12 AS i, dual / 16 * sum((CASE WHEN b IN (0, 8) THEN 1 ELSE 2 END) * re * (cos(2 * pi() * b * g.k / 16) - sin(2 * pi() * b * g.k / 16))) AS v FROM s, g GROUP BY vec_id, f, g.k, dual)
SELECT vec_id, CAST(i AS INTEGER) AS at, round(sum(v), 6) + 0e0 AS value FROM y WHERE i BETWEEN 0 AND 63 GROUP BY vec_id, i""")
def istft_of_real_parts(spark, d):
    """The real parts taken as imaginary ones, too, so that the result is not the signal."""
    rows = spectral.stft(_vectors(spark, d), "x", 16, 4)
    rows = rows.select("vec_id", spectral.istft(F.col("re"), F.col("re"), 16, 4, num_samples=64).alias("y"))
    return rows.select("vec_id", F.posexplode("y").alias("at", "value")).withColumn("value", F.round("value", 6) + 0.0)


@query(_X + f""", t AS (SELECT vec_id, f, b, x[f * 4 + k + 1] * {HANN.format(n=16)} AS v, 2 * pi() * b * k / 16 AS w FROM e, range(13) q(f), range(9) r(b), range(16) s(k)),
p AS (SELECT vec_id, f, pow(sum(v * cos(w)), 2) + pow(sum(v * sin(w)), 2) AS power FROM t GROUP BY vec_id, f, b)
SELECT vec_id, CAST(f AS INTEGER) AS at, round(sum(power), 6) AS value FROM p GROUP BY vec_id, f""")
def energy_per_frame(spark, d):
    rows = spectral.stft(_vectors(spark, d), "x", 16, 4, "hann", fading=None, pad=False)
    return rows.select("vec_id", F.posexplode(spectral.energy_per_frame(spectral.power(F.col("re"), F.col("im")))).alias("at", "value")).withColumn("value", F.round("value", 6))


@query("""WITH n AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) * 40 AS n FROM lineitem)
SELECT n, CAST(floor((n - 400 + 160 + 159) / 160e0) AS BIGINT) AS frames, CAST(floor((n + 480 - 400 + 160) / 160e0) AS BIGINT) AS cut_full, n * 160 + 400 - 160 - 240 AS samples_half,
greatest((n + 240 - 120) // 160, 0) AS frame, greatest(n * 160 - 240 + 200, 0) AS centre, greatest(n * 160 - 120 + 399, 0) AS last_half FROM n""")
def frame_and_sample_index(spark, d):
    n = _t(spark, d, "lineitem").select((F.col("l_quantity").cast("long") * 40).alias("n")).distinct()
    c = F.col("n")
    return n.select(
        "n", spectral.frames_of_samples(c, 400, 160).alias("frames"), spectral.frames_of_samples(c, 400, 160, False, "full").alias("cut_full"),
        spectral.samples_of_frames(c, 400, 160, "half").alias("samples_half"), spectral.frame_of_sample(c, 400, 160).alias("frame"),
        spectral.sample_of_frame(c, 400, 160).alias("centre"), spectral.sample_of_frame(c, 400, 160, "half", "last").alias("last_half"))


@query("SELECT CAST(k AS INTEGER) AS bin, k * 16000 / 512e0 AS hz, k * 31.25e0 * 512 / 16000 AS back FROM range(257) r(k)")
def bin_frequencies(spark, d):
    rows = spark.range(1).select(F.posexplode(spectral.centre_frequencies(512, 16_000)).alias("bin", "hz"))
    return rows.withColumn("back", features.hz_to_bin(features.bin_to_hz(F.col("bin"), 16_000, 512), 16_000, 512))


def _iir_sql(b, pole):
    terms = " + ".join(f"({v}) * coalesce(CASE WHEN j >= {k} THEN x[j - {k} + 1] END, 0)" for k, v in enumerate(b))
    return _X + f"SELECT vec_id, CAST(i AS INTEGER) AS at, round(sum(pow({pole}, i - j) * ({terms})), 8) + 0e0 AS value FROM e, range(64) r(i), range(64) s(j) WHERE j <= i GROUP BY vec_id, i"


@query(_iir_sql([1], 0.95))
def inverse_preemphasis(spark, d):
    return _values(features.inverse_preemphasis(_vectors(spark, d), "x"), "filtered")


@query(_iir_sql([1, -1], 0.999))
def offset_compensation(spark, d):
    return _values(features.offset_compensation(_vectors(spark, d), "x"), "filtered")


@query(_iir_sql([1, -1.95, 0.95], 0.999))
def preemphasis_with_offset_compensation(spark, d):
    return _values(features.preemphasis_with_offset_compensation(_vectors(spark, d), "x"), "filtered")


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(median(CASE WHEN i + k BETWEEN 0 AND 63 THEN x[i + k + 1] ELSE 0 END), 8) + 0e0 AS value FROM e, range(64) r(i), range(-2, 3) s(k) GROUP BY vec_id, i")
def median_filter(spark, d):
    return _values(_vectors(spark, d).withColumn("m", features.median_filter(F.col("x"), 5)), "m")


_MEL, _HZ = "2595 * log10(1 + ({0}) / 700e0)", "700 * (pow(10, ({0}) / 2595e0) - 1)"


def _bank_sql(rate, size, filters, unit=True):
    top = _MEL.format(f"{rate / 2}")
    weight = "w / (sum(w) OVER (PARTITION BY m) + 1e-18)" if unit else "w"
    return f"""edge AS (SELECT i, {_HZ.format(f'({top}) * i / {filters + 1}')} * {size} / {rate} AS k FROM range({filters + 2}) r(i)),
tri AS (SELECT m.i - 1 AS m, m.k AS mid, least(a.k, m.k - 1) AS lo, greatest(c.k, m.k + 1) AS hi FROM edge m JOIN edge a ON a.i = m.i - 1 JOIN edge c ON c.i = m.i + 1),
raw AS (SELECT m, b, greatest(least((b - lo) / (mid - lo), (b - hi) / (mid - hi)), 0) AS w FROM tri, range({size // 2 + 1}) q(b)),
bank AS (SELECT m, b, {weight} AS w FROM raw)"""


@query("WITH " + _bank_sql(16000, 512, 23) + "\nSELECT CAST(m AS INTEGER) AS filter, CAST(b AS INTEGER) AS bin, round(w, 8) AS weight FROM bank")
def mel_filter_bank(spark, d):
    bank = features.unit_bank(sample_rate=16_000, size=512, filters=23)
    rows = spark.createDataFrame([(r.tolist(),) for r in bank], "row array<double>").coalesce(1).withColumn("filter", F.monotonically_increasing_id().cast("int"))
    return rows.select("filter", F.posexplode("row").alias("bin", "weight")).withColumn("weight", F.round("weight", 8))


_FB = dict(sample_rate=16_000, window_length=16, shift=8, size=16, window_name="hamming")
_FRAMES = f""", y AS (SELECT vec_id, i, sum(pow(0.999, i - j) * (x[j + 1] - 1.97 * coalesce(CASE WHEN j >= 1 THEN x[j] END, 0) + 0.97 * coalesce(CASE WHEN j >= 2 THEN x[j - 1] END, 0))) AS y
  FROM e, range(64) r(i), range(64) s(j) WHERE j <= i GROUP BY vec_id, i),
t AS (SELECT vec_id, f, b, y * {HAMMING.format(n=16)} AS v, 2 * pi() * b * k / 16 AS w FROM range(7) q(f), range(9) r(b), range(16) s(k), y WHERE y.i = f * 8 + k),
p AS (SELECT vec_id, f, b, (pow(sum(v * cos(w)), 2) + pow(sum(v * sin(w)), 2)) / 16 AS power FROM t GROUP BY vec_id, f, b)"""


def _fbank_sql(filters):
    return _X + _FRAMES + ", " + _bank_sql(16000, 16, filters) + """,
m AS (SELECT vec_id, f, m, sum(power * w) AS v FROM p JOIN bank USING (b) GROUP BY vec_id, f, m)"""


@query(_fbank_sql(4) + "\nSELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(m AS INTEGER) AS at, round(v, 6) + 0e0 AS value FROM m")
def fbank(spark, d):
    return _cells(features.fbank(_vectors(spark, d), "x", filters=4, **_FB), "bands")


@query(_fbank_sql(4) + "\nSELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(m AS INTEGER) AS at, round(v - min(v) OVER (PARTITION BY vec_id, m), 6) + 0e0 AS value FROM m")
def fbank_denoised(spark, d):
    return _cells(features.fbank(_vectors(spark, d), "x", filters=4, denoise=True, **_FB), "bands")


@query(_fbank_sql(4) + "\nSELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(m AS INTEGER) AS at, round(ln(v + 1e-18), 5) + 0e0 AS value FROM m")
def logfbank(spark, d):
    return _cells(features.fbank(_vectors(spark, d), "x", filters=4, log=True, **_FB), "bands", 5)


_MFCC = _fbank_sql(6) + """,
c AS (SELECT vec_id, f, n, sum(ln(v + 1e-18) * cos(pi() * n * (2 * m + 1) / 12)) * sqrt((CASE WHEN n = 0 THEN 1e0 ELSE 2e0 END) / 6) * (1 + 11 * sin(pi() * n / 22)) AS v FROM m, range(5) q(n) GROUP BY vec_id, f, n)"""


def _cepstra(spark, d):
    return features.mfcc(_vectors(spark, d), "x", 5, 22, 6, **_FB)


@query(_MFCC + "\nSELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(n AS INTEGER) AS at, round(v, 5) + 0e0 AS value FROM c")
def mfcc(spark, d):
    return _cells(_cepstra(spark, d), "cepstra", 5)


@query(_MFCC + """,
d AS (SELECT a.vec_id, a.f, a.n, sum(k * b.v) / 60 AS v FROM c a, range(-4, 5) q(k), c b WHERE b.vec_id = a.vec_id AND b.f = a.f AND b.n = least(greatest(a.n + k, 0), 4) GROUP BY a.vec_id, a.f, a.n),
a AS (SELECT a.vec_id, a.f, a.n, sum((4 - k) * (4 - l) / 3600e0 * CASE WHEN a.n + 4 - k - l < -9 THEN 0 ELSE b.v END) AS v FROM c a, range(9) q(k), range(9) r(l), c b
  WHERE b.vec_id = a.vec_id AND b.f = a.f AND b.n = least(greatest(a.n + 4 - k - l, 0), 4) GROUP BY a.vec_id, a.f, a.n)
SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(n AS INTEGER) AS at, round(v, 5) + 0e0 AS value FROM c
UNION ALL SELECT vec_id, CAST(f AS INTEGER), CAST(5 + n AS INTEGER), round(v, 5) + 0e0 FROM d
UNION ALL SELECT vec_id, CAST(f AS INTEGER), CAST(10 + n AS INTEGER), round(v, 5) + 0e0 FROM a""")
def mfcc_velocity(spark, d):
    """Coefficients, velocity and acceleration."""
    return _cells(_cepstra(spark, d).withColumn("v", features.velocity_acceleration(F.col("cepstra"))), "v", 5)


@query(_MFCC + f""", u AS (SELECT vec_id, block, n, b, v * {HAMMING.format(n=4)} AS v, 2 * pi() * b * k / 4 AS w FROM range(3) r(block), range(3) q(b), range(4) s(k), c WHERE c.f = block * 2 + k)
SELECT vec_id, CAST(block AS INTEGER) AS block, CAST(b AS INTEGER) AS bin, CAST(n AS INTEGER) AS at, round(sqrt(pow(sum(v * cos(w)), 2) + pow(sum(v * sin(w)), 2)), 5) AS value FROM u GROUP BY vec_id, block, b, n""")
def modulation_spectrum(spark, d):
    rows = _cepstra(spark, d).select("vec_id", F.posexplode(features.modulation(F.col("cepstra"), 4, 2)).alias("block", "v"))
    rows = rows.select("vec_id", "block", F.posexplode("v").alias("bin", "w")).select("vec_id", "block", "bin", F.posexplode("w").alias("at", "value"))
    return rows.withColumn("value", F.round("value", 5))


@query(_MFCC + f""", u AS (SELECT vec_id, block, n, b, v * {HAMMING.format(n=4)} AS v, 2 * pi() * b * k / 4 AS w FROM range(4) r(block), range(3) q(b), range(4) s(k), c WHERE c.f = block + k),
l AS (SELECT vec_id, block, b, n, sqrt(pow(sum(v * cos(w)), 2) + pow(sum(v * sin(w)), 2)) AS v FROM u GROUP BY vec_id, block, b, n)
SELECT vec_id, CAST(g AS INTEGER) AS block, CAST(b AS INTEGER) AS bin, CAST(n AS INTEGER) AS at, round(sum(CASE WHEN l.block BETWEEN 2 * g AND 2 * g + 2 THEN v ELSE 0 END) / 3, 5) AS value FROM l, range(2) z(g) GROUP BY vec_id, g, b, n""")
def modulation_averaged(spark, d):
    """Means of three blocks, every second one."""
    rows = features.modmfcc(_vectors(spark, d), "x", 4, 1, average=3, average_step=2, cepstra=5, filters=6, lifter=22, **_FB)
    rows = rows.select("vec_id", F.posexplode("modulation").alias("block", "v")).select("vec_id", "block", F.posexplode("v").alias("bin", "w")).select("vec_id", "block", "bin", F.posexplode("w").alias("at", "value"))
    return rows.withColumn("value", F.round("value", 5))


@query(_X + """, t AS (SELECT vec_id, f, b, x[f * 4 + k + 1] * """ + HANN.format(n=16) + """ AS v, 2 * pi() * b * k / 16 AS w FROM e, range(13) q(f), range(1, 8) r(b), range(16) s(k)),
a AS (SELECT vec_id, f, b, atan2(-sum(v * sin(w)), sum(v * cos(w))) - 2 * pi() * f * b * 4 / 16 AS a FROM t GROUP BY vec_id, f, b),
p AS (SELECT vec_id, f, b, atan2(sin(a), cos(a)) AS p FROM a),
d AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY vec_id, b ORDER BY f), 0) AS d FROM p),
w AS (SELECT *, atan2(sin(d), cos(d)) AS w FROM d)
SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(b AS INTEGER) AS bin, round(cos(p), 5) + 0e0 AS cosine, round(cos(d), 5) + 0e0 AS change,
round(cos(coalesce(w - lag(w) OVER (PARTITION BY vec_id, b ORDER BY f), 0)), 5) + 0e0 AS change2 FROM w""")
def phase_features(spark, d):
    """Cosines, since angles near pi may round to either side."""
    rows = spectral.stft(_vectors(spark, d), "x", 16, 4, "hann", fading=None, pad=False)
    rows = spectral.phase_features(rows, 16, 4).select("vec_id", F.posexplode(F.arrays_zip("phase", "phase_delta", "phase_delta2")).alias("frame", "f"))
    rows = rows.select("vec_id", "frame", F.posexplode(F.arrays_zip(F.col("f.phase").alias("p"), F.col("f.phase_delta").alias("d"), F.col("f.phase_delta2").alias("e"))).alias("bin", "v")).where("bin BETWEEN 1 AND 7")
    return rows.select("vec_id", "frame", "bin", *((F.round(F.cos(f"v.{c}"), 5) + 0.0).alias(n) for c, n in (("p", "cosine"), ("d", "change"), ("e", "change2"))))


def _loud(spark, d):
    rows = spectral.stft(_vectors(spark, d), "x", 16, 4)
    return rows.select("vec_id", F.zip_with("re", "im", lambda a, b: F.zip_with(a, b, lambda p, q: F.sqrt(p * p + q * q))).alias("loud"))


@query()
def griffin_lim(spark, d):
    """From magnitudes alone."""
    return _values(spectral.griffin_lim(_loud(spark, d), "loud", 16, 4, iterations=20, alpha=0.9), "signal")


@query(_X + f""", w AS (SELECT k, {BLACKMAN.format(n=16)} AS w FROM range(16) s(k)),
g AS (SELECT a.k, a.w / sum(b.w * b.w) AS dual FROM w a JOIN w b ON (a.k - b.k) % 4 = 0 GROUP BY a.k, a.w),
t AS (SELECT vec_id, f, b, coalesce(CASE WHEN f * 4 + k >= 12 THEN x[f * 4 + k - 11] END, 0) * w AS v, 2 * pi() * b * k / 16 AS a FROM e, range(19) q(f), range(9) r(b), w),
s AS (SELECT vec_id, f, b, sqrt(pow(sum(v * cos(a)), 2) + pow(sum(v * sin(a)), 2)) AS loud FROM t GROUP BY vec_id, f, b),
y AS (SELECT vec_id, f * 4 + g.k - 12 AS i, dual / 16 * sum((CASE WHEN b IN (0, 8) THEN 1 ELSE 2 END) * loud * cos(2 * pi() * b * g.k / 16 + CASE WHEN b IN (0, 8) THEN 0 ELSE 0.3 * b + f END)) AS v FROM s, g GROUP BY vec_id, f, g.k, dual)
SELECT vec_id, CAST(i AS INTEGER) AS at, round(sum(v), 6) + 0e0 AS value FROM y WHERE i BETWEEN 0 AND 63 GROUP BY vec_id, i""")
def griffin_lim_step(spark, d):
    """One iteration from phases of 0.3 a bin and 1 a frame."""
    phase = F.transform("loud", lambda f, t: F.transform(f, lambda v, b: F.when((b == 0) | (b == 8), 0.0).otherwise(0.3 * b + t)))
    rows = spectral.griffin_lim(_loud(spark, d).withColumn("angle", phase), "loud", 16, 4, iterations=1, phases="angle")
    return rows.select("vec_id", F.posexplode("signal").alias("at", "value")).withColumn("value", F.round("value", 6) + 0.0)



@query("""WITH f AS (SELECT DISTINCT p_retailprice AS f FROM part)
SELECT f, round(2595 * log10(1 + f / 700e0), 6) AS htk, round(CASE WHEN f < 1000 THEN f * 3 / 200e0 ELSE 15 + ln(f / 1000e0) * 27 / ln(6.4e0) END, 6) AS slaney,
round(least(f * 1.1e0, (f - 0.7e0 * 8000 / 1.1e0) * (8000 - 0.7e0 * 8000) / (8000 - 0.7e0 * 8000 / 1.1e0) + 0.7e0 * 8000), 6) AS faster,
round(greatest(f * 0.9e0, (f - 0.7e0 * 8000) * (8000 - 0.63e0 * 8000) / (8000 - 0.7e0 * 8000) + 0.63e0 * 8000), 6) AS slower, round(f, 6) AS back FROM f""")
def mel_scales_and_warping(spark, d):
    f = F.col("f")
    return _t(spark, d, "part").select(F.col("p_retailprice").alias("f")).distinct().select(
        "f", F.round(features.hz_to_mel(f), 6).alias("htk"), F.round(features.hz_to_mel(f, False), 6).alias("slaney"), F.round(features.warp_hz(f, 1.1, 0.7, 8000.0), 6).alias("faster"),
        F.round(features.warp_hz(f, 0.9, 0.7, 8000.0), 6).alias("slower"), F.round(features.mel_to_hz(features.hz_to_mel(f, False), False), 6).alias("back"))


@query("""WITH f AS (SELECT DISTINCT p_retailprice AS f FROM part), m AS (SELECT f, 2595 * log10(1 + f / 700e0) AS m, 2595 * log10(1 + 8000 / 700e0) AS top FROM f),
w AS (SELECT f, least(m * 1.1e0, (m - 0.7e0 * top / 1.1e0) * (top - 0.7e0 * top) / (top - 0.7e0 * top / 1.1e0) + 0.7e0 * top) AS m FROM m)
SELECT f, round(700 * (pow(10, m / 2595e0) - 1), 5) AS warped FROM w""")
def mel_warping(spark, d):
    return _t(spark, d, "part").select(F.col("p_retailprice").alias("f")).distinct().select("f", F.round(features.warp_mel(F.col("f"), 1.1, 0.7, 8000.0), 5).alias("warped"))


@query("""WITH a AS (SELECT DISTINCT l_quantity AS a, l_discount AS b FROM lineitem)
SELECT a, b, round(cos(a - b), 6) + 0e0 AS difference, round(a - 2 * pi() * round(a / (2 * pi())), 6) + 0e0 AS by_sine, round(a - 2 * pi() * round(a / (2 * pi())), 6) + 0e0 AS by_half,
round(a * 180 / pi(), 6) AS degrees, round(radians(a), 6) AS radians, round(atan2(b + 1, a), 6) AS direction FROM a""")
def angle_math(spark, d):
    a, b = F.col("a"), F.col("b")
    return _t(spark, d, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_discount").alias("b")).distinct().select(
        "a", "b", (F.round(F.cos(V.minus_angle(a, b)), 6) + 0.0).alias("difference"), (F.round(V.wrap_by_sine(a), 6) + 0.0).alias("by_sine"), (F.round(V.wrap_by_half(a), 6) + 0.0).alias("by_half"),
        F.round(V.rad2deg(a), 6).alias("degrees"), F.round(V.deg2rad(a), 6).alias("radians"), F.round(V.direction_to_angle(F.array(a, b + 1)), 6).alias("direction"))


@query(_X + """SELECT vec_id, round(x[3] * cos(x[2]) * cos(x[1]), 6) + 0e0 AS px, round(x[3] * cos(x[2]) * sin(x[1]), 6) + 0e0 AS py, round(x[3] * sin(x[2]), 6) + 0e0 AS pz,
round(x[5] * cos(x[4]) - x[6] * sin(x[4]), 6) + 0e0 AS rx_y, round(x[7] * cos(x[4]) + x[5] * sin(x[4]) * 0 - x[5] * sin(x[4]), 6) + 0e0 AS ry_z, round(x[5] * sin(x[4]) + x[6] * cos(x[4]), 6) + 0e0 AS rz_y FROM e""")
def sphere_and_rotation(spark, d):
    x = lambda i: F.get("x", F.lit(i))
    px, py, pz = V.sph2cart(x(0), x(1), x(2))
    turn = lambda axis, v: V.matrix_times(V.rotation(axis, x(3)), v)
    return _vectors(spark, d).select(
        "vec_id", *((F.round(v, 6) + 0.0).alias(n) for n, v in (
            ("px", px), ("py", py), ("pz", pz), ("rx_y", turn("x", F.array(x(6), x(4), x(5)))[1]), ("ry_z", turn("y", F.array(x(4), x(5), x(6)))[2]), ("rz_y", turn("z", F.array(x(4), x(5), x(6)))[1]))))


@query(_X + f""", h AS (SELECT vec_id, x[1:32] AS a, x[33:64] AS b FROM e), p AS (SELECT p.vec_id, p.a, p.b, q.a AS c, q.b AS d FROM h p JOIN h q ON q.vec_id = p.vec_id + 1),
z AS (SELECT vec_id, {_DOT.format('a', 'c')} + {_DOT.format('b', 'd')} AS re, {_DOT.format('a', 'd')} - {_DOT.format('b', 'c')} AS im, {_DOT.format('a', 'a')} + {_DOT.format('b', 'b')} AS s, {_DOT.format('c', 'c')} + {_DOT.format('d', 'd')} AS t FROM p)
SELECT vec_id, round(re, 6) + 0e0 AS re, round(im, 6) + 0e0 AS im, round(re * re + im * im, 6) AS square, round(sqrt(re * re + im * im) / sqrt(s) / sqrt(t), 6) AS similarity FROM z""")
def complex_vectors(spark, d):
    h = _vectors(spark, d).select("vec_id", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))
    p = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("c"), F.col("b").alias("d")), "vec_id")
    one, two = (F.col("a"), F.col("b")), (F.col("c"), F.col("d"))
    re, im = V.complex_dot(one, two)
    return p.select("vec_id", (F.round(re, 6) + 0.0).alias("re"), (F.round(im, 6) + 0.0).alias("im"), F.round(V.abs_square(re, im), 6).alias("square"), F.round(V.complex_cos_similarity(one, two), 6).alias("similarity"))


@query(_X + """, m AS (SELECT vec_id, x[1] + 2 AS a, x[2] AS b, CASE WHEN vec_id % 5 = 0 THEN 2 * (x[1] + 2) ELSE x[3] END AS c, CASE WHEN vec_id % 5 = 0 THEN 2 * x[2] ELSE x[4] + 2 END AS d, x[5] AS p, x[6] AS q FROM e)
SELECT vec_id, round(CASE WHEN vec_id % 5 = 0 THEN a * (p + 2 * q) / (5 * (a * a + b * b)) ELSE (p * d - b * q) / (a * d - b * c) END, 6) + 0e0 AS x0,
round(CASE WHEN vec_id % 5 = 0 THEN b * (p + 2 * q) / (5 * (a * a + b * b)) ELSE (a * q - c * p) / (a * d - b * c) END, 6) + 0e0 AS x1 FROM m""")
def batched_solve(spark, d):
    x = lambda i: F.get("x", F.lit(i))
    first = F.array(x(0) + 2, x(1))
    second = F.when(F.col("vec_id") % 5 == 0, F.transform(first, lambda v: 2 * v)).otherwise(F.array(x(2), x(3) + 2))
    rows = _vectors(spark, d).select("vec_id", V.solve(F.array(first, second), F.array(x(4), x(5))).alias("s"))
    return rows.select("vec_id", (F.round(F.col("s")[0], 6) + 0.0).alias("x0"), (F.round(F.col("s")[1], 6) + 0.0).alias("x1"))


_U = "((CAST('0x' || substr(sha256('axis:' || p_partkey || ':{0}'), 1, 12) AS BIGINT) + 0.5e0) / pow(2, 48))"
_G = "sqrt(-2 * ln({a})) * cos(2 * pi() * {b})"


@query(f"""WITH u AS (SELECT p_partkey, {_U.format(0)} AS u, {_U.format(1)} AS v FROM part)
SELECT p_partkey, round(2 + 3 * u, 6) AS uniform, round(exp(-1 + 2 * u), 6) AS log_uniform, round(5 + 2 * {_G.format(a='u', b='v')}, 6) AS normal, round(1 - 2 * ln(1 - u * (1 - exp(-3 / 2e0))), 6) AS exponential FROM u""")
def random_samples(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select(
        "p_partkey", F.round(samplers.uniform("axis", k, 2.0, 5.0), 6).alias("uniform"), F.round(samplers.log_uniform("axis", k, -1.0, 1.0), 6).alias("log_uniform"),
        F.round(samplers.normal("axis", k, 5.0, 2.0), 6).alias("normal"), F.round(samplers.truncated_exponential("axis", k, 1.0, 2.0, 3.0), 6).alias("exponential"))


@query("""WITH t AS (SELECT p_partkey, i, 1.5e0 * sqrt(-2 * ln((CAST('0x' || substr(sha256('axis:' || p_partkey || ':' || 2 * i), 1, 12) AS BIGINT) + 0.5e0) / pow(2, 48)))
  * cos(2 * pi() * (CAST('0x' || substr(sha256('axis:' || p_partkey || ':' || (2 * i + 1)), 1, 12) AS BIGINT) + 0.5e0) / pow(2, 48)) AS z FROM part, range(32) r(i)),
f AS (SELECT p_partkey, arg_min(z, i) FILTER (abs(z) <= 2) AS z FROM t GROUP BY p_partkey)
SELECT p_partkey, round(3 + z, 6) AS truncated, round(exp(z), 6) AS log_truncated FROM f""")
def truncated_samples(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", F.round(samplers.truncated_normal("axis", k, 3.0, 1.5, 2.0), 6).alias("truncated"), F.round(samplers.log_truncated_normal("axis", k, 0.0, 1.5, 2.0), 6).alias("log_truncated"))


@query("SELECT r_regionkey, CAST(3 AS INTEGER) AS size, true AS hermitian, true AS positive, true AS shaped FROM region")
def random_hermitian(spark, d):
    k = F.col("r_regionkey")
    re, im = samplers.hermitian("axis", k, 3)
    pre, pim = samplers.positive_definite_hermitian("axis", k, 2)
    rows = _t(spark, d, "region").select("r_regionkey", re.alias("re"), im.alias("im"), pre.alias("pre"), pim.alias("pim"), samplers.vector(lambda key: samplers.uniform("axis", key), k, 4).alias("v"))
    places = F.sequence(F.lit(0), F.lit(2))
    mirrored = F.forall(places, lambda i: F.forall(places, lambda j: (F.get(F.get("re", i), j) == F.get(F.get("re", j), i)) & (F.get(F.get("im", i), j) == -F.get(F.get("im", j), i))))
    cell = lambda c, i, j: F.col(c)[i][j]
    minor = cell("pre", 0, 0) * cell("pre", 1, 1) - V.abs_square(cell("pre", 0, 1), cell("pim", 0, 1))
    return rows.select("r_regionkey", F.size("re").alias("size"), mirrored.alias("hermitian"), ((cell("pre", 0, 0) > 0) & (minor > 0)).alias("positive"), (F.size(F.array_distinct("v")) == 4).alias("shaped"))


