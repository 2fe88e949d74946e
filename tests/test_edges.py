"""Edges of kernels, features and tables that SQL rows do not reach."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisflow.operators import features, frames, spectral, tables

SIGNAL = "id int, x array<double>"


def test_kernels_of_empty_and_null_arrays(spark):
    rows = spark.createDataFrame([(1, []), (2, None), (3, [2.0])], SIGNAL)
    cases = [(how, *way) for how in ("max", "median") for way in (("edge", "pre"), ("edge", "post"), (None, "pre"))]
    for r in rows.select("id", *(frames.kernel(F.col("x"), 5, *case).alias(f"y{k}") for k, case in enumerate(cases))).collect():
        assert r.id == 3 or {str(v) for v in r[1:]} == {"[]" if r.id == 1 else "None"}
    assert [r["values"] for r in frames.sliding(rows, "x", 5, "max", None).orderBy("id").collect()] == [[], [], []]
    assert [r.y for r in rows.select(frames.context_frames(F.col("x"), 1, 1).alias("y")).collect()] == [[], None, [[2.0, 2.0, 2.0]]]
    assert spark.createDataFrame([(1, [])], "id int, x array<array<double>>").select(features.modulation(F.col("x"))).collect()[0][0] == []


@pytest.mark.parametrize("how", ["max", "min", "mean", "median"])
def test_sliding_against_windows(spark, how):
    rng = np.random.default_rng(7)
    signals = [rng.integers(0, 9, n).astype(float) for n in (1, 2, 7, 50, 51, 120, 120)]
    signals[-1][60] = np.nan
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(signals)], SIGNAL).coalesce(1)
    fold = {"max": np.max, "min": np.min, "mean": np.mean, "median": np.median}[how]
    cases = [(size, *way) for size in (1, 7, 51) for way in (("pre", "edge"), ("post", "edge"), ("pre", None))]
    for k, (size, position, padding) in enumerate(cases):
        rows = frames.sliding(rows, "x", size, how, padding, position, f"y{k}")
    for r in rows.collect():
        for k, (size, position, padding) in enumerate(cases):
            y = np.pad(r.x, size // 2, "edge") if padding and position == "pre" else np.array(r.x)
            want = [fold(y[i : i + size]) for i in range(len(y) - size + 1)]
            want = np.pad(want, size // 2, "edge") if padding and position == "post" and want else want
            assert np.allclose(r[f"y{k}"], want, equal_nan=True), (how, size, position, padding, r.id)


@pytest.mark.parametrize("how", ["max", "median"])
def test_wide_windows_cost_about_what_narrow_ones_do(how):
    x = np.random.default_rng(0).standard_normal((1, 80_000))
    took = {}
    for size in (5, 4001):
        began = time.process_time()
        for _ in range(3):
            frames._medians(x[0], size) if how == "median" else frames._extrema(x, size, np.maximum)
        took[size] = time.process_time() - began
    assert took[4001] < 3 * took[5] + 0.05


def test_preemphasis_default_is_the_usual_one(spark):
    rows = spark.createDataFrame([(1, np.random.default_rng(0).standard_normal(900).tolist())], SIGNAL)
    one, other = (features.fbank(rows, "x", **more).collect()[0]["bands"] for more in ({}, {"p": 0.97}))
    assert one == other


def test_moments_of_null_keys(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 9.0)], "k string, mean double")
    got = sorted((str(r.k), round(r.z, 3)) for r in tables.normalize_mean_variance(rows, ["k"], "mean", "z").collect())
    assert got == [("None", -1.0), ("None", 1.0), ("a", -1.0), ("a", 1.0)]


def test_signal_from_magnitudes(spark):
    """The spectrum of what comes back has nearly the magnitudes that went in, and more iterations come closer."""
    t = np.arange(2000)
    x = np.sin(t * 0.1) + 0.5 * np.sin(t * 0.31 + 1)
    rows = spectral.stft(spark.createDataFrame([(1, x.tolist()), (2, [])], SIGNAL), "x", 64, 16)
    loud = rows.withColumn("loud", F.zip_with("re", "im", lambda a, b: F.zip_with(a, b, lambda p, q: F.sqrt(p * p + q * q))))
    errors = []
    for n, alpha in ((1, 0.0), (30, 0.0), (30, 0.9)):
        made = spectral.griffin_lim(loud.drop("x"), "loud", 64, 16, iterations=n, alpha=alpha).where("id = 1")
        again = spectral.stft(made.select("id", "loud", "signal"), "signal", 64, 16).collect()[0]
        new, old = np.hypot(np.array(again.re), np.array(again.im)), np.array(again.loud)
        m = min(len(new), len(old))
        errors.append(np.linalg.norm(new[:m] - old[:m]) / np.linalg.norm(old))
    assert errors[1] < errors[0] and errors[2] < 0.3


def test_dtw_path_and_cost_by_plain_recursion(spark):
    rng = np.random.default_rng(4)
    pairs = [(rng.integers(0, 5, n).astype(float).tolist(), rng.integers(0, 5, m).astype(float).tolist()) for n, m in ((1, 1), (3, 5), (6, 4), (7, 7))]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id int, a array<double>, b array<double>")
    for penalty in ((0, 0, 0), (0.5, 0.1, 0.3)):
        for r in rows.select("*", spectral.dtw(F.col("a"), F.col("b"), penalty=penalty).alias("d")).collect():
            d = {(0, 0): 0.0}
            for i in range(1, len(r.a) + 1):
                for j in range(1, len(r.b) + 1):
                    ways = (d.get((i - 1, j - 1), math.inf) + penalty[1], d.get((i - 1, j), math.inf) + penalty[2], d.get((i, j - 1), math.inf) + penalty[0])
                    d[i, j] = abs(r.a[i - 1] - r.b[j - 1]) + min(ways)
            assert r.d.cost == pytest.approx(d[len(r.a), len(r.b)])
            path = [(p.i, p.j) for p in r.d.path]
            assert path[0] == (0, 0) and path[-1] == (len(r.a) - 1, len(r.b) - 1)
            steps = {(0, 1): penalty[0], (1, 1): penalty[1], (1, 0): penalty[2]}
            spent = abs(r.a[0] - r.b[0]) + penalty[1] + sum(abs(r.a[i] - r.b[j]) + steps[i - h, j - k] for (h, k), (i, j) in zip(path, path[1:], strict=False))
            assert spent == pytest.approx(r.d.cost)
