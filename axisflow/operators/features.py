"""Speech features: recursive filters, mel filter banks, cepstra and their differences."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spectral
from .blocks import on_blocks

EPS = 1e-18


def recursive_filter(df: DataFrame, column: str, b: list[float], a: list[float], out: str = "filtered") -> DataFrame:
    """df with y: y[n] = sum b[k] x[n - k] - sum a[k] y[n - k], a[0] = 1, from a state of zeros. Steps run over time, rows side by side."""
    def run(x: np.ndarray) -> tuple[np.ndarray]:
        y = np.zeros_like(x)
        for k, v in enumerate(b):
            y[:, k:] += v * x[:, : x.shape[1] - k]
        for n in range(x.shape[1]):
            for k in range(1, min(n, len(a) - 1) + 1):
                y[:, n] -= a[k] * y[:, n - k]
        return (y,)

    return on_blocks(df, column, run, {out: 1})


def inverse_preemphasis(df: DataFrame, column: str, p: float = 0.95, out: str = "filtered") -> DataFrame:
    return recursive_filter(df, column, [1.0], [1.0, -p], out)


def offset_compensation(df: DataFrame, column: str, out: str = "filtered") -> DataFrame:
    return recursive_filter(df, column, [1.0, -1.0], [1.0, -0.999], out)


def preemphasis_with_offset_compensation(df: DataFrame, column: str, p: float = 0.95, out: str = "filtered") -> DataFrame:
    return recursive_filter(df, column, [1.0, -(1 + p), p], [1.0, -0.999], out)


def median_filter(x: Column, size: int = 3) -> Column:
    """Medians of centred windows of an odd size, zeros outside."""
    zeros = F.array_repeat(F.lit(0.0), size // 2)
    wide = F.concat(zeros, x, zeros)
    return F.transform(x, lambda v, i: F.get(F.array_sort(F.slice(wide, i + 1, F.lit(size))), F.lit(size // 2)))


# ---- scales ----

SLANEY_STEP, SLANEY_FROM, SLANEY_LOG = 200.0 / 3, 1000.0, float(np.log(6.4) / 27)


def hz_to_mel(f, htk: bool = True, lib=F):
    """For columns, and with lib=np for numbers. htk: 2595 log10(1 + f / 700); else linear up to 1 kHz, logarithmic above."""
    if htk:
        return 2595.0 * lib.log10(1 + f / 700.0)
    high = SLANEY_FROM / SLANEY_STEP + lib.log(f / SLANEY_FROM) / SLANEY_LOG
    return np.where(f >= SLANEY_FROM, high, f / SLANEY_STEP) if lib is np else F.when(f >= SLANEY_FROM, high).otherwise(f / SLANEY_STEP)


def mel_to_hz(m, htk: bool = True, lib=F):
    if htk:
        return 700.0 * (lib.exp(m * float(np.log(10) / 2595)) - 1)
    border = SLANEY_FROM / SLANEY_STEP
    high = SLANEY_FROM * lib.exp(SLANEY_LOG * (m - border))
    return np.where(m >= border, high, m * SLANEY_STEP) if lib is np else F.when(m >= border, high).otherwise(m * SLANEY_STEP)


def bin_to_hz(k, sample_rate: float, size: int):
    return k * sample_rate / size


def hz_to_bin(f, sample_rate: float, size: int):
    return f * size / sample_rate


def warp_hz(f: Column, factor: float, ratio: float, highest: float) -> Column:
    """Two straight pieces: by `factor` up to a break, from there so that `highest` stays where it is."""
    at = ratio * highest * min(factor, 1.0) / factor
    if at > highest or factor * at > highest:
        at = highest
    value = factor * at
    first, second = f * factor, (f - at) * ((highest - value) / max(highest - at, EPS)) + value
    return F.least(first, second) if factor >= 1 else F.greatest(first, second)


def warp_mel(f: Column, factor: float, ratio: float, highest: float, htk: bool = True) -> Column:
    top = float(hz_to_mel(np.float64(highest), htk, np))
    return mel_to_hz(warp_hz(hz_to_mel(f, htk), factor, ratio, top), htk)


def filter_bank(sample_rate: float = 16_000, size: int = 512, filters: int = 23, lowest: float = 0.0, highest: float | None = None, htk: bool = True, warp: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """(filters, size // 2 + 1) triangles, evenly spaced in mel, each side at least one bin wide."""
    edges = np.array([hz_to_mel(np.float64(x), htk, np) for x in (lowest, sample_rate / 2 if highest is None else highest)])
    hz = mel_to_hz(np.linspace(*edges, filters + 2), htk, np)
    k = hz_to_bin(hz if warp is None else warp(hz), sample_rate, size)
    mid = k[1:-1, None]
    up, down = mid - np.minimum(k[:-2, None], mid - 1), np.maximum(k[2:, None], mid + 1) - mid
    away = np.arange(size // 2 + 1) - mid
    return np.clip(np.minimum(1 + away / up, 1 - away / down), 0, None)


def unit_bank(**of) -> np.ndarray:
    bank = filter_bank(**of)
    return bank / (bank.sum(1, keepdims=True) + EPS)


def weighted(spectrogram: Column, matrix: np.ndarray) -> Column:
    """Frames times a small constant matrix (rows: outputs), its zeros left out."""
    rows = F.array(*(F.array(*(F.struct(F.lit(int(i)).alias("i"), F.lit(float(r[i])).alias("w")) for i in np.flatnonzero(r))) if r.any() else F.array().cast("array<struct<i:int,w:double>>") for r in matrix))
    return F.transform(spectrogram, lambda f: F.transform(rows, lambda r: F.aggregate(r, F.lit(0.0), lambda t, x: t + x["w"] * F.get(f, x["i"]))))


def mel(spectrogram: Column, log: bool = True, **of) -> Column:
    """Spectrogram frames to (log) mel bands with filters of unit sum."""
    bands = weighted(spectrogram, unit_bank(**of))
    return F.transform(bands, lambda f: F.transform(f, lambda v: F.log(v + EPS))) if log else bands


def inverse_mel(bands: Column, log: bool = True, **of) -> Column:
    """Back by the pseudo-inverse, negative values cut."""
    flat = F.transform(bands, lambda f: F.transform(f, F.exp)) if log else bands
    return F.transform(weighted(flat, np.linalg.pinv(unit_bank(**of))), lambda f: F.transform(f, lambda v: F.greatest(v, F.lit(0.0))))


def _bands(sample_rate: float = 16_000, window_length: int = 400, shift: int = 160, filters: int = 23, size: int = 512, lowest: float = 0.0, highest: float | None = None, p: float = 0.97, window_name: str = "hamming", denoise: bool = False, log: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """(signals, samples) to (signals, frames, filters)."""
    bank, w = unit_bank(sample_rate=sample_rate, size=size, filters=filters, lowest=lowest, highest=highest).T, spectral.window(window_name, window_length)

    def run(x: np.ndarray) -> np.ndarray:
        y = x.copy()
        for k, v in ((1, -(1 + p)), (2, p)):
            y[:, k:] += v * x[:, : x.shape[1] - k]
        for n in range(1, y.shape[1]):
            y[:, n] += 0.999 * y[:, n - 1]
        frames = max(1, -(-(y.shape[1] - window_length) // shift) + 1)
        y = np.pad(y, ((0, 0), (0, max(0, (frames - 1) * shift + window_length - y.shape[1]))))
        seg = np.lib.stride_tricks.sliding_window_view(y, window_length, axis=1)[:, ::shift][:, :frames]
        bands = (np.abs(np.fft.rfft(seg * w, size, axis=-1)) ** 2 / size) @ bank
        bands = bands - bands.min(1, keepdims=True) if denoise else bands
        return np.log(bands + EPS) if log else bands

    return run


def fbank(df: DataFrame, column: str, sample_rate: float = 16_000, window_length: int = 400, shift: int = 160, filters: int = 23, size: int = 512, lowest: float = 0.0, highest: float | None = None, p: float = 0.97, window_name: str = "hamming", denoise: bool = False, log: bool = False, out: str = "bands") -> DataFrame:
    """df with mel bands a frame: preemphasis with offset compensation, spectrum without fading, power / size, unit filters; in one pass."""
    bands = _bands(sample_rate, window_length, shift, filters, size, lowest, highest, p, window_name, denoise, log)
    return on_blocks(df, column, lambda x: (bands(x),), {out: 2})


def _cepstra(cepstra: int = 13, lifter: int = 22, filters: int = 26, **of) -> Callable[[np.ndarray], np.ndarray]:
    """(signals, samples) to (signals, frames, cepstra)."""
    n, k = np.arange(filters), np.arange(cepstra)[:, None]
    matrix = np.cos(np.pi * k * (2 * n + 1) / (2 * filters)) * np.sqrt(np.where(k == 0, 1, 2) / filters)
    if lifter > 0:
        matrix = matrix * (1 + lifter / 2 * np.sin(np.pi * k / lifter))
    bands = _bands(filters=filters, **{**of, "log": True})
    return lambda x: bands(x) @ matrix.T


def mfcc(df: DataFrame, column: str, cepstra: int = 13, lifter: int = 22, filters: int = 26, out: str = "cepstra", **of) -> DataFrame:
    """df with the first `cepstra` orthonormal DCT-II coefficients of log mel bands, each lifted by 1 + L / 2 sin(pi n / L)."""
    found = _cepstra(cepstra, lifter, filters, **of)
    return on_blocks(df, column, lambda x: (found(x),), {out: 2})


def delta_taps(width: int = 9, order: int = 1) -> np.ndarray:
    """The regression filter of an odd width, `order` times over."""
    if width < 3 or width % 2 == 0 or order < 1:
        raise ValueError("width must be odd and at least 3, order positive")
    k = np.arange(width // 2, -(width // 2) - 1, -1.0)
    taps = one = k / (k * k).sum()
    for _ in range(order - 1):
        taps = np.convolve(taps, one)
    return taps


def delta(x: Column, width: int = 9, order: int = 1) -> Column:
    """Regression slope over `width` values with border values repeated; higher orders are filtered again and cut at the same place."""
    taps, half, n = delta_taps(width, order), width // 2, F.size(x)
    c = F.array(*map(F.lit, taps.tolist()))
    at = lambda i: F.when(i < -width, 0.0).otherwise(F.get(x, F.greatest(F.lit(0), F.least(i, n - 1))))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.aggregate(F.transform(c, lambda w, j: w * at(t + half - j)), F.lit(0.0), lambda s, v: s + v))).otherwise(x)


def velocity_acceleration(cepstra: Column) -> Column:
    """Each frame with its differences of first and second order along the coefficients behind it."""
    return F.transform(cepstra, lambda f: F.concat(f, delta(f), delta(f, order=2)))


def _runs(n: Column, size: int, step: int) -> Column:
    return F.greatest(F.lit(1), F.ceil((n - size) / step).cast("int") + 1)


def modulation(cepstra: Column, length: int = 16, shift: int = 8, window_name: str = "hamming") -> Column:
    """Magnitudes of the short-time spectrum along the frames of each coefficient: block, bin, coefficient.

    The last block is filled with zeros. No frames give no blocks.
    """
    w = spectral.window(window_name, length)
    turn = lambda b, use: F.array(*(F.lit(float(v)) for v in w * use(2 * np.pi * b * np.arange(length) / length)))

    def value(block, b, i):
        part = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.coalesce(F.get(F.get(cepstra, block * shift + k), i), F.lit(0.0)))
        total = lambda use: F.aggregate(F.zip_with(part, turn(b, use), lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)
        return F.sqrt(total(np.cos) * total(np.cos) + total(np.sin) * total(np.sin))

    each = F.sequence(F.lit(0), F.size(F.get(cepstra, F.lit(0))) - 1)
    blocks = F.transform(F.sequence(F.lit(0), _runs(F.size(cepstra), length, shift) - 1), lambda block: F.array(*(F.transform(each, partial(value, block, b)) for b in range(length // 2 + 1))))
    return F.when(F.size(cepstra) == 0, F.array().cast("array<array<array<double>>>")).when(F.size(cepstra) > 0, blocks)


def average_blocks(blocks: Column, length: int, shift: int) -> Column:
    """Means over runs of `length` blocks (bin, coefficient), one every `shift`; the last run is filled with zeros. `blocks` should be a stored column."""
    if shift > length:
        raise ValueError("averages must not leave blocks out")
    add = lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.zip_with(x, y, lambda p, q: F.zip_with(p, q, lambda u, v: u + v)))
    part = lambda run: F.slice(blocks, run * shift + 1, length)
    total = lambda run: F.aggregate(part(run), F.lit(None).cast("array<array<double>>"), add)
    mean = lambda run: F.transform(total(run), lambda b: F.transform(b, lambda v: v / length))
    found = F.transform(F.sequence(F.lit(0), _runs(F.size(blocks), length, shift) - 1), mean)
    return F.when(F.size(blocks) == 0, F.slice(blocks, 1, 0)).when(F.size(blocks) > 0, found)


def _in_runs(x: np.ndarray, length: int, shift: int) -> np.ndarray:
    """(rows, runs, .., length): runs of `length` along the second axis, one every `shift`; the last is filled with zeros."""
    runs = max(1, -(-(x.shape[1] - length) // shift) + 1)
    x = np.pad(x, ((0, 0), (0, max(0, (runs - 1) * shift + length - x.shape[1])), *((0, 0),) * (x.ndim - 2)))
    return np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, ::shift][:, :runs]


def modmfcc(df: DataFrame, column: str, block: int = 16, step: int = 8, block_window: str = "hamming", average: int = 1, average_step: int = 1, cepstra: int = 30, filters: int = 40, out: str = "modulation", **of) -> DataFrame:
    """df with the modulation spectrum of the signals' mel cepstra, averaged over runs of blocks if `average` is over 1; `of` goes to mfcc.

    Cepstra, spectra and means (as of modulation and average_blocks) are taken in one pass over the signals.
    """
    if average > 1 and average_step > average:
        raise ValueError("averages must not leave blocks out")
    found, w = _cepstra(cepstra, filters=filters, **of), spectral.window(block_window, block)

    def run(x: np.ndarray) -> tuple[np.ndarray]:
        spectra = np.abs(np.fft.rfft(_in_runs(found(x), block, step) * w, axis=-1)).swapaxes(2, 3)
        return (_in_runs(spectra, average, average_step).mean(-1) if average > 1 else spectra,)

    return on_blocks(df, column, run, {out: 3})
