"""Short-time spectra over array columns; Fourier transforms run on whole Arrow buffers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import mapped, matrices, on_blocks, on_lists


def _cosines(*weights: float) -> Callable[[int], np.ndarray]:
    """Symmetric window that is a sum of cosines."""
    return lambda n: sum(w * np.cos(2 * np.pi * k * np.arange(n) / max(n - 1, 1)) for k, w in enumerate(weights))


def _on_centre(shape: Callable[[np.ndarray], np.ndarray]) -> Callable[[int], np.ndarray]:
    """Symmetric window as a function of the distance from the middle, -1 and 1 at the first and last sample."""
    return lambda n: shape(np.linspace(-1, 1, n)) if n > 1 else np.ones(n)


def _parzen(n: int) -> np.ndarray:
    x = np.abs(2 * np.arange(n) - (n - 1)) / n
    return np.where(x <= 0.5, 1 - 6 * x**2 + 6 * x**3, 2 * (1 - x) ** 3)


#: The coefficients of the usual windows.
WINDOWS: dict[str, Callable[[int], np.ndarray]] = {
    "hann": _cosines(0.5, -0.5), "hamming": _cosines(0.54, -0.46), "blackman": _cosines(0.42, -0.5, 0.08),
    "blackmanharris": _cosines(0.35875, -0.48829, 0.14128, -0.01168),
    "flattop": _cosines(0.21557895, -0.41663158, 0.277263158, -0.083578947, 0.006947368),
    "boxcar": np.ones, "bartlett": _on_centre(lambda x: 1 - np.abs(x)), "parzen": _parzen,
    "triang": lambda n: 1 - np.abs(2 * np.arange(n) - (n - 1)) / (n + n % 2),
    "cosine": lambda n: np.sin(np.pi * (np.arange(n) + 0.5) / n),
    "bohman": _on_centre(lambda x: (1 - np.abs(x)) * np.cos(np.pi * np.abs(x)) + np.sin(np.pi * np.abs(x)) / np.pi),
    "tukey": _on_centre(lambda x: np.where(np.abs(x) <= 0.5, 1.0, 0.5 * (1 + np.cos(np.pi * (2 * np.abs(x) - 1))))),
}


def window(name: str, length: int, symmetric: bool = False) -> np.ndarray:
    """Periodic form, unless symmetric."""
    return np.asarray(WINDOWS[name](length), float) if symmetric else np.asarray(WINDOWS[name](length + 1), float)[:-1]


def dual_window(w: np.ndarray, shift: int, amplitude: bool = False) -> np.ndarray:
    """Synthesis window: w (or 1) over the sum of all shifted copies of its square (or of w)."""
    power, total = (w if amplitude else w * w), np.zeros(len(w))
    for at in range(0, len(w), shift):
        total[at:] += power[: len(w) - at]
        if at:
            total[: len(w) - at] += power[at:]
    return (1 if amplitude else w) / total


def fading_width(window_length: int, shift: int, fading: str | None) -> tuple[int, int]:
    """Zeros before and after the signal: `full`, `half` or None."""
    wide = window_length - shift
    return {None: (0, 0), "full": (wide, wide), "half": (wide // 2, wide - wide // 2)}[fading]


def stft(df: DataFrame, column: str, size: int = 1024, shift: int = 256, window_name: str = "blackman", window_length: int | None = None, fading: str | None = "full", pad: bool = True, symmetric: bool = False) -> DataFrame:
    """df with `re` and `im`: frames of size // 2 + 1 bins of the real signals in `column`.

    A shorter window is filled with zeros to `size`; the last frame is filled (`pad`) or cut. Empty and null signals
    have no frames with cutting and no fading, else what the zeros give.
    """
    length = window_length or size
    w, (before, after) = window(window_name, length, symmetric), fading_width(length, shift, fading)

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = x.shape[1] + before + after
        frames = max(0, -(-(n - length) // shift) + 1) if pad else max(0, (n - length) // shift + 1)
        frames = max(frames, 1) if pad else frames
        x = np.pad(x, ((0, 0), (before, after + max(0, (frames - 1) * shift + length - n))))
        if not frames:
            return (np.zeros((len(x), 0, size // 2 + 1)),) * 2
        seg = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, ::shift][:, :frames]
        s = np.fft.rfft(seg * w, size, axis=-1)
        return s.real, s.imag

    return on_blocks(df, column, run, {"re": 2, "im": 2})


def istft(re: Column, im: Column, size: int = 1024, shift: int = 256, window_name: str = "blackman", window_length: int | None = None, fading: str | None = "full", num_samples: int | None = None, symmetric: bool = False) -> Column:
    """array<double>: overlap-add with the synthesis window, fading taken off, cut to num_samples if given."""
    length = window_length or size
    dual, (before, after) = dual_window(window(window_name, length, symmetric), shift), fading_width(length, shift, fading)

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not a.shape[1]:
            return np.zeros((len(a), 0))
        return _overlapped(np.fft.irfft(a + 1j * b, size)[..., :length] * dual, shift)[:, before : (a.shape[1] - 1) * shift + length - after][:, :num_samples]

    return on_lists(run, re, im)


def _overlapped(frames: np.ndarray, shift: int) -> np.ndarray:
    """(signals, samples): sums of (signals, frames, samples) that begin `shift` apart."""
    n, length = frames.shape[1:]
    out = np.zeros((len(frames), (n - 1) * shift + length))
    for f in range(n):
        out[:, f * shift : f * shift + length] += frames[:, f]
    return out


def power(re: Column, im: Column) -> Column:
    """Squared magnitudes of frames."""
    return F.zip_with(re, im, lambda a, b: F.zip_with(a, b, lambda x, y: x * x + y * y))


def energy_per_frame(spectrogram: Column) -> Column:
    """Sums over bins; a sum of zero becomes the double's epsilon, so that its logarithm exists."""
    eps = float(np.finfo(float).eps)
    return F.transform(spectrogram, lambda f: F.aggregate(f, F.lit(0.0), lambda t, v: t + v, lambda t: F.when(t == 0, eps).otherwise(t)))


def centre_frequencies(size: int = 1024, sample_rate: int = 16_000) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size // 2)), lambda k: k * (sample_rate / size))


def frames_of_samples(samples: Column, size: int, shift: int, pad: bool = True, fading: str | None = None) -> Column:
    n = samples + sum(fading_width(size, shift, fading))
    return F.floor((n - size + shift + (shift - 1 if pad else 0)) / shift).cast("long")


def samples_of_frames(frames: Column, size: int, shift: int, fading: str | None = None) -> Column:
    return (frames * shift + size - shift - sum(fading_width(size, shift, fading))).cast("long")


def frame_of_sample(sample: Column, window_length: int, shift: int, fading: str | None = "full") -> Column:
    """The frame whose middle is nearest, not below 0."""
    at = sample + fading_width(window_length, shift, fading)[0] - (window_length - shift) // 2
    return F.greatest(F.floor(at / shift), F.lit(0)).cast("long")


def sample_of_frame(frame: Column, window_length: int, shift: int, fading: str | None = "full", mode: str = "center") -> Column:
    """First, middle or last sample of a frame, not below 0."""
    inside = {"first": 0, "center": window_length // 2, "last": window_length - 1}[mode]
    return F.greatest(frame * shift - sum(fading_width(window_length, shift, fading)) // 2 + inside, F.lit(0)).cast("long")


def to_baseband(re: Column, im: Column, size: int, shift: int) -> tuple[Column, Column]:
    """Each bin f of frame t turned by -2 pi t f shift / size."""
    def part(use):
        turn = lambda t, f: t * f * (-2 * math.pi * shift / size)
        return F.transform(F.arrays_zip(re.alias("a"), im.alias("b")), lambda x, t: F.transform(F.arrays_zip(x["a"].alias("p"), x["b"].alias("q")), lambda z, f: use(z["p"], z["q"], turn(t, f))))

    return part(lambda p, q, w: p * F.cos(w) - q * F.sin(w)), part(lambda p, q, w: p * F.sin(w) + q * F.cos(w))


def phase_features(df: DataFrame, size: int, shift: int) -> DataFrame:
    """df(re, im) with `phase`, its wrapped difference over frames `phase_delta`, and the difference of that; first frames 0."""
    from axisflow.functions.vectors import wrap_angle

    a, b = to_baseband(F.col("re"), F.col("im"), size, shift)
    rows = df.withColumn("phase", F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: F.atan2(q, p))))

    def steps(x: str, wrapped: bool) -> Column:
        change = lambda p, q: wrap_angle(q - p) if wrapped else q - p
        return F.transform(x, lambda f, t: F.when(t == 0, F.transform(f, lambda v: F.lit(0.0))).otherwise(F.zip_with(F.get(x, t - 1), f, change)))

    return rows.withColumn("phase_delta", steps("phase", True)).withColumn("phase_delta2", steps("phase_delta", False))


def griffin_lim(df: DataFrame, column: str, size: int = 1024, shift: int = 256, window_name: str = "blackman", fading: str | None = "full", iterations: int = 100, alpha: float = 0.0, phases: str | None = None, seed: int = 0, out: str = "signal") -> DataFrame:
    """df with a signal whose spectrum has nearly the magnitudes in `column` (frames of size // 2 + 1 bins, as of stft with the same windows).

    Each iteration gives the magnitudes the phases found so far, makes a signal of that, and takes the signal's spectrum; alpha over 0
    carries each change on, as the fast variant does. Phases begin with those of column `phases` (same shape), or with random ones by
    `seed`. The signal of the last iteration is returned, without the fading; no frames, or nulls, give an empty one.
    """
    w, bins = window(window_name, size), size // 2 + 1
    dual, (before, after) = dual_window(w, shift), fading_width(size, shift, fading)

    def run(loud: np.ndarray, *begin: np.ndarray) -> tuple[np.ndarray]:
        if not loud.shape[1]:
            return (np.zeros((len(loud), 0)),)
        if loud.shape[2] != bins or any(x.shape != loud.shape for x in begin):
            raise ValueError(f"magnitudes and phases need frames of {bins} bins each")
        angle = begin[0] if begin else 2 * np.pi * np.random.default_rng(seed).random(loud.shape[1:])

        def forward(y: np.ndarray) -> np.ndarray:
            y = np.pad(y, ((0, 0), (before, after)))
            return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(y, size, axis=1)[:, ::shift] * w, axis=-1)

        last = None
        for i in range(iterations):
            y = _overlapped(np.fft.irfft(loud * np.exp(1j * angle), size) * dual, shift)
            y = y[:, before : y.shape[1] - after]
            if i + 1 < iterations:
                new = forward(y)
                angle, last = np.angle(new if last is None else new + alpha * (new - last)), new
        return (y,)

    return mapped(df, [column, *([phases] if phases else [])], run, {out: 1})


def dct2(x: Column, n: int) -> Column:
    """First n coefficients of the orthonormal DCT-II."""
    size = F.size(x)
    def coefficient(k):
        terms = F.transform(x, lambda v, i: v * F.cos(math.pi * k * (2 * i + 1) / (2 * size)))
        return F.aggregate(terms, F.lit(0.0), lambda t, v: t + v) * F.sqrt(F.when(k == 0, 1.0).otherwise(2.0) / size)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), coefficient)


def dtw(a: Column, b: Column, border: tuple[float, float] = (math.inf, math.inf), penalty: tuple[float, float, float] = (0, 0, 0), weight: tuple[float, float, float] = (1, 1, 1)) -> Column:
    """struct<cost, path>: the cheapest monotone alignment by absolute differences, with its (i, j) places.

    border: what a step along the edge costs (first row, first column); penalty and weight of the steps (repeat a, match, repeat
    b), added to and multiplied with what was spent before. Cells are computed along anti-diagonals. Ties: match, then repeat b.
    """
    def align(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs, path lengths and the places of all paths one after another; signals lie side by side in the last axis."""
        n, r, c = len(x), x.shape[1], y.shape[1]
        x, y, rows = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), np.arange(n)
        d = np.full((r + 1, c + 1, n), np.inf)
        with np.errstate(invalid="ignore"):
            d[0, 1:], d[1:, 0], d[0, 0] = np.arange(1, c + 1)[:, None] * border[0], np.arange(1, r + 1)[:, None] * border[1], 0
        for s in range(2, r + c + 1):
            i = np.arange(max(1, s - c), min(r, s - 1) + 1)
            j = s - i
            way = np.minimum(weight[1] * d[i - 1, j - 1] + penalty[1], np.minimum(weight[2] * d[i - 1, j] + penalty[2], weight[0] * d[i, j - 1] + penalty[0]))
            d[i, j] = np.abs(x[i - 1] - y[j - 1]) + way
        i, j, steps = np.full(n, r), np.full(n, c), []
        while (on := (i > 0) & (j > 0)).any():
            steps.append((on, i - 1, j - 1))
            h, k = np.maximum(i, 1) - 1, np.maximum(j, 1) - 1
            best = np.argmin([d[h, k, rows] + penalty[1], d[h, j, rows] + penalty[2], d[i, k, rows] + penalty[0]], axis=0)
            i, j = i - (on & (best != 2)), j - (on & (best != 1))
        on, i, j = (np.stack(part[::-1], 1) if part else np.zeros((n, 0), int) for part in (zip(*steps, strict=True) if steps else ((), (), ())))
        return d[r, c].copy(), on.sum(1), np.stack([i[on.astype(bool)], j[on.astype(bool)]])

    @F.arrow_udf("cost double, path array<struct<i:int,j:int>>")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        known = pc.and_(pc.is_valid(xs), pc.is_valid(ys))
        found = [align(*m) for m in matrices([xs.filter(known), ys.filter(known)], lambda r, c: (r + 1) * (c + 1) // 8)]  # tables of 8 MB
        null = ~known.to_numpy(zero_copy_only=False)
        cost, sizes = np.full(len(null), np.nan), np.zeros(len(null), int)
        if found:
            cost[~null], sizes[~null] = (np.concatenate([f[k] for f in found]) for k in range(2))
        i, j = np.concatenate([f[2] for f in found], 1) if found else np.zeros((2, 0), int)
        places = pa.StructArray.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32())], ["i", "j"])
        path = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), places, mask=pa.array(null))
        return pa.StructArray.from_arrays([pa.array(cost, mask=null), path], ["cost", "path"])

    return run.asNondeterministic()(a, b)  # worked once, whatever filters follow
