"""Frames and sliding kernels over array columns."""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import on_blocks


MODES = ("constant", "edge", "reflect", "symmetric", "wrap")


def _source(i: Column, n: Column, mode: str) -> Column:
    """The place in 0 .. n - 1 that a place outside takes its value from."""
    if mode == "edge":
        return F.greatest(F.lit(0), F.least(i, n - 1))
    if mode == "wrap":
        return F.pmod(i, n)
    if mode == "symmetric":
        j = F.pmod(i, 2 * n)
        return F.when(j < n, j).otherwise(2 * n - 1 - j)
    j = F.pmod(i, F.greatest(2 * n - 2, F.lit(1)))  # reflect
    return F.when(j < n, j).otherwise(2 * n - 2 - j)


def pad_axis(x: Column, before: int | Column, after: int | Column, mode: str = "constant", value: float = 0.0) -> Column:
    """x with `before` and `after` more values: a constant, or taken from x; an empty x gets the constant."""
    before, after = (w if isinstance(w, Column) else F.lit(w) for w in (before, after))
    if mode == "constant":
        return F.concat(F.array_repeat(F.lit(value), before), x, F.array_repeat(F.lit(value), after))
    fill = F.concat(F.array_repeat(F.lit(value), before), F.array_repeat(F.lit(value), after))
    places = F.sequence(-before, F.size(x) + after - 1)
    return F.when(F.size(x) == 0, fill).otherwise(F.transform(places, lambda i: F.get(x, _source(i, F.size(x), mode))))


def pad_to(x: Column, to: Column, value: float = 0.0) -> Column:
    """x filled to the length of `to`, never cut."""
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(F.size(to) - F.size(x), F.lit(0))))


def segment_axis(x: Column, length: int, shift: int, end: str | None = "cut", mode: str = "constant", value: float = 0.0) -> Column:
    """Overlapping frames, in reverse order for a negative shift.

    end: `cut` leaves the rest out; `pad` fills it to one more frame (one at least); `conv_pad` fills both sides so that every
    value is in as many frames as one in the middle; None asks for a length without rest, and fails otherwise.
    """
    step = abs(shift)
    if end == "conv_pad":
        # length - step values before the first, and behind the last as many, plus what a whole frame lacks
        wide = length - step
        x = pad_axis(x, wide, F.lit(wide) + F.pmod(-(F.size(x) + 2 * wide - length), F.lit(step)), mode, value)
    n = F.size(x)
    frames = F.floor((n - length) / step).cast("int") + 1
    if end == "pad":
        frames = F.greatest(F.lit(1), F.ceil((n - length) / step).cast("int") + 1)
        x = pad_axis(x, 0, F.greatest(F.lit(0), (frames - 1) * step + length - n), mode, value)
    if end is None:
        x = F.when((n >= length) & ((n - length) % step == 0), x).otherwise(F.raise_error(F.lit("the frames leave a rest")).cast("array<double>"))
    out = F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.slice(x, i * step + 1, F.lit(length)))).otherwise(F.array().cast("array<array<double>>"))
    return F.reverse(out) if shift < 0 else out


def cut(x: Column, low: int, high: int) -> Column:
    """Without the first `low` and the last -`high` values (high <= 0)."""
    return F.slice(x, F.lit(low + 1), F.greatest(F.size(x) - low + high, F.lit(0)))


def expand(x: Column, low: int, high: int) -> Column:
    """Zeros where cut took values away."""
    return pad_axis(x, low, -high)


def overwrite(x: Column, low: int, high: int) -> Column:
    """Zeros in place of what cut takes away."""
    return F.transform(x, lambda v, i: F.when((i >= low) & (i < F.size(x) + high), v).otherwise(0.0))


def _around(x: Column, i: Column, half: int) -> Column:
    """The values at i - half .. i + half, border values repeated."""
    at = F.transform(F.sequence(i - half, i + half), lambda j: F.greatest(F.lit(0), F.least(j, F.size(x) - 1)))
    return F.transform(at, lambda j: F.get(x, j))


def kernel(x: Column, size: int, how: str, padding: str | None = "edge", position: str = "pre") -> Column:
    """Maximum, minimum, mean or median over centred windows of an odd size.

    Border values are repeated before the kernel runs (`pre`); or it runs over whole windows only, and its first and last
    results are repeated (`post`), or not (padding None, a shorter result).
    """
    fold = {
        "max": F.array_max, "min": F.array_min,
        "mean": lambda w: F.aggregate(w, F.lit(0.0), lambda t, v: t + v) / size,
        "median": lambda w: F.get(F.array_sort(w), F.lit(size // 2)),
    }[how]
    if padding is not None and position == "pre":
        found = F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: fold(_around(x, i, size // 2)))
    else:
        found = F.transform(segment_axis(x, size, 1), fold)
        found = found if padding is None else pad_axis(found, size // 2, size // 2, padding)
    return F.when(F.size(x) == 0, F.slice(x, 1, 0)).when(F.size(x) > 0, found)


def _extrema(x: np.ndarray, size: int, fold: np.ufunc) -> np.ndarray:
    """Of every `size` neighbours in each row, by running folds from both ends of blocks of `size`: three steps a value for any size."""
    n = x.shape[1]
    filled = np.concatenate([x, np.repeat(x[:, -1:], -n % size, 1)], 1).reshape(len(x), -1, size)
    ahead = fold.accumulate(filled, 2).reshape(len(x), -1)
    back = fold.accumulate(filled[:, :, ::-1], 2)[:, :, ::-1].reshape(len(x), -1)
    return fold(back[:, : n - size + 1], ahead[:, size - 1 : n])


def _medians(row: np.ndarray, size: int) -> np.ndarray:
    """Of every `size` neighbours, from a sorted window that one value leaves and one enters at a time; NaN wherever one is inside."""
    bad = np.isnan(row)
    values = np.where(bad, np.inf, row).tolist()
    held = sorted(values[:size])
    out = [held[size // 2]]
    for old, new in zip(values, values[size:], strict=False):
        del held[bisect.bisect_left(held, old)]
        bisect.insort(held, new)
        out.append(held[size // 2])
    seen = np.concatenate([[0], np.cumsum(bad)])
    return np.where(seen[size:] > seen[:-size], np.nan, out)


def sliding(df: DataFrame, column: str, size: int, how: str, padding: str | None = "edge", position: str = "pre", out: str = "values") -> DataFrame:
    """df with kernel()'s result for windows of any odd size, in time that follows the signal's length and not the window's.

    max and min by running folds over blocks, mean by running sums (exact to rounding), median by a sorted window. `pre` repeats border
    values first, `post` repeats the results' border; padding None gives the shorter result, empty if the signal is shorter than the
    window, as `post` does then. Null signals count as empty; empty ones stay empty; a NaN makes every window that holds it NaN.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("the size must be odd")
    half = size // 2

    def run(x: np.ndarray) -> tuple[np.ndarray]:
        if x.shape[1] and padding is not None and position == "pre":
            x = np.pad(x, ((0, 0), (half, half)), padding)
        if x.shape[1] < size:
            return (np.zeros((len(x), 0)),)
        if how in ("max", "min"):
            y = _extrema(x, size, np.maximum if how == "max" else np.minimum)
        elif how == "median":
            y = np.stack([_medians(r, size) for r in x])
        elif np.isfinite(x).all():
            base = x.mean(1, keepdims=True)  # sums of what is left stay small
            total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x - base, 1)], 1)
            y = base + (total[:, size:] - total[:, :-size]) / size
        else:
            y = np.lib.stride_tricks.sliding_window_view(x, size, axis=1).mean(2)
        return (np.pad(y, ((0, 0), (half, half)), padding) if padding is not None and position == "post" else y,)

    return on_blocks(df, column, run, {out: 1})


def roll_zeropad(x: Column, by: int) -> Column:
    """Moved by `by` places, zeros coming in; the length stays."""
    zeros = F.array_repeat(F.lit(0.0), F.least(F.lit(abs(by)), F.size(x)))
    rest = F.greatest(F.size(x) - abs(by), F.lit(0))
    return F.concat(zeros, F.slice(x, 1, rest)) if by >= 0 else F.concat(F.slice(x, F.lit(1 - by), rest), zeros)


def context_frames(x: Column, left: int, right: int, step: int = 1, mode: str = "symmetric") -> Column:
    """For every `step`-th value or frame of x the list of its neighbours from `left` before to `right` behind it."""
    n = F.size(x)
    at = lambda i: F.get(x, i) if mode == "constant" else F.get(x, _source(i, n, mode))
    found = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda t: F.transform(F.sequence(t - left, t + right), lambda i: F.when((i >= 0) & (i < n), F.get(x, i)).otherwise(at(i))))
    return F.when(n == 0, F.transform(F.slice(x, 1, 0), lambda v: F.array(v))).when(n > 0, found)


def stack_context(x: Column, left: int, right: int, step: int = 1, mode: str = "symmetric") -> Column:
    """Frames (arrays) joined with their neighbours, mirrored at the borders."""
    return F.transform(context_frames(x, left, right, step, mode), F.flatten)


def unstack_context(x: Column, left: int, right: int) -> Column:
    """The middle part of stacked frames."""
    return F.transform(x, lambda f: F.slice(f, (F.size(f) / (left + right + 1)).cast("int") * left + 1, (F.size(f) / (left + right + 1)).cast("int")))


def add_context(x: Column, left: int, right: int, step: int = 1, parts: int = 1) -> Column:
    """Frames with context as planes: part, feature, place; `parts` equal shares of the features (values, differences) are planes.

    Zeros outside the signal.
    """
    zeros = F.transform(F.get(x, F.lit(0)), lambda v: F.lit(0.0))
    wide = F.transform(context_frames(x, left, right, step, "constant"), lambda c: F.transform(c, lambda f: F.coalesce(f, zeros)))
    size = (F.size(F.get(x, F.lit(0))) / parts).cast("int")
    plane = lambda c, p: F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.transform(c, lambda f: F.get(f, p * size + k)))
    return F.transform(wide, lambda c: F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: plane(c, p)))


def split_complex(re: Column, im: Column) -> Column:
    """Frames with real parts first, imaginary ones behind."""
    return F.zip_with(re, im, lambda a, b: F.concat(a, b))


def merge_complex(x: Column) -> tuple[Column, Column]:
    half = lambda f: (F.size(f) / 2).cast("int")
    return F.transform(x, lambda f: F.slice(f, F.lit(1), half(f))), F.transform(x, lambda f: F.slice(f, half(f) + 1, half(f)))


def preemphasis(x: Column, p: float = 0.95) -> Column:
    """y[t] = x[t] - p * x[t - 1], x[-1] = 0."""
    return F.transform(x, lambda v, i: v - p * F.when(i > 0, F.get(x, i - 1)).otherwise(0.0))


def morph(df: DataFrame, operation: str, sizes: dict[str, int], value: str = "value") -> DataFrame:
    """Cells of an array with a column for each source axis, to a column for each target axis: `T,B*F->F,B*T`.

    `A*B` on the left is one column that is taken apart, on the right one that is put together; `1` on the right is an axis of one
    place. `sizes` names the lengths of the axes that are taken apart or put together behind the first. A left axis that the right
    leaves out must be summed by the caller's aggregation: its rows stay.
    """
    left, right = (side.replace(" ", "").split(",") for side in operation.split("->"))
    axes = {}
    for name in left:
        rest = F.col(f"`{name}`").cast("long")
        parts = name.split("*")
        for part in reversed(parts[1:]):
            axes[part] = F.pmod(rest, F.lit(sizes[part]))
            rest = F.floor(rest / sizes[part])
        axes[parts[0]] = rest
    out = []
    for name in right:
        place = F.lit(0).cast("long")
        for part in name.split("*") if name != "1" else ():
            place = place * sizes.get(part, 1) + axes[part]
        out.append(place.alias(name))
    return df.select(*[c for c in df.columns if c not in left and c != value], *out, value)
