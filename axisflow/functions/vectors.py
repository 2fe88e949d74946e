"""Scalar, angular and vector expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cos_similarity(a: Column, b: Column) -> Column:
    """Absolute cosine."""
    return F.abs(dot(a, b)) / (norm(a) * norm(b))


def cos_distance(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2, signed cosine."""
    return (1 - dot(a, b) / (norm(a) * norm(b))) / 2


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x))


def wrap_angle(x: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(x + math.pi, F.lit(2 * math.pi)) - math.pi


def cart2sph(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Azimuth, elevation, radius."""
    return F.atan2(y, x), F.atan2(z, F.sqrt(x * x + y * y)), F.sqrt(x * x + y * y + z * z)


def deg2rad(x: Column) -> Column:
    return x * (math.pi / 180)


def str_to_seed(s: Column) -> Column:
    """SHA-256 of the text modulo 2^32."""
    return F.conv(F.substring(F.sha2(s, 256), 57, 8), 16, 10).cast("long")


def rad2deg(x: Column) -> Column:
    return x * (180 / math.pi)


def wrap_by_sine(x: Column) -> Column:
    """Into [-pi, pi] by sine and cosine, so that pi stays pi."""
    return F.atan2(F.sin(x), F.cos(x))


def wrap_by_half(x: Column) -> Column:
    """Into [-pi, pi] by the tangent of half the angle."""
    return 2 * F.atan(F.tan(x / 2))


def minus_angle(a: Column, b: Column) -> Column:
    """Difference in [-pi, pi]."""
    return wrap_by_sine(a - b)


def direction_to_angle(v: Column) -> Column:
    """Angle of an array (x, y)."""
    return F.atan2(F.get(v, F.lit(1)), F.get(v, F.lit(0)))


def sph2cart(azimuth: Column, elevation: Column, radius: Column) -> tuple[Column, Column, Column]:
    flat = radius * F.cos(elevation)
    return flat * F.cos(azimuth), flat * F.sin(azimuth), radius * F.sin(elevation)


def rotation(axis: str, angle: Column) -> Column:
    """3 x 3 matrix of a right-handed turn about x, y or z."""
    c, s, i = F.cos(angle), F.sin(angle), "xyz".index(axis)
    one, zero = F.lit(1.0), F.lit(0.0)
    cell = {(0, 0): c, (1, 1): c, (0, 1): -s, (1, 0): s}  # in the plane of the two axes that follow
    place = lambda j: (j - i - 1) % 3
    return F.array(*(F.array(*(one if a == b == i else cell.get((place(a), place(b)), zero) for b in range(3))) for a in range(3)))


def matrix_times(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: dot(row, v))


def abs_square(re: Column, im: Column | None = None) -> Column:
    return re * re if im is None else re * re + im * im


def complex_dot(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """sum conj(a) b of two complex vectors, each a pair of arrays (real, imaginary)."""
    return dot(a[0], b[0]) + dot(a[1], b[1]), dot(a[0], b[1]) - dot(a[1], b[0])


def complex_cos_similarity(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """|<a, b>| / (|a| |b|)."""
    re, im = complex_dot(a, b)
    return F.sqrt(re * re + im * im) / (F.sqrt(dot(a[0], a[0]) + dot(a[1], a[1])) * F.sqrt(dot(b[0], b[0]) + dot(b[1], b[1])))


def solve(a: Column, b: Column) -> Column:
    """x of a x = b for each row's matrix and vector; the least-squares solution where the matrix is singular or not square.

    All regular matrices of a batch are solved at once.
    """
    @F.pandas_udf("array<double>")
    def run(matrices: pd.Series, vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(matrices)
        known = [i for i, (m, v) in enumerate(zip(matrices, vectors, strict=True)) if m is not None and v is not None]
        by_shape: dict = {}
        for i in known:
            m = np.stack(matrices.iloc[i]).astype(float)
            by_shape.setdefault(m.shape, []).append((i, m, np.asarray(vectors.iloc[i], float)))
        for (rows, columns), group in by_shape.items():
            m, v = np.stack([g[1] for g in group]), np.stack([g[2] for g in group])
            sure = np.linalg.cond(m) < 1e13 if rows == columns else np.zeros(len(m), bool)
            if sure.any():
                for g, x in zip(np.flatnonzero(sure), np.linalg.solve(m[sure], v[sure][..., None])[..., 0], strict=True):
                    out[group[g][0]] = x.tolist()
            for g in np.flatnonzero(~sure):
                out[group[g][0]] = np.linalg.lstsq(m[g], v[g], rcond=None)[0].tolist()
        return pd.Series(out)

    return run(a, b)
