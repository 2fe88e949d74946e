"""Random numbers as functions of a seed text and a row's key: the same on any partitioning, and in any engine that has SHA-256."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIES = 32  # of a truncated normal, before the last try is cut to the bounds


def unit(seed: str, key: Column, nth: int | Column = 0) -> Column:
    """Uniform in (0, 1), from 48 bits of a hash."""
    nth = nth if isinstance(nth, Column) else F.lit(nth)
    digest = F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string"), nth.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48


def uniform(seed: str, key: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return low + (high - low) * unit(seed, key)


def log_uniform(seed: str, key: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """exp of a uniform number; the bounds are logarithms."""
    return F.exp(uniform(seed, key, low, high))


def _gauss(seed: str, key: Column, nth: int | Column = 0) -> Column:
    return F.sqrt(-2 * F.log(unit(seed, key, 2 * nth))) * F.cos(2 * math.pi * unit(seed, key, 2 * nth + 1))


def normal(seed: str, key: Column, loc: float = 0.0, scale: float = 1.0) -> Column:
    return loc + scale * _gauss(seed, key)


def truncated_normal(seed: str, key: Column, loc: float = 0.0, scale: float = 1.0, truncation: float = 3.0) -> Column:
    """The first of TRIES normal numbers within loc +- truncation. Later tries are made only where the earlier ones lie outside."""
    one = lambda i: F.when(F.abs(scale * _gauss(seed, key, i)) <= truncation, scale * _gauss(seed, key, i))

    def some(first: int, last: int) -> Column:
        tries = F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: scale * _gauss(seed, key, i))
        return F.get(F.filter(tries, lambda z: F.abs(z) <= truncation), F.lit(0))

    last = F.greatest(F.lit(-truncation), F.least(F.lit(float(truncation)), scale * _gauss(seed, key, TRIES - 1)))
    return loc + F.coalesce(one(0), one(1), some(2, 5), some(6, TRIES - 1), last)


def log_truncated_normal(seed: str, key: Column, loc: float = 0.0, scale: float = 1.0, truncation: float = 3.0) -> Column:
    return F.exp(truncated_normal(seed, key, loc, scale, truncation))


def truncated_exponential(seed: str, key: Column, loc: float = 0.0, scale: float = 1.0, truncation: float = 3.0) -> Column:
    """In [loc, loc + truncation], by the inverse of its distribution."""
    return loc - scale * F.log(1 - unit(seed, key) * (1 - math.exp(-truncation / scale)))


def vector(draw, key: Column, size: int) -> Column:
    """`size` draws of draw(key): each place has a key of its own."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: draw(F.concat_ws("/", key.cast("string"), i.cast("string"))))


def hermitian(seed: str, key: Column, size: int) -> tuple[Column, Column]:
    """Real and imaginary part of a random Hermitian matrix: a symmetric and an antisymmetric one."""
    cell = lambda part, i, j: normal(f"{seed}/{part}", F.concat_ws("/", key.cast("string"), F.least(i, j).cast("string"), F.greatest(i, j).cast("string")))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    re = F.transform(places, lambda i: F.transform(places, lambda j: cell("re", i, j)))
    return re, F.transform(places, lambda i: F.transform(places, lambda j: cell("im", i, j) * F.signum(j - i)))


def positive_definite_hermitian(seed: str, key: Column, size: int) -> tuple[Column, Column]:
    """A conj(A)^T of a random complex matrix A, plus 1 on the diagonal."""
    cell = lambda part, i, k: normal(f"{seed}/{part}", F.concat_ws("/", key.cast("string"), i.cast("string"), k.cast("string")))
    places = F.sequence(F.lit(0), F.lit(size - 1))
    total = lambda f: F.aggregate(F.transform(places, f), F.lit(0.0), lambda t, v: t + v)
    re = lambda i, j: total(lambda k: cell("re", i, k) * cell("re", j, k) + cell("im", i, k) * cell("im", j, k))
    im = lambda i, j: total(lambda k: cell("im", i, k) * cell("re", j, k) - cell("re", i, k) * cell("im", j, k))
    return (F.transform(places, lambda i: F.transform(places, lambda j: re(i, j) + (i == j).cast("double"))),
            F.transform(places, lambda i: F.transform(places, lambda j: im(i, j))))
