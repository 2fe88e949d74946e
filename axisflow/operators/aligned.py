"""Algebra of sparse arrays segment by segment: both sides are cut at their common bounds, and whole slices are combined.

A segment is a row (by.., onset, length, values): `length` values from `onset` on, or a single value that holds for all of them, so that
a constant run of any length is one number. With `axes=2` values are channels of such arrays. Segments of a key are disjoint; what they
leave out is the pad value. No row stands for a place: work and size follow the segments, not the axis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import LIMIT, cuts, free, joined, ranged, running, stored


def from_arrays(seg: DataFrame, by: list[str], axes: int = 1) -> DataFrame:
    """Segments of rows (by.., onset, values); empty arrays and rows with a null are left out."""
    kind = "array<double>" if axes == 1 else "array<array<double>>"
    rows = seg.select(*by, F.col("onset").cast("long").alias("onset"), F.col("values").cast(kind).alias("values"))
    size = F.size("values") if axes == 1 else F.size(F.get("values", F.lit(0)))
    return rows.select(*by, "onset", size.cast("long").alias("length"), "values").where("onset IS NOT NULL AND values IS NOT NULL AND length > 0")


def from_intervals(iv: DataFrame, by: list[str], value: float = 1.0) -> DataFrame:
    """A constant run for each interval; intervals of a key must be disjoint."""
    rows = iv.select(*by, F.col("start").cast("long").alias("onset"), (F.col("stop") - F.col("start")).cast("long").alias("length"))
    return rows.select(*by, "onset", "length", F.array(F.lit(value)).alias("values")).where("length > 0")


def _slice(values: Column, length: Column, start: Column, size: Column, axes: int) -> Column:
    """`size` values from place `start` of a segment; a run of one value stays one."""
    one = lambda v: F.when((F.size(v) == 1) & (length > 1), v).otherwise(F.slice(v, (start + 1).cast("int"), size.cast("int")))
    return one(values) if axes == 1 else F.transform(values, one)


def split(seg: DataFrame, places: DataFrame, by: list[str], axes: int = 1, limit: int = LIMIT) -> DataFrame:
    """The same segments, cut at those of places(by.., at) that lie inside them.

    Segments and places go along the axis together; a running number tells each place its segment, which then gets one list of cuts.
    """
    at, kind, nth, end, piece, inner = free([*by, "onset", "length", "values"], "at", "kind", "nth", "end", "piece", "cuts")
    light = seg.select(*by, F.col("onset").alias(at), (F.col("onset") + F.col("length")).alias(end), F.lit(1).alias(kind))
    marks = places.select(*by, F.col("at").cast("long").alias(at), F.lit(None).cast("long").alias(end), F.lit(0).alias(kind))
    both = light.unionByName(marks)
    parts = cuts(both.select(*by, at), by, at, limit)
    if parts is not None:
        both = stored(both)
    order = [at, F.col(kind).desc()]  # a place at an onset belongs to that segment, and does not cut it
    rows = running(ranged(both, by, at, parts, piece), by, order, {nth: kind}, piece if parts is not None else None)
    own = rows.groupBy(*by, nth).agg(F.max(F.when(F.col(kind) == 1, F.col(at))).alias("onset"), F.max(end).alias(end), F.array_sort(F.collect_set(F.when(F.col(kind) == 0, F.col(at)))).alias(inner))
    own = own.where("onset IS NOT NULL")
    inside = F.filter(inner, lambda x: (x > F.col("onset")) & (x < F.col(end)))
    edges = own.select(*by, "onset", F.concat(F.array("onset"), inside, F.array(end)).alias(inner))
    whole = joined(seg, edges, [*by, "onset"], how="inner")
    pieces = F.transform(F.slice(F.col(inner), F.lit(1), F.size(inner) - 1), lambda e, i: F.struct(
        e.alias("onset"), (F.get(inner, i + 1) - e).alias("length"),
        _slice(F.col("values"), F.col("length"), e - F.col("onset"), F.get(inner, i + 1) - e, axes).alias("values")))
    return whole.select(*by, F.explode(pieces).alias(piece)).select(*by, f"{piece}.onset", f"{piece}.length", f"{piece}.values")


def _zip(x: Column, y: Column, func: Callable[[Column, Column], Column]) -> Column:
    """func value by value; a run of one value meets all of the other side's."""
    return (F.when(F.size(x) == F.size(y), F.zip_with(x, y, lambda p, q: func(p, q))).when(F.size(x) == 1, F.transform(y, lambda v: func(F.get(x, F.lit(0)), v)))
            .otherwise(F.transform(x, lambda v: func(v, F.get(y, F.lit(0))))))


def combine(a: DataFrame, b: DataFrame, by: list[str], func: Callable[[Column, Column], Column], pads: tuple[float, float] = (0.0, 0.0), axes: int = 1, limit: int = LIMIT) -> DataFrame:
    """Segments of func(a, b) wherever one side has one; elsewhere the result is func of both pads, its new pad.

    With axes=2 both sides have the same channels. Keys of one side only meet the other's pad.
    """
    ends = lambda s: s.select(*by, F.explode(F.array("onset", F.col("onset") + F.col("length"))).alias("at"))
    x, y, length, other = free([*by, "onset"], "x", "y", "length", "other")
    left = split(a, ends(b), by, axes, limit).select(*by, "onset", F.col("length").alias(length), F.col("values").alias(x))
    right = split(b, ends(a), by, axes, limit).select(*by, "onset", F.col("length").alias(other), F.col("values").alias(y))
    names = dict(zip([*by, "onset"], free([*by, "onset", x, y, length, other], *(f"of_{c}" for c in [*by, "onset"])), strict=True))
    right = right.select(*(F.col(c).alias(n) for c, n in names.items()), other, y)
    same = None
    for c, n in names.items():
        one = F.col(c).eqNullSafe(F.col(n))
        same = one if same is None else same & one
    both = left.join(right, same, "full")
    missing = F.col(length).isNull()  # then the row is the right side's
    keys = [F.when(missing, F.col(n)).otherwise(F.col(c)).alias(c) for c, n in names.items()]

    def filled(own: str, from_: str, pad: float) -> Column:
        run = F.array(F.lit(pad))
        return F.coalesce(F.col(own), run if axes == 1 else F.transform(from_, lambda _: run))

    u, v = filled(x, y, pads[0]), filled(y, x, pads[1])
    values = _zip(u, v, func) if axes == 1 else F.zip_with(u, v, lambda p, q: _zip(p, q, func))
    return both.select(*keys, F.coalesce(length, other).alias("length"), values.alias("values"))


def scalar(seg: DataFrame, by: list[str], func: Callable[[Column], Column], axes: int = 1) -> DataFrame:
    """Segments of func of each value; the new pad is func of the pad."""
    values = F.transform("values", func) if axes == 1 else F.transform("values", lambda c: F.transform(c, func))
    return seg.select(*by, "onset", "length", values.alias("values"))


def combine_dense(arrays: DataFrame, seg: DataFrame, by: list[str], func: Callable[[Column, Column], Column], pad: float = 0.0) -> DataFrame:
    """(by.., values): func(dense, sparse) for every key of arrays(by.., values), slice by slice of the dense array."""
    held, dense = free([*by, "values"], "held", "dense")
    own = seg.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("onset", "length", "values"))).alias(held))
    rows = joined(arrays.select(*by, F.col("values").cast("array<double>").alias(dense)), own, by)
    n, s = F.size(dense).cast("long"), F.coalesce(F.col(held), F.array().cast("array<struct<onset:bigint,length:bigint,values:array<double>>>"))
    end = lambda i: F.when(i > 0, F.least(F.get(s, i - 1)["onset"] + F.get(s, i - 1)["length"], n)).otherwise(F.lit(0))
    take = lambda start, stop: F.slice(F.col(dense), (start + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))
    padded = lambda part: F.transform(part, lambda v: func(v, F.lit(pad)))

    def one(x: Column, i: Column) -> Column:
        start, stop = F.least(x["onset"], n), F.least(x["onset"] + x["length"], n)
        part = take(start, stop)
        values = F.when((F.size(x["values"]) == 1) & (x["length"] > 1), x["values"]).otherwise(F.slice(x["values"], F.lit(1), F.size(part)))
        return F.concat(padded(take(end(i), start)), F.when(F.size(part) > 0, _zip(part, values, func)).otherwise(F.array().cast("array<double>")))

    body = F.flatten(F.transform(s, one))
    return rows.select(*by, F.concat(body, padded(take(end(F.size(s)), n))).alias("values"))


def dense(seg: DataFrame, by: list[str], start: int, stop: int, pad: float = 0.0) -> DataFrame:
    """(by.., values): the places [start, stop) of every key that has a segment, as an array."""
    n = F.lit(stop - start).cast("long")
    part = seg.where((F.col("onset") < stop) & (F.col("onset") + F.col("length") > start))
    first = F.greatest(F.lit(start) - F.col("onset"), F.lit(0))
    size = F.least(F.col("onset") + F.col("length"), F.lit(stop)) - F.greatest("onset", F.lit(start))
    cut = part.select(*by, (F.greatest("onset", F.lit(start)) - start).alias("onset"), size.alias("length"), _slice(F.col("values"), F.col("length"), first, size, 1).alias("values"))
    keys = seg.select(*by).distinct().select(*by, F.array_repeat(F.lit(0.0), n.cast("int")).alias("values"))
    return combine_dense(keys, cut, by, lambda zero, value: value, pad)
