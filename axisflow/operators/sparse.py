"""Sparse arrays on an axis: rows (key.., onset, values) of disjoint segments; what they leave out is the pad value.

The length of the axis, or None for an open one, and the pad value are parameters: an array without rows is a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows(seg: DataFrame, by: list[str]) -> DataFrame:
    return seg.select(*by, F.col("onset").cast("long").alias("onset"), F.col("values").cast("array<double>").alias("values"))


def offset() -> Column:
    """The first place behind a segment."""
    return F.col("onset") + F.size("values")


def cut(seg: DataFrame, by: list[str], start: int = 0, stop: int | None = None) -> DataFrame:
    """The part in [start, stop), on an axis that begins at start."""
    rows = _rows(seg, by).where(offset() > start)
    rows = rows if stop is None else rows.where(F.col("onset") < stop)
    head = F.greatest(F.lit(start) - F.col("onset"), F.lit(0)).cast("int")
    end = offset() if stop is None else F.least(offset(), F.lit(stop))
    size = F.greatest(end - F.greatest("onset", F.lit(start)), F.lit(0)).cast("int")
    return rows.select(*by, (F.greatest("onset", F.lit(start)) - start).alias("onset"), F.slice("values", head + 1, size).alias("values")).where(F.size("values") > 0)


def checked(seg: DataFrame, by: list[str]) -> DataFrame:
    """The same rows; the job fails where two segments of a key overlap."""
    before = F.max(offset()).over(Window.partitionBy(*by).orderBy("onset", F.size("values")).rowsBetween(Window.unboundedPreceding, -1))
    rows = _rows(seg, by).withColumn("_before", before)
    sure = F.when(F.col("_before") > F.col("onset"), F.raise_error(F.lit("segments overlap")).cast("long")).otherwise(F.col("onset"))
    return rows.select(*by, sure.alias("onset"), "values")


def from_arrays(seg: DataFrame, by: list[str], length: int | None = None) -> DataFrame:
    """Checked segments from arrays and onsets, cut to [0, length)."""
    return checked(cut(seg, by, 0, length), by)


def from_intervals(iv: DataFrame, by: list[str], value: float = 1.0) -> DataFrame:
    """Segments of a constant."""
    return iv.select(*by, F.col("start").alias("onset"), F.array_repeat(F.lit(value), (F.col("stop") - F.col("start")).cast("int")).alias("values"))


def add(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The segments of both; they must not overlap."""
    return checked(_rows(a, by).unionByName(_rows(b, by)), by)


def scale(seg: DataFrame, by: list[str], factor: float) -> DataFrame:
    return _rows(seg, by).withColumn("values", F.transform("values", lambda v: v * factor))


def support(seg: DataFrame, by: list[str]) -> DataFrame:
    """Intervals that segments cover; touching ones merge."""
    from .intervals import normalize

    return normalize(_rows(seg, by).select(*by, F.col("onset").alias("start"), offset().alias("stop")), by)


def length_of(seg: DataFrame, by: list[str]) -> DataFrame:
    """The least length that holds all segments of each key."""
    return _rows(seg, by).groupBy(*by).agg(F.max(offset()).alias("length"))


def dense(seg: DataFrame, by: list[str], length: int | None = None, pad: float = 0.0) -> DataFrame:
    """(key.., values): whole arrays of keys that have a segment, pasted from gaps and segments in order; an open axis ends with the last one."""
    rows = _rows(seg, by) if length is None else cut(seg, by, 0, length)
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("onset", "values"))).alias("s"))
    gap = lambda n: F.array_repeat(F.lit(pad), n.cast("int"))
    end = lambda i: F.when(i > 0, F.get("s", i - 1)["onset"] + F.size(F.get("s", i - 1)["values"])).otherwise(F.lit(0))
    body = F.flatten(F.transform("s", lambda x, i: F.concat(gap(x["onset"] - end(i)), x["values"])))
    tail = F.array().cast("array<double>") if length is None else gap(F.lit(length) - end(F.size("s")))
    return packed.select(*by, F.concat(body, tail).alias("values"))


def value_at(seg: DataFrame, by: list[str], place: int, pad: float = 0.0) -> DataFrame:
    """(key.., value) of one place, for keys that have a segment."""
    inside = (F.col("onset") <= place) & (offset() > place)
    found = F.max(F.when(inside, F.get("values", (F.lit(place) - F.col("onset")).cast("int"))))
    return _rows(seg, by).groupBy(*by).agg(F.coalesce(found, F.lit(pad)).alias("value"))


def assign(seg: DataFrame, by: list[str], start: int, values: list[float]) -> DataFrame:
    """The segments with `values` put at start .. in every key that has one."""
    stop, rows = start + len(values), _rows(seg, by)
    before = cut(rows.where(F.col("onset") < start), by, 0, start)
    behind = cut(rows, by, stop).withColumn("onset", F.col("onset") + stop)
    new = rows.select(*by).distinct().select(*by, F.lit(start).cast("long").alias("onset"), F.array(*map(F.lit, map(float, values))).alias("values"))
    return before.unionByName(new).unionByName(behind)


def combine_dense(arrays: DataFrame, seg: DataFrame, by: list[str], func, pad: float = 0.0) -> DataFrame:
    """(key.., values): func(dense, sparse), slice by slice, for every key of arrays(key.., values)."""
    from . import aligned

    return aligned.combine_dense(arrays, aligned.from_arrays(seg, by), by, func, pad)


def combine(a: DataFrame, b: DataFrame, by: list[str], func, pads: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(key.., at, value): func of two sparse arrays at the places that one of them covers; the new pad is func of both pads.

    aligned.combine gives the same as segments, without a row for each place.
    """
    from . import aligned

    found = aligned.combine(aligned.from_arrays(a, by), aligned.from_arrays(b, by), by, func, pads)
    return found.select(*by, "onset", F.posexplode("values").alias("i", "value")).select(*by, (F.col("onset") + F.col("i")).alias("at"), "value")
