"""Boolean axes with a length of their own, known or not, that may be stored as the complement of their spans.

A key's axis is one row of `keys` (by.., length, inverse) and rows of `spans` (by.., start, stop). Its value at a place is true inside spans,
or outside them if `inverse`. A null length means an open axis, which goes on for ever: true or false behind the last span. The algebra
is closed over both forms and moves no data to complement an axis; whatever needs an end fails for an open one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals as I
from .ranges import cuts, free, joined, ranged, running, stored

#: Both sides' booleans as logical operations and comparisons.
OPERATIONS = {"or": lambda a, b: a | b, "and": lambda a, b: a & b, "xor": lambda a, b: a != b} | I.COMPARE


@dataclass(frozen=True)
class Axes:
    """Keys are distinct; a null key is a key. Spans of keys that `keys` does not have are left out."""

    keys: DataFrame
    spans: DataFrame
    by: list[str]

    def _known(self, what: str) -> Column:
        """The length; the job fails for an open axis."""
        return F.when(F.col("length").isNull(), F.raise_error(F.lit(f"{what} needs the length of every axis")).cast("long")).otherwise(F.col("length"))

    def _with_keys(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        return joined(rows, self.keys, self.by, how=how)


def axes(keys: DataFrame, spans: DataFrame, by: list[str], length: Column | int | None = None, inverse: Column | bool = False) -> Axes:
    """Axes of the distinct keys with normalised spans; the job fails where a span begins before 0 or ends behind its axis."""
    side = keys.select(*by, (length if isinstance(length, Column) else F.lit(length)).cast("long").alias("length"), (inverse if isinstance(inverse, Column) else F.lit(inverse)).alias("inverse")).dropDuplicates(by)
    rows = joined(I.normalize(spans, by), side, by, how="inner")
    wrong = (F.col("start") < 0) | (F.col("stop") > F.col("length"))
    stop = F.when(wrong, F.raise_error(F.lit("a span lies outside its axis")).cast("long")).otherwise(F.col("stop"))
    return Axes(side, rows.select(*by, "start", stop.alias("stop")), by)


def zeros(keys: DataFrame, by: list[str], length: Column | int | None = None) -> Axes:
    """False everywhere."""
    return _constant(keys, by, length, False)


def ones(keys: DataFrame, by: list[str], length: Column | int | None = None) -> Axes:
    """True everywhere: the complement of no spans, whatever the length."""
    return _constant(keys, by, length, True)


def _constant(keys: DataFrame, by: list[str], length: Column | int | None, inverse: bool) -> Axes:
    none = keys.select(*by, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop")).where(F.lit(False))
    return axes(keys, none, by, length, inverse)


def invert(a: Axes) -> Axes:
    """The complement: only the flag turns."""
    return Axes(a.keys.withColumn("inverse", ~F.col("inverse")), a.spans, a.by)


def combine(a: Axes, b: Axes, how: str) -> Axes:
    """or, and, xor, eq, ne, lt, le, gt, ge, place by place, in one sweep over both sides' spans.

    The result's flag is the operation on both flags, and its spans are where the values differ from that. An open side takes the other's
    length; the job fails where two known lengths differ. A key of one side only meets an open axis of zeros.
    """
    func, by = OPERATIONS[how], a.by
    la, ia, ib = free([*by, "length", "inverse"], "own", "one", "other")
    mine = a.keys.select(*by, F.col("length").alias(la), F.col("inverse").alias(ia))
    theirs = b.keys.select(*by, "length", F.col("inverse").alias(ib))
    every = mine.select(*by).unionByName(theirs.select(*by)).distinct()
    both = joined(joined(every, mine, by), theirs, by)
    differ = F.raise_error(F.lit("axes of different lengths")).cast("long")
    length = F.when(F.col(la) != F.col("length"), differ).otherwise(F.coalesce(la, "length"))
    one, other = F.coalesce(ia, F.lit(False)), F.coalesce(ib, F.lit(False))
    keys = both.select(*by, length.alias("length"), func(one, other).alias("inverse"), one.alias(ia), other.alias(ib))
    names = free([*by, "start", "stop", "length", "inverse", la, ia, ib], "x", "y")
    levels, split = I._levels([a.spans, b.spans], by, names, I.LIMIT)
    rows = joined(levels, keys, by)
    value = func((F.col(names[0]) > 0) != F.col(ia), (F.col(names[1]) > 0) != F.col(ib))
    kept = rows.where((value != F.col("inverse")) & (F.col("start") < F.col("stop"))).select(*by, "start", "stop")
    return Axes(keys.select(*by, "length", "inverse"), I._merged(kept, by, split), by)


def plain(a: Axes) -> Axes:
    """The same values without complements; the job fails for an open complement, which has no end."""
    return Axes(a.keys.withColumn("inverse", F.lit(False)), _true_spans(a), a.by)


def _true_spans(a: Axes) -> DataFrame:
    """One ordered pass: an inverse axis has the gaps behind 0 and behind each of its spans, which are disjoint."""
    piece, nxt = free([*a.by, "start", "stop", "length", "inverse"], "piece", "nxt")
    zero = F.lit(0).cast("long")
    rows = a._with_keys(a.spans).select(*a.by, "start", "stop", "length", "inverse")
    rows = rows.unionByName(a.keys.where("inverse").select(*a.by, zero.alias("start"), zero.alias("stop"), "length", "inverse"))
    split = cuts(rows, a.by, "start")
    rows = running(ranged(rows, a.by, "start", split, piece), a.by, ["start", "stop"], {}, piece if split is not None else None, {nxt: "start"})
    gap = F.coalesce(F.col(nxt), a._known("an inverse axis"))
    found = rows.select(*a.by, F.when(F.col("inverse"), F.col("stop")).otherwise(F.col("start")).alias("start"), F.when(F.col("inverse"), gap).otherwise(F.col("stop")).alias("stop"))
    return found.where("start < stop")


def assign(a: Axes, start: int, stop: int | None, value: int | Axes) -> Axes:
    """The axes with [start, stop) set to 0, to 1, or to another one's first stop - start values; bounds count from the end if negative.

    Bounds end at the axis. A negative bound or no stop needs the length, another axis a stop.
    """
    by = a.by
    lo, hi = free([*by, "length", "inverse", "start", "stop"], "lo", "hi")
    keys = _bounded(a, start, stop, lo, hi)
    spans = joined(a.spans, keys, by, how="inner")
    left, right = spans.withColumn("stop", F.least("stop", lo)), spans.withColumn("start", F.greatest("start", hi))
    outside = left.unionByName(right).where("start < stop").select(*by, "start", "stop")
    if isinstance(value, Axes):
        theirs = _true_of(value, keys.select(*by, F.lit(0).cast("long").alias(lo), (F.col(hi) - F.col(lo)).alias(hi)), lo, hi)
        moved = joined(theirs, keys.select(*by, lo, hi, "inverse"), by, how="inner").select(*by, (F.col("start") + F.col(lo)).alias("start"), (F.col("stop") + F.col(lo)).alias("stop"), "inverse")
        window = keys.where("inverse").select(*by, F.col(lo).alias("start"), F.col(hi).alias("stop"))
        put = moved.where(~F.col("inverse")).select(*by, "start", "stop").unionByName(I.difference(window, moved.where("inverse").select(*by, "start", "stop"), by))
    else:
        put = keys.where(F.col("inverse") != F.lit(bool(value))).select(*by, F.col(lo).alias("start"), F.col(hi).alias("stop"))
    return Axes(a.keys, I.normalize(outside.unionByName(put), by), by)


def _bounded(a: Axes, start: int | None, stop: int | None, lo: str, hi: str) -> DataFrame:
    """keys with the bounds of a slice, which follow the rules of array slices."""
    def bound(x: int | None, open_: Column) -> Column:
        if x is None:
            return open_
        return F.greatest(a._known("a place from the end") + x, F.lit(0)) if x < 0 else F.least(F.lit(x), F.coalesce("length", F.lit(x)))

    rows = a.keys.withColumn(lo, bound(start, F.lit(0)).cast("long"))
    rows = rows.withColumn(hi, bound(stop, a._known("a slice without a stop")).cast("long"))
    return rows.withColumn(hi, F.greatest(lo, hi))


def _true_of(a: Axes, keys: DataFrame, lo: str, hi: str) -> DataFrame:
    """The true spans inside [lo, hi) of each key, where `keys` has these columns."""
    flagged = joined(joined(a.spans, a.keys.select(*a.by, "inverse"), a.by, how="inner"), keys.select(*a.by, lo, hi), a.by, how="inner")
    inside = flagged.select(*a.by, F.greatest("start", lo).alias("start"), F.least("stop", hi).alias("stop"), "inverse").where("start < stop")
    window = joined(keys.select(*a.by, lo, hi), a.keys.select(*a.by, "inverse"), a.by, how="inner").where("inverse").select(*a.by, F.col(lo).alias("start"), F.col(hi).alias("stop"))
    rest = I.difference(window, inside.where("inverse").select(*a.by, "start", "stop"), a.by)
    return inside.where(~F.col("inverse")).select(*a.by, "start", "stop").unionByName(rest)


def cut(a: Axes, start: int | None, stop: int | None) -> Axes:
    """The axes' part in [start, stop), by the rules of array slices, on axes of its own that are as long as the part and not inverse."""
    lo, hi = free([*a.by, "length", "inverse", "start", "stop"], "lo", "hi")
    keys = _bounded(a, start, stop, lo, hi)
    rows = joined(_true_of(a, keys, lo, hi), keys.select(*a.by, lo), a.by, how="inner")
    moved = rows.select(*a.by, (F.col("start") - F.col(lo)).alias("start"), (F.col("stop") - F.col(lo)).alias("stop"))
    return Axes(keys.select(*a.by, (F.col(hi) - F.col(lo)).alias("length"), F.lit(False).alias("inverse")), moved, a.by)


def dense(a: Axes, start: int | None = None, stop: int | None = None) -> DataFrame:
    """(by.., values): the booleans of [start, stop) of every key, also of those without spans."""
    part = cut(a, start, stop)
    runs = part.spans.groupBy(*a.by).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    rows = joined(part.keys, runs, a.by)
    r = F.coalesce("runs", F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    return rows.select(*a.by, I.pasted(r, F.col("length")).alias("values"))


def values_at(places: DataFrame, a: Axes, at: str = "at") -> DataFrame:
    """places with `value`: the boolean of the axis of the same key; a negative place counts from the end.

    The job fails for a place outside a known length, and for a negative one on an open axis. Places without a key's axis have null values.
    """
    length, inverse, place = free([*places.columns, "inside"], "length", "inverse", "place")
    keys = a.keys.select(*a.by, F.col("length").alias(length), F.col("inverse").alias(inverse))
    rows = joined(places, keys, a.by)
    here = F.when(F.col(at) < 0, F.col(at) + F.col(length)).otherwise(F.col(at))
    bad = (F.col(at) < 0) & F.col(length).isNull() & F.col(inverse).isNotNull() | (here < 0) | (here >= F.col(length))
    rows = rows.withColumn(place, F.when(bad, F.raise_error(F.lit("a place outside its axis")).cast("long")).otherwise(here.cast("long")))
    found = I.contains(rows, a.spans, a.by, place)
    return found.withColumn("value", F.when(F.col(place).isNotNull(), F.col("inside") != F.col(inverse))).drop("inside", length, inverse, place)


def total(a: Axes) -> DataFrame:
    """(by.., total): the number of true places of every key; the job fails for an open complement."""
    n, = free([*a.by, "length", "inverse"], "n")
    covered = joined(a.keys, a.spans.groupBy(*a.by).agg(F.sum(F.col("stop") - F.col("start")).alias(n)), a.by)
    covered = covered.withColumn(n, F.coalesce(n, F.lit(0)))
    return covered.select(*a.by, F.when(F.col("inverse"), a._known("the total of an inverse axis") - F.col(n)).otherwise(F.col(n)).cast("long").alias("total"))


def mean(a: Axes) -> DataFrame:
    """(by.., mean): the share of true places; the job fails for open axes; null for axes of length 0."""
    rows = joined(total(a), a.keys.select(*a.by, a._known("a mean").alias("length")), a.by)
    return rows.select(*a.by, (F.col("total") / F.when(F.col("length") > 0, F.col("length"))).alias("mean"))


def pad(a: Axes, before: int, after: int) -> Axes:
    """False places on both sides; an open axis has no other side, so `after` does nothing to it."""
    keys = a.keys.withColumn("length", F.col("length") + before + after)
    spans = a.spans.select(*a.by, (F.col("start") + before).alias("start"), (F.col("stop") + before).alias("stop"))
    flagged = keys.where("inverse")
    head = flagged.select(*a.by, F.lit(0).cast("long").alias("start"), F.lit(before).cast("long").alias("stop"))
    tail = flagged.where("length IS NOT NULL").select(*a.by, (F.col("length") - after).alias("start"), F.col("length").alias("stop"))
    return Axes(keys, I.normalize(spans.unionByName(head).unionByName(tail), a.by), a.by)


def to_text(a: Axes) -> DataFrame:
    """(by.., text, length): the true spans as `start:stop` joined by commas; the job fails for an open complement."""
    return joined(a.keys.select(*a.by, "length"), I.texts_of(_true_spans(a), a.by), a.by).select(*a.by, F.coalesce("text", F.lit("")).alias("text"), "length")


def from_text(texts: DataFrame, by: list[str]) -> Axes:
    """Axes of rows (by.., text, length), as to_text writes them; the job fails for malformed text. The rows are stored, since keys and spans both come of them."""
    texts = stored(texts.select(*by, "text", "length"))
    return axes(texts.select(*by, "length"), I.from_text(texts, by), by, F.col("length"))
