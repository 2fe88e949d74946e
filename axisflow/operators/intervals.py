"""Interval algebra on an integer axis: half-open [start, stop), touching intervals merge.

All operators take DataFrames with the key columns named by `by` and long columns start, stop. Rows with a null bound or
without length are left out; a null key is a key like others. Work is done by windows and aggregates inside (key, range of the axis):
only keys of more than ranges.LIMIT rows have more than one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import LIMIT, cuts, free, joined, ranged, running, stored


def _valid(iv: DataFrame, by: list[str]) -> DataFrame:
    return iv.select(*by, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).where("start < stop")


def normalize(iv: DataFrame, by: list[str], limit: int = LIMIT) -> DataFrame:
    """Disjoint, sorted intervals with the same points; touching ones merge.

    A key of more than `limit` intervals is merged inside ranges of its axis. Then a range's first intervals may touch what earlier ranges
    reach: one row a range carries that reach, and they join the interval that it comes from.
    """
    rows = _valid(iv, by)
    return _merged(rows, by, cuts(rows, by, "start", limit))


def _merged(rows: DataFrame, by: list[str], parts: DataFrame | None) -> DataFrame:
    piece, new, island, top, last = free(by, "piece", "new", "island", "top", "last")
    rows = ranged(rows, by, "start", parts, piece)
    order = Window.partitionBy(*by, piece).orderBy("start", "stop") if parts is not None else Window.partitionBy(*by).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn(new, (reach.isNull() | (F.col("start") > reach)).cast("int"))
    rows = rows.withColumn(island, F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if parts is None:
        return rows.groupBy(*by, island).agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop(island)
    here = stored(rows.groupBy(*by, piece, island).agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop(island))
    before = Window.partitionBy(*by).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    tops = here.groupBy(*by, piece).agg(F.max("stop").alias(top)).select(*by, piece, F.max(top).over(before).alias(top))
    flagged = joined(here, tops, [*by, piece]).withColumn(new, F.col(top).isNull() | (F.col("start") > F.col(top))).drop(top)
    heads = flagged.groupBy(*by, piece).agg(F.max(F.when(F.col(new), F.col("start"))).alias(last)).select(*by, piece, F.max(last).over(before).alias(last))
    named = joined(flagged, heads, [*by, piece]).withColumn(last, F.when(F.col(new), F.col("start")).otherwise(F.col(last)))
    return named.groupBy(*by, last).agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop(last)


def complement(iv: DataFrame, by: list[str], length: int, start: int = 0) -> DataFrame:
    """The points of [start, length) in no interval, for keys that have a row."""
    clipped = _valid(iv, by).select(*by, F.greatest("start", F.lit(start)).alias("start"), F.least("stop", F.lit(length)).alias("stop"))
    ends = iv.select(*by).distinct().withColumn("e", F.explode(F.array(F.lit(start).cast("long"), F.lit(length).cast("long")))).select(*by, F.col("e").alias("start"), F.col("e").alias("stop"))
    rows = normalize(clipped.where("start < stop"), by).unionByName(ends)
    order = Window.partitionBy(*by).orderBy("start", "stop")
    return rows.withColumn("_next", F.lead("start").over(order)).select(*by, F.col("stop").alias("start"), F.col("_next").alias("stop")).where("start < stop")


def _steps(parts: list[DataFrame], by: list[str], names: list[str]) -> DataFrame:
    """(by.., at, a column of names for each part): by how much the number of its open intervals changes at each bound."""
    steps = None
    for i, part in enumerate(parts):
        v = _valid(part, by)
        for bound, step in (("start", 1), ("stop", -1)):
            rows = v.select(*by, F.col(bound).alias("at"), *(F.lit(step if i == j else 0).alias(n) for j, n in enumerate(names)))
            steps = rows if steps is None else steps.unionByName(rows)
    return steps.groupBy(*by, "at").agg(*(F.sum(n).alias(n) for n in names))


def _levels(parts: list[DataFrame], by: list[str], names: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(by.., start, stop, names): how many intervals of each part are open between neighbouring bounds; and the cuts of the axis."""
    piece, *level = free([*by, "at", "stop", *names], "piece", *(f"open_{n}" for n in names))
    steps = _steps(parts, by, names)
    split = cuts(steps, by, "at", limit)
    if split is not None:
        steps = stored(steps)
    steps = ranged(steps, by, "at", split, piece)
    rows = running(steps, by, ["at"], dict(zip(level, names, strict=True)), piece if split is not None else None, {"stop": "at"})
    return rows.select(*by, F.col("at").alias("start"), "stop", *(F.col(x).alias(n) for x, n in zip(level, names, strict=True))), split


def sweep(parts: list[DataFrame], by: list[str], keep, limit: int = LIMIT) -> DataFrame:
    """The points where keep(covers) holds, covers being one boolean column an input: union, intersection, xor, equality, difference.

    Each input's bounds become +1 and -1 steps, and running sums give the coverage between steps, in one pass over all of them.
    """
    names = free(by, *(f"part{i}" for i in range(len(parts))))
    levels, split = _levels(parts, by, names, limit)
    kept = levels.where(keep(*(F.col(n) > 0 for n in names))).where("start < stop").select(*by, "start", "stop")
    return _merged(kept, by, split)


def union(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return normalize(a.select(*by, "start", "stop").unionByName(b.select(*by, "start", "stop")), by)


def intersection(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return sweep([a, b], by, lambda x, y: x & y)


def xor(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    return sweep([a, b], by, lambda x, y: x != y)


def difference(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Points of a that are not in b, also where bounds are shared."""
    return sweep([a, b], by, lambda x, y: x & ~y)


def shift_pad(iv: DataFrame, by: list[str], before: int) -> DataFrame:
    """As if `before` false points stood before the axis."""
    return _valid(iv, by).withColumns({"start": F.col("start") + before, "stop": F.col("stop") + before})


def cut(iv: DataFrame, by: list[str], start: int, stop: int) -> DataFrame:
    """The part in [start, stop), on an axis that begins at start."""
    rows = _valid(iv, by).where((F.col("stop") > start) & (F.col("start") < stop))
    return rows.select(*by, (F.greatest("start", F.lit(start)) - start).alias("start"), (F.least("stop", F.lit(stop)) - start).alias("stop"))


def dilate(iv: DataFrame, by: list[str], size: int) -> DataFrame:
    """Maximum over windows of an odd size: bounds move outward by size // 2, not below 0."""
    h = size // 2
    return normalize(_valid(iv, by).withColumns({"start": F.greatest(F.col("start") - h, F.lit(0)), "stop": F.col("stop") + h}), by)


def erode(iv: DataFrame, by: list[str], size: int) -> DataFrame:
    """Minimum over windows of an odd size: bounds of merged intervals move inward by size // 2, at borders too."""
    h = size // 2
    return normalize(iv, by).withColumns({"start": F.col("start") + h, "stop": F.col("stop") - h}).where("start < stop")


def total(iv: DataFrame, by: list[str]) -> DataFrame:
    return normalize(iv, by).groupBy(*by).agg(F.sum(F.col("stop") - F.col("start")).alias("total"))


def concurrency(iv: DataFrame, by: list[str], limit: int = LIMIT) -> DataFrame:
    """How long exactly `level` intervals are open at once, for level > 0."""
    rows, _ = _levels([iv], by, ["level"], limit)
    return rows.where("level > 0 AND stop > start").groupBy(*by, "level").agg(F.sum(F.col("stop") - F.col("start")).alias("duration"))


def to_text(iv: DataFrame, by: list[str]) -> DataFrame:
    """One text a key, `start:stop` joined by commas in order."""
    return texts_of(normalize(iv, by), by)


def texts_of(merged: DataFrame, by: list[str]) -> DataFrame:
    """to_text of intervals that are disjoint and do not touch."""
    item = F.array_sort(F.collect_list(F.struct("start", "stop")))
    return merged.groupBy(*by).agg(F.array_join(F.transform(item, lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("text"))


def from_text(texts: DataFrame, by: list[str], column: str = "text") -> DataFrame:
    """Intervals from `start:stop` pieces joined by commas, blanks allowed around them; the job fails for anything else."""
    piece, sides = free(by, "piece", "sides")
    parts = texts.select(*by, F.explode(F.split(F.regexp_replace(F.col(column), r"\s", ""), ",")).alias(piece)).where(F.col(piece) != "")
    sure = F.when(F.col(piece).rlike("^-?[0-9]+:-?[0-9]+$"), F.split(piece, ":")).otherwise(F.raise_error(F.concat(F.lit("not an interval: "), piece)).cast("array<string>"))
    parts = parts.select(*by, sure.alias(sides))
    return parts.select(*by, F.col(sides)[0].cast("long").alias("start"), F.col(sides)[1].cast("long").alias("stop"))


def run_lengths(rows: DataFrame, by: list[str], order: list[str], flag) -> DataFrame:
    """Intervals of the 0-based places, in `order`, where `flag` holds."""
    w = Window.partitionBy(*by).orderBy(*order)
    placed = rows.withColumns({"_at": F.row_number().over(w) - 1, "_on": flag}).where("_on")
    runs = placed.withColumn("_run", F.col("_at") - F.row_number().over(w))
    return runs.groupBy(*by, "_run").agg(F.min("_at").cast("long").alias("start"), (F.max("_at") + 1).cast("long").alias("stop")).drop("_run")


# ---- with the length of the axis: [0, length) ----


def _all(keys: DataFrame, by: list[str], length: int) -> DataFrame:
    """Ones: the whole axis for every key; zeros are no rows."""
    return keys.select(*by).distinct().select(*by, F.lit(0).cast("long").alias("start"), F.lit(length).cast("long").alias("stop"))


def ones(keys: DataFrame, by: list[str], length: int) -> DataFrame:
    return _all(keys, by, length)


def zeros(keys: DataFrame, by: list[str]) -> DataFrame:
    return keys.select(*by, F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop")).where("start < stop")


def invert(iv: DataFrame, by: list[str], length: int, keys: DataFrame | None = None) -> DataFrame:
    """What iv leaves of [0, length), also for keys that only `keys` has."""
    return difference(_all(iv if keys is None else keys, by, length), iv, by)


COMPARE = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: ~a & b, "le": lambda a, b: ~a | b,
    "gt": lambda a, b: a & ~b, "ge": lambda a, b: a | ~b,
}


def compare(a: DataFrame, b: DataFrame, by: list[str], length: int, how: str) -> DataFrame:
    """The places of [0, length) where the booleans compare so, for keys of either side; one sweep."""
    keys = a.select(*by).unionByName(b.select(*by)).distinct()
    return sweep([_all(keys, by, length), a, b], by, lambda axis, x, y: axis & COMPARE[how](x, y))


def mean(iv: DataFrame, by: list[str], length: int) -> DataFrame:
    """The share of [0, length) that is active."""
    return total(iv, by).select(*by, (F.col("total") / length).alias("mean"))


def contains(points: DataFrame, iv: DataFrame, by: list[str], at: str = "at", limit: int = LIMIT) -> DataFrame:
    """points with `inside`: whether an interval of the same key holds the place.

    Points and bounds go along the axis together: a point is inside where more intervals have begun than ended, so the work is a sort.
    A point without a place is not inside; repeated points stay.
    """
    place, kind, row, step, level, piece = free(by, "place", "kind", "row", "step", "level", "piece")
    steps = _steps([iv], by, [step]).select(*by, F.col("at").alias(place), step, F.lit(0).alias(kind))
    asked = points.select(*by, F.col(at).cast("long").alias(place), F.lit(0).cast("long").alias(step), F.lit(1).alias(kind), F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias(row))
    both = steps.withColumn(row, F.lit(None).cast(asked.schema[row].dataType)).unionByName(asked)
    split = cuts(both.select(*by, place), by, place, limit)
    if split is not None:
        both = stored(both)
    done = running(ranged(both, by, place, split, piece), by, [place, kind], {level: step}, piece if split is not None else None)
    return done.where(F.col(kind) == 1).select(f"{row}.*", F.coalesce(F.col(level) > 0, F.lit(False)).alias("inside"))


def pasted(runs: Column, length: Column) -> Column:
    """array<boolean> of `length` from ascending, disjoint structs (start, stop) inside it."""
    end = lambda i: F.when(i > 0, F.get(runs, i - 1)["stop"]).otherwise(F.lit(0))
    repeat = lambda v, n: F.array_repeat(F.lit(v), n.cast("int"))
    body = F.flatten(F.transform(runs, lambda x, i: F.concat(repeat(False, x["start"] - end(i)), repeat(True, x["stop"] - x["start"]))))
    return F.concat(body, repeat(False, length - end(F.size(runs))))


def dense(iv: DataFrame, by: list[str], length: int) -> DataFrame:
    """(key.., values): the whole boolean array of each key that has an interval before the end of the axis, even if that ends before 0."""
    inside = lambda c: F.greatest(F.least(c, F.lit(length)), F.lit(0)).cast("long").alias(c)
    runs, = free(by, "runs")
    rows = normalize(iv, by).where(F.col("start") < length).select(*by, F.struct(inside("start"), inside("stop")).alias(runs))
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(runs)).alias(runs)).select(*by, pasted(F.col(runs), F.lit(length)).alias("values"))


def assign(iv: DataFrame, by: list[str], start: int, stop: int, value: int | DataFrame) -> DataFrame:
    """The intervals with [start, stop) set to 1, to 0, or to those of another table, moved to begin at start."""
    rows = _valid(iv, by)
    left, right = rows.withColumn("stop", F.least("stop", F.lit(start))), rows.withColumn("start", F.greatest("start", F.lit(stop)))
    out = left.unionByName(right).where("start < stop")
    if isinstance(value, DataFrame):
        out = out.unionByName(shift_pad(cut(value, by, 0, stop - start), by, start))
    elif value:
        out = out.unionByName(iv.select(*by).distinct().select(*by, F.lit(start).cast("long").alias("start"), F.lit(stop).cast("long").alias("stop")))
    return normalize(out, by)


def pad(iv: DataFrame, by: list[str], length: int, before: int, after: int) -> tuple[DataFrame, int]:
    """The intervals and the length after false points were put on both sides."""
    return shift_pad(iv, by, before), length + before + after


def within(iv: DataFrame, by: list[str], length: int) -> DataFrame:
    """The same intervals; the job fails where one ends behind the axis."""
    stop = F.when(F.col("stop") > length, F.raise_error(F.lit("an interval ends behind the axis")).cast("long")).otherwise(F.col("stop"))
    return _valid(iv, by).withColumn("stop", stop)


def to_serializable(iv: DataFrame, by: list[str], length: int | None) -> DataFrame:
    """(key.., text, length), from which from_serializable restores the intervals."""
    return to_text(iv, by).withColumn("length", F.lit(length).cast("long"))


def from_serializable(texts: DataFrame, by: list[str]) -> DataFrame:
    """(key.., start, stop, length); the job fails for malformed text."""
    return from_text(texts, [*by, "length"]).select(*by, "start", "stop", "length")


def from_pairs(pairs: DataFrame, by: list[str], length: int, column: str = "pairs") -> DataFrame:
    """Intervals from arrays of (start, stop); negative bounds count from the end, and bounds stay in [0, length]."""
    bound = lambda x: F.least(F.greatest(F.when(x < 0, x + length).otherwise(x), F.lit(0)), F.lit(length)).cast("long")
    each = pairs.select(*by, F.explode(column).alias("p"))
    return normalize(each.select(*by, bound(F.col("p")[0]).alias("start"), bound(F.col("p")[1]).alias("stop")), by)


def union_of_files(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all tables; the job fails where two of them have one key."""
    rows = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    seen = rows.groupBy(key).agg(F.countDistinct("_part").alias("_parts")).withColumn("_ok", F.assert_true(F.col("_parts") == 1, "a key is in two tables"))
    return rows.join(seen.where(F.col("_ok").isNull()).select(key), key).drop("_part")
