"""Queries over intervals, frames and sparse arrays, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisflow.operators import aligned, frames, sparse
from axisflow.operators import intervals as I
from axisflow.sources import rttm, segments

from .registry import _AB, _X, HIGH, KEY, LOW, _merge, _norm, _segments, _spans, _t, _two, _vectors, query

AXIS = HIGH - LOW


def _moved(spans):
    """Spans on an axis that begins at LOW."""
    return spans.select("user_id", (F.col("start") - LOW).alias("start"), (F.col("stop") - LOW).alias("stop"))


def _compare_sql(keep):
    return _AB + f""",
u AS (SELECT DISTINCT user_id FROM (SELECT user_id FROM a UNION ALL SELECT user_id FROM b)),
p AS (SELECT DISTINCT user_id, x AS pos FROM (SELECT user_id, unnest([start, stop]) - {LOW} AS x FROM a UNION ALL SELECT user_id, unnest([start, stop]) - {LOW} FROM b UNION ALL SELECT user_id, unnest([0, {AXIS}]) FROM u) WHERE x BETWEEN 0 AND {AXIS}),
q AS (SELECT user_id, pos AS start, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS stop FROM p),
c AS (SELECT q.*, EXISTS (SELECT 1 FROM a WHERE a.user_id = q.user_id AND a.start - {LOW} <= q.start AND a.stop - {LOW} >= q.stop) AS ina,
             EXISTS (SELECT 1 FROM b WHERE b.user_id = q.user_id AND b.start - {LOW} <= q.start AND b.stop - {LOW} >= q.stop) AS inb FROM q WHERE stop IS NOT NULL),
k AS (SELECT user_id, start, stop FROM c WHERE {keep}),
""" + _merge("z", "k") + "\nSELECT * FROM z"


def _compare(spark, d, how):
    a, b = map(_moved, _two(spark, d))
    return I.compare(a, b, KEY, AXIS, how)


@query(_compare_sql("ina = inb"))
def interval_equal(spark, d):
    return _compare(spark, d, "eq")


@query(_compare_sql("ina <> inb"))
def interval_not_equal(spark, d):
    return _compare(spark, d, "ne")


@query(_compare_sql("NOT ina AND inb"))
def interval_less(spark, d):
    return _compare(spark, d, "lt")


@query(_compare_sql("NOT ina OR inb"))
def interval_less_equal(spark, d):
    return _compare(spark, d, "le")


@query(_compare_sql("ina AND NOT inb"))
def interval_greater(spark, d):
    return _compare(spark, d, "gt")


@query(_compare_sql("ina OR NOT inb"))
def interval_greater_equal(spark, d):
    return _compare(spark, d, "ge")


@query(_compare_sql("NOT ina"))
def interval_invert(spark, d):
    a, b = map(_moved, _two(spark, d))
    return I.invert(a, KEY, AXIS, a.select("user_id").unionByName(b.select("user_id")))


@query("WITH " + _norm("a") + f"\nSELECT user_id, round(sum(stop - start) / {AXIS}e0, 8) AS mean FROM a GROUP BY user_id")
def interval_mean(spark, d):
    return I.mean(_spans(spark, d), KEY, AXIS).withColumn("mean", F.round("mean", 8))


@query("SELECT r_regionkey, n.n_nationkey, CAST(0 AS BIGINT) AS start, CAST(100 AS BIGINT) AS stop FROM region JOIN nation n ON n.n_regionkey = r_regionkey")
def interval_ones_and_zeros(spark, d):
    keys = _t(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    by = ["r_regionkey", "n_nationkey"]
    return I.union(I.ones(keys, by, 100), I.zeros(keys, by), by)


@query("WITH " + _norm("a") + """,
p AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) - 3 * 3600 AS t FROM events)
SELECT event_id, user_id, t AS at, EXISTS (SELECT 1 FROM a WHERE a.user_id = p.user_id AND start <= t AND t < stop) AS inside FROM p""")
def interval_contains(spark, d):
    e = _t(spark, d, "events")
    points = e.select("event_id", "user_id", (F.unix_seconds(F.col("ts").cast("timestamp")) - 3 * 3600).alias("at"))
    return I.contains(points, _spans(spark, d), KEY)


def _hours(spark, d):
    """Bounds in whole hours from LOW, towards it on both sides, as of integer division in SQL."""
    s = _spans(spark, d)
    hour = lambda c: F.expr(f"({c} - {LOW}) div 3600").alias(c)
    return s.select("user_id", hour("start"), hour("stop"))


_HOURS = "WITH a_r AS (SELECT user_id, (CAST(floor(epoch(ts)) AS BIGINT) - %d) // 3600 AS start, (CAST(floor(epoch(ts)) AS BIGINT) - %d + 21600) // 3600 AS stop FROM events),\n" % (LOW, LOW) + _merge("a", "a_r")


@query(_HOURS + "\nSELECT u.user_id, CAST(i AS INTEGER) AS at, EXISTS (SELECT 1 FROM a WHERE a.user_id = u.user_id AND start <= i AND i < stop) AS value FROM (SELECT DISTINCT user_id FROM a WHERE start < 200) u, range(200) r(i)")
def interval_dense(spark, d):
    return I.dense(_hours(spark, d), KEY, 200).select("user_id", F.posexplode("values").alias("at", "value"))


@query(_HOURS + """,
w AS (SELECT user_id, start, least(stop, 100) AS stop FROM a UNION ALL SELECT user_id, greatest(start, 150), stop FROM a UNION ALL SELECT DISTINCT user_id, 100, 150 FROM a),
v AS (SELECT * FROM w WHERE start < stop),
""" + _merge("z", "v") + "\nSELECT * FROM z")
def interval_assign_ones(spark, d):
    return I.assign(_hours(spark, d), KEY, 100, 150, 1)


@query(_HOURS + """,
w AS (SELECT user_id, start, least(stop, 100) AS stop FROM a UNION ALL SELECT user_id, greatest(start, 150), stop FROM a UNION ALL SELECT user_id, start + 100, least(stop, 50) + 100 FROM a),
v AS (SELECT * FROM w WHERE start < stop),
""" + _merge("z", "v") + "\nSELECT * FROM z")
def interval_assign_other(spark, d):
    """What h holds before the axis is moved, too, to before the place 100."""
    h = _hours(spark, d)
    before = I.shift_pad(h.withColumn("stop", F.least("stop", F.lit(0))), KEY, 100)
    return I.union(I.assign(I.assign(h, KEY, 100, 150, 0), KEY, 100, 150, h), before, KEY)


@query(_HOURS + "\nSELECT user_id, string_agg(start || ':' || stop, ',' ORDER BY start) AS text, CAST(2000 AS BIGINT) AS length FROM a GROUP BY user_id")
def interval_serialize(spark, d):
    return I.to_serializable(I.within(_hours(spark, d), KEY, 2000), KEY, 2000)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(4 AS BIGINT), CAST(25 AS BIGINT)), (5, 20, 25), (22, 23, 25)) t(start, stop, length), (SELECT r_regionkey FROM region)")
def interval_parse(spark, d):
    texts = _t(spark, d, "region").select("r_regionkey", F.lit("1:4, 5:20, 22:23").alias("text"), F.lit(25).cast("long").alias("length"))
    return I.from_serializable(texts, ["r_regionkey"])


@query("SELECT r_regionkey, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM region, (VALUES (0, 4), (6, 10)) t(start, stop)")
def interval_from_pairs(spark, d):
    pairs = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((-20, 3), (2, 4), (-4, 99), (5, 5))))
    return I.from_pairs(_t(spark, d, "region").select("r_regionkey", pairs.alias("pairs")), ["r_regionkey"], 10)


@query("SELECT 'SPEAKER ' || user_id || ' 1 ' || (m // 1000000) || '.' || lpad(CAST(m % 1000000 AS VARCHAR), 6, '0') || ' 1.350000 <NA> <NA> ' || event_type || ' <NA> <NA>' AS line FROM (SELECT *, (CAST(floor(epoch(ts)) AS BIGINT) * 125 + 1) // 2 AS m FROM events)")
def rttm_lines(spark, d):
    e = _t(spark, d, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return rttm.to_lines(e.select(F.col("user_id").cast("string").alias("file_id"), F.col("event_type").alias("speaker"), start.alias("start"), (start + 21_600).alias("stop")), 16_000)


@query("SELECT CAST(user_id AS VARCHAR) AS file_id, event_type AS speaker, event_id * 8 AS start, event_id * 8 + 4000 AS stop FROM events")
def rttm_parse(spark, d):
    seconds = lambda c: (c.cast("decimal(20,4)") / 1000).cast("decimal(20,4)").cast("string")
    line = F.concat_ws(" ", F.lit("SPEAKER"), F.col("user_id"), F.lit("1"), seconds(F.col("event_id")), F.lit("0.5"), F.lit("<NA> <NA>"), F.col("event_type"), F.lit("<NA>  <NA>"))
    return rttm.parse_lines(_t(spark, d, "events").select(line.alias("line")), 8_000)


@query("SELECT CAST(user_id AS VARCHAR) AS file_id, 'u' || event_id AS utterance, event_id * 8 AS start, event_id * 8 + 4000 AS stop FROM events")
def segment_lines_parse(spark, d):
    seconds = lambda c: (c.cast("decimal(20,4)") / 1000).cast("decimal(20,4)").cast("string")
    line = F.concat_ws(" ", F.concat(F.lit("u"), F.col("event_id")), F.col("user_id"), seconds(F.col("event_id")), seconds(F.col("event_id") + 500))
    return segments.parse_lines(_t(spark, d, "events").select(line.alias("line")), 8_000)


@query("SELECT DISTINCT user_id, event_type FROM events")
def union_of_files(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type").distinct()
    return I.union_of_files([e.where(F.col("user_id") % 2 == 0), e.where(F.col("user_id") % 2 == 1)], "user_id").select("user_id", "event_type")


# ---- frames ----


def _framed(spark, d, expr):
    rows = _vectors(spark, d).select("vec_id", F.posexplode(expr).alias("frame", "v"))
    return rows.select("vec_id", "frame", F.posexplode("v").alias("at", "value"))


def _values(spark, d, expr):
    return _vectors(spark, d).select("vec_id", F.posexplode(expr).alias("at", "value")).withColumn("value", F.round("value", 8))


@query(_X + "SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(k AS INTEGER) AS at, CASE WHEN f * 4 + k - 6 BETWEEN 0 AND 63 THEN x[f * 4 + k - 5] ELSE 0 END AS value FROM e, range(18) r(f), range(10) s(k)")
def segment_axis_conv_pad(spark, d):
    return _framed(spark, d, frames.segment_axis(F.col("x"), 10, 4, "conv_pad"))


@query(_X + "SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(k AS INTEGER) AS at, x[(13 - f) * 4 + k + 1] AS value FROM e, range(14) r(f), range(12) s(k)")
def segment_axis_reversed(spark, d):
    return _framed(spark, d, frames.segment_axis(F.col("x"), 12, -4, None))


@query(_X + "SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(k AS INTEGER) AS at, x[(f * 4 + k) % 64 + 1] AS value FROM e, range(15) r(f), range(10) s(k)")
def segment_axis_wrap(spark, d):
    return _framed(spark, d, frames.segment_axis(F.col("x"), 10, 4, "pad", "wrap"))


def _padded_sql(place):
    return _X + f"SELECT vec_id, CAST(i + 5 AS INTEGER) AS at, round({place}, 8) AS value FROM e, range(-5, 68) r(i)"


@query(_padded_sql("CASE WHEN i BETWEEN 0 AND 63 THEN x[i + 1] ELSE 7 END"))
def pad_axis_constant(spark, d):
    return _values(spark, d, frames.pad_axis(F.col("x"), 5, 4, value=7.0))


@query(_padded_sql("x[least(greatest(i, 0), 63) + 1]"))
def pad_axis_edge(spark, d):
    return _values(spark, d, frames.pad_axis(F.col("x"), 5, 4, "edge"))


@query(_padded_sql("x[CASE WHEN i < 0 THEN -i WHEN i > 63 THEN 126 - i ELSE i END + 1]"))
def pad_axis_reflect(spark, d):
    return _values(spark, d, frames.pad_axis(F.col("x"), 5, 4, "reflect"))


@query(_padded_sql("x[CASE WHEN i < 0 THEN -1 - i WHEN i > 63 THEN 127 - i ELSE i END + 1]"))
def pad_axis_symmetric(spark, d):
    return _values(spark, d, frames.pad_axis(F.col("x"), 5, 4, "symmetric"))


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(CASE WHEN i < 60 THEN x[i + 5] ELSE 0 END, 8) AS value FROM e, range(64) r(i)")
def pad_to(spark, d):
    return _values(spark, d, frames.pad_to(F.slice("x", 5, 60), F.col("x")))


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(CASE WHEN i BETWEEN 3 AND 58 THEN x[i + 1] * 2 ELSE 0 END, 8) AS value FROM e, range(64) r(i)")
def cut_expand_overwrite(spark, d):
    both = F.zip_with(frames.expand(frames.cut(F.col("x"), 3, -5), 3, -5), frames.overwrite(F.col("x"), 3, -5), lambda a, b: a + b)
    return _values(spark, d, both)


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(max(x[least(greatest(i, 2), 61) + k + 1]), 8) AS value FROM e, range(64) r(i), range(-2, 3) s(k) GROUP BY vec_id, i")
def kernel_max_padded_after(spark, d):
    return _values(spark, d, frames.kernel(F.col("x"), 5, "max", position="post"))


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(avg(x[i + k + 1]), 8) AS value FROM e, range(60) r(i), range(5) s(k) GROUP BY vec_id, i")
def kernel_mean_inside(spark, d):
    return _values(spark, d, frames.kernel(F.col("x"), 5, "mean", padding=None))


def _eight(spark, d):
    """Eight frames of eight features."""
    return _vectors(spark, d).withColumn("f", frames.segment_axis(F.col("x"), 8, 8))


_MIRROR = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} > 7 THEN 15 - ({0}) ELSE {0} END"


@query(_X + f"SELECT vec_id, CAST(t AS INTEGER) AS frame, CAST(k * 8 + j AS INTEGER) AS at, x[CAST({_MIRROR.format('t * 2 + k - 2')} AS INTEGER) * 8 + j + 1] AS value FROM e, range(4) r(t), range(4) s(k), range(8) u(j)")
def stack_context_frames(spark, d):
    rows = _eight(spark, d).select("vec_id", F.posexplode(frames.stack_context(F.col("f"), 2, 1, 2)).alias("frame", "v"))
    return rows.select("vec_id", "frame", F.posexplode("v").alias("at", "value"))


@query(_X + "SELECT vec_id, CAST(t AS INTEGER) AS frame, CAST(j AS INTEGER) AS at, x[t * 8 + j + 1] AS value FROM e, range(8) r(t), range(8) u(j)")
def unstack_context_frames(spark, d):
    rows = _eight(spark, d).select("vec_id", F.posexplode(frames.unstack_context(frames.stack_context(F.col("f"), 2, 1), 2, 1)).alias("frame", "v"))
    return rows.select("vec_id", "frame", F.posexplode("v").alias("at", "value"))


@query(_X + "SELECT vec_id, CAST(t AS INTEGER) AS frame, CAST(p AS INTEGER) AS part, CAST(j AS INTEGER) AS feature, CAST(k AS INTEGER) AS place, CASE WHEN t + k - 1 BETWEEN 0 AND 7 THEN x[(t + k - 1) * 8 + p * 4 + j + 1] ELSE 0 END AS value FROM e, range(8) r(t), range(2) q(p), range(4) u(j), range(3) s(k)")
def add_context_planes(spark, d):
    rows = _eight(spark, d).select("vec_id", F.posexplode(frames.add_context(F.col("f"), 1, 1, parts=2)).alias("frame", "v"))
    rows = rows.select("vec_id", "frame", F.posexplode("v").alias("part", "v")).select("vec_id", "frame", "part", F.posexplode("v").alias("feature", "v"))
    return rows.select("vec_id", "frame", "part", "feature", F.posexplode("v").alias("place", "value"))


@query(_X + "SELECT vec_id, CAST(t AS INTEGER) AS frame, CAST(j AS INTEGER) AS at, CASE WHEN j < 8 THEN x[t * 8 + j + 1] ELSE -x[t * 8 + j - 7] END AS value FROM e, range(8) r(t), range(16) u(j)")
def split_complex(spark, d):
    minus = F.transform("f", lambda f: F.transform(f, lambda v: -v))
    rows = _eight(spark, d).select("vec_id", F.posexplode(frames.split_complex(F.col("f"), minus)).alias("frame", "v"))
    return rows.select("vec_id", "frame", F.posexplode("v").alias("at", "value"))


@query(_X + "SELECT vec_id, CAST(t AS INTEGER) AS frame, CAST(j AS INTEGER) AS at, x[t * 8 + j + 1] * x[t * 8 + j + 5] AS value FROM e, range(8) r(t), range(4) u(j)")
def merge_complex(spark, d):
    re, im = frames.merge_complex(F.col("f"))
    rows = _eight(spark, d).select("vec_id", F.posexplode(F.zip_with(re, im, lambda a, b: F.zip_with(a, b, lambda p, q: p * q))).alias("frame", "v"))
    return rows.select("vec_id", "frame", F.posexplode("v").alias("at", "value"))


@query(_X + "SELECT i % 8 AS \"F\", vec_id * 8 + i // 8 AS \"B*T\", x[i + 1] AS value FROM e, range(64) r(i)")
def morph_axes(spark, d):
    cells = _vectors(spark, d).select(F.col("vec_id").alias("B"), F.posexplode("x").alias("T*F", "value"))
    return frames.morph(cells, "B,T*F->F,B*T", {"F": 8, "T": 8})


# ---- sparse ----

_DENSE = _X + """, s AS (SELECT vec_id, CAST(i AS INTEGER) AS p, CASE WHEN i BETWEEN 5 AND 8 THEN x[i - 4] WHEN i BETWEEN 20 + vec_id % 7 AND 27 + vec_id % 7 THEN x[CAST(i - 15 - vec_id % 7 AS INTEGER)] END AS value FROM e, range(40) r(i))
"""


def _listed(df):
    return df.select("vec_id", F.posexplode("values").alias("at", "value"))


@query(_DENSE + "SELECT vec_id, p AS at, coalesce(value, 0) AS value FROM s WHERE p < 28 + vec_id % 7")
def sparse_open_axis(spark, d):
    return _listed(sparse.dense(sparse.from_arrays(_segments(spark, d), ["vec_id"]), ["vec_id"]))


@query(_DENSE + "SELECT vec_id, CAST(p - 6 AS INTEGER) AS at, coalesce(value, 0) AS value FROM s WHERE p BETWEEN 6 AND 24")
def sparse_slice(spark, d):
    return _listed(sparse.dense(sparse.cut(_segments(spark, d), ["vec_id"], 6, 25), ["vec_id"], 19))


@query(_DENSE + "SELECT vec_id, p AS at, coalesce(value * 3, -3) AS value FROM s WHERE p < 30")
def sparse_scale(spark, d):
    return _listed(sparse.dense(sparse.scale(_segments(spark, d), ["vec_id"], 3.0), ["vec_id"], 30, -3.0))


@query(_DENSE + "SELECT vec_id, p AS at, coalesce(value, CASE WHEN p BETWEEN 10 AND 12 THEN 1 ELSE 0 END) AS value FROM s WHERE p < 30")
def sparse_add(spark, d):
    iv = _vectors(spark, d).select("vec_id", F.lit(10).cast("long").alias("start"), F.lit(13).cast("long").alias("stop"))
    return _listed(sparse.dense(sparse.add(_segments(spark, d), sparse.from_intervals(iv, ["vec_id"]), ["vec_id"]), ["vec_id"], 30))


@query(_X + "SELECT vec_id, CAST(5 AS BIGINT) AS start, CAST(9 AS BIGINT) AS stop FROM e UNION ALL SELECT vec_id, 20 + vec_id % 7, 28 + vec_id % 7 FROM e")
def sparse_support(spark, d):
    return sparse.support(_segments(spark, d), ["vec_id"])


@query(_DENSE + "SELECT vec_id, coalesce(value, -1) AS value, 28 + vec_id % 7 AS length FROM s WHERE p = 22")
def sparse_value_and_length(spark, d):
    s = _segments(spark, d)
    return sparse.value_at(s, ["vec_id"], 22, -1.0).join(sparse.length_of(s, ["vec_id"]), "vec_id")


@query(_DENSE + "SELECT vec_id, p AS at, CASE WHEN p BETWEEN 7 AND 9 THEN p - 6 ELSE coalesce(value, 0) END AS value FROM s WHERE p < 35")
def sparse_assign(spark, d):
    return _listed(sparse.dense(sparse.assign(_segments(spark, d), ["vec_id"], 7, [1, 2, 3]), ["vec_id"], 35))


@query(_DENSE + "SELECT vec_id, p AS at, round(x[p + 1] * coalesce(value, 2), 8) AS value FROM s JOIN e USING (vec_id)")
def sparse_times_dense(spark, d):
    dense = _vectors(spark, d).select("vec_id", F.slice("x", 1, 40).alias("values"))
    return _listed(sparse.combine_dense(dense, _segments(spark, d), ["vec_id"], lambda a, b: a * b, 2.0)).withColumn("value", F.round("value", 8))


@query(_DENSE + "SELECT vec_id, CAST(p AS BIGINT) AS at, round(coalesce(value, 0) + CASE WHEN p BETWEEN 7 AND 22 THEN 10 ELSE 0 END, 8) AS value FROM s WHERE value IS NOT NULL OR p BETWEEN 7 AND 22")
def sparse_combine(spark, d):
    other = sparse.from_intervals(_vectors(spark, d).select("vec_id", F.lit(7).cast("long").alias("start"), F.lit(23).cast("long").alias("stop")), ["vec_id"], 10.0)
    return sparse.combine(_segments(spark, d), other, ["vec_id"], lambda a, b: a + b).withColumn("value", F.round("value", 8))


# ---- sparse arrays, combined by aligned segments ----

def _others(spark, d):
    """A segment a vector of seven values from 2 to 8 on, and one of four from 26 on."""
    x = _vectors(spark, d)
    first = x.select("vec_id", (2 + F.col("vec_id") % 7).alias("onset"), F.slice("x", 20, 7).alias("values"))
    return aligned.from_arrays(first.unionByName(x.select("vec_id", F.lit(26).cast("long").alias("onset"), F.slice("x", 40, 4).alias("values"))), ["vec_id"])


_OTHER = "o AS (SELECT vec_id, 2 + vec_id % 7 + i AS p, x[20 + i] AS other FROM e, range(7) r(i) UNION ALL SELECT vec_id, 26 + i, x[40 + i] FROM e, range(4) r(i))"
_BOTH = ", " + _OTHER + "\nSELECT vec_id, CAST(p AS BIGINT) AS at, round({}, 8) AS value FROM (SELECT * FROM s WHERE value IS NOT NULL) s FULL JOIN o USING (vec_id, p)"


def _places(seg):
    """For comparison only: a row a place."""
    each = F.when(F.size("values") == F.col("length"), F.col("values")).otherwise(F.array_repeat(F.get("values", F.lit(0)), F.col("length").cast("int")))
    rows = seg.select("vec_id", "onset", F.posexplode(each).alias("i", "value"))
    return rows.select("vec_id", (F.col("onset") + F.col("i")).alias("at"), F.round("value", 8).alias("value"))


def _mine(spark, d):
    return aligned.from_arrays(_segments(spark, d), ["vec_id"])


@query(_DENSE + _BOTH.format("coalesce(value, 1) - 2 * coalesce(other, 3)"))
def aligned_difference(spark, d):
    return _places(aligned.combine(_mine(spark, d), _others(spark, d), ["vec_id"], lambda a, b: a - 2 * b, (1.0, 3.0)))


@query(_DENSE + _BOTH.format("greatest(coalesce(value, 0), coalesce(other, 0))"))
def aligned_maximum(spark, d):
    return _places(aligned.combine(_mine(spark, d), _others(spark, d), ["vec_id"], F.greatest))


@query(_DENSE + "SELECT vec_id, CAST(p AS BIGINT) AS at, round(coalesce(value, 0) * CASE WHEN p BETWEEN 7 AND 22 THEN 10 ELSE 0.5 END, 8) AS value FROM s WHERE value IS NOT NULL OR p BETWEEN 7 AND 22")
def aligned_constants(spark, d):
    """Segments times a constant run."""
    iv = _vectors(spark, d).select("vec_id", F.lit(7).cast("long").alias("start"), F.lit(23).cast("long").alias("stop"))
    return _places(aligned.combine(_mine(spark, d), aligned.from_intervals(iv, ["vec_id"], 10.0), ["vec_id"], lambda a, b: a * b, (0.0, 0.5)))


@query(_DENSE + _BOTH.format("coalesce(value, 0) + coalesce(other, 0)").replace("SELECT vec_id, CAST(p", "SELECT vec_id, c AS channel, CAST(p").replace("coalesce(value, 0) + coalesce(other, 0)", "(coalesce(value, 0) + coalesce(other, 0)) * (c + 1)") + ", range(2) k(c)")
def aligned_channels(spark, d):
    """Two axes: the channels are the values and their double."""
    two = lambda s: s.withColumn("values", F.array("values", F.transform("values", lambda v: 2 * v)))
    found = aligned.combine(two(_mine(spark, d)), two(_others(spark, d)), ["vec_id"], lambda a, b: a + b, axes=2)
    each = found.select("vec_id", "onset", F.posexplode("values").alias("channel", "v")).select("vec_id", "onset", F.col("channel").cast("long").alias("channel"), F.posexplode("v").alias("i", "value"))
    return each.select("vec_id", "channel", (F.col("onset") + F.col("i")).alias("at"), F.round("value", 8).alias("value"))


@query(_DENSE + "SELECT vec_id, CAST(p - 3 AS INTEGER) AS at, round(coalesce(value * value, 4), 8) AS value FROM s WHERE p BETWEEN 3 AND 32")
def aligned_square_slice(spark, d):
    return _listed(aligned.dense(aligned.scalar(_mine(spark, d), ["vec_id"], lambda v: v * v), ["vec_id"], 3, 33, 4.0)).withColumn("value", F.round("value", 8))
