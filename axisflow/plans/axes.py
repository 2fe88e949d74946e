"""Queries over axes of known and unknown length, plain and complemented, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisflow.operators import axes as A
from axisflow.operators import intervals as I

from .arrays import AXIS, _moved
from .registry import KEY, LOW, _merge, _norm, _spans, _t, query

#: Lengths and flags by user: a third of the axes are open, half of the first and a fifth of the second are complements.
FIRST, SECOND = "user_id % 2 = 1", "user_id % 5 = 0"


def _axes(spark, d, kind, inverse, known=False):
    user = F.col("user_id")
    spans = I.cut(_moved(_spans(spark, d, kind)), KEY, 0, AXIS)
    length = F.lit(AXIS) if known else F.when(user % 3 != 0, AXIS)
    return A.axes(_t(spark, d, "events").select("user_id"), spans, KEY, length, F.expr(inverse))


def _both(spark, d):
    return _axes(spark, d, "click", FIRST), _axes(spark, d, "view", SECOND)


def _inside(name, kind):
    where = f"event_type = '{kind}'"
    return _norm(f"{name}_n", where) + f",\n{name} AS (SELECT user_id, greatest(start - {LOW}, 0) AS start, least(stop - {LOW}, {AXIS}) AS stop FROM {name}_n WHERE stop > {LOW} AND start < {LOW + AXIS})"


_USERS = f"u AS (SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN {AXIS} END AS length, {FIRST} AS inva, {SECOND} AS invb FROM (SELECT DISTINCT user_id FROM events))"
_PIECES = "WITH " + _inside("a", "click") + ",\n" + _inside("b", "view") + ",\n" + _USERS + """,
p AS (SELECT DISTINCT user_id, unnest([start, stop]) AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
q AS (SELECT user_id, pos AS start, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS stop FROM p),
c AS (SELECT q.*, length, inva, invb, EXISTS (SELECT 1 FROM a WHERE a.user_id = q.user_id AND a.start <= q.start AND a.stop >= q.stop) AS ina,
             EXISTS (SELECT 1 FROM b WHERE b.user_id = q.user_id AND b.start <= q.start AND b.stop >= q.stop) AS inb FROM q JOIN u USING (user_id) WHERE stop IS NOT NULL)"""


def _combined_sql(func):
    """The rows of spans with the flag and length of their axis, and those of axes without spans."""
    outer, value = func("inva", "invb"), func("(ina <> inva)", "(inb <> invb)")
    return _PIECES + f",\nk AS (SELECT user_id, start, stop FROM c WHERE ({value}) <> ({outer})),\n" + _merge("z", "k") + f"\nSELECT u.user_id, {outer} AS inverse, length, start, stop FROM u LEFT JOIN z USING (user_id)"


def _rows(a):
    return a.keys.join(a.spans, KEY, "left").select("user_id", "inverse", "length", "start", "stop")


def _combined(spark, d, how):
    return _rows(A.combine(*_both(spark, d), how))


@query(_combined_sql(lambda a, b: f"{a} OR {b}"))
def axis_or(spark, d):
    return _combined(spark, d, "or")


@query(_combined_sql(lambda a, b: f"{a} AND {b}"))
def axis_and(spark, d):
    return _combined(spark, d, "and")


@query(_combined_sql(lambda a, b: f"{a} <> {b}"))
def axis_xor(spark, d):
    return _combined(spark, d, "xor")


@query(_combined_sql(lambda a, b: f"{a} = {b}"))
def axis_equal(spark, d):
    return _combined(spark, d, "eq")


@query(_combined_sql(lambda a, b: f"NOT {a} AND {b}"))
def axis_less(spark, d):
    return _combined(spark, d, "lt")


@query(_combined_sql(lambda a, b: f"{a} OR NOT {b}"))
def axis_greater_equal(spark, d):
    return _combined(spark, d, "ge")


_A = "WITH " + _inside("a", "click") + ",\n" + _USERS


@query(_A + "\nSELECT u.user_id, NOT inva AS inverse, length, start, stop FROM u LEFT JOIN a USING (user_id)")
def axis_invert(spark, d):
    return _rows(A.invert(_axes(spark, d, "click", FIRST)))


@query(_A + f"""
SELECT u.user_id, CAST(CASE WHEN inva THEN {AXIS} - coalesce(n, 0) ELSE coalesce(n, 0) END AS BIGINT) AS total, round(CASE WHEN inva THEN {AXIS} - coalesce(n, 0) ELSE coalesce(n, 0) END / {AXIS}e0, 8) AS mean
FROM u LEFT JOIN (SELECT user_id, sum(stop - start) AS n FROM a GROUP BY user_id) USING (user_id)""")
def axis_total_and_mean(spark, d):
    a = _axes(spark, d, "click", FIRST, known=True)
    return A.total(a).join(A.mean(a), KEY).withColumn("mean", F.round("mean", 8))


@query(_A + """,
w AS (SELECT user_id, start, least(stop, 100000) AS stop FROM a UNION ALL SELECT user_id, greatest(start, 900000), stop FROM a UNION ALL SELECT user_id, 100000, 900000 FROM u WHERE NOT inva),
k AS (SELECT * FROM w WHERE start < stop),
""" + _merge("z", "k") + "\nSELECT u.user_id, inva AS inverse, length, start, stop FROM u LEFT JOIN z USING (user_id)")
def axis_assign_one(spark, d):
    return _rows(A.assign(_axes(spark, d, "click", FIRST), 100_000, 900_000, 1))


@query("WITH " + _inside("a", "click") + ",\n" + _inside("b", "view") + ",\n" + _USERS + """,
bp AS (SELECT user_id, start, least(stop, 800000) AS stop FROM b WHERE start < 800000),
bg AS (SELECT user_id, stop AS start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nxt FROM bp),
bc AS (SELECT user_id, start, coalesce(nxt, 800000) AS stop FROM bg UNION ALL SELECT user_id, 0, coalesce((SELECT min(start) FROM bp WHERE bp.user_id = u.user_id), 800000) FROM u),
v AS (SELECT user_id, start + 100000 AS start, stop + 100000 AS stop FROM bp JOIN u USING (user_id) WHERE inva = invb UNION ALL SELECT user_id, start + 100000, stop + 100000 FROM bc JOIN u USING (user_id) WHERE inva <> invb),
w AS (SELECT user_id, start, least(stop, 100000) AS stop FROM a UNION ALL SELECT user_id, greatest(start, 900000), stop FROM a UNION ALL SELECT * FROM v),
k AS (SELECT * FROM w WHERE start < stop),
""" + _merge("z", "k") + "\nSELECT u.user_id, inva AS inverse, length, start, stop FROM u LEFT JOIN z USING (user_id)")
def axis_assign_other(spark, d):
    a, b = _both(spark, d)
    return _rows(A.assign(a, 100_000, 900_000, b))


@query("WITH " + _inside("a", "click") + ",\n" + _USERS + f""",
p AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) - {LOW} AS t FROM events WHERE epoch(ts) >= {LOW} AND epoch(ts) < {LOW + AXIS})
SELECT event_id, user_id, t AS at, EXISTS (SELECT 1 FROM a WHERE a.user_id = p.user_id AND start <= t AND t < stop) <> inva AS value FROM p JOIN u USING (user_id)""")
def axis_values(spark, d):
    e = _t(spark, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp")) - LOW
    return A.values_at(e.select("event_id", "user_id", at.alias("at")).where((F.col("at") >= 0) & (F.col("at") < AXIS)), _axes(spark, d, "click", FIRST))


_FAR = f"SELECT user_id, CAST(i AS INTEGER) AS at, EXISTS (SELECT 1 FROM a WHERE a.user_id = u.user_id AND start <= {{0}} AND {{0}} < stop) <> inva AS value FROM u, range({{1}}) r(i)"


@query(_A + "\n" + _FAR.format("500000 + i", 40))
def axis_slice(spark, d):
    """A piece of open axes too."""
    return A.dense(_axes(spark, d, "click", FIRST), 500_000, 500_040).select("user_id", F.posexplode("values").alias("at", "value"))


@query(_A + "\n" + _FAR.format(f"{AXIS} - 60 + i", 60))
def axis_slice_from_end(spark, d):
    return A.dense(_axes(spark, d, "click", FIRST, known=True), -60, None).select("user_id", F.posexplode("values").alias("at", "value"))


@query(_A + """,
w AS (SELECT user_id, start + 500 AS start, stop + 500 AS stop FROM a UNION ALL SELECT user_id, 0, 500 FROM u WHERE inva UNION ALL SELECT user_id, length + 500, length + 800 FROM u WHERE inva AND length IS NOT NULL),
k AS (SELECT * FROM w WHERE start < stop),
""" + _merge("z", "k") + "\nSELECT u.user_id, inva AS inverse, length + 800 AS length, start, stop FROM u LEFT JOIN z USING (user_id)")
def axis_pad(spark, d):
    return _rows(A.pad(_axes(spark, d, "click", FIRST), 500, 300))


@query(_A + f""",
g AS (SELECT user_id, stop AS start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nxt FROM a),
i AS (SELECT user_id, start, coalesce(nxt, {AXIS}) AS stop FROM g UNION ALL SELECT user_id, 0, coalesce((SELECT min(start) FROM a WHERE a.user_id = u.user_id), {AXIS}) FROM u),
t AS (SELECT user_id, start, stop FROM a JOIN u USING (user_id) WHERE NOT inva UNION ALL SELECT user_id, start, stop FROM i JOIN u USING (user_id) WHERE inva AND start < stop)
SELECT u.user_id, coalesce(text, '') AS text, CAST({AXIS} AS BIGINT) AS length FROM u LEFT JOIN (SELECT user_id, string_agg(start || ':' || stop, ',' ORDER BY start) AS text FROM t GROUP BY user_id) USING (user_id)""")
def axis_text(spark, d):
    """Written, read and written again."""
    return A.to_text(A.from_text(A.to_text(_axes(spark, d, "click", FIRST, known=True)), KEY))
