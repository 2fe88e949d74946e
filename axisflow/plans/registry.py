"""Queries over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisflow.functions import vectors as V
from axisflow.operators import features, frames, nested, sparse, spectral, tables
from axisflow.operators import intervals as I
from axisflow.sources import rttm
from axisflow.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPAN = 21_600
KEY = ["user_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(spark, sf_dir, kind=None):
    e = _t(spark, sf_dir, "events")
    e = e.where(F.col("event_type") == kind) if kind else e
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select("user_id", start.alias("start"), (start + SPAN).alias("stop"))


def _vectors(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _segments(spark, sf_dir):
    """Two segments a vector, at 5 and at 20 to 26; the second may end behind 30."""
    x = _vectors(spark, sf_dir)
    first = x.select("vec_id", F.lit(5).cast("long").alias("onset"), F.slice("x", 1, 4).alias("values"))
    return first.unionByName(x.select("vec_id", (20 + F.col("vec_id") % 7).alias("onset"), F.slice("x", 5, 8).alias("values")))


# ---- SQL parts ----

def _raw(name, where="TRUE"):
    return f"{name}_r AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + {SPAN} AS stop FROM events WHERE {where})"


def _merge(out, source):
    return f"""{out}_m AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{out}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM {out}_m),
{out} AS (SELECT user_id, min(start) AS start, max(stop) AS stop FROM {out}_i GROUP BY user_id, island)"""


def _norm(name, where="TRUE"):
    return _raw(name, where) + ",\n" + _merge(name, f"{name}_r")


_AB = "WITH " + _norm("a", "event_type = 'click'") + ",\n" + _norm("b", "event_type = 'view'")


def _sweep_sql(keep):
    return _AB + f""",
p AS (SELECT DISTINCT user_id, x AS pos FROM (SELECT user_id, unnest([start, stop]) AS x FROM a UNION ALL SELECT user_id, unnest([start, stop]) FROM b)),
q AS (SELECT user_id, pos AS start, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS stop FROM p),
c AS (SELECT q.*, EXISTS (SELECT 1 FROM a WHERE a.user_id = q.user_id AND a.start <= q.start AND a.stop >= q.stop) AS ina,
             EXISTS (SELECT 1 FROM b WHERE b.user_id = q.user_id AND b.start <= q.start AND b.stop >= q.stop) AS inb FROM q WHERE stop IS NOT NULL),
k AS (SELECT user_id, start, stop FROM c WHERE {keep}),
""" + _merge("z", "k") + "\nSELECT * FROM z"


_X = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)\n"


# ---- intervals ----

@query("WITH " + _norm("a") + "\nSELECT * FROM a")
def interval_normalize(spark, d):
    return I.normalize(_spans(spark, d), KEY)


LOW, HIGH = 1_704_067_200, 1_704_067_200 + 40 * 86_400


@query("WITH " + _norm("a") + f""",
c AS (SELECT user_id, greatest(start, {LOW}) AS start, least(stop, {HIGH}) AS stop FROM a WHERE stop > {LOW} AND start < {HIGH}),
n AS (SELECT user_id, stop AS start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nxt FROM c),
g AS (SELECT user_id, start, coalesce(nxt, {HIGH}) AS stop FROM n UNION ALL SELECT u.user_id, {LOW}, coalesce((SELECT min(start) FROM c WHERE c.user_id = u.user_id), {HIGH}) FROM (SELECT DISTINCT user_id FROM a) u)
SELECT user_id, start, stop FROM g WHERE start < stop""")
def interval_complement(spark, d):
    return I.complement(_spans(spark, d), KEY, HIGH, LOW)


def _two(spark, d):
    return _spans(spark, d, "click"), _spans(spark, d, "view")


@query(_sweep_sql("ina AND inb"))
def interval_intersection(spark, d):
    return I.intersection(*_two(spark, d), KEY)


@query(_sweep_sql("ina OR inb"))
def interval_union(spark, d):
    return I.union(*_two(spark, d), KEY)


@query(_sweep_sql("ina <> inb"))
def interval_xor(spark, d):
    return I.xor(*_two(spark, d), KEY)


@query(_sweep_sql("ina AND NOT inb"))
def interval_difference(spark, d):
    return I.difference(*_two(spark, d), KEY)


@query("WITH " + _norm("a") + "\nSELECT user_id, CAST(sum(stop - start) AS BIGINT) AS total FROM a GROUP BY user_id")
def activity_total(spark, d):
    return I.total(_spans(spark, d), KEY)


@query("WITH " + _raw("a") + """,
s AS (SELECT user_id, pos, sum(s) AS s FROM (SELECT user_id, start AS pos, 1 AS s FROM a_r UNION ALL SELECT user_id, stop, -1 FROM a_r) GROUP BY user_id, pos),
l AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY pos) AS level, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) - pos AS n FROM s)
SELECT user_id, CAST(level AS BIGINT) AS level, CAST(sum(n) AS BIGINT) AS duration FROM l WHERE level > 0 AND n > 0 GROUP BY ALL""")
def activity_overlap(spark, d):
    return I.concurrency(_spans(spark, d), KEY)


@query("WITH " + _norm("a") + ",\nw AS (SELECT user_id, start - 600 AS start, stop + 600 AS stop FROM a),\n" + _merge("z", "w") + "\nSELECT * FROM z")
def interval_dilate(spark, d):
    return I.dilate(_spans(spark, d), KEY, 1201)


@query("WITH " + _norm("a") + "\nSELECT user_id, start + 600 AS start, stop - 600 AS stop FROM a WHERE start + 600 < stop - 600")
def interval_erode(spark, d):
    return I.erode(_spans(spark, d), KEY, 1201)


@query("WITH " + _norm("a") + f"\nSELECT user_id, greatest(start, {LOW + 86_400}) - {LOW + 86_400} AS start, least(stop, {LOW + 864_000}) - {LOW + 86_400} AS stop FROM a WHERE stop > {LOW + 86_400} AND start < {LOW + 864_000}")
def interval_slice(spark, d):
    return I.cut(I.normalize(_spans(spark, d), KEY), KEY, LOW + 86_400, LOW + 864_000)


@query("WITH " + _norm("a") + "\nSELECT user_id, start + 100 AS start, stop + 100 AS stop, CAST(4000000150 AS BIGINT) AS length FROM a")
def interval_pad(spark, d):
    padded, length = I.pad(I.normalize(_spans(spark, d), KEY), KEY, 4_000_000_000, 100, 50)
    return padded.withColumn("length", F.lit(length).cast("long"))


@query("WITH " + _norm("a") + "\nSELECT user_id, string_agg(start || ':' || stop, ',' ORDER BY start) AS text FROM a GROUP BY user_id")
def interval_to_text(spark, d):
    return I.to_text(_spans(spark, d), KEY)


@query("WITH " + _norm("a") + "\nSELECT * FROM a")
def interval_text_roundtrip(spark, d):
    return I.from_text(I.to_text(_spans(spark, d), KEY), KEY)


@query("SELECT CAST(user_id AS VARCHAR) AS file_id, event_type AS speaker, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + 21600 AS stop FROM events")
def rttm_roundtrip(spark, d):
    e = _t(spark, d, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    iv = e.select(F.col("user_id").cast("string").alias("file_id"), F.col("event_type").alias("speaker"), start.alias("start"), (start + SPAN).alias("stop"))
    return rttm.parse_lines(rttm.to_lines(iv, 16_000), 16_000)


@query("""WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, l_returnflag = 'N' AS f FROM lineitem),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS run FROM p WHERE f)
SELECT l_orderkey, min(pos) AS start, max(pos) + 1 AS stop FROM r GROUP BY l_orderkey, run""")
def run_length_encode(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]  # line numbers repeat
    return I.run_lengths(_t(spark, d, "lineitem").select("l_orderkey", *order, "l_returnflag"), ["l_orderkey"], order, F.col("l_returnflag") == "N")


# ---- frames ----

def _frames(spark, d, pad):
    return _vectors(spark, d).select("vec_id", F.posexplode(frames.segment_axis(F.col("x"), 10, 4, "pad" if pad else "cut")).alias("frame", "v")).select("vec_id", "frame", F.posexplode("v").alias("at", "value"))


@query(_X + "SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(k AS INTEGER) AS at, x[f * 4 + k + 1] AS value FROM e, range(14) r(f), range(10) s(k)")
def segment_axis_cut(spark, d):
    return _frames(spark, d, False)


@query(_X + "SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(k AS INTEGER) AS at, coalesce(x[f * 4 + k + 1], 0) AS value FROM e, range(15) r(f), range(10) s(k)")
def segment_axis_pad(spark, d):
    return _frames(spark, d, True)


def _kernel_sql(agg):
    return _X + f"SELECT vec_id, CAST(i AS INTEGER) AS at, round({agg}(x[least(greatest(i + k, 0), 63) + 1]), 8) AS value FROM e, range(64) r(i), range(-2, 3) s(k) GROUP BY vec_id, i"


def _kernel(spark, d, how):
    return _vectors(spark, d).select("vec_id", F.posexplode(frames.kernel(F.col("x"), 5, how)).alias("at", "value")).withColumn("value", F.round("value", 8))


@query(_kernel_sql("max"))
def kernel_max(spark, d):
    return _kernel(spark, d, "max")


@query(_kernel_sql("min"))
def kernel_min(spark, d):
    return _kernel(spark, d, "min")


@query(_kernel_sql("avg"))
def kernel_mean(spark, d):
    return _kernel(spark, d, "mean")


@query(_kernel_sql("median"))
def kernel_median(spark, d):
    return _kernel(spark, d, "median")


def _sliding(spark, d, how):
    rows = frames.sliding(_vectors(spark, d), "x", 31, how)
    return rows.select("vec_id", F.posexplode("values").alias("at", "value")).withColumn("value", F.round("value", 8))


@query(_kernel_sql("max").replace("range(-2, 3)", "range(-15, 16)"))
def sliding_max(spark, d):
    return _sliding(spark, d, "max")


@query(_kernel_sql("min").replace("range(-2, 3)", "range(-15, 16)"))
def sliding_min(spark, d):
    return _sliding(spark, d, "min")


@query(_kernel_sql("avg").replace("range(-2, 3)", "range(-15, 16)"))
def sliding_mean(spark, d):
    return _sliding(spark, d, "mean")


@query(_kernel_sql("median").replace("range(-2, 3)", "range(-15, 16)"))
def sliding_median(spark, d):
    return _sliding(spark, d, "median")


def _each(spark, d, f):
    return _vectors(spark, d).select("vec_id", F.posexplode(f(F.col("x"))).alias("at", "value")).withColumn("value", F.round("value", 8))


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(CASE WHEN i < 3 THEN 0 ELSE x[i - 2] END, 8) AS value FROM e, range(64) r(i)")
def roll_zeropad(spark, d):
    return _each(spark, d, lambda x: frames.roll_zeropad(x, 3))


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(x[i + 1] - 0.95e0 * (CASE WHEN i > 0 THEN x[i] ELSE 0 END), 8) AS value FROM e, range(64) r(i)")
def preemphasis(spark, d):
    return _each(spark, d, frames.preemphasis)


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(sum(k * x[least(greatest(i + k, 0), 63) + 1]) / 60e0, 8) AS value FROM e, range(64) r(i), range(-4, 5) s(k) GROUP BY vec_id, i")
def delta(spark, d):
    return _each(spark, d, features.delta)


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, CAST(k AS INTEGER) AS place, CASE WHEN i + k - 2 BETWEEN 0 AND 63 THEN x[i + k - 1] ELSE 0 END AS value FROM e, range(64) r(i), range(4) s(k)")
def stack_context(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(frames.context_frames(F.col("x"), 2, 1, mode="constant")).alias("at", "v")).select("vec_id", "at", F.posexplode("v").alias("place", "value")).fillna(0.0, ["value"])


# ---- spectra ----

@query(_X + """, t AS (SELECT vec_id, f, b, x[f * 4 + k + 1] * (0.5e0 - 0.5e0 * cos(2 * pi() * k / 16)) AS v, 2 * pi() * b * k / 16 AS w FROM e, range(13) q(f), range(9) r(b), range(16) s(k))
SELECT vec_id, CAST(f AS INTEGER) AS frame, CAST(b AS INTEGER) AS bin, round(pow(sum(v * cos(w)), 2) + pow(sum(v * sin(w)), 2), 6) AS power FROM t GROUP BY vec_id, f, b""")
def stft_power(spark, d):
    rows = spectral.stft(_vectors(spark, d), "x", 16, 4, "hann", fading=None, pad=False)
    return rows.select("vec_id", F.posexplode(spectral.power(F.col("re"), F.col("im"))).alias("frame", "p")).select("vec_id", "frame", F.posexplode("p").alias("bin", "power")).withColumn("power", F.round("power", 6))


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(x[i + 1], 8) AS value FROM e, range(64) r(i)")
def stft_roundtrip(spark, d):
    rows = spectral.stft(_vectors(spark, d), "x", 16, 4, "hann")
    back = spectral.istft(F.col("re"), F.col("im"), 16, 4, "hann", num_samples=64)
    return rows.select("vec_id", back.alias("y")).select("vec_id", F.posexplode("y").alias("at", "value")).withColumn("value", F.round("value", 8))


@query(_X + "SELECT vec_id, CAST(k AS INTEGER) AS at, round(sum(x[i + 1] * cos(pi() * k * (2 * i + 1) / 128)) * sqrt((CASE WHEN k = 0 THEN 1e0 ELSE 2e0 END) / 64), 8) AS value FROM e, range(64) r(i), range(8) s(k) GROUP BY vec_id, k")
def dct_coefficients(spark, d):
    return _each(spark, d, lambda x: spectral.dct2(x, 8))


@query("""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id, a.x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
r(vec_id, i, j, d) AS (
  SELECT vec_id, 0, CAST(j AS INTEGER), CASE WHEN j = 0 THEN 0e0 ELSE 1e300 END FROM p, range(65) t(j)
  UNION ALL
  SELECT vec_id, i, j, CASE WHEN j = 0 THEN 1e300 ELSE s + min(m - s + c) OVER (PARTITION BY vec_id ORDER BY j ROWS UNBOUNDED PRECEDING) END
  FROM (SELECT vec_id, i, j, c, CASE WHEN j = 0 THEN 1e300 ELSE m END AS m, sum(c) OVER (PARTITION BY vec_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS s
        FROM (SELECT r.vec_id, r.i + 1 AS i, r.j, CASE WHEN r.j = 0 THEN 0e0 ELSE abs(p.x[r.i + 1] - p.y[r.j]) END AS c,
                     least(r.d, coalesce(lag(r.d) OVER (PARTITION BY r.vec_id ORDER BY r.j), 1e300)) AS m
              FROM r JOIN p USING (vec_id) WHERE r.i < 64)))
SELECT vec_id, round(d, 6) AS cost FROM r WHERE i = 64 AND j = 64""")
def dtw_cost(spark, d):
    a = _vectors(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(spectral.dtw(F.col("x"), F.col("y"))["cost"], 6).alias("cost"))


@query("""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
p AS (SELECT a.vec_id, a.x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
r(vec_id, i, j, d) AS (
  SELECT vec_id, 0, CAST(j AS INTEGER), CASE WHEN j = 0 THEN 0e0 ELSE 1e300 END FROM p, range(65) t(j)
  UNION ALL
  SELECT vec_id, i, j, CASE WHEN j = 0 THEN 1e300 ELSE s + min(m - s + c) OVER (PARTITION BY vec_id ORDER BY j ROWS UNBOUNDED PRECEDING) END
  FROM (SELECT vec_id, i, j, c, CASE WHEN j = 0 THEN 1e300 ELSE m END AS m, sum(c + CASE WHEN j = 0 THEN 0 ELSE 0.1 END) OVER (PARTITION BY vec_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS s
        FROM (SELECT r.vec_id, r.i + 1 AS i, r.j, CASE WHEN r.j = 0 THEN 0e0 ELSE abs(p.x[r.i + 1] - p.y[r.j]) END AS c,
                     least(r.d + 0.2, coalesce(lag(r.d) OVER (PARTITION BY r.vec_id ORDER BY r.j), 1e300) + 0.05) AS m
              FROM r JOIN p USING (vec_id) WHERE r.i < 64)))
SELECT vec_id, round(d, 6) AS cost FROM r WHERE i = 64 AND j = 64""")
def dtw_penalties(spark, d):
    """Steps that repeat a value of the first or second signal, or go along both, cost 0.1, 0.2 and 0.05 more."""
    a = _vectors(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(spectral.dtw(F.col("x"), F.col("y"), penalty=(0.1, 0.05, 0.2))["cost"], 6).alias("cost"))


# ---- vectors and scalars ----

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"


@query(_X + f"SELECT a.vec_id, round(abs({_DOT.format('a.x', 'b.x')}) / sqrt({_DOT.format('a.x', 'a.x')}) / sqrt({_DOT.format('b.x', 'b.x')}), 6) AS similarity, round((1 - {_DOT.format('a.x', 'b.x')} / sqrt({_DOT.format('a.x', 'a.x')}) / sqrt({_DOT.format('b.x', 'b.x')})) / 2, 6) AS distance FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def cos_neighbours(spark, d):
    a = _vectors(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.join(b, "vec_id").select("vec_id", F.round(V.cos_similarity(x, y), 6).alias("similarity"), F.round(V.cos_distance(x, y), 6).alias("distance"))


@query(_X + f"SELECT vec_id, CAST(i AS INTEGER) AS at, round(x[i + 1] / sqrt({_DOT.format('x', 'x')}), 8) AS value FROM e, range(64) r(i)")
def unit_norm(spark, d):
    return _each(spark, d, V.unit)


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity + pi() - 2 * pi() * floor((l_quantity + pi()) / (2 * pi())) - pi(), 6) AS angle, round(2595 * log10(1 + l_extendedprice / 700e0), 6) AS mel,
round(atan2(l_tax, l_discount + 1), 6) AS azimuth, round(sqrt(pow(l_discount + 1, 2) + pow(l_tax, 2) + pow(l_quantity, 2)), 6) AS radius FROM lineitem""")
def scalar_math(spark, d):
    rows = _t(spark, d, "lineitem")
    azimuth, _, radius = V.cart2sph(F.col("l_discount") + 1, F.col("l_tax"), F.col("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", F.round(V.wrap_angle(F.col("l_quantity")), 6).alias("angle"), F.round(features.hz_to_mel(F.col("l_extendedprice")), 6).alias("mel"), F.round(azimuth, 6).alias("azimuth"), F.round(radius, 6).alias("radius"))


@query("SELECT DISTINCT p_brand, CAST('0x' || substr(sha256(p_brand), 57, 8) AS BIGINT) AS seed FROM part")
def str_to_seed(spark, d):
    return _t(spark, d, "part").select("p_brand").distinct().withColumn("seed", V.str_to_seed(F.col("p_brand")))


@query("SELECT l_returnflag, l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-6), 6) AS z FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)")
def normalize_mean_variance(spark, d):
    rows = _t(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return tables.normalize_mean_variance(rows, ["l_returnflag"], "l_quantity", "z").select("l_returnflag", "l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))


# ---- tables ----

@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def groupby_ordered(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "role")
    return tables.groupby_ordered(rows, ["conv_id"], ["turn"], "role").select("conv_id", F.array_join("items", ",").alias("roles"))


@query("SELECT vec_id, CAST(k AS INTEGER) AS class, CAST(label = k AS INTEGER) AS hot FROM embeddings, range(10) r(k)")
def one_hot(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.posexplode(tables.one_hot(F.col("label"), 10)).alias("class", "hot"))


@query("SELECT count(o_orderkey) = count(DISTINCT o_orderkey) AS o_orderkey, count(o_custkey) = count(DISTINCT o_custkey) AS o_custkey FROM orders")
def all_unique(spark, d):
    return tables.all_unique(_t(spark, d, "orders"), ["o_orderkey", "o_custkey"])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def get_by_path(spark, d):
    rows = _t(spark, d, "events").withColumn("tree", F.from_json("props", "k int"))
    return rows.select("event_id", nested.get_by_path(rows, "tree", "k").alias("k"))


@query("""WITH v AS (SELECT 'p_size' AS name, CAST(p_size AS VARCHAR) AS value, p_partkey FROM part UNION ALL SELECT 'p_brand', p_brand, p_partkey FROM part),
f AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY min(p_partkey)) AS nth FROM v GROUP BY name, value)
SELECT name, string_agg(CASE WHEN nth <= 3 THEN value ELSE '...' END, ', ' ORDER BY nth) AS "values" FROM f WHERE nth <= 4 GROUP BY name""")
def summary_columns(spark, d):
    return tables.summary(_t(spark, d, "part"), ["p_size", "p_brand"], ["p_partkey"])


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_query(spark, d):
    return tables.query(_t(spark, d, "orders"), "o_orderstatus = 'F' AND o_totalprice > 100000")


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, CASE WHEN i BETWEEN 5 AND 8 THEN x[i - 4] WHEN i BETWEEN 20 + vec_id % 7 AND 27 + vec_id % 7 THEN x[CAST(i - 15 - vec_id % 7 AS INTEGER)] ELSE -1 END AS value FROM e, range(30) r(i)")
def sparse_densify(spark, d):
    return sparse.dense(_segments(spark, d), ["vec_id"], 30, -1.0).select("vec_id", F.posexplode("values").alias("at", "value"))


# ---- event time ----

@query("""WITH w AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS s, value FROM events), x AS (SELECT (s // 3600 - k) * 3600 AS start, value FROM w, range(4) r(k))
SELECT start, start + 14400 AS stop, count(*) AS n, round(sum(value), 6) AS total FROM x GROUP BY start""")
def sliding_window_events(spark, d):
    return windows.sliding_counts(_t(spark, d, "events"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
s AS (SELECT *, sum(CASE WHEN b IS NULL OR t - b > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(t) AS start, max(t) + 21600000000 AS stop, count(*) AS n FROM s GROUP BY user_id, g""")
def session_events(spark, d):
    return windows.sessions(_t(spark, d, "events"))
