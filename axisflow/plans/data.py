"""Queries over tables, nested columns and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from axisflow.operators import nested, tables
from axisflow.sources import audio, files, nested_files

from .registry import _X, _t, _vectors, query


@query("SELECT conv_id, string_agg(role, ',' ORDER BY nth) AS roles FROM (SELECT conv_id, role, min(turn) AS nth FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def distinct_in_order(spark, d):
    rows = tables.groupby_ordered(_t(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role")
    return rows.select("conv_id", F.array_join(tables.distinct_in_order(F.col("items")), ",").alias("roles"))


@query(_X + """SELECT vec_id, CAST(i AS INTEGER) AS at, CASE WHEN i < 32 THEN x[CASE WHEN i % 2 = 0 THEN i // 2 + 1 ELSE i // 2 + 41 END] ELSE x[i - 15] END AS value FROM e, range(56) r(i)""")
def interleave(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(tables.interleave(F.slice("x", 1, 40), F.slice("x", 41, 16))).alias("at", "value"))


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, x[i + 1] AS a, x[i + 33] AS b FROM e, range(32) r(i)")
def zip_strict(spark, d):
    rows = _vectors(spark, d).select("vec_id", F.posexplode(tables.zip_strict(F.slice("x", 1, 32), F.slice("x", 33, 32))).alias("at", "p"))
    return rows.select("vec_id", "at", "p.a", "p.b")


@query("""WITH o AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS f FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(f) = 1 AS same, len(list_filter(f, lambda x: x NOT IN ('N', 'R'))) = 0 AS known, list_has_any(f, ['A', 'R']) AS meets FROM o""")
def set_tests(spark, d):
    o = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("f"))
    return o.select(
        "l_orderkey", tables.all_equal(F.col("f")).alias("same"), tables.all_in(F.col("f"), F.array(F.lit("N"), F.lit("R"))).alias("known"),
        tables.any_in(F.col("f"), F.array(F.lit("A"), F.lit("R"))).alias("meets"))


@query("SELECT *, 'p_retailprice' AS named, CAST(1 AS INTEGER) AS one FROM nation")
def squeeze_columns(spark, d):
    """The constants come back as what the table lost."""
    same, rest = tables.squeeze(_t(spark, d, "nation").withColumns({"one": F.lit(1), "named": F.lit("p_retailprice")}))
    return rest.select("*", *(F.lit(v).alias(c) for c, v in same.items()))


# ---- nested ----


def _tree(spark, d):
    """A struct of structs for each nation."""
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    inner = F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")).alias("region"))
    return n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), inner.alias("v"))


_TREE = "WITH t AS (SELECT n_nationkey AS id, n_name AS name, r_regionkey AS key, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)\n"


@query(_TREE + 'SELECT id, name, key AS "region.key", region AS "region.name" FROM t')
def nested_flatten(spark, d):
    return nested.flatten(_tree(spark, d), "v")


@query(_TREE + "SELECT id, name, key, region FROM t")
def nested_deflatten(spark, d):
    flat = nested.flatten(_tree(spark, d), "v", "/")
    rows = nested.deflatten(flat, ["name", "region/key", "region/name"], "w", "/")
    return rows.select("id", "w.name", "w.region.key", F.col("w.region.name").alias("region"))


@query(_TREE + "SELECT id, region, 'none' AS missing, name AS early, upper(name) AS changed, CAST(3 AS INTEGER) AS leaves FROM t")
def nested_paths(spark, d):
    t = _tree(spark, d)
    view = nested.FlatView(t, "v")
    view["name"] = F.upper("v.name")
    early = nested.get_by_path(t, "v", "name.first", early=True)
    both = t.select("id", early.alias("early"), nested.get_by_path(t, "v", "region.size", default=F.lit("none")).alias("missing"))
    return view.df.select("id", view["region.name"].alias("region"), F.col("v.name").alias("changed"), F.lit(len(view)).alias("leaves")).join(both, "id")


@query(_TREE + "SELECT id, 'name' AS path, name AS value FROM t UNION ALL SELECT id, 'region.key', CAST(key AS VARCHAR) FROM t UNION ALL SELECT id, 'region.name', region FROM t")
def nested_items(spark, d):
    return nested.items(_tree(spark, d), "v")


@query(_TREE + "SELECT id, lower(name) AS name, CAST(7 AS INTEGER) AS key, region, id AS more FROM t")
def nested_merge(spark, d):
    t = _tree(spark, d).withColumn("w", F.struct(F.lower("v.name").alias("name"), F.struct(F.lit(7).alias("key"), F.col("id").alias("more")).alias("region")))
    return t.select("id", nested.merge(t, ["v", "w"]).alias("m")).select("id", "m.name", "m.region.key", F.col("m.region.name").alias("region"), "m.region.more")


@query(_TREE + "SELECT id, name || '-' || name AS name, key || '-' || key AS key, region || '-' || region AS region FROM t")
def nested_op(spark, d):
    t = _tree(spark, d).withColumn("w", F.col("v"))
    both = nested.apply(t, lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")), ["v", "w"])
    return t.select("id", both.alias("m")).select("id", "m.name", "m.region.key", F.col("m.region.name").alias("region"))


@query(_TREE + "SELECT id, (name LIKE '%A%' OR region LIKE '%A%') AS some, (name LIKE '%A%' AND region LIKE '%A%' AND CAST(key AS VARCHAR) LIKE '%A%') AS every, CASE WHEN name = region AND region = CAST(key AS VARCHAR) THEN name END AS same FROM t")
def nested_tests(spark, d):
    t, has = _tree(spark, d), lambda x: x.cast("string").contains("A")
    return t.select("id", nested.any_leaf(t, "v", has).alias("some"), nested.all_leaves(t, "v", has).alias("every"), nested.squeeze(t, "v").alias("same"))


# ---- files ----


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, round(greatest(least(round_even(x[i + 1] / 2 * 32768, 0), 32767), -32768) / 32768, 8) + 0e0 AS value FROM e, range(8, 24) r(i)")
def audio_int16_slice(spark, d):
    halves = F.array(F.transform("x", lambda v: -v), F.transform("x", lambda v: v / 2))
    rows = _vectors(spark, d).select("vec_id", audio.encoded(F.lit(16_000), halves).alias("wav")).repartition("vec_id")
    rows = rows.select("vec_id", audio.decoded(F.col("wav"), 8, 24, 1).alias("a")).repartition("vec_id")
    return rows.select("vec_id", F.posexplode(F.col("a.channels")[0]).alias("p", "value")).select("vec_id", (F.col("p") + 8).alias("at"), (F.round("value", 8) + 0.0).alias("value"))


@query(_X + "SELECT vec_id, CAST(i AS INTEGER) AS at, CASE WHEN i < 64 THEN x[i + 1] ELSE 0 END AS value FROM e, range(70) r(i)")
def audio_float64_filled(spark, d):
    rows = _vectors(spark, d).select("vec_id", audio.encoded(F.lit(8_000), F.array("x"), "float64").alias("wav")).repartition("vec_id")
    rows = rows.select("vec_id", audio.decoded(F.col("wav"), 0, 70, fill=True).alias("a")).repartition("vec_id")
    return rows.select("vec_id", F.posexplode(F.col("a.channels")[0]).alias("at", "value"))


@query(_X + "SELECT vec_id, CAST(8000 AS INTEGER) AS sample_rate, CAST(2 AS INTEGER) AS n_channels, CAST(64 AS BIGINT) AS n_samples, CAST(4 AS INTEGER) AS width, true AS floating, false AS sphere, CAST(round(list_max(list_transform(x, lambda v: abs(v))) * 32768 / list_max(list_transform(x, lambda v: abs(v))), 0) - 1 AS INTEGER) AS peak FROM e")
def audio_headers(spark, d):
    rows = _vectors(spark, d).select("vec_id", audio.encoded(F.lit(8_000), F.array("x", "x"), "float32").alias("wav"), audio.encoded(F.lit(8_000), F.array("x"), normalize=True).alias("loud")).repartition("vec_id")
    rows = rows.select("vec_id", audio.params(F.col("wav")).alias("h"), audio.is_sphere(F.col("wav")).alias("sphere"), audio.raw(F.expr("substring(loud, 45)")).alias("raw")).repartition("vec_id")
    return rows.select("vec_id", "h.*", "sphere", F.array_max(F.transform("raw", F.abs)).cast("int").alias("peak"))


@query("SELECT r_regionkey, 'a/b.wav' AS path, CAST(100 AS BIGINT) AS start, CAST(200 AS BIGINT) AS stop, CAST(1 AS BIGINT) AS first, CAST(2 AS BIGINT) AS last FROM region")
def audio_slice_names(spark, d):
    return _t(spark, d, "region").select("r_regionkey", audio.parse_slice(F.lit("a/b.wav::[100:200,1]")).alias("s")).select("r_regionkey", "s.*")


@query("SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def csv_text(spark, d):
    line = F.concat_ws(files.sniff("1;A\n2;B"), F.concat(F.lit('"'), F.col("n_name"), F.lit('"')), F.col("n_regionkey").cast("string"))
    return _t(spark, d, "nation").select("n_nationkey", files.from_csv_text(line, ["name", "region"], ";").alias("c")).select("n_nationkey", "c.*")


@query("""SELECT o_orderkey, '{"a_date":"' || strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') || '","key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS text FROM orders""")
def json_text(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("a_date")).alias("v"))
    return o.select("o_orderkey", files.to_json_text(files.sorted_fields(o.schema["v"].dataType, F.col("v"))).alias("text"))


@query("""SELECT vec_id, '{"vec_id":' || vec_id || ',"embedding":"array(shape=(64,), dtype=float)"}' AS text FROM embeddings""")
def json_summary(spark, d):
    e = _t(spark, d, "embeddings")
    return e.select("vec_id", files.summary_json(e, ["vec_id", "embedding"]).alias("text"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS first, n_regionkey + 1 AS second FROM nation")
def yaml_text(spark, d):
    text = F.format_string("name: %s\nlist: [%d, %d]\n", F.col("n_name"), F.col("n_regionkey"), F.col("n_regionkey") + 1)
    rows = _t(spark, d, "nation").select("n_nationkey", text.alias("t")).select("n_nationkey", files.yaml_to_json("t").alias("j"))
    parsed = rows.select("n_nationkey", F.from_json("j", "name string, list array<int>").alias("v"))
    return parsed.select("n_nationkey", "v.name", F.col("v.list")[0].alias("first"), F.col("v.list")[1].alias("second"))


@query("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey, length(n_name) AS size FROM nation")
def update_table(spark, d):
    n = _t(spark, d, "nation")
    changes = n.select("n_nationkey", F.upper("n_name").alias("n_name"), F.length("n_name").cast("long").alias("size"))
    return files.update_table(n, changes, ["n_nationkey"], allow_overwrite=True)


def _shared_folder(spark):
    from axisflow.operators.ranges import shared_path

    return shared_path(spark)


@query(_X + """SELECT vec_id, 'whole' AS part, CAST(i AS INTEGER) AS at, x[i + 1] AS value FROM e, range(64) r(i)
UNION ALL SELECT vec_id, 'piece', CAST(i AS INTEGER), 2 * x[i + 9] FROM e, range(16) r(i)
UNION ALL SELECT vec_id, 'next', CAST(i AS INTEGER), y.x[i + 1] FROM (SELECT a.vec_id, b.x FROM e a JOIN e b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM e)) y, range(4) r(i)""")
def audio_nested_load(spark, d):
    """Every vector becomes an audio file of two channels; nested columns of their paths and parts of them are read back."""
    folder, rows = _shared_folder(spark), _vectors(spark, d)
    wide = rows.select(F.format_string("%d.wav", F.col("vec_id")).alias("name"), F.lit(8_000).alias("sample_rate"), F.array("x", F.transform("x", lambda v: 2 * v)).alias("channels"))
    nested_files.write_audio(wide, folder, "float64")
    n = rows.count()
    path = lambda i, tail="": F.format_string(f"{folder}/%d.wav{tail}", i)
    paths = rows.select("vec_id", F.struct(path(F.col("vec_id"), "::[:,0]").alias("whole"), F.array(path(F.col("vec_id"), "::[8:24,1]"), path((F.col("vec_id") + 1) % n, "::[:4,0]")).alias("parts")).alias("v"))
    loaded = nested_files.load_audio_nested(paths, "v")
    named = F.create_map(F.lit("whole"), F.col("v.whole.channels")[0], F.lit("piece"), F.col("v.parts")[0]["channels"][0], F.lit("next"), F.col("v.parts")[1]["channels"][0])
    return loaded.select("vec_id", F.explode(named).alias("part", "samples")).select("vec_id", "part", F.posexplode("samples").alias("at", "value"))
