"""Intervals and axes against sets of places; ranges of a hot key; what must fail."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from axisflow.operators import axes as A
from axisflow.operators import intervals as I
from axisflow.operators import ranges as R

BY = ["piece"]  # also the name of a helper column


def spans(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), s := rng.randrange(2000), s + rng.choice([0, 1, 2, 5, 9, 300])) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "piece string, start long, stop long")


def places(rows):
    found = {}
    for key, start, stop in rows:
        found.setdefault(key, set()).update(range(start, stop))
    return found


def runs(found):
    out = []
    for key, held in found.items():
        first = None
        for x in sorted(held):
            first = x if x - 1 not in held else first
            if x + 1 not in held:
                out.append((key, first, x + 1))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("limit", [10**9, 25], ids=["whole keys", "ranges"])
def test_intervals_in_ranges(spark, limit):
    one, other = spans(1, 500), spans(2, 400)
    a, b, pa, pb = table(spark, one), table(spark, other), places(one), places(other)
    assert rows_of(I.normalize(a, BY, limit)) == runs(pa)
    for keep, op in ((lambda x, y: x != y, set.__xor__), (lambda x, y: x & ~y, set.__sub__)):
        assert rows_of(I.sweep([a, b], BY, keep, limit)) == runs({k: op(pa.get(k, set()), pb.get(k, set())) for k in pa | pb})
    asked = [(random.Random(i).choice(["a", "b", None, "z"]), random.Random(i).choice([None, i * 7 % 2300]), i) for i in range(300)]
    got = I.contains(spark.createDataFrame(asked, "piece string, at long, row int"), a, BY, limit=limit).collect()
    assert len(got) == 300 and all(r.inside == (r.at in pa.get(r.piece, ())) for r in got)
    levels = Counter()
    for key, start, stop in one:
        levels.update((key, x) for x in range(start, stop))
    want = Counter((key, n) for (key, _), n in levels.items())
    assert {(r.piece, r.level): r.duration for r in I.concurrency(a, BY, limit).collect()} == want


def test_tasks_of_a_hot_key(spark):
    """One key holds all of 200,000 intervals: no range holds more than a few times the limit, and the result is that of whole keys."""
    rows = spark.range(200_000).select(F.lit("hot").alias("piece"), (F.col("id") * F.col("id") % 1_000_003 * 3).alias("start")).withColumn("stop", F.col("start") + 2)
    limit = 10_000
    parts = R.cuts(rows, BY, "start", limit)
    sizes = [r["count"] for r in R.ranged(rows, BY, "start", parts, "part").groupBy("part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2 * limit
    assert I.normalize(rows, BY, limit).exceptAll(I.normalize(rows, BY)).isEmpty() and I.normalize(rows, BY, limit).count() == I.normalize(rows, BY).count()


LENGTH = 2400
KEYS = [("a", LENGTH, True, LENGTH, False), ("b", None, True, None, True), (None, None, False, LENGTH, True), ("z", LENGTH, False, None, True)]


def two(spark):
    keys = spark.createDataFrame(KEYS, "piece string, l1 long, i1 boolean, l2 long, i2 boolean")
    one, other = [x for x in spans(3, 60) if x[2] <= LENGTH], [x for x in spans(4, 50) if x[2] <= LENGTH]
    a = A.axes(keys, table(spark, one), BY, F.col("l1"), F.col("i1"))
    b = A.axes(keys, table(spark, other), BY, F.col("l2"), F.col("i2"))
    line = lambda rows, at: {k[0]: [(x in places(rows).get(k[0], ())) != k[at] for x in range(LENGTH)] for k in KEYS}
    return a, b, line(one, 2), line(other, 4)


def booleans(a):
    return {r.piece: r["values"] for r in A.dense(a, 0, LENGTH).collect()}


def test_axes_place_by_place(spark):
    a, b, one, other = two(spark)
    assert booleans(a) == one and booleans(A.invert(b)) == {k: [not x for x in v] for k, v in other.items()}
    for how, op in {"or": lambda x, y: x or y, "and": lambda x, y: x and y, "xor": lambda x, y: x != y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "eq": lambda x, y: x == y}.items():
        both = A.combine(a, b, how)
        assert booleans(both) == {k: [op(x, y) for x, y in zip(one[k], other[k], strict=True)] for k in one}, how
        assert {r.piece: r.length for r in both.keys.collect()} == {"a": LENGTH, "b": None, None: LENGTH, "z": LENGTH}
    assert booleans(A.assign(a, 100, 900, 0)) == {k: v[:100] + [False] * 800 + v[900:] for k, v in one.items()}
    assert booleans(A.assign(a, 100, 900, b)) == {k: v[:100] + other[k][:800] + v[900:] for k, v in one.items()}
    padded = {r.piece: r["values"] for r in A.dense(A.pad(a, 7, 5), 0, LENGTH + 20).collect()}
    far = {k[0]: k[2] for k in KEYS}
    assert padded == {k: [False] * 7 + v + ([False] * 5 if dict((x[0], x[1]) for x in KEYS)[k] else [far[k]] * 13) for k, v in one.items()}
    asked = [(k, x) for k in one for x in (0, 5, 777, LENGTH - 1)]
    got = A.values_at(spark.createDataFrame(asked, "piece string, at long"), a).collect()
    assert all(r.value == one[r.piece][r.at] for r in got) and len(got) == len(asked)


def test_axes_with_length(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "piece string")
    a = A.axes(keys, table(spark, [("a", 1, 4), ("a", 4, 6), ("b", 8, 10)]), BY, 10, F.col("piece") == "b")
    assert {tuple(r) for r in A.total(a).collect()} == {("a", 5), ("b", 8)} and {tuple(r) for r in A.mean(a).collect()} == {("a", 0.5), ("b", 0.8)}
    assert {tuple(r) for r in A.to_text(a).collect()} == {("a", "1:6", 10), ("b", "0:8", 10)}
    assert booleans(A.cut(A.plain(a), -4, None)) == {"a": [False] * 4, "b": [True, True, False, False]}
    assert {r.piece: r["values"] for r in A.dense(A.from_text(A.to_text(a), BY)).collect()} == {r.piece: r["values"] for r in A.dense(a).collect()}
    assert A.total(A.ones(keys, BY, 7)).collect()[0].total == 7 and A.total(A.zeros(keys, BY)).collect()[0].total == 0
    assert {r.value for r in A.values_at(keys.withColumn("at", F.lit(-1)), a).collect()} == {False}


@pytest.mark.parametrize("wrong", [
    lambda a, s: A.dense(A.ones(a.keys, BY)), lambda a, s: A.total(A.ones(a.keys, BY)), lambda a, s: A.mean(A.zeros(a.keys, BY)), lambda a, s: A.to_text(A.ones(a.keys, BY)),
    lambda a, s: A.values_at(a.keys.select("piece", F.lit(-1).alias("at")), A.zeros(a.keys, BY)), lambda a, s: A.values_at(a.keys.select("piece", F.lit(10).alias("at")), a),
    lambda a, s: A.combine(a, A.zeros(a.keys, BY, 11), "or").keys, lambda a, s: A.axes(a.keys.select("piece"), table(s, [("a", 5, 11)]), BY, 10).spans,
    lambda a, s: I.from_text(s.createDataFrame([("a", "1:4, x:9")], "piece string, text string"), BY)])
def test_what_must_fail(spark, wrong):
    a = A.zeros(spark.createDataFrame([("a",)], "piece string"), BY, 10)
    with pytest.raises(Exception, match="length|outside|slice|total|mean|end|interval|axis"):
        wrong(a, spark).collect()


def test_text_of_complements_in_one_pass(spark):
    """Gaps at both ends, of full and of empty axes; and reading a text again does not work out twice what wrote it."""
    keys = spark.createDataFrame([(k, k != 4) for k in range(6)], "k int, inv boolean")
    spans = spark.createDataFrame([(1, 0, 10), (2, 0, 3), (2, 5, 7), (3, 2, 4), (3, 9, 10), (4, 2, 4), (4, 4, 6)], "k int, start long, stop long")
    a = A.axes(keys, spans, ["k"], 10, F.col("inv"))
    again = A.to_text(A.from_text(A.to_text(a), ["k"]))
    want = {0: "0:10", 1: "", 2: "3:5,7:10", 3: "0:2,4:9", 4: "2:6", 5: "0:10"}
    assert {r.k: (r.text, r.length) for r in again.collect()} == {k: (v, 10) for k, v in want.items()}
    assert again._jdf.queryExecution().optimizedPlan().toString().count("Window") <= 8
