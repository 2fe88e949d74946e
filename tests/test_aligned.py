"""Sparse arrays combined by aligned segments, against places written out; long axes, null keys, empty tables, ranges of a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from axisflow.operators import aligned as S

BY = ["cuts"]  # also the name of a helper column
SEG = "cuts string, onset long, length long, values array<double>"


def segments(seed, n=40):
    rng, at, out = random.Random(seed), {}, []
    for _ in range(n):
        key = rng.choice(["a", "a", "b", None])
        onset, length = at.get(key, 0) + rng.choice([0, 0, 1, 5]), rng.choice([1, 2, 3, 10])
        out.append((key, onset, length, [float(rng.randrange(9)) for _ in range(length)] if rng.random() < 0.6 else [float(rng.randrange(9))]))
        at[key] = onset + length
    return out


def places(rows):
    return {(k, o + i): (v[i] if len(v) == n else v[0]) for k, o, n, v in rows for i in range(n)}


@pytest.mark.parametrize("limit", [10**9, 20], ids=["whole keys", "ranges"])
def test_combine(spark, limit):
    one, other = segments(1), [*segments(2), ("z", 3, 4, [1.0, 2.0, 3.0, 4.0])]
    a, b, pa, pb = spark.createDataFrame(one, SEG), spark.createDataFrame(other, SEG), places(one), places(other)
    got = [tuple(r) for r in S.combine(a, b, BY, lambda x, y: x - 2 * y, (1.0, 3.0), limit=limit).collect()]
    assert places(got) == {k: pa.get(k, 1.0) - 2 * pb.get(k, 3.0) for k in pa | pb}
    assert sum(r[2] for r in got) == len(pa | pb)  # no place twice
    none = a.limit(0)
    assert places([tuple(r) for r in S.combine(a, none, BY, lambda x, y: x + y, (0.0, 7.0), limit=limit).collect()]) == {k: v + 7 for k, v in pa.items()}
    assert S.combine(none, none, BY, lambda x, y: x + y).collect() == []


def test_long_axis_without_a_row_a_place(spark):
    """A run of 10^9 places is one value, and stays a handful of rows."""
    a = S.from_intervals(spark.createDataFrame([("a", 0, 10**9)], "cuts string, start long, stop long"), BY, 2.0)
    b = S.from_arrays(spark.createDataFrame([("a", 500_000_000, [1.0, 5.0])], "cuts string, onset long, values array<double>"), BY)
    got = sorted(tuple(r) for r in S.combine(a, b, BY, lambda x, y: x * (1 + y)).collect())
    assert got == [("a", 0, 500_000_000, [2.0]), ("a", 500_000_000, 2, [4.0, 12.0]), ("a", 500_000_002, 499_999_998, [2.0])]
    assert S.dense(S.combine(a, b, BY, lambda x, y: x + y), BY, 499_999_999, 500_000_003).collect()[0]["values"] == [2.0, 3.0, 7.0, 2.0]


def test_dense_and_sparse(spark):
    one = segments(5)
    held, seg = places(one), spark.createDataFrame(one, SEG)
    arrays = spark.createDataFrame([(k, [float(i) for i in range(n)]) for k, n in (("a", 60), ("b", 7), (None, 0), ("none", 3))], "cuts string, values array<double>")
    got = {r.cuts: r["values"] for r in S.combine_dense(arrays, seg, BY, lambda d, s: d * 10 + s, -1.0).collect()}
    assert got == {k: [i * 10.0 + held.get((k, i), -1.0) for i in range(n)] for k, n in (("a", 60), ("b", 7), (None, 0), ("none", 3))}


def test_channels(spark):
    kind = "cuts string, onset long, values array<array<double>>"
    a = S.from_arrays(spark.createDataFrame([("a", 2, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]), ("a", 9, None), ("a", 20, [[], []])], kind), BY, axes=2)
    b = S.from_arrays(spark.createDataFrame([("a", 4, [[10.0, 20.0], [30.0, 40.0]])], kind), BY, axes=2)
    got = sorted((r.onset, r.length, r["values"]) for r in S.combine(a, b, BY, lambda x, y: x + y, (0.5, 0.25), axes=2).collect())
    assert got == [(2, 2, [[1.25, 2.25], [4.25, 5.25]]), (4, 1, [[13.0], [36.0]]), (5, 1, [[20.5], [40.5]])]
    assert S.scalar(a, BY, lambda v: -v, axes=2).select(F.col("values")[1][2]).collect()[0][0] == -6.0
