"""Truncated normal numbers: the first try inside, by plain Python, and later tries only where they are needed."""

import hashlib
import math
import time

import pytest
from pyspark.sql import functions as F

from axisflow.functions import samplers


def plain(key, scale, truncation):
    unit = lambda n: (int(hashlib.sha256(f"s:{key}:{n}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    tries = [scale * math.sqrt(-2 * math.log(unit(2 * i))) * math.cos(2 * math.pi * unit(2 * i + 1)) for i in range(samplers.TRIES)]
    return next((z for z in tries if abs(z) <= truncation), max(-truncation, min(truncation, tries[-1])))


@pytest.mark.parametrize("truncation", [2.0, 0.3, 0.02])
def test_first_try_inside(spark, truncation):
    rows = spark.range(300).select("id", samplers.truncated_normal("s", F.col("id"), 1.0, 1.5, truncation).alias("x")).collect()
    assert all(r.x == pytest.approx(1.0 + plain(r.id, 1.5, truncation), abs=1e-9) for r in rows)


def test_cost_of_tries(spark):
    k, began = F.col("id"), time.time()
    rows = spark.range(400_000).select(samplers.truncated_normal("s", k, 3.0, 1.5, 2.0).alias("a"), samplers.log_truncated_normal("s", k, 0.0, 1.5, 2.0).alias("b"))
    rows.write.format("noop").mode("overwrite").save()
    assert time.time() - began < 25
