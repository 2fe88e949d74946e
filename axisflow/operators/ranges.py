"""Ordered work along the axis of each key, also where one key holds more rows than a task should: its axis is cut into ranges.

Windows run inside (key, range); what they leave open at the borders is closed by a window over one row a range.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT = 4_000_000  # rows of a key that one task takes in one piece
PIECES = 1024  # ranges of a key at most


def free(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores in front as none of the taken ones needs."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share (in local mode, a temporary one if that is unset)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="axisflow-")
    return f"{base.rstrip('/')}/axisflow-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def joined(left: DataFrame, right: DataFrame, by: list[str], small: bool = False, how: str = "left") -> DataFrame:
    """left with right's other columns, null keys being equal; right is broadcast only if `small`, which callers bound."""
    names = dict(zip(by, free([*left.columns, *right.columns], *(f"of_{c}" for c in by)), strict=True))
    right = right.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns))
    same = None
    for c, other in names.items():
        one = F.col(f"`{c}`").eqNullSafe(F.col(f"`{other}`"))
        same = one if same is None else same & one
    out = left.join(F.broadcast(right) if small else right, same, how)
    return out.drop(*names.values())


def cuts(places: DataFrame, by: list[str], at: str, limit: int = LIMIT) -> DataFrame | None:
    """(by.., cuts): ascending places that part the axis of every key with more than `limit` rows into about equal ranges; None: no such key.

    Tables too small to hold such a key by Catalyst's estimate (16 bytes a row, up to ten times smaller on disk) are not counted.
    """
    if estimated_bytes(places) < 1.6 * limit:
        return None
    hot = stored(places.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > limit))
    keys = hot.count()
    if not keys:
        return None
    n, points, found = free(by, "n", "points", "cuts")
    hot = hot.withColumnRenamed("n", n) if n != "n" else hot
    some = joined(places.select(*by, at), hot, by, keys <= 100_000, "inner")
    ranges = F.least(F.ceil(F.max(n) / limit), F.lit(PIECES))
    every = F.floor(PIECES / ranges).cast("int")
    share = F.percentile_approx(at, [i / PIECES for i in range(1, PIECES)], F.lit(10 * PIECES))
    each = some.groupBy(*by).agg(share.alias(points), every.alias(n))
    return stored(each.select(*by, F.array_distinct(F.filter(points, lambda x, i: (i + 1) % F.col(n) == 0)).cast("array<long>").alias(found)))


def ranged(rows: DataFrame, by: list[str], at: str, parts: DataFrame | None, name: str) -> DataFrame:
    """rows with `name`: the number of cuts of their key up to `at`, by a search that halves; 0 for keys without cuts."""
    if parts is None:
        return rows.withColumn(name, F.lit(0))
    column, = (c for c in parts.columns if c not in by)
    inner, = free(rows.columns, "cuts")
    both = joined(rows, parts.withColumnRenamed(column, inner), by, parts.count() <= 1000)  # 8 KB a key at most
    steps = F.array(*(F.lit(PIECES >> k) for k in range(PIECES.bit_length())))
    found = F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= F.size(inner)) & (F.get(inner, n + s - 1) <= F.col(at)), n + s).otherwise(n))
    return both.withColumn(name, F.coalesce(found, F.lit(0))).drop(inner)


def running(rows: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str | Column], piece: str | None, follow: dict[str, str] | None = None) -> DataFrame:
    """rows with running sums over each key up to each row (name: what is summed) and, by `follow`, values of the row behind (name: column).

    `piece` names the column of ranged(), whose ranges ascend with `order`; None: keys are whole.
    """
    follow = follow or {}
    inside = Window.partitionBy(*by, *([piece] if piece else [])).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({n: F.sum(x).over(so_far) for n, x in sums.items()} | {n: F.lead(c).over(inside) for n, c in follow.items()})
    if not piece:
        return out
    inner = free([*rows.columns, *sums, *follow], *(f"all_{n}" for n in sums), *(f"first_{n}" for n in follow), "lead_of")
    totals = dict(zip(sums, inner, strict=False))
    firsts = dict(zip(follow, inner[len(sums):], strict=False))
    lead = inner[-1]
    rows_of = out.withColumn(lead, F.row_number().over(inside))
    heads = rows_of.groupBy(*by, piece).agg(*(F.sum(sums[n]).alias(t) for n, t in totals.items()), *(F.min(F.when(F.col(lead) == 1, F.col(follow[n]))).alias(t) for n, t in firsts.items()), F.count("*").alias(lead))
    over = Window.partitionBy(*by).orderBy(piece)
    heads = heads.select(*by, piece, *(F.sum(t).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(t) for t in totals.values()), *(F.lead(t).over(over).alias(t) for t in firsts.values()))
    both = joined(out, heads, [*by, piece])
    both = both.withColumns({n: F.col(n) + F.coalesce(F.col(t), F.lit(0)) for n, t in totals.items()} | {n: F.coalesce(F.col(n), F.col(t)) for n, t in firsts.items()})
    return both.drop(*totals.values(), *firsts.values())
