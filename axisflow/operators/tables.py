"""Grouping, filtering and set tests over tables and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import free, joined


def groupby_ordered(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The values of each group as one list in a stated order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*by).agg(F.transform(rows, lambda x: x["_v"]).alias("items"))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def squeeze(df: DataFrame) -> tuple[dict, DataFrame]:
    """Columns that hold one value only, as a dict, and the rest; one aggregation."""
    flat = [c for c, t in df.dtypes if not t.startswith("map")]
    row = df.agg(*(F.min(c).alias(f"lo_{c}") for c in flat), *(F.max(c).alias(f"hi_{c}") for c in flat), *(F.count(c).alias(f"n_{c}") for c in flat), F.count("*").alias("_n")).first()
    same = {c: row[f"lo_{c}"] for c in flat if row[f"n_{c}"] in (0, row["_n"]) and row[f"lo_{c}"] == row[f"hi_{c}"]}
    return same, df.drop(*same)


def all_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column, whether its non-null values differ."""
    return df.agg(*((F.count(c) == F.countDistinct(c)).alias(c) for c in columns))


def query(df: DataFrame, conditions: str | list[str]) -> DataFrame:
    """Rows that all conditions hold for; that there are none is the caller's to test with isEmpty()."""
    for condition in [conditions] if isinstance(conditions, str) else conditions:
        df = df.where(condition)
    return df


def summary(df: DataFrame, columns: list[str], order: list[str], most: int = 3) -> DataFrame:
    """One row a column: its first `most` distinct values in the order of the rows, as text, and `...` if there are more."""
    parts = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    rows = df.select(F.struct(*order).alias("at"), F.inline(parts)).groupBy("name", "value").agg(F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("at"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= most + 1)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("value", F.lit("None")).alias("value")))), lambda x: F.when(x["nth"] <= most, x["value"]).otherwise("..."))
    return first.groupBy("name").agg(F.array_join(listed, ", ").alias("values"))


def distinct_in_order(x: Column) -> Column:
    """Distinct elements, first seen first."""
    return F.array_distinct(x)


def zip_strict(a: Column, b: Column) -> Column:
    """Pairs of two arrays; other lengths fail."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.when(F.size(a) == F.size(b), pairs).otherwise(F.raise_error(F.lit("lengths differ")))


def interleave(*arrays: Column) -> Column:
    """One element of each in turn; shorter arrays drop out."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), *(F.size(a) - 1 for a in arrays)))
    pick = lambda i: F.filter(F.array(*(F.struct((i < F.size(a)).alias("has"), F.get(a, i).alias("v")) for a in arrays)), lambda x: x["has"])
    return F.flatten(F.transform(places, lambda i: F.transform(pick(i), lambda x: x["v"])))


def all_equal(x: Column) -> Column:
    """Exactly one distinct element."""
    return F.size(F.array_distinct(x)) == 1


def all_in(x: Column, y: Column) -> Column:
    return F.size(F.array_except(x, y)) == 0


def any_in(x: Column, y: Column) -> Column:
    return F.size(F.array_intersect(x, y)) > 0


def normalize_mean_variance(df: DataFrame, by: list[str], value: str, out: str, eps: float = 1e-6) -> DataFrame:
    """df with (value - mean) / (deviation + eps) within each key: moments by partial aggregation and a join, not a window; null keys are one key."""
    mean, deviation = free(df.columns, "mean", "deviation")
    moments = df.groupBy(*by).agg(F.avg(value).alias(mean), F.stddev_pop(value).alias(deviation))
    return joined(df, moments, by).withColumn(out, (F.col(value) - F.col(mean)) / (F.col(deviation) + eps)).drop(mean, deviation)
