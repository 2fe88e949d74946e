"""Segment lines: `utterance file start end`, in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, rate: int, round_fn=None) -> DataFrame:
    """file_id, utterance, start, stop in samples of each line; other than four fields, or a time between samples, fails.

    Times are exact decimals; round_fn (such as F.round or F.floor) lets them be between samples.
    """
    p = F.split(F.trim("line"), r"\s+")
    four = F.when(F.size(p) == 4, p).otherwise(F.raise_error(F.concat(F.lit("not four fields: "), F.col("line"))).cast("array<string>"))

    def samples(seconds: Column) -> Column:
        x = seconds.cast("decimal(30,6)") * rate
        if round_fn is not None:
            return round_fn(x).cast("long")
        return F.when(x == F.floor(x), x.cast("long")).otherwise(F.raise_error(F.concat(F.lit("between samples: "), seconds)).cast("long"))

    rows = lines.where(F.trim("line") != "").select(four.alias("p"))
    return rows.select(F.col("p")[1].alias("file_id"), F.col("p")[0].alias("utterance"), samples(F.col("p")[2]).alias("start"), samples(F.col("p")[3]).alias("stop"))


def read(spark: SparkSession, path: str, rate: int, round_fn=None) -> DataFrame:
    return parse_lines(spark.read.text(path).withColumnRenamed("value", "line"), rate, round_fn)
