"""Activity lines: `SPEAKER file channel start duration <NA> <NA> speaker <NA> <NA>`, in seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def to_lines(iv: DataFrame, rate: int) -> DataFrame:
    """line of each (file_id, speaker, start, stop) in samples."""
    seconds = lambda c: (c.cast("decimal(30,6)") / rate).cast("decimal(30,6)").cast("string")
    return iv.select(F.concat_ws(" ", F.lit("SPEAKER"), F.col("file_id"), F.lit("1"), seconds(F.col("start")), seconds(F.col("stop") - F.col("start")), F.lit("<NA> <NA>"), F.col("speaker"), F.lit("<NA> <NA>")).alias("line"))


def parse_lines(lines: DataFrame, rate: int) -> DataFrame:
    p = F.split(F.trim("line"), r"\s+")
    samples = lambda c: F.round(c.cast("decimal(30,6)") * rate).cast("long")
    rows = lines.where(p[0] == "SPEAKER").select(p[1].alias("file_id"), p[7].alias("speaker"), samples(p[3]).alias("start"), (p[3].cast("decimal(30,6)") + p[4].cast("decimal(30,6)")).alias("_end"))
    return rows.select("file_id", "speaker", "start", samples(F.col("_end")).alias("stop"))


def read(spark: SparkSession, path: str, rate: int) -> DataFrame:
    return parse_lines(spark.read.text(path).withColumnRenamed("value", "line"), rate)


def write(iv: DataFrame, path: str, rate: int) -> None:
    to_lines(iv, rate).write.text(path)
