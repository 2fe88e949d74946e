"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word classes that the contracts name, after lower-casing A-Z.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor shares; a local one only where it is unset in local mode."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="axisflow-")
    return f"{base.rstrip('/')}/axisflow-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, so that lost executors cost no recomputation."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of df needs."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def quoted(df: DataFrame) -> list[str]:
    """All columns of df as names that may hold dots."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def words_column(text):
    """Lower-cased ASCII letters; maximal runs of digits, letters and non-ASCII characters. Null: no words."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # equal for ASCII, where lower is much faster
    parts = F.split(low, NON_WORD)
    return F.filter(parts, lambda w: w != "")
