"""One reader and one writer for many file types, by their extension; all through Spark's own sources and sinks.

Types whose reading runs code (pickles, YAML with tags) are refused.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructType

from . import audio

KINDS = {"json": "json", "jsonl": "json", "csv": "csv", "tsv": "csv", "txt": "text", "parquet": "parquet", "orc": "orc", "wav": "wav", "yaml": "yaml", "yml": "yaml"}
DELIMITERS = ",;\t| :"


def kind_of(path: str, kind: str | None = None) -> str:
    """The type by extension; .gz counts for nothing, a slice behind `::` neither."""
    name = path.split("::")[0].rstrip("/").removesuffix(".gz").rpartition("/")[2]
    found = KINDS.get(kind or name.rpartition(".")[2].lower())
    if found is None:
        raise ValueError(f"no reader for {path}")
    return found


def read_any(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    found = kind_of(path, kind)
    if found == "wav":
        return audio.read(spark, path)
    if found == "yaml":
        return read_yaml(spark, path)
    if found == "csv":
        return read_csv(spark, path, **({"sep": "\t"} if path.split(".gz")[0].endswith("tsv") else {}) | options)
    if found == "json":
        return spark.read.options(**{"multiLine": "true", **options}).json(path)
    return spark.read.options(**options).format(found).load(path)


def write_any(df: DataFrame, path: str, kind: str | None = None, **options) -> None:
    """Rows to files of a type, which appear as a whole; for WAV a file a row (name, sample_rate, channels) below the folder."""
    found = kind_of(path, kind)
    if found == "wav":
        from . import nested_files

        return nested_files.write_audio(df, path, **options)
    if found not in ("json", "csv", "text", "parquet", "orc"):
        raise ValueError(f"no writer for {path}")
    defaults = {"csv": {"header": "true"}}.get(found, {})
    df.write.options(**defaults | options).format(found).save(path)


def read_csv(spark: SparkSession, path: str, fields: list[str] | None = None, sep: str | None = ",", **options) -> DataFrame:
    """All values as text; the first line names the fields, unless they are given; without sep it is told from the first lines."""
    if sep is None:
        lines = [r.value for r in spark.read.text(path).limit(20).collect()]  # bounded
        sep = sniff("\n".join(lines))
    rows = spark.read.options(**{"header": str(fields is None).lower(), "sep": sep, "inferSchema": "false", **options}).csv(path)
    return rows.toDF(*fields) if fields else rows


def sniff(head: str) -> str:
    """The delimiter that stands equally often, and most often, in every line."""
    lines = [x for x in head.split("\n") if x.strip()]
    even = [(lines[0].count(d), d) for d in DELIMITERS if lines and lines[0].count(d) and len({x.count(d) for x in lines}) == 1]
    return max(even, key=lambda x: (x[0], -DELIMITERS.index(x[1])), default=(0, ","))[1]


def from_csv_text(text: Column, fields: list[str], sep: str = ",") -> Column:
    """Struct of texts from one CSV line a row."""
    return F.from_csv(text, ", ".join(f"`{f}` string" for f in fields), {"sep": sep})


def to_json_text(value: Column, pretty: bool = False) -> Column:
    """JSON text; timestamps as yyyy-MM-dd_HH-mm-ss, nulls kept."""
    return F.to_json(value, {"timestampFormat": "yyyy-MM-dd_HH-mm-ss", "timestampNTZFormat": "yyyy-MM-dd_HH-mm-ss", "ignoreNullFields": "false", "pretty": str(pretty).lower()})


def sorted_fields(kind: DataType, value: Column) -> Column:
    """The struct with its fields, and those of structs below, in the order of their names."""
    if not isinstance(kind, StructType):
        return value
    return F.struct(*(sorted_fields(f.dataType, value.getField(f.name)).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))


def summary_json(df: DataFrame, columns: list[str]) -> Column:
    """JSON text in which arrays are told by their size and type only."""
    def short(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        return F.concat(F.lit("array(shape=("), F.size(c).cast("string"), F.lit(f",), dtype={kind[6:-1]})")) if kind.startswith("array<") else F.col(c)

    return F.to_json(F.struct(*(short(c).alias(c) for c in columns)))


@F.pandas_udf(StringType())
def yaml_to_json(texts: pd.Series) -> pd.Series:
    """Plain YAML only; tags fail."""
    import yaml

    return texts.map(lambda t: json.dumps(yaml.safe_load(t), default=str), na_action="ignore")


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """path, value (VARIANT) of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.parse_json(yaml_to_json("value")).alias("value"))


# ---- nested tables in place of hierarchical files ----


def leaf_paths(df: DataFrame, sep: str = "/") -> list[str]:
    """Paths of all leaves of the schema."""
    from axisflow.operators.nested import leaves

    return [sep + sep.join(p) for f in df.schema.fields for p, _ in leaves(f.dataType, F.col(f"`{f.name}`"), (f.name,))]


def read_below(spark: SparkSession, path: str, inner: str = "/") -> DataFrame:
    """A nested Parquet table, or what is below one path of it; only that is read."""
    rows = spark.read.parquet(path)
    parts = [p for p in inner.split("/") if p]
    if not parts:
        return rows
    at = F.col(".".join(f"`{p}`" for p in parts))
    kind = rows.select(at.alias("v")).schema["v"].dataType
    return rows.select(at.alias("v")).select("v.*") if isinstance(kind, StructType) else rows.select(at.alias(parts[-1]))


def update_table(df: DataFrame, changes: DataFrame, key: list[str], allow_overwrite: bool = False) -> DataFrame:
    """df with the columns of changes put in for its keys: new columns are added, others replaced only if that is allowed."""
    both = [c for c in changes.columns if c in df.columns and c not in key]
    if both and not allow_overwrite:
        raise ValueError(f"{both} are there already")
    new = changes.select(*key, F.struct(*(c for c in changes.columns if c not in key)).alias("_new"), F.lit(True).alias("_has"))
    joined = df.join(new, key, "left")
    keep = [F.when(F.col("_has"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in both else F.col(c) for c in df.columns]
    return joined.select(*keep, *(F.col(f"_new.{c}").alias(c) for c in changes.columns if c not in df.columns))
