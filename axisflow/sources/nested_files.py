"""Whole collections of files: nested structures of paths, a cache of decoded files, and audio files from rows."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from axisflow.operators.ranges import free, stored

from . import audio

Decoder = Callable[[Column, Column], Column]  # (content, path as it was given) -> data
BLOCK = 1 << 23  # bytes of files that a task's Python holds at once, if no single file is larger
OPENED = "leaf string, content binary"


def _plain(path: Column) -> Column:
    """A path without its slice, and local ones without their scheme, as Spark's file source and users write them differently."""
    return F.regexp_replace(F.regexp_replace(path, r"::\[.*\]$", ""), "^file:/+", "/")


def path_leaves(kind: DataType, value: Column) -> Column:
    """array<string>: all text leaves of a value made of structs, arrays and maps (their values), by its schema."""
    none = F.array().cast("array<string>")
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(value)).otherwise(none)
    if isinstance(kind, StructType):
        return F.concat(none, *(path_leaves(f.dataType, value.getField(f.name)) for f in kind.fields))
    if isinstance(kind, (ArrayType, MapType)):
        inner, items = (kind.elementType, value) if isinstance(kind, ArrayType) else (kind.valueType, F.map_values(value))
        return F.coalesce(F.flatten(F.transform(items, lambda x: path_leaves(inner, x))), none)
    raise TypeError(f"{kind.simpleString()} is no path and no collection of paths")


def replaced_leaves(kind: DataType, value: Column, found: Column) -> Column:
    """The same structure with every text leaf replaced by what the map `found` has for it."""
    if isinstance(kind, StringType):
        return F.element_at(found, value)
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(replaced_leaves(f.dataType, value.getField(f.name), found).alias(f.name) for f in kind.fields)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: replaced_leaves(kind.elementType, x, found))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: replaced_leaves(kind.valueType, x, found))
    raise TypeError(f"{kind.simpleString()} is no path and no collection of paths")


def _in_folders(spark: SparkSession, path: Column) -> Column:
    """Whether a path lies in folders that driver and executors mount: `file:`, or no scheme where Spark's default is local."""
    scheme = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):/", 1)
    local = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").startswith("file:")
    return scheme.isin("file", "") if local else scheme == "file"


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, content) of rows (leaf, file); leaves of one file that follow each other read it once."""
    last, content, held, size = None, b"", [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([x for _, x in held], pa.binary())], ["leaf", "content"])

    for batch in batches:
        for leaf, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if file != last:
                if not os.path.isfile(file):
                    raise FileNotFoundError(f"path is no file: {file}")
                with open(file, "rb") as f:
                    last, content = file, f.read()
            if held and size + len(content) > BLOCK:
                yield block()
                held, size = [], 0
            held.append((leaf, content))
            size += len(content)
    if held:
        yield block()


def contents(leaves: DataFrame) -> DataFrame:
    """(leaf, content) of a table of distinct `leaf`s, paths with or without slices; a file that is not there fails the job.

    Files in folders that driver and executors share are opened by the tasks that hold their leaves, always as many as Spark shuffles to,
    for what paths stand for is far more than their bytes, by which Spark joins small partitions. Others, in stores that only Spark reads,
    come in one scan, whose list of names is the driver's as of any file source.
    """
    spark = leaves.sparkSession
    mounted, rows = _in_folders(spark, F.col("leaf")), leaves.select("leaf", _plain(F.col("leaf")).alias("path"))
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit(f"{os.getcwd()}/"), "path"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.where(mounted).select("leaf", full.alias("file")).repartition(tasks, F.xxhash64("leaf")).sortWithinPartitions("file").mapInArrow(_opened, OPENED)
    others = rows.where(~mounted)
    names = [r.path for r in others.select("path").distinct().collect()]
    if not names:
        return found
    files = spark.read.format("binaryFile").load(names).select(_plain(F.col("path")).alias("path"), "content")
    return found.unionByName(others.join(files, "path").select("leaf", "content"))


def recursive_load(df: DataFrame, column: str, decode: Decoder) -> DataFrame:
    """df with every path in `column`, a path or a structure of structs, arrays and maps of paths, replaced by decode(content, path).

    Each distinct leaf is read and decoded once, and the structure is built again from its schema. Null paths stay null; a file that is
    not there fails the job; other types than text fail at once.
    """
    row, leaf, data, found = free(df.columns, "row", "leaf", "data", "found")
    kind = df.schema[column].dataType
    rows = stored(df.withColumn(row, F.monotonically_increasing_id()))
    leaves = rows.select(row, F.explode(F.array_distinct(path_leaves(kind, F.col(f"`{column}`")))).alias(leaf))
    read = contents(leaves.select(F.col(leaf).alias("leaf")).distinct())
    decoded = read.select(F.col("leaf").alias(leaf), decode(F.col("content"), F.col("leaf")).alias(data))
    maps = leaves.join(decoded, leaf).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(leaf, data))).alias(found))
    both = rows.join(maps, row, "left")
    built = replaced_leaves(kind, F.col(f"`{column}`"), F.col(found))
    return both.select(*(built.alias(c) if c == column else F.col(f"`{c}`") for c in df.columns))


def audio_decoder(content: Column, path: Column) -> Column:
    """struct(sample_rate, channels) of a WAV file, or of the part that `file.wav::[a:b,c:d]` names."""
    return audio.decoded_part(content, audio.parse_slice(path))


def load_audio_nested(df: DataFrame, column: str) -> DataFrame:
    """df with every path of WAV files in the nested `column` replaced by struct(sample_rate, channels)."""
    return recursive_load(df, column, audio_decoder)


KEYS = ["path", "length", "modificationTime"]


@dataclass(frozen=True)
class CachedLoader:
    """Decoded files in a Parquet table that all executors share, by path, size and time of change.

    What the table lacks is decoded and appended; nothing else is read again but the files' status. Two runs at a time may append a file
    twice; one of its rows is used. Old versions of changed files stay until the folder is removed.
    """

    spark: SparkSession
    folder: str
    decode: Callable[[Column], Column]

    def _held(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def missing(self, paths: str | list[str]) -> list[str]:
        """Files that a load would decode; their names are the driver's as of any file source."""
        status, held = self._status(paths), self._held()
        rows = status if held is None else status.join(held.select(*KEYS), KEYS, "left_anti")
        return [r.path for r in rows.select("path").distinct().collect()]

    def _status(self, paths: str | list[str]) -> DataFrame:
        return self.spark.read.format("binaryFile").load(paths).select(*KEYS)

    def load(self, paths: str | list[str]) -> DataFrame:
        """(path, data) of all files."""
        todo = self.missing(paths)
        if todo:
            fresh = self.spark.read.format("binaryFile").load(todo)
            fresh.select(*KEYS, self.decode(F.col("content")).alias("data")).write.mode("append").parquet(self.folder)
        held = self._held()
        if held is None:
            raise FileNotFoundError(f"no files at {paths}")
        return self._status(paths).join(held.dropDuplicates(KEYS), KEYS).select("path", "data")


class AudioFiles(DataSource):
    """Writer of WAV files from rows (name, sample_rate, channels) to a folder that driver and executors share.

    Each task writes to its own part of a staging folder, whose name hides it from Spark; only when all have ended does the driver, which
    gets their names, move the files there. A failed job leaves none, though a task that is killed meanwhile may leave files in the staging folder.
    """

    @classmethod
    def name(cls) -> str:
        return "axisflow_audio"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _AudioWriter(self.options["path"], self.options.get("kind", "int16"), schema.names, overwrite)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _AudioWriter(DataSourceWriter):
    def __init__(self, folder: str, kind: str, names: list[str], overwrite: bool):
        if not {"name", "sample_rate", "channels"} <= set(names):
            raise ValueError("rows need name, sample_rate and channels")
        self.folder, self.kind, self.overwrite = folder.removeprefix("file:"), kind, overwrite
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> _Written:
        folder, names = f"{self.staging}/{uuid.uuid4().hex}", []
        os.makedirs(folder)
        for row in iterator:
            if row.name is None or row.channels is None or os.path.isabs(row.name) or ".." in row.name.split("/"):
                raise ValueError(f"no place for a file: {row.name!r}")
            with open(f"{folder}/{len(names)}", "wb") as f:
                f.write(audio.encode(row.sample_rate, row.channels, self.kind, False))
            names.append(row.name)
        return _Written(folder, names)

    def commit(self, messages: list) -> None:
        files = [(f"{m.folder}/{i}", f"{self.folder}/{name}") for m in messages if m is not None for i, name in enumerate(m.names)]
        folders = {os.path.dirname(to) for _, to in files}
        held = set() if self.overwrite else {x for x in folders if self._holds(x)}
        taken = [to for _, to in files if os.path.dirname(to) in held and os.path.exists(to)] if held else []
        if taken or len({to for _, to in files}) < len(files):
            self.abort(messages)
            raise ValueError(f"names are not free: {sorted(taken)[:3] or 'some are repeated'}")
        for folder in folders:
            os.makedirs(folder, exist_ok=True)
        for at, to in files:
            os.replace(at, to)
        self._clear()

    def _holds(self, folder: str) -> bool:
        """Whether something but this staging folder is there, which a new file could meet."""
        if not os.path.isdir(folder):
            return False
        with os.scandir(folder) as found:
            return any(x.path != self.staging for x in found)

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        if os.path.isdir(self.staging):
            shutil.rmtree(self.staging, ignore_errors=True)


def write_audio(df: DataFrame, folder: str, kind: str = "int16", overwrite: bool = False) -> None:
    """WAV files of rows (name, sample_rate, channels), one a row at folder/name, all or none."""
    df.sparkSession.dataSource.register(AudioFiles)
    df.select("name", "sample_rate", "channels").write.format("axisflow_audio").mode("overwrite" if overwrite else "append").option("kind", kind).save(folder)
