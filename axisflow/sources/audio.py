"""WAV files through Spark's binary file source: 16 and 32-bit integers, 32 and 64-bit floats."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = "sample_rate int, channels array<array<double>>"
HEADER = "sample_rate int, n_channels int, n_samples long, width int, floating boolean"
TYPES = {"int16": ("<i2", 1), "int32": ("<i4", 1), "float32": ("<f4", 3), "float64": ("<f8", 3)}
SLICE = r"^(.*?)::\[\s*(-?\d*)\s*:\s*(-?\d*)\s*(?:,\s*(\d+)\s*(?::\s*(\d+)\s*)?)?\]$"


def header(content: bytes) -> tuple[int, int, int, int, bool, int]:
    """Rate, channels, samples a channel, bytes a sample, whether floating, and where the samples begin; RIFF chunks are walked."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt ":
            code, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", content, at + 8)
            code = struct.unpack_from("<H", content, at + 32)[0] if code == 0xFFFE else code
            form = (rate, channels, block, bits // 8, code == 3)
        if name == b"data" and form:
            rate, channels, block, width, floating = form
            return rate, channels, min(size, len(content) - at - 8) // block, width, floating, at + 8
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode(content: bytes, start: int = 0, stop: int | None = None, channel: tuple[int, int] | None = None, fill: bool = False) -> tuple[int, np.ndarray]:
    """Rate and (channels, samples) as doubles, integers scaled to [-1, 1); only the part asked for is converted."""
    rate, channels, n, width, floating, at = header(content)
    kind = {(2, False): "<i2", (4, False): "<i4", (4, True): "<f4", (8, True): "<f8"}[width, floating]
    begin, end, _ = slice(start, stop).indices(n)
    x = np.frombuffer(content, kind, max(end - begin, 0) * channels, at + begin * channels * width).reshape(-1, channels).T
    x = x[slice(*channel)] if channel else x
    x = x.astype(float) / (1 if floating else 2.0 ** (8 * width - 1))
    if fill and stop is not None and stop - start > x.shape[1]:
        x = np.pad(x, ((0, 0), (0, stop - start - x.shape[1])))
    return rate, x


def encode(rate: int, channels, kind: str = "int16", normalize: bool = False) -> bytes:
    """WAV bytes; integers are scaled by 2^(bits - 1), rounded and clipped; normalize sets the peak to (2^15 - 1) / 2^15 first."""
    x = np.stack([np.asarray(c, float) for c in channels])
    if normalize and x.size and np.abs(x).max() > 0:
        x = x * ((2**15 - 1) / 2**15 / np.abs(x).max())
    form, code = TYPES[kind]
    bits = 8 * np.dtype(form).itemsize
    if code == 1:
        x = (x * 2.0 ** (bits - 1)).round().clip(-(2.0 ** (bits - 1)), 2.0 ** (bits - 1) - 1)
        if kind == "int16":
            out = io.BytesIO()
            with wave.open(out, "wb") as f:
                f.setnchannels(len(x)), f.setsampwidth(2), f.setframerate(rate)
                f.writeframes(x.T.astype(form).tobytes())
            return out.getvalue()
    data, block = x.T.astype(form).tobytes(), len(x) * bits // 8
    form_chunk = struct.pack("<4sIHHIIHH", b"fmt ", 16, code, len(x), rate, rate * block, block, bits)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form_chunk) + 8 + len(data), b"WAVE") + form_chunk + struct.pack("<4sI", b"data", len(data)) + data


def parse_slice(path: Column) -> Column:
    """struct(path, start, stop, first, last) of `file.wav::[a:b,c:d]`; without a slice everything; a single channel c is c to c + 1."""
    part = lambda i: F.nullif(F.regexp_extract(path, SLICE, i), F.lit("")).cast("long")
    first = part(4)
    return F.struct(F.regexp_replace(path, r"::\[.*\]$", "").alias("path"), F.coalesce(part(2), F.lit(0)).alias("start"), part(3).alias("stop"), first.alias("first"), F.coalesce(part(5), first + 1).alias("last"))


def decoded(content: Column, start: int = 0, stop: int | None = None, channel: int | None = None, fill: bool = False) -> Column:
    """struct(sample_rate, channels) of WAV bytes, or of a part of them."""
    @F.pandas_udf(AUDIO)
    def run(files: pd.Series) -> pd.DataFrame:
        found = [decode(bytes(f), start, stop, None if channel is None else (channel, channel + 1), fill) for f in files]
        return pd.DataFrame({"sample_rate": [r for r, _ in found], "channels": [x.tolist() for _, x in found]})

    return run(content)


def decoded_part(content: Column, part: Column) -> Column:
    """struct(sample_rate, channels) of the part of WAV bytes that a struct of parse_slice names."""
    @F.pandas_udf(AUDIO)
    def run(files: pd.Series, start: pd.Series, stop: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        whole = lambda x: None if pd.isna(x) else int(x)
        found = [decode(bytes(f), int(a), whole(b), None if pd.isna(c) else (int(c), int(e))) for f, a, b, c, e in zip(files, start, stop, first, last, strict=True)]
        return pd.DataFrame({"sample_rate": [r for r, _ in found], "channels": [x.tolist() for _, x in found]})

    return run(content, *(part.getField(f) for f in ("start", "stop", "first", "last")))


def encoded(rate: Column, channels: Column, kind: str = "int16", normalize: bool = False) -> Column:
    @F.pandas_udf("binary")
    def run(rates: pd.Series, arrays: pd.Series) -> pd.Series:
        return pd.Series([encode(int(r), a, kind, normalize) for r, a in zip(rates, arrays, strict=True)])

    return run(rate, channels)


def params(content: Column) -> Column:
    """struct of what the header says: rate, channels, samples, bytes a sample, floating; samples are not converted."""
    @F.pandas_udf(HEADER)
    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header(bytes(f))[:5] for f in files], columns=["sample_rate", "n_channels", "n_samples", "width", "floating"])

    return run(content)


def raw(content: Column, kind: str = "<i2") -> Column:
    """Values of a file without header."""
    @F.pandas_udf("array<double>")
    def run(files: pd.Series) -> pd.Series:
        return files.map(lambda f: np.frombuffer(bytes(f), kind).astype(float).tolist(), na_action="ignore")

    return run(content)


def is_sphere(content: Column) -> Column:
    """Whether bytes begin as a NIST SPHERE file."""
    return F.hex(F.substring(content, 1, 7)) == "NIST_1A".encode().hex().upper()


def clipped_samples(x: Column) -> Column:
    """How many values pass the largest 16-bit sample."""
    return F.size(F.filter(x, lambda v: v > 32767))


def read(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, channel: int | None = None, fill: bool = False) -> DataFrame:
    """path, sample_rate, channels of each file."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content"), start, stop, channel, fill).alias("a")).select("path", "a.*")


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """path and the header of each file."""
    return spark.read.format("binaryFile").load(path).select("path", params(F.col("content")).alias("h")).select("path", "h.*")
