"""Array columns through NumPy in whole Arrow buffers: rows of one length are one matrix, and results are buffers again."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 17  # values of a matrix at once


def _values(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All numbers of (nested) lists, where each row's end, and each row's shape; the job fails where a row's inner lists differ in length."""
    inner, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    ends, shape = np.concatenate([[0], np.cumsum(sizes)]), [sizes]
    if pa.types.is_list(inner.type):
        widths = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
        first = np.append(widths, 0)[ends[:-1]] * (sizes > 0)
        if (widths != np.repeat(first, sizes)).any():
            raise ValueError("inner arrays of unequal length")
        inner, ends, shape = inner.flatten(), np.concatenate([[0], np.cumsum(sizes * first)]), [sizes, first]
    return inner.to_numpy(zero_copy_only=False).astype(float, copy=False), ends, shape


def _spans(shape: list[np.ndarray], cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of one shape that cost CELLS together at most, or single rows."""
    n = len(cost)
    change = np.flatnonzero(np.any([s[1:] != s[:-1] for s in shape], axis=0)) + 1
    for first, last in zip([0, *change], [*change, n], strict=True):
        step = max(1, CELLS // max(int(cost[first]), 1)) if first < n else 1
        for a in range(first, last, step):
            yield a, min(a + step, last)


def matrices(lists: list[pa.Array], cost: Callable[..., np.ndarray] | None = None) -> Iterator[list[np.ndarray]]:
    """The rows in order, as one array a column with the rows first, in runs of one shape and CELLS values (or what `cost` says of the shapes) at most."""
    parts = [_values(x) for x in lists]
    shape = [s for _, _, of in parts for s in of]
    for a, b in _spans(shape, cost(*shape) if cost else sum(np.diff(ends) for _, ends, _ in parts)):
        yield [values[ends[a] : ends[b]].reshape(b - a, *(int(s[a]) for s in of)) for values, ends, of in parts]


def on_lists(fn: Callable[..., np.ndarray], *columns: Column) -> Column:
    """array<double>: fn of arrays whose rows are equally shaped values of the columns; a null in one of them gives a null.

    Only these columns go to Python, and a batch's rows are worked on in small blocks.
    """
    @F.arrow_udf("array<double>")
    def run(*lists: pa.Array) -> pa.Array:
        null = np.any([x.is_null().to_numpy(zero_copy_only=False) for x in lists], axis=0)
        lists = [pc.if_else(pa.array(null), pa.scalar(None, x.type), x) for x in lists] if null.any() else lists
        found = [np.ascontiguousarray(fn(*m), float) for m in matrices(lists)]
        sizes = np.concatenate([np.full(len(f), f.shape[1]) for f in found]) if found else np.zeros(0, int)
        flat = np.concatenate([f.reshape(-1) for f in found]) if found else np.zeros(0)
        ends = np.concatenate([[0], np.cumsum(np.where(null, 0, sizes))])
        if null.any():
            flat = flat[~np.repeat(null, sizes)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(null))

    return run.asNondeterministic()(*columns)  # so that a filter on the result is not pushed below it, with the work done twice


def _nested(parts: list[np.ndarray], depth: int) -> pa.Array:
    """One list column of `depth` levels from blocks whose first axis is the rows."""
    out = pa.array(np.concatenate([p.reshape(-1) for p in parts]) if parts else np.zeros(0))
    for level in range(depth, 0, -1):
        sizes = [np.full(int(np.prod(p.shape[:level])), p.shape[level]) for p in parts]
        out = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(np.concatenate(sizes) if sizes else [])]), pa.int32()), out)
    return out


def on_blocks(df: DataFrame, column: str, fn: Callable[[np.ndarray], tuple[np.ndarray, ...]], results: dict[str, int]) -> DataFrame:
    """df with a column for each name in results, nested arrays of doubles of that depth.

    fn takes a matrix whose rows are equally long values of `column` and returns one array a result, rows first. Nulls count
    as empty, for which fn is called with rows of length 0.
    """
    rows = df.withColumn(column, F.transform(F.coalesce(F.col(column), F.array().cast("array<double>")), lambda v: v.cast("double")))
    return mapped(rows, [column], fn, results)


def mapped(rows: DataFrame, columns: list[str], fn: Callable[..., tuple[np.ndarray, ...]], results: dict[str, int]) -> DataFrame:
    """on_blocks for several columns, which may be nested: fn takes an array a column. All columns of rows go through Python, so select before."""
    kinds = ", ".join(f"`{name}` {'array<' * depth}double{'>' * depth}" for name, depth in results.items())
    names = [*rows.columns, *results]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size, at = [], 0, 0
            for parts in matrices([batch.column(c) for c in columns]):
                found.append((len(parts[0]), fn(*parts)))
                size += sum(x.size for x in parts)
                if size >= CELLS:
                    yield put(batch, at, found)
                    at, found, size = at + sum(n for n, _ in found), [], 0
            if found:
                yield put(batch, at, found)

    def put(batch: pa.RecordBatch, at: int, found: list) -> pa.RecordBatch:
        more = [_nested([np.ascontiguousarray(f[i], float) for _, f in found], depth) for i, depth in enumerate(results.values())]
        return pa.RecordBatch.from_arrays([*batch.slice(at, sum(n for n, _ in found)).columns, *more], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, {kinds}")
