"""Nested columns by their schema: structs are dictionaries, and paths are joined by a separator. Nothing is read to plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def leaves(kind: DataType, at: Column, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Column]]:
    """(path, expression) of every leaf below a struct; arrays and empty structs are leaves."""
    if not isinstance(kind, StructType) or not len(kind.fields):
        return [(path, at)]
    return [leaf for f in kind.fields for leaf in leaves(f.dataType, at.getField(f.name), (*path, f.name))]


def _of(df: DataFrame, column: str) -> list[tuple[tuple[str, ...], Column]]:
    return leaves(df.schema[column].dataType, F.col(f"`{column}`"))


def flatten(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """A column for each leaf, named by its path, in place of `column`."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != column), *(x.alias(sep.join(p)) for p, x in _of(df, column)))


def _tree(entries: list[tuple[list[str], Column]]) -> Column:
    groups: dict[str, list] = {}
    for path, x in entries:
        groups.setdefault(path[0], []).append((path[1:], x))
    for name, below in groups.items():
        if len(below) > 1 and any(not p for p, _ in below):
            raise ValueError(f"{name} is both a leaf and a container")
    return F.struct(*((b[0][1] if not b[0][0] else _tree(b)).alias(name) for name, b in groups.items()))


def deflatten(df: DataFrame, columns: list[str], out: str, sep: str = ".", maxdepth: int = -1) -> DataFrame:
    """Columns named by paths as one struct column; at most maxdepth separators of a name count, all if negative."""
    entries = [(c.split(sep, maxdepth if maxdepth >= 0 else -1), F.col(f"`{c}`")) for c in columns]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in columns), _tree(entries).alias(out))


def get_by_path(df: DataFrame, column: str, path: str, sep: str = ".", default: Column | None = None, early: bool = False) -> Column:
    """The value at a path; where the schema has none, the default, or with `early` the leaf on the way."""
    kind, at = df.schema[column].dataType, F.col(f"`{column}`")
    for name in path.split(sep):
        if not isinstance(kind, StructType) or name not in kind.names:
            if early and not isinstance(kind, StructType):
                return at
            if default is None:
                raise KeyError(path)
            return default
        kind, at = kind[name].dataType, at.getField(name)
    return at if default is None else F.coalesce(at, default)


def set_by_path(column: Column, path: str, value: Column, sep: str = ".") -> Column:
    """The struct with a value put at a path whose containers exist."""
    return column.withField(path.replace(sep, "."), value)


def merge(df: DataFrame, columns: list[str], allow_update: bool = True) -> Column:
    """Struct columns as one, the last one that has a leaf wins; without allow_update a leaf in two of them is an error."""
    found: dict[tuple[str, ...], Column] = {}
    for c in columns:
        for path, x in _of(df, c):
            if path in found and not allow_update:
                raise ValueError(f"{path} is set twice")
            found = {p: v for p, v in found.items() if p[: len(path)] != path or p == path}
            found[path] = x
    return _tree([(list(p), x) for p, x in found.items()])


def apply(df: DataFrame, func: Callable[..., Column], columns: list[str]) -> Column:
    """func of the leaves of the first column and those at the same paths of the others; a column without structs goes with all."""
    first, rest = _of(df, columns[0]), [dict(_of(df, c)) for c in columns[1:]]
    return _tree([(list(p), func(x, *(r[()] if () in r else r[p] for r in rest))) for p, x in first])


def items(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """A row (path, value as text) for each leaf, with the other columns."""
    pairs = F.array(*(F.struct(F.lit(sep.join(p)).alias("path"), x.cast("string").alias("value")) for p, x in _of(df, column)))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != column), F.inline(pairs))


def any_leaf(df: DataFrame, column: str, test: Callable[[Column], Column] = lambda x: x.cast("boolean")) -> Column:
    """Whether a leaf passes; a null leaf does not."""
    return F.exists(F.array(*(F.coalesce(test(x), F.lit(False)) for _, x in _of(df, column))), lambda b: b)


def all_leaves(df: DataFrame, column: str, test: Callable[[Column], Column] = lambda x: x.cast("boolean")) -> Column:
    return F.forall(F.array(*(F.coalesce(test(x), F.lit(False)) for _, x in _of(df, column))), lambda b: b)


def squeeze(df: DataFrame, column: str) -> Column:
    """The value that all leaves (as text) share, else null."""
    values = F.array(*(x.cast("string") for _, x in _of(df, column)))
    return F.when(F.forall(values, lambda v: v.eqNullSafe(F.get(values, F.lit(0)))), F.get(values, F.lit(0)))


class FlatView:
    """A struct column seen as a flat dictionary from paths to expressions."""

    def __init__(self, df: DataFrame, column: str, sep: str = "."):
        self.df, self.column, self.sep = df, column, sep

    def items(self) -> list[tuple[str, Column]]:
        return [(self.sep.join(p), x) for p, x in _of(self.df, self.column)]

    def keys(self) -> list[str]:
        return [k for k, _ in self.items()]

    def values(self) -> list[Column]:
        return [v for _, v in self.items()]

    def get(self, path: str, default: Column | None = None) -> Column:
        return get_by_path(self.df, self.column, path, self.sep, F.lit(None) if default is None else default)

    def __len__(self) -> int:
        return len(self.items())

    def __getitem__(self, path: str) -> Column:
        return get_by_path(self.df, self.column, path, self.sep)

    def __setitem__(self, path: str, value: Column) -> None:
        self.df = self.df.withColumn(self.column, set_by_path(F.col(f"`{self.column}`"), path, value, self.sep))
