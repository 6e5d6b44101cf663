"""Structural operators on nested records: repack, flatten, rename, keyed maps, defaults. All work on the schema at plan time."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

Transform = Callable[[DataFrame], DataFrame]


def field(path: str) -> Column:
    """The column at a `/` path, whatever characters its names have."""
    return F.col(".".join(f"`{p}`" for p in path.split("/")))


def paths(schema: StructType, prefix: str = "") -> list[str]:
    """`/` paths of all leaves."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += paths(f.dataType, f"{name}/") if isinstance(f.dataType, StructType) else [name]
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Every leaf as a column named by its path."""
    return df.select(*(field(p).alias(p) for p in paths(df.schema)))


def nested(leaves: Mapping[str, Column]) -> list[Column]:
    """Columns of nested structs from leaves by path."""
    top: dict[str, dict[str, Column] | Column] = {}
    for path, column in leaves.items():
        head, _, rest = path.partition("/")
        if rest:
            top.setdefault(head, {})[rest] = column
        else:
            top[head] = column
    return [(F.struct(*nested(v)) if isinstance(v, dict) else v).alias(k) for k, v in top.items()]


def unflatten(df: DataFrame) -> DataFrame:
    """Columns named by paths as nested structs."""
    return df.select(*nested({c: F.col(f"`{c}`") for c in df.columns}))


def repack(df: DataFrame, structure: Mapping) -> DataFrame:
    """A new record whose leaves are source paths; unlisted fields are dropped, a missing source is an analysis error."""

    def build(node: Mapping) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, Mapping) else field(v)).alias(k) for k, v in node.items()]

    return df.select(*build(structure))


def rename(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """Leaves renamed by the first pattern that matches a whole path (\\1 for groups), dropped where it is None.

    Two leaves of one name, and a name that is also a node above another, are errors."""
    out: dict[str, Column] = {}
    for path in paths(df.schema):
        new: str | None = path
        for pattern, target in patterns.items():
            if m := re.fullmatch(pattern, path):
                new = m.expand(target) if target is not None else None
                break
        if new is None:
            continue
        if new in out:
            raise ValueError(f"{new} already exists")
        out[new] = field(path)
    for name in out:
        parts = name.split("/")
        for i in range(1, len(parts)):
            if "/".join(parts[:i]) in out:
                raise ValueError(f"{'/'.join(parts[:i])} is a leaf and a node")
    return df.select(*nested(out))


def keyed_map(df: DataFrame, selector: Mapping[str, object], body: Callable[[Column, object], Column], strict: bool = False) -> DataFrame:
    """body(leaf, selector[path]) on the leaves in the selector; with strict, each of its paths must exist."""
    known = paths(df.schema)
    if strict and (missing := set(selector) - set(known)):
        raise ValueError(f"paths are missing: {sorted(missing)}")
    return df.select(*nested({p: body(field(p), selector[p]) if p in selector else field(p) for p in known}))


def depth(schema: StructType, name: str) -> int:
    """How many arrays a column is nested in."""
    kind, n = schema[name].dataType, 0
    while isinstance(kind, ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def default_column(df: DataFrame, name: str, value: str | None) -> DataFrame:
    """The column with a constant if it is absent; a null in an existing column is a value and stays."""
    return df if value is None or name in df.columns else df.withColumn(name, F.lit(value))


def without_strings(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, StringType)))


def merged(left: Mapping[str, Column], right: Mapping[str, Column]) -> dict[str, Column]:
    """Both, the right one winning."""
    return {**left, **right}


def compose(*transforms: Transform) -> Transform:
    return lambda df: reduce(lambda d, f: d.transform(f), transforms, df)


def checked(df: DataFrame, sizes: Mapping[str, int]) -> DataFrame:
    """An error for a row in which an array column has another size."""
    check = lambda c, n: F.when(F.size(c) == n, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"{c}: {n} elements are wanted, not "), F.size(c).cast("string"))))
    return df.withColumns({c: check(c, n) for c, n in sizes.items()})


def same_structure(a: StructType, b: StructType) -> list[str]:
    """Paths whose presence or type differs."""
    kinds = [{p: leaf_type(s, p) for p in paths(s)} for s in (a, b)]
    return sorted(p for p in kinds[0].keys() | kinds[1].keys() if kinds[0].get(p) != kinds[1].get(p))


def leaf_type(schema: StructType, path: str) -> str:
    kind = schema
    for part in path.split("/"):
        kind = kind[part].dataType
    return kind.simpleString()


def describe(schema: StructType) -> list[str]:
    """`path: type` of every leaf."""
    return [f"{p}: {leaf_type(schema, p)}" for p in paths(schema)]


def wide(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """An array column as named columns."""
    return df.withColumns({n: F.get(F.col(column), i) for i, n in enumerate(names)}).drop(column)


def long(df: DataFrame, keys: list[str], names: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Named columns as rows."""
    return df.unpivot(keys, names, name, value)


def batched(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """One row for each batch with its rows stacked, in order, as arrays."""
    rows = F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order))))
    return df.groupBy(by).agg(rows.alias("_rows")).select(by, *(F.col("_rows")[c].alias(c) for c in columns))


def unbatched(df: DataFrame, columns: list[str], index: str = "index") -> DataFrame:
    """Stacked arrays back as rows."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(F.arrays_zip(*columns)).alias(index, "_row")).select(*rest, index, *(F.col("_row")[c].alias(c) for c in columns))


def is_vector(schema: StructType, name: str) -> bool:
    return isinstance(schema[name].dataType, ArrayType)
