"""Scalar expressions on columns: collections, documents, dispatch."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def array_of(values: Sequence[Any], kind: T.DataType | None = None) -> Column:
    out = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
    return out.cast(T.ArrayType(kind)) if kind is not None else out


# Tests of arrays. NULL arrays give NULL; NULL elements never match.


def contains(c: Column, value: Any) -> Column:
    return F.when(c.isNotNull(), F.coalesce(F.array_contains(c, value if isinstance(value, Column) else F.lit(value)), F.lit(False)))


def is_superset(c: Column, values: Sequence[Any]) -> Column:
    """Every value is among the elements; of no values always."""
    if not values:
        return F.when(c.isNotNull(), F.lit(True))
    return F.when(c.isNotNull(), F.size(F.array_except(array_of(values), c)) == 0)


def intersects(c: Column, values: Sequence[Any]) -> Column:
    """Some value is among the elements; of no values never."""
    if not values:
        return F.when(c.isNotNull(), F.lit(False))
    return F.when(c.isNotNull(), F.coalesce(F.arrays_overlap(c, array_of(values)), F.lit(False)))


def length(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(c).cast("long"))


def is_empty(c: Column) -> Column:
    return length(c) == 0


def any_of(c: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(c, test)


def all_of(c: Column, test: Callable[[Column], Column]) -> Column:
    """Of no elements true."""
    return F.forall(c, test)


# Changes of arrays.


def push(c: Column, value: Any) -> Column:
    return F.concat(c, F.array(value if isinstance(value, Column) else F.lit(value)))


def extend(c: Column, values: Sequence[Any] | Column) -> Column:
    if isinstance(values, Column):
        return F.concat(c, values)
    return F.concat(c, array_of(values)) if values else c


def pop(c: Column) -> Column:
    """Without the last element; an empty array stays."""
    return F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))


def remove(c: Column, value: Any) -> Column:
    """Without every element equal to the value."""
    return F.filter(c, lambda x: ~F.coalesce(x == (value if isinstance(value, Column) else F.lit(value)), F.lit(False)))


def remove_at(c: Column, index: int) -> Column:
    """Without the element at a place from 0 on; a place outside changes nothing."""
    return F.filter(c, lambda _, i: i != index)


def clear(c: Column, kind: T.DataType | None = None) -> Column:
    return F.filter(c, lambda _: F.lit(False)) if kind is None else F.array().cast(kind)


def map_list(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(c, f)


# Dispatch, bindings, errors.


def match(subject: Column, arms: Mapping[Any, Any], default: Any = None) -> Column:
    """The arm of the constant that equals the subject, or the default."""
    wrap = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = None
    for pattern, value in arms.items():
        out = (F if out is None else out).when(subject == F.lit(pattern), wrap(value))
    return wrap(default) if out is None else out.otherwise(wrap(default))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def error(message: str, kind: T.DataType | str = "string") -> Column:
    """Raises where it is evaluated."""
    return F.raise_error(F.lit(message)).cast(kind)


# Documents.


def json_path(path: Sequence[str]) -> str:
    return "$" + "".join(f"['{p}']" for p in path)


def json_extract(c: Column, path: Sequence[str], kind: T.DataType | str = "string") -> Column:
    """A typed leaf of a JSON text; NULL where the key is missing or null."""
    return F.get_json_object(c, json_path(path)).cast(kind)


def json_encode(c: Column) -> Column:
    return F.to_json(c)


def json_decode(c: Column, kind: T.DataType) -> Column:
    return F.from_json(c, kind)


def json_literal(value: Any) -> Column:
    """JSON null is the text null, not a NULL."""
    return F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False))


def patched(c: Column, path: Sequence[str], value: Any) -> Column:
    """A struct with one nested field replaced."""
    return c.withField(".".join(f"`{p}`" for p in path), value if isinstance(value, Column) else F.lit(value))
