"""Filters: predicates to columns, and predicates through relations to joins.

Top-level conjuncts on relations become left semi and left anti joins. Elsewhere (under OR, or inside NOT with other
predicates) the keys that exist are joined as a flag. Only key columns of the other side travel."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.expr import And, Exists, Expr, Not

_number = itertools.count()


def _keys(db, node: Exists, tag: str) -> tuple[DataFrame, list[str]]:
    names = [f"__{tag}_{i}" for i in range(len(node.theirs))]
    return node.source(db).select(*[F.col(c).alias(n) for c, n in zip(node.theirs, names, strict=True)]), names


def _condition(node: Exists, names: list[str]) -> Column:
    out = None
    for mine, name in zip(node.mine, names, strict=True):
        out = mine == F.col(name) if out is None else out & (mine == F.col(name))
    return out


def joined(db, df: DataFrame, node: Exists, how: str) -> DataFrame:
    keys, names = _keys(db, node, f"k{next(_number)}")
    return df.join(keys, _condition(node, names), how)


def flagged(db, df: DataFrame, expr: Expr) -> tuple[DataFrame, Column]:
    """The frame with a flag for each relation that the predicate reaches, and the predicate's column."""
    flags: dict[int, Column] = {}
    for node in expr.reaches():
        if id(node) in flags:
            continue
        tag = f"f{next(_number)}"
        keys, names = _keys(db, node, tag)
        keys = keys if node.unique else keys.distinct()
        df = df.join(keys.withColumn(f"__{tag}", F.lit(True)), _condition(node, names), "left").drop(*names)
        flags[id(node)] = F.coalesce(F.col(f"__{tag}"), F.lit(False))
    return df, expr.column(lambda node: flags[id(node)])


def filtered(db, df: DataFrame, expr: Expr | None) -> DataFrame:
    """The rows for which the predicate is true."""
    if expr is None:
        return df
    parts = expr.flat() if isinstance(expr, And) else [expr]
    # Plain predicates first: they can reach the scan.
    for p in parts:
        if not p.reaches():
            df = df.filter(p.column())
    for p in parts:
        if isinstance(p, Exists):
            df = joined(db, df, p, "left_semi")
        elif isinstance(p, Not) and isinstance(p.part, Exists):
            df = joined(db, df, p.part, "left_anti")
        elif p.reaches():
            own = df.columns
            with_flags, condition = flagged(db, df, p)
            df = with_flags.filter(condition).select(*[F.col(f"`{c}`") for c in own])
    return df


def with_predicate(db, df: DataFrame, expr: Expr | None, name: str) -> DataFrame:
    """The frame with a column that says whether the predicate is true (never NULL)."""
    if expr is None:
        return df.withColumn(name, F.lit(True))
    own = df.columns
    out, condition = flagged(db, df, expr)
    return out.select(*[F.col(f"`{c}`") for c in own], F.coalesce(condition, F.lit(False)).alias(name))
