"""Eager loading: related rows as nested values of their parents, in one plan.

Children are selected, filtered, given their own includes (bottom up), gathered by the columns that link them to their
parents, and left-joined. Parents without children get an empty array (to many) or NULL (to one). Arrays are in the
include's order, by primary key where none is given. A parent's children are one value, so they must fit in a task's
memory; ``Query.pairs`` gives the same rows flat, for parents whose children don't.

Where the parents are not a whole table, children are first cut down to theirs by a left semi join on the link columns,
so that a page of parents doesn't gather all children there are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidStatement
from tessera.expr import Expr, Order, Path, and_all, or_all
from tessera.model import BelongsTo, HasMany, HasOne, Model, Relation, Via
from tessera.operators.navigation import linked
from tessera.operators.predicates import filtered


@dataclass(frozen=True)
class Include:
    """A path of names to load; ``filter`` and ``order`` act on the rows at its end."""

    names: tuple[str, ...]
    predicates: tuple[Expr, ...] = ()
    orders: tuple[Order, ...] = ()

    def filter(self, predicate: Expr) -> Include:
        """A further condition (AND)."""
        return Include(self.names, (*self.predicates, predicate), self.orders)

    def order_by(self, *orders: Order) -> Include:
        """Further sort keys."""
        return Include(self.names, self.predicates, (*self.orders, *orders))

    def inside(self) -> Include:
        return Include(self.names[1:], self.predicates, self.orders)


def include(path: Path | str | Include) -> Include:
    if isinstance(path, Include):
        return path
    return Include(tuple(path.split(".")) if isinstance(path, str) else path.names)


def merged(includes: Sequence[Include]) -> tuple[Expr | None, tuple[Order, ...], list[Include]]:
    """Of includes of one relation: the filters of repeated ones are ORed, and one without a filter lifts them; the last
    one's order counts, also if it has none; deeper includes go on."""
    own = [i for i in includes if not i.names]
    deeper = [i for i in includes if i.names]
    filters = [i.predicates for i in own]
    bare = not filters or any(not f for f in filters)
    predicate = None
    if not bare:
        predicate = or_all([and_all(f) for f in filters])
    return predicate, own[-1].orders if own else (), deeper


def check(model: Model, relation: Relation, predicate: Expr | None, orders: tuple[Order, ...], deeper: list[Include]) -> None:
    many = isinstance(relation, HasMany) or (isinstance(relation, Via) and not relation.one)
    if orders and not many:
        raise InvalidStatement(f"{model.name}.{relation.name}: one row can't be ordered")
    required = isinstance(relation, BelongsTo) and not relation.nullable or isinstance(relation, HasOne) and relation.required
    if predicate is not None and required:
        raise InvalidStatement(f"{model.name}.{relation.name}: a required row can't be filtered away")


def comparator(names: Sequence[tuple[str, bool]]):
    """Compares structs by fields: ascending with NULLs first, or descending with NULLs last."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for name, descending in reversed(names):
            x, y = (b[name], a[name]) if descending else (a[name], b[name])
            out = F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(out)
        return out

    return compare


def attach(db, rows: DataFrame, model: Model, includes: Sequence[Include], some: bool = False, prefix: str = "__i") -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` (stored columns) with the related values joined, and the column of each loaded relation by name. ``some``:
    the rows are not all of their table's."""
    parents = rows
    by: dict[str, list[Include]] = {}
    for i in includes:
        if not isinstance(model.field(i.names[0]), Relation):
            continue
        by.setdefault(i.names[0], []).append(i.inside())
    for r in model.relations:
        if r.eager and r.name not in by:
            by[r.name] = [Include(())]
    columns: dict[str, Column] = {}
    for n, (name, own) in enumerate(by.items()):
        relation = model.field(name)
        predicate, orders, deeper = merged(own)
        check(model, relation, predicate, orders, deeper)
        rows, columns[name] = _attach_one(db, rows, parents if some else None, model, relation, predicate, orders, deeper, f"{prefix}{n}")
    return rows, columns


def _attach_one(db, rows, parents, model, relation, predicate, orders, deeper, tag):
    """``parents``: rows whose children alone are wanted; None for all."""
    from tessera.query import projection

    registry = model.registry
    loaded = f"{tag}_value"
    if isinstance(relation, Via):
        keys = [f"{tag}_k{i}" for i in range(len(model.key))]
        children, target, scalar = linked(db, rows, model, relation, keys)
        children = filtered(db, children, predicate)
        on = list(zip(model.key_columns(), keys, strict=True))
        if scalar:
            value = Path(target, (scalar,)).value()
            pairs = children.select(*keys, value.alias(loaded)).distinct()
            groups = pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(loaded)).alias(loaded))
            rows = _left(rows, groups, on)
            return rows, F.get(F.col(loaded), F.lit(0)) if relation.one else F.coalesce(F.col(loaded), F.array().cast(groups.schema[loaded].dataType))
    else:
        target = registry[relation.target]
        mine, theirs = registry.link(model, relation)
        keys = [f"{tag}_k{i}" for i in range(len(mine))]
        children = filtered(db, db.table(target), predicate)
        on = list(zip(mine, keys, strict=True))
        if parents is not None and not isinstance(relation, BelongsTo):
            wanted = [f"{tag}_w{i}" for i in range(len(mine))]
            condition = _equal(list(zip(theirs, wanted, strict=True)))
            children = children.join(parents.select(*[F.col(c).alias(w) for c, w in zip(mine, wanted, strict=True)]), condition, "left_semi")
    some = parents is not None or predicate is not None or isinstance(relation, Via)
    children, nested = attach(db, children, target, deeper, some, f"{tag}_")
    value = F.struct(*[c.alias(n) for n, c in projection(target, deeper, nested)])
    own_keys = [F.col(c).alias(k) for c, k in zip(theirs, keys, strict=True)] if not isinstance(relation, Via) else [F.col(k) for k in keys]
    if isinstance(relation, BelongsTo):
        # The target's key is unique, so there is nothing to gather.
        rows = _left(rows, children.select(*own_keys, value.alias(loaded)), on)
        return rows, F.col(loaded)
    sort = [(f"o{i}", o.path.value(), o.descending) for i, o in enumerate(orders)]
    ties = [(f"t{i}", F.col(c), False) for i, c in enumerate(target.key_columns())]
    item = F.struct(*[c.alias(n) for n, c, _ in (*sort, *ties)], value.alias("value")).alias("item")
    grouped = children.select(*own_keys, item).groupBy(*keys).agg(F.collect_list("item").alias("items"))
    if not sort or all(not d for _, _, d in sort):
        ordered = F.sort_array("items")  # by the leading fields, NULLs first
    else:
        ordered = F.array_sort("items", comparator([(n, d) for n, _, d in (*sort, *ties)]))
    many = isinstance(relation, HasMany) or (isinstance(relation, Via) and not relation.one)
    values = F.transform(ordered, lambda x: x["value"])
    if many:
        groups = grouped.select(*keys, values.alias(loaded))
        rows = _left(rows, groups, on)
        return rows, F.coalesce(F.col(loaded), F.array().cast(groups.schema[loaded].dataType))
    one = F.when(F.size(values) > 1, F.raise_error(F.lit(f"{model.name}.{relation.name} has several rows")).cast("boolean")).otherwise(F.lit(True))
    groups = grouped.select(*keys, F.when(one, F.get(values, F.lit(0))).alias(loaded))
    return _left(rows, groups, on), F.col(loaded)


def _equal(pairs: Sequence[tuple[str, str]]) -> Column:
    out = None
    for a, b in pairs:
        c = F.col(a) == F.col(b)
        out = c if out is None else out & c
    return out


def _left(rows: DataFrame, groups: DataFrame, on) -> DataFrame:
    return rows.join(groups, _equal(on), "left").drop(*[k for _, k in on])
