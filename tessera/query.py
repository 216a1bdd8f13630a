"""Queries: immutable descriptions that become one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.errors import InvalidStatement, RecordNotFound
from tessera.expr import Expr, Order, Path, Value, and_all, stored_value
from tessera.model import Model, Relation
from tessera.operators.includes import Include, attach, include
from tessera.operators.navigation import linked, related
from tessera.operators.paginate import Paginate
from tessera.operators.predicates import filtered


def projection(model: Model, includes: Sequence[Include], nested: dict[str, Column]) -> list[tuple[str, Column]]:
    """Names and columns that loading a row gives: stored fields that aren't deferred or are included, then relations."""
    wanted = {i.names[0] for i in includes if len(i.names) == 1}
    own = [(f.name, stored_value(f)) for f in model.stored if not f.deferred or f.name in wanted]
    return own + list(nested.items())


@dataclass(frozen=True)
class Query:
    """Made by ``Db.all(model)`` and its like, or unbound by ``Query(model)`` and then ``bound(db)``."""

    model: Model
    db: Any = None
    source: Callable[[Any], DataFrame] | None = None
    predicate: Expr | None = None
    orders: tuple[Order, ...] = ()
    n: int | None = None
    skip: int = 0
    selected: tuple | None = None
    unique: bool = False
    includes: tuple[Include, ...] = ()
    #: Equalities that rows created through this query are given, and the relation they come through.
    scope: dict = field(default_factory=dict)
    through: Any = None

    def bound(self, db) -> Query:
        return replace(self, db=db)

    # Building.

    def filter(self, predicate: Expr) -> Query:
        """A further condition."""
        return replace(self, predicate=predicate if self.predicate is None else and_all([self.predicate, predicate]), scope=self.scope | _equalities(predicate))

    def set_filter(self, predicate: Expr | None) -> Query:
        """Instead of all conditions so far."""
        return replace(self, predicate=predicate)

    def _orders(self, orders: Sequence) -> tuple[Order, ...]:
        return tuple(o if isinstance(o, Order) else Order(o if isinstance(o, Path) else self.model.f[o], False) for o in orders)

    def order_by(self, *orders: Order | Path | str) -> Query:
        """Further sort keys; ascending unless said otherwise."""
        return replace(self, orders=(*self.orders, *self._orders(orders)))

    def set_order_by(self, *orders: Order | Path | str) -> Query:
        return replace(self, orders=self._orders(orders))

    def reverse(self) -> Query:
        return replace(self, orders=tuple(o.reversed() for o in self.orders))

    def latest_by(self, path: Path | str) -> Query:
        return self.set_order_by((path if isinstance(path, Path) else self.model.f[path]).desc())

    def limit(self, n: int) -> Query:
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise InvalidStatement("a limit is a number of rows")
        return replace(self, n=n)

    def offset(self, n: int) -> Query:
        if self.n is None:
            raise InvalidStatement("an offset needs a limit before it")
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise InvalidStatement("an offset is a number of rows")
        return replace(self, skip=n)

    def select(self, *paths: Path | Value | Column | str) -> Query:
        """Values instead of rows: fields, parts of embedded values, or relations."""
        return replace(self, selected=tuple(self.model.f[p] if isinstance(p, str) else p for p in paths))

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def include(self, *paths: Path | str | Include) -> Query:
        """Relations or deferred fields to load with the rows."""
        found = [include(p) for p in paths]
        for i in found:
            self._check_path(self.model, i.names)
        return replace(self, includes=(*self.includes, *found))

    def _check_path(self, model: Model, names: tuple[str, ...]) -> None:
        f = model.field(names[0])
        if not isinstance(f, Relation):
            if len(names) > 1:
                raise InvalidStatement(f"{model.name}.{names[0]} has nothing to include")
        elif len(names) > 1:
            self._check_path(model.registry.target(model, f), names[1:])

    def paginate(self, size: int) -> Paginate:
        if self.n is not None:
            raise InvalidStatement("a query with a limit can't be paged")
        if size < 1:
            raise InvalidStatement("a page has a row at least")
        if not self.orders:
            raise InvalidStatement("pages need an order")
        return Paginate(self, size)

    def related(self, name: str) -> Query:
        """The related rows of this query's rows, each once."""
        relation = self.model.field(name)
        if not isinstance(relation, Relation):
            raise InvalidStatement(f"{self.model.name}.{name} is not a relation")
        _, target, scalar = related_target(self.model, relation)
        out = Query(target, self.db, lambda db: related(db, self.bound(db).rows(ordered=self.n is not None), self.model, relation)[0], through=(self, relation))
        return out.select(scalar).distinct() if scalar else out

    def pairs(self, name: str) -> DataFrame:
        """A row for each pair of a row of this query and a related row: the key, then the related row's stored columns."""
        relation = self.model.field(name)
        keys = [f"{self.model.table}_{c}" for c in self.model.key_columns()]
        return linked(self.db, self.rows(ordered=self.n is not None), self.model, relation, keys)[0]

    # Set operations.

    def union(self, other: Query, all: bool = False) -> DataFrame:
        out = self.frame().union(other.frame())
        return out if all else out.distinct()

    def intersect(self, other: Query) -> DataFrame:
        return self.frame().intersect(other.frame())

    def except_(self, other: Query) -> DataFrame:
        return self.frame().subtract(other.frame())

    # Running.

    def rows(self, ordered: bool = True) -> DataFrame:
        """Stored columns of the rows."""
        df = self.source(self.db) if self.source else self.db.table(self.model)
        df = filtered(self.db, df, self.predicate)
        if ordered and self.orders:
            df = df.orderBy(*[o.column() for o in self.orders])
        if ordered and self.skip:
            df = df.offset(self.skip)
        if ordered and self.n is not None:
            df = df.limit(self.n)
        return df

    def projected(self, rows: DataFrame, orders: Sequence[Order] = (), extra: Sequence[Column] = (), some: bool | None = None) -> DataFrame:
        """What the query gives for such rows; in that order where given. ``some``: they aren't all of the table's."""
        if some is None:
            some = self.predicate is not None or self.n is not None or self.source is not None
        if self.selected is not None:
            names = [p.names[0] for p in self.selected if isinstance(p, Path) and not isinstance(p, Value) and p.resolve()[0] is not None]
            loads = [Include((n,)) for n in dict.fromkeys(names)]
            rows, nested = attach(self.db, rows, _without_eager(self.model), loads, some)
            columns = [_selected(p, nested) for p in self.selected]
        else:
            rows, nested = attach(self.db, rows, self.model, self.includes, some)
            columns = [c.alias(n) for n, c in projection(self.model, self.includes, nested)]
        if orders:
            rows = rows.orderBy(*[o.column() for o in orders])
        out = rows.select(*columns, *extra)
        return out.distinct() if self.unique else out

    def frame(self) -> DataFrame:
        loads = bool(self.includes) or any(r.eager for r in self.model.relations) or any(isinstance(p, Path) and not isinstance(p, Value) and p.resolve()[0] is not None for p in self.selected or ())
        # Joins don't keep an order, so it is put on again behind them.
        return self.projected(self.rows(), self.orders if loads else ())

    def exec(self) -> list[Row]:
        return self.db.observed(self, lambda: self.frame().collect())

    def stream(self) -> Iterator[Row]:
        """The rows one partition at a time."""
        return self.frame().toLocalIterator()

    def lock(self, mode: str = "update") -> Query:
        """Row locks don't exist on snapshots; a commit checks for other writers instead. Accepted, and changes nothing."""
        if mode not in ("update", "share", "no_key_update", "key_share"):
            raise InvalidStatement(f"unknown lock mode {mode!r}")
        return self

    def first(self) -> Row | None:
        found = self.limit(1).frame().collect()
        return found[0] if found else None

    def one(self) -> Row:
        row = self.first()
        if row is None:
            raise RecordNotFound(f"no {self.model.name} matches")
        return row

    get = one

    def count(self) -> int:
        return self.rows(ordered=self.n is not None).count()

    def count_frame(self, name: str = "count") -> DataFrame:
        return self.rows(ordered=self.n is not None).agg(F.count(F.lit(1)).alias(name))

    # Writing.

    def update(self, **assignments: Any):
        return self.db.update(self, assignments)

    def delete(self):
        return self.db.delete(self)

    def create(self, **values: Any):
        return self.db.create_through(self, values)

    def insert(self, row: Any):
        return self.db.link(self, row)

    def remove(self, row: Any):
        return self.db.unlink(self, row)


def related_target(model: Model, relation: Relation):
    from tessera.model import Via

    if isinstance(relation, Via):
        return model.registry.via_steps(model, relation)
    return None, model.registry[relation.target], None


def _without_eager(model: Model) -> Model:
    if not any(r.eager for r in model.relations):
        return model
    plain = replace(model, fields=tuple(replace(f, eager=False) if isinstance(f, Relation) else f for f in model.fields))
    plain.registry = model.registry
    return plain


def _selected(p: Any, nested: dict[str, Column]) -> Column:
    if isinstance(p, Column):
        return p
    if isinstance(p, Value):
        return p.value()
    relation, rest = p.resolve()
    if relation is None:
        return p.value().alias("_".join(p.names))
    column = nested[relation.name]
    for name in rest:
        column = column[name]
    return column.alias("_".join(p.names))


def _equalities(predicate: Expr) -> dict:
    from tessera.expr import And, Equals

    parts = predicate.flat() if isinstance(predicate, And) else [predicate]
    return {p.path.names[0]: p.value for p in parts if isinstance(p, Equals) and len(p.path.names) == 1}
