"""Keyset pages: rows strictly beyond a cursor in the query's order, without counting those before."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

from tessera.errors import InvalidStatement
from tessera.expr import Order, Path
from tessera.model import Field, Model


def tie_broken(model: Model, orders: Sequence[Order]) -> list[Order]:
    """The order with the primary key behind it, in the last key's direction, unless it covers a unique key without NULLs."""
    if not orders:
        raise InvalidStatement("pages need an order")
    names = [o.path.names for o in orders]
    for unique in model.unique_sets():
        fields = [model.field(n) for n in unique]
        if all((n,) in names for n in unique) and all(isinstance(f, Field) and not f.nullable for f in fields):
            return list(orders)
    return [*orders, *(Order(Path(model, (k,)), orders[-1].descending) for k in model.key if (k,) not in names)]


def beyond(orders: Sequence[Order], cursor: Sequence[Any] | Any) -> Column:
    """e0 beyond v0, or e0 = v0 and e1 beyond v1, and so on. A cursor may have fewer values than the order has keys.
    NULLs are first in ascending order and last in descending."""
    values = list(cursor) if isinstance(cursor, tuple | list | Row) else [cursor]
    if not values:
        raise InvalidStatement("a cursor needs a value")
    if len(values) > len(orders):
        raise InvalidStatement(f"the cursor has {len(values)} values, the order {len(orders)} keys")
    out, equal = F.lit(False), None
    for order, v in zip(orders, values, strict=False):
        c = order.path.value()
        if order.descending:
            after = F.lit(False) if v is None else (c < F.lit(v)) | c.isNull()
        else:
            after = c.isNotNull() if v is None else c > F.lit(v)
        term = after if equal is None else equal & after
        out = out | term
        same = c.isNull() if v is None else c == F.lit(v)
        equal = same if equal is None else equal & same
    # The leading key bounds the scan by itself; written apart, it is pushed down.
    if values[0] is not None:
        first, v = orders[0], F.lit(values[0])
        c = first.path.value()
        out = out & ((c <= v) | c.isNull() if first.descending else c >= v)
    return out


@dataclass(frozen=True)
class Page:
    """Rows of a page and where the next and the previous one begin."""

    query: Any
    rows: list[Row]
    next_cursor: tuple | None
    prev_cursor: tuple | None

    @property
    def has_next(self) -> bool:
        return self.next_cursor is not None

    @property
    def has_prev(self) -> bool:
        return self.prev_cursor is not None

    def next(self) -> Page | None:
        return self.query.after(self.next_cursor).exec() if self.has_next else None

    def prev(self) -> Page | None:
        return self.query.before(self.prev_cursor).exec() if self.has_prev else None


@dataclass(frozen=True)
class Paginate:
    """Pages of a query. ``frame`` is a page as a DataFrame, ``exec`` runs it."""

    query: Any
    size: int
    cursor: Any = None
    backward: bool = False

    def after(self, cursor: Any) -> Paginate:
        return Paginate(self.query, self.size, cursor, False)

    def before(self, cursor: Any) -> Paginate:
        return Paginate(self.query, self.size, cursor, True)

    def _orders(self) -> list[Order]:
        orders = tie_broken(self.query.model, self.query.orders)
        return [o.reversed() for o in orders] if self.backward else orders

    def _limited(self):
        """The page's rows with all stored columns; of a backward page in reverse."""
        rows = self.query.rows(ordered=False)
        orders = self._orders()
        if self.cursor is not None:
            rows = rows.filter(beyond(orders, self.cursor))
        return rows.orderBy(*[o.column() for o in orders]).limit(self.size)

    def frame(self):
        forward = [o.reversed() for o in self._orders()] if self.backward else self._orders()
        return self.query.projected(self._limited(), forward, some=True)

    def exec(self) -> Page:
        orders = self._orders()
        marks = [f"__c{i}" for i in range(len(orders))]
        forward = [o.reversed() for o in orders] if self.backward else orders
        found = self.query.projected(self._limited(), forward, extra=[o.path.value().alias(m) for o, m in zip(orders, marks, strict=True)], some=True).collect()
        at = lambda row: tuple(row[m] for m in marks)
        rows = [Row(**{k: v for k, v in r.asDict(False).items() if k not in marks}) for r in found]
        full = at(found[-1]) if len(found) == self.size and found else None
        began = at(found[0]) if self.cursor is not None and found else None
        if self.backward:
            # Rows were read in reverse: the far end is the first row.
            return Page(Paginate(self.query, self.size), rows, at(found[-1]) if self.cursor is not None and found else None, at(found[0]) if len(found) == self.size else None)
        return Page(Paginate(self.query, self.size), rows, full, began)
