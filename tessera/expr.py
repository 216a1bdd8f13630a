"""Expressions over models: paths, predicates, and the relations that predicates reach through.

A predicate on columns of one model becomes one ``Column``. A predicate through a relation can't: it becomes an
``Exists`` node, which ``operators.predicates`` turns into a semi join, an anti join or an existence flag."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidStatement
from tessera.functions import scalars
from tessera.model import BelongsTo, Document, EmbedEnum, Embedded, EmbedStruct, Field, Model, Relation, Variant, Via, embedded_columns, struct_type

#: Longer IN lists are joined instead of written into the plan.
LONG_LIST = 400


class Expr:
    """A three-valued predicate or a value."""

    def and_(self, other: Expr) -> Expr:
        return And((self, other))

    def or_(self, other: Expr) -> Expr:
        return Or((self, other))

    def not_(self) -> Expr:
        return Not(self)

    __and__, __or__, __invert__ = and_, or_, not_

    def __bool__(self) -> bool:
        raise InvalidStatement("use &, | and ~ on expressions")

    def column(self, flag: Callable[[Exists], Column] | None = None) -> Column:
        """``flag`` gives the column that says whether an Exists holds."""
        raise NotImplementedError

    def reaches(self) -> list[Exists]:
        """The Exists nodes in it."""
        return []


@dataclass(frozen=True, eq=False)
class Local(Expr):
    """Anything made of one model's columns."""

    build: Callable[[], Column]

    def column(self, flag=None) -> Column:
        return self.build()


@dataclass(frozen=True, eq=False)
class Equals(Local):
    """A path that equals a literal; kept apart so that rewrites can see it."""

    path: Path
    value: Any


@dataclass(frozen=True, eq=False)
class And(Expr):
    parts: tuple[Expr, ...]

    def column(self, flag=None) -> Column:
        out = F.lit(True)
        for i, p in enumerate(self.flat()):
            out = p.column(flag) if i == 0 else out & p.column(flag)
        return out

    def flat(self) -> list[Expr]:
        return [q for p in self.parts for q in (p.flat() if isinstance(p, And) else [p])]

    def reaches(self):
        return [e for p in self.parts for e in p.reaches()]


@dataclass(frozen=True, eq=False)
class Or(Expr):
    parts: tuple[Expr, ...]

    def flat(self) -> list[Expr]:
        return [q for p in self.parts for q in (p.flat() if isinstance(p, Or) else [p])]

    def column(self, flag=None) -> Column:
        """Equalities of one path become one IN, which reaches the scan as a filter."""
        rest: list[Expr] = []
        lists: dict[tuple, tuple[Path, list]] = {}
        for p in self.flat():
            if isinstance(p, Equals):
                lists.setdefault(p.path.names, (p.path, []))[1].append(p.value)
            else:
                rest.append(p)
        columns = [path.value().isin(values) if len(values) > 1 else path.value() == F.lit(values[0]) for path, values in lists.values()]
        columns += [p.column(flag) for p in rest]
        if not columns:
            return F.lit(False)
        out = columns[0]
        for c in columns[1:]:
            out = out | c
        return out

    def reaches(self):
        return [e for p in self.parts for e in p.reaches()]


@dataclass(frozen=True, eq=False)
class Not(Expr):
    part: Expr

    def not_(self) -> Expr:
        return self.part

    __invert__ = not_

    def column(self, flag=None) -> Column:
        return ~self.part.column(flag)

    def reaches(self):
        return self.part.reaches()


@dataclass(frozen=True, eq=False)
class Exists(Expr):
    """Some row of ``source`` (columns ``theirs``) equals this row in ``mine``. Never NULL. ``source`` is called with the
    database, and gives the rows that count."""

    mine: tuple[Column, ...]
    theirs: tuple[str, ...]
    source: Callable[[Any], Any]
    unique: bool = False

    def column(self, flag=None) -> Column:
        if flag is None:
            raise InvalidStatement("a predicate through a relation has no column of its own")
        return flag(self)

    def reaches(self):
        return [self]


def and_all(parts: Sequence[Expr]) -> Expr:
    return And(tuple(parts)) if parts else Local(lambda: F.lit(True))


def or_all(parts: Sequence[Expr]) -> Expr:
    return Or(tuple(parts)) if parts else Local(lambda: F.lit(False))


def value_column(v: Any) -> Column:
    if isinstance(v, Path):
        return v.value()
    if isinstance(v, Expr):
        return v.column()
    return v if isinstance(v, Column) else F.lit(v)


def exists(model: Model, relation: Relation, inner: Expr | None) -> Expr:
    """Some related row meets ``inner``."""
    registry = model.registry
    if isinstance(relation, Via):
        steps, _, _ = registry.via_steps(model, relation)
        for m, r in reversed(steps):
            inner = exists(m, r, inner)
        return inner
    target = registry[relation.target]
    mine, theirs = registry.link(model, relation)
    if isinstance(relation, BelongsTo) and inner is not None:
        pinned = _pinned(relation, inner)
        if pinned is not None:
            return pinned(model)
    from tessera.operators.predicates import filtered

    def source(db):
        df = db.table(target)
        return df if inner is None else filtered(db, df, inner)

    unique = isinstance(relation, BelongsTo) and set(theirs) == set(target.key_columns())
    return Exists(tuple(F.col(c) for c in mine), tuple(theirs), source, unique)


def _pinned(relation: BelongsTo, inner: Expr) -> Callable[[Model], Expr] | None:
    """If all that is asked of the target is its key, the own key columns are compared and nothing is joined."""
    parts = inner.flat() if isinstance(inner, And) else [inner]
    if not all(isinstance(p, Equals) and len(p.path.names) == 1 and p.path.names[0] in relation.keys.values() for p in parts):
        return None
    if {p.path.names[0] for p in parts} != set(relation.keys.values()) or len(parts) != len(relation.keys):
        return None
    own = {other: mine for mine, other in relation.keys.items()}
    return lambda model: and_all([Path(model, (own[p.path.names[0]],)).eq(p.value) for p in parts])


class Path:
    """A model's field, reached by names. ``path.name`` goes on; attributes that are methods need ``path["name"]``."""

    def __init__(self, model: Model, names: tuple[str, ...] = ()):
        self._model, self._names = model, names

    def __getattr__(self, name: str) -> Path:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Path:
        path = Path(self._model, (*self._names, name))
        path.resolve()
        return path

    @property
    def names(self) -> tuple[str, ...]:
        return self._names

    @property
    def model(self) -> Model:
        return self._model

    def resolve(self):
        """(relation, names behind it) if the first name is one, else the chain of parts."""
        first = self._model.field(self._names[0])
        if isinstance(first, Relation):
            return first, self._names[1:]
        at, chain = first, [first]
        for n in self._names[1:]:
            if isinstance(at, Embedded | Document):
                of = at.of
                at = of.variant(n) if isinstance(of, EmbedEnum) else of.field(n)
            elif isinstance(at, Variant):
                at = next((f for f in at.fields if f.name == n), None)
                if at is None:
                    raise InvalidStatement(f"{'.'.join(self._names)}: no such field")
            else:
                raise InvalidStatement(f"{'.'.join(self._names)}: {n!r} is not a part of a value")
            chain.append(at)
        return None, chain

    def end(self):
        """The field that the path ends at and the model that has it."""
        relation, rest = self.resolve()
        if relation is None:
            return self._model, rest[-1]
        target = self._model.registry.target(self._model, relation)
        if not rest:
            return self._model, relation
        return Path(target, rest).end()

    def value(self) -> Column:
        """The column; whole embedded values are structs."""
        relation, chain = self.resolve()
        if relation is not None:
            raise InvalidStatement(f"{'.'.join(self._names)} goes through a relation")
        return _column(chain)

    # Through relations: the same predicate on the target, inside Exists.

    def _on(self, make: Callable[[Path], Expr]) -> Expr:
        relation, rest = self.resolve()
        if relation is None or not rest:
            return make(self)
        target = self._model.registry.target(self._model, relation)
        return exists(self._model, relation, Path(target, rest)._on(make))

    def _local(self, make: Callable[[Column], Column]) -> Expr:
        return self._on(lambda p: Local(lambda: make(p.value())))

    def _relation(self) -> Relation | None:
        relation, rest = self.resolve()
        return relation if relation is not None and not rest else None

    def _own_key(self, instance: Any) -> list[tuple[Path, Any]]:
        relation = self._relation()
        if not isinstance(relation, BelongsTo):
            raise InvalidStatement(f"{'.'.join(self._names)}: only a belongs-to relation compares with a row")
        get = instance.get if isinstance(instance, dict) else lambda k: instance[k] if hasattr(instance, "asDict") else getattr(instance, k)
        return [(Path(self._model, (mine,)), get(other)) for mine, other in relation.keys.items()]

    def eq(self, v: Any) -> Expr:
        if v is None:
            return self.is_none()

        def make(p: Path) -> Expr:
            if p._relation() is not None:
                return and_all([q.eq(x) for q, x in p._own_key(v)])
            whole = p._whole()
            if whole is not None:
                return whole(v)
            if isinstance(v, Path | Expr | Column):
                return Local(lambda: p.value() == value_column(v))
            return Equals(lambda: p.value() == F.lit(v), p, v)

        return self._on(make)

    def ne(self, v: Any) -> Expr:
        if v is None:
            return self.is_some()

        def make(p: Path) -> Expr:
            if p._relation() is not None:
                return or_all([q.ne(x) for q, x in p._own_key(v)])
            whole = p._whole()
            if whole is not None:
                return Not(whole(v))
            return Local(lambda: p.value() != value_column(v))

        return self._on(make)

    def gt(self, v: Any) -> Expr:
        return self._local(lambda c: c > value_column(v))

    def ge(self, v: Any) -> Expr:
        return self._local(lambda c: c >= value_column(v))

    def lt(self, v: Any) -> Expr:
        return self._local(lambda c: c < value_column(v))

    def le(self, v: Any) -> Expr:
        return self._local(lambda c: c <= value_column(v))

    def between(self, lo: Any, hi: Any) -> Expr:
        return self._local(lambda c: c.between(value_column(lo), value_column(hi)))

    def in_list(self, values: Sequence[Any]) -> Expr:
        """NULL among the values matches nothing. Of no values false."""
        values = list(values)

        def make(p: Path) -> Expr:
            if p._relation() is not None or p._whole() is not None:
                return or_all([p.eq(v) for v in values])
            given = list(dict.fromkeys(v for v in values if v is not None))
            if len(given) > LONG_LIST:
                name = "listed"
                kind = p.end()[1].spark_type
                return Exists((p.value(),), (name,), lambda db: db.spark.createDataFrame([(v,) for v in given], T.StructType([T.StructField(name, kind)])), True)
            if not values:
                return Local(lambda: F.lit(False))
            nulls = [F.lit(None)] if None in values else []
            return Local(lambda: p.value().isin(*given, *nulls))

        return self._on(make)

    def in_query(self, query) -> Expr:
        """Equals some value of a query that selects one field."""
        return in_query([self], query)

    def is_none(self) -> Expr:
        def make(p: Path) -> Expr:
            r = p._relation()
            if isinstance(r, BelongsTo):
                return or_all([Path(p._model, (k,)).is_none() for k in r.keys])
            if r is not None:
                return Not(exists(p._model, r, None))
            return Local(lambda: p.value().isNull())

        return self._on(make)

    def is_some(self) -> Expr:
        def make(p: Path) -> Expr:
            r = p._relation()
            if isinstance(r, BelongsTo):
                return and_all([Path(p._model, (k,)).is_some() for k in r.keys])
            if r is not None:
                return exists(p._model, r, None)
            return Local(lambda: p.value().isNotNull())

        return self._on(make)

    def like(self, pattern: str, escape: str | None = None) -> Expr:
        return self._local(lambda c: F.like(c, F.lit(pattern), F.lit(escape) if escape else None))

    def like_with_escape(self, pattern: str, escape: str) -> Expr:
        return self.like(pattern, escape)

    def ilike(self, pattern: str, escape: str | None = None) -> Expr:
        return self._local(lambda c: F.ilike(c, F.lit(pattern), F.lit(escape) if escape else None))

    def ilike_with_escape(self, pattern: str, escape: str) -> Expr:
        return self.ilike(pattern, escape)

    def starts_with(self, prefix: str) -> Expr:
        return self._local(lambda c: c.startswith(prefix))

    # Relations to many.

    def any(self, inner: Expr | None = None) -> Expr:
        """Some related row meets the predicate."""
        return self._on(lambda p: exists(p._model, p._need_relation(), inner))

    def all(self, inner: Expr) -> Expr:
        """No related row fails it: one whose predicate is NULL doesn't, and no rows at all are fine."""
        return self._on(lambda p: Not(exists(p._model, p._need_relation(), Not(inner))))

    def _need_relation(self) -> Relation:
        r = self._relation()
        if r is None:
            raise InvalidStatement(f"{'.'.join(self._names)} is not a relation")
        return r

    # Arrays.

    def contains(self, v: Any) -> Expr:
        return self._local(lambda c: scalars.contains(c, v))

    def is_superset(self, values: Sequence[Any]) -> Expr:
        return self._local(lambda c: scalars.is_superset(c, values))

    def intersects(self, values: Sequence[Any]) -> Expr:
        return self._local(lambda c: scalars.intersects(c, values))

    def is_empty(self) -> Expr:
        return self._local(scalars.is_empty)

    def len(self) -> Value:
        return Value(lambda: scalars.length(self.value()))

    # Enums.

    def is_variant(self, name: str) -> Expr:
        def make(p: Path) -> Expr:
            embedded = p.end()[1]
            return Local(lambda: F.col(_prefix(p)) == F.lit(embedded.of.variant(name).value))

        return self._on(make)

    def matches(self, name: str, body: Callable[[Path], Expr]) -> Expr:
        """Is that variant, and its fields meet the body."""
        return self._on(lambda p: And((p.is_variant(name), body(p[name]))))

    # Order.

    def asc(self) -> Order:
        return Order(self, False)

    def desc(self) -> Order:
        return Order(self, True)

    def _whole(self) -> Callable[[Any], Expr] | None:
        """For paths to whole embedded values: equality part by part."""
        relation, chain = self.resolve()
        last = chain[-1] if relation is None else None
        if isinstance(last, Embedded) and isinstance(last.of, EmbedStruct) and not last.of.newtype:
            return lambda v: and_all([self[f.name].eq(v[f.name]) for f in last.of.fields])
        if isinstance(last, Embedded) and isinstance(last.of, EmbedEnum):

            def equal(v: Any) -> Expr:
                name, values = (v, {}) if isinstance(v, str) else (v["variant"], {k: x for k, x in v.items() if k != "variant"})
                return and_all([self.is_variant(name), *(self[name][k].eq(x) for k, x in values.items())])

            return equal
        return None


class Value(Path):
    """A computed value with a path's comparisons."""

    def __init__(self, build: Callable[[], Column]):
        self._build, self._model, self._names = build, None, ("value",)

    def __getattr__(self, name: str):
        raise AttributeError(name)

    def resolve(self):
        return None, [None]

    def value(self) -> Column:
        return self._build()

    def _relation(self):
        return None

    def _whole(self):
        return None

    def _on(self, make):
        return make(self)

    def eq(self, v: Any) -> Expr:
        return Local(lambda: self.value() == value_column(v))


def computed(build: Callable[[], Column] | Column) -> Value:
    return Value(build if callable(build) and not isinstance(build, Column) else lambda: build)


@dataclass(frozen=True)
class Order:
    """NULLs come first in ascending order and last in descending."""

    path: Path
    descending: bool

    def column(self) -> Column:
        c = self.path.value()
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()

    def reversed(self) -> Order:
        return Order(self.path, not self.descending)


def in_query(paths: Sequence[Path], query) -> Expr:
    """The paths together equal a row of a query that selects as many values."""
    names = tuple(f"k{i}" for i in range(len(paths)))

    def source(db):
        df = query.bound(db).frame()
        if len(df.columns) != len(names):
            raise InvalidStatement(f"the subquery selects {len(df.columns)} values for {len(names)}")
        return df.toDF(*names)

    return Exists(tuple(p.value() for p in paths), names, source)


def _prefix(path: Path) -> str:
    _, chain = path.resolve()
    return column_name(chain)


def column_name(chain: Sequence) -> str:
    """The column of a chain of embedded parts; a variant adds nothing to the name."""
    name = ""
    for i, part in enumerate(chain):
        if isinstance(part, Variant):
            continue
        above = chain[i - 1] if i else None
        if isinstance(above, Embedded) and isinstance(above.of, EmbedStruct) and above.of.newtype:
            continue
        name = f"{name}_{part.col}" if name else part.col
    return name


def _column(chain: Sequence) -> Column:
    for i, part in enumerate(chain):
        if isinstance(part, Document):
            base, rest = F.col(column_name(chain[: i + 1])), chain[i + 1 :]
            if part.storage == "struct":
                for p in rest:
                    base = base.getField(p.name)
                return base
            if not rest:
                return F.from_json(base, part.value_type)
            last = rest[-1]
            if isinstance(last, Field):
                leaf = F.get_json_object(base, scalars.json_path([p.name for p in rest]))
                if isinstance(last.spark_type, T.ArrayType | T.StructType):
                    return F.from_json(leaf, last.spark_type)
                return leaf.cast(last.spark_type)
            return F.from_json(F.get_json_object(base, scalars.json_path([p.name for p in rest])), struct_type(last.of))
    last = chain[-1]
    if isinstance(last, Field):
        return F.col(column_name(chain))
    if isinstance(last, Variant):
        return F.struct(*[F.col(f"{column_name(chain)}_{f.col}").alias(f.name) for f in last.fields])
    return decoded(last, column_name(chain))


def decoded(f: Embedded, prefix: str) -> Column:
    """An embedded value as a struct; NULL where a nullable one's columns are all NULL."""
    of = f.of
    if isinstance(of, EmbedEnum):
        names = scalars.match(F.col(prefix), {v.value: v.name for v in of.variants})
        parts, seen = [names.alias("variant")], {"variant"}
        for v in of.variants:
            for x in v.fields:
                if x.name not in seen:
                    seen.add(x.name)
                    parts.append(F.col(f"{prefix}_{x.col}").alias(x.name))
        return F.when(F.col(prefix).isNotNull(), F.struct(*parts))
    if of.newtype:
        return F.col(prefix)
    parts = [(F.col(f"{prefix}_{x.col}") if isinstance(x, Field) else decoded(x, f"{prefix}_{x.col}")).alias(x.name) for x in of.fields]
    whole = F.struct(*parts)
    if not f.nullable:
        return whole
    return F.when(_some(prefix, of), whole)


def _some(prefix: str, of: EmbedStruct) -> Column:
    """Whether any of its columns has a value."""
    out = F.lit(False)
    for c, _, _ in embedded_columns(prefix, of, True):
        out = out | F.col(c).isNotNull()
    return out


def stored_value(f: Any) -> Column:
    """A stored field as its default projection has it."""
    return _column([f])

