"""Models: fields, keys, embedded values and relations, linked and verified in a registry."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from tessera.errors import InvalidSchema
from tessera.functions.types import spark_type


@dataclass(frozen=True)
class Field:
    """A value in one column. ``auto``: uuid4, uuid7 or increment, made on insert. ``default`` and ``update``: values or
    callables for inserts and for every update. ``deferred``: loaded only when included."""

    name: str
    type: str | T.DataType
    column: str | None = None
    nullable: bool = False
    unique: bool = False
    index: bool = False
    auto: str | None = None
    default: Any = None
    update: Any = None
    deferred: bool = False
    versioned: bool = False
    min_length: int | None = None
    max_length: int | None = None
    one_of: tuple | None = None

    @property
    def col(self) -> str:
        return self.column or self.name

    @property
    def spark_type(self) -> T.DataType:
        return spark_type(self.type)


@dataclass(frozen=True)
class EmbedStruct:
    """A group of fields. A single field under ``newtype`` is one transparent column."""

    name: str
    fields: tuple
    newtype: bool = False

    def field(self, name: str):
        return _named(self.fields, name, self.name)


@dataclass(frozen=True)
class Variant:
    name: str
    value: int | str
    fields: tuple[Field, ...] = ()


@dataclass(frozen=True)
class EmbedEnum:
    """A discriminant and the fields of its variants. Fields of one ``column`` name share it between variants."""

    name: str
    variants: tuple[Variant, ...]

    @property
    def type(self) -> T.DataType:
        return T.StringType() if isinstance(self.variants[0].value, str) else T.LongType()

    def variant(self, name: str) -> Variant:
        return _named(self.variants, name, self.name)


@dataclass(frozen=True)
class Embedded:
    """An embedded struct or enum, in columns named by the field and its parts."""

    name: str
    of: EmbedStruct | EmbedEnum
    nullable: bool = False
    deferred: bool = False
    column: str | None = None

    @property
    def col(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Document:
    """A struct in one column: JSON text, or a Spark struct. ``many``: an array of them."""

    name: str
    of: EmbedStruct
    storage: str = "json"
    many: bool = False
    nullable: bool = False
    deferred: bool = False
    column: str | None = None

    @property
    def col(self) -> str:
        return self.column or self.name

    @property
    def value_type(self) -> T.DataType:
        one = struct_type(self.of)
        return T.ArrayType(one) if self.many else one


@dataclass(frozen=True)
class BelongsTo:
    """This row's ``keys`` fields hold the target's key: {own field: target field}."""

    name: str
    target: str
    keys: dict[str, str]
    nullable: bool = False
    eager: bool = False


@dataclass(frozen=True)
class HasMany:
    """Rows of the target whose ``pair`` (a BelongsTo) is this row."""

    name: str
    target: str
    pair: str
    eager: bool = False


@dataclass(frozen=True)
class HasOne:
    name: str
    target: str
    pair: str
    required: bool = False
    eager: bool = False


@dataclass(frozen=True)
class Via:
    """Distinct rows at the end of a path of relations, or the values of a column there."""

    name: str
    path: tuple[str, ...]
    one: bool = False
    eager: bool = False


Relation = BelongsTo | HasMany | HasOne | Via


@dataclass(frozen=True)
class Index:
    fields: tuple[str, ...]
    unique: bool = False
    name: str | None = None


def _named(items: Sequence, name: str, owner: str):
    for item in items:
        if item.name == name:
            return item
    raise InvalidSchema(f"{owner} has no {name!r}")


def struct_type(of: EmbedStruct) -> T.StructType:
    parts = []
    for f in of.fields:
        kind = f.spark_type if isinstance(f, Field) else struct_type(f.of)
        parts.append(T.StructField(f.name, kind, True))
    return T.StructType(parts)


def embedded_columns(prefix: str, of: EmbedStruct | EmbedEnum, nullable: bool) -> Iterator[tuple[str, T.DataType, bool]]:
    """Name, type and whether it may be NULL of each column."""
    if isinstance(of, EmbedEnum):
        yield prefix, of.type, nullable
        seen = set()
        for v in of.variants:
            for f in v.fields:
                name = f"{prefix}_{f.col}"
                if name not in seen:
                    seen.add(name)
                    yield name, f.spark_type, True
    elif of.newtype:
        yield prefix, of.fields[0].spark_type, nullable
    else:
        for f in of.fields:
            if isinstance(f, Field):
                yield f"{prefix}_{f.col}", f.spark_type, nullable or f.nullable
            else:
                yield from embedded_columns(f"{prefix}_{f.col}", f.of, nullable or f.nullable)


@dataclass
class Model:
    name: str
    table: str
    fields: tuple
    key: tuple[str, ...]
    indices: tuple[Index, ...] = ()
    registry: Registry | None = field(default=None, repr=False, compare=False)

    def field(self, name: str):
        return _named(self.fields, name, self.name)

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    @property
    def f(self):
        """Paths from this model: ``model.f.name``."""
        from tessera.expr import Path

        return Path(self)

    @property
    def stored(self) -> list:
        return [f for f in self.fields if not isinstance(f, Relation)]

    @property
    def relations(self) -> list:
        return [f for f in self.fields if isinstance(f, Relation)]

    @property
    def version_field(self) -> Field | None:
        return next((f for f in self.fields if isinstance(f, Field) and f.versioned), None)

    def columns(self) -> list[tuple[str, T.DataType, bool]]:
        out = []
        for f in self.stored:
            if isinstance(f, Field):
                out.append((f.col, f.spark_type, f.nullable))
            elif isinstance(f, Embedded):
                out += embedded_columns(f.col, f.of, f.nullable)
            else:
                out.append((f.col, T.StringType() if f.storage == "json" else f.value_type, f.nullable))
        return out

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, t, null) for n, t, null in self.columns()])

    def columns_of(self, names: Sequence[str]) -> list[str]:
        """The single columns of fields that have one."""
        return [self.field(n).col for n in names]

    def key_columns(self) -> list[str]:
        return self.columns_of(self.key)

    def unique_sets(self) -> list[tuple[str, ...]]:
        """Fields that no two rows share."""
        out = [tuple(self.key)]
        out += [(f.name,) for f in self.fields if isinstance(f, Field) and f.unique]
        return out + [tuple(i.fields) for i in self.indices if i.unique]

    def index_prefixes(self) -> list[tuple[str, ...]]:
        """Field lists that get_by, filter_by, update_by and delete_by exist for."""
        sets = [tuple(self.key), *((f.name,) for f in self.fields if isinstance(f, Field) and (f.unique or f.index)), *(tuple(i.fields) for i in self.indices)]
        return list(dict.fromkeys(s[:n] for s in sets for n in range(1, len(s) + 1)))


class Registry:
    """Linked models."""

    def __init__(self, *models: Model):
        self.models: dict[str, Model] = {}
        for m in models:
            if m.name in self.models:
                raise InvalidSchema(f"two models are named {m.name!r}")
            self.models[m.name] = m
            m.registry = self
        for m in models:
            self._verify(m)
        self._verify_eager()

    def __getitem__(self, name: str) -> Model:
        if name not in self.models:
            raise InvalidSchema(f"no model is named {name!r}")
        return self.models[name]

    def _verify(self, m: Model) -> None:
        names = [f.name for f in m.fields]
        if len(names) != len(set(names)):
            raise InvalidSchema(f"{m.name}: two fields have one name")
        columns = [c for c, _, _ in m.columns()]
        if len(columns) != len(set(columns)):
            raise InvalidSchema(f"{m.name}: two fields have one column")
        if not m.key:
            raise InvalidSchema(f"{m.name}: no primary key")
        for n in [*m.key, *(x for i in m.indices for x in i.fields)]:
            if isinstance(m.field(n), Relation):
                raise InvalidSchema(f"{m.name}.{n}: a relation can't be a key")
        if sum(1 for f in m.fields if isinstance(f, Field) and f.versioned) > 1:
            raise InvalidSchema(f"{m.name}: two version fields")
        for r in m.relations:
            if isinstance(r, BelongsTo):
                target = self[r.target]
                for own, other in r.keys.items():
                    mine, theirs = m.field(own), target.field(other)
                    if isinstance(mine, Field) and isinstance(theirs, Field) and mine.spark_type != theirs.spark_type:
                        raise InvalidSchema(f"{m.name}.{own} and {target.name}.{other} differ in type")
                if not any(set(u) <= set(r.keys.values()) for u in target.unique_sets()):
                    raise InvalidSchema(f"{m.name}.{r.name}: its target fields aren't a unique key of {target.name}")
            elif isinstance(r, HasMany | HasOne):
                pair = self[r.target].field(r.pair)
                if not isinstance(pair, BelongsTo) or pair.target != m.name:
                    raise InvalidSchema(f"{m.name}.{r.name}: {r.target}.{r.pair} doesn't belong to {m.name}")
            else:
                self.via_steps(m, r)

    def via_steps(self, m: Model, via: Via) -> tuple[list[tuple[Model, Relation]], Model, str | None]:
        """Single relations with the model each starts at, the last model, and the scalar at the end, if any."""
        steps, scalar = [], None
        for i, name in enumerate(via.path):
            f = m.field(name)
            if isinstance(f, Via):
                inner, m, scalar = self.via_steps(m, f)
                steps += inner
            elif isinstance(f, Relation):
                steps.append((m, f))
                m = self[f.target]
            else:
                scalar = name
            if scalar and i < len(via.path) - 1:
                raise InvalidSchema(f"{via.name}: a column in the middle of a path")
        if not steps:
            raise InvalidSchema(f"{via.name}: no relation in the path")
        return steps, m, scalar

    def target(self, m: Model, r: Relation) -> Model:
        return self.via_steps(m, r)[1] if isinstance(r, Via) else self[r.target]

    def link(self, m: Model, r: BelongsTo | HasMany | HasOne) -> tuple[list[str], list[str]]:
        """Columns of this side and of the target that are equal where rows are related."""
        target = self[r.target]
        if isinstance(r, BelongsTo):
            return m.columns_of(list(r.keys)), target.columns_of(list(r.keys.values()))
        pair = target.field(r.pair)
        return m.columns_of(list(pair.keys.values())), target.columns_of(list(pair.keys))

    def _verify_eager(self) -> None:
        """Eager relations must not come back to where they began."""
        done: set[str] = set()

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise InvalidSchema("eager relations form a cycle: " + " > ".join((*above, name)))
            if name not in done:
                for r in self[name].relations:
                    if r.eager:
                        visit(self.target(self[name], r).name, (*above, name))
                done.add(name)

        for name in self.models:
            visit(name, ())


def value_of(default: Any) -> Any:
    return default() if isinstance(default, Callable) else default
