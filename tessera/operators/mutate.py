"""Mutations as new snapshots: every write takes tables as DataFrames and gives the tables as they are afterwards.

Nothing is written here. A database keeps the new frames (``sources.db``), a commit stores them. Guards (uniqueness,
conditions, versions) are counted before a change is kept."""

from __future__ import annotations

import json
import secrets
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import InvalidStatement, UniqueViolation, ValidationFailed
from tessera.expr import Expr, Path, column_name
from tessera.functions import scalars
from tessera.functions.types import in_range
from tessera.model import BelongsTo, Document, EmbedEnum, Embedded, EmbedStruct, Field, HasMany, HasOne, Model, Relation, embedded_columns, value_of

# What a field is set to.


@dataclass(frozen=True)
class Change:
    """A new value made of the old one."""

    make: Callable[[Column, T.DataType], Column]


def set_(v: Any) -> Change:
    return Change(lambda _, kind: _value(v).cast(kind))


def add(n: Any) -> Change:
    """Overflow is an error."""
    return Change(lambda c, kind: (c + _value(n)).cast(kind))


def subtract(n: Any) -> Change:
    return Change(lambda c, kind: (c - _value(n)).cast(kind))


def increment() -> Change:
    return add(1)


def decrement() -> Change:
    return subtract(1)


def push(v: Any) -> Change:
    return Change(lambda c, kind: scalars.push(c, _value(v)).cast(kind))


def extend(vs: Sequence[Any]) -> Change:
    return Change(lambda c, kind: scalars.extend(c, vs).cast(kind))


def pop() -> Change:
    return Change(lambda c, _: scalars.pop(c))


def remove(v: Any) -> Change:
    return Change(lambda c, _: scalars.remove(c, v))


def remove_at(i: int) -> Change:
    return Change(lambda c, _: scalars.remove_at(c, i))


def clear() -> Change:
    return Change(lambda c, _: scalars.clear(c))


def apply(changes: Sequence[Change]) -> Change:
    """One after the other; of no changes none."""

    def make(c: Column, kind: T.DataType) -> Column:
        for change in changes:
            c = change.make(c, kind)
        return c

    return Change(make)


@dataclass(frozen=True)
class Patch:
    """Nested values of an embedded struct or a document: {"a.b": value}."""

    values: dict[str, Any]


def patch(**values: Any) -> Patch:
    return Patch({k.replace("__", "."): v for k, v in values.items()})


@dataclass(frozen=True)
class Incoming:
    """In the update branch of an upsert: the value that the new row proposes."""

    name: str


def incoming(name: str) -> Incoming:
    return Incoming(name)


def _value(v: Any) -> Column:
    if isinstance(v, Path):
        return v.value()
    if isinstance(v, Expr):
        return v.column()
    return v if isinstance(v, Column) else F.lit(v)


# Rows to stored columns.


def uuid7() -> str:
    """Time-ordered: 48 bits of milliseconds, then random bits."""
    n = int(time.time() * 1000) << 80 | 7 << 76 | secrets.randbits(12) << 64 | 2 << 62 | secrets.randbits(62)
    return str(uuid.UUID(int=n))


def encode_embedded(prefix: str, of: EmbedStruct | EmbedEnum, v: Any) -> dict[str, Any]:
    if isinstance(of, EmbedEnum):
        name, values = (v, {}) if isinstance(v, str) else (v["variant"], v)
        variant = of.variant(name)
        return {prefix: variant.value} | {f"{prefix}_{f.col}": values.get(f.name) for f in variant.fields}
    if of.newtype:
        return {prefix: v[of.fields[0].name] if isinstance(v, dict) else v}
    out: dict[str, Any] = {}
    for f in of.fields:
        x = v.get(f.name)
        if isinstance(f, Field):
            out[f"{prefix}_{f.col}"] = x
        elif x is not None:
            out |= encode_embedded(f"{prefix}_{f.col}", f.of, x)
    return out


def check_value(model: Model, f: Field, v: Any) -> None:
    name = f"{model.name}.{f.name}"
    if v is None:
        if not f.nullable:
            raise ValidationFailed(f"{name} is required")
        return
    if f.min_length is not None and len(v) < f.min_length:
        raise ValidationFailed(f"{name} is shorter than {f.min_length}")
    if f.max_length is not None and len(v) > f.max_length:
        raise ValidationFailed(f"{name} is longer than {f.max_length}")
    if f.one_of is not None and v not in f.one_of:
        raise ValidationFailed(f"{name}: {v!r} is not allowed")


def encode(model: Model, values: dict[str, Any], make_ids: bool = True) -> dict[str, Any]:
    """A new row's stored columns from its fields' values; ids and defaults are made. Increments stay NULL."""
    known = {f.name for f in model.fields}
    if unknown := set(values) - known:
        raise InvalidStatement(f"{model.name} has no {', '.join(sorted(unknown))}")
    out: dict[str, Any] = {}
    for f in model.stored:
        v = values.get(f.name)
        if isinstance(f, Field):
            if f.name not in values:
                if f.auto in ("uuid4", "uuid7") and make_ids:
                    v = str(uuid.uuid4()) if f.auto == "uuid4" else uuid7()
                elif f.versioned:
                    v = 1
                elif f.default is not None:
                    v = value_of(f.default)
                elif f.update is not None:
                    v = value_of(f.update)
            if not (f.auto == "increment" and v is None):
                check_value(model, f, v)
            out[f.col] = v
            continue
        if v is None:
            if not f.nullable:
                raise ValidationFailed(f"{model.name}.{f.name} is required")
        elif isinstance(f, Embedded):
            out |= encode_embedded(f.col, f.of, v)
        else:
            out[f.col] = json.dumps(v, separators=(",", ":"), ensure_ascii=False, default=str) if f.storage == "json" else v
    return {c: out.get(c) for c, _, _ in model.columns()}


def rows_frame(spark, model: Model, rows: Sequence[dict[str, Any]]) -> DataFrame:
    """Encoded rows as a frame of the model's schema."""
    schema = T.StructType([T.StructField(n, t, True) for n, t, _ in model.columns()])
    return spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)


def with_increments(table: DataFrame, new: DataFrame, model: Model, settle: bool = True) -> DataFrame:
    """Numbers behind the largest so far for increment fields without a value: one after the other over the partitions, from
    their counts of rows. The rows are written out first (to spark.checkpoint.dir), so that a number stays its row's."""
    fields = [f for f in model.stored if isinstance(f, Field) and f.auto == "increment"]
    if not fields:
        return new
    if settle and new.sparkSession.sparkContext.getCheckpointDir():
        new = new.checkpoint()
    partition, low = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for p, n in sorted((r.p, r["count"]) for r in new.groupBy(partition.alias("p")).count().collect()):  # one row for each partition
        before[p], total = total, total + n
    first = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[partition] if before else F.lit(0)
    for f in fields:
        largest = max(table.agg(F.max(f.col)).first()[0] or 0, new.agg(F.max(f.col)).first()[0] or 0)
        new = new.withColumn(f.col, F.coalesce(F.col(f.col), (low + first + largest + 1).cast(f.spark_type)))
    return new


def completed(model: Model, rows: DataFrame) -> DataFrame:
    """Stored columns of new rows: ids, versions and defaults where the frame has no such column, and every value checked."""
    have, out = set(rows.columns), []
    by_column = {f.col: f for f in model.stored if isinstance(f, Field)}
    for name, kind, _ in model.columns():
        f = by_column.get(name)
        if name in have:
            value = F.col(name)
        elif f is not None and f.auto in ("uuid4", "uuid7"):
            # The time in front makes a uuid7; the rest is a uuid4's.
            stamp = F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0")
            front = F.lower(F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7")))
            value = F.uuid() if f.auto == "uuid4" else F.concat(front, F.substring(F.uuid(), 16, 21))
        elif f is not None and f.versioned:
            value = F.lit(1)
        elif f is not None and (f.default is not None or f.update is not None):
            value = F.lit(value_of(f.default if f.default is not None else f.update))
        else:
            value = F.lit(None)
        value = value.cast(kind)
        out.append((checked(model, f, value) if f is not None and f.auto != "increment" else value).alias(name))
    return rows.select(*out)


def checked(model: Model, f: Field, c: Column) -> Column:
    """A new value that raises where it breaks the field's constraints."""
    tests = [c.isNotNull()] if not f.nullable else []
    if f.min_length is not None:
        tests.append(F.length(c) >= f.min_length)
    if f.max_length is not None:
        tests.append(F.length(c) <= f.max_length)
    if f.one_of is not None:
        tests.append(c.isin(*f.one_of))
    ok = in_range(f.type, c)
    if ok is not None:
        tests.append(ok)
    for test in tests:
        c = F.when(F.coalesce(test, F.lit(f.nullable)), c).otherwise(F.raise_error(F.lit(f"{model.name}.{f.name}: the new value is not valid")).cast(f.spark_type))
    return c


# Single-table changes.


def assigned(model: Model, assignments: dict[str, Any], of: Callable[[str], Column] = F.col, proposed: Callable[[str], Column] | None = None) -> dict[str, Column]:
    """New columns by name. ``of``: a stored column; ``proposed``: an incoming one."""
    out: dict[str, Column] = {}
    for name, v in assignments.items():
        f = model.field(name)
        if isinstance(f, BelongsTo):
            # The relation is set by its key; None unlinks.
            for mine, other in f.keys.items():
                key = None if v is None else v[other]
                field = model.field(mine)
                if key is None and not field.nullable:
                    raise ValidationFailed(f"{model.name}.{mine} is required")
                out[field.col] = F.lit(key).cast(field.spark_type)
        elif isinstance(f, Relation):
            raise InvalidStatement(f"{model.name}.{name} is changed through its rows")
        elif isinstance(v, Patch):
            out |= _patched(model, f, v, of)
        elif isinstance(f, Embedded):
            new = {c: None for c, _, _ in _embedded_columns(f)} | (encode_embedded(f.col, f.of, v) if v is not None else {})
            kinds = {c: t for c, t, _ in _embedded_columns(f)}
            out |= {c: F.lit(x).cast(kinds[c]) for c, x in new.items()}
        elif isinstance(f, Document):
            if f.storage == "json":
                out[f.col] = F.lit(None if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False, default=str))
            else:
                out[f.col] = _value(v).cast(f.value_type)
        elif isinstance(v, Incoming):
            if proposed is None:
                raise InvalidStatement("incoming values exist in upserts only")
            out[f.col] = checked(model, f, proposed(model.field(v.name).col).cast(f.spark_type))
        else:
            change = v if isinstance(v, Change) else set_(v)
            if isinstance(v, list | tuple) and isinstance(f.spark_type, T.ArrayType):
                change = Change(lambda _, kind, v=v: scalars.array_of(v).cast(kind))
            out[f.col] = checked(model, f, change.make(of(f.col), f.spark_type))
    return out


def _embedded_columns(f: Embedded):
    return list(embedded_columns(f.col, f.of, True))


def _patched(model: Model, f: Any, p: Patch, of: Callable[[str], Column]) -> dict[str, Column]:
    if isinstance(f, Document):
        doc = of(f.col) if f.storage == "struct" else F.from_json(of(f.col), f.value_type)
        for path, v in p.values.items():
            doc = scalars.patched(doc, path.split("."), v)
        return {f.col: doc if f.storage == "struct" else F.to_json(doc)}
    out = {}
    for path, v in p.values.items():
        _, chain = Path(model, (f.name, *path.split("."))).resolve()
        column, last = column_name(chain), chain[-1]
        change = v if isinstance(v, Change) else set_(v)
        out[column] = change.make(of(column), last.spark_type)
    return out


def with_updates(model: Model, assignments: dict[str, Any]) -> dict[str, Any]:
    """The assignments and what every update sets."""
    extra = {f.name: value_of(f.update) for f in model.stored if isinstance(f, Field) and f.update is not None and f.name not in assignments}
    version = model.version_field
    if version and version.name not in assignments:
        extra[version.name] = increment()
    return assignments | extra


def update_frame(model: Model, flagged: DataFrame, hit: str, assignments: dict[str, Any]) -> DataFrame:
    """``flagged`` has the table's columns and ``hit``; so has the result."""
    new = assigned(model, with_updates(model, assignments))
    kinds = dict(flagged.dtypes)
    return flagged.select(*[F.when(F.col(hit), new[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in new else F.col(c) for c in flagged.columns])


def check_unique(table: DataFrame, new: DataFrame, model: Model, sets: Sequence[tuple[str, ...]] | None = None) -> None:
    """Raises if new rows repeat a unique key of each other's or of the table's. NULLs repeat nothing."""
    for fields in model.unique_sets() if sets is None else sets:
        columns = model.columns_of(fields)
        own = new.select(*columns).dropna("any", subset=columns)
        if not own.groupBy(*columns).count().where("count > 1").isEmpty():
            raise UniqueViolation(f"{model.name}: rows with equal {', '.join(fields)}")
        if not table.select(*columns).join(own, columns, "left_semi").isEmpty():
            raise UniqueViolation(f"{model.name}: {', '.join(fields)} is taken")


def upsert_frame(
    model: Model, table: DataFrame, rows: DataFrame, on: Sequence[str], on_create: dict[str, Any] | None = None, on_update: dict[str, Any] | None = None, ignore: bool = False, assigned_names: Sequence[str] = ()
) -> DataFrame:
    """A full outer join on the unique fields. ``rows``: proposed rows with the table's columns. Where both sides have a
    row, ``assigned_names`` take the proposed value, ``on_update`` its own; where only the new one is there, it goes in
    with ``on_create`` over it. Result: the table's columns and __outcome: kept, created, updated or ignored."""
    columns = [c for c, _, _ in model.columns()]
    keys = model.columns_of(on)
    old = table.select(*[F.col(c).alias(f"__o_{c}") for c in columns], F.lit(True).alias("__old"))
    new = rows.select(*[F.col(c).alias(f"__n_{c}") for c in columns], F.lit(True).alias("__new"))
    condition = None
    for k in keys:
        c = F.col(f"__o_{k}") == F.col(f"__n_{k}")
        condition = c if condition is None else condition & c
    both = old.join(new, condition, "full_outer")
    has_old, has_new = F.coalesce(F.col("__old"), F.lit(False)), F.coalesce(F.col("__new"), F.lit(False))
    stored, proposed = (lambda c: F.col(f"__o_{c}")), (lambda c: F.col(f"__n_{c}"))
    # A row that is there keeps its primary key.
    shared = {n: Incoming(n) for n in assigned_names if n not in on and n not in model.key and isinstance(model.field(n), Field)}
    whole = [f for n in assigned_names if not isinstance(f := model.field(n), Field | Relation)]
    updates = with_updates(model, shared | (on_update or {}))
    changed = {c: proposed(c) for f in whole if f.name not in (on_update or {}) for c, _, _ in (_embedded_columns(f) if isinstance(f, Embedded) else [(f.col, None, None)])}
    changed |= assigned(model, updates, stored, proposed)
    created = assigned(model, on_create or {}, proposed, proposed)
    version = model.version_field
    if version:
        created[version.col] = F.lit(1).cast(version.spark_type)
    kinds = {c: t for c, t, _ in model.columns()}
    out = []
    for c in columns:
        match = stored(c) if ignore else changed.get(c, stored(c))
        out.append(F.when(has_old & has_new, match).when(has_new, created.get(c, proposed(c))).otherwise(stored(c)).cast(kinds[c]).alias(c))
    outcome = F.when(has_old & has_new, F.lit("ignored" if ignore else "updated")).when(has_new, F.lit("created")).otherwise(F.lit("kept"))
    return both.select(*out, outcome.alias("__outcome"))


def referring(model: Model) -> list[tuple[Model, BelongsTo, bool]]:
    """Models whose rows belong to this model's through a relation that this model declares, and whether that may be NULL."""
    out = []
    for r in model.relations:
        if isinstance(r, HasMany | HasOne):
            child = model.registry[r.target]
            pair = child.field(r.pair)
            out.append((child, pair, pair.nullable or all(child.field(k).nullable for k in pair.keys)))
    return out

