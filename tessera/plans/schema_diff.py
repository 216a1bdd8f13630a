"""Differences between two states of a schema, and the Spark SQL that leads from one to the other."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.model import Model, Registry


@dataclass(frozen=True)
class TableState:
    columns: dict[str, tuple[str, bool]]
    indices: frozenset = frozenset()


def state(registry: Registry) -> dict[str, TableState]:
    def of(m: Model) -> TableState:
        return TableState({n: (t.simpleString(), null) for n, t, null in m.columns()}, frozenset((tuple(m.columns_of(i.fields)), i.unique) for i in m.indices))

    return {m.table: of(m) for m in registry.models.values()}


@dataclass
class Diff:
    created: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    renamed: list[tuple[str, str]] = field(default_factory=list)
    added: list[tuple[str, str, str]] = field(default_factory=list)
    removed: list[tuple[str, str]] = field(default_factory=list)
    columns_renamed: list[tuple[str, str, str]] = field(default_factory=list)
    altered: list[tuple[str, str, str, str]] = field(default_factory=list)
    nullability: list[tuple[str, str, bool]] = field(default_factory=list)
    indices_added: list[tuple[str, tuple, bool]] = field(default_factory=list)
    indices_removed: list[tuple[str, tuple, bool]] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not any(vars(self).values())


def diff(old: dict[str, TableState], new: dict[str, TableState], tables: dict[str, str] | None = None, columns: dict[tuple[str, str], str] | None = None) -> Diff:
    """``tables``: old to new names; ``columns``: (new table name, old column) to new column. Without such a hint a rename is
    a drop and an addition."""
    tables, columns, out = tables or {}, columns or {}, Diff()
    for a, b in tables.items():
        if a in old and b in new:
            out.renamed.append((a, b))
    before = {tables.get(t, t): s for t, s in old.items()}
    out.created = [t for t in new if t not in before]
    out.dropped = [t for t in old if tables.get(t, t) not in new]
    for t, s in new.items():
        if t not in before:
            continue
        was = {columns.get((t, c), c): (c, kind) for c, kind in before[t].columns.items()}
        for c, (kind, null) in s.columns.items():
            if c not in was:
                out.added.append((t, c, kind))
                continue
            name, (old_kind, old_null) = was[c]
            if name != c:
                out.columns_renamed.append((t, name, c))
            if old_kind != kind:
                out.altered.append((t, c, old_kind, kind))
            if old_null != null:
                out.nullability.append((t, c, null))
        out.removed += [(t, name) for c, (name, _) in was.items() if c not in s.columns]
        out.indices_added += [(t, *i) for i in sorted(s.indices - before[t].indices)]
        out.indices_removed += [(t, *i) for i in sorted(before[t].indices - s.indices)]
    return out


def statements(d: Diff, new: dict[str, TableState]) -> list[str]:
    """Indices have no statement in Spark; they are checks before a write."""
    out = [f"ALTER TABLE {a} RENAME TO {b}" for a, b in d.renamed]
    for t in d.created:
        columns = ", ".join(f"{c} {kind}{'' if null else ' NOT NULL'}" for c, (kind, null) in new[t].columns.items())
        out.append(f"CREATE TABLE {t} ({columns}) USING parquet")
    out += [f"ALTER TABLE {t} RENAME COLUMN {a} TO {b}" for t, a, b in d.columns_renamed]
    out += [f"ALTER TABLE {t} ADD COLUMNS ({c} {kind})" for t, c, kind in d.added]
    out += [f"ALTER TABLE {t} ALTER COLUMN {c} TYPE {kind}" for t, c, _, kind in d.altered]
    out += [f"ALTER TABLE {t} DROP COLUMN {c}" for t, c in d.removed]
    return out + [f"DROP TABLE {t}" for t in d.dropped]


def migrated(df, d: Diff, table: str):
    """A stored frame as the new schema has it: renames, casts, new columns as NULL, removed ones gone."""
    from pyspark.sql import functions as F

    for t, a, b in d.columns_renamed:
        if t == table:
            df = df.withColumnRenamed(a, b)
    for t, c, _, kind in d.altered:
        if t == table:
            df = df.withColumn(c, F.col(c).cast(kind))
    for t, c, kind in d.added:
        if t == table:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df.drop(*[c for t, c in d.removed if t == table])
