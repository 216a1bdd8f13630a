"""Migrations: numbered steps from one schema state to the next, kept as JSON files, applied once each to a database.

A step holds the state it leads to and the rename hints that its diff needs; the diff itself is made anew, so a file
says what is wanted and not how."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import types as T

from tessera.errors import InvalidStatement
from tessera.model import Registry
from tessera.plans.schema_diff import Diff, TableState, diff, migrated, state, statements

#: The table that names the steps a database has seen.
HISTORY = "applied_migrations"


def _dump(s: dict[str, TableState]) -> dict:
    return {t: {"columns": {c: list(v) for c, v in x.columns.items()}, "indices": sorted([list(c), u] for c, u in x.indices)} for t, x in s.items()}


def _load(d: dict) -> dict[str, TableState]:
    return {t: TableState({c: tuple(v) for c, v in x["columns"].items()}, frozenset((tuple(c), u) for c, u in x["indices"])) for t, x in d.items()}


def steps(folder: str) -> list[dict]:
    return [json.loads(p.read_text()) for p in sorted(Path(folder).glob("[0-9]*.json"))]


def generate(registry: Registry, folder: str, name: str, tables: dict[str, str] | None = None, columns: dict[tuple[str, str], str] | None = None) -> str | None:
    """Writes the next step if the models differ from the last one's state; returns its id."""
    done = steps(folder)
    old, new = _load(done[-1]["state"]) if done else {}, state(registry)
    if diff(old, new, tables, columns).empty:
        return None
    key = f"{len(done) + 1:04d}_{name}"
    Path(folder).mkdir(parents=True, exist_ok=True)
    hints = {"tables": tables or {}, "columns": [[t, a, b] for (t, a), b in (columns or {}).items()]}
    Path(folder, f"{key}.json").write_text(json.dumps({"id": key, "hints": hints, "state": _dump(new)}, indent=1))
    return key


def plan(folder: str) -> list[tuple[str, Diff, list[str]]]:
    """Each step's id, diff and Spark SQL."""
    out, old = [], {}
    for step in steps(folder):
        new, hints = _load(step["state"]), step["hints"]
        d = diff(old, new, hints["tables"], {(t, a): b for t, a, b in hints["columns"]})
        out.append((step["id"], d, statements(d, new)))
        old = new
    return out


def apply(db, folder: str) -> list[str]:
    """Applies the steps that the database hasn't seen, in order, in one transaction; returns their ids."""
    applied = [r.id for r in db._raw(HISTORY).orderBy("id").collect()] if db.has_table(HISTORY) else []
    todo = plan(folder)
    if applied != [key for key, _, _ in todo[: len(applied)]]:
        raise InvalidStatement("the database has seen other migrations than the folder has")
    fresh = todo[len(applied) :]
    states = {s["id"]: _load(s["state"]) for s in steps(folder)}
    with db.transaction():
        layer = db._layers[-1]
        for key, d, _ in fresh:
            for a, b in d.renamed:
                layer[b] = db._raw(a)
            for t in d.created:
                fields = [T.StructField(c, T._parse_datatype_string(kind), null) for c, (kind, null) in states[key][t].columns.items()]
                layer[t] = db.spark.createDataFrame([], T.StructType(fields))
            touched = {x[0] for x in (*d.columns_renamed, *d.altered, *d.added, *d.removed)}
            for t in touched:
                layer[t] = migrated(db._raw(t), d, t).select(*states[key][t].columns)
        if fresh:
            layer[HISTORY] = db.spark.createDataFrame([(k,) for k, _, _ in todo], "id string")
    return [key for key, _, _ in fresh]
