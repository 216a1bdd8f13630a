"""Walking relations: related rows of a set of rows, and distinct ends of longer paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidStatement
from tessera.model import BelongsTo, HasMany, HasOne, Model, Via


def related(db, rows: DataFrame, model: Model, relation) -> tuple[DataFrame, Model, str | None]:
    """The target's rows that are related to some of ``rows``, each once; the target; the scalar column at the end, if any."""
    registry = model.registry
    if isinstance(relation, Via):
        steps, target, scalar = registry.via_steps(model, relation)
        for m, r in steps:
            rows, _, _ = related(db, rows, m, r)
        return rows, target, scalar
    target = registry[relation.target]
    mine, theirs = registry.link(model, relation)
    names = [f"__n{i}" for i in range(len(mine))]
    keys = rows.select(*[F.col(c).alias(n) for c, n in zip(mine, names, strict=True)])
    condition = None
    for name, column in zip(names, theirs, strict=True):
        c = F.col(column) == F.col(name)
        condition = c if condition is None else condition & c
    return db.table(target).join(keys, condition, "left_semi"), target, None


def linked(db, rows: DataFrame, model: Model, relation, key_names: list[str]) -> tuple[DataFrame, Model, str | None]:
    """Pairs of a source row's key (as ``key_names``) and its related rows, each pair once: inner joins along the path."""
    registry = model.registry
    steps, target, scalar = registry.via_steps(model, relation) if isinstance(relation, Via) else ([(model, relation)], registry[relation.target], None)
    out = rows.select(*[F.col(c).alias(n) for c, n in zip(model.key_columns(), key_names, strict=True)], *[F.col(c).alias(f"__s_{c}") for c in registry.link(*steps[0])[0]])
    for i, (m, r) in enumerate(steps):
        if not isinstance(r, BelongsTo | HasMany | HasOne):
            raise InvalidStatement("a path is made of single relations")
        mine, theirs = registry.link(m, r)
        then = db.table(registry[r.target])
        last = i == len(steps) - 1
        # Of rows on the way only the columns that the next step joins on.
        wanted = then.columns if last else registry.link(*steps[i + 1])[0]
        condition = None
        for a, b in zip(mine, theirs, strict=True):
            c = F.col(f"__s_{a}") == F.col(f"__t_{b}")
            condition = c if condition is None else condition & c
        then = then.select(*[F.col(c).alias(f"__t_{c}") for c in dict.fromkeys([*theirs, *wanted])])
        out = out.join(then, condition, "inner").select(*key_names, *[F.col(f"__t_{c}").alias(f"__s_{c}") for c in wanted])
        if not last:
            out = out.distinct()
    out = out.select(*key_names, *[F.col(f"__s_{c}").alias(c) for c in db.table(target).columns])
    if len(steps) > 1:
        out = out.dropDuplicates([*key_names, *target.key_columns()])
    return out, target, scalar
