"""A database of models: tables as DataFrames, mutations as an overlay of new snapshots, transactions, commits.

Reads see the overlay. A transaction works on an overlay of its own and gives it to the one around it, or drops it. A
commit writes all changed tables beside the old ones and then swaps directories; one writer at a time."""

from __future__ import annotations

import contextlib
import logging
import time
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.errors import ConditionFailed, InvalidStatement, ReadOnlyTransaction, RecordNotFound, SerializationFailure, UnsupportedFeature
from tessera.expr import Exists, Expr, Path, and_all
from tessera.model import BelongsTo, HasMany, HasOne, Model, Registry, Relation, Via
from tessera.operators import mutate
from tessera.operators.predicates import with_predicate
from tessera.query import Query
from tessera.sources.connect import finder, loader

ISOLATION = ("read_uncommitted", "read_committed", "repeatable_read", "serializable")
HIT = "__hit"
log = logging.getLogger("tessera")


class Db:
    def __init__(self, spark: SparkSession, registry: Registry, url: str | None = None, tables: dict[str, DataFrame] | None = None, slow_seconds: float | None = None):
        self.spark, self.registry, self.url, self.slow_seconds = spark, registry, url, slow_seconds
        self._load = loader(spark, url) if url else None
        self._stored = finder(spark, url) if url else None
        self._base: dict[str, DataFrame] = dict(tables or {})
        self._layers: list[dict[str, DataFrame]] = [{}]
        self._read_only = False
        self._seen: dict[str, list] = {}

    # Tables.

    def _raw(self, name: str) -> DataFrame:
        for layer in reversed(self._layers):
            if name in layer:
                return layer[name]
        if name not in self._base:
            if self._load is None:
                raise InvalidStatement(f"no table {name!r}")
            self._base[name] = self._load(name)
        return self._base[name]

    def table(self, model: Model | str) -> DataFrame:
        """A model's stored columns."""
        model = self.registry[model] if isinstance(model, str) else model
        return self._raw(model.table).select(*[F.col(c) for c, _, _ in model.columns()])

    def _put(self, model: Model, df: DataFrame) -> None:
        if self._read_only:
            raise ReadOnlyTransaction(f"{model.name} can't change in a read-only transaction")
        self._layers[-1][model.table] = df

    def check_schema(self, model: Model) -> None:
        """The table's columns have the declared types."""
        have = {f.name: f.dataType for f in self._raw(model.table).schema}
        for name, kind, _ in model.columns():
            if name not in have or have[name].simpleString() != kind.simpleString():
                raise InvalidStatement(f"{model.table}.{name}: {have.get(name)} is stored, {kind} declared")

    def has_table(self, name: str) -> bool:
        """Whether there is such a table; one that can't be read is there."""
        return any(name in layer for layer in self._layers) or name in self._base or (self._stored is not None and self._stored(name))

    def push_schema(self) -> None:
        """Empty tables for all models that have none."""
        for m in self.registry.models.values():
            if not self.has_table(m.table):
                self._put(m, self.spark.createDataFrame([], m.schema()))

    def reset(self) -> None:
        """All tables empty."""
        for m in self.registry.models.values():
            self._put(m, self.spark.createDataFrame([], m.schema()))

    def observed(self, query: Query, run):
        """Logs each query's model and seconds; slow ones as warnings."""
        began = time.perf_counter()
        out = run()
        seconds = time.perf_counter() - began
        slow = self.slow_seconds is not None and seconds >= self.slow_seconds
        log.log(logging.WARNING if slow else logging.DEBUG, "%s query on %s: %d rows in %.3f s", "slow" if slow else "a", query.model.name, len(out), seconds)
        return out

    # Queries.

    def all(self, model: Model | str) -> Query:
        return Query(self.registry[model] if isinstance(model, str) else model, self)

    def filter(self, model: Model | str, predicate: Expr) -> Query:
        return self.all(model).filter(predicate)

    def filter_by(self, model: Model | str, **keys: Any) -> Query:
        """By the leading fields of an index."""
        model = self.registry[model] if isinstance(model, str) else model
        if tuple(keys) not in model.index_prefixes() and tuple(sorted(keys)) not in [tuple(sorted(p)) for p in model.index_prefixes()]:
            raise InvalidStatement(f"{model.name} has no index on {', '.join(keys)}")
        return self.all(model).filter(and_all([Path(model, (k,)).eq(v) for k, v in keys.items()]))

    def get_by(self, model: Model | str, **keys: Any) -> Row:
        return self.filter_by(model, **keys).one()

    def get_by_keys(self, model: Model | str, keys: Sequence[Any]) -> Query:
        """Rows by primary keys; composite ones as tuples."""
        from tessera.expr import in_query, or_all

        model = self.registry[model] if isinstance(model, str) else model
        paths = [Path(model, (k,)) for k in model.key]
        if len(paths) == 1:
            return self.all(model).filter(paths[0].in_list([k[0] if isinstance(k, tuple) else k for k in keys]))
        if len(keys) > 50:
            from pyspark.sql import types as T

            schema = T.StructType([T.StructField(c, model.field(k).spark_type) for c, k in zip(model.key_columns(), model.key, strict=True)])
            given = _Frame(self.spark.createDataFrame([tuple(k) for k in keys], schema))
            return self.all(model).filter(in_query(paths, given))
        return self.all(model).filter(or_all([and_all([p.eq(v) for p, v in zip(paths, k, strict=True)]) for k in keys]))

    def update_by(self, model: Model | str, keys: dict[str, Any], **assignments: Any):
        return self.update(self.filter_by(model, **keys), assignments)

    def delete_by(self, model: Model | str, **keys: Any):
        return self.delete(self.filter_by(model, **keys))

    def values(self, rows: Sequence[Sequence[Any]], schema: str) -> DataFrame:
        """A literal row set."""
        return self.spark.createDataFrame([tuple(r) for r in rows], schema)

    def unit(self, *columns: Any) -> DataFrame:
        """One row of values, from no table."""
        return self.spark.range(1).select(*[c if not isinstance(c, Expr) else c.column() for c in columns])

    # SQL.

    def sql(self, text: str, args: Sequence[Any] | dict[str, Any] | None = None, column_types: dict[str, str] | None = None) -> DataFrame:
        """A query in Spark SQL over the tables by name, with bound values."""
        for m in self.registry.models.values():
            if self.has_table(m.table):
                self._raw(m.table).createOrReplaceTempView(m.table)
        df = self.spark.sql(text, args=list(args) if isinstance(args, tuple | list) else args)
        return df.select(*[F.col(c).cast(column_types[c]) if column_types and c in column_types else F.col(c) for c in df.columns])

    def statement(self, text: str, args: Sequence[Any] | dict[str, Any] | None = None) -> list[Row]:
        """A statement in Spark SQL that runs at once."""
        return self.sql(text, args).collect()

    # Inserts.

    def create(self, model: Model | str, **values: Any) -> Row:
        """A row and, under its relations, the rows related to it."""
        return self.create_many(model, [values])[0]

    def create_many(self, model: Model | str, rows: Sequence[dict[str, Any]], check: bool = True) -> list[Row]:
        """Rows and what is under their relations: all of them or, after an error, none."""
        with self.transaction():
            return self._create_many(self.registry[model] if isinstance(model, str) else model, rows, check)

    def _create_many(self, model: Model, rows: Sequence[dict[str, Any]], check: bool) -> list[Row]:
        rows = [dict(r) for r in rows]
        for row in rows:
            for r in model.relations:
                if isinstance(r, BelongsTo) and row.get(r.name) is not None:
                    target = row.pop(r.name)
                    if isinstance(target, dict) and not all(k in target for k in r.keys.values()):
                        target = self.create(r.target, **target)
                    for mine, other in r.keys.items():
                        row[mine] = target[other]
        plain = [{k: v for k, v in row.items() if not isinstance(model.field(k), Relation)} if all(model.has(k) for k in row) else row for row in rows]
        for row in rows:
            for r in model.relations:
                if isinstance(r, Via) and r.name in row:
                    raise InvalidStatement(f"{model.name}.{r.name}: rows can't be created at the end of a path")
                if isinstance(r, HasOne) and r.required and row.get(r.name) is None:
                    raise InvalidStatement(f"{model.name}.{r.name} is required")
        table = self.table(model)
        new = mutate.with_increments(table, mutate.rows_frame(self.spark, model, [mutate.encode(model, r) for r in plain]), model, settle=False)
        made = new.collect()  # what was given, with ids
        new = self.spark.createDataFrame(made, new.schema)
        if check:
            mutate.check_unique(table, new, model)
        self._put(model, table.unionByName(new))
        for row, stored in zip(rows, made, strict=True):
            for r in model.relations:
                if isinstance(r, HasMany | HasOne) and row.get(r.name) is not None:
                    children = row[r.name] if isinstance(r, HasMany) else [row[r.name]]
                    mine, _ = self.registry.link(model, r)
                    pair = self.registry[r.target].field(r.pair)
                    link = {k: stored[c] for k, c in zip(pair.keys, mine, strict=True)}
                    self.create_many(r.target, [{**c, **link} for c in children], check)
        return self._decoded(model, new)

    def insert_frame(self, model: Model | str, rows: DataFrame, check: bool = True) -> DataFrame:
        """Rows from a frame of stored columns; the new table. Columns that it lacks get what ``create`` gives them, and
        values are held to their fields' constraints."""
        model = self.registry[model] if isinstance(model, str) else model
        table = self.table(model)
        full = mutate.with_increments(table, mutate.completed(model, rows), model)
        if check:
            mutate.check_unique(table, full, model)
        self._put(model, table.unionByName(full))
        return self.table(model)

    def _decoded(self, model: Model, stored: DataFrame) -> list[Row]:
        from tessera.expr import stored_value

        return stored.select(*[stored_value(f).alias(f.name) for f in model.stored]).collect()

    def create_through(self, query: Query, values: dict[str, Any]) -> Row:
        """A row of the query's model that belongs to where the query comes from and meets its equalities."""
        given = {k: v for k, v in query.scope.items() if k not in values}
        if query.through:
            parent, relation = query.through
            if isinstance(relation, Via):
                raise InvalidStatement(f"{parent.model.name}.{relation.name}: longer paths are read-only")
            if not isinstance(relation, HasMany | HasOne):
                raise InvalidStatement("rows are created under their parent")
            given |= self._link_values(parent, relation)
        return self.create(query.model, **{**given, **values})

    def _link_values(self, parent: Query, relation: HasMany | HasOne) -> dict[str, Any]:
        row = parent.limit(1).rows().first()
        if row is None:
            raise RecordNotFound(f"no {parent.model.name} matches")
        mine, _ = self.registry.link(parent.model, relation)
        pair = self.registry[relation.target].field(relation.pair)
        return {k: row[c] for k, c in zip(pair.keys, mine, strict=True)}

    # Updates.

    def _hits(self, query: Query) -> DataFrame:
        """The model's table with HIT: whether the query has the row."""
        model, table = query.model, self.table(query.model)
        if query.source is None and query.n is None:
            return with_predicate(self, table, query.predicate, HIT)
        keys = model.key_columns()
        found = Exists(tuple(F.col(k) for k in keys), tuple(keys), lambda db: query.bound(db).rows(), True)
        return with_predicate(self, table, found, HIT)

    def update(self, query: Query, assignments: dict[str, Any], condition: Expr | None = None) -> DataFrame:
        """The changed rows, as they are afterwards. With a condition all rows of the query must meet it."""
        if isinstance(query.through, tuple) and isinstance(query.through[1], Via):
            raise InvalidStatement("longer paths are read-only")
        query = query.bound(self)
        if condition is not None:
            self._guard(query, condition)
        flagged = self._hits(query)
        for name, v in assignments.items():
            if v is None and isinstance(query.model.field(name), BelongsTo):
                self._delete_required_owners(query, query.model.field(name))
        out = mutate.update_frame(query.model, flagged, HIT, assignments)
        self._put(query.model, out.drop(HIT))
        return out.filter(HIT).drop(HIT)

    def changed(self, query: Query, assignments: dict[str, Any]) -> bool:
        """Updates, and says whether any row was there to change."""
        return not self.update(query, assignments).isEmpty()

    def _guard(self, query: Query, condition: Expr) -> None:
        rows = with_predicate(self, query.rows(), condition, "__met")
        found = rows.agg(F.count(F.lit(1)).alias("matched"), F.count_if("__met").alias("met")).first()
        if found["matched"] == 0:
            raise RecordNotFound(f"no {query.model.name} matches")
        if found["matched"] != found["met"]:
            raise ConditionFailed(f"{found['matched'] - found['met']} rows of {query.model.name} don't meet the condition")

    def _row_query(self, model: Model, row: Any) -> tuple[Query, Expr | None]:
        get = row.get if isinstance(row, dict) else lambda k: row[k]
        query = self.all(model).filter(and_all([Path(model, (k,)).eq(get(k)) for k in model.key]))
        version = model.version_field
        return query, Path(model, (version.name,)).eq(get(version.name)) if version else None

    def update_row(self, model: Model | str, row: Any, **assignments: Any) -> Row:
        """One loaded row; of a versioned model only if it hasn't changed since it was loaded."""
        model = self.registry[model] if isinstance(model, str) else model
        query, version = self._row_query(model, row)
        self._guard(query, version if version is not None else and_all([]))
        return self._decoded(model, self.update(query, assignments))[0]

    def delete_row(self, model: Model | str, row: Any) -> None:
        model = self.registry[model] if isinstance(model, str) else model
        query, version = self._row_query(model, row)
        self._guard(query, version if version is not None else and_all([]))
        self.delete(query)

    def _delete_required_owners(self, query: Query, relation: BelongsTo) -> None:
        """Rows that require the ones being unlinked can't stay without them."""
        target = self.registry[relation.target]
        for r in target.relations:
            if isinstance(r, HasOne) and r.required and r.target == query.model.name and r.pair == relation.name:
                self.delete(query.related(relation.name))

    # Deletes.

    def delete(self, query: Query, condition: Expr | None = None) -> None:
        """Rows that belong to deleted ones are deleted as well if they must belong to one, else unlinked."""
        if isinstance(query.through, tuple) and isinstance(query.through[1], Via):
            raise InvalidStatement("longer paths are read-only")
        query = query.bound(self)
        if condition is not None:
            self._guard(query, condition)
        flagged = self._hits(query)
        gone = flagged.filter(HIT).drop(HIT)
        tables: dict[str, tuple[Model, DataFrame]] = {query.model.name: (query.model, flagged.filter(~F.col(HIT)).drop(HIT))}
        self._cascade(query.model, gone, tables, ())
        for model, df in tables.values():
            self._put(model, df)

    def _cascade(self, model: Model, gone: DataFrame, tables: dict, above: tuple[str, ...]) -> None:
        for child, pair, nullable in mutate.referring(model):
            mine, theirs = self.registry.link(child, pair)
            here = tables[child.name][1] if child.name in tables else self.table(child)
            names = [f"__g{i}" for i in range(len(theirs))]
            keys = gone.select(*[F.col(c).alias(n) for c, n in zip(theirs, names, strict=True)]).distinct()
            condition = None
            for c, n in zip(mine, names, strict=True):
                x = F.col(c) == F.col(n)
                condition = x if condition is None else condition & x
            if nullable:
                marked = here.join(keys.withColumn("__gone", F.lit(True)), condition, "left")
                is_gone = F.coalesce(F.col("__gone"), F.lit(False))
                columns = [F.when(is_gone, F.lit(None)).otherwise(F.col(c)).alias(c) if c in mine else F.col(c) for c in here.columns]
                tables[child.name] = (child, marked.select(*columns))
                continue
            deleted = here.join(keys, condition, "left_semi")
            tables[child.name] = (child, here.join(keys, condition, "left_anti"))
            if child.name == model.name or child.name in above:
                # A chain within one model ends when a level is empty.
                if deleted.isEmpty():
                    continue
            self._cascade(child, deleted, tables, (*above, model.name))

    # Links.

    def _many(self, query: Query) -> tuple[Query, HasMany | HasOne]:
        if not query.through:
            raise InvalidStatement("rows are linked through a relation")
        parent, relation = query.through
        if not isinstance(relation, HasMany | HasOne):
            raise InvalidStatement("longer paths are read-only" if isinstance(relation, Via) else "rows are linked from their parent")
        return parent, relation

    def link(self, query: Query, row: Any) -> DataFrame:
        """Makes an existing row belong to the parent of the query."""
        parent, relation = self._many(query.bound(self))
        target, _ = self._row_query(query.model, row)
        return self.update(target, self._link_values(parent.bound(self), relation))

    def unlink(self, query: Query, row: Any) -> None:
        """The row no longer belongs to the parent: its key becomes NULL, or it is deleted where that can't be. A row that
        belongs to another parent is left."""
        parent, relation = self._many(query.bound(self))
        values = self._link_values(parent.bound(self), relation)
        target, _ = self._row_query(query.model, row)
        target = target.filter(and_all([Path(query.model, (k,)).eq(v) for k, v in values.items()]))
        if all(query.model.field(k).nullable for k in values):
            self.update(target, dict.fromkeys(values))
        else:
            self.delete(target)

    # Upserts.

    def upsert(self, model: Model | str, rows: Sequence[dict[str, Any]] | DataFrame, on: Sequence[str], on_create: dict | None = None, on_update: dict | None = None, ignore: bool = False) -> DataFrame:
        """Inserts rows or, where a row has the same unique fields, updates it: with what is given, ``on_update`` over it.
        ``ignore`` leaves such rows. Result: the rows created or updated."""
        model = self.registry[model] if isinstance(model, str) else model
        if tuple(sorted(on)) not in [tuple(sorted(u)) for u in model.unique_sets()]:
            raise InvalidStatement(f"{', '.join(on)} is not a unique key of {model.name}")
        if isinstance(rows, DataFrame):
            names = [f.name for f in model.stored if getattr(f, "col", None) in rows.columns]
            have = set(rows.columns)
            frame = rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t, _ in model.columns()])
        else:
            names = list(dict.fromkeys(k for r in rows for k in r))
            given = on_create or {}
            plain = {k: v for k, v in given.items() if not isinstance(v, mutate.Change | mutate.Incoming)}
            frame = mutate.rows_frame(self.spark, model, [mutate.encode(model, {**plain, **r}) for r in rows])
        keys = model.columns_of(on)
        if not frame.groupBy(*keys).count().where("count > 1").isEmpty():
            raise InvalidStatement("an upsert has each key once")
        frame = mutate.with_increments(self.table(model), frame, model)
        out = mutate.upsert_frame(model, self.table(model), frame, on, on_create, on_update, ignore, names)
        self._put(model, out.drop("__outcome"))
        return out.filter(F.col("__outcome").isin("created", "updated")).drop("__outcome")

    # Transactions.

    @contextlib.contextmanager
    def transaction(self, read_only: bool = False, isolation: str | None = None) -> Iterator[Db]:
        """Changes within are kept together or, after an error, not at all. Inside another one it is a savepoint."""
        if isolation is not None and isolation not in ISOLATION:
            raise InvalidStatement(f"unknown isolation level {isolation!r}")
        if isolation == "read_uncommitted":
            raise UnsupportedFeature("snapshots have no uncommitted reads")
        self._layers.append({})
        before, self._read_only = self._read_only, self._read_only or read_only
        depth = len(self._layers)
        try:
            yield self
        except BaseException:
            del self._layers[depth - 1 :]
            raise
        finally:
            self._read_only = before
        if len(self._layers) >= depth:
            top = self._layers.pop()
            self._layers[-1].update(top)

    def rollback(self) -> None:
        """Drops what the current transaction has changed so far."""
        self._layers[-1].clear()

    def changes(self) -> dict[str, DataFrame]:
        """All tables that differ from the stored ones."""
        out: dict[str, DataFrame] = {}
        for layer in self._layers:
            out |= layer
        return out

    # Storing.

    def _files(self, path: str) -> list[tuple[str, int, int]]:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p))

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def watch(self, directory: str) -> None:
        """Remembers what is stored, so that a commit can tell whether another writer was there."""
        self._seen = {m.table: self._files(f"{directory}/{m.table}.parquet") for m in self.registry.models.values()}

    def _check_unchanged(self, directory: str) -> None:
        """Of any watched table, since new values may have been made from any."""
        for name, files in self._seen.items():
            if self._files(f"{directory}/{name}.parquet") != files:
                raise SerializationFailure(f"{name} has changed since it was read")

    def commit(self, directory: str) -> list[str]:
        """Writes all changed tables under ``directory`` beside the old ones, then swaps them in. Returns their names. If a
        swap fails, those before it are undone; the staging folder goes only when it holds no table that is in its place
        no more."""
        if len(self._layers) > 1:
            raise InvalidStatement("a transaction is open")
        changed = self.changes()
        stage = f"{directory}/.staging-{uuid.uuid4().hex}"
        fs, stage_path = self._fs(stage)
        try:
            # Before, as what another writer has swapped out can't be read, and after, as it may come meanwhile.
            self._check_unchanged(directory)
            for name, df in changed.items():
                df.write.parquet(f"{stage}/{name}.parquet")
            self._check_unchanged(directory)
        except BaseException:
            fs.delete(stage_path, True)
            raise
        places = {name: [self._fs(path)[1] for path in (f"{stage}/{name}.parquet", f"{directory}/{name}.parquet", f"{stage}/{name}.old")] for name in changed}
        moved: list[tuple[Any, Any]] = []
        try:
            for new, target, old in places.values():
                for a, b in ([(target, old)] if fs.exists(target) else []) + [(new, target)]:
                    self._move(fs, a, b)
                    moved.append((a, b))
        except BaseException as error:
            try:
                for a, b in reversed(moved):
                    self._move(fs, b, a)
            except Exception as second:
                raise SerializationFailure(f"tables are half swapped; what was stored is under {stage}") from second
            fs.delete(stage_path, True)
            raise error
        fs.delete(stage_path, True)
        for name in changed:
            self._base[name] = self.spark.read.parquet(f"{directory}/{name}.parquet")
        self._layers = [{}]
        return sorted(changed)

    def _move(self, fs, a, b) -> None:
        if not fs.rename(a, b):
            raise SerializationFailure(f"{a} can't be moved to {b}")


class _Frame:
    """A frame in a subquery's place."""

    def __init__(self, df: DataFrame):
        self._df = df

    def bound(self, db) -> _Frame:
        return self

    def frame(self) -> DataFrame:
        return self._df
