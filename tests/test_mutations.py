import pytest
from pyspark.sql import functions as F

from tessera.errors import ConditionFailed, InvalidStatement, ReadOnlyTransaction, RecordNotFound, SerializationFailure, UniqueViolation, UnsupportedFeature, ValidationFailed
from tessera.model import BelongsTo, Field, HasMany, HasOne, Index, Model, Registry, Via
from tessera.operators import mutate as m
from tessera.plans import batch as batches
from tessera.plans import migrations
from tessera.plans.schema_diff import diff, migrated, state, statements
from tessera.sources.connect import loader
from tessera.sources.db import Db


def registry():
    return Registry(
        Model("User", "users", (
            Field("id", "string", auto="uuid7"), Field("email", "string", unique=True, max_length=20), Field("role", "string", default="member", one_of=("member", "admin")),
            Field("n", "i64", default=0), Field("touched", "string", nullable=True, update=lambda: "now"),
            HasMany("todos", "Todo", "user"), HasMany("notes", "Note", "user"), HasOne("badge", "Badge", "user"), Via("tags", ("todos", "tags")),
        ), ("id",)),
        Model("Todo", "todos", (Field("id", "i64", auto="increment"), Field("user_id", "string"), Field("title", "string"), BelongsTo("user", "User", {"user_id": "id"}), HasMany("tags", "Tag", "todo")), ("id",)),
        Model("Tag", "tags", (Field("id", "i64", auto="increment"), Field("todo_id", "i64"), Field("label", "string"), BelongsTo("todo", "Todo", {"todo_id": "id"})), ("id",)),
        Model("Note", "notes", (Field("id", "i64"), Field("user_id", "string", nullable=True), BelongsTo("user", "User", {"user_id": "id"}, nullable=True)), ("id",)),
        Model("Badge", "badges", (Field("id", "i64"), Field("user_id", "string", nullable=True), BelongsTo("user", "User", {"user_id": "id"}, nullable=True)), ("id",)),
        Model("Item", "items", (Field("id", "i64"), Field("tenant", "string"), Field("slug", "string"), Field("name", "string"), Field("version", "u32", versioned=True)), ("id",), (Index(("tenant", "slug"), unique=True),)),
    )


@pytest.fixture()
def db(spark):
    out = Db(spark, registry(), tables={})
    out.reset()
    return out


def test_create(db):
    u = db.create("User", email="a@x", todos=[{"title": "one", "tags": [{"label": "l"}]}, {"title": "two"}], badge={"id": 5})
    assert len(u.id) == 36 and u.id[14] == "7" and u.role == "member" and u.n == 0 and u.touched == "now"
    loaded = db.all("User").include("todos.tags", "badge").one()
    assert sorted(t.title for t in loaded.todos) == ["one", "two"] and loaded.badge.id == 5
    assert db.all("Tag").count() == 1
    assert db.create("Todo", title="three", user={"email": "b@x"}).user_id == db.get_by("User", email="b@x").id
    assert db.create("Todo", title="four", user=u).user_id == u.id


def test_constraints(db):
    db.create("User", email="a@x")
    for bad in ({"email": "x" * 21}, {"email": None}, {}, {"email": "b@x", "role": "king"}):
        with pytest.raises(ValidationFailed):
            db.create("User", **bad)
    with pytest.raises(UniqueViolation):
        db.create("User", email="a@x")
    with pytest.raises(UniqueViolation):
        db.create_many("User", [{"email": "c@x"}, {"email": "c@x"}])
    with pytest.raises(InvalidStatement):
        db.create("User", email="q@x", shoe_size=3)
    f = db.registry["User"].f
    with pytest.raises(Exception, match="not valid"):
        db.filter("User", f.email.eq("a@x")).update(role="king").collect()
    assert db.all("User").count() == 1


def test_updates(db):
    db.create_many("User", [{"email": "a@x"}, {"email": "b@x", "n": 7}])
    f = db.registry["User"].f
    changed = db.filter("User", f.n.gt(5)).update(n=m.add(3)).collect()
    assert [r.n for r in changed] == [10]
    assert db.changed(db.filter("User", f.n.eq(999)), {"n": 1}) is False
    db.all("User").update(n=m.decrement())
    assert sorted(r.n for r in db.all("User").exec()) == [-1, 9]
    db.update_by("User", {"email": "a@x"}, n=f.n)
    with pytest.raises(Exception, match="(?i)overflow"):
        db.all("User").update(n=m.add(9223372036854775807)).collect()


def test_index_methods(db):
    db.create("User", email="a@x")
    assert db.get_by("User", email="a@x").email == "a@x"
    with pytest.raises(RecordNotFound):
        db.get_by("User", email="zzz")
    with pytest.raises(InvalidStatement):
        db.filter_by("User", n=3)
    db.delete_by("User", email="a@x")
    assert db.all("User").count() == 0


def test_cascade(db):
    a = db.create("User", email="a@x", todos=[{"title": "t", "tags": [{"label": "l"}]}], notes=[{"id": 1}])
    db.create("User", email="b@x", todos=[{"title": "u", "tags": [{"label": "k"}]}], notes=[{"id": 2}])
    db.delete_row("User", a)
    assert [t.title for t in db.all("Todo").exec()] == ["u"] and [t.label for t in db.all("Tag").exec()] == ["k"]
    notes = {n.id: n.user_id for n in db.all("Note").exec()}
    assert notes[1] is None and notes[2] is not None


def test_self_reference(spark):
    reg = Registry(Model("Node", "nodes", (Field("id", "i64"), Field("up_id", "i64"), BelongsTo("up", "Node", {"up_id": "id"}), HasMany("down", "Node", "up")), ("id",)))
    db = Db(spark, reg, tables={"nodes": spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (9, 8)], "id long, up_id long")})
    db.filter("Node", reg["Node"].f.id.eq(1)).delete()
    assert [n.id for n in db.all("Node").exec()] == [9]


def test_links(db):
    a, b = db.create_many("User", [{"email": "a@x"}, {"email": "b@x"}])
    db.create_many("Note", [{"id": 1}, {"id": 2}])
    f = db.registry["User"].f
    mine = lambda u: db.filter("User", f.id.eq(u.id)).related("notes")
    mine(a).insert({"id": 1})
    assert [n.id for n in mine(a).exec()] == [1]
    mine(b).remove({"id": 1})  # another's
    assert [n.id for n in mine(a).exec()] == [1]
    mine(a).remove({"id": 1})
    assert mine(a).count() == 0 and db.all("Note").count() == 2
    assert mine(a).create(id=7).user_id == a.id
    todos = db.filter("User", f.id.eq(a.id)).related("todos")
    t = todos.create(title="x")
    todos.remove(t)
    assert db.all("Todo").count() == 0
    tags = db.all("User").related("tags")
    for act in (lambda: tags.insert({"id": 1}), lambda: tags.create(label="x"), lambda: tags.update(label="y"), lambda: tags.delete()):
        with pytest.raises(InvalidStatement):
            act()
    db.update(db.filter("Note", db.registry["Note"].f.id.eq(7)), {"user": None})
    assert db.get_by("Note", id=7).user_id is None


def test_scoped_create(db):
    f = db.registry["User"].f
    assert db.filter("User", f.role.eq("admin")).create(email="c@x").role == "admin"


def test_required_owner_goes(spark):
    reg = Registry(
        Model("User", "users", (Field("id", "i64"), HasOne("profile", "Profile", "user", required=True)), ("id",)),
        Model("Profile", "profiles", (Field("id", "i64"), Field("user_id", "i64", nullable=True), BelongsTo("user", "User", {"user_id": "id"}, nullable=True)), ("id",)),
    )
    db = Db(spark, reg, tables={"users": spark.createDataFrame([(1,), (2,)], "id long"), "profiles": spark.createDataFrame([(1, 1), (2, 2)], "id long, user_id long")})
    db.update(db.filter("Profile", reg["Profile"].f.id.eq(1)), {"user": None})
    assert [u.id for u in db.all("User").exec()] == [2] and db.get_by("Profile", id=1).user_id is None
    with pytest.raises(InvalidStatement):
        db.create("User", id=3)


def test_upserts(db):
    row = {"id": 1, "tenant": "t", "slug": "s", "name": "one"}
    assert [r.version for r in db.upsert("Item", [row], ["tenant", "slug"]).collect()] == [1]
    got = db.upsert("Item", [{**row, "id": 99, "name": "two"}], ["tenant", "slug"]).collect()
    assert [(r.id, r.name, r.version) for r in got] == [(1, "two", 2)]
    assert db.upsert("Item", [{**row, "name": "three"}], ["tenant", "slug"], ignore=True).collect() == []
    assert db.all("Item").one().name == "two"
    got = db.upsert("Item", [{**row, "name": "new"}], ["tenant", "slug"], on_update={"name": "updated"}, on_create={"name": "created"}).collect()
    assert got[0].name == "updated"
    got = db.upsert("Item", [{"id": 2, "tenant": "t", "slug": "r", "name": "x"}], ["tenant", "slug"], on_create={"name": "created"}).collect()
    assert got[0].name == "created" and got[0].version == 1
    with pytest.raises(InvalidStatement):
        db.upsert("Item", [row], ["name"])
    with pytest.raises(InvalidStatement):
        db.upsert("Item", [row, row], ["tenant", "slug"])


def test_upsert_to_null_and_unmatched_null_keys(spark):
    reg = Registry(Model("E", "e", (Field("id", "i64"), Field("k", "i64", nullable=True, unique=True), Field("v", "string", nullable=True)), ("id",)))
    db = Db(spark, reg, tables={"e": spark.createDataFrame([(1, 5, "x"), (2, None, "y")], "id long, k long, v string")})
    db.upsert("E", [{"id": 1, "k": 5, "v": None}, {"id": 3, "k": None, "v": "z"}], ["k"])
    assert sorted((r.id, r.k, r.v) for r in db.all("E").exec()) == [(1, 5, None), (2, None, "y"), (3, None, "z")]


def test_versions(db):
    db.create("Item", id=1, tenant="t", slug="s", name="a")
    stale = db.all("Item").one()
    fresh = db.update_row("Item", stale, name="b")
    assert fresh.version == 2
    with pytest.raises(ConditionFailed):
        db.update_row("Item", stale, name="c")
    with pytest.raises(ConditionFailed):
        db.delete_row("Item", stale)
    db.all("Item").update(name="q")
    assert db.all("Item").one().version == 3
    db.delete_row("Item", db.all("Item").one())
    with pytest.raises(RecordNotFound):
        db.update_row("Item", fresh, name="c")


def test_conditions(db):
    db.create_many("User", [{"email": "a@x", "n": 1}, {"email": "b@x", "n": 2}])
    f = db.registry["User"].f
    with pytest.raises(ConditionFailed):
        db.update(db.all("User"), {"n": 0}, condition=f.n.gt(1))
    with pytest.raises(RecordNotFound):
        db.update(db.filter("User", f.n.gt(100)), {"n": 0}, condition=f.n.gt(1))
    db.update(db.all("User"), {"n": 0}, condition=f.n.gt(0))
    assert {r.n for r in db.all("User").exec()} == {0}


def test_transactions(db):
    db.create("User", email="a@x")
    with pytest.raises(RuntimeError), db.transaction():
        db.create("User", email="b@x")
        raise RuntimeError
    assert db.all("User").count() == 1
    with db.transaction():
        db.create("User", email="c@x")
        with pytest.raises(RuntimeError), db.transaction():
            db.create("User", email="d@x")
            raise RuntimeError
        with db.transaction():
            db.create("User", email="e@x")
    assert sorted(r.email for r in db.all("User").exec()) == ["a@x", "c@x", "e@x"]
    with pytest.raises(ReadOnlyTransaction), db.transaction(read_only=True):
        db.create("User", email="f@x")
    with pytest.raises(InvalidStatement), db.transaction(isolation="odd"):
        pass
    with pytest.raises(UnsupportedFeature), db.transaction(isolation="read_uncommitted"):
        pass


def test_batch_is_all_or_nothing(db):
    with pytest.raises(UniqueViolation):
        batches.batch(db, [lambda: db.create("User", email="a@x"), lambda: db.create("User", email="a@x")])
    assert db.all("User").count() == 0
    out = batches.batch(db, [lambda: db.create("User", email="a@x"), db.all("User")])
    assert out[1][0].email == "a@x"


def test_commit(spark, tmp_path):
    d = str(tmp_path / "store")
    reg = registry()
    db = Db(spark, reg, tables={})
    db.reset()
    db.create("User", email="a@x")
    assert "users" in db.commit(d)
    again = Db(spark, registry(), d)
    assert again.all("User").one().email == "a@x"
    again.watch(d)
    again.all("User").update(n=5)
    other = Db(spark, registry(), d)
    other.all("User").update(n=6)
    other.commit(d)
    with pytest.raises(SerializationFailure):
        again.commit(d)
    assert Db(spark, registry(), d).all("User").one().n == 6
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith(".staging")]


def test_failed_commit_leaves_what_was(spark, tmp_path):
    d = str(tmp_path / "store")
    db = Db(spark, registry(), tables={})
    db.reset()
    db.create("User", email="a@x")
    db.commit(d)
    db._layers[-1]["users"] = db.table("User").withColumn("n", F.raise_error(F.lit("no")).cast("long"))
    db._layers[-1]["items"] = db.table("Item")
    with pytest.raises(Exception, match="no"):
        db.commit(d)
    assert Db(spark, registry(), d).all("User").count() == 1


@pytest.mark.parametrize("fails", range(1, 5))
def test_failed_swap_is_undone(spark, tmp_path, monkeypatch, fails):
    """Whichever rename fails, both tables are as before."""
    d = str(tmp_path / "store")
    db = Db(spark, registry(), tables={})
    db.push_schema()
    db.create("User", email="a@x")
    db.commit(d)
    db.all("User").update(n=7)
    db._layers[-1]["items"] = db.table("Item")
    calls, move = [], Db._move

    def failing(self, fs, a, b):
        calls.append(a)
        if len(calls) == fails:
            raise SerializationFailure("no")
        move(self, fs, a, b)

    monkeypatch.setattr(Db, "_move", failing)
    with pytest.raises(SerializationFailure, match="no"):
        db.commit(d)
    again = Db(spark, registry(), d)
    assert again.all("User").one().n == 0 and again.all("Item").count() == 0
    assert not [p for p in (tmp_path / "store").iterdir() if p.name.startswith(".staging")]


def test_unreadable_table_is_not_replaced(spark, tmp_path):
    d = tmp_path / "store"
    (d / "users.parquet").mkdir(parents=True)
    (d / "users.parquet" / "part-0.parquet").write_bytes(b"no parquet at all")
    db = Db(spark, registry(), str(d))
    db.push_schema()
    assert "users" not in db.changes() and "items" in db.changes()
    with pytest.raises(Exception, match="(?i)parquet|schema"):
        db.sql("SELECT 1")
    assert (d / "users.parquet" / "part-0.parquet").read_bytes() == b"no parquet at all"


def test_frames_are_held_to_the_model(db, spark):
    frame = spark.createDataFrame([("a@x", 3), ("b@x", 4)], "email string, n long")
    db.insert_frame("User", frame)
    rows = db.all("User").rows().collect()
    assert {r.role for r in rows} == {"member"} and {r.touched for r in rows} == {"now"} and len({r.id for r in rows}) == 2 and all(len(r.id) == 36 and r.id[14] == "7" for r in rows)
    db.insert_frame("Item", spark.createDataFrame([(1, "t", "s", "n")], "id long, tenant string, slug string, name string"))
    assert db.all("Item").one().version == 1
    for bad in ([(None, 1)], [("x" * 21, 1)]):
        with pytest.raises(Exception, match="not valid"):
            db.insert_frame("User", spark.createDataFrame(bad, "email string, n long")).collect()


def test_increments_over_partitions(spark):
    reg = Registry(Model("A", "a", (Field("id", "i32", auto="increment"), Field("x", "i64")), ("id",)))
    db = Db(spark, reg, tables={})
    db.reset()
    db.create("A", x=1)
    table = db.insert_frame("A", spark.range(0, 100, 1, 5).withColumnRenamed("id", "x"))
    first = {r.x: r.id for r in table.collect()}
    assert sorted(r.id for r in table.collect()) == list(range(1, 102)) and first == {r.x: r.id for r in db.all("A").rows().collect()}


def test_nested_create_is_all_or_nothing(db):
    with pytest.raises(ValidationFailed):
        db.create("User", email="a@x", todos=[{"title": "fine"}, {"title": None}])
    assert db.all("User").count() == 0 and db.all("Todo").count() == 0


def test_batch_keeps_the_order(db):
    before, _, after = batches.batch(db, [db.all("User"), lambda: db.create("User", email="a@x"), db.all("User")])
    assert len(before) == 0 and len(after) == 1


def test_migrations_of_a_directory(spark, tmp_path):
    folder, d = str(tmp_path / "steps"), str(tmp_path / "store")
    one = Registry(Model("A", "a", (Field("id", "i64"), Field("x", "i32")), ("id",)))
    migrations.generate(one, folder, "start")
    db = Db(spark, one, d)
    assert migrations.apply(db, folder) == ["0001_start"]
    db.create("A", id=1, x=5)
    db.commit(d)
    two = Registry(Model("A", "a", (Field("id", "i64"), Field("x", "i32"), Field("w", "bool", nullable=True)), ("id",)))
    migrations.generate(two, folder, "wider")
    later = Db(spark, two, d)
    assert migrations.apply(later, folder) == ["0002_wider"]
    later.commit(d)
    last = Db(spark, two, d)
    assert migrations.apply(last, folder) == [] and tuple(last.all("A").one()) == (1, 5, None)


def test_schema_check_and_push(spark):
    db = Db(spark, registry(), tables={"users": spark.createDataFrame([(1,)], "id long")})
    with pytest.raises(InvalidStatement):
        db.check_schema(db.registry["User"])
    db = Db(spark, registry(), tables={})
    db.push_schema()
    db.check_schema(db.registry["Item"])
    assert db.all("Item").count() == 0


def test_connections(spark, sf_dir):
    assert loader(spark, f"parquet:{sf_dir}")("region").count() == 5
    for url in ("postgresql://h/db", "mysql://h/db", "sqlite:///x", "turso://x", "dynamodb://x", "odd://x"):
        with pytest.raises(UnsupportedFeature):
            loader(spark, url)


def test_schema_diff(spark):
    old = Registry(Model("A", "a", (Field("id", "i64"), Field("x", "i32"), Field("y", "string")), ("id",), (Index(("x",)),)), Model("B", "b", (Field("id", "i64"),), ("id",)))
    new = Registry(Model("A", "a2", (Field("id", "i64"), Field("z", "i64"), Field("w", "bool", nullable=True)), ("id",), (Index(("z",), unique=True),)), Model("C", "c", (Field("id", "i64"),), ("id",)))
    d = diff(state(old), state(new), {"a": "a2"}, {("a2", "x"): "z"})
    assert d.renamed == [("a", "a2")] and d.created == ["c"] and d.dropped == ["b"]
    assert d.columns_renamed == [("a2", "x", "z")] and d.altered == [("a2", "z", "int", "bigint")] and d.added == [("a2", "w", "boolean")] and d.removed == [("a2", "y")]
    assert d.indices_added and d.indices_removed
    text = statements(d, state(new))
    assert "ALTER TABLE a RENAME TO a2" in text and "DROP TABLE b" in text
    df = migrated(spark.createDataFrame([(1, 2, "q")], "id long, x int, y string"), d, "a2")
    assert df.dtypes == [("id", "bigint"), ("z", "bigint"), ("w", "boolean")]
    assert diff(state(old), state(old)).empty


def test_raw_sql(db):
    db.create("User", email="a@x", n=4)
    assert db.sql("SELECT n FROM users WHERE n > ?", [3]).collect()[0].n == 4
    assert db.sql("SELECT n FROM users WHERE n > :n", {"n": 3}, {"n": "string"}).dtypes == [("n", "string")]
    assert db.statement("SELECT 1 AS x")[0].x == 1


def test_migrations(spark, tmp_path):
    folder = str(tmp_path / "steps")
    one = Registry(Model("A", "a", (Field("id", "i64"), Field("x", "i32")), ("id",)))
    assert migrations.generate(one, folder, "start") == "0001_start" and migrations.generate(one, folder, "again") is None
    db = Db(spark, one, tables={})
    assert migrations.apply(db, folder) == ["0001_start"]
    db.create("A", id=1, x=5)
    two = Registry(Model("A", "a", (Field("id", "i64"), Field("z", "i64"), Field("w", "bool", nullable=True)), ("id",)), Model("B", "b", (Field("id", "i64"),), ("id",)))
    assert migrations.generate(two, folder, "wider", columns={("a", "x"): "z"}) == "0002_wider"
    assert "ALTER TABLE a RENAME COLUMN x TO z" in migrations.plan(folder)[1][2]
    later = Db(spark, two, tables=db.changes())
    assert migrations.apply(later, folder) == ["0002_wider"] and migrations.apply(later, folder) == []
    assert tuple(later.all("A").one()) == (1, 5, None) and later.all("B").count() == 0
    other = Db(spark, one, tables={migrations.HISTORY: spark.createDataFrame([("0001_else",)], "id string")})
    with pytest.raises(InvalidStatement):
        migrations.apply(other, folder)
