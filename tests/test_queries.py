"""Semantics on small frames: NULLs, relations, includes, pages, embedded values."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidStatement, RecordNotFound
from tessera.expr import And, Or, computed
from tessera.model import BelongsTo, Document, Embedded, EmbedEnum, EmbedStruct, Field, HasMany, HasOne, Model, Registry, Variant, Via
from tessera.operators.includes import include
from tessera.operators.paginate import beyond, tie_broken
from tessera.plans import batch as batches
from tessera.plans import dsl
from tessera.sources.db import Db


@pytest.fixture(scope="module")
def db(spark):
    registry = Registry(
        Model("User", "users", (
            Field("id", "i64"), Field("name", "string", index=True), Field("age", "i64", nullable=True),
            HasMany("todos", "Todo", "user"), HasOne("profile", "Profile", "user"), Via("tags", ("todos", "tags")), Via("labels", ("tags", "label")), Via("bio", ("profile", "bio"), one=True),
        ), ("id",)),
        Model("Todo", "todos", (
            Field("id", "i64"), Field("user_id", "i64", nullable=True, index=True), Field("title", "string"), Field("done", "bool", nullable=True),
            BelongsTo("user", "User", {"user_id": "id"}, nullable=True), HasMany("tags", "Tag", "todo"),
        ), ("id",)),
        Model("Tag", "tags", (Field("id", "i64"), Field("todo_id", "i64"), Field("label", "string"), BelongsTo("todo", "Todo", {"todo_id": "id"})), ("id",)),
        Model("Profile", "profiles", (Field("id", "i64"), Field("user_id", "i64", nullable=True, unique=True), Field("bio", "string"), BelongsTo("user", "User", {"user_id": "id"}, nullable=True)), ("id",)),
    )
    return Db(spark, registry, tables={
        "users": spark.createDataFrame([(1, "Ann", 30), (2, "Bob", None), (3, "Cy", 20), (4, "Di", 30)], "id long, name string, age long"),
        "todos": spark.createDataFrame([(1, 1, "a", True), (2, 1, "b", False), (3, 2, "c", None), (4, None, "d", True), (5, 4, "e", True)], "id long, user_id long, title string, done boolean"),
        "tags": spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "x"), (4, 3, "z")], "id long, todo_id long, label string"),
        "profiles": spark.createDataFrame([(1, 1, "hi"), (2, None, "lost")], "id long, user_id long, bio string"),
    })


def ids(query):
    return sorted(r.id for r in query.exec())


@pytest.fixture(scope="module")
def paths(db):
    return type("P", (), {n: db.registry[n].f for n in db.registry.models})


def test_nulls(db, paths):
    u = paths.User
    assert ids(db.filter("User", u.age.eq(None))) == [2]
    assert ids(db.filter("User", u.age.ne(None))) == [1, 3, 4]
    assert ids(db.filter("User", u.age.ne(30))) == [3]
    assert ids(db.filter("User", u.age.in_list([30, None]))) == [1, 4]
    assert ids(db.filter("User", ~u.age.in_list([30, None]))) == []
    assert ids(db.filter("User", u.age.in_list([]))) == []
    assert ids(db.filter("User", ~u.age.in_list([]))) == [1, 2, 3, 4]


def test_long_lists(db, paths):
    u = paths.User
    assert ids(db.filter("User", u.id.in_list(range(2, 1000)))) == [2, 3, 4]
    assert ids(db.filter("User", ~u.id.in_list(range(2, 1000)))) == [1]
    assert ids(db.filter("User", u.id.in_list(range(3, 1000)) | u.name.eq("Ann"))) == [1, 3, 4]


def test_boolean_composition(db, paths):
    u = paths.User
    assert ids(db.filter("User", And((u.age.gt(10), Or((u.name.eq("Ann"), u.name.eq("Cy"), u.id.eq(4))))))) == [1, 3, 4]
    assert ids(db.filter("User", ~(u.age.gt(25)))) == [3]
    with pytest.raises(InvalidStatement):
        bool(u.age.eq(1))


def test_relation_predicates(db, paths):
    u, t = paths.User, paths.Todo
    assert ids(db.filter("User", u["todos"].any(t.done.eq(True)))) == [1, 4]
    assert ids(db.filter("User", ~u["todos"].any(t.done.eq(True)))) == [2, 3]
    # A NULL doesn't fail; no rows at all are fine.
    assert ids(db.filter("User", u["todos"].all(t.done.eq(True)))) == [2, 3, 4]
    assert ids(db.filter("User", ~u["todos"].all(t.done.eq(True)))) == [1]
    assert ids(db.filter("User", u["todos"].any())) == [1, 2, 4]
    assert ids(db.filter("User", u["todos"].is_none())) == [3]
    assert ids(db.filter("User", u["profile"].is_some())) == [1]
    assert ids(db.filter("User", u["todos"].any(t.done.eq(True)) | u.name.eq("Cy"))) == [1, 3, 4]
    assert ids(db.filter("User", ~(u["todos"].any(t.done.eq(True)) & u.age.eq(30)))) == [2, 3]


def test_paths_through_nullable_links(db, paths):
    t = paths.Todo
    assert ids(db.filter("Todo", t.user.name.eq("Ann"))) == [1, 2]
    assert ids(db.filter("Todo", t.user.name.ne("Ann"))) == [3, 5]
    assert ids(db.filter("Todo", ~t.user.name.eq("Ann"))) == [3, 4, 5]
    assert ids(db.filter("Todo", t.user.id.eq(2))) == [3]
    assert ids(db.filter("Todo", t["user"].eq({"id": 1}))) == [1, 2]
    assert ids(db.filter("Todo", t["user"].ne({"id": 1}))) == [3, 5]
    assert ids(db.filter("Todo", t["user"].is_none())) == [4]


def test_via(db, paths):
    u, g = paths.User, paths.Tag
    assert ids(db.filter("User", u["tags"].any(g.label.eq("z")))) == [2]
    assert ids(db.all("User").filter(u.id.eq(1)).related("tags")) == [1, 2, 3]
    assert sorted(r.label for r in db.all("User").related("labels").exec()) == ["x", "y", "z"]
    row = db.all("User").filter(u.id.eq(1)).include("labels", "bio").one()
    assert row.labels == ["x", "y"] and row.bio == "hi"
    assert db.all("User").filter(u.id.eq(3)).include("labels").one().labels == []


def test_includes(db, paths):
    t = paths.Todo
    rows = {r.id: r for r in db.all("User").include("todos.tags", "profile").exec()}
    assert [x.title for x in rows[1].todos] == ["a", "b"] and [x.label for x in rows[1].todos[0].tags] == ["x", "y"]
    assert rows[3].todos == [] and rows[2].profile is None and rows[1].profile.bio == "hi"
    # An include's filter doesn't filter parents; repeated ones are ORed, a bare one lifts them, the last order counts.
    titles = lambda *inc: {r.id: [x.title for x in r.todos] for r in db.all("User").include(*inc).exec()}
    a, b = include("todos").filter(t.title.eq("a")), include("todos").filter(t.title.eq("b"))
    assert titles(a) == {1: ["a"], 2: [], 3: [], 4: []}
    assert titles(a, b)[1] == ["a", "b"]
    assert titles(a, "todos")[1] == ["a", "b"]
    assert titles(include("todos").order_by(t.title.desc()))[1] == ["b", "a"]
    assert titles(include("todos").order_by(t.title.desc()), "todos")[1] == ["a", "b"]
    assert [r.user and r.user.name for r in db.all("Todo").include("user").order_by("id").exec()] == ["Ann", "Ann", "Bob", None, "Di"]


def test_include_checks(db, paths):
    with pytest.raises(InvalidStatement):
        db.all("Todo").include(include("user").order_by(paths.User.name.asc())).frame()
    with pytest.raises(InvalidStatement):
        db.all("Tag").include(include("todo").filter(paths.Todo.id.eq(1))).frame()
    with pytest.raises(Exception, match="no 'nothing'"):
        db.all("User").include("nothing")


def test_single_include_with_several_rows(spark, db):
    other = Db(spark, db.registry, tables=dict(db._base) | {"profiles": spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, user_id long, bio string")})
    with pytest.raises(Exception, match="several rows"):
        other.all("User").include("profile").exec()


def test_order_and_limits(db, paths):
    u = paths.User
    assert [r.id for r in db.all("User").order_by(u.age, u.id.desc()).exec()] == [2, 3, 4, 1]
    assert [r.id for r in db.all("User").order_by(u.age.desc(), u.id).exec()] == [1, 4, 3, 2]
    assert [r.id for r in db.all("User").order_by("id").limit(2).offset(1).exec()] == [2, 3]
    assert db.all("User").latest_by("age").order_by("id").first().id == 1
    assert db.filter("User", u.id.eq(9)).first() is None
    with pytest.raises(RecordNotFound):
        db.filter("User", u.id.eq(9)).one()
    for bad in (lambda: db.all("User").offset(1), lambda: db.all("User").limit(-1), lambda: db.all("User").limit("x"), lambda: db.all("User").limit(1).paginate(2), lambda: db.all("User").paginate(2)):
        with pytest.raises(InvalidStatement):
            bad()


def test_pages_forward_and_back(db, paths):
    page = db.all("User").order_by(paths.User.age.asc()).paginate(2).exec()
    assert [r.id for r in page.rows] == [2, 3] and page.has_next and not page.has_prev
    page = page.next()
    assert [r.id for r in page.rows] == [1, 4] and page.has_prev
    assert page.next().rows == []
    back = page.prev()
    assert [r.id for r in back.rows] == [2, 3] and back.has_next
    page = db.all("User").order_by(paths.User.age.desc()).paginate(3).exec()
    assert [r.id for r in page.rows] == [4, 1, 3]
    assert [r.id for r in page.next().rows] == [2]


def test_cursor_checks(db, paths):
    order = [paths.User.id.asc()]
    for bad in ((), (1, 2)):
        with pytest.raises(InvalidStatement):
            beyond(order, bad)
    assert tie_broken(db.registry["User"], order) == order
    assert len(tie_broken(db.registry["User"], [paths.User.name.desc()])) == 2
    # A nullable unique field leaves ties.
    assert len(tie_broken(db.registry["Profile"], [paths.Profile.user_id.asc()])) == 2


def test_language(db, paths):
    assert ids(dsl.query(db, 'User FILTER .age >= 20 AND NOT (.name == "Ann" OR .id == #x)', x=4)) == [3]
    assert ids(dsl.query(db, "Todo filter .user.name == #n", n="Ann")) == [1, 2]
    assert ids(dsl.query(db, "User filter .id in #l or .age < 25", l=[1])) == [1, 3]
    assert ids(dsl.query(db, "Todo filter .done")) == [1, 4, 5]
    assert [r.id for r in dsl.query(db, "User ORDER BY .id DESC OFFSET 1 LIMIT 2").exec()] == [3, 2]
    for bad in ("User FILTER", "User FILTER .age >", "User FILTER .age IN 3", "User ORDER .age", "User LIMIT 1 2", "User FILTER (.age == 1", "FILTER .x == 1", "User LIMIT #n", "User OFFSET 2", "User FILTER 1 == 1", "User FILTER .age ? 1"):
        with pytest.raises(Exception):  # noqa: B017
            dsl.query(db, bad)


def test_batch(db, paths):
    users, n = batches.batch(db, [db.all("User").order_by("id"), db.all("Todo").count_frame()])
    assert [u.id for u in users] == [1, 2, 3, 4] and n[0]["count"] == 5


def test_set_operations(db, paths):
    a, b = db.filter("User", paths.User.id.le(3)).select("id"), db.filter("User", paths.User.id.ge(3)).select("id")
    assert a.union(b).count() == 4 and a.union(b, all=True).count() == 5
    assert [r.id for r in a.intersect(b).collect()] == [3] and sorted(r.id for r in a.except_(b).collect()) == [1, 2]


def test_computed_and_columns(db, paths):
    assert ids(db.filter("User", paths.User.age.gt(computed(lambda: F.col("id") * 8)))) == [1]
    assert ids(db.filter("User", computed(lambda: F.length("name")).eq(2))) == [3, 4]


@pytest.fixture(scope="module")
def shapes(spark):
    address = EmbedStruct("Address", (Field("street", "string"), Field("city", "string", nullable=True)))
    contact = EmbedEnum("Contact", (Variant("Email", 1, (Field("address", "string"),)), Variant("Phone", 2, (Field("number", "string"),)), Variant("None", 3)))
    creature = EmbedEnum("Creature", (Variant("Human", "h", (Field("name", "string"), Field("job", "string"))), Variant("Animal", "a", (Field("name", "string"), Field("species", "string")))))
    meta = EmbedStruct("Meta", (Field("author", "string"), Field("stars", "i64", nullable=True), Embedded("place", address)))
    registry = Registry(
        Model("Thing", "things", (
            Field("id", "i64"), Embedded("home", address), Embedded("work", address, nullable=True), Embedded("contact", contact), Embedded("creature", creature, nullable=True),
            Document("meta", meta, nullable=True), Field("tags", "list<string>"),
        ), ("id",)),
    )
    db = Db(spark, registry, tables={"things": spark.createDataFrame([], registry["Thing"].schema())})
    db.create_many("Thing", [
        {"id": 1, "home": {"street": "A", "city": "X"}, "work": None, "contact": {"variant": "Email", "address": "a@b"}, "creature": {"variant": "Human", "name": "N", "job": "J"}, "meta": {"author": "Q", "stars": 5, "place": {"street": "S", "city": "T"}}, "tags": ["p", "q"]},
        {"id": 2, "home": {"street": "B", "city": None}, "work": {"street": "W", "city": "Y"}, "contact": {"variant": "Phone", "number": "12"}, "creature": {"variant": "Animal", "name": "N", "species": "cat"}, "meta": None, "tags": []},
        {"id": 3, "home": {"street": "A", "city": "Z"}, "work": None, "contact": "None", "creature": None, "meta": {"author": "R", "stars": None, "place": {"street": "S2", "city": None}}, "tags": ["q", "q", "r"]},
    ])
    return db


def test_embedded(shapes):
    f = shapes.registry["Thing"].f
    found = lambda e: ids(shapes.filter("Thing", e))
    assert found(f.home.street.eq("A")) == [1, 3]
    assert found(f["home"].eq({"street": "A", "city": "X"})) == [1]
    assert found(f["home"].in_list([{"street": "A", "city": "X"}, {"street": "B", "city": None}])) == [1, 2]
    assert found(f["work"].is_none()) == [1, 3]
    assert found(f.work.city.eq("Y")) == [2]
    assert found(f.contact.is_variant("Phone")) == [2]
    assert found(f.contact.matches("Email", lambda c: c.address.like("%@b"))) == [1]
    assert found(f["contact"].eq("None")) == [3]
    assert found(f["contact"].in_list(["None", {"variant": "Email", "address": "a@b"}])) == [1, 3]
    assert found(f.creature.matches("Human", lambda c: c.name.eq("N"))) == [1]
    assert found(f["creature"].is_none()) == [3]
    assert found(f.meta.stars.gt(4)) == [1]
    assert found(f.meta.place.city.eq("T")) == [1]
    assert found(f.meta.author.in_list(["R", "Z"])) == [3]
    assert found(f.tags.contains("q")) == [1, 3]
    assert found(f.tags.is_superset(["q", "p"])) == [1] and found(f.tags.is_superset([])) == [1, 2, 3]
    assert found(f.tags.intersects(["r", "p"])) == [1, 3] and found(f.tags.intersects([])) == []
    assert found(f.tags.len().eq(3)) == [3] and found(f.tags.is_empty()) == [2]


def test_embedded_projection(shapes):
    rows = {r.id: r for r in shapes.all("Thing").exec()}
    assert rows[1].home.city == "X" and rows[1].work is None and rows[2].work.street == "W"
    assert rows[1].contact.variant == "Email" and rows[1].contact.address == "a@b" and rows[3].contact.variant == "None"
    assert rows[2].creature.species == "cat" and rows[3].creature is None
    assert rows[1].meta.place.city == "T" and rows[2].meta is None
    assert [r.home_street for r in shapes.all("Thing").order_by("id").select(shapes.registry["Thing"].f.home.street).exec()] == ["A", "B", "A"]


def test_embedded_updates(shapes):
    from tessera.operators import mutate as m

    with shapes.transaction():
        f = shapes.registry["Thing"].f
        one = shapes.filter("Thing", f.id.eq(1))
        shapes.update(one, {"home": m.patch(city="NEW"), "meta": m.patch(stars=9), "contact": "None", "tags": m.apply([m.push("z"), m.remove("p")])})
        row = one.one()
        assert row.home.city == "NEW" and row.home.street == "A" and row.meta.stars == 9 and row.meta.author == "Q"
        assert row.contact.variant == "None" and row.contact.address is None and row.tags == ["q", "z"]
        shapes.update(one, {"tags": m.pop()})
        assert one.one().tags == ["q"]
        shapes.update(one, {"tags": m.extend(["a", "b"])})
        shapes.update(one, {"tags": m.remove_at(0)})
        assert one.one().tags == ["a", "b"]
        shapes.update(one, {"tags": m.clear(), "work": {"street": "V", "city": None}})
        assert one.one().tags == [] and one.one().work.street == "V"
        shapes.rollback()


def test_eager_relations(spark):
    reg = Registry(
        Model("A", "a", (Field("id", "i64"), HasMany("bs", "B", "a", eager=True), Via("names", ("bs", "name"), eager=True)), ("id",)),
        Model("B", "b", (Field("id", "i64"), Field("a_id", "i64"), Field("name", "string"), BelongsTo("a", "A", {"a_id": "id"})), ("id",)),
    )
    db = Db(spark, reg, tables={"a": spark.createDataFrame([(1,), (2,)], "id long"), "b": spark.createDataFrame([(1, 1, "x"), (2, 1, "y")], "id long, a_id long, name string")})
    rows = {r.id: r for r in db.all("A").exec()}
    assert [b.name for b in rows[1].bs] == ["x", "y"] and rows[1].names == ["x", "y"] and rows[2].bs == [] and rows[2].names == []
    assert db.all("A").order_by("id").select("id").frame().columns == ["id"]


def test_observation_streams_and_locks(db, caplog):
    import logging

    noisy = Db(db.spark, db.registry, tables=dict(db._base), slow_seconds=0)
    with caplog.at_level(logging.WARNING, "tessera"):
        noisy.all("User").exec()
    assert "slow query on User: 4 rows" in caplog.text
    assert sorted(r.id for r in db.all("User").lock().stream()) == [1, 2, 3, 4]
    with pytest.raises(InvalidStatement):
        db.all("User").lock("odd")


def test_composite_keys(spark):
    reg = Registry(
        Model("Order", "o", (Field("shop", "string"), Field("no", "i64"), HasMany("lines", "Line", "order")), ("shop", "no")),
        Model("Line", "l", (Field("id", "i64"), Field("shop", "string"), Field("no", "i64"), Field("q", "i64"), BelongsTo("order", "Order", {"shop": "shop", "no": "no"})), ("id",)),
    )
    db = Db(spark, reg, tables={"o": spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "shop string, no long"), "l": spark.createDataFrame([(1, "a", 1, 5), (2, "a", 1, 6), (3, "b", 1, 7)], "id long, shop string, no long, q long")})
    o, line = reg["Order"].f, reg["Line"].f
    keys = lambda q: sorted((r.shop, r.no) for r in q.exec())
    assert keys(db.filter("Order", o["lines"].any(line.q.gt(5)))) == [("a", 1), ("b", 1)]
    assert keys(db.filter("Order", o["lines"].all(line.q.gt(5)))) == [("a", 2), ("b", 1)]
    assert [len(r.lines) for r in db.all("Order").order_by("shop", "no").include("lines").exec()] == [2, 0, 1]
    assert ids(db.filter("Line", line["order"].eq({"shop": "a", "no": 1}))) == [1, 2]
    assert ids(db.filter("Line", line["order"].in_list([{"shop": "b", "no": 1}, {"shop": "a", "no": 9}]))) == [3]
    assert keys(db.get_by_keys("Order", [("a", 2), ("z", 1)])) == [("a", 2)]
    assert keys(db.get_by_keys("Order", [("a", n) for n in range(60)])) == [("a", 1), ("a", 2)]
    assert keys(db.filter("Line", line.q.eq(7)).related("order")) == [("b", 1)]
