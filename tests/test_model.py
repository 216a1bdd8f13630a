import pytest

from tessera.errors import InvalidSchema
from tessera.model import BelongsTo, Embedded, EmbedStruct, Field, HasMany, HasOne, Index, Model, Registry, Via


def user(*extra, **kw):
    return Model("User", "users", (Field("id", "i64"), Field("name", "string"), *extra), ("id",), **kw)


def todo(*extra):
    return Model("Todo", "todos", (Field("id", "i64"), Field("user_id", "i64"), BelongsTo("user", "User", {"user_id": "id"}), *extra), ("id",))


def test_links():
    r = Registry(user(HasMany("todos", "Todo", "user")), todo())
    assert r.link(r["User"], r["User"].field("todos")) == (["id"], ["user_id"])
    assert r.link(r["Todo"], r["Todo"].field("user")) == (["user_id"], ["id"])


@pytest.mark.parametrize(
    "models",
    [
        lambda: (user(Field("name", "i64")),),
        lambda: (user(Field("x", "string", column="name")),),
        lambda: (user(HasMany("todos", "Todo", "owner")), todo()),
        lambda: (user(HasMany("todos", "Nothing", "user")),),
        lambda: (user(Field("x", "colour")),),
        lambda: (user(), user()),
        lambda: (user(indices=(Index(("nope",)),)),),
        lambda: (user(), Model("T", "t", (Field("id", "i64"), Field("u", "string"), BelongsTo("user", "User", {"u": "id"})), ("id",))),
        lambda: (user(), Model("T", "t", (Field("id", "i64"), Field("u", "string"), BelongsTo("user", "User", {"u": "name"})), ("id",))),
        lambda: (user(HasMany("todos", "Todo", "user"), Via("bad", ("todos", "id", "user"))), todo()),
        lambda: (user(Via("bad", ("name",))),),
        lambda: (Model("N", "n", (Field("id", "i64"),), ()),),
    ],
)
def test_bad_schemas(models):
    with pytest.raises(InvalidSchema):
        Registry(*models())


def test_eager_cycle():
    with pytest.raises(InvalidSchema, match="cycle"):
        Registry(
            user(HasMany("todos", "Todo", "user", eager=True)),
            Model("Todo", "todos", (Field("id", "i64"), Field("user_id", "i64"), BelongsTo("user", "User", {"user_id": "id"}, eager=True)), ("id",)),
        )


def test_index_prefixes():
    m = user(Field("a", "i64"), Field("b", "i64"), indices=(Index(("a", "b"), unique=True),))
    assert m.index_prefixes() == [("id",), ("a",), ("a", "b")]
    assert ("a", "b") in m.unique_sets()


def test_embedded_columns():
    address = EmbedStruct("Address", (Field("street", "string"), Field("city", "string")))
    office = EmbedStruct("Office", (Field("name", "string"), Embedded("address", address)))
    m = Model("Company", "company", (Field("id", "i64"), Embedded("hq", office)), ("id",))
    assert [c for c, _, _ in m.columns()] == ["id", "hq_name", "hq_address_street", "hq_address_city"]


def test_via_of_via_and_scalar():
    r = Registry(
        user(HasMany("todos", "Todo", "user"), Via("tags", ("todos", "tags")), Via("labels", ("tags", "label"))),
        todo(HasMany("tags", "Tag", "todo")),
        Model("Tag", "tags", (Field("id", "i64"), Field("todo_id", "i64"), Field("label", "string"), BelongsTo("todo", "Todo", {"todo_id": "id"})), ("id",)),
    )
    steps, target, scalar = r.via_steps(r["User"], r["User"].field("labels"))
    assert [s[1].name for s in steps] == ["todos", "tags"] and target.name == "Tag" and scalar == "label"


def test_required_has_one():
    r = Registry(
        Model("User", "users", (Field("id", "i64"), HasOne("profile", "Profile", "user", required=True)), ("id",)),
        Model("Profile", "profiles", (Field("id", "i64"), Field("user_id", "i64", nullable=True), BelongsTo("user", "User", {"user_id": "id"}, nullable=True)), ("id",)),
    )
    assert r["User"].field("profile").required
