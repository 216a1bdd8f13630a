"""Random predicates against DuckDB, and scalar functions on odd values."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.expr import And, Not, Or
from tessera.functions import scalars, types
from tessera.model import Field, Model, Registry
from tessera.sources.db import Db

ROWS = [(i, (None, 0, 1, 2, 3)[i % 5], (None, "", "a", "ab", "B", "a%")[i % 6]) for i in range(60)]

numbers, texts = st.sampled_from([None, 0, 1, 2, 9]), st.sampled_from(["", "a", "ab", "B", "a%", "zz"])


def literal(v):
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"


@st.composite
def leaves(draw):
    f = Registry(Model("R", "r", (Field("id", "i64"), Field("n", "i64", nullable=True), Field("s", "string", nullable=True)), ("id",)))["R"].f
    kind = draw(st.integers(0, 6))
    if kind == 0:
        v = draw(st.sampled_from([0, 1, 2, 9]))
        op, sql = draw(st.sampled_from([("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")]))
        return getattr(f.n, op)(v), f"n {sql} {v}"
    if kind == 1:
        vs = draw(st.lists(numbers, max_size=4))
        return f.n.in_list(vs), f"n IN ({', '.join(map(literal, vs))})" if vs else "false"
    if kind == 2:
        a, b = draw(st.integers(0, 3)), draw(st.integers(0, 3))
        return f.n.between(a, b), f"n BETWEEN {a} AND {b}"
    if kind == 3:
        v = draw(texts)
        return f.s.starts_with(v), f"starts_with(s, {literal(v)})"
    if kind == 4:
        v = draw(st.sampled_from(["a%", "%b", "_", "%", "a!%"]))
        return f.s.like_with_escape(v, "!"), f"s LIKE {literal(v)} ESCAPE '!'"
    if kind == 5:
        return (f.s.is_none(), "s IS NULL") if draw(st.booleans()) else (f.n.is_some(), "n IS NOT NULL")
    v = draw(texts)
    return f.s.eq(v), f"s = {literal(v)}"


def grown(children):
    pairs = st.tuples(children, children)
    return st.one_of(
        pairs.map(lambda p: (And((p[0][0], p[1][0])), f"({p[0][1]} AND {p[1][1]})")),
        pairs.map(lambda p: (Or((p[0][0], p[1][0])), f"({p[0][1]} OR {p[1][1]})")),
        children.map(lambda c: (Not(c[0]), f"(NOT {c[1]})")),
    )


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.recursive(leaves(), grown, max_leaves=6))
def test_random_predicates(spark, case):
    import duckdb

    expr, sql = case
    reg = Registry(Model("R", "r", (Field("id", "i64"), Field("n", "i64", nullable=True), Field("s", "string", nullable=True)), ("id",)))
    db = Db(spark, reg, tables={"r": spark.createDataFrame(ROWS, "id long, n long, s string")})
    con = duckdb.connect()
    con.execute("CREATE TABLE r (id BIGINT, n BIGINT, s VARCHAR)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", ROWS)
    assert sorted(x.id for x in db.filter("R", expr).exec()) == sorted(x[0] for x in con.execute(f"SELECT id FROM r WHERE {sql}").fetchall())


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_arrays_with_nulls(spark):
    a, none = F.array(F.lit(1), F.lit(None), F.lit(2), F.lit(1)), F.lit(None).cast("array<int>")
    assert one(spark, scalars.contains(a, 3)) is False and one(spark, scalars.contains(none, 3)) is None
    assert one(spark, scalars.is_superset(a, [1, 2])) is True and one(spark, scalars.intersects(a, [9])) is False
    assert one(spark, scalars.length(a)) == 4 and one(spark, scalars.length(none)) is None
    assert one(spark, scalars.remove(a, 1)) == [None, 2] and one(spark, scalars.remove_at(a, 7)) == [1, None, 2, 1]
    assert one(spark, scalars.pop(F.array().cast("array<int>"))) == []
    assert one(spark, scalars.all_of(F.array().cast("array<int>"), lambda x: x > 1)) is True


def test_dispatch(spark):
    assert one(spark, scalars.match(F.lit("b"), {"a": 1, "b": 2}, 0)) == 2
    assert one(spark, scalars.match(F.lit("z"), {}, 5)) == 5
    assert one(spark, scalars.let(F.lit(3), lambda x: x * x)) == 9
    with pytest.raises(Exception, match="unreachable"):
        one(spark, scalars.error("unreachable"))


def test_json(spark):
    doc = F.lit('{"a": {"b c": 3, "n": null}}')
    assert one(spark, scalars.json_extract(doc, ["a", "b c"], "int")) == 3
    assert one(spark, scalars.json_extract(doc, ["a", "n"])) is None and one(spark, scalars.json_extract(doc, ["x"])) is None
    assert one(spark, scalars.json_literal(None)) == "null"
    kind = T.StructType([T.StructField("a", T.IntegerType())])
    assert one(spark, scalars.json_encode(scalars.json_decode(F.lit('{"a":1}'), kind))) == '{"a":1}'


def test_types(spark):
    assert types.spark_type("list<i32>") == T.ArrayType(T.IntegerType()) and types.spark_type("decimal(10,2)") == T.DecimalType(10, 2)
    assert one(spark, types.cast(F.lit(200), "u8")) == 200
    for value, kind in ((300, "u8"), (-1, "u16"), (40000, "i16"), ("x", "i32")):
        with pytest.raises(Exception):  # noqa: B017
            one(spark, types.cast(F.lit(value), kind))
    assert one(spark, types.cast(F.lit("abc"), "varchar(3)")) == "abc"
    u = "0189F7EA-AE2C-7C3A-8B5D-000000000001"
    assert one(spark, types.bytes_to_uuid(types.uuid_to_bytes(F.lit(u)))) == u.lower()
