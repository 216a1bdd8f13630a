"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ValidationFailed
from tessera.expr import And, Or, Path, and_all, computed, in_query, or_all
from tessera.functions import scalars
from tessera.operators import mutate
from tessera.operators.includes import include
from tessera.plans import batch as batches
from tessera.plans import dsl, models
from tessera.query import Query
from tessera.sources.db import Db

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Short names for a query: ``t.Order`` is the model's paths, ``t.all("Order")`` its rows."""

    def __init__(self, spark: SparkSession, sf_dir: str, registry=models.registry):
        self.db = Db(spark, registry(), sf_dir)
        self.spark = spark

    def __getattr__(self, name: str) -> Path:
        return self.db.registry[name].f

    def all(self, name: str) -> Query:
        return self.db.all(name)


def query(sql: str, registry=models.registry):
    """Registers a function of Tables under its name."""

    def register(f: Callable[[Tables], Query | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir, registry))
            return out.frame() if isinstance(out, Query) else out

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return f

    return register


DAY = dt.datetime(1997, 1, 1)
ORDER = "o_orderkey AS orderkey, o_custkey AS custkey, o_orderstatus AS status, o_totalprice AS totalprice, o_orderdate AS orderdate, o_orderpriority AS orderpriority"
CUSTOMER = "c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment"
PART = "p_partkey AS partkey, p_name AS name, p_brand AS brand, p_type AS type, p_size AS size, p_retailprice AS retailprice"
NATION = "n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey"
SUPPLIER = "s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey, s_acctbal AS acctbal"


# Sources.


@query(f"SELECT {NATION} FROM nation")
def source_all(t):
    return t.all("Nation")


@query(f"SELECT {ORDER} FROM orders WHERE o_orderkey IN (1, 7, 32, 100000000)")
def get_by_keys(t):
    return t.db.get_by_keys("Order", [1, 7, 32, 100_000_000])


@query("SELECT conv_id, turn, role, text FROM conversations WHERE (conv_id, turn) IN ((0, 0), (1, 1), (2, 0))")
def get_by_composite_keys(t):
    return t.db.get_by_keys("Turn", [(0, 0), (1, 1), (2, 0)])


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn >= 1 ORDER BY turn LIMIT 5")
def query_key_range(t):
    return t.db.filter_by("Turn", conv_id=3).filter(t.Turn.turn.ge(1)).order_by(t.Turn.turn).limit(5).select("conv_id", "turn", "role")


@query("SELECT p_partkey AS partkey FROM part WHERE p_brand = 'Brand#12'")
def find_keys_by_index(t):
    return t.db.filter_by("Part", brand="Brand#12").select("partkey")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(id, name)")
def values_rows(t):
    return t.db.values([(1, "a"), (2, "b"), (3, None)], "id int, name string")


@query("SELECT 1 AS one, 'x' AS letter, 3 AS three")
def unit_row(t):
    return t.db.unit(F.lit(1).alias("one"), F.lit("x").alias("letter"), (F.lit(1) + F.lit(2)).alias("three"))


@query("SELECT n.name, n.nationkey FROM (SELECT n_name AS name, n_nationkey AS nationkey FROM nation WHERE n_regionkey = 1) n WHERE n.nationkey > 2")
def derived_table(t):
    return t.all("Nation").filter(t.Nation.regionkey.eq(1)).frame().where("nationkey > 2").select("name", "nationkey")


@query("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey AS custkey, count(*) AS n FROM big GROUP BY 1")
def cte_reuse(t):
    return t.db.sql("WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey AS custkey, count(*) AS n FROM big GROUP BY 1")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY 1")
def raw_sql_params(t):
    return t.db.sql("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_totalprice > ? AND o_orderstatus = ? GROUP BY 1", [100000, "F"])


@query("SELECT n_name AS nation, r_name AS region FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def raw_sql_comma_join(t):
    return t.db.sql("SELECT n_name AS nation, r_name AS region FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> ?", ["ASIA"])


@query("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_custkey = 4")
def raw_sql_named(t):
    return t.db.sql("SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders WHERE o_custkey = :c", {"c": 4}, {"orderkey": "bigint"})


# Projection.


@query("SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders")
def select_tuple(t):
    return t.all("Order").select("orderkey", "totalprice")


@query("SELECT o_orderkey AS orderkey, o_orderstatus AS s, o_totalprice AS p FROM orders")
def select_struct_flat(t):
    whole = F.struct(t.Order.status.value().alias("s"), t.Order.totalprice.value().alias("p")).alias("pair")
    return t.all("Order").select("orderkey", whole).frame().select("orderkey", "pair.s", "pair.p")


@query("SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS orderpriority FROM orders")
def distinct(t):
    return t.all("Order").select("status", "orderpriority").distinct()


@query("SELECT o_orderkey AS orderkey, c_name AS customer_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
def select_belongs_to(t):
    return t.all("Order").filter(t.Order.totalprice.gt(400000)).select(t.Order.orderkey, t.Order.customer.name)


@query("SELECT n_nationkey AS nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::BIGINT AS n, (SELECT coalesce(sum(s_suppkey), 0) FROM supplier WHERE s_nationkey = n_nationkey)::BIGINT AS keys FROM nation")
def select_has_many(t):
    found = t.all("Nation").select(t.Nation.nationkey, t.Nation["suppliers"]).frame()
    return found.select("nationkey", F.size("suppliers").cast("long").alias("n"), F.aggregate("suppliers", F.lit(0).cast("long"), lambda a, s: a + s["suppkey"]).alias("keys"))


@query("SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def select_has_one(t):
    return t.all("Document").select(t.Document.doc_id, t.Document["label"]).frame().select("doc_id", "label.toxic")


@query("SELECT o_orderkey AS orderkey, 1 AS one FROM orders WHERE o_orderstatus = 'P'")
def returning_constant(t):
    return t.all("Order").filter(t.Order.status.eq("P")).select(t.Order.orderkey, F.lit(1).alias("one"))


@query("SELECT vec_id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), 'sum')::BIGINT AS positive FROM embeddings")
def map_list(t):
    signs = scalars.map_list(F.col("embedding"), lambda x: F.when(x > 0, 1).otherwise(0))
    return t.all("Embedding").select(t.Embedding.vec_id, F.aggregate(signs, F.lit(0).cast("long"), lambda a, x: a + x).alias("positive"))


@query("SELECT o_orderkey AS orderkey, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS rank FROM orders")
def match_case(t):
    return t.all("Order").select(t.Order.orderkey, scalars.match(t.Order.status.value(), {"F": 2, "P": 1}, 0).alias("rank"))


@query("SELECT o_orderkey AS orderkey, (o_custkey % 7) * (o_custkey % 7) + (o_custkey % 7) AS y FROM orders")
def let_binding(t):
    return t.all("Order").select(t.Order.orderkey, scalars.let(t.Order.custkey.value() % 7, lambda x: x * x + x).alias("y"))


@query("SELECT o_orderkey AS orderkey, o_custkey::VARCHAR AS text, o_custkey::DOUBLE AS float FROM orders")
def cast_values(t):
    from tessera.functions.types import cast

    c = t.Order.custkey.value()
    return t.all("Order").select(t.Order.orderkey, cast(c, "string").alias("text"), cast(c, "f64").alias("float"))


# Predicates.


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'")
def filter_eq_ne(t):
    return t.all("Order").filter(t.Order.status.eq("F")).filter(t.Order.orderpriority.ne("1-URGENT"))


@query(f"SELECT {ORDER} FROM orders WHERE o_totalprice > 1000 AND o_totalprice >= 2000 AND o_totalprice < 300000 AND o_totalprice <= 250000 AND o_orderdate >= TIMESTAMP '1997-01-01'")
def filter_range(t):
    p = t.Order.totalprice
    return t.all("Order").filter(p.gt(1000) & p.ge(2000) & p.lt(300000) & p.le(250000) & t.Order.orderdate.ge(DAY))


@query(f"SELECT {ORDER} FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def filter_between(t):
    return t.all("Order").filter(t.Order.totalprice.between(100000, 150000))


@query(f"SELECT {ORDER} FROM orders WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') OR (o_orderpriority IN ('2-HIGH', NULL) AND o_orderstatus = 'O')")
def filter_in(t):
    p = t.Order.orderpriority
    return t.all("Order").filter(p.in_list(["1-URGENT", "3-MEDIUM"]) | (p.in_list(["2-HIGH", None]) & t.Order.status.eq("O")))


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def filter_not_in(t):
    return t.all("Order").filter(~t.Order.status.in_list(["F", "O"]))


@query(f"SELECT {ORDER} FROM orders WHERE false")
def filter_in_empty(t):
    return t.all("Order").filter(t.Order.status.in_list([]))


@query(f"SELECT {ORDER} FROM orders WHERE o_orderkey IN (SELECT unnest(range(0, 3000, 3)))")
def filter_in_long(t):
    return t.all("Order").filter(t.Order.orderkey.in_list(range(0, 3000, 3)))


@query(f"SELECT {ORDER} FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P' OR o_totalprice > 400000) AND NOT (o_orderpriority = '5-LOW' OR o_totalprice < 5000)")
def filter_and_or_not(t):
    o = t.Order
    return t.all("Order").filter(And((Or((o.status.eq("F"), o.status.eq("P"), o.totalprice.gt(400000))), ~(o.orderpriority.eq("5-LOW") | o.totalprice.lt(5000)))))


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'P'")
def filter_set(t):
    return t.all("Order").filter(t.Order.status.eq("F")).set_filter(t.Order.status.eq("P"))


@query(f"SELECT {PART} FROM part WHERE p_name LIKE '%1_'")
def filter_like(t):
    return t.all("Part").filter(t.Part.name.like("%1_"))


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_name LIKE 'Customer#%1' OR c_name LIKE '%!_%' ESCAPE '!'")
def filter_like_escape(t):
    n = t.Customer.name
    return t.all("Customer").filter(n.like("Customer#%1") | n.like_with_escape("%!_%", "!"))


@query(f"SELECT {PART} FROM part WHERE p_type ILIKE '%STEEL%'")
def filter_ilike(t):
    return t.all("Part").filter(t.Part["type"].ilike("%steel%"))


@query(f"SELECT {PART} FROM part WHERE p_name ILIKE 'PART!_%' ESCAPE '!' OR p_brand ILIKE 'brand#1%' ESCAPE '!'")
def filter_ilike_escape(t):
    return t.all("Part").filter(t.Part.name.ilike_with_escape("PART!_%", "!") | t.Part.brand.ilike_with_escape("brand#1%", "!"))


@query(f"SELECT {PART} FROM part WHERE starts_with(p_brand, 'Brand#2')")
def filter_starts_with(t):
    return t.all("Part").filter(t.Part.brand.starts_with("Brand#2"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def filter_is_none_relation(t):
    return t.all("Document").filter(t.Document["label"].is_none()).select("doc_id")


@query("SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL OR toxic = 1")
def filter_is_null(t):
    rows = t.all("Document").select(t.Document.doc_id, t.Document["label"]).frame().select("doc_id", "label.toxic")
    return rows.where(F.col("toxic").isNull() | (F.col("toxic") == 1))


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem WHERE l_extendedprice > l_quantity * 1000 AND l_discount > l_tax")
def filter_columns(t):
    line = t.Lineitem
    return t.all("Lineitem").filter(line.extendedprice.gt(computed(lambda: F.col("l_quantity") * 1000)) & line.discount.gt(line.tax)).select("orderkey", "linenumber", "partkey", "suppkey")


@query(f"SELECT {ORDER} FROM orders WHERE (o_custkey, o_orderstatus) IN ((1, 'O'), (2, 'F'), (4, 'P'))")
def filter_record(t):
    o = t.Order
    return t.all("Order").filter(or_all([and_all([o.custkey.eq(c), o.status.eq(s)]) for c, s in ((1, "O"), (2, "F"), (4, "P"))]))


# Counts.


@query("SELECT count(*) AS count FROM orders")
def count_all(t):
    return t.all("Order").count_frame()


@query("SELECT count(*) AS count FROM orders WHERE o_orderstatus = 'F'")
def count_filtered(t):
    return t.all("Order").filter(t.Order.status.eq("F")).count_frame()


@query("SELECT count(*) FILTER (WHERE o_totalprice > 200000) AS big, count(o_custkey) AS customers FROM orders")
def count_filter_clause(t):
    return t.all("Order").rows().agg(F.count_if(t.Order.totalprice.gt(200000).column()).alias("big"), F.count(t.Order.custkey.value()).alias("customers"))


@query("SELECT n_nationkey AS nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def count_children(t):
    return t.all("Nation").select(t.Nation.nationkey, t.Nation["customers"]).frame().select("nationkey", F.size("customers").cast("long").alias("n"))


# Order, limits, pages.


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def order_limit(t):
    return t.all("Customer").filter(t.Customer.acctbal.gt(0)).order_by(t.Customer.acctbal.desc(), t.Customer.custkey.asc()).limit(10)


@query(f"SELECT {ORDER} FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 15")
def order_limit_offset(t):
    return t.all("Order").order_by("totalprice").order_by("orderkey").limit(20).offset(15)


@query(f"SELECT {ORDER} FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50")
def order_mixed(t):
    o = t.Order
    return t.all("Order").order_by(o.status, o.totalprice.desc(), o.orderkey).limit(50)


@query(f"SELECT {ORDER} FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def order_reverse(t):
    return t.all("Order").order_by("orderkey").reverse().limit(5)


@query(f"SELECT {ORDER} FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 7")
def latest_by(t):
    return t.all("Order").latest_by("orderdate").order_by(t.Order.orderkey.desc()).limit(7)


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1")
def first(t):
    return t.all("Order").filter(t.Order.status.eq("P")).order_by("orderkey").limit(1)


@query(f"SELECT {ORDER} FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def page_first(t):
    return t.all("Order").order_by("orderdate", "orderkey").paginate(25).frame()


@query(f"SELECT {ORDER} FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-01-01', 500) ORDER BY o_orderdate, o_orderkey LIMIT 25")
def page_after(t):
    return t.all("Order").order_by("orderdate", "orderkey").paginate(25).after((DAY, 500)).frame()


@query(f"SELECT * FROM (SELECT {ORDER} FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1997-01-01', 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25)")
def page_before(t):
    return t.all("Order").order_by("orderdate", "orderkey").paginate(25).before((DAY, 500)).frame()


@query(f"SELECT {ORDER} FROM orders WHERE o_orderstatus > 'F' OR (o_orderstatus = 'F' AND (o_totalprice < 200000 OR (o_totalprice = 200000 AND o_orderkey > 100))) ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 40")
def page_mixed_dir(t):
    o = t.Order
    return t.all("Order").order_by(o.status, o.totalprice.desc(), o.orderkey).paginate(40).after(("F", 200000.0, 100)).frame()


@query(f"SELECT {ORDER} FROM orders WHERE o_orderpriority > '2-HIGH' OR (o_orderpriority = '2-HIGH' AND o_orderkey > 5000) ORDER BY o_orderpriority, o_orderkey LIMIT 30")
def page_tiebreak(t):
    return t.all("Order").order_by("orderpriority").paginate(30).after(("2-HIGH", 5000)).frame()


@query(f"SELECT {ORDER} FROM orders WHERE o_orderpriority > '2-HIGH' ORDER BY o_orderpriority, o_orderkey LIMIT 30")
def page_partial_cursor(t):
    return t.all("Order").order_by("orderpriority").paginate(30).after("2-HIGH").frame()


@query("SELECT doc_id, toxic FROM (SELECT doc_id, toxic FROM documents LEFT JOIN labels USING (doc_id)) WHERE toxic IS NOT NULL AND (toxic > 0 OR (toxic = 0 AND doc_id > 500)) ORDER BY toxic NULLS FIRST, doc_id LIMIT 20")
def page_nulls(t):
    """Pages over a column with NULLs, which come first."""
    from tessera.operators.paginate import beyond

    rows = t.all("Document").select(t.Document.doc_id, t.Document["label"]).frame().select("doc_id", "label.toxic")
    label, doc = t.Label.toxic.asc(), t.Document.doc_id.asc()
    return rows.filter(beyond([label, doc], (0, 500))).orderBy(label.column(), doc.column()).limit(20)


@query("SELECT custkey, count(o_orderkey) AS n FROM (SELECT c_custkey AS custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10) LEFT JOIN orders ON o_custkey = custkey GROUP BY custkey")
def page_include(t):
    page = t.all("Customer").order_by("acctbal").include("orders").paginate(10).frame()
    return page.select("custkey", F.size("orders").cast("long").alias("n"))


# Relations in predicates.


@query(f"SELECT {ORDER} FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def rel_path_filter(t):
    return t.all("Order").filter(t.Order.customer.mktsegment.eq("BUILDING"))


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)))")
def rel_path_chain(t):
    return t.all("Lineitem").filter(t.Lineitem.order.customer.nation.regionkey.eq(2)).select("orderkey", "linenumber", "partkey", "suppkey")


@query(f"SELECT {ORDER} FROM orders WHERE o_custkey = 7")
def rel_pinned_key(t):
    """Only the target's key is asked for, so nothing is joined."""
    return t.all("Order").filter(t.Order.customer.custkey.eq(7))


@query(f"SELECT {ORDER} FROM orders WHERE o_custkey <> 7 AND o_totalprice > 350000")
def rel_handle_ne(t):
    return t.all("Order").filter(t.Order["customer"].ne({"custkey": 7}) & t.Order.totalprice.gt(350000))


@query(f"SELECT {ORDER} FROM orders WHERE o_custkey IN (7, 8, 10)")
def rel_handle_in(t):
    return t.all("Order").filter(t.Order["customer"].in_list([{"custkey": k} for k in (7, 8, 10)]))


@query(f"SELECT {ORDER} FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING')")
def rel_path_ne(t):
    return t.all("Order").filter(t.Order.customer.mktsegment.ne("BUILDING"))


@query(f"SELECT {ORDER} FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def rel_path_not(t):
    return t.all("Order").filter(~t.Order.customer.mktsegment.eq("BUILDING"))


@query(f"SELECT {ORDER} FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_name LIKE '%5')")
def rel_path_like(t):
    return t.all("Order").filter(t.Order.customer.name.like("%5"))


@query(f"SELECT {CUSTOMER} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_any(t):
    return t.all("Customer").filter(t.Customer["orders"].any(t.Order.totalprice.gt(300000)))


@query(f"SELECT {CUSTOMER} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 20000))")
def rel_all(t):
    return t.all("Customer").filter(t.Customer["orders"].all(t.Order.totalprice.gt(20000)))


@query(f"SELECT {ORDER} FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity > 10))")
def rel_all_vacuous(t):
    return t.all("Order").filter(t.Order["lineitems"].all(t.Lineitem.quantity.gt(10)))


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_acctbal < -900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def rel_any_or(t):
    return t.all("Customer").filter(t.Customer.acctbal.lt(-900) | t.Customer["orders"].any(t.Order.totalprice.gt(400000)))


@query(f"SELECT {CUSTOMER} FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def rel_not_any(t):
    return t.all("Customer").filter(~t.Customer["orders"].any(t.Order.status.eq("P")))


@query(f"SELECT {CUSTOMER} FROM customer WHERE NOT (c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000))")
def rel_not_and(t):
    return t.all("Customer").filter(~(t.Customer.acctbal.gt(0) & t.Customer["orders"].any(t.Order.totalprice.gt(200000))))


@query(f"SELECT {CUSTOMER} FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49))")
def rel_any_nested(t):
    return t.all("Customer").filter(t.Customer["orders"].any(t.Order.status.eq("F") & t.Order["lineitems"].any(t.Lineitem.quantity.gt(49))))


@query("SELECT r_regionkey AS regionkey, r_name AS name FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = r_regionkey AND o_totalprice > 450000)")
def rel_any_via(t):
    return t.all("Region").filter(t.Region["orders"].any(t.Order.totalprice.gt(450000)))


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3))")
def in_query_simple(t):
    return t.all("Customer").filter(t.Customer.nationkey.in_query(t.all("Nation").filter(t.Nation.regionkey.in_list([1, 3])).select("nationkey")))


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50)")
def in_query_composite(t):
    line = t.Lineitem
    pairs = t.all("Lineitem").filter(line.quantity.eq(50.0)).select("partkey", "suppkey")
    return t.all("Lineitem").filter(in_query([line.partkey, line.suppkey], pairs)).select("orderkey", "linenumber", "partkey", "suppkey")


@query(f"SELECT {CUSTOMER} FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 1)")
def not_in_query(t):
    return t.all("Customer").filter(~t.Customer.nationkey.in_query(t.all("Nation").filter(t.Nation.regionkey.eq(1)).select("nationkey")))


# Navigation.


@query(f"SELECT {ORDER} FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def assoc_has_many(t):
    return t.all("Customer").filter(t.Customer.mktsegment.eq("MACHINERY")).related("orders")


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 380000)")
def assoc_belongs_to(t):
    return t.all("Order").filter(t.Order.totalprice.gt(380000)).related("customer")


@query("SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def assoc_chain(t):
    return t.all("Customer").filter(t.Customer.nationkey.eq(3)).related("orders").filter(t.Order.status.eq("P")).related("lineitems").select("orderkey", "linenumber", "partkey", "suppkey")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'de')")
def assoc_has_one(t):
    return t.all("Document").filter(t.Document.lang.eq("de")).related("label")


@query("SELECT c_custkey AS customer_c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 5")
def related_pairs(t):
    return t.all("Customer").filter(t.Customer.nationkey.eq(5)).pairs("orders").select("customer_c_custkey", "o_orderkey", "o_totalprice")


@query(f"SELECT {CUSTOMER} FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def via_targets(t):
    return t.all("Region").filter(t.Region.regionkey.eq(1)).related("customers")


@query("SELECT DISTINCT o_orderpriority AS orderpriority FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def via_scalar(t):
    return t.all("Region").filter(t.Region.regionkey.eq(2)).related("priorities")


@query(f"SELECT DISTINCT {SUPPLIER} FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13' AND p_size < 5")
def via_many_to_many(t):
    return t.all("Part").filter(t.Part.brand.eq("Brand#13") & t.Part.size.lt(5)).related("suppliers")


@query(f"SELECT {ORDER} FROM orders WHERE o_totalprice > 400000 AND o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0)")
def via_of_via(t):
    return t.all("Region").filter(t.Region.regionkey.eq(0)).related("orders").filter(t.Order.totalprice.gt(400000))


# Includes.


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def include_many(t):
    found = t.all("Customer").include("orders").frame()
    return found.select("custkey", F.size("orders").cast("long").alias("n"), F.aggregate("orders", F.lit(0).cast("long"), lambda a, o: a + o["orderkey"]).alias("keys"))


@query("SELECT o_orderkey AS orderkey, c_name AS name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def include_one(t):
    return t.all("Order").include("customer").frame().select("orderkey", "customer.name", F.col("customer.mktsegment").alias("segment"))


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def include_has_one(t):
    return t.all("Document").include("label").frame().select("doc_id", "label.quality", "label.toxic")


@query("""SELECT c_custkey AS custkey, o_orderkey AS orderkey, count(l_linenumber) AS n, coalesce(sum(l_partkey), 0)::BIGINT AS parts
FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def include_nested(t):
    found = t.all("Customer").include("orders.lineitems").frame().select("custkey", F.explode("orders").alias("o"))
    return found.select("custkey", "o.orderkey", F.size("o.lineitems").cast("long").alias("n"), F.aggregate("o.lineitems", F.lit(0).cast("long"), lambda a, x: a + x["partkey"]).alias("parts"))


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 50000 GROUP BY 1")
def include_filtered(t):
    one = include("orders").filter(t.Order.status.eq("F")).filter(t.Order.totalprice.gt(50000))
    return t.all("Customer").include(one).frame().select("custkey", F.size("orders").cast("long").alias("n"))


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND (o_orderstatus = 'P' OR o_totalprice > 300000) GROUP BY 1")
def include_filter_or(t):
    found = t.all("Customer").include(include("orders").filter(t.Order.status.eq("P"))).include(include("orders").filter(t.Order.totalprice.gt(300000)))
    return found.frame().select("custkey", F.size("orders").cast("long").alias("n"))


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def include_bare_wins(t):
    found = t.all("Customer").include(include("orders").filter(t.Order.status.eq("P"))).include("orders")
    return found.frame().select("custkey", F.size("orders").cast("long").alias("n"))


@query("SELECT o_custkey AS custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) - 1 AS place, o_orderkey AS orderkey FROM orders")
def include_ordered(t):
    one = include("orders").order_by(t.Order.status.asc(), t.Order.totalprice.desc())
    found = t.all("Customer").include(one).frame().select("custkey", F.posexplode("orders").alias("place", "o"))
    return found.select("custkey", F.col("place").cast("long").alias("place"), "o.orderkey")


@query("SELECT p_partkey AS partkey, count(DISTINCT l_suppkey) AS n, coalesce(sum(DISTINCT l_suppkey), 0)::BIGINT AS keys FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def include_via(t):
    found = t.all("Part").include("suppliers").frame()
    return found.select("partkey", F.size("suppliers").cast("long").alias("n"), F.aggregate("suppliers", F.lit(0).cast("long"), lambda a, s: a + s["suppkey"]).alias("keys"))


@query("SELECT r_regionkey AS regionkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def include_via_scalar(t):
    return t.all("Region").include("priorities").frame().select("regionkey", F.array_join("priorities", ",").alias("priorities"))


@query("SELECT o_orderkey AS orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def include_empty(t):
    return t.all("Order").include("lineitems").frame().where(F.size("lineitems") == 0).select("orderkey")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE lang = 'es'")
def include_deferred(t):
    return t.all("Document").filter(t.Document.lang.eq("es")).include("text").frame().select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def deferred_default(t):
    return t.all("Document")


# Arrays.

TAGS = "SELECT o_custkey AS custkey, list_sort(list(DISTINCT o_orderpriority)) AS tags FROM orders GROUP BY 1"


def tagged(t) -> DataFrame:
    return t.all("Order").rows().groupBy(F.col("o_custkey").alias("custkey")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("tags"))


@query(f"SELECT custkey FROM ({TAGS}) WHERE list_contains(tags, '1-URGENT')")
def array_contains(t):
    return tagged(t).where(scalars.contains(F.col("tags"), "1-URGENT")).select("custkey")


@query(f"SELECT custkey FROM ({TAGS}) WHERE list_has_all(tags, ['1-URGENT', '5-LOW'])")
def array_superset(t):
    return tagged(t).where(scalars.is_superset(F.col("tags"), ["1-URGENT", "5-LOW"])).select("custkey")


@query(f"SELECT custkey FROM ({TAGS}) WHERE list_has_any(tags, ['2-HIGH', 'none'])")
def array_intersects(t):
    return tagged(t).where(scalars.intersects(F.col("tags"), ["2-HIGH", "none"])).select("custkey")


@query(f"SELECT custkey, len(tags) AS n FROM ({TAGS})")
def array_len(t):
    return tagged(t).select("custkey", scalars.length(F.col("tags")).alias("n"))


@query(f"SELECT custkey FROM ({TAGS}) WHERE len(list_filter(tags, lambda x: x > '4')) = 0")
def array_is_empty(t):
    return tagged(t).where(scalars.is_empty(F.filter("tags", lambda x: x > "4"))).select("custkey")


@query(f"SELECT custkey, array_to_string(list_append(tags, 'new'), ',') AS tags FROM ({TAGS})")
def array_push(t):
    return tagged(t).select("custkey", F.array_join(scalars.push(F.col("tags"), "new"), ",").alias("tags"))


@query(f"SELECT custkey, array_to_string(list_concat(tags, ['a', 'b']), ',') AS tags FROM ({TAGS})")
def array_extend(t):
    return tagged(t).select("custkey", F.array_join(scalars.extend(F.col("tags"), ["a", "b"]), ",").alias("tags"))


@query(f"SELECT custkey, array_to_string(tags[1:len(tags) - 1], ',') AS tags FROM ({TAGS})")
def array_pop(t):
    return tagged(t).select("custkey", F.array_join(scalars.pop(F.col("tags")), ",").alias("tags"))


@query(f"SELECT custkey, array_to_string(list_filter(tags, lambda x: x <> '3-MEDIUM'), ',') AS tags FROM ({TAGS})")
def array_remove(t):
    return tagged(t).select("custkey", F.array_join(scalars.remove(F.col("tags"), "3-MEDIUM"), ",").alias("tags"))


@query(f"SELECT custkey, array_to_string(list_concat(tags[1:1], tags[3:]), ',') AS tags FROM ({TAGS})")
def array_remove_at(t):
    return tagged(t).select("custkey", F.array_join(scalars.remove_at(F.col("tags"), 1), ",").alias("tags"))


@query(f"SELECT custkey, len(tags) AS before, 0 AS after FROM ({TAGS})")
def array_clear(t):
    return tagged(t).select("custkey", F.size("tags").alias("before"), F.size(scalars.clear(F.col("tags"))).alias("after"))


@query("SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey FROM customer")
def json_round_trip(t):
    """A record written as JSON and read back."""
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("nationkey", T.IntegerType())])
    rows = t.db.table("Customer").select(F.col("c_custkey").alias("custkey"), scalars.json_encode(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"))).alias("text"))
    return rows.select("custkey", scalars.json_decode(F.col("text"), kind).alias("d")).select("custkey", "d.name", "d.nationkey")


@query(f"SELECT custkey, array_to_string(list_append(tags[1:len(tags) - 1], 'x'), ',') AS tags, 0 AS cleared FROM ({TAGS})")
def array_apply(t):
    c = F.col("tags")
    done = mutate.apply([mutate.pop(), mutate.push("x")]).make(c, dict((f.name, f.dataType) for f in tagged(t).schema)["tags"])
    return tagged(t).select("custkey", F.array_join(done, ",").alias("tags"), F.size(scalars.clear(c)).alias("cleared"))


@query(f"SELECT custkey, len(list_filter(tags, lambda x: x > '3')) > 0 AS some, len(list_filter(tags, lambda x: x > '3')) = len(tags) AS every FROM ({TAGS})")
def array_any_all(t):
    c = F.col("tags")
    return tagged(t).select("custkey", scalars.any_of(c, lambda x: x > "3").alias("some"), scalars.all_of(c, lambda x: x > "3").alias("every"))


@query("SELECT vec_id FROM embeddings WHERE len(embedding) > 8 AND label IN (1, 2)")
def array_column(t):
    e = t.Embedding
    return t.all("Embedding").filter(e.embedding.len().gt(8) & e.label.in_list([1, 2])).select("vec_id")


# Documents, enums.


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k')::BIGINT > 90")
def json_path_filter(t):
    return t.all("Event").filter(t.Event.props.k.gt(90)).select("event_id")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS props_k FROM events")
def json_path_select(t):
    return t.all("Event").select(t.Event.event_id, t.Event.props.k)


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT + 1 AS k FROM events")
def document_patch(t):
    rows = t.all("Event").select(t.Event.event_id, t.Event["props"]).frame()
    return rows.select("event_id", scalars.patched(F.col("props"), ["k"], F.col("props.k") + 1).alias("p")).select("event_id", "p.k")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def enum_variant_filter(t):
    return t.all("Event").filter(t.Event.kind.is_variant("Purchase")).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE event_type IN ('purchase', 'error') AND value > 50")
def enum_matches(t):
    e = t.Event
    return t.all("Event").filter(e.kind.in_list(["Purchase", "Error"]) & e["value"].gt(50)).select("event_id")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'View' WHEN 'signup' THEN 'Signup' WHEN 'purchase' THEN 'Purchase' WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Click' END AS variant FROM events")
def enum_decode(t):
    return t.all("Event").select(t.Event.event_id, t.Event["kind"]).frame().select("event_id", "kind.variant")


# Mutations: the table as it is afterwards.


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT * FROM (VALUES (100, 'ATLANTIS', 1), (101, 'LEMURIA', 2))", models.mutable)
def insert_rows(t):
    t.db.create_many("Nation", [{"nationkey": 100, "name": "ATLANTIS", "regionkey": 1}, {"nationkey": 101, "name": "LEMURIA", "regionkey": 2}])
    return t.db.table("Nation")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT * FROM (VALUES (900001, 'ONE', 500, 1.5), (900002, 'TWO', 500, -2.0))", models.mutable)
def create_nested(t):
    """A nation with its suppliers, all of them or none."""
    t.db.create("Nation", nationkey=500, name="ATLANTIS", regionkey=1, suppliers=[{"suppkey": 900_001, "name": "ONE", "acctbal": 1.5}, {"suppkey": 900_002, "name": "TWO", "acctbal": -2.0}])
    with contextlib.suppress(ValidationFailed):
        t.db.create("Nation", nationkey=501, name="LEMURIA", regionkey=1, suppliers=[{"suppkey": 900_003, "name": "THREE", "acctbal": 0.0}, {"suppkey": 900_004, "name": None, "acctbal": 0.0}])
    return t.db.table("Supplier")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 1000, 'NEW ' || n_name, n_regionkey FROM nation WHERE n_regionkey = 0", models.mutable)
def insert_from_query(t):
    rows = t.db.filter("Nation", t.Nation.regionkey.eq(0)).rows()
    return t.db.insert_frame("Nation", rows.select((F.col("n_nationkey") + 1000).alias("n_nationkey"), F.concat(F.lit("NEW "), "n_name").alias("n_name"), "n_regionkey"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer", models.mutable)
def update_set(t):
    t.db.filter("Customer", t.Customer.acctbal.lt(0)).update(mktsegment="DEBT")
    return t.db.table("Customer")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100.5 WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal - 10.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer", models.mutable)
def update_arith(t):
    t.db.filter("Customer", t.Customer.mktsegment.eq("BUILDING")).update(acctbal=mutate.add(100.5))
    t.db.filter("Customer", t.Customer.mktsegment.eq("MACHINERY")).update(acctbal=mutate.subtract(10.0))
    return t.db.table("Customer")


@query("SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_nationkey = 3", models.mutable)
def update_returning(t):
    return t.db.filter("Customer", t.Customer.nationkey.eq(3)).update(acctbal=mutate.increment()).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer", models.mutable)
def update_by_relation(t):
    t.db.filter("Customer", t.Customer.nation.regionkey.eq(1)).update(acctbal=0.0)
    return t.db.table("Customer").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT c_acctbal < 500", models.mutable)
def delete_where(t):
    t.db.filter("Customer", t.Customer.acctbal.lt(500)).delete()
    return t.db.table("Customer")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", models.mutable)
def delete_cascade(t):
    """Customers must have a nation, so they go with theirs."""
    t.db.filter("Nation", t.Nation.regionkey.eq(1)).delete()
    return t.db.table("Customer").select("c_custkey")


@query("SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) THEN NULL ELSE s_nationkey END AS s_nationkey FROM supplier", models.mutable)
def unlink_nullify(t):
    """Suppliers may be without a nation, so they stay."""
    t.db.filter("Nation", t.Nation.regionkey.eq(1)).delete()
    return t.db.table("Supplier").select("s_suppkey", "s_nationkey")


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'THREE' ELSE n_name END AS n_name, CASE n_nationkey WHEN 3 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 300, 'NEW', 4", models.mutable)
def upsert_update(t):
    t.db.upsert("Nation", [{"nationkey": 3, "name": "THREE", "regionkey": 0}, {"nationkey": 300, "name": "NEW", "regionkey": 4}], ["nationkey"])
    return t.db.table("Nation")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 300, 'NEW', 4", models.mutable)
def upsert_ignore(t):
    t.db.upsert("Nation", [{"nationkey": 3, "name": "THREE", "regionkey": 0}, {"nationkey": 300, "name": "NEW", "regionkey": 4}], ["nationkey"], ignore=True)
    return t.db.table("Nation")


@query("SELECT n_nationkey, n_name, CASE n_nationkey WHEN 3 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 300, 'NEW', 9", models.mutable)
def upsert_branches(t):
    """What is created and what is updated differ."""
    rows = [{"nationkey": 3, "regionkey": 0, "name": "X"}, {"nationkey": 300, "regionkey": 0, "name": "NEW"}]
    t.db.upsert("Nation", rows, ["nationkey"], on_create={"regionkey": 9}, on_update={"regionkey": mutate.add(10), "name": mutate.Change(lambda c, _: c)})
    return t.db.table("Nation")


@query("SELECT s_suppkey, CASE WHEN s_suppkey <= 10 THEN s_acctbal + 5 ELSE s_acctbal END AS s_acctbal FROM supplier", models.mutable)
def upsert_incoming(t):
    rows = t.db.filter("Supplier", t.Supplier.suppkey.le(10)).rows().withColumn("s_acctbal", F.col("s_acctbal") + 5)
    t.db.upsert("Supplier", rows, ["suppkey"])
    return t.db.table("Supplier").select("s_suppkey", "s_acctbal")


@query("SELECT c_custkey, CASE WHEN c_custkey <= 5 THEN 'CHECKED' ELSE c_mktsegment END AS c_mktsegment FROM customer", models.mutable)
def conditional_update(t):
    t.db.update(t.db.filter("Customer", t.Customer.custkey.le(5)), {"mktsegment": "CHECKED"}, condition=t.Customer.acctbal.gt(-100000))
    return t.db.table("Customer").select("c_custkey", "c_mktsegment")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 1 UNION ALL SELECT 77, 'KEPT'", models.mutable)
def transaction_rollback(t):
    """What fails leaves nothing; a savepoint that fails leaves what is around it."""
    with t.db.transaction():
        t.db.create("Nation", nationkey=77, name="KEPT", regionkey=0)
        try:
            with t.db.transaction():
                t.db.create("Nation", nationkey=78, name="LOST", regionkey=0)
                raise RuntimeError
        except RuntimeError:
            t.db.filter("Nation", t.Nation.nationkey.eq(1)).delete()
    return t.db.table("Nation").select("n_nationkey", "n_name")


# Set operations, language, batches.


@query("SELECT n_regionkey AS regionkey FROM nation WHERE n_nationkey < 10 UNION SELECT n_regionkey FROM nation WHERE n_nationkey > 15")
def union_distinct(t):
    return t.all("Nation").filter(t.Nation.nationkey.lt(10)).select("regionkey").union(t.all("Nation").filter(t.Nation.nationkey.gt(15)).select("regionkey"))


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    return t.all("Customer").select("nationkey").intersect(t.all("Supplier").select("nationkey"))


@query("SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def except_(t):
    return t.all("Nation").select("nationkey").except_(t.all("Supplier").filter(t.Supplier.acctbal.gt(3000)).select("nationkey"))


@query(f"SELECT {ORDER} FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice >= 300000) AND NOT o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED') AND o_custkey > 3 ORDER BY o_orderkey DESC LIMIT 10 OFFSET 5")
def dsl_query(t):
    text = 'Order FILTER (.status == "F" OR .totalprice >= #least) AND NOT .orderpriority IN ["5-LOW", "4-NOT SPECIFIED"] AND 3 < .custkey ORDER BY .orderkey DESC OFFSET 5 LIMIT #n'
    return dsl.query(t.db, text, least=300000, n=10)


@query("SELECT c_custkey AS custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def dsl_relation_path(t):
    return dsl.query(t.db, "Customer filter .nation.regionkey == 2").select("custkey")


@query("SELECT 'customers' AS name, count(*) AS n FROM customer UNION ALL SELECT 'late', count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' UNION ALL SELECT 'nations', count(*) FROM nation")
def batch_counts(t):
    return batches.counts({"customers": t.all("Customer"), "late": t.all("Order").filter(t.Order.orderdate.ge(DAY)), "nations": t.all("Nation")})


@query("SELECT c_custkey AS custkey, n_name AS nation, count(DISTINCT o_orderkey) AS urgent, count(l_linenumber) AS lines FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE c_acctbal > 0 GROUP BY 1, 2")
def customer_overview(t):
    """Nation, urgent orders and their lines, loaded with each customer in one plan."""
    orders = include("orders").filter(t.Order.orderpriority.eq("1-URGENT"))
    found = t.all("Customer").filter(t.Customer.acctbal.gt(0)).include("nation", orders, include("orders.lineitems")).frame()
    lines = F.aggregate("orders", F.lit(0).cast("long"), lambda a, o: a + F.size(o["lineitems"]))
    return found.select("custkey", F.col("nation.name").alias("nation"), F.size("orders").cast("long").alias("urgent"), lines.alias("lines"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["customer_overview"](spark, sf_dir)
