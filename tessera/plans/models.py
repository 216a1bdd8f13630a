"""Models of the driver's tables."""

from __future__ import annotations

from tessera.model import BelongsTo, Document, Embedded, EmbedEnum, EmbedStruct, Field, HasMany, HasOne, Index, Model, Registry, Variant, Via

F = Field

#: What events.props holds.
PROPS = EmbedStruct("Props", (F("k", "i64", nullable=True),))

#: Events tagged by their type; a value belongs to purchases and errors, in one shared column.
EVENT_KIND = EmbedEnum("EventKind", (Variant("View", "view"), Variant("Signup", "signup"), Variant("Purchase", "purchase"), Variant("Error", "error"), Variant("Click", "click")))


def registry() -> Registry:
    return Registry(
        Model("Region", "region", (
            F("regionkey", "i32", "r_regionkey"), F("name", "string", "r_name", unique=True),
            HasMany("nations", "Nation", "region"), Via("customers", ("nations", "customers")), Via("orders", ("customers", "orders")),
            Via("priorities", ("customers", "orders", "orderpriority")),
        ), ("regionkey",)),
        Model("Nation", "nation", (
            F("nationkey", "i32", "n_nationkey"), F("name", "string", "n_name", unique=True), F("regionkey", "i32", "n_regionkey", index=True),
            BelongsTo("region", "Region", {"regionkey": "regionkey"}), HasMany("customers", "Customer", "nation"), HasMany("suppliers", "Supplier", "nation"),
        ), ("nationkey",)),
        Model("Customer", "customer", (
            F("custkey", "i64", "c_custkey"), F("name", "string", "c_name", index=True), F("nationkey", "i32", "c_nationkey", index=True),
            F("acctbal", "f64", "c_acctbal"), F("mktsegment", "string", "c_mktsegment", index=True),
            BelongsTo("nation", "Nation", {"nationkey": "nationkey"}), HasMany("orders", "Order", "customer"), HasMany("events", "Event", "customer"),
        ), ("custkey",)),
        Model("Supplier", "supplier", (
            F("suppkey", "i64", "s_suppkey"), F("name", "string", "s_name"), F("nationkey", "i32", "s_nationkey", index=True), F("acctbal", "f64", "s_acctbal"),
            BelongsTo("nation", "Nation", {"nationkey": "nationkey"}), HasMany("lineitems", "Lineitem", "supplier"), Via("parts", ("lineitems", "part")),
        ), ("suppkey",)),
        Model("Part", "part", (
            F("partkey", "i64", "p_partkey"), F("name", "string", "p_name"), F("brand", "string", "p_brand", index=True), F("type", "string", "p_type"),
            F("size", "i32", "p_size"), F("retailprice", "f64", "p_retailprice"),
            HasMany("lineitems", "Lineitem", "part"), Via("suppliers", ("lineitems", "supplier")),
        ), ("partkey",), (Index(("brand", "size")),)),
        Model("Order", "orders", (
            F("orderkey", "i64", "o_orderkey"), F("custkey", "i64", "o_custkey", index=True), F("status", "string", "o_orderstatus"),
            F("totalprice", "f64", "o_totalprice"), F("orderdate", "datetime", "o_orderdate"), F("orderpriority", "string", "o_orderpriority"),
            BelongsTo("customer", "Customer", {"custkey": "custkey"}), HasMany("lineitems", "Lineitem", "order"),
        ), ("orderkey",)),
        Model("Lineitem", "lineitem", (
            F("orderkey", "i64", "l_orderkey", index=True), F("partkey", "i64", "l_partkey", index=True), F("suppkey", "i64", "l_suppkey", index=True),
            F("linenumber", "i32", "l_linenumber"), F("quantity", "f64", "l_quantity"), F("extendedprice", "f64", "l_extendedprice"),
            F("discount", "f64", "l_discount"), F("tax", "f64", "l_tax"), F("returnflag", "string", "l_returnflag"), F("linestatus", "string", "l_linestatus"),
            F("shipdate", "datetime", "l_shipdate"),
            BelongsTo("order", "Order", {"orderkey": "orderkey"}), BelongsTo("part", "Part", {"partkey": "partkey"}), BelongsTo("supplier", "Supplier", {"suppkey": "suppkey"}),
        ), ("orderkey", "linenumber", "partkey", "suppkey")),
        Model("Event", "events", (
            F("event_id", "i64"), F("ts", "datetime"), F("user_id", "i64", index=True), Embedded("kind", EVENT_KIND, column="event_type"), F("value", "f64"),
            Document("props", PROPS), BelongsTo("customer", "Customer", {"user_id": "custkey"}),
        ), ("event_id",)),
        Model("Document", "documents", (
            F("doc_id", "i64"), F("text", "string", deferred=True), F("lang", "string", index=True), F("source", "string"), F("n_chars", "i64"),
            HasOne("label", "Label", "document"),
        ), ("doc_id",)),
        Model("Label", "labels", (
            F("doc_id", "i64"), F("quality", "i32"), F("toxic", "i32"), BelongsTo("document", "Document", {"doc_id": "doc_id"}),
        ), ("doc_id",)),
        Model("Embedding", "embeddings", (F("vec_id", "i64"), F("embedding", "list<f32>"), F("label", "i32", index=True)), ("vec_id",)),
        Model("Turn", "conversations", (F("conv_id", "i64"), F("turn", "i64"), F("role", "string"), F("text", "string")), ("conv_id", "turn")),
        Model("Page", "pages", (F("page_id", "i64"), F("url", "string"), F("html", "string", deferred=True)), ("page_id",)),
    )


def mutable() -> Registry:
    """Region to nation to customer as tables to change: nullable links, versions, defaults."""
    return Registry(
        Model("Nation", "nation", (
            F("nationkey", "i32", "n_nationkey"), F("name", "string", "n_name", unique=True, max_length=40), F("regionkey", "i32", "n_regionkey"),
            HasMany("customers", "Customer", "nation"), HasMany("suppliers", "Supplier", "nation"),
        ), ("nationkey",)),
        Model("Customer", "customer", (
            F("custkey", "i64", "c_custkey"), F("name", "string", "c_name"), F("nationkey", "i32", "c_nationkey"), F("acctbal", "f64", "c_acctbal"), F("mktsegment", "string", "c_mktsegment"),
            BelongsTo("nation", "Nation", {"nationkey": "nationkey"}),
        ), ("custkey",)),
        Model("Supplier", "supplier", (
            F("suppkey", "i64", "s_suppkey"), F("name", "string", "s_name"), F("nationkey", "i32", "s_nationkey", nullable=True), F("acctbal", "f64", "s_acctbal"),
            BelongsTo("nation", "Nation", {"nationkey": "nationkey"}, nullable=True),
        ), ("suppkey",)),
    )
