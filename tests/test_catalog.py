"""Every query of the catalog against DuckDB."""

import pytest

from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows_as_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name])


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize(
    ("name", "wanted", "unwanted"),
    [
        ("order_limit", ["TakeOrderedAndProject", "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)]"], []),
        ("page_after", ["TakeOrderedAndProject", "GreaterThanOrEqual(o_orderdate"], ["CartesianProduct"]),
        ("rel_any", ["LeftSemi"], ["CartesianProduct", "BroadcastNestedLoopJoin"]),
        ("rel_all_vacuous", ["LeftAnti"], ["BroadcastNestedLoopJoin"]),
        ("rel_pinned_key", ["EqualTo(o_custkey,7)"], ["Join"]),
        ("filter_in_long", ["LeftSemi"], []),
        ("include_nested", ["ObjectHashAggregate", "LeftOuter"], ["CartesianProduct"]),
        ("page_include", ["LeftSemi", "LeftOuter", "TakeOrderedAndProject"], ["CartesianProduct"]),
        ("select_tuple", ["ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>"], ["Exchange"]),
    ],
)
def test_plans(name, wanted, unwanted, spark, sf_dir):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    for w in wanted:
        assert w in text
    for u in unwanted:
        assert u not in text


def test_no_python_in_plans(spark, sf_dir):
    for name, f in catalog.QUERIES.items():
        text = plan(f(spark, sf_dir))
        assert not any(x in text for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas")), name
