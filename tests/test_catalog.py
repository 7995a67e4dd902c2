"""Every query of the catalog against its SQL, and plans that must stay as they are."""

import pytest
from oracle import SF, assert_same, connect
from pyspark.sql import functions as F

from incidara.plans import bindings, catalog, flows  # noqa: F401


@pytest.fixture(scope="module")
def con():
    return connect()


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert_same(spark, con, catalog.QUERIES[name], catalog.SQL[name])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    events = bindings.table(spark, SF, "events")
    plan = _plan(events.filter((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & F.col("event_type").isin("view", "click")).select("user_id"))
    assert "GreaterThanOrEqual(ts" in plan and "In(event_type" in plan and "props" not in plan


def test_point_join_is_on_cells(spark):
    plan = _plan(catalog.QUERIES["point_in_polygon"](spark, SF))
    assert "cell_x" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_topk_and_latest_row_need_no_full_sort(spark):
    assert "TakeOrderedAndProject" in _plan(catalog.QUERIES["recent_points_topk"](spark, SF))
    assert "WindowGroupLimit" in _plan(catalog.QUERIES["latest_per_event"](spark, SF))


def test_rows_of_an_event_are_dealt_once(spark):
    from incidara.operators import response

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(catalog.QUERIES["response_rollup"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    above, _, below = plan.partition("SortMergeJoin [cast(l_orderkey")
    assert below and "Aggregate" in above and "Exchange" not in above
    rows = bindings.calls(spark, SF).limit(50).collect()
    calls = spark.createDataFrame(rows, bindings.calls(spark, SF).schema)
    above, _, below = _plan(response.event_response(calls, bindings.CALL_ROLES)).partition("Exchange hashpartitioning(event_id")
    assert "partial_min_by" in above and "Aggregate" not in below and "Exchange" not in below


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
