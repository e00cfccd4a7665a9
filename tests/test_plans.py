"""The physical plans the jobs are written for."""

import re
from datetime import datetime

import pytest
from helpers import cameras, events

from slotwise.operators.ranking import latest_slots
from slotwise.plans import city, forecast, heatmap
from slotwise.registry import AS_OF, QUERIES
from slotwise.sources import sinks
from slotwise.sources.driver_tables import DriverTables
from slotwise.sources.tables import FrameTables, StoredTables

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    src = DriverTables(spark, SF)
    tables = StoredTables(spark, str(tmp_path_factory.mktemp("tables")))
    sinks.write_events(src.events(series=True), tables.root)
    sinks.write_cameras(src.cameras(), tables.root)
    sinks.write_predicts(src.predicts(), tables.root)
    return tables


def test_stored_scan_prunes_days_and_columns(stored):
    text = plan(stored.events(datetime(2024, 1, 5), datetime(2024, 1, 6)).select("camera_id", "weather.main"))
    assert re.search(r"PartitionFilters: \[[^]]*dt[^]]*>=[^]]*dt[^]]*<=", text)
    assert "GreaterThanOrEqual(slot" in text and "LessThan(slot" in text
    assert "ReadSchema: struct<camera_id:string,slot:timestamp_ntz,weather:struct<main:string>>" in text


def test_raw_scan_gets_the_slot_bounds(spark):
    text = plan(DriverTables(spark, SF).events(datetime(2024, 1, 5, 0, 2), datetime(2024, 1, 6)).select("vehicles_count"))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:05)" in text and "LessThan(ts,2024-01-06T00:00)" in text
    assert "collect_list" not in text


def test_small_cameras_are_broadcast_and_large_ones_are_not(spark, stored):
    assert "BroadcastHashJoin" in plan(city.traffic_events(stored, AS_OF, 30))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        src = FrameTables(events(spark, [("a", "2024-01-30 01:00:00", 1.0, 1.0)]), cameras(spark, [("a", "d")]))
        assert "SortMergeJoin" in plan(city.traffic_events(src, AS_OF, 30))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_forecast_join_reads_only_the_window(stored):
    text = plan(forecast.ml_performance(stored, AS_OF, 1))
    assert text.count("GreaterThanOrEqual(slot") >= 2


def test_latest_slots_are_cut_before_the_shuffle(stored):
    text = plan(latest_slots(stored.events(), 5))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_top_k_does_not_sort_everything(stored):
    assert "TakeOrderedAndProject" in plan(city.top_congestion(stored, AS_OF, 30))


def test_heat_map_shuffles_slots_once(stored):
    text = plan(heatmap.heatmap_hourly(stored, AS_OF, 30))
    assert text.count("Exchange hashpartitioning") == 1


def test_no_distinct_count_expands_rows(stored):
    for report in (city.operations_kpi, city.city_kpi, city.kpi_overview, city.dow_profile):
        assert "Expand" not in plan(report(stored, AS_OF, 30))
    assert "Expand" not in plan(city.city_status(stored, AS_OF))


BATCH = [n for n in QUERIES if not n.startswith(("stream_", "src_", "sink_"))]


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin", text)
