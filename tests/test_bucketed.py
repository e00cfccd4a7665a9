"""Bucketed slot facts: same rows, no shuffle between them."""

import re

import pytest
from helpers import at, dicts, events, predicts

from slotwise.plans import forecast
from slotwise.registry import AS_OF
from slotwise.sources import sinks
from slotwise.sources.bucketed import BucketedTables
from slotwise.sources.driver_tables import DriverTables
from slotwise.sources.tables import StoredTables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    src = DriverTables(spark, SF)
    root = str(tmp_path_factory.mktemp("bucketed"))
    plain, bucketed = StoredTables(spark, root), BucketedTables(spark, root, 4)
    sinks.write_cameras(src.cameras(), root)
    sinks.write_events(src.events(), root)
    sinks.write_predicts(src.predicts(), root)
    bucketed.write("events", src.events())
    bucketed.write("predicts", src.predicts())
    return plain, bucketed


def join_inputs(df):
    """The plan below the first sort-merge join."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("SortMergeJoin"):]


@pytest.mark.parametrize("report", [forecast.predictions, forecast.ml_performance, forecast.ml_accuracy, forecast.prediction_trend])
def test_fact_meets_fact_without_a_shuffle(spark, both, report):
    plain, bucketed = both
    assert sorted(map(str, dicts(report(bucketed, AS_OF, 30)))) == sorted(map(str, dicts(report(plain, AS_OF, 30))))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if "SortMergeJoin" in plain_text(report(plain, AS_OF, 30)):
            facts = forecast._paired(bucketed, AS_OF, 30)
            assert "Exchange" not in join_inputs(facts) and "Bucketed: true" in join_inputs(facts)
            assert "Exchange" in join_inputs(forecast._paired(plain, AS_OF, 30))
            pair = re.search(r"SortMergeJoin \[camera_id#\d+, slot#\d+\](?s:.*)", plain_text(report(bucketed, AS_OF, 30)))
            if pair:
                scans = [m.start() for m in re.finditer("Scan parquet", pair.group())][:2]
                assert "Exchange" not in pair.group()[: scans[1]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plain_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_are_replaced_and_another_session_reads_them(spark, tmp_path):
    root = str(tmp_path / "t")
    tables = BucketedTables(spark, root, 4)
    tables.write("events", events(spark, [("a", "2024-01-01 00:00:00", 1.0, 1.0), ("b", "2024-01-02 00:00:00", 2.0, 2.0)]))
    tables.write("events", events(spark, [("c", "2024-01-02 00:05:00", 3.0, 3.0)]))
    tables.write("predicts", predicts(spark, [("a", "2024-01-01 00:00:00", [1.0], [1.0])]))
    other = spark.newSession()
    for session in (spark, other):
        again = BucketedTables(session, root, 4)
        assert sorted((r.camera_id, r.vehicles_count) for r in again.events().collect()) == [("a", 1.0), ("c", 3.0)]
        assert again.events(at("2024-01-02 00:00:00")).count() == 1 and again.predicts().count() == 1
    spark.sql(f"DROP TABLE {tables._table('events')}")  # the entry goes, the files stay
    assert BucketedTables(spark, root, 4).events().count() == 2
    text = plain_text(tables.events(at("2024-01-02 00:00:00"), at("2024-01-03 00:00:00")).select("camera_id"))
    assert re.search(r"PartitionFilters: \[[^]]*dt", text) and "ReadSchema: struct<camera_id:string,slot:timestamp_ntz>" in text
