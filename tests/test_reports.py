from datetime import datetime, timedelta

import pytest
from helpers import at, cameras, dicts, events, tables
from pyspark.sql import functions as F

from slotwise.operators.calendar import fill_calendar
from slotwise.operators import quantiles
from slotwise.operators.quantiles import exact_quantiles
from slotwise.operators.ranking import latest_slots
from slotwise.plans import anomaly, city, forecast, quality, speed, trend, weather
from slotwise.sources.tables import FrameTables

NOON = datetime(2024, 1, 10, 12, 0, 0)


def test_null_speed_is_in_the_else_bin_but_in_no_page_range(spark):
    src = tables(spark, [("a", "2024-01-10 10:00:00", 5.0, None)])
    assert [(r["speed_bin"], r["event_count"]) for r in dicts(speed.speed_bins(src, NOON))] == [("50+", 1)]
    assert [r["speed_category"] for r in dicts(speed.speed_distribution(src, NOON))] == ["Thông thoáng (>50)"]
    assert sum(r["slots"] for r in dicts(city.speed_shares(src, NOON))) == 0


def test_idle_cameras_stay(spark):
    src = tables(spark, [("a", "2024-01-10 10:00:00", 5.0, 10.0)], [("a", "d1"), ("idle", "d1")])
    rows = dicts(quality.data_freshness(src, NOON))
    assert [(r["camera_id"], r["slots_today"], r["last_event"]) for r in rows] == [
        ("idle", 0, None), ("a", 1, at("2024-01-10 10:00:00"))]
    status = dicts(city.city_status(src, NOON))[0]
    assert (status["total_cams"], status["active_cams"], status["congestion_pct"]) == (2, 1, 50.0)


def spread(camera, values, day="2024-01-09"):
    return [(camera, f"{day} {h:02d}:00:00", v, 30.0) for h, v in enumerate(values)]


def test_z_scores_are_strict_and_need_a_deviation(spark):
    # Mean 10 and sample deviation exactly 1 for "v"; none for "flat" and "single".
    steady = [9.0, 11.0] * 2 + [10.0]
    rows = spread("v", steady) + spread("flat", [10.0, 10.0]) + spread("single", [10.0])
    today = [("v", "2024-01-10 01:00:00", 13.0, 30.0), ("v", "2024-01-10 02:00:00", 13.5, 30.0),
             ("v", "2024-01-10 03:00:00", 6.5, 30.0), ("v", "2024-01-10 04:00:00", 14.0, 10.0),
             ("flat", "2024-01-10 01:00:00", 99.0, 30.0), ("single", "2024-01-10 01:00:00", 99.0, 14.0),
             ("new", "2024-01-10 01:00:00", 99.0, 1.0)]
    src = tables(spark, rows + today, [(c, "d") for c in ("v", "flat", "single", "new")])
    z = {(r["camera_id"], r["slot"].hour): r["z_score"] for r in dicts(anomaly.with_baseline(src, NOON))}
    assert z[("v", 1)] == pytest.approx(3.0) and z[("flat", 1)] is None and z[("single", 1)] is None
    found = [(r["camera_id"], r["slot"].hour, r["alert_type"]) for r in dicts(anomaly.anomalies(src, NOON))]
    assert found == [("v", 4, "Sudden Spike"), ("v", 3, "Sudden Drop"), ("v", 2, "Sudden Spike"), ("single", 1, "Congestion")]
    summary = dicts(anomaly.incidents_summary(src, NOON))[0]
    assert (summary["congested_cams"], summary["sudden_drop_cams"], summary["sudden_spike_cams"]) == (2, 1, 1)


def test_short_forecasts_and_zero_actuals(spark):
    src = tables(
        spark,
        [("a", "2024-01-10 01:00:00", 0.0, 20.0), ("a", "2024-01-10 02:00:00", 10.0, 20.0)],
        [("a", "d")],
        [("a", "2024-01-10 01:00:00", [5.0], [30.0]), ("a", "2024-01-10 02:00:00", [5.0], [30.0])],
    )
    assert dicts(forecast.ml_accuracy(src, NOON))[0]["mape_count"] == 50.0
    first = dicts(forecast.prediction_trend(src, NOON))[0]
    assert (first["pred_speed_t1"], first["pred_speed_t7"], first["pred_speed_t12"]) == (30.0, None, None)


def test_moving_mean_uses_neighbouring_rows(spark):
    src = tables(spark, [("a", f"2024-01-10 {h:02d}:00:00", 1.0, v) for h, v in ((1, 10.0), (2, 20.0), (5, 60.0))])
    got = [(r["hour"], r["speed_ma3"]) for r in dicts(speed.speed_smoothed(src, NOON))]
    assert got == [(1, 15.0), (2, 30.0), (5, 40.0)]


def test_missing_day_is_kept_and_skipped(spark):
    src = tables(spark, [("a", f"2024-01-0{d} 01:00:00", float(d), 20.0) for d in (5, 6, 8)])
    rows = dicts(trend.rolling_week(src, NOON))
    assert [(r["day"].day, r["daily_total"]) for r in rows] == [(5, 5.0), (6, 6.0), (7, None), (8, 8.0)]
    assert rows[2]["ma7"] == pytest.approx(19 / 3)
    assert dicts(trend.completeness(src, NOON))[0] == {
        "expected_days": 4, "present_days": 3, "missing_days": 1, "complete_pct": 75.0}
    volume = dicts(trend.daily_volume(src, NOON))
    assert [(r["day"].day, r["total_vehicles"], r["day_is_empty"]) for r in volume] == [
        (5, 5.0, False), (6, 6.0, False), (7, 0.0, True), (8, 8.0, False)]
    wide = dicts(trend.daily_volume_wide(src, NOON, 30, ["d1", "d2"]))
    assert [(r["d1"], r["d2"]) for r in wide] == [(5.0, 0.0), (6.0, 0.0), (0.0, 0.0), (8.0, 0.0)]


def test_calendar_of_nothing_is_empty(spark):
    assert fill_calendar(spark.createDataFrame([], "day date, v double")).count() == 0


def test_month_growth_needs_two_months(spark):
    rows = [(at("2024-01-05"), 10.0), (at("2024-01-06"), 10.0), (at("2024-03-01"), 30.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    assert dicts(trend.month_growth(df, "t", "v")) == [{"month": "2024-03", "total": 30.0, "growth_pct": 50.0}]
    assert trend.month_growth(df.limit(2), "t", "v").count() == 0


def test_peak_day_is_the_earliest_on_ties(spark):
    src = tables(spark, [("a", f"2024-01-0{d} 01:00:00", 7.0, 20.0) for d in (6, 5, 8)])
    assert dicts(trend.trend_kpi(src, NOON))[0]["peak_day"].day == 5


def test_previous_window_overlaps_and_ends_at_the_newest_slot(spark):
    src = tables(spark, [("a", "2024-01-08 13:00:00", 10.0, 10.0), ("a", "2024-01-09 13:00:00", 20.0, 20.0),
                         ("a", "2024-01-10 11:00:00", 60.0, 60.0)])
    row = dicts(city.kpi_delta(src, NOON, days=1))[0]
    assert (row["avg_vehicles"], row["prev_vehicles"], row["delta_vehicles"]) == (40.0, 15.0, 25.0)


def test_commonest_weather_is_the_first_by_name_on_ties(spark):
    src = tables(spark, [("a", "2024-01-10 01:00:00", 1.0, 1.0, "Rain"), ("a", "2024-01-10 02:00:00", 3.0, 5.0, "Clear"),
                         ("a", "2024-01-10 03:00:00", 9.0, 5.0, None)])
    row = dicts(weather.weather_kpi(src, NOON))[0]
    assert (row["most_common"], row["vehicles_diff"], row["speed_diff"]) == ("Clear", -2.0, -4.0)
    empty = dicts(weather.weather_kpi(src, NOON, chosen=["Snow"]))[0]
    assert (empty["most_common"], empty["rain_vehicles"]) == ("N/A", 0.0)


def test_null_keys_are_groups_in_sql_reports_and_dropped_on_pages(spark):
    src = tables(spark, [("a", "2024-01-10 01:00:00", 1.0, 1.0, None)], [("a", None)])
    assert dicts(weather.weather_summary(src, NOON))[0]["weather"] is None
    assert weather.weather_stats(src, NOON).count() == 0
    assert dicts(city.rush_offpeak(src, NOON))[0]["district"] is None
    assert city.rush_pivot(src, NOON).count() == 0


def test_suspicious_needs_fast_and_steady(spark):
    rows = [("a", f"2024-01-10 0{h}:00:00", 1.0, 40.0 + h % 2) for h in range(4)]
    rows += [("b", f"2024-01-10 0{h}:00:00", 1.0, 40.0 + 10 * (h % 2)) for h in range(4)]
    rows += [("c", "2024-01-10 01:00:00", 1.0, 40.0)]
    src = tables(spark, rows, [("a", "da"), ("b", "db"), ("c", "dc")])
    assert [(r["district"], r["is_suspicious"]) for r in dicts(speed.suspicious_districts(src, NOON))] == [
        ("da", True), ("db", False), ("dc", False)]


def test_quantiles_are_exact(spark):
    df = spark.range(1000).select(
        (F.col("id") % 2).alias("g"), (F.when(F.col("id") < 400, F.lit(3.0)).otherwise((F.col("id") * 7919 % 1009) / 4 - 50)).alias("v"))
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = {(r["g"], p): q for r in dicts(df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")))
            for p, q in zip(probs, r["q"])}
    got = {(r["g"], r["prob"]): r["quantile"] for r in dicts(exact_quantiles(df, "v", probs, ["g"]))}
    assert got == pytest.approx(want)
    weighted = df.groupBy("v").agg(F.count("*").alias("n"))
    alone = dicts(exact_quantiles(weighted, "v", [0.05], weight="n"))
    assert alone[0]["quantile"] == pytest.approx(dicts(df.agg(F.percentile("v", F.lit(0.05)).alias("q")))[0]["q"])
    assert exact_quantiles(df.where("false"), "v", [0.5]).count() == 0


@pytest.mark.parametrize("few", [quantiles.FEW, 0])
def test_quantiles_of_values_that_lie_close_or_far_apart(spark, monkeypatch, few):
    import numpy as np

    monkeypatch.setattr(quantiles, "FEW", few)

    rng = np.random.default_rng(3)
    close = 30.0 + rng.integers(0, 4000, 3000) * 1e-13
    far = np.concatenate([10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-300, 300, 500)), [0.0, -0.0, 5e-324, -5e-324]])
    for values in (close, far, np.array([7.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = {r["prob"]: r["quantile"] for r in dicts(exact_quantiles(df, "v", [0.0, 0.05, 0.5, 0.999, 1.0]))}
        ordered = np.sort(values)
        for prob, found in got.items():
            low, high = ordered[int(np.floor(prob * (len(values) - 1)))], ordered[int(np.ceil(prob * (len(values) - 1)))]
            assert low <= found <= high
            if low == high:
                assert found == low


def test_quantile_passes_follow_what_the_brackets_hold(spark, monkeypatch):
    passes, written = [], []
    bracketed, folder = quantiles._bracketed, quantiles.fresh_dir
    monkeypatch.setattr(quantiles, "_bracketed", lambda *a, **k: passes.append(a[2]) or bracketed(*a, **k))
    monkeypatch.setattr(quantiles, "fresh_dir", lambda *a: written.append(1) or folder(*a))

    def run(df):
        passes.clear(), written.clear()
        got = {r["prob"]: r["quantile"] for r in dicts(exact_quantiles(df, "v", [0.25, 0.9], weight="n"))}
        return got, list(passes), len(written)

    whole = spark.range(2000).select((F.col("id") % 100).cast("double").alias("v"), (F.col("id") % 3).alias("n"))
    fine = spark.range(2000).select((F.lit(40.0) + F.col("id") * 1e-9).alias("v"), F.lit(2).alias("n"))
    assert run(whole)[1:] == ([40], 0)
    bracket, passed, writes = run(fine)
    assert (passed, writes) == ([40, 0], 0)
    monkeypatch.setattr(quantiles, "FEW", 100)
    narrowed, passed, writes = run(fine)
    assert (passed, writes, narrowed) == ([40, 20, 0], 1, bracket)
    every = fine.unionByName(fine).agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.9))).alias("q"))
    assert list(bracket.values()) == pytest.approx(dicts(every)[0]["q"], abs=1e-12)


def test_month_growth_over_two_months(spark):
    src = tables(spark, [("a", "2023-12-30 01:00:00", 100.0, 1.0), ("a", "2024-01-02 01:00:00", 50.0, 1.0),
                         ("a", "2024-01-09 01:00:00", 70.0, 1.0)], [("a", "d")])
    got = dicts(trend.traffic_month_growth(src, NOON))
    assert [(r["month"], r["total"], r["growth_pct"]) for r in got] == [("2024-01", 120.0, pytest.approx(20.0))]


def test_deviation_of_large_steady_values(spark):
    rows = [("a", f"2024-01-09 {h:02d}:00:00", 1e9 + h % 2, 1e8 + h % 2) for h in range(10)]
    src = tables(spark, rows, [("a", "d")])
    assert dicts(trend.weekday_box(src, NOON))[0]["sd"] == pytest.approx(0.527046, abs=1e-4)


def test_latest_slots(spark):
    rows = [("a", f"2024-01-10 01:{5 * i:02d}:00", float(i), 1.0) for i in range(6)] + [("b", "2024-01-09 01:00:00", 1.0, 1.0)]
    got = latest_slots(events(spark, rows), 2)
    assert sorted((r["camera_id"], r["vehicles_count"]) for r in dicts(got)) == [("a", 4.0), ("a", 5.0), ("b", 1.0)]


def test_window_end_is_exclusive(spark):
    src = FrameTables(
        events(spark, [("a", "2024-01-09 12:00:00", 1.0, 1.0), ("a", "2024-01-10 12:00:00", 1.0, 1.0)]), cameras(spark, [("a", "d")]))
    assert dicts(city.traffic_events(src, NOON).select("slot")) == [{"slot": NOON - timedelta(days=1)}]
