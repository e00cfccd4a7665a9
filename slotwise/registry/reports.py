"""Reports and page computations by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.plans import anomaly, city, forecast, heatmap, quality, speed, trend, weather
from slotwise.registry.base import AS_OF, DAYS, HOURS, register
from slotwise.sources.tables import FrameTables


def _windowed(report, digits: int | None = None, name: str | None = None, days: int = DAYS, **options):
    register(name or report.__name__, lambda src: report(src, AS_OF, days, **options), digits)


def _today(report):
    register(report.__name__, lambda src: report(src, AS_OF))


def _hourly(name: str, build: Callable[[DataFrame], DataFrame], digits: int = 6):
    register(name, lambda src: build(heatmap.heatmap_hourly(src, AS_OF, DAYS)), digits)


for _report in (
    city.traffic_events, city.rush_offpeak, heatmap.heatmap_hourly, forecast.predictions,
    forecast.forecast_frame, city.city_kpi,
    city.top_congestion, city.dow_profile, speed.flow_speed_trend, speed.speed_bins, speed.hourly_pattern,
    weather.weather_impact, forecast.ml_performance, forecast.ml_accuracy, city.operations_kpi,
    city.congestion_by_district, speed.speed_distribution, city.traffic_scatter, weather.weather_summary,
    weather.weather_scatter, weather.weather_hourly, forecast.prediction_trend,
):
    _windowed(_report)
for _report in (anomaly.anomalies, quality.camera_quality, quality.data_freshness, city.city_status, anomaly.incidents_summary):
    _today(_report)
register("prediction_risk", lambda src: forecast.prediction_risk(src, AS_OF, HOURS))
register("prediction_congestion", lambda src: forecast.prediction_congestion(src, AS_OF, HOURS))
register("hot_humid_speed", weather.hot_humid_speed, 6)
register("unnest_series", lambda src: src.samples())
register("weather_condition_agg", weather.weather_condition_agg, 6)
register("rain_rows", weather.rain_rows)

# Overview page
for _report in (city.kpi_overview, city.map_points, city.top_busiest, city.top_slowest, city.district_summary,
                city.rush_pivot, city.speed_shares):
    _windowed(_report, 6)
_windowed(city.kpi_delta, 6, days=15)

# Heat-map page
_hourly("district_top5", heatmap.busiest_districts)
_hourly("district_options", heatmap.district_options)
_hourly("heat_district_hour", heatmap.district_by_hour)
_hourly("heat_district_hour_wide", heatmap.district_by_hour_wide)
_hourly("heat_camera_hour", heatmap.camera_by_hour)
_hourly("dow_stack_other", heatmap.weekday_stack)
_hourly("dow_pattern", heatmap.weekday_pattern)
_hourly("weekday_weekend", heatmap.weekday_weekend)

# Speed page
_windowed(speed.slowest_districts, 6, "district_slowest5")
_windowed(speed.speed_kpi, 6)
_windowed(speed.speed_histogram, 6)
_windowed(speed.speed_heat, 6)
_windowed(speed.congestion_index, 6)
_windowed(speed.speed_smoothed, 6, "speed_ma3")
_windowed(speed.suspicious_districts, 6, "suspicious_district")

# Weather page
for _report in (weather.weather_kpi, weather.weather_stats, weather.weather_district, weather.weather_district_wide,
                weather.temp_vs_traffic, weather.humidity_scaled):
    _windowed(_report, 6)

# Trend page
_windowed(trend.trend_kpi, 6)
_windowed(trend.daily_volume, 6)
_windowed(trend.weekday_box, 6, "dow_box")
_windowed(trend.rolling_week, 6, "rolling_ma7")
register(
    "mom_growth",
    lambda src: trend.month_growth(src.table("orders").withColumn("price", F.floor("o_totalprice").cast("double")), "o_orderdate", "price"),
    6,
)


def _over_three_months(src) -> FrameTables:
    """The slots moved to one of three months by their day, as the events span one alone."""
    moved = src.events().withColumn("slot", F.expr("slot - make_ym_interval(0, day(slot) % 3)"))
    return FrameTables(moved, src.cameras())


register("traffic_month_growth", lambda src: trend.traffic_month_growth(_over_three_months(src), AS_OF), 6)
_windowed(trend.completeness, 6)
_windowed(trend.completeness_days, 6)
