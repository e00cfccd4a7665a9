import random
import re
from datetime import timedelta

import pytest
from helpers import at, dicts
from pyspark.sql import functions as F

from slotwise import schemas
from slotwise.operators import series
from slotwise.operators.series import children_of, counter_rate, counter_rates, matches, series_text, sum_by, sustained
from slotwise.plans import alerts
from slotwise.sources.tables import FrameTables

# Samples as they come in, without a stored series key.
UNKEYED = schemas.T.StructType([f for f in schemas.METRICS.fields if f.name != "series"])
START = at("2024-01-01 05:50:00")


def metric(spark, rows, name="m"):
    """Rows of (seconds, labels, value)."""
    return spark.createDataFrame([(START + timedelta(seconds=s), name, l, float(v)) for s, l, v in rows], UNKEYED)


def breaches(spark, *patterns, step=15):
    """One series per pattern, named after it; ``x`` is a breach."""
    rows = [(p, START + timedelta(seconds=i * step), float(i), c == "x") for p in patterns for i, c in enumerate(p)]
    return spark.createDataFrame(rows, "series string, ts timestamp_ntz, value double, breach boolean")


@pytest.mark.parametrize("panes", [(15,), (60, 240), (60, 6 * 3600), (15, 45, 135, 405)])
def test_only_an_unbroken_breach_of_the_full_length_fires(spark, panes):
    # 4 min 45 s, then 5 min 0 s
    pattern = "." + "x" * 20 + "." + "x" * 21 + "."
    got = dicts(sustained(breaches(spark, pattern), ["series"], F.lit(300), panes))
    assert [(r["samples"], r["value"], r["to_ts"] - r["from_ts"]) for r in got] == [(21, 42.0, timedelta(minutes=5))]


@pytest.mark.parametrize("panes", [(15,), (45,), (15, 45, 90), (30, 60, 120, 240), (60, 6 * 3600)])
def test_runs_do_not_depend_on_the_panes(spark, panes):
    patterns = ["xxxx", "x..x", ".xx.xxx.x", "....", "xx......xx", "x.x.x.xx", "xxxxxxx.xxxxx"]
    want = sorted((p, len(run)) for p in patterns for run in p.split(".") if run)
    got = dicts(sustained(breaches(spark, *patterns), ["series"], F.lit(0), panes))
    assert sorted((r["series"], r["samples"]) for r in got) == want


def test_counter_reset_never_gives_a_negative_increase(spark):
    rows = [(0, {"a": "1"}, 10), (60, {"a": "1"}, 20), (120, {"a": "1"}, 5), (180, {"a": "1"}, 15)]
    got = dicts(counter_rate(metric(spark, rows), 180).orderBy("ts"))
    assert [None if r["rate"] is None else r["rate"] * 180 for r in got] == [None, 10.0, 15.0, 25.0]


@pytest.mark.parametrize("panes", [1, 2, 4, 7, 60])
def test_rates_do_not_depend_on_the_panes(spark, panes):
    rows = [(i * 37, {"a": str(i % 2)}, (i * i * 13) % 400) for i in range(60)]
    want = []
    for i, (second, labels, _) in enumerate(rows):
        inside = [v for s, l, v in rows[: i + 1] if l == labels and s >= second - 120]
        steps = [b - a if b >= a else b for a, b in zip(inside, inside[1:])]
        want.append(sum(steps) / 120 if len(inside) >= 2 else None)
    got = [r["rate"] for r in dicts(counter_rate(metric(spark, rows), 120, panes, 1).orderBy("ts"))]
    assert got == pytest.approx(want)


def test_label_selectors(spark):
    samples = metric(spark, [(0, {"a": "xy", "b": "1"}, 1), (0, {"a": "x"}, 2), (0, {"b": "1"}, 4)])

    def total(**selector):
        return dicts(samples.where(matches(selector)).agg(F.sum("value").alias("v")))[0]["v"]

    assert total(a=("=", "x")) == 2 and total(a=("=~", "x")) == 2 and total(a=("=~", "x.*")) == 3
    assert total(a=("!~", "x")) == 5 and total(a=("!=", "x")) == 5 and total(a=("=", "")) == 4
    assert [r["s"] for r in dicts(samples.select(series_text().alias("s")))] == ["a=xy,b=1", "a=x", "b=1"]
    assert {(r["b"], r["value"]) for r in dicts(sum_by(samples, "b"))} == {("1", 5.0), ("", 2.0)}


def test_children_of_a_group(spark):
    parents = metric(spark, [(0, {"component_id": "p1"}, 1)])
    parts = metric(spark, [(0, {"parent_id": "p1", "n": "in"}, 1), (0, {"parent_id": "p2", "n": "out"}, 1), (0, {"n": "none"}, 1)])
    assert [r["labels"]["n"] for r in dicts(children_of(parts, parents))] == ["in"]


def fired(spark, name, rows):
    src = FrameTables(metrics=metric(spark, rows, name))
    return {(r["rule"], r["samples"]) for r in dicts(alerts.alert_table(src))}


def test_rules(spark):
    steps = [i * 15 for i in range(61)]
    assert fired(spark, "nifi_jvm_heap_usage", [(s, {}, 0.95) for s in steps]) == {
        ("NiFiHighHeapUsage", 61), ("NiFiCriticalHeapUsage", 61)}
    group = {"component_type": "ProcessGroup", "component_name": "AI"}
    # Flat for 15 minutes; the first sample has no rate, so one more is needed.
    assert fired(spark, "nifi_amount_flowfiles_sent", [(s, group, 7) for s in steps]) == set()
    assert fired(spark, "nifi_amount_flowfiles_sent", [(s, group, 7) for s in steps + [915]]) == {("NiFiPipelineStalled", 61)}
    assert fired(spark, "nifi_amount_flowfiles_sent", [(s, {**group, "component_name": "other"}, 7) for s in steps + [915]]) == set()
    # Half an idle second per second on one processor and none on the other: 75 % busy.
    cpu = [(s, {"instance": "h", "mode": "idle", "cpu": c}, s * 0.5 * (c == "0")) for s in steps for c in "01"]
    assert fired(spark, "node_cpu_seconds_total", cpu) == set()
    busy = [(s, {"instance": "h", "mode": "idle", "cpu": "0"}, s * 0.125) for s in steps]
    assert fired(spark, "node_cpu_seconds_total", busy) == {("HighCPUUsage", 60)}


def test_used_share_pairs_by_labels(spark):
    rows = []
    for s in range(0, 600, 15):
        for kind, free in (("ext4", 5), ("tmpfs", 1)):
            labels = {"instance": "h", "fstype": kind}
            rows += [(START + timedelta(seconds=s), "node_filesystem_avail_bytes", labels, float(free)),
                     (START + timedelta(seconds=s), "node_filesystem_size_bytes", labels, 100.0)]
    src = FrameTables(metrics=spark.createDataFrame(rows, UNKEYED))
    got = {(r["rule"], r["series"]) for r in dicts(alerts.alert_table(src))}
    assert got == {("DiskAlmostFull", "fstype=ext4,instance=h"), ("DiskCritical", "fstype=ext4,instance=h")}


def plain_rates(rows, window):
    """Rows of (seconds, series, value); the rate of each, by the definition."""
    out = []
    for second, series, _ in rows:
        inside = [v for s, k, v in sorted(rows) if k == series and second - window <= s <= second]
        steps = [b - a if b >= a else b for a, b in zip(inside, inside[1:])]
        out.append((second, series, sum(steps) / window if len(inside) > 1 else None))
    return sorted(out)


@pytest.mark.parametrize("window, panes, least", [(60, 1, 1), (60, 4, 1), (300, 4, 60), (600, 4, 300), (300, 12, 1)])
def test_rates_of_sparse_and_dense_series(spark, window, panes, least):
    """Gaps of many panes, several samples a second, restarts in and between panes."""
    draw = random.Random(window * panes)
    rows = []
    for series in "abc":
        second, value = draw.randint(0, 50), 0.0
        for _ in range(70):
            second += draw.choice([1, 1, 2, 5, 15, 60, 61, 400, 3000])
            value = draw.choice([value + draw.randint(0, 9), value + 100, draw.randint(0, 5)])
            rows.append((second, series, value))
    made = metric(spark, [(s, {"k": k}, v) for s, k, v in rows]).repartition(5)
    got = sorted((int((r["ts"] - START).total_seconds()), r["labels"]["k"], r["rate"]) for r in dicts(counter_rate(made, window, panes, least)))
    want = plain_rates(rows, window)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_rates_of_several_windows_in_one_pass(spark):
    rows = [(s * 20, "a", (s * 7) % 50) for s in range(80)]
    made = metric(spark, [(s, {"k": k}, v) for s, k, v in rows]).withColumn("series", series_text())
    both = made.withColumn("window", F.explode(F.array(F.lit(0), F.lit(120), F.lit(600))))
    got = dicts(counter_rates(both, [0, 120, 600], ["labels"]))
    assert len(got) == 240 and all(r["rate"] is None and r["labels"] == {"k": "a"} for r in got if r["window"] == 0)
    for window in (120, 600):
        rates = [r["rate"] for r in sorted(got, key=lambda r: r["ts"]) if r["window"] == window]
        assert rates == pytest.approx([w[2] for w in plain_rates(rows, window)])


def windows_of(df):
    return re.findall(r"Window \[.*?\], \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString())


def test_no_window_holds_more_than_one_pane(spark):
    samples = metric(spark, [(0, {}, 1)])
    plans = windows_of(counter_rate(samples, 3600))
    assert len(plans) >= 3 and all(re.match(r"_?pane#", keys) for keys in plans)
    runs = windows_of(sustained(breaches(spark, "x."), ["series"], F.lit(0)))
    # The first two see samples and the runs of one pane; the rest, at most two rows per pane.
    assert len(runs) >= 3 and all(keys.startswith("_at#") for keys in runs[-2:])


def test_a_dense_series_spreads_over_its_panes(spark):
    """One series, an hour of many samples a second, in runs of 50 and one long one."""
    dense = spark.range(200_000).select(
        F.lit("s").alias("series"), (F.lit(START) + F.expr("make_dt_interval(0, 0, 0, id * 0.018)")).cast("timestamp_ntz").alias("ts"),
        F.col("id").cast("double").alias("value"), ((F.col("id") % 51 != 0) | F.col("id").between(60_000, 150_000)).alias("breach"),
    )
    got = dicts(sustained(dense, ["series"], F.lit(60)))
    assert [(r["samples"], r["value"]) for r in got] == [(150_042 - 59_977, 150_041.0)]
    assert sustained(dense, ["series"], F.lit(0)).count() == sustained(dense, ["series"], F.lit(0), (3600,)).count()
    panes = dense.groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 300_000_000)).count()
    assert panes.count() >= 12 and panes.agg(F.max("count")).first()[0] <= 16_667


def test_ordered_work_is_dealt_by_size(spark, monkeypatch):
    """Partitions whose number is asked for are not joined again by adaptive execution, and
    no second exchange follows on them."""
    monkeypatch.setattr(series, "TASK_BYTES", 100)
    samples = spark.range(600).selectExpr(
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 20) AS ts", "concat('m', id % 2) AS metric",
        "map('i', CAST(id % 3 AS STRING)) AS labels", "CAST(id AS DOUBLE) AS value")
    rated = counter_rate(samples, 3600)
    runs = sustained(
        samples.select("metric", "ts", "value", (F.col("value") % 10 > 2).alias("breach")), ["metric"], F.lit(60), (300, 3600))
    for df, exchanges in ((rated, 2), (runs, 3)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == exchanges
        parts = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan)
        assert min(map(int, parts)) > 20
