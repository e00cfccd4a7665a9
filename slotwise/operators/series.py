"""Operators over labelled time series: columns ts, metric, labels, value, perhaps series.

A series has at most one sample per instant. Ordered work runs per series *and* pane, a
short stretch of time: what crosses panes is a summary of each, merged on the way up, so one
series that holds most samples is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotwise.operators.joins import scan_bytes

SECOND = 1_000_000
#: Seconds of a pane, at least, and of how many panes a window of a rate is made at most.
PANE_SECONDS, PANES = 300, 4
#: Length of a pane in which runs are found, and of longer ones in which they are joined,
#: each a multiple of the one before; then per series, from two rows per pane.
RUN_PANES = (PANE_SECONDS,)
#: Bytes that a task of ordered work has, by the planner's estimate, and such tasks at most.
TASK_BYTES, MOST_TASKS = 1 << 20, 2000
#: An estimate from here on says that the size is not known.
UNKNOWN = 1 << 60


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def label_sql(name: str, labels: str = "labels") -> str:
    return f"coalesce(try_element_at({labels}, {_quoted(name)}), '')"


def label(name: str, labels: str = "labels") -> Column:
    """A label's value; an absent label is the empty string."""
    return F.expr(label_sql(name, labels))


def matches_sql(selector: dict[str, tuple[str, str]], labels: str = "labels") -> str:
    """:func:`matches` as SQL text, for use inside larger expressions."""
    tests = []
    for name, (operator, text) in selector.items():
        value = label_sql(name, labels)
        if operator in ("=", "!="):
            tests.append(f"{value} {operator} {_quoted(text)}")
        elif operator in ("=~", "!~"):
            tests.append(f"{'NOT ' if operator == '!~' else ''}{value} RLIKE {_quoted(f'^(?:{text})$')}")
        else:
            raise ValueError(f"unknown label operator {operator}")
    return " AND ".join(f"({test})" for test in tests) or "true"


def matches(selector: dict[str, tuple[str, str]], labels: str = "labels") -> Column:
    """All of ``{label: (operator, text)}`` hold; operators ``=``, ``!=``, ``=~`` and ``!~``.

    Patterns must match the whole value.
    """
    return F.expr(matches_sql(selector, labels))


def series_text(labels: str = "labels") -> Column:
    """The labels as one text, ``a=1,b=2`` in label order: a groupable series key."""
    return F.expr(f"array_join(transform(array_sort(map_entries({labels})), e -> concat(e.key, '=', e.value)), ',')")


def with_series(samples: DataFrame) -> DataFrame:
    """The samples with their ``series`` key, computed only where it is not stored."""
    return samples if "series" in samples.columns else samples.withColumn("series", series_text())


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _pane(us: str, length: int) -> Column:
    return F.expr(f"({us} - pmod({us}, {length})) div {length}")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of equal ``keys`` in one task, of which there are more for larger inputs.

    Left alone, adaptive execution joins partitions until they have so many compressed bytes;
    labels and series compress so well that a task would sort millions of rows. Rows whose
    size the planner does not know, such as those made in the driver, are left alone.
    """
    size = scan_bytes(df)
    return df if size >= UNKNOWN else df.repartition(max(1, min(MOST_TASKS, size // TASK_BYTES)), *keys)


def _step(before: Column, after: Column) -> Column:
    """What a counter gained between two samples; a drop is a restart from 0."""
    return F.when(after >= before, after - before).when(before.isNotNull(), after)


def _pane_length(seconds: int, panes: int, least: int) -> int:
    """Microseconds of a pane, so that panes make up a window exactly."""
    return seconds * SECOND // max(k for k in range(1, panes + 1) if seconds * SECOND % k == 0 and (k == 1 or seconds >= k * least))


def counter_rates(
    samples: DataFrame, windows: Sequence[int], keep: Sequence[str] = (), panes: int = PANES, least: int = PANE_SECONDS
) -> DataFrame:
    """Per sample, the counter's increase per second over the trailing ``[ts - window, ts]``.

    ``samples`` has ts, metric, series, value and ``window``, one of ``windows`` in seconds;
    a sample may stand there once per window. Window 0 gives the sample as it is, with a
    NULL rate. ``keep`` names more columns to return.

    A drop is a restart from 0. Only pairs of samples inside the window count, nothing is
    extrapolated to the window's edges, and a window with one sample gives NULL.

    Inside a pane, running sums give the increase from its first sample to each other one.
    A window that ends in a pane begins in the pane that lies one window before: there its
    rest is looked up, by a probe sorted in among the samples. The panes between are
    complete, and each is sent to where windows over it begin as one summary: first value,
    last value, increase. No step holds the samples of more than one pane, and the metrics
    are read once. A window is made of at most ``panes`` panes of at least ``least`` seconds.
    """
    own = ["ts", "metric", "series", "value", "window"]
    lengths = {w: _pane_length(w, panes, least) for w in windows if w}
    length = "CASE window " + " ".join(f"WHEN {w} THEN {n}" for w, n in lengths.items()) + f" ELSE {60 * SECOND} END"
    spread = samples.select(*own, *keep, micros("ts").alias("_us")).withColumn(
        "_pane", F.expr(f"(_us - pmod(_us, {length})) div ({length})")
    )
    # The pane comes first, as a number sorts faster than labels that begin alike.
    # Not by window too: where it is a constant, Spark drops it from the windows' keys.
    cell = ["series", "metric", "window"]
    spread = _dealt(spread, "_pane", "series", "metric")
    inside = W.partitionBy("_pane", *cell).orderBy("_us")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = spread.withColumns({
        "_gain": F.coalesce(_step(F.lag("value").over(inside), F.col("value")), F.lit(0.0)),
        "_place": F.row_number().over(inside),
        "_first": F.first("value").over(upto),
        "_ends": F.lead("_us").over(inside).isNull(),
    }).withColumn("_sum", F.sum("_gain").over(upto))

    # What a sample sends on: itself to its own pane; a probe to the pane where its window
    # begins; and the last one of a pane, the pane's summary to the panes between.
    none, at = "CAST(NULL AS DOUBLE)", "_us"
    sent = []
    for w, n in lengths.items():
        k = w * SECOND // n
        rows = [
            f"struct('sample' AS kind, _pane AS pane, {at} AS at, _sum AS gain, value AS last, {none} AS first)",
            f"struct('probe' AS kind, _pane - {k} AS pane, {at} - {w * SECOND} AS at, _sum AS gain, value AS last, _first AS first)",
        ]
        between = f"struct('pane' AS kind, _pane - p AS pane, _pane * {n} AS at, _sum AS gain, value AS last, _first AS first)"
        panes_sent = f"transform(CASE WHEN _ends THEN sequence(1, {k - 1}) ELSE array() END, p -> {between})"
        sent.append(f"WHEN {w} THEN " + (f"concat(array({', '.join(rows)}), {panes_sent})" if k > 1 else f"array({', '.join(rows)})"))
    plain = f"array(struct('plain' AS kind, _pane AS pane, {at} AS at, {none} AS gain, {none} AS last, {none} AS first))"
    rows = summed.select(
        *own, *keep, "_place", F.explode(F.expr(f"CASE window {' '.join(sent)} ELSE {plain} END" if sent else plain)).alias("r"),
    ).select(
        "metric", "series", "window", "r.*",
        *[F.when(F.col("r.kind").isin("probe", "plain"), F.col(c)).alias(c) for c in ("ts", "value", *keep, "_place")],
    )
    # Backwards in time: first the summaries, then the samples and probes of the pane itself,
    # a sample before a probe of its instant.
    rows = _dealt(rows, "pane", "series", "metric")
    back = W.partitionBy("pane", *cell).orderBy(F.desc("at"), F.desc("kind"))
    seen = back.rowsBetween(W.unboundedPreceding, W.currentRow)
    of = lambda kind, column: F.when(F.col("kind") == kind, F.col(column))
    looked = rows.withColumn(
        "_link", F.when(F.col("kind") == "pane", F.col("gain") + F.coalesce(_step(F.col("last"), F.lag("first").over(back)), F.lit(0.0)))
    ).withColumns({
        "_between": F.sum("_link").over(seen),
        "_next": F.last(of("pane", "first"), ignorenulls=True).over(seen),
        "_latest": F.first(of("pane", "last"), ignorenulls=True).over(seen),
        "_near": F.last(of("sample", "gain"), ignorenulls=True).over(seen),
        "_top": F.first(of("sample", "gain"), ignorenulls=True).over(seen),
        "_last": F.first(of("sample", "last"), ignorenulls=True).over(seen),
    })
    here, between = F.col("_near").isNotNull(), F.col("_next").isNotNull()
    increase = (
        F.col("gain")
        + F.when(between, F.col("_between") + _step(F.col("_latest"), F.col("first"))).otherwise(0.0)
        + F.when(here, F.col("_top") - F.col("_near") + _step(F.col("_last"), F.coalesce("_next", "first"))).otherwise(0.0)
    )
    rate = F.when(here | between | (F.col("_place") > 1), increase / F.col("window"))
    return looked.where(F.col("kind").isin("probe", "plain")).select(
        *own, *keep, F.when(F.col("kind") == "probe", rate).alias("rate")
    )


def counter_rate(samples: DataFrame, seconds: int, panes: int = PANES, least: int = PANE_SECONDS) -> DataFrame:
    """Per sample, the counter's increase per second over the trailing ``[ts - seconds, ts]``;
    see :func:`counter_rates`."""
    windowed = with_series(samples).withColumn("window", F.lit(seconds))
    return counter_rates(windowed, [seconds], ["labels"], panes, least).select("ts", "metric", "labels", "series", "value", "rate")


def latest(samples: DataFrame, *keep: Column) -> DataFrame:
    """The last value of every series."""
    return (
        with_series(samples)
        .groupBy("metric", "series", *keep)
        .agg(F.max_by("value", "ts").alias("value"))
    )


def sum_by(samples: DataFrame, *names: str) -> DataFrame:
    """At every instant, the sum over series that share the named labels."""
    return samples.groupBy("ts", "metric", *[label(n).alias(n) for n in names]).agg(F.sum("value").alias("value"))


def label_values(samples: DataFrame, name: str) -> DataFrame:
    return samples.select(label(name).alias(name)).where(F.col(name) != "").distinct().orderBy(name)


def children_of(samples: DataFrame, parents: DataFrame, key: str = "parent_id", parent_key: str = "component_id") -> DataFrame:
    """Series whose ``key`` label names a component among ``parents``."""
    ids = parents.select(label(parent_key).alias("_id")).where(F.col("_id") != "").distinct()
    return samples.withColumn("_id", label(key)).join(ids, "_id", "left_semi").drop("_id")


def _joined_runs(runs: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """Runs of smaller cells as those of larger ones: ``cells`` name the larger cell.

    A run is head (tail) if it holds the first (last) sample of its cell. Every cell has a
    tail, perhaps an empty one; a head exists where it starts in a breach. A head goes on
    the tail before it, the last row of the cell before.
    """
    runs = _dealt(runs, *keys, *cells)
    along = W.partitionBy(*keys, *cells).orderBy("_at", "_run")
    goes_on = F.col("_head") & (F.coalesce(F.lag("samples").over(along), F.lit(0)) > 0)
    numbered = runs.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn(
        "_id", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    joined = numbered.groupBy(*keys, *cells, "_id").agg(
        F.min("from_ts").alias("from_ts"), F.max("to_ts").alias("to_ts"), F.sum("samples").alias("samples"),
        F.max_by("value", "to_ts").alias("value"), F.min_by("_head", F.struct("_at", "_run")).alias("_starts"),
    )
    return joined.select(
        *keys, *cells, "from_ts", "to_ts", "samples", "value", F.col("_id").alias("_run"),
        (F.col("_starts") & (F.col("_id") == 1)).alias("_head"),
        (F.col("_id") == F.max("_id").over(W.partitionBy(*keys, *cells))).alias("_tail"),
    )


def sustained(
    samples: DataFrame, keys: list[str], hold_seconds: Column, panes: Sequence[int] = RUN_PANES
) -> DataFrame:
    """Unbroken runs of ``breach`` that last at least ``hold_seconds``.

    Needs ``ts``, ``value`` and a boolean ``breach`` per series ``keys``; gives the run's
    first and last instant, its samples and its last value. ``hold_seconds`` is an
    expression over ``keys``. ``panes`` are lengths in seconds, each a multiple of the one
    before.

    Runs are found inside short panes. Of a pane only the runs that touch its edges, at most
    two, go on to be joined in the next longer panes, and at last per series; runs inside
    are finished where they are found.
    """
    lasting = (F.col("samples") > 0) & (micros("to_ts") - micros("from_ts") >= hold_seconds * SECOND)
    rows = samples.select(
        *keys, "ts", "value", F.coalesce("breach", F.lit(False)).alias("breach"), micros("ts").alias("_us"),
    ).withColumn("_at", _pane("_us", panes[0] * SECOND))
    rows = _dealt(rows, "_at", *keys)
    cell = W.partitionBy("_at", *keys)
    # A run is the breaches that follow the same number of calm samples.
    past_calm = F.expr("count_if(NOT breach)").over(cell.orderBy("_us").rowsBetween(W.unboundedPreceding, 0))
    runs = (
        rows.withColumn("_run", past_calm)
        .groupBy("_at", *keys, "_run")
        .agg(
            F.expr("min(CASE WHEN breach THEN ts END) AS from_ts"),
            F.expr("max(CASE WHEN breach THEN ts END) AS to_ts"),
            F.expr("count_if(breach) AS samples"),
            F.expr("max_by(value, CASE WHEN breach THEN ts END) AS value"),
        )
        .withColumn("_tail", F.col("_run") == F.max("_run").over(cell))
        .withColumn("_head", F.col("_run") == 0)
    )
    # One pass per length; a finished run goes along untouched, in a cell of its own.
    for length, longer in zip(panes, (*panes[1:], None)):
        outer = F.lit(0) if longer is None else F.floor(F.col("_at") * length / F.lit(longer))
        edge = F.col("_head") | F.col("_tail")
        kept = runs.where(edge | lasting).withColumns({
            "_cell": F.when(edge, outer.cast("long")), "_done": F.when(~edge, F.col("from_ts")),
        })
        runs = _joined_runs(kept, keys, ["_cell", "_done"])
        unfinished = F.col("_cell").isNotNull()
        runs = runs.withColumns({"_head": F.col("_head") & unfinished, "_tail": F.col("_tail") & unfinished, "_at": F.col("_cell")})
        runs = runs.drop("_cell", "_done")
    return runs.where(lasting).select(*keys, "from_ts", "to_ts", "samples", "value")
