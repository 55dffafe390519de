"""Data-quality suite over raw metrics, logs and incidents.

Every check is one row (name, status, detail). All checks that need no order or join share one aggregation per table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.functions.columns import as_long, ratio, total_of
from emberwatch.operators.incidents import duration_mismatch, missing_types, overlapping
from emberwatch.operators.intervals import points_in_intervals
from emberwatch.plans.asof import counts_up_to
from emberwatch.plans.blocks import AUTO, Layout, home_rows, series
from emberwatch.plans.durable import durable
from emberwatch.plans.ranking import exact_quantiles
from emberwatch.schemas import INCIDENT_TABLE, LOG_LEVELS, LOG_TABLE, METRIC_NAMES, METRIC_TABLE, METRICS

SEVERITY = {"INFO": 0, "PASS": 1, "WARN": 2, "FAIL": 3}


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, quartiles and max per column."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "metric", "value")
    rows = rows.where(F.col("value").isNotNull() & ~F.isnan("value"))
    plain = rows.groupBy("metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(rows, ["metric"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return plain.join(quartiles, "metric").select(
        "metric",
        "count",
        # the inner rounding removes floating-point noise, so that halves round alike on every run
        *[F.round(F.round(c, 9), 4).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
    )


def tick_counts(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("service").agg(F.count(F.lit(1)).alias("ticks"))


def misaligned_times(metrics: DataFrame) -> DataFrame:
    """Timestamps that some service lacks."""
    services = metrics.select("service").distinct().agg(F.count(F.lit(1)).alias("all"))
    seen = metrics.groupBy("timestamp").agg(F.countDistinct("service").alias("seen"))
    return seen.where(F.col("seen") < services.select("all").scalar())


def irregular_gaps(metrics: DataFrame, interval_sec: int, layout: Layout = AUTO) -> DataFrame:
    """Ticks more than one second off the sampling interval after their predecessor."""
    rows, _, window = series(metrics.select("timestamp", "service"), layout, 1)
    gap = (F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(window))) / F.lit(1e6)
    return home_rows(rows.withColumn("gap_sec", gap)).where(F.abs(F.col("gap_sec") - interval_sec) > 1)


def _missing_columns(columns: Sequence[str]) -> list[Column]:
    doubles = [F.col(c).cast("double") for c in columns]
    return [
        F.sum(total_of([(d.isNull() | F.isnan(d)).cast("int") for d in doubles])).alias("missing"),
        F.sum(total_of([F.coalesce((F.abs(d) == float("inf")).cast("int"), F.lit(0)) for d in doubles])).alias("infinite"),
    ]


def missing_and_infinite(df: DataFrame, columns: Sequence[str] = METRIC_NAMES) -> DataFrame:
    return df.agg(*_missing_columns(columns))


def out_of_bounds(df: DataFrame) -> DataFrame:
    """Rows outside the declared range per metric; the lower bound counts for every metric."""
    present = [m for m in METRIC_NAMES if m in df.columns]
    return df.agg(*[_outside(m).alias(m) for m in present]).unpivot([], present, "metric", "outside")


def _outside(name: str) -> Column:
    _, low, high = METRICS[name]
    value = F.col(name).cast("double")
    bad = value < low if high is None else (value < low) | (value > high)
    return F.count(F.when(bad & ~F.isnan(value), 1))


def health_by_service(metrics: DataFrame) -> DataFrame:
    bad = F.sum((~F.col("healthy")).cast("int"))
    return metrics.groupBy("service").agg(F.count(F.lit(1)).alias("ticks"), bad.alias("unhealthy"))


def invalid_levels(logs: DataFrame) -> DataFrame:
    """Log levels outside the known set."""
    return logs.where(~F.col("level").isin(*LOG_LEVELS)).select("level").distinct()


def incident_share(metrics: DataFrame, incidents: DataFrame) -> DataFrame:
    """Ticks inside (closed) incident windows and how many of them are unhealthy."""
    inside = points_in_intervals(
        metrics.select("timestamp", "service", "healthy"),
        incidents.select("incident_id", "service", "start_ts", "end_ts"),
        ["service"],
        "start_ts",
        "end_ts",
        closed=True,
    )
    return inside.agg(
        F.count(F.lit(1)).alias("inside"),
        F.coalesce(F.sum((~F.col("healthy")).cast("int")), F.lit(0)).alias("unhealthy"),
    )


def recovery_after(
    metrics: DataFrame, incidents: DataFrame, ticks: int = 5, layout: Layout = AUTO
) -> DataFrame:
    """Per incident: are the first ``ticks`` ticks after its end all healthy? NULL where the data ends with it.

    Each tick first learns the health of the ticks after it; the incident then looks up its last covered tick, so only
    one row per incident is joined.
    """
    rows, _, window = series(metrics.select("timestamp", "service", "healthy"), layout, 0, ticks)
    frame = window.rowsBetween(1, ticks)
    after = home_rows(
        rows.withColumn("_all_healthy", F.min(F.col("healthy").cast("int")).over(frame)).withColumn(
            "_next_ts", F.lead("timestamp").over(window)
        )
    )
    # the last tick at or before the end: its own time <= end, the next one after it (or none)
    ends = incidents.select("incident_id", "service", "end_ts")
    covering = after.withColumn("_until", F.coalesce("_next_ts", F.timestamp_seconds(F.lit(253402300799))))
    width = 6 * 3600
    last = covering.where(F.col("_next_ts").isNull()).select(
        "service", "timestamp", F.lit(None).cast("int").alias("_all_healthy"), "_until"
    )
    body = covering.where(F.col("_next_ts").isNotNull()).select("service", "timestamp", "_all_healthy", "_until")
    within = points_in_intervals(ends, body, ["service"], "timestamp", "_until", "end_ts", width)
    beyond = ends.join(last, "service").where(F.col("end_ts") >= F.col("timestamp"))
    both = within.unionByName(beyond)
    return both.select(
        "incident_id", "service", "end_ts", (F.col("_all_healthy") == 1).alias("recovered")
    )


def correlated_incidents(logs: DataFrame, incidents: DataFrame, match_service: bool = True) -> DataFrame:
    """Incidents with at least one WARNING or ERROR log inside ``[start, end]``; one without an end has none.

    More serious instants up to the end than before the start prove a match, so no match is enumerated.
    """
    keys = ["service"] if match_service else []
    serious = logs.where(F.col("level").isin("WARNING", "ERROR")).select(*keys, F.col("timestamp").alias("at")).distinct()
    edges = F.explode(
        F.array(
            F.struct(F.col("start_ts").alias("at"), F.lit(False).alias("inclusive")),
            F.struct(F.col("end_ts").alias("at"), F.lit(True).alias("inclusive")),
        )
    )
    asked = incidents.select("incident_id", *keys, edges.alias("edge")).select("incident_id", *keys, "edge.*")
    counts = counts_up_to(serious, asked, keys).groupBy("incident_id").agg(
        F.max(F.when(F.col("inclusive"), F.col("n_before"))).alias("upto"), F.max(F.when(~F.col("inclusive"), F.col("n_before"))).alias("before")
    )
    return counts.where("upto > before").select("incident_id")


def incident_types(incidents: DataFrame) -> DataFrame:
    minutes = (F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(60_000_000.0)
    return incidents.withColumn("_min", minutes).groupBy("scenario_type").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count(F.when(F.col("_min") <= 0, 1)).alias("non_positive"),
        F.max("_min").alias("max_min"),
    )


SWINGS = ("request_rate_rps", "latency_ms", "cpu_util_pct")


def _span_columns() -> list[Column]:
    swing = [F.round(F.max(c) - F.min(c), 2).alias(f"{c}_swing") for c in SWINGS]
    span = (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / F.lit(60_000_000.0)
    return [span.alias("span_min"), *swing]


def _expected_ticks(interval_sec: int) -> Column:
    return F.round((F.col("span_min") * 60 + interval_sec) / interval_sec).cast("long")


def spans(metrics: DataFrame, interval_sec: int) -> DataFrame:
    """One row: span in minutes, expected ticks and the swing (max - min) of the three daily metrics."""
    return metrics.agg(*_span_columns()).withColumn("expected_ticks", _expected_ticks(interval_sec))


def _check(df: DataFrame, name: str, status: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), status.alias("status"), detail.cast("string").alias("detail"))


def _pass_or(condition: Column, otherwise: str) -> Column:
    return F.when(condition, "PASS").otherwise(otherwise)


def validate(
    metrics: DataFrame,
    logs: DataFrame,
    incidents: DataFrame,
    interval_sec: int = 30,
    schedule: DataFrame | None = None,
    layout: Layout = AUTO,
    match_service: bool = True,
) -> DataFrame:
    """All checks as rows (name, status, detail) plus the row ``overall`` holding the worst status."""
    spark = metrics.sparkSession
    count = F.count(F.lit(1))

    def schema_check(name: str, df: DataFrame, expected) -> DataFrame:
        fits = df.columns[: len(expected.fieldNames())] == expected.fieldNames()
        one = spark.range(1)
        return _check(one, name, F.lit("PASS" if fits else "FAIL"), F.lit(f"{len(df.columns)} columns"))

    # one pass over the metrics per grouping, one over the logs; each leaves a handful of rows
    health = durable(health_by_service(metrics), "health")
    per_service = health.agg(
        F.countDistinct("ticks").alias("sizes"),
        F.max("ticks").alias("ticks"),
        ratio(F.sum("ticks") - F.sum("unhealthy"), F.sum("ticks")).alias("share"),
        F.count(F.when(F.col("unhealthy") == 0, 1)).alias("never"),
    )
    facts = durable(
        metrics.agg(
            *_missing_columns(METRIC_NAMES),
            total_of([_outside(m) for m in METRIC_NAMES]).alias("outside"),
            *_span_columns(),
            F.min("timestamp").alias("first"),
            F.max("timestamp").alias("last"),
        ),
        "facts",
    )
    log_facts = logs.agg(
        F.min("timestamp").alias("lo"),
        F.max("timestamp").alias("hi"),
        count.alias("n"),
        F.count(F.when(~F.col("level").isin(*LOG_LEVELS), 1)).alias("invalid"),
    )
    within = (F.col("lo") >= facts.select("first").scalar()) & (F.col("hi") <= facts.select("last").scalar())
    log_facts = durable(log_facts.withColumn("within", within), "log_facts")
    types = incident_types(incidents).agg(
        count.alias("types"), F.coalesce(F.sum("non_positive"), F.lit(0)).alias("bad"), F.max("max_min").alias("longest")
    )
    expected_types = schedule if schedule is not None else incidents.limit(0)
    recovered = recovery_after(metrics, incidents, layout=layout).agg(
        F.count(F.when(~F.col("recovered"), 1)).alias("bad"), F.count(F.when(F.col("recovered").isNull(), 1)).alias("open")
    )
    matched = correlated_incidents(logs, incidents, match_service).agg(count.alias("hit"))
    incident_count = incidents.agg(count.alias("n"))
    n_incidents = incident_count.select("n").scalar()

    # Names of the checks.
    checks = [
        schema_check("metrics_schema", metrics, METRIC_TABLE),
        schema_check("logs_schema", logs, LOG_TABLE),
        schema_check("truth_schema", incidents, INCIDENT_TABLE),
        _check(per_service, "per_service_ticks", _pass_or(F.col("sizes") == 1, "FAIL"), F.col("ticks")),
        _check(
            misaligned_times(metrics).agg(count.alias("n")),
            "timestamp_alignment",
            _pass_or(F.col("n") == 0, "FAIL"),
            F.col("n"),
        ),
        _check(
            irregular_gaps(metrics, interval_sec, layout).agg(count.alias("n")),
            "uniform_spacing",
            _pass_or(F.col("n") == 0, "WARN"),
            F.col("n"),
        ),
        _check(
            facts,
            "missing_values",
            _pass_or((F.col("missing") == 0) & (F.col("infinite") == 0), "FAIL"),
            F.concat_ws(",", "missing", "infinite"),
        ),
        _check(facts, "metric_bounds", _pass_or(F.col("outside") == 0, "FAIL"), F.col("outside")),
        _check(
            per_service,
            "healthy_distribution",
            _pass_or((F.col("share") > 0) & (F.col("share") < 1), "WARN"),
            F.format_string("%.3f", "share"),
        ),
        _check(per_service.where("never > 0"), "per_service_failures", F.lit("INFO"), F.col("never")),
        _check(log_facts, "log_levels", _pass_or(F.col("invalid") == 0, "FAIL"), F.col("invalid")),
        _check(
            log_facts,
            "log_time_range",
            _pass_or((F.col("n") > 0) & F.coalesce("within", F.lit(False)), "WARN"),
            F.col("n"),
        ),
        _check(
            missing_types(expected_types, incidents).agg(count.alias("n")),
            "incident_types",
            F.when(n_incidents == 0, "FAIL").when(F.col("n") == 0, "PASS").otherwise("WARN"),
            F.col("n"),
        ),
        _check(types, "incident_duration", _pass_or(F.col("bad") == 0, "FAIL"), F.format_string("%.0f", "longest")),
        _check(
            overlapping(incidents).agg(count.alias("n")),
            "incident_overlap",
            _pass_or(F.col("n") == 0, "WARN"),
            F.col("n"),
        ),
        _check(
            incident_share(metrics, incidents),
            "unhealthy_alignment",
            _pass_or(ratio(F.col("unhealthy"), F.greatest("inside", F.lit(1))) >= 0.6, "WARN"),
            F.format_string("%.3f", ratio(F.col("unhealthy"), F.greatest("inside", F.lit(1)))),
        ),
        _check(recovered, "recovery_after_incident", _pass_or(F.col("bad") == 0, "WARN"), F.col("bad")),
        _check(recovered.where("open > 0"), "recovery_window_missing", F.lit("INFO"), F.col("open")),
        _check(matched, "log_correlation", _pass_or(F.col("hit") == n_incidents, "WARN"), F.col("hit")),
        _check(facts, "expected_ticks", F.lit("INFO"), _expected_ticks(interval_sec)),
        _check(
            facts,
            "metric_range",
            F.lit("INFO"),
            F.concat_ws(",", *[F.format_string("%.2f", f"{c}_swing") for c in SWINGS]),
        ),
        _check(incident_count, "incident_rows", F.lit("INFO"), F.col("n")),
    ]
    if schedule is not None:
        mismatch = duration_mismatch(schedule, incidents, interval_sec).agg(count.alias("n"))
        checks.append(_check(mismatch, "incident_schedule_match", _pass_or(F.col("n") == 0, "WARN"), F.col("n")))
    report = durable(reduce(DataFrame.unionByName, checks), "quality")
    return report.unionByName(_check(report.agg(verdict(F.col("status")).alias("s"), count.alias("n")), "overall", F.col("s"), F.col("n")))


def verdict(status: Column) -> Column:
    """Aggregate: FAIL if any check failed, else WARN if any warned, else PASS."""
    rank = F.max(
        F.when(status == "FAIL", SEVERITY["FAIL"]).when(status == "WARN", SEVERITY["WARN"]).otherwise(SEVERITY["PASS"])
    )
    return F.when(rank == SEVERITY["FAIL"], "FAIL").when(rank == SEVERITY["WARN"], "WARN").otherwise("PASS")


def as_metric_rows(metrics: DataFrame, ids: Sequence[str] = ("timestamp", "service")) -> DataFrame:
    return as_long(metrics, list(ids), METRIC_NAMES, "metric", "value")
