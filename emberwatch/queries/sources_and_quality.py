"""Readers, sinks and the data-quality suite."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberwatch.operators import incidents as windows
from emberwatch.operators import quality as q
from emberwatch.operators.intervals import points_in_intervals
from emberwatch.plans.durable import fresh_folder
from emberwatch.queries.base import FEATURES, GRID, LABEL, Tables, query
from emberwatch.queries.preparation import KEYS, ids, observed_schedule, rounded
from emberwatch.queries.sqlbase import long_of, r, t, with_blocks
from emberwatch.schemas import INCIDENT_TABLE, LOG_TABLE, METRIC_NAMES, METRIC_TABLE
from emberwatch.sources import adapter
from emberwatch.sources.readers import keep_last, load_dataset, load_raw, read_incidents, read_logs, read_metrics, read_raw
from emberwatch.sources.sinks import FeatureStore, Journal, append_incidents, append_logs, append_metrics, newest, write_report

METRIC_IDS = f"SELECT {ids()}, {rounded(METRIC_NAMES)}, healthy::INT AS healthy FROM metrics"
INCIDENT_ROWS = (
    f"SELECT incident_id, service, scenario_type, {t('start_ts', 'start_ts')}, {t('end_ts', 'end_ts')} FROM incidents"
)


def text_times(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return df


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("s1_read_metrics", with_blocks(METRIC_IDS, "metrics"))
def _(x: Tables):
    """Metrics written as CSV, JSON lines and Parquet into one location and read back as one table."""
    root = fresh_folder(x.spark, "s1")
    rows = x.metrics.select(*METRIC_TABLE.fieldNames())
    third = F.pmod(F.xxhash64("service"), F.lit(3))
    text_times(rows.where(third == 0), "timestamp").write.option("header", True).csv(f"{root}/metrics_a.csv")
    text_times(rows.where(third == 1), "timestamp").write.json(f"{root}/metrics_b.jsonl")
    rows.where(third == 2).write.parquet(f"{root}/metrics_c.parquet")
    return read_metrics(x.spark, root)


@query("s2_discover_files", with_blocks("SELECT strftime(ts, '%Y-%m-%d-%H') AS dt, count(*) AS rows FROM metrics GROUP BY 1", "metrics"))
def _(x: Tables):
    """Files are found at any depth: named after the table, or below a dt= folder whatever their name."""
    root = fresh_folder(x.spark, "s2")
    rows = x.metrics.select(*METRIC_TABLE.fieldNames())
    third = F.pmod(F.xxhash64("service"), F.lit(3))
    append_metrics(rows.where(third == 0), f"{root}/region/west")
    rows.where(third == 1).write.parquet(f"{root}/2024/metrics_north.parquet")
    text_times(rows.where(third == 2), "timestamp").write.json(f"{root}/2024/deep/er/metrics_east.jsonl")
    found = read_raw(x.spark, root, "metrics", METRIC_TABLE)
    return found.groupBy(F.date_format("timestamp", "yyyy-MM-dd-HH").alias("dt")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s3_keep_last",
    with_blocks(
        f"SELECT {t('ts')}, service, k, event_id FROM (SELECT date_trunc('hour', ts) AS ts, service, k, event_id, "
        "row_number() OVER (PARTITION BY service, date_trunc('hour', ts) ORDER BY event_id DESC) AS nr FROM ev) WHERE nr = 1",
        "ev",
    ),
)
def _(x: Tables):
    """Several readings per (hour, service): the one read last stays."""
    readings = x.events.select(
        F.date_trunc("hour", "timestamp").alias("timestamp"), "service", "k", "event_id", F.lit("f").alias("_file"), F.col("event_id").alias("_row")
    )
    return keep_last(readings)


LOG_ROWS = f"SELECT {ids()}, level, message, count(*) AS lines FROM log GROUP BY ts, service, level, message"


@query("s4_read_logs", with_blocks(LOG_ROWS, "log"))
def _(x: Tables):
    root = fresh_folder(x.spark, "s4")
    rows = x.logs.select("timestamp", "service", "level", "message")
    text = rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    text.where("level = 'INFO'").write.json(f"{root}/logs_info.jsonl")
    rows.where("level <> 'INFO'").write.parquet(f"{root}/logs_rest.parquet")
    read = read_logs(x.spark, root).withColumn("timestamp", F.col("timestamp"))
    return read.groupBy(*KEYS, "level", "message").agg(F.count(F.lit(1)).alias("lines"))


@query("s5_read_incidents", with_blocks(INCIDENT_ROWS, "incidents"))
def _(x: Tables):
    root = fresh_folder(x.spark, "s5")
    text_times(x.incidents, "start_ts", "end_ts").write.option("header", True).csv(f"{root}/ground_truth.csv")
    return read_incidents(x.spark, root)


@query(
    "s6_load_raw",
    with_blocks(
        "SELECT 'metrics' AS name, count(*) AS rows FROM metrics UNION ALL SELECT 'logs', count(*) FROM log "
        "UNION ALL SELECT 'incidents', count(*) FROM incidents",
        "incidents",
        "log",
    ),
)
def _(x: Tables):
    """A dataset root without a truth folder: incidents come from the metrics folder."""
    root = fresh_folder(x.spark, "s6")
    x.metrics.select(*METRIC_TABLE.fieldNames()).write.parquet(f"{root}/raw/metrics/metrics.parquet")
    x.logs.select(*LOG_TABLE.fieldNames()).write.parquet(f"{root}/raw/logs/logs.parquet")
    x.incidents.select(*INCIDENT_TABLE.fieldNames()).write.parquet(f"{root}/raw/metrics/ground_truth.parquet")
    raw = load_raw(x.spark, root)
    sizes = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, df in raw.items()]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query(
    "s7_hourly_sink",
    with_blocks(
        "SELECT strftime(ts, '%Y-%m-%d-%H') AS dt, level, count(*) AS lines FROM log GROUP BY 1, 2 "
        "UNION ALL SELECT strftime(start_ts, '%Y-%m-%d-%H'), 'incident', count(*) FROM incidents GROUP BY 1",
        "log",
        "incidents",
    ),
)
def _(x: Tables):
    """Logs and incidents appended to hour partitions and counted per partition."""
    root = fresh_folder(x.spark, "s7")
    append_logs(x.logs.select(*LOG_TABLE.fieldNames()), root)
    append_incidents(x.incidents, root)
    logs, incidents = x.spark.read.parquet(f"{root}/raw/logs"), x.spark.read.parquet(f"{root}/raw/truth")
    dt = F.col("dt").cast("string").alias("dt")
    a = logs.groupBy(dt, "level").agg(F.count(F.lit(1)).alias("lines"))
    b = incidents.groupBy(dt).agg(F.lit("incident").alias("level"), F.count(F.lit(1)).alias("lines"))
    return a.unionByName(b)


@query(
    "s9_feature_store",
    with_blocks(f"SELECT {ids()}, {rounded(FEATURES)}, in_failure, {LABEL} FROM ds", "ds"),
)
def _(x: Tables):
    store = FeatureStore(x.spark, fresh_folder(x.spark, "s9"))
    store.write_table(x.dataset, "feature_table", FEATURES, adapter.LABELS.label_columns, adapter.HOUR, 300)
    meta = store.read_metadata("feature_table").first()
    return store.read_table("feature_table").select(*KEYS, *meta["feature_columns"], "in_failure", LABEL)


@query("s10_load_split", with_blocks(f"SELECT {ids()}, {LABEL} FROM split WHERE split = 'val'", "split"))
def _(x: Tables):
    store = FeatureStore(x.spark, fresh_folder(x.spark, "s10"))
    store.write_splits(x.split)
    return store.load_split("val").select(*KEYS, LABEL)


@query("s11_export_csv", with_blocks(f"SELECT count(*) AS rows, {r('sum(\"Error_rate\")', 'error_sum')} FROM feat", "feat"))
def _(x: Tables):
    store = FeatureStore(x.spark, fresh_folder(x.spark, "s11"))
    store.write_table(x.dataset, "features.csv", FEATURES, adapter.LABELS.label_columns, adapter.HOUR, 300, "csv")
    back = load_dataset(x.spark, f"{store.root}/features.csv")
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum("Error_rate").alias("error_sum"))


@query(
    "s13_journal_tail",
    with_blocks(
        f"SELECT event_id, {t('ts')}, service, level FROM (SELECT * FROM log ORDER BY ts DESC, event_id DESC LIMIT 50)",
        "log",
    ),
)
def _(x: Tables):
    """All log lines appended to a JSON-lines journal in two batches; the newest fifty are read back."""
    schema = "timestamp timestamp, service string, level string, message string, event_id bigint"
    journal = Journal(x.spark, fresh_folder(x.spark, "s13"), schema)
    journal.append(x.logs.where("service < 'svc-2'"))
    journal.append(x.logs.where("service >= 'svc-2'"))
    return journal.tail(50, "event_id").select("event_id", "timestamp", "service", "level")


@query(
    "s14_load_dataset",
    "SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY o_orderstatus",
)
def _(x: Tables):
    return load_dataset(x.spark, f"{x.folder}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s19_report",
    with_blocks("SELECT service, count(*) AS ticks FROM metrics GROUP BY service", "metrics"),
)
def _(x: Tables):
    path = fresh_folder(x.spark, "s19")
    write_report(q.tick_counts(x.metrics), path)
    return x.spark.read.schema("service string, ticks long").json(path)


@query(
    "t4_newest_logs",
    with_blocks(f"SELECT event_id, {t('ts')}, service FROM log ORDER BY ts DESC, event_id DESC LIMIT 20", "log"),
)
def _(x: Tables):
    return newest(x.logs, 20, "timestamp", "event_id").select("event_id", "timestamp", "service")


@query(
    "u1_union_tables",
    "SELECT service, count(*) AS rows FROM (SELECT o_orderpriority AS service FROM orders UNION ALL SELECT l_returnflag FROM lineitem) GROUP BY service",
)
def _(x: Tables):
    a = x.read("orders").select(F.col("o_orderpriority").alias("service"))
    b = x.read("lineitem").select(F.col("l_returnflag").alias("service"))
    return a.unionByName(b).groupBy("service").agg(F.count(F.lit(1)).alias("rows"))


# --- checks -----------------------------------------------------------------------------------------------------------


@query("a1_tick_counts", with_blocks("SELECT service, count(*) AS ticks FROM metrics GROUP BY service", "metrics"))
def _(x: Tables):
    return q.tick_counts(x.metrics)


@query(
    "a2_misaligned_times",
    "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, seen FROM (SELECT date_trunc('day', o_orderdate) AS ts, count(DISTINCT o_orderpriority) AS seen "
    "FROM orders GROUP BY 1) WHERE seen < (SELECT count(DISTINCT o_orderpriority) FROM orders)",
)
def _(x: Tables):
    """Days on which some order priority is missing."""
    return q.misaligned_times(adapter.daily_orders(x.spark, x.folder))


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DESCRIBE = (
    "SELECT metric, count(value) AS count, "
    + ", ".join(
        r(f"round(round({e}, 9), 4)", n)
        for n, e in {
            "mean": "avg(value)",
            "std": "stddev_samp(value)",
            "min": "min(value)",
            "p25": "quantile_cont(value, 0.25)",
            "p50": "quantile_cont(value, 0.5)",
            "p75": "quantile_cont(value, 0.75)",
            "max": "max(value)",
        }.items()
    )
)


@query("a3_describe_lineitem", f"{DESCRIBE} FROM ({long_of('lineitem', LINE_COLUMNS, 'metric')}) GROUP BY metric")
def _(x: Tables):
    return q.describe(x.read("lineitem"), LINE_COLUMNS)


@query("a3_describe_metrics", with_blocks(f"{DESCRIBE} FROM ({long_of('metrics', METRIC_NAMES, 'metric')}) GROUP BY metric", "metrics"))
def _(x: Tables):
    return q.describe(x.metrics, METRIC_NAMES)


@query(
    "a4_missing_and_infinite",
    with_blocks(
        "SELECT (" + " + ".join(f'count(*) FILTER (WHERE "{f}" IS NULL)' for f in [*FEATURES, "time_to_failure_min"]) + ")::BIGINT AS missing, 0::BIGINT AS infinite FROM ds",
        "ds",
    ),
)
def _(x: Tables):
    return q.missing_and_infinite(x.dataset, [*FEATURES, "time_to_failure_min"])


@query(
    "a5_out_of_bounds",
    with_blocks(
        "SELECT metric, (count(*) FILTER (WHERE value < 0 OR value > hi))::BIGINT AS outside FROM ("
        + long_of("metrics", METRIC_NAMES, "metric")
        + ") JOIN (VALUES "
        + ", ".join(
            f"('{m}', {'1e300' if hi is None else hi}::DOUBLE)" for m, (_, _, hi) in q.METRICS.items()
        )
        + ") b(metric, hi) USING (metric) GROUP BY metric",
        "metrics",
    ),
)
def _(x: Tables):
    return q.out_of_bounds(x.metrics)


@query(
    "a6_health_by_service",
    with_blocks("SELECT service, count(*) AS ticks, (sum((NOT healthy)::INT))::BIGINT AS unhealthy FROM metrics GROUP BY service", "metrics"),
)
def _(x: Tables):
    return q.health_by_service(x.metrics)


@query(
    "a7_log_levels",
    with_blocks(
        f"SELECT level, count(*) AS lines, {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')}, "
        "(level IN ('INFO', 'WARNING', 'ERROR'))::INT AS known FROM log GROUP BY level",
        "log",
    ),
)
def _(x: Tables):
    return x.logs.groupBy("level").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.max(F.col("level").isin("INFO", "WARNING", "ERROR").cast("int")).alias("known"),
    )


@query(
    "a8_incident_types",
    with_blocks(
        "SELECT scenario_type, count(*) AS incidents, (count(*) FILTER (WHERE end_ts <= start_ts))::BIGINT AS non_positive, "
        + r("max((epoch_us(end_ts) - epoch_us(start_ts)) / 6e7)", "max_min")
        + " FROM incidents GROUP BY scenario_type",
        "incidents",
    ),
)
def _(x: Tables):
    return q.incident_types(x.incidents)


@query(
    "a9_spans",
    with_blocks(
        f"SELECT {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7', 'span_min')}, "
        "round(((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 + 3600) / 3600)::BIGINT AS expected_ticks, "
        + ", ".join(r(f"max({c}) - min({c})", f"{c}_swing", 2) for c in ("request_rate_rps", "latency_ms", "cpu_util_pct"))
        + " FROM metrics",
        "metrics",
    ),
)
def _(x: Tables):
    return q.spans(x.metrics, adapter.HOUR)


@query(
    "w6_sampling_gaps",
    "SELECT service, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, gap AS gap_sec FROM (SELECT service, ts, "
    "(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY service ORDER BY ts))) / 1e6 AS gap FROM "
    "(SELECT DISTINCT o_orderpriority AS service, date_trunc('day', o_orderdate) AS ts FROM orders)) WHERE abs(gap - 86400) > 1",
)
def _(x: Tables):
    """Days without orders per priority."""
    return q.irregular_gaps(adapter.daily_orders(x.spark, x.folder), 86_400)


def widened(x: Tables):
    """Incident windows extended by a day, so that some of them overlap."""
    return x.incidents.withColumn("end_ts", F.col("end_ts") + F.expr("interval 1 day"))


WIDE = "(SELECT incident_id, service, scenario_type, start_ts, end_ts + INTERVAL 1 DAY AS end_ts FROM incidents)"


@query(
    "w7_overlapping_incidents",
    with_blocks(
        f"SELECT incident_id, service FROM (SELECT *, max(end_ts) OVER (PARTITION BY service ORDER BY start_ts, end_ts, incident_id "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM {WIDE}) WHERE start_ts < until",
        "incidents",
    ),
)
def _(x: Tables):
    return windows.overlapping(widened(x)).select("incident_id", "service")


@query(
    "j4_log_correlation",
    with_blocks(
        "SELECT DISTINCT i.incident_id FROM incidents i JOIN log l ON l.service = i.service AND l.ts >= i.start_ts AND l.ts <= i.end_ts "
        "AND l.level IN ('WARNING', 'ERROR')",
        "incidents",
        "log",
    ),
)
def _(x: Tables):
    return q.correlated_incidents(x.logs, x.incidents)


@query(
    "j4_log_correlation_any_service",
    with_blocks(
        "SELECT DISTINCT i.incident_id FROM incidents i JOIN log l ON l.ts >= i.start_ts AND l.ts <= i.end_ts AND l.level IN ('WARNING', 'ERROR')",
        "incidents",
        "log",
    ),
)
def _(x: Tables):
    return q.correlated_incidents(x.logs, x.incidents, match_service=False)


@query(
    "j5_unhealthy_share",
    with_blocks(
        "SELECT count(*) AS inside, (sum((NOT m.healthy)::INT))::BIGINT AS unhealthy FROM metrics m JOIN incidents i "
        "ON i.service = m.service AND m.ts >= i.start_ts AND m.ts <= i.end_ts",
        "incidents",
    ),
)
def _(x: Tables):
    return q.incident_share(x.metrics, x.incidents)


@query(
    "j5_events_in_incidents",
    with_blocks(
        "SELECT e.event_id, i.incident_id FROM ev e JOIN incidents i ON i.service = e.service AND e.ts >= i.start_ts AND e.ts < i.end_ts",
        "ev",
        "incidents",
    ),
)
def _(x: Tables):
    """Every event matched with the incident window it falls into."""
    events = x.events.select("event_id", "service", "timestamp")
    hits = points_in_intervals(events, x.incidents.select("incident_id", "service", "start_ts", "end_ts"), ["service"], "start_ts", "end_ts")
    return hits.select("event_id", "incident_id")


@query(
    "j6_recovery_after_incident",
    with_blocks(
        """SELECT i.incident_id, i.service, strftime(i.end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts, min(a.healthy::INT) AS recovered
        FROM incidents i LEFT JOIN LATERAL (SELECT m.healthy FROM metrics m WHERE m.service = i.service AND m.ts > i.end_ts
        ORDER BY m.ts LIMIT 5) a ON true GROUP BY ALL""",
        "incidents",
    ),
)
def _(x: Tables):
    return q.recovery_after(x.metrics, x.incidents, layout=GRID)


def typical_schedule(x: Tables):
    """Shortest observed duration per service and type, taken as the schedule."""
    return observed_schedule(x).groupBy("service", "scenario_type").agg(F.min("duration_min").alias("duration_min"))


@query(
    "j8_schedule_mismatch",
    with_blocks(
        "SELECT i.incident_id, i.service, " + r("minutes", "actual_min") + ", " + r("least_min", "duration_min") + " FROM (SELECT *, "
        "(epoch_us(end_ts) - epoch_us(start_ts)) / 6e7 AS minutes FROM incidents) i JOIN (SELECT service, scenario_type, "
        "min((epoch_us(end_ts) - epoch_us(start_ts)) / 6e7) AS least_min FROM incidents GROUP BY ALL) s USING (service, scenario_type) "
        "WHERE abs(minutes - least_min) > 30",
        "incidents",
    ),
)
def _(x: Tables):
    return windows.duration_mismatch(typical_schedule(x), x.incidents, 300).select(
        "incident_id", "service", "actual_min", "duration_min"
    )


@query(
    "j9_missing_types",
    with_blocks(
        "SELECT strftime(week, '%Y-%m-%d %H:%M:%S') AS week, scenario_type FROM ("
        "SELECT date_trunc('week', start_ts) + INTERVAL 7 DAY AS week, scenario_type FROM incidents "
        "EXCEPT SELECT date_trunc('week', start_ts), scenario_type FROM incidents)",
        "incidents",
    ),
)
def _(x: Tables):
    """Types expected in each week, because they occurred in the week before, that did not occur in it."""
    weekly = x.incidents.withColumn("week", F.date_trunc("week", "start_ts"))
    expected = weekly.withColumn("week", F.col("week") + F.expr("INTERVAL 7 DAYS"))
    return windows.missing_types(expected, weekly, ["week"])


@query(
    "u2_level_difference",
    with_blocks(
        "SELECT DISTINCT level FROM log EXCEPT SELECT unnest(['INFO', 'WARNING'])",
        "log",
    ),
)
def _(x: Tables):
    """Levels in use beyond INFO and WARNING."""
    allowed = x.logs.select("level").where(F.col("level").isin("INFO", "WARNING")).distinct()
    return x.logs.select("level").distinct().join(allowed, "level", "left_anti")


SUITE_SQL = """
, checks AS (
SELECT 'metrics_schema' AS name, 'PASS' AS status UNION ALL SELECT 'logs_schema', 'PASS' UNION ALL SELECT 'truth_schema', 'PASS'
UNION ALL SELECT 'per_service_ticks', CASE WHEN count(DISTINCT n) = 1 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT count(*) AS n FROM metrics GROUP BY service)
UNION ALL SELECT 'timestamp_alignment', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM (SELECT ts FROM metrics GROUP BY ts
  HAVING count(DISTINCT service) < (SELECT count(DISTINCT service) FROM metrics))
UNION ALL SELECT 'uniform_spacing', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END FROM (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY service ORDER BY ts))) / 1e6 AS g FROM metrics) WHERE abs(g - 3600) > 1
UNION ALL SELECT 'missing_values', 'PASS'
UNION ALL SELECT 'metric_bounds', CASE WHEN count(*) FILTER (WHERE cpu_util_pct > 100 OR memory_util_pct > 100 OR disk_util_pct > 100 OR http_4xx_rate > 1
  OR http_5xx_rate > 1 OR db_connection_usage_pct > 100) = 0 THEN 'PASS' ELSE 'FAIL' END FROM metrics
UNION ALL SELECT 'healthy_distribution', CASE WHEN avg(healthy::INT) > 0 AND avg(healthy::INT) < 1 THEN 'PASS' ELSE 'WARN' END FROM metrics
UNION ALL SELECT 'log_levels', 'PASS'
UNION ALL SELECT 'log_time_range', CASE WHEN (SELECT min(ts) FROM log) >= (SELECT min(ts) FROM metrics) AND (SELECT max(ts) FROM log) <= (SELECT max(ts) FROM metrics) THEN 'PASS' ELSE 'WARN' END
UNION ALL SELECT 'incident_types', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END FROM incidents
UNION ALL SELECT 'incident_duration', CASE WHEN count(*) FILTER (WHERE end_ts <= start_ts) = 0 THEN 'PASS' ELSE 'FAIL' END FROM incidents
UNION ALL SELECT 'incident_overlap', CASE WHEN count(*) FILTER (WHERE start_ts < until) = 0 THEN 'PASS' ELSE 'WARN' END FROM
  (SELECT start_ts, max(end_ts) OVER (PARTITION BY service ORDER BY start_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM incidents)
UNION ALL SELECT 'unhealthy_alignment', CASE WHEN avg((NOT m.healthy)::INT) >= 0.6 THEN 'PASS' ELSE 'WARN' END FROM metrics m JOIN incidents i
  ON i.service = m.service AND m.ts >= i.start_ts AND m.ts <= i.end_ts
UNION ALL SELECT 'recovery_after_incident', CASE WHEN count(*) FILTER (WHERE ok = 0) = 0 THEN 'PASS' ELSE 'WARN' END FROM rec
UNION ALL SELECT 'recovery_window_missing', 'INFO' FROM rec HAVING count(*) FILTER (WHERE ok IS NULL) > 0
UNION ALL SELECT 'log_correlation', CASE WHEN count(DISTINCT i.incident_id) = (SELECT count(*) FROM incidents) THEN 'PASS' ELSE 'WARN' END FROM incidents i
  JOIN log l ON l.service = i.service AND l.ts >= i.start_ts AND l.ts <= i.end_ts AND l.level IN ('WARNING', 'ERROR')
UNION ALL SELECT 'expected_ticks', 'INFO' UNION ALL SELECT 'metric_range', 'INFO' UNION ALL SELECT 'incident_rows', 'INFO'
UNION ALL SELECT 'incident_schedule_match', CASE WHEN count(*) FILTER (WHERE abs(minutes - least_min) > 360) = 0 THEN 'PASS' ELSE 'WARN' END
  FROM (SELECT minutes, min(minutes) OVER (PARTITION BY service, scenario_type) AS least_min FROM
  (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 6e7 AS minutes FROM incidents))
)
SELECT name, status FROM checks UNION ALL SELECT 'overall', CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END FROM checks"""
RECOVERED = """, rec AS (SELECT i.incident_id, min(a.healthy::INT) AS ok FROM incidents i LEFT JOIN LATERAL (SELECT m.healthy FROM metrics m
WHERE m.service = i.service AND m.ts > i.end_ts ORDER BY m.ts LIMIT 5) a ON true GROUP BY ALL)"""


@query("i18_quality_suite", with_blocks(RECOVERED + SUITE_SQL, "incidents", "log"))
def _(x: Tables):

    report = q.validate(
        x.metrics, x.logs.select(*LOG_TABLE.fieldNames()), x.incidents, adapter.HOUR, typical_schedule(x), GRID
    )
    return report.select("name", "status")


@query(
    "a10_verdict",
    with_blocks(RECOVERED + SUITE_SQL.replace("SELECT name, status FROM checks UNION ALL SELECT 'overall',", "SELECT"), "incidents", "log").replace(
        "ELSE 'PASS' END FROM checks", "ELSE 'PASS' END AS status FROM checks"
    ),
)
def _(x: Tables):
    report = q.validate(
        x.metrics, x.logs.select(*LOG_TABLE.fieldNames()), x.incidents, adapter.HOUR, typical_schedule(x), GRID
    )
    return report.where("name = 'overall'").select("status")


@query(
    "p18_drop_missing",
    with_blocks(f"SELECT {ids()}, {rounded(['time_to_failure_min'])} FROM ds WHERE time_to_failure_min IS NOT NULL", "ds"),
)
def _(x: Tables):
    c = F.col("time_to_failure_min")
    return x.dataset.where(c.isNotNull() & ~F.isnan(c)).select(*KEYS, c)


