"""Telemetry tables derived from the event, order and line-item tables.

``events`` becomes an hourly grid of five services with the twelve raw metrics, the log of single events and the windows
in which a service was unhealthy. The grid holds one row per service and hour, so a service has at most as many rows as
the data spans hours, whatever the number of events; windows over one service of the *grid* are bounded by that. Rows
of single events are not bounded and always go through ``plans.blocks``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.config import AnomalyConfig, EvidenceConfig, FeatureConfig, LabelConfig, RiskConfig, SplitConfig
from emberwatch.config import DriftConfig, RecoveryConfig
from emberwatch.plans.ranking import numbered

# Incident types by incident_id % 5 and log messages by k % 5.
INCIDENT_TYPES = (
    "memory_leak",
    "connection_pool_exhaustion",
    "latency_spike",
    "network_partition",
    "disk_fill",
)
LOG_MESSAGES = (
    "connection pool exhausted",
    "memory usage increasing",
    "disk write failed: no space left",
    "response latency increasing",
    "network flapping detected",
)

HOUR = 3600
FEATURES = FeatureConfig(
    interval_sec=HOUR,
    windows_min=(600, 1200, 1800),
    growth_window_min=1200,
    error_window_min=600,
    request_window_min=600,
    name_unit="tick",
)
LABELS = LabelConfig(horizons_min=(300,), interval_sec=HOUR, name_unit="tick")
SPLITS = SplitConfig(purge_min=300, interval_sec=HOUR)
ANOMALY = AnomalyConfig(rolling_iqr_window_min=7200, interval_sec=HOUR)
SIGNALS = {"error_rate": "Error_rate", "latency_trend": "Latency_30t_avg", "memory_growth": "Memory_growth_rate"}
RISK = RiskConfig(signals=SIGNALS)
EVIDENCE = EvidenceConfig(
    log_window_min=1200,
    delta_metrics=(
        "Error_rate",
        "Latency_30t_avg",
        "Memory_growth_rate",
        "CPU_30t_avg",
        "Request_rate",
        "DB_usage_30t_avg",
    ),
)
DRIFT = DriftConfig(critical_features=("Error_rate", "Latency_30t_avg", "Memory_growth_rate"))
RECOVERY = RecoveryConfig(
    cooldown_sec=HOUR,
    metrics=("Error_rate", "Latency_30t_avg", "Memory_growth_rate"),
    thresholds={"Error_rate": 0.02, "Latency_30t_avg": 300.0, "Memory_growth_rate": 0.05},
)
LABEL = LABELS.horizon_name(300)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events with their service, UTC time and the integer ``k`` of their properties."""
    return read_table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _cells(events: DataFrame) -> DataFrame:
    """Counts and sums per service and hour. Sums are rounded so that they do not depend on the order of addition."""

    def seen(*kinds: str):
        return F.count(F.when(F.col("event_type").isin(*kinds), 1))

    return events.groupBy("service", F.date_trunc("hour", "timestamp").alias("timestamp")).agg(
        F.count(F.lit(1)).alias("n"),
        seen("click", "view").alias("n_browse"),
        seen("purchase").alias("n_purchase"),
        seen("signup").alias("n_signup"),
        seen("error").alias("n_error"),
        F.sum("k").alias("k_sum"),
        F.round(F.sum("value"), 4).alias("value_sum"),
        F.countDistinct("user_id").alias("users"),
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly metrics grid, dense from the first to the last hour of the whole table for every service."""
    cells = _cells(event_rows(spark, folder))
    span = cells.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    grid = cells.select("service").distinct().select(
        "service",
        F.explode(
            F.sequence(
                span.select("first").scalar(), span.select("last").scalar(), F.expr("interval 1 hour")
            )
        ).alias("timestamp"),
    )

    def share(column: str, scale: float = 1.0):
        return F.coalesce(F.lit(scale) * F.col(column) / F.col("n"), F.lit(0.0))

    inflow = F.coalesce(F.col("value_sum") / F.lit(100.0), F.lit(0.0))
    by_service = W.partitionBy("service")
    so_far = by_service.orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    rated = grid.join(cells, ["service", "timestamp"], "left").select(
        "timestamp",
        "service",
        share("n_browse", 100.0).alias("cpu_util_pct"),
        share("k_sum").alias("memory_util_pct"),
        share("n_purchase", 100.0).alias("disk_util_pct"),
        inflow.alias("network_in_mbps"),
        (F.lit(0.4) * inflow).alias("network_out_mbps"),
        F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("request_rate_rps"),
        share("value_sum").alias("latency_ms"),
        share("n_signup").alias("http_4xx_rate"),
        share("n_error").alias("http_5xx_rate"),
        F.coalesce(F.col("users"), F.lit(0)).cast("double").alias("db_connections"),
        share("users", 100.0).alias("db_connection_usage_pct"),
        F.sum(F.coalesce("n_error", F.lit(0))).over(so_far).cast("double").alias("container_restarts"),
    )
    pressure = F.col("http_5xx_rate") * F.col("request_rate_rps") * F.col("latency_ms")
    return (
        rated.withColumn("_p", pressure)
        .withColumn("healthy", ~(F.col("_p") > F.percentile("_p", F.lit(0.98)).over(by_service)))
        .drop("_p")
    )


def incidents(metric_rows: DataFrame) -> DataFrame:
    """Maximal runs of unhealthy hours, numbered by start and service."""
    so_far = W.partitionBy("service").orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    runs = (
        metric_rows.select("timestamp", "service", "healthy")
        .withColumn("_run", F.sum(F.col("healthy").cast("int")).over(so_far))
        .where(~F.col("healthy"))
        .groupBy("service", "_run")
        .agg(
            F.min("timestamp").alias("start_ts"),
            (F.max("timestamp") + F.expr("interval 1 hour")).alias("end_ts"),
        )
    )
    counted = numbered(runs, ["start_ts", "service"], "incident_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in INCIDENT_TYPES]), (F.col("incident_id") % 5 + 1).cast("int"))
    return counted.select("incident_id", "service", kind.alias("scenario_type"), "start_ts", "end_ts")


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """One log line per event."""
    level = (
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    )
    message = F.element_at(F.array(*[F.lit(m) for m in LOG_MESSAGES]), F.col("k") % 5 + 1)
    return event_rows(spark, folder).select(
        "timestamp", "service", level.alias("level"), message.alias("message"), "event_id"
    )


def daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Second telemetry source: order totals per priority and day."""
    return (
        read_table(spark, folder, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("service"),
            F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("timestamp"),
        )
        .agg(
            F.count(F.lit(1)).cast("double").alias("orders"),
            F.round(F.sum("o_totalprice"), 2).alias("revenue"),
            F.countDistinct("o_custkey").cast("double").alias("customers"),
        )
    )
