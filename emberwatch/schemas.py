"""Schemas of the raw tables. Raw files are always read with these; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Metric -> (unit, lower bound, upper bound); None = unbounded above.
METRICS = {
    "cpu_util_pct": ("%", 0.0, 100.0),
    "memory_util_pct": ("%", 0.0, 100.0),
    "disk_util_pct": ("%", 0.0, 100.0),
    "network_in_mbps": ("Mbps", 0.0, None),
    "network_out_mbps": ("Mbps", 0.0, None),
    "request_rate_rps": ("req/s", 0.0, None),
    "latency_ms": ("ms", 0.0, None),
    "http_4xx_rate": ("fraction", 0.0, 1.0),
    "http_5xx_rate": ("fraction", 0.0, 1.0),
    "db_connections": ("count", 0.0, None),
    "db_connection_usage_pct": ("%", 0.0, 100.0),
    "container_restarts": ("count", 0.0, None),
}
METRIC_NAMES = list(METRICS)
LOG_LEVELS = ("INFO", "WARNING", "ERROR")


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


METRIC_TABLE = _schema(
    timestamp=T.TimestampType(),
    service=T.StringType(),
    **{name: T.DoubleType() for name in METRIC_NAMES},
    healthy=T.BooleanType(),
)
LOG_TABLE = _schema(
    timestamp=T.TimestampType(), service=T.StringType(), level=T.StringType(), message=T.StringType()
)
INCIDENT_TABLE = _schema(
    incident_id=T.LongType(),
    service=T.StringType(),
    scenario_type=T.StringType(),
    start_ts=T.TimestampType(),
    end_ts=T.TimestampType(),
)


def as_text_times(schema: T.StructType) -> T.StructType:
    """The same table as it looks in CSV and JSON lines: times are text in mixed ISO formats."""
    return T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType)
            for f in schema.fields
        ]
    )
