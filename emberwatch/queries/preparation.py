"""Features, labels, splits and the dataset build."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F


from emberwatch.functions.columns import iso, parse_time
from emberwatch.operators import incidents as windows
from emberwatch.operators.features import build_features, growth_rate, rolling_mean
from emberwatch.operators.labels import build_labels, join_labels
from emberwatch.operators.registry import LANES, dataset_version, table_metadata
from emberwatch.operators.splits import split_borders, split_report, time_split
from emberwatch.plans.blocks import home_rows, series
from emberwatch.queries.base import EVENT_LAYOUT, FEATURES, GRID, LABEL, Tables, comparable, query
from emberwatch.queries.sqlbase import r, t, with_blocks
from emberwatch.schemas import METRIC_NAMES
from emberwatch.sources import adapter

KEYS = ["timestamp", "service"]
AVERAGES = [name for name, _, _ in adapter.FEATURES.rolling]
GROWTHS = [name for name, _, _ in adapter.FEATURES.growth]


def rounded(names) -> str:
    return ", ".join(r(f'"{n}"', n) for n in names)


def ids() -> str:
    return f"{t('ts')}, service"


# --- the grid itself --------------------------------------------------------------------------------------------------


@query("u0_telemetry_grid", with_blocks(f"SELECT {ids()}, {rounded(METRIC_NAMES)}, healthy::INT AS healthy FROM metrics", "metrics"))
def _(x: Tables):
    return adapter.metrics(x.spark, x.folder)


@query(
    "p1_normalize_timestamps",
    f"SELECT event_id, {t('ts', 'parsed')} FROM events",
)
def _(x: Tables):
    """Times of all events written in five formats and parsed back."""
    ts = F.col("ts").cast("timestamp")
    written = (
        F.when(F.col("event_type") == "click", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        .when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(F.col("event_type") == "purchase", F.date_format(ts, "yyyy/MM/dd HH:mm:ss"))
        .when(F.col("event_type") == "signup", F.date_format(ts, "dd.MM.yyyy HH:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    )
    return x.read("events").select("event_id", iso(parse_time(written)).alias("parsed"))


# --- row windows ------------------------------------------------------------------------------------------------------


@query("w1_rolling_mean", with_blocks(f"SELECT {ids()}, {rounded(AVERAGES)} FROM feat", "feat"))
def _(x: Tables):
    return build_features(x.metrics, adapter.FEATURES, GRID).select(*KEYS, *AVERAGES)


EVENT_MEANS = {"value_10": ("value", 10), "value_50": ("value", 50), "k_20": ("k", 20)}


@query(
    "w1_rolling_mean_events",
    with_blocks(
        "SELECT event_id, service, "
        + ", ".join(
            r(
                f"avg({c}) OVER (PARTITION BY service ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)",
                name,
            )
            for name, (c, n) in EVENT_MEANS.items()
        )
        + " FROM ev",
        "ev",
    ),
)
def _(x: Tables):
    """Rolling means over single events: five series that grow with the table, so they are cut into blocks."""
    rows, _, window = series(x.events, EVENT_LAYOUT, 49, order=("timestamp", "event_id"))
    means = [rolling_mean(F.col(c), window, n).alias(name) for name, (c, n) in EVENT_MEANS.items()]
    return home_rows(rows.select("event_id", "service", *means, "_home", "_block"))


@query("w2_growth_rate", with_blocks(f"SELECT {ids()}, {rounded(GROWTHS)} FROM feat", "feat"))
def _(x: Tables):
    return build_features(x.metrics, adapter.FEATURES, GRID).select(*KEYS, *GROWTHS)


@query(
    "w2_growth_rate_events",
    with_blocks(
        "SELECT event_id, service, "
        + r(
            "coalesce((value - lag(value, 30) OVER (PARTITION BY service ORDER BY ts, event_id)) / "
            "greatest(abs(lag(value, 30) OVER (PARTITION BY service ORDER BY ts, event_id)), 1e-9), 0)",
            "growth",
        )
        + " FROM ev",
        "ev",
    ),
)
def _(x: Tables):
    rows, _, window = series(x.events, EVENT_LAYOUT, 30, order=("timestamp", "event_id"))
    growth = growth_rate(F.col("value"), window, 30, 1e-9)
    return home_rows(rows.select("event_id", "service", growth.alias("growth"), "_home", "_block"))


@query("w3_error_rate", with_blocks(f"SELECT {ids()}, {rounded(['Error_rate'])} FROM feat", "feat"))
def _(x: Tables):
    return build_features(x.metrics, adapter.FEATURES, GRID).select(*KEYS, "Error_rate")


@query("w4_request_rate", with_blocks(f"SELECT {ids()}, {rounded(['Request_rate'])} FROM feat", "feat"))
def _(x: Tables):
    return build_features(x.metrics, adapter.FEATURES, GRID).select(*KEYS, "Request_rate")


@query("p3_cpu_memory_ratio", with_blocks(f"SELECT {ids()}, {rounded(['CPU_memory_ratio'])} FROM feat", "feat"))
def _(x: Tables):
    return build_features(x.metrics, adapter.FEATURES, GRID).select(*KEYS, "CPU_memory_ratio")


@query("p4_latency_per_request", with_blocks(f"SELECT {ids()}, {rounded(['latency_per_request'])} FROM feat", "feat"))
def _(x: Tables):
    return build_features(x.metrics, adapter.FEATURES, GRID).select(*KEYS, "latency_per_request")


@query("p5_passthrough", with_blocks(f"SELECT {ids()}, healthy::INT AS healthy FROM feat", "feat"))
def _(x: Tables):
    return build_features(x.metrics, adapter.FEATURES, GRID).select(*KEYS, "healthy")


# --- labels -----------------------------------------------------------------------------------------------------------


@query("j2_in_failure", with_blocks(f"SELECT {ids()}, in_failure FROM lab", "lab"))
def _(x: Tables):
    return build_labels(x.metrics, x.incidents, adapter.LABELS, GRID).select(*KEYS, "in_failure")


@query("j3_next_incident", with_blocks(f"SELECT {ids()}, {rounded(['time_to_failure_min'])} FROM lab", "lab"))
def _(x: Tables):
    return build_labels(x.metrics, x.incidents, adapter.LABELS, GRID).select(*KEYS, "time_to_failure_min")


@query(
    "j3_next_incident_events",
    with_blocks(
        "SELECT e.event_id, e.service, "
        "EXISTS (SELECT 1 FROM incidents i WHERE i.service = e.service AND i.start_ts <= e.ts AND e.ts < i.end_ts)::INT AS in_failure, "
        + r(
            "CASE WHEN EXISTS (SELECT 1 FROM incidents i WHERE i.service = e.service AND i.start_ts <= e.ts AND e.ts < i.end_ts) THEN 0e0 "
            "ELSE (epoch_us((SELECT min(i.start_ts) FROM incidents i WHERE i.service = e.service AND i.start_ts > e.ts)) - epoch_us(e.ts)) / 6e7 END",
            "time_to_failure_min",
        )
        + " FROM ev e",
        "ev",
        "incidents",
    ),
)
def _(x: Tables):
    """Every event against the incident windows, swept in time buckets."""
    from emberwatch.operators.labels import mark_failures

    marked = mark_failures(x.events.select("event_id", *KEYS), x.incidents, adapter.LABELS, EVENT_LAYOUT)
    return marked.select(
        "event_id", "service", F.col("_failing").alias("in_failure"), F.col("_minutes").alias("time_to_failure_min")
    )


@query("w5_forward_label", with_blocks(f"SELECT {ids()}, {LABEL} FROM lab", "lab"))
def _(x: Tables):
    return build_labels(x.metrics, x.incidents, adapter.LABELS, GRID).select(*KEYS, LABEL)


@query(
    "j1_features_with_labels",
    with_blocks(
        f"SELECT {ids()}, {rounded(['Error_rate', 'Memory_growth_rate'])}, in_failure, {LABEL}, {rounded(['time_to_failure_min'])} FROM ds",
        "ds",
    ),
)
def _(x: Tables):
    joined = join_labels(build_features(x.metrics, adapter.FEATURES, GRID), build_labels(x.metrics, x.incidents, adapter.LABELS, GRID))
    return joined.select(*KEYS, "Error_rate", "Memory_growth_rate", "in_failure", LABEL, "time_to_failure_min")


@query(
    "w16_incident_tracking",
    with_blocks(f"SELECT incident_id, service, {t('start_ts', 'start_ts')}, {t('end_ts', 'end_ts')} FROM incidents", "incidents"),
)
def _(x: Tables):
    return windows.track_incidents(x.metrics, adapter.HOUR, GRID).select("incident_id", "service", "start_ts", "end_ts")


@query(
    "i20_dataset_build",
    with_blocks(
        f"SELECT {ids()}, {rounded(FEATURES)}, healthy::INT AS healthy, in_failure, {LABEL}, {rounded(['time_to_failure_min'])}, split FROM split",
        "split",
    ),
)
def _(x: Tables):
    """From events to the labelled, split feature table."""
    return time_split(x.fresh_dataset(), adapter.SPLITS)


@query(
    "t1_sorted_series",
    with_blocks(f"SELECT {ids()}, row_number() OVER (PARTITION BY service ORDER BY ts) AS tick_no FROM metrics", "metrics"),
)
def _(x: Tables):
    ordered = x.metrics.select(*KEYS).orderBy("service", "timestamp")
    return ordered.withColumn("tick_no", F.row_number().over(W.partitionBy("service").orderBy("timestamp")).cast("long"))


# --- split ------------------------------------------------------------------------------------------------------------


@query(
    "i19_time_split",
    with_blocks(f"SELECT {ids()}, split FROM split", "split"),
)
def _(x: Tables):
    return time_split(x.dataset, adapter.SPLITS).select(*KEYS, "split")


@query(
    "i19_split_borders",
    with_blocks(
        ", ".join(["SELECT " + t("train_end", "train_end"), t("val_start", "val_start"), t("val_end", "val_end"), t("test_start", "test_start")])
        + ", (SELECT count(DISTINCT ts) FROM ds) AS instants FROM borders",
        "borders",
    ),
)
def _(x: Tables):
    return split_borders(x.dataset, adapter.SPLITS)


ORDER_BORDERS = """
WITH days AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n
              FROM (SELECT DISTINCT date_trunc('day', o_orderdate) AS ts FROM orders)),
cut AS (SELECT max(least(greatest(1, floor(n * 6e-1)), n - 2)) AS c1,
               max(least(greatest(least(greatest(1, floor(n * 6e-1)), n - 2) + 1, floor(n * 8e-1)), n - 1)) AS c2 FROM days),
b AS (SELECT max(ts) FILTER (WHERE i = c1) AS t1, max(ts) FILTER (WHERE i = c2) AS t2 FROM days, cut),
s AS (SELECT o_orderkey, CASE WHEN o_orderdate <= t1 - INTERVAL 7 DAY THEN 'train'
                   WHEN o_orderdate > t1 AND o_orderdate <= t2 - INTERVAL 7 DAY THEN 'val'
                   WHEN o_orderdate > t2 THEN 'test' END AS split
      FROM orders, b)
SELECT o_orderkey, split FROM s WHERE split IS NOT NULL"""


@query("i19_time_split_orders", ORDER_BORDERS)
def _(x: Tables):
    """All orders split by date with a purge of a week."""
    from emberwatch.config import SplitConfig

    orders = x.read("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("timestamp"))
    return time_split(orders, SplitConfig(purge_min=7 * 1440, interval_sec=86_400)).select("o_orderkey", "split")


@query(
    "a11_split_report",
    with_blocks(
        f"""SELECT split, count(*) AS rows, count(DISTINCT service) AS services, {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')},
        {r(f'avg({LABEL})', f'{LABEL}_rate')}, {r('avg(in_failure)', 'in_failure_rate')},
        0 AS overlap_pairs, 1 AS chronological FROM split GROUP BY split""",
        "split",
    ),
)
def _(x: Tables):
    return split_report(x.split, [LABEL, "in_failure"])


@query(
    "u5_distinct_timestamps",
    with_blocks(f"SELECT DISTINCT {t('ts')} FROM metrics", "metrics"),
)
def _(x: Tables):
    return x.metrics.select("timestamp").distinct()


@query(
    "a12_table_metadata",
    with_blocks(
        f"""SELECT count(*) AS n_rows, count(DISTINCT service) AS n_services, list_sort(list(DISTINCT service)) AS services,
        {t('min(ts)', 'start_ts')}, {t('max(ts)', 'end_ts')}, 26 AS features, 2 AS labels, 3600 AS interval_sec,
        300 AS prediction_window_min FROM ds""",
        "ds",
    ),
)
def _(x: Tables):
    meta = table_metadata(x.dataset, FEATURES, adapter.LABELS.label_columns, adapter.HOUR, 300)
    return meta.select(
        "n_rows", "n_services", "services", "start_ts", "end_ts", F.size("feature_columns").alias("features"),
        F.size("label_columns").alias("labels"), "interval_sec", "prediction_window_min",
    )


def content_sql(texts: list[str], source: str) -> str:
    """Version of the rows of ``source``, whose columns are given as texts."""
    row = " || ".join(f"coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')" for x in texts)
    lanes = [f"sum(('0x' || substr(d, {1 + 8 * k}, 8))::BIGINT)::HUGEINT % 4294967296" for k in range(LANES)]
    parts = " || '|' || ".join(f"({x})::VARCHAR" for x in ["count(*)", *lanes])
    return f"SELECT 'ds-' || substr(sha256({parts}), 1, 12) AS dataset_version, count(*) AS rows FROM (SELECT sha256({row}) AS d FROM {source})"


@query(
    "i21_dataset_version",
    with_blocks(
        content_sql(
            ["epoch_us(ts)::VARCHAR", "service", "split", f"{LABEL}::VARCHAR", *[f"(round(({r(f'"{c}"')}) * 1e6))::HUGEINT::VARCHAR" for c in FEATURES]],
            "split",
        ),
        "split",
    ),
)
def _(x: Tables):
    """Fingerprint of the split dataset."""
    return dataset_version(x.split.select(*KEYS, "split", LABEL, *[comparable(F.col(c)).alias(c) for c in FEATURES]))


@query(
    "j14_tiled_schedule",
    with_blocks(
        f"""SELECT service, scenario_type, {r('(epoch_us(start_ts) - epoch_us((SELECT min(ts) FROM metrics))) / 6e7 + rep * 43200e0', 'start_min')},
        {r('(epoch_us(end_ts) - epoch_us(start_ts)) / 6e7', 'duration_min')}
        FROM incidents CROSS JOIN (VALUES (0), (1), (2)) v(rep)""",
        "incidents",
    ),
)
def _(x: Tables):
    """The observed incidents as a schedule, repeated for three months."""
    return windows.tile_schedule(observed_schedule(x), 3, 43_200)


def observed_schedule(x: Tables):
    first = x.metrics.agg(F.min("timestamp").alias("first")).select("first").scalar()
    minute = F.lit(60_000_000.0)
    return x.incidents.select(
        "service",
        "scenario_type",
        ((F.unix_micros("start_ts") - F.unix_micros(first)) / minute).alias("start_min"),
        ((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / minute).alias("duration_min"),
    )


