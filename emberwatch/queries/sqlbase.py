"""Building blocks of the comparison SQL: the telemetry derivation as named subqueries."""

from __future__ import annotations

from emberwatch.config import GROWTH_PREFIXES, RISK_WEIGHTS, ROLLING_PREFIXES
from emberwatch.schemas import METRIC_NAMES
from emberwatch.sources import adapter

FEATURES = adapter.FEATURES.feature_names
LABEL = adapter.LABEL
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, body: str, *needs: str) -> None:
    BLOCKS[name] = (needs, body)


def with_blocks(select: str, *names: str) -> str:
    """``WITH`` the named blocks and everything they need, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        needs, _ = BLOCKS[name]
        for n in needs:
            add(n)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{BLOCKS[n][1]}\n)" for n in done)
    return f"WITH {parts}\n{select}" if parts else select


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded double, the same way as ``base.comparable``; adding 0 turns a negative zero into zero."""
    value = f"({expression})::DOUBLE"
    power = f"pow(1e1, floor(log10(abs({value}))))"
    return (
        f"CASE WHEN abs({value}) < 1e4 THEN round({value} + 1e-9, {digits}) + 0e0 "
        f"ELSE round({value} / {power}, 9) * {power} END" + (f' AS "{name}"' if name else "")
    )


def t(expression: str, name: str = "timestamp") -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS \"{name}\""


def texts(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


block(
    "ev",
    """
SELECT event_id, ts, 'svc-' || (user_id % 5) AS service, user_id, event_type, value,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events""",
)
block(
    "cells",
    """
SELECT service, date_trunc('hour', ts) AS ts, count(*) AS n,
       count(*) FILTER (WHERE event_type IN ('click', 'view')) AS n_browse,
       count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase,
       count(*) FILTER (WHERE event_type = 'signup') AS n_signup,
       count(*) FILTER (WHERE event_type = 'error') AS n_error,
       sum(k)::BIGINT AS k_sum, round(sum(value), 4) AS value_sum, count(DISTINCT user_id) AS users
FROM ev GROUP BY ALL""",
    "ev",
)
block(
    "rated",
    """
SELECT g.service, g.ts,
       coalesce(1e2 * n_browse / n, 0) AS cpu_util_pct,
       coalesce(1e0 * k_sum / n, 0) AS memory_util_pct,
       coalesce(1e2 * n_purchase / n, 0) AS disk_util_pct,
       coalesce(value_sum / 1e2, 0) AS network_in_mbps,
       4e-1 * coalesce(value_sum / 1e2, 0) AS network_out_mbps,
       coalesce(n, 0)::DOUBLE AS request_rate_rps,
       coalesce(value_sum / n, 0) AS latency_ms,
       coalesce(1e0 * n_signup / n, 0) AS http_4xx_rate,
       coalesce(1e0 * n_error / n, 0) AS http_5xx_rate,
       coalesce(users, 0)::DOUBLE AS db_connections,
       coalesce(1e2 * users / n, 0) AS db_connection_usage_pct,
       (sum(coalesce(n_error, 0)) OVER (PARTITION BY g.service ORDER BY g.ts ROWS UNBOUNDED PRECEDING))::DOUBLE
         AS container_restarts
FROM (SELECT s.service, h.ts FROM (SELECT DISTINCT service FROM cells) s
      CROSS JOIN (SELECT unnest(generate_series((SELECT min(ts) FROM cells), (SELECT max(ts) FROM cells),
                                                INTERVAL 1 HOUR)) AS ts) h) g
LEFT JOIN cells c ON c.service = g.service AND c.ts = g.ts""",
    "cells",
)
block(
    "metrics",
    """
SELECT x.* EXCLUDE (p), NOT (p > quantile_cont(p, 0.98) OVER (PARTITION BY service)) AS healthy
FROM (SELECT *, http_5xx_rate * request_rate_rps * latency_ms AS p FROM rated) x""",
    "rated",
)
block(
    "incidents",
    f"""
SELECT incident_id, service, ({texts(adapter.INCIDENT_TYPES)})[incident_id % 5 + 1] AS scenario_type, start_ts, end_ts
FROM (SELECT service, min(ts) AS start_ts, max(ts) + INTERVAL 1 HOUR AS end_ts,
             row_number() OVER (ORDER BY min(ts), service) AS incident_id
      FROM (SELECT service, ts, healthy,
                   sum(healthy::INT) OVER (PARTITION BY service ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
            FROM metrics)
      WHERE NOT healthy GROUP BY service, run)""",
    "metrics",
)
block(
    "log",
    f"""
SELECT ts, service, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
       ({texts(adapter.LOG_MESSAGES)})[k % 5 + 1] AS message, event_id
FROM ev""",
    "ev",
)


def over(rows: str = "") -> str:
    return f"OVER (PARTITION BY service ORDER BY ts{' ' + rows if rows else ''})"


def back(ticks: int) -> str:
    return over(f"ROWS BETWEEN {ticks - 1} PRECEDING AND CURRENT ROW")


def feature_expressions() -> list[str]:
    out = []
    for metric, prefix in ROLLING_PREFIXES.items():
        out += [f'avg({metric}) {back(n)} AS "{prefix}_{n}t_avg"' for n in (10, 20, 30)]
    for metric, prefix in GROWTH_PREFIXES.items():
        before = f"lag({metric}, 20) {over()}"
        out.append(f'coalesce(({metric} - {before}) / greatest(abs({before}), 1e-9), 0) AS "{prefix}_growth_rate"')
    out.append(f'avg(http_4xx_rate + http_5xx_rate) {back(10)} AS "Error_rate"')
    out.append(f'avg(request_rate_rps) {back(10)} AS "Request_rate"')
    out.append('cpu_util_pct / greatest(memory_util_pct, 1e-9) AS "CPU_memory_ratio"')
    out.append("latency_ms / greatest(request_rate_rps, 1e0) AS latency_per_request")
    return out


block("feat", f"SELECT service, ts, {', '.join(feature_expressions())}, healthy FROM metrics", "metrics")
block(
    "failing",
    """
SELECT m.service, m.ts,
       EXISTS (SELECT 1 FROM incidents i WHERE i.service = m.service AND i.start_ts <= m.ts AND m.ts < i.end_ts)::INT
         AS in_failure,
       (SELECT min(i.start_ts) FROM incidents i WHERE i.service = m.service AND i.start_ts > m.ts) AS next_start
FROM metrics m""",
    "incidents",
)
block(
    "lab",
    f"""
SELECT service, ts, in_failure,
       max(in_failure) {over("ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING")} AS {LABEL},
       CASE WHEN in_failure = 1 THEN 0e0 ELSE (epoch_us(next_start) - epoch_us(ts)) / 6e7 END AS time_to_failure_min
FROM failing""",
    "failing",
)
block(
    "ds",
    f"SELECT f.*, l.{LABEL}, l.in_failure, l.time_to_failure_min FROM feat f JOIN lab l USING (service, ts)",
    "feat",
    "lab",
)
block(
    "borders",
    """
SELECT max(ts) FILTER (WHERE i = c1) - INTERVAL 5 HOUR AS train_end, max(ts) FILTER (WHERE i = c1) AS val_start,
       max(ts) FILTER (WHERE i = c2) - INTERVAL 5 HOUR AS val_end, max(ts) FILTER (WHERE i = c2) AS test_start
FROM (SELECT *, least(greatest(c1 + 1, floor(n * 8e-1)), n - 1) AS c2
      FROM (SELECT *, least(greatest(1, floor(n * 6e-1)), n - 2) AS c1
            FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n
                  FROM (SELECT DISTINCT ts FROM ds))))""",
    "ds",
)
block(
    "split",
    """
SELECT * FROM (
  SELECT ds.*, CASE WHEN ts <= train_end THEN 'train' WHEN ts > val_start AND ts <= val_end THEN 'val'
                    WHEN ts > test_start THEN 'test' END AS split
  FROM ds, borders) WHERE split IS NOT NULL""",
    "borders",
)
block(
    "zfit",
    "SELECT service, "
    + ", ".join(f'avg("{f}") AS "{f}__mean", greatest(stddev_pop("{f}"), 1e-9) AS "{f}__std"' for f in FEATURES)
    + " FROM split WHERE split = 'train' GROUP BY service",
    "split",
)
Z = "greatest(" + ", ".join(f'abs((d."{f}" - z."{f}__mean") / z."{f}__std")' for f in FEATURES) + ")"
block("zs", f"SELECT d.*, {Z} AS zscore_score FROM ds d JOIN zfit z USING (service)", "zfit")
# Columns that are ranked; equal values must tie alike in both engines.
RANKED = ["Error_rate", "Latency_30t_avg", "Memory_growth_rate", "zscore_score"]
block(
    "probed",
    """
SELECT * REPLACE (""" + ", ".join(r(f'"{c}"', c) for c in RANKED) + """), 1 / (1 + exp(-(6e0 * "Error_rate" + 1e-2 * "Latency_30t_avg" - 4e0))) AS p_rows,
       CASE WHEN ts >= (SELECT min(ts) FROM zs) + INTERVAL 19 HOUR
            THEN 1 / (1 + exp(-(5e-1 * "Memory_growth_rate" + 5e-2 * zscore_score))) END AS p_windows
FROM zs""",
    "zs",
)


def share_at_or_below(feature: str) -> str:
    return (
        f'(SELECT count(*) FROM split s WHERE s.split = \'train\' AND {r('s."' + feature + '"')} <= p."{feature}")'
        " / (SELECT count(*) FROM split WHERE split = 'train')::DOUBLE"
    )


block(
    "comp",
    f"""
SELECT p.* EXCLUDE ("Error_rate"), {share_at_or_below("Error_rate")} AS error_rate, {share_at_or_below("Latency_30t_avg")} AS latency_trend,
       {share_at_or_below("Memory_growth_rate")} AS memory_growth,
       cume_dist() OVER (ORDER BY zscore_score) AS anomaly_score,
       CASE WHEN p_windows IS NULL THEN p_rows ELSE (p_rows + p_windows) / 2 END AS failure_probability
FROM probed p""",
    "probed",
    "split",
)
FUSED = " + ".join(f"{w}::DOUBLE * {c}" for c, w in RISK_WEIGHTS.items())
block(
    "risk",
    f"""
SELECT *, CASE WHEN risk_score >= 85e-2 THEN 'CRITICAL' WHEN risk_score >= 65e-2 THEN 'ANOMALOUS'
               WHEN risk_score >= 4e-1 THEN 'WARNING' ELSE 'NORMAL' END AS risk_level,
       (risk_score >= 4e-1)::INT AS risk
FROM (SELECT *, least(greatest({FUSED}, 0), 1) AS risk_score FROM comp)""",
    "comp",
)


def long_of(source: str, columns, name: str = "feature", value: str = "value", ids: str = "") -> str:
    """UNION ALL form of unpivot, keeping ids."""
    lead = f"{ids}, " if ids else ""
    return " UNION ALL ".join(f"SELECT {lead}'{c}' AS {name}, \"{c}\"::DOUBLE AS {value} FROM {source}" for c in columns)


METRIC_LIST = ", ".join(METRIC_NAMES)
