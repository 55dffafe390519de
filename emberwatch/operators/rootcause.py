"""Root-cause category of an evidence package, and validation of answers written by a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.columns import half_even, total_of

# Categories in tie-break order, keywords per category, feature-name tokens per category.
CATEGORIES = (
    "memory_leak",
    "connection_pool_exhaustion",
    "latency_spike",
    "network_partition",
    "disk_fill",
    "code_deployment",
    "traffic_spike",
)
UNKNOWN = "unknown"
KEYWORDS = {
    "memory_leak": [
        "memory", "gc", "heap", "oom", "out of memory", "outofmemory", "leak", "allocation", "metaspace",
    ],
    "connection_pool_exhaustion": [
        "connection pool", "pool exhausted", "exhaustion", "connections", "jdbc", "acquire", "max pool", "borrow",
        "timeout acquiring",
    ],
    "latency_spike": [
        "latency", "p99", "p95", "queue depth", "queue buildup", "slow query", "request timeout", "saturated",
        "blocked thread",
    ],
    "network_partition": [
        "network", "unreachable", "refused", "partition", "reconnect", "downstream", "connect reset", "no route",
        "host is down",
    ],
    "disk_fill": [
        "disk", "space", "no space left", "device", "filesystem", "storage", "inode", "write error",
    ],
    "code_deployment": ["deployment", "release", "rollout", "v2.", "canary", "rollback", "config change"],
    "traffic_spike": ["traffic", "load spike", "qps", "requests per second", "autoscaler", "scaled up"],
}
FEATURE_TOKENS = {
    "memory_leak": ["memory_growth", "cpu_memory", "memory"],
    "connection_pool_exhaustion": ["request_rate", "db_usage", "error_rate", "latency_per_request"],
    "latency_spike": ["latency", "latency_per_request"],
    "network_partition": ["network_in", "network_out"],
    "disk_fill": ["disk", "disk_growth"],
}
# Wording of the probable causes.
SUMMARIES = {
    "memory_leak": "Sustained memory growth and GC pressure consistent with a memory leak in the service runtime.",
    "connection_pool_exhaustion": "Connection pool exhaustion: demand exceeded available downstream connections, causing acquire timeouts.",
    "latency_spike": "Latency spike driven by an exhausted or saturated upstream path (queue buildup / slow processing).",
    "network_partition": "Network partition or downstream unreachability: connectivity loss between the service and its dependencies.",
    "disk_fill": "Disk capacity filling: filesystem pressure from log or storage growth on the node.",
    "code_deployment": "Behavior change correlated with a recent deployment, indicating a regression.",
    "traffic_spike": "Unusual traffic surge overwhelming current capacity.",
    "unknown": "No single dominant signal; further investigation required.",
}
# Wording of the recommended actions.
ACTIONS = {
    "memory_leak": "Trigger a heap dump and memory-profile analysis; roll the service if confirmed.",
    "connection_pool_exhaustion": "Increase or tune the connection pool limit and check downstream latency; restart pools.",
    "latency_spike": "Scale horizontally to reduce queue depth and enable request shedding on non-critical paths.",
    "network_partition": "Verify service mesh / firewall / DNS; check for flapping replicas and downstream health.",
    "disk_fill": "Free disk space, rotate logs, and add a disk-utilisation alarm for earlier warning.",
    "code_deployment": "Roll back the most recent deployment to mitigate while the regression is analysed.",
    "traffic_spike": "Trigger autoscaling and engage rate limiting to absorb the surge.",
    "unknown": "Collect additional traces and correlate upstream dependency health.",
}


def keyword_points(text: Column, category: str) -> Column:
    """Two points per keyword of the category that occurs in the lower-cased text."""
    return total_of([F.when(text.contains(k), 2.0).otherwise(0.0) for k in KEYWORDS[category]])


def feature_points(features: Column, category: str) -> Column:
    """One and a half points per anomalous feature whose name contains a token of the category."""
    tokens = FEATURE_TOKENS.get(category)
    if not tokens:
        return F.lit(0.0)

    def matches(feature: Column) -> Column:
        name = F.replace(F.lower(feature["feature"]), F.lit("-"), F.lit("_"))
        hit = name.contains(tokens[0])
        for token in tokens[1:]:
            hit = hit | name.contains(token)
        return hit

    return F.size(F.filter(features, matches)) * F.lit(1.5)


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key]


def decide_category(points: dict[str, Column]) -> tuple[Column, Column]:
    """Category with most points (list order on ties; unknown without any point) and the confidence."""
    ordered = F.array(*[points[c] for c in CATEGORIES])
    best = F.array_max(ordered)
    total = total_of([points[c] for c in CATEGORIES])
    name = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), F.array_position(ordered, best).cast("int"))
    category = F.when(best > 0, name).otherwise(UNKNOWN)
    share = best / F.when(total == 0, 1.0).otherwise(total)
    confidence = F.when(best > 0, half_even(F.least(F.lit(0.98), F.lit(0.3) + share), 2)).otherwise(0.3)
    return category, confidence


def classify_text(df: DataFrame, text: str) -> DataFrame:
    """Adds category and confidence from keywords in a plain text column."""
    points = {c: F.col(f"_p_{c}") for c in CATEGORIES}
    category, confidence = decide_category(points)
    scored = df.withColumn("_text", F.lower(F.col(text))).withColumns(
        {f"_p_{c}": keyword_points(F.col("_text"), c) for c in CATEGORIES}
    )
    return scored.withColumn("root_cause_category", category).withColumn("confidence_score", confidence).drop(
        "_text", *[f"_p_{c}" for c in CATEGORIES]
    )


def classify(evidence: DataFrame, text_source: str = "logs_only") -> DataFrame:
    """Adds the diagnosis to evidence packages.

    ``logs_only`` looks for keywords in the log messages; ``full_json`` in the whole package, where field names and
    action texts count as well.
    """
    if text_source == "logs_only":
        text = F.array_join(F.transform("correlated_logs", lambda log: log["message"]), "\n")
    elif text_source == "full_json":
        text = F.to_json(F.struct(*evidence.columns))
    else:
        raise ValueError(f"unknown text source: {text_source}")
    growth = F.coalesce(F.col("components")["memory_growth"], F.lit(0.0))
    staged = evidence.withColumn("_text", F.lower(text))

    def points(category: str) -> Column:
        score = keyword_points(F.col("_text"), category) + feature_points(F.col("top_anomalous_features"), category)
        return score + F.when(growth > 0.75, 1.0).otherwise(0.0) if category == "memory_leak" else score

    staged = staged.withColumns({f"_p_{c}": points(c) for c in CATEGORIES})
    category, confidence = decide_category({c: F.col(f"_p_{c}") for c in CATEGORIES})
    return (
        staged.withColumn("root_cause_category", category)
        .withColumn("confidence_score", confidence)
        .withColumn("probable_root_cause", _lookup(SUMMARIES, F.col("root_cause_category")))
        .withColumn("recommended_action", _lookup(ACTIONS, F.col("root_cause_category")))
        .withColumn("evidence", snippets())
        .drop("_text", *[f"_p_{c}" for c in CATEGORIES])
    )


def snippets(limit: int = 8) -> Column:
    """Up to eight short observations: components, four deltas, four features, four log lines."""

    def number(value: Column, digits: int) -> Column:
        return F.format_string(f"%.{digits}f", value)

    components = F.transform(
        F.filter(F.map_entries("components"), lambda e: e["value"].isNotNull()),
        lambda e: F.concat(F.lit("component "), e["key"], F.lit(" = "), number(e["value"], 3)),
    )
    deltas = F.transform(
        F.slice(F.map_entries("metrics_deltas"), 1, 4),
        lambda e: F.concat(F.lit("metric "), e["key"], F.lit(" delta = "), number(e["value"], 1)),
    )
    features = F.transform(
        F.slice("top_anomalous_features", 1, 4),
        lambda f: F.concat(
            F.lit("feature "), f["feature"], F.lit(" z="), number(f["zscore"], 2), F.lit(" ("), f["direction"], F.lit(")")
        ),
    )
    logs = F.transform(F.slice("correlated_logs", 1, 4), lambda log: F.concat(F.lit("log: "), log["message"]))
    everything = F.slice(F.concat(components, deltas, features, logs), 1, limit)
    return F.when(F.size(everything) > 0, everything).otherwise(F.array(F.lit("no structured evidence available")))


ANSWER = (
    "probable_root_cause string, confidence_score string, recommended_action string, root_cause_category string, "
    "evidence array<string>"
)


def parse_answers(df: DataFrame, answer: str, fallback_text: str | None = None) -> DataFrame:
    """Validates model-written answers as a column job.

    Code fences are ignored by taking the outermost braces. An answer is accepted when all required keys are there, the
    cause is not empty and the confidence lies in [0, 1]; an unknown category becomes ``unknown``. Everything else gets
    the keyword diagnosis of ``fallback_text`` and the status ``fallback_heuristic``.
    """
    body = F.regexp_extract(F.trim(F.col(answer)), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, ANSWER)
    text = fallback_text or answer
    staged = classify_text(df.withColumn("_a", parsed), text)
    a = F.col("_a")
    confidence = a["confidence_score"].try_cast("double")
    valid = F.coalesce(
        (F.length(F.trim(a["probable_root_cause"])) > 0)
        & confidence.between(0.0, 1.0)
        & a["recommended_action"].isNotNull(),
        F.lit(False),
    )
    known = F.when(a["root_cause_category"].isin(*CATEGORIES), a["root_cause_category"]).otherwise(UNKNOWN)
    staged = staged.withColumn("_ok", valid)
    ok = F.col("_ok")
    return (
        staged.withColumn("status", F.when(ok, "ok").otherwise("fallback_heuristic"))
        .withColumn("root_cause_category", F.when(ok, known).otherwise(F.col("root_cause_category")))
        .withColumn("confidence_score", F.when(ok, confidence).otherwise(F.col("confidence_score")))
        .withColumn(
            "probable_root_cause",
            F.when(ok, F.trim(a["probable_root_cause"])).otherwise(_lookup(SUMMARIES, F.col("root_cause_category"))),
        )
        .withColumn(
            "recommended_action",
            F.when(ok, F.trim(a["recommended_action"])).otherwise(_lookup(ACTIONS, F.col("root_cause_category"))),
        )
        .drop("_a", "_ok")
    )


def prompts(evidence: DataFrame, instructions: str | None = None) -> DataFrame:
    """(timestamp, service, prompt) rows for batch inference elsewhere: instructions plus the package as JSON."""
    allowed = ", ".join([*CATEGORIES, UNKNOWN])
    lead = instructions or (
        "Name the most likely root cause of this service incident. Use only the evidence given. Answer with one JSON "
        "object holding probable_root_cause, root_cause_category, evidence, confidence_score (0 to 1) and "
        f"recommended_action. root_cause_category is one of: {allowed}."
    )
    package = F.to_json(F.struct(*evidence.columns))
    return evidence.select("timestamp", "service", F.concat(F.lit(lead + "\n\n"), package).alias("prompt"))
