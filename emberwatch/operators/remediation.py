"""Remediation plans, the safety policy, execution status, rollback and the approval queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.config import PolicyConfig
from emberwatch.functions.columns import stable_id
from emberwatch.operators.rootcause import UNKNOWN

# Action templates per category in plan order, the action registry, risk order, modes.
PLANS = {
    "memory_leak": [
        ("restart_container", "Roll-restart the service to reclaim leaked memory"),
        ("create_incident_ticket", "Open a memory-leak diagnosis ticket (heap dump + profile)"),
    ],
    "connection_pool_exhaustion": [
        ("scale_replicas", "Scale up replicas to relieve pool pressure"),
        ("clear_cache", "Flush local caches holding pooled connections"),
        ("create_incident_ticket", "Open a connection-pool tuning ticket"),
    ],
    "latency_spike": [
        ("scale_replicas", "Scale up replicas to cut queue depth"),
        ("clear_cache", "Clear hot-path cache to refresh stale entries"),
        ("create_incident_ticket", "Open latency/SLO breach ticket"),
    ],
    "network_partition": [
        ("restart_container", "Restart the service to re-establish connectivity"),
        ("create_incident_ticket", "Open network-partition ticket for mesh/firewall check"),
    ],
    "disk_fill": [
        ("clear_cache", "Free disk by evicting temp/cache data"),
        ("restart_container", "Restart the service to release file handles and temp files"),
        ("create_incident_ticket", "Open disk-capacity ticket (cleanup + alarm)"),
    ],
    "code_deployment": [
        ("restart_container", "Roll back the failed deployment by restarting prior image"),
        ("create_incident_ticket", "Open deployment-regression ticket"),
    ],
    "traffic_spike": [
        ("scale_replicas", "Scale up replicas to absorb traffic burst"),
        ("clear_cache", "Validate cached responses for burst traffic"),
        ("create_incident_ticket", "Open traffic-spike ticket"),
    ],
    "unknown": [("create_incident_ticket", "Open investigatory ticket for unknown root cause")],
}
REGISTRY = {  # action -> (risk, reversible, rollback action, parameters the rollback needs)
    "restart_container": ("medium", True, "rollback_restart", ["container"]),
    "clear_cache": ("low", True, "rollback_clear_cache", ["service"]),
    "scale_replicas": ("low", True, "rollback_scale", ["service"]),
    "create_incident_ticket": ("low", False, "rollback_ticket", ["ticket_id"]),
}
REPLICAS_ADDED = 2
RISKS = {"low": 1, "medium": 2, "high": 3}
MODES = ("advisory", "approval", "autonomous")


def plan_table(spark: SparkSession) -> DataFrame:
    """(category, step, action, description)"""
    rows = [(c, i + 1, a, d) for c, steps in PLANS.items() for i, (a, d) in enumerate(steps)]
    return spark.createDataFrame(rows, "category string, step int, action string, description string")


def registry_table(spark: SparkSession) -> DataFrame:
    rows = [(a, *entry) for a, entry in REGISTRY.items()]
    return spark.createDataFrame(
        rows, "action string, action_risk string, reversible boolean, rollback string, rollback_params array<string>"
    )


def build_plans(diagnoses: DataFrame, category: str = "root_cause_category", replicas: str | None = None) -> DataFrame:
    """One row per planned action of every diagnosis; a category without a plan uses the one of ``unknown``.

    Both joined tables are constants of this module (a few rows), so broadcasting them is safe at any data size.
    """
    spark = diagnoses.sparkSession
    known = F.when(F.col(category).isin(*PLANS), F.col(category)).otherwise(UNKNOWN)
    planned = (
        diagnoses.withColumn("category", known)
        .join(F.broadcast(plan_table(spark)), "category")
        .join(F.broadcast(registry_table(spark)), "action")
    )
    service, action = F.col("service"), F.col("action")
    current = F.col(replicas) if replicas else F.lit(1)
    target = F.when(action == "restart_container", F.create_map(F.lit("container"), service)).otherwise(
        F.create_map(F.lit("service"), service)
    )
    summary = F.concat(F.lit("["), service, F.lit("] "), F.replace("category", F.lit("_"), F.lit(" ")), F.lit(" detected"))
    extra = (
        F.when(
            action == "scale_replicas",
            F.create_map(F.lit("count"), (current.cast("int") + REPLICAS_ADDED).cast("string")),
        )
        .when(
            action == "create_incident_ticket",
            F.create_map(F.lit("category"), F.col("category"), F.lit("summary"), summary),
        )
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return planned.withColumn("params", F.map_concat(target, extra))


def _risk_rank(risk: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in RISKS.items() for x in pair])[risk]


def decide_actions(plans: DataFrame, autonomous: bool, policy: PolicyConfig = PolicyConfig(), incident=("service",)):
    """Adds ``decision`` (execute / propose) and ``reason`` per action, in plan order per incident.

    An incident has at most as many rows as its plan has steps, so the running count is over a handful of rows.
    """
    if not autonomous:
        return plans.withColumn("decision", F.lit("propose")).withColumn("reason", F.lit("requires approval"))
    names = "[" + ", ".join(f"'{n}'" for n in sorted(policy.whitelist)) + "]"
    listed = F.col("action").isin(*policy.whitelist)
    within = _risk_rank(F.col("action_risk")) <= RISKS[policy.max_risk]
    allowed = listed & within
    earlier = W.partitionBy(*incident).orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.col("_allowed").cast("int")).over(earlier), F.lit(0))
    full = F.col("_used") >= policy.max_actions
    reason = (
        F.when(full, f"exceeds max_actions_per_incident={policy.max_actions}")
        .when(~listed, F.format_string(f"action '%s' not in autonomous whitelist: {names}", "action"))
        .when(~within, F.format_string(f"risk '%s' exceeds autonomous limit '{policy.max_risk}'", "action_risk"))
        .otherwise("ok")
    )
    return (
        plans.withColumn("_allowed", allowed)
        .withColumn("_used", used)
        .withColumn("decision", F.when(F.col("_allowed") & ~full, "execute").otherwise("propose"))
        .withColumn("reason", reason)
        .drop("_allowed", "_used")
    )


def planned_status(decided: DataFrame, mode: str, approved: bool = False) -> DataFrame:
    """Adds ``status``: what the executor would do with each action under the mode."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "autonomous":
        status = F.when(F.col("decision") == "execute", "execute").otherwise("requires_approval")
    elif mode == "approval" and approved:
        status = F.lit("execute")
    else:
        status = F.lit("planned")
    return decided.withColumn("mode", F.lit(mode)).withColumn("status", status)


def rollback_plan(executed: DataFrame) -> DataFrame:
    """Reverses executed actions (status ``ok``) that can be reversed, keeping only the parameters rollback needs."""
    ok = F.col("status") == "ok"
    undo = ok & F.col("reversible")
    needed = F.map_filter("params", lambda k, _: F.array_contains("rollback_params", k))
    return (
        executed.withColumn("rollback_status", F.when(undo, "rollback").otherwise("skipped"))
        .withColumn(
            "detail",
            F.when(~ok, "nothing to roll back").when(~F.col("reversible"), "not reversible").otherwise(F.col("rollback")),
        )
        .withColumn("rollback_arguments", F.when(undo, needed))
    )


def execution_counts(results: DataFrame, incident=("service",)) -> DataFrame:
    """Executed and pending actions per incident, and whether everything ran."""
    return results.groupBy(*incident).agg(
        F.count(F.lit(1)).alias("actions"),
        F.count(F.when(F.col("status") == "ok", 1)).alias("executed"),
        F.count(F.when(F.col("status") == "requires_approval", 1)).alias("pending"),
        F.bool_and(F.col("status") == "ok").alias("all_ok"),
    )


def approval_requests(plans: DataFrame, created_at: Column) -> DataFrame:
    """One 'created' event per incident with its steps; ids derive from the content, so a re-run adds nothing new."""
    incident = ["service", "timestamp", "category"]
    steps = F.array_sort(F.collect_list(F.struct("step", "action")))  # a plan has a few steps
    return plans.groupBy(*incident).agg(steps.alias("plan")).select(
        stable_id(*[F.col(c) for c in incident]).alias("approval_id"),
        "service",
        "category",
        F.lit("created").alias("event"),
        created_at.alias("event_ts"),
        "plan",
    )


def pending_approvals(events: DataFrame, now: Column, ttl_min: float = 60.0) -> DataFrame:
    """Requests whose latest event is 'created' and that are not older than the time to live, by id."""
    names = events.columns
    latest = events.groupBy("approval_id").agg(
        F.max_by(F.struct(*names), F.struct("event_ts", "event")).alias("row")
    ).select("row.*")
    age = (F.unix_micros(now) - F.unix_micros("event_ts")) / F.lit(60_000_000.0)
    return latest.where((F.col("event") == "created") & (age <= ttl_min)).orderBy("approval_id")
