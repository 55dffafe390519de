"""The whole incident run: features, risk, evidence, diagnosis, remediation and recovery as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.config import EvidenceConfig, PolicyConfig, RecoveryConfig, RiskConfig
from emberwatch.operators.evidence import assemble, top_per_service
from emberwatch.operators.recovery import verify
from emberwatch.operators.remediation import build_plans, decide_actions, planned_status
from emberwatch.operators.risk import latest_by_service, score_risk
from emberwatch.operators.rootcause import classify
from emberwatch.plans.blocks import AUTO, Layout
from emberwatch.plans.durable import durable


@dataclass
class IncidentRun:
    scored: DataFrame
    latest: DataFrame
    evidence: DataFrame
    diagnoses: DataFrame
    actions: DataFrame
    recovery: DataFrame | None


def run(
    features: DataFrame,
    reference: DataFrame,
    feature_columns: Sequence[str],
    logs: DataFrame | None = None,
    probabilities: Sequence[str] = (),
    anomaly: str | None = None,
    risk: RiskConfig = RiskConfig(),
    evidence: EvidenceConfig = EvidenceConfig(),
    policy: PolicyConfig = PolicyConfig(),
    recovery: RecoveryConfig = RecoveryConfig(),
    mode: str = "approval",
    approved: bool = False,
    per_service: bool = True,
    after: DataFrame | None = None,
    layout: Layout = AUTO,
) -> IncidentRun:
    """Runs every stage. The scored table is written once because ranking and evidence both read it.

    ``per_service`` diagnoses the worst tick of every flagged service, otherwise only the worst of all. ``after`` holds
    features observed after remediation; the flagged services are verified against it.
    """
    scored = durable(score_risk(features, reference, risk, probabilities, anomaly), "scored")
    packages = top_per_service(assemble(features, scored, feature_columns, logs, evidence, layout))
    if not per_service:
        packages = packages.orderBy(F.col("risk_score").desc(), "service").limit(1)
    packages = durable(packages, "packages")
    diagnoses = classify(packages)
    plans = build_plans(diagnoses.select("service", "timestamp", "risk_score", "root_cause_category"))
    actions = planned_status(decide_actions(plans, mode == "autonomous", policy), mode, approved)
    checked = None
    if after is not None:
        flagged = packages.select("service")
        before_rows = features.join(flagged, "service", "left_semi")
        checked = verify(before_rows, after.join(flagged, "service", "left_semi"), recovery)
    return IncidentRun(scored, latest_by_service(scored), packages, diagnoses, actions, checked)


def fleet_report(outcome: IncidentRun) -> DataFrame:
    """Per service: level, diagnosis, number of actions, recovery verdict, and whether all stages passed."""
    planned = outcome.actions.groupBy("service").agg(F.count(F.lit(1)).alias("actions"))
    report = (
        outcome.latest.select("service", "risk_level", "risk_score")
        .join(outcome.diagnoses.select("service", "root_cause_category"), "service", "left")
        .join(planned, "service", "left")
    )
    if outcome.recovery is None:
        report = report.withColumn("recovery", F.lit(None).cast("string"))
    else:
        report = report.join(outcome.recovery.select("service", F.col("status").alias("recovery")), "service", "left")
    ok = F.coalesce((F.col("actions") > 0) & (F.col("recovery") == "SUCCESS"), F.lit(False))
    return report.withColumn("ok", ok)


def fleet_summary(report: DataFrame) -> DataFrame:
    """One row over ``fleet_report``: services, flagged, remediated, recovered and the overall pass."""
    return report.agg(
        F.count(F.lit(1)).alias("services"),
        F.count(F.when(F.col("root_cause_category").isNotNull(), 1)).alias("flagged"),
        F.count(F.when(F.col("actions") > 0, 1)).alias("remediated"),
        F.count(F.when(F.col("recovery") == "SUCCESS", 1)).alias("recovered"),
        F.bool_and("ok").alias("all_ok"),
    )
