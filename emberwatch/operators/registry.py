"""Experiment registry: versions, lookups, comparison, idempotent backfill and the dataset fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberwatch.functions.columns import stable_id

EXPERIMENTS = (
    "experiment_id string, family string, model string, model_version int, dataset_version string, "
    "dataset map<string,string>, hyperparameters map<string,string>, metrics map<string,map<string,double>>, "
    "model_path string, trained_at timestamp, status string, notes map<string,string>"
)


def next_version(records: DataFrame) -> DataFrame:
    """Next free version per (family, model)."""
    return records.groupBy("family", "model").agg((F.max("model_version") + 1).alias("next_version"))


def assign_versions(records: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Numbers new records per (family, model) in time order, continuing after the existing ones."""
    order = W.partitionBy("family", "model").orderBy("trained_at", "experiment_id")
    numbered = records.withColumn("model_version", F.row_number().over(order))
    if existing is None:
        return numbered
    used = existing.groupBy("family", "model").agg(F.max("model_version").alias("_used"))
    joined = numbered.join(used, ["family", "model"], "left")
    return joined.withColumn("model_version", F.col("model_version") + F.coalesce("_used", F.lit(0))).drop("_used")


def metric_value(metric: str = "f1", split: str = "test") -> Column:
    return F.col("metrics")[split][metric]


def get(records: DataFrame, experiment_id: str) -> DataFrame:
    return records.where(F.col("experiment_id") == experiment_id)


def latest(records: DataFrame) -> DataFrame:
    """Newest record per (family, model)."""
    return _pick(records, F.struct("trained_at", "model_version", "experiment_id"))


def best(records: DataFrame, metric: str = "f1", split: str = "test") -> DataFrame:
    """Best successful record per (family, model); the earliest one on ties."""
    value = metric_value(metric, split)
    scored = records.where((F.col("status") == "ok") & value.isNotNull())
    order = F.struct(value.alias("value"), (-F.unix_micros("trained_at")).alias("early"), F.col("experiment_id"))
    return _pick(scored, order)


def _pick(records: DataFrame, order: Column) -> DataFrame:
    names = records.columns
    return records.groupBy("family", "model").agg(F.max_by(F.struct(*names), order).alias("row")).select("row.*")


def models(records: DataFrame) -> DataFrame:
    """Distinct family/model keys."""
    return records.select(F.concat_ws("/", "family", "model").alias("model_key")).distinct().orderBy("model_key")


def compare(records: DataFrame, metric: str = "f1", split: str = "test") -> DataFrame:
    """Best record per model, highest value first."""
    value = metric_value(metric, split)
    return (
        best(records, metric, split)
        .select(
            "family",
            "model",
            "model_version",
            "dataset_version",
            F.lit(split).alias("split"),
            F.lit(metric).alias("metric"),
            value.alias("value"),
            "experiment_id",
        )
        .orderBy(F.col("value").desc(), "model")
    )


def untracked(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose (family, model, dataset_version) is not in the registry yet."""
    return candidates.join(existing, ["family", "model", "dataset_version"], "left_anti")


def backfill(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append: new candidates with versions and ids. Running it twice appends nothing the second time."""
    fresh = untracked(candidates, existing).withColumn(
        "experiment_id", stable_id(F.col("family"), F.col("model"), F.col("dataset_version"))
    )
    return assign_versions(fresh, existing)


LANES = 8  # of 32 bits each, together a SHA-256 digest


def row_text(df: DataFrame, digits: int = 6) -> Column:
    """One text per row that no other row has: every value with its length in front, ``-`` for null.

    Doubles are counted in units of ``digits`` decimals and times in microseconds, so that the text depends neither on how an
    engine prints them nor on a session's zone.
    """
    parts = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if field.dataType.typeName() in ("double", "float"):
            value = F.when(F.isnan(value), "nan").otherwise(F.round(value * F.lit(float(10**digits))).cast("decimal(38,0)").cast("string"))
        elif field.dataType.typeName() == "timestamp":
            value = F.unix_micros(value).cast("string")  # no zone of a session in it
        else:
            value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


def content_hash(df: DataFrame) -> DataFrame:
    """Order-insensitive fingerprint of a table: row count, and the lane-wise sums of the rows' SHA-256 digests.

    Sums are modulo 2^32, so fingerprints of parts add up to that of the whole and can be taken off again; see
    ``merge_content``. A row that occurs twice counts twice.
    """
    digest = F.sha2(row_text(df).cast("binary"), 256)
    lane = lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)")
    sums = [(F.coalesce(F.sum(lane(k)), F.lit(0)) % F.lit(1 << 32)).cast("long").alias(f"lane_{k}") for k in range(LANES)]
    return df.agg(F.count(F.lit(1)).alias("rows"), *sums)


def merge_content(hashes: DataFrame) -> DataFrame:
    """Fingerprint of the rows of all ``hashes``; those with a negative ``sign`` are taken off."""
    sign = F.col("sign") if "sign" in hashes.columns else F.lit(1)
    sums = [F.pmod(F.sum(F.col(f"lane_{k}") * sign), F.lit(1 << 32)).alias(f"lane_{k}") for k in range(LANES)]
    return hashes.agg(F.sum(F.col("rows") * sign).alias("rows"), *sums)


def dataset_version(df: DataFrame, facts: Sequence[Column] = ()) -> DataFrame:
    """``ds-`` and 12 hex characters over the content hash and further facts such as split sizes."""
    return version_of(content_hash(df), facts)


def version_of(content: DataFrame, facts: Sequence[Column] = ()) -> DataFrame:
    parts = [F.col("rows"), *[F.col(f"lane_{k}") for k in range(LANES)], *facts]
    return content.select(F.concat(F.lit("ds-"), stable_id(*parts)).alias("dataset_version"), "rows")


def table_metadata(
    df: DataFrame, feature_columns: Sequence[str], label_columns: Sequence[str], interval_sec: int, horizon_min: int
) -> DataFrame:
    """One row describing a feature table."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("service").alias("n_services"),
        F.array_sort(F.collect_set("service")).alias("services"),
        F.min("timestamp").alias("start_ts"),
        F.max("timestamp").alias("end_ts"),
    ).select(
        "*",
        F.array(*[F.lit(c) for c in feature_columns]).alias("feature_columns"),
        F.array(*[F.lit(c) for c in label_columns]).alias("label_columns"),
        F.lit(interval_sec).alias("interval_sec"),
        F.lit(horizon_min).alias("prediction_window_min"),
    )
