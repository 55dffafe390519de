"""Registry of queries over the driver's tables, each with the SQL that must give the same rows.

Derived telemetry (grid, dataset, scores) is written once per session and folder and then shared: it is the feature
store the operators read from. Queries that measure or check the derivation itself build it afresh.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.config import SeriesLayout
from emberwatch.operators.detectors import Fitted, fit_zscore, score_zscore
from emberwatch.operators.labels import build_dataset
from emberwatch.operators.risk import calibration, score_risk
from emberwatch.operators.splits import time_split
from emberwatch.plans.durable import durable
from emberwatch.sources import adapter

FEATURES = adapter.FEATURES.feature_names
LABEL = adapter.LABEL
# Columns that are ranked; they carry ten digits so that equal values tie alike in both engines.
RANKED = ["Error_rate", "Latency_30t_avg", "Memory_growth_rate", "zscore_score"]
# Blocks small enough that the test scales cut every service into several of them, as production settings do large ones.
GRID = SeriesLayout(block_rows=240)
# Blocks small enough that the test scales cut every service into several of them.
EVENT_LAYOUT = SeriesLayout(bucket_sec=86_400, block_rows=100_000)


class Tables:
    """Derived tables of one data folder, written on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return adapter.read_table(self.spark, self.folder, name)

    @property
    def events(self) -> DataFrame:
        return adapter.event_rows(self.spark, self.folder)

    @property
    def logs(self) -> DataFrame:
        return adapter.logs(self.spark, self.folder)

    @cached_property
    def metrics(self) -> DataFrame:
        return durable(adapter.metrics(self.spark, self.folder), "metrics")

    @cached_property
    def incidents(self) -> DataFrame:
        return durable(adapter.incidents(self.metrics), "incidents")

    def fresh_dataset(self) -> DataFrame:
        metrics = adapter.metrics(self.spark, self.folder)
        return build_dataset(metrics, self.incidents, adapter.FEATURES, adapter.LABELS, GRID)

    @cached_property
    def dataset(self) -> DataFrame:
        return durable(build_dataset(self.metrics, self.incidents, adapter.FEATURES, adapter.LABELS, GRID), "dataset")

    @cached_property
    def split(self) -> DataFrame:
        return durable(time_split(self.dataset, adapter.SPLITS), "split")

    def part(self, name: str) -> DataFrame:
        return self.split.where(F.col("split") == name)

    @cached_property
    def zscore(self) -> Fitted:
        return fit_zscore(self.part("train"), FEATURES)

    @cached_property
    def probed(self) -> DataFrame:
        """Dataset with the z-score and two stand-in model probabilities, one of them unknown for warm-up rows."""
        scored = score_zscore(self.dataset, self.zscore, FEATURES, "zscore_score")
        scored = scored.withColumn("p_rows", probability_of_rows()).withColumn(
            "p_windows", probability_of_windows(self.dataset.agg(F.min("timestamp")).first()[0])
        )
        return durable(scored.withColumns({c: comparable(F.col(c)) for c in RANKED}), "probed")

    @cached_property
    def reference(self) -> DataFrame:
        train = self.part("train").withColumns({c: comparable(F.col(c)) for c in RANKED if c in FEATURES})
        return durable(calibration(train, adapter.RISK), "reference")

    @cached_property
    def risk(self) -> DataFrame:
        return durable(
            score_risk(self.probed, self.reference, adapter.RISK, ["p_rows", "p_windows"], "zscore_score"), "risk"
        )


def probability_of_rows() -> Column:
    """Fixed logistic function of two features, standing in for a trained row classifier."""
    return 1 / (1 + F.exp(-(F.lit(6.0) * F.col("Error_rate") + F.lit(0.01) * F.col("Latency_30t_avg") - F.lit(4.0))))


def probability_of_windows(start) -> Column:
    """Fixed logistic function that, like a window classifier, has no value before its window of 20 hours is full."""
    value = 1 / (1 + F.exp(-(F.lit(0.5) * F.col("Memory_growth_rate") + F.lit(0.05) * F.col("zscore_score"))))
    return F.when(F.col("timestamp") >= F.lit(start) + F.expr("interval 19 hours"), value)


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str, fresh: bool = False) -> Tables:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (spark.sparkContext.applicationId, folder)
    if fresh or key not in _TABLES:
        _TABLES[key] = Tables(spark, folder)
    return _TABLES[key]


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Registers ``build(tables)``; ``sql`` is the statement that must return the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


NUDGE = 1e-9  # moves exact halves off the rounding border, where engines disagree in the last bit


def comparable(c: Column, digits: int = 6) -> Column:
    """Six decimals, or ten significant digits for large values."""
    value = c.cast("double")
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))))
    return F.when(F.abs(value) < 1e4, F.round(value + F.lit(NUDGE), digits)).otherwise(F.round(value / power, 9) * power)


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Result in comparable types: times as text, doubles rounded, booleans as 0/1."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = comparable(c, digits)
        elif isinstance(field.dataType, T.BooleanType):
            c = c.cast("int")
        columns.append(c.alias(field.name))
    return df.select(*columns)
