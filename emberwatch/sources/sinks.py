"""Partitioned sinks, the feature store, append-only journals and report files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.operators.registry import table_metadata

MAX_RECORDS_PER_FILE = 5_000_000


def hour_partition(timestamp: Column) -> Column:
    """Partition value ``yyyy-MM-dd-HH`` of a timestamp."""
    return F.date_format(timestamp, "yyyy-MM-dd-HH")


def append_hourly(df: DataFrame, path: str, time: str = "timestamp", fmt: str = "parquet") -> None:
    """Append below ``dt=`` folders. Rows are first brought together per hour, so an hour is written by few tasks
    instead of leaving one tiny file per task; AQE splits an hour that is too large for one task."""
    dated = df.withColumn("dt", hour_partition(F.col(time))).hint("rebalance", "dt")
    writer = dated.write.mode("append").partitionBy("dt").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
    if fmt == "csv":
        writer = writer.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    writer.format(fmt).save(path)


def append_metrics(df: DataFrame, root: str, fmt: str = "parquet") -> None:
    append_hourly(df, f"{root}/raw/metrics", "timestamp", fmt)


def append_logs(df: DataFrame, root: str, fmt: str = "parquet") -> None:
    append_hourly(df, f"{root}/raw/logs", "timestamp", fmt)


def append_incidents(df: DataFrame, root: str, fmt: str = "parquet") -> None:
    append_hourly(df, f"{root}/raw/truth", "start_ts", fmt)


class FeatureStore:
    """Feature tables and splits below one folder, each table with a one-row metadata table beside it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write_table(
        self,
        df: DataFrame,
        name: str,
        feature_columns: list[str],
        label_columns: list[str],
        interval_sec: int,
        horizon_min: int,
        fmt: str = "parquet",
    ) -> None:
        writer = df.write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(self._path(name))
        stored = self.spark.read.parquet(self._path(name)) if fmt == "parquet" else df
        meta = table_metadata(stored, feature_columns, label_columns, interval_sec, horizon_min)
        meta.withColumn("name", F.lit(name)).write.mode("overwrite").parquet(self._path(f"{name}.meta"))

    def _read(self, path: str) -> DataFrame:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                raise FileNotFoundError(path) from None
            raise

    def read_table(self, name: str) -> DataFrame:
        return self._read(self._path(name))

    def read_metadata(self, name: str) -> DataFrame:
        return self._read(self._path(f"{name}.meta"))

    def write_splits(self, split: DataFrame, name: str = "splits") -> None:
        split.hint("rebalance", "split").write.mode("overwrite").option(
            "maxRecordsPerFile", MAX_RECORDS_PER_FILE
        ).partitionBy("split").parquet(self._path(name))

    def read_splits(self, name: str = "splits") -> DataFrame:
        return self._read(self._path(name))

    def load_split(self, split: str, name: str = "splits") -> DataFrame:
        """One split; only its folder is read."""
        return self.read_splits(name).where(F.col("split") == split).drop("split")


class Journal:
    """Append-only JSON-lines log: diagnoses, remediation, recovery, experiments.

    Every append is a segment of files, each of a narrow span of time, and an index row per file: its records with a time,
    and the first and last of these times. The newest records are found through the index, so a tail opens the few files
    that can hold them, however long the journal is. Records without time count as oldest.
    """

    def __init__(self, spark: SparkSession, path: str, schema, time: str = "timestamp"):
        self.spark, self.path, self.schema, self.time = spark, path.rstrip("/"), schema, time

    def append(self, df: DataFrame) -> None:
        segment = uuid.uuid4().hex
        df.repartitionByRange(F.col(self.time)).write.json(f"{self.path}/data/{segment}")
        rows = self.spark.read.schema(self.schema).json(f"{self.path}/data/{segment}")
        time = F.col(self.time)
        files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.count(time).alias("records"), F.min(time).alias("first"), F.max(time).alias("last")
        )
        files.coalesce(1).write.parquet(f"{self.path}/index/{segment}")

    def _read(self, read: Callable[[], DataFrame], schema) -> DataFrame:
        try:
            return read()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def read(self) -> DataFrame:
        reader = self.spark.read.schema(self.schema).option("recursiveFileLookup", True)
        return self._read(lambda: reader.json(f"{self.path}/data"), self.schema)

    def index(self) -> DataFrame:
        reader = self.spark.read.schema(JOURNAL_INDEX).option("recursiveFileLookup", True)
        return self._read(lambda: reader.parquet(f"{self.path}/index"), JOURNAL_INDEX)

    def since(self, first) -> DataFrame:
        """Records of time ``first`` and later; files that end before it are not opened."""
        files = [r["file"] for r in self.index().where(F.col("last") >= F.lit(first)).select("file").collect()]
        rows = self.spark.read.schema(self.schema)
        rows = rows.json(files) if files else self.spark.createDataFrame([], self.schema)
        return rows.where(F.col(self.time) >= F.lit(first))

    def tail(self, limit: int, *tie_breakers: str) -> DataFrame:
        """The newest ``limit`` records, oldest first. Sort-and-limit keeps ``limit`` rows per task."""
        # The newest files by their first record hold `limit` records or more, as none is empty: no older one can matter.
        held = self.index().where("records > 0").orderBy(F.col("first").desc()).limit(max(limit, 0)).select("records", "first").collect()
        total = 0
        for row in held:
            total += row["records"]
            if total >= limit:
                return newest(self.since(row["first"]), limit, self.time, *tie_breakers)
        return newest(self.read(), limit, self.time, *tie_breakers)


JOURNAL_INDEX = "file string, records long, first timestamp, last timestamp"


def newest(df: DataFrame, limit: int, time: str = "timestamp", *tie_breakers: str) -> DataFrame:
    last_first = [F.col(c).desc() for c in (time, *tie_breakers)]
    return df.orderBy(*last_first).limit(max(limit, 0)).orderBy(time, *tie_breakers)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines. Reports are small by construction (rows per check, feature, model or split)."""
    df.write.mode("overwrite").json(path)
