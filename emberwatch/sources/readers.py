"""Raw telemetry readers. A location may hold CSV, JSON lines and Parquet side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions.columns import null_if_nan, parse_time
from emberwatch.schemas import INCIDENT_TABLE, LOG_TABLE, METRIC_TABLE, as_text_times

# File-name prefix of each raw table; files below a dt= folder match whatever their name, at any depth.
PREFIXES = {"metrics": "metrics", "logs": "logs", "incidents": "ground_truth"}
FORMATS = {"csv": "csv", "jsonl": "json", "parquet": "parquet"}
GLOBS = {"csv": "*.csv", "jsonl": "*.{jsonl,json}", "parquet": "*.parquet"}  # Spark writes JSON lines as .json


def _try_read(spark: SparkSession, fmt: str, schema: T.StructType, location: str, prefix: str, suffix: str) -> DataFrame | None:
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", GLOBS[suffix])
    if fmt == "csv":
        # files written at different times may order their columns differently
        reader = reader.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
    try:
        df = reader.format(fmt).load(location)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return df.where(F.col("_metadata.file_path").rlike(_wanted(prefix, suffix)))


def _wanted(prefix: str, suffix: str) -> str:
    """Files named after the table at any depth, files in folders named so by a writer, and all below a dt= folder."""
    return f"/dt(=|%3D)[^/]*/|/{prefix}[^/]*[.]{suffix}($|/)"


def read_raw(spark: SparkSession, location: str, prefix: str, schema: T.StructType) -> DataFrame:
    """All files of one table below ``location``, whatever their format, with the file they came from.

    Folders are searched at any depth. Times in text files are parsed from mixed formats; NaN becomes NULL.
    """
    frames = []
    for suffix, fmt in FORMATS.items():
        declared = schema if fmt == "parquet" else as_text_times(schema)
        df = _try_read(spark, fmt, declared, location, prefix, suffix)
        if df is None:
            continue
        columns = []
        for field in schema.fields:
            column = F.col(field.name)
            if isinstance(field.dataType, T.TimestampType) and fmt != "parquet":
                column = parse_time(column)
            elif isinstance(field.dataType, T.DoubleType):
                column = null_if_nan(column)
            columns.append(column.alias(field.name))
        frames.append(
            df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
            if fmt == "parquet"
            else df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
        )
    if not frames:
        empty = T.StructType([*schema.fields, T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())])
        return spark.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, frames)


def keep_last(df: DataFrame, keys: tuple[str, ...] = ("timestamp", "service")) -> DataFrame:
    """One row per key: the last one by file and position in the file. Partial maxima, no sort of a key."""
    kept = [c for c in df.columns if c not in ("_file", "_row")]
    order = F.struct("_file", "_row")
    return df.groupBy(*keys).agg(F.max_by(F.struct(*kept), order).alias("row")).select("row.*")


def read_metrics(spark: SparkSession, location: str) -> DataFrame:
    """Metrics without duplicates of (timestamp, service)."""
    return keep_last(read_raw(spark, location, PREFIXES["metrics"], METRIC_TABLE))


def read_logs(spark: SparkSession, location: str) -> DataFrame:
    return read_raw(spark, location, PREFIXES["logs"], LOG_TABLE).drop("_file", "_row")


def read_incidents(spark: SparkSession, location: str) -> DataFrame:
    """Incident windows; an open incident has no end."""
    return read_raw(spark, location, PREFIXES["incidents"], INCIDENT_TABLE).drop("_file", "_row")


def load_raw(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """metrics, logs and incidents of a dataset root; incidents from ``raw/truth``, else from ``raw/metrics``."""
    root = root.rstrip("/")
    truth = read_incidents(spark, f"{root}/raw/truth")
    if truth.isEmpty():
        truth = read_incidents(spark, f"{root}/raw/metrics")
    return {
        "metrics": read_metrics(spark, f"{root}/raw/metrics"),
        "logs": read_logs(spark, f"{root}/raw/logs"),
        "incidents": truth,
    }


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A reference or target table by suffix: Parquet, CSV or comma-separated text. A text file is read twice unless its
    schema is given."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if lowered.endswith((".csv", ".txt")):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"unsupported dataset format: {path}")
