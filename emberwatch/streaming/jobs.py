"""Structured Streaming jobs: ingest, de-duplication, rolling features, incidents, risk, drift, log correlation.

Every job takes a streaming telemetry frame. Watermarks state how late a row may be; ``split_late`` puts later rows into a
table of their own instead of letting them vanish, and ``late_rows`` counts them by their time of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberwatch.config import DriftConfig, FeatureConfig, RiskConfig
from emberwatch.operators.drift import dataset_drift, feature_drift
from emberwatch.operators.features import build_features
from emberwatch.operators.intervals import points_in_intervals
from emberwatch.operators.risk import latest_by_service, score_risk
from emberwatch.plans.durable import durable
from emberwatch.sources.sinks import hour_partition
from emberwatch.streaming.history import History

LATENESS = "10 minutes"
DRAIN = {"availableNow": True}  # trigger of a bounded run; a service passes e.g. {"processingTime": "30 seconds"}


def stream_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_batch: int | None = None):
    """File-source stream with a declared schema."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.format(fmt).load(path)


def utc(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Zone-less times become UTC timestamps, which watermarks require."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def ingest(stream: DataFrame, path: str, checkpoint: str, time: str = "timestamp", available_now: bool = False):
    """Continuous append to hour partitions. File sink plus checkpoint make each input row appear exactly once."""
    dated = stream.withColumn("dt", hour_partition(F.col(time)))
    writer = dated.writeStream.format("parquet").partitionBy("dt").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def deduplicate(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """One row per (timestamp, service); state is dropped once the watermark has passed."""
    return stream.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["timestamp", "service"])


def rolling_means(
    stream: DataFrame, metric: str, length: str = "5 minutes", step: str = "30 seconds", lateness: str = LATENESS
) -> DataFrame:
    """Event-time rolling mean per service. On a gap-free grid the window ending one step after a tick equals the row
    window of that tick."""
    return (
        stream.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", length, step), "service")
        .agg(F.avg(metric).alias("mean"), F.count(metric).alias("ticks"))
        .select("service", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "ticks")
    )


def features_in_batches(
    stream: DataFrame,
    store: str,
    out_path: str,
    checkpoint: str,
    config: FeatureConfig = FeatureConfig(),
    trigger: dict = DRAIN,
):
    """Row-frame features on a stream, equal to the batch result whatever gaps the series have and however late rows are.

    Rows go to a history (see ``history``), from which a micro-batch takes the ``lookback`` rows before its own, also those
    of a late row, and the ``lookback`` rows after them, whose features a late row changes. New rows are written below
    ``out_path/rows``, changed ones below ``out_path/revised``; ``streamed_features`` reads the newest of each. A row whose
    key came before is a duplicate and is left out.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        history = History(batch.sparkSession, store, batch.schema)
        known = history.fences(epoch)
        own = history.append(batch, epoch, known)
        rows = history.around(epoch, known, own, config.lookback)
        changed = lambda window: [F.max("_new").over(window.rowsBetween(-config.lookback, 0)).alias("_changed")]
        featured = build_features(rows, replace(config, passthrough=(*config.passthrough, "_new")), also=changed)
        featured = durable(featured.where("_changed").drop("_changed"), "features")
        for name, wanted in (("rows", "_new"), ("revised", "not _new")):
            featured.where(wanted).drop("_new").write.mode("overwrite").parquet(f"{out_path}/{name}/epoch={epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def streamed_features(spark: SparkSession, out_path: str) -> DataFrame:
    """Newest features of every key that ``features_in_batches`` wrote; a shuffle carries revised rows only."""
    keys = ["service", "timestamp"]
    rows, revised = (spark.read.parquet(f"{out_path}/{name}") for name in ("rows", "revised"))
    newest = F.max_by(F.struct(*[c for c in revised.columns if c not in keys]), "epoch")
    newest = revised.groupBy(*keys).agg(newest.alias("row")).select(*keys, "row.*").select(*rows.columns)
    return rows.join(revised.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).unionByName(newest).drop("epoch")


INCIDENT_EVENTS = "service string, event string, start_ts timestamp, end_ts timestamp"
INCIDENT_STATE = "open_start long, last_bad long, times array<long>, healthy array<boolean>"


def _incident_events(
    times: np.ndarray, healthy: np.ndarray, start: int | None, last_bad: int | None, step: int
) -> tuple[list[tuple], int | None, int | None]:
    """Starts and ends among ticks in time order, and the open incident after them."""
    bad = ~healthy
    before = np.r_[start is not None, bad[:-1]]
    events: list[tuple] = []
    for i in np.flatnonzero(bad != before):  # only where health changes
        if bad[i]:
            start = int(times[i])
            events.append(("start", start, None))
        else:
            end = int(times[i - 1]) if i else last_bad
            events.append(("end", start, end + step))
            start = None
    if bad.any():
        last_bad = int(times[np.flatnonzero(bad)[-1]])
    return events, start, last_bad


def _event_rows(service: str, events: list[tuple]) -> pd.DataFrame:
    stamp = lambda x: pd.Timestamp(x, unit="us") if x is not None else pd.NaT
    rows = [(service, kind, stamp(a), stamp(b)) for kind, a, b in events]
    return pd.DataFrame(rows, columns=["service", "event", "start_ts", "end_ts"])


def track_incidents(stream: DataFrame, interval_sec: int, lateness: str = LATENESS) -> DataFrame:
    """Starts and ends of incidents per service, as the batch operator finds them.

    Ticks wait in the state of their service until the watermark has passed them, so a late tick takes its place in
    time. As in the batch, only a healthy tick closes an incident, one interval after its last unhealthy tick.
    ``flush_incidents`` gives what is still waiting when the stream is stopped.
    """
    step = interval_sec * 1_000_000

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last_bad, times, healthy = state.get if state.exists else (None, None, [], [])
        times, healthy = [np.asarray(times, "int64")], [np.asarray(healthy, bool)]
        if not state.hasTimedOut:
            for ticks in batches:
                times.append(ticks["timestamp"].astype("datetime64[us]").astype("int64").to_numpy())
                healthy.append(ticks["healthy"].to_numpy(bool))
        at, good = np.concatenate(times), np.concatenate(healthy)
        order = np.argsort(at, kind="stable")
        at, good = at[order], good[order]
        done = int(np.searchsorted(at, state.getCurrentWatermarkMs() * 1000, side="right"))
        events, start, last_bad = _incident_events(at[:done], good[:done], start, last_bad, step)
        state.update((start, last_bad, at[done:].tolist(), good[done:].tolist()))
        if done < len(at):
            state.setTimeoutTimestamp(int(at[done]) // 1000 + 1)
        if events:
            yield _event_rows(key[0], events)

    return (
        stream.select("timestamp", "service", "healthy")
        .withWatermark("timestamp", lateness)
        .groupBy("service")
        .applyInPandasWithState(advance, INCIDENT_EVENTS, INCIDENT_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def flush_incidents(spark: SparkSession, checkpoint: str, interval_sec: int) -> DataFrame:
    """Events of the ticks that a stopped ``track_incidents`` stream still holds back, from its state. An incident that
    remains open ends with its last unhealthy tick."""
    step = interval_sec * 1_000_000
    held = spark.read.format("statestore").load(checkpoint).select("key.service", "value.groupState.*")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = lambda x: None if pd.isna(x) else int(x)
        for rows in batches:
            for r in rows.itertuples():
                waiting = np.asarray(r.times, "int64"), np.asarray(r.healthy, bool)
                events, start, last = _incident_events(*waiting, known(r.open_start), known(r.last_bad), step)
                if start is not None:
                    events.append(("end", start, last + step))
                yield _event_rows(r.service, events)

    return held.mapInPandas(finish, INCIDENT_EVENTS)


def risk_in_batches(
    features: DataFrame,
    reference: DataFrame,
    out_path: str,
    checkpoint: str,
    config: RiskConfig = RiskConfig(),
    probabilities: Sequence[str] = (),
    trigger: dict = DRAIN,
):
    """Scores each micro-batch and keeps the newest row per service as table ``out_path``.

    The table holds one row per service. Each epoch writes its own folder from the one before, so a replayed epoch
    yields the same result.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = latest_by_service(score_risk(batch, reference, config, probabilities))
        if epoch > 0:
            before = spark.read.parquet(f"{out_path}/epoch={epoch - 1}")
            fresh = latest_by_service(fresh.unionByName(before, allowMissingColumns=True))
        fresh.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    return features.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def drift_in_batches(
    stream: DataFrame,
    reference: DataFrame,
    columns: Sequence[str],
    out_path: str,
    checkpoint: str,
    config: DriftConfig = DriftConfig(),
    trigger: dict = DRAIN,
):
    """Compares every micro-batch with the training reference and writes one summary row per batch."""

    def step(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        summary = dataset_drift(feature_drift(reference, batch, columns, config), config)
        summary.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out_path}/batch={epoch}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def correlate_in_batches(
    incidents: DataFrame, logs: DataFrame, store: str, out_path: str, checkpoint: str, trigger: dict = DRAIN
):
    """Serious log lines inside ``[start_ts, end_ts]`` of an incident of their service, from two streams.

    Both streams are appended to tables below ``store``. A micro-batch joins its new incidents with all lines and its
    new lines with the earlier incidents, so every match appears exactly once, however long an incident lasted and
    however late either side arrives; no state has to be bounded in time. Lines lie in hour partitions, and only those of
    the new incidents are read again.
    """
    left = incidents.select(F.lit("incident").alias("kind"), "service", "start_ts", "end_ts", *_nulls(LOG_PART))
    right = logs.where(F.col("level").isin("WARNING", "ERROR"))
    right = right.select(F.lit("log").alias("kind"), "service", *_nulls(INCIDENT_PART), "timestamp", "level", "message")

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        windows = batch.where("kind = 'incident'").select("service", "start_ts", "end_ts")
        lines = batch.where("kind = 'log'").select("service", "timestamp", "level", "message")
        lines.withColumn("dt", hour_partition(F.col("timestamp"))).write.mode("overwrite").partitionBy("dt").parquet(
            f"{store}/logs/epoch={epoch}"
        )
        windows.write.mode("overwrite").parquet(f"{store}/incidents/epoch={epoch}")
        named = windows.withColumnRenamed("service", "incident_service")
        everything = lines
        found = None
        if epoch > 0:
            span = windows.agg(F.date_format(F.min("start_ts"), "yyyy-MM-dd-HH"), F.date_format(F.max("end_ts"), "yyyy-MM-dd-HH")).first()
            stored = spark.read.schema(f"{LOG_ROW}, epoch int, dt string").option("basePath", f"{store}/logs").parquet(f"{store}/logs")
            if span[0] is not None:
                stored = stored.where((F.col("epoch") < epoch) & F.col("dt").between(span[0], span[1]))
                everything = lines.unionByName(stored.select(*lines.columns))
            known = spark.read.schema(f"{INCIDENT_ROW}, epoch int").option("basePath", f"{store}/incidents").parquet(f"{store}/incidents")
            # only incidents that any of the new lines can lie in; Parquet statistics skip the others
            seen = lines.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
            if seen["first"] is not None:
                known = known.where((F.col("epoch") < epoch) & (F.col("end_ts") >= F.lit(seen["first"])) & (F.col("start_ts") <= F.lit(seen["last"])))
                found = _lines_inside(lines, known.select(*windows.columns).withColumnRenamed("service", "incident_service"))
        new = _lines_inside(everything, named)
        (new if found is None else new.unionByName(found)).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        batch.unpersist()

    return left.unionByName(right).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


INCIDENT_PART = {"start_ts": "timestamp", "end_ts": "timestamp"}
LOG_PART = {"timestamp": "timestamp", "level": "string", "message": "string"}
INCIDENT_ROW = "service string, start_ts timestamp, end_ts timestamp"
LOG_ROW = "service string, timestamp timestamp, level string, message string"


def _nulls(columns: dict[str, str]) -> list[Column]:
    return [F.lit(None).cast(kind).alias(name) for name, kind in columns.items()]


def _lines_inside(lines: DataFrame, incidents: DataFrame) -> DataFrame:
    windows = incidents.withColumn("service", F.col("incident_service"))
    return points_in_intervals(lines, windows, ["service"], "start_ts", "end_ts", closed=True).select(
        "incident_service", "start_ts", "end_ts", "timestamp", "level", "message"
    )


def split_late(
    stream: DataFrame, store: str, out_path: str, late_path: str, checkpoint: str, lateness_sec: int = 600, trigger: dict = DRAIN
):
    """Lateness policy of a stream: rows at or below the watermark go to ``late_path``, all others to ``out_path``.

    The watermark of a micro-batch is the latest event time of the batches before it, less the allowed lateness; it never
    falls. What is counted as late is what was taken out, and every row is in exactly one table. A stateful stream over
    ``out_path`` with the same lateness drops nothing more, as its own watermark is never ahead. Rows without time are
    late. Each epoch keeps the watermark after it below ``store``, so a replayed epoch decides alike.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{store}/epoch={epoch - 1}").first()["latest"] if epoch else None
        batch = batch.persist()
        in_time = F.col("timestamp").isNotNull()
        if before is not None:
            in_time = in_time & (F.unix_micros("timestamp") > before - lateness_sec * 1_000_000)
        batch.where(in_time).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        batch.where(~in_time).write.mode("overwrite").parquet(f"{late_path}/epoch={epoch}")
        latest = F.greatest(F.max(F.unix_micros("timestamp")), F.lit(before).cast("long")).alias("latest")
        batch.agg(latest).write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def late_rows(stream: DataFrame, lateness_sec: int = 600) -> DataFrame:
    """Rows per service that arrive later than allowed, by comparing event time with arrival time."""
    arrived = F.col("arrival") if "arrival" in stream.columns else F.current_timestamp()
    late = (F.unix_micros(arrived) - F.unix_micros("timestamp")) > lateness_sec * 1_000_000
    return stream.groupBy("service").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(late, 1)).alias("late"))
