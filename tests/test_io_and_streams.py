import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberwatch.config import FeatureConfig
from emberwatch.functions.columns import parse_time
from emberwatch.operators.features import build_features
from emberwatch.operators.incidents import track_incidents
from emberwatch.operators.risk import calibration
from emberwatch.plans.durable import durable, shared_folder
from emberwatch.schemas import INCIDENT_TABLE, LOG_TABLE, METRIC_TABLE
from emberwatch.sources.readers import load_dataset, load_raw, read_logs, read_metrics
from emberwatch.sources.sinks import FeatureStore, Journal, append_incidents, append_logs, append_metrics
from emberwatch.streaming import history, jobs
from tests.frames import START, metrics, series_frame, tick


def test_mixed_time_formats(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01 01:00:00+01:00", "2024/01/01 00:00:00", "01.01.2024 00:00:00", "2024-01-01", "soon"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_time(F.col("t"))).collect()]
    assert got == [START] * 5 + [None]


def test_last_read_duplicate_wins(spark, tmp_path):
    old = metrics(spark, 4, ("a",))
    new = metrics(spark, 4, ("a",), lambda s, i: {"cpu_util_pct": 77.0})
    old.coalesce(1).write.parquet(f"{tmp_path}/metrics_1.parquet")
    text = new.coalesce(1).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    text.write.option("header", True).csv(f"{tmp_path}/metrics_2.csv")
    df = read_metrics(spark, str(tmp_path))
    assert df.count() == 4 and {r["cpu_util_pct"] for r in df.collect()} == {77.0}
    assert df.columns == METRIC_TABLE.fieldNames()


def test_hourly_layout_round_trip(spark, tmp_path):
    root = str(tmp_path)
    grid = metrics(spark, 240, ("a", "b"))
    append_metrics(grid, root)
    append_logs(spark.createDataFrame([(tick(0), "a", "INFO", "x")], LOG_TABLE), root)
    append_incidents(spark.createDataFrame([(1, "a", "t", tick(0), None)], INCIDENT_TABLE), root)
    raw = load_raw(spark, root)
    assert (raw["metrics"].count(), raw["logs"].count(), raw["incidents"].count()) == (480, 1, 1)
    assert raw["incidents"].first()["end_ts"] is None
    hours = sorted(p.name for p in (tmp_path / "raw" / "metrics").iterdir() if p.is_dir())
    assert hours == ["dt=2024-01-01-00", "dt=2024-01-01-01"]


def test_files_are_found_at_any_depth(spark, tmp_path):
    rows = [spark.createDataFrame([(tick(i), "a", "INFO", str(i))], LOG_TABLE).coalesce(1) for i in range(5)]
    rows[0].write.parquet(f"{tmp_path}/2024/logs_a.parquet")
    rows[1].write.parquet(f"{tmp_path}/region/dt=2024-01-01-00/any.parquet")
    rows[2].write.parquet(f"{tmp_path}/logs.parquet")
    rows[3].write.parquet(f"{tmp_path}/2024/other.parquet")  # another table
    text = rows[4].withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ssXXX"))
    text.write.json(f"{tmp_path}/x/y/logs_b.jsonl")
    assert sorted(r["message"] for r in read_logs(spark, str(tmp_path)).collect()) == ["0", "1", "2", "4"]


def test_nothing_there_is_empty_or_an_error(spark, tmp_path):
    assert read_metrics(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        FeatureStore(spark, str(tmp_path)).read_table("missing")
    with pytest.raises(ValueError, match="unsupported"):
        load_dataset(spark, "x.xlsx")


def test_feature_store_and_pruned_splits(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    df = series_frame(spark, 20, y=lambda i: 0)
    store.write_table(df, "t", ["f1"], ["y"], 30, 10)
    meta = store.read_metadata("t").first()
    assert (meta["n_rows"], meta["n_services"], meta["services"], meta["feature_columns"]) == (40, 2, ["a", "b"], ["f1"])
    store.write_splits(df.withColumn("split", F.when(F.col("timestamp") < F.lit(tick(10)), "train").otherwise("test")))
    part = store.load_split("train")
    assert part.count() == 20 and "split" not in part.columns
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_journal_tail(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "j"), "timestamp timestamp, n int")
    assert journal.read().count() == 0
    for i in (2, 0, 1):
        journal.append(spark.createDataFrame([(tick(i), i)], journal.schema))
    assert [r["n"] for r in journal.tail(2).collect()] == [1, 2] and journal.tail(0).count() == 0
    assert [r["n"] for r in journal.tail(9).collect()] == [0, 1, 2]


def test_journal_tail_opens_few_files(spark, tmp_path):
    """Of forty appends, some of which overlap in time or lack it, the newest records come from the files that can hold them."""
    journal = Journal(spark, str(tmp_path / "j"), "timestamp timestamp, n int")
    rows = [(tick(i), i) for i in range(200)]
    for k in range(40):
        journal.append(spark.createDataFrame(rows[5 * k : 5 * k + 5], journal.schema).coalesce(1))
    journal.append(spark.createDataFrame([(tick(0), -1), (tick(199), 500), (None, -2)], journal.schema))
    tail = journal.tail(20, "n")
    assert [r["n"] for r in tail.collect()] == [*range(181, 200), 500]
    assert len(tail.inputFiles()) <= 10 and len(journal.read().inputFiles()) > 40
    assert [r["n"] for r in journal.tail(300, "n").collect()][:3] == [-2, -1, 0]
    assert [r["n"] for r in journal.since(tick(198)).orderBy("n").collect()] == [198, 199, 500]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = Elsewhere

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session)
    assert shared_folder(spark) == shared_folder(spark)
    assert durable(spark.range(5)).count() == 5


# --- streams ----------------------------------------------------------------------------------------------------------


def in_slices(df, path, by="timestamp", parts=3):
    """Files in time order, one per slice."""
    ordered = df.orderBy(by).toPandas()
    size = -(-len(ordered) // parts)
    for i in range(parts):
        chunk = ordered.iloc[i * size : (i + 1) * size]
        df.sparkSession.createDataFrame(chunk, df.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def sink(df, path, checkpoint):
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def test_ingest_is_exactly_once(spark, tmp_path):
    source = in_slices(metrics(spark, 30), f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        stream = jobs.stream_table(spark, source, METRIC_TABLE, per_batch=1)
        jobs.ingest(stream, f"{tmp_path}/out", f"{tmp_path}/ck", available_now=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60


def test_duplicates_are_dropped(spark, tmp_path):
    df = metrics(spark, 30)
    stream = jobs.stream_table(spark, in_slices(df.unionByName(df), f"{tmp_path}/in"), METRIC_TABLE)
    sink(jobs.deduplicate(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60


def test_stream_features_equal_batch(spark, tmp_path):
    df = metrics(spark, 120, change=lambda s, i: {"cpu_util_pct": (i * 31 % 97) * 1.0})
    stream = jobs.stream_table(spark, in_slices(df, f"{tmp_path}/in", parts=4), METRIC_TABLE, per_batch=1)
    jobs.features_in_batches(stream, f"{tmp_path}/hist", f"{tmp_path}/out", f"{tmp_path}/ck", FeatureConfig()).awaitTermination()
    batch = build_features(df)
    got = jobs.streamed_features(spark, f"{tmp_path}/out").select(*batch.columns)
    assert got.orderBy("service", "timestamp").collect() == batch.orderBy("service", "timestamp").collect()


def test_stream_features_after_a_silence_equal_batch(spark, tmp_path):
    """Forty ticks, five hours without any, three more; every tick of the second file arrives twice."""
    times = [tick(i) for i in range(40)] + [tick(640 + i) for i in range(3)]
    df = metrics(spark, 43, change=lambda s, i: {"timestamp": times[i], "cpu_util_pct": float(i * i % 41)})
    source = in_slices(df, f"{tmp_path}/in", parts=4)
    df.where(F.col("timestamp").between(tick(20), tick(25))).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.stream_table(spark, source, METRIC_TABLE, per_batch=1)
    jobs.features_in_batches(stream, f"{tmp_path}/tail", f"{tmp_path}/out", f"{tmp_path}/ck", FeatureConfig()).awaitTermination()
    batch = build_features(df)
    got = jobs.streamed_features(spark, f"{tmp_path}/out").select(*batch.columns)
    assert got.orderBy("service", "timestamp").collect() == batch.orderBy("service", "timestamp").collect()


def test_late_rows_of_streamed_features_equal_batch(spark, tmp_path, monkeypatch):
    """Rows late by 1, lookback - 1, lookback and far more ticks, the first row last of all, and a duplicate of an old one."""
    monkeypatch.setattr(history, "FOLD", 3)
    back = FeatureConfig().lookback
    df = metrics(spark, 2 * back + 150, ("a", "b"), lambda s, i: {"cpu_util_pct": float(i * 31 % 97), "latency_ms": float(i)})
    i = ((F.unix_micros("timestamp") - F.unix_micros(F.lit(tick(0)))) / 30_000_000).cast("int")
    late = {3: 140 + 2 * back, 20: 100, 70: 1, 75: back - 1, 90: back, 91: back, 110: 2 * back}
    delay = F.coalesce(*[F.when((i == k) & (F.col("service") == "a"), F.lit(d)) for k, d in late.items()], F.lit(0))
    order = df.withColumn("arrival", i + delay)
    order = order.unionByName(order.where((i == 5) | (i == 60)).withColumn("arrival", i + 130))
    stream = jobs.stream_table(spark, in_slices(order, f"{tmp_path}/in", "arrival", 9), METRIC_TABLE, per_batch=1)
    jobs.features_in_batches(stream, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/ck", FeatureConfig()).awaitTermination()
    batch = build_features(df)
    got = jobs.streamed_features(spark, f"{tmp_path}/out").select(*batch.columns)
    assert got.orderBy("service", "timestamp").collect() == batch.orderBy("service", "timestamp").collect()
    rows = spark.read.parquet(f"{tmp_path}/out/rows")
    assert rows.count() == rows.select("service", "timestamp").distinct().count() == df.count()
    assert 0 < spark.read.parquet(f"{tmp_path}/out/revised").count() < 10 * back


def test_history_opens_only_the_hours_it_needs(spark, tmp_path):
    """A late row before a silence of weeks reads the hours around it, not those between."""
    schema = "service string, timestamp timestamp, v int"
    at = lambda h: tick(0) + dt.timedelta(hours=h)
    rows = [("a", at(h), h) for h in [*range(10), *range(900, 910)]] + [("b", at(h), h) for h in range(10)]
    stored = history.History(spark, str(tmp_path), spark.createDataFrame([], schema).schema)
    stored.append(spark.createDataFrame(rows, schema), 0, stored.fences(0))
    known = stored.fences(1)
    late = spark.createDataFrame([("a", at(904.5), -1), ("a", at(904), -2)], schema)
    own = stored.append(late, 1, known)
    assert [(r.service, r.rows) for r in own.collect()] == [("a", 1)]
    got = stored.around(1, known, own, 2)
    assert sorted(r.v for r in got.collect()) == [-1, *range(902, 907)] and [r.v for r in got.where("_new").collect()] == [-1]
    assert {r.service for r in got.collect()} == {"a"}


def test_stream_incidents_equal_batch(spark, tmp_path):
    """Ticks in disorder, a gap inside an incident, one incident still open at the end."""
    bad = {5, 6, 7, 30, 31, 50, 88, 89}
    df = metrics(spark, 90, change=lambda s, i: {"healthy": not (s == "a" and i in bad)})
    df = df.where(~F.col("timestamp").between(tick(32), tick(45)))
    late = df.withColumn("arrival", F.col("timestamp") + F.make_interval(secs=F.pmod(F.xxhash64("timestamp"), F.lit(4)) * 30.0))
    source = in_slices(late, f"{tmp_path}/in", by="arrival", parts=9)
    stream = jobs.stream_table(spark, source, late.schema, per_batch=1)
    sink(jobs.track_incidents(stream, 30, "2 minutes"), f"{tmp_path}/out", f"{tmp_path}/ck")
    written = spark.read.schema(jobs.INCIDENT_EVENTS).parquet(f"{tmp_path}/out")
    assert written.where("event = 'end'").count() == 3  # known while the stream ran
    events = written.unionByName(jobs.flush_incidents(spark, f"{tmp_path}/ck", 30))
    ended = events.where("event = 'end'").select("service", "start_ts", "end_ts")
    batch = track_incidents(df, 30).select("service", "start_ts", "end_ts")
    assert sorted(ended.collect()) == sorted(batch.collect()) and ended.count() == 4
    assert sorted(r.start_ts for r in events.where("event = 'start'").collect()) == sorted(r.start_ts for r in batch.collect())


def test_late_rows_are_taken_out_and_counted(spark, tmp_path):
    """Kept and late rows are all rows; late are those at or below the watermark of the batches before."""
    rows = [(tick(i), "a", i) for i in range(90)] + [(None, "b", 90)]
    late = {5: 31, 6: 70, 40: 45, 41: 80, 50: 52}  # row: after which row it arrives
    df = spark.createDataFrame(rows, "timestamp timestamp, service string, n int")
    arrival = F.coalesce(*[F.when(F.col("n") == k, F.lit(v + 0.5)) for k, v in late.items()], F.col("n") * 1.0)
    source = in_slices(df.withColumn("arrival", arrival), f"{tmp_path}/in", "arrival", 9)
    stream = jobs.stream_table(spark, source, df.schema, per_batch=1)
    jobs.split_late(stream, f"{tmp_path}/s", f"{tmp_path}/out", f"{tmp_path}/late", f"{tmp_path}/ck", 10 * 30).awaitTermination()
    taken = sorted(r.n for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/late").collect())
    kept = sorted(r.n for r in spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect())
    order, want, latest = sorted(range(91), key=lambda n: late.get(n, n - 0.5)), [], None
    for k in range(0, 91, 11):
        batch = order[k : k + 11]
        want += [n for n in batch if n == 90 or (latest is not None and n <= latest - 10)]
        latest = max([latest or 0, *[n for n in batch if n < 90]])
    assert taken == sorted(want) and len(taken) > 3 and sorted(taken + kept) == list(range(91))
    again = jobs.stream_table(spark, f"{tmp_path}/out", df.schema, per_batch=1)
    query = jobs.deduplicate(again.where("timestamp is not null"), "5 minutes").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck2")
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 0


def test_rolling_means_on_event_time(spark, tmp_path):
    df = metrics(spark, 60, ("a",), lambda s, i: {"latency_ms": float(i)})
    stream = jobs.stream_table(spark, in_slices(df, f"{tmp_path}/in"), METRIC_TABLE, per_batch=1)
    writer = jobs.rolling_means(stream, "latency_ms", lateness="1 minute").writeStream.format("memory")
    writer.queryName("rolling_means").trigger(availableNow=True).start().awaitTermination()
    means = spark.table("rolling_means")
    row = means.where(F.col("end") == F.lit(tick(40))).first()
    assert row["mean"] == pytest.approx(sum(range(30, 40)) / 10) and row["ticks"] == 10


def test_risk_and_drift_per_batch(spark, tmp_path):
    df = series_frame(spark, 60, columns=("Error_rate", "Latency_15min_avg", "Memory_growth_rate"))
    source = in_slices(df, f"{tmp_path}/in")
    stream = jobs.stream_table(spark, source, df.schema, per_batch=1)
    jobs.risk_in_batches(stream, calibration(df), f"{tmp_path}/risk", f"{tmp_path}/ck1").awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/risk/epoch=2")
    assert {(r["service"], r["timestamp"]) for r in last.collect()} == {("a", tick(59)), ("b", tick(59))}
    stream = jobs.stream_table(spark, source, df.schema, per_batch=3)
    jobs.drift_in_batches(stream, df, ["Error_rate"], f"{tmp_path}/drift", f"{tmp_path}/ck2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/drift").first()["drifted_features_count"] == 0


@pytest.mark.parametrize("logs_first", [True, False])
def test_logs_meet_incidents_on_streams(spark, tmp_path, logs_first):
    """An incident of three days, whose lines and end arrive in any order."""
    logs = spark.createDataFrame(
        [(tick(i * 300), "a", "ERROR" if i % 2 else "INFO", str(i)) for i in range(40)], LOG_TABLE
    )
    rows = [("a", tick(300), tick(300 * 28)), ("b", tick(0), tick(40)), ("a", tick(300 * 3), tick(300 * 5))]
    windows = spark.createDataFrame(rows, "service string, start_ts timestamp, end_ts timestamp")
    left = jobs.stream_table(spark, in_slices(windows, f"{tmp_path}/i", "start_ts", 1 if logs_first else 3), windows.schema, per_batch=1)
    right = jobs.stream_table(spark, in_slices(logs, f"{tmp_path}/l", parts=5 if logs_first else 2), LOG_TABLE, per_batch=1)
    jobs.correlate_in_batches(left, right, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    first = [int(r["message"]) for r in got if r["start_ts"] == tick(300)]
    assert sorted(first) == [i for i in range(1, 29) if i % 2]
    assert sorted(int(r["message"]) for r in got if r["start_ts"] == tick(900)) == [3, 5]


def test_late_rows_are_counted(spark):
    df = metrics(spark, 10, ("a",)).withColumn("arrival", F.col("timestamp") + F.expr("interval 20 minutes"))
    assert jobs.late_rows(df).first()["late"] == 10 and jobs.late_rows(df, 3600).first()["late"] == 0
