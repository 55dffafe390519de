import datetime as dt

import pytest
from pyspark.sql import functions as F

from emberwatch.config import FeatureConfig, LabelConfig, SeriesLayout, SplitConfig
from emberwatch.operators.features import build_features
from emberwatch.operators.incidents import tile_schedule, track_incidents
from emberwatch.operators.labels import build_dataset, build_labels
from emberwatch.operators.splits import split_report, time_split
from emberwatch.plans.blocks import index_rows
from emberwatch.plans.slices import borders, slice_of
from emberwatch.schemas import INCIDENT_TABLE
from tests.frames import by_tick, metrics, series_frame, tick

SMALL = SeriesLayout(bucket_sec=300, block_rows=40)


def test_constant_stays_constant_and_first_row_is_itself(spark):
    df = build_features(metrics(spark, change=lambda s, i: {"cpu_util_pct": float(i) if s == "b" else 50.0}))
    assert set(by_tick(df, "CPU_5min_avg")) == {50.0}
    ramp = by_tick(df, "CPU_5min_avg", "b")
    assert ramp[0] == 0.0 and ramp[-1] == pytest.approx(sum(range(50, 60)) / 10)
    assert len(FeatureConfig().feature_names) == 26 and None not in ramp


def test_growth_rate_and_warm_up(spark):
    df = build_features(metrics(spark, change=lambda s, i: {"memory_util_pct": 100.0 + i}))
    growth = by_tick(df, "Memory_growth_rate")
    assert growth[19] == 0.0 and growth[40] == pytest.approx(20.0 / 120.0)


def test_ratios_and_floors(spark):
    values = {"cpu_util_pct": 40.0, "memory_util_pct": 80.0, "latency_ms": 300.0, "request_rate_rps": 0.5,
              "http_4xx_rate": 0.01, "http_5xx_rate": 0.02}
    row = build_features(metrics(spark, 12, ("a",), lambda s, i: values)).first()
    assert row["CPU_memory_ratio"] == 0.5 and row["latency_per_request"] == 300.0
    assert row["Error_rate"] == pytest.approx(0.03)


def test_nan_is_skipped_and_min_periods(spark):
    df = metrics(spark, 12, ("a",), lambda s, i: {"cpu_util_pct": float("nan") if i == 3 else 10.0})
    assert set(by_tick(build_features(df), "CPU_5min_avg")) == {10.0}
    gated = by_tick(build_features(df, FeatureConfig(min_periods=5)), "CPU_5min_avg")
    assert gated[4] is None and gated[5] == 10.0


def test_causal_and_isolated(spark):
    base = build_features(metrics(spark))
    moved = build_features(metrics(spark, change=lambda s, i: {"cpu_util_pct": 99.0} if s == "a" and i == 59 else {}))
    assert by_tick(base, "CPU_15min_avg")[:59] == by_tick(moved, "CPU_15min_avg")[:59]
    assert by_tick(base, "CPU_15min_avg", "b") == by_tick(moved, "CPU_15min_avg", "b")


def test_missing_column(spark):
    with pytest.raises(ValueError, match="latency_ms"):
        build_features(metrics(spark, 3).drop("latency_ms"))


def incidents(spark, *rows):
    return spark.createDataFrame([(i, s, "t", a, b) for i, (s, a, b) in enumerate(rows)], INCIDENT_TABLE)


def test_labels_around_an_incident(spark):
    grid = metrics(spark)
    inc = incidents(spark, ("a", tick(20), tick(30)))
    df = build_labels(grid, inc)
    failing, ahead, minutes = (by_tick(df, c) for c in ("in_failure", "failure_in_next_10min", "time_to_failure_min"))
    assert [i for i, f in enumerate(failing) if f] == list(range(20, 30))
    assert [i for i, f in enumerate(ahead) if f] == list(range(1, 30))
    assert minutes[0] == 10.0 and minutes[19] == 0.5 and minutes[25] == 0.0 and minutes[30] is None
    later = build_labels(grid, inc, LabelConfig(include_current_failure=False))
    assert [i for i, f in enumerate(by_tick(later, "failure_in_next_10min")) if f] == list(range(0, 29))
    assert sum(by_tick(df, "in_failure", "b")) == 0


def test_overlapping_and_open_incidents(spark):
    grid = metrics(spark, services=("a",))
    inc = incidents(spark, ("a", tick(5), tick(15)), ("a", tick(10), tick(12)), ("a", tick(50), None))
    assert [i for i, f in enumerate(by_tick(build_labels(grid, inc), "in_failure")) if f] == [*range(5, 15), *range(50, 60)]
    strict = LabelConfig(open_incident_is_failing=False)
    assert [i for i, f in enumerate(by_tick(build_labels(grid, inc, strict), "in_failure")) if f] == list(range(5, 15))


def test_blocks_equal_whole_series(spark):
    noisy = metrics(spark, 200, change=lambda s, i: {"cpu_util_pct": (i * 37 % 101) * 1.0, "latency_ms": (i * i % 53) * 1.0})
    inc = incidents(spark, ("a", tick(38), tick(45)), ("a", tick(100), tick(160)), ("b", tick(3), tick(4)))
    plain = build_dataset(noisy, inc).orderBy("service", "timestamp").collect()
    blocked = build_dataset(noisy, inc, layout=SMALL).orderBy("service", "timestamp").collect()
    assert plain == blocked and len(plain) == 400
    a = build_features(noisy).orderBy("service", "timestamp").collect()
    assert a == build_features(noisy, layout=SMALL).orderBy("service", "timestamp").collect()


def test_blocks_survive_gaps(spark):
    """Row frames count rows, so a gap in time must not shorten them."""
    gappy = metrics(spark, 300, ("a",), lambda s, i: {"cpu_util_pct": i * 1.0}).where("minute(timestamp) % 7 <> 3")
    a = build_features(gappy).orderBy("timestamp").collect()
    assert a == build_features(gappy, layout=SMALL).orderBy("timestamp").collect()


def test_block_shorter_than_frame_is_refused(spark):
    with pytest.raises(ValueError, match="block_rows"):
        build_features(metrics(spark, 5), layout=SeriesLayout(block_rows=5))


def test_one_service_and_one_day_are_spread(spark):
    """All rows belong to one service and one day, most of them to one minute; no slice holds more than a few of them."""
    df = metrics(spark, 500, ("a",), lambda s, i: {"timestamp": tick(0) + dt.timedelta(milliseconds=i * 100), "cpu_util_pct": i * 1.0})
    indexed = index_rows(df, SMALL).select("cpu_util_pct", "_idx").collect()
    assert all(r["_idx"] == r["cpu_util_pct"] for r in indexed)
    time = F.unix_micros("timestamp")
    sizes = df.groupBy(slice_of(time, borders(df, time)).alias("s")).count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) <= 40


def test_split_fractions_and_purge(spark):
    df = series_frame(spark, 100)
    counts = {r["split"]: r["count"] for r in time_split(df, SplitConfig(purge_min=0)).groupBy("split").count().collect()}
    assert counts == {"train": 120, "val": 40, "test": 40}
    purged = time_split(df, SplitConfig(purge_min=2.5))
    counts = {r["split"]: r["count"] for r in purged.groupBy("split").count().collect()}
    assert counts == {"train": 110, "val": 30, "test": 40}
    report = split_report(purged, []).collect()
    assert all(r["chronological"] and r["overlap_pairs"] == 0 and r["services"] == 2 for r in report)


def test_split_needs_three_timestamps(spark):
    with pytest.raises(ValueError, match="at least 3"):
        time_split(series_frame(spark, 2))


def test_split_border_in_many_slices(spark, many_slices):
    counts = time_split(series_frame(spark, 100), SplitConfig(purge_min=0)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in counts} == {"train": 120, "val": 40, "test": 40}


@pytest.mark.parametrize("layout", [None, SMALL])
def test_incident_tracking(spark, layout):
    bad = {3, 4, 5, 39, 40, 41, 59}
    df = metrics(spark, 60, change=lambda s, i: {"healthy": not (s == "a" and i in bad)})
    rows = track_incidents(df, 30, layout).orderBy("incident_id").collect()
    assert [(r["start_ts"], r["end_ts"]) for r in rows] == [(tick(3), tick(6)), (tick(39), tick(42)), (tick(59), tick(60))]
    assert [r["incident_id"] for r in rows] == [1, 2, 3]


def test_tiled_schedule(spark):
    base = spark.createDataFrame([("a", "x", 60.0, 10.0)], "service string, scenario_type string, start_min double, duration_min double")
    starts = [r["start_min"] for r in tile_schedule(base, 3, 720).orderBy("start_min").collect()]
    assert starts == [60.0, 780.0, 1500.0] and tile_schedule(base, 1, 720).count() == 1


def test_tick_is_regular():
    assert tick(2) - tick(1) == dt.timedelta(seconds=30)
