"""Small frames shared by the tests."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from emberwatch.schemas import METRIC_NAMES, METRIC_TABLE

START = dt.datetime(2024, 1, 1)


def tick(i: int, step: int = 30) -> dt.datetime:
    return START + dt.timedelta(seconds=step * i)


def metrics(spark, ticks: int = 60, services=("a", "b"), change=None):
    """Constant 50.0 for every metric; ``change(service, i)`` returns values to override."""
    rows = []
    for s in services:
        for i in range(ticks):
            values = dict.fromkeys(METRIC_NAMES, 50.0) | {"healthy": True} | (change(s, i) if change else {})
            rows.append((values.get("timestamp", tick(i)), s, *[values[m] for m in METRIC_NAMES], values["healthy"]))
    return spark.createDataFrame(rows, METRIC_TABLE)


def by_tick(df, column: str, service: str = "a") -> list:
    rows = df.where(f"service = '{service}'").orderBy("timestamp").select(column).collect()
    return [r[0] for r in rows]


def series_frame(spark, ticks: int, services=("a", "b"), seed: int = 0, columns=("f1", "f2", "f3"), **more):
    rng = np.random.default_rng(seed)
    frames = []
    for s in services:
        data = {"timestamp": [tick(i) for i in range(ticks)], "service": s}
        data |= {c: rng.normal(10.0 * k, 1.0 + k, ticks) for k, c in enumerate(columns)}
        data |= {k: [v(i) for i in range(ticks)] for k, v in more.items()}
        frames.append(pd.DataFrame(data))
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))
