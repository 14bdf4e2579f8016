"""Readings as a stream: masking, hourly means with late data, constant runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brumar.common import usable


def hourly_means(stream: DataFrame, entity: str, time: str, value: str, late: str = "2 days") -> DataFrame:
    """(entity, hour, mean_value, n) over tumbling hours; readings up to ``late`` late are counted in."""
    s = stream.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{time}`").cast("timestamp").alias("ts"), usable(F.col(f"`{value}`")).alias("v")).where("entity is not null and ts is not null and v is not null")
    return s.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "entity").agg(F.avg("v").alias("mean_value"), F.count("v").alias("n")).select("entity", F.col("w.start").alias("hour"), "mean_value", "n")


def stuck_runs(stream: DataFrame, entity: str, time: str, value: str, least: int = 8) -> DataFrame:
    """(entity, ts, value, length) for each reading that brings a run of equal non-zero values to ``least`` or more.

    The state of an entity is the last value, its time and the length of the run; readings that come earlier than the last one are passed over.
    """
    s = stream.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{time}`").cast("timestamp").alias("ts"), usable(F.col(f"`{value}`")).alias("v")).where("entity is not null and ts is not null and v is not null")

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, at, run = state.get if state.exists else (float("nan"), 0, 0)
        out = []
        for pdf in batches:
            for ts, v in pdf.sort_values("ts")[["ts", "v"]].itertuples(index=False):
                us = int(ts.value // 1000)
                if us <= at:
                    continue
                run = run + 1 if v == last else 1
                last, at = v, us
                if run >= least and v != 0:
                    out.append((key[0], ts, v, run))
        state.update((last, at, run))
        yield pd.DataFrame(out, columns=["entity", "ts", "value", "length"])

    return s.groupBy("entity").applyInPandasWithState(follow, "entity string, ts timestamp, value double, length int", "last double, at long, run int", "append", "NoTimeout")
