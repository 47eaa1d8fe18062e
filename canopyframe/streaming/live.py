"""The batch operators over streams (an extension: the finite operators are the reference semantics)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.arrays import STATS, fin
from ..operators import raster as R


def sensor_windows(log: DataFrame, ts: str, value: str, keys: list[str], window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean, extremes and count per key and tumbling window; rows later than ``late`` are dropped."""
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    v = fin(F.col(value))
    grouped = timed.groupBy(F.window(ts, window).alias("w"), *keys).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "mean", "min", "max", "n")


def canopy_stream(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Canopy statistics of each arriving frame: a projection, so it needs no state."""
    s = frames.withColumn("_s", R.canopy_temperature(F.col("temp"), F.col("mask")))
    return s.select(*keys, *(F.col(f"_s.{k}").alias(f"canopy_{k}") for k in STATS))


def frame_sensor_join(frames: DataFrame, log: DataFrame, ts: str, key: str, within: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Frames with every reading of their key at most ``within`` before or after; state is bounded by both watermarks."""
    f = frames.withColumn("frame_ts", F.col(ts).cast("timestamp")).withWatermark("frame_ts", late).withColumnRenamed(key, "frame_key").drop(ts)
    s = log.withColumn("sensor_ts", F.col(ts).cast("timestamp")).withWatermark("sensor_ts", late).withColumnRenamed(key, "sensor_key").drop(ts)
    near = F.expr(f"frame_key = sensor_key AND sensor_ts BETWEEN frame_ts - INTERVAL {within} AND frame_ts + INTERVAL {within}")
    return f.join(s, near)


def phase_changes(series: DataFrame, key: str, ts: str, phase: str, late: str = "30 minutes") -> DataFrame:
    """Phase transitions per key, with the last phase kept as state; rows of a batch are taken in time order."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(ts)
        out = []
        for t, p in zip(rows[ts], rows[phase]):
            if last is not None and p != last:
                out.append((k[0], t, last, p))
            last = p
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, ts, "from_phase", "to_phase"])

    timed = series.select(key, F.col(ts).cast("timestamp").alias(ts), phase).withWatermark(ts, late)
    kind = series.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {ts} timestamp, from_phase string, to_phase string", "last string", "append", GroupStateTimeout.NoTimeout)
