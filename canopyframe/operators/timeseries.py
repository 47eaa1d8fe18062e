"""Time-series operators: sensor cleaning, bracketing and nearest as-of alignment, kinetics, transitions, roll-ups.

Alignment is a union of both sides, one shuffle by series key, and one forward
fill per side, so its cost is that of a sort, not of a product of the two
sides.  A long or keyless series is cut into stretches of time
(``stretch_sec``): each stretch also gets the last reading before it and the
first after it, which is all that a bracket needs, so no task sorts a whole
series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import fin


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a timestamp, with or without zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, exact to the microsecond."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def stretches(readings: DataFrame, asked: DataFrame, keys: Sequence[str], stretch_sec: float | None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(readings, asked, keys) with the stretch of ``_ts`` as one more key, neighbours' readings carried in.

    ``readings`` has the keys, ``_ts`` and one payload column.  Only one row per
    stretch takes part in the carrying.
    """
    if not stretch_sec:
        return readings, asked, list(keys)
    payload = next(c for c in readings.columns if c not in (*keys, "_ts"))
    number = F.floor(seconds(F.col("_ts")) / stretch_sec).alias("_stretch")
    dealt, spots = readings.select("*", number), asked.select("*", number)
    inner = [*keys, "_stretch"]
    row = F.struct("_ts", payload)
    ends = dealt.groupBy(*inner).agg(F.min_by(row, "_ts").alias("_first"), F.max_by(row, "_ts").alias("_last"))
    every = spots.select(*inner).distinct().unionByName(ends.select(*inner)).distinct().join(ends, inner, "left")
    along = W.partitionBy(*keys).orderBy("_stretch")
    before = F.last("_last", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing))
    carried = every.select(*inner, F.array_compact(F.array(before, after)).alias("_c")).select(*inner, F.explode("_c").alias("_c")).select(*inner, "_c._ts", f"_c.{payload}")
    return dealt.unionByName(carried), spots, inner


def prepare_sensor(log: DataFrame, ts: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per timestamp: mean of each numeric column over repeats, and whether it was repeated; null times go."""
    means = [F.avg(fin(F.col(v).try_cast("double"))).alias(v) for v in values]
    return log.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(*means, (F.count(F.lit(1)) > 1).alias("duplicated"))


def localize(ts: Column, zone: str) -> Column:
    """Instant of a local wall-clock time."""
    return F.to_utc_timestamp(ts, zone)


def align(
    frames: DataFrame, sensor: DataFrame, ts: str, values: Sequence[str], keys: Sequence[str] = (), max_gap_sec: float = 600.0, stretch_sec: float | None = None,
) -> DataFrame:
    """Each frame with linearly interpolated sensor values, never extrapolated.

    ``sensor`` comes from :func:`prepare_sensor`.  Adds the values,
    ``previous_time``, ``next_time``, ``bracket_gap_sec``,
    ``nearest_offset_sec`` and ``qc_flag``.
    """
    here = F.struct(F.col(ts).alias("ts"), F.col("duplicated").alias("dup"), *(F.col(v).alias(v) for v in values))
    readings, asked, keys = stretches(
        sensor.select(*keys, F.col(ts).alias("_ts"), here.alias("_here")), frames.withColumn("_ts", F.col(ts)).withColumn("_frame", F.lit(True)), keys, stretch_sec
    )
    known = readings.withColumn("_bracket", F.struct(F.col("_here").alias("here"), F.lead("_here").over(W.partitionBy(*keys).orderBy("_ts")).alias("next"))).drop("_here")
    both = known.unionByName(asked, allowMissingColumns=True)
    # a reading at a frame's own time comes before the frame
    fill = W.partitionBy(*keys).orderBy("_ts", F.col("_frame").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    any_sensor = F.count("_bracket").over(W.partitionBy(*keys))
    filled = both.withColumn("_b", F.last("_bracket", ignorenulls=True).over(fill)).withColumn("_some", any_sensor > 0).where(F.col("_frame"))
    prev, nxt, at = F.col("_b.here"), F.col("_b.next"), F.col("_ts")
    exact = prev["ts"] == at
    between = ~exact & nxt.isNotNull()
    gap = seconds_between(prev["ts"], nxt["ts"])
    before, after = seconds_between(prev["ts"], at), seconds_between(at, nxt["ts"])
    share = before / gap
    usable = between & (gap > 0) & (gap <= max_gap_sec)
    got = {v: F.when(exact, prev[v]).when(usable, prev[v] + (nxt[v] - prev[v]) * share) for v in values}
    missing = F.lit(False)
    for v in values:
        missing = missing | fin(got[v]).isNull()
    flag = (
        F.when(~F.col("_some"), "sensor_empty")
        .when(F.col("_b").isNull(), "outside_sensor_range")
        .when(exact & missing, "sensor_value_missing")
        .when(exact & prev["dup"], "duplicate_sensor_timestamp_aggregated")
        .when(exact, "ok")
        .when(nxt.isNull(), "outside_sensor_range")
        .when(gap <= 0, "nonpositive_time_gap")
        .when(gap > max_gap_sec, "sensor_gap_exceeds_limit")
        .when(missing, "sensor_value_missing")
        .when(prev["dup"] | nxt["dup"], "duplicate_sensor_timestamp_aggregated")
        .otherwise("ok")
    )
    inside = F.col("_b").isNotNull() & (exact | nxt.isNotNull())
    return filled.select(
        *(F.col(c) for c in frames.columns), *(got[v].alias(v) for v in values),
        F.when(inside, prev["ts"]).alias("previous_time"), F.when(exact, prev["ts"]).otherwise(nxt["ts"]).alias("next_time"),
        F.when(exact, 0.0).when(between, gap).alias("bracket_gap_sec"),
        F.when(exact, 0.0).when(between, F.least(before, after)).alias("nearest_offset_sec"), flag.alias("qc_flag"),
    )


def pair_shifted(
    series: DataFrame, ts: str, values: Sequence[str], keys: Sequence[str] = (), shift_hours: float = 24.0, tolerance_sec: float = 180.0, phase: str | None = None,
    stretch_sec: float | None = None,
) -> DataFrame:
    """Each row with the nearest row that lies ``shift_hours`` later, within a tolerance (inclusive; ties look back).

    Adds ``<value>_shift``, ``<value>_target``, ``diff__<value>`` (target minus
    shifted), ``pair_offset_sec`` and, with a phase, ``phase_agreement``.
    """
    carried = [*values, *([phase] if phase else [])]
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(shift_hours * 3600)).cast("decimal(18,6)"))
    left = series.select(*keys, (F.col(ts) + shift).alias("_t"), F.col(ts).alias(f"{ts}_shift"), *(F.col(c).alias(f"{c}_shift") for c in carried))
    right = series.select(*keys, F.col(ts).alias("_t"), F.struct(F.col(ts).alias("ts"), *carried).alias("_r"))
    out_keys = list(keys)
    right, left, keys = stretches(right.withColumnRenamed("_t", "_ts"), left.withColumnRenamed("_t", "_ts"), keys, stretch_sec)
    both = left.withColumn("_l", F.lit(True)).unionByName(right, allowMissingColumns=True).withColumnRenamed("_ts", "_t")
    back = W.partitionBy(*keys).orderBy("_t", F.col("_l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(F.col("_t").desc(), F.col("_l").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    near = both.withColumn("_p", F.last("_r", ignorenulls=True).over(back)).withColumn("_n", F.last("_r", ignorenulls=True).over(ahead)).where("_l")
    t = F.col("_t")
    dp, dn = seconds_between(F.col("_p.ts"), t), seconds_between(t, F.col("_n.ts"))
    found = F.when(F.col("_n").isNull() | (dp <= dn), F.col("_p")).otherwise(F.col("_n"))
    out = near.withColumn("_m", found).withColumn("pair_offset_sec", seconds_between(t, F.col("_m.ts")))
    kept = out.where(F.abs("pair_offset_sec") <= tolerance_sec)
    agreement = [(F.col(f"{phase}_shift") == F.col(f"_m.{phase}")).alias("phase_agreement")] if phase else []
    return kept.select(
        *out_keys, f"{ts}_shift", F.col("_m.ts").alias(f"{ts}_target"), *(F.col(f"{v}_shift") for v in carried), *(F.col(f"_m.{v}").alias(f"{v}_target") for v in carried),
        *((F.col(f"_m.{v}") - F.col(f"{v}_shift")).alias(f"diff__{v}") for v in values), "pair_offset_sec", *agreement,
    )


def light_transitions(series: DataFrame, ts: str, phase: str, keys: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Rows whose phase differs from the row before; null to null is no change unless ``strict``."""
    order = W.partitionBy(*keys).orderBy(ts)
    before, first = F.lag(phase).over(order), F.row_number().over(order) == 1
    changed = series.withColumn("from_phase", before).withColumn("_first", first).where(
        (~F.col("_first") & ~F.col(phase).eqNullSafe(F.col("from_phase"))) | (F.lit(strict) & F.col(phase).isNull())
    )
    return changed.select(*keys, ts, "from_phase", F.col(phase).alias("to_phase"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("iso_time"), F.date_format(ts, "HH:mm:ss").alias("time_of_day"))


#: Hours after the event, open below and closed above (fixed values).
KINETIC_WINDOWS = ((float("-inf"), 0.0, "pre_event_all"), (0.0, 1.0, "0-1h"), (1.0, 2.0, "1-2h"), (2.0, 4.0, "2-4h"), (4.0, 18.0, "4-18h"), (18.0, 25.0, "18-25h"))


def hours_since(ts: Column, event: str) -> Column:
    return seconds_between(F.lit(event), ts) / 3600.0


def recovery_kinetics(series: DataFrame, ts: str, metric: str, event: str, keys: Sequence[str] = (), windows=KINETIC_WINDOWS) -> DataFrame:
    """Mean per window of hours since the event, and against the mean before it; windows may overlap.

    A row at the event itself counts as after it, but its hour 0 lies in the
    window that ends at 0.
    """
    h = hours_since(F.col(ts), event)
    timed = series.withColumn("_h", h).withColumn("_before", h < 0)
    inside = F.array_compact(F.array(*(F.when((F.col("_h") > lo) & (F.col("_h") <= hi), F.struct(F.lit(i).alias("place"), F.lit(name).alias("window"))) for i, (lo, hi, name) in enumerate(windows))))
    baseline = timed.where("_before").groupBy(*keys).agg(F.avg(fin(F.col(metric))).alias("baseline"))
    means = timed.select(*keys, metric, F.explode(inside).alias("w")).groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("n"), F.avg(fin(F.col(metric))).alias("mean"))
    joined = means.join(baseline, list(keys), "left") if keys else means.crossJoin(F.broadcast(baseline))  # one row
    return joined.select(*keys, F.col("w.place").alias("place"), F.col("w.window").alias("window"), "n", "mean", (F.col("mean") - F.col("baseline")).alias("vs_baseline"))


def plant_summary(series: DataFrame, plant: str, ts: str, metrics: Sequence[str]) -> DataFrame:
    """Rows, first and last time, and least, median and largest value of each metric, per plant."""
    stats = [e for m in metrics for e in (F.min(fin(F.col(m))).alias(f"{m}_min"), F.median(fin(F.col(m))).alias(f"{m}_median"), F.max(fin(F.col(m))).alias(f"{m}_max"))]
    return series.groupBy(plant).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_time"), F.max(ts).alias("last_time"), *stats)


def phase_summary(series: DataFrame, plant: str, phase: str, metrics: Sequence[str]) -> DataFrame:
    """Rows, mean, median and sample deviation of each metric, per plant and phase; null phases are left out."""
    stats = [e for m in metrics for e in (F.avg(fin(F.col(m))).alias(f"{m}_mean"), F.median(fin(F.col(m))).alias(f"{m}_median"), F.stddev_samp(fin(F.col(m))).alias(f"{m}_std"))]
    return series.where(F.col(phase).isNotNull()).groupBy(plant, phase).agg(F.count(F.lit(1)).alias("n"), *stats)
