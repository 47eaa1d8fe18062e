"""Thermal segments end to end: direction merge, sequential cleanup, layers, checks, statistics.

Cleanup is serial within a segment (a frame leans on its cleaned neighbour) and
parallel across segments; everything after it is a projection per frame.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import arrays as A
from ..functions.physics import plain_segment_id
from . import kernels as K, raster as R


def merged_masks(spine: DataFrame, forward: DataFrame, backward: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Every frame of the spine (keys, frame_idx) with one mask: forward, else backward, else empty."""
    on = [*keys, "frame_idx"]
    f, b = forward.select(*on, F.col("mask").alias("_f")), backward.select(*on, F.col("mask").alias("_b"))
    joined = spine.join(f, on, "left").join(b, on, "left")
    return joined.withColumn("mask", R.merge_bidirectional(F.col("_f"), F.col("_b"), size)).drop("_f", "_b")


def clean_segments(frames: DataFrame, keys: Sequence[str], width: int, reference: int = 0, points: Sequence[tuple[float, float]] = (), labels: Sequence[int] = (), **limits) -> DataFrame:
    """Cleaned masks per segment: keys, frame_idx, mask, support_mode, hard_fail, n_components, records.

    One segment's masks are held together; they are small next to its images.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.select(*keys).schema.fields)
    record = "array<struct<component_id:int,area:int,positive_hits:int,negative_hits:int,anchor_overlap:int,retained:boolean,reason:string>>"
    names = ("component_id", "area", "positive_hits", "negative_hits", "anchor_overlap", "retained", "reason")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_idx").reset_index(drop=True)
        grids = [K.as_grid(m, width, bool) for m in pdf["mask"]]
        at = int((pdf["frame_idx"] == reference).to_numpy().argmax())
        done = K.clean_sequence(grids, at, points, labels, **limits)
        return pd.DataFrame({
            **{k: pdf[k] for k in keys}, "frame_idx": pdf["frame_idx"], "mask": [m.ravel().tolist() for m, _ in done], "support_mode": [a["support_mode"] for _, a in done],
            "hard_fail": [bool(a["hard_fail"]) for _, a in done], "n_components": [a["n_components"] for _, a in done], "records": [[{n: r[n] for n in names} for r in a["records"]] for _, a in done],
        })

    schema = f"{kinds}, frame_idx int, mask array<boolean>, support_mode string, hard_fail boolean, n_components int, records {record}"
    return frames.select(*keys, F.col("frame_idx").cast("int"), "mask").groupBy(*keys).applyInPandas(run, schema)


def segment_metrics(cleaned: DataFrame, temps: DataFrame, keys: Sequence[str], width: int, most: int = 30_000, least: int = 200) -> DataFrame:
    """Per frame: area, check result, layer areas and audit, canopy and layer temperatures."""
    on = [*keys, "frame_idx"]
    joined = cleaned.join(temps.select(*on, "temp"), on, "left").withColumn("area_px", A.count_true(F.col("mask")))
    parts = joined.withColumns({
        "_layers": R.layer_of(F.col("mask"), width), "_canopy": R.canopy_temperature(F.col("temp"), F.col("mask")), "_per": R.layer_temperatures(F.col("temp"), F.col("mask"), width),
        "qc_flag": R.qc_flag(F.col("hard_fail"), F.col("area_px"), most, least),
    })
    audit = R.layer_audit(F.col("_layers"), F.col("mask"))
    return parts.select(
        *on, "area_px", "qc_flag", "support_mode", "hard_fail", *(c.alias(k) for k, c in audit.items()),
        *(F.col(f"_canopy.{k}").alias(f"canopy_{k}") for k in A.STATS), *(F.col(f"_per.{k}").alias(k) for k in R.LAYER_COLUMNS),
    )


def biological_segments(frames: DataFrame, segment: str = "segment") -> DataFrame:
    """Frames with debug segments under the id of the segment they repeat."""
    return frames.withColumn(segment, plain_segment_id(F.col(segment)))
