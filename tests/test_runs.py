"""Runs over sequences and segments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import geometry as G, segments
from canopyframe.plans import runs


def bar_frames(spark):
    masks = []
    for i in range(5):
        m = np.zeros((60, 50), bool)
        m[20 - 2 * i : 50, 20:30] = True
        masks.append(m)
    rows = [("s_dbg" if i == 9 else "s", i, m.ravel().tolist(), [25.0 + i] * 3000) for i, m in enumerate(masks)]
    return spark.createDataFrame(rows, "segment string, frame_idx int, mask array<boolean>, temp array<double>"), masks


def test_growing_bar(spark, tmp_path):
    frames, masks = bar_frames(spark)
    spine = frames.select("segment", "frame_idx")
    forward = frames.where("frame_idx < 3").select("segment", "frame_idx", "mask")
    backward = frames.select("segment", "frame_idx", "mask")
    out = {r.frame_idx: r for r in runs.run_segments(spine, forward, backward, frames, ["segment"], 50, 3000, str(tmp_path / "r"), 0, [(25, 30)], [1]).collect()}
    assert {k: (r.area_px, r.qc_flag, r.union_xor) for k, r in out.items()} == {i: (int(m.sum()), "OK", 0) for i, m in enumerate(masks)}
    assert all(r.lower_area + r.middle_area + r.upper_area == r.area_px and r.canopy_median == 25.0 + k for k, r in out.items())
    assert spark.read.parquet(str(tmp_path / "r" / "cleanup_audit")).count() == 5


def test_failed_segment_is_not_published(spark, tmp_path):
    frames, _ = bar_frames(spark)
    with pytest.raises(ValueError):
        runs.run_segments(frames.select("segment", "frame_idx"), frames, frames, frames, ["segment"], 50, 3000, str(tmp_path / "r"), 0, [(1, 1)], [1])
    assert not (tmp_path / "r" / "segment_metrics").exists() and (tmp_path / "r" / "cleanup_audit").exists()


def test_debug_segments(spark):
    df = spark.createDataFrame([("a_dbg",), ("b",)], "segment string")
    assert sorted(r.segment for r in segments.biological_segments(df).collect()) == ["a", "b"]


def test_run_and_resume(spark, tmp_path):
    frames = runs.demo_frames(spark)
    logits = frames.select("sequence", "frame_idx", F.transform("mask", lambda m: F.when(m, 10.0).otherwise(-10.0)).alias("logits"))
    none = logits.where("false")
    args = (logits, none, ["sequence"], 64, 48, str(tmp_path / "r"))
    rows, summary = runs.run_sequences(frames.drop("mask"), *args)
    got = {r.frame_idx: r for r in rows.collect()}
    assert [got[i].pred_source for i in range(6)] == ["manual", "propagated", "propagated", "manual", "propagated", "manual"]
    assert all(got[i].area_px < got[i + 1].area_px for i in range(5)) and summary.first().n_manual == 3 and got[0].roi_x1 <= 64
    rows, _ = runs.run_sequences(frames.drop("mask"), *args, done=frames.select("sequence").distinct())
    assert rows.count() == 6, "nothing is done twice"


def test_providers():
    with pytest.raises(NotImplementedError):
        runs.provider("yolo")
    with pytest.raises(KeyError):
        runs.provider("nothing")
    runs.register_provider("mock", lambda frames: frames)
    assert runs.provider("mock")(1) == 1
    with pytest.raises(ValueError):
        runs.register_provider("mock", lambda frames: frames)
    assert "operators" in runs.list_modules()


def test_crop_and_long_form(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0], [False, True, False, True]), (2, [1.0] * 4, [False] * 4)], "k int, temp array<double>, mask array<boolean>")
    got = {r.k: r for r in runs.crop_frames(df, ["k"], 2, 2).collect()}
    assert got[1].ok and got[1].cropped == [2.0, 4.0] and got[1].stats.mean == 3.0 and not got[2].ok and got[2].reason == "no_finite_temperature" and got[2].cropped is None
    long = runs.long_traits(spark.createDataFrame([(1, 2, None, "x")], "k int, a int, b double, c string"), ["k"]).collect()
    assert {(r.trait, r.value) for r in long} == {("a", 2.0), ("b", None)}


def test_canopy_geometry():
    depth, mask, camera, plane = np.full((20, 20), 900.0), np.zeros((20, 20), bool), (600.0, 600.0, 10.0, 10.0), np.array([0.0, 0.0, 1000.0])
    mask[5:15, 5:15] = True
    g = G.canopy_geometry(depth, mask, camera, plane)
    assert abs(g["canopy_projected_area_mm2"] - 81 * 1.5 * 1.5) < 1e-6 and abs(g["mean_canopy_height_mm"] - 100) < 1e-9 and g["geometry_qc_pass"] and g["mesh_vertex_coverage_fraction"] == 1.0
    assert abs(g["canopy_envelope_volume_mm3"] - g["canopy_projected_area_mm2"] * 100) / g["canopy_envelope_volume_mm3"] < 0.1
    depth[7, 7] = np.nan
    depth[5, 5] = 2600.0
    g = G.canopy_geometry(depth, mask, camera, plane)
    assert g["native_depth_fraction"] == 0.98 and g["edge_depth_fraction"] == 1 - 1 / 64 and g["geometry_qc_pass"]
    for bad in (np.zeros_like(mask), np.zeros((4, 4), bool)):
        with pytest.raises(ValueError):
            G.canopy_geometry(depth, bad, camera, plane)
