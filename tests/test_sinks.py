"""Files and command line: what is written is read back."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.__main__ import main
from canopyframe.operators import kernels as K, raster as R, render, sequence as S
from canopyframe.plans import runs, traits
from canopyframe.sources import config, png, rasters, tables

H, W = 24, 32


def disc(r):
    ys, xs = np.indices((H, W))
    return np.hypot(ys - H / 2, xs - W / 2) <= r


def growing(spark, n=6):
    """A growing disc with anchors 0, 3 and 5, and logits that find it."""
    rows = [("s", i, f"rgb/f{i}.png", f"d{i}", i in (0, 3, 5), disc(3 + i).ravel().tolist() if i in (0, 3, 5) else None, i + 1) for i in range(n)]
    frames = spark.createDataFrame(rows, "sequence_key string, frame_idx int, frame_path string, frame_label string, is_anchor boolean, anchor_mask array<boolean>, das int")
    logits = spark.createDataFrame([("s", i, np.where(disc(3 + i), 1.0, -9.0).ravel().tolist()) for i in range(n)], "sequence_key string, frame_idx int, logits array<double>")
    return frames, logits


def test_sequence_files(spark, tmp_path):
    frames, logits = growing(spark)
    done = S.propagate(frames, logits, logits.where("false"), ["sequence_key"], R.PropagationConfig(), H * W).drop("anchor_mask", "is_anchor")
    assert runs.persist_sequences(done, str(tmp_path), W, H) == 12
    for i in range(6):
        mask = png.decode((tmp_path / "s" / "masks" / f"f{i}.png").read_bytes())
        assert ((mask > 0) == disc(3 + i)).all() and set(np.unique(mask)) == {0, 255}
        doc = json.loads((tmp_path / "s" / "jsons" / f"f{i}.json").read_text())
        source = "manual" if i in (0, 3, 5) else "propagated"
        assert doc["info"] == {"description": "ISAT", "folder": "rgb", "name": f"f{i}.png", "width": W, "height": H, "depth": 3, "note": f"s | frame_idx={i} | label=d{i} | src={source}"}
        assert [o["group"] for o in doc["objects"]] == [1] and doc["objects"][0]["category"] == "plant"
    area = spark.read.option("header", "true").option("inferSchema", "true").csv(str(tmp_path / "area")).orderBy("frame_idx").collect()
    assert [(r.sequence, r.das, r.stem, r.area_px, r.pred_source) for r in area][1] == ("s", 2, "f1", int(disc(4).sum()), "propagated")
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".part")]


def test_leave_one_out(spark):
    frames, _ = growing(spark)
    fold = spark.createDataFrame([("s", 0, np.where(disc(3), 1.0, -9.0).ravel().tolist()), ("s", 3, np.where(disc(5), -0.7, -9.0).ravel().tolist())], "sequence_key string, held_idx int, logits array<double>")
    got = {r.held_idx: r for r in S.leave_one_out(frames, fold, ["sequence_key"], W, H).collect()}
    assert {k: (v.pred_source, v.gap, v.is_endpoint, v.n_prompts) for k, v in got.items()} == {0: ("propagated", 3, True, 2), 3: ("propagated_lowthr", 2, False, 2), 5: ("missing", 2, True, 2)}
    assert got[0].iou == got[0].boundary_f1 == 1.0 and got[3].iou == round(disc(5).sum() / disc(6).sum(), 4) and got[3].threshold == -1.0
    assert got[5].iou == 0.0 and got[5].pred_area == 0 and got[5].gt_area == disc(8).sum()
    roi = spark.createDataFrame([("s", (0, 0, W // 2, H))], "sequence_key string, roi struct<x0:int,y0:int,x1:int,y1:int>")
    inside = {r.held_idx: r for r in S.leave_one_out(frames, fold, ["sequence_key"], W, H, rois=roi).collect()}
    assert inside[0].gt_area == disc(3)[:, : W // 2].sum() and inside[0].iou == 1.0
    s = S.quality_summary(S.leave_one_out(frames, fold, ["sequence_key"], W, H), interior_only=True).first()
    assert s.n == 1 and s.median_iou == got[3].iou


def test_crop_files(spark, tmp_path):
    temp = np.arange(H * W, dtype=float) / 10
    rows = [("a", temp.tolist(), disc(4).ravel().tolist()), ("b", [float("nan")] * (H * W), disc(4).ravel().tolist()), ("c", temp.tolist(), [False] * (H * W))]
    df = spark.createDataFrame(rows, "stem string, temp array<double>, mask array<boolean>")
    assert runs.save_crops(df, ["stem"], W, H, str(tmp_path)) == 5
    ys, xs = np.nonzero(disc(4))
    want = np.where(disc(4), temp.reshape(H, W), np.nan)[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    np.testing.assert_allclose(np.load(tmp_path / "a_crop.npy"), want.astype(np.float32))
    np.testing.assert_allclose(np.loadtxt(tmp_path / "a_crop.csv", delimiter=","), want, atol=1e-3)
    assert json.loads((tmp_path / "a_report.json").read_text())["ok"] is True
    assert all(json.loads((tmp_path / f"{k}_report.json").read_text())["ok"] is False for k in "bc")


def test_overlays(spark, tmp_path):
    image = render.temperature_image(np.array([[20.0, 23.0, 26.5, 30.0, 99.0, np.nan]]), 23.0, 30.0)[0]
    assert abs(image[1].astype(int) - (0, 0, 4)).max() <= 5 and abs(image[3].astype(int) - (252, 255, 164)).max() <= 6 and abs(image[2].astype(int) - (188, 55, 84)).max() <= 6
    assert (image[0] == image[1]).all() and (image[3] == image[4]).all() and not image[5].any()
    temp, mask = np.full((H, W), 26.5), disc(6)
    shown, base, edge = render.overlay(temp, mask, 23.0, 30.0), image[2].astype(float), render.border(mask)
    inner = mask & ~edge
    assert (shown[edge] == (0, 255, 255)).all() and (shown[~mask & ~edge] == image[2]).all() and (shown[inner] == (0.72 * base + 0.28 * np.array((0, 170, 220))).astype(np.uint8)).all()
    layers = render.layer_overlay(temp, {"upper": mask, "odd": disc(1)}, 23.0, 30.0)
    assert (layers[render.border(disc(1))] == 255).all() and (layers[edge] == (0, 255, 255)).all()
    df = spark.createDataFrame([("a", temp.ravel().tolist(), mask.ravel().tolist())], "stem string, temp array<double>, mask array<boolean>")
    assert runs.save_overlays(df, ["stem"], W, str(tmp_path)) == 2
    assert (png.decode((tmp_path / "a_overlay.png").read_bytes()) == shown).all() and png.decode((tmp_path / "a_layers.png").read_bytes()).shape == (H, W, 3)


def test_contact_sheets(spark, tmp_path):
    rows = [("s", i, *[[float(40 * i + c)] * (H * W) for c in range(3)], disc(3 + i).ravel().tolist()) for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, "seq string, frame_idx int, r array<double>, g array<double>, b array<double>, mask array<boolean>")
    assert runs.save_contact_sheets(df, ["seq"], W, str(tmp_path), R.PropagationConfig(qa_grid_cols=2, qa_grid_tile=48)) == 1
    sheet = png.decode((tmp_path / "s_qa_grid.png").read_bytes())
    images = [np.dstack([np.full((H, W), 40 * i + c, dtype=np.uint8) for c in range(3)]) for i in range(3)]
    assert (sheet == render.contact_sheet(images, [disc(3 + i) for i in range(3)], 2, 48)).all() and sheet.shape == (96, 96, 3)
    assert (sheet[0, 48] == (40, 41, 42)).all() and (sheet == render.SHEET).all(axis=2).any() and not sheet[48:, 48:].any()


def test_publish_writes_what_it_checked(spark, tmp_path):
    good, bad = (spark.createDataFrame([(1, flag)], "k int, qc_flag string") for flag in ("OK", "FAIL"))
    with pytest.raises(ValueError):
        tables.publish(bad, str(tmp_path / "bad"))
    assert not os.listdir(tmp_path)
    tables.publish(good, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        tables.publish(good, str(tmp_path / "out"))


def test_files_in_uri(spark, tmp_path):
    rows = spark.createDataFrame([("x/1.bin", bytearray(b"one")), ("2.bin", None)], "name string, content binary")
    assert tables.write_files(rows, f"file://{tmp_path}") == 2
    assert (tmp_path / "x" / "1.bin").read_bytes() == b"one" and (tmp_path / "2.bin").read_bytes() == b""


def test_command_line_segments(spark, tmp_path, capsys):
    frames, logits = growing(spark)
    os.makedirs(tmp_path / "masks")
    lines = ["sequence_key,frame_idx,frame_path,frame_label,is_anchor,mask_path"]
    for i in range(6):
        anchor = i in (0, 3, 5)
        if anchor:
            (tmp_path / "masks" / f"m{i}.png").write_bytes(png.encode(disc(3 + i).astype(np.uint8) * 255))
        lines.append(f"s,{i},rgb/f{i}.png,d{i},{'yes' if anchor else 'no'},{f'masks/m{i}.png' if anchor else ''}")
    (tmp_path / "m.csv").write_text("\n".join(lines))
    logits.write.parquet(str(tmp_path / "logits"))
    logits.withColumnRenamed("frame_idx", "held_idx").write.parquet(str(tmp_path / "folds"))
    args = ["segment", "--manifest", str(tmp_path / "m.csv"), "--masks", str(tmp_path / "masks"), "--logits", str(tmp_path / "logits"), "--fold-logits", str(tmp_path / "folds"), "--output", str(tmp_path / "out"), "--image-size", str(H), str(W)]
    assert main(args) == 0
    said = capsys.readouterr().out
    assert "1 sequences, 12 files" in said and "IoU median 1.0" in said
    assert ((png.decode((tmp_path / "out" / "s" / "masks" / "f4.png").read_bytes()) > 0) == disc(7)).all()
    assert {r.pred_source for r in spark.read.parquet(str(tmp_path / "out" / "frame_manifest")).collect()} == {"manual", "propagated"}
    assert main([*args, "--no-loo"]) == 0 and "0 files" in capsys.readouterr().out, "what is done is not done again"
    with pytest.raises(SystemExit):
        main(["segment", "--adapter", "plant", "--masks", "m", "--logits", "l", "--output", "o"])


def test_command_line_crops(spark, tmp_path, capsys):
    os.makedirs(tmp_path / "t")
    os.makedirs(tmp_path / "m")
    data = io.BytesIO()
    np.save(data, np.arange(H * W, dtype=np.float32).reshape(H, W))
    (tmp_path / "t" / "x_temp.npy").write_bytes(data.getvalue())
    small = disc(6)[::2, ::2]
    (tmp_path / "m" / "x.png").write_bytes(png.encode(small.astype(np.uint8) * 255))
    assert main(["crop", "--frames", str(tmp_path / "t"), "--masks", str(tmp_path / "m"), "--output", str(tmp_path / "o"), "--image-size", str(H), str(W)]) == 0
    assert "3 files" in capsys.readouterr().out
    large = np.kron(small, np.ones((2, 2))) > 0
    ys, xs = np.nonzero(large)
    crop = np.load(tmp_path / "o" / "x_crop.npy")
    assert crop.shape == (ys.max() - ys.min() + 1, xs.max() - xs.min() + 1) and np.isfinite(crop).sum() == large.sum()


def test_traits_of_four_tiers(spark, tmp_path):
    depth, mask, n = np.full((200, 200), 1000.0), np.zeros((200, 200), bool), 200 * 200
    mask[80:120, 80:120] = True
    depth[mask] = 900.0
    flat = {"mask": mask.ravel().tolist(), "depth": depth.ravel().tolist(), "camera": [600.0, 600.0, 100.0, 100.0]}
    flat |= {"r": [30.0] * n, "g": [200.0] * n, "b": [40.0] * n, "b555": [0.1] * n, "b660": [0.05] * n, "b720": [0.1] * n, "b840": [0.5] * n}
    kinds = "frame_id int, " + ", ".join(f"{k} array<{'boolean' if k == 'mask' else 'double'}>" for k in flat)
    frames = spark.createDataFrame([(1, *flat.values()), (2, flat["mask"], None, *list(flat.values())[2:]), (3, [False] * n, *list(flat.values())[1:])], kinds)
    got = {r.frame_id: r for r in traits.compute_traits(frames, 200, ["frame_id"]).collect()}
    r = got[1]
    assert r._traits_run == ["shape2d", "rgb_vegetation_indices", "canopy_3d_geometry", "multispectral_vegetation_indices"]
    assert r.area_px == 1600 and r.perimeter_px == 156.0 and r.convex_hull_area_px == 39.0 * 39 and r.solidity > 1 and 0.8 < r.circularity < 1 and r.aspect_ratio == 1.0
    assert r.ExG_mean > 1 and r.ExG_valid_frac == 1.0 and abs(r.NDVI_mean - 0.8182) < 1e-4
    assert abs(r.mean_canopy_height_mm - 100) < 0.5 and r.geometry_qc_pass and r.missing_reason == ""
    assert [r[f"{t}_error"] for t in r._traits_run] == [None] * 4
    assert got[2].canopy_3d_geometry_error == "a raster is missing" and got[2].area_px == 1600 and got[2].mean_canopy_height_mm is None
    assert got[3].missing_reason == "soil_plane_unavailable" and got[3].area_px == 0 and got[3].perimeter_px is None
    short = frames.where("frame_id = 1").withColumn("r", F.slice("r", 1, 7))
    e = traits.compute_traits(short, 200, ["frame_id"]).first()
    assert e.rgb_vegetation_indices_error == "r and mask differ in size" and e.ExG_mean is None and e.area_px == 1600
    one_band = traits.compute_traits(frames.select("frame_id", "mask", "b555"), 200, ["frame_id"]).where("frame_id = 1").first()
    assert one_band.multispectral_vegetation_indices_error == "missing inputs: b660, b720, b840" and one_band.area_px == 1600


def test_kernels_pass_columns_through(spark):
    df = spark.createDataFrame([(1 << 60, {"a": 1}, [1.0, None]), (None, None, None)], "k long, m map<string,int>, v array<double>")
    got = K.per_frame(df, ["k", "m"], ["v"], lambda v: {"n": None if v is None else len(v), "first": [] if v is None else [v[0]]}, "n int, first array<double>").collect()
    assert {(r.k, r.n, tuple(r.first), r.error) for r in got} == {(1 << 60, 2, (1.0,), None), (None, None, (), None)} and {"a": 1} in [r.m for r in got]


def test_configurations(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"thermal": {"hac_max_lags": 5, "unknown": 1}, "presets": {"fast": {"block_bootstrap_iterations": 10}}}))
    got = config.load_thermal_config(str(path), "fast")
    assert (got.hac_max_lags, got.block_bootstrap_iterations, got.interpolation_max_gap_sec, got.random_seed) == (5, 10, 600.0, 20260728)
    assert config.load_thermal_config() == config.ThermalConfig()
    with pytest.raises(KeyError):
        config.load_thermal_config(str(path), "none")
    with pytest.raises(FileNotFoundError):
        config.load_thermal_config(None, "fast")
    assert tables.overlay(config.SegmentConfig, {"dilate_px": 3, "more": 1}).dilate_px == 3 and config.SegmentConfig().hard_area_max_px == 30_000
    assert config.as_mapping(R.PropagationConfig())["threshold_ladder"] == [-0.5, -1.0, -2.0, -4.0]


def test_masks_are_read_back(spark, tmp_path):
    frames = spark.createDataFrame([("a", disc(5).ravel().tolist(), W)], "stem string, mask array<boolean>, width int")
    files = rasters.png_bytes(frames, "mask").select(F.concat("stem", F.lit(".png")).alias("name"), F.col("png").alias("content"))
    assert tables.write_files(files, str(tmp_path)) == 1
    back = rasters.read_masks(spark, str(tmp_path)).first()
    assert (np.array(back.mask).reshape(H, W) == disc(5)).all() and (back.height, back.width, back.stem) == (H, W, "a")
