"""Time series, inference, sequences, sources and streams: closed-form cases."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.operators import inference as N, raster as R, sequence as S, timeseries as T
from canopyframe.sources import png, rasters, tables
from canopyframe.streaming import live

T0 = dt.datetime(2024, 1, 1, 16, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# --- alignment -----------------------------------------------------------------------


@pytest.mark.parametrize("stretch", [None, 300.0, 3600.0])
def test_bracketed_alignment(spark, stretch):
    log = spark.createDataFrame([(at(0), 20.0), (at(5), 21.0), (at(10), 22.0), (at(15), 23.0), (at(15), 25.0), (at(60), None), (at(61), 1.0)], "ts timestamp_ntz, v double")
    frames = spark.createDataFrame([(i, at(m)) for i, m in enumerate((2.5, 5, -1, 200, 12.5, 15, 30, 60.5, 61))], "id int, ts timestamp_ntz")
    got = {r.id: r for r in T.align(frames, T.prepare_sensor(log, "ts", ["v"]), "ts", ["v"], stretch_sec=stretch).collect()}
    assert (got[0].v, got[0].qc_flag, got[0].bracket_gap_sec, got[0].nearest_offset_sec) == (20.5, "ok", 300.0, 150.0)
    assert (got[1].v, got[1].qc_flag, got[1].bracket_gap_sec) == (21.0, "ok", 0.0)
    assert got[2].qc_flag == got[3].qc_flag == "outside_sensor_range" and got[2].v is None and got[3].bracket_gap_sec is None
    assert got[4].v == 23.0 and got[4].qc_flag == "duplicate_sensor_timestamp_aggregated"
    assert got[5].v == 24.0 and got[5].qc_flag == "duplicate_sensor_timestamp_aggregated"
    assert got[6].qc_flag == "sensor_gap_exceeds_limit" and got[6].v is None
    assert got[7].qc_flag == "sensor_value_missing" and got[8].qc_flag == "ok"


def test_alignment_without_sensor(spark):
    log = spark.createDataFrame([], "ts timestamp_ntz, v double")
    frames = spark.createDataFrame([(1, at(0))], "id int, ts timestamp_ntz")
    assert T.align(frames, T.prepare_sensor(log, "ts", ["v"]), "ts", ["v"]).first().qc_flag == "sensor_empty"


@pytest.mark.parametrize("stretch", [None, 7200.0])
def test_shifted_pairs(spark, stretch):
    day = 24 * 60
    rows = [(at(0), 1.0, "lit"), (at(day - 2), 5.0, "lit"), (at(day + 2), 7.0, "dark"), (at(100), 2.0, None), (at(day + 110), 9.0, "lit")]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double, phase string")
    got = T.pair_shifted(df, "ts", ["v"], phase="phase", stretch_sec=stretch).collect()
    assert len(got) == 1 and got[0].diff__v == 4.0 and got[0].pair_offset_sec == -120.0 and got[0].phase_agreement is True


def test_transitions(spark):
    rows = [(at(i), p) for i, p in enumerate([None, "a", "a", None, None, "b"])]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, phase string")
    assert [r.to_phase for r in T.light_transitions(df, "ts", "phase").orderBy("ts").collect()] == ["a", None, "b"]
    assert T.light_transitions(df, "ts", "phase", strict=True).count() == 5


def test_kinetics_event_row(spark):
    df = spark.createDataFrame([("p", at(-60), 1.0), ("p", at(0), 3.0), ("p", at(30), 5.0)], "p string, ts timestamp_ntz, v double")
    got = {r.window: r for r in T.recovery_kinetics(df, "ts", "v", "2024-01-01 16:00:00", ["p"]).collect()}
    assert got["pre_event_all"].n == 2 and got["pre_event_all"].mean == 2.0 and got["pre_event_all"].vs_baseline == 1.0 and got["0-1h"].vs_baseline == 4.0 and len(got) == 2


def test_summaries(spark):
    df = spark.createDataFrame([("p", at(1), 4.0, "lit"), ("p", at(0), 2.0, "lit"), ("p", at(2), 9.0, None)], "p string, ts timestamp_ntz, v double, phase string")
    one = T.plant_summary(df, "p", "ts", ["v"]).first()
    assert (one.n, one.first_time, one.v_median) == (3, at(0), 4.0)
    two = T.phase_summary(df, "p", "phase", ["v"]).collect()
    assert len(two) == 1 and two[0].v_mean == 3.0 and abs(two[0].v_std - math.sqrt(2)) < 1e-12


# --- inference --------------------------------------------------------------------------


def test_student_p_table_values():
    for t, df, p in ((2.228, 10, 0.05), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (3.169, 10, 0.01)):
        assert abs(N.student_p(t, df) - p) < 2e-4
    assert N.student_p(0.0, 5) == 1.0 and abs(N.normal_p(1.959964) - 0.05) < 1e-6


def test_bootstrap_bounds():
    x = np.random.default_rng(0).normal(3, 1, 200)
    low, high = N.moving_block_ci(x, iterations=500)
    assert low < x.mean() < high and math.isnan(N.moving_block_ci(x[:5])[0])
    low, high, p = N.block_difference_ci(x, x - 2, iterations=300)
    assert high < 0 and p == 0.0
    assert N.block_difference_ci(x[:4], x[:4], iterations=50)[0] == 0.0, "shorter than a block: no width"


def test_hac_against_plain_formula(spark):
    x = np.cumsum(np.random.default_rng(1).normal(0, 1, 80))
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, t int, v double")
    got = N.hac_mean(df, ["k"], "t", "v").first()
    e, lags = x - x.mean(), 12
    s = (e @ e) + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    assert abs(got.mean - x.mean()) < 1e-9 and abs(got.hac_se - math.sqrt(s) / len(x)) < 1e-9


def test_regression_recovers_coefficients(spark):
    r = np.random.default_rng(2)
    rows = [("k", i, float(i >= 50), float(h), float(3 + 2.0 * (i >= 50) + 0.5 * h + e)) for i, (h, e) in enumerate(zip(r.normal(0, 1, 100), r.normal(0, 0.1, 100)))]
    df = spark.createDataFrame(rows, "k string, t int, post double, h double, y double")
    got = N.hac_regression(df, ["k"], "t", "y", ["post", "h"]).first()
    assert abs(got.coef - 2) < 0.1 and abs(got.covariate_coefs["h"] - 0.5) < 0.1 and got.p_value < 1e-6 and got.r_squared > 0.98 and got.ci_low < 2.1
    empty = N.hac_regression(df.withColumn("y", F.lit(None).cast("double")), ["k"], "t", "y", ["post"]).first()
    assert empty.n == 0 and empty.coef is None
    assert abs(N.ols_effect(df, ["k"], "y", F.col("post")).first().post_coef - 2) < 0.5


def test_contrast(spark):
    r = np.random.default_rng(7)
    rows = [("k", i, float(v) + (4.0 if i < 60 else 0.0)) for i, v in enumerate(r.normal(0, 1, 120))]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = N.phase_contrast(df, ["k"], "t", "v", F.col("t") >= 60, iterations=200).first()
    assert got.effect < -3 and got.boot_ci_high < 0 and got.ci_excludes_zero and got.p_value < 1e-6
    tiny = N.phase_contrast(df.where("t < 3"), ["k"], "t", "v", F.col("t") >= 2, iterations=10).first()
    assert tiny.t is None and tiny.ci_excludes_zero is False


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "i int, p double")
    got = [r.q for r in N.benjamini_hochberg(df, "p").orderBy("i").collect()]
    assert np.allclose(got, [0.02, 0.04, 0.04, 0.02])
    bad = df.unionByName(spark.createDataFrame([(9, None)], "i int, p double"))
    assert all(r.q is None for r in N.benjamini_hochberg(bad, "p").collect())
    assert sum(r.q is not None for r in N.benjamini_hochberg(bad, "p", poisoned=False).collect()) == 4


def test_spearman(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 20.0), ("a", 2.0, 15.0), ("a", 4.0, 90.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("b", 3.0, 1.0), ("c", 1.0, 2.0)], "k string, x double, y double")
    got = {r.k: r for r in N.spearman_p(N.spearman(df, ["k"], "x", "y")).collect()}
    assert abs(got["a"].rho - np.corrcoef([1, 2.5, 2.5, 4], [1, 3, 2, 4])[0, 1]) < 1e-12 and got["b"].rho is None and got["c"].rho is None and 0 < got["a"].p_value < 1


def test_driver_screen_and_paired(spark):
    r = np.random.default_rng(3)
    rows = [("p", at(i), "lit" if i % 2 else "dark", float(i), float(i) + float(r.normal(0, 0.1))) for i in range(30)]
    df = spark.createDataFrame(rows, "plant string, ts timestamp_ntz, phase string, d double, y double")
    got = N.driver_screen(df, "plant", "ts", "phase", ["d"], ["y"]).collect()
    assert {(g.scope, g.kind) for g in got} == {(s, k) for s in ("all", "lit", "dark") for k in ("level", "change")}
    assert all(g.rho > 0.9 for g in got if g.kind == "level")
    pairs = df.select("phase", "ts", F.lit(1.0).alias("diff__a"), F.lit(-1.0).alias("diff__b"))
    s = {(x.phase, x.metric): x for x in N.paired_difference_summary(pairs, "phase", "ts", ["diff__a", "diff__b"], iterations=20).collect()}
    assert s["lit", "diff__a"].positive_fraction == 1.0 and s["lit", "diff__b"].median == -1.0 and s["dark", "diff__a"].n_pairs == 15


def test_stress_response(spark):
    rows = [("p", at(15 * i), "lit" if i % 8 < 5 else "dark", (2.0 if i < 60 else -2.0) + 0.01 * (i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "plant string, ts timestamp_ntz, phase string, v double")
    event = str(at(15 * 60))
    contrast, regression, kinetics = N.stress_response(df, ["plant"], "ts", "phase", "v", event, iterations=50)
    assert {r.scope: round(r.effect) for r in contrast.collect()} == {"all": -4, "lit": -4, "dark": -4}
    assert abs(regression.first().coef + 4) < 0.1 and kinetics.where("window = '1-2h'").first().mean < -1.9


# --- sequences ---------------------------------------------------------------------------


def manifest(spark):
    rows = [("s", str(i), f"f{i}.png", "1" if i in (0, 3, 5) else "no", str(i + 1)) for i in range(6)] + [("t", None, "g.png", "yes", "1")]
    return spark.createDataFrame(rows, "sequence_key string, frame_idx string, frame_path string, is_anchor string, das string")


def test_manifest(spark):
    frames, skipped = S.manifest_sequences(manifest(spark))
    got = {r.frame_idx: r for r in frames.collect()}
    assert sorted(got) == list(range(6)) and got[3].is_anchor and not got[1].is_anchor and got[2].extras == {"das": "3"}
    assert [r.sequence_key for r in skipped.collect()] == ["t"]


def test_folds_and_quality(spark):
    frames, _ = S.manifest_sequences(manifest(spark))
    folds = {r.held_idx: r for r in S.leave_one_out_folds(frames, ["sequence_key"]).collect()}
    assert {k: (v.gap, v.is_endpoint) for k, v in folds.items()} == {0: (3, True), 3: (2, False), 5: (2, True)}
    assert {r.frame_idx: r.nearest_anchor for r in S.nearest_anchor(frames, ["sequence_key"]).collect()} == {0: 0, 1: 0, 2: 3, 3: 3, 4: 3, 5: 5}
    q = spark.createDataFrame([(0.9, 1.0, True), (0.8, 0.5, False), (0.6, 0.7, False)], "iou double, boundary_f1 double, is_endpoint boolean")
    s = S.quality_summary(q, interior_only=True).first()
    assert s.n == 2 and s.median_iou == 0.7 and s.frac_iou_ge_070 == 0.5 and s.frac_iou_ge_085 == 0.0
    assert S.quality_summary(q.where("iou > 2")).first().n == 0


def test_propagation_sources(spark):
    full, none = [1.0] * 16, [-9.0] * 16
    rows = [("s", i, i == 0, [True] * 16 if i == 0 else None) for i in range(5)]
    frames = spark.createDataFrame(rows, "seq string, frame_idx int, is_anchor boolean, anchor_mask array<boolean>")
    logits = spark.createDataFrame([("s", 1, full), ("s", 2, [-0.2] * 16), ("s", 3, none)], "seq string, frame_idx int, logits array<double>")
    rescue = spark.createDataFrame([("s", 3, full)], "seq string, frame_idx int, logits array<double>")
    done = S.propagate(frames, logits, rescue, ["seq"], R.PropagationConfig(), 16)
    assert {r.frame_idx: r.pred_source for r in done.collect()} == {0: "manual", 1: "propagated", 2: "propagated_lowthr", 3: "point_rescue", 4: "failed_empty"}
    roi = spark.createDataFrame([("s", (0, 0, 4, 4))], "seq string, roi struct<x0:int,y0:int,x1:int,y1:int>")
    rows = S.frame_rows(done, roi, ["seq"])
    s = S.sequence_summary(rows, ["seq"]).first()
    assert (s.n_manual, s.n_failed_empty, s.area_first, s.area_last, s.area_max) == (1, 1, 16, 0, 16) and rows.first().roi_x1 == 4
    assert S.remaining(frames.select("seq").distinct(), spark.createDataFrame([("s",)], "seq string"), ["seq"]).count() == 0


def test_index_sequences(spark):
    index = spark.createDataFrame([(f"{p}.0", "side", f"d\\{p}_{i}.png") for p in (1, 2, 3) for i in range(3)] + [("1.0", "top", "x.png"), ("", "side", "y.png")], "plant_no string, frame_role string, rgb_path string")
    anchors = spark.createDataFrame([("plant_01", "1_0"), ("plant_01", "1_2"), ("plant_02", "2_0"), ("plant_02", "zz")], "plant_key string, stem string")
    frames, skipped = S.index_sequences(index, anchors, "side")
    assert [(r.stem, r.frame_idx, r.is_anchor) for r in frames.orderBy("frame_idx").collect()] == [("1_0", 0, True), ("1_1", 1, False), ("1_2", 2, True)]
    assert {r.plant_key: r.reason for r in skipped.collect()} == {"plant_02": "too few matched anchors", "plant_03": "no anchor directory"}
    with pytest.raises(ValueError):
        S.index_sequences(index, anchors, "side", plants=[9])
    with pytest.raises(ValueError):
        S.index_sequences(index, anchors, "side", strict=True)
    assert S.unmatched_anchors(anchors, frames, ["plant_key", "stem"]).count() == 2


def test_paths(spark):
    files = spark.createDataFrame([("/a/x.tif",), ("/a/x.png",), ("/a/y.npy",), ("/a/z.doc",)], "path string")
    assert {r.stem: r.path for r in S.first_match(files).collect()} == {"x": "/a/x.png", "y": "/a/y.npy"}
    masks = spark.createDataFrame([("/m/whole/s1.png",), ("/m/s1.png",), ("/m/q_s2.png",)], "path string")
    got = S.find_mask(spark.createDataFrame([("s1",), ("s2",), ("s3",)], "stem string"), masks)
    assert {r.stem: r.mask_path for r in got.collect()} == {"s1": "/m/s1.png", "s2": "/m/q_s2.png", "s3": None}
    joined = S.stem_join(spark.createDataFrame([("x",)], "stem string"), ("rgb", files.withColumn("stem", F.lit("x")).limit(1)))
    assert joined.columns == ["stem", "rgb_path"]


def test_evidence_and_bounds(spark):
    rows = [("s", i, 100 + (i == 7) * 50 - (i == 4) * 50, "OK" if i != 9 else "FAIL") for i in range(30)]
    df = spark.createDataFrame(rows, "segment string, frame_idx int, area_px int, qc string")
    assert {r.frame_idx for r in S.evidence_frames(df, ["segment"], reference=2).collect()} == {0, 2, 4, 7, 9, 29}
    assert S.evidence_frames(df, ["segment"], full=["s"]).count() == 30 and S.evidence_frames(df, ["segment"], dense=["s"]).count() > 10
    with pytest.raises(Exception, match="outside"):
        S.assert_anchor_bounds(df, df.limit(1).withColumn("frame_idx", F.lit(99)), ["segment"]).collect()


# --- sources and sinks --------------------------------------------------------------------


@pytest.mark.parametrize("image", [np.arange(48, dtype=np.uint8).reshape(6, 8), (np.arange(48) * 1000).astype(np.uint16).reshape(6, 8), np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)])
def test_png_round_trip(image):
    assert (png.decode(png.encode(image)) == image).all()


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    import struct
    import zlib

    image = np.random.default_rng(kind).integers(0, 256, (4, 5, 3)).astype(int)
    lines, above = [], np.zeros(15, dtype=int)
    for row in image.reshape(4, 15):
        left, corner = np.r_[0, 0, 0, row[:-3]], np.r_[0, 0, 0, above[:-3]]
        p = left + above - corner
        paeth = [min(((abs(q - v), k, v) for k, v in enumerate((a, b, c))))[2] for q, a, b, c in zip(p, left, above, corner)]
        guess = [np.zeros(15, int), left, above, (left + above) // 2, np.array(paeth)][kind]
        lines.append(bytes([kind]) + bytes(((row - guess) & 255).astype(np.uint8)))
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (png.decode(data) == image).all()


def test_raster_scans(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.png").write_bytes(png.encode((np.eye(4) * 200).astype(np.uint8)))
    (tmp_path / "m" / "b.png").write_bytes(png.encode((np.eye(4) * 100).astype(np.uint8)))
    np.save(tmp_path / "m" / "s_temp.npy", np.full((2, 3), 25.5, dtype=np.float32))
    (tmp_path / "d.png").write_bytes(png.encode(np.full((2, 2), 40000, dtype=np.uint16)))
    masks = {r.stem: r for r in rasters.read_masks(spark, str(tmp_path / "m"), 127).collect()}
    assert sum(masks["a"].mask) == 4 and sum(masks["b"].mask) == 0 and masks["a"].width == 4
    temp = rasters.MODALITIES["thermal"](spark, str(tmp_path / "m"))
    assert temp.first().temp == [25.5] * 6
    meta = spark.createDataFrame([("/x/s_meta.json", '{"a": "1"}')], "path string, value string")
    assert rasters.thermal_meta(temp, meta).first().meta == {"a": "1"}
    band = rasters.read_band(spark, str(tmp_path), "band", "d.png").first()
    assert abs(band.band[0] - 40000 / 65535) < 1e-6
    out = rasters.png_bytes(rasters.read_masks(spark, str(tmp_path / "m")), "mask").first()
    assert (png.decode(bytes(out.png)) > 0).sum() == 4
    assert len(rasters.content_hashes(rasters.scan(spark, str(tmp_path / "m"))).first().sha256) == 64
    disc = rasters.growing_disc(spark, 2, 40, 30, 5.0, 2.0).collect()
    assert sum(disc[0].mask) < sum(disc[1].mask)
    with pytest.raises(ValueError):
        rasters.register_modality("rgb", rasters.read_rgb)


def test_tables(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿sequence_key,frame_path\ns,a.png\n", encoding="utf-8")
    (tmp_path / "m.json").write_text(json.dumps({"frames": [{"sequence_key": "s"}, {"sequence_key": "t"}]}))
    assert tables.read_manifest(spark, str(tmp_path / "m.csv")).columns == ["sequence_key", "frame_path"]
    assert tables.read_manifest(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "e.csv").write_text("time,T\n2024-01-01 00:00:00,21.5\nbad,x\n")
    log = tables.read_workbook(spark, str(tmp_path / "e.csv"), {"timestamp": "time", "temp": "T"}).collect()
    assert log[0].temp == 21.5 and log[1].temp is None and log[1].timestamp is None
    with pytest.raises(ValueError):
        tables.read_sensor_log(spark.range(1), {"timestamp": "no"})
    doc = {"results_by_resolution": {"640x480": {"attempts": [{"resolved_streams": {"color": {"resolved": {"intrinsics": {"fx": 1.0, "fy": 2.0, "ppx": 3.0, "ppy": 4.0}}}}}]}}}
    got = spark.createDataFrame([(json.dumps(doc),)], "d string").select(tables.intrinsics(F.col("d"), 640, 480).alias("i"), tables.intrinsics(F.col("d"), 1, 1).alias("n")).first()
    assert (got.i.fx, got.i.cy) == (1.0, 4.0) and got.n is None
    (tmp_path / "c.json").write_text(json.dumps({"roi_min_size": 5, "unknown": 1, "presets": {"x": {"roi_pad_ratio": 2.5}}}))
    cfg = tables.load_config(R.PropagationConfig, str(tmp_path / "c.json"), "x")
    assert cfg.roi_min_size == 5 and cfg.roi_pad_ratio == 2.5 and tables.load_config(R.PropagationConfig).base_threshold == 0.0
    with pytest.raises(KeyError):
        tables.load_config(R.PropagationConfig, str(tmp_path / "c.json"), "y")
    with pytest.raises(FileNotFoundError):
        tables.load_config(R.PropagationConfig, None, "y")


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 3.0)], "a int, c double")
    tables.write_csv(tables.union_rows(a, b), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["a", "b", "c"]
    tables.write_run({"t": a}, str(tmp_path / "run"), ["a"])
    assert spark.read.parquet(str(tmp_path / "run" / "t")).count() == 1
    flagged = spark.createDataFrame([("OK",), ("FAIL",)], "qc_flag string")
    with pytest.raises(ValueError):
        tables.publish(flagged, str(tmp_path / "pub"))
    assert not (tmp_path / "pub").exists()
    tables.publish(flagged.where("qc_flag = 'OK'"), str(tmp_path / "pub"))


def test_prompts(spark):
    schema = "prompt_type string, box array<int>, points array<array<int>>, point_labels array<int>"
    good = spark.createDataFrame([("box", [1, 2, 30, 40], None, None), ("points", None, [[5, 5]], [1])], schema)
    assert tables.check_prompts(good).count() == 2 and len(tables.check_prompts(good).collect()) == 2
    for bad in (("box", [1, 2, 900, 40], None, None), ("points", None, [[5, 5]], [2]), ("points", None, [[5, 5]], None), ("none", None, None, None)):
        with pytest.raises(Exception, match="invalid prompt"):
            tables.check_prompts(spark.createDataFrame([bad], schema)).collect()


# --- streams ----------------------------------------------------------------------------


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_streams(spark, tmp_path):
    rows = [("k", at(i), float(i), "a" if i < 30 else "b") for i in range(60)]
    spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, phase string").coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema("k string, ts timestamp_ntz, v double, phase string").parquet(str(tmp_path / "s"))
    windows = drain(live.sensor_windows(stream(), "ts", "v", ["k"]), "w", "complete")
    assert len(windows) == 6 and all(w.n == 10 for w in windows)
    changes = drain(live.phase_changes(stream(), "k", "ts", "phase"), "c")
    assert [(c.from_phase, c.to_phase) for c in changes] == [("a", "b")]
    pairs = drain(live.frame_sensor_join(stream().select("k", "ts"), stream().select("k", "ts", "v"), "ts", "k", "1 minutes"), "j")
    assert len(pairs) == 60 * 3 - 2


def test_canopy_stream(spark, tmp_path):
    spark.createDataFrame([(1, [20.0, 30.0], [True, False])], "id int, temp array<double>, mask array<boolean>").write.parquet(str(tmp_path / "f"))
    s = spark.readStream.schema("id int, temp array<double>, mask array<boolean>").parquet(str(tmp_path / "f"))
    assert drain(live.canopy_stream(s, ["id"]), "f")[0].canopy_mean == 20.0


def test_command_line(spark, tmp_path, capsys):
    from canopyframe.__main__ import build_parser, main

    assert main(["list-traits"]) == 0 and "shape2d" in capsys.readouterr().out
    assert build_parser().parse_args(["align", "--frames", "f", "--sensor", "s", "--out", "o", "--value", "v"]).max_gap_sec == 600.0
    spark.createDataFrame([(1, [True, False])], "frame_id int, mask array<boolean>").write.parquet(str(tmp_path / "f"))
    assert main(["phenotype", "--frames", str(tmp_path / "f"), "--out", str(tmp_path / "t"), "--width", "2"]) == 0
    assert spark.read.parquet(str(tmp_path / "t")).first().area_px == 1


def _plain_moving(x, draws=4000, block=12):
    rng, n = np.random.default_rng(42), len(x)
    if n < block:
        return None, None
    found = [x[((rng.integers(0, n, size=-(-n // block))[:, None] + np.arange(block)) % n).ravel()[:n]].mean() for _ in range(draws)]
    return tuple(np.quantile(found, [0.025, 0.975]))


def _plain_difference(a, b, draws=4000, block=12):
    rng = np.random.default_rng(42)
    one = lambda x: np.concatenate([x[s : s + block] for s in rng.integers(0, max(1, len(x) - block + 1), size=-(-len(x) // block))])[: len(x)].mean()
    found = np.array([one(b) - one(a) for _ in range(draws)])
    return (*np.percentile(found, [2.5, 97.5]), (found >= 0).mean())


def test_bootstrap_queries_take_all_plants_and_draws(spark, tmp_path):
    from canopyframe.plans import series_queries as Q

    rng, start = np.random.default_rng(3), Q.EVENT[:10]
    rows = [(i * 1000 + k, i, float(rng.normal(i, 2))) for i, n in ((1, 5), (2, 40), (7, 61), (20, 25), (41, 12)) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double").selectExpr("*", f"timestamp_ntz '{start} 00:00:00' + make_dt_interval(0, event_id % 1000 * 5 - 100) AS ts")
    df.write.parquet(str(tmp_path / "events.parquet"))
    series = {i: np.array([v for e, u, v in rows if u == i]) for i in (1, 2, 7, 20, 41)}
    got = {r.plant_id: (r.ci_low, r.ci_high) for r in Q.q_bootstrap_rows(spark, str(tmp_path)).collect()}
    assert got == {i: _plain_moving(x) for i, x in series.items()}
    after = {(r.user_id, r.event_id) for r in df.where(Q._post()).collect()}
    boot = {(r.plant_id, r.scope): r for r in Q.q_stress_contrast_rows(spark, str(tmp_path)).collect()}
    assert {p for p, _ in boot} == set(series)
    for i, x in series.items():
        side = np.array([(i, e) in after for e, u, _ in rows if u == i])
        if min(side.sum(), (~side).sum()) >= 2:
            r = boot[i, "all"]
            assert (r.boot_ci_low, r.boot_ci_high, r.p_positive) == _plain_difference(x[~side], x[side])
    assert sum(r.p_positive is not None for r in boot.values()) > 3


def test_bootstrap_by_formula_computes_recurring_draws_once(spark):
    """Series shorter and longer than the iterations, against every draw; no row is made per draw."""
    r = np.random.default_rng(6)
    series = {"a": r.normal(size=17), "b": r.normal(size=40), "c": r.normal(size=150), "d": r.normal(size=12), "short": r.normal(size=11)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, i int, v double")
    found = N.bootstrap_hash_ci(df, ["k"], "i", "v", iterations=100)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {x.k: x for x in found.collect()}
    assert set(got) == set(series) - {"short"}
    for k in got:
        x, n = series[k], len(series[k])
        means = [np.mean(np.concatenate([x[((7919 * i + 104729 * b + 13) + np.arange(12)) % n] for b in range(-(-n // 12))])[:n]) for i in range(100)]
        np.testing.assert_allclose([got[k].n, got[k].ci_low, got[k].ci_high], [n, *np.quantile(means, [0.025, 0.975])], rtol=1e-9)


def test_benjamini_hochberg_ranks_no_family_in_one_task(spark):
    """Ties, zeros, ones and several families against the definition; the largest task holds a small share of a family."""
    r = np.random.default_rng(8)
    ps = np.concatenate([r.random(3000), r.random(500) ** 6, np.zeros(20), np.ones(30), np.full(40, 0.25), [1e-300]])
    names = [None, "x", "y"]
    df = spark.createDataFrame([(i, names[i % 3], float(v)) for i, v in enumerate(ps)] + [(9000 + i, "y", None) for i in range(50)], "i int, f string, p double")

    def q(values):
        order = np.argsort(values)
        raw = values[order] * len(values) / np.arange(1, len(values) + 1)
        out = np.empty(len(values))
        out[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1.0)
        return out

    whole = {x.i: x.q for x in N.benjamini_hochberg(df.where("p is not null"), "p").collect()}
    np.testing.assert_allclose([whole[i] for i in range(len(ps))], q(ps), rtol=1e-12)
    found = N.benjamini_hochberg(df, "p", ["f"])
    assert found.columns == ["i", "f", "p", "q"] and found.count() == len(ps) + 50
    got = {x.i: x.q for x in found.collect()}
    for k in (0, 1):
        np.testing.assert_allclose([got[i] for i in range(k, len(ps), 3)], q(ps[k::3]), rtol=1e-12)
    assert all(got[i] is None for i in range(2, len(ps), 3)) and got[9000] is None
    plan = N.benjamini_hochberg(df, "p", poisoned=False)._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in plan.splitlines() if "Window" in line and "_p#" in line]
    assert rows and all("windowspecdefinition(_b" in line for line in rows)
