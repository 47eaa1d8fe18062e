"""Raster operators and kernels: closed-form cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopyframe.functions import arrays as A, indices as I, physics as P
from canopyframe.operators import geometry as G, index_stats as X, kernels as K, raster as R
from canopyframe.plans import traits


def flat(a):
    return np.asarray(a).ravel().tolist()


def one(spark, cols, schema, **exprs):
    df = spark.createDataFrame([cols], schema)
    return df.select(*(e.alias(k) for k, e in exprs.items())).first()


def square(n, lo, hi, kind=bool):
    m = np.zeros((n, n), dtype=kind)
    m[lo:hi, lo:hi] = 1
    return m


# --- arrays ----------------------------------------------------------------------


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 9.0], [3.0], [], [float("nan"), 1.0, float("inf"), None, 5.0]])
def test_summary_matches_numpy(spark, values):
    s = one(spark, (values,), "v array<double>", s=A.summary(F.col("v"))).s
    ok = np.array([v for v in values if v is not None and math.isfinite(v)])
    if not len(ok):
        assert s.n == 0 and s.mean is None and s.median is None and s.std is None
        return
    want = {"median": np.median(ok), "mean": ok.mean(), "p10": np.percentile(ok, 10), "p90": np.percentile(ok, 90), "std": ok.std(), "n": len(ok)}
    assert all(abs(s[k] - v) < 1e-12 for k, v in want.items())


def test_safe_division(spark):
    got = one(spark, (1.0, 0.0, float("nan")), "a double, z double, n double", ok=A.safe_div(F.col("a"), F.lit(-2.0)), zero=A.safe_div(F.col("a"), F.col("z")), nan=A.safe_div(F.col("a"), F.col("n")))
    assert got.ok == -0.5 and got.zero is None and got.nan is None


# --- indices -----------------------------------------------------------------------


def test_green_plant(spark):
    df = spark.createDataFrame([([30.0] * 4, [200.0] * 4, [40.0] * 4, [True] * 4)], "r array<double>, g array<double>, b array<double>, m array<boolean>")
    got = R.rgb_summaries(df, "r", "g", "b", "m").first()
    assert got.ExG.mean > 1 and got.GRVI.mean > 0.5 and got.VARI.mean is not None and got.rgb_masked == 4 and got.ExG.n == 4


def test_index_statistics_of_odd_frames(spark):
    """Nulls, short channels, pixels that are no numbers and empty masks; statistics are those of the values one by one."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [True, False, True, True, None, True], [1.0, 9.0, nan, 4.0, 5.0, None], [2.0, 9.0, 3.0, inf, 5.0, 6.0]), (2, [False] * 3, [1.0] * 3, [1.0] * 3), (3, None, [1.0], [1.0]), (4, [True], None, [1.0]),
        (5, [True, True, True], [1.0, 2.0], [3.0, 4.0, 5.0]), (6, [], [], []), (7, [True] * 4, [3.0, 1.0, 2.0, 10.0], [1.0, 1.0, 1.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "k int, m array<boolean>, a array<double>, b array<double>").repartition(1)
    found = X.index_statistics(F.col("m"), [F.col("a"), F.col("b")], ["sum", "ratio"], lambda a, b: {"sum": a + b, "ratio": A.safe_div(a, b - 1)})
    got = {r.k: r.s for r in df.select("k", found.alias("s")).collect()}
    assert got[1].masked == 4 and got[1]["sum"].n == 1 and got[1]["sum"].median == got[1]["sum"].p90 == 3.0 and got[1]["sum"].std == 0.0 and got[1].ratio.n == 1
    assert got[2].masked == 0 and got[2]["sum"].n == 0 and got[2]["sum"].mean is None and got[6].masked == 0
    assert got[3].masked is None and got[3]["sum"].n is None and got[4].masked == 1 and got[4]["sum"].n is None
    assert got[5].masked == 3 and got[5]["sum"].n == 2 and got[5]["sum"].mean == 5.0
    v = np.array([4.0, 2.0, 3.0, 11.0])
    assert [got[7]["sum"][k] for k in A.STATS] == [np.median(v), v.mean(), np.quantile(v, 0.1), np.quantile(v, 0.9), v.std(), 4] and got[7].ratio.n == 0


def test_uniform_bands(spark):
    got = one(spark, (0.1, 0.05, 0.1, 0.5), "g double, r double, e double, n double", **I.spectral_indices(*map(F.col, "gren")))
    for name, want in {"NDVI": 0.8182, "NDRE": 0.6667, "GNDVI": 0.6667, "MCARI": 0.10, "TCARI": 0.15}.items():
        assert abs(got[name] - want) < 1e-4


def test_black_pixels_and_gain(spark):
    r, g, b = I.normalized(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    got = one(spark, (1,), "x int", r=r, gain=I.gain(F.lit(0.62), F.lit(0.31)), big=I.band_scale(F.array(F.lit(65535.0), F.lit(0.0)))[0])
    assert got.r is None and abs(got.gain - 2.0) < 1e-12 and got.big == 1.0
    with pytest.raises(Exception, match="panel"):
        one(spark, (0.0,), "x double", g=I.gain(F.lit(1.0), F.col("x")))


def test_physics(spark):
    got = one(
        spark, ("20240115_123456_789_x", 25.0), "s string, t double", vpd=P.vpd_kpa(F.col("t"), F.lit(100.0)), h=P.height_over_plane(F.lit(0.0), F.lit(0.0), F.lit(900.0), F.lit(0.0), F.lit(0.0), F.lit(1000.0)),
        at=P.stem_time(F.col("s"), "Asia/Shanghai").cast("string"), key=P.plant_key(P.plant_number(F.lit("3.0"))), stem=P.path_stem(F.lit("a\\b/c.d.png")),
        area=P.shoelace(F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 4.0, 4.0)))), rot=P.is_rotation([F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]), refl=P.is_rotation([F.lit(float(v)) for v in (1, 0, 0, 0, 1, 0, 0, 0, -1)]),
    )
    assert abs(got.vpd) < 1e-12 and got.h == 100.0 and got["at"].startswith("2024-01-15 04:34:56.789")
    assert got.key == "plant_03" and got.stem == "c.d" and got.area == 16.0 and got.rot and not got.refl


# --- shapes and regions -----------------------------------------------------------------


def test_square_and_empty_shape(spark):
    cols = R.shape_moments(F.col("m"), 120)
    got = one(spark, (flat(square(120, 40, 80)),), "m array<boolean>", s=cols).s
    assert (got.area_px, got.bbox_w, got.bbox_h, got.aspect_ratio, got.centroid_x) == (1600, 40, 40, 1.0, 59.5)
    empty = one(spark, (flat(np.zeros((50, 50), bool)),), "m array<boolean>", s=R.shape_moments(F.col("m"), 50)).s
    assert empty.area_px == 0 and empty.bbox_w is None and empty.centroid_x is None


def test_boxes(spark):
    box = R.tight_bbox(F.col("m"), 20)
    got = one(spark, (flat(square(20, 5, 8)),), "m array<boolean>", t=box, e=R.expand_bbox(box, 1, 8, 20, 20), odd=R.expand_bbox(box, 0, 6, 20, 20), c=R.closed_bbox(F.col("m"), 20), none=R.closed_bbox(F.transform("m", lambda x: F.lit(False)), 20))
    assert tuple(got.t) == (5, 5, 8, 8) and tuple(got.e) == (3, 3, 11, 11) and tuple(got.odd) == (4, 4, 10, 10)
    assert tuple(got.c) == (5, 5, 7, 7) and tuple(got.none) == (0, 0, 0, 0)


def test_ladder(spark):
    a, b = np.full((50, 50), -9.0), np.zeros((50, 50))
    a[15:35, 15:35] = 0.3
    b[15:35, 15:35] = -0.2
    cfg = R.PropagationConfig()
    for logits, want in ((a, (0.0, False, 400)), (b, (-0.5, True, 2500)), (np.full((50, 50), -9.0), (0.0, True, 0))):
        got = one(spark, (flat(logits),), "l array<double>", r=R.threshold_ladder(F.col("l"), cfg))
        assert tuple(got.r) == want


def test_iou_and_boundaries(spark):
    a, b = square(16, 4, 10), square(16, 5, 11)
    empty = np.zeros((16, 16), bool)
    schema = "a array<boolean>, b array<boolean>, e array<boolean>"
    got = one(
        spark, (flat(a), flat(b), flat(empty)), schema, iou=R.mask_iou(F.col("a"), F.col("b")), none=R.mask_iou(F.col("e"), F.col("e")), same=R.boundary_f1(F.col("a"), F.col("a"), 16, 16),
        near=R.boundary_f1(F.col("a"), F.col("b"), 16, 16), nothing=R.boundary_f1(F.col("e"), F.col("e"), 16, 16), half=R.boundary_f1(F.col("a"), F.col("e"), 16, 16),
    )
    assert abs(got.iou - 25 / 47) < 1e-12 and got.none == 1.0 and got.same == 1.0 and got.near == 1.0 and got.nothing == 1.0 and got.half == 0.0


def test_layers(spark):
    m = np.zeros((60, 50), bool)
    m[10:40, 20:30] = True
    temp = np.where(np.arange(60)[:, None] < 20, 30.0, 20.0) * np.ones((60, 50))
    got = one(spark, (flat(temp), flat(m)), "t array<double>, m array<boolean>", s=R.layer_temperatures(F.col("t"), F.col("m"), 50)).s
    assert got.upper_median == 30.0 and got.lower_median == 20.0 and got.upper_minus_lower == 10.0 and got.upper_n == got.lower_n == got.middle_n == 100 and got.layer_error is None
    two = one(spark, ([1.0] * 8, [True] * 8), "t array<double>, m array<boolean>", s=R.layer_temperatures(F.col("t"), F.col("m"), 4)).s
    assert two.layer_error and two.upper_median is None


def test_direction_merge(spark):
    t, f, n = [True] * 4, [False] * 4, None
    rows = [(t, f), (t, t), (f, t), (f, n), (n, n)]
    df = spark.createDataFrame(rows, "f array<boolean>, b array<boolean>")
    got = [r.m for r in df.select(R.merge_bidirectional(F.col("f"), F.col("b"), 4).alias("m")).collect()]
    assert got == [t, t, t, f, f]


def test_mesh_of_a_flat_scene(spark):
    depth = flat(np.full((6, 6), 900.0))
    got = one(spark, (depth,), "d array<double>", m=R.cell_area(F.col("d"), 6, 6, 600.0, 600.0, 3.0, 3.0)).m
    assert got.n_triangles == 50 and abs(got.projected_area - 25 * 1.5 * 1.5) < 1e-9


def test_paste_and_constrain(spark):
    box = R.box_struct(F.lit(1), F.lit(1), F.lit(3), F.lit(3))
    got = one(spark, ([True, False, False, True],), "s array<boolean>", p=R.paste_from_roi(F.col("s"), 2, 2, box, 4, 4))
    assert np.flatnonzero(got.p).tolist() == [5, 10]
    b = F.struct(F.lit(0.5).alias("x0"), F.lit(1.5).alias("y0"), F.lit(2.5).alias("x1"), F.lit(9.0).alias("y1"))
    got = one(spark, ([1.0] * 16,), "l array<double>", c=R.constrain_logits(F.col("l"), 4, 4, b))
    assert np.flatnonzero(np.array(got.c) == 1.0).tolist() == [8, 9, 12, 13]


# --- kernels ---------------------------------------------------------------------------


def test_components_and_morphology():
    m = np.zeros((8, 10), bool)
    m[1:3, 1:3] = m[3, 3] = m[6, 7:9] = True
    table = K.component_table(K.components(m))
    assert [(r["area"], r["x0"], r["y1"]) for r in table] == [(5, 1, 3), (2, 7, 6)]
    u = np.array([[1, 0, 1], [1, 0, 1], [1, 1, 1]], bool)
    assert K.components(u).max() == 1
    assert K.dilate(m, K.box(3)).sum() > m.sum() and K.erode(np.ones((4, 4), bool), K.box(3)).all()
    r = np.random.default_rng(1).random((20, 20)) > 0.6
    slow = np.array([[r[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for x in range(20)] for y in range(20)])
    assert (K.dilate(r, K.box(3)) == slow).all() and (K.grow(r, 0) == r).all()


def test_contours():
    assert K.polygon_area(K.outer_contour(square(5, 0, 5))) == 16.0
    objects = K.isat_objects(square(8, 0, 5))
    assert len(objects) == 1 and objects[0]["area"] == 16.0 and objects[0]["bbox"] == [0, 0, 5, 5]
    t = K.shape_traits(square(60, 10, 50))
    assert t["area_px"] == 1600 and abs(t["convex_hull_area_px"] - 39 * 39) < 1e-9 and t["solidity"] > 1
    line = np.zeros((5, 9), bool)
    line[2, 1:8] = True
    assert K.polygon_area(K.outer_contour(line)) == 0.0
    assert len(K.simplify(K.outer_contour(square(30, 2, 28)), 2.0)) == 4
    assert K.fill_polygons([[(1, 1), (4, 1), (4, 4), (1, 4)]], 6, 6).sum() == 16
    with pytest.raises(ValueError):
        K.fill_polygons([[(0, 0), (1, 1)]], 4, 4)


def two_blocks():
    m = np.zeros((20, 30), bool)
    m[2:8, 2:8] = m[12:18, 20:28] = True
    return m


def test_cleanup_rules():
    m = two_blocks()
    out, audit = K.clean_mask(m, None, [(4, 4)], [1], True)
    assert out.sum() == 36 and not audit["hard_fail"] and audit["support_mode"] == "reference_positive"
    assert K.clean_mask(m, None, [(4, 4), (5, 5)], [1, 0], True)[1]["hard_fail"]
    out, audit = K.clean_mask(m, None, [], [], True)
    assert out.sum() == 48 and audit["support_mode"] == "box_only" and not audit["hard_fail"]
    anchor = np.zeros_like(m)
    anchor[3:6, 3:6] = True
    out, audit = K.clean_mask(m, anchor, reach=2)
    assert out.sum() == 36 and audit["hard_fail"], "over three times the anchor"
    out, audit = K.clean_mask(m, m & (np.arange(30) < 10))
    assert out.sum() == 36 and not audit["hard_fail"]
    assert K.clean_mask(np.zeros_like(m), None, [(1, 1)], [1], True)[1]["support_mode"] == "none"
    assert K.clean_mask(m, None, [], [], True, most=10)[1]["hard_fail"]
    done = K.clean_sequence([m, m, m], 1, [(4, 4)], [1])
    assert [int(x.sum()) for x, _ in done] == [36, 36, 36]


def test_component_stats_match_pixels():
    r = np.random.default_rng(4)
    for _ in range(20):
        labels = K.components(r.random((17, 23)) > 0.6)
        for row in K.component_table(labels):
            ys, xs = np.nonzero(labels == row["label"])
            assert row == {"label": row["label"], "area": len(ys), "x0": xs.min(), "y0": ys.min(), "x1": xs.max(), "y1": ys.max()}


def test_distances_to_seeds():
    r = np.random.default_rng(5)
    for _ in range(20):
        seeds = r.random((13, 19)) > r.choice([0.7, 0.95, 0.99])
        at = np.argwhere(seeds)
        ys, xs = np.indices(seeds.shape)
        want = np.min([(ys - y) ** 2 + (xs - x) ** 2 for y, x in at], axis=0) if len(at) else np.full(seeds.shape, np.inf)
        assert (K.squared_distances(seeds) == want).all()


def test_pot_rim_evidence_within_its_arc():
    y, x = np.indices((220, 220))
    d = np.hypot(x - 110, y - 110)
    mask, rgb = d < 100, np.zeros((220, 220), bool)
    rgb[110, 200:205] = True
    ndvi = np.where(rgb, 0.5, 0.0)
    out, audit = K.remove_pot_rim(mask, rgb, ndvi, (110, 110, 100))
    near = (abs(y - 110) <= 5) & (x >= 195) & (x <= 209)
    assert (out == ((d < 68) | (mask & near))).all() and audit == {"inspected": 1, "suspicious": 1, "removed_px": int((mask & ~out).sum()), "preserved_px": int((mask & near).sum())}
    ring = (d >= 75) & (d < 100)  # touches no core
    out, audit = K.remove_pot_rim(ring, rgb, ndvi, (110, 110, 100))
    assert not out.any() and audit["preserved_px"] == 0
    assert K.remove_pot_rim(d < 50, rgb, ndvi, (110, 110, 100))[1]["inspected"] == 0


def test_pot_rim_keeps_the_core():
    y, x = np.indices((120, 120))
    d = np.hypot(x - 60, y - 60)
    disk = d < 50
    out, audit = K.remove_pot_rim(disk, np.zeros_like(disk), np.zeros(disk.shape), (60, 60, 50))
    assert (out == (d < 0.68 * 50)).all() and audit["suspicious"] == 1
    with pytest.raises(ValueError):
        K.remove_pot_rim(disk, disk, np.zeros(disk.shape), (60, 60, 0))


def test_overlap_goes_to_the_nearest_seed():
    a, b = np.zeros((5, 9), bool), np.zeros((5, 9), bool)
    a[:, :6] = b[:, 3:] = True
    seeds = {"a": np.zeros_like(a), "b": np.zeros_like(b)}
    seeds["a"][2, 0] = seeds["b"][2, 8] = True
    out, n = K.resolve_overlap({"a": a, "b": b}, seeds)
    assert n == 15 and not (out["a"] & out["b"]).any() and (out["a"] | out["b"]).all() and out["a"][2, 4] and not out["a"][2, 5]


def test_soil_plane():
    r = np.random.default_rng(0)
    xy = r.uniform(-200, 200, (4000, 2))
    z = 0.05 * xy[:, 0] + 0.02 * xy[:, 1] + 500 + r.normal(0, 1, 4000)
    z[:400] += r.uniform(30, 90, 400)
    plane, median, audit = G.fit_soil_plane(np.column_stack([xy, z]))
    assert audit["status"] == "accepted" and abs(plane[0] - 0.05) < 0.02 and abs(plane[1] - 0.02) < 0.02 and abs(plane[2] - 500) < 5
    assert median < 2 and audit["method"] == "iteratively_reweighted_least_squares"
    assert G.fit_soil_plane(np.zeros((10, 3)))[2] == {"status": "rejected", "reason": "insufficient_soil_points", "point_count": 10}
    steep = np.column_stack([xy, 0.8 * xy[:, 0] + 500])
    assert G.fit_soil_plane(steep)[2]["reason"] == "soil_plane_slope_exceeded"


def test_soil_plane_by_consensus():
    """Half of the points on a slope of their own: the level plane is found among the trials, and is theirs alone."""
    r = np.random.default_rng(3)
    xy = r.uniform(-200, 200, (3000, 2))
    z = np.where(np.arange(3000) < 1800, 600 + r.normal(0, 1, 3000), 700 + 1.5 * xy[:, 0] + r.uniform(0, 150, 3000))
    plane, median, audit = G.fit_soil_plane(np.column_stack([xy, z]))
    assert audit["method"] == "deterministic_ransac_refit" and abs(plane[2] - 600) < 3 and np.hypot(*plane[:2]) < 0.02 and median < 2
    assert audit["robust_spatial_quadrants"] == 4 and 0.4 < audit["robust_holdout_inlier_ratio"] < 0.8


CAMERA = (600.0, 600.0, 100.0, 100.0)


def test_heights_of_a_flat_scene():
    depth, mask = np.full((200, 200), 1000.0), square(200, 80, 120)
    depth[mask] = 900.0
    h = G.plant_height(depth, mask, CAMERA)
    assert abs(h["mean_canopy_height_mm"] - 100) < 0.5 and abs(h["canopy_height_p95_mm"] - 100) < 0.5 and h["geometry_qc_pass"] and h["missing_reason"] == ""
    assert abs(h["canopy_projected_area_mm2"] - 39 * 39 * 1.5 * 1.5) < 1e-6 and abs(h["visible_canopy_surface_area_mm2"] - 1600 * 1.5 * 1.5) < 1e-6
    assert h["native_depth_fraction"] == h["edge_depth_fraction"] == h["mesh_vertex_coverage_fraction"] == 1.0 and h["metric_authority"] == "native_d435_only"
    assert G.plant_height(np.zeros((200, 200)), mask, CAMERA)["missing_reason"] == "soil_plane_unavailable"
    steep = 1000 + 2.0 * np.indices((200, 200))[1].astype(float)
    assert G.plant_height(steep, mask, CAMERA)["missing_reason"] == "soil_plane_fit_failed"
    assert G.canopy_traits(np.full((200, 200), 5000.0), mask, CAMERA, np.array([0.0, 0.0, 1000.0]))["missing_reason"] == "l3_failed:no canopy triangles passed continuity/layer gates"
    assert G.canopy_traits(depth, np.zeros_like(mask), CAMERA, np.array([0.0, 0.0, 1000.0]))["missing_reason"] == "l3_failed:canopy_mask empty"


def slow_surface(depth, ok, camera, cfg):
    """Visible surface pixel by pixel, by the definition."""
    fx, fy, cx, cy = camera
    p, area, supported, capped, least = G.deproject(depth, *camera), 0.0, 0, 0, np.cos(np.deg2rad(cfg.most_tilt_degrees))
    for y, x in np.argwhere(ok):
        ys, xs = np.mgrid[max(0, y - cfg.normal_reach) : min(ok.shape[0], y + cfg.normal_reach + 1), max(0, x - cfg.normal_reach) : min(ok.shape[1], x + cfg.normal_reach + 1)]
        use = ok[ys, xs] & (abs(depth[ys, xs] - depth[y, x]) <= max(35.0, 0.03 * depth[y, x]))
        q, cosine = p[ys, xs][use], 1.0
        if len(q) >= cfg.normal_points:
            design, z = np.column_stack([q[:, :2] - np.median(q[:, :2], axis=0), np.ones(len(q))]), q[:, 2] - np.median(q[:, 2])
            fit = np.linalg.lstsq(design, z, rcond=None)[0]
            gap = z - design @ fit
            off = abs(gap - np.median(gap))
            inside = off <= max(2.5 * 1.4826 * np.median(off), 1.0)
            if inside.sum() >= cfg.normal_points:
                fit = np.linalg.lstsq(design[inside], z[inside], rcond=None)[0]
            cosine, supported = 1 / np.sqrt(1 + fit[0] ** 2 + fit[1] ** 2), supported + 1
            capped += cosine < least
        area += depth[y, x] ** 2 / (fx * fy) / max(cosine, least)
    return area, supported / ok.sum(), capped / max(supported, 1)


def test_visible_surface_matches_the_definition():
    r = np.random.default_rng(2)
    ys, xs = np.indices((26, 30))
    depth = 800 + 3.0 * xs + 0.5 * ys + r.normal(0, 2, ys.shape) + 120.0 * (xs > 17)
    depth[r.random(depth.shape) < 0.05] = 0.0
    mask = np.hypot(ys - 13, xs - 15) < 11
    cfg = G.CanopyConfig(normal_reach=4)
    got = G.visible_surface(depth, mask, (300.0, 310.0, 15.0, 13.0), cfg=cfg, block=37)
    want = slow_surface(depth, mask & (depth >= 250), (300.0, 310.0, 15.0, 13.0), cfg)
    np.testing.assert_allclose([got["visible_surface_area"], got["normal_support"], got["capped_fraction"]], want, rtol=1e-9)


def test_visible_surface_across_tiles_and_along_lines():
    r = np.random.default_rng(5)
    ys, xs = np.indices((60, 50))
    depth = 700 + 2.0 * xs - 1.0 * ys + r.normal(0, 1, ys.shape)
    mask = (r.random(depth.shape) < 0.7) & (ys > 5) & (ys < 50) & (xs > 3)
    mask[52, :] = True  # a line one pixel wide has no slope across
    cfg = G.CanopyConfig(normal_reach=7)
    got = G.visible_surface(depth, mask, (300.0, 310.0, 25.0, 30.0), cfg=cfg)
    np.testing.assert_allclose([got["visible_surface_area"], got["normal_support"], got["capped_fraction"]], slow_surface(depth, mask, (300.0, 310.0, 25.0, 30.0), cfg), rtol=1e-9)
    alone = np.zeros_like(mask)
    alone[52, 3:40] = True
    got = G.visible_surface(depth, alone, (300.0, 310.0, 25.0, 30.0), cfg=cfg)["visible_surface_area"]
    assert G.visible_surface(depth, np.zeros_like(mask), (300.0, 310.0, 25.0, 30.0))["normal_support"] == 0.0 and got > 0


def test_boxes_dilate_and_erode_by_the_definition():
    mask = np.random.default_rng(4).random((12, 9)) < 0.4
    padded = lambda fill: np.pad(mask, ((2, 2), (1, 1)), constant_values=fill)
    windows = lambda fill: np.lib.stride_tricks.sliding_window_view(padded(fill), (5, 3))
    element = np.ones((5, 3), dtype=bool)
    assert (K.dilate(mask, element) == windows(False).any(axis=(2, 3))).all() and (K.erode(mask, element) == windows(True).all(axis=(2, 3))).all()


def test_footprints_and_rotations():
    xs, ys, z = np.array([3.0, 9.0]), np.array([4.0, 1.0]), np.array([500.0, 800.0])
    np.testing.assert_allclose(G.footprint_areas(xs, ys, z, (600.0, 500.0, 5.0, 5.0)), z * z / 3e5)
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    np.testing.assert_allclose(G.footprint_areas(xs, ys, z, (600.0, 500.0, 5.0, 5.0), turn), z * z / 3e5)
    tilt = np.array([[1, 0, 0], [0, 0.6, -0.8], [0, 0.8, 0.6]])
    np.testing.assert_allclose(G.footprint_areas(xs, ys, z, (600.0, 500.0, 5.0, 5.0), tilt), 0.6 * z * z / 3e5)
    assert (G.checked_rotation(tilt.ravel()) == tilt).all()
    for bad in (np.eye(3) * 2, np.diag([1.0, 1.0, -1.0])):
        with pytest.raises(ValueError):
            G.checked_rotation(bad)


def test_geometry_checks_in_order():
    good = dict(zip(G.CANOPY_FIELDS, (1.0, 1.0, 1.0, 5.0, 5.0, 1.0, 1.0, 1.0, 1.0)))
    assert G.canopy_checks(good, 1.0, 0.0) == "" and G.canopy_checks(good, 1.0, 0.0, 4.0) == ""
    bad = dict.fromkeys(G.CANOPY_FIELDS, 0.0) | {"surface_to_projected_area_ratio": 5.0}
    assert G.canopy_checks(bad, 0.0, 1.0, 3.0) == (
        "low_native_depth_coverage;low_edge_depth_coverage;low_mesh_vertex_coverage;mean_height_not_above_minimum;p95_height_not_above_minimum;p95_height_not_above_soil_uncertainty;"
        "implausible_surface_to_projected_ratio;low_surface_normal_support;high_unresolved_surface_inclination"
    )
    assert G.canopy_checks(good, 0.79, 0.16, 5.0) == "p95_height_not_above_soil_uncertainty;low_surface_normal_support;high_unresolved_surface_inclination"


def test_feature_image_and_envelope():
    r = np.random.default_rng(0)
    f = K.feature_image(r.normal(25, 2, (40, 50)))
    assert f.shape == (40, 50, 3) and f.min() >= 0 and f.max() <= 1 and not K.feature_image(np.full((4, 4), np.nan)).any()
    image, n = r.random((33, 70)), 28
    weights = np.exp(-0.5 * (np.arange(-n, n + 1) / 7.0) ** 2)
    mirror = lambda i, size: min(i % (2 * size - 2), (2 * size - 2) - i % (2 * size - 2))
    slow = sum(wy * wx * image[mirror(9 + dy, 33), mirror(61 + dx, 70)] for dy, wy in zip(range(-n, n + 1), weights) for dx, wx in zip(range(-n, n + 1), weights)) / weights.sum() ** 2
    assert abs(K._smooth(image, 7.0)[9, 61] - slow) < 1e-12
    corners = np.array([[[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]], [[10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]])
    volume, mean = G.envelope(corners, np.full((2, 3), 5.0), 0.5)
    assert abs(volume - 500) < 1e-6 and abs(mean - 5) < 1e-6
    volume, _ = G.envelope(np.concatenate([corners, corners]), np.concatenate([np.full((2, 3), 5.0), np.full((2, 3), 7.0)]), 1.0)
    assert abs(volume - 700) < 1e-6, "the highest surface counts"
    with pytest.raises(ValueError):
        G.envelope(corners * 1e5, np.ones((2, 3)))


# --- traits ------------------------------------------------------------------------------


def test_registry():
    reg = traits.standard()
    assert [t.name for t in reg.available_for(["mask"])] == ["shape2d"]
    assert [t.name for t in reg.available_for(["mask", "temp", "ambient"])] == ["canopy_temperature", "shape2d", "canopy_delta_t", "layer_temperature"]
    with pytest.raises(ValueError):
        reg.register(reg.get("shape2d"))
    reg.clear()
    assert not reg.available_for(["mask"])


def test_compute_traits(spark):
    m = square(12, 2, 10)
    df = spark.createDataFrame([(1, flat(m), flat(np.full((12, 12), 28.0)), 25.0, 12), (2, flat(~m & m), flat(np.full((12, 12), 28.0)), None, 12)], "frame_id int, mask array<boolean>, temp array<double>, ambient double, width int")
    got = {r.frame_id: r for r in traits.compute_traits(df, 12, ["frame_id"]).collect()}
    assert got[1].delta_t_median == 3.0 and got[1].area_px == 64 and "layer_temperature" in got[1]._traits_run
    assert got[2].area_px == 0 and got[2].canopy_median is None and got[2].layer_error and got[2].canopy_delta_t_missing_reason == "ambient_temperature_missing"
    reg = traits.standard()
    assert traits.tier_counts(traits.compute_traits(df, 12, ["frame_id"]), reg).first().tier_1 == 2
    c = {r.frame_id: r for r in traits.contour_traits(df, ["frame_id"]).collect()}
    assert c[1].convex_hull_area_px == 49.0 and c[2].area_px == 0 and c[2].error is None


def test_kernel_errors_are_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "k int, v array<double>")

    def kernel(v):
        if v[0] == 0:
            raise ValueError("no")
        return {"x": float(sum(v))}

    got = {r.k: r for r in K.per_frame(df, ["k"], ["v"], kernel, "x double").collect()}
    assert got[1].x == 3.0 and got[1].error is None and got[2].x is None and got[2].error == "ValueError: no"
