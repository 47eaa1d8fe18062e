"""Canopy geometry from a depth frame: soil plane, mesh, visible surface, envelope and checks (numpy, one frame per row).

Lengths are millimetres.  A camera is (fx, fy, cx, cy), a plane (a, b, c) of
Z = aX + bY + c.  Everything is computed for all pixels, triangles or candidate
planes at once, in blocks of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from .kernels import box, dilate, erode

Camera = tuple[float, float, float, float]
LEVEL = np.eye(3)


@dataclass(frozen=True)
class CanopyConfig:
    """Ranges and limits of the geometry (fixed values)."""

    depth_min: float = 250.0
    depth_max: float = 2500.0
    jump_abs: float = 35.0
    jump_rel: float = 0.03
    cell: float = 1.0
    most_cells: int = 5_000_000
    least_native: float = 0.75
    least_edge: float = 0.65
    least_vertex: float = 0.80
    least_mean_height: float = 1.0
    least_p95_height: float = 2.0
    least_height_to_uncertainty: float = 1.0
    most_surface_ratio: float = 4.0
    normal_reach: int = 9
    normal_points: int = 12
    most_tilt_degrees: float = 75.0
    least_normal_support: float = 0.80
    most_capped: float = 0.15


def deproject(depth: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> np.ndarray:
    ys, xs = np.indices(depth.shape)
    return np.stack([(xs - cx) * depth / fx, (ys - cy) * depth / fy, depth], axis=2)


def checked_rotation(values=LEVEL) -> np.ndarray:
    """A camera-to-ground rotation; ValueError unless it is orthogonal and right-handed."""
    r = np.asarray(values, dtype=float).reshape(3, 3)
    if not np.allclose(r.T @ r, np.eye(3), atol=1e-6):
        raise ValueError("camera_to_ground rotation is not orthogonal")
    if not np.isclose(np.linalg.det(r), 1.0, atol=1e-6):
        raise ValueError("camera_to_ground rotation has wrong handedness")
    return r


def footprint_areas(xs: np.ndarray, ys: np.ndarray, depth: np.ndarray, camera: Camera, rotation: np.ndarray = LEVEL) -> np.ndarray:
    """Ground area of each pixel's four corners, deprojected at its depth and rotated."""
    fx, fy, cx, cy = camera
    u = (xs[:, None] + np.array([-0.5, 0.5, 0.5, -0.5]) - cx) * depth[:, None] / fx
    v = (ys[:, None] + np.array([-0.5, -0.5, 0.5, 0.5]) - cy) * depth[:, None] / fy
    ground = np.stack([u, v, np.broadcast_to(depth[:, None], u.shape)], axis=2) @ rotation.T
    x, y = ground[..., 0], ground[..., 1]
    return np.abs((x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1)) / 2


def heights_over(points: np.ndarray, plane: np.ndarray) -> np.ndarray:
    """Distance above a plane along its normal, none below it."""
    a, b, c = plane
    return np.maximum((points[..., 0] * a + points[..., 1] * b + c - points[..., 2]) / math.sqrt(a * a + b * b + 1), 0.0)


# --- soil ---------------------------------------------------------------------------------

#: Limits of the soil fit (fixed values).
LEAST_POINTS, HELD_OUT, SEED, TRIALS = 100, 0.25, 17, 128
POOR_MEDIAN, INLIER, STEEPEST, MARGINAL_SLOPE = 8.0, 6.0, 0.15, 0.22
LEAST_RATIO, LEAST_HELD, LEAST_QUADRANTS = 0.18, 100, 3


def soil_points(depth: np.ndarray, mask: np.ndarray, camera: Camera) -> np.ndarray | None:
    """Points of a ring around the canopy, at a distance from it; the whole disc if the ring is thin, none below 50."""
    if not mask.any():
        return None
    ys, xs = np.nonzero(mask)
    reach = 0.75 * max(np.ptp(xs), np.ptp(ys), 40.0)
    gy, gx = np.indices(mask.shape)
    far = np.hypot(gx - np.median(xs), gy - np.median(ys))
    free = ~dilate(mask, box(9)) & (depth > 0) & (far <= 1.2 * reach)
    ring = free & (far >= 0.78 * reach)
    chosen = ring if ring.sum() >= 200 else free
    if chosen.sum() < 50:
        return None
    points = deproject(depth, *camera)[chosen]
    return points[np.isfinite(points).all(axis=1)]


def least_squares_plane(points: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(np.c_[points[:, :2], np.ones(len(points))], points[:, 2], rcond=None)[0]


def _gaps(points: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Signed depth differences, planes by points (or points alone for one plane)."""
    planes = np.asarray(planes)
    return points[:, 2] - (planes[..., :2] @ points[:, :2].T + planes[..., 2:])


def _median_within(gaps: np.ndarray) -> np.ndarray:
    """Median size of the gaps that are inliers, per row; infinite where there is none."""
    size = np.where(np.abs(gaps) <= INLIER, np.abs(gaps), np.inf)
    ordered, n = np.sort(size, axis=-1), np.isfinite(size).sum(axis=-1)
    at = lambda k: np.take_along_axis(ordered, np.maximum(k, 0)[..., None], axis=-1)[..., 0]
    return np.where(n > 0, (at((n - 1) // 2) + at(n // 2)) / 2, np.inf)


def _consensus(train: np.ndarray, hold: np.ndarray, draw: np.random.Generator) -> np.ndarray | None:
    """The plane of the trial with the most inliers in training (then the least median gap held out), fitted to them."""
    triples = np.stack([draw.choice(len(train), size=3, replace=False) for _ in range(TRIALS)])
    design = np.concatenate([train[triples][..., :2], np.ones((TRIALS, 3, 1))], axis=2)
    use = np.abs(np.linalg.det(design)) >= 1e-8
    if not use.any():
        return None
    planes = np.linalg.solve(design[use], train[triples[use]][..., 2:])[..., 0]
    planes = planes[np.hypot(planes[:, 0], planes[:, 1]) <= STEEPEST]
    counts, middles = np.zeros(len(planes), dtype=int), np.full(len(planes), np.inf)
    step = max(1, 4_000_000 // len(train))
    for at in range(0, len(planes), step):
        counts[at : at + step] = (np.abs(_gaps(train, planes[at : at + step])) <= INLIER).sum(axis=1)
        middles[at : at + step] = _median_within(_gaps(hold, planes[at : at + step]))
    order = np.lexsort((np.arange(len(planes)), middles, -counts))
    if not len(order) or counts[order[0]] < LEAST_POINTS:
        return None
    return least_squares_plane(train[np.abs(_gaps(train, planes[order[0]])) <= INLIER])


def fit_soil_plane(points: np.ndarray, seed: int = SEED) -> tuple[np.ndarray | None, float | None, dict]:
    """(plane or None, median gap held out, audit).

    A quarter of the points is held out.  A trimmed least-squares plane is kept
    unless its median gap there is poor or it is steep; then a plane found by
    consensus may take its place, in one of three classes of confidence.
    """
    audit: dict = {"point_count": len(points)}
    if len(points) < LEAST_POINTS:
        return None, None, {"status": "rejected", "reason": "insufficient_soil_points", **audit}
    draw = np.random.default_rng(seed)
    shuffled = points[draw.permutation(len(points))]
    cut = max(int(len(points) * (1.0 - HELD_OUT)), 3)
    train, hold = shuffled[:cut], shuffled[cut:]
    near, plane = np.ones(cut, dtype=bool), None
    for _ in range(4):  # the first fit takes all, three more what is near the last
        if near.sum() < LEAST_POINTS and plane is not None:
            break
        plane = least_squares_plane(train[near])
        gap = _gaps(train, plane)
        near = np.abs(gap) <= max(3.0, 3.0 * 1.4826 * np.median(np.abs(gap - np.median(gap))))
    median, slope = float(np.median(np.abs(_gaps(hold, plane)))), math.hypot(*plane[:2])
    audit |= {"method": "iteratively_reweighted_least_squares", "initial_slope_norm": slope}
    allowed = STEEPEST
    robust = _consensus(train, hold, draw) if median > POOR_MEDIAN or slope > STEEPEST else None
    if robust is not None:
        gap = _gaps(hold, robust)
        inside = np.abs(gap) <= INLIER
        n, ratio, middle, steep = int(inside.sum()), float(inside.mean()), float(_median_within(gap)), math.hypot(*robust[:2])
        quadrants = len(np.unique((hold[inside, :2] > np.median(hold[:, :2], axis=0)) @ [2, 1]))
        audit |= {"robust_holdout_inlier_ratio": ratio, "robust_holdout_inlier_median_mm": middle, "robust_spatial_quadrants": quadrants, "robust_slope_norm": steep}
        classes = (  # method, slope allowed, points held out, their share, quadrants, median gap
            ("deterministic_ransac_refit", STEEPEST, LEAST_HELD, LEAST_RATIO, LEAST_QUADRANTS, math.inf),
            ("deterministic_ransac_marginal_slope", MARGINAL_SLOPE, 2 * LEAST_HELD, 2 * LEAST_RATIO, 4, 4.0),
            ("deterministic_ransac_highconf_inlier", STEEPEST, 4 * LEAST_HELD, 0.0, 3, 3.0),
        )
        held = next((c for c in classes if steep <= c[1] and n >= c[2] and ratio >= c[3] and quadrants >= c[4] and middle <= c[5]), None)
        if held and middle < median:
            plane, median, allowed = robust, middle, held[1]
            audit["method"] = held[0]
    final = math.hypot(*plane[:2])
    audit |= {"holdout_median_mm": median, "final_slope_norm": final}
    if final > allowed:
        return None, median, {"status": "rejected", "reason": "soil_plane_slope_exceeded", **audit}
    return plane, median, {"status": "accepted", **audit}


# --- mesh ----------------------------------------------------------------------------------


def mesh_triangles(valid: np.ndarray, points: np.ndarray, depth: np.ndarray, jump_abs: float = 35.0, jump_rel: float = 0.03) -> np.ndarray:
    """Flat pixel indices of the triangles of 2 by 2 cells (shorter diagonal), without depth jumps."""
    h, w = valid.shape
    i = np.arange(h * w).reshape(h, w)
    a, b, c, d = (x.ravel() for x in (i[:-1, :-1], i[:-1, 1:], i[1:, :-1], i[1:, 1:]))
    ok, p, z = valid.ravel(), points.reshape(-1, 3), depth.ravel()
    four = ok[a] & ok[b] & ok[c] & ok[d]
    main = np.zeros(len(a), dtype=bool)
    main[four] = ((p[a[four]] - p[d[four]]) ** 2).sum(axis=1) <= ((p[b[four]] - p[c[four]]) ** 2).sum(axis=1)
    sets = [(four & main, (a, b, d)), (four & main, (a, d, c)), (four & ~main, (a, b, c)), (four & ~main, (b, d, c))]
    for three in ((a, b, c), (a, b, d), (a, c, d), (b, c, d)):
        sets.append((~four & ok[three[0]] & ok[three[1]] & ok[three[2]], three))
    t = np.concatenate([np.column_stack(tri)[use] for use, tri in sets])
    corner = z[t]
    return t[np.ptp(corner, axis=1) <= np.maximum(jump_abs, jump_rel * np.median(corner, axis=1))]


def _row_medians(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the n (1 at least) lowest values of each row."""
    ordered, rows = np.sort(values, axis=1), np.arange(len(values))
    return (ordered[rows, (n - 1) // 2] + ordered[rows, n // 2]) / 2


#: Side of the tiles whose pixels share their candidates, and spread of places across over along a line below which they count as a line.
TILE, LINE = 13, 1e-4


def _counts(use: np.ndarray) -> np.ndarray:
    return use.view(np.uint8).sum(axis=1, dtype=np.int32)


def _row_slopes(points: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Least-squares slopes (a, b) per row over the points in use (of least size where several fit)."""
    x, y, z = points.T
    n, sx, sy, sz, xx, xy, yy, xz, yz = (use.astype(float) @ np.column_stack([np.ones_like(x), x, y, z, x * x, x * y, y * y, x * z, y * z])).T
    xx, xy, yy, xz, yz = xx - sx * sx / n, xy - sx * sy / n, yy - sy * sy / n, xz - sx * sz / n, yz - sy * sz / n
    det = xx * yy - xy * xy
    line = ~(det > LINE * (xx + yy) ** 2)
    det = np.where(line, 1.0, det)
    out = np.column_stack([(xz * yy - yz * xy) / det, (yz * xx - xz * xy) / det])
    for row in np.flatnonzero(line):
        near = points[use[row]]
        near = near - near[len(near) // 2]
        design = np.column_stack([near[:, :2], np.ones(len(near))])
        out[row] = (np.linalg.pinv(design.T @ design, rcond=1e-13, hermitian=True) @ (design.T @ near[:, 2]))[:2]
    return out


def visible_surface(
    depth: np.ndarray, mask: np.ndarray, camera: Camera, rotation: np.ndarray = LEVEL, cfg: CanopyConfig = CanopyConfig(), layers: np.ndarray | None = None, block: int = 256
) -> dict:
    """Visible surface area: each pixel's footprint over the cosine of its local plane's tilt, held at a cap.

    A pixel's plane is fitted to the pixels around it of its layer and without
    a depth jump, then again to those within 2.5 deviations (1 mm at least).
    ``normal_support`` is the share of pixels that have a plane,
    ``capped_fraction`` the share of these that are too steep.  Pixels of a tile
    share their candidates, so that moments and gaps are matrix products.
    """
    ok = mask & np.isfinite(depth) & (depth >= cfg.depth_min) & (depth <= cfg.depth_max)
    reach, least = max(cfg.normal_reach, 1), math.cos(math.radians(cfg.most_tilt_degrees))
    ys, xs = np.nonzero(ok)
    tiles = np.column_stack([(c - (c.min() if len(c) else 0)) // TILE for c in (ys, xs)])
    order = np.lexsort(tiles.T[::-1])
    ys, xs, tiles = ys[order].astype(np.int32), xs[order].astype(np.int32), tiles[order]
    z = depth[ys, xs].astype(float)
    ground = deproject(np.where(ok, depth, 0.0), *camera)[ys, xs] @ rotation.T
    level = layers[ys, xs] if layers is not None else None
    area, cosine, supported = footprint_areas(xs, ys, z, camera, rotation), np.ones(len(ys)), np.zeros(len(ys), dtype=bool)
    beyond = -(-reach // TILE)
    starts = np.flatnonzero((np.diff(tiles, axis=0, prepend=-1) != 0).any(axis=1)).tolist()
    for first, last in zip(starts, [*starts[1:], len(ys)]):
        (y0, y1), (x0, x1) = ((c[first:last].min() - reach, c[first:last].max() + reach) for c in (ys, xs))
        band = slice(*np.searchsorted(tiles[:, 0], [tiles[first, 0] - beyond, tiles[first, 0] + beyond + 1]))
        near = band.start + np.flatnonzero((ys[band] >= y0) & (ys[band] <= y1) & (xs[band] >= x0) & (xs[band] <= x1))
        here = ground[near] - ground[first]  # slopes do not depend on the origin
        for at in range(first, last, block):
            own = slice(at, min(at + block, last))
            depths = z[own, None]
            use = (np.abs(z[near] - depths) <= np.maximum(cfg.jump_abs, cfg.jump_rel * depths)) & (np.abs(ys[near] - ys[own, None]) <= reach) & (np.abs(xs[near] - xs[own, None]) <= reach)
            if level is not None:
                use &= level[near] == level[own, None]
            n = _counts(use)
            enough = supported[own] = n >= max(cfg.normal_points, 1)
            if not enough.any():
                continue
            if not enough.all():
                use, n = use[enough], n[enough]
            slope = _row_slopes(here, use)
            gap = np.where(use, here[:, 2] - slope @ here[:, :2].T, np.inf)
            gap -= _row_medians(gap, n)[:, None]
            np.abs(gap, out=gap)
            inside = gap <= np.maximum(2.5 * 1.4826 * _row_medians(gap, n), 1.0)[:, None]
            left = _counts(inside)
            again = (left >= cfg.normal_points) & (left < n)
            if again.any():
                slope[again] = _row_slopes(here, inside[again])
            cosine[own][enough] = 1 / np.sqrt(1 + (slope**2).sum(axis=1))
    cosine = np.where(supported, cosine, 1.0)
    n, k = len(ys), int(supported.sum())
    return {
        "visible_surface_area": float((area / np.maximum(cosine, least)).sum()), "normal_support": k / max(n, 1),
        "capped_fraction": float((cosine < least).sum()) / max(k, 1),
    }


#: Cells of triangles' boxes that are looked at together.
BOX_CELLS = 200_000


def envelope(corners: np.ndarray, heights: np.ndarray, cell: float = 1.0, most_cells: int = 5_000_000) -> tuple[float, float]:
    """(volume, mean height) under the highest surface over a ground grid.

    ``corners`` (triangles by 3 by 2) are ground places, ``heights`` (triangles
    by 3) theirs; a cell takes the largest interpolated height at its centre,
    and cells that no triangle covers have none.
    """
    if not len(corners):
        return 0.0, 0.0
    lo = np.floor(corners.min(axis=(0, 1)) / cell) * cell
    hi = np.ceil(corners.max(axis=(0, 1)) / cell) * cell
    width, height = (np.ceil((hi - lo) / cell).astype(int) + 1).tolist()
    if width * height > most_cells:
        raise ValueError("envelope integration grid exceeds safety ceiling")
    grid = (corners - lo) / cell
    first = np.maximum(np.floor(grid.min(axis=1)).astype(int), 0)
    last = np.minimum(np.ceil(grid.max(axis=1)).astype(int), [width - 1, height - 1])
    (ax, ay), (bx, by), (cx, cy) = (corners[:, k].T for k in range(3))
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    top = np.full(width * height, -np.inf, dtype=np.float32)
    use = np.flatnonzero((np.abs(det) >= 1e-12) & (last >= first).all(axis=1))
    cells = (last[use] - first[use] + 1).prod(axis=1)
    ends = np.cumsum(cells)
    at = 0
    while at < len(use):  # the cells of many triangles' boxes go together, about BOX_CELLS of them
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BOX_CELLS, side="right")))
        t = np.repeat(use[at:upto], cells[at:upto])
        place = np.arange(len(t)) - np.repeat(ends[at:upto] - cells[at:upto] - (ends[at - 1] if at else 0), cells[at:upto])
        wide = (last[t, 0] - first[t, 0]) + 1
        gx, gy = first[t, 0] + place % wide, first[t, 1] + place // wide
        px, py = lo[0] + (gx + 0.5) * cell, lo[1] + (gy + 0.5) * cell
        u = ((by[t] - cy[t]) * (px - cx[t]) + (cx[t] - bx[t]) * (py - cy[t])) / det[t]
        v = ((cy[t] - ay[t]) * (px - cx[t]) + (ax[t] - cx[t]) * (py - cy[t])) / det[t]
        inside = (u >= -1e-7) & (v >= -1e-7) & (1 - u - v >= -1e-7)
        value = u * heights[t, 0] + v * heights[t, 1] + (1 - u - v) * heights[t, 2]
        np.maximum.at(top, (gy * width + gx)[inside], value[inside].astype(np.float32))
        at = upto
    filled = top[np.isfinite(top)]
    return float(filled.sum(dtype=np.float64) * cell * cell), float(filled.mean(dtype=np.float64)) if len(filled) else 0.0


# --- canopy ----------------------------------------------------------------------------------

#: What a canopy is measured by, in report order.
CANOPY_FIELDS = (
    "canopy_projected_area_mm2", "visible_canopy_surface_area_mm2", "canopy_envelope_volume_mm3", "mean_canopy_height_mm", "canopy_height_p95_mm",
    "surface_to_projected_area_ratio", "native_depth_fraction", "edge_depth_fraction", "mesh_vertex_coverage_fraction",
)
AUTHORITY = "native_d435_only"
CANOPY_SCHEMA = ", ".join(f"{f} double" for f in CANOPY_FIELDS) + ", metric_authority string, geometry_qc_pass boolean, missing_reason string"
#: Nothing is known of a canopy, for a reason.
unknown_canopy = lambda reason: {**dict.fromkeys(CANOPY_FIELDS), "metric_authority": "", "geometry_qc_pass": False, "missing_reason": reason}


def canopy_checks(m: dict, support: float, capped: float, uncertainty: float | None = None, cfg: CanopyConfig = CanopyConfig()) -> str:
    """Reasons of failed checks, joined by semicolons: coverage, then height, then surface (fixed order)."""
    failed = (
        (m["native_depth_fraction"] < cfg.least_native, "low_native_depth_coverage"),
        (m["edge_depth_fraction"] < cfg.least_edge, "low_edge_depth_coverage"),
        (m["mesh_vertex_coverage_fraction"] < cfg.least_vertex, "low_mesh_vertex_coverage"),
        (m["mean_canopy_height_mm"] < cfg.least_mean_height, "mean_height_not_above_minimum"),
        (m["canopy_height_p95_mm"] < cfg.least_p95_height, "p95_height_not_above_minimum"),
        (uncertainty is not None and m["canopy_height_p95_mm"] <= cfg.least_height_to_uncertainty * (uncertainty or 0.0), "p95_height_not_above_soil_uncertainty"),
        (m["surface_to_projected_area_ratio"] > cfg.most_surface_ratio, "implausible_surface_to_projected_ratio"),
        (support < cfg.least_normal_support, "low_surface_normal_support"),
        (capped > cfg.most_capped, "high_unresolved_surface_inclination"),
    )
    return ";".join(reason for bad, reason in failed if bad)


class NoSurface(ValueError):
    """A canopy has no mesh; ``known`` is what needs none: height, native and edge fractions."""

    def __init__(self, reason: str, known: dict):
        super().__init__(reason)
        self.known = known


def _quantile(values: np.ndarray, q: float) -> float:
    """Linear interpolation upwards from the lower value, as in SQL: other forms differ in the last bit."""
    ordered, at = np.sort(values), (len(values) - 1) * q
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    return float(low + (high - low) * (at - math.floor(at)))


def canopy_geometry(
    depth: np.ndarray, mask: np.ndarray, camera: Camera, plane: np.ndarray, rotation: np.ndarray = LEVEL, cfg: CanopyConfig = CanopyConfig(), uncertainty: float | None = None
) -> dict:
    """Area, surface, volume, heights and coverages of a canopy over a ground plane, and its failed checks.

    ValueError for input of no canopy, its kind NoSurface where only the mesh is degenerate.
    """
    if depth.shape != mask.shape:
        raise ValueError("depth/mask/intrinsics size mismatch")
    if not mask.any():
        raise ValueError("canopy_mask empty")
    rotation = checked_rotation(rotation)
    valid = mask & np.isfinite(depth) & (depth >= cfg.depth_min) & (depth <= cfg.depth_max)
    edge = mask & ~erode(mask, box(5))
    points = deproject(np.where(valid, depth, 0.0), *camera)
    heights, native = heights_over(points[valid], np.asarray(plane, dtype=float)), float(valid.sum() / mask.sum())
    known = {
        "canopy_height_p95_mm": _quantile(heights, 0.95) if len(heights) else math.nan, "native_depth_fraction": native,
        "edge_depth_fraction": float(valid[edge].mean()) if edge.any() else native,
    }
    tri = mesh_triangles(valid, points, np.where(valid, depth, 0.0), cfg.jump_abs, cfg.jump_rel)
    if not len(tri):
        raise NoSurface("no canopy triangles passed continuity/layer gates", known)
    own = points.reshape(-1, 3)
    ground = (own @ rotation.T)[tri][..., :2]
    side, other = ground[:, 1] - ground[:, 0], ground[:, 2] - ground[:, 0]
    twice = np.abs(side[:, 0] * other[:, 1] - other[:, 0] * side[:, 1])
    if not (twice > 1e-8).any():
        raise NoSurface("all ground-projected triangles degenerate", known)
    tri, ground, twice = tri[twice > 1e-8], ground[twice > 1e-8], twice[twice > 1e-8]
    surface = visible_surface(depth, mask, camera, rotation, cfg)
    volume, mean = envelope(ground, heights_over(own[tri], np.asarray(plane, dtype=float)), cfg.cell, cfg.most_cells)
    area = float(twice.sum() / 2)
    out = dict(zip(CANOPY_FIELDS, (
        area, surface["visible_surface_area"], volume, mean, known["canopy_height_p95_mm"],
        surface["visible_surface_area"] / max(area, 1e-12), native, known["edge_depth_fraction"], float(len(np.unique(tri)) / valid.sum()),
    )))
    reasons = canopy_checks(out, surface["normal_support"], surface["capped_fraction"], uncertainty, cfg)
    return out | {"metric_authority": AUTHORITY, "geometry_qc_pass": not reasons, "missing_reason": reasons}


def plant_height(depth: np.ndarray, mask: np.ndarray, camera: Camera, plane: np.ndarray | None = None, rotation: np.ndarray = LEVEL, cfg: CanopyConfig = CanopyConfig()) -> dict:
    """Canopy geometry over a given plane, or over the soil fitted around the canopy; unknown, with a reason, where there is none."""
    if plane is None:
        points = soil_points(depth, mask, camera)
        if points is None or len(points) < LEAST_POINTS:
            return unknown_canopy("soil_plane_unavailable")
        plane = fit_soil_plane(points)[0]
        if plane is None:
            return unknown_canopy("soil_plane_fit_failed")
    return canopy_geometry(depth, mask, camera, plane, rotation, cfg)


def canopy_traits(depth: np.ndarray, mask: np.ndarray, camera: Camera, plane: np.ndarray | None = None) -> dict:
    """The geometry as a trait: degenerate input is a reason, not an error."""
    try:
        return plant_height(depth, mask, camera, plane)
    except ValueError as e:
        return unknown_canopy(f"l3_failed:{e}")
