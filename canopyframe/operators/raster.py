"""Raster operators: a frame is one row, its pixels are arrays in row order.

Everything here is a projection over the arrays of a frame, so it runs where
the frame is scanned and never shuffles pixels.  ``width`` and ``height`` may
be columns or numbers.  Masks are boolean arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import arrays as A
from ..functions.arrays import let
from ..functions.indices import MS_NAMES, RGB_NAMES, normalized, rgb_indices, spectral_indices
from .index_stats import index_statistics


def _c(x: Column | int | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# --- boxes and shapes ----------------------------------------------------------


def extent(mask: Column, width: Column | int) -> Column:
    """struct(x0, y0, x1, y1, area, cx, cy) of the true pixels, ends inclusive; null places and area 0 for none."""
    w = _c(width)

    def of_places(at: Column) -> Column:
        some = F.size(at) > 0
        xs, ys = F.transform(at, lambda i: i % w), F.transform(at, lambda i: F.floor(i / w).cast("int"))
        mean = lambda v: F.when(some, A.total(F.transform(v, lambda x: x.cast("double"))) / F.size(at))
        return F.struct(
            F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"),
            F.size(at).cast("long").alias("area"), mean(xs).alias("cx"), mean(ys).alias("cy"),
        )

    return let(A.indices(mask), of_places)


def shape_moments(mask: Column, width: Column | int) -> Column:
    """struct of area, bounding box, centroid and aspect of a mask; only the area is known for an empty one."""

    def of(e: Column) -> Column:
        bw, bh = e["x1"] - e["x0"] + 1, e["y1"] - e["y0"] + 1
        named = {
            "area_px": e["area"], "bbox_x": e["x0"], "bbox_y": e["y0"], "bbox_w": bw, "bbox_h": bh,
            "centroid_x": e["cx"], "centroid_y": e["cy"], "aspect_ratio": F.when(bh > 0, bw / bh),
        }
        return F.struct(*(c.alias(k) for k, c in named.items()))

    return let(extent(mask, width), of)


SHAPE = ("area_px", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "centroid_x", "centroid_y", "aspect_ratio")


def box_struct(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"))


def tight_bbox(mask: Column, width: Column | int) -> Column:
    """Bounding box with open right and bottom ends; null for an empty mask."""
    return let(extent(mask, width), lambda e: F.when(e["area"] > 0, box_struct(e["x0"], e["y0"], e["x1"] + 1, e["y1"] + 1)))


def closed_bbox(mask: Column, width: Column | int) -> Column:
    """Bounding box with inclusive ends; all zeros for an empty mask."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return let(extent(mask, width), lambda e: box_struct(zero(e["x0"]), zero(e["y0"]), zero(e["x1"]), zero(e["y1"])))


def expand_bbox(box: Column, pad: int, min_size: int, height: Column | int, width: Column | int) -> Column:
    """Pad, grow to a least side (the odd pixel goes right and down), clamp; a box without area becomes the frame; null stays null."""
    return let(box, lambda b: F.when(b.isNotNull(), _expanded(b, pad, min_size, height, width)))


def _expanded(box: Column, pad: int, min_size: int, height: Column | int, width: Column | int) -> Column:
    h, w = _c(height), _c(width)

    def grown(lo: Column, hi: Column) -> tuple[Column, Column]:
        lo, hi = lo - pad, hi + pad
        lack = F.greatest(F.lit(min_size) - (hi - lo), F.lit(0)) if min_size > 0 else F.lit(0)
        half = F.floor(lack / 2)
        return lo - half, hi + lack - half

    (ax, bx), (ay, by) = grown(box["x0"], box["x1"]), grown(box["y0"], box["y1"])
    x0, y0, x1, y1 = F.greatest(ax, F.lit(0)), F.greatest(ay, F.lit(0)), F.least(bx, w), F.least(by, h)
    grown_box = box_struct(x0, y0, x1, y1)
    return let(grown_box, lambda b: F.when((b["x1"] <= b["x0"]) | (b["y1"] <= b["y0"]), box_struct(F.lit(0), F.lit(0), w, h)).otherwise(b))


@dataclass(frozen=True)
class PropagationConfig:
    """Parameters of region, threshold ladder, rescue, annotation export, and which provider makes the logits."""

    roi_pad_ratio: float = 1.9
    roi_min_size: int = 384
    roi_max_size: int | None = None
    base_threshold: float = 0.0
    threshold_ladder: tuple[float, ...] = (-0.5, -1.0, -2.0, -4.0)
    min_valid_area: int = 1
    rescue_min_box: float = 8.0
    rescue_box_ratio: float = 0.65
    rescue_enabled: bool = True
    bidirectional: bool = True
    isat_category: str = "plant"
    isat_simplify_eps: float = 2.0
    isat_min_area: float = 10.0
    jpeg_quality: int = 95
    qa_grid_cols: int = 6
    qa_grid_tile: int = 200
    backend: str = "sam2"
    min_anchors: int = 2


def roi_of_extent(x0: Column, y0: Column, x1: Column, y1: Column, height: Column | int, width: Column | int, cfg: PropagationConfig) -> Column:
    """Square region around the union of the anchors, padded, held between sizes and moved inside; the frame if all are empty."""
    h, w = _c(height), _c(width)
    longest = F.greatest(x1 - x0 + 1, y1 - y0 + 1) * cfg.roi_pad_ratio
    cap = F.lit(float(cfg.roi_max_size)) if cfg.roi_max_size else F.least(h, w).cast("double")
    side = F.least(F.greatest(longest, F.lit(float(cfg.roi_min_size))), cap)
    size = F.rint(side).cast("int")

    def start(lo: Column, hi: Column, limit: Column) -> Column:
        at = F.rint((lo + hi) / 2.0 - side / 2.0).cast("int")
        return F.when(size <= limit, F.greatest(F.lit(0), F.least(at, limit - size))).otherwise(0)

    rx, ry = start(x0, x1, w), start(y0, y1, h)
    return F.when(x0.isNull(), box_struct(F.lit(0), F.lit(0), w, h)).otherwise(box_struct(rx, ry, F.least(w, rx + size), F.least(h, ry + size)))


def sequence_roi(anchors: DataFrame, keys: list[str], width: int, height: int, cfg: PropagationConfig) -> DataFrame:
    """One region per sequence from its anchors' masks: extents are reduced per anchor before they are grouped."""
    e = anchors.select(*keys, extent(F.col("mask"), width).alias("e"))
    union = e.groupBy(*keys).agg(F.min("e.x0").alias("x0"), F.min("e.y0").alias("y0"), F.max("e.x1").alias("x1"), F.max("e.y1").alias("y1"))
    return union.select(*keys, roi_of_extent(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), height, width, cfg).alias("roi"))


def in_box(i: Column, width: Column | int, box: Column) -> Column:
    x, y = i % _c(width), F.floor(i / _c(width))
    return (x >= box["x0"]) & (x < box["x1"]) & (y >= box["y0"]) & (y < box["y1"])


def crop_to_roi(values: Column, width: Column | int, box: Column) -> Column:
    """Pixels inside the region, in row order."""
    return F.filter(values, lambda v, i: in_box(i, width, box))


def paste_from_roi(sub: Column, sub_w: Column | int, sub_h: Column | int, box: Column, width: int, height: int) -> Column:
    """Full-frame mask from a region's mask; another size is resampled by nearest neighbour."""
    tw, th = box["x1"] - box["x0"], box["y1"] - box["y0"]

    def pixel(i: Column) -> Column:
        x, y = i % width - box["x0"], F.floor(i / width) - box["y0"]
        sx, sy = F.floor(x * _c(sub_w) / tw).cast("int"), F.floor(y * _c(sub_h) / th).cast("int")
        return F.when(in_box(i, width, box), F.coalesce(F.get(sub, (sy * _c(sub_w) + sx).cast("int")), F.lit(False))).otherwise(False)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), pixel)


def resize_nearest(values: Column, width: Column | int, height: Column | int, to_width: int, to_height: int) -> Column:
    """Nearest-neighbour resampling of a frame."""
    w, h = _c(width), _c(height)
    at = lambda i: F.floor(F.floor(i / to_width) * h / to_height) * w + F.floor((i % to_width) * w / to_width)
    return F.transform(F.sequence(F.lit(0), F.lit(to_width * to_height - 1)), lambda i: F.get(values, at(i).cast("int")))


def constrain_logits(logits: Column, width: int, height: int, box: Column, fill: float = -1e9) -> Column:
    """Logits outside a box (doubles, rounded half to even, clamped, at least one pixel) become ``fill``."""
    r = lambda c: F.rint(c).cast("int")
    x0 = F.greatest(F.lit(0), F.least(r(box["x0"]), F.lit(width - 1)))
    y0 = F.greatest(F.lit(0), F.least(r(box["y0"]), F.lit(height - 1)))
    x1 = F.greatest(x0 + 1, F.least(r(box["x1"]), F.lit(width)))
    y1 = F.greatest(y0 + 1, F.least(r(box["y1"]), F.lit(height)))
    return let(box_struct(x0, y0, x1, y1), lambda b: F.transform(logits, lambda v, i: F.when(in_box(i, width, b), v).otherwise(fill)))


# --- masks ---------------------------------------------------------------------


def _over(threshold: float):
    return lambda v: v > threshold


def threshold_ladder(logits: Column, cfg: PropagationConfig) -> Column:
    """struct(threshold, fallback, area): the first threshold that leaves enough pixels above it; else none."""
    rungs = (cfg.base_threshold, *cfg.threshold_ladder)
    above = [F.size(F.filter(logits, _over(t))).cast("long") for t in rungs]
    out = F.struct(F.lit(cfg.base_threshold).alias("threshold"), F.lit(True).alias("fallback"), F.lit(0).cast("long").alias("area"))
    for i in range(len(rungs) - 1, -1, -1):
        hit = F.struct(F.lit(rungs[i]).alias("threshold"), F.lit(i > 0).alias("fallback"), above[i].alias("area"))
        out = F.when(above[i] >= cfg.min_valid_area, hit).otherwise(out)
    return out


def ladder_mask(logits: Column, rung: Column) -> Column:
    return F.transform(logits, lambda v: (rung["area"] > 0) & (v > rung["threshold"]))


def prediction_source(is_anchor: Column, rung: Column) -> Column:
    return F.when(is_anchor, "manual").when(rung["area"] == 0, "empty").when(rung["fallback"], "propagated_lowthr").otherwise("propagated")


def mask_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two masks; two empty masks agree."""
    both = F.zip_with(a, b, lambda x, y: F.when(x & y, 2).when(x | y, 1).otherwise(0))
    inter, union = F.size(F.filter(both, lambda v: v == 2)), F.size(F.filter(both, lambda v: v > 0))
    return F.when(union == 0, 1.0).otherwise(inter / union)


def rescue_box(mask: Column, width: int, height: int, cfg: PropagationConfig) -> Column:
    """Centre and box around an anchor's centroid; null for an empty mask."""

    def of(e: Column) -> Column:
        half_w = cfg.rescue_box_ratio * F.greatest((e["x1"] - e["x0"]).cast("double"), F.lit(cfg.rescue_min_box))
        half_h = cfg.rescue_box_ratio * F.greatest((e["y1"] - e["y0"]).cast("double"), F.lit(cfg.rescue_min_box))
        return F.when(e["area"] > 0, F.struct(
            e["cx"].alias("cx"), e["cy"].alias("cy"),
            F.greatest(F.lit(0.0), e["cx"] - half_w).alias("x0"), F.greatest(F.lit(0.0), e["cy"] - half_h).alias("y0"),
            F.least(F.lit(width - 1.0), e["cx"] + half_w).alias("x1"), F.least(F.lit(height - 1.0), e["cy"] + half_h).alias("y1"),
        ))

    return let(extent(mask, width), of)


def edge(mask: Column, width: int, height: int) -> Column:
    """True pixels with a false pixel among their eight neighbours; outside the frame nothing is eroded."""

    def inner(i: Column) -> Column:
        out = F.lit(True)
        x, y = i % width, F.floor(i / width)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dx or dy:
                    inside = (x + dx >= 0) & (x + dx < width) & (y + dy >= 0) & (y + dy < height)
                    out = out & (~inside | F.coalesce(F.get(mask, (i + dy * width + dx).cast("int")), F.lit(True)))
        return out

    return F.transform(mask, lambda m, i: m & ~inner(i))


def boundary_f1(pred: Column, truth: Column, width: int, height: int, tolerance: int = 2) -> Column:
    """F1 of the two boundaries, matched within a Chebyshev tolerance; 1 if both are empty, 0 if one is."""

    def near(at: Column, others: Column) -> Column:
        return F.size(F.filter(at, lambda i: F.exists(others, lambda j: (F.abs(i % width - j % width) <= tolerance) & (F.abs(F.floor(i / width) - F.floor(j / width)) <= tolerance))))

    def score(e: Column) -> Column:
        p, t = e["p"], e["t"]
        np_, nt = F.size(p), F.size(t)
        precision, recall = near(p, t) / np_, near(t, p) / nt
        return F.when((np_ == 0) & (nt == 0), 1.0).when((np_ == 0) | (nt == 0), 0.0).when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)

    return let(F.struct(A.indices(edge(pred, width, height)).alias("p"), A.indices(edge(truth, width, height)).alias("t")), score)


def merge_logits(forward: Column, backward: Column) -> Column:
    """Mean where both directions have a frame, else the one that has."""
    return F.when(forward.isNotNull() & backward.isNotNull(), F.zip_with(forward, backward, lambda a, b: (a + b) / 2)).otherwise(F.coalesce(forward, backward))


def merge_bidirectional(forward: Column, backward: Column, size: int) -> Column:
    """The forward mask unless it is missing or empty, then the backward one, else all false."""
    some = lambda m: F.coalesce(F.exists(m, lambda x: x), F.lit(False))
    return F.when(some(forward), forward).otherwise(F.coalesce(backward, F.array_repeat(F.lit(False), size)))


# --- summaries -----------------------------------------------------------------


def canopy_temperature(temp: Column, mask: Column) -> Column:
    """Masked statistics of a temperature frame."""
    return A.summary(A.where_mask(temp, mask))


LAYERS = ("lower", "middle", "upper")


def layer_of(mask: Column, width: int) -> Column:
    """Layer number of each pixel by thirds of relative height (0 lower, 2 upper; rows count downward), null outside the mask."""

    def number(e: Column) -> Column:
        relative = lambda i: (F.floor(i / width) - e["y0"]) / (e["y1"] - e["y0"] + 1)
        return F.transform(mask, lambda m, i: F.when(m, F.when(relative(i) < 1 / 3, 2).when(relative(i) < 2 / 3, 1).otherwise(0)))

    return let(extent(mask, width), number)


def layer_temperatures(temp: Column, mask: Column, width: int) -> Column:
    """struct of statistics per layer, range and upper minus lower; null with an error if a layer is empty."""

    def per_layer(layers: Column) -> Column:
        of_layer = lambda k: A.where_mask(temp, F.transform(layers, lambda x: x.eqNullSafe(k)))
        found = F.transform(F.array(*map(F.lit, range(len(LAYERS)))), lambda k: A.summary(of_layer(k)))
        present = F.size(F.array_distinct(F.filter(layers, lambda x: x.isNotNull())))
        return let(found, lambda f: F.struct(*(f[k].alias(name) for k, name in enumerate(LAYERS)), (present == len(LAYERS)).alias("all")))

    def report(p: Column) -> Column:
        medians = [p[name]["median"] for name in LAYERS]
        known = {f"{name}_{stat}": p[name][stat] for name in LAYERS for stat in A.STATS}
        known |= {"layer_range": F.greatest(*medians) - F.least(*medians), "upper_minus_lower": medians[2] - medians[0]}
        return F.struct(*(F.when(p["all"], c).alias(k) for k, c in known.items()), F.when(~p["all"], "canopy layer is empty").alias("layer_error"))

    return let(let(layer_of(mask, width), per_layer), report)


LAYER_COLUMNS = (*(f"{name}_{stat}" for name in LAYERS for stat in A.STATS), "layer_range", "upper_minus_lower", "layer_error")


def _pixels(mask: Column, *channels: Column) -> Column:
    """Array of structs c0, c1 ... of the masked pixels."""
    zipped = F.arrays_zip(mask.alias("m"), *(c.alias(f"c{k}") for k, c in enumerate(channels)))
    return F.filter(zipped, lambda p: F.coalesce(p["m"], F.lit(False)))


def _index_summaries(df: DataFrame, found: Column, masked: str, names: Sequence[str]) -> DataFrame:
    column = "_indices"
    while column in df.columns:
        column = f"_{column}"
    return df.withColumn(column, found).select(*(F.col(f"`{c}`") for c in df.columns), F.col(column)["masked"].alias(masked), *(F.col(column)[k].alias(k) for k in names))


def rgb_summaries(df: DataFrame, r: str, g: str, b: str, mask: str) -> DataFrame:
    """The frames with a struct of statistics per colour index (16) over the mask, and ``rgb_masked``, the masked pixels."""
    found = index_statistics(F.col(mask), [F.col(c) for c in (r, g, b)], RGB_NAMES, lambda *c: rgb_indices(*normalized(*c)))
    return _index_summaries(df, found, "rgb_masked", RGB_NAMES)


def spectral_summaries(df: DataFrame, bands: Sequence[str], mask: str) -> DataFrame:
    """The frames with a struct of statistics per spectral index (12) over the mask, and ``ms_masked``."""
    return _index_summaries(df, index_statistics(F.col(mask), [F.col(c) for c in bands], MS_NAMES, spectral_indices), "ms_masked", MS_NAMES)


def valid_fraction(n: Column, masked: Column) -> Column:
    """Share of masked pixels with a finite value; null for an empty mask."""
    return F.when(masked > 0, n / masked)


def crop_report(temp: Column, mask: Column, width: int, height: int, pad: int = 0, min_size: int = 0) -> Column:
    """struct report of a plant crop: ok, reason, box, 1..99 % scale, statistics."""

    def of(ordered: Column) -> Column:
        ok = F.size(ordered) > 0
        box = expand_bbox(tight_bbox(mask, width), pad, min_size, height, width)
        return F.struct(
            ok.alias("ok"), F.when(~ok, "no_finite_temperature").alias("reason"), F.when(ok, box).alias("box"),
            A.quantile_of_sorted(ordered, 0.01).alias("vmin"), A.quantile_of_sorted(ordered, 0.99).alias("vmax"), A.summary(ordered).alias("stats"),
        )

    return let(F.sort_array(A.finite(A.where_mask(temp, mask))), of)


def layer_audit(layers: Column, mask: Column) -> dict[str, Column]:
    """Area per layer, overlaps (a pixel has one layer number, so none) and pixels that union and mask do not share."""
    area = lambda k: F.size(F.filter(layers, lambda x: x == k)).cast("long")
    differ = F.zip_with(layers, mask, lambda x, m: x.isNotNull() != m)
    return {**{f"{n}_area": area(k) for k, n in enumerate(LAYERS)}, "union_xor": F.size(F.filter(differ, lambda x: x)).cast("long")}


def qc_flag(hard_fail: Column, area: Column, most: int = 30_000, least: int = 200) -> Column:
    return F.when(hard_fail | (area > most) | (area < least), "FAIL").otherwise("OK")


# --- depth ---------------------------------------------------------------------


def cell_area(depth: Column, width: int, height: int, fx: float, fy: float, cx: float, cy: float, jump_abs: float = 35.0, jump_rel: float = 0.03) -> Column:
    """struct(projected_area, n_triangles) of the grid mesh.

    Each 2 by 2 cell of deprojected pixels gives one triangle of its three
    valid corners, or two along the shorter diagonal; corners whose depths
    differ by more than ``jump_abs`` and ``jump_rel`` of their median make none.
    """
    ok = lambda z: z.isNotNull() & ~F.isnan(z) & (z > 0)

    def corner(i: Column) -> Column:
        z = F.get(depth, i.cast("int"))
        return F.struct(((i % width - cx) * z / fx).alias("x"), ((F.floor(i / width) - cy) * z / fy).alias("y"), z.alias("z"))

    def triangle(q: Column) -> Column:
        a, b, c = q[0], q[1], q[2]
        flat = F.abs((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])) / 2
        depths = F.array_sort(F.transform(q, lambda p: p["z"]))
        level = let(depths, lambda z: z[2] - z[0] <= F.greatest(F.lit(jump_abs), jump_rel * z[1]))
        return let(flat, lambda f: F.when(F.forall(q, lambda p: ok(p["z"])) & level & (2 * f > 1e-8), f))

    # triangles by their corners' places: both of the shorter diagonal, or any of three
    chosen = lambda *t: F.array(*(F.array(*map(F.lit, k)) for k in t))
    main, other, three = chosen((0, 1, 3), (0, 3, 2)), chosen((0, 1, 2), (1, 3, 2)), chosen((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))

    def cell(i: Column) -> Column:
        corners = F.transform(F.array(F.lit(0), F.lit(1), F.lit(width), F.lit(width + 1)), lambda k: corner(i + k))

        def triangles(p: Column) -> Column:
            dist = lambda u, v: (p[u]["x"] - p[v]["x"]) ** 2 + (p[u]["y"] - p[v]["y"]) ** 2 + (p[u]["z"] - p[v]["z"]) ** 2
            wanted = F.when(F.forall(p, lambda q: ok(q["z"])), F.when(dist(0, 3) <= dist(1, 2), main).otherwise(other)).otherwise(three)
            return F.transform(wanted, lambda t: let(F.transform(t, lambda k: F.get(p, k)), triangle))

        return let(corners, triangles)

    cells = F.filter(F.sequence(F.lit(0), F.lit(width * (height - 1) - 2)), lambda i: i % width < width - 1)
    found = F.filter(F.flatten(F.transform(cells, cell)), lambda t: t.isNotNull())
    return let(found, lambda t: F.struct(A.total(t).alias("projected_area"), F.size(t).cast("long").alias("n_triangles")))


def plane_least_squares(points: DataFrame, keys: list[str]) -> DataFrame:
    """Plane Z = aX + bY + c per group by normal equations; null for a degenerate group."""
    s = points.groupBy(*keys).agg(
        *(F.sum(e).alias(n) for n, e in {
            "sxx": F.col("x") * F.col("x"), "sxy": F.col("x") * F.col("y"), "syy": F.col("y") * F.col("y"), "sx": F.col("x"), "sy": F.col("y"),
            "sxz": F.col("x") * F.col("z"), "syz": F.col("y") * F.col("z"), "sz": F.col("z"),
        }.items()), F.count("z").cast("double").alias("n"),
    )
    c = F.col
    det3 = lambda m: m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])
    base = [c("sxx"), c("sxy"), c("sx"), c("sxy"), c("syy"), c("sy"), c("sx"), c("sy"), c("n")]
    right = [c("sxz"), c("syz"), c("sz")]
    swap = lambda k: [right[i // 3] if i % 3 == k else base[i] for i in range(9)]
    det = det3(base)
    return s.select(*keys, *(F.when(F.abs(det) > 1e-9, det3(swap(k)) / det).alias(n) for k, n in enumerate("abc")), c("n").cast("long").alias("n"))
