"""Physics and geometry of single values, and parsing of names and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import fin, finite, quantile_of_sorted, let


def vpd_kpa(temp_c: Column, rh_pct: Column) -> Column:
    """Vapour pressure deficit (Tetens)."""
    return 0.6108 * F.exp(17.27 * temp_c / (temp_c + 237.3)) * (1 - rh_pct / 100)


def delta_t(canopy_c: Column, ambient_c: Column) -> Column:
    return F.when(fin(ambient_c).isNotNull(), canopy_c - ambient_c)


def robust_normalize(values: Column) -> Column:
    """Array clipped to its 1st..99th percentile and scaled to 0..1; all zeros without finite values."""

    def scale(s: Column) -> Column:
        p1, p99 = quantile_of_sorted(s, 0.01), quantile_of_sorted(s, 0.99)
        span = F.greatest(p99 - p1, F.lit(1e-9))
        return F.transform(values, lambda v: F.when(F.size(s) == 0, 0.0).otherwise(F.least(F.greatest((v - p1) / span, F.lit(0.0)), F.lit(1.0))))

    return let(F.sort_array(finite(values)), scale)


def gray_level(t: Column, vmin: float, vmax: float) -> Column:
    """Fixed-scale 0..255 level, rounded half to even."""
    share = F.least(F.greatest((t - vmin) / max(vmax - vmin, 1e-9), F.lit(0.0)), F.lit(1.0))
    return F.rint(share * 255).cast("int")


def deproject(u: Column, v: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> tuple[Column, Column, Column]:
    return (u - cx) * z / fx, (v - cy) * z / fy, z


def height_over_plane(x: Column, y: Column, z: Column, a: Column, b: Column, c: Column) -> Column:
    """Height of a point above the plane Z = aX + bY + c, not below it."""
    return F.greatest((a * x + b * y + c - z) / F.sqrt(a * a + b * b + 1), F.lit(0.0))


def shoelace(xs: Column, ys: Column) -> Column:
    """Area of a polygon from the arrays of its vertices."""
    n = F.size(xs)
    turn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + xs[i] * ys[(i + 1) % n] - ys[i] * xs[(i + 1) % n])
    return F.when(n >= 3, F.abs(turn) / 2).otherwise(0.0)


def is_rotation(r: list[Column]) -> Column:
    """Nine entries, row by row, form a right-handed orthonormal matrix (within 1e-6)."""
    dot = lambda i, j: sum((r[3 * i + k] * r[3 * j + k] for k in range(3)), F.lit(0.0))
    unit = [F.abs(dot(i, j) - (1.0 if i == j else 0.0)) <= 1e-6 for i in range(3) for j in range(i, 3)]
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    out = F.abs(det - 1.0) <= 1e-6
    for u in unit:
        out = out & u
    return out


#: A camera that looks straight down.
LEVEL = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)


def footprint_area(depth: Column, fx: Column | float, fy: Column | float, rotation: tuple[float, ...] = LEVEL) -> Column:
    """Ground area of a pixel at a depth: its corners share the depth, so a rotation scales the area by the determinant of its ground part."""
    r = rotation
    return F.abs(F.lit(r[0] * r[4] - r[1] * r[3])) * depth * depth / (fx * fy)


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter))


def solidity(area: Column, hull_area: Column) -> Column:
    return F.when(hull_area > 0, area / hull_area)


def aspect(width: Column, height: Column) -> Column:
    return F.when(height > 0, width / height)


# --- names and times -----------------------------------------------------------


def stem_time(stem: Column, zone: str) -> Column:
    """Instant of a stem ``YYYYMMDD_HHMMSS_mmm...`` in a local zone."""
    local = F.regexp_extract(stem, r"^(\d{8}_\d{6}_\d{3})", 1)
    return F.when(local != "", F.to_utc_timestamp(F.to_timestamp(local, "yyyyMMdd_HHmmss_SSS"), zone))


def path_stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(normalize_path(path), "/"), -1), r"\.[^.]*$", "")


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def plant_number(text: Column) -> Column:
    """Integer of a plant number written like ``3`` or ``3.0``."""
    return F.try_to_number(F.trim(text), F.lit("999999999.999")).cast("int")


def plant_key(number: Column) -> Column:
    return F.format_string("plant_%02d", number)


TRUE_WORDS = ("1", "true", "t", "yes", "y")


def is_true_word(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*TRUE_WORDS), F.lit(False))


def plain_segment_id(segment: Column) -> Column:
    """Segment id without its debug mark."""
    return F.replace(segment, F.lit("_dbg"), F.lit(""))


#: Names of colour maps that a rendering may ask for (fixed values).
COLORMAPS = (
    "autumn", "bone", "jet", "winter", "rainbow", "ocean", "summer", "spring", "cool", "hsv", "pink", "hot",
    "parula", "magma", "inferno", "plasma", "viridis", "cividis", "twilight", "turbo", "deepgreen",
)


def colormap_known(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin(*COLORMAPS), F.lit(False))
