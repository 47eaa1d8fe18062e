"""Vegetation indices of channels and bands: formulas of Columns, or of numpy arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import safe_div as sd


def normalized(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Channel shares; null for a black pixel."""
    s = r + g + b
    return sd(r, s), sd(g, s), sd(b, s)


def rgb_indices(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """The 16 colour indices of normalized channels."""
    return {
        "NDI": (r - g) / (r + g + 0.01),
        "CIVE": 0.441 * r - 0.811 * g + 0.3856 * b + 18.78745,
        "MNDVI": sd(r - g - b, r + g),
        "GRVI": sd(g - r, g + r),
        "IKAW": sd(r - b, r + b),
        "ExG": 2 * g - r - b,
        "ExR": 1.4 * r - g,
        "ExGR": 3 * g - 2.4 * r - b,
        "VARI": sd(g - r, g + r - b),
        "GLA": sd(2 * g - r + b, 2 * g + r + b),
        "GLI": sd(2 * g - r - b, 2 * g + r + b),
        "RGBVI": sd(g * g - b * r, g * g + b * r),
        "MGRVI": sd(g * g - r * r, g * g + r * r),
        "WI": sd(g - b, r - g),
        "PSRI": sd(r - b, r),
        "ARI": sd(1.0, 1 - r),
    }


#: Names in report order.
RGB_NAMES = ("NDI", "CIVE", "MNDVI", "GRVI", "IKAW", "ExG", "ExR", "ExGR", "VARI", "GLA", "GLI", "RGBVI", "MGRVI", "WI", "PSRI", "ARI")
MS_NAMES = ("NDVI", "NDRE", "GNDVI", "SAVI", "OSAVI", "RVI", "DVI", "CIgreen", "CIrededge", "MTCI", "MCARI", "TCARI")


def channel_features(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Ten plain features of normalized channels."""
    return {
        "r": r, "g": g, "b": b, "r_over_g": sd(r, g), "g_over_b": sd(g, b), "b_over_g": sd(b, g),
        "r_plus_g": r + g, "r_plus_b": r + b, "g_plus_b": g + b, "gb_contrast": sd(g - b, g + b),
    }


def spectral_indices(green: Column, red: Column, edge: Column, nir: Column) -> dict[str, Column]:
    """The 12 multispectral indices of reflectances at 555, 660, 720 and 840 nm."""
    absorption = edge - red - 0.2 * (edge - green)
    return {
        "NDVI": sd(nir - red, nir + red),
        "NDRE": sd(nir - edge, nir + edge),
        "GNDVI": sd(nir - green, nir + green),
        "SAVI": 1.5 * sd(nir - red, nir + red + 0.5),
        "OSAVI": 1.16 * sd(nir - red, nir + red + 0.16),
        "RVI": sd(nir, red),
        "DVI": nir - red,
        "CIgreen": sd(nir, green) - 1,
        "CIrededge": sd(nir, edge) - 1,
        "MTCI": sd(nir - edge, edge - red),
        "MCARI": absorption * sd(edge, red),
        "TCARI": 3 * (edge - red - 0.2 * (edge - green) * sd(edge, red)),
    }


BANDS = (555, 660, 720, 840)


def gain(reflectance: Column, panel_median: Column) -> Column:
    """Empirical-line gain; an unusable panel is an error."""
    usable = ~F.isnan(panel_median) & (panel_median > 0)
    return F.when(F.coalesce(usable, F.lit(False)), reflectance / panel_median).otherwise(F.raise_error(F.lit("panel median must be positive and finite")).cast("double"))


def calibrated(signal: Column, band_gain: Column) -> Column:
    return signal * band_gain


def band_scale(values: Column) -> Column:
    """A frame whose largest value exceeds 1.5 is a 16-bit frame and is divided by 65535."""
    scale = F.when(F.array_max(values) > 1.5, 65535.0).otherwise(1.0)
    return F.transform(values, lambda v: v / scale)
