"""Pictures for review: temperatures on a fixed scale with masks drawn over them, and contact sheets (numpy, RGB)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .kernels import box, dilate, erode

#: Polynomial of the "inferno" colour map, constant term first, per channel (fixed values, a published fit).
INFERNO = np.array([
    (0.0002189403691192265, 0.001651004631001012, -0.01948089843709184),
    (0.1065134194856116, 0.5639564367884091, 3.932712388889277),
    (11.60249308247187, -3.972853965665698, -15.9423941062914),
    (-41.70399613139459, 17.43639888205313, 44.35414519872813),
    (77.162935699427, -33.40235894210092, -81.80730925738993),
    (-71.31942824499214, 32.62606426397723, 73.20951985803202),
    (25.13112622477341, -12.24266895238567, -23.07032500287172),
])
#: Colours (fixed values): a mask's fill and border, its layers, borders on contact sheets.
FILL, BORDER, SHEET = (0, 170, 220), (0, 255, 255), (0, 255, 0)
LAYER_COLORS = {"upper": (0, 255, 255), "middle": (80, 220, 80), "lower": (220, 80, 255)}


def temperature_image(temp: np.ndarray, low: float, high: float) -> np.ndarray:
    """Temperatures between two limits in 256 steps of colour; what is no number is black."""
    scaled = np.clip((temp - low) / max(high - low, 1e-9), 0.0, 1.0)
    t = np.round(np.nan_to_num(scaled, nan=0.0) * 255) / 255
    colors = np.clip(np.polynomial.polynomial.polyval(t, INFERNO), 0, 1)  # channel first
    return np.moveaxis(np.where(np.isfinite(temp), np.round(colors * 255), 0), 0, -1).astype(np.uint8)


def border(mask: np.ndarray) -> np.ndarray:
    """Pixels on either side of a mask's edge."""
    return dilate(mask, box(3)) & ~erode(mask, box(3))


def drawn(image: np.ndarray, mask: np.ndarray, fill: Sequence[int], edge: Sequence[int], share: float) -> np.ndarray:
    """The image with a mask tinted by a share of its fill, and its border in full colour."""
    out = image.astype(float)
    out[mask] = (1 - share) * out[mask] + share * np.array(fill)
    out[border(mask)] = edge
    return out


def overlay(temp: np.ndarray, mask: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(drawn(temperature_image(temp, low, high), mask, FILL, BORDER, 0.28), 0, 255).astype(np.uint8)


def layer_overlay(temp: np.ndarray, layers: dict[str, np.ndarray], low: float, high: float) -> np.ndarray:
    """Layers over temperatures, each in its colour (white if it has none)."""
    out = temperature_image(temp, low, high)
    for name, mask in layers.items():
        color = LAYER_COLORS.get(name, (255, 255, 255))
        out = drawn(out, mask, color, color, 0.24)
    return np.clip(out, 0, 255).astype(np.uint8)


def contact_sheet(images: Sequence[np.ndarray], masks: Sequence[np.ndarray], columns: int = 6, tile: int = 200) -> np.ndarray:
    """The frames of a sequence in rows of tiles, with their masks' borders."""
    sheet = np.zeros((max(1, -(-len(images) // columns)) * tile, columns * tile, 3), dtype=np.uint8)
    for i, (image, mask) in enumerate(zip(images, masks)):
        shown = image.copy()
        shown[border(mask)] = SHEET
        ys, xs = (np.arange(tile) * n // tile for n in mask.shape)
        y, x = divmod(i, columns)
        sheet[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] = shown[np.ix_(ys, xs)]
    return sheet
