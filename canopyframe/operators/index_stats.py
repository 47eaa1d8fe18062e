"""Statistics of index maps over masked pixels, frame by frame, with numpy under Arrow.

An index summary reads every masked pixel some hundred times: 16 formulas, each
sorted for its quantiles.  Interpreted array functions take seconds for a frame
of real size, numpy a fifth of a second; only the mask and the channels cross to
Python, and only the statistics come back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from ..functions.arrays import STATS

Formulas = Callable[..., dict[str, np.ndarray]]


def summaries(values: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of the finite values of each row; what no value has is NaN, the counts are whole numbers."""
    ok = np.isfinite(values)
    n = ok.sum(axis=1)
    ordered = np.sort(np.where(ok, values, np.inf), axis=1) if values.shape[1] else np.full((len(values), 1), np.inf)

    def quantile(q: float) -> np.ndarray:
        at = np.maximum(n - 1, 0) * q
        low, high = (np.take_along_axis(ordered, f(at).astype(int)[:, None], axis=1)[:, 0] for f in (np.floor, np.ceil))
        return np.where(n > 0, low + np.where(high > low, high - low, 0.0) * (at - np.floor(at)), np.nan)

    known = np.where(ok, values, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = known.sum(axis=1) / n
        std = np.sqrt((np.where(ok, values - mean[:, None], 0.0) ** 2).sum(axis=1) / n)
        return {"median": quantile(0.5), "mean": mean, "p10": quantile(0.1), "p90": quantile(0.9), "std": std, "n": n}


class _Lists:
    """Rows of an array column as numpy slices; a null element is False or NaN."""

    def __init__(self, column: pa.Array) -> None:
        flags = pa.types.is_boolean(column.type.value_type)
        self.values = pc.fill_null(column.values, False if flags else float("nan")).to_numpy(zero_copy_only=False)
        self.offsets = column.offsets.to_numpy()
        self.known = column.is_valid().to_numpy(zero_copy_only=False)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.values[self.offsets[i] : self.offsets[i + 1]]


def _masked(channel: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The channel at the masked places; NaN beyond its end."""
    if len(places) and places[-1] >= len(channel):
        channel = np.concatenate([channel, np.full(places[-1] + 1 - len(channel), np.nan)])
    return channel[places]


def index_statistics(mask: Column, channels: Sequence[Column], names: Sequence[str], formulas: Formulas) -> Column:
    """struct(masked, and for each name a struct of statistics) of a frame; all are null where the mask or a channel is."""
    one = ", ".join(f"{s}: {'bigint' if s == 'n' else 'double'}" for s in STATS)
    schema = f"struct<masked: bigint, {', '.join(f'{name}: struct<{one}>' for name in names)}>"

    @F.arrow_udf(schema)
    def run(frames: pa.Array) -> pa.Array:
        mask, *channels = (_Lists(c) for c in frames.flatten())
        valid = mask.known.copy()
        for c in channels:
            valid &= c.known
        masked = np.zeros(len(frames), dtype=np.int64)
        out = {s: np.full((len(names), len(frames)), np.nan) for s in STATS}
        for i in range(len(frames)):
            places = np.flatnonzero(mask[i])
            masked[i] = len(places)
            if valid[i]:
                with np.errstate(all="ignore"):
                    found = formulas(*(_masked(c[i], places) for c in channels))
                for s, v in summaries(np.stack([found[name] for name in names])).items():
                    out[s][:, i] = v
        parts = [pa.array(masked, mask=~mask.known)]
        for k in range(len(names)):
            stats = []
            for s in STATS:
                v, lost = out[s][k], ~valid | ~np.isfinite(out[s][k])
                stats.append(pa.array(np.where(lost, 0, v).astype(np.int64), mask=lost) if s == "n" else pa.array(v, mask=lost))
            parts.append(pa.StructArray.from_arrays(stats, list(STATS)))
        return pa.StructArray.from_arrays(parts, ["masked", *names])

    return run(F.struct(mask, *channels))
