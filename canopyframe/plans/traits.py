"""Trait registry and orchestration: which traits a frame's inputs allow, computed in one projection.

A trait is a builder of Columns over a frame's arrays, a kernel run under Arrow,
or both.  Only traits whose inputs are present are planned, so columns that no
trait needs are never read; all kernels of a frame run in one pass over it.  A
trait that fails on a frame says why in its column ``<trait>_error`` and leaves
its traits null; the others are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import arrays as A
from ..functions.indices import MS_NAMES, RGB_NAMES
from ..operators import geometry as G, kernels as K, raster as R


@dataclass(frozen=True)
class Trait:
    """``prepare`` adds structs to the frames, ``columns`` reads the traits from them; ``kernel`` takes the columns ``kernel_inputs`` of a frame and its width.

    Of the inputs in ``together`` all must be given: where only some are, the
    trait runs and fails on every frame.
    """

    name: str
    requires: frozenset[str]
    tier: int
    prepare: Callable[[DataFrame, int], DataFrame] = lambda df, width: df
    columns: Callable[[], dict[str, Column]] = dict
    description: str = ""
    rasters: tuple[str, ...] = ()
    together: frozenset[str] = frozenset()
    kernel: Callable[..., dict] | None = None
    kernel_inputs: tuple[str, ...] = ()
    kernel_schema: str = ""

    def lacks(self, given: Sequence[str]) -> set[str]:
        """Inputs that keep the trait from running at all."""
        some = bool(self.together & set(given))
        return set(self.requires) - set(given) - (set(self.together) if some else set())


@dataclass
class Registry:
    traits: dict[str, Trait] = field(default_factory=dict)

    def register(self, trait: Trait) -> Trait:
        if trait.name in self.traits:
            raise ValueError(f"trait {trait.name} is registered already")
        self.traits[trait.name] = trait
        return trait

    def get(self, name: str) -> Trait:
        return self.traits[name]

    def available_for(self, inputs: Sequence[str]) -> list[Trait]:
        """Traits whose inputs are all given, by tier, then name."""
        return sorted((t for t in self.traits.values() if not t.lacks(inputs)), key=lambda t: (t.tier, t.name))

    def clear(self) -> None:
        self.traits.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        """The registry as a table, for plans that choose traits by data."""
        rows = [(t.name, t.tier, sorted(t.requires)) for t in self.traits.values()]
        return spark.createDataFrame(rows, "name string, tier int, requires array<string>")


def _flat(prefix: str, part: str) -> dict[str, Column]:
    return {f"{prefix}{k}": F.col(f"{part}.{k}") for k in A.STATS}


def _index_columns(masked: str, names: Sequence[str]) -> dict[str, Column]:
    return {k: v for n in names for k, v in (_flat(f"{n}_", n) | {f"{n}_valid_frac": R.valid_fraction(F.col(f"{n}.n"), F.col(masked))}).items()}


MS_BANDS = ("b555", "b660", "b720", "b840")


CONTOUR_SCHEMA = "convex_hull_area_px double, perimeter_px double, solidity double, circularity double"


def _contour(mask, width: int) -> dict:
    return K.shape_traits(K.as_grid(mask, width, bool))


def _canopy(depth, mask, camera, width: int) -> dict:
    if camera is None or len(camera) != 4:
        raise ValueError("a camera is fx, fy, cx, cy")
    return G.canopy_traits(K.as_grid(depth, width), K.as_grid(mask, width, bool), tuple(map(float, camera)))


def standard() -> Registry:
    """All built-in traits, by tier: masks and temperatures, colour, depth, spectral bands."""
    c, out = F.col, Registry()
    canopy = lambda df, w: df.withColumn("_canopy", R.canopy_temperature(c("temp"), c("mask")))
    add = lambda name, requires, tier, *rest, **more: out.register(Trait(name, frozenset(requires), tier, *rest, **more))
    add(
        "shape2d", ["mask"], 1, lambda df, w: df.withColumn("_shape", R.shape_moments(c("mask"), w)), lambda: {k: c(f"_shape.{k}") for k in R.SHAPE}, "area, box, centroid, hull, perimeter and ratios",
        kernel=_contour, kernel_inputs=("mask",), kernel_schema=CONTOUR_SCHEMA,
    )
    add("canopy_temperature", ["mask", "temp"], 1, canopy, lambda: _flat("canopy_", "_canopy"), "masked temperature", rasters=("temp",))
    add("layer_temperature", ["mask", "temp"], 2, lambda df, w: df.withColumn("_layers", R.layer_temperatures(c("temp"), c("mask"), w)), lambda: {k: c(f"_layers.{k}") for k in R.LAYER_COLUMNS}, "temperature by thirds of height", rasters=("temp",))
    add("canopy_delta_t", ["mask", "temp", "ambient"], 2, lambda df, w: canopy(df, w).withColumn("_ambient", A.fin(c("ambient"))), _delta, "canopy less ambient temperature", rasters=("temp",))
    add("rgb_vegetation_indices", ["mask", "r", "g", "b"], 2, lambda df, w: R.rgb_summaries(df, "r", "g", "b", "mask"), lambda: _index_columns("rgb_masked", RGB_NAMES), "16 colour indices", rasters=("r", "g", "b"))
    add("canopy_3d_geometry", ["mask", "depth", "camera"], 3, description="height, area, surface and volume over the fitted soil", kernel=_canopy, kernel_inputs=("depth", "mask", "camera"), kernel_schema=G.CANOPY_SCHEMA)
    add(
        "multispectral_vegetation_indices", ["mask", *MS_BANDS], 4, lambda df, w: R.spectral_summaries(df, MS_BANDS, "mask"), lambda: _index_columns("ms_masked", MS_NAMES), "12 spectral indices",
        rasters=MS_BANDS, together=frozenset(MS_BANDS),
    )
    return out


def _delta() -> dict[str, Column]:
    ambient = F.col("_ambient")
    return {
        "delta_t_median": F.col("_canopy.median") - ambient, "delta_t_mean": F.col("_canopy.mean") - ambient,
        "canopy_delta_t_missing_reason": F.when(ambient.isNull(), "ambient_temperature_missing"),
    }


INPUTS = ("mask", "temp", "ambient", "r", "g", "b", "b555", "b660", "b720", "b840", "depth", "camera")


def _misfit(trait: Trait) -> Column:
    """What keeps a trait's Columns from a frame: a raster that is missing or not as large as the mask; null if nothing does."""
    checks = [F.when(F.col("mask").isNull(), "mask is missing")]
    checks += [F.when(F.col(r).isNull(), f"{r} is missing").when(F.size(r) != F.size("mask"), f"{r} and mask differ in size") for r in trait.rasters]
    return F.coalesce(*checks, F.lit(None).cast("string"))


def compute_traits(frames: DataFrame, width: int, keys: Sequence[str], registry: Registry | None = None, inputs: Sequence[str] | None = None) -> DataFrame:
    """One row per frame with every trait its columns allow, each trait's error, and which inputs and traits those were."""
    given = [c for c in (inputs or INPUTS) if c in frames.columns]
    chosen = (registry or standard()).available_for(given)
    whole = [t for t in chosen if t.requires <= set(given)]
    cols, errors, prepared = {}, {}, frames
    for t in whole:  # each struct is computed once
        prepared = t.prepare(prepared, width)
        misfit = _misfit(t)
        cols |= {k: F.when(misfit.isNull(), v) if t.rasters else v for k, v in t.columns().items()}
        if not t.kernel:
            errors[f"{t.name}_error"] = misfit
    for t in chosen:
        if t not in whole:
            errors[f"{t.name}_error"] = F.lit(f"missing inputs: {', '.join(sorted(t.requires - set(given)))}")
    kernels = [t for t in whole if t.kernel]
    needed = list(dict.fromkeys(c for t in kernels for c in t.kernel_inputs))
    listed = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    rows = prepared.select(
        *keys, *(v.alias(k) for k, v in cols.items()), *(v.alias(k) for k, v in errors.items()), listed(given).alias("_inputs"), listed([t.name for t in chosen]).alias("_traits_run"),
        *(F.col(c).alias(f"_in_{c}") for c in needed),
    )
    if not kernels:
        return rows
    names = {t.name: [f.split()[0] for f in t.kernel_schema.split(", ")] for t in kernels}

    def run(*values) -> dict:
        row, out = dict(zip(needed, values)), {}
        for t in kernels:
            try:
                found = t.kernel(*(row[c] for c in t.kernel_inputs), width)
                out |= {k: found.get(k) for k in names[t.name]}
            except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
                out[f"{t.name}_error"] = str(e)
        return out

    schema = ", ".join(f"{t.kernel_schema}, {t.name}_error string" for t in kernels)
    kept = [c for c in rows.columns if not c.startswith("_in_")]
    return K.per_frame(rows, kept, [f"_in_{c}" for c in needed], run, schema, "_kernel_error").drop("_kernel_error")


def contour_traits(frames: DataFrame, keys: Sequence[str], width: str = "width") -> DataFrame:
    """Perimeter, hull and shape ratios; an error is reported beside null traits."""

    def kernel(mask, w):
        t = _contour(mask, int(w))
        return {k: t.get(k) for k in ("area_px", "perimeter_px", "convex_hull_area_px", "circularity", "solidity")}

    return K.per_frame(frames, keys, ["mask", width], kernel, "area_px long, perimeter_px double, convex_hull_area_px double, circularity double, solidity double")


def tier_counts(rows: DataFrame, registry: Registry) -> DataFrame:
    """How many frames ran some trait of each tier."""
    tiers = sorted({t.tier for t in registry.traits.values()})
    ran = lambda k: F.count_if(F.arrays_overlap("_traits_run", F.array(*(F.lit(t.name) for t in registry.traits.values() if t.tier == k))))
    return rows.agg(*(ran(k).alias(f"tier_{k}") for k in tiers))


def available_by_data(spark: SparkSession, rows: DataFrame, registry: Registry) -> DataFrame:
    """Rows (key, inputs) with the traits each allows, in order: a join to the registry's table, whose size is the code's."""
    table = F.broadcast(registry.table(spark))
    hit = rows.join(table, F.size(F.array_except(table["requires"], rows["inputs"])) == 0, "left")
    return hit.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("tier", "name"))), lambda t: t["name"]).alias("traits"))
