"""Configurations of thermal runs, and where they come from."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from .tables import load_config


@dataclass(frozen=True)
class SegmentConfig:
    """Parameters of thermal segments (fixed defaults): frame size, cleanup, display range, crops, failure."""

    image_width: int = 640
    image_height: int = 480
    dilate_px: int = 10
    hard_area_max_px: int = 30_000
    min_whole_area_px: int = 200
    vmin: float = 23.0
    vmax: float = 30.0
    jpeg_quality: int = 95
    crop_plant: bool = False
    crop_pad_px: int = 0
    crop_min_size: int = 0
    offload_video_to_cpu: bool = True
    bidirectional: bool = True
    qc_fail_raises: bool = True


@dataclass(frozen=True)
class ThermalConfig:
    """Parameters of thermal analysis (fixed defaults): display range, sensor gaps, layers, uncertainty."""

    temperature_vmin_c: float = 22.0
    temperature_vmax_c: float = 29.0
    interpolation_max_gap_sec: float = 600.0
    layer_partition: str = "relative_height_thirds"
    delta_t_reference_column: str = "ambient_c"
    block_bootstrap_iterations: int = 4000
    block_bootstrap_block_size: int = 12
    hac_max_lags: int = 12
    light_phase_threshold_lux: float = 50.0
    random_seed: int = 20260728


def load_thermal_config(path: str | None = None, preset: str | None = None) -> ThermalConfig:
    """The block ``thermal`` of a configuration file under one of its presets; the defaults without a file."""
    return load_config(ThermalConfig, path, preset, block="thermal")


def as_mapping(config) -> dict:
    """A configuration as plain values, tuples as lists."""
    return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(config).items()}
