"""Raster scans: folders of image and array files to one row per frame.

Files are read with Spark's ``binaryFile`` source, so listing, pruning by path
and scheduling are Spark's; decoding runs in Arrow batches.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.indices import band_scale
from ..functions.physics import path_stem
from . import png

EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff", "npy")


def decode_file(path: str, content: bytes) -> np.ndarray:
    """``.npy`` and PNG are decoded here; other formats need an imaging library."""
    if path.lower().endswith(".npy"):
        return np.load(io.BytesIO(content), allow_pickle=False)
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return png.decode(content)
    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError(f"no decoder for {path}") from e
    return np.asarray(Image.open(io.BytesIO(content)))


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def _frames(files: DataFrame, fields: str, build: Callable[[np.ndarray], dict]) -> DataFrame:
    names = [f.strip().split()[0] for f in fields.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                a = decode_file(path, content)
                rows.append({"path": path, "height": a.shape[0], "width": a.shape[1], **build(a)})
            yield pd.DataFrame(rows, columns=["path", "height", "width", *names])

    decoded = files.select("path", "content").mapInPandas(run, f"path string, height int, width int, {fields}")
    return decoded.withColumn("stem", path_stem(F.col("path")))


def _gray(a: np.ndarray) -> np.ndarray:
    return a if a.ndim == 2 else a[..., 0] if a.shape[2] < 3 else np.rint(a[..., :3] @ np.array([0.299, 0.587, 0.114]))


def read_masks(spark: SparkSession, path: str, threshold: int = 0, glob: str = "*.png") -> DataFrame:
    """path, height, width, mask, stem: pixels above the threshold (0 for plain masks, 127 for anchors)."""
    return _frames(scan(spark, path, glob), "mask array<boolean>", lambda a: {"mask": (_gray(a) > threshold).ravel().tolist()})


def read_rgb(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """path, height, width, r, g, b, stem."""

    def build(a: np.ndarray) -> dict:
        c = np.repeat(a[..., None], 3, axis=2) if a.ndim == 2 else a
        return {n: c[..., k].ravel().astype(float).tolist() for k, n in enumerate("rgb")}

    return _frames(scan(spark, path, glob), "r array<double>, g array<double>, b array<double>", build)


def read_values(spark: SparkSession, path: str, name: str, glob: str = "*") -> DataFrame:
    """One numeric raster per file (depth in mm, temperature in degrees, any single band) as ``name``."""
    return _frames(scan(spark, path, glob), f"{name} array<double>", lambda a: {name: _gray(a).astype(np.float32).ravel().astype(float).tolist()})


def read_band(spark: SparkSession, path: str, name: str, glob: str = "*") -> DataFrame:
    """A reflectance band; a 16-bit frame is scaled to 0..1."""
    return read_values(spark, path, name, glob).withColumn(name, band_scale(F.col(name)))


def thermal_meta(frames: DataFrame, meta: DataFrame) -> DataFrame:
    """Temperature frames (``X_temp``) with the metadata of ``X_meta``; an empty map where there is none.

    ``meta`` has path and a JSON text in ``value``.
    """
    side = meta.select(F.regexp_replace(path_stem(F.col("path")), "_meta$", "").alias("_k"), F.from_json("value", "map<string,string>").alias("meta"))
    joined = frames.withColumn("_k", F.regexp_replace("stem", "_temp$", "")).join(side, "_k", "left").drop("_k")
    return joined.withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


def content_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def png_bytes(frames: DataFrame, mask: str, width: str = "width") -> DataFrame:
    """Adds ``png``: the mask as a 0/255 gray image, ready to be written by any sink."""
    schema = frames.select("*", F.lit(b"").alias("png")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(png=[png.encode((np.asarray(list(m), dtype=bool).reshape(-1, int(w)) * 255).astype(np.uint8)) for m, w in zip(pdf[mask], pdf[width])])

    return frames.mapInPandas(run, schema)


def growing_disc(spark: SparkSession, n_frames: int = 6, width: int = 320, height: int = 240, start: float = 18.0, step: float = 6.0) -> DataFrame:
    """Synthetic sequence: a centred disc that grows; frame_idx, width, height, mask."""
    inside = lambda i, r: (F.pow(i % width - width / 2, F.lit(2)) + F.pow(F.floor(i / width) - height / 2, F.lit(2))) <= r * r
    radius = F.lit(start) + F.col("id") * step
    mask = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: inside(i, radius))
    return spark.range(n_frames).select(F.col("id").cast("int").alias("frame_idx"), F.lit(width).alias("width"), F.lit(height).alias("height"), mask.alias("mask"))


# --- modalities ------------------------------------------------------------------------

MODALITIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_modality(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    if name in MODALITIES:
        raise ValueError(f"modality {name} is registered already")
    MODALITIES[name] = reader


for _name, _reader in {
    "mask": read_masks, "rgb": read_rgb, "depth": lambda s, p: read_values(s, p, "depth"), "lidar": lambda s, p: read_values(s, p, "depth"),
    "thermal": lambda s, p: read_values(s, p, "temp", "*_temp.npy"), "multispectral": lambda s, p: read_band(s, p, "band"),
}.items():
    register_modality(_name, _reader)
