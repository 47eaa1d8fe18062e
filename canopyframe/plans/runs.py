"""Runs over many sequences: what is left to do, propagate, summarize, write.  Mask proposals come from a provider."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrays import count_true
from ..functions.physics import path_stem
from ..operators import kernels as K, raster as R, render, segments, sequence as S
from ..sources import png, tables

#: A provider makes the logits table (keys, frame_idx, logits) of some frames.
Provider = Callable[[DataFrame], DataFrame]
PROVIDERS: dict[str, Provider] = {}


def register_provider(name: str, provider: Provider) -> None:
    if name in PROVIDERS:
        raise ValueError(f"provider {name} is registered already")
    PROVIDERS[name] = provider


def provider(name: str) -> Provider:
    """A registered provider; models that are not part of this library raise NotImplementedError."""
    if name in PROVIDERS:
        return PROVIDERS[name]
    if name in ("sam2", "classical", "yolo"):
        raise NotImplementedError(f"{name} is an external model: register a function that makes its logits table")
    raise KeyError(f"unknown provider {name}")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def run_sequences(
    frames: DataFrame, logits: DataFrame, rescue: DataFrame, keys: Sequence[str], width: int, height: int, path: str, done: DataFrame | None = None, cfg: R.PropagationConfig | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(frame rows, sequence summary) of the sequences that are not done, written under ``path``."""
    cfg = cfg or R.PropagationConfig()
    todo = S.remaining(frames, done, keys) if done is not None else frames
    rois = S.R.sequence_roi(todo.where("is_anchor").withColumn("mask", F.col("anchor_mask")), list(keys), width, height, cfg)
    rows = S.frame_rows(S.propagate(todo, logits, rescue, keys, cfg, width * height), rois, keys)
    tables.write_run({"frame_manifest": rows}, path, mode="append")
    written = todo.sparkSession.read.parquet(f"{path}/frame_manifest")
    summary = S.sequence_summary(written, keys)
    tables.write_run({"sequence_summary": summary}, path, mode="overwrite")
    return written, summary


def run_segments(spine: DataFrame, forward: DataFrame, backward: DataFrame, temps: DataFrame, keys: Sequence[str], width: int, size: int, path: str, reference: int = 0, points=(), labels=(), most: int = 30_000, least: int = 200) -> DataFrame:
    """Metrics of thermal segments; they are published only if every frame passes its checks, the audit always."""
    merged = segments.merged_masks(spine, forward, backward, keys, size)
    cleaned = segments.clean_segments(merged, keys, width, reference, points, labels, most=most)
    tables.write_run({"cleanup_audit": cleaned.drop("mask"), "cleaned_masks": cleaned.select(*keys, "frame_idx", "mask", "support_mode", "hard_fail")}, path, mode="overwrite")
    kept = spine.sparkSession.read.parquet(f"{path}/cleaned_masks")
    metrics = segments.segment_metrics(kept, temps, keys, width, most, least)
    tables.publish(metrics, f"{path}/segment_metrics")
    return spine.sparkSession.read.parquet(f"{path}/segment_metrics")


def crop_frames(frames: DataFrame, keys: Sequence[str], width: int, height: int, pad: int = 0, min_size: int = 0) -> DataFrame:
    """A crop report per frame, failed ones included, with the cropped temperatures (null outside the mask)."""
    reported = frames.withColumn("_r", R.crop_report(F.col("temp"), F.col("mask"), width, height, pad, min_size))
    inside = F.zip_with("temp", "mask", lambda t, m: F.when(m, t))
    return reported.select(*keys, "_r.*", F.when(F.col("_r.ok"), R.crop_to_roi(inside, width, F.col("_r.box"))).alias("cropped"))


def _file_rows(rows: DataFrame, inputs: Sequence[str], kernel: Callable[..., list[tuple[str, bytes]]]) -> DataFrame:
    """(name, content) of the files that a kernel makes of each row."""
    files = K.per_frame(rows, [], inputs, lambda *v: {"files": [{"name": n, "content": c} for n, c in kernel(*v)]}, "files array<struct<name:string,content:binary>>")
    return files.select(F.when(F.col("error").isNotNull(), F.raise_error("error").cast("array<struct<name:string,content:binary>>")).otherwise(F.col("files")).alias("files")).select(F.inline("files"))


def persist_sequences(frames: DataFrame, path: str, width: int, height: int, cfg: R.PropagationConfig | None = None, isat: bool = True) -> int:
    """Files of propagated frames, and how many: ``<sequence>/masks/<stem>.png``, ``<sequence>/jsons/<stem>.json`` and a table ``area`` as CSV.

    ``frames`` has sequence_key, frame_idx, frame_path, frame_label, mask, pred_source and threshold; other plain columns go to the table.
    """
    cfg = cfg or R.PropagationConfig()
    core = ("sequence_key", "frame_idx", "frame_path", "frame_label", "mask", "pred_source", "threshold")
    rows = frames.withColumn("stem", path_stem(F.col("frame_path")))

    def files(key, idx, frame_path, label, mask, source, stem):
        m = K.as_grid(mask, width, bool)
        out = [(f"{key}/masks/{stem}.png", png.encode(m.astype(np.uint8) * 255))]
        if isat:
            folder, _, name = frame_path.replace("\\", "/").rpartition("/")
            note = f"{key} | frame_idx={idx} | label={label} | src={source}"
            objects = K.isat_objects(m, cfg.isat_simplify_eps, cfg.isat_min_area, cfg.isat_category)
            out.append((f"{key}/jsons/{stem}.json", json.dumps(K.isat_document(objects, width, height, folder, name, note), ensure_ascii=False).encode()))
        return out

    n = tables.write_files(_file_rows(rows, ["sequence_key", "frame_idx", "frame_path", "frame_label", "mask", "pred_source", "stem"], files), path)
    extras = [c for c in frames.columns if c not in core]
    area = rows.select(
        F.col("sequence_key").alias("sequence"), "frame_idx", "frame_label", *extras, "stem", count_true(F.col("mask")).alias("area_px"), "pred_source", F.col("threshold").alias("thr")
    )
    tables.write_csv(area, f"{path}/area", mode="append")
    return n


def save_overlays(frames: DataFrame, keys: Sequence[str], width: int, path: str, low: float = 23.0, high: float = 30.0) -> int:
    """Pictures of temperature frames with their masks, whole and by layers, and how many; ``frames`` has temp and mask."""
    rows = frames.select(F.concat_ws("_", *keys).alias("stem"), "temp", "mask", R.layer_of(F.col("mask"), width).alias("layers"))

    def files(stem, temp, mask, layers):
        t, m = K.as_grid(temp, width), K.as_grid(mask, width, bool)
        of = np.array([-1 if v is None else v for v in layers]).reshape(m.shape)
        parts = {name: of == k for k, name in enumerate(R.LAYERS)}
        return [(f"{stem}_overlay.png", png.encode(render.overlay(t, m, low, high))), (f"{stem}_layers.png", png.encode(render.layer_overlay(t, parts, low, high)))]

    return tables.write_files(_file_rows(rows, ["stem", "temp", "mask", "layers"], files), path)


def save_contact_sheets(frames: DataFrame, keys: Sequence[str], width: int, path: str, cfg: R.PropagationConfig | None = None) -> int:
    """One contact sheet per sequence, and how many; ``frames`` has frame_idx, r, g, b and mask.

    A sequence's frames are cut down to tiles before they are brought together.
    """
    cfg = cfg or R.PropagationConfig()
    tiled = K.per_frame(
        frames, [*keys, "frame_idx"], ["r", "g", "b", "mask"],
        lambda r, g, b, m: {"tile": render.contact_sheet([np.stack([K.as_grid(c, width) for c in (r, g, b)], axis=2).astype(np.uint8)], [K.as_grid(m, width, bool)], 1, cfg.qa_grid_tile).tobytes()}, "tile binary",
    )
    sheets = tiled.where("tile is not null").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "tile"))), lambda t: t["tile"]).alias("tiles"))
    rows = sheets.select(F.concat_ws("_", *keys).alias("stem"), "tiles")

    def files(stem, tiles):
        n, side = cfg.qa_grid_cols, cfg.qa_grid_tile
        sheet = np.zeros((-(-len(tiles) // n) * side, n * side, 3), dtype=np.uint8)
        for i, t in enumerate(tiles):
            y, x = divmod(i, n)
            sheet[y * side : (y + 1) * side, x * side : (x + 1) * side] = np.frombuffer(t, dtype=np.uint8).reshape(side, side, 3)
        return [(f"{stem}_qa_grid.png", png.encode(sheet))]

    return tables.write_files(_file_rows(rows, ["stem", "tiles"], files), path)


def save_crops(frames: DataFrame, keys: Sequence[str], width: int, height: int, path: str, pad: int = 0, min_size: int = 0) -> int:
    """Files of each frame's crop, and how many: temperatures as ``.npy`` and ``.csv`` (not a number outside the plant), and a report, which a failed frame has too."""
    crops = crop_frames(frames, keys, width, height, pad, min_size)
    report = F.to_json(F.struct(*(F.col(c) for c in crops.columns if c != "cropped")), {"ignoreNullFields": "false"})
    rows = crops.select(F.concat_ws("_", *keys).alias("stem"), report.alias("report"), "cropped", (F.col("box.x1") - F.col("box.x0")).alias("w"))

    def files(stem, text, cropped, w):
        out = [(f"{stem}_report.json", text.encode())]
        if cropped is not None and w:
            grid = np.array([np.nan if v is None else v for v in cropped], dtype=np.float32).reshape(-1, int(w))
            npy, table = io.BytesIO(), io.StringIO()
            np.save(npy, grid)
            np.savetxt(table, grid, delimiter=",", fmt="%.3f")
            out += [(f"{stem}_crop.npy", npy.getvalue()), (f"{stem}_crop.csv", table.getvalue().encode())]
        return out

    return tables.write_files(_file_rows(rows, ["stem", "report", "cropped", "w"], files), path)


def long_traits(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Traits as (keys, trait, value): one row per numeric trait, null values kept."""
    numeric = [f.name for f in rows.schema.fields if f.name not in keys and f.dataType.typeName() in ("double", "float", "integer", "long", "bigint", "int")]
    return rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in numeric)).unpivot(list(keys), numeric, "trait", "value")


def list_modules() -> list[str]:
    """Public subpackages."""
    return ["functions", "operators", "sources", "plans", "streaming"]


def demo_frames(spark: SparkSession, n: int = 6) -> DataFrame:
    """The synthetic growing disc as a sequence with anchors at both ends and in the middle."""
    from ..sources.rasters import growing_disc

    discs = growing_disc(spark, n, 64, 48, 6.0, 2.0)
    anchor = F.col("frame_idx").isin(0, n // 2, n - 1)
    return discs.select(F.lit("demo").alias("sequence"), "frame_idx", anchor.alias("is_anchor"), F.when(anchor, F.col("mask")).alias("anchor_mask"), "mask")
