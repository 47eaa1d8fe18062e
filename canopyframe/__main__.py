"""Command line: list-traits, phenotype (frames table to traits), align (frames to sensor log), segment, crop."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="canopyframe")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list-traits", help="registered traits, their tiers and inputs").add_argument("-v", "--verbose", action="store_true")
    t = sub.add_parser("phenotype", help="traits of a parquet table of frames")
    t.add_argument("--frames", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--csv", help="also write the traits as CSV here")
    t.add_argument("--width", type=int, required=True)
    t.add_argument("--intrinsics", nargs=4, type=float, metavar=("FX", "FY", "CX", "CY"), help="camera of frames with a depth")
    t.add_argument("--key", action="append", default=[], help="key column (repeatable; default frame_id)")
    a = sub.add_parser("align", help="align frames to a sensor log")
    a.add_argument("--frames", required=True)
    a.add_argument("--sensor", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--timestamp", default="timestamp")
    a.add_argument("--value", action="append", required=True)
    a.add_argument("--max-gap-sec", type=float, default=600.0)
    a.add_argument("--stretch-sec", type=float, default=86400.0)
    s = sub.add_parser("segment", help="propagate keyframe masks to whole sequences, from a table of logits")
    s.add_argument("--adapter", choices=["csv", "plant"], default="csv")
    s.add_argument("--manifest", help="manifest CSV or JSON (csv adapter)")
    s.add_argument("--index", help="frame index CSV (plant adapter)")
    s.add_argument("--role", default="crop", help="frame role to take (plant adapter)")
    s.add_argument("--masks", required=True, help="folder of anchor masks")
    s.add_argument("--logits", required=True, help="parquet: sequence_key, frame_idx, logits")
    s.add_argument("--fold-logits", help="parquet: sequence_key, held_idx, logits; for validation")
    s.add_argument("--output", required=True)
    s.add_argument("--config")
    s.add_argument("--preset")
    s.add_argument("--backend", choices=["sam2", "classical", "yolo"], help="other than a table of logits: must be registered")
    s.add_argument("--image-size", nargs=2, type=int, default=(720, 1280), metavar=("H", "W"))
    s.add_argument("--min-anchors", type=int, default=2)
    s.add_argument("--no-loo", action="store_true")
    s.add_argument("--no-isat", action="store_true")
    s.add_argument("--no-resume", action="store_true")
    c = sub.add_parser("crop", help="crop temperature frames to their plants; masks are matched by name")
    c.add_argument("--frames", required=True, help="folder of *_temp.npy")
    c.add_argument("--masks", required=True, help="folder of mask images")
    c.add_argument("--output", required=True)
    c.add_argument("--image-size", nargs=2, type=int, default=(480, 640), metavar=("H", "W"))
    c.add_argument("--pad", type=int, default=0)
    c.add_argument("--min-size", type=int, default=0)
    return p


def sequences(spark: SparkSession, args) -> DataFrame:
    """Frames of the wanted adapter: sequence_key, frame_idx, frame_path, frame_label, is_anchor, stem of the anchor's mask."""
    from .functions.physics import path_stem
    from .operators import sequence as S
    from .sources import rasters, tables

    if args.adapter == "csv":
        frames, _ = S.manifest_sequences(tables.read_manifest(spark, args.manifest), min_anchors=args.min_anchors)
        return frames.withColumn("mask_stem", F.coalesce(path_stem(F.col("mask_path")), path_stem(F.col("frame_path")))).drop("mask_path", "extras")
    files = rasters.scan(spark, args.masks, "*.png").select("path")
    place = F.split(F.translate("path", "\\", "/"), "/")
    anchors = files.select(F.element_at(place, -2).alias("plant_key"), path_stem(F.col("path")).alias("stem"))
    frames, _ = S.index_sequences(tables.read_manifest(spark, args.index), anchors, args.role, min_anchors=args.min_anchors)
    return frames.select(F.col("plant_key").alias("sequence_key"), "frame_idx", F.col("rgb_path").alias("frame_path"), F.col("stem").alias("frame_label"), "is_anchor", F.col("stem").alias("mask_stem"))


def segment(spark: SparkSession, args) -> int:
    from .operators import raster as R, sequence as S
    from .plans import runs
    from .sources import rasters, tables

    cfg = tables.load_config(R.PropagationConfig, args.config, args.preset)
    height, width = args.image_size
    frames = sequences(spark, args)
    if frames.isEmpty():
        print("no sequences: check the manifest or index", file=sys.stderr)
        return 2
    masks = rasters.read_masks(spark, args.masks, 127).select(F.col("stem").alias("mask_stem"), F.col("mask").alias("anchor_mask"))
    marked = frames.where("is_anchor").join(masks, "mask_stem").select("sequence_key", "frame_idx", "anchor_mask")
    ready = frames.join(marked, ["sequence_key", "frame_idx"], "left").drop("mask_stem").withColumn("is_anchor", F.col("anchor_mask").isNotNull())
    logits = runs.provider(args.backend)(ready) if args.backend else spark.read.parquet(args.logits)
    none = logits.where("false")
    done = None
    if not args.no_resume and runs.exists(spark, f"{args.output}/sequence_summary"):
        done = spark.read.parquet(f"{args.output}/sequence_summary").select("sequence_key")
    todo = S.remaining(ready, done, ["sequence_key"]) if done is not None else ready
    # files first: the summary, written last, says which sequences are done
    propagated = S.propagate(todo, logits, none, ["sequence_key"], cfg, width * height).drop("anchor_mask", "is_anchor")
    n = runs.persist_sequences(propagated, args.output, width, height, cfg, not args.no_isat)
    _, summary = runs.run_sequences(ready, logits, none, ["sequence_key"], width, height, args.output, done, cfg)
    print(f"{summary.count()} sequences, {n} files")
    if args.fold_logits and not args.no_loo:
        loo = S.leave_one_out(ready, spark.read.parquet(args.fold_logits), ["sequence_key"], width, height, cfg)
        tables.write_run({"loo": loo}, args.output, mode="overwrite")
        for r in S.quality_summary(spark.read.parquet(f"{args.output}/loo"), interior_only=True).collect():
            print(f"leave-one-out (interior): IoU median {r.median_iou} mean {r.mean_iou}, F1 median {r.median_bf1} (n {r.n})")
    return 0


def crop(spark: SparkSession, args) -> int:
    from .operators import raster as R
    from .plans import runs
    from .sources import rasters

    height, width = args.image_size
    temps = rasters.read_values(spark, args.frames, "temp", "*_temp.npy").withColumn("stem", F.regexp_replace("stem", "_temp$", ""))
    masks = rasters.read_masks(spark, args.masks).select(F.regexp_replace("stem", "_mask$", "").alias("stem"), "mask", F.col("height").alias("mh"), F.col("width").alias("mw"))
    sized = temps.where((F.col("height") == height) & (F.col("width") == width)).join(masks, "stem")
    as_large = F.when((F.col("mh") == height) & (F.col("mw") == width), F.col("mask")).otherwise(R.resize_nearest(F.col("mask"), F.col("mw"), F.col("mh"), width, height))
    n = runs.save_crops(sized.withColumn("mask", as_large), ["stem"], width, height, args.output, args.pad, args.min_size)
    print(f"{n} files")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    from .operators import timeseries as T
    from .plans import traits

    if args.command == "list-traits":
        for t in traits.standard().available_for(traits.INPUTS):
            print(f"{t.tier}  {t.name}  [{', '.join(sorted(t.requires))}]" + (f"  {t.description}" if args.verbose else ""))
        return 0
    if args.command == "segment" and not (args.manifest if args.adapter == "csv" else args.index):
        parser.error(f"--{'manifest' if args.adapter == 'csv' else 'index'} is required for the {args.adapter} adapter")
    spark = SparkSession.builder.appName("canopyframe").getOrCreate()
    if args.command in ("segment", "crop"):
        return (segment if args.command == "segment" else crop)(spark, args)
    frames = spark.read.parquet(args.frames)
    if args.command == "phenotype":
        if args.intrinsics:
            frames = frames.withColumn("camera", F.array(*map(F.lit, args.intrinsics)))
        traits.compute_traits(frames, args.width, args.key or ["frame_id"]).write.mode("error").parquet(args.out)
        if args.csv:
            from .sources.tables import write_csv

            write_csv(spark.read.parquet(args.out), args.csv)
    else:
        sensor = T.prepare_sensor(spark.read.parquet(args.sensor), args.timestamp, args.value)
        T.align(frames, sensor, args.timestamp, args.value, max_gap_sec=args.max_gap_sec, stretch_sec=args.stretch_sec).write.mode("error").parquet(args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
