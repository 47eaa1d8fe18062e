"""Sequences of frames: manifests, anchors, provenance of masks, leave-one-out quality.

A model that proposes masks is outside this library: it delivers a table of
logits per frame and direction, and everything around it is here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.arrays import count_true
from ..functions.physics import is_true_word, plant_key, plant_number
from . import raster as R

CORE_COLUMNS = ("sequence_key", "frame_idx", "frame_path", "frame_label", "is_anchor", "mask_path")


# --- manifests -------------------------------------------------------------------


def manifest_sequences(manifest: DataFrame, order: Sequence[str] = (), min_anchors: int = 2) -> tuple[DataFrame, DataFrame]:
    """(frames, skipped) of a manifest.

    Frames are numbered from 0 within a sequence: by their given ``frame_idx``
    where the sequence's first row has one, else by ``order``.  Columns beyond
    the core six go to ``extras``.  A sequence with fewer anchors than wanted
    is skipped with a reason.
    """
    extras = [c for c in manifest.columns if c not in CORE_COLUMNS]
    given = F.expr("try_cast(try_cast(frame_idx AS double) AS int)") if "frame_idx" in manifest.columns else F.lit(None).cast("int")
    seq = W.partitionBy("sequence_key")
    by = [F.col(c) for c in order] or [F.col("frame_path")]
    numbered = manifest.withColumn("_row", F.row_number().over(seq.orderBy(*by)) - 1).withColumn("_given", given)
    first = F.first("_given").over(seq.orderBy("_row").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    anchor = is_true_word(F.col("is_anchor").cast("string"))
    frames = numbered.select(
        "sequence_key", F.when(first.isNotNull(), F.col("_given")).otherwise(F.col("_row")).cast("int").alias("frame_idx"), "frame_path",
        (F.col("frame_label") if "frame_label" in manifest.columns else F.lit(None).cast("string")).alias("frame_label"), anchor.alias("is_anchor"),
        (F.col("mask_path") if "mask_path" in manifest.columns else F.lit(None).cast("string")).alias("mask_path"),
        (F.create_map(*(x for c in extras for x in (F.lit(c), F.col(c).cast("string")))) if extras else F.create_map().cast("map<string,string>")).alias("extras"),
    )
    counts = frames.groupBy("sequence_key").agg(F.count_if("is_anchor").alias("n_anchors"), F.count(F.lit(1)).alias("n_frames"))
    skipped = counts.where(F.col("n_anchors") < min_anchors).select("sequence_key", "n_frames", "n_anchors", F.concat(F.lit("only "), "n_anchors", F.lit(" anchors")).alias("reason"))
    return frames.join(counts.where(F.col("n_anchors") >= min_anchors).select("sequence_key"), "sequence_key", "left_semi"), skipped


def index_sequences(index: DataFrame, anchors: DataFrame, role: str, plants: Sequence[int] | None = None, min_anchors: int = 2, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, skipped) from a frame index (plant_no, frame_role, rgb_path, ...) and anchor masks (plant_key, stem).

    Frames are ordered by stem.  Skipped plants say why: no anchors at all, or
    too few matched ones.  Wanted plants that are not in the index, and under
    ``strict`` anchors without a frame, are errors.
    """
    from ..functions.physics import path_stem

    rows = index.where((F.trim("frame_role") == role) & (F.trim("plant_no") != "")).withColumn("plant_key", plant_key(plant_number(F.col("plant_no")))).withColumn("stem", path_stem(F.col("rgb_path")))
    if plants is not None:
        wanted = index.sparkSession.createDataFrame([(p,) for p in plants], "n int").select(plant_key(F.col("n")).alias("plant_key"))
        absent = [r[0] for r in wanted.join(rows, "plant_key", "left_anti").collect()]
        if absent:
            raise ValueError(f"plants not in the index: {sorted(absent)}")
        rows = rows.join(wanted, "plant_key", "left_semi")
    known = anchors.select("plant_key", "stem").distinct()
    if strict and not known.join(rows, ["plant_key", "stem"], "left_anti").isEmpty():
        raise ValueError("anchor masks without a frame")
    idx = F.row_number().over(W.partitionBy("plant_key").orderBy("stem")) - 1
    frames = rows.withColumn("frame_idx", idx).join(known.withColumn("is_anchor", F.lit(True)), ["plant_key", "stem"], "left").withColumn("is_anchor", F.coalesce("is_anchor", F.lit(False)))
    counts = frames.groupBy("plant_key").agg(F.count_if("is_anchor").alias("n_anchors"))
    has_any = known.select("plant_key").distinct().withColumn("_has", F.lit(True))
    reasons = counts.join(has_any, "plant_key", "left").withColumn("reason", F.when(F.col("_has").isNull(), "no anchor directory").when(F.col("n_anchors") < min_anchors, "too few matched anchors"))
    skipped = reasons.where(F.col("reason").isNotNull()).select("plant_key", "n_anchors", "reason")
    return frames.join(skipped, "plant_key", "left_anti"), skipped


def unmatched_anchors(anchors: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Anchor masks that no frame carries."""
    return anchors.join(frames, list(keys), "left_anti")


def stem_join(masks: DataFrame, *sides: tuple[str, DataFrame]) -> DataFrame:
    """Masks with whatever other modality shares their stem; ``sides`` are (name, table with stem and path)."""
    out = masks
    for name, side in sides:
        out = out.join(side.select("stem", F.col("path").alias(f"{name}_path")), "stem", "left")
    return out


def first_match(files: DataFrame, extensions: Sequence[str] = ("png", "jpg", "jpeg", "tif", "tiff", "npy")) -> DataFrame:
    """One path per stem: the first extension of the list that exists."""
    ext = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    place = F.array_position(F.array(*map(F.lit, extensions)), ext)
    from ..functions.physics import path_stem

    found = files.select("path", path_stem(F.col("path")).alias("stem"), place.alias("place")).where("place > 0")
    return found.groupBy("stem").agg(F.min_by("path", F.struct("place", "path")).alias("path"))


def find_mask(frames: DataFrame, masks: DataFrame) -> DataFrame:
    """Each frame's mask: same stem in the top folder, then anywhere below ``whole``, then one whose stem ends in the frame's stem."""
    from ..functions.physics import path_stem

    m = masks.select("path", path_stem(F.col("path")).alias("mask_stem"), F.when(F.contains("path", F.lit("/whole/")), 1).otherwise(0).alias("place"))
    exact = frames.select("stem").join(m, frames["stem"] == m["mask_stem"]).select("stem", "path", "place")
    # a longer mask stem ends in the frame's stem after an underscore: try every such ending
    cut = F.split("mask_stem", "_")
    endings = F.transform(F.sequence(F.lit(2), F.size(cut)), lambda k: F.array_join(F.slice(cut, k, F.size(cut)), "_"))
    tails = m.where(F.size(cut) > 1).select("path", F.explode(endings).alias("stem")).withColumn("place", F.lit(2))
    both = exact.unionByName(frames.select("stem").distinct().join(tails, "stem").select("stem", "path", "place"))
    best = both.groupBy("stem").agg(F.min_by("path", F.struct("place", "path")).alias("mask_path"))
    return frames.join(best, "stem", "left")


# --- anchors -----------------------------------------------------------------------


def nearest_anchor(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the nearest anchor's index (the lower one on ties), from ``is_anchor``, by two fills along the sequence."""
    seq = W.partitionBy(*keys)
    mark = F.when(F.col("is_anchor"), F.col("frame_idx"))
    before = F.last(mark, ignorenulls=True).over(seq.orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(seq.orderBy("frame_idx").rowsBetween(0, W.unboundedFollowing))
    out = frames.withColumn("_b", before).withColumn("_a", after)
    nearer = F.when(F.col("_a").isNull() | (F.col("frame_idx") - F.col("_b") <= F.col("_a") - F.col("frame_idx")), F.col("_b")).otherwise(F.col("_a"))
    return out.withColumn("nearest_anchor", nearer).drop("_b", "_a")


def endpoints(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``is_endpoint``: first or last frame of its sequence."""
    last = F.max("frame_idx").over(W.partitionBy(*keys))
    return frames.withColumn("is_endpoint", (F.col("frame_idx") == 0) | (F.col("frame_idx") == last))


def leave_one_out_folds(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per held-out anchor: the other anchors as prompts, the gap to the nearest, whether it is an endpoint.

    Anchors are sparse within a sequence, so their indices are held as an array.
    """
    ends = endpoints(frames, keys).where("is_anchor")
    every = ends.withColumn("_all", F.array_sort(F.collect_set("frame_idx").over(W.partitionBy(*keys))))
    others = F.filter("_all", lambda k: k != F.col("frame_idx"))
    folds = every.withColumn("prompts", others).where(F.size("prompts") > 0)
    return folds.withColumn("gap", F.array_min(F.transform("prompts", lambda k: F.abs(k - F.col("frame_idx"))))).drop("_all").withColumnRenamed("frame_idx", "held_idx")


def leave_one_out_quality(folds: DataFrame, truth: str, predicted: str, width: int, height: int) -> DataFrame:
    """Adds IoU and boundary F1 of each fold, rounded half to even at four digits."""
    return folds.withColumn("iou", F.bround(R.mask_iou(F.col(truth), F.col(predicted)), 4)).withColumn("boundary_f1", F.bround(R.boundary_f1(F.col(truth), F.col(predicted), width, height), 4))


def leave_one_out(frames: DataFrame, logits: DataFrame, keys: Sequence[str], width: int, height: int, cfg: R.PropagationConfig | None = None, rois: DataFrame | None = None) -> DataFrame:
    """One row per held-out anchor: how well the others' propagation finds its mask.

    ``logits`` (keys, held_idx, logits) is what a provider makes of each fold's
    prompts; a fold without them has the source ``missing`` and an empty mask.
    Masks are compared inside the sequence's region, where ``rois`` (keys, roi)
    gives one.
    """
    cfg, on = cfg or R.PropagationConfig(), [*keys, "held_idx"]
    folds = leave_one_out_folds(frames, keys).withColumnRenamed("anchor_mask", "truth")
    joined = folds.join(logits.select(*on, F.col("logits").alias("_l")), on, "left")
    joined = joined.join(rois.select(*keys, "roi"), list(keys), "left") if rois is not None else joined
    rung = joined.withColumn("_rung", R.threshold_ladder(F.coalesce("_l", F.array().cast("array<double>")), cfg))
    inside = lambda c: F.transform(c, lambda m, i: m & R.in_box(i, width, F.col("roi"))) if rois is not None else c
    none, found = F.transform("truth", lambda m: F.lit(False)), F.col("_rung.area") > 0
    source = F.when(F.col("_l").isNull(), "missing").when(found & ~F.col("_rung.fallback"), "propagated").when(found, "propagated_lowthr").otherwise("failed_empty")
    masks = rung.withColumns({"truth": inside(F.col("truth")), "predicted": inside(F.when(found, R.ladder_mask(F.col("_l"), F.col("_rung"))).otherwise(none)), "pred_source": source})
    scored = leave_one_out_quality(masks, "truth", "predicted", width, height)
    return scored.select(
        *on, "iou", "boundary_f1", count_true(F.col("truth")).alias("gt_area"), count_true(F.col("predicted")).alias("pred_area"), "gap", "is_endpoint",
        F.coalesce("_rung.threshold", F.lit(float(cfg.base_threshold))).alias("threshold"), "pred_source", F.size("prompts").alias("n_prompts"),
    )


def quality_summary(rows: DataFrame, keys: Sequence[str] = (), interior_only: bool = False) -> DataFrame:
    """Count, median, mean, least and tenth percentile of IoU, median F1, shares at .85 and .70."""
    kept = rows.where(~F.col("is_endpoint")) if interior_only else rows
    share = lambda at: F.bround(F.avg((F.col("iou") >= at).cast("double")), 4)
    return kept.groupBy(*keys).agg(
        F.count("iou").alias("n"), F.bround(F.median("iou"), 4).alias("median_iou"), F.bround(F.avg("iou"), 4).alias("mean_iou"), F.bround(F.min("iou"), 4).alias("min_iou"),
        F.bround(F.percentile("iou", 0.1), 4).alias("p10_iou"), F.bround(F.median("boundary_f1"), 4).alias("median_bf1"), share(0.85).alias("frac_iou_ge_085"), share(0.70).alias("frac_iou_ge_070"),
    )


# --- propagation ---------------------------------------------------------------------


def merge_directions(forward: DataFrame, backward: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Logits of both directions per frame, merged; each table has the keys and ``logits``."""
    f, b = forward.select(*keys, F.col("logits").alias("_f")), backward.select(*keys, F.col("logits").alias("_b"))
    return f.join(b, list(keys), "full_outer").select(*keys, R.merge_logits(F.col("_f"), F.col("_b")).alias("logits"))


def propagate(frames: DataFrame, logits: DataFrame, rescue: DataFrame, keys: Sequence[str], cfg: R.PropagationConfig, size: int) -> DataFrame:
    """Adds mask, pred_source and threshold: the anchor's own mask, else the ladder over its logits, else over the rescue logits, else empty."""
    on = [*keys, "frame_idx"]
    joined = frames.join(logits.select(*on, F.col("logits").alias("_l")), on, "left").join(rescue.select(*on, F.col("logits").alias("_r")), on, "left")
    none = F.array().cast("array<double>")
    rungs = joined.withColumn("_rl", R.threshold_ladder(F.coalesce("_l", none), cfg)).withColumn("_rr", R.threshold_ladder(F.coalesce("_r", none), cfg))
    anchored = F.col("is_anchor") & F.col("anchor_mask").isNotNull()
    found, saved = F.col("_rl.area") > 0, F.col("_rr.area") > 0
    source = F.when(anchored, "manual").when(found & ~F.col("_rl.fallback"), "propagated").when(found, "propagated_lowthr").when(saved, "point_rescue").otherwise("failed_empty")
    mask = F.when(anchored, F.col("anchor_mask")).when(found, R.ladder_mask(F.col("_l"), F.col("_rl"))).when(saved, R.ladder_mask(F.col("_r"), F.col("_rr"))).otherwise(F.array_repeat(F.lit(False), size))
    thr = F.when(anchored, F.lit(None).cast("double")).when(found, F.col("_rl.threshold")).when(saved, F.col("_rr.threshold"))
    return rungs.withColumn("mask", mask).withColumn("pred_source", source).withColumn("threshold", thr).drop("_l", "_r", "_rl", "_rr")


def frame_rows(propagated: DataFrame, rois: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Provenance rows: path, label, source, threshold, area, region and extras of each frame."""
    flat = rois.select(*keys, *(F.col(f"roi.{c}").alias(f"roi_{c}") for c in ("x0", "y0", "x1", "y1")))
    return propagated.withColumn("area_px", count_true(F.col("mask"))).join(flat, list(keys), "left").drop("mask", "anchor_mask")


def sequence_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames per source, and first, last and largest area, per sequence."""
    sources = ("manual", "propagated", "propagated_lowthr", "point_rescue", "failed_empty")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), *(F.count_if(F.col("pred_source") == s).alias(f"n_{s}") for s in sources),
        F.min_by("area_px", "frame_idx").alias("area_first"), F.max_by("area_px", "frame_idx").alias("area_last"), F.max("area_px").alias("area_max"),
    )


def remaining(sequences: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sequences that a resumed run still has to do."""
    return sequences.join(done, list(keys), "left_anti")


def evidence_frames(frames: DataFrame, keys: Sequence[str], reference: int = 0, dense: Sequence[str] = (), full: Sequence[str] = (), segment: str = "segment", most: int = 13) -> DataFrame:
    """Frames to review: first, reference, last, all that are not OK, smallest and largest area.

    Segments named in ``dense`` are filled up to ``most`` at even strides, those
    in ``full`` keep all frames.
    """
    w = W.partitionBy(*keys)
    last, n = F.max("frame_idx").over(w), F.count(F.lit(1)).over(w)
    rank = lambda *by: F.row_number().over(w.orderBy(*by)) == 1
    base = frames.withColumn("_n", n).withColumn("_last", last).withColumn("_lo", rank("area_px", "frame_idx")).withColumn("_hi", rank(F.desc("area_px"), "frame_idx"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / most))
    keep = (
        F.col("frame_idx").isin(0, reference) | (F.col("frame_idx") == F.col("_last")) | (F.col("qc") != "OK") | F.col("_lo") | F.col("_hi")
        | (F.col(segment).isin(*dense) & (F.col("frame_idx") % stride == 0) if dense else F.lit(False)) | (F.col(segment).isin(*full) if full else F.lit(False))
    )
    return base.where(keep).drop("_n", "_last", "_lo", "_hi")


def assert_anchor_bounds(frames: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The anchors, failing on one whose index lies outside its sequence."""
    sizes = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ok = (F.col("frame_idx") >= 0) & (F.col("frame_idx") < F.col("_n"))
    checked = anchors.join(sizes, list(keys), "left")
    return checked.withColumn("frame_idx", F.when(F.coalesce(ok, F.lit(False)), F.col("frame_idx")).otherwise(F.raise_error(F.lit("anchor index outside its sequence")).cast("int"))).drop("_n")
