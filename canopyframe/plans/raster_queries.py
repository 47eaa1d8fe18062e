"""Raster queries on frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A, indices as I, physics as P
from ..operators import raster as R
from .frames import PX, SIDE, bands, channels, frames, logits, r9, r9_of, rolled, sql_stats, stat_columns, stat_fields, table

CFG = R.PropagationConfig(roi_min_size=4, min_valid_area=3)
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- temperature ---------------------------------------------------------------------


@query(f"WITH {PX} SELECT frame_id, {sql_stats('25 + 5 * e', 'canopy_', 'e > 0')} FROM px GROUP BY frame_id")
def q_canopy_temperature(spark, d):
    return frames(spark, d).withColumn("s", R.canopy_temperature(F.col("temp"), F.col("mask"))).select("frame_id", *stat_columns(F.col("s"), "canopy_"))


_LAYERED = f"""{PX}, box AS (SELECT frame_id, min(y) AS y0, max(y) AS y1 FROM px WHERE e > 0 GROUP BY frame_id),
lay AS (SELECT p.*, CASE WHEN (y - y0) / (y1 - y0 + 1) < 1 / 3 THEN 'upper' WHEN (y - y0) / (y1 - y0 + 1) < 2 / 3 THEN 'middle' ELSE 'lower' END AS layer
  FROM px p JOIN box USING (frame_id) WHERE e > 0)"""


@query(f"""WITH {_LAYERED}, s AS (SELECT frame_id, {', '.join(sql_stats('25 + 5 * e', f'{n}_', f"layer = '{n}'") for n in R.LAYERS)},
  median(25 + 5 * e) FILTER (WHERE layer = 'lower') AS l, median(25 + 5 * e) FILTER (WHERE layer = 'middle') AS m, median(25 + 5 * e) FILTER (WHERE layer = 'upper') AS u FROM lay GROUP BY frame_id)
SELECT * EXCLUDE (l, m, u), round(greatest(l, m, u) - least(l, m, u), 9) + 0.0 AS layer_range, round(u - l, 9) + 0.0 AS upper_minus_lower, NULL::VARCHAR AS layer_error FROM s""")
def q_layer_temperature(spark, d):
    plain = {k for k in R.LAYER_COLUMNS if k.endswith("_n") or k == "layer_error"}
    found = frames(spark, d).select("frame_id", R.layer_temperatures(F.col("temp"), F.col("mask"), SIDE).alias("s"))
    return found.select("frame_id", *((F.col(f"s.{k}") if k in plain else r9(F.col(f"s.{k}"))).alias(k) for k in R.LAYER_COLUMNS))


@query(f"""WITH {PX} SELECT frame_id, round(median(25 + 5 * e) FILTER (WHERE e > 0) - (20 + any_value(label) / 10), 9) + 0.0 AS delta_t_median,
  round(avg(25 + 5 * e) FILTER (WHERE e > 0) - (20 + any_value(label) / 10), 9) + 0.0 AS delta_t_mean FROM px GROUP BY frame_id""")
def q_delta_t(spark, d):
    s = frames(spark, d).withColumn("s", R.canopy_temperature(F.col("temp"), F.col("mask")))
    return s.select("frame_id", *(r9(P.delta_t(F.col(f"s.{k}"), F.col("ambient"))).alias(f"delta_t_{k}") for k in ("median", "mean")))


@query(f"""WITH {_LAYERED} SELECT p.frame_id, count(*) FILTER (WHERE layer = 'lower') AS lower_area, count(*) FILTER (WHERE layer = 'middle') AS middle_area,
  count(*) FILTER (WHERE layer = 'upper') AS upper_area, count(*) FILTER (WHERE (l.layer IS NOT NULL) <> (p.e > 0)) AS union_xor
  FROM px p LEFT JOIN lay l ON p.frame_id = l.frame_id AND p.i = l.i GROUP BY p.frame_id""")
def q_layer_audit(spark, d):
    layered = frames(spark, d).withColumn("layers", R.layer_of(F.col("mask"), SIDE))
    return layered.select("frame_id", *(c.alias(k) for k, c in R.layer_audit(F.col("layers"), F.col("mask")).items()))


# --- indices ---------------------------------------------------------------------------


def _sd(n: str, den: str) -> str:
    return f"CASE WHEN abs({den}) > 1e-6 THEN ({n}) / ({den}) END"


RGB_SQL = {
    "NDI": "(r - g) / (r + g + 0.01)", "CIVE": "0.441 * r - 0.811 * g + 0.3856 * b + 18.78745", "MNDVI": _sd("r - g - b", "r + g"), "GRVI": _sd("g - r", "g + r"),
    "IKAW": _sd("r - b", "r + b"), "ExG": "2 * g - r - b", "ExR": "1.4 * r - g", "ExGR": "3 * g - 2.4 * r - b", "VARI": _sd("g - r", "g + r - b"),
    "GLA": _sd("2 * g - r + b", "2 * g + r + b"), "GLI": _sd("2 * g - r - b", "2 * g + r + b"), "RGBVI": _sd("g * g - b * r", "g * g + b * r"),
    "MGRVI": _sd("g * g - r * r", "g * g + r * r"), "WI": _sd("g - b", "r - g"), "PSRI": _sd("r - b", "r"), "ARI": _sd("1", "1 - r"),
}
_LEVEL = "floor(255 * least(1.0, greatest(0.0, {} + 0.5)))"
_RGB = f"""{PX}, ch AS (SELECT frame_id, {_LEVEL.format('e')} AS rr, {_LEVEL.format('e21')} AS gg, {_LEVEL.format('e42')} AS bb FROM px WHERE e > 0),
nrm AS (SELECT frame_id, CASE WHEN rr + gg + bb > 1e-6 THEN rr / (rr + gg + bb) END AS r, CASE WHEN rr + gg + bb > 1e-6 THEN gg / (rr + gg + bb) END AS g, CASE WHEN rr + gg + bb > 1e-6 THEN bb / (rr + gg + bb) END AS b FROM ch)"""


def _index_sql(source: str, table_: str, named: dict[str, str]) -> str:
    cols = ", ".join(f"{sql_stats(f'({v})', f'{k}_')}, round(count({v}) / count(*), 9) AS {k}_valid_frac" for k, v in named.items())
    return f"WITH {source} SELECT frame_id, {cols} FROM {table_} GROUP BY frame_id"


def _index_columns(names, masked):
    return [c for n in names for c in (*stat_fields(n, f"{n}_"), r9_of(f"(CASE WHEN {masked} > 0 THEN {n}.n / {masked} END)", f"{n}_valid_frac"))]


@query(_index_sql(_RGB, "nrm", RGB_SQL))
def q_rgb_indices(spark, d):
    found = R.rgb_summaries(channels(frames(spark, d)), "r", "g", "b", "mask")
    return found.select("frame_id", *_index_columns(RGB_SQL, "rgb_masked"))


FEATURE_SQL = {
    "r": "r", "g": "g", "b": "b", "r_over_g": _sd("r", "g"), "g_over_b": _sd("g", "b"), "b_over_g": _sd("b", "g"),
    "r_plus_g": "r + g", "r_plus_b": "r + b", "g_plus_b": "g + b", "gb_contrast": _sd("g - b", "g + b"),
}


@query("WITH " + _RGB + " SELECT frame_id, " + ", ".join(f"round(avg({v}), 9) + 0.0 AS {k}_mean" for k, v in FEATURE_SQL.items()) + " FROM nrm GROUP BY frame_id")
def q_channel_features(spark, d):
    px = R._pixels(F.col("mask"), F.col("r"), F.col("g"), F.col("b"))
    df = channels(frames(spark, d)).select("frame_id", px.alias("px"))
    each = F.transform("px", lambda p: F.struct(*(c.alias(k) for k, c in I.channel_features(*I.normalized(p["c0"], p["c1"], p["c2"])).items())))
    found = A.with_summaries(df.withColumn("ix", each), {f"x_{k}": F.col("ix")[k] for k in FEATURE_SQL})
    return found.select("frame_id", *(r9(F.col(f"x_{k}.mean")).alias(f"{k}_mean") for k in FEATURE_SQL))


MS_SQL = {
    "NDVI": _sd("n - r", "n + r"), "NDRE": _sd("n - re", "n + re"), "GNDVI": _sd("n - g", "n + g"), "SAVI": "1.5 * " + _sd("n - r", "n + r + 0.5"), "OSAVI": "1.16 * " + _sd("n - r", "n + r + 0.16"),
    "RVI": _sd("n", "r"), "DVI": "n - r", "CIgreen": _sd("n", "g") + " - 1", "CIrededge": _sd("n", "re") + " - 1", "MTCI": _sd("n - re", "re - r"),
    "MCARI": "(re - r - 0.2 * (re - g)) * " + _sd("re", "r"), "TCARI": "3 * (re - r - 0.2 * (re - g) * " + _sd("re", "r") + ")",
}
_MS = f"{PX}, ms AS (SELECT frame_id, 0.05 + abs(e) AS g, 0.05 + abs(e16) AS r, 0.05 + abs(e32) AS re, 0.05 + abs(e48) AS n FROM px WHERE e > 0)"


@query(_index_sql(_MS, "ms", MS_SQL))
def q_ms_indices(spark, d):
    found = R.spectral_summaries(bands(frames(spark, d)), [f"b{nm}" for nm in I.BANDS], "mask")
    return found.select("frame_id", *_index_columns(MS_SQL, "ms_masked"))


@query(f"WITH {_MS} SELECT frame_id, " + ", ".join(f"{sql_stats(v, f'R{nm}_')}, round(count({v}) / count(*), 9) AS R{nm}_valid_fraction" for nm, v in ((555, "g"), (660, "r"), (720, "re"), (840, "n"))) + " FROM ms GROUP BY frame_id")
def q_reflectance(spark, d):
    df = bands(frames(spark, d)).withColumn("masked", A.count_true(F.col("mask")))
    df = A.with_summaries(df, {f"s{nm}": A.where_mask(F.col(f"b{nm}"), F.col("mask")) for nm in I.BANDS})
    return df.select("frame_id", *(c for nm in I.BANDS for c in (*stat_columns(F.col(f"s{nm}"), f"R{nm}_"), r9(R.valid_fraction(F.col(f"s{nm}.n"), F.col("masked"))).alias(f"R{nm}_valid_fraction"))))


@query(f"""WITH {_MS}, gains AS (SELECT frame_id, 0.61 / median(n) AS gain FROM ms GROUP BY frame_id)
SELECT m.frame_id, round(any_value(gain), 9) AS gain840, round(avg(n * gain), 9) AS calibrated_mean FROM ms m JOIN gains USING (frame_id) GROUP BY m.frame_id""")
def q_panel_gain(spark, d):
    df = bands(frames(spark, d)).withColumn("v", A.where_mask(F.col("b840"), F.col("mask")))
    df = df.withColumn("gain", I.gain(F.lit(0.61), A.summary(F.col("v"))["median"]))
    return df.select("frame_id", r9(F.col("gain")).alias("gain840"), r9(A.summary(F.transform("v", lambda x: I.calibrated(x, F.col("gain"))))["mean"]).alias("calibrated_mean"))


@query("""SELECT event_id, round(0.6108 * exp(17.27 * t / (t + 237.3)) * (1 - rh / 100), 9) + 0.0 AS vpd_kpa FROM (SELECT event_id, 10 + value % 25 AS t, (40 + event_id % 50)::DOUBLE AS rh FROM events)""")
def q_vpd(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", r9(P.vpd_kpa(10 + F.col("value") % 25, (40 + F.col("event_id") % 50).cast("double"))).alias("vpd_kpa"))


# --- shapes, regions, masks ----------------------------------------------------------------


@query(f"""WITH {PX} SELECT frame_id, count(*) FILTER (WHERE e > 0) AS area_px, min(x) FILTER (WHERE e > 0) AS bbox_x, min(y) FILTER (WHERE e > 0) AS bbox_y,
  max(x) FILTER (WHERE e > 0) - min(x) FILTER (WHERE e > 0) + 1 AS bbox_w, max(y) FILTER (WHERE e > 0) - min(y) FILTER (WHERE e > 0) + 1 AS bbox_h,
  round(avg(x) FILTER (WHERE e > 0), 9) AS centroid_x, round(avg(y) FILTER (WHERE e > 0), 9) AS centroid_y,
  round((max(x) FILTER (WHERE e > 0) - min(x) FILTER (WHERE e > 0) + 1) / (max(y) FILTER (WHERE e > 0) - min(y) FILTER (WHERE e > 0) + 1), 9) AS aspect_ratio FROM px GROUP BY frame_id""")
def q_shape_moments(spark, d):
    doubles = {"centroid_x", "centroid_y", "aspect_ratio"}
    found = frames(spark, d).select("frame_id", R.shape_moments(F.col("mask"), SIDE).alias("s"))
    return found.select("frame_id", *((r9(F.col(f"s.{k}")) if k in doubles else F.col(f"s.{k}").cast("long")).alias(k) for k in R.SHAPE))


_THRESH = "0.2"
_TIGHT = f"""{PX}, bb AS (SELECT frame_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM px WHERE e > {_THRESH} GROUP BY frame_id)"""


@query(f"""WITH {_TIGHT}, grown AS (SELECT f.vec_id AS frame_id, b.x0 IS NOT NULL AS found, x0 - 1 - (greatest(4 - (x1 - x0 + 2), 0) // 2) AS x0, y0 - 1 - (greatest(4 - (y1 - y0 + 2), 0) // 2) AS y0,
  x1 + 1 + greatest(4 - (x1 - x0 + 2), 0) - greatest(4 - (x1 - x0 + 2), 0) // 2 AS x1, y1 + 1 + greatest(4 - (y1 - y0 + 2), 0) - greatest(4 - (y1 - y0 + 2), 0) // 2 AS y1 FROM embeddings f LEFT JOIN bb b ON f.vec_id = b.frame_id)
SELECT frame_id, CASE WHEN found THEN greatest(x0, 0) END AS x0, CASE WHEN found THEN greatest(y0, 0) END AS y0, CASE WHEN found THEN least(x1, 8) END AS x1, CASE WHEN found THEN least(y1, 8) END AS y1 FROM grown""")
def q_tight_bbox(spark, d):
    mask = F.transform("e", lambda v: v > float(_THRESH))
    box = R.expand_bbox(R.tight_bbox(mask, SIDE), 1, 4, SIDE, SIDE)
    return frames(spark, d).withColumn("b", box).select("frame_id", *(F.col(f"b.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"""WITH {PX}, ext AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px WHERE frame_id % 5 = 0 AND e > 0.35 GROUP BY label),
side AS (SELECT *, least(greatest(greatest(x1 - x0 + 1, y1 - y0 + 1) * 1.9, 4.0), 8.0) AS side FROM ext),
s AS (SELECT *, round_even(side, 0)::BIGINT AS size, round_even((x0 + x1) / 2.0 - side / 2.0, 0)::BIGINT AS rx, round_even((y0 + y1) / 2.0 - side / 2.0, 0)::BIGINT AS ry FROM side),
p AS (SELECT *, greatest(0, least(rx, 8 - size)) AS px0, greatest(0, least(ry, 8 - size)) AS py0 FROM s)
SELECT label, px0 AS x0, py0 AS y0, least(8, px0 + size) AS x1, least(8, py0 + size) AS y1 FROM p""")
def q_roi(spark, d):
    anchors = frames(spark, d).where("frame_id % 5 = 0").withColumn("mask", F.transform("e", lambda v: v > 0.35))
    rois = R.sequence_roi(anchors, ["label"], SIDE, SIDE, CFG)
    some = anchors.where(F.exists("mask", lambda m: m)).select("label").distinct()
    return rois.join(some, "label", "left_semi").select("label", *(F.col(f"roi.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(f"""WITH {PX} SELECT frame_id, count(*) FILTER (WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 6) AS n, round(sum(e) FILTER (WHERE x >= 2 AND x < 7 AND y >= 1 AND y < 6), 9) + 0.0 AS total FROM px GROUP BY frame_id""")
def q_crop_to_roi(spark, d):
    box = R.box_struct(F.lit(2), F.lit(1), F.lit(7), F.lit(6))
    return frames(spark, d).withColumn("c", R.crop_to_roi(F.col("e"), SIDE, box)).select("frame_id", F.size("c").cast("long").alias("n"), r9(A.total(F.col("c"))).alias("total"))


@query(f"""WITH {PX}, sub AS (SELECT frame_id, y // 2 * 4 + x // 2 AS j, bool_or(e > 0) FILTER (WHERE x % 2 = 0 AND y % 2 = 0) AS m FROM px GROUP BY ALL)
SELECT p.frame_id, sum((x >= 1 AND x < 7 AND y >= 2 AND y < 8 AND m)::INT)::BIGINT AS area, sum(CASE WHEN x >= 1 AND x < 7 AND y >= 2 AND y < 8 AND m THEN i ELSE 0 END)::BIGINT AS places
FROM px p JOIN sub s ON p.frame_id = s.frame_id AND s.j = CASE WHEN x >= 1 AND x < 7 AND y >= 2 AND y < 8 THEN (y - 2) * 4 // 6 * 4 + (x - 1) * 4 // 6 ELSE 0 END GROUP BY p.frame_id""")
def q_paste_from_roi(spark, d):
    sub = F.transform(F.filter("e", lambda v, i: (i % SIDE % 2 == 0) & (F.floor(i / SIDE) % 2 == 0)), lambda v: v > 0)
    box = R.box_struct(F.lit(1), F.lit(2), F.lit(7), F.lit(8))
    full = R.paste_from_roi(sub, 4, 4, box, SIDE, SIDE)
    return frames(spark, d).withColumn("full", full).select("frame_id", A.count_true(F.col("full")).alias("area"), F.aggregate(A.indices(F.col("full")), F.lit(0).cast("long"), lambda a, i: a + i).alias("places"))


@query(f"""WITH {PX} SELECT frame_id, round(sum(CASE WHEN x >= 3 AND x < 7 AND y >= 1 AND y < 5 THEN e - 0.3 - 0.5 * label ELSE 0 END), 9) + 0.0 AS inside, count(*) FILTER (WHERE NOT (x >= 3 AND x < 7 AND y >= 1 AND y < 5)) AS n_filled FROM px GROUP BY frame_id""")
def q_constrain_logits(spark, d):
    box = F.struct(F.lit(2.6).alias("x0"), F.lit(0.5000001).alias("y0"), F.lit(6.7).alias("x1"), F.lit(5.2).alias("y1"))
    out = logits(frames(spark, d)).withColumn("c", R.constrain_logits(F.col("logits"), SIDE, SIDE, box))
    return out.select("frame_id", r9(A.total(F.filter("c", lambda v: v > -1e8))).alias("inside"), F.size(F.filter("c", lambda v: v <= -1e8)).cast("long").alias("n_filled"))


_RUNGS = (0.0, -0.5, -1.0, -2.0, -4.0)
_LADDER = f"""{PX}, cnt AS (SELECT frame_id, label, {', '.join(f'count(*) FILTER (WHERE e - 0.3 - 0.5 * label > {t}) AS c{k}' for k, t in enumerate(_RUNGS))} FROM px GROUP BY frame_id, label),
lad AS (SELECT frame_id, label, CASE {' '.join(f'WHEN c{k} >= 3 THEN {t}' for k, t in enumerate(_RUNGS))} ELSE 0.0 END::DOUBLE AS threshold, c0 < 3 AS fallback,
  CASE {' '.join(f'WHEN c{k} >= 3 THEN c{k}' for k, t in enumerate(_RUNGS))} ELSE 0 END AS area FROM cnt)"""


@query(f"WITH {_LADDER} SELECT frame_id, threshold, fallback, area FROM lad")
def q_threshold_ladder(spark, d):
    return logits(frames(spark, d)).withColumn("l", R.threshold_ladder(F.col("logits"), CFG)).select("frame_id", "l.threshold", "l.fallback", "l.area")


@query(f"WITH {PX} SELECT frame_id, round(CASE WHEN count(*) FILTER (WHERE e > 0 OR e1 > 0) = 0 THEN 1.0 ELSE count(*) FILTER (WHERE e > 0 AND e1 > 0) / count(*) FILTER (WHERE e > 0 OR e1 > 0) END, 9) AS iou FROM px GROUP BY frame_id")
def q_mask_iou(spark, d):
    return frames(spark, d).select("frame_id", r9(R.mask_iou(F.col("mask"), rolled(F.col("mask"), 1))).alias("iou"))


def _edge_sql(name: str, test: str) -> str:
    return f"""{name} AS (SELECT a.frame_id, a.x, a.y FROM px a JOIN px b ON a.frame_id = b.frame_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
  WHERE a.{test} > 0 GROUP BY ALL HAVING bool_or(NOT (b.{test} > 0)))"""


@query(f"""WITH {PX}, {_edge_sql('ep', 'e1')}, {_edge_sql('et', 'e')},
np AS (SELECT e.frame_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM et t WHERE t.frame_id = e.frame_id AND abs(t.x - e.x) <= 2 AND abs(t.y - e.y) <= 2)) AS hit FROM ep e GROUP BY e.frame_id),
nt AS (SELECT e.frame_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM ep t WHERE t.frame_id = e.frame_id AND abs(t.x - e.x) <= 2 AND abs(t.y - e.y) <= 2)) AS hit FROM et e GROUP BY e.frame_id)
SELECT v.vec_id AS frame_id, round(CASE WHEN p.n IS NULL AND t.n IS NULL THEN 1.0 WHEN p.n IS NULL OR t.n IS NULL OR p.hit + t.hit = 0 THEN 0.0 ELSE 2 * (p.hit / p.n) * (t.hit / t.n) / (p.hit / p.n + t.hit / t.n) END, 9) AS bf1
FROM embeddings v LEFT JOIN np p ON v.vec_id = p.frame_id LEFT JOIN nt t ON v.vec_id = t.frame_id""")
def q_boundary_f1(spark, d):
    return frames(spark, d).select("frame_id", r9(R.boundary_f1(rolled(F.col("mask"), 1), F.col("mask"), SIDE, SIDE)).alias("bf1"))


@query(f"""WITH {PX}, s AS (SELECT frame_id, avg(x) AS cx, avg(y) AS cy, greatest(max(x) - min(x), 8.0) AS bw, greatest(max(y) - min(y), 8.0) AS bh FROM px WHERE e > 0 GROUP BY frame_id)
SELECT frame_id, round(cx, 9) AS cx, round(cy, 9) AS cy, round(greatest(0, cx - 0.65 * bw), 9) AS x0, round(greatest(0, cy - 0.65 * bh), 9) AS y0, round(least(7, cx + 0.65 * bw), 9) AS x1, round(least(7, cy + 0.65 * bh), 9) AS y1 FROM s""")
def q_rescue_box(spark, d):
    return frames(spark, d).withColumn("b", R.rescue_box(F.col("mask"), SIDE, SIDE, CFG)).where("b is not null").select("frame_id", *(r9(F.col(f"b.{c}")).alias(c) for c in ("cx", "cy", "x0", "y0", "x1", "y1")))


@query(f"""WITH {PX} SELECT frame_id, count(*) FILTER (WHERE e > 0) > 0 AS ok, round(quantile_cont(25 + 5 * e, 0.01) FILTER (WHERE e > 0), 9) AS vmin, round(quantile_cont(25 + 5 * e, 0.99) FILTER (WHERE e > 0), 9) AS vmax,
  min(x) FILTER (WHERE e > 0) AS x0, min(y) FILTER (WHERE e > 0) AS y0, max(x) FILTER (WHERE e > 0) + 1 AS x1, max(y) FILTER (WHERE e > 0) + 1 AS y1, {sql_stats('25 + 5 * e', '', 'e > 0')} FROM px GROUP BY frame_id""")
def q_crop_report(spark, d):
    df = frames(spark, d).select("frame_id", R.crop_report(F.col("temp"), F.col("mask"), SIDE, SIDE).alias("s")).select("frame_id", "s.*")
    return df.select("frame_id", "ok", r9(F.col("vmin")).alias("vmin"), r9(F.col("vmax")).alias("vmax"), *(F.col(f"box.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")), *stat_columns(F.col("stats")))


@query(f"""WITH {PX}, q AS (SELECT frame_id, quantile_cont(e, 0.01) AS p1, quantile_cont(e, 0.99) AS p99 FROM px GROUP BY frame_id)
SELECT frame_id, round(sum(least(1.0, greatest(0.0, (e - p1) / greatest(p99 - p1, 1e-9)))), 9) AS total FROM px JOIN q USING (frame_id) GROUP BY frame_id""")
def q_robust_normalize(spark, d):
    return frames(spark, d).select("frame_id", r9(A.total(P.robust_normalize(F.col("e")))).alias("total"))


@query(f"WITH {PX} SELECT frame_id, sum(round_even(least(1.0, greatest(0.0, (25 + 5 * e - 23.0) / 7.0)) * 255, 0)::BIGINT)::BIGINT AS total FROM px GROUP BY frame_id")
def q_gray_level(spark, d):
    return frames(spark, d).select("frame_id", F.aggregate(F.transform("temp", lambda t: P.gray_level(t, 23.0, 30.0)), F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


# --- depth ---------------------------------------------------------------------------------


_XYZ = f"{PX}, z AS (SELECT frame_id, i, x, y, 900 + 100 * e AS z, (x - 4) * (900 + 100 * e) / 600 AS cx, (y - 4) * (900 + 100 * e) / 600 AS cy, e FROM px)"


def _depth(spark, d):
    return frames(spark, d).withColumn("depth", F.transform("e", lambda v: 900 + 100 * v))


@query(f"WITH {_XYZ} SELECT frame_id, round(avg(greatest(1000 - z, 0)), 9) AS mean_height, round(quantile_cont(greatest(1000 - z, 0), 0.95), 9) AS p95_height, round(avg(cx), 9) + 0.0 AS mean_x, round(avg(cy), 9) + 0.0 AS mean_y FROM z WHERE e > 0 GROUP BY frame_id")
def q_deproject_height(spark, d):
    at = F.transform("depth", lambda z, i: F.struct(*(c.alias(n) for n, c in zip("xyz", P.deproject(i % SIDE, F.floor(i / SIDE), z, 600.0, 600.0, 4.0, 4.0)))))
    df = _depth(spark, d).withColumn("p", A.where_mask(at, F.col("mask")))
    h = F.transform("p", lambda p: P.height_over_plane(p["x"], p["y"], p["z"], F.lit(0.0), F.lit(0.0), F.lit(1000.0)))
    s = df.select("frame_id", "p", F.sort_array(h).alias("h")).where(F.size("h") > 0)
    mean = lambda c: r9(A.summary(F.transform("p", lambda p: p[c]))["mean"])
    return s.select("frame_id", r9(A.summary(F.col("h"))["mean"]).alias("mean_height"), r9(A.quantile_of_sorted(F.col("h"), 0.95)).alias("p95_height"), mean("x").alias("mean_x"), mean("y").alias("mean_y"))


def _tri(a: str, b: str, c: str) -> str:
    hi, lo = (f"{f}({a}.z, {b}.z, {c}.z)" for f in ("greatest", "least"))
    flat = f"abs(({b}.cx - {a}.cx) * ({c}.cy - {a}.cy) - ({b}.cy - {a}.cy) * ({c}.cx - {a}.cx)) / 2"
    return f"CASE WHEN {hi} - {lo} <= greatest(35.0, 0.03 * ({a}.z + {b}.z + {c}.z - {hi} - {lo})) AND 2 * ({flat}) > 1e-8 THEN {flat} END"


@query(f"""WITH {_XYZ}, cells AS (SELECT a.frame_id, (a.cx - d.cx) ** 2 + (a.cy - d.cy) ** 2 + (a.z - d.z) ** 2 <= (b.cx - c.cx) ** 2 + (b.cy - c.cy) ** 2 + (b.z - c.z) ** 2 AS main,
  {_tri('a', 'b', 'd')} AS t1, {_tri('a', 'd', 'c')} AS t2, {_tri('a', 'b', 'c')} AS t3, {_tri('b', 'd', 'c')} AS t4
  FROM z a JOIN z b ON a.frame_id = b.frame_id AND b.x = a.x + 1 AND b.y = a.y JOIN z c ON a.frame_id = c.frame_id AND c.x = a.x AND c.y = a.y + 1 JOIN z d ON a.frame_id = d.frame_id AND d.x = a.x + 1 AND d.y = a.y + 1),
tri AS (SELECT frame_id, unnest(CASE WHEN main THEN [t1, t2] ELSE [t3, t4] END) AS t FROM cells)
SELECT frame_id, round(coalesce(sum(t), 0), 9) AS projected_area, count(t) AS n_triangles FROM tri GROUP BY frame_id""")
def q_mesh_area(spark, d):
    m = R.cell_area(F.col("depth"), SIDE, SIDE, 600.0, 600.0, 4.0, 4.0)
    return _depth(spark, d).withColumn("m", m).select("frame_id", r9(F.col("m.projected_area")).alias("projected_area"), "m.n_triangles")


@query(f"""WITH {_XYZ}, s AS (SELECT frame_id, sum(cx * cx) sxx, sum(cx * cy) sxy, sum(cy * cy) syy, sum(cx) sx, sum(cy) sy, sum(cx * z) sxz, sum(cy * z) syz, sum(z) sz, count(*)::DOUBLE n FROM z GROUP BY frame_id),
t AS (SELECT *, sxx * (syy * n - sy * sy) - sxy * (sxy * n - sy * sx) + sx * (sxy * sy - syy * sx) AS det FROM s)
SELECT frame_id, round((sxz * (syy * n - sy * sy) - sxy * (syz * n - sy * sz) + sx * (syz * sy - syy * sz)) / det, 4) + 0.0 AS a,
  round((sxx * (syz * n - sy * sz) - sxz * (sxy * n - sy * sx) + sx * (sxy * sz - syz * sx)) / det, 4) + 0.0 AS b,
  round((sxx * (syy * sz - syz * sy) - sxy * (sxy * sz - syz * sx) + sxz * (sxy * sy - syy * sx)) / det, 4) + 0.0 AS c, n::BIGINT AS n FROM t""")
def q_soil_plane_ls(spark, d):
    at = F.transform("depth", lambda z, i: F.struct(*(c.alias(n) for n, c in zip("xyz", P.deproject(i % SIDE, F.floor(i / SIDE), z, 600.0, 600.0, 4.0, 4.0)))))
    points = _depth(spark, d).select("frame_id", F.inline(at))
    r4 = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return R.plane_least_squares(points, ["frame_id"]).select("frame_id", r4("a"), r4("b"), r4("c"), "n")


@query("""WITH p AS (SELECT vec_id AS frame_id, i, 10 * embedding[2 * i + 1]::DOUBLE AS x, 10 * embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, range(32) t(i))
SELECT a.frame_id, round(abs(sum(a.x * b.y - a.y * b.x)) / 2, 9) AS area FROM p a JOIN p b ON a.frame_id = b.frame_id AND b.i = (a.i + 1) % 32 GROUP BY a.frame_id""")
def q_polygon_area(spark, d):
    even = F.transform(F.filter("e", lambda v, i: i % 2 == 0), lambda v: 10 * v)
    odd = F.transform(F.filter("e", lambda v, i: i % 2 == 1), lambda v: 10 * v)
    return frames(spark, d).select("frame_id", r9(P.shoelace(even, odd)).alias("area"))


# --- sequences of frames ---------------------------------------------------------------------


@query(f"""WITH {PX}, f AS (SELECT frame_id, list(CASE WHEN frame_id % 2 = 0 THEN e END ORDER BY i) AS fwd, list(e1 ORDER BY i) AS bwd FROM px GROUP BY frame_id)
SELECT frame_id, round(sum(CASE WHEN frame_id % 2 = 0 AND frame_id % 3 = 0 THEN (e + e1) / 2 WHEN frame_id % 2 = 0 THEN e ELSE e1 END), 9) + 0.0 AS total FROM px WHERE frame_id % 2 = 0 OR frame_id % 3 = 0 GROUP BY frame_id""")
def q_bidirectional_merge(spark, d):
    from ..operators.sequence import merge_directions

    f = frames(spark, d)
    forward = f.where("frame_id % 2 = 0").select("frame_id", F.col("e").alias("logits"))
    backward = f.where("frame_id % 3 = 0").select("frame_id", rolled(F.col("e"), 1).alias("logits"))
    return merge_directions(forward, backward, ["frame_id"]).select("frame_id", r9(A.total(F.col("logits"))).alias("total"))


@query(f"""WITH {PX}, a AS (SELECT frame_id, count(*) FILTER (WHERE e > 0.4) AS fa, count(*) FILTER (WHERE e1 > 0.3) AS ba FROM px GROUP BY frame_id)
SELECT frame_id, CASE WHEN fa > 0 THEN fa WHEN frame_id % 2 = 0 THEN ba ELSE 0 END AS area FROM a""")
def q_merge_masks(spark, d):
    fwd = F.transform("e", lambda v: v > 0.4)
    bwd = F.when(F.col("frame_id") % 2 == 0, F.transform(rolled(F.col("e"), 1), lambda v: v > 0.3))
    return frames(spark, d).select("frame_id", A.count_true(R.merge_bidirectional(fwd, bwd, 64)).alias("area"))
