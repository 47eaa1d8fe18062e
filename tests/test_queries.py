"""Every query with an SQL equivalent gives exactly its rows on the smallest tables."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from canopyframe.plans import catalog

DATA = "/root/testdata/sf0.001"


def both(spark, query, sql):
    df = query(spark, DATA)
    order = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in order)).collect()), key=repr)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == order
    at = [names.index(c) for c in order]
    return got, sorted((tuple(r[i] for i in at) for r in out.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    got, want = both(spark, catalog.QUERIES[name], catalog.ORACLES[name])
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    rows = catalog.QUERIES[name](spark, DATA)
    got = rows.collect()
    assert got and all(r[c] is None for r in got for c in rows.columns if c == "error" or c.endswith("_error") and c != "layer_error")


def values(spark, name):
    return catalog.QUERIES[name](spark, DATA).toPandas()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are absent")
def test_queries_without_sql_show_their_operators(spark):
    """Every outcome that an operator can have occurs in its query."""
    rim = values(spark, "q_pot_rim_rows")
    assert (rim.removed_px > 0).any() and (rim.preserved_px > 0).any() and (rim.suspicious == 0).any() and (rim.area - rim.cleaned_area == rim.removed_px).all()
    height = values(spark, "q_plant_height_rows")
    assert height.geometry_qc_pass.any() and height.mean_canopy_height_mm.between(60, 180).all() and (height.native_depth_fraction == 1.0).all()
    cleaned = values(spark, "q_segment_cleanup_rows")
    assert {"reference_positive", "anchor_overlap"} <= set(cleaned.support_mode)
    surface = values(spark, "q_visible_surface_rows")
    assert (surface.visible_surface_area > 0).all() and surface.normal_support.between(0, 1).all() and (surface.capped_fraction > 0).any()
    contrast = values(spark, "q_stress_contrast_rows")
    assert set(contrast.scope) == {"all", "lit", "dark"} and (contrast.boot_ci_low <= contrast.boot_ci_high).sum() > 0 and contrast.p_positive.dropna().between(0, 1).all()
    screen = values(spark, "q_driver_screen_rows")
    assert set(screen.kind) == {"level", "change"} and (screen.q.dropna() >= screen.p_value[screen.q.notna()] - 1e-12).all()


def test_frame_queries_do_not_shuffle(spark):
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are absent")
    for name in ("q_canopy_temperature", "q_threshold_ladder", "q_mask_iou", "q_boundary_f1", "q_shape_moments"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan, name


def test_slow_kernels_run_on_all_cores(spark):
    """A file of one row group is one task; frames that take milliseconds each are dealt."""
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables are absent")
    for name in ("q_plant_height_rows", "q_canopy_geometry", "q_visible_surface_rows", "q_pot_rim_rows"):
        assert catalog.QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def write_frames(folder, rows, kind=pa.float32()):
    """An embeddings table of vectors of 64 values."""
    ids = list(range(len(rows)))
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(kind)), "label": pa.array(ids, pa.int32())}), folder / "embeddings.parquet")


def agrees(spark, name, folder):
    """The query's rows, which are those of its SQL."""
    got = catalog.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]}) ORDER BY 1").fetchall()
    rows = [tuple(r) for r in got.orderBy(got.columns[0]).collect()]
    assert rows == want
    return rows


def test_canopy_geometry_of_masks_without_a_mesh(spark, tmp_path):
    board = [0.1 + i / 1000 if (i + i // 8) % 2 == 0 and i // 8 % 2 == 0 else -0.1 for i in range(64)]
    one = [0.3 if i == 20 else -0.1 for i in range(64)]
    write_frames(tmp_path, [board, one, [-0.1] * 64, [0.2 + i / 500 for i in range(64)], None])
    assert [r[0] for r in agrees(spark, "q_canopy_geometry", tmp_path)] == [0, 1, 3]


@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_layer_overlap_at_the_limits(spark, tmp_path, kind):
    """A value equal to a limit in its own precision is neither above nor below it."""
    limits = [-0.15, -0.1, 0.1, 0.15]
    rows = [[limits[(i + k) % 4] if i % 3 == 0 else 0.02 * (i % 17) - 0.16 for i in range(64)] for k in range(4)]
    write_frames(tmp_path, [*rows, [limits[0]] * 64, [limits[2]] * 32 + [limits[3]] * 32, [None, float("nan"), *rows[0][2:]], None], kind)
    assert len(agrees(spark, "q_layer_overlap", tmp_path)) == 8
