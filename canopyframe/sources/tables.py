"""Table scans and sinks: manifests, sensor logs, calibrations, configuration, run results."""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (a byte-order mark is dropped), or JSON: a list of rows or ``{"frames": [...]}``."""
    if path.lower().endswith(".json"):
        raw = spark.read.option("multiLine", "true").json(path)
        return raw.select(F.explode("frames").alias("f")).select("f.*") if raw.columns == ["frames"] else raw
    df = spark.read.option("header", "true").csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read_sensor_log(log: DataFrame, columns: dict[str, str], timestamp: str = "timestamp") -> DataFrame:
    """Rename (new name to old), cast all but the timestamp to numbers (unreadable ones are null); a missing column is an error."""
    absent = sorted(set(columns.values()) - set(log.columns))
    if absent:
        raise ValueError(f"sensor log lacks the columns {absent}")
    if timestamp not in columns:
        raise ValueError("sensor log needs a timestamp")
    cast = lambda new, old: (F.col(old).try_cast("timestamp_ntz") if new == timestamp else F.col(old).try_cast("double")).alias(new)
    return log.select(*(cast(new, old) for new, old in columns.items()))


def read_workbook(spark: SparkSession, path: str, columns: dict[str, str], timestamp: str = "timestamp") -> DataFrame:
    """A sensor log from CSV, parquet or (where openpyxl is installed) a workbook."""
    if path.lower().endswith((".xlsx", ".xls")):
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise ValueError("reading workbooks needs openpyxl") from e
        import pandas as pd

        return read_sensor_log(spark.createDataFrame(pd.read_excel(path).astype(str)), columns, timestamp)
    log = spark.read.parquet(path) if path.lower().endswith(".parquet") else spark.read.option("header", "true").csv(path)
    return read_sensor_log(log, columns, timestamp)


def intrinsics(text: Column, width: int, height: int) -> Column:
    """struct(width, height, fx, fy, cx, cy) of the colour camera at a resolution, from a calibration document; null if absent."""
    path = f"$.results_by_resolution['{width}x{height}'].attempts[0].resolved_streams.color.resolved.intrinsics"
    get = lambda k: F.get_json_object(text, f"{path}.{k}").cast("double")
    return F.when(get("fx").isNotNull(), F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), get("fx").alias("fx"), get("fy").alias("fy"), get("ppx").alias("cx"), get("ppy").alias("cy")))


def overlay(cls, defaults: dict | None = None, presets: dict[str, dict] | None = None, preset: str | None = None, **changes):
    """A configuration: class defaults, file values, preset, then explicit changes; unknown keys are ignored, an unknown preset is an error."""
    if preset is not None and preset not in (presets or {}):
        raise KeyError(f"unknown preset {preset}")
    merged = (defaults or {}) | ((presets or {}).get(preset, {}) if preset else {}) | changes
    known = {f.name for f in dataclasses.fields(cls)}
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in merged.items() if k in known})


def load_config(cls, path: str | None = None, preset: str | None = None, block: str | None = None):
    """Configuration from a JSON or YAML file with optional ``presets``; its values are at the top, or in a ``block``."""
    if path is None:
        if preset is not None:
            raise FileNotFoundError("a preset needs a configuration file")
        return cls()
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        import yaml

        data = yaml.safe_load(text) or {}
    values = data.get(block, {}) if block else {k: v for k, v in data.items() if k != "presets"}
    return overlay(cls, values, data.get("presets"), preset)


def check_prompts(prompts: DataFrame, width: int = 640, height: int = 480) -> DataFrame:
    """The prompts (prompt_type, box, points, point_labels), failing on a box or point outside the frame or unmatched labels."""
    b = F.col("box")
    box_ok = b.isNull() | ((F.size(b) == 4) & (b[0] >= 0) & (b[1] >= 0) & (b[2] <= width) & (b[3] <= height) & (b[0] < b[2]) & (b[1] < b[3]))
    points_ok = F.col("points").isNull() | F.forall("points", lambda p: (F.size(p) == 2) & (p[0] >= 0) & (p[0] < width) & (p[1] >= 0) & (p[1] < height))
    labels_ok = F.coalesce(F.size("points"), F.lit(-1)) == F.coalesce(F.size("point_labels"), F.lit(-1))
    kinds_ok = F.col("point_labels").isNull() | F.forall("point_labels", lambda v: v.isin(0, 1))
    given = b.isNotNull() | (F.coalesce(F.size("points"), F.lit(0)) > 0)
    good = box_ok & points_ok & labels_ok & kinds_ok & given
    return prompts.withColumn("prompt_type", F.when(good, F.col("prompt_type")).otherwise(F.raise_error(F.lit("invalid prompt"))))


def union_rows(*tables: DataFrame) -> DataFrame:
    """Rows of tables with differing columns; absent values are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_csv(rows: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header; null is an empty field."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.mode(mode).option("header", "true").option("emptyValue", "").csv(path)


def write_run(tables: dict[str, DataFrame], path: str, partition: Sequence[str] = (), mode: str = "error") -> None:
    """Results of a run, one parquet table each, partitioned where a table has the columns."""
    for name, t in tables.items():
        by = [c for c in partition if c in t.columns]
        w = t.write.mode(mode)
        (w.partitionBy(*by) if by else w).parquet(f"{path}/{name}")


def write_files(rows: DataFrame, root: str, name: str = "name", content: str = "content") -> int:
    """One file per row: ``name`` below ``root`` (a path or a URI that Arrow knows), holding the bytes of ``content``; how many were written.

    A file appears whole, under its name, once written; a task that runs again writes the same again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for n, c in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                place = f"{base}/{n}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                partial = f"{place}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(partial) as f:
                    f.write(c or b"")
                store.move(partial, place)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    written = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def publish(rows: DataFrame, path: str, flag: str = "qc_flag") -> None:
    """Fail-closed sink: nothing is published if any row failed its checks.

    The rows are written aside, checked as written, and only then moved into place.
    """
    spark = rows.sparkSession
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}.part"
    rows.write.parquet(aside)
    jvm = spark.sparkContext._jvm
    here, there = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(path)
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        if not spark.read.parquet(aside).where(F.col(flag) == "FAIL").isEmpty():
            raise ValueError("a frame failed its checks; nothing was published")
        if store.exists(there) or not store.rename(here, there):
            raise FileExistsError(f"{path} exists already")
    finally:
        if store.exists(here):
            store.delete(here, True)
