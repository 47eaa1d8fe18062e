"""Bindings of tables to rasters: an embedding row is an 8 by 8 frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIDE, PIXELS = 8, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of frames in a task where a kernel takes milliseconds a frame, and most tasks.
DEALT, MOST_TASKS = 128 << 10, 10_000


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a scan in many small tasks: files of one row group are one task, whatever the number of cores."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, size // DEALT)))


def frames(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    """frame_id, label, e (64 doubles), mask (e > 0), temp, ambient; ``deal`` for slow kernels."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return (
        (dealt(rows) if deal else rows).select(F.col("vec_id").alias("frame_id"), "label", e.alias("e"))
        .withColumn("mask", F.transform("e", lambda v: v > 0)).withColumn("temp", F.transform("e", lambda v: 25 + 5 * v)).withColumn("ambient", 20 + F.col("label") / 10)
    )


def rolled(c: Column, k: int) -> Column:
    """Array rotated so that place i holds the value of place i + k."""
    return F.concat(F.slice(c, k + 1, PIXELS), F.slice(c, 1, k))


def channels(df: DataFrame) -> DataFrame:
    level = F.transform("e", lambda v: F.floor(255 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), v + 0.5))).cast("double"))
    return df.withColumn("r", level).withColumn("g", rolled(F.col("r"), 21)).withColumn("b", rolled(F.col("r"), 42))


def bands(df: DataFrame) -> DataFrame:
    base = F.transform("e", lambda v: 0.05 + F.abs(v))
    out = df.withColumn("b555", base)
    for nm, k in ((660, 16), (720, 32), (840, 48)):
        out = out.withColumn(f"b{nm}", rolled(F.col("b555"), k))
    return out


def logits(df: DataFrame) -> DataFrame:
    return df.withColumn("logits", F.transform("e", lambda v: v - 0.3 - 0.5 * F.col("label")))


def r9(c: Column) -> Column:
    """Rounded for comparison across engines; no negative zero."""
    return F.round(c * 1e9) / 1e9 + F.lit(0.0)


def r9_of(path: str, name: str) -> Column:
    """The same of a column or field by its path; one expression, for queries with very many."""
    return F.expr(f"round({path} * 1e9D) / 1e9D + 0.0D AS {name}")


PX = """px AS (
  SELECT vec_id AS frame_id, label, i, i // 8 AS y, i % 8 AS x, embedding[i + 1]::DOUBLE AS e, embedding[(i + 1) % 64 + 1]::DOUBLE AS e1,
    embedding[(i + 16) % 64 + 1]::DOUBLE AS e16, embedding[(i + 21) % 64 + 1]::DOUBLE AS e21, embedding[(i + 32) % 64 + 1]::DOUBLE AS e32,
    embedding[(i + 42) % 64 + 1]::DOUBLE AS e42, embedding[(i + 48) % 64 + 1]::DOUBLE AS e48
  FROM embeddings, range(64) t(i)
)"""


def sql_stats(value: str, prefix: str = "", where: str = "TRUE") -> str:
    """The six statistics of the library's summary."""
    f = f"FILTER (WHERE {where})"
    p = prefix
    return f"""round(median({value}) {f}, 9) + 0.0 AS {p}median, round(avg({value}) {f}, 9) + 0.0 AS {p}mean, round(quantile_cont({value}, 0.1) {f}, 9) + 0.0 AS {p}p10,
      round(quantile_cont({value}, 0.9) {f}, 9) + 0.0 AS {p}p90, round(stddev_pop({value}) {f}, 9) + 0.0 AS {p}std, count({value}) {f} AS {p}n"""


def stat_fields(path: str, prefix: str = "") -> list[Column]:
    """The rounded statistics of a struct by its path."""
    return [*(r9_of(f"{path}.{k}", f"{prefix}{k}") for k in ("median", "mean", "p10", "p90", "std")), F.expr(f"{path}.n AS {prefix}n")]


def stat_columns(s: Column, prefix: str = "") -> list[Column]:
    return [*(r9(s[k]).alias(f"{prefix}{k}") for k in ("median", "mean", "p10", "p90", "std")), s["n"].alias(f"{prefix}n")]
