"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of characters that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a table up to which its rows are dealt to all cores: so little often lies in one row group, which one task reads.
ONE_SPLIT = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= ONE_SPLIT else df


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset, on one machine only, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="canopyframe-checkpoint-"))
    return sc.getCheckpointDir()


#: Bits of a table's estimated size beyond which the estimate is let go.
ESTIMATE_BITS = 256


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage."""
    spark = df.sparkSession
    _checkpoint_folder(spark)
    cut = df.checkpoint()
    # a checkpoint inherits the size estimated for its plan, joins multiply sizes: in a loop its digits double each round
    plan = cut._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes().bit_length() > ESTIMATE_BITS:
        cut = DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.rdd(), cut._jdf.schema(), False), spark)
    return cut


#: Bytes of a written table up to which no garbage is collected behind it.
SMALL_TABLE = 4 << 20


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: columns can be pruned, unlike those of a checkpoint.

    The table is deleted when the session's JVM ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{_checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(place)
    # what led here is garbage once the frame is let go; collecting it now lets the driver drop its
    # shuffle files before the next phase writes its own (little is behind a small table)
    del df
    for _ in range(2 if store.getContentSummary(place).getLength() > SMALL_TABLE else 0):  # the second finds what the first has cut loose
        gc.collect()
        jvm.System.gc()
        time.sleep(0.2)
    return spark.read.schema(schema).parquet(path)


#: Keys that hold over a 10,000th of all rows, and HOT_ROWS at least, are dealt over several tasks: there are 10,000 of them at most.
HOT_KEYS, HOT_ROWS = 10_000, 200


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row per key and says in ``n`` how many rows of ``left`` have it (about ``total`` in all).

    The rows of a hot key are dealt by a hash of their columns ``by`` and meet a
    copy of its row each; which keys are hot is sent to every task.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    salts, salt = free_name(left, "_salts"), free_name(left, "_salt")
    shares = F.ceil(F.col(n) / least)
    hot = right.where(F.col(n) > least).select(*keys, shares.alias(salts))
    marked = left.join(F.broadcast(hot), keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*by), F.col(salts)), F.lit(0))).drop(salts)
    copies = F.when(F.col(n) > least, F.sequence(F.lit(0).cast("long"), shares - 1)).otherwise(F.array(F.lit(0).cast("long")))
    return marked.join(right.withColumn(salt, F.explode(copies)), [*keys, salt], how).drop(salt)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of words; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, used together as one 128-bit key."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)
