"""What the operators of this subpackage share: shared storage, hot keys, shipping code to Python workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import let as let
from palimpsest.shipping import ship as ship

#: Keys a "hot" side may hold, and keys that the sketch which finds them tracks: a key outside the hot ones has fewer
#: than 1/HOT_KEYS of all rows.
HOT_KEYS, TRACKED = 1000, 20_000
#: Rows of a side that is broadcast, counted before.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one of this machine, which
    is right for a local master only; on any other it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_unevenly(left: DataFrame, right: DataFrame, key: str, n: str | None, spread: Column) -> DataFrame:
    """left LEFT JOIN right USING (key), without right's column n, for a left side where few keys may hold most rows.

    right has one row per key, and is read twice: a written table, or cheap. A sketch of fixed size finds the most frequent keys of left, whether right has them or
    not; their rows of right, at most HOT_KEYS, are broadcast. The others, each under 1/HOT_KEYS of the left rows, are
    joined by a shuffle, in which the rows of hot keys and those without a key are dealt out by `spread`.
    """
    cols = [c for c in right.columns if c not in (key, n)]
    known = F.col(key).isNotNull()
    top = left.filter(known).select(F.xxhash64(key).alias("h")).agg(F.expr(f"approx_top_k(h, {HOT_KEYS}, {TRACKED})").alias("top"))
    # written, as a sketch of the same rows in another order may differ
    hot = written(top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("__hot")), "hot")
    of_hot = right.join(F.broadcast(hot), F.xxhash64(key) == F.col("__hot"))
    of_hot = hot.join(of_hot.select(F.col("__hot").alias("__same"), F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in cols]), F.col("__hot") == F.col("__same"), "left").drop("__same")
    out = left.join(F.broadcast(of_hot), (F.xxhash64(key) == F.col("__hot")) & F.coalesce(F.col("__key") == F.col(key), known), "left")
    salt = F.when(F.col("__hot").isNotNull() | ~known, F.xxhash64(spread)).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("__h", F.xxhash64(key, salt)).drop("__hot", "__key")
    # a hash of the key and the salt on both sides: an equality with the salt alone, a constant on the right, would be taken out of the join's keys
    cold = right.join(F.broadcast(hot), F.xxhash64(key) == F.col("__hot"), "left_anti")
    cold = cold.select(F.col(key).alias("__key"), F.xxhash64(key, F.lit(0).cast("long")).alias("__cold"), *[F.col(c).alias(f"__cold_{c}") for c in cols])
    out = out.join(cold, (F.col(key) == F.col("__key")) & (F.col("__h") == F.col("__cold")), "left")
    return out.select(*left.columns, *[F.coalesce(F.col(f"__{c}"), F.col(f"__cold_{c}")).alias(c) for c in cols])


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it if it has at most BROADCAST_ROWS rows; otherwise as it is, for a shuffle.

    df should be a written table or cheap to count.
    """
    return F.broadcast(df) if _is_small(df) else df


def join_by_size(left: DataFrame, right: DataFrame, key: str, n: str | None, spread: Column) -> DataFrame:
    """left LEFT JOIN right USING (key), without n: by a broadcast if right, a written table, is small, and otherwise
    by join_unevenly(), so that no key's rows meet in one task."""
    return left.join(F.broadcast(right.drop(n) if n else right), key, "left") if _is_small(right) else join_unevenly(left, right, key, n, spread)


def _is_small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
