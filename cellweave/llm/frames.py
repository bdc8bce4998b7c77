"""Frames: materialised cuts of lineage and connected components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the context's checkpoint folder. In local mode, where the driver is the
    only machine, one is made when neither is set; on a cluster that is an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_to:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = f"{tempfile.gettempdir()}/cellweave-checkpoints"
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder, where column pruning pays."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that written() made and that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that are done with; Spark deletes them when the driver's JVM notices."""
    for _ in range(2):  # what the first round frees holds on to more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_in(rows: DataFrame, key: str, wanted: DataFrame, of: str, how: str = "left_semi", bits: int = 23) -> DataFrame:
    """The rows whose key (a long, null too) may be among the wanted; those whose key is none of them stay as far as they share no
    slot of a bitmap of 2**bits, which is all that is sent to them. With left_anti the other rows, none of whose keys is wanted."""
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits))
    marks = wanted.select(slot(of).alias("_s")).selectExpr("shiftright(_s, 6) as _word", "shiftleft(1L, cast(_s & 63 as int)) as _mark").groupBy("_word").agg(F.bit_or("_mark").alias("_marks"))
    on = (F.shiftright(slot(key), 6) == F.col("_word")) & (F.getbit("_marks", slot(key).bitwiseAND(F.lit(63)).cast("int")) == 1)
    return rows.join(F.broadcast(marks), on, how)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): rows (id, root), root the smallest id.

    Alternates large-star and small-star steps. A step groups by node with map-side partial minima and joins
    the minima back, so that a hub of any degree is a skewed join at worst, never a collected list. Every
    round is checkpointed; a sum of hashes tells when the edges stay as they are. Null ends and loops are
    dropped; no edges give no rows."""
    e = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(e.where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").union(down.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == seen:
            return e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root").union(
                e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            )
        seen = (now.n, now.h)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
