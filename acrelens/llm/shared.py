"""Helpers that the corpus operators share: table reading, written tables in the shared folder, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`, through Spark's reader whatever the store is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only a local session without one gets a new temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='acrelens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it again.

    Cuts the lineage, so that a lost executor costs a reread and not the whole plan, and makes every
    later use see the same rows.
    """
    path = f"{shared_folder(df.sparkSession)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again.settled_at = path
    return again


def discard(df: DataFrame) -> None:
    """Delete a table written by settle() that nothing reads any more."""
    path = getattr(df, "settled_at", None)
    if path:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs whose results have been written and whose plans nothing holds any more.

    It does so when the driver collects garbage, which a driver with little to do puts off while disks fill.
    """
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a long, b long): rows (node, component), component the smallest node.

    Alternates large-star and small-star contraction. Both are a grouped minimum, which Spark combines
    before the shuffle, and an equi-join whose hot keys AQE splits; no neighbourhood is ever gathered in
    one task. Each round is written to the shared folder. Nodes without an edge to another node are
    absent. Null ends are ignored.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    now = settle(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _mark(now)
    for _ in range(20 + 4 * int(before[0]).bit_length()):  # far above the rounds that halving takes
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        after = settle(small.select("e.*").where("a != b").distinct(), "edges")
        mark = _mark(after)
        discard(now)
        now = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components() did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a checksum of them: equal marks mean that a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
