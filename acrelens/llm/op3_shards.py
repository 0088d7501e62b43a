"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

In a uniform random permutation the number of rows that go from a partition to a shard follows the
multivariate hypergeometric law. So the driver draws that matrix once (partitions x shards, independent
of the number of rows), each partition permutes its rows and deals them out by its row of the matrix,
and each shard permutes what it received.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelens.llm.shared import settle, table

SEED = 20261128
LANES = 64  # of each shard in the second permutation


def communication_matrix(rows: list[int], shards: list[int], seed: int = SEED) -> np.ndarray:
    """Counts from partition to shard: row sums `rows`, column sums `shards`, as a uniform permutation has them."""
    rng, left, out = np.random.default_rng(seed), np.array(shards, np.int64), []
    for n in rows:
        drawn = rng.multivariate_hypergeometric(left, n, method="marginals") if n else np.zeros_like(left)
        left, _ = left - drawn, out.append(drawn)
    return np.array(out, np.int64).reshape(len(rows), len(shards))


def shuffle_into_shards(rows: DataFrame, key_cols: list[str], shards: int = 40, seed: int = SEED, rows_per_partition: int = 20_000, most_partitions: int = 4096) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard): a uniform random permutation.

    Shard sizes are at most one apart. All randomness comes from hashes of `key_cols` and `seed`, so a task
    that is run again deals its rows alike; rows that agree in every key column are interchangeable. Nulls
    hash like any value. An empty table gives no rows. The matrix has at most most_partitions x shards
    entries. Columns of `rows` named shard or slot give way. No shard is sorted in one task: a shard has LANES lanes by the leading bits of the second
    random key, whose sizes give each lane its first slot.
    """
    spark, plain = rows.sparkSession, [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    key_cols = [f"row.{c}" for c in key_cols]
    draw = lambda salt: F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in key_cols], F.lit(seed + salt))
    total = rows.count()
    parts = int(min(most_partitions, max(16, -(-total // rows_per_partition))))
    rows = rows.withColumn("_part", F.pmod(draw(0), F.lit(parts)).cast("int"))
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    per_shard = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([sizes.get(p, 0) for p in range(parts)], per_shard, seed).cumsum(1)
    dealt = spark.createDataFrame([(p, m.tolist()) for p, m in enumerate(matrix)], "_part int, _upto array<long>")
    own = Window.partitionBy("_part").orderBy(draw(1), *key_cols)
    first = rows.withColumn("_at", F.row_number().over(own)).join(F.broadcast(dealt), "_part")
    first = first.withColumn("shard", F.size(F.filter("_upto", lambda c: c < F.col("_at"))))
    first = first.withColumn("_second", draw(2)).withColumn("_lane", F.pmod(F.shiftrightunsigned("_second", 40), F.lit(LANES)).cast("int"))
    first = settle(first.drop("_part", "_upto", "_at"), "dealt")
    lanes = first.groupBy("shard", "_lane").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("shard", "_lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_from"))
    last = Window.partitionBy("shard", "_lane").orderBy("_second", *key_cols)
    out = first.withColumn("_at", F.row_number().over(last)).join(F.broadcast(lanes), ["shard", "_lane"])
    return out.select(*[F.col(f"row.`{c}`") for c in plain], "shard", (F.col("_from") + F.col("_at") - 1).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32("text").alias("text_crc32")
    )
    out = shuffle_into_shards(docs, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
