"""Surrogate keys and keep-first de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wicketlake.session import ensure_checkpoint_dir


def dense_index(df: DataFrame, order: list[str], name: str, start: int = 1,
                partitions: int | None = None) -> DataFrame:
    """Consecutive numbers ``start..start+n-1`` in the order of ``order``
    (which must be a total order), without a single-partition window.

    Rows are range-partitioned on the order key, numbered inside their range
    partition, and shifted by the row count of all earlier partitions. Range
    bounds are sampled, so two runs of the same partitioning may differ: its
    output, with the partition of each row, is checkpointed once, and both the
    numbers and the partition sizes are read from there. The offset table has
    one row per partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (local.join(offsets, "_pid")
            .withColumn(name, (F.col("_off") + F.col("_local") + (start - 1)).cast("long"))
            .drop("_pid", "_local", "_off"))


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key, the first by ``order`` (a deterministic
    tiebreak); planned as a per-key window, so work splits by key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
