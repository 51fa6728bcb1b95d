"""Contiguous shards of near-equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import partitions, saved


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Cut all rows, in order of ``id_col``, into ``n_shards`` runs of equal bytes.

    Rows are range-partitioned once; each partition's byte and row totals are
    summed up (as many rows as partitions), so every row's global prefix is its
    partition's base plus a running sum within the partition. A row belongs to
    the shard in whose equal share of all bytes its first byte lies.

    Returns id_col, size, text_crc32, shard, slot (gapless from 0 in each shard).
    Null text: size ``overhead``, checksum of no bytes. Null ids come first;
    repeated ids keep one row each, ordered by checksum and size. A row larger
    than a share leaves the shards it covers empty. No rows give no rows; other
    columns of ``docs`` are not read.
    """
    n = partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.col(id_col), F.col("text_crc32"), F.col("size")]
    ranged = saved(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "shards")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("base_size"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("part_size").over(every).alias("all_size"),
    )
    here = Window.partitionBy("part").orderBy(*order)
    prefix = F.coalesce(F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (
        ranged.withColumn("prefix", prefix)
        .withColumn("nth", F.row_number().over(here))
        .join(F.broadcast(bases), "part")  # one row a partition
        .withColumn("start", F.col("base_size") + F.col("prefix"))
        .withColumn("rank", F.col("base_rows") + F.col("nth") - 1)
        .withColumn("shard", F.least(F.expr(f"cast(start * cast({n_shards} as decimal(10, 0)) div all_size as int)"), F.lit(n_shards - 1)))
    )
    firsts = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return placed.join(F.broadcast(firsts), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"))  # one row a shard
