"""Tables that are kept up to date batch by batch: merges, derived frames, and cycles that appear whole or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import resample
from ..sources.shared import saved

#: Column of stored rows: the number of the batch that wrote them.
VERSION = "version"


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table under ``path``, or None before its first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def touched(spark: SparkSession, path: str, batch: DataFrame, part: str) -> DataFrame | None:
    """Stored rows of the partitions that a batch touches: a value a partition goes through the driver, and prunes the scan."""
    there = stored(spark, path)
    return there if there is None else there.where(F.col(part).isin([r[0] for r in batch.select(part).distinct().collect()]))


def overwrite(rows: DataFrame, path: str, part: str, keys: list[str], file_rows: int = 1_000_000) -> None:
    """Replace the partitions that ``rows`` have, and no others. Rows are saved first, as they may come from the same partitions.

    A partition is written by as many tasks, by a hash of ``keys``, as keep each to about ``file_rows`` rows of the whole.
    """
    merged = saved(rows, "merged")
    salts = -(-merged.count() // file_rows)
    dealt = [F.col(part), F.pmod(F.xxhash64(*keys), F.lit(salts))] if salts > 1 else [F.col(part)]
    merged.repartition(*dealt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def merge_into(path: str, batch: DataFrame, batch_id: int, keys: list[str], part: str, enrich: bool = False) -> None:
    """Merge a batch into the table under ``path``, partitioned by ``part``: of each key the row of the greatest batch stays.

    ``enrich``: stored values stay, and only their nulls are filled. A batch has
    one row a key. Only partitions that the batch touches are read and written.
    The same batch again, whole or after a failure, gives the same table.
    """
    spark = batch.sparkSession
    both = batch.withColumn(VERSION, F.lit(batch_id).cast("long"))
    before = touched(spark, path, batch, part)
    if before is not None:
        both = before.select(*both.columns).unionByName(both)
    group = list(dict.fromkeys([*keys, part]))
    others = [c for c in both.columns if c not in group]
    if enrich:
        got = both.groupBy(*group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(VERSION))).alias(c) if c != VERSION else F.min(VERSION).alias(VERSION) for c in others])
    else:
        got = both.groupBy(*group).agg(F.max_by(F.struct(*others), VERSION).alias("_row")).select(*group, "_row.*")
    overwrite(got, path, part, keys)


def merge_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], part: str, reduce: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append", enrich: bool = False):
    """Start a stream whose batches are merged into a table, over what is there: late rows correct it, a repeated batch changes nothing.

    ``reduce`` brings a batch to one row a key. A batch is saved before it is
    merged, which reads it several times: its states are worked out once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_into(path, saved(reduce(batch) if reduce else batch, "batch"), batch_id, keys, part, enrich)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def refresh_frames(path: str, batch: DataFrame, batch_id: int, source: int, target: int, key: str = "symbol", part_seconds: int = 30 * 86400, valid_only: bool = True) -> None:
    """Merge bars of ``source`` seconds into ``path/bars`` and bring ``path/frames``, bars of ``target`` seconds, up to date.

    Only buckets that have a bar in the batch are made anew, in a steady state the
    last two of each key, and only their partitions are written. A bucket that is
    not complete, or not any more, is kept as a row that says so:
    :func:`frames` reads the others. ``valid_only``: bars that are not valid count as missing.
    """
    spark = batch.sparkSession
    bucket = F.col("ts") - F.pmod("ts", F.lit(target))
    parted = lambda df: df.withColumn("part", F.floor((F.col("ts") - F.pmod("ts", F.lit(target))) / part_seconds).cast("int"))
    bars = saved(parted(batch), "bars")
    merge_into(f"{path}/bars", bars, batch_id, [key, "ts"], "part")
    changed = saved(bars.select(key, bucket.alias("ts"), "part").distinct(), "changed")
    now = touched(spark, f"{path}/bars", bars, "part").withColumn("_bucket", bucket)
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_ts"))
    of = changed.select(F.col(key).alias("_k"), F.col("ts").alias("_ts"))
    whole = resample(now.join(of, same, "left_semi").drop("_bucket"), source, target, key, valid_only).withColumnsRenamed({key: "_k", "ts": "_ts"})
    made = changed.join(whole, F.col(key).eqNullSafe(F.col("_k")) & (F.col("ts") == F.col("_ts")), "left")
    merge_into(f"{path}/frames", made.select(key, "ts", "part", "open", "high", "low", "close", "volume"), batch_id, [key, "ts"], "part")


def frames(spark: SparkSession, path: str) -> DataFrame:
    """The complete bars that :func:`refresh_frames` keeps."""
    return spark.read.parquet(f"{path}/frames").where("open is not null").drop("part", VERSION)


def commit_cycle(path: str, cycle: int, tables: dict[str, DataFrame]) -> None:
    """Write a cycle's rows of several tables, then the manifest that makes them visible together.

    A cycle that failed on the way has no manifest: readers never see its rows,
    and the cycle may be written again.
    """
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}/cycle={cycle}")
    spark.range(1).select(F.lit(sorted(tables)).alias("tables")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/cycle={cycle}")


def committed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Rows of a table from all cycles that have a manifest, with their ``cycle``; None before the first."""
    manifest = stored(spark, f"{path}/manifest")
    if manifest is None:
        return None
    done = manifest.where(F.array_contains("tables", name)).select("cycle").distinct()
    there = stored(spark, f"{path}/{name}")
    return there if there is None else there.join(done, "cycle", "left_semi")


def newest_state(spark: SparkSession, path: str, name: str, keys: list[str], order: str) -> DataFrame | None:
    """The newest committed row of each key: greatest cycle, then ``order``."""
    rows = committed(spark, path, name)
    if rows is None:
        return None
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("cycle", order)).alias("_row")).select(*keys, "_row.*")


def recommendation_cycle(path: str, cycle: int, rows: DataFrame, keys: list[str], material: list[str], due: Column) -> None:
    """One cycle of recommendations: the rows themselves, latest states that are new or materially changed, an audit of these changes, and labels to make.

    ``material`` are the columns whose change counts; ``due`` gives the time of a
    row's label (null: none). All four tables appear at once.
    """
    spark = rows.sparkSession
    batch = saved(rows, "cycle")
    before = newest_state(spark, path, "state", keys, "ts")
    if before is None:
        changed = batch.withColumn("_was", F.lit(None).cast(f"struct<{', '.join(f'{c}: {batch.schema[c].dataType.simpleString()}' for c in material)}>"))
    else:
        old = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*material).alias("_was"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        changed = batch.join(old, same, "left").where(~F.struct(*material).eqNullSafe(F.col("_was"))).drop(*[f"_k{i}" for i in range(len(keys))])
    changed = saved(changed, "changed")
    audit = changed.select(*keys, "ts", F.col("_was").alias("was"), F.struct(*material).alias("now"), F.when(F.col("_was").isNull(), "created").otherwise("changed").alias("change"))
    labels = batch.select(*keys, "ts", due.alias("due_ts")).where("due_ts is not null")
    commit_cycle(path, cycle, {"recommendations": batch, "state": changed.drop("_was"), "audit": audit, "label_schedule": labels})


def outcome_cycle(path: str, cycle: int, outcomes: DataFrame, keys: list[str]) -> None:
    """Outcomes and the marks that their rows are labeled, together; a row labeled before is left as it is."""
    spark = outcomes.sparkSession
    fresh = outcomes
    before = committed(spark, path, "labeled")
    if before is not None:
        old = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        fresh = fresh.join(old, same, "left_anti")
    fresh = saved(fresh.dropDuplicates(keys), "outcomes")
    commit_cycle(path, cycle, {"outcomes": fresh, "labeled": fresh.select(*keys)})
