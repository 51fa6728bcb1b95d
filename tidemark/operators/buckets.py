"""Folds over a key's rows in order, a bucket at a time: state goes from bucket to bucket, so no task holds a whole key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

_AGGREGATES = {"sum": F.sum, "max": F.max, "min": F.min}


def keyed(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """``df`` with _kb, keys and bucket as one value that is never null: windows and joins on it share one shuffle, null keys too."""
    return df.withColumn("_kb", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], bucket.alias("bucket")))


def carried_on(x: DataFrame, order: list, values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """:func:`running` of a table that is :func:`keyed`; _kb stays."""
    w = Window.partitionBy("_kb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    names = {name: f"_base_{i}" for i, name in enumerate(values)}
    per_bucket = x.groupBy("_kb").agg(*[_AGGREGATES[kind](c).alias(names[name]) for name, (kind, c) in values.items()])
    key = F.col("_kb").dropFields("bucket") if len(x.schema["_kb"].dataType.names) > 1 else F.lit(0)
    earlier = Window.partitionBy(key).orderBy("_kb.bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(F.col("_kb").alias("_of"), *[_AGGREGATES[kind](names[name]).over(earlier).alias(names[name]) for name, (kind, _) in values.items()])
    columns = x.columns
    for name, (kind, c) in values.items():
        x = x.withColumn(name, _AGGREGATES[kind](c).over(w))
    joined = x.join(carried, F.col("_kb") == F.col("_of"))
    for name, (kind, _) in values.items():
        here, base = F.col(name), F.col(names[name])
        joined = joined.withColumn(name, F.coalesce(here, F.lit(0)) + F.coalesce(base, F.lit(0)) if kind == "sum" else (F.greatest if kind == "max" else F.least)(here, base))
    return joined.select(*columns, *values)


def running(df: DataFrame, keys: list[str], bucket: Column, order: list, values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """``df`` with running aggregates: ``values`` names them, each a kind (sum, max or min) and what it is of.

    Rows go by ``bucket``, which must rise with ``order``, then ``order``. What
    earlier buckets come to is found by a window over one row a bucket, the rest
    by a window in each bucket. Nothing before a row gives null (a sum: 0).
    """
    return carried_on(keyed(df, keys, bucket), order, values, inclusive).drop("_kb")


def _inside(part: pd.DataFrame, width: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows in order of key, bucket and ``at``, and for each the place of the row that it leads to; -1 where that is in another bucket, or nowhere."""
    keys = part["k"].map(repr) if part["k"].dtype == object else part["k"]  # struct keys come as dictionaries
    part = part.assign(group=part.groupby([keys, "bucket"], dropna=False).ngroup()).sort_values(["group", "at"]).reset_index(drop=True)
    base = (part["group"] - part["bucket"]).to_numpy(np.int64) * width
    places, to = part["at"].to_numpy(np.int64) + base, part["after"].fillna(-1).to_numpy(np.int64)
    stays = part["after"].notna().to_numpy() & (to // width == part["bucket"].to_numpy(np.int64))
    return part, np.where(stays, np.searchsorted(places, np.where(stays, to + base, 0)), -1)


def _exits(width: int):
    """For each row the first one on its way that lies outside the bucket: ways double until none leads on inside."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, inside = _inside(part, width)
        last = np.where(inside < 0, np.arange(len(part)), inside)
        while ((further := last[last]) != last).any():
            last = further
        return part[["k", "at", "after", "bucket"]].assign(exit=part["after"].iloc[last].reset_index(drop=True))

    return run


def _ways(width: int):
    """The rows of each bucket on the way from its entry, one step in all buckets at a time."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, inside = _inside(part, width)
        here, on = np.flatnonzero(part["at"] == part["entry"]), np.zeros(len(part), bool)
        while len(here):
            on[here] = True
            here = inside[here]
            here = here[here >= 0]
        return part.loc[on, ["k", "at"]]

    return run


def followed(links: DataFrame, key: str, width: int, unit_rows: int = 200_000) -> DataFrame:
    """key, at: the rows that each key's first one leads to, step by step.

    ``links`` has key, at (whole numbers, distinct in a key) and after: the next
    row's ``at``, greater than its own, or null at the end. In every bucket of
    ``width`` links are followed to where they leave it, all rows at once; of the
    few rows that are entered from outside, ways are doubled round by round, so
    rounds are logarithmic in the buckets; then each bucket marks its own way. A
    task takes the buckets of a hash, about ``unit_rows`` rows.
    """
    spark = links.sparkSession
    kind = links.schema[key].dataType.simpleString()
    x = links.select(F.col(key).alias("k"), F.col("at").cast("long").alias("at"), F.col("after").cast("long").alias("after"), F.floor(F.col("at") / width).alias("bucket"))
    x = saved(x, "links")
    units = F.pmod(F.xxhash64("k", "bucket"), F.lit(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-x.count() // unit_rows))))
    rows = saved(x.groupBy(units.alias("unit")).applyInPandas(_exits(width), f"k {kind}, at long, after long, bucket long, exit long"), "exits")
    reached = saved(rows.groupBy("k").agg(F.min("at").alias("at")), "reached")
    entered = rows.where("exit is not null").select(F.col("k").alias("_k"), F.col("exit").alias("_at")).union(reached.select("k", "at")).distinct()
    same = lambda c: F.col("k").eqNullSafe(F.col("_k")) & (F.col(c) == F.col("_at"))
    hops = saved(rows.join(entered, same("at"), "left_semi").where("exit is not null").select("k", "at", "exit"), "hops")
    while True:
        to = hops.select(F.col("k").alias("_k"), F.col("at").alias("_at"), F.col("exit").alias("_to"))
        more = saved(reached.join(to, same("at")).select("k", F.col("_to").alias("at")), "reached")
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        hops = saved(hops.join(to, same("exit")).select("k", "at", F.col("_to").alias("exit")), "hops")
    entries = reached.select(F.col("k").alias("_k"), F.floor(F.col("at") / width).alias("_b"), F.col("at").alias("entry"))
    crossed = rows.join(entries, F.col("k").eqNullSafe(F.col("_k")) & (F.col("bucket") == F.col("_b"))).select("k", "at", "after", "bucket", "entry")
    return crossed.groupBy(units.alias("unit")).applyInPandas(_ways(width), f"k {kind}, at long").withColumnRenamed("k", key)
