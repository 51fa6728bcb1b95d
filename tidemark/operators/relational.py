"""Latest-state tables: newest per key, upserts, duplicates, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by ``order``: a partial aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``, with their place ``rn``."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= n)


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Stored rows, replaced and joined by the batch's latest row of each key."""
    fresh = latest(batch, keys, [order])
    return fresh.unionByName(stored.join(fresh.select(*keys), keys, "left_anti"))


def changed(stored: DataFrame, batch: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of ``batch`` that are new or differ from what is stored."""
    old = stored.select(*keys, F.struct(*values).alias("_old"))
    return batch.join(old, keys, "left").where(~F.col("_old").eqNullSafe(F.struct(*values))).drop("_old")


def bucket_snapshots(df: DataFrame, key: str, ts: str, seconds: int, values: list[str]) -> DataFrame:
    """One row a key and bucket: the latest values under the bucket's earliest time."""
    rest = F.max_by(F.struct(*values), F.struct(ts, *values))
    return df.groupBy(key, F.floor(F.col(ts) / seconds).alias("bucket")).agg(F.min(ts).alias(ts), rest.alias("_v")).select(key, "bucket", ts, "_v.*")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def round_robin(df: DataFrame, order: str, budget: int, cursor: int) -> DataFrame:
    """``budget`` rows of a small list from place ``cursor`` on, past its end to its beginning."""
    place = F.row_number().over(Window.orderBy(order)) - 1
    total = F.count("*").over(Window.partitionBy())
    return df.withColumn("turn", F.pmod(place - cursor, total)).where(F.col("turn") < budget)


def with_fallback(rows: DataFrame, features: DataFrame, keys: list[str], loose: list[str], values: list[str]) -> DataFrame:
    """Each row with the features of its ``keys``, or else with those of its ``loose`` keys alone (of several, the one whose other keys come first)."""
    rest = [k for k in keys if k not in loose]
    exact = features.select(*[F.col(k).alias(f"_x_{k}") for k in keys], F.struct(*values).alias("_exact"))
    any_ = features.groupBy(*[F.col(k).alias(f"_y_{k}") for k in loose]).agg(F.min_by(F.struct(*values), F.struct(*rest)).alias("_any"))
    x = rows.join(exact, [F.col(k) == F.col(f"_x_{k}") for k in keys], "left").join(any_, [F.col(k) == F.col(f"_y_{k}") for k in loose], "left")
    hit = F.coalesce("_exact", "_any")
    return x.select(*rows.columns, *[hit[v].alias(v) for v in values])


def newest_valid(df: DataFrame, keys: list[str], ts: str, valid: Column, n: int) -> DataFrame:
    """Each key's ``n`` newest rows that are valid: rows are judged before they are counted, so invalid ones take no place. Adds rn, 1 the newest."""
    newest_first = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.where(valid).withColumn("rn", F.row_number().over(newest_first)).where(F.col("rn") <= n)


def latest_or_fallback(df: DataFrame, keys: list[str], ts: str, valid: Column, columns: list[str], fallback: dict[str, Column]) -> DataFrame:
    """Each key's newest valid row, or where it has none its newest row with ``fallback`` in place of columns; adds is_valid. One partial aggregate."""
    good = F.coalesce(valid, F.lit(False))
    best = F.max_by(F.struct(F.col(ts), good.alias("is_valid"), *columns), F.struct(good, F.col(ts)))
    got = df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")
    return got.withColumns({c: F.when(F.col("is_valid"), F.col(c)).otherwise(x) for c, x in fallback.items()})


def work_queue(due: DataFrame, attempts: DataFrame, key: str, ts: str, attempted: str, n: int) -> DataFrame:
    """The ``n`` rows to work on next: least recently attempted first (never counts as 0), then oldest, then key."""
    last = attempts.groupBy(F.col(key).alias("_k")).agg(F.max(attempted).alias("last_attempt"))
    x = due.join(last, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("last_attempt", F.coalesce("last_attempt", F.lit(0)))
    return x.orderBy("last_attempt", ts, key).limit(n)


def dealt(df: DataFrame, keys: list[str], rows: int = 500_000) -> DataFrame:
    """``df`` by a hash of ``keys`` in as many parts as keep each at about ``rows`` rows: for groups that are nearly as many as the rows, which no partial aggregate makes fewer."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
