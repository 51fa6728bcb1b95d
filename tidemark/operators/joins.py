"""Point-in-time, interval and range joins without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import carried_on, keyed


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str = "ts", values: tuple[str, ...] = ("price",), bucket: int = 86400, forward: bool = False) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (``forward``: the first at or after).

    Both sides go, tagged, through one window per key and time bucket; what a
    bucket does not find comes from the nearest bucket that has a right row, by a
    window over one row a bucket. A hot key is spread over its buckets.
    Right rows of one key and time must be unique. Unmatched rows get nulls. Null
    keys count as one key.
    """
    side = F.lit(-1) if forward else F.lit(1)
    pack = F.struct(*[F.col(v) for v in values], F.col(ts).alias("_at"))
    r = right.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), pack.alias("_hit"))
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    l_ = left.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), whole.alias("_row"))
    both = l_.withColumn("_hit", F.lit(None).cast(r.schema["_hit"].dataType)).unionByName(r.withColumn("_row", F.lit(None).cast(l_.schema["_row"].dataType)))
    both = both.withColumn("_bucket", F.floor(F.col("_ts") / bucket)).withColumn("_time", F.col("_ts") * side)
    # at equal times right rows come first
    inside = Window.partitionBy("_key", "_bucket").orderBy("_time", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_hit", ignorenulls=True).over(inside)).where("_row is not null")
    edge = (F.min_by if forward else F.max_by)("_hit", F.when(F.col("_hit").isNotNull(), F.col("_ts")))
    buckets = both.groupBy("_key", "_bucket").agg(edge.alias("_edge"))
    earlier = Window.partitionBy("_key").orderBy(F.col("_bucket") * side).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(F.col("_key").alias("_k"), F.col("_bucket").alias("_b"), F.last("_edge", ignorenulls=True).over(earlier).alias("_carried"))
    got = found.join(carried, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
    hit = F.coalesce("_here", "_carried")
    return got.select("_row.*", *[hit[v].alias(f"asof_{v}") for v in values], hit["_at"].alias("asof_ts"))


def sessions(events: DataFrame, key: str, gap: int, ts: str = "ts", bucket: int = 30 * 86400) -> DataFrame:
    """Spans of events no more than ``gap`` apart: key, span_start, span_end, n. Times and numbers are carried from bucket to bucket of ``bucket`` seconds."""
    times = keyed(events.groupBy(key, ts).agg(F.count("*").alias("_n")), [key], F.floor(F.col(ts) / bucket))
    x = carried_on(times, [ts], {"_before": ("max", F.col(ts))}, inclusive=False)
    new = F.when(F.col(ts) - F.col("_before") <= gap, 0).otherwise(1)
    x = carried_on(x.withColumn("_new", new), [ts], {"_span": ("sum", F.col("_new"))})
    return x.groupBy(key, "_span").agg(F.min(ts).alias("span_start"), F.max(ts).alias("span_end"), F.sum("_n").alias("n")).drop("_span")


def covering_span(windows: DataFrame, spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Each window with the latest-starting span of its key that holds all of it, if the spans of a key do not overlap.

    The span that begins last at or before a window's start is the only one
    that can hold it, so an as-of join does and no pairs are tried.
    """
    s = spans.select(key, F.col("span_start").alias("ts"), "span_start", "span_end")
    got = as_of(windows.withColumn("ts", F.col(start)), s, key, values=("span_start", "span_end"))
    holds = F.col("asof_span_end") >= F.col(end)
    return got.drop("ts", "asof_ts").withColumn("asof_span_start", F.when(holds, F.col("asof_span_start"))).withColumn("asof_span_end", F.when(holds, F.col("asof_span_end")))


def next_bar(rows: DataFrame, bars: DataFrame, key: str, tf: int, ts: str = "ts") -> DataFrame:
    """Each row with the bar that begins next after it, strictly; a missing bar stays missing."""
    target = F.col(ts) - F.pmod(F.col(ts), F.lit(tf)) + tf
    b = bars.select(F.col(key).alias("_k"), F.col("ts").alias("entry_ts"), F.col("open").alias("entry"))
    return rows.withColumn("_target", target).join(b, (F.col(key) == F.col("_k")) & (F.col("_target") == F.col("entry_ts")), "left").drop("_k", "_target")


def in_range(points: DataFrame, ranges: DataFrame, key: str, ts: Column, start: Column, end: Column, bucket: int, spread: Column | None = None, salts: int = 8) -> DataFrame:
    """Points of ``ranges``' key within [start, end): an equi-join on time buckets that each range spans, then the exact test.

    With ``spread``, something that tells ranges apart, the ranges of a key and
    bucket are dealt to ``salts`` tasks, each of which gets all points of them:
    for keys with many ranges and few points a bucket.
    """
    r = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(start / bucket), F.floor((end - 1) / bucket))))
    p, on = points.withColumn("_bucket", F.floor(ts / bucket)), [key, "_bucket"]
    if spread is not None:
        r = r.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        p, on = p.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, "_salt"]
    return r.join(p, on).where((ts >= start) & (ts < end)).drop("_bucket", "_salt")
