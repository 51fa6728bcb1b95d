"""Weighted and time-aware statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .buckets import carried_on, followed, keyed, running
from .joins import as_of


def weighted_returns(df: DataFrame, key: str, ret: str, weight: str, width: float = 0.001) -> DataFrame:
    """Weighted mean and deviation, Kish's effective sample and return of the worst 20 % of weight.

    Expected shortfall takes whole rows by return until their weight reaches a
    fifth of all, and of the row at the border what is left. A key's returns are
    summed in buckets of ``width`` first; only the bucket at the border is looked
    into.
    """
    x = df.where((F.col(weight) > 0) & F.col(ret).isNotNull()).select(key, F.col(ret).alias("_r"), F.col(weight).cast("double").alias("_w")).withColumn("_bucket", F.floor(F.col("_r") / width))
    w, r = F.col("_w"), F.col("_r")
    sums = x.groupBy(key, "_bucket").agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * r).alias("wr"), F.sum(w * r * r).alias("wrr"), F.sum(w * w).alias("ww"))
    order = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0.0))).withColumn("_target", 0.2 * F.sum("w").over(Window.partitionBy(key)))
    whole = F.col("before") + F.col("w") <= F.col("_target")
    at_border = ~whole & (F.col("before") < F.col("_target"))
    total, mean = F.sum("w"), F.sum("wr") / F.sum("w")
    got = sums.groupBy(key).agg(
        F.sum("n").alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("wrr") / total - mean * mean)).alias("std"), (total * total / F.sum("ww")).alias("n_eff"), F.coalesce(F.sum(F.when(whole, F.col("wr"))), F.lit(0.0)).alias("_full"),
        F.max("_target").alias("_fifth"), F.max(F.when(at_border, F.struct("_bucket", (F.col("_target") - F.col("before")).alias("need")))).alias("_border"),
    )
    border = got.select(F.col(key).alias("_k"), F.col("_border._bucket").alias("_b"), F.col("_border.need").alias("need"))
    last = x.join(border, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b"))).groupBy("_k", "need", "_r").agg(F.sum(w).alias("_w"))
    before = F.coalesce(F.sum("_w").over(Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    last = last.withColumn("_tail", F.least(w, F.greatest(F.lit(0.0), F.col("need") - before))).groupBy("_k").agg(F.sum(F.col("_tail") * r).alias("_part"))
    joined = got.join(last, F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.select(key, "n", "mean", "std", "n_eff", F.try_divide(F.col("_full") + F.coalesce("_part", F.lit(0.0)), F.col("_fifth")).alias("shortfall"))


def merged(df: DataFrame, key: str, start: str, end: str, joins: Callable[[Column, Column], Column], names: tuple[str, str], bucket: int) -> DataFrame:
    """Intervals of each key merged in order of start: key, the two ``names``, n. ``joins`` of (start, greatest end before it) says whether one goes on.

    Ends and numbers are carried from bucket to bucket of ``bucket`` seconds.
    """
    s, e = F.col("_s"), F.col("_e")
    thin = df.groupBy(key, F.col(start).alias("_s")).agg(F.max(end).alias("_e"), F.count("*").alias("_n"))
    x = carried_on(keyed(thin, [key], F.floor(s / bucket)), ["_s"], {"_so_far": ("max", e)}, inclusive=False)
    x = carried_on(x.withColumn("_new", F.when(joins(s, F.col("_so_far")), 0).otherwise(1)), ["_s"], {"_c": ("sum", F.col("_new"))})
    return x.groupBy(key, "_c").agg(F.min(s).alias(names[0]), F.max(e).alias(names[1]), F.sum("_n").alias("n")).drop("_c")


def clusters(df: DataFrame, key: str, start: str, end: str, bucket: int = 30 * 86400) -> DataFrame:
    """Merged overlapping intervals of each key: key, cluster_start, cluster_end, n. Touching ones stay apart; an interval ends after it starts."""
    return merged(df, key, start, end, lambda s, before: s < before, ("cluster_start", "cluster_end"), bucket)


def _apart_links(df: DataFrame, key: str, start: str, end: str, bucket: int) -> DataFrame:
    """key, at, after: each end and the end of the interval to take next, the one of earliest end among those that start then or later."""
    ends = df.where(F.col(end) > F.col(start)).groupBy(key, F.col(start).cast("long").alias("ts")).agg(F.min(F.col(end).cast("long")).alias("_e"))
    soonest = running(ends, [key], -F.floor(F.col("ts") / bucket), [F.col("ts").desc()], {"soonest": ("min", F.col("_e"))}).select(key, "ts", "soonest")
    at = ends.select(key, F.col("_e").alias("ts")).distinct()
    links = as_of(at, soonest, key, values=("soonest",), bucket=bucket, forward=True)
    return links.select(key, F.col("ts").alias("at"), F.col("asof_soonest").alias("after"))


def most_apart(df: DataFrame, key: str, start: str, end: str, bucket: int = 90 * 86400) -> DataFrame:
    """The greatest number of intervals of each key that do not overlap: earliest finish first. key, apart.

    Links from each end to the next are made by a running minimum and an as-of
    join, and followed from the earliest end.
    """
    return followed(_apart_links(df, key, start, end, bucket), key, bucket).groupBy(key).agg(F.count("*").alias("apart"))


def apart(df: DataFrame, key: str, start: str, end: str, bucket: int = 90 * 86400) -> DataFrame:
    """key, start, end: intervals of each key that do not overlap, as many as can be: earliest finish first, of equal ends the earliest start that fits."""
    links = saved(_apart_links(df, key, start, end, bucket), "apart-links")
    way = saved(followed(links, key, bucket), "apart-way").select(F.col(key).alias("_k"), F.col("at").alias("_at"))
    first = way.groupBy("_k").agg(F.min("_at").alias("_e")).select("_k", F.lit(None).cast("long").alias("_from"), "_e")
    later = links.where("after is not null").join(way, F.col(key).eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")), "left_semi").select(F.col(key).alias("_k"), F.col("at").alias("_from"), F.col("after").alias("_e"))
    taken = first.unionByName(later)
    spans = df.where(F.col(end) > F.col(start)).select(key, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_end")).distinct()
    fits = spans.join(taken, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_end") == F.col("_e"))).where(F.col("_from").isNull() | (F.col("_s") >= F.col("_from")))
    return fits.groupBy(key, F.col("_end").alias(end)).agg(F.min("_s").alias(start)).select(key, start, end)


def pearson(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Correlation with its status: insufficient_samples (under 3 rows), zero_variance or descriptive_only_clustered_rows."""
    got = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.corr(x, y).alias("_r"))
    status = F.when(F.col("n") < 3, "insufficient_samples").when((F.col("_vx") <= 0) | (F.col("_vy") <= 0), "zero_variance").otherwise("descriptive_only_clustered_rows")
    return got.withColumn("status", status).withColumn("r", F.when(F.col("status").startswith("descriptive"), F.col("_r"))).drop("_vx", "_vy", "_r")


def tertiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """Edges of the thirds by nearest rank, of keys with 6 values or more and edges that differ."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return df.groupBy(key).agg(F.count(value).alias("n"), at("cast(1 as double) / 3").alias("low"), at("cast(2 as double) / 3").alias("high")).where("n >= 6 and low < high")


def drawdown(df: DataFrame, key: str, order: list[str], value: str, bucket: Column | None = None) -> DataFrame:
    """Total, peak of the running sum (0 at least) and deepest fall from it.

    ``bucket`` rises with ``order`` (by default its first column's month). A
    bucket comes to its total, its highest and lowest sum and its own deepest
    fall; a window over these carries sum and peak on.
    """
    at = bucket if bucket is not None else F.date_trunc("month", F.col(order[0]))
    w = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("_bucket", at).withColumn("_sum", F.sum(value).over(w)).withColumn("_peak", F.max("_sum").over(w))
    parts = x.groupBy(key, "_bucket").agg(F.sum(value).alias("_total"), F.max("_sum").alias("_high"), F.min("_sum").alias("_low"), F.max(F.col("_peak") - F.col("_sum")).alias("_fall"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0.0))).withColumn("_top", F.col("_before") + F.col("_high"))
    parts = parts.withColumn("_former", F.greatest(F.lit(0.0), F.max("_top").over(earlier)))
    fall = F.greatest("_fall", F.col("_former") - F.col("_before") - F.col("_low"))
    return parts.groupBy(key).agg(F.sum("_total").alias("total"), F.greatest(F.lit(0.0), F.max("_top")).alias("peak"), F.max(fall).alias("max_drawdown"))


def losing_streak(df: DataFrame, key: str, newest_first: list, value: str) -> DataFrame:
    """How many of a key's newest rows lost in a row."""
    won = F.sum((F.col(value) >= 0).cast("int")).over(Window.partitionBy(key).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_won", won).groupBy(key).agg(F.sum((F.col("_won") == 0).cast("int")).alias("streak"))


def ewma(df: DataFrame, key: str, ts: str, value: str, weight: str, half_life: float, now) -> DataFrame:
    """Mean of values by weight and age: half as much for each half life before ``now``, a number or a column. No order is needed."""
    w = F.col(weight) * F.exp(-F.ln(F.lit(2.0)) * (F.lit(now) - F.col(ts)) / half_life)
    return df.groupBy(key).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias("ewma"))


def walk_forward(df: DataFrame, ts: str, available: str, value: str, bucket: int = 86400) -> DataFrame:
    """For every time of validation, rows whose label was known by then, their total and mean value.

    Labels are summed by their time; a prefix over time buckets (a row a bucket)
    and one inside each bucket give the running sums, so no task holds all times.
    """
    labels = df.groupBy(F.col(available).alias("t")).agg(F.count("*").alias("k"), F.sum(value).alias("s"))
    times = df.select(F.col(ts).alias("t")).distinct()
    both = labels.withColumn("v", F.lit(0)).unionByName(times.select("t", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("s"), F.lit(1).alias("v"))).withColumn("bucket", F.floor(F.col("t") / bucket))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy("bucket").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    bases = sums.select("bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base_k"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("base_s"))
    w = Window.partitionBy("bucket").orderBy("t", "v").rowsBetween(Window.unboundedPreceding, 0)
    done = both.withColumn("n", F.sum("k").over(w)).withColumn("total", F.sum("s").over(w)).where("v = 1").join(bases, "bucket")
    n, total = F.col("n") + F.col("base_k"), F.col("total") + F.col("base_s")
    return done.select(F.col("t").alias("validation_ts"), n.alias("n_train"), total.alias("total_train"), F.try_divide(total, n).alias("mean_train"))


def apart_by(df: DataFrame, key: str, ts: str, embargo: int, bucket: int | None = None) -> DataFrame:
    """key, ts: of a key's distinct times in order, the first and then each that is ``embargo`` or more after the last one taken.

    A time's successor is the first at or after ``embargo`` beyond it, by an as-of
    join; successors are followed bucket by bucket (64 embargoes, or a day, by default).
    """
    width = bucket or max(86400, 64 * embargo)
    times = df.where(F.col(ts).isNotNull()).select(key, F.col(ts).cast("long").alias("at")).distinct()
    there = times.select(key, F.col("at").alias("ts"), F.col("at").alias("next"))
    links = as_of(times.withColumn("ts", F.col("at") + max(1, embargo)), there, key, values=("next",), bucket=width, forward=True)
    return followed(links.select(key, "at", F.col("asof_next").alias("after")), key, width).withColumnRenamed("at", ts)


def purged(df: DataFrame, validation: DataFrame, key: str, ts: str, available: str, bucket: int = 30 * 86400) -> DataFrame:
    """Training rows of each validation time: those decided before it whose label came in between the decision and it.

    ``validation`` has key and v_ts. Rows without a label time, or with one
    before their own time, are never trained on. Returns key, v_ts, n_train and
    last_label. Labels are counted by time, and counts carried from bucket to
    bucket of ``bucket`` seconds.
    """
    labels = df.where(F.col(available) >= F.col(ts)).groupBy(key, F.col(available).alias("_t")).agg(F.count("*").alias("_n")).withColumn("_v", F.lit(0))
    times = validation.select(key, F.col("v_ts").alias("_t")).distinct().select(key, "_t", F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_v"))
    # at equal times the validation comes first: a label of that very moment is not known yet
    known = {"n_train": ("sum", F.col("_n")), "last_label": ("max", F.when(F.col("_v") == 0, F.col("_t")))}
    both = running(labels.unionByName(times), [key], F.floor(F.col("_t") / bucket), ["_t", F.col("_v").desc()], known)
    return both.where("_v = 1").select(key, F.col("_t").alias("v_ts"), "n_train", "last_label")


def loss_bounds(df: DataFrame, key: str, label: str, probabilities: list[str], weight: str, alpha: float = 0.05) -> DataFrame:
    """Weighted and plain log loss, the largest gap of a class between how often it came and how likely it was said to be, and that gap with a Hoeffding margin, 1 at most.

    ``label`` is the number of the class, from 0; probabilities are cut at 1e-12.
    """
    k = len(probabilities)
    said = F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.element_at(F.array(*probabilities), F.col(label).cast("int") + 1)))
    gaps = [F.abs(F.avg((F.col(label) == i).cast("double")) - F.avg(p)) for i, p in enumerate(probabilities)]
    gap = F.greatest(*gaps)
    margin = F.sqrt(F.ln(F.lit(2.0 * k / alpha)) / (2 * F.count("*")))
    return df.groupBy(key).agg(
        F.count("*").alias("n"), (F.sum(F.col(weight) * -F.ln(said)) / F.sum(weight)).alias("weighted_loss"), F.avg(-F.ln(said)).alias("loss"), gap.alias("gap"), F.least(F.lit(1.0), gap + margin).alias("bound")
    )
