"""Returns of what a policy would have published, for many thresholds of confidence at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from . import stats
from .intervals import lower_bound

_SUMS = ("n", "w", "wr", "wrr", "ww")


def _moments(n_: str = "n") -> list[Column]:
    """Weighted mean, deviation (corrected by the effective sample) and Kish's effective sample, from sums."""
    w = F.col("w")
    mean, effective = F.try_divide(F.col("wr"), w), F.try_divide(w * w, F.col("ww"))
    variance = F.greatest(F.lit(0.0), F.try_divide(F.col("wrr"), w) - mean * mean)
    return [mean.alias("mean"), F.sqrt(variance * F.when(effective > 1.0, effective / (effective - 1)).otherwise(1.0)).alias("std"), F.coalesce(effective, F.lit(0.0)).alias("n_eff")]


def _suffix(cells: DataFrame, keys: list[str], thresholds: int, sums: list[Column]) -> DataFrame:
    """Cells (keys, reach: thresholds passed) as sums of all rows that pass each threshold: a cell counts for every one it reaches."""
    passed = cells.where("reach > 0").withColumn("at", F.explode(F.sequence(F.lit(1), "reach"))).where(F.col("at") <= thresholds)
    return passed.groupBy(*keys, "at").agg(*sums)


def selected_returns(df: DataFrame, key: str, thresholds: list[float], confidence: str, ret: str, weight: str, ts: str, available: str, least: int, least_clusters: int | None = None, level: float = 0.95, width: float = 0.001) -> DataFrame:
    """What rows at or above each threshold of ``confidence`` earned: a row a key and threshold.

    Columns: key, threshold, status, samples, mean, std, n_eff, shortfall (of the
    worst fifth of weight), lower; and of decisions that do not overlap in time
    clusters, temporal_mean, temporal_std, temporal_n_eff, temporal_lower. Status
    is insufficient (fewer than ``least`` samples or ``least_clusters`` clusters,
    plain or effective), negative, uncertain (a lower bound is not above 0) or
    positive. A key with a row that misses a value, has no weight, or a label not
    after its time is insufficient throughout: to drop such rows could make a
    profit. Decisions of one time are one: mean by weight, greatest weight, last
    label; of these, those of earliest end that fit are taken.

    Rows are read once and summed by how many thresholds they pass; a threshold is
    the sum of the cells that reach it, so the work is rows plus cells times
    thresholds. ``thresholds`` are of the order of a hundred.
    """
    grid = sorted(set(thresholds))
    floor = least_clusters if least_clusters is not None else max(1, min(20, -(-least // 4)))
    values = [F.col(c).cast("double") for c in (confidence, ret, weight)]
    good = F.lit(True)
    for v in values:
        good = good & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    good = good & (F.col(weight) > 0) & F.coalesce(F.col(available) > F.col(ts), F.lit(False))
    reach = F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid]), lambda t: F.col(confidence) + 1e-12 >= t))
    x = df.select(F.col(key).alias("k"), good.alias("good"), reach.alias("reach"), F.col(ret).cast("double").alias("r"), F.col(weight).cast("double").alias("w"), F.col(ts).cast("long").alias("ts"), F.col(available).cast("long").alias("end")).withColumn("slot", F.floor(F.col("r") / width))
    r, w = F.col("r"), F.col("w")
    keys = x.groupBy("k").agg(F.bool_and("good").alias("whole"))
    # Cells by reach and slot of return: moments and tails of every threshold come from them.
    cells = saved(x.where("good").groupBy("k", "reach", "slot").agg(F.count("*").alias("n"), F.sum(w).alias("w"), F.sum(w * r).alias("wr"), F.sum(w * r * r).alias("wrr"), F.sum(w * w).alias("ww")), "policy-cells")
    slots = saved(_suffix(cells, ["k", "slot"], len(grid), [F.sum(c).alias(c) for c in _SUMS]), "policy-slots")
    order = Window.partitionBy("k", "at").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0.0))).withColumn("fifth", 0.2 * F.sum("w").over(Window.partitionBy("k", "at")))
    inside = F.col("before") + w <= F.col("fifth")
    border = F.struct("slot", (F.col("fifth") - F.col("before")).alias("need"))
    sums = slots.groupBy("k", "at").agg(*[F.sum(c).alias(c) for c in _SUMS], F.coalesce(F.sum(F.when(inside, F.col("wr"))), F.lit(0.0)).alias("full"), F.max("fifth").alias("fifth"), F.max(F.when(~inside & (F.col("before") < F.col("fifth")), border)).alias("border"))
    sums = saved(sums, "policy-sums")
    edge = sums.select(F.col("k").alias("_k"), "at", F.col("border.slot").alias("_slot"), F.col("border.need").alias("need")).where("_slot is not null")
    last = x.where("good").groupBy("k", "slot", "reach", "r").agg(F.sum(w).alias("w")).join(edge, F.col("k").eqNullSafe(F.col("_k")) & (F.col("slot") == F.col("_slot")) & (F.col("reach") >= F.col("at"))).groupBy("_k", "at", "need", "r").agg(F.sum("w").alias("w"))
    so_far = F.coalesce(F.sum("w").over(Window.partitionBy("_k", "at").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    tails = last.withColumn("tail", F.least(w, F.greatest(F.lit(0.0), F.col("need") - so_far))).groupBy("_k", F.col("at").alias("_at")).agg(F.sum(F.col("tail") * r).alias("part"))
    got = sums.join(tails, F.col("k").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")), "left")
    got = got.select("k", "at", F.col("n").alias("samples"), *_moments(), F.try_divide(F.col("full") + F.coalesce("part", F.lit(0.0)), F.col("fifth")).alias("shortfall"))

    moments = x.where("good").groupBy("k", "ts", "reach").agg(F.max("end").alias("end"), F.sum(w * r).alias("wr"), F.sum(w).alias("w"), F.max(w).alias("top"))
    cohorts = _suffix(moments, ["k", "ts"], len(grid), [F.max("end").alias("end"), F.sum("wr").alias("wr"), F.sum("w").alias("w"), F.max("top").alias("top")])
    cohorts = saved(cohorts.select(F.struct("k", "at").alias("part"), "ts", "end", (F.col("wr") / F.col("w")).alias("r"), F.col("top").alias("w")), "policy-cohorts")
    taken = stats.apart(cohorts, "part", "ts", "end").toDF("_part", "_ts", "_end")
    kept = cohorts.join(taken, F.col("part").eqNullSafe(F.col("_part")) & (F.col("ts") == F.col("_ts")), "left_semi")
    temporal = kept.groupBy("part").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(w * r).alias("wr"), F.sum(w * r * r).alias("wrr"), F.sum(w * w).alias("ww"))
    temporal = temporal.select(F.col("part.k").alias("_k"), F.col("part.at").alias("_at"), F.col("n").alias("clusters"), *[c.alias(f"temporal_{name}") for c, name in zip(_moments(), ("mean", "std", "n_eff"), strict=True)])

    every = keys.withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = every.join(got.withColumnsRenamed({"k": "_k", "at": "_at"}), F.col("k").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")) & F.col("whole"), "left").drop("_k", "_at")
    both = both.join(temporal, F.col("k").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")) & F.col("whole"), "left").drop("_k", "_at")
    both = both.withColumns({"samples": zero("samples"), "clusters": zero("clusters"), "n_eff": F.coalesce("n_eff", F.lit(0.0)), "temporal_n_eff": F.coalesce("temporal_n_eff", F.lit(0.0))})
    both = both.withColumn("lower", lower_bound(F.col("mean"), F.col("std"), F.col("n_eff"), level)).withColumn("temporal_lower", lower_bound(F.col("temporal_mean"), F.col("temporal_std"), F.col("temporal_n_eff"), level))
    few = (F.col("samples") < least) | (F.col("clusters") < floor) | (F.col("n_eff") + 1e-6 < least) | (F.col("temporal_n_eff") + 1e-6 < floor) | F.col("lower").isNull() | F.col("temporal_lower").isNull()
    status = F.when(~F.col("whole") | few, "insufficient").when(F.col("mean") <= 0, "negative").when((F.col("lower") <= 0) | (F.col("temporal_lower") <= 0), "uncertain").otherwise("positive")
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in grid]), F.col("at"))
    return both.select(F.col("k").alias(key), threshold.alias("threshold"), status.alias("status"), "samples", "mean", "std", "n_eff", "shortfall", "lower", "clusters", "temporal_mean", "temporal_std", "temporal_n_eff", "temporal_lower")
