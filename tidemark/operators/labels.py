"""First-touch labels of directional entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import valid_bar
from .joins import in_range


def first_touch(entries: DataFrame, bars: DataFrame, key: str, tf: int, horizon: int, bucket: int = 86400, valid_only: bool = True) -> DataFrame:
    """What came first of each entry (entry_id, key, entry_ts, entry, target, stop; direction, long if absent; cost_bps, 0 if absent).

    A bar that opens at or beyond the stop exits at its open, one that opens at
    or beyond the target at the target; a bar that touches both is AMBIGUOUS,
    without a return. With neither by the horizon, the open of the bar that
    begins there counts. UNAVAILABLE: a bar missing before the exit, one that is
    not valid within the horizon (unless ``valid_only`` is off), or none at the horizon; INVALID: target and
    stop not on their sides of a positive entry, or no such direction.

    Returns entry_id, event, exit_reason, exit_ts, exit_price, gross (signed
    return), net (less costs), success, and mfe and mae: the best and worst
    excursions, of the exit's own bar only the level it left at. An entry's path
    is at most horizon / tf bars, in one group; entries of a hot key spread by
    time bucket and by salts of their ids.
    """
    add = lambda df, name, value: df if name in df.columns else df.withColumn(name, value)
    entries = add(add(entries, "direction", F.lit("long")), "cost_bps", F.lit(0.0))
    s = F.when(F.col("direction") == "long", 1.0).when(F.col("direction") == "short", -1.0)
    entry, target, stop, ts, start = (F.col(x) for x in ("entry", "target", "stop", "bar_ts", "entry_ts"))
    fair = F.coalesce((entry > 0) & (target > 0) & (stop > 0) & (s * stop < s * entry) & (s * entry < s * target), F.lit(False))
    b = bars.select(key, F.col("ts").alias("bar_ts"), "open", "high", "low", "close", (valid_bar() if valid_only else F.lit(True)).alias("_valid"))
    path = in_range(b, entries.where(fair), key, ts, start, start + horizon + 1, bucket, spread=F.col("entry_id"))
    o, best, worst = F.col("open"), F.when(s > 0, F.col("high")).otherwise(F.col("low")), F.when(s > 0, F.col("low")).otherwise(F.col("high"))
    gap, jump, up, down = s * o <= s * stop, s * o >= s * target, s * best >= s * target, s * worst <= s * stop
    inside = ts < start + horizon
    event = F.when(gap, "SL_FIRST").when(jump, "TP_FIRST").when(up & down, "AMBIGUOUS").when(up, "TP_FIRST").when(down, "SL_FIRST")
    price = F.when(gap, o).when(jump | (up & ~down), target).when(down & ~up, stop)
    path = path.withColumn("_event", F.when(inside, event)).withColumn("_price", price).withColumn("_gap", gap)
    path = path.withColumn("_hit", F.min(F.when(F.col("_event").isNotNull(), ts)).over(Window.partitionBy("entry_id")))
    gain = lambda x: s * (x - entry) / entry
    at, last = ts == F.col("_hit"), F.coalesce("_hit", start + horizon - tf)
    running = inside & F.coalesce(ts < F.col("_hit"), F.lit(True))
    first = lambda c: F.max(F.when(at, c))
    got = path.groupBy("entry_id").agg(
        first(F.col("_event")).alias("_event"), first(F.col("_price")).alias("_price"), first(F.col("_gap")).alias("_gap"), F.max("_hit").alias("_hit"), F.max(F.when(ts == start + horizon, o)).alias("_boundary"),
        F.count_if(inside & ~F.col("_valid")).alias("_bad"), F.count_if(inside & (ts <= last)).alias("_seen"), F.max(F.when(running, gain(best))).alias("_up"), F.min(F.when(running, gain(worst))).alias("_down"),
    )
    x = entries.withColumn("_fair", fair).join(got, "entry_id", "left")
    end = F.coalesce("_hit", start + horizon - tf)
    whole = (F.coalesce("_bad", F.lit(0)) == 0) & (F.coalesce("_seen", F.lit(0)) * tf == end - start + tf) & (F.col("_hit").isNotNull() | F.col("_boundary").isNotNull())
    name = F.when(~F.col("_fair"), "INVALID").when(~whole, "UNAVAILABLE").otherwise(F.coalesce("_event", F.lit("HORIZON_EXIT")))
    x = x.withColumn("event", name)
    done = F.col("event").isin("TP_FIRST", "SL_FIRST", "HORIZON_EXIT")
    reason = F.when(F.col("event") == "TP_FIRST", "take_profit").when((F.col("event") == "SL_FIRST") & F.col("_gap"), "stop_loss_gap").when(F.col("event") == "SL_FIRST", "stop_loss").when(F.col("event") == "HORIZON_EXIT", "horizon")
    x = x.withColumn("exit_price", F.when(done, F.coalesce("_price", "_boundary"))).withColumn("exit_reason", reason)
    gross = gain(F.col("exit_price"))
    net = gross - F.greatest(F.lit(0.0), F.col("cost_bps")) / 1e4
    left_at = F.when(F.col("event") != "HORIZON_EXIT", gross)
    return x.select(
        "entry_id", "event", "exit_reason", F.when(done, F.coalesce("_hit", start + horizon)).alias("exit_ts"), "exit_price", gross.alias("gross"), net.alias("net"),
        F.when(done, (~F.col("exit_reason").startswith("stop_loss") & (net > 1e-12)).cast("int")).alias("success"),
        F.when(done, F.greatest(F.lit(0.0), F.col("_up"), F.when(F.col("event") == "TP_FIRST", left_at))).alias("mfe"),
        F.when(done, F.least(F.lit(0.0), F.col("_down"), F.when(F.col("event") == "SL_FIRST", left_at))).alias("mae"),
    )


def funding_returns(labels: DataFrame, settlements: DataFrame, bars: DataFrame, key: str, bucket: int = 86400) -> DataFrame:
    """Funding paid or received over each position (entry_id, key, entry_ts, exit_ts, entry, direction), as a share of its entry: entry_id, n_events, funding_return.

    Settlements (key, ts, rate) from the entry on and before the exit count: one at
    the exit's own time may have come after it. Each is on the open of the bar that
    begins then, or else on the entry price; longs pay positive rates.
    """
    opens = bars.select(F.col(key).alias("_k"), F.col("ts").alias("_t"), F.col("open").alias("_open"))
    paid = settlements.select(key, F.col("ts").alias("event_ts"), "rate").join(opens, (F.col(key) == F.col("_k")) & (F.col("event_ts") == F.col("_t")), "left").drop("_k", "_t")
    held = in_range(paid, labels.where(F.col("exit_ts") > F.col("entry_ts")), key, F.col("event_ts"), F.col("entry_ts"), F.col("exit_ts"), bucket)
    side = F.when(F.col("direction") == "short", 1.0).otherwise(-1.0)
    got = held.groupBy("entry_id").agg(F.count("*").alias("n_events"), F.sum(side * F.coalesce("_open", "entry") * F.col("rate") / F.col("entry")).alias("funding_return"))
    return labels.select("entry_id").join(got, "entry_id", "left").select("entry_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("funding_return", F.lit(0.0)).alias("funding_return"))
