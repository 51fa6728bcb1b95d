"""What positions earned: ledgers, reconciliation, risk streams and daily sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def execution_summary(events: DataFrame, bots: DataFrame, snapshots: DataFrame, key: str = "bot_id") -> DataFrame:
    """Each bot's events as one row, checked against its exchange's last word.

    ``events``: key, event_id, event_type (execution or funding), ts, side, qty,
    gross, fee, funding. ``bots``: key, status, stopped_ts. ``snapshots``: key, ts,
    complete, open_orders, position, executions, fundings, gross, fee, funding;
    the newest counts. An execution without a side or quantity leaves the ledger
    incomplete. A result is final once the bot has stopped, its position is flat
    to a billionth, and the snapshot agrees in all. Null amounts count as zero.
    """
    kind, side, qty = F.lower(F.trim("event_type")), F.lower(F.trim("side")), F.coalesce("qty", F.lit(0.0))
    run = kind == "execution"
    good = run & (qty > 0) & side.isin("buy", "sell")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    ledger = events.groupBy(key).agg(
        F.count_if(run).alias("executions"), F.count_if(kind == "funding").alias("fundings"), F.count_if(run & ~F.coalesce(good, F.lit(False))).alias("bad"),
        total("gross").alias("gross"), total("fee").alias("fee"), total("funding").alias("funding"), F.max("ts").alias("last_ts"),
        F.sum(F.when(good & (side == "buy"), qty).otherwise(0.0)).alias("bought"), F.sum(F.when(good & (side == "sell"), qty).otherwise(0.0)).alias("sold"),
    )
    last = snapshots.groupBy(key).agg(F.max_by(F.struct("ts", "complete", "open_orders", "position", "executions", "fundings", "gross", "fee", "funding"), "ts").alias("snap"))
    x = bots.select(key, "status", "stopped_ts").join(ledger, key, "left").join(last, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    money = {c: F.coalesce(c, F.lit(0.0)) for c in ("gross", "fee", "funding", "bought", "sold")}
    flat_to = F.greatest(F.lit(1e-12), (money["bought"] + money["sold"]) * 1e-9)
    flat = (zero("executions") > 0) & (zero("bad") == 0) & (F.abs(money["bought"] - money["sold"]) <= flat_to)
    s = F.col("snap")
    differs = lambda c: ~F.coalesce(F.abs(s[c] - money[c]) <= F.greatest(F.lit(1e-8), F.greatest(F.abs(s[c]), F.abs(money[c])) * 1e-9), F.lit(False))
    rules = [
        ("exchange_reconciliation_incomplete", ~F.coalesce(s["complete"], F.lit(False))),
        ("exchange_reconciliation_precedes_bot_stop", s["ts"] < F.col("stopped_ts")),
        ("exchange_reconciliation_precedes_last_event", s["ts"] < F.col("last_ts")),
        ("exchange_open_orders_remain", zero(s["open_orders"]) != 0),
        ("exchange_position_not_flat", ~F.coalesce(F.abs(s["position"]) <= flat_to, F.lit(False))),
        ("execution_event_count_mismatch", zero(s["executions"]) != zero("executions")),
        ("funding_event_count_mismatch", zero(s["fundings"]) != zero("fundings")),
        ("realized_pnl_gross_mismatch", differs("gross")), ("fee_mismatch", differs("fee")), ("funding_mismatch", differs("funding")),
    ]
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    failures = F.when(s.isNull(), F.array(F.lit("missing_terminal_exchange_reconciliation"))).otherwise(codes)
    stopped = (F.lower(F.trim("status")) == "stopped") & F.col("stopped_ts").isNotNull()
    x = x.withColumn("failures", failures).withColumn("flat", flat).withColumn("net", money["gross"] + money["funding"] - money["fee"])
    final = F.coalesce(stopped & F.col("flat") & (F.size("failures") == 0), F.lit(False))
    return x.select(key, zero("executions").alias("executions"), zero("fundings").alias("fundings"), *[money[c].alias(c) for c in ("gross", "fee", "funding")], "net", (money["bought"] - money["sold"]).alias("position"), "flat", "failures", final.alias("final"), "last_ts")


def trade_summary(trades: DataFrame, key: str = "bot_id") -> DataFrame:
    """Each bot's plain trades (ts, pnl, fee): count, pnl, fees, net and time range."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    return trades.groupBy(key).agg(F.count("*").alias("n"), total("pnl").alias("pnl"), total("fee").alias("fee"), (total("pnl") - total("fee")).alias("net"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def risk_events(summary: DataFrame, trades: DataFrame, key: str = "bot_id") -> DataFrame:
    """Net results for risk: those of final bots in full, of others only losses; and trades of bots without a ledger. key, ts, net, source."""
    evidence = summary.where(F.col("last_ts").isNotNull())
    net = F.when(F.col("final"), F.col("net")).otherwise(F.least(F.lit(0.0), F.col("net")))
    own = evidence.select(key, F.col("last_ts").alias("ts"), net.alias("net"), F.lit("evidence").alias("source"))
    legacy = trades.join(evidence.select(key), key, "left_anti").select(key, "ts", (F.coalesce("pnl", F.lit(0.0)) - F.coalesce("fee", F.lit(0.0))).alias("net"), F.lit("legacy").alias("source"))
    return own.unionByName(legacy)


def daily_sums(trades: DataFrame) -> DataFrame:
    """Gross, fees and net of each day (ts in seconds, UTC)."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(0.0)))
    return trades.groupBy((F.col("ts") - F.pmod("ts", F.lit(86400))).alias("day")).agg(total("pnl").alias("gross"), total("fee").alias("fees"), (total("pnl") - total("fee")).alias("net"))
