"""Registered queries on the rules of a decision, its money, and validation in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import costs as C
from ..functions import policy as P
from ..operators import intervals, joins, money, relational, stats
from ..sources.tables import epoch, table, trades
from .market import BARS, DAY, HOUR, TRADES, hourly, newest, query, r

SIDES = "CASE l_returnflag WHEN 'A' THEN 'long' WHEN 'R' THEN 'short' ELSE 'neutral' END"


def lines(spark, d):
    side = F.when(F.col("l_returnflag") == "A", "long").when(F.col("l_returnflag") == "R", "short").otherwise("neutral")
    return table(spark, d, "lineitem").withColumn("side", side)


@query(f"""WITH x AS (SELECT *, {SIDES} AS side, CASE WHEN l_linenumber = 1 THEN NULL ELSE (l_quantity - 25) / 5 END AS chg FROM lineitem),
t AS (SELECT *, CASE WHEN chg IS NULL THEN 'unknown' WHEN chg > 3 THEN 'growing' WHEN chg < -3 THEN 'falling' ELSE 'stable' END AS trend FROM x)
SELECT l_orderkey, l_linenumber, trend, CASE WHEN trend = 'growing' AND side = 'long' THEN 'bullish' WHEN trend = 'growing' AND side = 'short' THEN 'bearish' WHEN trend = 'falling' THEN 'caution' ELSE 'neutral' END AS signal,
  round(CASE WHEN l_linenumber > 4 THEN l_discount ELSE (1 - w) * l_discount + w * l_tax END, 6) AS blend FROM (SELECT *, least(0.5::DOUBLE, greatest(0.1::DOUBLE, l_suppkey % 30 / 20.0::DOUBLE)) AS w FROM t)""")
def oi_signals(spark, d):
    """Open interest's trend and what it says with the price's direction; sentiment blended by its points."""
    trend = P.oi_trend(F.when(F.col("l_linenumber") > 1, (F.col("l_quantity") - 25) / 5))
    own = F.when(F.col("l_linenumber") <= 4, F.col("l_tax"))
    return lines(spark, d).withColumn("trend", trend).select("l_orderkey", "l_linenumber", "trend", P.oi_signal(F.col("trend"), F.col("side")).alias("signal"), r(P.blended_sentiment(F.col("l_discount"), own, F.col("l_suppkey") % 30)).alias("blend"))


OI = """WITH o AS (SELECT o_custkey AS k, epoch_us(o_orderdate) // 1000000 AS ts, max(o_totalprice) AS oi FROM orders GROUP BY ALL), n AS (SELECT k, max(ts) AS ts, arg_max(oi, ts) AS now FROM o GROUP BY k)"""


@query(f"""{OI}, f AS (SELECT n.k, any_value(now) AS now, arg_max(o.oi, o.ts) FILTER (o.ts <= n.ts - 30 * 86400) AS month, arg_max(o.oi, o.ts) FILTER (o.ts <= n.ts - 180 * 86400) AS half FROM n JOIN o USING (k) GROUP BY n.k)
SELECT k, round((now - month) / month * 100, 4) AS short_pct, round((now - half) / half * 100, 4) AS long_pct, CASE WHEN half IS NULL THEN 'unknown' WHEN (now - half) / half * 100 > 3 THEN 'growing' WHEN (now - half) / half * 100 < -3 THEN 'falling' ELSE 'stable' END AS trend FROM f""")
def oi_changes(spark, d):
    """Each key's newest value against the last at or before two times back."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), epoch(F.col("o_orderdate")).alias("ts")).agg(F.max("o_totalprice").alias("oi"))
    now = o.groupBy("k").agg(F.max("ts").alias("last"), F.max_by("oi", "ts").alias("now"))
    back = lambda days: F.max_by("oi", F.when(F.col("ts") <= F.col("last") - days * DAY, F.col("ts")))
    x = o.join(now, "k").groupBy("k").agg(F.max("now").alias("now"), back(30).alias("month"), back(180).alias("half"))
    pct = lambda c: (F.col("now") - F.col(c)) / F.col(c) * 100
    return x.select("k", r(pct("month"), 4).alias("short_pct"), r(pct("half"), 4).alias("long_pct"), P.oi_trend(pct("half")).alias("trend"))


@query(f"""WITH x AS (SELECT *, {SIDES} AS side, ['normal', 'amber_down', 'amber_up', 'red_down', 'chaos'][1 + l_suppkey % 5] AS state, CASE WHEN l_linenumber > 6 THEN NULL ELSE l_discount END AS rate FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 OR l_linenumber < 3 THEN 'blocked' WHEN l_discount * 10 < 0.4 THEN 'no_trade' ELSE 'pass' END AS reversion, coalesce(side <> 'neutral' AND rate IS NOT NULL AND l_linenumber > 1 AND l_quantity / 5 >= 6, false) AS funding_extreme,
  CASE WHEN state IN ('red_down', 'chaos') THEN 'MARKET_LOCKDOWN' WHEN state = 'amber_down' AND side = 'long' THEN 'MARKET_GUARDED_DOWN' WHEN state = 'amber_up' AND side = 'short' THEN 'MARKET_GUARDED_UP' WHEN side = 'neutral' AND l_linenumber > 2 AND state = 'amber_down' THEN 'MARKET_GUARDED_DOWN_NEUTRAL' WHEN side = 'neutral' AND l_linenumber > 2 AND state = 'amber_up' THEN 'MARKET_GUARDED_UP_NEUTRAL' END AS shock FROM x""")
def entry_gates(spark, d):
    """Mean-reversion evidence, funding and the market's state as gates of an entry."""
    n = F.col("l_linenumber")
    state = F.element_at(F.array(*[F.lit(x) for x in ("normal", "amber_down", "amber_up", "red_down", "chaos")]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    rate = F.when(n <= 6, F.col("l_discount"))
    return lines(spark, d).select(
        "l_orderkey", "l_linenumber", P.mean_reversion_gate(n % 4 != 0, n, F.col("l_discount") * 10, F.lit(0.4)).alias("reversion"), P.funding_extreme(F.col("side"), rate, n - 1, F.col("l_quantity") / 5).alias("funding_extreme"), P.shock_gate(state, F.col("side"), n > 2).alias("shock")
    )


@query(f"""WITH {BARS}, c AS (SELECT symbol, ts, close / lag(close, 1) OVER o - 1 AS r1, close / lag(close, 3) OVER o - 1 AS r3, close / lag(close, 5) OVER o - 1 AS r5, (ts // 3600 % 5 - 1) / 2.0::DOUBLE AS z, ['long', 'short', 'neutral'][1 + ts // 3600 % 3] AS side FROM b WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, CASE WHEN side = 'long' AND r1 <= -0.006 AND r3 <= -0.010 AND r5 <= -0.018 AND z >= 0.75 THEN 'down_break' WHEN side = 'short' AND r1 >= 0.006 AND r3 >= 0.010 AND r5 >= 0.018 AND z >= 0.75 THEN 'up_break' WHEN side = 'neutral' AND abs(r5) >= 0.020 AND z >= 0.90 THEN 'volatility_spike' ELSE 'normal' END AS state FROM c""")
def fast_veto(spark, d):
    """Entries against a symbol's last moves."""
    from .evidence import changes

    h = F.floor(F.col("ts") / 3600)
    side = F.element_at(F.array(F.lit("long"), F.lit("short"), F.lit("neutral")), (h % 3 + 1).cast("int"))
    share = lambda c: F.col(c) / 100
    return changes(spark, d).select("symbol", "ts", P.fast_veto(side, share("r1"), share("r3"), share("r5"), (h % 5 - 1) / 2).alias("state"))


@query(f"""WITH x AS (SELECT *, {SIDES} AS side, CASE WHEN l_linenumber % 2 = 0 THEN 'take_profit' ELSE 'stop_loss' END AS kind, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_extendedprice END AS ref, l_extendedprice * (0.95::DOUBLE + l_discount) AS px FROM lineitem),
u AS (SELECT *, (side = 'long' AND kind = 'take_profit') OR (side = 'short' AND kind = 'stop_loss') AS rise FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN side = 'neutral' THEN 'PROTECTIVE_DIRECTION_INVALID' WHEN ref <= 0 THEN 'PROTECTIVE_REFERENCE_PRICE_INVALID' ELSE concat_ws(',', CASE WHEN (rise AND px <= ref) OR (NOT rise AND px >= ref) THEN upper(side) || CASE kind WHEN 'take_profit' THEN '_TP' ELSE '_SL' END || '_TRIGGER_NOT_' || CASE WHEN rise THEN 'ABOVE' ELSE 'BELOW' END || '_REFERENCE' END,
  CASE WHEN rise <> (px > ref) THEN 'PROTECTIVE_TRIGGER_DIRECTION_MISMATCH' END) END AS errors FROM u""")
def trigger_geometry(spark, d):
    """Protective orders on the wrong side of the price."""
    kind = F.when(F.col("l_linenumber") % 2 == 0, "take_profit").otherwise("stop_loss")
    ref = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_extendedprice"))
    errors = P.trigger_errors(F.col("side"), kind, ref, F.col("l_extendedprice") * (0.95 + F.col("l_discount")))
    return lines(spark, d).select("l_orderkey", "l_linenumber", F.array_join(errors, ",").alias("errors"))


@query("""WITH x AS (SELECT *, CASE WHEN l_linenumber < 4 THEN l_tax * 10 END AS cal, CASE WHEN l_linenumber = 2 THEN 0.92::DOUBLE ELSE 1 END * CASE WHEN l_suppkey % 4 = 0 THEN 0.94::DOUBLE ELSE 1 END * CASE WHEN l_suppkey % 3 = 0 AND l_linenumber <> 5 THEN 0.96::DOUBLE ELSE 1 END * CASE WHEN l_linenumber = 6 THEN 0.98::DOUBLE ELSE 1 END * CASE WHEN l_linenumber < 3 THEN 0.93::DOUBLE ELSE 1 END AS ctx FROM lineitem),
m AS (SELECT *, CASE WHEN cal IS NULL THEN 0 ELSE least(1, l_suppkey / 300.0::DOUBLE) * 0.40::DOUBLE + 0.10::DOUBLE END AS w FROM x),
c AS (SELECT *, CASE WHEN cal IS NOT NULL AND l_suppkey = 0 THEN 0 WHEN cal IS NULL THEN least(0.7::DOUBLE, 1 / (1 + exp(-2.1 * (l_quantity / 50)))) ELSE least(1, greatest(0, (1 - w) / (1 + exp(-2.1 * (l_quantity / 50))) + w * cal)) END AS mixed FROM m),
f AS (SELECT *, mixed * ctx * CASE WHEN l_returnflag = 'R' THEN 0.88::DOUBLE ELSE 1 END * CASE WHEN l_linestatus = 'O' THEN 0.93::DOUBLE ELSE 1 END AS conf, CASE WHEN l_linestatus = 'O' AND l_linenumber <> 1 THEN (l_discount * 10 - 0.2) * 0.92::DOUBLE ELSE l_discount * 10 - 0.2::DOUBLE END AS score FROM c)
SELECT l_orderkey, l_linenumber, round(conf, 6) AS confidence, round(score, 6) AS score, CASE WHEN l_linenumber = 1 THEN 'blocked' WHEN score < 0.1::DOUBLE THEN 'no_trade' WHEN l_suppkey % 2 = 0 AND conf < 0.3::DOUBLE THEN 'no_trade' ELSE 'recommended' END AS status, round(least(1, l_tax / 0.10::DOUBLE), 6) AS risk FROM f""")
def decision_status(spark, d):
    """Confidence after calibration and context, the score in a guarded market, and the status they lead to."""
    n, supp = F.col("l_linenumber"), F.col("l_suppkey")
    ctx = P.context_multiplier(n != 2, supp % 4 != 0, supp % 3 != 0, n != 6, n, n != 5)
    conf = P.confidence(F.col("l_quantity") / 50, F.when(n < 4, F.col("l_tax") * 10), supp, ctx, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    score = P.guarded_score(F.col("l_discount") * 10 - 0.2, F.col("l_linestatus") == "O", n == 1)
    x = lines(spark, d).withColumn("confidence", conf).withColumn("score", score).withColumn("codes", F.when(n == 1, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")))
    status = P.status(F.col("codes"), F.col("score"), 0.1, F.col("confidence"), 0.3, supp % 2 == 0)
    return x.select("l_orderkey", "l_linenumber", r("confidence").alias("confidence"), r("score").alias("score"), status.alias("status"), r(P.risk_score(F.col("l_tax"))).alias("risk"))


@query("""WITH x AS (SELECT *, ['v1', 'v1+x', 'v10', ' v1 ', NULL][1 + o_orderkey % 5] AS version, CASE o_orderstatus WHEN 'F' THEN 'recommended' WHEN 'O' THEN 'no_trade' ELSE 'pending' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'queued' END AS review FROM orders),
s AS (SELECT *, status = 'no_trade' AND o_orderkey % 4 <> 0 AND o_custkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 6 = 0 AS shadow FROM x)
SELECT o_orderkey, coalesce(trim(version) = 'v1' OR trim(version) LIKE 'v1+%', false) AS current, shadow, CASE status WHEN 'no_trade' THEN shadow WHEN 'pending' THEN false ELSE coalesce(review = 'completed', false) END AS eligible, status <> 'recommended' AND status <> 'pending' OR o_custkey % 2 = 0 OR o_totalprice / 300000 >= 0.4 AS passes FROM s""")
def label_eligibility(spark, d):
    """Which rows' outcomes count: model version, safe shadows, reviews and the confidence floor."""
    k = F.col("o_orderkey")
    version = F.element_at(F.array(*[F.lit(x) for x in ("v1", "v1+x", "v10", " v1 ", None)]), (k % 5 + 1).cast("int"))
    state = F.when(F.col("o_orderstatus") == "F", "recommended").when(F.col("o_orderstatus") == "O", "no_trade").otherwise("pending")
    review = F.when(k % 3 == 0, "completed").when(k % 3 == 1, "queued")
    x = table(spark, d, "orders").withColumn("status", state)
    role = F.when(F.col("o_custkey") % 5 != 0, "shadow_no_trade").otherwise("live")
    shadow = P.safe_shadow(F.col("status"), k % 4 != 0, role, k % 7 != 0, k % 6)
    return x.withColumn("shadow", shadow).select(
        "o_orderkey", P.model_matches(version, "v1").alias("current"), "shadow", P.label_eligible(F.col("status"), F.col("shadow"), review).alias("eligible"), P.confidence_passes(F.col("status"), F.col("o_totalprice") / 300000, 0.4, F.col("o_custkey") % 2 != 0).alias("passes")
    )


@query("""WITH x AS (SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS ts, ['futures_grid', 'directional_trend', 'other'][1 + o_orderkey % 3] AS bot, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % 60 END AS hours FROM orders),
h AS (SELECT *, CASE bot WHEN 'futures_grid' THEN CASE WHEN hours > 0 THEN least(48, greatest(6, hours)) * 3600 ELSE 43200 END WHEN 'directional_trend' THEN CASE WHEN hours > 0 THEN least(24, greatest(3, hours)) * 3600 ELSE 43200 END ELSE CASE WHEN hours > 0 THEN least(72, greatest(0.5, hours)) * 3600 ELSE 14400 END END::BIGINT AS horizon FROM x)
SELECT o_orderkey, horizon, ts + horizon + 120 AS due, (CASE WHEN o_orderkey % 2 = 0 THEN ts * 1000 ELSE ts END) > 100000000000 AS milliseconds, ts AS seconds, ts > 0 AND ts <= 900000000 + 300 AS plausible FROM h""")
def label_horizons(spark, d):
    """Horizons within each strategy's bounds, when labels are due, and times that may come in milliseconds."""
    k, ts = F.col("o_orderkey"), F.col("ts")
    bot = F.element_at(F.array(F.lit("futures_grid"), F.lit("directional_trend"), F.lit("other")), (k % 3 + 1).cast("int"))
    x = table(spark, d, "orders").select("o_orderkey", epoch(F.col("o_orderdate")).alias("ts"), P.horizon(bot, F.when(k % 4 != 0, F.col("o_custkey") % 60), 14400).alias("horizon"))
    remote = F.when(k % 2 == 0, ts * 1000).otherwise(ts)
    return x.select("o_orderkey", "horizon", P.label_due(ts, F.col("horizon")).alias("due"), (remote > 100000000000).alias("milliseconds"), P.seconds(remote).alias("seconds"), P.plausible_time(ts, F.lit(900000000)).alias("plausible"))


@query(f"""WITH x AS (SELECT *, {SIDES} AS side, l_linenumber - 2 AS lev FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_extendedprice + l_extendedprice * (1 + l_discount)) * 5.5::DOUBLE / 10000, 11) AS fee, round(l_extendedprice * (l_tax - 0.04) * l_linenumber * CASE side WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END, 11) AS funding, round(l_extendedprice / CASE WHEN lev > 0 THEN lev ELSE 1 END, 11) AS margin,
  round(CASE side WHEN 'short' THEN greatest(0, (l_extendedprice * (0.9::DOUBLE + l_discount * 3) - l_extendedprice) / l_extendedprice * 100) WHEN 'long' THEN greatest(0, (l_extendedprice - l_extendedprice * (0.9::DOUBLE + l_discount * 3)) / l_extendedprice * 100) END, 11) AS buffer FROM x""")
def position_costs(spark, d):
    """Fees, funding, margin and room to liquidation of positions."""
    p, n = F.col("l_extendedprice"), F.col("l_linenumber")
    return lines(spark, d).select(
        "l_orderkey", "l_linenumber", r(P.round_trip_fee(p, p * (1 + F.col("l_discount")), F.lit(5.5)), 11).alias("fee"), r(P.funding_cashflow(F.col("side"), p, F.col("l_tax") - 0.04, n), 11).alias("funding"), r(P.margin_required(p, n - 2), 11).alias("margin"), r(P.liquidation_buffer(F.col("side"), p, p * (0.9 + F.col("l_discount") * 3)), 11).alias("buffer")
    )


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, greatest(0, (l_tax * 20 - 0.1::DOUBLE) / 100) * 10000 AS gross, greatest(l_discount * 100, 5.5::DOUBLE * 2) AS cost, (l_discount - 0.05) * 100 AS f, l_extendedprice AS size, l_quantity AS q FROM lineitem),
n AS (SELECT *, gross - cost AS net FROM x)
SELECT l_orderkey, l_linenumber, round(gross, 4) AS gross_bps, round(cost, 4) AS cost_bps, round(net, 4) AS net_bps, round(net - greatest(0, f), 4) AS stress_bps, round(gross * least(1, greatest(0, q / 50)) - cost, 4) AS projected_bps, net > 0 AS breakeven,
  concat_ws(',', CASE WHEN net <= 0 THEN 'GRID_NET_PROFIT_NON_POSITIVE' WHEN net < 2 THEN 'GRID_NET_PROFIT_TOO_THIN' END, CASE WHEN gross <= cost * 1.10::DOUBLE THEN 'GRID_GROSS_EDGE_BELOW_COSTS' END, CASE WHEN q < 12 THEN 'LIQUIDATION_BUFFER_TOO_LOW' END, CASE WHEN l_linenumber < 2 THEN 'MIN_LEVERAGE_PER_BOT' END, CASE WHEN l_linenumber > 5 THEN 'MAX_LEVERAGE_PER_BOT' END, CASE WHEN size > 60000 THEN 'MAX_POSITION_NOTIONAL_PER_BOT' END, CASE WHEN size / l_linenumber > 30000 THEN 'MAX_MARGIN_PER_BOT' END) AS blocks FROM n""")
def grid_leg(spark, d):
    """What one step of a grid earns, and the codes that economics put on a plan."""
    size, n = F.col("l_extendedprice"), F.col("l_linenumber")
    leg = P.grid_leg(F.col("l_tax") * 20 - 0.1, size, F.lit(5.5), F.col("l_discount") * 100, (F.col("l_discount") - 0.05) * 100, F.col("l_quantity") / 50)
    x = lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", *[c.alias(name) for name, c in leg.items()])
    codes = P.economics_blocks(F.col("net_bps"), F.col("gross_bps"), F.col("cost_bps"), F.col("l_quantity"), n, (2, 5), size, 60000, size / n, 30000)
    return x.select("l_orderkey", "l_linenumber", *[r(c, 4).alias(c) for c in ("gross_bps", "cost_bps", "net_bps", "stress_bps", "projected_bps")], "breakeven", F.array_join(codes, ",").alias("blocks"))


LEDGER = """WITH e AS (SELECT l_suppkey AS bot_id, CASE WHEN l_linenumber = 7 THEN 'funding' ELSE 'execution' END AS kind, epoch_us(l_shipdate) // 1000000 AS ts, CASE WHEN l_returnflag = 'A' THEN 'buy' ELSE 'sell' END AS side, CASE WHEN l_linenumber = 6 AND l_suppkey % 3 = 0 THEN 0 ELSE l_quantity END AS qty, l_tax * 100 AS gross, l_discount AS fee, l_tax AS funding FROM lineitem),
g AS (SELECT bot_id, count(*) FILTER (kind = 'execution') AS executions, count(*) FILTER (kind = 'funding') AS fundings, count(*) FILTER (kind = 'execution' AND qty <= 0) AS bad, sum(gross) AS gross, sum(fee) AS fee, sum(funding) AS funding, max(ts) AS last_ts, sum(CASE WHEN kind = 'execution' AND side = 'buy' THEN qty ELSE 0 END) AS bought, sum(CASE WHEN kind = 'execution' AND side = 'sell' THEN qty ELSE 0 END) AS sold FROM e GROUP BY bot_id),
b AS (SELECT s_suppkey AS bot_id, s_suppkey % 4 <> 0 AS stopped FROM supplier),
x AS (SELECT bot_id, stopped, coalesce(executions, 0) AS executions, coalesce(fundings, 0) AS fundings, coalesce(bad, 0) AS bad, coalesce(gross, 0) AS gross, coalesce(fee, 0) AS fee, coalesce(funding, 0) AS funding, coalesce(bought, 0) AS bought, coalesce(sold, 0) AS sold, last_ts, last_ts + CASE WHEN bot_id % 7 = 0 THEN -1 ELSE 1000 END AS snap_ts FROM b LEFT JOIN g USING (bot_id)),
c AS (SELECT *, executions > 0 AND bad = 0 AND abs(bought - sold) <= greatest(1e-12, (bought + sold) * 1e-9) AS flat, CASE WHEN last_ts IS NULL THEN 'missing_terminal_exchange_reconciliation' ELSE concat_ws(',', CASE WHEN bot_id % 5 = 0 THEN 'exchange_reconciliation_incomplete' END, CASE WHEN stopped AND snap_ts < last_ts + 500 THEN 'exchange_reconciliation_precedes_bot_stop' END, CASE WHEN snap_ts < last_ts THEN 'exchange_reconciliation_precedes_last_event' END, CASE WHEN bot_id % 6 = 0 THEN 'exchange_open_orders_remain' END, CASE WHEN bot_id % 11 = 0 THEN 'exchange_position_not_flat' END, CASE WHEN bot_id % 9 = 0 THEN 'fee_mismatch' END) END AS failures FROM x)"""


def ledgers(spark, d):
    """Line items as ledgers of bots, with the bots and what the exchange said last."""
    n, k = F.col("l_linenumber"), F.col("l_suppkey")
    e = table(spark, d, "lineitem").select(
        k.alias("bot_id"), (F.col("l_orderkey") * 10 + n).alias("event_id"), F.when(n == 7, "funding").otherwise("execution").alias("event_type"), epoch(F.col("l_shipdate")).alias("ts"), F.when(F.col("l_returnflag") == "A", "buy").otherwise("sell").alias("side"),
        F.when((n == 6) & (k % 3 == 0), 0.0).otherwise(F.col("l_quantity")).alias("qty"), (F.col("l_tax") * 100).alias("gross"), F.col("l_discount").alias("fee"), F.col("l_tax").alias("funding"),
    )
    ends = e.groupBy("bot_id").agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "execution").alias("executions"), F.count_if(F.col("event_type") == "funding").alias("fundings"), F.sum("gross").alias("gross"), F.sum("fee").alias("fee"), F.sum("funding").alias("funding"))
    b = F.col("bot_id")
    bots = table(spark, d, "supplier").select(F.col("s_suppkey").alias("bot_id")).join(ends.select("bot_id", "last"), "bot_id", "left").select("bot_id", F.when(b % 4 != 0, "stopped").otherwise("running").alias("status"), F.when(b % 4 != 0, F.coalesce(F.col("last") + 500, F.lit(0))).alias("stopped_ts"))
    snaps = ends.select(
        "bot_id", (F.col("last") + F.when(b % 7 == 0, -1).otherwise(1000)).alias("ts"), (b % 5 != 0).alias("complete"), F.when(b % 6 == 0, 1).otherwise(0).alias("open_orders"), F.when(b % 11 == 0, 5.0).otherwise(0.0).alias("position"), "executions", "fundings", "gross", (F.col("fee") + F.when(b % 9 == 0, 1).otherwise(0)).alias("fee"), "funding",
    )
    return money.execution_summary(e, bots, snaps)


@query(f"""{LEDGER} SELECT bot_id, executions, fundings, round(gross + funding - fee, 4) AS net, round(bought - sold, 4) AS position, flat, failures, stopped AND flat AND failures = '' AS final FROM c""")
def execution_summary(spark, d):
    """Each bot's ledger against its exchange's last word."""
    return ledgers(spark, d).select("bot_id", "executions", "fundings", r("net", 4).alias("net"), r("position", 4).alias("position"), "flat", F.array_join("failures", ",").alias("failures"), "final")


@query(f"""{LEDGER} SELECT bot_id, 'evidence' AS source, last_ts AS ts, round(CASE WHEN stopped AND flat AND failures = '' THEN gross + funding - fee ELSE least(0, gross + funding - fee) END, 7) AS net FROM c WHERE last_ts IS NOT NULL
UNION ALL SELECT o_custkey + 1000000 - o_custkey % 2 * 1000000, 'legacy', epoch_us(o_orderdate) // 1000000, round(o_totalprice / 1000 - o_totalprice / 10000, 7) FROM orders WHERE o_custkey + 1000000 - o_custkey % 2 * 1000000 NOT IN (SELECT bot_id FROM c WHERE last_ts IS NOT NULL)""")
def risk_events(spark, d):
    """Final results in full, others only as losses, and trades of bots without a ledger."""
    k = F.col("o_custkey")
    t = table(spark, d, "orders").select((k + 1000000 - k % 2 * 1000000).alias("bot_id"), epoch(F.col("o_orderdate")).alias("ts"), (F.col("o_totalprice") / 1000).alias("pnl"), (F.col("o_totalprice") / 10000).alias("fee"))
    return money.risk_events(ledgers(spark, d), t).select("bot_id", "source", "ts", r("net", 7).alias("net"))


@query("""SELECT ts - ts % 86400 AS day, round(sum(p), 7) AS gross, round(sum(f), 7) AS fees, round(sum(p) - sum(f), 7) AS net FROM (SELECT epoch_us(o_orderdate) // 1000000 AS ts, o_totalprice / 1000 AS p, o_totalprice / 10000 AS f FROM orders) GROUP BY 1""")
def daily_sums(spark, d):
    t = table(spark, d, "orders").select(epoch(F.col("o_orderdate")).alias("ts"), (F.col("o_totalprice") / 1000).alias("pnl"), (F.col("o_totalprice") / 10000).alias("fee"))
    return money.daily_sums(t).select("day", *[r(c, 7).alias(c) for c in ("gross", "fees", "net")])


@query("""SELECT o_custkey AS bot_id, count(*) AS n, round(sum(o_totalprice / 1000) - sum(o_totalprice / 10000), 7) AS net, epoch_us(min(o_orderdate)) // 1000000 AS first_ts, epoch_us(max(o_orderdate)) // 1000000 AS last_ts FROM orders GROUP BY 1""")
def trade_summary(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("bot_id"), epoch(F.col("o_orderdate")).alias("ts"), (F.col("o_totalprice") / 1000).alias("pnl"), (F.col("o_totalprice") / 10000).alias("fee"))
    return money.trade_summary(t).select("bot_id", "n", r("net", 7).alias("net"), "first_ts", "last_ts")


@query("""WITH RECURSIVE t AS (SELECT DISTINCT o_custkey AS k, epoch_us(o_orderdate) // 1000000 AS ts FROM orders), g AS (SELECT k, min(ts) AS ts FROM t GROUP BY k
UNION ALL SELECT g.k, (SELECT min(t.ts) FROM t WHERE t.k = g.k AND t.ts >= g.ts + 90 * 86400) FROM g WHERE EXISTS (SELECT 1 FROM t WHERE t.k = g.k AND t.ts >= g.ts + 90 * 86400)) SELECT k, ts FROM g""")
def embargoed_times(spark, d):
    """Times of validation that keep an embargo between them."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), epoch(F.col("o_orderdate")).alias("ts"))
    return stats.apart_by(o, "k", "ts", 90 * DAY)


@query("""WITH a AS (SELECT o_custkey AS k, epoch_us(o_orderdate) // 1000000 AS ts, epoch_us(o_orderdate) // 1000000 + CASE WHEN o_orderkey % 9 = 0 THEN -5 ELSE 604800 END AS av FROM orders), v AS (SELECT DISTINCT k, ts FROM a)
SELECT v.k, v.ts AS v_ts, count(a.av) AS n_train, max(a.av) AS last_label FROM v LEFT JOIN a ON a.k = v.k AND a.av >= a.ts AND a.av < v.ts GROUP BY ALL""")
def purged_training(spark, d):
    """What may be trained on at each time of validation."""
    label = F.col("ts") + F.when(F.col("o_orderkey") % 9 == 0, -5).otherwise(7 * DAY)
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", epoch(F.col("o_orderdate")).alias("ts")).withColumn("available", label)
    return stats.purged(o, o.select("k", F.col("ts").alias("v_ts")), "k", "ts", "available")


@query("""SELECT o_orderpriority AS bot, count(*) FILTER (l_orderkey IS NULL) AS pending, count(*) FILTER (l_orderkey IS NULL AND o_orderkey % 3 = 0) AS unattempted, min(epoch_us(o_orderdate) // 1000000 + 43320) FILTER (l_orderkey IS NULL) AS oldest_due FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey GROUP BY 1""")
def worker_liveness(spark, d):
    """Rows that wait for an outcome, those never tried, and the oldest due time, by strategy."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    x = table(spark, d, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    waits = F.col("l_orderkey").isNull()
    due = P.label_due(epoch(F.col("o_orderdate")), F.lit(43200))
    return x.groupBy(F.col("o_orderpriority").alias("bot")).agg(F.count_if(waits).alias("pending"), F.count_if(waits & (F.col("o_orderkey") % 3 == 0)).alias("unattempted"), F.min(F.when(waits, due)).alias("oldest_due"))


@query("""SELECT (props->>'$.k')::BIGINT % 4 AS status, event_type, count(*) AS n FROM events GROUP BY ALL""")
def json_status_counts(spark, d):
    """Counts by a status inside JSON."""
    e = table(spark, d, "events").select("event_type", (F.get_json_object("props", "$.k").try_cast("long") % 4).alias("status"))
    return e.groupBy("status", "event_type").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS}, c AS (SELECT symbol, count(*) AS n, max(ts) AS last FROM b GROUP BY symbol), m AS (SELECT max(ts) AS now FROM b)
SELECT n_name AS symbol, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no_rows' WHEN n < 100 THEN 'too_few' WHEN now - last > 7200 THEN 'stale' ELSE 'ready' END AS state FROM (SELECT n_name FROM nation UNION ALL SELECT DISTINCT event_type FROM events) LEFT JOIN c ON symbol = n_name, m""")
def warmup_readiness(spark, d):
    """Configured symbols with their rows, freshness and what they still lack."""
    b = hourly(spark, d)
    c = b.groupBy("symbol").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    names = table(spark, d, "nation").select(F.col("n_name").alias("symbol")).unionByName(table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct())
    x = names.join(c, "symbol", "left").withColumn("now", newest(b))
    state = F.when(F.col("n").isNull(), "no_rows").when(F.col("n") < 100, "too_few").when(F.col("now") - F.col("last") > 2 * HOUR, "stale").otherwise("ready")
    return x.select("symbol", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


@query("""WITH p AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000000 AS ts FROM orders), q AS (SELECT *, ts + 30 * 86400 AS until FROM p WHERE o_orderkey % 3 = 0)
SELECT p.o_orderkey, arg_max(q.o_orderkey, (q.ts, q.o_orderkey)) AS root FROM p LEFT JOIN q ON p.o_custkey = q.o_custkey AND q.ts <= p.ts AND p.ts < q.until AND q.o_orderkey <> p.o_orderkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = q.o_orderkey AND l_returnflag = 'R') GROUP BY p.o_orderkey""")
def open_roots(spark, d):
    """Each row's newest root that is within its horizon and has no outcome yet."""
    p = table(spark, d, "orders").select("o_orderkey", "o_custkey", epoch(F.col("o_orderdate")).alias("ts"))
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    q = p.where("o_orderkey % 3 = 0").join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_custkey", F.col("o_orderkey").alias("root"), F.col("ts").alias("root_ts"))
    held = joins.in_range(p, q, "o_custkey", F.col("ts"), F.col("root_ts"), F.col("root_ts") + 30 * DAY, 30 * DAY).where("root <> o_orderkey")
    best = held.groupBy("o_orderkey").agg(F.max_by("root", F.struct("root_ts", "root")).alias("root"))
    return p.select("o_orderkey").join(best, "o_orderkey", "left")


@query(f"""WITH {TRADES}, o AS (SELECT trade_id, user_id % 20 AS u, ts FROM t WHERE trade_id % 11 = 0), m AS (SELECT max(ts) AS now FROM t) SELECT DISTINCT u FROM o, m WHERE ts + 172800 >= now""")
def capture_scope(spark, d):
    """Keys that still have an open window."""
    t = trades(spark, d)
    return t.where("trade_id % 11 = 0").select((F.col("user_id") % 20).alias("u"), "ts").where(F.col("ts") + 2 * DAY >= newest(t)).select("u").distinct()


@query("""SELECT o_orderkey, sha256('{"bot":' || to_json(o_orderpriority) || ',"key":' || o_custkey || ',"state":' || to_json(o_orderstatus) || '}') AS fingerprint FROM orders""")
def fingerprints(spark, d):
    """SHA-256 of a contract as JSON with sorted names."""
    o = table(spark, d, "orders")
    canonical = F.to_json(F.struct(F.col("o_orderpriority").alias("bot"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("state")))
    return o.select("o_orderkey", F.sha2(canonical, 256).alias("fingerprint"))


@query("""SELECT doc_id, list_contains(w, 'que') AS single, contains(array_to_string(w, ' '), 'in the') AS phrase FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+') AS w FROM documents)""")
def keyword_routing(spark, d):
    """Single keywords among tokens, phrases in their order."""
    from ..functions import sentiment

    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", sentiment.keyword_match(t, "que").alias("single"), sentiment.keyword_match(t, "in the").alias("phrase"))


@query("""SELECT o_orderpriority AS bot, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS wins, count(*) FILTER (o_orderstatus <> 'F') AS losses, 2 * least(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus <> 'F')) AS effective, round(avg((o_orderstatus = 'F')::INT), 9) AS win_rate FROM orders GROUP BY 1""")
def label_balance(spark, d):
    """Wins and losses, and what a fit may count on."""
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("bot"), (F.col("o_orderstatus") == "F").alias("won"))
    return intervals.label_balance(x, "bot", "won").withColumn("win_rate", r("win_rate", 9))


@query("""WITH m AS (SELECT l_returnflag, sum(l_tax) AS w, sum(l_tax * l_quantity) / sum(l_tax) AS q, sum(l_tax * l_discount) / sum(l_tax) AS d FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(any_value(q), 6) AS l_quantity_mean, round(any_value(d), 6) AS l_discount_mean, round(sqrt(sum(l_tax * (l_quantity - q) ** 2) / any_value(w)), 6) AS l_quantity_std, round(sqrt(sum(l_tax * (l_discount - d) ** 2) / any_value(w)), 6) AS l_discount_std FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def weighted_moments(spark, d):
    """Weighted mean and deviation of features."""
    got = intervals.weighted_moments(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"], "l_tax")
    return got.select("l_returnflag", *[r(c).alias(c) for c in got.columns[1:]])


@query()
def return_intervals(spark, d):
    """Intervals and one-sided bounds of weighted mean returns."""
    ret = F.col("l_discount") - F.col("l_tax")
    x = stats.weighted_returns(table(spark, d, "lineitem").select("l_suppkey", ret.alias("ret"), F.col("l_quantity").alias("w")), "l_suppkey", "ret", "w")
    low, high = intervals.mean_interval(F.col("mean"), F.col("std"), F.col("n_eff"))
    return x.select("l_suppkey", r("mean").alias("mean"), r(low).alias("low"), r(high).alias("high"), r(intervals.lower_bound(F.col("mean"), F.col("std"), F.col("n_eff"))).alias("bound"))


@query("""WITH RECURSIVE c AS (SELECT o_orderpriority AS k, epoch_us(o_orderdate) // 1000000 AS t, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT *, sum(n) OVER w - n AS before, row_number() OVER w - 1 AS place FROM c WINDOW w AS (PARTITION BY k ORDER BY t)),
s AS (SELECT k, sum(n)::BIGINT AS total, count(*) AS times FROM c GROUP BY k HAVING sum(n) >= 80 AND count(*) > 5), f AS (SELECT *, greatest(40, total // (least(5, greatest(2, total // 40)) + 1)) AS width FROM s),
l AS (SELECT f.*, (SELECT max({'place': place, 'before': before}) FROM p WHERE p.k = f.k AND before <= total - 40 AND place <= times - 5) AS last FROM f), o AS (SELECT * FROM l WHERE last.before >= 40 AND total - last.before >= 40),
g AS (SELECT k, (SELECT min({'place': place, 'before': before}) FROM p WHERE p.k = o.k AND before >= width AND place >= 1 AND place < last.place) AS spot FROM o UNION ALL
  SELECT k, (SELECT min({'place': place, 'before': before}) FROM p WHERE p.k = g.k AND before >= g.spot.before + o.width AND place < o.last.place) FROM g JOIN o USING (k) WHERE g.spot IS NOT NULL),
b AS (SELECT k, spot FROM g WHERE spot IS NOT NULL UNION SELECT k, last FROM o), e AS (SELECT k, spot.place AS a, lead(spot.place) OVER w AS z, row_number() OVER w - 1 AS block FROM b WINDOW w AS (PARTITION BY k ORDER BY spot.place))
SELECT e.k AS bot, block::INT AS block, min(t) AS first_ts, max(t) AS last_ts, sum(n)::BIGINT AS n, count(*)::INT AS n_times FROM e JOIN p ON p.k = e.k AND p.place >= a AND (z IS NULL OR p.place < z) GROUP BY e.k, block""")
def validation_blocks(spark, d):
    """Blocks of validation on whole times."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("bot"), epoch(F.col("o_orderdate")).alias("ts"))
    return intervals.validation_blocks(o, "bot", "ts", 40)


@query(f"""WITH x AS (SELECT *, {SIDES} AS side, l_linenumber % 2 = 0 AS grid, l_linenumber <> 5 AS linear, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax * 100 END AS spread, CASE WHEN l_linenumber <> 6 THEN (l_discount - 0.05) / 100 END AS rate, 1700000000 + l_suppkey AS now, 1700000000 - l_partkey * 60 AS nxt, CASE l_suppkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 240 END AS minutes FROM lineitem),
s AS (SELECT *, coalesce(spread, CASE WHEN linear THEN 10.0 ELSE 8.0 END)::DOUBLE AS sp, coalesce(minutes * 60, 28800) AS gap FROM x),
k AS (SELECT *, greatest(CASE WHEN linear THEN 1.0 ELSE 0.8 END::DOUBLE, sp * CASE WHEN grid THEN 0.35 ELSE 0.5 END::DOUBLE) AS slip, CASE side WHEN 'long' THEN rate * 10000 WHEN 'short' THEN -rate * 10000 ELSE CASE WHEN grid AND linear THEN abs(rate) * 10000 ELSE 0 END END AS each, nxt + ((now - nxt) // gap + 1) * gap AS rolled FROM s),
e AS (SELECT *, CASE WHEN linear AND rate IS NOT NULL THEN CASE WHEN now + 43200 >= rolled THEN 1 + (now + 43200 - rolled) // gap ELSE 0 END ELSE 0 END AS events FROM k)
SELECT l_orderkey, l_linenumber, round(sp, 6) AS spread_bps, round(slip, 6) AS slippage_bps, round(11 + sp + slip, 6) AS execution_bps, events::BIGINT AS funding_events, round(coalesce(each * events, 0), 6) AS funding_bps, round(11 + sp + slip + greatest(0, coalesce(each * events, 0)), 6) AS net_bps FROM e""")
def cost_model(spark, d):
    """Fees, spread, slippage and funding of trades until their horizon."""
    n, supp = F.col("l_linenumber"), F.col("l_suppkey")
    got = C.cost_model(
        n % 2 == 0, n != 5, F.col("side"), F.when(n != 3, F.col("l_tax") * 100), F.lit(5.5), F.when(n != 6, (F.col("l_discount") - 0.05) / 100), 1700000000 - F.col("l_partkey") * 60, F.when(supp % 3 == 0, 60).when(supp % 3 == 1, 240), 1700000000 + supp, F.lit(43200)
    )
    return lines(spark, d).select("l_orderkey", "l_linenumber", *[r(got[c]).alias(c) for c in ("spread_bps", "slippage_bps", "execution_bps")], got["funding_events"].alias("funding_events"), r(got["funding_bps"]).alias("funding_bps"), r(got["net_bps"]).alias("net_bps"))


@query(f"""WITH x AS (SELECT *, {SIDES} AS side, l_extendedprice AS p, [CASE WHEN l_linenumber > 1 THEN l_linenumber::DOUBLE END, CASE WHEN l_linenumber > 2 THEN (l_suppkey % 3 + 2)::DOUBLE END, CASE WHEN l_linenumber = 7 THEN 1.5 END] AS c FROM lineitem),
y AS (SELECT *, list_distinct([v::BIGINT FOR v IN c IF v IS NOT NULL AND v = floor(v)]) AS vs, len([v FOR v IN c IF v IS NOT NULL AND v <> floor(v)]) AS bad FROM x)
SELECT l_orderkey, l_linenumber, bad = 0 AND len(vs) <= 1 AS ok, CASE WHEN len(vs) = 1 THEN vs[1] END AS value, list_min(vs) AS least, list_max(vs) AS most, CASE side WHEN 'long' THEN p * 1.1::DOUBLE WHEN 'short' THEN p * 0.9::DOUBLE END AS take_profit, CASE side WHEN 'long' THEN p * 0.9::DOUBLE WHEN 'short' THEN p * 1.1::DOUBLE END AS stop_loss,
  CASE WHEN side = 'neutral' THEN NULL WHEN (side = 'long') = (l_linenumber % 2 = 0) THEN 'Buy' ELSE 'Sell' END AS order_side, CASE WHEN side <> 'neutral' THEN l_linenumber % 2 <> 0 END AS reduce_only, round(CASE WHEN l_linenumber % 3 = 0 THEN (p - 20000) / p ELSE (20000 - p) / p END * 100, 9) AS room FROM y""")
def order_plans(spark, d):
    """Integers of several names, exits between kill switches, sides of orders and room to a bound."""
    n, p = F.col("l_linenumber"), F.col("l_extendedprice")
    found = C.resolved_integer(F.when(n > 1, n), F.when(n > 2, F.col("l_suppkey") % 3 + 2), F.when(n == 7, F.lit(1.5)))
    x = lines(spark, d).withColumn("i", found).withColumn("x", C.exits(F.col("side"), p * 0.9, p * 1.1)).withColumn("o", C.order_side(F.col("side"), F.when(n % 2 == 0, "open").otherwise("close")))
    room = C.distance_to_bound(p, F.lit(20000.0), F.when(n % 3 == 0, "lower").otherwise("upper"))
    return x.select("l_orderkey", "l_linenumber", "i.ok", "i.value", "i.least", "i.most", "x.take_profit", "x.stop_loss", F.col("o.side").alias("order_side"), "o.reduce_only", r(room, 9).alias("room"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN NULL ELSE (l_discount - 0.01) END AS a, l_tax - 0.005 AS b, l_discount AS m, l_tax AS t, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE -l_tax / 2 END AS tail, l_quantity / 50 AS conf FROM lineitem),
v AS (SELECT *, least(a, b) AS lo, least(m, t) AS mean, least(1, greatest(0, (conf - 0.2) / (1 - 0.2::DOUBLE))) AS margin FROM x),
u AS (SELECT *, lo + 0.20::DOUBLE * margin * greatest(0, mean - lo) - 0.05::DOUBLE * greatest(0, -tail) AS value, concat_ws(',', CASE WHEN NOT (conf >= 0.2::DOUBLE AND conf <= 1) THEN 'CANDIDATE_CONFIDENCE_BELOW_VALIDATED_POLICY' END, CASE WHEN a IS NULL THEN 'POLICY_LOWER_BOUND_UNAVAILABLE' END, CASE WHEN a IS NOT NULL AND lo <= 0 THEN 'POLICY_LOWER_BOUND_NON_POSITIVE' END, CASE WHEN tail IS NULL THEN 'EXPECTED_SHORTFALL_UNAVAILABLE' END) AS codes FROM v)
SELECT l_orderkey, l_linenumber, round(CASE WHEN codes = '' THEN value END, 9) AS utility, CASE WHEN codes = '' AND value <= 0.00005::DOUBLE THEN 'RISK_ADJUSTED_UTILITY_NON_POSITIVE' ELSE codes END AS codes FROM u""")
def candidate_utility(spark, d):
    """Utility of candidates and what keeps them from counting."""
    n = F.col("l_linenumber")
    lower = [F.when(n != 4, F.col("l_discount") - 0.01), F.col("l_tax") - 0.005]
    got = C.utility(lower, [F.col("l_discount"), F.col("l_tax")], F.when(F.col("l_suppkey") % 9 != 0, -F.col("l_tax") / 2), F.col("l_quantity") / 50, F.lit(0.2))
    return lines(spark, d).select("l_orderkey", "l_linenumber", r(got["utility"], 9).alias("utility"), F.array_join(got["codes"], ",").alias("codes"))


@query("""WITH f AS (SELECT l_suppkey % 40 AS venue, l_partkey % 60 AS symbol, max(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), a AS (SELECT symbol, arg_min(q, venue) AS q FROM f GROUP BY symbol)
SELECT o_orderkey, coalesce(f.q, a.q) AS q FROM orders LEFT JOIN f ON f.venue = o_custkey % 50 AND f.symbol = o_orderkey % 70 LEFT JOIN a ON a.symbol = o_orderkey % 70""")
def feature_fallback(spark, d):
    """Features of a venue and symbol, or of the symbol anywhere."""
    f = table(spark, d, "lineitem").where("l_linenumber = 1").groupBy((F.col("l_suppkey") % 40).alias("venue"), (F.col("l_partkey") % 60).alias("symbol")).agg(F.max("l_quantity").alias("q"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("venue"), (F.col("o_orderkey") % 70).alias("symbol"))
    return relational.with_fallback(o, f, ["venue", "symbol"], ["symbol"], ["q"]).select("o_orderkey", "q")


@query("""SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 // 86400 * 86400 AS day, NOT (o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0) AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS valid FROM orders""")
def valid_quotes(spark, d):
    """Tickers that can be trusted, and the day they belong to."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    bid = F.when(k % 3 != 0, F.when(k % 5 == 0, p * 1.01).otherwise(p * 0.99))
    ok = C.valid_quote(F.when(k % 2 == 0, p), bid, p, F.when(k % 7 == 0, -1.0), F.when(k % 11 == 0, float("nan")).when(k % 13 == 0, 0.0))
    return table(spark, d, "orders").select("o_orderkey", C.day_start(epoch(F.col("o_orderdate"))).alias("day"), ok.alias("valid"))
