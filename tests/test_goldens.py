"""Operators on small inputs whose results are known."""

import math
import random
from collections import namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import costs as C
from tidemark.functions import policy as P
from tidemark.functions import sentiment as S
from tidemark.operators import bars, indicators, intervals, labels, money, relational, routing, sentiment, stats
from tidemark.streaming import states


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(name) for name, c in columns.items()]).first()


@pytest.mark.parametrize("n,cap", [(0, 0.0), (1, 0.40), (2, 0.52), (3, 0.64), (4, 0.75), (5, 0.81), (9, 0.85)])
def test_regime_confidence_is_capped_by_its_sample(spark, n, cap):
    rows = spark.createDataFrame([(0.03, 0.7, 5.0)] * n, "atr_pct double, trend_strength double, spread_bps double")
    got = bars.regime(rows).first()
    assert got.confidence == pytest.approx(cap)
    assert (got.vol_state, got.trend_state, got.risk_state) == (("normal", "trending", "risk_on") if n else ("unknown",) * 3)


def test_regime_states(spark):
    rows = spark.createDataFrame([(0.07, 0.2, 9.0), (0.07, 0.2, 9.0)], "atr_pct double, trend_strength double, spread_bps double")
    got = bars.regime(rows).first()
    assert (got.vol_state, got.trend_state, got.risk_state) == ("high", "ranging", "risk_off")


def test_features_need_thirty_valid_bars(spark):
    rows = [("a", 3600 * i, 10.0, 11.0, 9.0, 10.0 + i % 2, 1.0) for i in range(40)] + [("b", 3600 * i, 10.0, 11.0, 9.0, 10.0, 1.0) for i in range(29)] + [("b", 3600 * 29, 10.0, 9.0, 9.0, 10.0, 1.0)]
    got = bars.bar_features(spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")).collect()
    assert len(got) == 11 and {r.symbol for r in got} == {"a"}
    last = max(got, key=lambda r: r.ts)
    assert last.slope == pytest.approx((last.sma20 - last.sma60) / last.close)


def test_features_of_all_bars_if_asked(spark):
    rows = [("a", 3600 * i, 10.0, 11.0, 0.0 if i == 5 else 9.0, 10.0 + i % 2, 1.0) for i in range(40)]  # one low of 0
    df = spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")
    assert (bars.bar_features(df).count(), bars.bar_features(df, valid_only=False).count()) == (10, 11)
    shut = df.withColumn("close", F.when(F.col("ts") == 3600 * 35, 0.0).otherwise(F.col("close")))
    got = {r.ts // 3600: r.ret for r in bars.bar_features(shut, valid_only=False).collect()}
    assert (got[35], got[36]) == (-math.inf, math.inf)


def test_dealt_parts_grow_with_the_rows(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("k"), "id")
    got = relational.dealt(df, ["k"], rows=100)
    held = got.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert got.rdd.getNumPartitions() == 40 and sum(r.n for r in held) == 4000 and max(r.n for r in held) < 400
    assert got.select("k", F.spark_partition_id().alias("part")).distinct().count() == 1000


def test_rsi(spark):
    of = lambda xs: one(spark, x=indicators.rsi(F.array(*[F.lit(float(v)) for v in xs]))).x
    assert of([5] * 30) == 50 and of(range(1, 16)) == 50 and of(range(1, 17)) == 100
    assert of(range(30, 0, -1)) == pytest.approx(0)


def mean_reversion_scores(spark, phi):
    rows = []
    for seed in range(40):
        rng, value, price = random.Random(seed), 0.0, 100.0
        for i in range(161):
            rows.append((seed, i, price))
            value = phi * value + rng.gauss(0.0, 0.001)
            price *= 2.718281828459045**value
    got = indicators.mean_reversion(spark.createDataFrame(rows, "symbol long, ts long, close double")).collect()
    return [r.score for r in got]


def test_mean_reversion_tells_noise_from_reversal(spark):
    assert sum(s >= 0.55 for s in mean_reversion_scores(spark, 0.0)) <= 1
    assert sum(s >= 0.55 for s in mean_reversion_scores(spark, -0.35)) >= 28


T0 = 1_700_000_040  # a whole minute


def touch(spark, candles, direction="long", target=104.0, stop=98.0, boundary=None):
    rows = [("s", T0 + 60 * i, *c, 1.0) for i, c in enumerate(candles)]
    if boundary:
        rows.append(("s", T0 + 60 * len(candles), boundary, boundary, boundary, boundary, 1.0))
    b = spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")
    e = spark.createDataFrame([(1, "s", T0, 100.0, target, stop, direction, 10.0)], "entry_id long, symbol string, entry_ts long, entry double, target double, stop double, direction string, cost_bps double")
    return labels.first_touch(e, b, "symbol", 60, 60 * len(candles)).first()


def test_first_touch_events(spark):
    tp = touch(spark, [(100.0, 101.0, 99.0, 100.5), (100.5, 104.2, 100.0, 103.9)])
    assert (tp.event, tp.exit_price, tp.exit_ts, tp.success) == ("TP_FIRST", 104.0, T0 + 60, 1)
    assert tp.gross == pytest.approx(0.04) and tp.net == pytest.approx(0.039) and tp.mfe == pytest.approx(0.04) and tp.mae == pytest.approx(-0.01)
    sl = touch(spark, [(100.0, 101.0, 99.0, 99.5), (99.5, 100.0, 97.8, 98.1)])
    assert (sl.event, sl.exit_reason, sl.exit_price, sl.success) == ("SL_FIRST", "stop_loss", 98.0, 0)
    assert sl.mfe == pytest.approx(0.01) and sl.mae == pytest.approx(-0.02)
    end = touch(spark, [(100.0, 101.0, 99.0, 100.4), (100.4, 101.5, 99.5, 101.0)], boundary=101.2)
    assert (end.event, end.exit_price, end.exit_ts) == ("HORIZON_EXIT", 101.2, T0 + 120)
    assert touch(spark, [(100.0, 101.0, 99.0, 100.4)]).event == "UNAVAILABLE"
    assert touch(spark, [(100.0, 104.5, 97.5, 101.0)]).event == "AMBIGUOUS"
    assert touch(spark, [(100.0, 101.0, 99.0, 100.0)], target=99.0).event == "INVALID"


def test_first_touch_of_shorts_and_gaps(spark):
    gap = touch(spark, [(100.0, 101.0, 99.0, 101.0), (103.0, 109.0, 90.0, 100.0)], "short", target=96.0, stop=102.0)
    assert (gap.event, gap.exit_reason, gap.exit_price) == ("SL_FIRST", "stop_loss_gap", 103.0)
    assert gap.gross == pytest.approx(-0.03) and gap.mae == pytest.approx(-0.03) and gap.mfe == pytest.approx(0.01)
    won = touch(spark, [(95.0, 101.0, 80.0, 96.0)], "short", target=96.0, stop=102.0)
    assert (won.event, won.exit_price, won.mfe) == ("TP_FIRST", 96.0, pytest.approx(0.04))


def test_walk_forward_trains_on_labels_that_were_known(spark):
    rows = [("k", ts, ts + 220) for ts in (1000, 1100, 1200, 1300, 1400)]
    df = spark.createDataFrame(rows, "k string, ts long, available long")
    got = {r.v_ts: (r.n_train, r.last_label) for r in stats.purged(df, df.select("k", F.col("ts").alias("v_ts")), "k", "ts", "available").collect()}
    assert [ts for ts, (n, _) in got.items() if n >= 2] == [1400] and got[1400] == (2, 1320)
    late = spark.createDataFrame([("k", 10, 20), ("k", 10, 5), ("k", 10, None)], df.schema)
    at = lambda t: stats.purged(late, late.select("k", F.lit(t).alias("v_ts")), "k", "ts", "available").first().n_train
    assert at(20) == 0 and at(21) == 1


def test_embargo(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 5, 9, 10, 19, 20, 20, 31)] + [("b", None)], "k string, ts long")
    assert sorted(r.ts for r in stats.apart_by(df, "k", "ts", 10).collect()) == [0, 10, 20, 31]


def test_routing(spark):
    schema = "k string, rec_id string, eligible boolean, utility double, lower double, confidence double"
    rows = [("one", "a", True, 0.0002, 0.0, 0.5), ("near", "a", True, 0.00210, 0.0, 0.5), ("near", "b", True, 0.00200, 0.0, 0.9), ("far", "a", True, 0.0030, 0.0, 0.1), ("far", "b", True, 0.0020, 0.0, 0.1)]
    rows += [("share", "a", True, 0.00020, 0.0, 0.1), ("share", "b", True, 0.00010, 0.0, 0.1), ("none", "a", True, 0.00005, 0.0, 0.1), ("none", "b", False, 0.9, 0.0, 0.1), ("none", "c", None, 0.9, 0.0, 0.1)]
    got = {r.k: (r.status, r.winner) for r in routing.select_strategy(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert got == {"one": ("selected", "a"), "near": ("no_clear_winner", None), "far": ("selected", "a"), "share": ("selected", "a"), "none": ("no_eligible_strategy", None)}


def test_lexicon(spark):
    texts = {"The bank approved a startup grant.": 0.0, "Bull breakout and growth with no hack": 0.5, "CRASH down": -1.0, None: 0.0, "up up ban's": 1.0}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.lexicon_score(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == texts
    got = one(spark, a=S.keyword_match(F.lit("To the near protocol!"), "near protocol"), b=S.keyword_match(F.lit("nearly"), "near"), c=S.keyword_match(F.lit("so NEAR."), "near"))
    assert (got.a, got.b, got.c) == (True, False, True)


def test_sentiment_of_sources_and_points(spark):
    both = spark.createDataFrame([("k", 1.0, 1.0), ("k", -1.0, 60.0)], "key string, sentiment double, volume double")
    assert sentiment.combined(both, "key").first().sentiment == pytest.approx((6 - 60) / 66)
    many = spark.createDataFrame([("k", "momentum", 1.0), ("k", "rss", -1.0), ("k", "rss", 0.0), ("k", "blog", -1.0)], "key string, source string, sentiment double")
    got = sentiment.blended(many, "key").first()
    assert got.n_sources == 2 and got.sentiment == pytest.approx((0.45 - 0.5 * 0.15) / 0.60)
    now = 1_700_000_000
    polls = spark.createDataFrame([("k", now - 30 * i, 1.0, 1.0) for i in range(6)] + [("k", now - 3600, -1.0, 1.0)], "key string, ts long, sentiment double, volume double")
    got = sentiment.symbol_sentiment(polls, "key", F.lit(now)).first()
    assert got.n_points == 2 or got.n_points == 3
    assert -1 <= got.effective <= 1


def test_ledger_needs_all_to_agree(spark):
    events = spark.createDataFrame([(1, 1, "execution", 10, "buy", 2.0, 0.0, 0.1, 0.0), (1, 2, "execution", 20, "sell", 2.0, 5.0, 0.1, 0.0), (1, 3, "funding", 30, None, None, None, 0.0, -0.5)], "bot_id long, event_id long, event_type string, ts long, side string, qty double, gross double, fee double, funding double")
    bots = spark.createDataFrame([(1, "stopped", 40), (2, "running", None)], "bot_id long, status string, stopped_ts long")
    snap = "bot_id long, ts long, complete boolean, open_orders long, position double, executions long, fundings long, gross double, fee double, funding double"
    of = lambda *rows: {r.bot_id: r for r in money.execution_summary(events, bots, spark.createDataFrame(rows, snap)).collect()}
    good = of((1, 50, True, 0, 0.0, 2, 1, 5.0, 0.2, -0.5), (1, 45, False, 9, 9.0, 0, 0, 0.0, 0.0, 0.0))
    assert good[1].final and good[1].net == pytest.approx(4.3) and good[1].failures == []
    assert not good[2].final and good[2].failures == ["missing_terminal_exchange_reconciliation"]
    bad = of((1, 35, True, 1, 0.5, 3, 1, 5.0, 0.3, None))
    assert bad[1].failures == ["exchange_reconciliation_precedes_bot_stop", "exchange_open_orders_remain", "exchange_position_not_flat", "execution_event_count_mismatch", "fee_mismatch", "funding_mismatch"] and not bad[1].final
    trades = spark.createDataFrame([(3, 1, 2.0, None), (1, 1, 9.0, 0.0)], "bot_id long, ts long, pnl double, fee double")
    got = {(r.bot_id, r.source): r.net for r in money.risk_events(money.execution_summary(events, bots, spark.createDataFrame([], snap)), trades).collect()}
    assert got == {(1, "evidence"): 0.0, (3, "legacy"): 2.0}


def test_rules(spark):
    lit = F.lit
    null = lambda t: lit(None).cast(t)
    got = one(
        spark,
        gate=P.mean_reversion_gate(null("boolean"), lit(4), lit(0.9), lit(0.5)), weak=P.mean_reversion_gate(lit(True), lit(3), lit(0.4), lit(0.5)), shock=P.shock_gate(lit("amber_down"), lit("neutral"), lit(False)),
        veto=P.fast_veto(lit("long"), lit(-0.006), lit(-0.01), lit(-0.018), lit(0.75)), calm=P.fast_veto(lit("long"), lit(-0.006), lit(-0.01), lit(-0.017), lit(0.75)), pays=P.funding_extreme(lit("short"), lit(-0.001), lit(1), lit(6.0)), side=P.funding_extreme(lit("neutral"), lit(0.001), lit(1), lit(60.0)),
        model=P.model_matches(lit("v1+fix"), "v1"), other=P.model_matches(lit("v10"), "v1"), conf=P.confidence(lit(0.9), null("double"), lit(0), lit(1.0), lit(False), lit(False)), mixed=P.confidence(lit(0.8), lit(0.4), lit(300), lit(0.92), lit(True), lit(True)),
        grid=P.horizon(lit("futures_grid"), lit(2), 60), trend=P.horizon(lit("directional_trend"), null("int"), 60), free=P.horizon(lit("x"), null("int"), 60), due=P.label_due(lit(100), lit(3600)), ms=P.seconds(lit(1_700_000_000_123)), s=P.seconds(lit(1_700_000_000)),
        liq=P.liquidation_buffer(lit("long"), lit(100.0), lit(120.0)), none=P.liquidation_buffer(lit("flat"), lit(100.0), lit(90.0)), tp=P.trigger_errors(lit("long"), lit("take_profit"), lit(100.0), lit(100.0)), ok=P.trigger_errors(lit("short"), lit("stop_loss"), lit(100.0), lit(101.0)), bad=P.trigger_errors(lit("flat"), lit("stop_loss"), lit(100.0), lit(101.0)),
    )
    assert (got.gate, got.weak, got.shock, got.veto, got.calm, got.pays, got.side) == ("blocked", "no_trade", None, "down_break", "normal", True, False)
    assert (got.model, got.other, got.conf) == (True, False, 0.70) and got.mixed == pytest.approx((0.5 / (1 + math.exp(-2.1 * 0.8)) + 0.2) * 0.92 * 0.88 * 0.93)
    assert (got.grid, got.trend, got.free, got.due, got.ms, got.s) == (21600, 43200, 60, 3820, 1_700_000_000, 1_700_000_000)
    assert (got.liq, got.none, got.ok, got.bad) == (0.0, None, [], ["PROTECTIVE_DIRECTION_INVALID"])
    assert got.tp == ["LONG_TP_TRIGGER_NOT_ABOVE_REFERENCE", "PROTECTIVE_TRIGGER_DIRECTION_MISMATCH"]


def test_t_critical_values():
    """Against the printed tables of the distribution."""
    want = {(0.95, 2): 6.3138, (0.975, 11): 2.2281, (0.95, 31): 1.6973, (0.975, 121): 1.9799, (0.99, 6): 3.3649, (0.975, 100_001): 1.9600}
    got = intervals.t_critical(np.array([c for c, _ in want]), np.array([float(n) for _, n in want]))
    assert got == pytest.approx(list(want.values()), abs=2e-4)
    assert np.isinf(intervals.t_critical(np.array([0.5, 0.95, 1.0]), np.array([9.0, 1.9, 9.0]))).all()


def plain_blocks(counts, least):
    """Block starts, tried time by time."""
    times = [i for i, n in enumerate(counts) for _ in range(n)]
    total, need = len(times), min(5, max(2, least))
    first = {i: times.index(i) for i in range(len(counts))}
    fits = [i for i in first if len(counts) - i >= need and total - first[i] >= least]
    if total < max(6, 2 * least) or len(counts) <= need or not fits or first[max(fits)] < least:
        return []
    width, found, target = max(least, total // (min(5, max(2, total // least)) + 1)), [], None
    target = width
    for i in range(1, max(fits)):
        if first[i] >= target:
            found.append(i)
            target = first[i] + width
    return [*found, max(fits)]


def test_validation_blocks(spark):
    rng = random.Random(3)
    counts = {str(k): [rng.randrange(1, 6) for _ in range(rng.randrange(1, 40))] for k in range(100)}
    many = spark.createDataFrame([(k, t) for k, ns in counts.items() for t, n in enumerate(ns) for _ in range(n)], "k string, ts long")
    for least in (1, 7):
        got = sorted((r.k, r.first_ts) for r in intervals.validation_blocks(many, "k", "ts", least).collect())
        assert got == sorted((k, at) for k, ns in counts.items() for at in plain_blocks(ns, least))
    df = spark.createDataFrame([("k", t) for t in range(20) for _ in range(2)] + [("few", 1), ("few", None)], "k string, ts long")
    got = sorted(intervals.validation_blocks(df, "k", "ts", 6).collect())
    assert [r.first_ts for r in got] == plain_blocks([2] * 20, 6) and sum(r.n for r in got) == 40 - 2 * got[0].first_ts and {r.k for r in got} == {"k"}


def test_states():
    Row = namedtuple("Row", "ts direction evidence")
    state, out = None, []
    for row in (Row(10, "long", 5), Row(20, "long", 5), Row(30, "long", 6), Row(40, "short", 7), Row(50, "long", 8), Row(500, "long", 9), Row(510, "long", 8), Row(520, "long", None), Row(530, "long", 9)):
        state, (count, passed) = states.confirm(state, row, 100, 2)
        out.append((count, passed))
    assert out == [(1, False), (1, False), (2, True), (1, False), (1, False), (1, False), (1, False), (0, False), (1, False)]
    Veto = namedtuple("Veto", "ts state")
    state, out = None, []
    for row in (Veto(0, "normal"), Veto(10, "up_break"), Veto(60, "normal"), Veto(130, "normal"), Veto(131, "normal")):
        state, values = states.hold_veto(state, row, 120)
        out.append(values)
    assert out == [("normal", False), ("up_break", False), ("up_break", True), ("up_break", True), ("normal", False)]


def test_costs(spark):
    lit = F.lit
    base = dict(grid=lit(True), linear=lit(True), direction=lit("long"), spread_bps=lit(4.0), taker_bps=lit(5.5), rate=lit(0.0001), next_funding=lit(1_700_000_000), interval_min=lit(480), now=lit(1_700_000_000), horizon=lit(43200))
    of = lambda **change: one(spark, **C.cost_model(**(base | change)))
    got = of()
    # the event at this very moment is past: the next is in eight hours, one until the horizon
    assert (got.fee_bps, got.slippage_bps, got.execution_bps, got.funding_events) == (11.0, pytest.approx(1.4), pytest.approx(16.4), 1)
    assert got.funding_bps == pytest.approx(1.0) and got.net_bps == pytest.approx(17.4)
    short = of(direction=lit("short"))
    assert short.funding_bps == pytest.approx(-1.0) and short.net_bps == pytest.approx(16.4) and short.signed_bps == pytest.approx(15.4)
    assert of(spread_bps=lit(None).cast("double")).spread_bps == 10.0 and of(next_funding=lit(None).cast("long")).funding_events == 2
    assert of(next_funding=lit(1_699_990_000_000), interval_min=lit(60)).funding_events == 12 and of(rate=lit(None).cast("double")).funding_events == 0
    assert of(direction=lit("neutral"), rate=lit(-0.0001)).funding_bps == pytest.approx(1.0)


def test_orders_and_bounds(spark):
    lit = F.lit
    got = one(
        spark, same=C.resolved_integer(lit(3), lit(3.0), lit(None).cast("int")), two=C.resolved_integer(lit(3), lit(5)), bad=C.resolved_integer(lit(2.5)), none=C.resolved_integer(lit(None).cast("int")),
        short=C.exits(lit("short"), lit(90.0), lit(110.0)), flat=C.exits(lit("neutral"), lit(90.0), lit(110.0)), close=C.order_side(lit("long"), lit("close")), no=C.order_side(lit("neutral"), lit("open")), room=C.distance_to_bound(lit(100.0), lit(120.0), lit("lower")),
        crossed=C.valid_quote(lit(1.0), lit(2.0), lit(1.0), lit(0.0), lit(None).cast("double")), day=C.day_start(lit(1_700_000_000), "America/Chicago"),
    )
    assert tuple(got.same) == (True, 3, 3, 3, 0) and tuple(got.two) == (False, None, 3, 5, 0) and tuple(got.bad) == (False, None, None, None, 1) and tuple(got.none) == (True, None, None, None, 0)
    assert tuple(got.short) == (90.0, 110.0) and tuple(got.flat) == (None, None) and tuple(got.close) == ("Sell", True) and got.no is None
    assert got.room == pytest.approx(-20) and got.crossed is False and got.day == 1_699_941_600


def test_utility(spark):
    lit = F.lit
    of = lambda lower, shortfall, confidence: one(spark, **C.utility([lit(lower), lit(0.01)], [lit(0.02), lit(0.03)], lit(shortfall), lit(confidence), lit(0.5)))
    got = of(0.004, -0.02, 0.75)
    assert got.codes == [] and got.utility == pytest.approx(0.004 + 0.2 * 0.5 * 0.016 - 0.05 * 0.02)
    assert of(0.004, -0.2, 0.5).codes == ["RISK_ADJUSTED_UTILITY_NON_POSITIVE"]
    assert of(-0.1, None, 0.4).codes == ["CANDIDATE_CONFIDENCE_BELOW_VALIDATED_POLICY", "POLICY_LOWER_BOUND_NON_POSITIVE", "EXPECTED_SHORTFALL_UNAVAILABLE"]


def test_features_fall_back_to_the_symbol(spark):
    f = spark.createDataFrame([("b", "s", 2), ("a", "s", 1), ("a", "t", 3)], "venue string, symbol string, x long")
    rows = spark.createDataFrame([(1, "b", "s"), (2, "z", "s"), (3, "z", "u")], "id long, venue string, symbol string")
    assert {r.id: r.x for r in relational.with_fallback(rows, f, ["venue", "symbol"], ["symbol"], ["x"]).collect()} == {1: 2, 2: 1, 3: None}


def test_market_sentiment_reads_a_week_within_bounds(spark):
    """Outliers are cut to -1..1 and older points do not count: the value of an hour's half life by hand."""
    now = 40 * 86400
    df = spark.createDataFrame([("m", now - 600, -0.2, 1.0), ("m", now - 3600, -5.0, 1.0), ("m", now - 30 * 86400, 1.0, 1.0)], "key string, ts long, sentiment double, volume double")
    got = sentiment.market_sentiment(df.withColumn("now", F.lit(now)), "key", F.col("now")).first()
    young, old = 0.5 ** (600 / 3600), 0.5
    assert got.n_points == 2 and got.s_1h == pytest.approx((-0.2 * young - old) / (young + old)) and got.s_1h == pytest.approx(-0.49, abs=0.005)


def test_frames_under_eighty_closed_bars_do_not_vote(spark):
    bars = [("s", f, f * i, 1.0 + i / 1000, 1.0, 1.0 + i / 2000) for f, n in ((900, 80), (1800, 81), (14400, 600)) for i in range(n)]
    df = spark.createDataFrame(bars, "symbol string, frame long, ts long, high double, low double, close double")
    now = 14400 * 600 - 1  # the last bar of four hours is open, shorter frames ended long ago
    got = {r.frame: r.n for r in indicators.frame_votes(df, now).collect()}
    assert got == {900: 80, 1800: 81, 14400: 419}
    assert {r.frame for r in indicators.frame_votes(df.where("frame < 14400"), 80 * 1800 + 1).collect()} == {900, 1800}
    assert {r.frame for r in indicators.frame_votes(df.where("frame = 900"), 80 * 900 - 1).collect()} == set()
