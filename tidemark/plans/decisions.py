"""Registered queries on decisions: votes and direction, grids, first-touch value, scalers, messages and keyed streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import direction as D
from ..functions import grid as G
from ..operators import bars as B
from ..operators import indicators, models, relational
from ..sources import messages
from ..sources.tables import epoch, table, trades
from ..streaming import candles, states
from .market import DAY, TRADES, _drained, newest, query, r


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_discount - 0.05 AS slope, 0.01 + l_tax / 2 AS atr, (l_tax - 0.04) / 10 AS hist, l_quantity * 2 AS rsi, l_linenumber / 7.0::DOUBLE AS b FROM lineitem),
c AS (SELECT *, greatest(-1.0, least(1.0, slope / greatest(1e-6::DOUBLE, atr) * 0.22::DOUBLE)) AS s, greatest(-1.0, least(1.0, hist / greatest(1e-9::DOUBLE, atr) * 4.0)) AS m,
  greatest(-1.0, least(1.0, (rsi - 50) / 30)) AS x, greatest(-1.0, least(1.0, (b - 0.5::DOUBLE) * 2)) AS v FROM x)
SELECT l_orderkey, l_linenumber, round(0.55::DOUBLE * s + 0.22::DOUBLE * m + 0.15::DOUBLE * x + 0.08::DOUBLE * v, 6) AS score, round(abs(s) * 0.75::DOUBLE + abs(m) * 0.25::DOUBLE, 6) AS trend_strength FROM c""")
def frame_vote(spark, d):
    """A frame's vote from slope, MACD, RSI and band position."""
    vote = D.vote(F.col("l_discount") - 0.05, 0.01 + F.col("l_tax") / 2, (F.col("l_tax") - 0.04) / 10, F.col("l_quantity") * 2, F.col("l_linenumber") / 7.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(vote["score"]).alias("score"), r(vote["trend_strength"]).alias("trend_strength"))


DECIDED = """y AS (SELECT *, greatest(-1.0, least(1.0, x)) AS s FROM v),
a AS (SELECT k, round(coalesce(sum(w * s) FILTER (i <= 3) / sum(w) FILTER (i <= 3), 0), 9) AS tactical, round(coalesce(sum(w * s) FILTER (i > 3) / sum(w) FILTER (i > 3), 0), 9) AS structural, round(sum(w * s) / sum(w), 9) AS s, round(sum(w * t) / sum(w), 9) AS trendiness,
  coalesce(sum(w) FILTER (s > 0.1::DOUBLE), 0) AS up, coalesce(sum(w) FILTER (s < -0.1::DOUBLE), 0) AS down, sum(w) AS total FROM y GROUP BY k),
b AS (SELECT *, CASE WHEN s > 0.1::DOUBLE THEN 'long' WHEN s < -0.1::DOUBLE THEN 'short' ELSE 'neutral' END AS bias, CASE WHEN structural > 0.1::DOUBLE THEN 'long' WHEN structural < -0.1::DOUBLE THEN 'short' ELSE 'neutral' END AS base FROM a),
c AS (SELECT *, round(CASE WHEN base = 'neutral' OR up + down = 0 THEN 0.5 ELSE 0.5 + (CASE base WHEN 'long' THEN up ELSE down END / (up + down) - 0.5) * (up + down) / total END, 9) AS coherence FROM b),
e AS (SELECT *, CASE WHEN trendiness >= 0.48 AND coherence >= 0.5 THEN 'trend' WHEN trendiness <= 0.25 THEN 'range' ELSE 'transition' END AS regime FROM c),
f AS (SELECT *, CASE WHEN abs(s) < 0.12 THEN 'neutral' WHEN regime <> 'range' THEN CASE WHEN s > 0 THEN 'long' ELSE 'short' END WHEN bias <> 'neutral' AND bias = base AND abs(s) >= 0.15 AND abs(structural) >= 0.1 AND coherence >= 0.62 THEN bias ELSE 'neutral' END AS plain FROM e)"""


@query(f"""WITH v AS (SELECT l_orderkey AS k, l_linenumber AS i, l_discount * 20 - 0.9::DOUBLE AS x, l_quantity / 70 AS t, CASE l_linenumber WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.25 WHEN 3 THEN 2.0 WHEN 4 THEN 2.25 ELSE 0.75 END AS w FROM lineitem WHERE l_linenumber <= 5),
{DECIDED}
SELECT k, tactical, structural, s, trendiness, coherence, regime, bias, base <> 'neutral' AND abs(structural) >= 0.18 AND plain <> base AS veto,
  CASE WHEN base <> 'neutral' AND abs(structural) >= 0.18 AND plain <> base THEN CASE WHEN coherence >= 0.55 THEN base ELSE 'neutral' END ELSE plain END AS direction,
  round(least(0.99, 0.30 + 0.52 * abs(s) + 0.18 * coherence + CASE regime WHEN 'trend' THEN 0.08 WHEN 'range' THEN -0.08 ELSE 0 END), 6)::DOUBLE AS confidence,
  round(0.25 + 0.75 * CASE regime WHEN 'trend' THEN 0.65 * greatest(0, least(1, (trendiness - 0.48) / 0.30)) + 0.35 * greatest(0, least(1, (coherence - 0.5) / 0.35)) WHEN 'range' THEN least(1, (0.25 - trendiness) / 0.25) ELSE 1 - least(1, abs(trendiness - 0.365) / 0.115) END, 6)::DOUBLE AS regime_confidence FROM f""")
def direction_tree(spark, d):
    """Direction and regime of orders, their lines standing for time frames."""
    frame = F.element_at(F.array(*map(F.lit, D.FRAME_WEIGHTS)), F.col("l_linenumber"))
    x = table(spark, d, "lineitem").where("l_linenumber <= 5").select(F.col("l_orderkey").alias("k"), frame.alias("frame"), (F.col("l_discount") * 20 - 0.9).alias("score"), (F.col("l_quantity") / 70).alias("trend_strength"))
    return D.aggregate(x, "k").withColumn("confidence", r("confidence")).withColumn("regime_confidence", r("regime_confidence"))


def frame_bars(spark, d):
    """Candles of all time frames, from trades."""
    return reduce(lambda a, b: a.unionByName(b), [B.bars_from_trades(trades(spark, d), f).withColumn("frame", F.lit(f)) for f in D.FRAME_WEIGHTS])


FRAMES = f"""{TRADES}, f AS (SELECT unnest([900, 1800, 3600, 14400, 86400]) AS frame), w AS (SELECT max(ts) AS now FROM t),
b AS (SELECT symbol, frame, ts - ts % frame AS ts, max(price) AS high, min(price) AS low, arg_max(price, (us, trade_id)) AS close FROM t, f GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, frame ORDER BY ts DESC) AS rn FROM b),
c AS (SELECT *, ln(close) AS lc, row_number() OVER (PARTITION BY symbol, frame ORDER BY ts DESC) AS nth, ln(lag(close) OVER (PARTITION BY symbol, frame ORDER BY ts)) AS p FROM k, w WHERE rn <= CASE WHEN frame > 3600 THEN 420 ELSE 260 END AND ts + frame <= now),
a AS (SELECT symbol, frame, count(*) AS n, avg(lc) FILTER (nth <= 20) - avg(lc) FILTER (nth <= 60) AS slope, avg(greatest(ln(high) - ln(low), abs(ln(high) - p), abs(ln(low) - p))) FILTER (nth <= 14) AS atr,
  list(close ORDER BY ts) AS xs, max(lc) FILTER (nth = 1) AS last, avg(lc) FILTER (nth <= 20) AS mid, stddev_pop(lc) FILTER (nth <= 20) AS sd FROM c GROUP BY ALL HAVING count(*) >= 80),
e AS (SELECT *, [ln(x) for x in xs] AS ys, [ln(xs[i]) - ln(xs[i - 1]) for i in range(2, len(xs) + 1)] AS d FROM a),
m AS (SELECT *, list_reduce(ys[2:], lambda acc, x: list_append(acc, acc[-1] * (1 - 2.0::DOUBLE / 13) + x * (2.0::DOUBLE / 13)), ys[1:1]) AS fast, list_reduce(ys[2:], lambda acc, x: list_append(acc, acc[-1] * (1 - 2.0::DOUBLE / 27) + x * (2.0::DOUBLE / 27)), ys[1:1]) AS slow, [greatest(x, 0.0) for x in d] AS u, [greatest(-x, 0.0) for x in d] AS z FROM e),
l AS (SELECT *, [fast[i] - slow[i] for i in range(1, len(fast) + 1)] AS line, list_reduce([list_sum(u[1:14]) / 14] || u[15:], lambda m, x: (m * 13 + x) / 14) AS up, list_reduce([list_sum(z[1:14]) / 14] || z[15:], lambda m, x: (m * 13 + x) / 14) AS down FROM m),
i AS (SELECT *, line[-1] - list_reduce(line, lambda acc, x: acc + 2.0::DOUBLE / 10 * (x - acc)) AS hist, CASE WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi, least(1, greatest(0, (last - mid + 2 * sd) / greatest(1e-9, 4 * sd))) AS pb FROM l),
o AS (SELECT *, greatest(-1.0, least(1.0, slope / greatest(1e-6::DOUBLE, atr) * 0.22::DOUBLE)) AS v1, greatest(-1.0, least(1.0, hist / greatest(1e-9::DOUBLE, atr) * 4.0)) AS v2, greatest(-1.0, least(1.0, (rsi - 50) / 30)) AS v3, greatest(-1.0, least(1.0, (pb - 0.5::DOUBLE) * 2)) AS v4 FROM i),
g AS (SELECT symbol, frame, n, atr, rsi, hist, greatest(-1.0, least(1.0, 0.55::DOUBLE * v1 + 0.22::DOUBLE * v2 + 0.15::DOUBLE * v3 + 0.08::DOUBLE * v4)) AS score, least(1, abs(v1) * 0.75::DOUBLE + abs(v2) * 0.25::DOUBLE) AS trend_strength FROM o)"""


@query(f"WITH {FRAMES} SELECT symbol, frame, n, round(atr, 6) AS atr, round(rsi, 5) AS rsi, round(hist, 6) AS hist, round(score, 6) AS score, round(trend_strength, 6) AS trend_strength FROM g")
def frame_votes(spark, d):
    """Votes of every symbol's time frames from their closed bars."""
    x = indicators.frame_votes(frame_bars(spark, d), newest(trades(spark, d)))
    return x.select("symbol", F.col("frame").cast("int").alias("frame"), "n", r("atr").alias("atr"), r("rsi", 5).alias("rsi"), r("hist").alias("hist"), r("score").alias("score"), r("trend_strength").alias("trend_strength"))


@query(f"""WITH v AS (SELECT symbol AS k, CASE frame WHEN 900 THEN 1 WHEN 1800 THEN 2 WHEN 3600 THEN 3 WHEN 14400 THEN 4 ELSE 5 END AS i, score AS x, trend_strength AS t, CASE frame WHEN 900 THEN 1.0::DOUBLE WHEN 1800 THEN 1.25 WHEN 3600 THEN 2.0 WHEN 14400 THEN 2.25 ELSE 0.75 END AS w FROM (WITH {FRAMES} SELECT * FROM g)),
{DECIDED}
SELECT k AS symbol, s, trendiness, coherence, regime, CASE WHEN base <> 'neutral' AND abs(structural) >= 0.18 AND plain <> base THEN CASE WHEN coherence >= 0.55 THEN base ELSE 'neutral' END ELSE plain END AS direction,
  round(least(0.99, 0.30 + 0.52 * abs(s) + 0.18 * coherence + CASE regime WHEN 'trend' THEN 0.08 WHEN 'range' THEN -0.08 ELSE 0 END), 6)::DOUBLE AS confidence FROM f""")
def direction_of_symbols(spark, d):
    """Direction of each symbol from the votes of its time frames."""
    votes = indicators.frame_votes(frame_bars(spark, d), newest(trades(spark, d)))
    return D.aggregate(votes, "symbol").select("symbol", "s", "trendiness", "coherence", "regime", "direction", r("confidence").alias("confidence"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber > 1 THEN least(1, 0.15 * l_discount * 10 + 0.30 * calm + 0.55 * l_tax * 12) ELSE 0.2 * l_discount * 10 + 0.8 * calm END, 6)::DOUBLE AS suited FROM
(SELECT *, greatest(0, least(1, 1 - l_quantity / 50 + CASE l_returnflag WHEN 'A' THEN 0.06 * c WHEN 'N' THEN -0.04 * greatest(0, c - 0.5) ELSE 0 END)) AS calm FROM (SELECT *, l_tax * 10 AS c FROM lineitem))""")
def stable_range(spark, d):
    """How well a market suits a grid."""
    regime = F.when(F.col("l_returnflag") == "A", "range").when(F.col("l_returnflag") == "N", "trend").otherwise("transition")
    x = D.stable_range(F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_tax") * 10, regime, F.col("l_tax") * 12, F.col("l_linenumber") > 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(x).alias("suited"))


GRIDS = """WITH g AS (SELECT l_orderkey, l_linenumber, 0.9 * l_extendedprice AS lo, (1.1 * l_extendedprice - 0.9 * l_extendedprice) / (2 * l_linenumber + 2) AS step, (2 * l_linenumber + 2)::INT AS n, l_extendedprice * (0.95 + l_discount) AS p,
  CASE l_returnflag WHEN 'A' THEN 'long' WHEN 'N' THEN 'short' ELSE 'neutral' END AS side FROM lineitem),
h AS (SELECT *, floor((p - lo) / step + 0.5)::INT AS near, least(n - 1, floor((p - lo) / step)::INT) AS cell FROM g),
i AS (SELECT *, CASE WHEN abs(p - (lo + step * near)) <= step * 1e-10 THEN near WHEN side = 'short' THEN cell ELSE cell + 1 END AS idle FROM h),
j AS (SELECT *, [lo + step * k FOR k IN range(0, idle)] AS buys, [lo + step * k FOR k IN range(idle + 1, n + 1)] AS sells FROM i),
k AS (SELECT *, CASE side WHEN 'long' THEN p * len(sells) + coalesce(list_sum(buys), 0) WHEN 'short' THEN p * len(buys) + coalesce(list_sum(sells), 0) ELSE coalesce(list_sum(buys), 0) + coalesce(list_sum(sells), 0) END AS committed,
  CASE WHEN side = 'long' THEN [p FOR x IN sells] || buys ELSE buys END AS longs, CASE WHEN side = 'short' THEN [p FOR x IN buys] || sells ELSE sells END AS shorts FROM j)"""


def _grids(spark, d):
    p, side = F.col("l_extendedprice"), F.when(F.col("l_returnflag") == "A", "long").when(F.col("l_returnflag") == "N", "short").otherwise("neutral")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (0.9 * p).alias("lo"), (1.1 * p).alias("hi"), (2 * F.col("l_linenumber") + 2).alias("n"), (p * (0.95 + F.col("l_discount"))).alias("p"), side.alias("side"))
    return x.withColumn("g", G.commitment(F.col("lo"), F.col("hi"), F.col("n"), F.col("p"), F.col("side")))


@query(f"{GRIDS} SELECT l_orderkey, l_linenumber, idle, len(buys)::INT AS buys, len(sells)::INT AS sells, round(committed / p, 7) AS committed FROM k")
def grid_commitment(spark, d):
    """First orders of arithmetic grids and what they commit, as a multiple of the price."""
    return _grids(spark, d).select("l_orderkey", "l_linenumber", "g.idle", "g.buys", "g.sells", r(F.col("g.committed") / F.col("p"), 7).alias("committed"))


@query(f"""{GRIDS}, m AS (SELECT *, lo * 0.97 AS kl, (lo + n * step) * 1.03 AS kh FROM k),
s AS (SELECT *, list_sum([x - kl + (x + kl) * 0.0006 + kl * 0.005 FOR x IN longs]) AS down, list_sum([kh - x + (x + kh) * 0.0006 + kh * 0.005 FOR x IN shorts]) AS up FROM m),
w AS (SELECT *, CASE side WHEN 'long' THEN down WHEN 'short' THEN up ELSE greatest(coalesce(down, 0), coalesce(up, 0)) END AS worst FROM s)
SELECT l_orderkey, l_linenumber, round(worst / p + 3e-10, 7)::DOUBLE AS worst, round(100 * (1 - worst * 3 / committed) + 3e-9, 6)::DOUBLE AS buffer_pct, CASE WHEN worst / committed <= 0.88 THEN least(10, floor(0.88 * committed / worst + 1e-9))::INT END AS leverage FROM w""")
def grid_stress(spark, d):
    """(What is added before rounding keeps exact halves, frequent in these columns, from going either way.) Loss at the kill switch as a multiple of the price, what it leaves of the margin at threefold leverage, and the highest leverage that leaves 12 percent."""
    x = _grids(spark, d)
    worst = G.stress(F.col("g"), F.col("lo"), F.col("p"), F.col("side"), F.col("lo") * 0.97, F.col("hi") * 1.03, F.lit(12.0))
    x, c = x.withColumn("loss", worst), F.col("g.committed")
    return x.select("l_orderkey", "l_linenumber", r(F.col("loss") / F.col("p") + 3e-10, 7).alias("worst"), r(G.buffer_pct(c, F.col("loss"), F.lit(3)) + 3e-9, 6).alias("buffer_pct"), G.safe_leverage(c, F.col("loss"), 1, 10).alias("leverage"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey > 0 THEN round((1 - a) * l_quantity / 50 + a * l_discount * 10, 6)::DOUBLE END AS confidence, CASE WHEN l_returnflag = 'R' OR l_linenumber < 2 THEN 0 WHEN l_discount >= 0.08 THEN -0.08 WHEN l_discount >= 0.04 THEN -0.05 WHEN l_discount >= 0.015 THEN -0.02 ELSE 0 END::DOUBLE AS funding
FROM (SELECT *, least(1.0, l_partkey / 300) * 0.4 + 0.1 AS a FROM lineitem)""")
def policy_confidence(spark, d):
    """Confidence mixed by the model's samples, and what funding takes off a score."""
    side = F.when(F.col("l_returnflag") == "R", "neutral").otherwise("long")
    mixed = D.policy_confidence(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_partkey"), F.lit(1.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(mixed).alias("confidence"), D.funding_adjustment(side, F.col("l_linenumber") - 1, F.round(F.col("l_discount") * 100, 6)).alias("funding"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, 0.3 + l_discount * 4 AS p, 0.28 - l_discount * 2 AS q, 0.01 + l_tax / 4 AS up, -0.012 - l_quantity / 5000 AS down FROM lineitem), y AS (SELECT *, 1 - p - q AS h, p - greatest(0, p - 0.08) AS freed FROM x),
z AS (SELECT *, p * up + q * down + h * 0.001 AS v, (p - freed) * up + (q + CASE WHEN -0.015 < down THEN 0 ELSE freed END) * down + (h + CASE WHEN -0.015 < down THEN freed ELSE 0 END) * -0.015 AS low FROM y)
SELECT l_orderkey, l_linenumber, round(v, 7)::DOUBLE AS expected, round(low, 7)::DOUBLE AS lower_bound, round(p - freed, 9) > round(q + 0.08, 9) AS likely FROM z""")
def first_touch_value(spark, d):
    """Expected return of first-touch events and its low bound."""
    p, q = 0.3 + F.col("l_discount") * 4, 0.28 - F.col("l_discount") * 2
    got = D.first_touch_value(F.round(p, 9), F.round(q, 9), 1 - p - q, 0.01 + F.col("l_tax") / 4, -0.012 - F.col("l_quantity") / 5000, F.lit(0.001), F.lit(-0.015), F.lit(0.08))
    likely = F.round(F.greatest(F.lit(0.0), p - 0.08), 9) > F.round(q + 0.08, 9)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(got["expected"], 7).alias("expected"), r(got["lower_bound"], 7).alias("lower_bound"), likely.alias("likely"))


@query("""WITH RECURSIVE x AS (SELECT l_returnflag AS k, l_quantity / 25 - 1 AS s, (l_tax * 1000 % 20 < l_quantity / 3)::INT::DOUBLE AS y FROM lineitem), n AS (SELECT k, count(*) AS n, 2 * least(sum(y), count(*) - sum(y)) >= 80 AND avg(y) BETWEEN 0.15::DOUBLE AND 0.85::DOUBLE AS fitted FROM x GROUP BY k),
g AS (SELECT k, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0 AS i FROM n WHERE fitted UNION ALL
  SELECT x.k, any_value(a) - 0.06::DOUBLE * avg((1 / (1 + exp(-(a * s + b))) - y) * s), any_value(b) - 0.06::DOUBLE * avg(1 / (1 + exp(-(a * s + b))) - y), any_value(i) + 1 FROM g JOIN x USING (k) WHERE i < 300 GROUP BY x.k)
SELECT k AS l_returnflag, n, coalesce(round(a, 6), 1) AS a, coalesce(round(b, 6), 0) AS b, fitted FROM n LEFT JOIN (SELECT * FROM g WHERE i = 300) AS e USING (k)""")
def platt_scalers(spark, d):
    """A Platt scaler of each return flag, learnt from all rows."""
    x = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 25 - 1).alias("score"), (F.col("l_tax") * 1000 % 20 < F.col("l_quantity") / 3).cast("double").alias("y"))
    return models.platt_by_group(x, "l_returnflag", "score", "y").withColumn("a", r("a")).withColumn("b", r("b"))


_LOGIT = lambda i: f"exp(w{i}q * q + w{i}c * c + b{i})"
_SOFT = ", ".join([*[f"any_value(w{i}{f}) - any_value(rate) * (avg((e{i} / (e0 + e1 + e2) - (y = {i})::INT) * {f}) + 0.002::DOUBLE * any_value(w{i}{f})) AS w{i}{f}" for i in range(3) for f in "qc"], *[f"any_value(b{i}) - any_value(rate) * avg(e{i} / (e0 + e1 + e2) - (y = {i})::INT) AS b{i}" for i in range(3)]])
_ZEROS = ", ".join(f"0.0::DOUBLE AS {c}" for c in [*[f"w{i}{f}" for i in range(3) for f in "qc"], "b0", "b1", "b2"])


@query(f"""WITH RECURSIVE x AS (SELECT l_linestatus AS k, l_quantity / 50 AS q, l_discount * 10 AS c, l_linenumber % 3 AS y FROM lineitem),
g AS (SELECT k, {_ZEROS}, 0 AS i FROM x GROUP BY k UNION ALL SELECT k, {_SOFT}, any_value(i) + 1 FROM (SELECT *, {', '.join(f'{_LOGIT(i)} AS e{i}' for i in range(3))}, 0.08::DOUBLE / sqrt(1 + i / 100.0::DOUBLE) AS rate FROM g JOIN x USING (k) WHERE i < 600) GROUP BY k)
SELECT k AS l_linestatus, (SELECT count(*) FROM x WHERE x.k = g.k) AS n, [{', '.join(f'round(w{i}q, 6), round(w{i}c, 6)' for i in range(3))}] AS weights, [round(b0, 6), round(b1, 6), round(b2, 6)] AS bias FROM g WHERE i = 600""")
def softmax_models(spark, d):
    """A three-class softmax model of each line status, learnt from all rows."""
    x = table(spark, d, "lineitem").select("l_linestatus", (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("c"), (F.col("l_linenumber") % 3).cast("int").alias("y"))
    got = models.softmax_by_group(x, "l_linestatus", ["q", "c"], "y", 3)
    return got.select("l_linestatus", "n", F.transform(F.flatten("weights"), lambda v: F.round(v, 6)).alias("weights"), F.transform("bias", lambda v: F.round(v, 6)).alias("bias"))


@query("""SELECT l_orderkey, l_linenumber, round(exp(a) / (exp(a) + exp(b) + 1), 6) AS target, round(exp(b) / (exp(a) + exp(b) + 1), 6) AS stop, round(1 / (exp(a) + exp(b) + 1), 6) AS horizon FROM (SELECT *, l_quantity / 50 - 4 * l_discount + 0.2::DOUBLE AS a, 3 * l_tax - 0.5 * l_quantity / 50 AS b FROM lineitem)""")
def softmax_probabilities(spark, d):
    """Class probabilities of a fixed softmax model."""
    p = models.softmax([F.col("l_quantity") / 50, F.col("l_discount"), F.col("l_tax")], [[1.0, -4.0, 0.0], [-0.5, 0.0, 3.0], [0.0, 0.0, 0.0]], [0.2, 0.0, 0.0])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[r(x).alias(n) for x, n in zip(p, ("target", "stop", "horizon"), strict=True)])


@query("""WITH x AS (SELECT *, epoch_us(l_shipdate) // 1000 AS ms, lag(epoch_us(l_shipdate)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before FROM lineitem),
m AS (SELECT l_orderkey, max(ms) AS last FROM x GROUP BY l_orderkey HAVING count(*) = count(DISTINCT l_linenumber) AND bool_and(before IS NULL OR before <= epoch_us(l_shipdate)))
SELECT 'O' || l_orderkey || 'USDT' AS symbol, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INT AS row_index, l_linenumber::VARCHAR AS trade_id, ms AS trade_ts_ms, CASE WHEN l_linestatus = 'O' THEN 'Buy' ELSE 'Sell' END AS side, l_quantity AS qty FROM x JOIN m USING (l_orderkey)""")
def trade_messages(spark, d):
    """Orders as messages in JSON, their lines as trades, parsed whole or not at all."""
    ms, status = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1000).cast("string"), F.when(F.col("l_linestatus") == "O", "Buy").otherwise("sell")
    symbol = F.concat(F.lit("O"), F.col("l_orderkey"), F.lit("USDT"))
    pairs = {"T": ms, "s": symbol, "S": status, "v": F.col("l_quantity").cast("string"), "p": F.col("l_extendedprice").cast("string"), "i": F.col("l_linenumber").cast("string"), "BT": F.lit("false"), "seq": F.lit("7")}
    row = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.to_json(row).alias("j")))), lambda x: x["j"]).alias("js"), F.max(ms.cast("long")).alias("last"))
    raw = F.concat(F.lit('{"topic": "publicTrade.'), symbol, F.lit('", "ts": '), F.col("last"), F.lit(', "data": ['), F.array_join("js", ", "), F.lit("]}"))
    got = messages.message_rows(messages.parse_messages(lines.select(raw.alias("raw")), "raw", "USDT"))
    return got.select("symbol", "row_index", "trade_id", "trade_ts_ms", "side", "qty")


SEEN = "e AS (SELECT *, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events)"


@query(f"""WITH RECURSIVE {SEEN}, x AS (SELECT user_id, t, rn, v, CASE WHEN v > 0 THEN 'long' ELSE 'short' END AS side, CASE WHEN event_id % 5 = 0 THEN 'range' ELSE 'trend' END AS regime, abs(v / 3) AS size, abs(v) AS strength, user_id % 10 / 10.0::DOUBLE AS trendiness FROM (SELECT *, value % 100 / 50 - 1 AS v FROM e)),
p AS (SELECT *, CASE WHEN regime = 'range' AND size < 0.18 THEN 'neutral' WHEN size < 0.14 OR trendiness < 0.28 THEN 'neutral' ELSE side END AS raw, CASE WHEN regime = 'range' AND size < 0.18 THEN 'range_neutrality_hold' WHEN size < 0.14 OR trendiness < 0.28 THEN 'enter_deadband' ELSE 'pass_through' END AS why FROM x),
g AS (SELECT user_id, rn, t, side, regime, raw AS stable, why AS mode FROM p WHERE rn = 1 UNION ALL
  SELECT user_id, rn, t, side, regime, CASE WHEN hold THEN before ELSE raw END, CASE WHEN hold THEN 'hysteresis_hold' ELSE why END FROM
  (SELECT *, before <> 'neutral' AND ((raw = 'neutral' AND size >= 0.09 AND regime <> 'range') OR (raw NOT IN ('neutral', before) AND (size < 0.18 OR strength < 0.18))) AS hold FROM
    (SELECT p.*, CASE WHEN p.t - g.t <= 259200 THEN g.stable ELSE 'neutral' END AS before FROM g JOIN p ON p.user_id = g.user_id AND p.rn = g.rn + 1)))
SELECT user_id, t AS ts, side AS direction, regime, stable, mode FROM g""")
def stream_hysteresis(spark, d):
    """Directions of a stream held until the other side is clear."""
    v = F.col("value") % 100 / 50 - 1
    x = candles.trade_stream(spark, d, "events").select(
        "user_id", epoch(F.col("ts")).cast("long").alias("ts"), F.when(v > 0, "long").otherwise("short").alias("direction"), F.when(v > 0, "long").otherwise("short").alias("bias"),
        F.when(F.col("event_id") % 5 == 0, "range").otherwise("trend").alias("regime"), (v / 3).alias("score"), F.abs(v).alias("strength"), (F.col("user_id") % 10 / 10).alias("trendiness"), F.lit(0.6).alias("coherence"),
    )
    return _drained(spark, states.direction_hysteresis(x, ["user_id"], 3 * DAY)).select("user_id", "ts", "direction", "regime", "stable", "mode")


@query(f"""WITH RECURSIVE {SEEN}, x AS (SELECT user_id, t, rn, CASE WHEN value % 10 < 1 THEN 'lockdown' WHEN value % 10 < 3 THEN 'guarded' ELSE 'normal' END AS severity, CASE WHEN value % 10 < 1 THEN 2 WHEN value % 10 < 3 THEN 1 ELSE 0 END AS n FROM e),
g AS (SELECT user_id, rn, t, severity, t AS since, severity AS stable, n AS level, false AS held FROM x WHERE rn = 1 UNION ALL
  SELECT user_id, rn, t, severity, CASE WHEN keep THEN since ELSE t END, CASE WHEN keep THEN before ELSE severity END, CASE WHEN keep THEN level ELSE n END, keep FROM
  (SELECT x.*, g.since, g.stable AS before, g.level, g.level > x.n AND x.t - g.since <= 259200 AND (g.stable = 'lockdown' OR (x.severity = 'normal' AND x.t - g.since <= 129600)) AS keep FROM g JOIN x ON x.user_id = g.user_id AND x.rn = g.rn + 1))
SELECT user_id, t AS ts, severity, stable, held FROM g""")
def stream_cooldown(spark, d):
    """Severities of a stream that fall only after a cooldown."""
    severity = F.when(F.col("value") % 10 < 1, "lockdown").when(F.col("value") % 10 < 3, "guarded").otherwise("normal")
    return _drained(spark, states.release_cooldown(candles.trade_stream(spark, d, "events").select("user_id", epoch(F.col("ts")).cast("long").alias("ts"), severity.alias("severity")), ["user_id"], 3 * DAY))


@query(f"""WITH RECURSIVE {SEEN}, x AS (SELECT user_id, t, rn, CASE WHEN value > 50 THEN 'long' ELSE 'short' END AS side, t - t % 86400 AS evidence FROM e),
g AS (SELECT user_id, rn, t, side, evidence, t AS seen, evidence AS last, 1::BIGINT AS count FROM x WHERE rn = 1 UNION ALL
  SELECT user_id, rn, t, side, evidence, CASE WHEN same THEN seen ELSE t END, evidence, CASE WHEN same THEN count WHEN fresh AND evidence > last THEN count + 1 ELSE 1 END FROM
  (SELECT x.*, g.seen, g.last, g.count, x.side = g.side AND x.t - g.seen <= 432000 AS fresh, x.side = g.side AND x.t - g.seen <= 432000 AND x.evidence = g.last AS same FROM g JOIN x ON x.user_id = g.user_id AND x.rn = g.rn + 1))
SELECT user_id, t AS ts, side AS direction, evidence, count, count >= 2 AS passed FROM g""")
def stream_persistence(spark, d):
    """Directions that pass once two later snapshots agree."""
    ts = epoch(F.col("ts")).cast("long")
    x = candles.trade_stream(spark, d, "events").select("user_id", F.when(F.col("value") > 50, "long").otherwise("short").alias("direction"), ts.alias("ts"), (ts - F.pmod(ts, F.lit(DAY))).alias("evidence"))
    return _drained(spark, states.persistence_gate(x, ["user_id"], 5 * DAY))


@query(f"""WITH RECURSIVE {SEEN}, x AS (SELECT user_id, t, rn, CASE WHEN value % 10 < 2 THEN 'down_break' WHEN value % 10 < 3 THEN 'up_break' ELSE 'normal' END AS state FROM e),
g AS (SELECT user_id, rn, t, state, t AS since, state AS stable, false AS held FROM x WHERE rn = 1 UNION ALL
  SELECT user_id, rn, t, state, CASE WHEN keep THEN since ELSE t END, CASE WHEN keep THEN before ELSE state END, keep FROM
  (SELECT x.*, g.since, g.stable AS before, x.state = 'normal' AND g.stable <> 'normal' AND x.t - g.since <= 172800 AS keep FROM g JOIN x ON x.user_id = g.user_id AND x.rn = g.rn + 1))
SELECT user_id, t AS ts, state, stable, held FROM g""")
def stream_veto(spark, d):
    """Breaks of a stream that last some time after the last of them."""
    state = F.when(F.col("value") % 10 < 2, "down_break").when(F.col("value") % 10 < 3, "up_break").otherwise("normal")
    x = candles.trade_stream(spark, d, "events").select("user_id", epoch(F.col("ts")).cast("long").alias("ts"), state.alias("state"))
    return _drained(spark, states.veto_cooldown(x, ["user_id"], 2 * DAY))


@query("""SELECT user_id, ts, event_id, event_id > coalesce(max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS accepted FROM (SELECT user_id, event_id, epoch_us(ts) AS ts FROM events)""")
def stream_ordered(spark, d):
    """Messages of a stream that come after all before them."""
    x = candles.trade_stream(spark, d, "events").select("user_id", F.unix_micros("ts").alias("ts"), "event_id")
    return _drained(spark, states.ordered_ingest(x, ["user_id"], "event_id", ["ts", "event_id"]))
