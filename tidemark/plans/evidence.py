"""Registered queries on evidence: votes, breadth, scopes, integrity, audit, losses and plans of work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import market as M
from ..operators import relational, sentiment, stats
from ..sources.tables import epoch, table, trades
from .market import BARS, DAY, HOUR, TRADES, hourly, newest, query, r


@query(f"""WITH {BARS}, x AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM b), k AS (SELECT ts, r AS m FROM x WHERE symbol = 'purchase'),
y AS (SELECT symbol, r, m, row_number() OVER (PARTITION BY symbol ORDER BY x.ts DESC) AS rn FROM x JOIN k USING (ts) WHERE r IS NOT NULL AND m IS NOT NULL)
SELECT symbol, count(*) AS n, round(covar_pop(r, m) / greatest(var_pop(m), 1e-12), 6) AS beta, round(corr(r, m), 6) AS corr FROM y WHERE rn <= 24 GROUP BY symbol HAVING count(*) >= 8""")
def benchmark_beta(spark, d):
    """Beta and correlation of each symbol's last 24 hourly returns to a benchmark's, matched by time."""
    x = hourly(spark, d).select("symbol", "ts", F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))).alias("r")).where("r is not null")
    both = x.join(x.where("symbol = 'purchase'").select("ts", F.col("r").alias("m")), "ts")
    last = both.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("ts").desc()))).where("rn <= 24")
    beta = F.covar_pop("r", "m") / F.greatest(F.var_pop("m"), F.lit(1e-12))
    return last.groupBy("symbol").agg(F.count("*").alias("n"), r(beta).alias("beta"), r(F.corr("r", "m")).alias("corr")).where("n >= 8")


@query("""SELECT l_orderkey, round(sum(w * x) / sum(w), 6) AS vote, round(0.5 + (sum(CASE WHEN abs(x) >= 0.1 THEN w END) / sum(w) - 0.5) * 0.5, 6) AS coherence FROM
(SELECT l_orderkey, l_discount * 20 - 1 AS x, CASE l_linenumber WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.25 WHEN 3 THEN 2.0 WHEN 4 THEN 2.25 ELSE 0.75 END AS w FROM lineitem) GROUP BY l_orderkey""")
def signed_votes(spark, d):
    """Votes of several time frames, by the frames' weights, and how far they agree."""
    n = F.col("l_linenumber")
    w = F.when(n == 1, 1.0).when(n == 2, 1.25).when(n == 3, 2.0).when(n == 4, 2.25).otherwise(0.75)
    x = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") * 20 - 1).alias("x"), w.alias("w"))
    total, strong = F.sum("w"), F.sum(F.when(F.abs("x") >= 0.1, F.col("w")))
    return x.groupBy("l_orderkey").agg(r(F.sum(F.col("w") * F.col("x")) / total).alias("vote"), r(0.5 + (strong / total - 0.5) * 0.5).alias("coherence"))


CHANGES = f"""{BARS}, c AS (SELECT symbol, ts, (close / lag(close, 1) OVER o - 1) * 100 AS r1, (close / lag(close, 3) OVER o - 1) * 100 AS r3, (close / lag(close, 5) OVER o - 1) * 100 AS r5 FROM b WINDOW o AS (PARTITION BY symbol ORDER BY ts))"""


def changes(spark, d):
    o = Window.partitionBy("symbol").orderBy("ts")
    back = lambda k: (F.col("close") / F.lag("close", k).over(o) - 1) * 100
    return hourly(spark, d).select("symbol", "ts", back(1).alias("r1"), back(3).alias("r3"), back(5).alias("r5"))


@query(f"WITH {CHANGES} SELECT symbol, ts, round(r1, 5) AS r1, round(r3, 5) AS r3, round(r5, 5) AS r5 FROM c")
def percent_changes(spark, d):
    return changes(spark, d).select("symbol", "ts", *[r(c, 5).alias(c) for c in ("r1", "r3", "r5")])


@query(f"""WITH {CHANGES}, s AS (SELECT ts, count(*) AS n, median(r5) AS mid, avg((r5 <= -0.8)::INT) AS down, avg((r5 >= 0.8)::INT) AS up FROM c WHERE r5 IS NOT NULL GROUP BY ts)
SELECT ts, n, round(mid, 5) AS mid, round(down, 6) AS down, round(up, 6) AS up, CASE WHEN n < 3 THEN 'thin' WHEN down >= 0.68 THEN 'red' WHEN down >= 0.55 THEN 'amber' ELSE 'calm' END AS state FROM s""")
def shock_breadth(spark, d):
    """For each hour the median change and the shares of symbols that fell or rose much."""
    x = changes(spark, d).where("r5 is not null").groupBy("ts").agg(F.count("*").alias("n"), F.median("r5").alias("mid"), F.avg((F.col("r5") <= -0.8).cast("int")).alias("down"), F.avg((F.col("r5") >= 0.8).cast("int")).alias("up"))
    state = F.when(F.col("n") < 3, "thin").when(F.col("down") >= 0.68, "red").when(F.col("down") >= 0.55, "amber").otherwise("calm")
    return x.select("ts", "n", r("mid", 5).alias("mid"), r("down").alias("down"), r("up").alias("up"), state.alias("state"))


@query("""WITH x AS (SELECT l_suppkey, l_returnflag, l_discount - l_tax AS net FROM lineitem),
s AS (SELECT 'portfolio' AS scope, '' AS key, net FROM x UNION ALL SELECT 'symbol', l_suppkey::VARCHAR, net FROM x UNION ALL SELECT 'direction', l_suppkey::VARCHAR || '/' || l_returnflag, net FROM x)
SELECT scope, key, count(*) AS n, round(avg(net), 6) AS mean, count(*) FILTER (net > 0) AS wins FROM s GROUP BY scope, key""")
def nested_scopes(spark, d):
    """Every row counts in each scope that holds it: all, its symbol, its symbol and direction."""
    s = F.col("l_suppkey").cast("string")
    scope = lambda name, key: F.struct(F.lit(name).alias("scope"), key.alias("key"))
    x = table(spark, d, "lineitem").select((F.col("l_discount") - F.col("l_tax")).alias("net"), F.inline(F.array(scope("portfolio", F.lit("")), scope("symbol", s), scope("direction", F.concat(s, F.lit("/"), "l_returnflag")))))
    return x.groupBy("scope", "key").agg(F.count("*").alias("n"), r(F.avg("net")).alias("mean"), F.count_if(F.col("net") > 0).alias("wins"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
def event_pivot(spark, d):
    x = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return x.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in ("F", "O", "P")])


@query("""SELECT 'orders' AS name, count(*) AS n, epoch_us(min(o_orderdate)) // 1000000 AS first, epoch_us(max(o_orderdate)) // 1000000 AS last FROM orders
UNION ALL SELECT 'lineitem', count(*), epoch_us(min(l_shipdate)) // 1000000, epoch_us(max(l_shipdate)) // 1000000 FROM lineitem UNION ALL SELECT 'events', count(*), epoch_us(min(ts)) // 1000000, epoch_us(max(ts)) // 1000000 FROM events""")
def table_ranges(spark, d):
    """Rows and time range of each table: what continuity checks compare."""
    of = lambda name, c: table(spark, d, name).agg(F.count("*").alias("n"), epoch(F.min(c)).alias("first"), epoch(F.max(c)).alias("last")).select(F.lit(name).alias("name"), "n", "first", "last")
    return of("orders", "o_orderdate").unionByName(of("lineitem", "l_shipdate")).unionByName(of("events", "ts"))


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS orphans, count(*) FILTER (l_shipdate < o_orderdate) AS early, count(*) FILTER (l_quantity * 1000 > o_totalprice) AS mismatched FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def semantic_integrity(spark, d):
    """Rows without their root, before their root's time, or at odds with it."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_quantity").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("orphans"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("early"), F.count_if(F.col("l_quantity") * 1000 > F.col("o_totalprice")).alias("mismatched"))


@query("""SELECT l_orderkey, l_suppkey, count(*) AS n, count(DISTINCT l_quantity) AS contents, CASE WHEN count(*) = 1 THEN 'new' WHEN count(DISTINCT l_quantity) = 1 THEN 'repeat' ELSE 'conflict' END AS verdict FROM lineitem GROUP BY l_orderkey, l_suppkey""")
def idempotent_events(spark, d):
    """Events of one external id: repeats with equal content do no harm, others conflict."""
    x = relational.dealt(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_suppkey"])
    x = x.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_quantity").alias("contents"))
    return x.withColumn("verdict", F.when(F.col("n") == 1, "new").when(F.col("contents") == 1, "repeat").otherwise("conflict"))


@query("""SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * -ln(CASE WHEN l_linestatus = 'O' THEN p ELSE 1 - p END)) / sum(l_quantity), 6) AS weighted_loss, round(avg(-ln(CASE WHEN l_linestatus = 'O' THEN p ELSE 1 - p END)), 6) AS loss,
  round(greatest(abs(avg((l_linestatus = 'O')::INT) - avg(p)), abs(avg((l_linestatus <> 'O')::INT) - avg(1 - p))), 6) AS gap, round(least(1, greatest(abs(avg((l_linestatus = 'O')::INT) - avg(p)), abs(avg((l_linestatus <> 'O')::INT) - avg(1 - p))) + sqrt(ln(4 / 0.05::DOUBLE) / (2 * count(*)))), 6) AS bound
FROM (SELECT *, 1 / (1 + exp(-(2 * l_discount * 10 - 1))) AS p FROM lineitem) GROUP BY l_returnflag""")
def weighted_log_loss(spark, d):
    """Log loss of probabilities, weighted and plain, and their gap to what happened with a Hoeffding margin."""
    p = 1 / (1 + F.exp(-(2 * F.col("l_discount") * 10 - 1)))
    x = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("w"), (F.col("l_linestatus") == "O").cast("int").alias("y"), (1 - p).alias("p0"), p.alias("p1"))
    return stats.loss_bounds(x, "l_returnflag", "y", ["p0", "p1"], "w").select("l_returnflag", "n", *[r(c).alias(c) for c in ("weighted_loss", "loss", "gap", "bound")])


@query("""SELECT o_orderkey, round(exp(-ln(2.0) * (m - ts) / (21 * 86400)) * count(*) OVER (PARTITION BY o_custkey) / sum(exp(-ln(2.0) * (m - ts) / (21 * 86400))) OVER (PARTITION BY o_custkey), 6) AS weight
FROM (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) // 1000000 AS ts, max(epoch_us(o_orderdate) // 1000000) OVER (PARTITION BY o_custkey) AS m FROM orders)""")
def recency_weights(spark, d):
    """Weights that halve every 21 days before a key's newest row and sum to its rows."""
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", epoch(F.col("o_orderdate")).alias("ts"))
    key = Window.partitionBy("o_custkey")
    w = F.exp(-F.ln(F.lit(2.0)) * (F.max("ts").over(key) - F.col("ts")) / (21 * DAY))
    x = x.withColumn("w", w)
    return x.select("o_orderkey", r(F.col("w") * F.count("*").over(key) / F.sum("w").over(key)).alias("weight"))


POINTS = f"{TRADES}, p AS (SELECT user_id % 50 AS key, ts, least(1, greatest(-1, price / 50 - 1)) AS s, trade_id % 20 AS volume, least(4, sqrt(greatest(1, trade_id % 20))) AS w, max(ts) OVER () AS now, price FROM t)"


def points(spark, d):
    """Trades as sentiment points, each with the newest time of all."""
    t = trades(spark, d)
    s = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("price") / 50 - 1))
    x = t.select((F.col("user_id") % 50).alias("key"), "ts", s.alias("sentiment"), (F.col("trade_id") % 20).cast("double").alias("volume"), "price")
    return x.withColumn("now", newest(t))


@query(f"""WITH {POINTS}, g AS (SELECT key, ts // 900 AS q, sum(s * w) / sum(w) AS s, least(3, sum(w)) AS w, max(now) - max(ts) AS age FROM p WHERE ts >= now - 21600 GROUP BY ALL),
e AS (SELECT key, count(*) AS n_points, sum(s * w * exp(-ln(2.0) / 2700 * age)) / sum(w * exp(-ln(2.0) / 2700 * age)) AS f, sum(s * w * exp(-ln(2.0) / 7200 * age)) / sum(w * exp(-ln(2.0) / 7200 * age)) AS m, sum(s * w * exp(-ln(2.0) / 21600 * age)) / sum(w * exp(-ln(2.0) / 21600 * age)) AS l FROM g GROUP BY key)
SELECT key, round(least(1, greatest(-1, 0.60 * f + 0.25 * m + 0.15 * l + 0.30 * (f - m))), 6) AS effective, n_points FROM e""")
def symbol_sentiment(spark, d):
    """Quarter hours as points of bounded weight, three half lives and an impulse."""
    return sentiment.symbol_sentiment(points(spark, d), "key", F.col("now")).select("key", r("effective").alias("effective"), "n_points")


_LIFE = lambda seconds: f"sum(s * w * exp(-ln(2.0) / {seconds} * (now - ts))) / sum(w * exp(-ln(2.0) / {seconds} * (now - ts)))"
_VOTED = lambda name: " + ".join(f"CASE WHEN {v} = '{name}' THEN {w}::DOUBLE ELSE 0 END" for v, w in (("v1", 1.30), ("v6", 1.45), ("vd", 1.00), ("vw", 0.60), ("ve", 1.35)))
_VOTE = lambda c: f"CASE WHEN {c} <= -0.35 THEN 'risk_off' WHEN {c} >= 0.35 THEN 'risk_on' ELSE 'neutral' END"


@query(f"""WITH {POINTS}, wide AS (SELECT * REPLACE (price / 25 - 2 AS s) FROM p), a AS (SELECT key, count(*) AS n_points, {_LIFE(3600)} AS s1, {_LIFE(21600)} AS s6, {_LIFE(86400)} AS sd, {_LIFE(604800)} AS sw FROM (SELECT * REPLACE (least(1, greatest(-1, s)) AS s) FROM wide WHERE ts >= now - 604800) GROUP BY key),
e AS (SELECT *, least(1, greatest(-1, 0.50 * s1 + 0.30 * s6 + 0.15 * sd + 0.05 * sw + 0.20 * (s1 - s6))) AS eff FROM a),
v AS (SELECT *, {_VOTE('s1')} AS v1, {_VOTE('s6')} AS v6, {_VOTE('sd')} AS vd, {_VOTE('sw')} AS vw, {_VOTE('eff')} AS ve FROM e),
m AS (SELECT *, round({_VOTED('risk_on')}, 6) AS a_on, round({_VOTED('risk_off')}, 6) AS a_off, round({_VOTED('neutral')}, 6) AS a_no FROM v),
k AS (SELECT *, list_sort([a_on, a_off, a_no]) AS o, list_sort([{{'w': a_on, 'e': ve = 'risk_on', 's': v6 = 'risk_on', 'n': false, 'name': 'risk_on'}}, {{'w': a_off, 'e': ve = 'risk_off', 's': v6 = 'risk_off', 'n': false, 'name': 'risk_off'}}, {{'w': a_no, 'e': ve = 'neutral', 's': v6 = 'neutral', 'n': true, 'name': 'neutral'}}]) AS best FROM m)
SELECT key, n_points, round(eff, 6) AS effective, round(s1 - s6, 6) AS impulse, best[3].name AS regime, round((o[3] - o[2]) / (a_on + a_off + a_no), 6) AS strength, (eff <= -0.62 AND s1 - s6 < -0.08) OR s6 <= -0.60 AS panic, (eff >= 0.62 AND s1 - s6 > 0.08) OR s6 >= 0.60 AS euphoria FROM k""")
def market_sentiment(spark, d):
    """Four half lives, their votes and what they come to."""
    wide = points(spark, d).withColumn("sentiment", F.col("price") / 25 - 2)  # beyond -1 and 1 too
    x = sentiment.market_sentiment(wide, "key", F.col("now"))
    return x.select("key", "n_points", r("effective").alias("effective"), r("impulse").alias("impulse"), "regime", r("strength").alias("strength"), "panic", "euphoria")


@query(f"""WITH {POINTS}, n AS (SELECT key, CASE ts % 5 WHEN 0 THEN 'momentum' WHEN 1 THEN 'reddit' WHEN 2 THEN 'rss' WHEN 3 THEN 'trending' ELSE 'other' END AS source, s FROM p), o AS (SELECT key, source, avg(s) AS s, CASE source WHEN 'momentum' THEN 0.45::DOUBLE WHEN 'reddit' THEN 0.30 WHEN 'rss' THEN 0.15 ELSE 0.10 END AS w FROM n WHERE source <> 'other' GROUP BY ALL)
SELECT key, round(least(1, greatest(-1, sum(s * w) / sum(w))), 6) AS sentiment, count(*) AS n_sources FROM o GROUP BY key""")
def sentiment_blend(spark, d):
    """Sources of each symbol by their weights."""
    source = F.element_at(F.array(*[F.lit(x) for x in ("momentum", "reddit", "rss", "trending", "other")]), (F.col("ts") % 5 + 1).cast("int"))
    return sentiment.blended(points(spark, d).withColumn("source", source), "key").select("key", r("sentiment").alias("sentiment"), "n_sources")


@query(f"WITH {POINTS} SELECT key, round(least(1, greatest(-1, sum(s * greatest(volume, 6)) / sum(greatest(volume, 6)))), 6) AS sentiment, floor(sum(greatest(volume, 6)))::BIGINT AS volume FROM p GROUP BY key")
def sentiment_combined(spark, d):
    """Points by their volume, each of some weight at least."""
    return sentiment.combined(points(spark, d), "key").select("key", r("sentiment").alias("sentiment"), "volume")


@query(f"WITH {POINTS}, q AS (SELECT *, least(6, greatest(0.8::DOUBLE, sqrt(least(greatest(1, volume * 1e7), 5e9)) / 5000)) AS mw FROM p) SELECT key, round(least(1, greatest(-1, sum(s * mw) / sum(mw))), 6) AS sentiment, count(*) AS n_symbols FROM q GROUP BY key")
def momentum_pulse(spark, d):
    """A market's pulse by the bounded roots of its symbols' volumes."""
    return sentiment.momentum_pulse(points(spark, d).withColumn("volume", F.col("volume") * 1e7), "key").select("key", r("sentiment").alias("sentiment"), "n_symbols")


@query(f"""WITH {TRADES}, g AS (SELECT user_id, ts + 60 AS lo, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, trade_id) AS hi FROM t)
SELECT user_id, w AS start, least(w + 360 * 60, hi) AS stop FROM (SELECT user_id, hi, unnest(range(lo, hi, 360 * 60)) AS w FROM g WHERE hi > lo)""")
def fetch_windows(spark, d):
    """Gaps as requests of 360 minutes at most."""
    hi = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "trade_id"))
    g = trades(spark, d).select("user_id", (F.col("ts") + 60).alias("lo"), hi.alias("hi")).where("hi > lo")
    w = g.select("user_id", "hi", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(360 * 60).cast("long"))).alias("start"))
    return w.select("user_id", "start", F.least(F.col("start") + 360 * 60, "hi").alias("stop"))


@query("""SELECT o_orderkey, f AS chain_first, ts + 86400 * (1 + o_orderkey % 30) < now OR f + 86400 * 365 < now AS expired FROM
(SELECT o_orderkey, epoch_us(o_orderdate) // 1000000 AS ts, min(epoch_us(o_orderdate) // 1000000) OVER (PARTITION BY o_custkey) AS f, max(epoch_us(o_orderdate) // 1000000) OVER () AS now FROM orders)""")
def chain_expiry(spark, d):
    """Rows past their own time to live or that of their chain's first row."""
    x = table(spark, d, "orders").select("o_orderkey", "o_custkey", epoch(F.col("o_orderdate")).alias("ts"))
    now = newest(x)
    x = x.withColumn("chain_first", F.min("ts").over(Window.partitionBy("o_custkey")))
    return x.select("o_orderkey", "chain_first", ((F.col("ts") + DAY * (1 + F.col("o_orderkey") % 30) < now) | (F.col("chain_first") + DAY * 365 < now)).alias("expired"))


@query(f"""WITH {BARS} SELECT symbol, ts - ts % 86400 AS day, count(*) AS n, count(*) = 24 AND min(ts) = ts - ts % 86400 AND max(ts) = ts - ts % 86400 + 82800 AS whole FROM b GROUP BY symbol, ts - ts % 86400""")
def whole_days(spark, d):
    """Whether a day's hourly bars are all there."""
    day = F.col("ts") - F.pmod("ts", F.lit(DAY))
    x = hourly(spark, d).groupBy("symbol", day.alias("day")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return x.select("symbol", "day", "n", ((F.col("n") == 24) & (F.col("lo") == F.col("day")) & (F.col("hi") == F.col("day") + 23 * HOUR)).alias("whole"))


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_transform(list_sort([{'a': -abs(l_discount - 0.05), 'f': 'discount'}, {'a': -abs(l_tax - 0.04), 'f': 'tax'}, {'a': -abs(l_quantity - 25) / 1000, 'f': 'quantity'}])[1:2], lambda x: x.f), ',') AS factors FROM lineitem""")
def top_factors(spark, d):
    """The two factors of greatest absolute weight."""
    one = lambda w, name: F.struct((-F.abs(w)).alias("a"), F.lit(name).alias("f"))
    fs = F.array_sort(F.array(one(F.col("l_discount") - 0.05, "discount"), one(F.col("l_tax") - 0.04, "tax"), one((F.col("l_quantity") - 25) / 1000, "quantity")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(F.slice(fs, 1, 2), lambda x: x["f"]), ",").alias("factors"))


@query("SELECT l_suppkey, count(*) AS n, round(avg(l_discount - l_tax), 6) AS mean, round(median(l_extendedprice), 4) AS mid, round(sum(l_discount - l_tax), 5) AS total, count(*) FILTER (l_discount > l_tax) AS wins FROM lineitem GROUP BY l_suppkey")
def metric_summary(spark, d):
    ret = F.col("l_discount") - F.col("l_tax")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), r(F.avg(ret)).alias("mean"), r(F.median("l_extendedprice"), 4).alias("mid"), r(F.sum(ret), 5).alias("total"), F.count_if(F.col("l_discount") > F.col("l_tax")).alias("wins"))


@query("""WITH e AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 1000000 AS ts FROM orders WHERE o_orderkey % 3 <> 0), s AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) // 1000000 AS ts, o_totalprice AS rate FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(e.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unexpected' ELSE 'settled' END AS state, rate FROM e FULL JOIN s ON e.k = s.k AND e.ts = s.ts""")
def settlement_match(spark, d):
    """Expected events against observed settlements: settled, missing or unexpected."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), epoch(F.col("o_orderdate")).alias("ts"), F.col("o_totalprice").alias("rate"))
    e, s = o.where("k % 3 <> 0").select("k", "ts", F.lit(1).alias("e")), o.where("k % 3 <> 1").withColumn("s", F.lit(1))
    x = e.join(s, ["k", "ts"], "full")
    return x.select("k", F.when(F.col("s").isNull(), "missing").when(F.col("e").isNull(), "unexpected").otherwise("settled").alias("state"), "rate")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN bid > 0 AND ask >= bid THEN (ask - bid) / ((ask + bid) / 2) * 1e4 END, 5) AS spread_bps FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount / 100) AS bid, l_extendedprice * (1 + (l_tax - 0.02) / 100) AS ask FROM lineitem)""")
def quote_spread(spark, d):
    """Spread in basis points; crossed quotes have none."""
    p = F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r(M.spread_bps(p * (1 - F.col("l_discount") / 100), p * (1 + (F.col("l_tax") - 0.02) / 100)), 5).alias("spread_bps"))
