"""Inputs made safe before they are used: tickers, vectors of prices, ages, plans of fetches, kinds of candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import finite

#: Kinds of candidates.
RECOMMENDED_KIND, REJECTED_KIND = "strategy_recommendation", "trend_evaluation_rejected"
#: Rows asked for without history, at least, at most, and of overlap.
FIRST_ROWS, FEWEST_ROWS, MOST_ROWS, OVERLAP = 72, 6, 200, 2


def amount(text: Column) -> Column:
    """A finite number of zero or more out of text, or null."""
    x = finite(text.try_cast("double"))
    return F.when(x >= 0, x)


def ticker(last: Column, bid: Column, ask: Column, volume: Column, turnover: Column) -> dict[str, Column]:
    """A ticker's texts as numbers; crossed quotes are both null."""
    b, a = amount(bid), amount(ask)
    crossed = F.coalesce(a < b, F.lit(False))
    return {"last": amount(last), "bid": F.when(~crossed, b), "ask": F.when(~crossed, a), "vol24h": amount(volume), "turnover24h": amount(turnover)}


def safe_bars(closes: Column, highs: Column, lows: Column) -> Column:
    """Arrays of closes, highs and lows as an array of bars (c, h, l): the last of each as far as all reach, without those that are not finite and positive; high and low hold all three. Null arrays give none."""
    n = F.least(*[F.coalesce(F.size(x), F.lit(0)) for x in (closes, highs, lows)])
    tail = lambda x: F.when(n > 0, F.slice(x, F.size(x) - n + 1, n))
    bars = F.coalesce(F.arrays_zip(tail(closes).alias("c"), tail(highs).alias("h"), tail(lows).alias("l")), F.array().cast("array<struct<c: double, h: double, l: double>>"))
    good = lambda v: F.coalesce(~F.isnan(v) & (v > 0) & (v < float("inf")), F.lit(False))
    kept = F.filter(bars, lambda b: good(b["c"]) & good(b["h"]) & good(b["l"]))
    return F.transform(kept, lambda b: F.struct(b["c"].alias("c"), F.greatest(b["c"], b["h"], b["l"]).alias("h"), F.least(b["c"], b["h"], b["l"]).alias("l")))


def staleness(candle_ts: Column, ticker_ts: Column, now: Column, most: int) -> dict[str, Column]:
    """Age of the slowest input, which it is (candle, ticker or ticker_missing), and whether it is older than ``most`` seconds. A missing ticker is too old."""
    candle, quote = F.greatest(F.lit(0), now - candle_ts), F.when(ticker_ts > 0, F.greatest(F.lit(0), now - ticker_ts))
    age = F.when(quote.isNull(), F.greatest(candle, F.lit(most + 1))).otherwise(F.greatest(candle, quote))
    source = F.when(quote.isNull(), "ticker_missing").when(quote > candle, "ticker").otherwise("candle")
    return {"age_sec": age, "source": source, "stale": age > most}


def interest_plan(last_ts: Column, now: Column, interval: int = 3600) -> dict[str, Column]:
    """What to fetch of open interest: limit, start_ms, end_ms. Rows for the gap and some overlap, within bounds; without history the newest rows."""
    rows = F.greatest(F.lit(FEWEST_ROWS), F.ceil(F.greatest(F.lit(0), now - last_ts) / max(1, interval)) + OVERLAP)
    return {"limit": F.when(last_ts.isNull(), FIRST_ROWS).otherwise(F.least(F.lit(MOST_ROWS), rows)), "start_ms": F.greatest(F.lit(0), (last_ts - OVERLAP * interval) * 1000), "end_ms": F.when(last_ts.isNotNull(), (now + interval) * 1000)}


def candidate_kind(bot: Column, direction: Column, stored: Column, stated: Column) -> Column:
    """The kind of a candidate: a trend without a side is rejected whatever is stored; else what is stored, or stated, if it is a kind; else a recommendation."""
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    explicit = F.when(F.coalesce(stored, F.lit("")) != "", text(stored)).otherwise(text(stated))
    sideless = (text(bot) == "directional_trend") & ~text(direction).isin("long", "short")
    return F.when(sideless, REJECTED_KIND).when(explicit.isin(RECOMMENDED_KIND, REJECTED_KIND), explicit).otherwise(RECOMMENDED_KIND)


def effective_status(effective: Column, status: Column) -> Column:
    """What an operator sees a row as: its effective status, or its own."""
    own = F.coalesce(F.when(effective != "", effective), status, F.lit(""))
    return F.lower(F.trim(own))
