"""Arithmetic grids as columns: the first orders, what they commit, and stress at the kill switch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ladder(n: Column, first: Column, lower: Column, step: Column) -> Column:
    """Sum of ``n`` neighbouring prices from level ``first`` on."""
    return n * lower + step * (n * first + n * (n - 1) / 2)


def commitment(lower: Column, upper: Column, count: Column, price: Column, direction: Column) -> Column:
    """A grid's first orders as a struct; null for bad geometry.

    A grid of ``count`` intervals has ``count`` orders: of its levels, the one
    that the price sits on, or else one beside it, stays idle. Sums of prices
    come from the levels' even spacing. Fields: step, exact, idle, buys (levels
    0 to buys - 1), first_sell, sells, held (slots bought or sold short at
    once), slots (most at one time), committed (price sum to back).
    """
    n = count.cast("int")
    step = (upper - lower) / n
    at = (price - lower) / step
    near, cell = F.floor(at + 0.5).cast("int"), F.greatest(F.lit(0), F.least(n - 1, F.floor(at).cast("int")))
    exact = F.abs(price - (lower + step * near)) <= F.greatest(F.lit(1e-12), step * 1e-10)
    short = direction == "short"
    idle = F.when(exact, near).when(short, cell).otherwise(cell + 1)
    buys, sells = idle, n - idle
    bought, sold = _ladder(buys, F.lit(0), lower, step), _ladder(sells, idle + 1, lower, step)
    long = direction == "long"
    held = F.when(long, sells).when(short, -buys).otherwise(0)
    slots = F.when(long | short, n).otherwise(F.greatest(buys, sells))
    committed = F.when(long, price * sells + bought).when(short, price * buys + sold).otherwise(bought + sold)
    ok = (n > 0) & (lower > 0) & (upper > lower) & price.between(lower, upper) & direction.isin("neutral", "long", "short")
    return F.when(
        ok,
        F.struct(
            step.alias("step"), exact.alias("exact"), idle.alias("idle"), buys.alias("buys"), (idle + 1).alias("first_sell"), sells.alias("sells"), held.alias("held"), slots.alias("slots"), committed.alias("committed")
        ),
    )


def _side(grid: Column, lower: Column, price: Column, stop: Column, long: bool, cost: Column, maintenance: float) -> Column:
    """Loss, costs and reserve if every order up to the kill switch ``stop`` fills and is closed there."""
    first, n = (F.lit(0), grid["buys"]) if long else (grid["first_sell"], grid["sells"])
    levels = F.transform(F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>")), lambda k: lower + grid["step"] * k)
    filled = F.filter(levels, lambda p: p >= stop if long else p <= stop)
    held = F.greatest(F.lit(0), grid["held"] if long else -grid["held"])
    total = F.aggregate(filled, F.lit(0.0), lambda s, p: s + p)
    away = (price - stop) if long else (stop - price)
    loss = held * F.greatest(F.lit(0.0), away) + (total - F.size(filled) * stop) * (1 if long else -1)
    closed = (held + F.size(filled)) * stop
    return loss + (held * price + total + closed) * cost + closed * maintenance


def stress(grid: Column, lower: Column, price: Column, direction: Column, stop_low: Column, stop_high: Column, cost_bps: Column, maintenance: float = 0.005) -> Column:
    """The worse side's loss with closing costs and maintenance reserve, per unit of quantity; null without a grid or for bad kill switches."""
    cost = F.greatest(F.lit(0.0), cost_bps) / 20_000
    down, up = _side(grid, lower, price, stop_low, True, cost, maintenance), _side(grid, lower, price, stop_high, False, cost, maintenance)
    worst = F.when(direction == "long", down).when(direction == "short", up).otherwise(F.greatest(down, up))
    return F.when(grid.isNotNull() & (stop_low > 0) & (stop_high > stop_low), worst)


def buffer_pct(committed: Column, stressed: Column, leverage: Column) -> Column:
    """Share of the initial margin, in percent, that is left after ``stressed``."""
    return F.when(leverage > 0, 100 * (1 - stressed * leverage / committed))


def safe_leverage(committed: Column, stressed: Column, least: int, most: int, buffer: float = 12.0) -> Column:
    """The highest whole leverage from ``least`` to ``most`` that keeps ``buffer`` percent; null if none does."""
    fits = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda x: buffer_pct(committed, stressed, x) >= buffer)
    return F.array_max(fits)
