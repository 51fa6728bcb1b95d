"""Market shock: how many symbols fall or rise at once, and what state that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Falls of a symbol over 5 and 15 minutes that count, of a benchmark (strong, weak), breadth (strong, weak) and impulse with its volume (strong, weak).
FALL_5, FALL_15 = 0.008, 0.012
BENCHMARKS = {"btc": (0.016, 0.009), "eth": (0.020, 0.012)}
BREADTH = (0.68, 0.55)
IMPULSE = ((0.010, 1.0), (0.008, 0.8))
#: Least symbols, median move, volume, share of reversals and most median of chaos; what a symbol's move and reversal need.
CHAOS_SYMBOLS, CHAOS_MOVE, CHAOS_VOLUME, CHAOS_MIXED, CHAOS_MEDIAN, REVERSAL = 6, 0.012, 1.1, 0.20, 0.004, 0.010


def _weight(x: Column, strong: float, weak: float) -> Column:
    """2 at ``strong`` or more, 1 at ``weak``, else 0; null counts as 0."""
    return F.when(x >= strong, 2).when(x >= weak, 1).otherwise(0)


def market_shock(snapshots: DataFrame, keys: list[str], required: int = 1) -> DataFrame:
    """State of the market per key (a time): normal, amber or red down or up, or chaos, with severity, bias and whether neutral is blocked.

    ``snapshots`` has a row a key and symbol: symbol, r5 and r15 (changes as
    fractions, null: unknown), volume_z, panic_vote (-1, 0 or 1: sentiment says
    risk off or on). The symbols btc and eth are benchmarks. Signals weigh 1 or 2:
    a benchmark's move, breadth, the median's impulse with volume, sentiment. Red
    takes 5 with two strong ones, amber 3 with a strong one; the other side must
    weigh less. One aggregate with exact medians: a key's symbols are few.
    """
    r5, r15 = F.coalesce("r5", F.lit(0.0)), F.coalesce("r15", F.lit(0.0))
    share = lambda rule: F.avg(F.coalesce(rule, F.lit(False)).cast("double"))
    mark = lambda name: F.max(F.when(F.lower("symbol") == name, F.col("r5")))
    x = snapshots.groupBy(*keys).agg(
        F.count("*").alias("active"), share((r5 <= -FALL_5) & (r15 <= -FALL_15)).alias("breadth_down"), share((r5 >= FALL_5) & (r15 >= FALL_15)).alias("breadth_up"), share((F.abs(r5) >= REVERSAL) & (r5 * r15 < 0)).alias("breadth_mixed"),
        F.coalesce(F.median("r5"), F.lit(0.0)).alias("median_r5"), F.coalesce(F.median(F.abs("r5")), F.lit(0.0)).alias("median_abs_r5"), F.coalesce(F.median("volume_z"), F.lit(0.0)).alias("median_volume_z"), *[mark(b).alias(b) for b in BENCHMARKS], F.max("panic_vote").alias("vote"),
    )

    def side(sign: int, breadth: str) -> tuple[Column, Column]:
        """Weight and number of strong signals of one side."""
        move = F.col("median_r5") * sign
        impulse = F.when((move >= IMPULSE[0][0]) & (F.col("median_volume_z") >= IMPULSE[0][1]), 2).when((move >= IMPULSE[1][0]) & (F.col("median_volume_z") >= IMPULSE[1][1]), 1).otherwise(0)
        parts = [*[_weight(F.col(b) * sign, *bounds) for b, bounds in BENCHMARKS.items()], _weight(F.col(breadth), *BREADTH), impulse, F.when(F.col("vote") == sign, 1).otherwise(0)]
        return sum(parts[1:], parts[0]), sum(((p == 2).cast("int") for p in parts[1:]), (parts[0] == 2).cast("int"))

    for name, sign in (("down", -1), ("up", 1)):
        weight, strong = side(sign, f"breadth_{name}")
        both = F.coalesce((F.col("btc") * sign >= BENCHMARKS["btc"][0]) & (F.col("eth") * sign >= BENCHMARKS["eth"][0]), F.lit(False))
        x = x.withColumns({f"{name}_weight": weight, f"{name}_strong": strong, f"_{name}": (F.col(f"breadth_{name}") >= BREADTH[0]) | both})
    chaos = (F.col("active") >= max(CHAOS_SYMBOLS, required)) & (F.col("median_abs_r5") >= CHAOS_MOVE) & (F.col("median_volume_z") >= CHAOS_VOLUME) & (F.col("breadth_mixed") >= CHAOS_MIXED) & (F.abs("median_r5") <= CHAOS_MEDIAN)
    over = lambda a, b: F.col(f"{a}_weight") > F.col(f"{b}_weight")
    red = lambda a, b: (F.col(f"{a}_weight") >= 5) & (F.col(f"{a}_strong") >= 2) & over(a, b)
    amber = lambda a, b: (F.col(f"{a}_weight") >= 3) & ((F.col(f"{a}_strong") >= 1) | F.col(f"_{a}")) & over(a, b)
    state = F.when(chaos, "chaos").when(red("down", "up"), "red_down").when(red("up", "down"), "red_up").when(amber("down", "up"), "amber_down").when(amber("up", "down"), "amber_up").otherwise("normal")
    x = x.withColumn("state", state)
    severity = F.when(F.col("state").isin("chaos", "red_down", "red_up"), "lockdown").when(F.col("state").startswith("amber"), "guarded").otherwise("normal")
    bias = F.when(F.col("state") == "chaos", "two_sided").when(F.col("state").endswith("down"), "down").when(F.col("state").endswith("up"), "up").otherwise("neutral")
    firm = lambda a: (F.col("state") == f"amber_{a}") & (F.col(f"{a}_weight") >= 4) & ((F.col(f"{a}_strong") >= 2) | (F.col(f"breadth_{a}") >= BREADTH[0]) | (F.col("median_abs_r5") >= 0.010))
    return x.withColumn("severity", severity).withColumn("bias", bias).withColumn("blocks_neutral", (severity == "lockdown") | firm("down") | firm("up")).drop("_down", "_up")
