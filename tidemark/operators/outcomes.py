"""Statistics of outcomes: the headline of an archive, breakdowns in one scan, and how independent a sample is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats


def _totals(prefix: str, rule: Column) -> list[Column]:
    ret = lambda c: F.coalesce(F.sum(F.when(rule, c)), F.lit(0.0))
    return [
        F.count_if(rule).alias(f"{prefix}total"), F.count_if(rule & (F.col("success") == 1)).alias(f"{prefix}wins"), ret(F.col("ret")).alias(f"{prefix}ret_sum"), ret(F.abs("ret")).alias(f"{prefix}abs_ret_sum")
    ]


def archive_summary(outcomes: DataFrame) -> DataFrame:
    """One row over outcomes (root, shadow, success, ret, status): all rows, and roots in all, as shadows, as actionable ones and as executed, each with wins and returns.

    One scan and one partial aggregate; flags that are null count as false.
    """
    root, shadow = (F.coalesce(F.col(c), F.lit(False)) for c in ("root", "shadow"))
    x = outcomes.agg(F.count("*").alias("raw_total"), *_totals("", root), *_totals("shadow_", root & shadow), *_totals("actionable_", root & ~shadow), F.count_if(root & (F.col("status") == "executed")).alias("executed_total"))
    return x.withColumn("duplicates", F.col("raw_total") - F.col("total")).select("*", *[_rate(p) for p in ("", "shadow_", "actionable_")])


def _rate(prefix: str) -> Column:
    return F.try_divide(f"{prefix}wins", f"{prefix}total").alias(f"{prefix}win_rate")


def breakdowns(outcomes: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """Statistics of outcomes (success, ret and the keys) by several sets of keys at once: breakdown, keys (null where not in the set), total, wins, losses, win_rate, avg_ret_pct, avg_abs_ret_pct.

    One scan: rows are first summed by all keys together, as all measures add up;
    only those sums go into each of the sets. Keys that are null are a group of
    their own.
    """
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    own = outcomes.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("success") == 1).alias("w"), F.sum("ret").alias("r"), F.sum(F.abs("ret")).alias("a"))
    entry = lambda name, part: F.struct(F.lit(name).alias("breakdown"), *[(F.col(k) if k in part else F.lit(None).cast(outcomes.schema[k].dataType)).alias(k) for k in keys])
    x = own.select("n", "w", "r", "a", F.inline(F.array(*[entry(name, part) for name, part in sets.items()])))
    n, wins = F.sum("n"), F.sum("w")
    return x.groupBy("breakdown", *keys).agg(
        n.alias("total"), wins.alias("wins"), (n - wins).alias("losses"), (wins / n).alias("win_rate"), (F.sum("r") / n * 100).alias("avg_ret_pct"), (F.sum("a") / n * 100).alias("avg_abs_ret_pct")
    )


def observability(outcomes: DataFrame, key: str, ts: str = "ts", end: str = "end", symbol: str = "symbol") -> DataFrame:
    """How independent each key's outcomes are: rows, distinct times and symbols, merged clusters of their windows, most windows apart, span of times."""
    x = outcomes.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(ts).alias("unique_timestamps"), F.count_distinct(symbol).alias("unique_symbols"), (F.max(ts) - F.min(ts)).alias("span"))
    windows = outcomes.select(key, F.col(ts).alias("s"), F.col(end).alias("e")).distinct()
    merged = stats.clusters(windows, key, "s", "e").groupBy(key).agg(F.count("*").alias("clusters"))
    return reduce(lambda a, b: a.join(b, key), [merged, stats.most_apart(windows, key, "s", "e")], x)


def label_ledger(rows: DataFrame, outcomes: DataFrame, ledger: DataFrame, key: str, now: Column, grace: int = 120) -> DataFrame:
    """What the ledger of labels says of each root that counts: key, ts, label_due_ts, state, reason.

    ``rows`` has key, ts, horizon, root and eligible; ``outcomes`` key and
    available; ``ledger`` key and state (waiting or censored) of what is there.
    An outcome makes a root labeled, whatever the ledger says; a censored one
    stays so; others wait until they are due, and are unresolved after. Roots new
    to the ledger get a reason that says whence they come.
    """
    o = outcomes.groupBy(F.col(key).alias("_o")).agg(F.max("available").alias("_available"))
    seen = ledger.groupBy(F.col(key).alias("_l")).agg(F.max("state").alias("_state"))
    x = rows.where(F.coalesce("root", F.lit(True)) & F.col("ts").isNotNull() & (F.col("ts") > 0)).join(o, F.col(key) == F.col("_o"), "left").join(seen, F.col(key) == F.col("_l"), "left")
    planned = F.when(F.col("horizon") > 0, F.col("ts") + F.col("horizon") + grace)
    labeled = F.col("_o").isNotNull()
    due = F.when(labeled & (F.col("_available") >= F.col("ts")), F.col("_available")).otherwise(planned)
    x = x.withColumn("label_due_ts", due).where(labeled | F.col("_l").isNotNull() | (F.coalesce("eligible", F.lit(False)) & planned.isNotNull()))
    state = F.when(labeled, "labeled").when(F.col("_state") == "censored", "censored").when(F.col("label_due_ts") <= now, "unresolved").otherwise("waiting")
    reason = F.when(F.col("_l").isNotNull(), "kept").when(labeled, "existing_outcome_materialized").otherwise("scheduled_for_label_horizon")
    return x.select(key, "ts", "label_due_ts", state.alias("state"), reason.alias("reason"))


def ledger_counts(ledger: DataFrame, key: str, valid: Column) -> DataFrame:
    """Matured roots of each key by what became of them: matured_total, labeled_total, censored_total, unresolved_total, invalid_labeled_total. ``valid`` says whether a labeled root's label is sound."""
    is_ = lambda s: F.col("state") == s
    return ledger.where(F.col("state") != "waiting").groupBy(key).agg(
        F.count("*").alias("matured_total"), F.count_if(is_("labeled")).alias("labeled_total"), F.count_if(is_("censored")).alias("censored_total"), F.count_if(is_("unresolved")).alias("unresolved_total"), F.count_if(is_("labeled") & ~F.coalesce(valid, F.lit(False))).alias("invalid_labeled_total")
    )
