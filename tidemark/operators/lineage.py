"""Lineage of publications: roots by pointer jumping, and a funnel of conditions counted in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved


def roots(rows: DataFrame, id_col: str, ts_col: str, previous_col: str, reuse_col: str) -> DataFrame:
    """The root of each publication: id_col, root, is_root, chain_first_ts.

    A row that reuses (``reuse_col``) a previous one has its root, others are
    their own. Only a previous row that comes before, by time and then id, is
    followed; one that is unknown or later is the root itself. chain_first_ts is
    the root's time (null if the root is no row). Ids are distinct.

    Links are halved round by round: rounds are logarithmic in the longest chain,
    and each is saved. Each side of a round's join is a saved table, so that a
    root with very many rows is split.
    """
    there = rows.select(F.col(id_col).alias("id"), F.col(ts_col).alias("ts"), F.when(F.coalesce(F.col(reuse_col), F.lit(False)), F.col(previous_col)).alias("previous"))
    there = saved(there, "lineage")
    former = there.select(F.col("id").alias("p_id"), F.col("ts").alias("p_ts"))
    linked = there.join(former, F.col("previous") == F.col("p_id"), "left")
    before = F.coalesce((F.col("p_ts") < F.col("ts")) | ((F.col("p_ts") == F.col("ts")) & (F.col("p_id") < F.col("id"))), F.lit(False))
    now = saved(linked.select("id", F.coalesce("previous", "id").alias("root"), F.coalesce("p_ts", F.when(F.col("previous").isNull(), F.col("ts"))).alias("first"), F.when(before, F.col("previous")).alias("up"), F.col("previous").isNull().alias("is_root")), "lineage-links")
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("id").alias("a_id"), F.col("root").alias("a_root"), F.col("first").alias("a_first"), F.col("up").alias("a_up"))
        done, open_ = now.where("up is null"), now.where("up is not null")
        jumped = open_.join(above, F.col("up") == F.col("a_id")).select("id", F.col("a_root").alias("root"), F.col("a_first").alias("first"), F.col("a_up").alias("up"), "is_root")
        now = saved(done.unionByName(jumped), "lineage-links")
    return now.select(F.col("id").alias(id_col), "root", "is_root", F.col("first").alias("chain_first_ts"))


def funnel(rows: DataFrame, key: str, tests: list[tuple[str, str, Column]], win: Column) -> DataFrame:
    """How many rows of each key pass test after test: key, n, wins, and for every stage its rows and wins, and for every reason what it dropped.

    ``tests`` are (stage, reason, condition), in order; a null condition fails.
    A stage has the rows that pass its test and all before it, stages that share
    a name the last of them; a row is dropped for its first failed test. Tests
    are read once, as bits of a mask; rows are counted by key and mask, at most
    2**tests of them a key, and every figure is a sum over masks.
    """
    mask = sum((F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1 << i) for i, (_, _, c) in enumerate(tests)), F.lit(0))
    counted = rows.groupBy(F.col(key), mask.alias("_mask")).agg(F.count("*").alias("_n"), F.sum(F.coalesce(win, F.lit(False)).cast("long")).alias("_w"))
    stages = {stage: i for i, (stage, _, _) in enumerate(tests)}
    passed = lambda i: F.col("_mask").bitwiseAND((2 << i) - 1) == 0
    failed_first = lambda i: F.col("_mask").bitwiseAND((2 << i) - 1) == (1 << i)
    total = lambda c, rule: F.coalesce(F.sum(F.when(rule, F.col(c))), F.lit(0))
    reasons = list(dict.fromkeys(reason for _, reason, _ in tests))
    any_of = lambda reason: F.array_contains(F.array(*[failed_first(i) for i, (_, r, _) in enumerate(tests) if r == reason]), True)
    return counted.groupBy(key).agg(
        F.sum("_n").alias("n"), F.sum("_w").alias("wins"), *[total("_n", passed(i)).alias(f"{s}_n") for s, i in stages.items()], *[total("_w", passed(i)).alias(f"{s}_wins") for s, i in stages.items()], *[total("_n", any_of(r)).alias(f"dropped_{r}") for r in reasons]
    )
