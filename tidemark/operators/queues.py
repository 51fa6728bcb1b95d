"""Queues of repairs with backoff, and repairs of labels that came too early."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds before the next try after so many tries, the last for all more; and of a job that cannot be tried at all.
DELAYS, INVALID_DELAY = (60, 120, 300, 600, 1800), 1800


def retry_delay(attempts: Column) -> Column:
    """Seconds before the next try of a job that had ``attempts`` tries before the one that failed now."""
    return F.element_at(F.array(*map(F.lit, DELAYS)), (F.least(F.lit(len(DELAYS) - 1), F.greatest(F.lit(0), attempts)) + 1).cast("int"))


def due_jobs(jobs: DataFrame, now: Column | int, n: int) -> DataFrame:
    """The ``n`` pending jobs to try now: next_attempt_ts first, then first_requested_ts, then repair_id. A distributed top-n."""
    return jobs.where((F.col("state") == "pending") & (F.col("next_attempt_ts") <= now)).orderBy("next_attempt_ts", "first_requested_ts", "repair_id").limit(n)


def attempted(due: DataFrame, found: DataFrame, now: Column | int, delay: Column | None = None) -> DataFrame:
    """Jobs after a try, for a merge into the queue: state, next_attempt_ts, attempt_count, last_attempt_ts, last_error.

    ``due`` has repair_id, symbol, expected_ts (null: any), range_start_ts,
    range_end_ts, attempt_count; ``found`` symbol and ts of what the source now
    has. A job is resolved if what it expects is among the rows in its range.
    """
    n = F.col("attempt_count")
    valid = F.coalesce((F.col("range_start_ts") > 0) & (F.col("range_end_ts") >= F.col("range_start_ts")), F.lit(False))
    there = found.select(F.col("symbol").alias("_s"), F.col("ts").alias("_ts")).distinct()
    inside = (F.col("symbol") == F.col("_s")) & F.col("_ts").between(F.col("range_start_ts"), F.col("range_end_ts")) & (F.col("expected_ts").isNull() | (F.col("_ts") == F.col("expected_ts")))
    hits = due.where(valid).join(there, inside).select("repair_id").distinct().withColumn("_hit", F.lit(True))
    x = due.join(hits, "repair_id", "left")
    resolved = F.coalesce("_hit", F.lit(False))
    wait = F.when(valid, delay if delay is not None else retry_delay(n)).otherwise(INVALID_DELAY)
    error = F.when(resolved, None).when(valid, "settlement not yet returned by funding history").otherwise("invalid repair range")
    return x.withColumns({"state": F.when(resolved, "resolved").otherwise("pending"), "next_attempt_ts": F.when(resolved, F.lit(now)).otherwise(F.lit(now) + wait), "attempt_count": n + 1, "last_attempt_ts": F.lit(now), "last_error": error}).drop("_hit")


def newest_by_root(bots: DataFrame, rows: DataFrame, status: str | None = None) -> DataFrame:
    """The newest bot of each publication root: root, bot_id, started_ts.

    A bot's own root counts; only for roots that no bot names is it looked up by
    the row that it came from (``rows``: rec_id, publication_root, empty counting
    as none).
    """
    x = bots if status is None else bots.where(F.col("status") == status)
    newest = lambda df: df.groupBy("root").agg(F.max_by(F.struct("bot_id", "started_ts"), F.struct("started_ts", "bot_id")).alias("b")).select("root", "b.*")
    own = newest(x.where("publication_root is not null").withColumn("root", F.col("publication_root")))
    root = F.coalesce(F.when(F.trim("publication_root") != "", F.trim("publication_root")), F.col("rec_id")).alias("root")
    joined = newest(x.join(rows.select(F.col("rec_id").alias("origin_rec_id"), root), "origin_rec_id"))
    return own.unionByName(joined.join(own.select("root"), "root", "left_anti"))


def early_labels(outcomes: DataFrame, now: Column | int, grace: int = 120) -> DataFrame:
    """Labels declared available before their contract's due time, with the time they should have: key, label_available_ts.

    ``outcomes`` has key, ts, horizon, available, contract_grace (null: none
    given) and stored_due. Only where the stored due time is that of the contract,
    has passed, and is later than what is declared.
    """
    own = F.coalesce("contract_grace", F.lit(grace))
    due = F.when((F.col("ts") > 0) & (F.col("horizon") > 0) & (own > 0), F.col("ts") + F.col("horizon") + own)
    early = (F.col("available") > 0) & (F.col("available") < F.col("ts") + F.col("horizon") + grace) & (F.col("stored_due") == due) & (due <= now) & (F.col("available") < due)
    return outcomes.where(early).select("key", F.col("stored_due").alias("label_available_ts"))


def direction_conflicts(rows: DataFrame, running: DataFrame) -> DataFrame:
    """What running bots keep a candidate from: rec_id, bot_id, code, same_root.

    ``rows`` has rec_id, root, venue, symbol, direction, bot; ``running`` bot_id,
    root, venue, symbol, direction, bot. Another strategy on the symbol, a running
    bot of unknown direction, or one of the opposite direction conflict. Grids may
    be neutral too. Rows of unknown strategies, venues or directions have none.
    """
    low, up = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    kinds = ("futures_grid", "directional_trend")
    allowed = lambda bot, side: side.isin("long", "short") | ((bot == kinds[0]) & (side == "neutral"))
    mine = rows.select("rec_id", F.coalesce(F.nullif(F.trim("root"), F.lit("")), F.col("rec_id").cast("string")).alias("root"), low("venue").alias("venue"), up("symbol").alias("symbol"), low("direction").alias("side"), F.trim("bot").alias("kind"))
    mine = mine.where((F.col("venue") == "linear") & F.col("kind").isin(*kinds) & allowed(F.col("kind"), F.col("side")))
    theirs = running.select("bot_id", F.trim("root").alias("b_root"), low("venue").alias("venue"), up("symbol").alias("symbol"), low("direction").alias("b_side"), F.trim("bot").alias("b_kind")).where(F.col("b_kind").isin(*kinds))
    both = mine.join(theirs, ["venue", "symbol"])
    code = F.when(F.col("b_kind") != F.col("kind"), "SYMBOL_STRATEGY_ALREADY_RUNNING").when(~allowed(F.col("b_kind"), F.col("b_side")), "EXISTING_SYMBOL_DIRECTION_UNKNOWN").when(F.col("b_side") != F.col("side"), "OPPOSITE_SYMBOL_DIRECTION_RUNNING")
    return both.withColumn("code", code).where("code is not null").select("rec_id", "bot_id", "code", F.coalesce(F.col("b_root") == F.col("root"), F.lit(False)).alias("same_root"))


def repair_status(jobs: DataFrame) -> DataFrame:
    """One row over all jobs: pending, resolved, failed, next_due_ts (of pending ones), last_updated_ts."""
    is_ = lambda s: F.col("state") == s
    return jobs.agg(F.count_if(is_("pending")).alias("pending"), F.count_if(is_("resolved")).alias("resolved"), F.count_if(is_("failed")).alias("failed"), F.min(F.when(is_("pending"), F.col("next_attempt_ts"))).alias("next_due_ts"), F.max("updated_ts").alias("last_updated_ts"))


def best_snapshot(snapshots: DataFrame, benchmarks: tuple[str, ...] = ("BTCUSDT", "ETHUSDT")) -> DataFrame:
    """Of each symbol's venues the freshest snapshot: symbol, venue, age_sec; benchmarks take the venue linear on equal age, others the one of least ``priority``."""
    prefer = F.when(F.col("symbol").isin(*benchmarks) & (F.col("venue") == "linear"), 0).otherwise(1)
    age = F.coalesce("age_sec", F.lit(10**9))
    return snapshots.groupBy("symbol").agg(F.min_by(F.struct("venue", "age_sec"), F.struct(age, prefer, "priority")).alias("_b")).select("symbol", "_b.*")
