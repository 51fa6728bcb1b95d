"""Purged out-of-fold evidence: every block of time is judged by models that were learnt before it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved
from .intervals import LAST_TIMES, validation_blocks
from .models import fit_groups, platt_steps, weighted_steps

#: Gradient steps of a fold's model, by how much a loss must be smaller, and the bound of a logit.
FOLD_STEPS, IMPROVEMENT, LOGIT = 260, 1e-4, 60.0

def _of_features(steps, n_features: int):
    """Steps that see the first columns alone."""
    try:
        f = next(steps)
        while True:
            f = steps.send((yield lambda x, y, w, c, f=f: f(x[:, :n_features], y, w, c)))
    except StopIteration as end:
        return end.value


def _fold_steps(n_features: int, least: int):
    """Steps of a fold on x, features and then a score: coef, bias, fa, fb, sa, sb, null_p and whether both scalers are fitted."""
    coef, bias = yield from _of_features(weighted_steps(n_features, FOLD_STEPS), n_features)
    fa, fb, by_features = yield from platt_steps(lambda x: x[:, :n_features] @ coef + bias, least=least)
    sa, sb, by_score = yield from platt_steps(lambda x: x[:, n_features], least=least)
    won, total = yield lambda x, y, w, c: np.array([(w * c) @ y, w @ c])
    return [*coef, bias, fa, fb, sa, sb, min(1 - 1e-12, max(1e-12, won / total)), by_features and by_score]


def _probability(logit: Column, a: str, b: str) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col(a) * logit + F.col(b)))))


def out_of_fold(rows: DataFrame, key: str, ts: str, available: str, features: list[str], score: str, label: str, weight: str, least: int, carried: list[str] = (), unit_rows: int = 200_000) -> DataFrame:
    """Probabilities of the rows of each validation block, by models learnt on what was known before the block.

    Returns key, ts, available, label, weight and ``carried`` columns, block,
    n_times (of its block), n_blocks (of its key), n_train, logit, feature_p,
    score_p, null_p. A fold learns on rows whose label came before the block's
    first time; it needs ``least`` of them, and twice the rarer label too. A model
    of the features, a Platt scaler over it, one over the score alone, and the
    share of wins are learnt together. Blocks without a fold's model have no rows.
    Rows that miss a value, or whose label comes before they do, take no part.

    A fold, (key, block), learns from all of its rows (see :func:`fit_groups`); a
    key has at most eleven folds. Every row of a block is judged, in the JVM.
    """
    number = lambda c: F.col(c).cast("double")
    vector = F.array(*[number(c) for c in features])
    x = rows.select(F.col(key).alias("k"), F.col(ts).cast("long").alias("ts"), F.col(available).cast("long").alias("available"), vector.alias("x"), number(score).alias("score"), F.col(label).cast("int").alias("y"), number(weight).alias("w"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)])
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = saved(x.where(whole & F.col("score").isNotNull() & F.col("y").isin(0, 1) & (F.col("w") > 0) & (F.col("available") >= F.col("ts"))), "fold-rows")
    blocks = validation_blocks(x, "k", "ts", least)
    blocks = saved(blocks.select(F.col("k").alias("_k"), "block", "first_ts", "last_ts", "n_times", F.count("*").over(Window.partitionBy("k")).cast("int").alias("n_blocks")), "fold-blocks")
    known = x.join(blocks, F.col("k").eqNullSafe(F.col("_k")) & (F.col("available") < F.col("first_ts"))).select("k", "block", "ts", "available", "x", "score", "y", "w")
    sizes = known.groupBy("k", "block").agg(F.count("*").alias("n_train"), F.sum("y").alias("wins"))
    rarer = F.least("wins", F.col("n_train") - F.col("wins"))
    sizes = saved(sizes.where((F.col("n_train") >= least) & (2 * rarer >= least)).select(F.col("k").alias("s_k"), F.col("block").alias("s_block"), "n_train"), "fold-sizes")
    train = known.join(sizes, F.col("k").eqNullSafe(F.col("s_k")) & (F.col("block") == F.col("s_block")))
    learnt = fit_groups(train.select("k", "block", F.concat("x", F.array("score")).alias("x"), F.col("y").cast("double").alias("y"), "w"), ["k", "block"], lambda: _fold_steps(len(features), least), unit_rows)
    part = lambda i: F.col("theta")[len(features) + i]
    names = ("bias", "fa", "fb", "sa", "sb", "null_p")
    models = saved(learnt.where(part(6) == 1).select(F.col("k").alias("m_k"), F.col("block").alias("m_block"), F.col("n").alias("n_train"), F.slice("theta", 1, len(features)).alias("coef"), *[part(i).alias(c) for i, c in enumerate(names)]), "fold-models")
    placed = x.join(blocks, F.col("k").eqNullSafe(F.col("_k")) & F.col("ts").between(F.col("first_ts"), F.col("last_ts")))
    judged = placed.join(models, F.col("k").eqNullSafe(F.col("m_k")) & (F.col("block") == F.col("m_block")))
    logit = F.aggregate(F.zip_with("x", "coef", lambda a, b: a * b), F.col("bias"), lambda s, v: s + v)
    judged = judged.withColumn("logit", F.greatest(F.lit(-LOGIT), F.least(F.lit(LOGIT), logit))).withColumn("raw", logit)
    return judged.select(
        F.col("k").alias(key), F.col("ts").alias(ts), F.col("available").alias(available), F.col("y").alias(label), F.col("w").alias(weight), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)],
        "block", "n_times", "n_blocks", "n_train", "logit", _probability(F.col("raw"), "fa", "fb").alias("feature_p"), _probability(F.col("score"), "sa", "sb").alias("score_p"), "null_p",
    )


def skill(predictions: DataFrame, key: str, label: str, weight: str, least: int) -> DataFrame:
    """Whether the features foretell more than the score and the share of wins: key, status, samples, final_samples, final_times and six log losses.

    ``predictions`` are those of :func:`out_of_fold`. accepted if, over all blocks
    and over the last alone, the features' loss is smaller than both others, and
    the last block has ``least`` rows and five times (``least`` of them if fewer,
    two at least); insufficient with fewer than ``least`` rows, or no model for
    the last block; else rejected.
    """
    y, w = F.col(label), F.col(weight)
    last = F.col("block") == F.col("n_blocks") - 1
    loss = lambda p: -F.ln(F.when(y == 1, F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))).otherwise(1 - F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))))
    mean = lambda p, rule: F.try_divide(F.sum(F.when(rule, w * loss(p))), F.sum(F.when(rule, w)))
    names = ("feature", "score", "null")
    got = predictions.groupBy(key).agg(
        F.count("*").alias("samples"), F.count_if(last).alias("final_samples"), F.coalesce(F.max(F.when(last, F.col("n_times"))), F.lit(0)).alias("final_times"),
        *[mean(f"{n}_p", F.lit(True)).alias(f"{n}_loss") for n in names], *[mean(f"{n}_p", last).alias(f"final_{n}_loss") for n in names],
    )
    better = lambda a, b: F.col(a) + IMPROVEMENT < F.col(b)
    accepted = (F.col("final_samples") >= least) & (F.col("final_times") >= min(LAST_TIMES, max(2, least)))
    for part in ("", "final_"):
        for other in ("score", "null"):
            accepted = accepted & better(f"{part}feature_loss", f"{part}{other}_loss")
    status = F.when((F.col("samples") < least) | (F.col("final_samples") == 0), "insufficient").when(accepted, "accepted").otherwise("rejected")
    return got.withColumn("status", status)
