"""The gates that a calibrator passes before it counts, and the event model with its held-out end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.direction import policy_confidence
from ..sources.shared import saved
from . import crossfit
from .buckets import running
from .intervals import lower_bound
from .models import fit_groups, flat_steps, softmax_steps
from .selection import selected_returns

#: Rows from which a model is learnt at all, bounds of the share of wins, share of censored roots that may be, and the least adverse return assumed for one.
LEAST_ROWS, LEAST_WINS, MOST_WINS, MOST_CENSORED, ADVERSE = 300, 0.15, 0.85, 0.05, -0.01
#: Rows and times of the held-out end, its share, least rows a class of either part, and by how much its loss must be smaller.
HOLDOUT_ROWS, HOLDOUT_TIMES, HOLDOUT_SHARE, TRAIN_CLASS, HOLDOUT_CLASS, EVENT_MARGIN = 18, 5, 0.20, 3, 2, 0.005


def calibrator_gates(rows: DataFrame, key: str, ts: str, available: str, features: list[str], score: str, label: str, weight: str, ret: str, raw: str, adjustment: str, least: int = 80, threshold: float = 0.5) -> DataFrame:
    """What keeps each key's calibrator from use: a row a key, with the first gate that fails, or fitted.

    Gates in order: ``samples`` and effective ones, independent clusters, a mean
    above 0 and both lower bounds too (``expectancy``: insufficient, negative,
    uncertain or positive); labels in balance; LEAST_ROWS rows; out-of-fold
    predictions; their skill; returns of what the policy would have selected by
    them at ``threshold``, over all blocks and over the last alone. ``raw`` and
    ``adjustment`` are the confidence before calibration and what multiplies it.

    Columns: key, samples, expectancy, mean, shortfall, lower, clusters,
    temporal_lower, win_rate, balanced, oof_samples, skill, selected, terminal,
    gate, fitted.
    """
    known = saved(rows, "calibrator-rows")
    all_ = known.withColumn("_c", F.lit(1.0))
    money = selected_returns(all_, key, [0.0], "_c", ret, weight, ts, available, least)
    wins = known.groupBy(F.col(key).alias("_w")).agg(F.avg(F.col(label).cast("double")).alias("win_rate"), (2 * F.least(F.sum(label), F.count("*") - F.sum(label))).alias("balanced"))
    oof = saved(crossfit.out_of_fold(known, key, ts, available, features, score, label, weight, least, carried=[ret, raw, adjustment]), "calibrator-oof")
    skill = crossfit.skill(oof, key, label, weight, least).select(F.col(key).alias("_s"), F.col("samples").alias("oof_samples"), F.col("status").alias("skill"))
    told = oof.withColumn("_c", policy_confidence(F.col(raw), F.col("feature_p"), F.col("n_train"), F.col(adjustment)))
    chosen = selected_returns(told, key, [threshold], "_c", ret, weight, ts, available, least).select(F.col(key).alias("_p"), F.col("status").alias("selected"))
    last = told.where(F.col("block") == F.col("n_blocks") - 1)
    end = selected_returns(last, key, [threshold], "_c", ret, weight, ts, available, least, least_clusters=min(crossfit.LAST_TIMES, max(2, least))).select(F.col(key).alias("_t"), F.col("status").alias("terminal"))
    x = money.withColumnRenamed("status", "expectancy")
    for part, name in ((wins, "_w"), (skill, "_s"), (chosen, "_p"), (end, "_t")):
        x = x.join(part, F.col(key).eqNullSafe(F.col(name)), "left").drop(name)
    x = x.withColumns({"oof_samples": F.coalesce("oof_samples", F.lit(0)), **{c: F.coalesce(c, F.lit("insufficient")) for c in ("skill", "selected", "terminal")}})
    gate = (
        F.when(F.col("expectancy") != "positive", "expectancy").when((F.col("balanced") < least) | ~F.col("win_rate").between(LEAST_WINS, MOST_WINS), "label_balance").when(F.col("samples") < LEAST_ROWS, "rows")
        .when(F.col("oof_samples") < least, "out_of_fold").when(F.col("skill") != "accepted", "skill").when(F.col("selected") != "positive", "selected_policy").when(F.col("terminal") != "positive", "terminal_policy")
    )
    return x.select(key, "samples", "expectancy", "mean", "std", "n_eff", "shortfall", "lower", "clusters", "temporal_lower", "win_rate", "balanced", "oof_samples", "skill", "selected", "terminal", gate.alias("gate"), gate.isNull().alias("fitted"))


def censoring(counts: DataFrame) -> DataFrame:
    """``counts`` (matured_total, labeled_total, censored_total, unresolved_total, invalid_labeled_total; expectancy, samples, mean, std, n_eff, shortfall, lower, temporal_lower) with censoring_rate, assumed_return, adjusted_mean, sensitivity and expectancy as gated.

    Unresolved or invalid roots block. Censored ones get an adverse return each:
    the least of -1 %, the shortfall and the mean less three deviations, -1 at
    worst; at most MOST_CENSORED of the matured may be, and the mean must stay
    above 0, as must both lower bounds.
    """
    positive = F.coalesce(F.col("expectancy") == "positive", F.lit(False))
    unresolved = F.col("unresolved_total") + F.when(positive, F.greatest(F.lit(0), F.col("samples") - F.col("matured_total"))).otherwise(0)
    invalid = F.greatest(F.col("invalid_labeled_total"), F.col("labeled_total") - F.col("samples"))
    rate = F.when(F.col("matured_total") > 0, F.col("censored_total") / F.col("matured_total")).otherwise(0.0)
    assumed = F.greatest(F.lit(-1.0), F.least(F.lit(ADVERSE), F.col("shortfall"), F.col("mean") - 3 * F.col("std")))
    n = F.greatest(F.lit(1.0), F.coalesce(F.nullif(F.col("n_eff"), F.lit(0.0)), F.nullif(F.col("samples").cast("double"), F.lit(0.0)), F.lit(1.0)))
    adjusted = (F.col("mean") * n + assumed * F.col("censored_total")) / (n + F.col("censored_total"))
    hard = (unresolved > 0) | (invalid > 0)
    judged = ~hard & (F.col("censored_total") > 0) & positive
    passes = F.coalesce((rate <= MOST_CENSORED) & (adjusted > 0) & (F.col("lower") > 0) & (F.col("temporal_lower") > 0), F.lit(False))
    sensitivity = F.when(hard, "hard_block").when(~judged, "not_evaluated").when(passes, "passed").otherwise("failed")
    return counts.select(
        "*", rate.alias("censoring_rate"), F.when(judged, assumed).alias("assumed_return"), F.when(judged, adjusted).alias("adjusted_mean"), sensitivity.alias("sensitivity"), F.when(sensitivity.isin("hard_block", "failed"), "censored").otherwise(F.col("expectancy")).alias("gated_expectancy")
    )


def event_models(rows: DataFrame, key: str, ts: str, available: str, horizon: int, features: list[str], event: str, events: list[str], ret: str, horizon_event: str, least: int = 80, unit_rows: int = 200_000) -> DataFrame:
    """A softmax model of events a key, learnt before its last times and judged on them: key, status, n_samples, fit_samples, holdout_samples, loss, null_loss, gap, error_bound, coef, intercept, horizon_mean, horizon_lower.

    Rows whose label came before their horizon ended take no part. The held-out
    end is a fifth of the rows and five times at least, cut at a whole time; rows
    before it whose label came later are on neither side. insufficient where rows
    or classes are too few; accepted if the loss is smaller by EVENT_MARGIN than
    that of the classes' shares; else rejected, without a model. The end is found
    by counts of times, newest first, carried by bucket; fits see all rows (see
    :func:`fit_groups`), and all of the end are judged.
    """
    minimum = max(30, least)
    number = lambda c: F.col(c).cast("double")
    label = F.array_position(F.array(*map(F.lit, events)), F.upper(F.trim(F.col(event)))).cast("int") - 1
    x = rows.select(F.col(key).alias("k"), F.col(ts).cast("long").alias("ts"), F.col(available).cast("long").alias("available"), label.alias("y"), F.array(*[number(c) for c in features]).alias("x"), number(ret).alias("ret"))
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = saved(x.where((F.col("y") >= 0) & (F.col("ts") > 0) & (F.col("available") >= F.col("ts") + horizon) & whole & F.col("ret").isNotNull() & ~F.isnan("ret")), "event-rows")
    classes = [F.count_if(F.col("y") == i) for i in range(len(events))]
    sizes = x.groupBy("k").agg(F.count("*").alias("n"), F.least(*classes).alias("rarest"))
    times = x.groupBy("k", "ts").agg(F.count("*").alias("c"))
    later = running(times, ["k"], -F.floor(F.col("ts") / (30 * 86400)), [F.col("ts").desc()], {"rows": ("sum", F.col("c")), "times": ("sum", F.lit(1))})
    target = F.greatest(F.lit(HOLDOUT_ROWS), F.ceil(F.col("n") * HOLDOUT_SHARE))
    reach = later.join(sizes.select(F.col("k").alias("_k"), "n"), F.col("k").eqNullSafe(F.col("_k"))).where((F.col("rows") >= target) & (F.col("times") >= HOLDOUT_TIMES))
    cut = saved(sizes.join(reach.groupBy(F.col("k").alias("_k")).agg(F.max("ts").alias("cut")), F.col("k").eqNullSafe(F.col("_k")), "left").drop("_k"), "event-cuts")
    split = x.join(cut.select(F.col("k").alias("_k"), "cut"), F.col("k").eqNullSafe(F.col("_k"))).drop("_k")
    split = split.withColumn("side", F.when(F.col("ts") >= F.col("cut"), "end").when(F.col("available") < F.col("cut"), "train")).where("side is not null")
    split = saved(split, "event-sides")
    is_ = lambda s: F.col("side") == s
    per = split.groupBy("k").agg(F.count_if(is_("train")).alias("fit_samples"), F.count_if(is_("end")).alias("holdout_samples"), *[F.count_if(is_("train") & (F.col("y") == i)).alias(f"t{i}") for i in range(len(events))], *[F.count_if(is_("end") & (F.col("y") == i)).alias(f"h{i}") for i in range(len(events))])
    enough = (F.col("n") >= minimum) & (F.col("rarest") >= max(5, minimum // 20)) & (F.col("fit_samples") >= max(24, minimum // 2)) & (F.least(*[f"t{i}" for i in range(len(events))]) >= TRAIN_CLASS) & (F.least(*[f"h{i}" for i in range(len(events))]) >= HOLDOUT_CLASS)
    about = saved(cut.join(per.withColumnRenamed("k", "_k"), F.col("k").eqNullSafe(F.col("_k")), "left").drop("_k").withColumn("enough", F.coalesce(enough, F.lit(False))), "event-counts")
    fit_on = split.where(is_("train")).join(about.where("enough").select(F.col("k").alias("_k")), F.col("k").eqNullSafe(F.col("_k")))
    learnt = fit_groups(fit_on.select("k", "x", F.col("y").cast("double").alias("y"), F.lit(1.0).alias("w")), ["k"], lambda: flat_steps(softmax_steps(len(features), len(events))), unit_rows)
    coef = F.array(*[F.slice("theta", 1 + i * len(features), len(features)) for i in range(len(events))])
    models = saved(learnt.select(F.col("k").alias("m"), coef.alias("coef"), F.slice("theta", 1 + len(events) * len(features), len(events)).alias("intercept")), "event-models")
    counts = F.array(*[F.col(f"t{i}").cast("double") for i in range(len(events))])
    judged = split.where(is_("end")).join(models, F.col("k").eqNullSafe(F.col("m"))).join(about.select(F.col("k").alias("_k"), (F.transform(counts, lambda c: F.greatest(F.lit(1e-9), F.try_divide(c, F.col("fit_samples"))))).alias("shares")), F.col("k").eqNullSafe(F.col("_k")))
    dot = lambda w: F.aggregate(F.zip_with(w, F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    logits = F.zip_with("coef", "intercept", lambda w, b: dot(w) + b)
    judged = judged.withColumn("z", logits).withColumn("z", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    judged = judged.withColumn("p", F.transform("z", lambda v: v / F.aggregate("z", F.lit(0.0), lambda s, u: s + u)))
    said = lambda c: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), F.element_at(c, F.col("y") + 1)))
    total = F.aggregate("shares", F.lit(0.0), lambda s, u: s + u)
    gaps = [F.abs(F.avg((F.col("y") == i).cast("double")) - F.avg(F.element_at("p", i + 1))) for i in range(len(events))]
    losses = judged.groupBy("k").agg(F.avg(-F.ln(said(F.col("p")))).alias("loss"), F.avg(-F.ln(said(F.transform("shares", lambda s: s / total)))).alias("null_loss"), F.greatest(*gaps).alias("gap"), F.count("*").alias("_n"))
    losses = losses.withColumn("error_bound", F.least(F.lit(1.0), F.col("gap") + F.sqrt(F.ln(F.lit(2.0 * len(events) / 0.05)) / (2 * F.col("_n"))))).drop("_n").withColumnRenamed("k", "_l")
    ends = split.where(is_("train") & (F.col("y") == events.index(horizon_event))).groupBy(F.col("k").alias("_h")).agg(F.avg("ret").alias("hm"), F.stddev_samp("ret").alias("hs"), F.count("*").cast("double").alias("hn"))
    got = about.join(losses, F.col("k").eqNullSafe(F.col("_l")), "left").join(models, F.col("k").eqNullSafe(F.col("m")), "left").join(ends, F.col("k").eqNullSafe(F.col("_h")), "left")
    good: Column = F.coalesce(F.col("loss") < F.col("null_loss") - EVENT_MARGIN, F.lit(False))
    status = F.when(~F.col("enough"), "insufficient").when(good, "accepted").otherwise("rejected")
    only = lambda c: F.when(F.col("enough") & good, F.col(c))
    low = lower_bound(F.col("hm"), F.col("hs"), F.col("hn"), 0.95)
    return got.select(F.col("k").alias(key), status.alias("status"), F.col("n").alias("n_samples"), F.coalesce("fit_samples", F.lit(0)).alias("fit_samples"), F.coalesce("holdout_samples", F.lit(0)).alias("holdout_samples"), "loss", "null_loss", "gap", "error_bound", only("coef").alias("coef"), only("intercept").alias("intercept"), only("hm").alias("horizon_mean"), F.when(F.col("enough") & good, low).alias("horizon_lower"))
