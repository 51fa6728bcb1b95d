"""Cross-fitting and selected policies against loops and goldens, lineage of long chains, features out of JSON, recorded messages over restarts."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.operators import crossfit, lineage, models, selection
from tidemark.sources.recorded import RecordedMessages
from tidemark.sources.shared import shared_dir
from tidemark.streaming.candles import drain

HORIZON = 12 * 3600


def selected(spark, rows, least=80, thresholds=(0.5,), **options):
    df = spark.createDataFrame(rows, "k string, c double, r double, w double, ts long, available long")
    return {(r.k, r.threshold): r for r in selection.selected_returns(df, "k", list(thresholds), "c", "r", "w", "ts", "available", least, **options).collect()}


def test_many_symbols_of_one_horizon_are_one_cluster(spark):
    one = [("one", 0.9, 0.03 if i < 40 else -0.01, 1.0, 23 * HORIZON, 24 * HORIZON) for i in range(80)]
    apart = [("apart", 0.9, r, 1.0, c * HORIZON, (c + 1) * HORIZON) for c in range(3, 24) for r in (0.03, 0.03, 0.03, -0.01, -0.01)]
    straddling = [("two", 0.9, 0.02, 1.0, 20 * HORIZON - 1, 21 * HORIZON - 1), ("two", 0.9, 0.02, 1.0, 21 * HORIZON - 2, 22 * HORIZON - 2)]
    losing = [("losing", 0.9, -r, 1.0, t, e) for _, _, r, _, t, e in apart]
    bad = [("bad", 0.9, 0.03, 1.0, t, e) for _, _, _, _, t, e in apart] + [("bad", 0.1, None, 1.0, 5, 6)]
    got = selected(spark, one + apart + straddling + losing + bad)
    assert (got["one", 0.5].samples, got["one", 0.5].clusters, got["one", 0.5].temporal_n_eff, got["one", 0.5].status) == (80, 1, 1.0, "insufficient")
    good = got["apart", 0.5]
    assert (good.samples, good.clusters, good.status) == (105, 21, "positive") and good.temporal_n_eff == pytest.approx(21) and good.temporal_lower > 0
    assert got["two", 0.5].clusters == 1 and got["losing", 0.5].status == "negative"
    assert (got["bad", 0.5].status, got["bad", 0.5].samples) == ("insufficient", 0)


def plain_selected(rows, threshold):
    rows = [x for x in rows if x[1] + 1e-12 >= threshold]
    if not rows:
        return None
    total, left = sum(x[3] for x in rows), 0.2 * sum(x[3] for x in rows)
    mean, tail = sum(x[2] * x[3] for x in rows) / total, 0.0
    for x in sorted(rows, key=lambda x: x[2]):
        tail, left = tail + x[2] * min(x[3], left), max(0.0, left - x[3])
    by_ts = {}
    for x in rows:
        by_ts.setdefault(x[4], []).append(x)
    cohorts = sorted((max(x[5] for x in g), t, sum(x[2] * x[3] for x in g) / sum(x[3] for x in g), max(x[3] for x in g)) for t, g in by_ts.items())
    taken, last = [], -math.inf
    for end, start, r, w in cohorts:
        if start >= last:
            taken.append((r, w))
            last = end
    return len(rows), mean, tail / (0.2 * total), len(taken), sum(r * w for r, w in taken) / sum(w for _, w in taken)


def test_selected_returns_by_loop(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice("ab"), rnd.choice([0.1, 0.3, 0.5, 0.7]), rnd.uniform(-0.05, 0.06), float(rnd.randint(1, 4)), t := rnd.randrange(400) * 3600, t + rnd.randint(1, 60) * 3600) for _ in range(400)]
    got = selected(spark, rows, thresholds=[0.7, 0.2, 0.5, 0.95])
    for k in "ab":
        for threshold in (0.2, 0.5, 0.7):
            r, want = got[k, threshold], plain_selected([x for x in rows if x[0] == k], threshold)
            assert (r.samples, r.clusters) == (want[0], want[3]) and (r.mean, r.shortfall, r.temporal_mean) == pytest.approx((want[1], want[2], want[4]))
        assert got[k, 0.95].samples == 0


def plain_folds(rows, starts, least):
    """Probabilities by row, with folds one after the other; starts are the blocks' first times."""
    out = {}
    for i, first in enumerate(starts):
        train = sorted((r for r in rows if r[1] <= r[2] < first), key=lambda r: (r[1], r[2], r[4], r[5], r[6]))
        wins = sum(r[5] for r in train)
        if len(train) < least or 2 * min(wins, len(train) - wins) < least:
            continue
        total = sum(r[6] for r in train)
        width = len(train[0][3])
        mean = [sum(r[6] * r[3][j] for r in train) / total for j in range(width)]
        std = [max(1e-6, math.sqrt(sum(r[6] * (r[3][j] - mean[j]) ** 2 for r in train) / total)) for j in range(width)]
        z = [[(r[3][j] - mean[j]) / std[j] for j in range(width)] for r in train]
        own = [r[6] * len(train) / (2 * (wins if r[5] else len(train) - wins)) for r in train]
        share = min(0.98, max(0.02, sum(o for o, r in zip(own, train, strict=True) if r[5]) / sum(own)))
        w, b = [0.0] * width, math.log(share / (1 - share))
        for step in range(260):
            errors = [o * (1 / (1 + math.exp(-(b + sum(a * v for a, v in zip(w, zz, strict=True))))) - r[5]) for o, zz, r in zip(own, z, train, strict=True)]
            now = 0.12 / math.sqrt(1 + step / 75)
            grads = [sum(e * zz[j] for e, zz in zip(errors, z, strict=True)) / sum(own) for j in range(width)]
            b -= now * sum(errors) / sum(own)
            w = [a - now * (g + 0.08 * a) for a, g in zip(w, grads, strict=True)]
        coef = [a / s for a, s in zip(w, std, strict=True)]
        bias = b - sum(c * m for c, m in zip(coef, mean, strict=True))
        logit = lambda r: bias + sum(c * v for c, v in zip(coef, r[3], strict=True))  # noqa: E731, B023

        def platt(xs):
            a, b = 1.0, 0.0
            for _ in range(300):
                errors = [r[6] * (1 / (1 + math.exp(-(a * x + b))) - r[5]) for x, r in zip(xs, train, strict=True)]  # noqa: B023
                a, b = a - 0.06 * sum(e * x for e, x in zip(errors, xs, strict=True)) / total, b - 0.06 * sum(errors) / total  # noqa: B023
            return a, b

        (fa, fb), (sa, sb) = platt([logit(r) for r in train]), platt([r[4] for r in train])
        last = starts[i + 1] if i + 1 < len(starts) else math.inf
        for r in rows:
            if first <= r[1] < last:
                p = lambda a, x, b: 1 / (1 + math.exp(-(a * x + b)))
                out[r[7]] = (i, len(train), p(fa, logit(r), fb), p(sa, r[4], sb), sum(r[6] for r in train if r[5]) / total)
    return out


def fold_rows(n=160):
    rnd = random.Random(12)
    rows = []
    for i in range(n):
        x = [rnd.gauss(0, 1), rnd.gauss(3, 2)]
        y = int(rnd.random() < 1 / (1 + math.exp(-2.5 * x[0])))
        t = i // 2 * 100
        rows.append(("a", t, t + rnd.choice([50, 250, 900]), x, rnd.gauss(0, 1), y, float(rnd.randint(1, 3)), i))
    return rows


def test_out_of_fold_by_loop(spark):
    rows = fold_rows()
    flat = [(*r[:3], *r[3], *r[4:]) for r in rows] + [("few", 5, 6, 1.0, 1.0, 0.0, 1, 1.0, 900), ("a", 50, 40, 1.0, 1.0, 0.0, 1, 1.0, 901), ("a", 50, 60, None, 1.0, 0.0, 1, 1.0, 902)]
    df = spark.createDataFrame(flat, "k string, ts long, av long, x0 double, x1 double, score double, y int, w double, id long")
    got = crossfit.out_of_fold(df, "k", "ts", "av", ["x0", "x1"], "score", "y", "w", 20, carried=["id"]).collect()
    starts = sorted({min(r.ts for r in got if r.block == b) for b in {r.block for r in got}})
    want = plain_folds(rows, starts, 20)
    assert {r.id for r in got} == set(want) and len(got) == len(want)
    first = min(r.block for r in got)
    for r in got:
        block, n, *p = want[r.id]
        assert (r.block - first, r.n_train) == (block, n) and (r.feature_p, r.score_p, r.null_p) == pytest.approx(p, abs=1e-9)
    found = crossfit.skill(spark.createDataFrame(got), "k", "y", "w", 20).first()
    assert found.status == "accepted" and found.feature_loss < found.null_loss and found.final_samples >= 20
    noise = df.where("id < 900").withColumn("y", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    assert crossfit.skill(crossfit.out_of_fold(noise, "k", "ts", "av", ["x0", "x1"], "score", "y", "w", 20), "k", "y", "w", 20).first().status == "rejected"


def test_fit_by_group_is_the_plain_fit(spark):
    rows = [(str(i % 2), float(i % 7), float(i % 5), float(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    got = {r.k: r for r in models.fit_by_group(df, "k", ["a", "b"], "y").collect()}
    for k in "01":
        mine = [("k", 0, 1, [a, b], 0.0, int(y), 1.0, i) for i, (key, a, b, y) in enumerate(rows) if key == k]
        assert got[k].n == len(mine)
        p = [1 / (1 + math.exp(-(got[k].bias + sum(w * v for w, v in zip(got[k].weights, r[3], strict=True))))) for r in mine]
        assert sum((q > 0.5) == r[5] for q, r in zip(p, mine, strict=True)) > 90


@pytest.mark.parametrize("unit_rows", [200_000, 10])
def test_models_learn_from_all_rows(spark, unit_rows, monkeypatch):
    """One task a group, or many blocks and a few steps: 60,000 rows a group, most of them equal, against the plain fit on all rows."""
    n = {}
    if unit_rows == 10:
        n = {"iterations": 12}
        monkeypatch.setattr(models.weighted_steps, "__defaults__", (12, 0.12, 0.08))
        monkeypatch.setattr(models.platt_steps, "__defaults__", (12, 0.06, 80))
        monkeypatch.setattr(models.softmax_steps, "__defaults__", (12, 0.08, 0.002))
    i = F.col("id")
    df = spark.range(120_000).select(F.when(i % 2 == 0, "p").alias("k"), (i % 11 / 3).alias("a"), (i % 7 / 2).alias("b"), ((i * 7919 % 101) > 60).cast("double").alias("y"), (i * 31 % 17 % 3).cast("int").alias("z"))
    rows = df.toPandas()
    got = {r.k: r for r in models.fit_by_group(df, "k", ["a", "b"], "y", unit_rows).collect()}
    soft = {r.k: r for r in models.softmax_by_group(df, "k", ["a", "b"], "z", 3, unit_rows).collect()}
    platt = {r.k: r for r in models.platt_by_group(df, "k", "a", "y", unit_rows).collect()}
    for k in ("p", None):
        part = rows[rows.k.isna() if k is None else rows.k == k]
        x, y = part[["a", "b"]].to_numpy(float), part.y.to_numpy(float)
        w, b = models.fit_weighted(x, y, **n)
        assert got[k].n == soft[k].n == platt[k].n == 60_000
        assert (*got[k].weights, got[k].bias) == pytest.approx((*w, b), abs=1e-9)
        w, b = models.fit_softmax(x, part.z.to_numpy(int), 3, **n)
        assert np.allclose(soft[k].weights, w, atol=1e-9) and np.allclose(soft[k].bias, b, atol=1e-9)
        assert (platt[k].a, platt[k].b, platt[k].fitted) == pytest.approx(models.fit_platt(x[:, 0], y, **n), abs=1e-9)


def test_chain_of_a_thousand(spark):
    rows = [(i, 1000 + i, i - 1 if i else None, True) for i in range(1000)]
    rows += [(2000, 5000, 999, False), (2001, 5001, 2000, True), (2002, 5002, 77777, True), (2003, 5003, 2004, True), (2004, 5004, 2003, True), (2005, 5005, 2005, True), (2006, 5006, 2002, None)]
    df = spark.createDataFrame(rows, "id long, ts long, previous long, reuse boolean")
    got = {r.id: (r.root, r.is_root, r.chain_first_ts) for r in lineage.roots(df, "id", "ts", "previous", "reuse").collect()}
    assert {got[i] for i in range(1, 1000)} == {(0, False, 1000)} and got[0] == (0, True, 1000)
    assert (got[2000], got[2001], got[2002], got[2006]) == ((2000, True, 5000), (2000, False, 5000), (77777, False, None), (2006, True, 5006))
    # one that comes later is the root itself, and is not followed further
    assert (got[2003], got[2004], got[2005]) == ((2004, False, 5004), (2004, False, 5004), (2005, False, 5005))


def test_funnel(spark):
    df = spark.createDataFrame([("a", 1, 1, True), ("a", 0, 1, True), ("a", 1, None, False), ("b", 0, 0, None)], "k string, x int, y int, win boolean")
    got = {r.k: r.asDict() for r in lineage.funnel(df, "k", [("s", "old", F.col("x") == 1), ("t", "bad", F.col("y") == 1)], F.col("win")).collect()}
    assert got["a"] == {"k": "a", "n": 3, "wins": 2, "s_n": 2, "t_n": 1, "s_wins": 1, "t_wins": 1, "dropped_old": 1, "dropped_bad": 1}
    assert (got["b"]["dropped_old"], got["b"]["dropped_bad"], got["b"]["wins"]) == (1, 0, 0)


def test_features_by_hand(spark):
    snap = lambda **x: json.dumps({"feature_snapshot": x})
    factors = {"top_positive_factors": [{"feature": "atr_pct", "value": None}, 7], "top_negative_factors": [{"feature": "atr_pct", "value": "0.05"}], "direction_agg": {"strength": 0.4, "coherence": True, "direction_confidence_calibrated": 0.9, "direction_confidence": 0.1}, "funding": {"expected_funding_bps": None, "directional_funding_bps_8h": -100}}
    cases = [
        (snap(range_score=2, trend_strength="0.25", score=None, coherence=True, effective_sentiment=-0.5), 0.7, "long"), (snap(direction_sign=-1.0), 0.1, " Long "), (snap(direction_sign=None), 0.1, "long"),
        (snap(effective_sentiment=0.4, sentiment_alignment=-0.4), 0.1, "neutral"), (snap(effective_sentiment=0.4, sentiment_alignment=0.4), 0.1, "short"), (json.dumps(factors), -3.0, "short"), ("{", 0.1, "long"), ("[]", 0.1, "long"), (None, 0.1, "long"), (snap(range_score=1), None, "long"), (json.dumps({"feature_snapshot": {}}), 0.1, None),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, j string, score double, direction string").withColumn("v", X.variant(F.col("j")))
    vector, code = X.features(F.col("v"), F.col("score"), F.col("direction"))
    got = {r.i: r for r in df.select("i", vector.alias("x"), code.alias("code")).collect()}
    assert [got[i].code for i in range(11)] == [None, "DIRECTION_SIGN_MISMATCH", "DIRECTION_SIGN_MISMATCH", None, "SENTIMENT_ALIGNMENT_MISMATCH", None, "NO_REASONS", "NO_REASONS", "NO_REASONS", "NO_SCORE", None]
    assert got[0].x == [1.0, 0.25, 0.0, -0.5, 0.5, 0.5, 0.8, 0.7, 0.0, 0.0, 0.67, 0.0, 0.5, 1.0, -0.5]
    assert got[3].x[13:] == [0.0, -0.4]
    assert got[5].x == pytest.approx([0.6, 0.4, 0.5, 0.0, 0.9, 0.5, 0.8, -1.0, 0.0, -2.0, 0.67, 0.0, 0.5, -1.0, 0.0])
    assert all((r.x is None) == (r.code is not None) for r in got.values())


def test_recorded_messages_over_restarts(spark, tmp_path):
    """Each drain starts the query again from its checkpoint: no message is lost or comes twice."""
    spark.dataSource.register(RecordedMessages)
    folder, base = tmp_path / "in", shared_dir(spark, "recorded")
    folder.mkdir()
    want = []
    for round_, files in enumerate((["a", "b"], ["c"], [], ["d", "e"])):
        for name in files:
            lines = [f"{name}{i}" for i in range(3)] + (["", "é"] if name == "c" else [])
            (folder / f"{name}.txt").write_text("\n".join(lines) + ("\n" if name != "d" else ""))
            want += [(name, i, x) for i, x in enumerate(lines)]
        stream = spark.readStream.format("recorded_messages").option("path", folder.as_uri()).load()
        got = sorted(tuple(r) for r in drain(stream, base).collect())
        assert got == sorted(want), round_
