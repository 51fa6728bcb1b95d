"""Gates of calibrators and event models, shock states, validity before limits: by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import eligibility as EL
from tidemark.functions import features as X
from tidemark.operators import calibrator, outcomes, relational, shock

DAY = 86400


def gate_rows(n=1500, signal=1.0, ret=0.02, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t, x = 1000 + i // 5 * DAY, rnd.gauss(0, 1)
        y = int(rnd.random() < (0.9 if signal * x > 0 else 0.1) if signal else rnd.random() < 0.5)
        rows.append(("k", t, t + DAY // 2, x, rnd.gauss(0, 1), y, 1.0, ret + 0.01 * (1 if y else -1), 0.7, 1.0))
    return rows


def gates(spark, rows):
    df = spark.createDataFrame(rows, "k string, ts long, av long, x double, score double, y int, w double, ret double, raw double, adj double")
    return calibrator.calibrator_gates(df, "k", "ts", "av", ["x"], "score", "y", "w", "ret", "raw", "adj", least=80).first()


def test_calibrator_gates_in_order(spark):
    good = gates(spark, gate_rows())
    assert (good.expectancy, good.skill, good.selected) == ("positive", "accepted", "positive") and good.gate in (None, "terminal_policy") and good.fitted == (good.gate is None)
    assert gates(spark, gate_rows(ret=-0.02)).gate == "expectancy"
    noise = gates(spark, gate_rows(signal=0))
    assert (noise.expectancy, noise.gate, noise.fitted) == ("positive", "skill", False)
    assert gates(spark, gate_rows(n=250)).gate == "rows"


def test_censoring_by_hand(spark):
    base = {"matured_total": 100, "labeled_total": 96, "censored_total": 4, "unresolved_total": 0, "invalid_labeled_total": 0, "expectancy": "positive", "samples": 96, "mean": 0.02, "std": 0.01, "n_eff": 96.0, "shortfall": -0.03, "lower": 0.01, "temporal_lower": 0.01}
    cases = [base, base | {"censored_total": 6, "matured_total": 102}, base | {"unresolved_total": 1}, base | {"mean": 0.001, "std": 0.2}, base | {"temporal_lower": -0.1}, base | {"samples": 101, "labeled_total": 101, "censored_total": 0}, base | {"expectancy": "uncertain"}]
    rows = [{"i": i, **c} for i, c in enumerate(cases)]
    got = {r.i: r for r in calibrator.censoring(spark.createDataFrame(rows)).collect()}
    assert [got[i].sensitivity for i in range(7)] == ["passed", "failed", "hard_block", "failed", "failed", "hard_block", "not_evaluated"]
    assert got[0].assumed_return == pytest.approx(-0.03) and got[0].adjusted_mean == pytest.approx((0.02 * 96 - 0.03 * 4) / 100) and got[3].assumed_return == pytest.approx(0.001 - 0.6)
    assert [got[i].gated_expectancy for i in (0, 1, 2, 6)] == ["positive", "censored", "censored", "uncertain"]


def test_event_models(spark):
    rnd = random.Random(5)
    names = ["TP", "SL", "END"]
    rows = []
    for k, n, noisy in (("learns", 600, 0.05), ("noise", 600, 1.0), ("few", 20, 0.05)):
        for i in range(n):
            t, y = 1000 + i // 3 * DAY, rnd.randrange(3)
            at = y if rnd.random() > noisy else rnd.randrange(3)
            rows.append((k, t, t + DAY // 2 + (i % 7 == 0) * 3 * DAY, names[y], 1.0 * (at == 0), 1.0 * (at == 1), 0.01 * y))
    rows.append(("learns", 5000, 5001, "TP", 1.0, 0.0, 0.0))  # a label before its horizon ended
    df = spark.createDataFrame(rows, "k string, ts long, av long, event string, a double, b double, ret double")
    got = {r.k: r for r in calibrator.event_models(df, "k", "ts", "av", DAY // 2, ["a", "b"], "event", names, "ret", "END").collect()}
    assert {k: r.status for k, r in got.items()} == {"learns": "accepted", "noise": "rejected", "few": "insufficient"}
    r = got["learns"]
    assert (r.n_samples, r.holdout_samples) == (600, 120) and r.fit_samples < 480 and r.loss < r.null_loss - 0.3 and r.horizon_mean == pytest.approx(0.02) and len(r.coef) == 3
    assert got["noise"].coef is None and got["noise"].loss >= got["noise"].null_loss - 0.005
    cut = sorted({t for k, t, *_ in rows if k == "learns"})[-40]
    assert r.fit_samples == sum(k == "learns" and t < cut and a < cut and a - t >= DAY // 2 for k, t, a, *_ in rows)


def test_shock_states(spark):
    calm = [("t", f"s{i}", 0.0, 0.0, 0.0, 0) for i in range(4)]
    cases = {
        "normal": calm,
        "chaos": [("", f"s{i}", 0.02 * (-1) ** i, 0.001 * (-1) ** (i + 1), 1.5, 0) for i in range(8)],
        "red_down": [("", n, -0.021, -0.03, 1.2, -1) for n in ("BTC", "ETH", "x", "y")],
        "red_up": [("", n, 0.021, 0.03, 1.2, 0) for n in ("btc", "eth", "x", "y")],
        "amber_down": [("", "btc", -0.010, -0.02, 0.0, -1), ("", "x", -0.009, -0.02, 0.0, -1), ("", "y", -0.009, -0.013, None, -1)],
    }
    rows = [(k, *r[1:]) for k, rs in cases.items() for r in rs]
    got = {r.t: r for r in shock.market_shock(spark.createDataFrame(rows, "t string, symbol string, r5 double, r15 double, volume_z double, panic_vote int"), ["t"]).collect()}
    assert {k: r.state for k, r in got.items()} == {k: k for k in cases}
    assert (got["chaos"].severity, got["chaos"].bias, got["chaos"].blocks_neutral) == ("lockdown", "two_sided", True)
    assert (got["amber_down"].down_weight, got["amber_down"].severity, got["amber_down"].blocks_neutral) == (4, "guarded", True)


def test_validity_comes_before_limits(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, None), ("a", 4, -1.0), ("b", 9, None), ("b", 8, None)], "k string, ts long, x double")
    assert sorted((r.k, r.ts, r.rn) for r in relational.newest_valid(df, ["k"], "ts", F.col("x") > 0, 1).collect()) == [("a", 2, 1)]
    got = relational.latest_or_fallback(df, ["k"], "ts", F.col("x") > 0, ["x"], {"x": F.lit(0.0)}).collect()
    assert sorted((r.k, r.ts, r.is_valid, r.x) for r in got) == [("a", 2, True, 2.0), ("b", 9, False, 0.0)]


def test_ledger_counts(spark):
    rows = spark.createDataFrame([(1, 100, 50, True, True), (2, 100, 50, None, True), (3, 100, 50, True, False), (4, 100, None, True, True), (5, 100, 9999, True, True), (6, 100, 50, False, True)], "k long, ts long, horizon long, root boolean, eligible boolean")
    done = spark.createDataFrame([(1, 150), (4, 90)], "k long, available long")
    seen = spark.createDataFrame([(2, "censored"), (3, "waiting")], "k long, state string")
    ledger = outcomes.label_ledger(rows, done, seen, "k", F.lit(1000))
    got = {r.k: (r.label_due_ts, r.state, r.reason) for r in ledger.collect()}
    assert got == {1: (150, "labeled", "existing_outcome_materialized"), 2: (270, "censored", "kept"), 3: (270, "unresolved", "kept"), 4: (None, "labeled", "existing_outcome_materialized"), 5: (10219, "waiting", "scheduled_for_label_horizon")}
    counts = outcomes.ledger_counts(ledger.withColumn("all", F.lit(1)), "all", F.col("label_due_ts").isNotNull()).first()
    assert tuple(counts)[1:] == (4, 2, 1, 1, 1)


def test_scopes_and_contracts(spark):
    import hashlib
    import json

    contract = {"b": {"z": 1, "a": 0.5}, "a": "x"}
    sha = hashlib.sha256(json.dumps(contract, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    texts = [json.dumps({"outcome_policy": {"policy_contract": c, "policy_fingerprint": f}}) for c, f in ((contract, sha.upper()), (contract, "0" * 64), ({"a": 1}, sha), ([1], sha))] + ["{}", None]
    df = spark.createDataFrame([(i, t, "v1+x" if i else "v2") for i, t in enumerate(texts)] + [(9, texts[0], "v1")], "i int, j string, version string").withColumn("v", X.variant(F.col("j")))
    got = {r.i: (r.a, r.m, r.p) for r in df.select("i", *[EL.in_scope(F.col("v"), F.col("version"), s, "v1", sha).alias(n) for s, n in (("archive", "a"), ("current_model", "m"), ("current_policy", "p"))]).collect()}
    assert got == {0: (True, False, False), **{i: (True, True, False) for i in range(1, 6)}, 9: (True, True, True)}


def test_warm_up_and_alerts_by_hand(spark):
    from types import SimpleNamespace as Row

    from tidemark.streaming import states

    state, made = None, []
    for ts, ready, sig in [(0, False, "a"), (10, False, "b"), (70, False, "c"), (80, False, "c"), (90, True, "c"), (95, True, "c"), (96, False, "c")]:
        state, (event,) = states.warm_up(state, Row(ts=ts, ready=ready, signature=sig), 60)
        made.append(event)
    assert made == ["RECO_WARMUP_SKIP", None, "RECO_WARMUP_SKIP", None, "RECO_WARMUP_RECOVERED", None, "RECO_WARMUP_SKIP"]
    health = spark.createDataFrame([(1, 5, 2, 4, 1, 0), (2, 4, 1, 4, 0, 0), (3, 9, 0, 0, 0, 5)], "i int, errors int, bad int, total int, healthy int, recommendations int")
    assert sorted((r.i, r.alert) for r in states.due_alerts(health).collect()) == [(1, "collect_errors"), (1, "no_recos"), (1, "symbols_stale"), (3, "collect_errors")]


def test_repair_jobs_by_hand(spark):
    from tidemark.operators import queues

    jobs = spark.createDataFrame(
        [("a", "s", 50, 10, 90, 0), ("b", "s", 51, 10, 90, 1), ("c", "s", None, 10, 90, 9), ("d", "s", 50, 90, 10, 0), ("e", "t", None, 10, 90, 4)], "repair_id string, symbol string, expected_ts long, range_start_ts long, range_end_ts long, attempt_count int"
    )
    found = spark.createDataFrame([("s", 50), ("s", 50), ("t", 95)], "symbol string, ts long")
    got = {r.repair_id: (r.state, r.next_attempt_ts, r.attempt_count) for r in queues.attempted(jobs, found, 1000).collect()}
    assert got == {"a": ("resolved", 1000, 1), "b": ("pending", 1120, 2), "c": ("resolved", 1000, 10), "d": ("pending", 2800, 1), "e": ("pending", 2800, 5)}
    assert queues.attempted(jobs.limit(0), found, 1000).collect() == []
