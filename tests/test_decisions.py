"""Golden grids, cooldowns and scalers by hand and by brute force."""

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import grid
from tidemark.operators import models
from tidemark.streaming import states


def test_grid_commitment(spark):
    x = spark.createDataFrame([(90.0, 110.0, 20, 100.0, "long"), (99.0, 101.0, 2, 100.5, "neutral"), (99.0, 101.0, 2, 100.5, "short"), (99.0, 98.0, 2, 98.5, "long"), (None, 98.0, 2, 98.5, "long")], "l double, u double, n int, p double, d string")
    got = [r.g for r in x.select(grid.commitment(*map(F.col, "lunpd")).alias("g")).collect()]
    assert (got[0].exact, got[0].buys, got[0].sells, got[0].committed) == (True, 10, 10, 1945.0)
    assert (got[1].idle, got[1].buys, got[1].sells, got[1].committed) == (2, 2, 0, 199.0)
    assert (got[2].idle, got[2].buys, got[2].sells, got[2].held) == (1, 1, 1, -1)
    assert got[3:] == [None, None]


def test_hysteresis_and_cooldown():
    row = lambda ts, side, score, **o: SimpleNamespace(**{"ts": ts, "direction": side, "bias": side, "regime": "trend", "score": score, "strength": abs(score), "trendiness": 0.5, "coherence": 0.6} | o)
    state, made = None, []
    for x in [row(100, "long", 0.10), row(200, "long", 0.20), row(300, "short", -0.15), row(400, "short", -0.20), row(9000, "short", -0.10)]:
        state, out = states.hold_direction(state, x, 900)
        made.append(out)
    assert made == [("neutral", "enter_deadband"), ("long", "pass_through"), ("long", "hysteresis_hold"), ("short", "pass_through"), ("neutral", "enter_deadband")]
    state, made = None, []
    for ts, severity in [(100, "lockdown"), (500, "normal"), (1000, "guarded"), (1100, "guarded"), (1500, "normal"), (1700, "normal")]:
        state, out = states.hold_severity(state, SimpleNamespace(ts=ts, severity=severity), 900)
        made.append(out)
    assert made == [("lockdown", False), ("lockdown", True), ("lockdown", True), ("guarded", False), ("guarded", True), ("normal", False)]


def test_platt_by_loop():
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-1.5 * x))).astype(float)
    a, b = 1.0, 0.0
    for _ in range(300):
        errors = [1 / (1 + math.exp(-(a * u + b))) - v for u, v in zip(x, y, strict=True)]
        a, b = a - 0.06 * sum(e * u for e, u in zip(errors, x, strict=True)) / 200, b - 0.06 * sum(errors) / 200
    assert np.allclose(models.fit_platt(x, y), (a, b, True))
    assert models.fit_platt(x[:40], y[:40]) == (1.0, 0.0, False)


def test_softmax_learns():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    y = np.argmax(x @ np.array([[2.0, 0], [0, 2.0], [-2.0, -2.0]]).T, 1)
    w, b = models.fit_softmax(x, y, 3)
    assert (np.argmax(x @ w.T + b, 1) == y).mean() > 0.9
