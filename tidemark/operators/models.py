"""Small models: native scoring and grouped fits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from ..sources.shared import saved


def linear_probability(features: list[Column], weights: list[float], bias: float) -> Column:
    """Logistic score of fixed weights, all in the JVM."""
    total = F.lit(bias)
    for x, w in zip(features, weights, strict=True):
        total = total + x * w
    return sigmoid(total)


def weighted_steps(n_features: int, iterations: int = 450, rate: float = 0.12, l2: float = 0.08):
    """Class-balanced logistic regression by decaying gradient steps on standardised columns, as a generator: returns (weights, bias) for raw columns.

    Generators of steps yield functions of rows (x, y, weights, counts) whose
    values add up over parts of the rows, and are sent the sums over all rows.
    With one class alone there is a bias only.
    """
    sums = yield lambda x, y, w, c: np.concatenate([[c.sum(), c @ y, w @ c], (w * c) @ x])
    (n, wins, total), mean = sums[:3], sums[3:] / sums[2]
    if wins in (0, n):
        share = min(0.98, max(0.02, wins / max(1, n)))
        return np.zeros(n_features), float(np.log(share / (1 - share)))
    std = np.maximum(1e-6, np.sqrt((yield lambda x, y, w, c: (w * c) @ (x - mean) ** 2) / total))
    lost, won = n / (2 * (n - wins)), n / (2 * wins)
    total, good = yield lambda x, y, w, c: np.array([(w * c) @ np.where(y == 1, won, lost), (w * c) @ (y * won)])
    share = min(0.98, max(0.02, good / total))
    w, b = np.zeros(n_features), float(np.log(share / (1 - share)))
    for step in range(iterations):
        raw, bias = w / std, b - (w / std) @ mean

        def slopes(x, y, own, c, raw=raw, bias=bias):
            e = (1 / (1 + np.exp(-np.clip(x @ raw + bias, -60, 60))) - y) * own * c * np.where(y == 1, won, lost)
            return np.append(e @ x, e.sum())

        g = (yield slopes) / total
        now = rate / np.sqrt(1 + step / 75)
        w, b = w - now * ((g[:-1] - mean * g[-1]) / std + l2 * w), b - now * g[-1]
    return w / std, float(b - (w / std) @ mean)


def platt_steps(score, iterations: int = 300, rate: float = 0.06, least: int = 80):
    """Platt's (a, b, fitted) over ``score``, a function of x, as a generator like :func:`weighted_steps`. Not fitted where twice the rarer label is under ``least`` or the share of wins is not in 0.15 to 0.85."""
    n, wins, total = yield lambda x, y, w, c: np.array([c.sum(), c @ y, w @ c])
    if not n or 2 * min(wins, n - wins) < least or not 0.15 <= wins / n <= 0.85:
        return 1.0, 0.0, False
    a, b = 1.0, 0.0
    for _ in range(iterations):

        def slopes(x, y, w, c, a=a, b=b):
            s = score(x)
            error = (1 / (1 + np.exp(-np.clip(a * s + b, -500, 500))) - y) * w * c
            return np.array([error @ s, error.sum()])

        g = (yield slopes) / total
        a, b = a - rate * g[0], b - rate * g[1]
    return float(a), float(b), True


def softmax_steps(n_features: int, classes: int, iterations: int = 600, rate: float = 0.08, l2: float = 0.002):
    """Softmax regression by decaying gradient steps, as a generator like :func:`weighted_steps`: (weights by class, bias by class)."""
    w, b = np.zeros((classes, n_features)), np.zeros(classes)
    for step in range(iterations):

        def slopes(x, y, own, c, w=w, b=b):
            z = x @ w.T + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y.astype(int)] -= 1
            error = p * (own * c)[:, None]
            return np.concatenate([(error.T @ x).ravel(), error.sum(0), [own @ c]])

        g = yield slopes
        g = g[:-1] / g[-1]
        now = rate / np.sqrt(1 + step / 100)
        w, b = w - now * (g[: w.size].reshape(w.shape) + l2 * w), b - now * g[w.size :]
    return w, b


def run_steps(steps, x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, counts: np.ndarray | None = None):
    """What a generator of steps returns on rows that are all here."""
    w, c = (np.ones(len(y)) if v is None else v for v in (weights, counts))
    try:
        f = next(steps)
        while True:
            f = steps.send(f(x, y, w, c))
    except StopIteration as end:
        return end.value


def fit_weighted(x: np.ndarray, y: np.ndarray, iterations: int = 450, rate: float = 0.12, l2: float = 0.08, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """:func:`weighted_steps` on arrays. Rows weigh ``weights`` (1 by default)."""
    return run_steps(weighted_steps(x.shape[1], iterations, rate, l2), x, y, weights)


def fit_platt(x: np.ndarray, y: np.ndarray, iterations: int = 300, rate: float = 0.06, least: int = 80, weights: np.ndarray | None = None) -> tuple[float, float, bool]:
    """:func:`platt_steps` on arrays."""
    return run_steps(platt_steps(lambda s: s, iterations, rate, least), x, y, weights)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, iterations: int = 600, rate: float = 0.08, l2: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """:func:`softmax_steps` on arrays."""
    return run_steps(softmax_steps(x.shape[1], classes, iterations, rate, l2), x, y)


def softmax(features: list[Column], weights: list[list[float]], bias: list[float]) -> list[Column]:
    """Class probabilities of fixed weights, all in the JVM."""
    logits = [sum((x * w for x, w in zip(features, ws, strict=True)), F.lit(b)) for ws, b in zip(weights, bias, strict=True)]
    parts = [F.exp(z - F.greatest(*logits)) for z in logits]
    return [part / sum(parts[1:], parts[0]) for part in parts]


def _arrays(part: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(part["x"].tolist(), float), *[part[c].to_numpy(float) for c in ("y", "w", "c")]]


def fit_groups(rows: DataFrame, keys: list[str], make, unit_rows: int = 200_000) -> DataFrame:
    """What steps come to on all rows of each group: keys, n, theta.

    ``rows`` has keys, x (numbers), y and w; ``make`` gives a generator like
    :func:`weighted_steps`, which returns a list of numbers. Equal rows count
    together. A group of at most ``unit_rows`` distinct rows is learnt in one
    task; larger ones lie in blocks of about so many, each step is one Spark job
    over the blocks of all of them, and only its sums pass through the driver.
    """
    spark = rows.sparkSession
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    same = lambda a, b: reduce(lambda p, q: p & q, [a[k].eqNullSafe(b[f"_{k}"]) for k in keys])
    x = saved(rows.groupBy(*keys, "x", "y", "w").agg(F.count("*").alias("c")), "fit-rows")
    sizes = x.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.ceil(F.count("*") / unit_rows).alias("_units"), F.sum("c").alias("n"))
    sizes = saved(sizes, "fit-sizes")
    x = x.join(sizes, same(x, sizes)).drop(*[f"_{k}" for k in keys])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        return part[[*keys, "n"]].head(1).assign(theta=[[float(v) for v in run_steps(make(), *_arrays(part))]])

    small = x.where("_units = 1").groupBy(*keys).applyInPandas(fit, f"{kinds}, n long, theta array<double>")
    if sizes.where("_units > 1").isEmpty():
        return small

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        return part[["g"]].head(1).assign(**{c: [a.tobytes()] for c, a in zip("xywc", _arrays(part), strict=True)})

    name = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    blocks = x.where("_units > 1").withColumn("g", name).withColumn("unit", F.pmod(F.xxhash64("x", "y", "w"), F.col("_units")))
    blocks = saved(blocks.groupBy("g", "unit").applyInPandas(pack, "g string, x binary, y binary, w binary, c binary"), "fit-blocks")
    models, asked, got = {g: make() for (g,) in blocks.select("g").distinct().collect()}, {}, {}

    def ask(g: str, sums: np.ndarray | None) -> None:
        try:
            asked[g] = models[g].send(sums)
        except StopIteration as end:
            got[g] = [float(v) for v in end.value]

    for g in models:
        ask(g, None)
    while asked:
        now = dict(asked)

        def add(parts):
            for part in parts:
                told = []
                for g, *raw in part[["g", "x", "y", "w", "c"]].itertuples(index=False):
                    if g in now:  # noqa: B023
                        u, y, w, c = (np.frombuffer(v, float) for v in raw)
                        told.append((g, now[g](u.reshape(len(y), -1), y, w, c).tolist()))  # noqa: B023
                yield pd.DataFrame(told, columns=["g", "sums"])

        sums: dict[str, np.ndarray] = {}
        for g, values in blocks.mapInPandas(add, "g string, sums array<double>").collect():
            sums[g] = sums.get(g, 0.0) + np.array(values)
        asked.clear()
        for g, value in sums.items():
            ask(g, value)
    learnt = spark.createDataFrame(list(got.items()), "_g string, theta array<double>")
    names = sizes.where("_units > 1").select(*[F.col(f"_{k}").alias(k) for k in keys], "n").withColumn("g", name)
    return small.unionByName(names.join(learnt, F.col("g") == F.col("_g")).select(*keys, "n", "theta"))


def _rows_of(df: DataFrame, key: str, features: list[str], label: str) -> DataFrame:
    number = lambda c: F.col(c).cast("double")
    return df.select(key, *features, label).dropna(subset=[*features, label]).select(key, F.array(*map(number, features)).alias("x"), number(label).alias("y"), F.lit(1.0).alias("w"))


def platt_by_group(df: DataFrame, key: str, score: str, label: str, unit_rows: int = 200_000) -> DataFrame:
    """A Platt scaler a group, learnt from all of its rows: key, n, a, b, fitted."""
    got = fit_groups(_rows_of(df, key, [score], label), [key], lambda: platt_steps(lambda x: x[:, 0]), unit_rows)
    return got.select(key, "n", F.col("theta")[0].alias("a"), F.col("theta")[1].alias("b"), (F.col("theta")[2] == 1).alias("fitted"))


def softmax_by_group(df: DataFrame, key: str, features: list[str], label: str, classes: int, unit_rows: int = 200_000) -> DataFrame:
    """A softmax model a group, learnt from all of its rows: key, n, weights, bias."""
    got = fit_groups(_rows_of(df, key, features, label), [key], lambda: flat_steps(softmax_steps(len(features), classes)), unit_rows)
    weights = F.array(*[F.slice("theta", 1 + i * len(features), len(features)) for i in range(classes)])
    return got.select(key, "n", weights.alias("weights"), F.slice("theta", 1 + classes * len(features), classes).alias("bias"))


def flat_steps(steps):
    """Steps whose result is one list of numbers: weights, then bias."""
    w, b = yield from steps
    return [*np.ravel(w), *np.ravel(b)]


def fit_by_group(df: DataFrame, key: str, features: list[str], label: str, unit_rows: int = 200_000) -> DataFrame:
    """A model a group, learnt from all of its rows: key, n, weights, bias."""
    got = fit_groups(_rows_of(df, key, features, label), [key], lambda: flat_steps(weighted_steps(len(features))), unit_rows)
    return got.select(key, "n", F.slice("theta", 1, len(features)).alias("weights"), F.element_at("theta", -1).alias("bias"))
