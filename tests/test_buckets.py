"""Folds over buckets against plain loops over whole keys, on random rows and on hot keys of many buckets."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.operators import intervals, joins, stats

DAY = 86400


def random_times(seed, n=600, keys=("a", "b", None), most=40 * DAY):
    rnd = random.Random(seed)
    rows = [(rnd.choice(keys[:1] * 3 + keys), rnd.randrange(most // 100) * 100) for _ in range(n)]
    return rows + [("one", 5), (keys[0], 0), (keys[0], 0)]


def by_key(rows):
    out = defaultdict(list)
    for k, *rest in rows:
        out[k].append(tuple(rest))
    return out


def test_apart_by_has_no_bound(spark):
    rows = random_times(1)
    want = []
    for k, times in by_key(rows).items():
        last = None
        for (t,) in sorted(set(times)):
            if last is None or t - last >= 5000:
                want.append((k, t))
                last = t
    df = spark.createDataFrame(rows, "k string, ts long")
    for bucket in (3 * DAY, None):
        assert Counter(tuple(r) for r in stats.apart_by(df, "k", "ts", 5000, bucket).collect()) == Counter(want)


def test_most_apart_and_clusters(spark):
    rnd = random.Random(2)
    rows = [(k, t, t + rnd.randint(1, 30) * 500) for k, t in random_times(2, most=20 * DAY)]
    apart, merged = {}, []
    for k, spans in by_key(rows).items():
        last, n = -math.inf, 0
        for s, e in sorted(spans, key=lambda x: x[1]):
            if s >= last:
                last, n = e, n + 1
        apart[k] = n
        here = None
        for s, e in sorted(spans):
            if here and s < here[1]:
                here = (here[0], max(here[1], e), here[2] + 1)
            else:
                merged += [(k, *here)] if here else []
                here = (s, e, 1)
        merged.append((k, *here))
    df = spark.createDataFrame(rows, "k string, s long, e long")
    for bucket in (2 * DAY, 365 * DAY):
        assert {r.k: r.apart for r in stats.most_apart(df, "k", "s", "e", bucket).collect()} == apart
        assert Counter(tuple(r) for r in stats.clusters(df, "k", "s", "e", bucket).collect()) == Counter(merged)


def test_sessions(spark):
    rows, want = random_times(3), []
    for k, times in by_key(rows).items():
        here = None
        for (t,) in sorted(times):
            if here and t - here[1] <= 3000:
                here = (here[0], t, here[2] + 1)
            else:
                want += [(k, *here)] if here else []
                here = (t, t, 1)
        want.append((k, *here))
    df = spark.createDataFrame(rows, "k string, ts long")
    for bucket in (5000, 400 * DAY):
        assert Counter(tuple(r) for r in joins.sessions(df, "k", 3000, bucket=bucket).collect()) == Counter(want)


def test_drawdown(spark):
    rnd = random.Random(4)
    rows = [(k, t, i, float(rnd.randint(-9, 9))) for i, (k, t) in enumerate(random_times(4))]
    want = {}
    for k, moves in by_key(rows).items():
        total = peak = worst = 0.0
        for _, _, x in sorted(moves):
            total += x
            peak = max(peak, total)
            worst = max(worst, peak - total)
        want[k] = (total, peak, worst)
    df = spark.createDataFrame(rows, "k string, ts long, i long, x double")
    for width in (2 * DAY, 999 * DAY):
        got = stats.drawdown(df, "k", ["ts", "i"], "x", F.floor(F.col("ts") / width))
        assert {r.k: (r.total, r.peak, r.max_drawdown) for r in got.collect()} == want


def test_weighted_returns_tail(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice("aab"), rnd.choice([-0.01, 0.02, rnd.uniform(-0.1, 0.1)]), float(rnd.randint(0, 5))) for _ in range(500)] + [("c", 0.5, 2.0)]
    df = spark.createDataFrame(rows, "k string, r double, w double")
    got = {r.k: r.shortfall for r in stats.weighted_returns(df, "k", "r", "w").collect()}
    for k, moves in by_key(rows).items():
        moves = sorted((r, w) for r, w in moves if w > 0)
        left = fifth = 0.2 * sum(w for _, w in moves)
        total = 0.0
        for r, w in moves:
            total, left = total + r * min(w, left), max(0.0, left - w)
        assert math.isclose(got[k], total / fifth, abs_tol=1e-12)


def test_purged(spark):
    rnd = random.Random(6)
    rows = [(k, t, None if rnd.random() < 0.1 else t + rnd.choice([-50, 0, 3000, 90000])) for k, t in random_times(6)]
    df = spark.createDataFrame(rows, "k string, ts long, av long")
    want = {}
    for k, times in by_key(rows).items():
        for v in {t for t, _ in times}:
            known = [a for t, a in times if a is not None and t <= a < v]
            want[k, v] = (len(known), max(known, default=None))
    for bucket in (8000, 400 * DAY):
        got = stats.purged(df, df.select("k", F.col("ts").alias("v_ts")), "k", "ts", "av", bucket)
        assert {(r.k, r.v_ts): (r.n_train, r.last_label) for r in got.collect()} == want


def plain_blocks(times, least):
    counts = sorted(Counter(times).items())
    starts = [sum(n for _, n in counts[:i]) for i in range(len(counts))]
    total, need = len(times), min(5, max(2, least))
    if total < max(6, 2 * least) or len(counts) <= need:
        return []
    last = min(len(counts) - need, max(i for i, s in enumerate(starts) if s <= total - least))
    if starts[last] < least or total - starts[last] < least:
        return []
    width = max(least, total // (min(5, max(2, total // least)) + 1))
    found = []
    while True:
        since = starts[found[-1]] if found else 0
        at = next((i for i, s in enumerate(starts) if s >= since + width and i >= 1), len(starts))
        if at >= last:
            break
        found.append(at)
    found.append(last)
    return [(i, counts[a][0], counts[b - 1][0], sum(n for _, n in counts[a:b]), b - a) for i, (a, b) in enumerate(zip(found, [*found[1:], len(counts)], strict=True))]


def test_validation_blocks(spark):
    rnd = random.Random(7)
    rows = [(k, rnd.randrange(size)) for k, n, size in (("a", 300, 90), ("b", 40, 9), ("c", 5, 5), ("d", 200, 3), ("e", 64, 64), (None, 90, 30)) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, ts long")
    for least in (1, 3):
        want = Counter((k, *b) for k, times in by_key(rows).items() for b in plain_blocks([t for (t,) in times], least))
        for bucket in (10 if least == 3 else 10_000,):
            assert Counter(tuple(r) for r in intervals.validation_blocks(df, "k", "ts", least, bucket).collect()) == want
