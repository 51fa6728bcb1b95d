"""Exact top-k search and vector codes against brute force: the registered queries, odd rows, ties, copies, several shards."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes, kdtree, queries, topk

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top_k(rows, k, scale, every):
    """rows: (id, vector), each a row of its own; null ids last."""
    rows = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if usable(v)]
    made = Counter()
    for n, (q, v) in enumerate(rows):
        if q is None or q % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v))
        made.update((q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(scores[:k], 1))
    return made


def brute_codes(rows, parts, entries, rounds, scale):
    rows = [(i, lab, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, lab in rows if usable(v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    long = next((len(v) for _, _, v in rows if v and len(v) % parts == 0), None)
    fits = [v for _, _, v in rows if len(v) == long]
    cut = lambda v: [v[p * (long // parts) : (p + 1) * (long // parts)] for p in range(parts)]
    books = [[list(cut(v)[p]) for v in fits[:entries]] for p in range(parts)]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = [near(cut(v)[p], book)[1] for v in fits]
            book[:] = [[sum(c) // len(c) for c in zip(*ys, strict=True)] if (ys := [cut(v)[p] for v, m in zip(fits, mine, strict=True) if m == k]) else e for k, e in enumerate(book)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest() if fits else None
    out = [(i, lab, *((lambda f: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)))([near(y, b) for y, b in zip(cut(v), books, strict=True)]) if len(v) == long else (None, None))) for i, lab, v in rows]
    total = {}
    for _, lab, _, e in out:
        if e is not None:
            total[lab] = total.get(lab, 0) + e
    return Counter((i, code, e, total.get(lab), sha) for i, lab, code, e in out)


def odd_rows(n=400, dim=16, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.5, rnd.random()]) for _ in range(dim)], rnd.choice([0, 1, None])) for i in range(n)]
    rows += [(1000 + i, [0.25] * dim, 3) for i in range(n // 2)]  # copies of one vector
    rows += [(5, rows[5][1], 1), (10, rows[11][1], 1), (10, rows[11][1], 1), (None, rows[7][1], 2), (2000, None, 1), (2001, [None] + [0.5] * (dim - 1), 1), (2002, [float("nan")] * dim, 1), (2020, [float("inf")] * dim, None)]
    return rows + [(3000, [1.0, 2.0], 1), (3010, [1.0, -2.0], 1), (4000, [], 1), (4010, [], 1)]


def test_tree_boxes_are_tight():
    points = np.random.default_rng(2).integers(-9, 9, (500, 3))
    tree = kdtree.build(points, 20)
    leaves = np.flatnonzero(tree.left < 0)
    assert sorted(np.concatenate([tree.order[tree.start[i] : tree.end[i]] for i in leaves])) == list(range(500))
    for i in range(len(tree.start)):
        inside = points[tree.order[tree.start[i] : tree.end[i]]]
        assert (inside.min(0) == tree.lo[i]).all() and (inside.max(0) == tree.hi[i]).all()
    assert all(tree.end[i] - tree.start[i] <= 20 for i in leaves)


def test_search_skips_what_cannot_be_better():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(90, 100, (500, 4)), rng.integers(-100, -90, (500, 4))])
    tree = kdtree.build(points, 50)
    opened = []
    real = kdtree.best_first
    try:
        kdtree.best_first = lambda t, b, w, visit, skip=None: real(t, b, w, lambda n, who: (opened.append(n), visit(n, who)), skip)
        q = np.array([[1, 1, 1, 1]])
        topk.search(tree._replace(order=None), points[tree.order], tree.order, q, 5, np.full(1, -np.inf), np.full(1, topk.NO_ID))
    finally:
        kdtree.best_first = real
    assert len(opened) < (tree.left < 0).sum() / 2


@pytest.mark.parametrize("shard_rows, block", [(64, 7), (8192, 4096)])
def test_top_k(spark, shard_rows, block):
    rows = odd_rows()
    df = spark.createDataFrame([(i, v, lab) for i, v, lab in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=6, scale=4, shard_rows=shard_rows, block_queries=block, leaf=16)
    assert Counter(tuple(r) for r in got.collect()) == brute_top_k([(i, v) for i, v, _ in rows], 6, 4, 10)


def test_codes(spark):
    rows = odd_rows()
    rows.sort(key=lambda r: r[0] == 4000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = codes.compress(df, parts=4, entries=8, rounds=2, scale=8, leaf=2)
    assert Counter(tuple(r) for r in got.collect()) == brute_codes(rows, 4, 8, 2, 8)


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(20, [0.5, 1.0], 1, "a", 2, 3), (3, [1.0, 1.0], None, "b", 2, 3)], SCHEMA + ", code string, score int, row int")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, scale=2).collect()] == [(20, 1, 3, 6)]
    assert Counter(r.error for r in codes.compress(df, parts=2).collect()) == {0: 2}
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).collect() == [] == codes.compress(none).collect()


def test_too_large_components_stop_the_job(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        codes.compress(df, parts=2).collect()


def test_op11(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op11_topk(spark, SF).collect()) == brute_top_k(rows, 20, 64, 20)


def test_op12(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op12_codes(spark, SF).collect()) == brute_codes(rows, 16, 64, 2, 256)
