"""Exact top-k search by inner product: a kd-tree a shard, searched best node first."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kdtree
from ._common import saved

#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1
#: Stands for the k-th score of a query that has found fewer.
NO_SCORE = -(1 << 62)

_SHARD = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("block", pa.int32()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("worst", pa.int64()), ("body", pa.binary()), ("asked", pa.list_(pa.int64())), ("query", pa.list_(pa.int64())), ("vec", pa.list_(pa.int64())), ("score", pa.list_(pa.int64()))])
_SHARD_SQL = "shard int, dim int, block int, lo array<int>, hi array<int>, worst long, body binary, asked array<long>, query array<long>, vec array<long>, score array<long>"
_HIT = pa.schema([("asked", pa.int64()), ("query", pa.int64()), ("vec", pa.int64()), ("score", pa.int64())])
_HIT_SQL = "asked long, query long, vec long, score long"


def _exact_type(q: np.ndarray, points: np.ndarray):
    """The fastest type in which inner products and their bounds are whole."""
    most = q.shape[1] * int(abs(q).max(initial=0)) * int(abs(points).max(initial=0))
    if most >= 1 << 53:
        raise ValueError("vectors are too large for exact inner products")
    return np.float32 if most < 1 << 24 else np.float64


def search(tree: kdtree.Tree, points: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, worst: np.ndarray, worst_id: np.ndarray, own: np.ndarray | None = None):
    """The points that are among the ``k`` best of queries ``q`` and better than what they know: (query number, id, score).

    ``points`` and ``ids`` are in the tree's order; ``own`` is each query's own
    place in it. ``worst`` and ``worst_id`` are the k-th score and id known so
    far, and are raised on the way: what one shard finds prunes the next.
    """
    kind = _exact_type(q, points)
    points, q, lo, hi = points.astype(kind), q.astype(kind), tree.lo.astype(kind), tree.hi.astype(kind)
    above, below = np.maximum(q, 0), np.minimum(q, 0)
    least = np.array([ids[a:b].min() for a, b in zip(tree.start, tree.end, strict=True)])
    top, top_id = np.full((len(q), k), -np.inf), np.full((len(q), k), NO_ID)

    def visit(node: int, who: np.ndarray) -> None:
        a, b = tree.start[node], tree.end[node]
        found = (q[who] @ points[a:b].T).astype(np.float64)
        if own is not None:
            at = own[who] - a
            inside = np.flatnonzero((at >= 0) & (at < b - a))
            found[inside, at[inside]] = -np.inf
        if b - a > 2 * k:  # no more than the k best of the leaf, and what equals them
            found[found < np.partition(found, b - a - k, axis=1)[:, b - a - k, None]] = -np.inf
        bar = worst[who, None]
        better = (found > bar) | ((found == bar) & (ids[None, a:b] < worst_id[who, None]) & (found > -np.inf))
        some = np.flatnonzero(better.any(1))
        if not len(some):
            return
        r, c = np.nonzero(better[some])
        us = who[some]
        number = np.concatenate([np.repeat(np.arange(len(us)), k), r])
        score, label = np.concatenate([top[us].ravel(), found[some][r, c]]), np.concatenate([top_id[us].ravel(), ids[a:b][c]])
        order = np.lexsort((label, -score, number))
        first = np.searchsorted(number[order], np.arange(len(us)))
        best = order[(first[:, None] + np.arange(k))]
        top[us], top_id[us] = score[best], label[best]
        full = us[top[us, -1] > -np.inf]
        worst[full], worst_id[full] = top[full, -1], top_id[full, -1]

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        return above[who] @ hi[node] + below[who] @ lo[node]

    kdtree.best_first(tree, bound, worst, visit, skip=lambda node, who: least[node] > worst_id[who])
    r, c = np.nonzero(top > -np.inf)
    return r, top_id[r, c], top[r, c].astype(np.int64)


def _planes(points: np.ndarray, cells: int) -> list[list[int]]:
    """Median planes that cut a sample into about ``cells`` cells: [side, threshold, node below, node not below]; a negative node is a cell, -1 the first."""
    planes, made = [], 0

    def cut(part: np.ndarray, n: int) -> int:
        nonlocal made
        side = int(np.argmax(part.max(0) - part.min(0))) if len(part) and part.shape[1] else -1
        middle = int(np.median(part[:, side])) if side >= 0 else 0
        below = part[:, side] < middle if side >= 0 else np.zeros(0, bool)
        if n < 2 or not below.any():  # an unsplit cell is dealt by salts
            made += 1
            return -made
        planes.append([side, middle, 0, 0])
        at = len(planes) - 1
        planes[at][2] = cut(part[below], n // 2)
        planes[at][3] = cut(part[~below], n - n // 2)
        return at

    return planes if cut(points, cells) >= 0 else []


def _cell_of(planes: list[list[int]], points: np.ndarray) -> np.ndarray:
    cell = np.ones(len(points), np.int32)
    todo = [(0, np.arange(len(points)))] if planes else []
    while todo:
        at, who = todo.pop()
        side, middle, *children = planes[at]
        below = points[who, side] < middle
        for child, part in zip(children, (who[below], who[~below]), strict=True):
            if child < 0:
                cell[part] = -child
            else:
                todo.append((child, part))
    return cell


def _assigner(planes: dict[int, list[list[int]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch["dim"].to_numpy(), np.ones(len(batch), np.int32)
            for dim in np.unique(dims):
                if planes.get(int(dim)):
                    who = np.flatnonzero(dims == dim)
                    cell[who] = _cell_of(planes[int(dim)], kdtree.matrix(batch["v"].take(pa.array(who)), int(dim)))
            yield batch.append_column("cell", pa.array(cell))

    return run


def _small(x: np.ndarray) -> np.ndarray:
    most = int(abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32)


def _sharder(k: int, leaf: int, block_queries: int):
    """Build a shard's tree, and search it at once with the shard's own queries."""

    def run(key: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, dim = key[0].as_py(), table["dim"][0].as_py()
        ids, rows, asks, v = table["id"].to_numpy(), table["row"].to_numpy(), table["asks"].to_numpy(), kdtree.matrix(table["v"], dim)
        by_id = np.lexsort((rows, ids))
        tree = kdtree.build(v[by_id], leaf)
        o = by_id[tree.order]
        ids, rows, asks, v = ids[o], rows[o], asks[o], v[o]
        body = pickle.dumps((tree._replace(order=None), _small(v), ids), protocol=5)
        made = [(shard, dim, None, tree.lo[0], tree.hi[0], None, body, None, None, None, None)]
        asking = np.flatnonzero(asks)
        for block, i in enumerate(range(0, len(asking), block_queries)):
            own = asking[i : i + block_queries]
            q, worst, worst_id = v[own], np.full(len(own), -np.inf), np.full(len(own), NO_ID)
            r, vec, score = search(tree, v, ids, q, k, worst, worst_id, own)
            body = pickle.dumps((_small(q), worst, worst_id, rows[own], ids[own]), protocol=5)
            low = int(worst.min()) if np.isfinite(worst.min()) else NO_SCORE
            made.append((shard, dim, block, q.min(0), q.max(0), low, body, rows[own][r], ids[own][r], vec, score))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _SHARD, strict=True)], schema=_SHARD)

    return lambda key, table: pa.Table.from_batches(run(key, table))


def _searcher(k: int):
    """Search a shard with a block of another shard's queries."""

    def run(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(trees) or not len(blocks):
            return _HIT.empty_table()
        tree, points, ids = pickle.loads(trees["body"][0].as_py())
        q, worst, worst_id, rows, asking = pickle.loads(blocks["b_body"][0].as_py())
        r, vec, score = search(tree, points.astype(np.int64), ids, q.astype(np.int64), k, worst, worst_id)
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (rows[r], asking[r], vec, score)], schema=_HIT)

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard_rows: int = 8192, block_queries: int = 4096, leaf: int = 256, sample_rows: int = 16384) -> DataFrame:
    """The ``k`` rows of greatest inner product with each row for which ``asks`` holds: query_id, rank, vec_id, score.

    Components x count as floor(scale * x). A row is no candidate of its own;
    ties go to smaller ids, null ids last. All rows are indexed and all answers
    exact.

    Median planes of a sample of about ``sample_rows`` rows cut space into
    cells, and salts cut cells with too many rows (copies of one vector cannot be
    parted by planes) into shards of about ``shard_rows``: the sample shapes
    shards, never answers. Each shard builds a kd-tree and answers its own
    queries first; their k-th scores travel with them, in blocks of at most
    ``block_queries``, to the shards whose box may hold better. A unit of work is
    one block in one shard, so none grows with the data.

    Vectors that are null, or hold null, NaN or infinite components, take no
    part. Vectors meet only those of their own length; empty ones score 0. Rows
    that repeat, ids too, are rows of their own. Ids are whole numbers (the
    greatest long stands for null). Components must stay under 2**24 once scaled;
    otherwise the job stops. Other columns are not read; no rows give no rows.
    """
    spark = vectors.sparkSession
    known = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), kdtree.scaled(vector_col, scale).alias("v")).where("v is not null")
    known = known.withColumn("dim", F.size("v"))
    n = known.count()
    sample = known.select("v").where(F.rand(7) < min(1.0, sample_rows / max(n, 1))).limit(2 * sample_rows).collect() if n > shard_rows else []
    by_dim: dict[int, list] = {}
    for (v,) in sample:
        by_dim.setdefault(len(v), []).append(v)
    cells = max(1, min(-(-2 * n // shard_rows), sample_rows // 16))
    planes = {dim: _planes(np.array(vs, dtype=np.int64).reshape(len(vs), dim), max(1, cells * len(vs) // len(sample))) for dim, vs in by_dim.items()}
    numbered = known.withColumn("row", F.monotonically_increasing_id())
    celled = saved(numbered.mapInArrow(_assigner(planes), "id long, asks boolean, v array<int>, dim int, row long, cell int"), "cells")

    # A row a cell: at most sample_rows / 16 cells, and one for each other length of vectors.
    counts = celled.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int"))
    counts = saved(counts.withColumn("first", F.sum("parts").over(Window.orderBy("dim", "cell")) - F.col("parts")), "cell-counts")
    shards = counts.agg(F.coalesce(F.sum("parts"), F.lit(0)).cast("int")).first()[0]
    shard = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")
    placed = celled.join(counts.select("dim", "cell", "first", "parts"), ["dim", "cell"]).withColumn("shard", shard)
    built = saved(placed.select("shard", "dim", "row", "id", "asks", "v").groupBy("shard").applyInArrow(_sharder(k, leaf, block_queries), _SHARD_SQL), "kd-shards")

    blocks, trees = built.where("block is not null"), built.where("block is null")
    boxes = trees.select("shard", F.col("dim").alias("t_dim"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    targets = blocks.select("block", F.col("shard").alias("home"), "dim", "lo", "hi", "worst", F.explode(F.sequence(F.lit(0), F.lit(max(shards - 1, 0)))).alias("shard"))
    corners = lambda x: F.greatest(*[x[a].cast("long") * x[b] for a in ("lo", "hi") for b in ("t_lo", "t_hi")])
    most = F.aggregate(F.arrays_zip("lo", "hi", "t_lo", "t_hi"), F.lit(0).cast("long"), lambda s, x: s + corners(x))
    pairs = saved(targets.join(boxes, "shard").where((F.col("shard") != F.col("home")) & (F.col("dim") == F.col("t_dim")) & (most >= F.col("worst"))).select("shard", "home", "block"), "kd-pairs")
    unit_trees = pairs.join(trees.select("shard", "body"), "shard").groupBy("shard", "home", "block")
    there = pairs.toDF("b_shard", "b_home", "b_block").join(blocks.select(F.col("shard").alias("b_home"), F.col("block").alias("b_block"), F.col("body").alias("b_body")), ["b_home", "b_block"])
    unit_blocks = there.groupBy("b_shard", "b_home", "b_block")
    hits = unit_trees.cogroup(unit_blocks).applyInArrow(_searcher(k), _HIT_SQL)
    at_home = blocks.select(F.explode(F.arrays_zip("asked", "query", "vec", "score")).alias("hit")).select("hit.*")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec"))
    known_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return at_home.unionByName(hits).withColumn("rank", rank).where(F.col("rank") <= k).select(known_id("query").alias("query_id"), "rank", known_id("vec").alias("vec_id"), "score")
