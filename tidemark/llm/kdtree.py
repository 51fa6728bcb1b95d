"""kd-trees over integer vectors, searched best node first, many queries at a time."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components stay below this, so that inner products and squared distances are whole numbers of 64 bits.
LIMIT = 1 << 24


class Tree(NamedTuple):
    """Nodes by number, the root 0: points ``order[start:end]``, their bounding box and children (-1: a leaf)."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray


def build(points: np.ndarray, leaf: int) -> Tree:
    """Median splits of the widest side, down to ``leaf`` points; boxes are tight.

    Points that are equal in the split's component may go either way: the earlier
    ones left. Copies of one point are split by their places.
    """
    order = np.arange(len(points))
    nodes, todo = [[0, len(points), -1, -1]], [0]
    lo, hi = [points.min(0)], [points.max(0)]
    while todo:
        at = todo.pop()
        start, end = nodes[at][:2]
        if end - start <= leaf:
            continue
        part = order[start:end]
        side = int(np.argmax(hi[at] - lo[at])) if points.shape[1] else None
        if side is not None and hi[at][side] > lo[at][side]:
            order[start:end] = part[np.argsort(points[part, side], kind="stable")]
        middle = (start + end) // 2
        for child, (a, b) in enumerate(((start, middle), (middle, end)), 2):
            nodes[at][child] = len(nodes)
            todo.append(len(nodes))
            nodes.append([a, b, -1, -1])
            lo.append(points[order[a:b]].min(0))
            hi.append(points[order[a:b]].max(0))
    start, end, left, right = np.array(nodes).T
    return Tree(order, start, end, np.array(lo), np.array(hi), left, right)


def best_first(tree: Tree, bound: Callable, worst: np.ndarray, visit: Callable, skip: Callable | None = None) -> None:
    """Let every query open the nodes of ``tree`` by falling bound, as long as a bound is not below its ``worst``.

    ``bound(node, who)`` gives the most that queries ``who`` (numbers) may find
    in a node; ``visit(node, who)`` looks at a leaf's points and raises
    ``worst[who]``. Nodes whose bound equals the worst are opened, unless
    ``skip(node, who)`` rules them out. Queries that open the same node next do
    it together.
    """
    who = np.arange(len(worst))
    ahead = np.full((len(who), len(tree.start)), -np.inf)
    ahead[:, 0] = bound(0, who)
    while len(who):
        pick = ahead.argmax(1)
        best = ahead[np.arange(len(who)), pick]
        alive = (best >= worst[who]) & (best > -np.inf)
        if not alive.all():
            who, ahead, pick = who[alive], ahead[alive], pick[alive]
        by_node = np.argsort(pick, kind="stable")
        for here in np.split(by_node, np.flatnonzero(np.diff(pick[by_node])) + 1):
            if not len(here):
                continue
            node, now = int(pick[here[0]]), ahead[here, pick[here[0]]]
            ahead[here, node] = -np.inf
            if skip is not None:
                here = here[~((now == worst[who[here]]) & skip(node, who[here]))]
                if not len(here):
                    continue
            if tree.left[node] < 0:
                visit(node, who[here])
            else:
                for child in (tree.left[node], tree.right[node]):
                    ahead[here, child] = bound(child, who[here])


def scaled(vector: Column | str, scale: int) -> Column:
    """floor(scale * x) of every component x taken as double, as ints; null for vectors that are null or hold null, NaN or infinite components.

    A scaled component of 2**24 or more stops the job: results would not be exact.
    """
    x = F.col(vector) if isinstance(vector, str) else vector
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    floors = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < float(LIMIT), F.floor(c.cast("double") * scale)).otherwise(F.raise_error(F.lit("a vector's component is too large to scale"))).cast("int"))
    return F.when(x.isNotNull() & whole, floors)


def matrix(column, width: int | None = None) -> np.ndarray:
    """A list column of Arrow as rows of 64-bit whole numbers."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(flat), width if width is not None else (len(values) // len(flat) if len(flat) else 0))
