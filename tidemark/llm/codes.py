"""Vector code compression: product codes whose codebooks are searched by broadcast kd-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kdtree
from ._common import saved


def nearest(tree: kdtree.Tree, entries: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each query and its squared distance; of equal distances the lower index."""
    worst, index = np.full(len(q), -np.inf), np.full(len(q), len(entries))

    def bound(node: int, who: np.ndarray) -> np.ndarray:
        x = q[who]
        out = np.maximum(np.maximum(tree.lo[node] - x, x - tree.hi[node]), 0)
        return -(out * out).sum(1)

    def visit(node: int, who: np.ndarray) -> None:
        at = np.sort(tree.order[tree.start[node] : tree.end[node]])
        far = q[who, None, :] - entries[None, at, :]
        far = -(far * far).sum(2)
        best = far.argmax(1)  # the first of equals: the lower index
        near, found = far[np.arange(len(who)), best], at[best]
        won = (near > worst[who]) | ((near == worst[who]) & (found < index[who]))
        worst[who[won]], index[who[won]] = near[won], found[won]

    kdtree.best_first(tree, bound, worst, visit)
    return index, (-worst).astype(np.int64)


def _assigned(books: np.ndarray, v: np.ndarray, trees: list[kdtree.Tree]):
    """(index, squared distance) of each part of each vector, a column a part."""
    parts, _, width = books.shape
    if width * (int(abs(v).max(initial=0)) + int(abs(books).max(initial=0))) ** 2 >= 1 << 53:
        raise ValueError("vectors are too large for exact distances")
    found = [nearest(trees[p], books[p].astype(np.float64), v[:, p * width : (p + 1) * width].astype(np.float64)) for p in range(parts)]
    return np.stack([x[0] for x in found], 1), np.stack([x[1] for x in found], 1)


def _summing(books: np.ndarray, leaf: int):
    """Counts and sums of the parts that a task assigns to each entry: a row an entry, as whole numbers."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("total", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [kdtree.build(b, leaf) for b in books]
        parts, size, width = books.shape
        n, total = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            v = kdtree.matrix(batch["v"], parts * width)
            index, _ = _assigned(books, v, trees)
            for p in range(parts):
                n[p] += np.bincount(index[:, p], minlength=size)
                np.add.at(total[p], index[:, p], v[:, p * width : (p + 1) * width])
        p, e, w = np.nonzero(np.broadcast_to(n[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((p, e, n[p, e], w, total[p, e, w]), schema, strict=True)], schema=schema)

    return run


def _coding(books: np.ndarray, leaf: int, id_type: pa.DataType, label_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("label", label_type), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [kdtree.build(b, leaf) for b in books]
        for batch in batches:
            index, far = _assigned(books, kdtree.matrix(batch["v"], books.shape[0] * books.shape[2]), trees)
            digits = 2 if books.shape[1] <= 256 else 4
            code = pa.array([x.tobytes().hex() for x in index.astype(">u1" if digits == 2 else ">u2")], pa.string())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], code, pa.array(far.sum(1))], schema=schema)

    return run


def train(vectors: DataFrame, parts: int, entries: int, rounds: int, leaf: int = 8) -> np.ndarray:
    """Codebooks (part, entry, component) of ``vectors``: id and v, arrays of ints all of one length.

    They start as the vectors of the least ids. Each round broadcasts the
    codebooks, from which each task builds a kd-tree a part; a task sums what it
    assigns and sends a row an entry and component, and the sums are added by
    Spark. The driver sees codebooks alone, of the size of ``entries`` vectors.
    """
    first = np.array([r[0] for r in vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()], dtype=np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).swapaxes(0, 1))
    for _ in range(rounds):
        summed = vectors.select("v").mapInArrow(_summing(books, leaf), "part int, entry int, n long, at int, total long")
        for p, e, w, n, total in summed.groupBy("part", "entry", "at").agg(F.sum("n"), F.sum("total")).collect():  # as many rows as the codebooks have numbers
            books[p, e, w] = total // n
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, leaf: int = 8) -> DataFrame:
    """Codes of the vectors: id_col, code, error, label_error, codebooks_sha256.

    Components x count as floor(scale * x). A vector is cut into ``parts``; each
    part has a codebook of ``entries``, trained in ``rounds`` by :func:`train`.
    ``code`` holds the index of the nearest entry of each part in hex, ties to the
    lower index; ``error`` is the sum of the squared distances, ``label_error``
    that of all vectors of the label, null labels together. ``codebooks_sha256``
    is that of all entries' components in decimal, joined by commas.

    Vectors that are null, or hold null, NaN or infinite components, are dropped.
    The vector of the least id that can be cut into ``parts`` sets the length; a
    vector of another length keeps its row, with null code and error. Null ids
    come after all others; of equal ids the lesser vector comes first. With
    fewer than ``entries`` vectors there are as many entries as vectors. No rows
    give no rows. Components must stay under 2**24 once scaled; otherwise the job
    stops.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    types = [vectors.schema[c].dataType for c in (id_col, label_col)]
    known = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), kdtree.scaled(vector_col, scale).alias("v")).where("v is not null")
    fits = known.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    least = fits.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    same = F.size("v") == (least[0] if least else -1)
    schema = f"id {types[0].simpleString()}, label {types[1].simpleString()}, code string, error long"
    others = known.where(~same).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    digest = F.lit(None).cast("string")
    coded = others
    if least:
        books = train(known.where(same).select("id", "v"), parts, entries, rounds, leaf)
        coded = known.where(same).mapInArrow(_coding(books, leaf, *map(to_arrow_type, types)), schema).unionByName(others)
        digest = F.lit(hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest())
    coded = saved(coded, "codes")
    by_label = saved(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(id_col), "code", "error", "label_error", digest.alias("codebooks_sha256"))
