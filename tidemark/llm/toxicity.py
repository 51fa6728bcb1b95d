"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batched, rows
from .words import WordHashes, mix64

#: ASCII letters in lower case, digits and bytes of other letters stay; the rest parts words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def features(raw: bytes | None, cache: WordHashes, bits: int) -> np.ndarray:
    """Places of a text's words, word pairs and pairs with a word between, in 2**bits; repeats included."""
    h = cache.of((raw or b"").translate(_TABLE).split())
    grams = [mix64(h)]
    for gap, mark in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        grams.append(mix64(h[:-gap] * np.uint64(mark) + h[gap:]) if len(h) > gap else h[:0])
    return (np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: a rate of its own for every coordinate, and L1 that keeps most weights at zero."""

    def __init__(self, bits: int, alpha: float = 1.5, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + math.sqrt(self.bias_n)) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + b)))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - (math.sqrt(self.bias_n + g * g) - math.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g


def held_out(id_col: str, folds: int = 5):
    """Whether a row is kept from learning: crc32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20, max_rows: int = 30_000, epochs: int = 4) -> dict:
    """Sparse weights learnt from labelled rows that are not held out.

    Learns from about ``max_rows`` labelled rows at most, chosen by a hash of
    their id: that bounds the one task that learns and what is broadcast. Whole
    texts are read. An id with several labels counts by the greatest. Returns
    places, weights and bias; with no labelled rows all scores are 0.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("label").alias("label"))
    total = known.count()
    order = F.xxhash64(id_col, F.lit(7))
    part = F.pmod(order, F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(1, total)))
    sample = known.where(part).select(F.col(id_col).alias("l_id"), "label")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        schema = pa.schema([("order", pa.int64()), ("label", pa.int32()), ("places", pa.binary())])
        each = ((o, label, np.unique(features(raw, cache, bits)).astype(np.int32).tobytes()) for o, label, raw in rows(batches))
        yield from batched(each, schema, 256)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(bits), []
        for _, label, raw in rows(batches):
            seen.append((np.frombuffer(raw, np.int32), label))
        for _ in range(epochs):
            for at, label in seen:
                model.learn(at, label)
        schema = pa.schema([("places", pa.binary()), ("weights", pa.binary()), ("bias", pa.float64())])
        w = model.weights(np.arange(1 << bits))
        at = np.flatnonzero(w)
        yield from batched(iter([(at.astype(np.int32).tobytes(), w[at].astype(np.float32).tobytes(), model.bias() if seen else -math.inf)]), schema)

    # at most about max_rows labels are broadcast
    labelled = docs.join(F.broadcast(sample), F.col(id_col) == F.col("l_id")).select(F.xxhash64(id_col, F.lit(11)).alias("order"), "label", F.col(text_col).cast("binary").alias("raw"))
    one = labelled.mapInArrow(places, "order long, label int, places binary").repartition(1).sortWithinPartitions("order", "label", "places")
    got = one.mapInArrow(learn, "places binary, weights binary, bias double").first()
    if got is None:  # Spark drops the task where it knows that there are no rows
        return {"bits": bits, "places": np.empty(0, np.int32), "weights": np.empty(0, np.float32), "bias": -math.inf}
    return {"bits": bits, "places": np.frombuffer(bytes(got.places), np.int32), "weights": np.frombuffer(bytes(got.weights), np.float32), "bias": got.bias}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, name: str = "score") -> DataFrame:
    """Score every whole text: id_col (or, with ``keep``, all columns), score in 0 to 1.

    Null and empty texts score what the bias says. At most 2**bits weights are
    broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.pandas.types import to_arrow_type

    kept = docs.schema.fields if keep else [docs.schema[id_col]]
    schema = pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in kept), (name, pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = np.zeros(1 << m["bits"], np.float32)
        dense[m["places"]] = m["weights"]
        cache = WordHashes()
        for batch in batches:
            scores = []
            for raw in batch.column(batch.num_columns - 1).to_pylist():
                at = features(raw, cache, m["bits"])
                at = np.unique(at[dense[at] != 0])
                x = float(dense[at].sum(dtype=np.float64)) + m["bias"]
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) if x > -math.inf else 0.0)
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns[:-1], schema, strict=False)), pa.array(scores, pa.float64())], schema=schema)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` double"])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text_col).cast("binary").alias("_raw")).mapInArrow(run, ddl)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, **options) -> DataFrame:
    """Fit on the rows that are not held out and score all: id_col, held_out, score, predicted.

    Only the text is an input of a score. Rows that repeat are scored alike; a
    null id is never learnt from. No rows give no rows.
    """
    model = fit(docs, labels, id_col, text_col, label_col, **options)
    return score(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    model = fit(docs, labels, id_col, text_col, **options)
    return score(docs, model, id_col, text_col, keep=True, name=name).where(F.col(name) < threshold).drop(name)
