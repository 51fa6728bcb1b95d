"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from test_operators import SCHEMA, SF, brute_components, ids_of, odd_rows, pairs  # noqa: E402

import corpus_pipeline  # noqa: E402
from tidemark.llm import mixing, packing, queries, toxicity  # noqa: E402
from tidemark.llm._common import saved  # noqa: E402


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns
    clean, distinct, far, mixed = kept[1:]

    scores = toxicity.toxicity(docs, labels).where("score < 0.5").collect()
    assert Counter(k for k, _ in pairs(clean)) == Counter(r.doc_id for r in scores)

    last = {}
    for key, text in pairs(clean):
        normal = (text or "").encode().lower()
        last[normal] = max(key, last.get(normal, key))
    assert Counter(k for k, _ in pairs(distinct)) == Counter(last.values())

    assert Counter(k for k, _ in pairs(far)) == Counter(key for key, _, least in brute_components(pairs(distinct), 5, 80) if key == least)

    planned = mixing.mix(far).collect()
    assert words(mixed) == Counter({(r.source, r.doc_id): r.taken for r in planned if r.taken})
    assert Counter(k for k, _ in pairs(mixed)) == Counter({r.doc_id: len(r.slots) for r in planned if r.slots})

    want = Counter()
    for key, text in pairs(mixed):
        at = 0
        for i, n in enumerate(packing.cut(len(ids_of(queries.BYTE_BPE, text, 0)), 2048)):
            want[key, i, at, n] += 1
            at += n
    packed = corpus_pipeline.STAGES[-1][1](spark, mixed, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in packed) == want


def test_null_and_repeated_ids(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(12)]
    rows = [(None, t, "a") for t in texts] + [(7, t + " end", "b") for t in texts[:6]] + [(7, f"alone {t}", "b") for t in texts[:2]]
    rows += [(None, "", "a"), (None, None, "a"), (3, " ", "c"), (None, texts[11] + " near", "c"), (None, texts[11] + " near", "c"), (9, "once more " * 3, "c"), (9, "once more " * 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()

    far = corpus_pipeline.drop_near_copies(spark, docs, SF)
    got = Counter((r.doc_id, r.text) for r in far.collect())
    assert far.columns == docs.columns and set(got.values()) == {1}
    for i, t in enumerate(texts):
        group = [k for k in got if t in (k[1] or "")]
        assert len(group) == 1 and group[0][0] == (7 if i < 6 else None)
    assert {(None, ""), (None, None), (3, " "), (9, "once more " * 3)} <= set(got) and len(got) == 12 + 4

    plan = mixing.mix(docs).collect()
    mixed = mixing.mixed_rows(docs)
    want = Counter()
    for r in plan:
        want[r.source, r.doc_id] += r.taken
    assert mixed.columns == docs.columns and words(mixed) == +want
    assert mixed.count() == sum(len(r.slots) for r in plan)
    assert max(Counter((r.doc_id, r.text, r.source) for r in mixed.collect()).values()) <= 4


def test_mix_that_ends_among_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c", s) for s in "xyz" for _ in range(9)], "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.source, None] += r.taken
    assert words(mixing.mixed_rows(docs)) == want and want["x", None] == 54


def words(docs):
    """Words in all, by source and id."""
    found = Counter()
    for r in docs.collect():
        found[r.source, r.doc_id] += len((r.text or "").encode().split())
    return +found


@pytest.mark.parametrize("rows", [odd_rows(), []], ids=["odd", "empty"])
def test_every_stage_on_odd_rows(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_key", F.lit(1)).withColumn("_stays", F.lit("x"))
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == before.columns
    texts = {(r.text or "").encode().lower() for r in docs.collect()}
    assert bool(texts) == bool(rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.length for r in packed) == sum(len(ids_of(queries.BYTE_BPE, t, 0)) for _, t in pairs(docs))
