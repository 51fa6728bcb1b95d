"""Each registered query on the smallest tables, against a plain version of its contract; and models against plain ones."""

import base64
import hashlib
import json
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))

from test_operators import SF, arrow, brute_components, brute_repeats, duck, ids_of, pairs  # noqa: E402

from tidemark.llm import packing, queries  # noqa: E402
from tidemark.llm.toxicity import Ftrl  # noqa: E402


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_op1(spark):
    got = queries.op1_sharding(spark, SF).collect()
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in pairs(documents(spark)))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None} and {r.shard for r in got} <= set(range(40))
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


def test_op2(spark):
    got = queries.op2_toxicity(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in pairs(documents(spark)))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op3(spark):
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    first = {}
    for k, p in rows:
        first[p] = min(k, first.get(p, k))
    want = Counter((k, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if k == first[p] else "revisit", None if k == first[p] else first[p]) for k, p in rows)
    got = queries.op3_warc(spark, SF)
    assert got.schema["page_id"].dataType == got.schema["refers_to"].dataType == spark.read.parquet(f"{SF}/pages.parquet").schema["page_id"].dataType
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == want


def test_op4(spark):
    got = queries.op4_ngram_jaccard(spark, SF).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(pairs(documents(spark)), 3, 90)


def test_op5(spark):
    rows = pairs(documents(spark))
    want = Counter((k, n, gone, spans, hashlib.sha256(kept).hexdigest()) for (k, _), (n, gone, spans, kept) in zip(rows, brute_repeats([t for _, t in rows], 200), strict=True))
    got = queries.op5_suffix_dedup(spark, SF).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_op6(spark):
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r)
    got = queries.op6_mixing(spark, SF).collect()
    assert Counter(map(key, got)) == Counter(map(key, duck(queries.ORACLE_SQL["op6_mixing"], documents=arrow(documents(spark)))))


def test_op8(spark):
    got = sorted(queries.op8_token_ids(spark, SF).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, (k, t) in zip(got, sorted(pairs(documents(spark))), strict=True):
        ids = ids_of(queries.WORD_BPE, t, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op9(spark):
    want = Counter()
    for k, t in pairs(documents(spark)):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want[k, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload) / 8000] += 1
    got = queries.op9_ogg(spark, SF).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, json.loads(r.feature)["seconds"]) for r in got) == want


def test_op10(spark):
    want = Counter()
    for k, t in pairs(documents(spark)):
        ids, at = np.array(ids_of(queries.BYTE_BPE, t, 0), "<u4"), 0
        for i, n in enumerate(packing.cut(len(ids), 2048)):
            want[k, i, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
    got = queries.op10_packing(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_best_fit_bin_by_bin():
    """Against a list of open bins that is searched through for every piece."""
    rng = random.Random(11)
    for capacity, most in ((20, 3), (100, 8), (64, 1)):
        fast, bins, made = packing.BestFit(capacity, most), [], 0  # bins: free, when it came to be so, number
        for turn in range(2000):
            n = rng.randrange(1, capacity + 1)
            fits = sorted(b for b in bins if b[0] >= n)
            if fits:
                free, _, number = fits[0]
                bins.remove(fits[0])
            else:
                if len(bins) >= most and n < capacity:
                    bins.remove(min(bins))
                number, free, made = made, capacity, made + 1
            if free > n:
                bins.append((free - n, turn, number))
            assert fast.place(n) == (number, capacity - free)


def test_ftrl_against_plain_loops():
    rng = random.Random(5)
    model, alpha, beta, l1 = Ftrl(6, alpha=0.8, beta=1.0, l1=0.3), 0.8, 1.0, 0.3
    z, n, bias_z, bias_n = Counter(), Counter(), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha)

    for _ in range(400):
        at = sorted(rng.sample(range(64), rng.randrange(1, 9)))
        label = int(sum(i < 20 for i in at) > len(at) / 2)
        model.learn(np.array(at), label)
        b = -bias_z / ((beta + math.sqrt(bias_n)) / alpha)
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - label
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
        bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / alpha * b
        bias_n += g * g
    assert np.allclose(model.weights(np.arange(64)), [weight(i) for i in range(64)])
    assert abs(model.bias() + bias_z / ((beta + math.sqrt(bias_n)) / alpha)) < 1e-9


def test_toxicity_scores_by_hand(spark):
    """A score is the sigmoid of the bias and the weights of a text's distinct words, pairs and pairs around a word."""
    from pyspark.sql import functions as F

    from tidemark.llm import toxicity
    from tidemark.llm.words import WordHashes

    of = lambda text: toxicity.features(text.encode(), WordHashes(), 20).tolist()
    (bad,), around = of("Bad"), of("bad q bad")[-1]
    assert [len(of(t)) for t in ("", "a", "a b", "a b c d")] == [0, 1, 3, 9]  # words, pairs, pairs with a word between
    assert of("BAD, bad")[:2] == [bad, bad] and of("bad q bad")[-1] == of("bad r bad")[-1] != of("bad bad")[-1]
    model = {"bits": 20, "places": np.array([bad, around], np.int32), "weights": np.array([0.75, -0.25], np.float32), "bias": -0.5}
    docs = spark.createDataFrame([(1, "bad x bad, bad"), (2, "fine"), (3, None), (4, "bad"), (5, "q bad z bad q")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    want = {1: sigmoid(0.75 - 0.25 - 0.5), 2: sigmoid(-0.5), 3: sigmoid(-0.5), 4: sigmoid(0.75 - 0.5), 5: sigmoid(0.75 - 0.25 - 0.5)}
    assert all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    # labels of held-out rows change nothing
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, toxicity.toxicity(docs, labels).collect())) == sorted(map(tuple, toxicity.toxicity(docs, turned).collect()))
