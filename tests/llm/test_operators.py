"""Every corpus operator against a plain, brute-force version, on odd rows and on small tables."""

import base64
import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import exact_dedup, grammar, jaccard, media, mixing, packing, queries, repeats, sharding, toxicity, warc
from tidemark.llm.components import connected
from tidemark.llm.sieve import sifted
from tidemark.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, kept string, id string, row string, part int, start string"
PASSAGE = " ".join(f"passage{i}" for i in range(60))


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, repeated ids, columns with clashing names."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choices(words, k=9000))
    base = " ".join(rng.choices(words, k=120))
    texts = {
        1: "Alpha beta", 2: "ALPHA beta", 3: "", 4: None, 5: " \t\n ", 6: long, 7: long.upper(), 8: "É alpha", 9: "é alpha", 10: base, 11: base + " more", 12: base.replace("w1 ", "w2 "),
        13: "x" * 500, 14: "ab" * 300, 15: f"{PASSAGE} one", 16: f"two {PASSAGE}", 17: long[:20000] + " tail", 18: "one", 19: "two words", 20: "one\ntwo\r\nthree  four ", 21: base.upper(), 22: "naïve space <|endoftext|> it's",
    }
    rest = ("en", "a", 1, 9, "s", "k", "i", "r", 3, "t")
    rows = [(k, t, *rest) for k, t in texts.items()]
    rows += [rows[0], rows[2], (None, "no id", None, None, None, *rest[3:]), (None, None, None, None, None, *[None] * 7), (23, "repeat", "en", "b", 1, *rest[3:]), (23, "repeat with another text", "en", "b", 1, *rest[3:]), (24, base, "en", None, 1, *rest[3:])]
    return rows


@pytest.fixture(scope="module", params=["odd", "empty", "sf"])
def docs(spark, request):
    if request.param == "sf":
        return spark.read.parquet(f"{SF}/documents.parquet").cache()
    return spark.createDataFrame(odd_rows() if request.param == "odd" else [], SCHEMA).repartition(3, F.xxhash64("text")).cache()


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_sharding(docs):
    got = sharding.shard_by_bytes(docs, 5).collect()
    want = Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in pairs(docs))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total = sum(r["size"] for r in got)
    most = max((r["size"] for r in got), default=0)
    ids = []
    for shard in sorted(by):
        assert sorted(r.slot for r in by[shard]) == list(range(len(by[shard])))
        assert abs(sum(r["size"] for r in by[shard]) - total / 5) <= most
        ids += [r.doc_id for r in sorted(by[shard], key=lambda r: r.slot) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = sum(r.predicted and r.toxic for r in got)
    assert len(got) > 500 and sum(r.predicted for r in got) <= 1.08 * caught
    assert caught >= 0.75 * sum(r.toxic for r in got)
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_toxicity_on_odd_rows(spark, docs):
    labels = docs.select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    kept = toxicity.clean_rows(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert all(r.score == 0 and r.predicted == 0 for r in none)


def page_rows(spark, name):
    if name == "sf":
        return spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(1, "http://a/?q=ü x\r\n", "<p>Ä</p>", "x"), (2, None, "<p>Ä</p>", "x"), (3, "u", None, None), (4, "u", "", None), (5, "u", "long " * 90000, ""), (6, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n", ""), (None, "u", "<p>Ä</p>", ""), (None, "u", "only", ""), (1, "again", "<p>Ä</p>", "x")]
    return spark.createDataFrame(rows if name == "odd" else [], "page_id long, url string, html string, payload string")


@pytest.mark.parametrize("name", ["odd", "empty", "sf"])
@pytest.mark.parametrize("split", [1 << 22, 700])
def test_warc(spark, name, split):
    if name == "sf" and split == 700:
        split = 5000
    pages = page_rows(spark, name)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for k, p in rows:
        if k is not None:
            first[p] = min(k, first.get(p, k))
    want = Counter((str(k), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if k == first.get(p) else "revisit", None if k == first.get(p) else str(first[p]), p if k == first.get(p) else None) for k, p in rows)
    got = warc.read_warc(spark, warc.write_warc(pages), split_bytes=split).collect()
    assert Counter((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is None else bytes(r.payload)) for r in got) == want


def test_warc_false_magic():
    import pyarrow as pa

    inner = warc.member([("WARC-Type", "response")], b"x")  # a record without the fields that count
    real = [warc.page_record(i, "u", inner + bytes([i]) * 50, warc.digest(b""), None, "d") for i in range(3)]
    data = inner + real[0] + b"".join(real[1:])
    file = pa.BufferReader(data)
    for cut in range(0, len(data), 17):
        got = [*warc.members(file, len(data), 0, cut), *warc.members(file, len(data), cut, len(data))]
        assert len(got) == 3


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"block_members": 300, "few": 2, "sieve_bits": 64}])
@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard(docs, k, percent, options):
    got = jaccard.near_components(docs, k=k, percent=percent, **options).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(pairs(docs), k, percent)


def test_sifted(spark):
    rows = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    for ids in ([], [None], [*range(100, 300), None]):
        wanted = spark.createDataFrame([(x,) for x in ids], "w long")
        got = {r.k for r in sifted(rows, "k", wanted, "w").collect()}
        assert set(ids) <= got and len(got) <= len(set(ids)) + 200
        assert sifted(rows, "k", wanted, "w", most_bits=4 * len(ids) - 1 if ids else -1).count() == 5000


def test_all_links(spark):
    rng = random.Random(3)
    base = [rng.choices(range(1000), k=60) for _ in range(4)]
    texts = [" ".join(str(x if rng.random() > 0.02 else rng.randrange(1000)) for x in rng.choice(base)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, links = jaccard.jaccard_links(docs, k=3, percent=60, skip_connected=False, block_members=1000)
    sets = {}
    for r in members.collect():
        sets[bytes(r.cls)] = sets_of(texts[r.id], 3)
    names = sorted(sets)
    want = {frozenset((a, b)) for i, a in enumerate(names) for b in names[:i] if 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}
    assert want and {frozenset((bytes(r.a), bytes(r.b))) for r in links.collect()} == want


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((1, 1), (40, 30), (60, 70)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1)]
        got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
        near = defaultdict(set)
        for a, b in edges:
            if a is not None and a != b:
                near[a].add(b)
                near[b].add(a)
        want = {}
        for x in sorted(near):
            if x not in want:
                todo = [x]
                while todo:
                    y = todo.pop()
                    if y not in want:
                        want[y] = x
                        todo += near[y]
        assert got == want


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for raw in raws:
        cover = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                cover[i : i + length] = 1
        gone = cover[: len(raw)]
        spans = int((np.diff(np.r_[0, gone]) == 1).sum())
        yield len(raw), int(gone.sum()), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)


@pytest.mark.parametrize("length,flush", [(200, 32 << 20), (100, 2000)])
def test_repeats(docs, length, flush):
    rows = pairs(docs)
    want = Counter((k, *x) for (k, _), x in zip(rows, brute_repeats([t for _, t in rows], length), strict=True))
    got = repeats.remove_repeats(docs, length=length, flush_bytes=flush).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want


def test_repeats_of_many_sides(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abc", k=n))
    shared = [letters(150) for _ in range(2)]
    fronts, backs = [letters(60) for _ in range(5)], [letters(60) for _ in range(5)]
    texts = [letters(30) + rng.choice(fronts) + rng.choice(shared) + rng.choice(backs)[: rng.randrange(61)] + letters(30) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, length=200).collect()}
    assert [got[i] for i in range(len(texts))] == list(brute_repeats(texts, 200))


def test_loser_tree():
    rng = random.Random(2)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(rng.randrange(40))) for _ in range(k)]
        coded = []
        for run in runs:
            last, out = b"", []
            for x in run:
                out.append((x, repeats.common_prefix(last, x), None))
                last = x
            coded.append(iter(out))
        got = [(x, n) for x, n, _ in repeats.LoserTree(coded)]
        want = sorted(x for run in runs for x in run)
        assert [x for x, _ in got] == want
        assert [n for _, n in got[1:]] == [repeats.common_prefix(a, b) for a, b in zip(want, want[1:], strict=False)]


def duck(sql, **tables):
    with duckdb.connect() as con:
        for name, frame in tables.items():
            con.register(name, frame)
        return con.execute(sql).fetchall()


def arrow(docs):
    return docs.select("doc_id", "text", "source").toArrow()


def rounded(rows):
    return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


def test_mixing(docs):
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "slots").collect()
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r)
    assert Counter(map(key, got)) == Counter(map(key, duck(queries.ORACLE_SQL["op6_mixing"], documents=arrow(docs))))
    for block_words in (256, 16):
        got = mixing.mix(docs, block_words=block_words).collect()
        assert all(r.taken <= 2 * r["size"] and len(r.slots) == -(-r.taken // max(1, r["size"])) and r.slots == sorted(r.slots) for r in got)
        sources = {(r.source_size, round(r.target, 6)) for r in got}
        assert abs(sum(r.taken for r in got) - 1.5 * sum(r["size"] for r in got)) <= 30 and all(t <= 2 * s + 1e-6 for s, t in sources)


def test_schedule_deals_sources_evenly(spark):
    """Each stretch of the mix holds the sources by their targets; in another order of the points it would not."""
    targets = spark.createDataFrame([("a", 90_000, 90_000.0), ("b", 40_000, 20_000.5), (None, 10_000, 19_999.0), ("none", 0, 0.0)], "source string, source_size long, target double")
    slots = sorted(mixing.schedule(targets, block_words=100).collect())
    assert len({r.slot for r in slots}) == len(slots)
    taken = Counter()
    for r in slots:
        taken[r.source] += r.words
    assert taken == {"a": 90_000, "b": 20_000, None: 19_999}
    seen = Counter()
    for i, r in enumerate(slots[: int(0.9 * len(slots))], 1):
        seen[r.source] += 1
        for source, words in taken.items():
            assert abs(seen[source] - i * words / 129_999) <= 4
    for source in taken:
        own = [(r["pass"], r.block) for r in slots if r.source == source]
        assert own == sorted(own) and len(set(own)) == len(own)


def test_mixed_rows(spark):
    docs = spark.createDataFrame([(i, "a b c", "xyz"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    # 180 words, 270 wanted in shares of 3, 1, 2: x is full at 120, y and z share 150
    assert taken == {"x": 120, "y": 50, "z": 100}


@pytest.mark.parametrize("block_words", [256, 16])
def test_mixed_rows_are_what_the_mix_plans(docs, block_words):
    more = docs.withColumn("_mix_key", F.lit(1)).withColumn("_MIX_slot", F.lit(2))
    mixed = mixing.mixed_rows(more, block_words=block_words)
    assert mixed.columns == more.columns
    got = mixed.collect()
    planned = mixing.mix(docs, block_words=block_words).collect()
    words, want = defaultdict(int), defaultdict(int)
    for r in got:
        words[r.source, r.doc_id] += len((r.text or "").encode().split())
    for r in planned:
        want[r.source, r.doc_id] += r.taken
    assert dict(words) == {k: n for k, n in want.items() if n}
    assert len(got) == sum(len(r.slots) for r in planned)
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.source, r.doc_id].append(r.text or "")
    assert all(any(t.startswith(r.text) for t in texts[r.source, r.doc_id]) for r in got)
    place = {}
    for r in planned:
        for slot in r.slots:
            place.setdefault((r.source, r.doc_id), []).append(slot)
    if all(len(v) <= 2 for v in place.values()):
        order = [min(place[r.source, r.doc_id]) for r in got if len(place[r.source, r.doc_id]) == 1]
        assert order == sorted(order)


def test_mixed_rows_with_one_id(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "d e f", "x"), (1, "d e f", "x"), (None, "g h", "y"), (None, "i j", "y"), (2, "k l", "z")], "doc_id long, text string, source string")
    got = Counter((r.text, r.source) for r in mixing.mixed_rows(docs).collect())
    plan = mixing.mix(docs).collect()
    assert sum(len(t.split()) * n for (t, _), n in got.items()) == sum(r.taken for r in plan)


def test_exact_dedup(docs):
    rows = pairs(docs)
    groups = defaultdict(list)
    for k, t in rows:
        groups[(t or "").encode().lower()].append(k)
    keep = {t: max((k for k in ks if k is not None), default=None) for t, ks in groups.items()}
    want = Counter((k, keep[x], len(groups[x]), hashlib.sha256(x).hexdigest()) for k, t in rows for x in [(t or "").encode().lower()])
    for block in (16384, 64):
        got = exact_dedup.exact_dedup(docs, block_bytes=block).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(x).hexdigest() for x in groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    docs = docs.withColumn("_key", F.lit(1)).withColumn("k", F.lit(2))
    stay = exact_dedup.distinct_texts(docs)
    assert stay.columns == docs.columns and Counter((r.text or "").encode().lower() for r in stay.collect()) == Counter(groups.keys())


def test_exact_dedup_oracle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op7_exact_dedup(spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(duck(queries.ORACLE_SQL["op7_exact_dedup"], documents=arrow(docs)))


@cache
def plain_tokenizer(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def ids_of(path, text, end):
    t = plain_tokenizer(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def test_token_ids(docs):
    path = queries.WORD_BPE
    files = grammar.write_ids(docs, path, shard_ids=3000)
    got = sorted(grammar.read_ids(files).collect(), key=lambda r: r.start)
    want = Counter()
    for k, t in pairs(docs):
        ids = ids_of(path, t, 2)
        want[k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert known == sorted(known)


def plain_repair(ids, end_id, least):
    """Re-Pair as published: the most frequent pair, over and over."""
    seq, rules = ids.tolist(), 0
    while True:
        count, last = Counter(), None
        for i, pair in enumerate(zip(seq, seq[1:], strict=False)):
            if end_id in pair or (last == (i - 1, pair)):
                last = None
                continue
            count[pair] += 1
            last = (i, pair)
        pair, n = max(count.items(), key=lambda x: (x[1], x[0]), default=(None, 0))
        if n < least:
            return len(seq), rules
        rules, out, i = rules + 1, [], 0
        while i < len(seq):
            if tuple(seq[i : i + 2]) == pair:
                out.append(1000 + rules)
                i += 2
            else:
                out.append(seq[i])
                i += 1
        seq = out


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    passage = rng.integers(3, 400, 200)
    texts = [rng.integers(3, 9, 3000), np.concatenate([np.r_[rng.integers(3, 400, 20), passage] for _ in range(40)]), np.full(2000, 7)]
    for ids in texts:
        ids = np.r_[ids, 2]
        symbols, rules = grammar.compress(ids, 500, 2, least=8)
        lengths, all_texts = grammar.expansions(500, rules)
        assert np.array_equal(grammar.expand(symbols, lengths, all_texts), ids)
        inner = [p for p in zip(symbols.tolist(), symbols[1:].tolist(), strict=False) if 2 not in p]
        often = [p for p, n in Counter(inner).items() if n >= 8 and p[0] != p[1]]
        assert not often
        plain, plain_rules = plain_repair(ids, 2, 8)
        assert len(symbols) + 2 * len(rules) <= 1.1 * (plain + 2 * plain_rules) + 20


def test_grammar():
    rng = np.random.default_rng(1)
    for n, top in ((1, 3), (50, 3), (20000, 6), (20000, 400)):
        counts = []
        parts = []
        for _ in range(9):
            x = np.r_[rng.integers(3, 3 + top, n), 2].astype(np.uint32)
            parts.append(x)
            counts.append(len(x))
        parts.append(np.r_[np.full(1001, 5), 2].astype(np.uint32))
        counts.append(1002)
        ids = np.concatenate(parts)
        shard = grammar.Shard(grammar.pack_shard(ids, np.array(counts), 500, 2))
        got, n_ids = shard.all()
        assert np.array_equal(got, ids) and n_ids.tolist() == counts
        assert all(np.array_equal(shard.document(k), x) for k, x in enumerate(parts))
        if n == 20000 and top == 6:
            assert len(shard.symbols) < 0.4 * len(ids)


def test_encoder_agrees_with_the_tokenizer():
    rng = random.Random(9)
    pools = ["abcXYZ .,;:!?'", "ae\u0130I\u0131\xdf\xe9\xc9\xf1\xb5\xaa\xba\xb2 ", "\u0430\u0431\u0412 .,!", "\u0307\u0301 a\u0130?.", "\u65e5\u672c a,", "0123 a.b", "\t\n\r\xa0\u3000ab.", "\ufb01\u2460\u2167a,\U0001f600 "]
    for path, space in ((queries.WORD_BPE, False), (queries.BYTE_BPE, True)):
        encode = encoder(path, space)
        for _ in range(3000):
            pool = "".join(rng.sample(pools, rng.randrange(1, 4))) + "".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(rng.randrange(3)))
            text = "".join(rng.choice(pool) for _ in range(rng.randrange(14)))
            assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(path, text, 0)[:-1], text
        assert np.frombuffer(encode("z\u0130?"), "<u4").tolist() == ids_of(path, "z\u0130?", 0)[:-1]


def test_grammar_of_documents_alike_at_both_ends():
    rng = np.random.default_rng(2)
    for n in (0, 4, 30):
        parts = [np.r_[7, 8, rng.integers(3, 400, n), 9, 2].astype(np.uint32) for _ in range(500)]
        shard = grammar.Shard(grammar.pack_shard(np.concatenate(parts), np.array([len(x) for x in parts]), 500, 2))
        ids, counts = shard.all()
        assert np.array_equal(ids, np.concatenate(parts)) and counts.tolist() == [len(x) for x in parts]
        assert all(np.array_equal(shard.document(k), x) for k, x in enumerate(parts))
        assert all(2 not in shard.texts[500:][at : at + m] for m, at in zip(shard.lengths[500:], np.cumsum(shard.lengths[500:]) - shard.lengths[500:], strict=True))


def test_media(docs):
    got = media.read_media(media.store_media(docs)).collect()
    want = Counter()
    for k, t in pairs(docs):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want[k, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    stored = {(r.doc_id, hashlib.sha256(r.media).hexdigest()): r.media for r in media.store_media(docs).collect()}
    for r in got:
        data = bytes(stored[r.doc_id, r.media_sha256])
        payload = media.read_streams(data)[media.SOUND]["packets"][1:]
        x = [b - 128 for b in b"".join(payload)]
        said = json.loads(r.feature)
        assert r.media_bytes == len(data) and said["packets"] == len(payload) and said["pages"] == data.count(b"OggS")
        assert said["seconds"] == r.payload_bytes / 8000 and said["mean"] == round(sum(x) / len(x), 6) and abs(said["rms"] ** 2 - sum(v * v for v in x) / len(x)) < 1e-2
        assert said["crossings"] == sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))


def test_ogg_container():
    def slow_crc(data):
        crc = 0
        for b in data:
            crc ^= b << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc >> 31 else crc << 1
        return crc

    assert media.checksum(b"OggS and more") == slow_crc(b"OggS and more")
    packets = [b"", b"a" * 254, b"b" * 255, b"c" * 510, b"d" * 70000, b"e"]
    one = media.write_stream(packets, [0, 5, 6, 7, 8, 9], 7)
    two = media.write_stream([b"z"], [3], 9)
    data = media.interleave(one, two)
    got = media.read_streams(data)
    assert got[7]["packets"] == packets and got[9]["packets"] == [b"z"] and got[7]["granules"][-1] == 9
    # the first four end in one page, the last two in another
    assert got[7]["granules"] == [None, None, None, 7, None, 9]
    assert media.packet_ends(got[7]["granules"], [0, 3, 2, 1, 1, 1]) == [1, 4, 6, 7, 8, 9]
    assert media.packet_ends([], []) == []
    sound = media.decode_samples(media.encode_samples(bytes(range(250)) * 50, rate=1000, packet_samples=120))
    assert sound["ends"] == [min(12500, 120 * (i + 1)) / 1000 for i in range(105)]
    for damaged in (data[:-1] + bytes([data[-1] ^ 1]), data[:-3], b"x" + data, b"".join(one[:-1])):
        with pytest.raises(ValueError):
            media.read_streams(damaged)


def test_packing(docs):
    path = queries.BYTE_BPE
    got = packing.pack(docs, path, capacity=256).collect()
    want = Counter()
    for k, t in pairs(docs):
        ids = np.array(ids_of(path, t, 0), "<u4")
        at = 0
        for i, n in enumerate(packing.cut(len(ids), 256)):
            want[k, i, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 256
    assert len(by) <= 1.02 * sum(n for *_, n, _ in want.elements()) / 256 + 2


def test_packing_more_pieces_than_open_bins(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " a" * rng.randrange(1, 200)) for i in range(6000)], "doc_id long, text string")
    got = packing.pack(docs, queries.BYTE_BPE, capacity=256, open_bins=64).collect()
    assert len(got) == 6000
    assert len({r.sequence_id for r in got}) <= 1.05 * sum(r.length for r in got) / 256


def test_best_fit():
    rng = random.Random(4)
    lengths = [rng.randrange(1, 101) for _ in range(3000)]
    bins = packing.BestFit(100, 8)
    free = defaultdict(lambda: 100)
    for n in lengths:
        number, offset = bins.place(n)
        assert offset == 100 - free[number]
        free[number] -= n
        assert free[number] >= 0 and bins.count <= 8
    assert len(free) < 1.25 * sum(lengths) / 100
