"""The registered queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import saved
from . import codes, conversations, exact_dedup, grammar, jaccard, media, mixing, packing, repeats, sharding, topk, toxicity, warc

#: Tokenizer files.
WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty contiguous shards of near-equal bytes."""
    shards = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 40)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    pages = _table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    records = warc.read_warc(spark, warc.write_warc(pages), with_payload=False)
    return records.select(F.col("record_id").try_cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast(kind).alias("refers_to"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets reach 0.9."""
    return jaccard.near_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes removed."""
    kept = repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of the sources takes of each document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "slots")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id stays."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="max").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written as grammar-compressed shards and read back."""
    return grammar.read_ids(grammar.write_ids(_table(spark, sf_dir, "documents"), WORD_BPE))


def op9_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as sound in Ogg files, read back and described."""
    stored = saved(media.store_media(_table(spark, sf_dir, "documents"), multiple=192), "media")
    return media.read_media(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), BYTE_BPE)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector: 16 parts, 64 entries, two rounds."""
    return codes.compress(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, damaged first."""
    return conversations.repair_damaged(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_warc, op4_ngram_jaccard, op5_suffix_dedup, op6_mixing, op7_exact_dedup, op8_token_ids, op9_ogg, op10_packing, op11_topk, op12_codes, op13_repair)}

#: Vectors without null, NaN or infinite components.
_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: Parts of vectors assigned to their nearest entries, and the entries that follow.
_ASSIGN = """{a} AS (SELECT vec_id, label, p, min({{'d': list_sum([(y[i] - b[i]) * (y[i] - b[i]) for i in range(1, w + 1)])::BIGINT, 'k': k}}) AS best, any_value(y) AS y FROM part JOIN {b} USING (p) GROUP BY vec_id, label, p)"""
_UPDATE = """{c} AS (SELECT {b}.p, {b}.k, coalesce(any_value(m.y), any_value({b}.b)) AS b FROM {b} LEFT JOIN (SELECT p, k, list(z ORDER BY i) AS y FROM (SELECT p, best.k AS k, i, floor(sum(y[i])::DOUBLE / count(*))::BIGINT AS z FROM {a}, (SELECT unnest(range(1, (SELECT max(w) FROM part) + 1)) AS i) GROUP BY ALL) GROUP BY p, k) AS m ON m.p = {b}.p AND m.k = {b}.k GROUP BY {b}.p, {b}.k)"""

_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op7_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
""",
    "op6_mixing": f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS wanted FROM w),
l AS (SELECT *, (wanted - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN line IS NULL THEN most ELSE least(most, weight * line) END AS target
  FROM l CROSS JOIN (SELECT min_by(level, ratio) AS line FROM l WHERE ratio >= level) AS m),
p AS (SELECT doc_id, d.source, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT source, source_size, floor(target)::BIGINT AS most, ceil(source_size / 256)::BIGINT AS per_pass FROM t WHERE source_size > 0),
k AS (SELECT *, (most // source_size) * per_pass + ceil((most - source_size * (most // source_size)) / 256)::BIGINT AS slots FROM q),
h AS (SELECT *, sum(slots) OVER (ORDER BY source NULLS LAST)::BIGINT AS top, sum(slots) OVER ()::BIGINT AS total FROM k WHERE slots > 0),
g AS (SELECT i, ((i % 1048576) * 0.6180339887498949::DOUBLE + ((i // 1048576) * {(mixing.GOLDEN * (1 << 20)) % 1.0!r}::DOUBLE) % 1.0::DOUBLE) % 1.0::DOUBLE * (SELECT max(total) FROM h)::DOUBLE AS point
  FROM range((SELECT coalesce(max(2 * total + 2), 0) FROM h)) AS r(i)),
z AS (SELECT i, source, source_size, most, per_pass, slots, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS n FROM g JOIN h ON point >= top - slots AND point < top),
b AS (SELECT i, source, n // per_pass AS pass, n % per_pass AS block, least(256, source_size - n % per_pass * 256, most - n // per_pass * source_size - n % per_pass * 256) AS words FROM z WHERE n < slots),
o AS (SELECT p.source AS o_source, p.start AS o_start, list(b.i ORDER BY b.pass) AS slots FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source AND b.block = p.start // 256 AND b.words > p.start % 256 WHERE p.size > 0 GROUP BY ALL)
SELECT p.doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE size * floor(floor(target) / source_size) + greatest(0, least(start + size, floor(target) - source_size * floor(floor(target) / source_size)) - start) END::BIGINT AS taken,
  coalesce(o.slots, []::BIGINT[]) AS slots
FROM p LEFT JOIN o ON p.source IS NOT DISTINCT FROM o_source AND p.start = o_start AND p.size > 0
""",
    "op11_topk": f"""
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS x FROM embeddings WHERE {_WHOLE}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
""",
    "op12_codes": f"""
WITH v AS (SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS x, len(embedding) // 16 AS w FROM embeddings WHERE {_WHOLE}),
part AS (SELECT vec_id, label, w, p, x[p * w + 1 : p * w + w] AS y FROM v, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, k, y AS b FROM part JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v QUALIFY k < 64) USING (vec_id)),
{_ASSIGN.format(a="a0", b="book0")}, {_UPDATE.format(a="a0", b="book0", c="book1")},
{_ASSIGN.format(a="a1", b="book1")}, {_UPDATE.format(a="a1", b="book1", c="book2")},
{_ASSIGN.format(a="a2", b="book2")},
g AS (SELECT vec_id, label, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, k)) FROM book2) AS codebooks_sha256 FROM g
""",
}
