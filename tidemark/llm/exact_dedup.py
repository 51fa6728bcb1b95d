"""Exact deduplication by deterministic naming of fixed-size blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, partitions, rows, saved


def _block_runs(block_bytes: int, flush_bytes: int, id_type: pa.DataType):
    """Split normalised texts into blocks; each distinct block of a stretch of rows leaves once, with where it occurs."""
    occurrence = pa.struct([("id", id_type), ("row", pa.int64()), ("pos", pa.int32()), ("n_blocks", pa.int32()), ("n_bytes", pa.int64()), ("sha", pa.binary())])
    schema = pa.schema([("block", pa.binary()), ("at", pa.list_(occurrence))])

    def flush(seen: dict[bytes, list[tuple]]) -> Iterator[pa.RecordBatch]:
        blocks = list(seen)
        for i in range(0, len(blocks), 512):
            part = blocks[i : i + 512]
            found = [seen[b] for b in part]
            offsets = [0]
            for x in found:
                offsets.append(offsets[-1] + len(x))
            columns = zip(*(t for x in found for t in x), strict=True)
            at = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, occurrence, strict=True)], fields=list(occurrence)))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), at.cast(schema.field("at").type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen, held = TaskContext.get().partitionId() << 40, {}, 0
        for key, raw in rows(batches):
            text = (raw or b"").lower()  # of bytes: A-Z only
            sha = hashlib.sha256(text).digest()
            n = max(1, -(-len(text) // block_bytes))
            for pos in range(n):
                block = text[pos * block_bytes : (pos + 1) * block_bytes]
                seen.setdefault(block, []).append((key, row, pos, n, len(text), sha if pos == 0 else None))
                held += len(block) + 150
            row += 1
            if held > flush_bytes:
                yield from flush(seen)
                seen, held = {}, 0
        yield from flush(seen)

    return run


def _named(df: DataFrame, columns: list[str], n: int, name: str) -> DataFrame:
    """Add ``name``, an integer that is equal just where ``columns`` are: the sorted place within a hash bucket, and the bucket."""
    place = F.dense_rank().over(Window.partitionBy("bucket").orderBy(*columns))
    return df.withColumn("bucket", F.pmod(F.xxhash64(*columns), F.lit(n))).withColumn(name, place.cast("long") * n + F.col("bucket")).drop("bucket")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16384, flush_bytes: int = 32 << 20) -> DataFrame:
    """One collision-free identity a row: equal exactly where the texts are, A-Z lower-cased.

    Blocks get integer names by sorting, then adjacent pairs of names do, level
    by level, until one name is left; with the length in bytes it is the
    identity. Copies of a block within a stretch of rows travel as one row, so a
    text held by a third of all rows costs little to sort, and texts cross the
    network once. Names depend on nothing but the data and the partition count.

    Returns id, row, n_bytes, name, sha. Null text counts as empty; null and
    repeated ids keep their rows.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"block binary, at array<struct<id: {id_type.simpleString()}, row: bigint, pos: int, n_blocks: int, n_bytes: bigint, sha: binary>>"
    runs = pairs.mapInArrow(_block_runs(block_bytes, flush_bytes, to_arrow_type(id_type)), schema)
    level = saved(_named(runs, ["block"], n, "name").select("name", F.explode("at").alias("at")).select("at.*", "name"), "block-names")

    done = level.where("n_blocks = 1")
    heads = level.where("n_blocks > 1 and pos = 0").select("row", "id", "n_bytes", "sha")
    level = level.where("n_blocks > 1").select("row", "pos", "name", "n_bytes")
    longest = level.agg(F.max("pos")).first()[0]
    for _ in range(math.ceil(math.log2(longest + 1)) if longest else 0):
        even = F.col("pos") % 2 == 0
        paired = level.groupBy("row", "n_bytes", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right")
        )
        paired = saved(paired, "block-pairs")
        names = _named(paired.select("left", "right").distinct(), ["left", "right"], n, "name")
        level = saved(paired.join(names, ["left", "right"]).select("row", "pos", "name", "n_bytes"), "pair-names")
    long = heads.join(level.select("row", "name"), "row")
    columns = ["id", "row", "n_bytes", "name", "sha"]
    return done.select(*columns).unionByName(long.select(*columns))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", block_bytes: int = 16384) -> DataFrame:
    """Groups of equal texts, case of A-Z aside; the ``keep`` (max or min) id of each group stays.

    Returns one row a row of ``docs``: id_col, keep_id, group_size, kept,
    text_sha256. Null texts equal empty ones. Repeated ids within a group are
    rows of their own and just one of them is kept; a null id stays only where
    a group has no other. No rows give no rows; other columns are not read.
    """
    named = saved(identify(docs, id_col, text_col, block_bytes), "identities")
    best = F.max if keep == "max" else F.min
    first = F.max_by if keep == "max" else F.min_by
    groups = named.groupBy("n_bytes", "name").agg(best("id").alias("keep_id"), F.coalesce(first("row", F.when(F.col("id").isNotNull(), F.struct("id", "row"))), F.max("row")).alias("keep_row"), F.count("*").alias("group_size"))
    return named.join(groups, ["n_bytes", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "row"
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Of rows that repeat both id and text, one stays. Ids must tell other rows
    apart: rows of one id whose texts differ are each held to their own group.
    """
    key_col, k, r = (free_name(docs, x) for x in ("_key", "_kept", "_repeated"))
    key = F.struct(F.col(id_col).alias("id"), F.sha2(F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256).alias("sha"))
    keyed = docs.withColumn(key_col, key)
    groups = saved(exact_dedup(docs, id_col, text_col, keep), "text-groups")
    kept = groups.where("kept").select(F.struct(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).alias(k))
    # Rows that repeat an id and a text are told apart by their keys alone, not by their texts.
    often = saved(groups.groupBy(F.struct(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")).alias(r)).count().where("count > 1").select(r), "text-repeats")
    same = F.col(key_col).eqNullSafe(F.col(k))
    if often.isEmpty():
        return keyed.join(kept, same, "left_semi").drop(key_col)
    alone = keyed.join(kept.join(often, F.col(k).eqNullSafe(F.col(r)), "left_anti"), same, "left_semi")
    several = keyed.join(kept.join(often, F.col(k).eqNullSafe(F.col(r)), "left_semi"), same, "left_semi")
    return alone.unionByName(several.dropDuplicates([key_col])).drop(key_col)
