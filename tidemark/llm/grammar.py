"""Token-id shards, compressed by grammars of frequent pairs."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import batched, partitions, rows, saved, shared_dir
from ._files import opened, replacing
from .tokens import encoder

MAGIC = b"IDGRAM1\n"
_HEAD = struct.Struct("<IIIIQ")  # terminals, rules, documents, reserved, symbols


def frequent_pairs(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, places, ranks): the pairs (left << 32 | right) that occur ``least`` times or more, most frequent first, and where in ``keys`` they are.

    Pairs are counted by a hash into a table; pairs that share a place in it are
    told apart by sorting.
    """
    bits = min(20, max(10, (2 * len(keys)).bit_length()))
    hashed = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
    filled = np.bincount(hashed, minlength=1 << bits)
    at = np.flatnonzero(filled[hashed] >= least)
    place, key = hashed[at], keys[at]
    held = np.zeros(1 << bits, np.int64)
    held[place] = key
    mixed = np.zeros(1 << bits, bool)
    mixed[place[held[place] != key]] = True
    several = mixed[place]
    found, which, counts = np.unique(key[several], return_inverse=True, return_counts=True)
    alone = np.flatnonzero((filled >= least) & ~mixed)
    pairs, times = np.r_[held[alone], found], np.r_[filled[alone], counts]
    number = np.zeros(1 << bits, np.int64)
    number[alone] = np.arange(len(alone))
    own = number[place]
    own[several] = len(alone) + which
    order = np.lexsort((pairs, -times))
    order = order[: np.searchsorted(-times[order], -least, side="right")]
    rank = np.full(len(pairs), -1)
    rank[order] = np.arange(len(order))
    rank = rank[own]
    return pairs[order], at[rank >= 0], rank[rank >= 0]


def chosen(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which occurrences, of pairs with ``rank`` at places ``at``, are replaced: of those that overlap the more frequent, and of a run of one pair every other."""
    near = np.diff(at) == 1
    nth = np.arange(len(at))
    begins = np.r_[True, ~near | (rank[1:] != rank[:-1])]
    begin = np.maximum.accumulate(np.where(begins, nth, 0))
    best = (nth - begin) % 2 == 0
    best[1:] &= ~(near & (rank[:-1] < rank[1:]))
    best[:-1] &= ~(near & (rank[1:] < rank[:-1]))
    best[1:] &= ~(near & best[:-1] & best[1:])
    return best


def compress(ids: np.ndarray, terminals: int, end_id: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules) by Re-Pair: rule k expands symbol ``terminals`` + k to two earlier symbols; none spans an ``end_id``.

    A round replaces all frequent pairs, the more frequent first where they
    overlap; rounds go on until no pair occurs ``least`` times (or occurrences
    overlap so that it cannot be replaced half as often). Only pairs at symbols
    of the last round are counted, and all pairs once more before the end.
    """
    seq, rules, new = ids.astype(np.int32), np.empty((0, 2), np.int64), 0
    while len(seq) > 1:
        fresh = seq >= new
        at = np.flatnonzero(fresh[:-1] | fresh[1:])
        left, right = seq[at], seq[at + 1]
        inside = (left != end_id) & (right != end_id)
        at, keys = at[inside], (left[inside].astype(np.int64) << 32) | right[inside]
        pairs, hits, rank = frequent_pairs(keys, least)
        first = terminals + len(rules)
        if len(pairs):
            best = chosen(rank, at[hits])
            taken, rank = at[hits][best], rank[best]
            used = np.bincount(rank, minlength=len(pairs)) >= max(2, least // 2)
            taken, rank = taken[used[rank]], rank[used[rank]]
            pairs = pairs[used]
        if not len(pairs):
            if not new:
                break
            new = 0  # a last look at all pairs
            continue
        seq[taken] = first + (np.cumsum(used) - 1)[rank]
        kept = np.ones(len(seq), bool)
        kept[taken + 1] = False
        seq, new = seq[kept], first
        rules = np.vstack([rules, np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1)])
    return seq, rules


def expansion_lengths(terminals: int, rules: np.ndarray) -> np.ndarray:
    """Each symbol's length in ids."""
    lengths = [1] * terminals
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    return np.array(lengths, np.int64)


def expansions(terminals: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, texts): each symbol's length in ids, and all symbols' expansions one after the other."""
    texts = [i.to_bytes(4, "little") for i in range(terminals)]
    for a, b in rules.tolist():
        texts.append(texts[a] + texts[b])
    return expansion_lengths(terminals, rules), np.frombuffer(b"".join(texts), "<u4")


def expand(symbols: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[symbols]
    total = int(n.sum())
    skip = np.repeat(starts[symbols] - (np.cumsum(n) - n), n)
    return texts[skip + np.arange(total)]


def pack_shard(ids: np.ndarray, counts: np.ndarray, terminals: int, end_id: int, **options) -> bytes:
    """A shard's file: head, rules, expansion lengths of the rules, each document's first symbol, symbols."""
    symbols, rules = compress(ids, terminals, end_id, **options)
    lengths = expansion_lengths(terminals, rules)
    ends = np.cumsum(lengths[symbols])
    firsts = np.searchsorted(ends, np.cumsum(counts) - counts, side="right")
    head = _HEAD.pack(terminals, len(rules), len(counts), 0, len(symbols))
    return MAGIC + head + rules.astype("<u4").tobytes() + lengths[terminals:].astype("<u4").tobytes() + firsts.astype("<u8").tobytes() + symbols.astype("<u4").tobytes()


class Shard:
    """A shard's file, open for reading any document."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        terminals, n_rules, self.documents, _, n = _HEAD.unpack_from(data, len(MAGIC))
        at = len(MAGIC) + _HEAD.size
        rules = np.frombuffer(data, "<u4", 2 * n_rules, at).astype(np.int64).reshape(-1, 2)
        said = np.frombuffer(data, "<u4", n_rules, at := at + 8 * n_rules)
        self.firsts = np.frombuffer(data, "<u8", self.documents, at := at + 4 * n_rules).astype(np.int64)
        self.symbols = np.frombuffer(data, "<u4", n, at + 8 * self.documents).astype(np.int64)
        self.lengths, self.texts = expansions(terminals, rules)
        if not np.array_equal(self.lengths[terminals:], said):
            raise ValueError("expansion lengths do not fit the rules")

    def document(self, k: int) -> np.ndarray:
        """The ids of document k, from its own symbols alone."""
        end = self.firsts[k + 1] if k + 1 < self.documents else len(self.symbols)
        return expand(self.symbols[self.firsts[k] : end], self.lengths, self.texts)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of all documents."""
        sums = np.r_[0, np.cumsum(self.lengths[self.symbols])]
        bounds = sums[np.r_[self.firsts, len(self.symbols)]]
        return expand(self.symbols, self.lengths, self.texts), np.diff(bounds)


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, terminals: int = 49408, keeps_space: bool = False, shard_ids: int = 1_000_000) -> DataFrame:
    """Encode whole texts, in order of ``id_col``, to grammar-compressed shards.

    Rows are range-partitioned and sorted by id; each task writes shards of about
    ``shard_ids`` ids, each with its own grammar, so that memory is bounded, and
    under their final names only when complete. Null text is empty: ``end_id``
    alone. Null ids come first; rows that repeat an id are ordered by a hash of
    the text. Returns part, shard, path, ids (documents' ids, in order), n_ids.
    """
    path = path or shared_dir(docs.sparkSession, "token-ids")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("ids", pa.list_(to_arrow_type(kind))), ("n_ids", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, keeps_space, words=300_000), TaskContext.get().partitionId()

        def each() -> Iterator[tuple]:
            keys, held, total, shard = [], [], 0, 0
            for batch in batches:
                for key, ids in zip(batch.column(0).to_pylist(), encode.each(batch.column(1)), strict=True):
                    keys.append(key)
                    held.append(ids + end)
                    total += len(held[-1]) // 4
                    if total >= shard_ids:
                        yield flush(keys, held, total, shard)
                        keys, held, total, shard = [], [], 0, shard + 1
            if keys:
                yield flush(keys, held, total, shard)

        def flush(keys: list, held: list[bytes], total: int, shard: int) -> tuple:
            name = f"{path}/ids-{part:06d}-{shard:06d}.bin"
            data = pack_shard(np.frombuffer(b"".join(held), "<u4"), np.array([len(x) // 4 for x in held], np.int64), terminals, end_id)
            with replacing(name) as out:
                out.write(data)
            return part, shard, name, keys, total

        yield from batched(each(), schema, 1)

    n = partitions(docs.sparkSession)
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    ordered = docs.select(id_col, text_col, tie.alias("tie")).repartitionByRange(n, id_col, "tie").sortWithinPartitions(id_col, "tie").select(id_col, text_col)
    ddl = f"part int, shard int, path string, ids array<{kind.simpleString()}>, n_ids long"
    return saved(ordered.mapInArrow(run, ddl), "token-files")


def read_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode shards: id_col, start (ids of all documents before), n_tokens, ids_crc32, for each document in them.

    Starts are prefix sums of the shards' totals: over tasks first, then over each task's shards.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("k")).select("part", zero(F.sum("k").over(before)).alias("part_base"))  # a row a task
    placed = files.join(F.broadcast(bases), "part").withColumn("base", F.col("part_base") + zero(F.sum("n_ids").over(inside)))
    kind = files.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(kind)), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for path, keys, base in rows(batches):
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    ids, counts = Shard(file.read()).all()
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for key, n in zip(keys, counts.tolist(), strict=True):
                    yield key, base + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])
                    at += n

        yield from batched(each(), schema)

    dealt = placed.select("path", "ids", "base").repartition(partitions(files.sparkSession), "path")
    return dealt.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")
