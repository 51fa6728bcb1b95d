"""Best-fit packing of token sequences in bounded space."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batched, rows, saved
from .tokens import encoder


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, after a first that may be shorter."""
    return [n % capacity] * bool(n % capacity) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, keeps_space: bool = True) -> DataFrame:
    """The token pieces of every row: id_col, piece, start, length, ids_crc32.

    A row's ids are those of its whole text (null: empty) and ``end_id``; only
    rows longer than ``capacity`` are cut.
    """
    name, kind = id_col, docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keeps_space)

        def each() -> Iterator[tuple]:
            for key, text in rows(batches):
                ids = encode(text or "") + end
                at = 0
                for k, length in enumerate(cut(len(ids) // 4, capacity)):
                    yield key, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])
                    at += length

        yield from batched(each(), schema)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{name}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best fit with a fixed number of open bins.

    Bins are found by their free space: bit s of ``spaces`` says that a bin with
    s tokens free is open. A piece goes where least is left over; if it fits
    nowhere it opens a bin, and if that is one too many the fullest closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.spaces, self.bins, self.count, self.made = 0, {}, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            number, space = self.made, self.capacity
            self.made += 1
            if self.count >= self.open_bins and length < self.capacity:
                self._take((self.spaces & -self.spaces).bit_length() - 1)  # the fullest closes
        if space > length:
            self.bins.setdefault(space - length, deque()).append(number)
            self.spaces |= 1 << (space - length)
            self.count += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        held = self.bins[space]
        number = held.popleft()
        self.count -= 1
        if not held:
            self.spaces ^= 1 << space
        return number


def pack_lengths(lengths: Iterable[int], capacity: int, open_bins: int) -> Iterator[tuple[int, int]]:
    """(bin, offset) of each length in turn."""
    bins = BestFit(capacity, open_bins)
    return (bins.place(x) for x in lengths)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, open_bins: int = 1024, tokens_per_task: int = 8_000_000, keeps_space: bool = True) -> DataFrame:
    """Pack all rows' token pieces into sequences of at most ``capacity``.

    Texts are encoded once; the narrow pieces are dealt evenly by a hash of them
    over as many tasks as give each about ``tokens_per_task`` tokens, and each
    task packs on its own, online and in bounded space. Within a task pieces come
    in the order of that hash, so that long and short ones meet while bins are
    open, however many come; longest first, the long ones' bins would close
    before the short ones came. A task's last open bins stay as they are: up to
    ``open_bins`` sequences, so that waste falls a little with more tokens a task.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset. Null
    or empty text: one piece, the end id. Null and repeated ids keep their rows.
    No rows give no rows; other columns are not read.
    """
    cut_up = saved(pieces(docs, tokenizer, id_col, text_col, capacity, end_id, keeps_space), "pieces")
    tokens = cut_up.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // tokens_per_task))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_up.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(x) for x in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + n for n, _ in placed], pa.int64()), pa.array([at for _, at in placed], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"]
            )

    mixed = F.xxhash64(id_col, "piece", "start", "ids_crc32")
    dealt = cut_up.repartition(int(tasks), mixed).sortWithinPartitions(mixed, id_col, "piece", "start", "ids_crc32")
    return dealt.mapInArrow(run, schema)
