"""Removal of long repeated byte strings by a common-prefix-aware distributed merge sort of suffixes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import batched, partitions, rows

GRAM = 32  # bytes at an anchor; a power of two
SEGMENT = 1 << 23  # window starts handled at once


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    table = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
    h, width, factor = table[data], 1, 0x9E3779B97F4A7C15
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, hash) of runs of windows of ``length`` bytes that begin at ``starts``, ascending places of ``data``.

    A window's anchor is the place in it whose gram has the least hash, the
    leftmost of equals, so equal windows have their anchors at equal distance.
    """
    h = _gram_hashes(data)
    low = (h & np.uint64(~0xFFFFFF & 0xFFFFFFFFFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    change = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (np.diff(starts) != 1)])
    return at[change], starts[change], starts[np.r_[change[1:] - 1, len(starts) - 1]], h[at[change]].view(np.int64)


def text_anchors(texts: list[bytes], length: int, chunk: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, anchors, first starts, last starts, hashes) for each stretch of a text; short texts are handled together."""
    held: list[tuple[int, int]] = []  # text number, offset in it
    parts: list[bytes] = []
    size = 0

    def flush() -> Iterator[tuple]:
        if not parts:
            return
        data = np.frombuffer(b"".join(parts), np.uint8)
        begins = np.cumsum([0, *map(len, parts)])
        starts = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(begins[:-1], begins[1:], strict=True)])
        at, first, last, h = anchors(data, starts, length)
        owner = np.searchsorted(begins, first, side="right") - 1
        cuts = np.searchsorted(owner, np.arange(len(parts) + 1))
        for k, (number, offset) in enumerate(held):
            own = slice(cuts[k], cuts[k + 1])
            move = offset - begins[k]
            yield number, at[own] + move, first[own] + move, last[own] + move, h[own]

    for number, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - length + 1), SEGMENT):
            part = text[offset : offset + SEGMENT + length - 1]
            held.append((number, offset))
            parts.append(part)
            size += len(part)
            if size >= chunk:
                yield from flush()
                held, parts, size = [], [], 0
    yield from flush()


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are equal and not looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - (((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) >> 3)


class LoserTree:
    """Merges sorted runs of (string, prefix in common with the one before, value).

    Each loser remembers how long a prefix it shares with the winner it lost to.
    Of two candidates the one that shares more with the last winner is smaller;
    only when both share as much are bytes compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, object]]]):
        self.runs = runs
        self.size = 1
        while self.size < max(1, len(runs)):
            self.size *= 2
        self.now: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs' strings; what the loser shares with the winner is kept."""
        x, y = self.now[a], self.now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.shared[a], self.shared[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        x, y = x[0], y[0]
        n = common_prefix(x, y, p)
        if len(x) == n or (len(y) > n and x[n] < y[n]):
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        if self.size == 1:
            head = self.now[0]
            if head is not None:
                yield head
                yield from self.runs[0]
            return
        while self.now[self.winner] is not None:
            w = self.winner
            string, _, value = self.now[w]
            yield string, self.shared[w], value
            self.now[w] = nxt = next(self.runs[w], None)
            self.shared[w] = nxt[1] if nxt else 0
            node = (w + self.size) >> 1
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node >>= 1
            self.winner = w


def front_coded(entries: list[tuple[bytes, bytes, int, list[tuple[int, int]]]]) -> tuple[bytes, bytes, bytes, bytes]:
    """A sorted run of (suffix, what stands before it, occurrences, places not yet settled): numbers, suffixes' new bytes, bytes before, places."""
    numbers, new, before, places, last = [], [], [], [], b""
    for right, left, count, where in entries:
        n = common_prefix(last, right)
        numbers += (n, len(right) - n, len(left), count, len(where))
        new.append(right[n:])
        before.append(left)
        places += [x for pair in where for x in pair]
        last = right
    return np.array(numbers, "<u4").tobytes(), b"".join(new), b"".join(before), np.array(places, "<i8").tobytes()


def decoded(numbers: bytes, new: bytes, before: bytes, places: bytes, owners: list) -> Iterator[tuple[bytes, int, tuple[bytes, int, list]]]:
    """The run back: (suffix, prefix shared with the one before, (bytes before it, occurrences, [(owner, place)]))."""
    at = p = q = 0
    last = b""
    where = np.frombuffer(places, "<i8").tolist()
    for n, fresh, left, count, open_ in np.frombuffer(numbers, "<u4").reshape(-1, 5).tolist():
        last = last[:n] + new[at : at + fresh]
        own = where[q : q + 2 * open_]
        yield last, n, (before[p : p + left], count, [(owners[own[i]], own[i + 1]) for i in range(0, 2 * open_, 2)])
        at, p, q = at + fresh, p + left, q + 2 * open_


def repeated_offsets(entries: list[tuple[bytes, int, bytes, int]], length: int, by_pairs: int = 24) -> list[list[tuple[int, int]]]:
    """For entries with one gram at their anchors, the distances (least, greatest) from window start to anchor whose windows occur again.

    An entry is (suffix from the anchor, prefix shared with the entry before,
    bytes before the anchor, occurrences), in order of suffixes. It stands for
    the windows that begin up to len(before) bytes ahead and end within the
    suffix. Of two entries those windows are equal whose part before the anchor
    is shared, and whose part after is.
    """
    lows, highs = [length - len(r) for r, _, _, _ in entries], [len(x) for _, _, x, _ in entries]
    found: list[list[tuple[int, int]]] = [[(lo, hi)] if n > 1 else [] for lo, hi, (_, _, _, n) in zip(lows, highs, entries, strict=True)]
    m = len(entries)
    if m == 1 or all(found):
        return found
    if m <= by_pairs:
        flipped = [x[::-1] for _, _, x, _ in entries]
        for i in range(m):
            shared = length
            for j in range(i + 1, m):
                shared = min(shared, entries[j][1])
                if found[i] and entries[i][3] > 1 and entries[j][3] > 1:
                    continue
                lo, hi = max(lows[i], lows[j], length - shared), min(highs[i], highs[j])
                if lo <= hi and (hi := min(hi, common_prefix(flipped[i], flipped[j]))) >= lo:
                    found[i].append((lo, hi))
                    found[j].append((lo, hi))
        return found
    rights = np.array([e[1] for e in entries])
    flipped = [x[::-1] for _, _, x, _ in entries]
    order = sorted(range(m), key=flipped.__getitem__)
    lefts = np.array([0, *(common_prefix(flipped[a], flipped[b]) for a, b in zip(order, order[1:], strict=False))])
    order, lows_, highs_ = np.array(order), np.array(lows), np.array(highs)
    for o in range(min(lows), max(highs) + 1):
        left = np.empty(m, np.int64)
        left[order] = np.cumsum(lefts < o)
        here = np.flatnonzero((lows_ <= o) & (o <= highs_))
        key = np.cumsum(rights < length - o)[here] * (m + 1) + left[here]
        _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
        for i in here[counts[which] > 1].tolist():
            if found[i] and found[i][-1][1] >= o - 1:
                if found[i][-1][1] < o:
                    found[i][-1] = (found[i][-1][0], o)
            else:
                found[i].append((o, o))
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, flush_bytes: int = 32 << 20) -> DataFrame:
    """Remove every byte that a string of ``length`` bytes covers which also starts elsewhere in any text.

    Returns id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept
    (bytes left). Texts count as UTF-8, null as empty; matches never cross texts
    and are judged on the input. Ids may be null or repeat; rows that repeat an
    id and a text are copies of one another. No rows give no rows.

    1. Each window of ``length`` bytes has an anchor in it, chosen by its content
       alone, and windows in a row share theirs. A window that occurs twice has
       an anchor whose gram does; only suffixes at such anchors are sorted. That
       drops none: it is an exact filter. A gram that a stretch of rows has twice
       is known to repeat; one row in place of all goes on to the gram's task.
    2. Tasks sort the suffixes at their anchors and merge equal ones into one. Of
       one with several places all windows repeat: they are settled at once, and
       the suffix goes on without them. Front-coded runs go to the task of the
       gram's hash. So a passage that very many rows have sends there at most one
       place for each stretch of rows that a task sorts.
    3. There a loser tree that never compares a known prefix merges the runs.
       Neighbours tell what each suffix shares with others to the right of its
       anchor; what stands before the anchor tells the rest.
    4. The texts take back their intervals and drop them.
    """
    spark = docs.sparkSession
    n_parts = partitions(spark)
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, id_ddl = to_arrow_type(kind), kind.simpleString()
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tx"), text.cast("binary").alias("raw"))
    gram_schema = pa.schema([("id", id_type), ("tx", pa.int64()), ("gram", pa.int64()), ("kind", pa.int32())])
    single, known, stands_in = 0, 1, 2

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tx = batch.column(0), batch.column(1)
            for part in _stretches(batch.column(2)):
                found = [(number, h) for number, _, _, _, h in text_anchors(part[1], length)]
                if found:
                    take = pa.array(np.repeat([part[0] + n for n, _ in found], [len(h) for _, h in found]))
                    h = np.concatenate([h for _, h in found])
                    unique, which, counts = np.unique(h, return_inverse=True, return_counts=True)
                    kind = np.where(counts[which] > 1, known, single).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([ids.take(take), tx.take(take), pa.array(h), pa.array(kind)], schema=gram_schema)
                    more = unique[counts > 1]
                    if len(more):
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(more), id_type), pa.array(np.zeros(len(more), np.int64)), pa.array(more), pa.array(np.full(len(more), stands_in, np.int32))], schema=gram_schema)

    place = F.when(F.col("kind") == known, F.xxhash64("id", "tx", "gram")).otherwise(F.col("gram"))
    by_gram = Window.partitionBy("place").orderBy("id", "tx")
    again = (F.col("kind") == known) | F.lag("tx").over(by_gram).isNotNull() | F.lead("tx").over(by_gram).isNotNull()
    found = texts.mapInArrow(grams, f"id {id_ddl}, tx long, gram long, kind int").withColumn("place", place).withColumn("again", again).where(F.col("again") & (F.col("kind") != stands_in))
    hits = found.groupBy("id", "tx").agg(F.collect_set("gram").alias("grams"))  # as many as a text has anchors

    run_schema = pa.schema([("part", pa.int32()), ("ids", pa.list_(id_type)), ("txs", pa.list_(pa.int64())), ("numbers", pa.binary()), ("new", pa.binary()), ("before", pa.binary()), ("places", pa.binary())])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: dict, owners: list, turn: int) -> Iterator[pa.RecordBatch]:
            settled = []
            for part, held in parts.items():
                settled += [x for (right, left), where in held.items() if len(where) > 1 for o, at in where for x in (o, at - len(left), at + len(right))]
                entries = sorted((right, left, min(2, len(where)), where if len(where) == 1 else []) for (right, left), where in held.items())
                used = sorted({o for *_, where in entries for o, _ in where})
                number = {o: i for i, o in enumerate(used)}
                entries = [(r, x, n, [(number[o], at) for o, at in where]) for r, x, n, where in entries]
                row = (part, [owners[o][0] for o in used], [owners[o][1] for o in used], *front_coded(entries))
                yield from batched(iter([row]), run_schema)
            if settled:  # a row without a run: (owner, begin, end) of what repeats
                row = (turn % n_parts, [o[0] for o in owners], [o[1] for o in owners], b"", b"", b"", np.array(settled, "<i8").tobytes())
                yield from batched(iter([row]), run_schema)

        turn = TaskContext.get().partitionId()
        parts, owners, size = {}, [], 0
        for key_, tx, raw, hit in rows(batches):
            hit = np.array(hit, np.int64)
            for _, at, first, last, h in text_anchors([raw], length):
                chosen = np.isin(h, hit)
                for a, s, e, g in zip(at[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist(), h[chosen].tolist(), strict=True):
                    right, left = raw[a : e + length], raw[s:a]
                    parts.setdefault(g % n_parts, {}).setdefault((right, left), []).append((len(owners), a))
                    size += len(right) + len(left) + 200
            owners.append((key_, tx))
            if size > flush_bytes:
                yield from flush(parts, owners, turn)
                parts, owners, size, turn = {}, [], 0, turn + 1
        yield from flush(parts, owners, turn)

    wanted = texts.join(hits.withColumnsRenamed({"id": "h_id", "tx": "h_tx"}), F.col("id").eqNullSafe(F.col("h_id")) & (F.col("tx") == F.col("h_tx")))
    runs = wanted.select("id", "tx", "raw", "grams").mapInArrow(sort, f"part int, ids array<{id_ddl}>, txs array<long>, numbers binary, new binary, before binary, places binary")
    span_schema = pa.schema([("s_id", id_type), ("s_tx", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for _, group in groupby(rows(batches), key=lambda r: r[0]):
                runs_ = []
                for _, ids, txs, numbers, new, before, places in group:
                    owners = list(zip(ids, txs, strict=True))
                    if numbers:
                        runs_.append(decoded(numbers, new, before, places, owners))
                    else:
                        yield from ((*owners[o], lo, hi) for o, lo, hi in np.frombuffer(places, "<i8").reshape(-1, 3).tolist())
                yield from spans(runs_)

        yield from batched(each(), span_schema, 8192)

    def spans(parts: list) -> Iterator[tuple]:
        held: list[tuple] = []

        def done() -> Iterator[tuple]:
            merged: dict[tuple[bytes, bytes], list] = {}
            shared: dict[tuple[bytes, bytes], int] = {}
            counts: dict[tuple[bytes, bytes], int] = {}
            least = length
            for right, n, (left, count, where) in held:
                least = min(least, n)
                if (right, left) in merged:
                    merged[right, left].extend(where)
                    counts[right, left] += count
                else:
                    merged[right, left], shared[right, left], counts[right, left] = list(where), least, count
                    least = length + 1
            if len(merged) == 1 and next(iter(counts.values())) == 1:
                return
            entries = [(r, min(shared[r, x], length), x, counts[r, x]) for r, x in merged]
            for where, offsets in zip(merged.values(), repeated_offsets(entries, length), strict=True):
                for lo, hi in offsets:
                    for (id_, tx), at in where:
                        yield id_, tx, at - hi, at - lo + length

        for right, n, value in LoserTree(parts):
            if n < GRAM and held:
                yield from done()
                held = []
            held.append((right, n, value))
        if held:
            yield from done()

    covered = runs.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(merge, f"s_id {id_ddl}, s_tx long, lo long, hi long")
    covered = covered.distinct().groupBy("s_id", "s_tx").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # a few for each anchor of a text
    out_schema = pa.schema([("id", id_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for id_, raw, spans_ in rows(batches):
                kept, at, count = [], 0, 0
                for s in sorted((x["lo"], x["hi"]) for x in spans_ or ()):
                    if s[0] > at or not count:
                        kept.append(raw[at : s[0]])
                        count += 1
                    at = max(at, s[1])
                kept.append(raw[at:])
                left = b"".join(kept)
                yield id_, len(raw), len(raw) - len(left), count, left

        yield from batched(each(), out_schema, 256)

    both = texts.join(covered, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("tx") == F.col("s_tx")), "left")
    return both.select("id", "raw", "spans").mapInArrow(drop, f"id {id_ddl}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def _stretches(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) for stretches of a column of about ``most`` bytes."""
    begin, held, size = 0, [], 0
    for number, raw in enumerate(column.to_pylist()):
        held.append(raw or b"")
        size += len(held[-1])
        if size >= most:
            yield begin, held
            begin, held, size = number + 1, [], 0
    yield begin, held
