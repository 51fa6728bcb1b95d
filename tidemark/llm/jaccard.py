"""Exact Jaccard join of word-shingle sets by signature trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import batched, partitions, rows, saved
from .components import connected
from .sieve import Bloom, bits_for, sifted
from .words import WordHashes, shingles


_LOW = 0xFFFFFFFF


def least_overlap(n: int, percent: int) -> int:
    """A set of n that reaches ``percent`` with another shares so many members at least."""
    return -(-n * percent // 100)


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """(other columns..., set) of rows whose last column is a text's bytes."""
    cache = WordHashes()
    for *others, raw in rows(batches):
        yield *others, shingles(cache.of((raw or b"").lower().split()), k)


def _class(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _half(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def signature(found: np.ndarray, each: int = 4) -> bytes:
    """Bitmap of a set: member m sets bit m mod ``each`` s, s being the set's size rounded up to a power of two."""
    bits = max(64, each << (len(found) - 1).bit_length())
    marks = np.zeros(bits, np.uint8)
    marks[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(marks, bitorder="little").tobytes()


class Node:
    """Of a signature tree: OR of the members' bitmaps, range of their sizes, and the most that a size exceeds the count of bits; the bitmaps and the excess both in full and folded to half the bits."""

    __slots__ = ("full", "excess", "half", "half_excess", "least", "most", "children", "leaf", "bits", "single")

    def __init__(self, full: int, excess: int, half: int, half_excess: int, least: int, most: int, children: list, leaf: int, bits: int):
        self.full, self.excess, self.half, self.half_excess = full, excess, half, half_excess
        self.least, self.most, self.children, self.leaf, self.bits = least, most, children, leaf, bits
        self.single = not children  # whether all members are known to be in one component


def leaf(number: int, n: int, bitmap: bytes) -> Node:
    bits = 8 * len(bitmap)
    full = int.from_bytes(bitmap, "little")
    half = (full >> (bits // 2)) | (full & ((1 << (bits // 2)) - 1))
    return Node(full, n - full.bit_count(), half, n - half.bit_count(), n, n, [], number, bits)


def trees(leaves: list[tuple[int, Node]], fan: int = 8) -> list[Node]:
    """The roots of trees over (order, leaf), one for each width of bitmaps; leaves of like size and order lie together."""
    roots = []
    for _, group in groupby(sorted(leaves, key=lambda x: (x[1].bits, x[1].most.bit_length(), 16 * x[1].most >> x[1].most.bit_length(), x[0], x[1].leaf)), key=lambda x: x[1].bits):
        level = [node for _, node in group]
        while len(level) > 1:
            joined = []
            for i in range(0, len(level), fan):
                part = level[i : i + fan]
                full = half = 0
                for x in part:
                    full, half = full | x.full, half | x.half
                joined.append(Node(full, max(x.excess for x in part), half, max(x.half_excess for x in part), min(x.least for x in part), max(x.most for x in part), part, part[0].leaf, part[0].bits))
            level = joined
        roots += level
    return roots


class Traversal:
    """Dual traversal of signature trees, node pair by node pair.

    A pair of nodes is left out when no two members can reach ``percent`` of
    each other: by their sizes, or because the bits in common plus the excess
    over bits bound the overlap. Widths of bitmaps that differ more than twofold
    are of sizes that cannot link. With ``skip_connected`` a pair is left out too
    when all members of both are known to be in one component: components are
    then complete, but not every link within one is reported. ``check`` decides
    on two leaves; without one, those that might link count as linked.
    """

    def __init__(self, count: int, percent: int, skip_connected: bool, check=None):
        self.percent, self.skip, self.check = percent, skip_connected, check
        self.parent = list(range(count))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def one(self, node: Node) -> bool:
        if not node.single:
            root = self.find(node.leaf)
            node.single = all(self.one(x) and self.find(x.leaf) == root for x in node.children)
        return node.single

    def alone(self, node: Node) -> None:
        """All pairs within a node, those of the lowest nodes first."""
        for child in node.children:
            self.alone(child)
        for i, a in enumerate(node.children):
            for b in node.children[i + 1 :]:
                self.pair(a, b)

    def pair(self, a: Node, b: Node) -> None:
        """All pairs of a member of a and one of b."""
        p, stack = self.percent, [(a, b)]
        while stack:
            a, b = stack.pop()
            if 100 * a.most < p * b.least or 100 * b.most < p * a.least:
                continue
            if a.bits == b.bits:
                common, most_a, most_b = (a.full & b.full).bit_count(), a.excess, b.excess
            elif a.bits == 2 * b.bits:
                common, most_a, most_b = (a.half & b.full).bit_count(), a.half_excess, b.excess
            elif b.bits == 2 * a.bits:
                common, most_a, most_b = (a.full & b.half).bit_count(), a.excess, b.half_excess
            else:
                continue
            if (100 + p) * min(a.most, b.most, most_a + common, most_b + common) < p * (a.least + b.least):
                continue
            if self.skip and self.find(a.leaf) == self.find(b.leaf) and self.one(a) and self.one(b):
                continue
            if a.children and (not b.children or a.most - a.least >= b.most - b.least):
                stack += [(x, b) for x in a.children]
            elif b.children:
                stack += [(a, x) for x in b.children]
            elif self.check is None or self.check(a.leaf, b.leaf):
                self.links.append((a.leaf, b.leaf))
                self.parent[self.find(a.leaf)] = self.find(b.leaf)


def tree_links(items: list[tuple[int, int, bytes, int]], percent: int, skip_connected: bool, check=None) -> list[tuple[int, int]]:
    """Linked pairs of items (side, size, bitmap, order): of side 0 with side 1 or, if there is no side 1, within side 0."""
    walk = Traversal(len(items), percent, skip_connected, check)
    sides = [trees([(order, leaf(i, n, bitmap)) for i, (side, n, bitmap, order) in enumerate(items) if side == s]) for s in (0, 1)]
    if sides[1]:
        for a in sides[0]:
            for b in sides[1]:
                walk.pair(a, b)
    else:
        for i, a in enumerate(sides[0]):
            walk.alone(a)
            for b in sides[0][i + 1 :]:
                walk.pair(a, b)
    return walk.links


def stars(names: list[bytes], pairs: list[tuple[int, int]]) -> Iterator[tuple[bytes, bytes]]:
    """For each name that pairs connect to a lesser one: itself and the least."""
    parent = {}

    def find(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b, key=names.__getitem__)] = min(a, b, key=names.__getitem__)
    yield from ((names[i], names[find(i)]) for i in list(parent) if find(i) != i)


def linked(sets: list[np.ndarray], percent: int):
    """A check of two places in ``sets`` by exact intersection."""

    def check(i: int, j: int) -> bool:
        x, y = sets[i], sets[j]
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return check


def _duties(placed: DataFrame, percent: int, block_members: int, columns: list[str]) -> DataFrame:
    """Which task each class of ``placed`` (cls, n, unit, ...) works in: ``columns``, work, side.

    A unit of up to ``block_members`` members is one task's. A larger one is
    split by size class, and a size class by hash, into blocks; each block meets
    itself and those of its own and the next size class.
    """
    width = math.log(100 / percent) * 1.0001 if percent < 100 else 1.0
    placed = placed.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    big = placed.groupBy("unit").agg(F.sum("n").alias("unit_n")).where(F.col("unit_n") > block_members).select("unit")
    split = placed.groupBy("unit", "band").agg(F.ceil(F.sum("n") / block_members).cast("int").alias("salts")).join(big, "unit", "left_semi")
    blocked = placed.join(split, ["unit", "band"], "left").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int"))
    blocked = saved(blocked.select(*columns, "unit", "band", "salt"), "shingle-blocks")
    halls = blocked.where("salt is not null").select("unit", "band", "salt").distinct()
    a, b = halls.alias("a"), halls.alias("b")
    later = (F.col("a.band") < F.col("b.band")) | (F.col("a.salt") <= F.col("b.salt"))
    meet = a.join(b, (F.col("a.unit") == F.col("b.unit")) & (F.col("b.band") - F.col("a.band")).between(0, 1) & later)
    ends = [F.struct(F.col(f"{x}.band").alias("band"), F.col(f"{x}.salt").alias("salt"), F.lit(side).alias("side")) for side, x in enumerate("ab")]
    itself = (F.col("a.band") == F.col("b.band")) & (F.col("a.salt") == F.col("b.salt"))
    work = F.concat_ws("/", "a.unit", "a.band", "a.salt", "b.band", "b.salt")
    meet = meet.select(work.alias("work"), F.col("a.unit").alias("unit"), F.explode(F.when(itself, F.array(ends[0])).otherwise(F.array(*ends))).alias("end")).select("work", "unit", "end.*")
    small = blocked.where("salt is null").select(*columns, F.col("unit").cast("string").alias("work"), F.lit(0).alias("side"))
    return small.unionByName(blocked.where("salt is not null").join(meet, ["unit", "band", "salt"]).select(*columns, "work", "side"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90, skip_connected: bool = True, block_members: int = 2_000_000, few: int = 64, sieve_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets and the links between them.

    Returns (members, links): members has a row a row of ``docs``: id, cls (of
    its set; null for an empty set) and n_shingles; links has pairs a, b of cls
    with ``100 * |a & b| >= percent * |a | b|``, all of them; with
    ``skip_connected`` it has instead each class and the least that links within
    a task connect it to, which leads to the same components.

    1. Two sets that link share one of their first ``n - least_overlap(n) + 1``
       members in any order common to all sets. The order used is by hash, with
       members last that more than one of these prefixes has, by a Bloom filter
       of at most ``sieve_bits`` bits; if they are too many for it, those that
       most have. So members that come together by chance bring no sets together.
    2. The sets that share such a member, in order of size, part where the next
       is too large to link. Up to ``few`` of them are a group of their own;
       groups of the same sets, which near copies have many of, are one. Larger
       ones, which are of mass copies, join where they have a set in common: each
       set is in one such unit. So work grows with the rows, not their square. A
       unit with more than ``block_members`` members is split by size class and
       hash into blocks, and only blocks of equal or adjacent size classes meet.
    3. A task builds signature trees over the bitmaps of a group or unit, or of
       two blocks that meet, and traverses them. Those that might link make finer
       units.
    4. The sets of these alone are gathered, and the trees traversed again with
       exact intersection at the leaves. Texts of other rows do not move: a Bloom
       filter of at most ``sieve_bits`` bits keeps them back (where more ids are
       wanted than it can tell apart, all texts go to the join).
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark = docs.sparkSession
    n_parts = partitions(spark)
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))
    first_schema = pa.schema([("id", id_type), ("cls", pa.binary()), ("n_shingles", pa.int64()), ("prefix", pa.list_(pa.int64())), ("least", pa.int64()), ("sketch", pa.binary()), ("bitmap", pa.binary())])

    def prefix_length(n: int) -> int:
        return n - least_overlap(n, percent) + 1

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for key, found in _sets(batches, k):
                n = len(found)
                if n:
                    yield key, _class(found), n, found[: prefix_length(n) * 5 // 4].view(np.int64), int(found[0] >> np.uint64(1)), signature(found, 1), signature(found)
                else:
                    yield key, None, 0, [], None, None, None

        yield from batched(each(), first_schema, 256)

    read = saved(texts.mapInArrow(first, f"id {kind.simpleString()}, cls binary, n_shingles long, prefix array<long>, least long, sketch binary, bitmap binary"), "shingle-sets")
    members = read.select("id", "cls", "n_shingles")

    # Counted by 32 bits of the hash: any order common to all sets will do.
    counts = read.select(F.explode("prefix").alias("member")).groupBy(F.col("member").bitwiseAND(F.lit(_LOW)).alias("member")).agg(F.count("*").alias("times"))
    often = saved(counts.where("times > 1"), "shingle-often")
    least, n_common, fits = 4096, 0, max(1, sieve_bits // 8)
    for times, found in sorted((tuple(r) for r in often.groupBy(F.least("times", F.lit(least))).count().collect()), reverse=True):  # 4095 rows at most
        if n_common and n_common + found > fits:
            break
        least, n_common = times, n_common + found
    shared_common = spark.sparkContext.broadcast(Bloom(often.where(F.col("times") >= least), F.col("member"), bits_for(n_common, sieve_bits)))
    token_schema = pa.schema([("half", pa.int64()), ("member", pa.int64()), ("n", pa.int64())])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared_common.value

        def made() -> pa.RecordBatch:
            lengths = [len(x) for x in held]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(names, np.int64), lengths)), pa.array(np.concatenate(held).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int64), lengths))], schema=token_schema)

        seen: set[int] = set()
        held, names, sizes, count = [], [], [], 0
        for (found,) in _sets(batches, k):
            n = len(found)
            name = _half(_class(found)) if n else None
            if not n or name in seen:  # copies of one text say the same
                continue
            if len(seen) >= 200_000:
                seen.clear()
            seen.add(name)
            p = prefix_length(n)
            often = common.has(found)
            held.append(np.concatenate([found[~often], found[often]])[:p] if often[:p].any() else found[:p])
            names.append(name)
            sizes.append(n)
            count += p
            if count > 100_000:
                yield made()
                held, names, sizes, count = [], [], [], 0
        if held:
            yield made()

    # In order of size, sets that share the member part where the next is too large to link.
    by_size = Window.partitionBy("member").orderBy("n", "half")
    tokens = texts.select("raw").mapInArrow(second, "half long, member long, n long")
    tokens = tokens.withColumn("again", F.lag("half").over(by_size)).where("again is null or again != half")
    apart = F.coalesce((F.lag("n").over(by_size) * 100 < F.col("n") * percent).cast("int"), F.lit(0))
    tokens = tokens.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("member", "run")
    leader = F.first("half").over(run.orderBy("n", "half").rowsBetween(Window.unboundedPreceding, 0))
    # A run's name is that of its sets: runs of the same sets have the same, but for accidents of 2**-64.
    names = F.sum(F.xxhash64("half").cast("decimal(20,0)")).over(run)
    shared = tokens.withColumn("size", F.count("*").over(run)).where("size > 1").withColumn("before", leader)
    hot = F.col("size") > few
    shared = shared.select("half", F.when(hot, F.lit(None)).otherwise(F.xxhash64(names, "size")).alias("group"), F.when(hot, F.col("before")).alias("before"))
    shared = saved(shared.distinct(), "shingle-shared")
    units = connected(shared.where("before is not null"), "half", "before")
    groups = shared.where("group is not null").select("half", "group")

    # of each class its row with the least id; its bitmaps go along
    halves = saved(shared.select("half").distinct(), "shingle-halves")
    named = read.where("cls is not null").withColumn("half", _half_column("cls"))
    named = sifted(named, "half", halves, "half", sieve_bits).join(halves, "half", "left_semi")
    columns = [F.first(x).alias(x) for x in ("half", "n_shingles", "least", "sketch", "bitmap")]
    classes = saved(named.groupBy("cls").agg(F.min("id").alias("id"), *columns).withColumnRenamed("n_shingles", "n"), "shingle-classes")
    link_schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for _, group in groupby(rows(batches), key=lambda r: r[0]):
                held = list(group)
                yield from stars([x[2] for x in held], tree_links([(side, n, bitmap, low) for _, side, _, n, low, bitmap in held], percent, True))

        yield from batched(each(), link_schema)

    def might_link(dealt: DataFrame, work: str, name: str) -> DataFrame:
        return saved(dealt.repartition(n_parts, work).sortWithinPartitions(work).mapInArrow(possible, "a binary, b binary"), name)

    found = [might_link(groups.join(classes, "half").select("group", F.lit(0).alias("side"), "cls", "n", "least", "sketch"), "group", "shingle-pairs")]
    if not units.isEmpty():
        duty = _duties(classes.join(units.withColumnRenamed("node", "half"), "half").withColumnRenamed("root", "unit"), percent, 8 * block_members, ["cls", "n", "least", "bitmap"])
        found.append(might_link(duty.select("work", "side", "cls", "n", "least", "bitmap"), "work", "shingle-pairs"))
    maybe = connected(reduce(DataFrame.unionByName, found))

    set_schema = pa.schema([("cls", pa.binary()), ("work", pa.string()), ("side", pa.int32()), ("members", pa.binary())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for name, duties, found in _sets(batches, k):
                if len(found) and _class(found) == name:
                    for d in duties:
                        yield name, d["work"], d["side"], found.tobytes()

        yield from batched(each(), set_schema, 64)

    # A class has as many duties as blocks meet its own: one, unless its unit is large.
    finer = classes.select("cls", "id", "n").join(maybe.withColumnRenamed("node", "cls"), "cls").select("cls", "id", "n", F.hex("root").alias("unit"))
    duties = _duties(finer, percent, block_members, ["cls", "id"]).groupBy("cls", F.col("id").alias("d_id")).agg(F.collect_list(F.struct("work", "side")).alias("duties"))
    duties = saved(duties, "shingle-duties")
    # Most texts have no duty: a filter of bounded size keeps them from the exchange.
    near = sifted(texts, "id", duties, "d_id", sieve_bits)
    fetched = near.join(duties, F.col("id").eqNullSafe(F.col("d_id"))).select("cls", "duties", "raw").mapInArrow(fetch, "cls binary, work string, side int, members binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for _, group in groupby(rows(batches), key=lambda r: r[0]):
                held = {(name, side): raw for _, name, side, raw in group}  # rows that repeat an id and a text came more than once
                names = [name for name, _ in held]
                found = [np.frombuffer(raw, np.uint64) for raw in held.values()]
                items = [(side, len(x), signature(x), int(x[0])) for (_, side), x in zip(held, found, strict=True)]
                found_links = tree_links(items, percent, skip_connected, linked(found, percent))
                yield from stars(names, found_links) if skip_connected else ((names[i], names[j]) for i, j in found_links)

        yield from batched(each(), link_schema)

    dealt = fetched.select("work", "cls", "side", "members").repartition(n_parts, "work").sortWithinPartitions("work")
    links = saved(dealt.mapInArrow(join, "a binary, b binary"), "shingle-links")
    return members, links


def _half_column(name: str):
    """:func:`_half` of a binary column: its first 8 bytes as a little-endian long."""
    low = [F.conv(F.hex(F.substring(name, i, 1)), 16, 10).cast("long") for i in range(1, 9)]
    out = low[0]
    for i in range(1, 8):
        out = out.bitwiseOR(F.shiftleft(low[i], 8 * i))
    return out


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, **options) -> DataFrame:
    """Components of documents whose word-shingle sets link: id_col, n_shingles, component_id.

    Words are runs of bytes other than space and tab to carriage return, A-Z
    lower-cased; a set holds the distinct runs of k words, as 64-bit hashes, or
    the whole sequence if it is shorter. component_id is the least id that links
    reach, the row's own included. Null or empty texts and texts without words
    have no set and no links. Rows that repeat are equal texts and linked. A null
    id counts as greater than any other. No rows give no rows.
    """
    members, links = jaccard_links(docs, id_col, text_col, k, percent, **options)
    roots = connected(links)
    labelled = members.join(roots, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("root", "cls"))
    least = labelled.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id"))
    return labelled.join(least, "label", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
