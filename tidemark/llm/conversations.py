"""Conversation repair: the cheapest edits that leave turns in order, found by a DP over the turns that stay."""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batched, partitions, rows, saved

#: Bytes of UTF-8 between words are space and tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT = 2, 3, 2
#: Roles of turns that stay: none so far, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NAMES, STATES = ("\0\0", "system", "user", "assistant"), range(4)
#: Turns to insert between one that stays and the next, or the end: roles alternate from user to assistant.
BETWEEN = {(NONE, SYSTEM): (), (NONE, USER): (), (NONE, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,), (USER, USER): (ASSISTANT,), (USER, ASSISTANT): (), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,)}
AT_END = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}

LEGAL = {"su", "ua", "au"}

_STRETCH = pa.schema([("conv", pa.string()), ("missing", pa.bool_()), ("block", pa.int64()), ("first", pa.int32()), ("initials", pa.string()), ("faults", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("turns", pa.list_(pa.int64()))])
_STRETCH_SQL = "conv string, missing boolean, block long, first int, initials string, faults string, costs array<long>, ranks array<int>, turns array<long>"
_PLAN_SQL = "conv string, missing boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, ways array<struct<block: bigint, start: int, end: int, last: boolean>>"
_PLAN = pa.schema([("conv", pa.string()), ("missing", pa.bool_()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("ways", pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("last", pa.bool_())])))])
_TURN_SQL = "conv string, missing boolean, block long, nth int, edit string, turn long, role string, text string"
_TURN = pa.schema([("conv", pa.string()), ("missing", pa.bool_()), ("block", pa.int64()), ("nth", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_WHOLE = pa.schema([("conv", pa.string()), ("missing", pa.bool_()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class Choice(NamedTuple):
    """The best way to a state: its cost less the deletions before it, the rank of its audit, the state it came from and the letters added since."""

    cost: int
    rank: int
    before: int
    letters: str


def _ranked(found: dict[int, tuple[int, int, int, str]]) -> dict[int, Choice]:
    """Rank audits by (rank of the former audit, letters added). No audit of as many turns is a proper prefix of another, so former ranks decide where they differ."""
    order = {x: i for i, x in enumerate(sorted({(rank, letters) for _, rank, _, letters in found.values()}))}
    return {state: Choice(cost, order[rank, letters], before, letters) for state, (cost, rank, before, letters) in found.items()}


def _step(best: dict[int, Choice], initial: str, fault: str) -> dict[int, tuple[int, int, int, str]]:
    """Ways to each state after one more turn, from the running minima before it. Costs are less the prefix sum of deletions, so to delete the turn changes none."""
    found = {state: (x.cost, x.rank, state, "D") for state, x in best.items()}
    if fault in "BD":
        return found
    for state in (SYSTEM, USER, ASSISTANT):
        kept = initial == NAMES[state][0]
        if state == SYSTEM and not kept:
            continue
        own = (0 if kept else REROLE) + (fault == "T") - DELETE
        for former, x in best.items():
            if (between := BETWEEN.get((former, state))) is None:
                continue
            way = (x.cost + INSERT * len(between) + own, x.rank, former, "I" * len(between) + ("K" if kept else "R"))
            if state not in found or (way[0], way[1], way[3]) < (found[state][0], found[state][1], found[state][3]):
                found[state] = way
    return found


def _walk(start: int, initials: str, faults: str) -> Iterator[dict[int, Choice]]:
    """Running minima after each turn of a stretch that begins in state ``start``."""
    best = {start: Choice(0, 0, start, "")}
    for initial, fault in zip(initials, faults, strict=True):
        best = _ranked(_step(best, initial, fault))
        yield best


def _audit(start: int, end: int, initials: str, faults: str) -> tuple[str, list[int]]:
    """Letters of the best way through a stretch, and the states after each turn."""
    steps = list(_walk(start, initials, faults))
    letters, states, state = [], [], end
    for step in reversed(steps):
        letters.append(step[state].letters)
        states.append(state)
        state = step[state].before
    return letters[::-1], states[::-1]


def _matrix(initials: str, faults: str) -> tuple[list[int | None], list[int | None]]:
    """Costs from each state before a stretch to each after it, and the order of their audits; stretches compose by these alone."""
    ways = {}
    for start in STATES:
        last = {}
        for last in _walk(start, initials, faults):
            pass
        for end, x in last.items():
            ways[start, end] = (x.cost + DELETE * len(initials), "".join(_audit(start, end, initials, faults)[0]))
    order = {x: i for i, x in enumerate(sorted({x for _, x in ways.values()}))}
    pairs = [(a, b) for a in STATES for b in STATES]
    return [ways[p][0] if p in ways else None for p in pairs], [order[ways[p][1]] if p in ways else None for p in pairs]


def _joined(stretches: list[tuple[list, list]]) -> tuple[int, list[int]]:
    """Cost of a conversation, and the states between its stretches."""
    best = {NONE: Choice(0, 0, NONE, "")}
    back = []
    for costs, ranks in stretches:
        found: dict[int, tuple] = {}
        for former, x in best.items():
            for state in STATES:
                cost, rank = costs[4 * former + state], ranks[4 * former + state]
                if cost is not None and (state not in found or (x.cost + cost, x.rank, rank) < (found[state][0], found[state][1], found[state][3])):
                    found[state] = (x.cost + cost, x.rank, former, rank)
        best = _ranked(found)
        back.append(best)
    state = min(best, key=lambda s: (best[s].cost + INSERT * len(AT_END[s]), best[s].rank, len(AT_END[s])))
    states, cost = [state], best[state].cost + INSERT * len(AT_END[state])
    for step in reversed(back):
        states.append(step[states[-1]].before)
    return cost, states[::-1]


def damage(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Damaged turns, to try repairs on: conv, turn, role, text, under the columns' own names.

    crc32(``conv:turn``) % 20 decides: 0 drops the turn, 1 empties its text, 2
    removes full stops, exclamation and question marks, 3 repeats it, 4 makes the
    role user. Nulls count as one space, but for the columns of conversation and
    turn, which stay. No rows give no rows.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.pmod(F.crc32(F.concat(filled(conv_col), F.lit(":"), filled(turn_col)).cast("binary")), F.lit(20))
    text = F.when(lot == 1, "").when(lot == 2, F.regexp_replace(filled(text_col), "[.!?]", "")).otherwise(filled(text_col))
    hurt = conversations.select(
        F.col(conv_col), F.col(turn_col), F.when(lot == 4, "user").otherwise(filled(role_col)).alias(role_col), text.alias(text_col), F.when(lot == 3, 2).otherwise(1).alias("_times"), (lot == 0).alias("_lost")
    )
    return hurt.where("not _lost").withColumn("_times", F.explode(F.sequence(F.lit(1), "_times"))).drop("_times", "_lost")


def _numbered(block_rows: int, block_bytes: int):
    """Number the sorted turns of a task: blocks of bounded rows and bytes, and places in a block."""
    schema = pa.schema([("conv", pa.string()), ("missing", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("block", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            blocks, places = [], []
            for size in batch["size"].to_pylist():
                if at >= block_rows or at and held + size > block_bytes:
                    block, at, held = block + 1, 0, 0
                blocks.append(block)
                places.append(at)
                at, held = at + 1, held + size
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("conv", "missing", "turn", "role", "text")), pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], schema=schema)

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of each conversation in each block as one row: initials, faults, costs between states, and the first, last and number of distinct turns."""

    @functools.lru_cache(4096)
    def matrix(initials: str, faults: str) -> tuple[list, list]:
        return _matrix(initials, faults)

    def found() -> Iterator[tuple]:
        for key, turns in itertools.groupby(rows(batches), lambda x: x[:3]):
            held = [x[3:] for x in turns]  # no more than a block's
            initials, faults = "".join(x[2] or "\0" for x in held), "".join(x[3] for x in held)
            seen = [x[0] for x in held if x[0] is not None]
            ends = [seen[0], seen[-1], 1 + sum(a != b for a, b in itertools.pairwise(seen))] if seen else None
            yield (*key, held[0][1], initials, faults, *matrix(initials, faults), ends)

    return batched(found(), _STRETCH)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and cost of each conversation, and the states in which the best way enters and leaves its stretches. A stretch is a few numbers here."""

    def found() -> Iterator[tuple]:
        for key, parts in itertools.groupby(rows(batches), lambda x: x[:2]):
            parts = [x[2:] for x in parts]
            blank, duplicate, truncated, illegal = (sum(x[i] for x in parts) for i in range(3, 7))
            illegal += sum(a[2] + b[1] not in LEGAL for a, b in itertools.pairwise(parts))
            turns = [x[9] for x in parts if x[9] is not None]
            gaps = turns[-1][1] - turns[0][0] + 1 - sum(x[2] for x in turns) + sum(a[1] == b[0] for a, b in itertools.pairwise(turns)) if turns else 0
            cost, states = _joined([(x[7], x[8]) for x in parts])
            ways = [{"block": x[0], "start": a, "end": b, "last": i == len(parts)} for i, (x, (a, b)) in enumerate(zip(parts, itertools.pairwise(states), strict=True), 1)]
            yield (*key, gaps, blank, duplicate, truncated, illegal, cost, ways)

    return batched(found(), _PLAN)


def _rewrite(ways: pa.Table, turns: pa.Table) -> pa.Table:
    """The turns of a block as the best way leaves them, edits and all."""
    turns = turns.sort_by("at")
    turn, role, text = (turns[c].to_pylist() for c in ("turn", "role", "text"))
    out: list[tuple] = []
    for w in ways.to_pylist():
        steps, states = _audit(w["start"], w["end"], w["initials"], w["faults"])
        key, nth, former = (w["conv"], w["missing"], w["block"]), itertools.count(), w["start"]
        for i, (letters, state) in enumerate(zip(steps, states, strict=True), w["first"]):
            out += [(*key, next(nth), "I", None, NAMES[x], "") for x in BETWEEN.get((former, state), ()) if letters != "D"]
            edit = letters[-1]
            out.append((*key, next(nth), edit, turn[i], NAMES[state] if edit == "R" else role[i], text[i]))
            former = state
        if w["last"]:
            out += [(*key, next(nth), "I", None, NAMES[x], "") for x in AT_END[w["end"]]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_TURN), _TURN, strict=True)], schema=_TURN)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and hash of each conversation, turn by turn: a task holds one turn at a time."""

    def found() -> Iterator[tuple]:
        for key, turns in itertools.groupby(rows(batches), lambda x: x[:2]):
            sha, audit, begun = hashlib.sha256(), io.StringIO(), False
            for _, _, edit, role, text in turns:
                audit.write(edit)
                if edit != "D":
                    sha.update(f"{'\n' if begun else ''}{role}:{text}".encode())
                    begun = True
            yield (*key, audit.getvalue(), sha.hexdigest())

    return batched(found(), _WHOLE)


def _planned(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, block_rows: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(a row a conversation with its counts, cost and ways; every turn as repaired, with its edit): both saved."""
    n = 4 * partitions(conversations.sparkSession)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = conversations.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("conv"), F.col(conv_col).isNull().alias("missing"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    turns = turns.withColumn("hash", F.xxhash64("text")).withColumn("size", F.octet_length("text").cast("long"))
    order = ["conv", "missing", "turn", "role", "hash"]
    placed = turns.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    placed = saved(placed.mapInArrow(_numbered(block_rows, block_bytes), "conv string, missing boolean, turn long, role string, text string, block long, at int"), "turns")

    ended = F.rtrim("text", F.lit(SPACES))
    fault = F.when(ended == "", "B").when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "T").otherwise("-")
    narrow = placed.select("conv", "missing", "block", "turn", "at", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"), "role", F.sha2("text", 256).alias("sha"))
    same = ["conv", "missing", "role", "sha"]
    seen = saved(narrow.groupBy(*same).agg(F.min(F.struct("block", "at")).alias("seen"), F.count("*").alias("times")).where("times > 1").drop("times"), "repeated-turns")
    later = (F.col("fault") != "B") & (F.struct("block", "at") > F.col("seen"))
    judged = narrow.join(seen, same, "left").withColumn("fault", F.when(later, "D").otherwise(F.col("fault")))
    judged = judged.select("conv", "missing", "block", "turn", "at", "initial", "fault").repartition(n, "block").sortWithinPartitions("block", "at")
    stretches = saved(judged.mapInArrow(_stretches, _STRETCH_SQL), "stretches")

    times = lambda letter: F.length("faults") - F.length(F.replace("faults", F.lit(letter), F.lit("")))
    adjacent = F.size(F.filter(F.sequence(F.lit(1), F.length("initials")), lambda i: (i < F.length("initials")) & ~F.substring("initials", i, F.lit(2)).isin(*sorted(LEGAL))))
    light = stretches.select("conv", "missing", "block", F.left("initials", F.lit(1)), F.right("initials", F.lit(1)), times("B"), times("D"), times("T"), adjacent, "costs", "ranks", "turns")
    plan = saved(light.repartition(n, "conv", "missing").sortWithinPartitions("conv", "missing", "block").mapInArrow(_conversations, _PLAN_SQL), "plans")

    ways = plan.select("conv", "missing", F.explode("ways").alias("way")).select("conv", "missing", "way.*")
    ways = ways.join(stretches.select("conv", "missing", "block", "first", "initials", "faults"), ["conv", "missing", "block"])
    of_block = placed.select(F.col("block").alias("b"), "at", "turn", "role", "text").groupBy("b")
    repaired = ways.groupBy("block").cogroup(of_block).applyInArrow(_rewrite, _TURN_SQL)
    return plan, saved(repaired, "repaired-turns")


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = 4096, block_bytes: int = 1 << 20) -> DataFrame:
    """The turns of every conversation after the cheapest repair: conv_col, place, edit, turn, role and text, as :func:`repair` says. Deleted turns are left out, inserted ones have no number."""
    _, turns = _planned(conversations, conv_col, turn_col, role_col, text_col, block_rows, block_bytes)
    conv = F.when(~F.col("missing"), F.col("conv")).cast(conversations.schema[conv_col].dataType)
    return turns.where("edit != 'D'").select(conv.alias(conv_col), F.struct("block", "nth").alias("place"), "edit", F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col))


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = 4096, block_bytes: int = 1 << 20) -> DataFrame:
    """Faults of every conversation and its cheapest repair: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns go by number, nulls first, then role and a hash of the text. Faults, of
    which a turn's first counts: blank; duplicate of an earlier role and text;
    truncated (no full stop, exclamation or question mark at the end). A repair
    keeps a turn (0, K), gives it the role user or assistant (2, R), deletes it
    (3, D; blank and duplicate ones must go) or inserts an empty turn (2, I); a
    truncated turn that stays costs 1. Of the repairs whose roles are an optional
    system turn and pairs of user and assistant, or nothing, the cheapest counts,
    and of those the one whose letters come first.

    The DP goes over the turns that stay: a state is the role of the last one,
    its running minimum is kept less the prefix sum of deletions, pairs of roles
    say what to insert, and ranks of audits break ties. Blocks of at most
    ``block_rows`` turns and ``block_bytes`` are solved for every state before and
    after them, and joined by these few numbers, so a conversation may be of any
    length; only its hash, which is a chain, is one task's stream.

    Nulls in role and text count as one space, a null conversation is one of its
    own, null turns make no gaps. No rows give no rows; other columns are not
    read.
    """
    plan, turns = _planned(conversations, conv_col, turn_col, role_col, text_col, block_rows, block_bytes)
    n = 4 * partitions(conversations.sparkSession)
    chain = turns.select("conv", "missing", "edit", "role", "text", "block", "nth").repartition(n, "conv", "missing").sortWithinPartitions("conv", "missing", "block", "nth").drop("block", "nth")
    whole = chain.mapInArrow(_digests, "conv string, missing boolean, audit string, repaired_sha256 string")
    conv = F.when(~F.col("missing"), F.col("conv")).cast(conversations.schema[conv_col].dataType)
    return plan.join(whole, ["conv", "missing"]).select(conv.alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """:func:`repair` after :func:`damage`, with a row for conversations that lost all turns too: zeros, no audit, and the hash of nothing."""
    names = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    done = repair(damage(conversations, **names), **names).withColumnRenamed(conv_col, "_of")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    audit, sha = F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    every = conversations.select(conv_col).distinct()
    return every.join(done, F.col(conv_col).eqNullSafe(F.col("_of")), "left").select(conv_col, *zeros.values(), audit, sha)
