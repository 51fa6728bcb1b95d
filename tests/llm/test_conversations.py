"""Conversation repair against a search over all repairs, kept whole per state."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLES = {"u": "user", "a": "assistant"}


def cheapest(states):
    return {p: {x for x in v if x[0] == min(y[0] for y in v)} for p, v in states.items()}


def inserted(states):
    for _ in range(2):
        more = {p: set(v) for p, v in states.items()}
        for p, v in states.items():
            for cost, audit, out in v:
                for ch, name in ROLES.items():
                    if q := NEXT.get((p, ch)):
                        more.setdefault(q, set()).add((cost + 2, audit + "I", (*out, f"{name}:")))
        states = more
    return cheapest(states)


def brute_repair(rows):
    """Every cheapest repair up to each state is kept as it is; the letters are compared at the end alone."""
    faults, seen = [], set()
    for _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("B" if not letters else "D" if (role, text) in seen else "T" if letters[-1] not in ".!?" else "-")
        seen.add((role, text))
    states = {0: {(0, "", ())}}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        states, after = inserted(states), defaultdict(set)
        for p, v in states.items():
            for cost, audit, out in v:
                after[p].add((cost + 3, audit + "D", out))
                if fault in "T-":
                    own = cost + (fault == "T")
                    if role and (q := NEXT.get((p, role[0]))):
                        after[q].add((own, audit + "K", (*out, f"{role}:{text}")))
                    for ch, name in ROLES.items():
                        if q := NEXT.get((p, ch)):
                            after[q].add((own + 2, audit + "R", (*out, f"{name}:{text}")))
        states = cheapest(after)
    states = inserted(states)
    cost, audit, out = min((x for p in (0, 3) for x in states.get(p, ())), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(x) for x in "BDT"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute(rows, hashes):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        lot, kept = zlib.crc32(key.encode()) % 20, by_conv[conv]
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        kept += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], hashes[x[2]])
    return Counter((conv, *brute_repair(sorted(kept, key=order))) for conv, kept in by_conv.items())


def random_rows(seed, convs=120):
    rnd = random.Random(seed)
    turn = lambda t: rnd.choice([None, t, t, t, t + rnd.randint(0, 2)])
    rows = [(c, turn(t), rnd.choice(["user", "assistant", "system", "u", "", None, "tool"]), rnd.choice(["Hi.", "Ok", "  ", "", None, "Yes!", "What?", "No"])) for c in range(convs) for t in range(rnd.randint(1, 9))]
    return [*rows, (None, 1, "user", "Hi."), (None, 2, None, None), (None, 2, None, None)]


def hashes(df):
    return {r.text: r.h for r in conversations.damage(df).select("text", F.xxhash64("text").alias("h")).distinct().collect()}


def test_repair(spark):
    rows = random_rows(5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert Counter(tuple(r) for r in conversations.repair_damaged(df).collect()) == brute(rows, hashes(df))


def test_blocks_compose(spark):
    """A conversation that spans many blocks has the repair of one that fits in one."""
    df = conversations.damage(spark.createDataFrame(random_rows(6), SCHEMA))
    whole = Counter(tuple(r) for r in conversations.repair(df).collect())
    assert Counter(tuple(r) for r in conversations.repair(df, block_rows=2).collect()) == whole
    assert Counter(tuple(r) for r in conversations.repair(df, block_bytes=3).collect()) == whole


@pytest.mark.parametrize("seed", range(3))
def test_stretches_compose_in_python(seed):
    rnd = random.Random(seed)
    for _ in range(200):
        n = rnd.randint(1, 12)
        initials, faults = "".join(rnd.choice("suax") for _ in range(n)), "".join(rnd.choice("BDT---") for _ in range(n))
        cost, (_, end) = conversations._joined([conversations._matrix(initials, faults)])
        cut = rnd.randint(0, n)
        parts = [(initials[:cut], faults[:cut]), (initials[cut:], faults[cut:])]
        parts = [p for p in parts if p[0]]
        twice, states = conversations._joined([conversations._matrix(*p) for p in parts])
        audit = "".join(x for p, a, b in zip(parts, states, states[1:], strict=False) for x in conversations._audit(a, b, *p)[0])
        assert (twice, states[-1], audit) == (cost, end, "".join(conversations._audit(0, end, initials, faults)[0]))


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "One."), (1, 1, "user", ""), (1, 2, "user", "Two."), (2, 0, "system", "S."), (2, 1, "user", "Q?"), (2, 2, "assistant", "A.")]
    got = conversations.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.turn, r.role, r.text) for r in got] == [
        (1, "I", None, "user", ""), (1, "K", 0, "assistant", "One."), (1, "K", 2, "user", "Two."), (1, "I", None, "assistant", ""),
        (2, "K", 0, "system", "S."), (2, "K", 1, "user", "Q?"), (2, "K", 2, "assistant", "A."),
    ]


def test_empty_table_and_clashing_names(spark):
    assert conversations.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 3, "user", "Hi.", 7, "x"), (1, 4, "assistant", "Yo.", 8, "y")], SCHEMA + ", block int, audit string")
    assert [r.audit for r in conversations.repair(df).collect()] == ["KK"]


def test_op13(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert Counter(tuple(r) for r in queries.op13_repair(spark, SF).collect()) == brute([tuple(r) for r in df.collect()], hashes(df))
