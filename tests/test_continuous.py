"""Tables kept up to date: derived frames, merges, cycles, coverage of a stream over restarts, publication locks."""

import random
from collections import Counter, namedtuple
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import joins
from tidemark.plans.continuous import coverage_table
from tidemark.sources.shared import shared_dir
from tidemark.streaming import coverage, states, stores

BAR = "symbol string, ts long, open double, high double, low double, close double, volume double"
MONTH = 30 * 86400


def bars(hours, price=lambda h: float(h % 7 + 1), symbol="s"):
    return [(symbol, 3600 * h, price(h), price(h) + 1, price(h) - 0.5, price(h), 1.0) for h in hours]


def files(spark, path):
    """The files of each partition."""
    found = stores.stored(spark, path).select("part", F.input_file_name().alias("f")).distinct().collect()
    return {p: {r.f for r in found if r.part == p} for p in {r.part for r in found}}


def test_derived_frames_follow_batches(spark):
    path = shared_dir(spark, "derived")
    first, second = bars(range(24 * 70)), bars(range(24 * 70 - 1, 24 * 70 + 6), lambda h: 9.0)
    one, two = spark.createDataFrame(first, BAR), spark.createDataFrame(second, BAR)
    stores.refresh_frames(path, one, 0, 3600, 14400)
    before = files(spark, f"{path}/frames"), files(spark, f"{path}/bars")
    stores.refresh_frames(path, two, 1, 3600, 14400)
    after = files(spark, f"{path}/frames"), files(spark, f"{path}/bars")
    for was, now in zip(before, after, strict=True):
        assert sorted(now) == [0, 1, 2] and now[0] == was[0] and now[1] == was[1] and now[2] != was[2]
    table = Counter(tuple(r) for r in stores.frames(spark, path).select("symbol", "ts", "open", "high", "low", "close", "volume").collect())
    full = B.resample(spark.createDataFrame([*first[:-1], *second], BAR), 3600, 14400)
    assert table == Counter(tuple(r) for r in full.collect())
    stores.refresh_frames(path, two, 1, 3600, 14400)  # the same batch again
    assert Counter(tuple(r) for r in stores.frames(spark, path).select("symbol", "ts", "open", "high", "low", "close", "volume").collect()) == table


def test_a_correction_may_take_a_frame_back(spark):
    path = shared_dir(spark, "derived")
    stores.refresh_frames(path, spark.createDataFrame(bars(range(8)), BAR), 0, 3600, 14400)
    assert stores.frames(spark, path).count() == 2
    stores.refresh_frames(path, spark.createDataFrame([("s", 3600, 1.0, 0.5, 0.5, 1.0, 1.0)], BAR), 1, 3600, 14400)  # no valid bar
    assert [r.ts for r in stores.frames(spark, path).collect()] == [14400]


def test_merge_corrects_and_repeats(spark):
    path = shared_dir(spark, "merge")
    schema = "k string, part int, x double"
    rows = lambda: Counter(tuple(r) for r in stores.stored(spark, path).select("k", "part", "x").collect())
    stores.merge_into(path, spark.createDataFrame([("a", 0, 1.0), ("b", 1, 2.0), (None, 1, 3.0)], schema), 0, ["k"], "part")
    late = spark.createDataFrame([("a", 0, 7.0), ("c", 0, None)], schema)
    stores.merge_into(path, late, 1, ["k"], "part")
    want = Counter([("a", 0, 7.0), ("b", 1, 2.0), (None, 1, 3.0), ("c", 0, None)])
    assert rows() == want
    stores.merge_into(path, late, 1, ["k"], "part")
    assert rows() == want
    stores.merge_into(path, spark.createDataFrame([("a", 0, 8.0), ("c", 0, 9.0)], schema), 2, ["k"], "part", enrich=True)
    assert rows() == Counter([("a", 0, 7.0), ("b", 1, 2.0), (None, 1, 3.0), ("c", 0, 9.0)])
    stores.merge_into(path, spark.createDataFrame([], schema), 3, ["k"], "part")
    assert sum(rows().values()) == 4


def test_a_late_file_corrects_a_candle(spark):
    base = shared_dir(spark, "late")
    for price in (1.0, 5.0):
        spark.createDataFrame([(h, price) for h in range(2 if price > 1 else 3)], "h int, x double").withColumn("part", F.lit(0)).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("h int, x double, part int").parquet(f"{base}/in")
        stores.merge_stream(stream, f"{base}/out", f"{base}/checkpoint", ["h"], "part").awaitTermination()
    assert {(r.h, r.x, r.version) for r in stores.stored(spark, f"{base}/out").collect()} == {(0, 5.0, 1), (1, 5.0, 1), (2, 1.0, 0)}


def test_a_half_written_cycle_is_not_seen(spark):
    path = shared_dir(spark, "cycles")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, ts long, status string, note string")
    stores.recommendation_cycle(path, 0, rows((1, 10, "new", "a"), (2, 10, "new", "b")), ["k"], ["status"], F.col("ts") + 5)

    def view():
        state = {(r.k, r.status, r.note) for r in stores.newest_state(spark, path, "state", ["k"], "ts").collect()}
        return state, stores.committed(spark, path, "audit").count(), stores.committed(spark, path, "recommendations").count(), stores.committed(spark, path, "label_schedule").count()

    before = view()
    assert before == ({(1, "new", "a"), (2, "new", "b")}, 2, 2, 2)
    fails = F.when(F.col("k") == 1, F.raise_error(F.lit("lost"))).otherwise(F.col("ts"))
    with pytest.raises(Exception, match="lost"):  # tables before the last are written, the last is not
        stores.recommendation_cycle(path, 1, rows((1, 20, "old", "c"), (2, 20, "new", "d")), ["k"], ["status"], fails)
    assert stores.stored(spark, f"{path}/recommendations").count() == 4 and view() == before
    stores.recommendation_cycle(path, 1, rows((1, 20, "old", "c"), (2, 20, "new", "d")), ["k"], ["status"], F.lit(None).cast("long"))
    assert view() == ({(1, "old", "c"), (2, "new", "b")}, 3, 4, 2)


MESSAGES = "k string, ts timestamp, kind string, session string, message long, ids array<string>, times array<long>, reason string"


def message(k, second, kind="poll", session="", number=None, ids=(), times=None, reason=None):
    at = datetime.fromtimestamp(second, timezone.utc)
    return (k, at, kind, session, second if number is None else number, list(ids), [1000 * second - 500] * len(ids) if times is None else times, reason)


def cover(spark, base, batches, timeout_ms=10**9):
    for rows in batches:
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(f"{base}/in")
        got = coverage_table(spark, base, f"{base}/in", spark.createDataFrame([], MESSAGES).schema, "k", timeout_ms, 10**9)
    return {(r.k, r.start_ms, r.end_ms, r.state, r.gap_reason) for r in got.collect()}


def test_coverage_reasons(spark):
    got = cover(spark, shared_dir(spark, "coverage"), [
        [message("a", 100, ids=["1"]), message("a", 110, ids=["1", "2"]), message("a", 120, ids=["9"]), message("b", 100, "message", "s1", 1, ["1"]), message("b", 105, "message", "s1", 2, ["2"]), message("b", 106, "message", "s1", 2, ["3"])],
        [message("a", 130, ids=["9", "10"]), message("b", 110, "disconnect", reason="socket closed"), message("b", 120, "message", "s2", 1, ["7"]), message("b", 125, "message", "s3", 1, ["8"]), message("c", 130, ids=[])],
    ])
    assert got == {
        ("a", 99501, 110000, "closed", coverage.NO_OVERLAP), ("a", 119501, 130000, "open", None),
        ("b", 99501, 105000, "closed", "socket closed"), ("b", 119501, 120000, "closed", "session_replaced"), ("b", 124501, 125000, "open", None),
    }


def test_coverage_over_triggers_and_restarts_is_that_of_a_batch(spark):
    """Every call of cover starts the query anew from its checkpoint; timers close what is quiet for two hours."""
    rnd = random.Random(9)
    times = sorted({(k, rnd.randrange(60) * 600 + (i > 20) * 40000) for k in "xy" for i in range(40)})
    rows = []
    for k in "xy":
        own = [t for key, t in times if key == k]
        rows += [message(k, t + 1000, ids=([f"{p}"] if p is not None and t - p <= 1800 else []) + [f"{t}"], times=([1000 * (p + 1000)] if p is not None and t - p <= 1800 else []) + [1000 * (t + 1000)]) for p, t in zip([None, *own], own, strict=False)]
    rows.sort(key=lambda r: r[1])
    third = len(rows) // 3
    got = cover(spark, shared_dir(spark, "coverage"), [rows[:third], rows[third : 2 * third], rows[2 * third :], [message("z", 500_000, ids=["1"])]], timeout_ms=7_200_000)
    spans = joins.sessions(spark.createDataFrame([(k, t + 1000) for k, t in times], "k string, ts long"), "k", 1800).collect()
    assert {(k, a, b) for k, a, b, _, _ in got if k != "z"} == {(r.k, 1000 * r.span_start + 1, max(1000 * r.span_end, 1000 * r.span_start + 1)) for r in spans}
    assert {(s, w) for k, _, _, s, w in got if k != "z"} <= {("closed", coverage.NO_OVERLAP), ("closed", "timeout")} and Counter(w for k, _, _, _, w in got if k != "z")["timeout"] >= 2


def test_publication_lock_by_hand():
    Row = namedtuple("Row", "ts rec score confidence reward entry")
    steps = [
        (Row(0, 1, 0.5, 0.5, 1.0, 100.0), ("publish_new", 1, 1, True)),
        (Row(50, 2, 0.9, 0.9, 2.0, 150.0), ("reuse_active", 1, 1, False)),  # locked: upgrades do not count
        (Row(150, 3, 0.5, 0.5, 1.0, 100.0), ("publish_fresh_operator_root", 3, 1, False)),  # the publication has expired, the position not
        (Row(200, 4, 0.5, 0.5, 1.0, 100.0), ("reuse_active", 3, 1, False)),
        (Row(310, 5, 0.57, 0.54, 1.07, 100.9), ("reuse_active", 3, 1, False)),  # unlocked, within the cooldown, nothing material
        (Row(320, 6, 0.58, 0.5, 1.0, None), ("publish_new", 6, 6, True)),  # a score of 0.08 more
        (Row(330, 7, 0.9, 0.9, 9.0, 1.0), ("reuse_active", 6, 6, False)),  # locked again
        (Row(620, 8, 0.58, 0.5, 1.0, 101.0), ("reuse_active", 6, 6, False)),  # no entry before to shift from
        (Row(900, 9, None, float("nan"), None, None), ("publish_new", 9, 9, True)),  # after the cooldown
    ]
    state = None
    for row, want in steps:
        state, got = states.lock_publication(state, row, horizon=300, alive=100, cooldown=500)
        assert got == want, row
    assert states.material_upgrade((0.5, 0.5, 1.0, 100.0), (0.5, 0.5, 1.0, 101.0)) and not states.material_upgrade((0.5, 0.5, 1.0, 100.0), (0.5, 0.549, 1.079, 100.9))
