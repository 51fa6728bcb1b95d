"""What would not show on small tables: calls of a state store, files of a large partition, work done once."""

from collections import Counter

import pandas as pd

from tidemark.plans import market
from tidemark.sources.shared import shared_dir
from tidemark.streaming import coverage, stores


class Store:
    """A handle with its states: a value and a map, that count their calls."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = Counter(), None, {}, set()

    def called(self, name):
        self.calls[name] += 1

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key_schema, value_schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def containsKey(self, key):
        self.called("contains")
        return key in self.map

    def updateValue(self, key, value):
        self.called("update")
        self.map[key] = value

    def removeKey(self, key):
        self.called("remove")
        del self.map[key]

    def iterator(self):
        self.called("iterator")
        return iter(list(self.map.items()))

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


def test_coverage_reads_its_state_once_a_trigger():
    store = Store()
    spans = coverage.CoverageSpans("k", 10**9, 1500)
    spans.init(store)
    rows = [{"at_ms": 1000 * i, "kind": "poll", "session": "", "message": i, "ids": [str(i - 1), str(i)], "times": [1000 * i - 1000, 1000 * i], "reason": None} for i in range(1, 201)]
    first = pd.concat(spans.handleInputRows(("a",), iter([pd.DataFrame(rows[100::-1])]), None))
    second = pd.concat(spans.handleInputRows(("a",), iter([pd.DataFrame(rows[101:150]), pd.DataFrame(rows[150:])]), None))
    assert [(r.start_ms, r.end_ms, r.state) for r in [*first.itertuples(), *second.itertuples()]] == [(1, 101000, "open"), (1, 200000, "open")]
    assert store.map == {("199",): (199000,), ("200",): (200000,)} and store.timers == {200000 + 10**9}
    assert store.calls == {"iterator": 2, "update": 4, "remove": 2}


def test_coverage_takes_messages_without_a_number_last():
    store = Store()
    spans = coverage.CoverageSpans("k", 10**9, 10**9)
    spans.init(store)
    row = {"at_ms": 5000, "session": "", "ids": None, "times": None, "reason": "off", "kind": "disconnect", "message": None}
    rows = [row, row, row | {"kind": "poll", "message": 1, "ids": ["1"], "times": [4000]}]
    got = pd.concat(spans.handleInputRows(("a",), iter([pd.DataFrame(rows)]), None))
    assert [(r.start_ms, r.end_ms, r.state, r.gap_reason) for r in got.itertuples()] == [(4001, 5000, "closed", "off")] and store.value is None


def test_a_large_partition_is_written_by_several_tasks(spark):
    path = shared_dir(spark, "large")
    rows = spark.range(200).selectExpr("id AS k", "cast(id % 2 AS int) AS part", "id * 2 AS x")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream's batches
    try:
        stores.overwrite(rows, path, "part", ["k"], file_rows=50)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    got = stores.stored(spark, path)
    assert len(got.inputFiles()) > 2
    assert {tuple(r) for r in got.select("k", "part", "x").collect()} == {(k, k % 2, 2 * k) for k in range(200)}


def test_rules_of_the_policy_look_nothing_up_in_the_reasons(spark):
    """Every part of the reasons is read once, by the projection below the rules; before, each rule read its own again."""
    plan = market.QUERIES["exact_policy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    rules, evidence, *_ = plan.splitlines()
    assert "POLICY_CONTRACT_UNVERIFIED" in rules and "variant" not in rules and "sha2" not in rules
    assert "variant_get" in evidence
