"""Features and de-duplication by keyed state: equal to the contract, also over a restart; late rows are marked, none vanish."""

import random
import sys

import numpy as np
import pandas as pd
from contract import PARSED_SCHEMA, by_seq, expected_features, frame, random_rows
from pyspark.sql import functions as F

from gatewatch.plans.features import FAMILIES
from gatewatch.streaming import keyed


def run(spark, source, out):
    stream = spark.readStream.schema(PARSED_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for query in keyed.start_families(stream, out):
        query.awaitTermination()


def test_keyed_state_equals_the_contract_over_a_restart(spark, tmp_path):
    """Batches in order of time; the queries end after two of four and are started again from their checkpoints. A last batch
    brings a row behind the newest one of its user: it is marked, and nothing else changes.
    """
    rows = random_rows(random.Random(21), 160, start=5000)
    times = sorted({r["timestamp"] for r in rows})
    edges = [times[0], *(times[len(times) * i // 4] for i in (1, 2, 3)), times[-1] + 1]
    parts = [[r for r in rows if a <= r["timestamp"] < b] for a, b in zip(edges, edges[1:])]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for group in (parts[:2], parts[2:]):
        for part in group:
            frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, out)
    got = keyed.read_families(spark, out)
    assert got.where("late").count() == 0 and by_seq(got) == expected_features(rows)
    late = {**rows[0], "seq": 9999, "src_username": next(r["src_username"] for r in rows if r["src_username"] is not None)}
    frame(spark, [late]).coalesce(1).write.mode("append").parquet(source)
    run(spark, source, out)
    got = keyed.read_families(spark, out)
    assert [r.seq for r in got.where("late").collect()] == [9999]
    assert by_seq(got.where("not late")) == expected_features(rows)


def test_order_matters_inside_a_key_only(spark, tmp_path):
    """Users and hosts of two halves have nothing in common; the newer half arrives first."""
    first, second = random_rows(random.Random(5), 50), random_rows(random.Random(6), 50, start=400_000)
    own = lambda v: v if v in (None, "?", "-") else v + "x"
    second = [{**r, "seq": r["seq"] + 100, **{c: own(r[c]) for c in ("src_username", "username", "src_host", "destination_host")}} for r in second]
    second = [r for r in second if None is not r["src_username"] not in ("?", "-") and r["src_host"] not in ("?", "-") and r["destination_host"] not in ("?", "-")]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (second, first):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, out)
    got = keyed.read_families(spark, out)
    assert got.where("late").count() == 0 and by_seq(got) == expected_features(first + second)


def test_marked_rows_add_up(spark, tmp_path):
    schema = "record_id bigint, host string, event_time timestamp, status string"
    hour = lambda h, m=0: f"timestamp '2024-01-01 {h:02d}:{m:02d}:00'"
    batches = [
        f"(7, 'a', {hour(5)}, 'x'), (7, 'a', {hour(5, 30)}, 'x'), (8, 'a', {hour(5)}, 'x'), (null, 'a', {hour(5)}, 'x'), (9, null, {hour(5)}, 'x'), (9, 'a', null, 'x')",
        f"(7, 'a', {hour(4, 10)}, 'x'), (7, 'a', {hour(3)}, 'x'), (8, 'b', {hour(1)}, 'x'), (8, 'a', {hour(7)}, 'x'), (8, 'a', {hour(7)}, 'x')",
    ]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for number, batch in enumerate(batches):
        spark.sql(f"select * from values {batch} as t(record_id, host, event_time, status)").selectExpr("cast(record_id as bigint) record_id", "host", "event_time", "status").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        with keyed.state_store(spark):
            keyed.dedup_marked(stream, keys=["record_id", "host"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(out)
        assert rows.count() == (6 if number == 0 else 11)
    counts = {r.status: r["count"] for r in rows.groupBy("status").count().collect()}
    assert counts == {"kept": 7, "repeated": 3, "late": 1}
    assert rows.where("status = 'late'").select(F.hour("event_time")).first()[0] == 3


def test_many_record_keys_share_one_call():
    """A call works through all keys of a bucket and touches one state entry a key."""
    entries, reads, writes = {}, [], []

    class Entries:
        def getValue(self, key):
            reads.append(key)
            return entries.get(key)

        def updateValue(self, key, value):
            writes.append(key)
            entries[key] = value

    class Handle:
        def getMapState(self, *_):
            return Entries()

    state = keyed.RecordState(["n"], 10)
    state.init(Handle())

    def call(*rows):
        (out,) = state.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["key", "at", "tie", "n"])]), None)
        return dict(zip(out["n"], out["status"]))

    assert call(("a", 100, 1, 0), ("b", 100, 1, 1), ("a", 111, 2, 2), ("b", 110, 2, 3)) == {0: "kept", 1: "kept", 2: "kept", 3: "repeated"}
    assert call(("a", 100, 1, 0), ("b", 100, 1, 1), ("c", 5, 1, 2)) == {0: "late", 1: "repeated", 2: "kept"}
    assert entries == {("a",): (111,), ("b",): (100,), ("c",): (5,)} and len(reads) == 5 and len(writes) == 3


def test_marked_rows_keep_long_numbers_beside_nulls(spark, tmp_path):
    big, source, out = 2**53 + 1, str(tmp_path / "in"), str(tmp_path / "out")
    schema = "record_id bigint, extra bigint, weight double, event_time timestamp"
    values = f"(1, {big}, 0.0D), (2, null, -0.0D), (3, {-big}, 1.5D)"
    spark.sql(f"select cast(r as bigint) record_id, cast(e as bigint) extra, w weight, timestamp '2024-01-01' event_time from values {values} as t(r, e, w)").coalesce(1).write.parquet(source)
    with keyed.state_store(spark):
        marked = keyed.dedup_marked(spark.readStream.schema(schema).parquet(source), keys=["weight", "event_time"])
        marked.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert {r.record_id: r.extra for r in rows} == {1: big, 2: None, 3: -big}
    assert sorted(r.status for r in rows) == ["kept", "kept", "repeated"]


class Store:
    """State of one key, as the operators of a family use it."""

    def __init__(self):
        self.one, self.many, self.entries = None, [], {}

    def getListState(self, *_):
        return type("", (), {"get": lambda _: iter(self.many), "put": lambda _, rows: setattr(self, "many", rows)})()

    def getMapState(self, *_):
        return type("", (), {"getValue": lambda _, k: self.entries.get(k), "updateValue": lambda _, k, v: self.entries.__setitem__(k, v)})()

    def getValueState(self, *_):
        return type("", (), {"exists": lambda _: self.one is not None, "get": lambda _: self.one, "update": lambda _, v: setattr(self, "one", v)})()


def lists(family, n, start=0):
    """``n`` rows of one key, ten a second, as one row of lists."""
    others, place = keyed._others(family), np.arange(n)
    columns = {"timestamp": start + place // 10, "seq": start * 10 + place, "ok": np.ones(n, dtype=bool), "w0": place % 2}
    columns |= {f"v{i}": np.array([f"h{j % 7}" for j in range(n)], dtype=object) for i in range(len(others))} | {f"ok{i}": np.ones(n, dtype=bool) for i in range(len(others))}
    return pd.DataFrame({c: [v] for c, v in columns.items()})


def test_python_work_does_not_grow_with_the_rows_of_a_key():
    """Calls of Python functions for a key's batch: as many for 40,000 rows as for 2,000."""
    for family in FAMILIES:
        calls = []
        for n in (2_000, 2_000, 40_000):
            state, count = keyed.FamilyState(family), [0]
            state.init(Store())
            rows = iter([lists(family, n)])
            sys.setprofile(lambda _, event, __, count=count: count.__setitem__(0, count[0] + (event == "call")))
            try:
                out = list(state.handleInputRows(("k",), rows, None))
            finally:
                sys.setprofile(None)
            assert sum(map(len, out)) == n and not any(part["late"].any() for part in out)
            calls.append(count[0])
        assert calls[2] < calls[1] + 500


def test_rows_twice_and_old_rows_are_late_and_change_no_state():
    family, store = FAMILIES[0], Store()

    def call(rows):
        state = keyed.FamilyState(family)
        state.init(store)
        return pd.concat(list(state.handleInputRows(("k",), iter([rows]), None)))

    first = call(pd.concat([lists(family, 30, 100), lists(family, 30, 100)]))
    assert sorted(first["late"]) == [False] * 30 + [True] * 30 and first.loc[first["late"], family.names()].isna().all(axis=None)
    held = store.one, list(store.many), dict(store.entries)
    assert held[0] == (102, 1029) and len(held[1]) == 30
    assert call(lists(family, 30, 100))["late"].all() and held == (store.one, store.many, store.entries)
    later = call(lists(family, 10, 103)).sort_values("seq").iloc[-1]
    assert later["auth_attempts_5m_per_src_user"] == 39 and later["unique_dst_computers_1h_per_src_user"] == 7 and later["prior_auth_count_1h_src_user_dst_computer"] == 5
    assert later["seconds_since_last_auth_by_src_user"] == 0 and later["is_first_seen_src_user_dst_computer"] == 0


def test_rows_of_a_key_travel_as_lists(spark):
    rows = spark.range(0, 5000, 1, 1).selectExpr("concat('k', id % 3) as k", "id as seq", "if(id % 5 = 0, null, concat('v', id)) as v0", "id % 2 = 0 as ok0")
    got = keyed.key_lists(rows)
    assert got.count() == 3
    back = got.selectExpr("k", "explode(arrays_zip(seq, v0, ok0)) as r").select("k", "r.*")
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0
