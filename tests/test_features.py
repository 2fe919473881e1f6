import random
import re

import pytest
from contract import by_seq, expected_features, frame, random_rows
from pyspark.sql import functions as F

from gatewatch.operators.windows import first_seen, flags_and_recencies, rolling_count, rolling_distinct, rolling_in_buckets, seconds_since_last
from gatewatch.plans.features import FAMILIES, build_features, build_features_in_buckets, crowded_buckets, hot_keys, with_context


def row(seq, t, user="u", host="h", target="d", dst_user="v", event_id=4624):
    return {"timestamp": t, "src_username": user, "username": dst_user, "src_host": host, "destination_host": target,
            "logon_type": "3", "event_id": event_id, "label": 0, "seq": seq}


FORMS = {"one exchange per key": {}, "all keys oversized": {"max_group_rows": 0, "cell_rows": 1_000},
         "tiny cells": {"max_group_rows": 12, "cell_rows": 2}}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("seed", [1, 2])
def test_features_equal_brute_force(spark, form, seed):
    rows = random_rows(random.Random(seed), 260)
    got = by_seq(build_features(frame(spark, rows), keep=["seq"], **FORMS[form]))
    assert got == expected_features(rows)


def test_features_do_not_depend_on_partitioning(spark):
    rows = random_rows(random.Random(5), 200)
    shuffled = frame(spark, rows).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = by_seq(build_features(shuffled, keep=["seq"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == expected_features(rows)


HAND = {
    "closed lower bound": ([row(0, 0), row(1, 300), row(2, 301)], "auth_attempts_5m_per_src_user", [0, 1, 1]),
    "ties count earlier rows": ([row(i, 5) for i in range(3)], "auth_attempts_5m_per_src_user", [0, 1, 2]),
    "ties have recency 0": ([row(i, 5) for i in range(3)], "seconds_since_last_auth_by_src_user", [-1, 0, 0]),
    "marker user is counted": ([row(0, 1, "?"), row(1, 2, "?")], "auth_attempts_5m_per_src_user", [0, 1]),
    "marker user is never new": ([row(0, 1, "?"), row(1, 2, "?")], "is_first_seen_src_user_dst_computer", [0, 0]),
    "marker user has no recency": ([row(0, 1, "?"), row(1, 2, "?")], "seconds_since_last_auth_by_src_user", [-1, -1]),
    "null user is not counted": ([row(0, 1, None), row(1, 2, None)], "auth_attempts_5m_per_src_user", [0, 0]),
    "null user, host still counts": ([row(0, 1, None), row(1, 2, None)], "unique_dst_users_1h_per_src_computer", [0, 1]),
    "null user, host pair is new once": ([row(0, 1, None), row(1, 2, None)], "is_first_seen_src_computer_dst_computer", [1, 0]),
    "value becomes active again": ([row(0, 0), row(1, 3600), row(2, 7201)], "unique_src_computers_1h_per_src_user", [0, 1, 0]),
    "null value is no value": ([row(0, 0, host=None), row(1, 1, host="a"), row(2, 2, host="a")], "unique_src_computers_1h_per_src_user", [0, 0, 1]),
    "hour floors before zero": ([row(0, -1), row(1, 0), row(2, 3599), row(3, 3600), row(4, 86400)], "hour_of_day", [23, 0, 0, 1, 0]),
}


@pytest.mark.parametrize("hot", [False, True])
def test_hand_cases(spark, hot):
    """All cases in one table: ten days apart, each with names of its own."""
    rows, wanted = [], {}
    for number, (name, (case, feature, want)) in enumerate(HAND.items()):
        for r, value in zip(case, want):
            own = {c: v if v in (None, "?", "-") else f"{v}{number}" for c, v in r.items() if c in ("src_username", "username", "src_host", "destination_host")}
            seq = len(rows)
            rows.append({**r, **own, "seq": seq, "timestamp": r["timestamp"] + number * 864_000})
            wanted[seq] = (name, feature, value)
    got = by_seq(build_features(frame(spark, rows), keep=["seq"], max_group_rows=0 if hot else 10**9, cell_rows=1))
    assert [(n, f, got[s][f]) for s, (n, f, _) in wanted.items()] == list(wanted.values())


def test_one_exchange_per_family(spark, tmp_path):
    frame(spark, random_rows(random.Random(0), 50)).write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = build_features(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == len(FAMILIES)
    assert plan.count("Exchange") == len(FAMILIES)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_oversized_keys_cost_bounded_scans_and_exchanges(spark, tmp_path):
    """What is left to run after the rows were written apart: the last family alone, by either way."""
    frame(spark, random_rows(random.Random(0), 120)).write.parquet(str(tmp_path / "p"))
    out = build_features(spark.read.parquet(str(tmp_path / "p")), max_group_rows=12, cell_rows=4)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Final Plan" in final and final.count("FileScan parquet") <= 4 and final.count("Exchange hashpartitioning") <= 15


def test_flags_and_recencies_look_a_pair_up_once(spark, tmp_path):
    frame(spark, random_rows(random.Random(4), 120)).write.parquet(str(tmp_path / "p"))
    rows, family = spark.read.parquet(str(tmp_path / "p")), FAMILIES[0]
    out = flags_and_recencies(rows, family.key, family.first_seen, family.recency)
    # The user, and the user with either host.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    one_by_one = rows
    for name, other in family.first_seen:
        one_by_one = first_seen(one_by_one, [family.key, other], name)
    for name, other in family.recency:
        one_by_one = seconds_since_last(one_by_one, [family.key, other] if other else [family.key], name)
    assert out.schema == one_by_one.schema and out.exceptAll(one_by_one).count() == 0 == one_by_one.exceptAll(out).count()


def test_hot_keys_are_bounded(spark):
    rows = [row(i, i, user="big" if i % 3 == 0 else f"u{i}") for i in range(60)]
    found = hot_keys(frame(spark, rows), ["src_username", "src_host"], max_group_rows=10)
    assert [r[0] for r in found["src_username"].collect()] == ["big"]
    assert hot_keys(frame(spark, rows), ["src_username"], max_group_rows=60) == {}


def test_rolling_on_many_keys_and_order(spark):
    rows = random_rows(random.Random(9), 150)
    df = frame(spark, rows)
    got = {r["seq"]: (r["n"], r["k"]) for r in rolling_distinct(
        rolling_count(df, ["src_host", "username"], 1800, "n", cell_rows=3), ["src_host", "username"], "destination_host", 1800, "k", cell_rows=3).collect()}
    for i, r in enumerate(rows):
        near = [b for b in rows[:i] if b["timestamp"] >= r["timestamp"] - 1800 and r["src_host"] is not None and r["username"] is not None
                and (b["src_host"], b["username"]) == (r["src_host"], r["username"])]
        assert got[r["seq"]] == (len(near), len({b["destination_host"] for b in near} - {None}))


@pytest.mark.parametrize("bucket, limit", [(7200, 10**9), (3600, 10**9), (1000, 10**9), (7200, 4)])
def test_time_buckets_equal_the_contract(spark, bucket, limit):
    """Also with buckets shorter than a window (several halo copies), before time 0, and with crowded buckets sent by cells."""
    rows = random_rows(random.Random(bucket + limit % 7), 150, start=-20_000)
    assert by_seq(build_features_in_buckets(frame(spark, rows), bucket, limit, cell_rows=3, keep=["seq"])) == expected_features(rows)


def test_buckets_keep_extra_columns_and_rows_without_a_key(spark):
    rows = random_rows(random.Random(3), 80) + [dict(row(200, 5, user=None)), dict(row(201, 5, user="u1"))]
    df = with_context(frame(spark, rows)).withColumn("note", F.concat(F.lit("n"), F.col("seq")))
    out = rolling_in_buckets(df, FAMILIES[0], 7200)
    assert out.where("note = concat('n', seq)").count() == out.count() == len(rows)
    assert out.where("seq = 200").select("auth_attempts_5m_per_src_user").first()[0] == 0
    assert rolling_in_buckets(df.limit(0), FAMILIES[0], 7200).count() == 0


def test_no_window_of_the_buckets_is_partitioned_by_the_key_alone(spark, tmp_path):
    frame(spark, random_rows(random.Random(0), 50)).write.parquet(str(tmp_path / "p"))
    events = with_context(spark.read.parquet(str(tmp_path / "p")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for family in FAMILIES:
            plan = rolling_in_buckets(events, family, 7200)._jdf.queryExecution().executedPlan().toString()
            windows = re.findall(r"windowspecdefinition\(([^)]*?) ASC", plan)
            assert windows and all("_bucket#" in w for w in windows)
            assert plan.count("Exchange hashpartitioning") == 1 and "_bucket#" in plan.split("Exchange hashpartitioning")[1].split("\n")[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_copies_are_bounded(spark):
    """A third of the rows in one key: with buckets of two windows, rows are copied once at most, half of them on average."""
    rows = [row(i, i * 13, user="big" if i % 3 == 0 else f"u{i % 50}") for i in range(6000)]
    df = frame(spark, rows)
    bucket = 7200
    halo = df.selectExpr(f"floor((timestamp + 3600) / {bucket}) - floor(timestamp / {bucket}) as n")
    assert halo.agg(F.max("n")).first()[0] == 1 and abs(halo.agg(F.avg("n")).first()[0] - 0.5) < 0.05
    assert crowded_buckets(df, ["src_username"], bucket, 10**6) == {}
    crowded = crowded_buckets(df, ["src_username"], bucket, 100)
    assert [r[0] for r in crowded["src_username"].collect()] == ["big"]
