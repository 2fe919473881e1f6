import random

from contract import PARSED_SCHEMA, by_seq, expected_features, frame, random_rows
from pyspark.sql import functions as F

from gatewatch.operators.labels import dedup_records
from gatewatch.streaming import live


def batches_of(rows, n, rng):
    """Cut at second boundaries: rows of one second arrive together."""
    times = sorted({r["timestamp"] for r in rows})
    cuts = sorted(rng.sample(times[1:], n - 1))
    edges = [times[0], *cuts, times[-1] + 1]
    return [[r for r in rows if a <= r["timestamp"] < b] for a, b in zip(edges, edges[1:])]


def test_batches_equal_the_whole_also_when_repeated(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SNAPSHOT_EVERY", 2)
    rng = random.Random(11)
    rows = random_rows(rng, 240, start=5000)
    want, state = expected_features(rows), str(tmp_path / "state")
    for number, part in enumerate(batches_of(rows, 6, rng)):
        for _ in range(2 if number in (2, 4) else 1):
            features, late = live.advance(frame(spark, part), number, state)
            got = by_seq(features)
            assert got == {r["seq"]: want[r["seq"]] for r in part}
        assert late.count() == 0


def test_late_and_untimed_rows_are_set_apart(spark, tmp_path):
    rows = [dict(r, timestamp=1000 + i) for i, r in enumerate(random_rows(random.Random(2), 6))]
    live.advance(frame(spark, rows[3:5]), 0, str(tmp_path / "s"))[0].collect()
    features, late = live.advance(frame(spark, [rows[0], rows[5], dict(rows[1], timestamp=None)]), 1, str(tmp_path / "s"))
    assert [r["seq"] for r in features.collect()] == [5]
    assert sorted(r["seq"] for r in late.collect()) == [0, 1]


def test_rows_out_of_order_wait_within_the_lateness(spark, tmp_path):
    rng = random.Random(8)
    rows = random_rows(rng, 160, start=5000)
    want, state, got, late = expected_features(rows), str(tmp_path / "s"), {}, 0
    arrival = sorted(rows, key=lambda r: r["timestamp"] + rng.randrange(1800))
    parts = [arrival[i:i + 40] for i in range(0, 160, 40)] + [[]]
    for number, part in enumerate(parts):
        for _ in range(2 if number == 2 else 1):
            batch = frame(spark, part) if part else frame(spark, rows[:1]).limit(0)
            features, behind = live.advance(batch, number, state, lateness=1801 if part else 0)
            found = by_seq(features)
            late += behind.count()
        assert not got.keys() & found.keys()
        got.update(found)
    assert got == want and late == 0


def test_records_of_several_machines(spark):
    rows = spark.createDataFrame([(7, "a", 1, 1), (7, "b", 2, 2), (7, "a", 3, 3), (None, "a", 4, 4), (7, None, 5, 5)], "record_id long, host string, timestamp long, seq long")
    assert sorted(r.seq for r in dedup_records(rows, ["record_id", "host"]).collect()) == [1, 2, 4, 5]
    assert sorted(r.seq for r in dedup_records(rows).collect()) == [1, 4]


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    rows = [dict(r, timestamp=1000 + i) for i, r in enumerate(random_rows(random.Random(3), 4))]
    live.advance(frame(spark, rows[:2]), 0, str(tmp_path / "s"))[0].collect()
    features, late = live.advance(frame(spark, rows[:0] or rows[:2]).filter("false"), 1, str(tmp_path / "s"))
    assert features.count() == 0 and late.count() == 0
    got = by_seq(live.advance(frame(spark, rows[2:]), 2, str(tmp_path / "s"))[0])
    want = expected_features(rows)
    assert got == {s: want[s] for s in (2, 3)}


def test_stream_to_files(spark, tmp_path):
    rows = random_rows(random.Random(4), 80)
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PARSED_SCHEMA).parquet(str(tmp_path / "in"))
    live.stream_features(stream, str(tmp_path / "out")).awaitTermination()
    assert by_seq(spark.read.parquet(str(tmp_path / "out/features"))) == expected_features(rows)


def test_repeated_ids_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(7, 1, 4624), (7, 2, 4624), (None, 3, 4625), (None, 4, 4625), (8, 5, 4634)], "record_id bigint, timestamp bigint, event_id bigint")
    rows.withColumn("event_time", F.timestamp_seconds("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    kept = live.stream_dedup(live.stream_filter(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
    live.start(kept, lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}")), str(tmp_path / "c")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(str(r["record_id"]) for r in out) == ["7", "None", "None"]


def test_alert_lines(spark):
    df = spark.createDataFrame([(1, 0, 4624, "a", "h", None, "d", 0.75), (2, 0, 4625, "a", "h", "b", "d", 0.25)],
                               "seq bigint, timestamp bigint, event_id bigint, src_username string, src_host string, username string, destination_host string, probability double")
    rows = live.with_alerts(df, 0.5).orderBy("seq").collect()
    assert [r["verdict"] for r in rows] == ["ANOMALY", "NORMAL"]
    assert rows[0]["alert"] == "[ANOMALY] rec_id=1 | time=1970-01-01 00:00:00 | id=4624 | score=0.75000 (threshold=0.50000) | a@h -> None@d"
    assert rows[1]["alert"].startswith("[NORMAL ] rec_id=2")


def files_read(rows):
    return {r[0] for r in rows.select("_metadata.file_path").distinct().collect()}


def test_a_batch_reads_the_buckets_of_its_own_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SNAPSHOT_EVERY", 1)
    rng, state = random.Random(6), str(tmp_path / "s")
    rows = [dict(r, src_username=f"U{i % 2000}", src_host=f"C{i % 900}") for i, r in enumerate(random_rows(rng, 4000, start=5000))]
    rows.sort(key=lambda r: r["timestamp"])
    later = [dict(r, seq=10_000 + i, timestamp=rows[-1]["timestamp"] + 9000, src_username=f"U{i}", src_host="C1") for i, r in enumerate(rows[:10])]
    for number, part in enumerate([rows[:2000], rows[2000:]]):
        live.advance(frame(spark, part), number, state)[0].count()
    wanted = live._last_rows(frame(spark, later)).select(*live.KEYS)
    snapshot = spark.read.parquet(f"{state}/snapshot/1")
    read = snapshot.filter(live._buckets_of(wanted))
    per_chain = {r["chain"]: r["n"] for r in read.groupBy("chain").agg(F.count_distinct("bucket").alias("n")).collect()}
    assert per_chain["user"] <= 10 and per_chain["user_source"] <= 10 and per_chain["user_target"] <= 10 and per_chain["source_target"] == 1
    assert len(files_read(read)) <= 31 < 1000 < len(files_read(snapshot))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # The state that is pruned gives the same rows as the whole of it.
    keys = {tuple(r) for r in wanted.collect()}
    both = [{tuple(r) for r in live._remembered(spark, state, 2, only).select(*live.KEYS, "at").collect() if tuple(r)[:4] in keys and r["chain"] != "all"}
            for only in (None, live._buckets_of(wanted))]
    assert both[0] == both[1] and len(both[0]) > 10


def test_state_that_no_batch_can_read_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SNAPSHOT_EVERY", 2)
    rng, state = random.Random(12), tmp_path / "s"
    rows = [dict(r, timestamp=7200 * (i // 8) + i) for i, r in enumerate(random_rows(rng, 64, start=0))]
    want = expected_features(rows)
    for number in range(8):
        part = rows[8 * number:8 * number + 8]
        for _ in range(2 if number in (4, 5) else 1):
            got = by_seq(live.advance(frame(spark, part), number, str(state), lateness=0)[0])
            assert got == {r["seq"]: want[r["seq"]] for r in part}
    names = {f: sorted(p.name for p in (state / f).iterdir() if not p.name.startswith((".", "_"))) for f in ("history", "last", "snapshot")}
    assert names == {"history": ["hour=12", "hour=14"], "last": ["7"], "snapshot": ["6"]}


def test_features_of_a_batch_read_its_rows_once(spark, tmp_path):
    """They start from the stored rows of the batch, not from history and last rows again, and only those of the newest batch stay."""
    state = tmp_path / "s"
    rows = [dict(r, timestamp=1000 + i) for i, r in enumerate(random_rows(random.Random(3), 30))]
    want = expected_features(rows)
    for number in range(3):
        part = rows[10 * number:10 * number + 10]
        features, _ = live.advance(frame(spark, part), number, str(state))
        assert {f.split("/s/")[1].split("/part-")[0] for f in features.inputFiles()} == {f"current/{number}"}
        assert by_seq(features) == {r["seq"]: want[r["seq"]] for r in part}
    assert [p.name for p in (state / "current").iterdir()] == ["2"]
