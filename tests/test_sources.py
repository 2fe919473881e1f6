import gzip

import pytest
from pyspark.sql import functions as F

from gatewatch.functions import scalar as S
from gatewatch.operators.labels import dedup_records, label_join
from gatewatch.operators.quality import check_sorted, in_file_order, require_sorted
from gatewatch.plans.parsing import clean_labels, parse
from gatewatch.sources.event_xml import parse_event_xml, rejected_event_xml
from gatewatch.sources.tables import load_parsed, scan_parsed, write_parsed, write_splits
from gatewatch.sources.text import scan_attack_labels, scan_auth_log, scan_event_xml

NAMESPACE = 'xmlns="http://schemas.microsoft.com/win/2004/08/events/event"'


def line(t, user="U1"):
    return f"{t},{user},U2,C1,C2,NTLM,Network,LogOn,Success\n"


def test_file_order_over_files_and_splits(spark, tmp_path):
    rows = 40_000
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_text("".join(line(part * rows + i, f"U{'x' * 30}{i}") for i in range(rows)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        df = scan_auth_log(spark, str(tmp_path)).cache()
        assert df.rdd.getNumPartitions() > 3
        typed = df.select(F.col("time").cast("bigint").alias("timestamp"), "seq")
        assert df.select("seq").distinct().count() == 3 * rows
        assert check_sorted(typed, chunk_rows=1 << 30).count() == 0
        assert typed.orderBy("seq").select("timestamp").limit(3).collect() == [(0,), (1,), (2,)]
        df.unpersist()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_files_get_the_same_numbers(spark, tmp_path, monkeypatch):
    from gatewatch.sources import text

    for part in range(4):
        (tmp_path / f"{part}.csv").write_text("".join(line(part * 10 + i) for i in range(10)))
    few = scan_auth_log(spark, str(tmp_path)).orderBy("seq").select("time", "seq").collect()
    monkeypatch.setattr(text, "MAX_BROADCAST_FILES", 1)
    many = scan_auth_log(spark, str(tmp_path)).orderBy("seq").select("time", "seq").collect()
    assert [int(r[0]) for r in many] == list(range(40)) and few == many


def test_gzip_is_read_as_it_is(spark, tmp_path):
    with gzip.open(tmp_path / "auth.txt.gz", "wt") as f:
        f.writelines(line(i) for i in range(20))
    assert scan_auth_log(spark, str(tmp_path / "auth.txt.gz")).count() == 20


def test_rows_of_a_compressed_file_are_spread(spark, tmp_path, monkeypatch):
    from gatewatch.sources import text

    monkeypatch.setattr(text, "SPREAD_ROWS", 100)
    with gzip.open(tmp_path / "auth.txt.gz", "wt") as f:
        f.writelines(line(i) for i in range(5000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = scan_auth_log(spark, str(tmp_path / "auth.txt.gz")).withColumn("p", F.spark_partition_id()).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [int(r["time"]) for r in rows] == list(range(5000)) and len({r["p"] for r in rows}) > 1
    assert parse(scan_auth_log(spark, str(tmp_path / "auth.txt.gz")), scan_attack_labels(spark, str(tmp_path / "absent"))).count() == 5000


def test_parse_refuses_an_unsorted_log(spark, tmp_path):
    labels = scan_attack_labels(spark, str(tmp_path / "absent"))
    for name, times in {"one": [[1, 3, 2]], "two": [[5, 6], [1, 2]]}.items():
        (tmp_path / name).mkdir()
        for i, part in enumerate(times):
            (tmp_path / name / f"{i}.csv").write_text("".join(line(t) for t in part))
        log = scan_auth_log(spark, str(tmp_path / name))
        with pytest.raises(ValueError, match="time order"):
            parse(log, labels)
        assert parse(log, labels, check_order=False).count() == sum(map(len, times))


def test_file_order_needs_no_shuffle_of_rows(spark, tmp_path):
    rows = 40_000
    for part in range(3):
        (tmp_path / f"part-{part}.csv").write_text("".join(line(part * rows + i, f"U{'x' * 30}{i}") for i in range(rows)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        df = scan_auth_log(spark, str(tmp_path)).select(F.col("time").cast("bigint").alias("timestamp"), "seq")
        assert in_file_order(df)
        # One wrong time anywhere is found, whether inside a split or at its start.
        first = df.groupBy(F.expr("seq >> 33")).agg(F.min("seq").alias("s")).orderBy("s").collect()[3]["s"]
        for at in (first, first + 7):
            assert not in_file_order(df.withColumn("timestamp", F.when(F.col("seq") == at, 0).otherwise(F.col("timestamp"))))
        # Rows dealt anew say nothing by themselves; the exact check still accepts them.
        assert require_sorted(df.repartition(4)) is not None
        assert in_file_order(df.where("false"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_splits_hold_all_rows(spark, tmp_path):
    whole = spark.createDataFrame([(1, 0, "train"), (2, 1, "valid"), (3, 0, None)], "timestamp bigint, label int, split string")
    with pytest.raises(ValueError, match="lost"):
        write_splits(whole, str(tmp_path / "a"), whole)
    fine = whole.fillna("test", ["split"])
    assert write_splits(fine, str(tmp_path / "b"), fine)["part_rows"] == 3


def test_small_splits_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text(line(1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        with pytest.raises(ValueError, match="1 MiB"):
            scan_auth_log(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_byte_settings():
    from gatewatch.sources.text import _bytes

    assert [_bytes(t) for t in ("1048576", "1048576b", "1024k", "1MB", "2g")] == [1 << 20] * 4 + [2 << 30]


def test_parse_cleans_labels_and_joins(spark, tmp_path):
    (tmp_path / "auth.csv").write_text(
        "1, U1 ,U2\t,C1,C2,NTLM,Network,LogOn, Success\nabc,U1,U2,C1,C2,NTLM,Network,LogOn,Success\n"
        "2,,U2,C1,C2,NTLM,3,LogOn,Fail\n3.9,NA,U2,?,C2,NTLM,null,LogOn,success\n")
    (tmp_path / "red.csv").write_text("1,U1,C1,C2\n1, U1,C1,C2\n2,,C1,C2\nx,U1,C1,C2\n")
    parsed = parse(scan_auth_log(spark, str(tmp_path / "auth.csv")), scan_attack_labels(spark, str(tmp_path / "red.csv")))
    got = [tuple(r)[:-1] for r in parsed.orderBy("seq").collect()]
    assert got == [(1, "U1", "U2", "C1", "C2", "Network", 4624, 1), (2, None, "U2", "C1", "C2", "3", 4625, 1),
                   (3, None, "U2", "?", "C2", None, 0, 0)]
    assert clean_labels(scan_attack_labels(spark, str(tmp_path / "red.csv"))).count() == 2
    write_parsed(parsed, str(tmp_path / "out"))
    assert load_parsed(spark, str(tmp_path / "out")).count() == 3
    scan = scan_parsed(spark, str(tmp_path / "out")).select("src_username").filter("timestamp >= 2")
    text = scan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp,2)]" in text
    assert "ReadSchema: struct<timestamp:bigint,src_username:string>" in text


def test_no_label_file_means_no_labels(spark, tmp_path):
    labels = scan_attack_labels(spark, str(tmp_path / "absent.csv"))
    log = spark.createDataFrame([("1", "a", "b", "c")], "time string, src_user string, src_computer string, dst_computer string")
    assert [r["label"] for r in label_join(log, labels).collect()] == [0]


def test_repeated_records(spark):
    df = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (None, 1, 2), (None, 1, 3)], "record_id bigint, timestamp bigint, seq bigint")
    kept = dedup_records(df)
    assert sorted(r["seq"] for r in kept.collect()) == [0, 2, 3]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_text_cleaning(spark):
    df = spark.createDataFrame([(" a\t",), (" x ",), ("\x1cy\x1f",), (" NA ",), ("?",), ("-",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(S.normalize_text("c")).collect()] == ["a", "x", "y", None, "?", "-", None, None]
    odd = [r[0] for r in df.select(S.valid_key("c")).collect()]
    assert odd == [True, True, True, True, False, False, False, False]


def test_times(spark):
    df = spark.createDataFrame([(" 12 ",), ("1.9",), ("1e3",), ("abc",), ("inf",), ("nan",), (None,), ("9007199254740993",)], "c string")
    assert [r[0] for r in df.select(S.clean_time("c")).collect()] == [12, 1, 1000, None, None, None, None, 9007199254740993]
    stamps = spark.createDataFrame([("2024-01-01T01:02:03.1234567Z",), ("2024-01-01T01:02:03Z",), ("-",), (None,), ("2024-13-01T00:00:00Z",)], "c string")
    assert [r[0] for r in stamps.select(S.parse_event_time("c")).collect()] == [1704070923, 1704070923, None, None, None]


def test_results_and_scores(spark):
    df = spark.createDataFrame([("Success",), (" Fail ",), ("success",), (None,)], "c string")
    assert [r[0] for r in df.select(S.map_event_id(S.strip("c"))).collect()] == [4624, 4625, 0, 0]
    scores = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (0.5,), (2.0,), (-1.0,)], "c double")
    assert [r[0] for r in scores.select(S.clean_scores("c")).collect()] == [0.0, 1.0, 0.0, 0.0, 0.5, 1.0, 0.0]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (9.0,)], "c double")
    assert [r[0] for r in halves.select(S.round_clip("c", 0, 5)).collect()] == [0, 2, 2, 0, 5]


def xml(event_id="4624", record="<EventRecordID>7</EventRecordID>", time="2024-01-01T01:02:03.1Z",
        station='<Data Name="WorkstationName">WS</Data>', namespace=NAMESPACE):
    return (f'<Event {namespace}><System><EventID Qualifiers="0">{event_id}</EventID>{record}<TimeCreated SystemTime="{time}"/><Computer>DC</Computer>'
            f'</System><EventData><Data Name="SubjectUserName">bob</Data><Data Name="TargetUserName"></Data>{station}'
            '<Data Name="IpAddress">1.2.3.4</Data><Data Name="LogonType">3</Data></EventData></Event>')


def test_event_xml(spark):
    cases = [xml(), xml(station=""), xml(station='<Data Name="WorkstationName">-</Data>'), xml(event_id="4634"), xml()[:-9],
             xml(namespace=""), xml(record=""), xml(record="<EventRecordID>x</EventRecordID>"), xml(time="-"), "junk"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, xml string")
    got = {r["i"]: r for r in parse_event_xml(df).collect()}
    assert sorted(got) == [0, 1, 2, 6, 8]
    assert [got[i]["src_host"] for i in (0, 1, 2)] == ["WS", "1.2.3.4", "1.2.3.4"]
    assert (got[0]["src_username"], got[0]["username"], got[0]["destination_host"], got[0]["timestamp"]) == ("bob", "-", "DC", 1704070923)
    assert got[6]["record_id"] is None and got[8]["timestamp"] is None
    plan = parse_event_xml(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml") + plan.count("xmltostructs") <= 2


def test_event_xml_prefixes_and_rejected(spark):
    spelled = xml().replace("<", "<e:").replace("<e:/", "</e:").replace("xmlns=", "xmlns:e=")
    cases = [spelled, '<?xml version="1.0"?>\n' + spelled, xml(event_id="4634"), xml()[:-9], xml(namespace='xmlns="other"'),
             xml(record="<EventRecordID>x</EventRecordID>"), xml(event_id="none"), None, "", xml(), xml(event_id="&#52;624")]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, xml string")
    got = {r["i"]: r for r in parse_event_xml(df).collect()}
    assert sorted(got) == [0, 1, 9, 10]
    assert [tuple(got[i])[1:] for i in (0, 1, 10)] == [tuple(got[9])[1:]] * 3
    assert {r["i"]: r["reason"] for r in rejected_event_xml(df).collect()} == {
        3: "not readable", 4: "other name space", 5: "record number", 6: "event number", 7: "not readable", 8: "not readable"}


def test_event_xml_over_many_lines(spark, tmp_path):
    wide = [xml(record=f"<EventRecordID>{i}</EventRecordID>").replace("><", ">\n  <") for i in range(50)]
    (tmp_path / "a.xml").write_text('<?xml version="1.0"?>\n<Events>\n' + "\n".join(wide) + "\n</Events>\n")
    df = scan_event_xml(spark, str(tmp_path), end="</Event>")
    assert sorted(r["record_id"] for r in parse_event_xml(df).collect()) == list(range(50)) and rejected_event_xml(df).isEmpty()
