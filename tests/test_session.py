from types import SimpleNamespace

import pytest

from gatewatch.functions.scalar import clean_time, coerce_label, is_success
from gatewatch.operators.split import assign_split, split_report
from gatewatch.session import scratch_dir, sized_for


def session(master, folder=None):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    get = lambda key, default=None: settings.get(key, default)
    return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get)))


@pytest.mark.parametrize("master", ["yarn", "k8s://https://host", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session(master), "x")
    assert scratch_dir(session(master, "hdfs://shared"), "x").startswith("hdfs://shared/x-")


def test_a_local_master_gets_a_folder_of_its_own():
    assert scratch_dir(session("local[8]"), "x").startswith("/tmp/run-")


def test_partitions_grow_with_the_input():
    assert sized_for(100 << 40)["spark.sql.shuffle.partitions"] == str((100 << 40) // (256 << 20))


def test_only_decimal_texts_are_numbers(spark):
    rows = spark.createDataFrame([("10d",), ("0x1p3",), ("4624f",), ("1d",), (" 4624 ",), ("1.9",), ("1e3",), ("NaN",), (None,)], "t string")
    got = rows.select("t", clean_time("t").alias("s"), is_success("t").alias("ok"), coerce_label("t").alias("y")).collect()
    assert [r.s for r in got] == [None, None, None, None, 4624, 1, 1000, None, None]
    assert [r.ok for r in got] == [0, 0, 0, 0, 1, 0, 0, 0, 0]
    assert [r.y for r in got][:4] == [0, 0, 0, 0] and got[5].y == 1


@pytest.mark.parametrize("days, valid", [([0, 1, 2], True), ([0, 1], False), ([0, 1, 2, 3], False)])
def test_report_says_whether_the_split_is_whole(spark, days, valid):
    rows = spark.createDataFrame([(d * 86400, 0) for d in days], "timestamp long, label int")
    report = split_report(assign_split(rows)).first()
    assert report.valid == valid and report.total_rows == min(len(days), 3)
