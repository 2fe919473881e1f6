import pytest
from pyspark.sql import functions as F

from gatewatch.streaming.replay import finish, number_range, replay


def rows_at(spark, times):
    """(number, time) rows; the day they belong to goes with them."""
    return spark.createDataFrame(list(enumerate(times)), "record_id bigint, timestamp bigint").withColumn("day", F.floor(F.col("timestamp") / 86_400))


class Seen:
    """A handler that remembers the rows of every call, and may break down in one batch."""

    def __init__(self, breaks=None):
        self.calls, self.plans, self.breaks = [], [], breaks

    def __call__(self, rows, batch_id):
        self.plans.append(rows._jdf.queryExecution().executedPlan().toString())
        self.calls.append((batch_id, sorted((r.record_id, r.timestamp) for r in rows.collect())))
        if batch_id == self.breaks:
            raise RuntimeError("broken down")


def test_batches_grow_in_time_whatever_the_dates_of_the_files(spark, tmp_path):
    times = [90_000, 500, 3_599, 86_399, 500, 3_600, 86_400, 172_800]
    rows, path = rows_at(spark, times), str(tmp_path / "t")
    for first in (172_800, 86_400, 3_600, 0):  # the newest rows are written first
        rows.filter((F.col("timestamp") >= first) & (F.col("timestamp") < {172_800: 10**9, 86_400: 172_800, 3_600: 86_400, 0: 3_600}[first])).write.mode("append").partitionBy("day").parquet(path)
    seen = Seen()
    finish(replay(spark.read.parquet(path), seen, str(tmp_path / "c"), step=43_200))
    assert [b for b, _ in seen.calls] == [0, 1, 2, 3]
    cut = lambda t: (t - 500) // 43_200
    for batch, found in seen.calls:
        assert found == sorted((i, t) for i, t in enumerate(times) if cut(t) == batch)
    assert all("PartitionFilters: [isnotnull(day" in p and "PushedFilters: [IsNotNull(timestamp)" in p for p in seen.plans)


def test_a_restarted_replay_repeats_the_broken_batch_and_goes_on(spark, tmp_path):
    rows, path = rows_at(spark, range(0, 100, 7)), str(tmp_path / "t")
    rows.write.parquet(path)
    table, broken, after = spark.read.parquet(path), Seen(breaks=2), Seen()
    with pytest.raises(Exception, match="broken down"):
        finish(replay(table, broken, str(tmp_path / "c"), step=20))
    finish(replay(table, after, str(tmp_path / "c"), step=20))
    assert [b for b, _ in broken.calls] == [0, 1, 2] and [b for b, _ in after.calls] == [2, 3, 4]
    assert broken.calls[2] == after.calls[0]
    got = [r for _, found in broken.calls[:2] + after.calls for r in found]
    assert sorted(got) == sorted((r.record_id, r.timestamp) for r in rows.collect())


def test_a_table_that_has_grown_is_taken_up_where_it_was_left(spark, tmp_path):
    path, first, again, more = str(tmp_path / "t"), Seen(), Seen(), Seen()
    rows_at(spark, [50] * 25).write.parquet(path)
    finish(replay(spark.read.parquet(path), first, str(tmp_path / "c"), by="record_id", step=10))
    assert [len(found) for _, found in first.calls] == [10, 10, 5]
    finish(replay(spark.read.parquet(path), again, str(tmp_path / "c"), by="record_id", step=10))
    assert again.calls == []
    rows_at(spark, [60] * 33).filter("record_id >= 25").write.mode("append").parquet(path)
    finish(replay(spark.read.parquet(path), more, str(tmp_path / "c"), by="record_id", step=10))
    assert [(b, [i for i, _ in found]) for b, found in more.calls] == [(3, list(range(25, 33)))]


def test_empty_tables_and_rows_without_a_number(spark, tmp_path):
    seen = Seen()
    finish(replay(rows_at(spark, [1]).limit(0), seen, str(tmp_path / "c")))
    assert seen.calls == []
    with pytest.raises(ValueError, match="1 rows have no timestamp"):
        number_range(rows_at(spark, [3, None]))
    assert number_range(rows_at(spark, [3, -4])) == (-4, 4)


def test_numbers_below_zero_and_slices_without_rows(spark, tmp_path):
    seen = Seen()
    finish(replay(rows_at(spark, [-90_000, -1, 0]), seen, str(tmp_path / "c"), step=30_000))
    assert [[t for _, t in found] for _, found in seen.calls] == [[-90_000], [], [-1], [0]]
