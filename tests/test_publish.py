"""Tables are published after their audit; what readers see before, after and meanwhile; figures without passes of their own."""

import random

import pytest
from contract import frame, random_rows
from pyspark.sql import functions as F

from gatewatch.operators.split import chronological_split
from gatewatch.plans.features import build_features
from gatewatch.schemas import FEATURE_COLUMNS
from gatewatch.sources.publish import KEPT_VERSIONS, is_published, publish, published_figures, read_published
from gatewatch.sources.tables import load_features, load_split, write_features, write_splits

def rows_only():
    return {"rows": F.count(F.lit(1))}


def no_problem(figures):
    return []


def counted(spark, df):
    """The rows of ``df`` through a step that counts how often rows pass it."""
    passes = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passes.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), passes


def three_days(spark, n=300):
    rows = random_rows(random.Random(12), n, start=86_400 * 40)
    for i, r in enumerate(rows):
        r["timestamp"] = 86_400 * 40 + i * 3 * 86_400 // n
    return build_features(frame(spark, rows))


def folders(tmp_path, name):
    return sorted(p.name for p in (tmp_path / name / "versions").iterdir())


def test_a_refused_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert not is_published(spark, path) and published_figures(spark, path) == {}
    publish(spark.range(5), path, rows_only(), no_problem)
    before = folders(tmp_path, "t")
    with pytest.raises(ValueError, match="too few"):
        publish(spark.range(3), path, rows_only(), lambda f: ["too few rows"] if f["rows"] < 5 else [])
    broken = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        publish(broken, path, rows_only(), no_problem)
    assert read_published(spark, path).count() == 5 and published_figures(spark, path) == {"rows": 5}
    assert folders(tmp_path, "t") == before


def test_versions_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (1, 2, 3, 0):
        old = read_published(spark, path) if is_published(spark, path) else None
        publish(spark.range(n), path, rows_only(), no_problem)
        assert read_published(spark, path).count() == n
        assert old is None or old.count() >= 1  # a reader that opened the version before can go on
    assert len(folders(tmp_path, "t")) == KEPT_VERSIONS == len(list((tmp_path / "t" / "_marks").glob("0*")))


def test_the_second_of_two_writers_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark.range(1), path, rows_only(), no_problem)

    def other_writer_is_faster(figures):
        publish(spark.range(2), path, rows_only(), no_problem)
        return []

    with pytest.raises(ValueError, match="another writer"):
        publish(spark.range(3), path, rows_only(), other_writer_is_faster)
    assert read_published(spark, path).count() == 2 and len(folders(tmp_path, "t")) == 2


def test_plain_folders_can_be_read(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "plain"))
    assert read_published(spark, str(tmp_path / "plain")).count() == 4


def test_features_and_splits_are_checked_in_the_pass_that_writes_them(spark, tmp_path):
    """The rows run once when they are written as features; splitting and checking reads no feature row but to write it."""
    whole = three_days(spark)
    plain = str(tmp_path / "plain")
    whole.write.parquet(plain)
    rows, passes = counted(spark, spark.read.parquet(plain))
    figures = write_features(rows, str(tmp_path / "f"))
    # Sorting by ranges samples its input once; no further pass is for the figures.
    assert figures["rows"] == 300 and passes.value <= 600
    assert figures["positives"] == whole.where("label = 1").count() and figures["bad_labels"] == figures["untimed"] == 0
    assert figures == published_figures(spark, str(tmp_path / "f"))
    stored, passes = counted(spark, load_features(spark, str(tmp_path / "f")))
    found = write_splits(chronological_split(stored, figures), str(tmp_path / "s"), figures)
    assert passes.value == 300
    assert found["part_rows"] == 300 and [found[f"{n}_rows"] for n in ("train", "valid", "test")] == [100] * 3
    assert sum(load_split(spark, str(tmp_path / "s"), n).count() for n in ("train", "valid", "test")) == 300
    assert chronological_split(load_features(spark, str(tmp_path / "f"))).groupBy("split").count().count() == 3


def test_bad_features_are_refused(spark, tmp_path):
    whole, path = three_days(spark, 60), str(tmp_path / "f")
    write_features(whole, path)
    name = FEATURE_COLUMNS[0]
    with pytest.raises(ValueError, match=f"{name} has 60 missing"):
        write_features(whole.withColumn(name, F.lit(None).cast("int")), path)
    with pytest.raises(ValueError, match="labels are not 0 or 1"):
        write_features(whole.withColumn("label", F.lit(2)), path)
    assert load_features(spark, path).count() == 60


def test_bad_splits_are_refused(spark, tmp_path):
    path, figures = str(tmp_path / "f"), write_features(three_days(spark, 90), str(tmp_path / "f"))
    split = chronological_split(load_features(spark, path), figures)
    write_splits(split, str(tmp_path / "s"), figures)
    for bad, message in ((split.where("split <> 'valid'"), "valid has no rows"), (split.unionAll(split.limit(1)), "lost or added"),
                         (split.withColumn("label", F.lit(None).cast("int")), "labels are not")):
        with pytest.raises(ValueError, match=message):
            write_splits(bad, str(tmp_path / "s"), figures)
    assert sum(load_split(spark, str(tmp_path / "s"), n).count() for n in ("train", "valid", "test")) == 90
    for days, message in (({"days": figures["days"] & ~(1 << 41)}, "three consecutive"), ({"last_day": 43}, "three consecutive"), ({"untimed": 1}, "no time"), ({"bad_labels": 1}, "0 or 1"), ({"rows": 0}, "no rows")):
        with pytest.raises(ValueError, match=message):
            chronological_split(load_features(spark, path), figures | days)
