import math
import random

import pytest
from pyspark.sql import functions as F

from gatewatch.operators import evaluate as E
from gatewatch.operators import quality as Q
from gatewatch.operators.split import assign_split, chronological_split, split_report, split_stats
from gatewatch.schemas import OUTPUT_COLUMNS


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "label int, probability double")


def random_pairs(seed, n=400, levels=40):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.2), rng.randrange(levels) / levels) for _ in range(n)]


def brute_auc(pairs):
    pos, neg = ([s for y, s in pairs if y == c] for c in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(pairs):
    total, last, out = sum(y for y, _ in pairs), 0.0, 0.0
    for cut in sorted({s for _, s in pairs}, reverse=True):
        hits = [y for y, s in pairs if s >= cut]
        recall = sum(hits) / total
        out += (recall - last) * sum(hits) / len(hits)
        last = recall
    return out


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_ranking_figures_with_ties(spark, ranges):
    pairs = random_pairs(ranges)
    df = scores(spark, pairs)
    assert math.isclose(E.roc_auc(df, ranges=ranges).first()[0], brute_auc(pairs), rel_tol=1e-12)
    assert math.isclose(E.average_precision(df, ranges=ranges).first()[0], brute_ap(pairs), rel_tol=1e-12)


def test_ranking_figures_per_group(spark):
    parts = {m: random_pairs(m, 150) for m in (1, 2, 3)}
    df = spark.createDataFrame([(m, *p) for m, ps in parts.items() for p in ps], "m int, label int, probability double")
    got = {r["m"]: r["pr_auc"] for r in E.average_precision(df, by="m", ranges=5).collect()}
    assert all(math.isclose(got[m], brute_ap(ps), rel_tol=1e-12) for m, ps in parts.items())


def test_one_class_has_no_ranking_figures(spark):
    row = E.evaluate_model(scores(spark, [(0, 0.1), (0, 0.9)]), 0.5).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None
    assert (row["true_negative"], row["false_positive"], row["precision"]) == (1, 1, 0.0)


def brute_threshold(pairs, bins, target):
    best = None
    total = sum(y for y, _ in pairs)
    for b in range(bins + 1):
        hits = [y for y, s in pairs if min(int(min(max(s, 0), 1) * bins), bins) >= b]
        tp = sum(hits)
        p = tp / len(hits) if hits else 0.0
        r = tp / total
        f = 2 * p * r / (p + r) if p + r else 0.0
        if r >= target and (best is None or (p, f, b) >= best[:3]):
            best = (p, f, b, tp, len(hits) - tp)
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_threshold_choice(spark, seed):
    pairs = random_pairs(seed, 120, 17)
    got = E.select_threshold(scores(spark, pairs), 50, 0.6).first()
    p, f, b, tp, fp = brute_threshold(pairs, 50, 0.6)
    assert (got["threshold"], got["true_positive"], got["false_positive"]) == (b / 50, tp, fp)
    assert math.isclose(got["precision"], p) and math.isclose(got["f1"], f) and got["false_negative"] == sum(y for y, _ in pairs) - tp


def test_equal_bins_give_the_higher_threshold(spark):
    assert E.select_threshold(scores(spark, [(1, 0.9), (0, 0.1)]), 10).first()["threshold"] == 0.9


def test_threshold_errors(spark):
    df = scores(spark, [(0, 0.1), (0, 0.9)])
    with pytest.raises(ValueError):
        E.select_threshold(df, 1)
    with pytest.raises(ValueError):
        E.select_threshold(df, 10, 0.0)
    for bad in (df, df.filter("false"), scores(spark, [(2, 0.5), (1, 0.5)])):
        with pytest.raises(Exception, match="positive label|labels must be"):
            E.select_threshold(bad, 10).collect()


def test_order_check(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (10, 5), (11, 4)], "seq bigint, timestamp bigint")
    for chunk in (1, 2, 100):
        assert sorted(tuple(r) for r in Q.check_sorted(df, chunk_rows=chunk).collect()) == [(3, 2, 3), (11, 4, 5)]
    with pytest.raises(ValueError, match="time order"):
        Q.require_sorted(df)


def test_column_and_value_checks(spark):
    df = spark.createDataFrame([(1.0, 0), (float("nan"), None), (None, 2)], "x double, label int")
    assert Q.column_problems(df, ["x", "y"]) == ["missing column y"]
    assert Q.column_problems(df, ["label", "x"], exact=True) == ["column order differs"]
    assert [tuple(r) for r in Q.check_no_nan(df, ["x", "label"]).orderBy("column_name").collect()] == [("label", 1), ("x", 2)]
    assert {r["value"] for r in Q.check_binary_label(df).collect()} == {None, 2}
    with pytest.raises(ValueError, match="NaN"):
        Q.require_no_nan(df, ["x"])
    with pytest.raises(ValueError, match="positive"):
        Q.require_min_positives(df, 1)


def feature_frame(spark, days, label=0):
    rows = spark.createDataFrame([(d * 86400 + i, label) for d in days for i in range(2)], "timestamp bigint, label int")
    return rows.select("timestamp", *[F.lit(0).alias(c) for c in OUTPUT_COLUMNS[1:-1]], "label")


def test_split(spark):
    out = chronological_split(feature_frame(spark, [5, 6, 7]))
    assert {r["split"]: (r["n_rows"], r["min_timestamp"] // 86400) for r in split_stats(out).collect()} == {
        "train": (2, 5), "valid": (2, 6), "test": (2, 7)}
    report = split_report(out).first()
    assert (report["total_rows"], report["first_day_index"], report["splits"]["valid"]["benign"]) == (6, 5, 2)
    assert Q.check_conservation(feature_frame(spark, [5, 6, 7]), out).first()["conserved"]


@pytest.mark.parametrize("days, label", [([0, 1], 0), ([0, 3], 0), ([0, 1, 2, 3], 0), ([], 0), ([0, 1, 2], 3)])
def test_split_refuses(spark, days, label):
    with pytest.raises(ValueError):
        chronological_split(feature_frame(spark, days, label))


def test_days_outside_the_split_have_none(spark):
    got = {r["split"] for r in assign_split(feature_frame(spark, [0, 1, 4])).select("split").collect()}
    assert got == {"train", "valid", None}
    verdicts = {r["relative_day"]: r["verdict"] for r in Q.check_three_days(feature_frame(spark, [0, 1, 4])).collect()}
    assert verdicts == {0: "ok", 1: "ok", 2: "empty", 4: "out of range"}


def test_ranking_by_model_reads_its_rows_once(spark):
    """Cuts and sums start from the same distinct scores: a costly source is not worked out twice."""
    from gatewatch.operators.evaluate import average_precision

    read = spark.sparkContext.accumulator(0)

    def scores(batches):
        for part in batches:
            read.add(len(part))
            yield part.assign(trees=part["id"] % 2, label=(part["id"] % 5 == 0).astype("int64"), score=(part["id"] % 70) / 70.0)[["trees", "label", "score"]]

    rows = spark.range(2000).mapInPandas(scores, "trees bigint, label bigint, score double")
    found = average_precision(rows, by="trees", label="label", probability="score").collect()
    assert len(found) == 2 and read.value == 2000


def test_groups_are_cut_into_fewer_ranges(spark):
    """The cuts are part of the plan, which the driver keeps for each block of trees: by group they are few, with the same figures."""
    from gatewatch.operators import evaluate as E

    df = spark.range(400).selectExpr("cast(id % 3 as int) as trees", "(id * 37 % 100) / 100 as score", "cast(id % 7 = 0 as int) as label")
    grouped = E.average_precision(df, by="trees", label="label", probability="score")
    assert len(grouped._jdf.queryExecution().toString()) < 60_000
    for r in grouped.collect():
        assert abs(r["pr_auc"] - E.average_precision(df.where(f"trees = {r['trees']}"), label="label", probability="score").first()[0]) < 1e-12
