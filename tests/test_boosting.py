"""Histogram boosting against a plain numpy version, its stopping rule, and what a saved model gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.operators import boosting as B
from gatewatch.operators.evaluate import average_precision, average_precision_of_sums
from gatewatch.schemas import FEATURE_COLUMNS


@pytest.fixture(scope="module")
def rows(spark):
    """2,000 rows; a rare label that depends on two features and noise."""
    draw = np.random.default_rng(3)
    x = draw.integers(0, 40, (2000, 16)).astype(float)
    y = ((x[:, 0] > 30) & (x[:, 5] < 12) & (draw.random(2000) < 0.8) | (draw.random(2000) < 0.01)).astype(int)
    data = [(*map(float, r), int(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(data, ", ".join([*(f"{c} double" for c in FEATURE_COLUMNS), "label int"])).repartition(3).cache(), x, y


def plain_tree(x, g, h, depth, alpha, lam, least, rate):
    """The same greedy tree over all distinct values, by direct sums: per row, the leaf's value."""
    soft = lambda v: np.sign(v) * max(abs(v) - alpha, 0)
    out = np.full(len(x), -rate * soft(g.sum()) / (h.sum() + lam))

    def grow(at, level):
        score = lambda m: soft(g[m].sum()) ** 2 / (h[m].sum() + lam)
        best = (1e-9, None)
        for c in range(x.shape[1]):
            for v in np.unique(x[at, c])[:-1]:
                left, right = at[x[at, c] <= v], at[x[at, c] > v]
                if h[left].sum() >= least and h[right].sum() >= least:
                    gain = (score(left) + score(right) - score(at)) / 2
                    if gain > best[0] + 1e-6:
                        best = (gain, (left, right))
        if best[1]:
            for side in best[1]:
                out[side] = -rate * soft(g[side].sum()) / (h[side].sum() + lam)
                if level + 1 < depth:
                    grow(side, level + 1)

    grow(np.arange(len(x)), 0)
    return out


def test_trees_equal_a_plain_version(spark, rows):
    df, x, y = rows
    settings = {**B.SETTINGS, "subsample": 1.0, "colsample_bytree": 1.0, "max_depth": 3, "learning_rate": 0.3}
    edges = [list(np.unique(x[:, c])[:-1]) for c in range(16)]
    matrix = B.binned_matrix(df, FEATURE_COLUMNS, edges)
    trees, margin = [], np.zeros(len(x))
    for number in range(3):
        trees.append(B.fit_tree(matrix, trees, number, 3.0, 16, settings))
        p, w = 1 / (1 + np.exp(-margin)), np.where(y == 1, 3.0, 1.0)
        margin = margin + plain_tree(x, w * (p - y), w * p * (1 - p), 3, 1.0, 2.0, 5.0, 0.3)
        got = B._margins(B._binned(x, edges), trees)
        assert np.abs(got - margin).max() < 1e-5
    again = B.advanced(matrix, trees[:2], 16)
    assert B.fit_tree(again, [], 2, 3.0, 16, settings) == trees[2]


def test_penalties_and_child_weight(spark, rows):
    df, x, _ = rows
    matrix = B.binned_matrix(df, FEATURE_COLUMNS, B.bin_edges(df, FEATURE_COLUMNS, 256))
    fit = lambda **kw: B.fit_tree(matrix, [], 0, 3.0, 16, {**B.SETTINGS, "max_depth": 2, **kw})
    assert fit(min_child_weight=1e9).column == [-1] * 7
    assert fit(reg_alpha=1e9).column == [-1] * 7
    assert max(map(abs, fit(reg_lambda=1e6).leaf)) < max(map(abs, fit().leaf)) / 100
    few = fit(colsample_bytree=0.1)
    assert len({c for c in few.column if c >= 0}) <= 1
    assert fit() == fit() and fit(seed=1) != fit()


def test_rows_are_drawn_by_their_number():
    numbers = np.random.default_rng(1).integers(-(2**62), 2**62, 20000)
    first, second = B._drawn(numbers, 0, 42, 0.7), B._drawn(numbers, 1, 42, 0.7)
    assert abs(first.mean() - 0.7) < 0.02 and abs((first & second).mean() - 0.49) < 0.02
    assert B._drawn(numbers, 0, 42, 1.0).all() and (B._drawn(numbers, 0, 42, 0.7) == first).all()


def test_training_stops_keeps_the_best_and_can_be_saved(spark, rows, tmp_path):
    df, _, y = rows
    fitted = []
    real = B.fit_tree
    try:
        B.fit_tree = lambda *a: fitted.append(a[2]) or real(*a)
        model = B.train_boosted(df, df.sample(0.5, 7), patience=3, block=4, n_estimators=24, learning_rate=0.5, max_depth=2)
    finally:
        B.fit_tree = real
    assert fitted == list(range(len(fitted))) and model.info["fitted_trees"] == len(fitted) <= 24
    assert model.info["best_iteration"] + 1 == len(model.trees) <= len(fitted)
    assert len(fitted) == 24 or len(fitted) - len(model.trees) >= 3
    assert model.info["recall_target_met"] and model.info["validation_recall"] >= 0.8
    assert abs(model.info["scale_pos_weight"] ** 2 - (y == 0).sum() / (y == 1).sum()) < 1e-9
    assert average_precision(B.score_boosted(model, df)).first()[0] > 0.6
    B.save_boosted(model, str(tmp_path / "m"))
    kept = B.load_boosted(spark, str(tmp_path / "m"))
    assert kept == model
    both = B.score_boosted(kept, df).withColumnRenamed("probability", "p").transform(lambda d: B.score_boosted(model, d))
    assert both.where("p <> probability or not probability between 0 and 1").count() == 0
    importance = {r.feature: r.importance for r in B.boosted_importance(spark, model).collect()}
    assert len(importance) == 16 and abs(sum(importance.values()) - 1) < 1e-9
    assert max(importance, key=importance.get) in (FEATURE_COLUMNS[0], FEATURE_COLUMNS[5])


def test_training_needs_positives_and_whole_rows(spark, rows):
    df = rows[0]
    with pytest.raises(ValueError, match="positive"):
        B.train_boosted(df.where("label = 0"), df)
    with pytest.raises(ValueError, match="NaN or null"):
        B.train_boosted(df.withColumn(FEATURE_COLUMNS[3], F.lit(None).cast("double")), df)


def test_rows_are_binned_by_view_and_walked_by_column():
    """Bins of a batch are a view of its buffer, also of a slice; rows end in the node that a walk one by one finds."""
    import pyarrow as pa

    rng = random.Random(4)
    bins = np.array([[rng.randrange(256) for _ in range(3)] for _ in range(200)], np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([r.tobytes() for r in bins], pa.binary())], names=["row", "bins"])
    got = B._bins_of(batch.slice(20, 50), 3)
    assert not got.flags.owndata and (got == bins[20:70]).all() and B._bins_of(batch.slice(0, 0), 3).shape == (0, 3)
    tree = B.Tree([0, -1, 2, -1, -1, 1, -1], [90, 0, 120, 0, 0, 30, 0], [0.0] * 7, [0.0] * 7)
    tree = B.Tree(tree.column + [-1] * 8, tree.bin + [0] * 8, [0.0] * 15, [0.0] * 15)

    def walk(row, levels):
        at = 0
        for _ in range(levels):
            if tree.column[at] >= 0:
                at = 2 * at + 1 + int(row[tree.column[at]] > tree.bin[at])
        return at

    for levels in (0, 1, 2, 3):
        assert tree.nodes(bins, levels).tolist() == [walk(r, levels) for r in bins]
    assert tree.nodes(bins).tolist() == [walk(r, 3) for r in bins]


def test_rows_are_kept_in_blocks_and_sums_are_whole_numbers(spark, rows, monkeypatch):
    """A matrix of few files is dealt out to all cores; sums are the same added up on the driver or on the executors first; a new
    matrix of margins is kept too.
    """
    df = rows[0]
    edges = B.bin_edges(df, FEATURE_COLUMNS, 256)
    matrix = B.binned_matrix(df, FEATURE_COLUMNS, edges)
    assert matrix.getNumPartitions() == spark.sparkContext.defaultParallelism and matrix.is_cached
    assert matrix.map(lambda b: len(b[0])).sum() == 2000
    tree = B.fit_tree(matrix, [], 0, 3.0, 16, B.SETTINGS)
    sums = lambda: B.level_sums(matrix, [], tree, 0, 2, [1, 4, 9], 3.0, 16, B.SETTINGS)
    direct = sums()
    monkeypatch.setattr(B, "DIRECT", 1)
    assert direct.dtype == np.int64 and direct.shape == (2, 4, 3, 256) and (sums() == direct).all() and direct[1].any()
    later = B.advanced(matrix, [tree], 16)
    assert later.is_cached and later.map(lambda b: bool((b[3] == B._margins(b[1], [tree])).all())).collect() == matrix.map(lambda b: True).collect()


def test_blocks_send_a_row_per_distinct_score(spark, rows):
    """The precision after each tree is that over all rows."""
    df, x, _ = rows
    edges = B.bin_edges(df, FEATURE_COLUMNS, 256)
    matrix = B.binned_matrix(df, FEATURE_COLUMNS, edges)
    trees = []
    for number in range(3):
        trees.append(B.fit_tree(matrix, trees, number, 3.0, 16, {**B.SETTINGS, "learning_rate": 0.3}))
    got = B.prefix_precision(matrix, trees, 1, 16)
    for n in (1, 2, 3):
        want = average_precision(B.score_boosted(B.BoostedModel(FEATURE_COLUMNS, edges, trees[:n]), df)).first()[0]
        assert abs(got[n] - want) < 1e-9
    counted = spark.createDataFrame([(1, 0.5, 1, 1), (1, 0.5, 0, 2), (1, 0.2, 1, 0), (2, 0.1, 0, 4)], "trees int, score double, positives bigint, negatives bigint")
    figures = {r["trees"]: r["pr_auc"] for r in average_precision_of_sums(counted, "trees").collect()}
    assert figures == {1: pytest.approx((1 / 4 + 2 / 5) / 2), 2: None}
