import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewatch.operators import model
from gatewatch.operators import resample as R
from gatewatch.operators.evaluate import average_precision, evaluate_model
from gatewatch.operators.model import (
    evaluate_bundle,
    feature_importance,
    first_trees,
    load_bundle,
    model_matrix,
    prefix_scores,
    save_bundle,
    score_batch,
    train_baseline,
    train_weighted,
)
from gatewatch.operators.neighbours import nearest
from gatewatch.schemas import FEATURE_COLUMNS, LEGACY_FEATURE_COLUMNS


def brute(points, ids, k):
    scale = points.std(0)
    scale[scale == 0] = 1
    z = (points - points.mean(0)) / scale
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {int(ids[i]): np.sort(d[i])[:min(k, len(ids) - 1)] for i in range(len(ids))}, z


CASES = {
    "spread": (lambda g: g.normal(0, 1, (300, 3)), 5, {"block_points": 16, "share_points": 60}),
    "a third are copies": (lambda g: np.where(np.arange(240)[:, None] < 80, 1.0, g.integers(0, 5, (240, 3)).astype(float)), 4, {"block_points": 5, "share_points": 30}),
    "far clusters": (lambda g: g.normal(0, 0.1, (200, 2)) + g.integers(0, 5, (200, 1)) * 10.0, 5, {}),
    "fewer rows than k": (lambda g: g.normal(0, 1, (4, 2)), 10, {}),
    "all equal": (lambda g: np.ones((30, 2)), 3, {}),
}


@pytest.mark.parametrize("name", CASES)
def test_neighbours_equal_brute_force(spark, name):
    make, k, sizes = CASES[name]
    rng = np.random.default_rng(3)
    points = make(rng)
    ids = rng.permutation(len(points)) * 7
    columns = [f"c{i}" for i in range(points.shape[1])]
    df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in zip(ids, points)], "id bigint, " + ", ".join(f"{c} double" for c in columns))
    got = {r["id"]: r["neighbours"] for r in nearest(df, "id", columns, k, **sizes).collect()}
    want, z = brute(points, ids, k)
    place = {int(i): n for n, i in enumerate(ids)}
    assert got.keys() == want.keys()
    for i, entries in got.items():
        found = [e["id"] for e in entries]
        assert i not in found and len(set(found)) == len(found)
        np.testing.assert_allclose([e["distance2"] for e in entries], want[i], atol=1e-9)
        np.testing.assert_allclose([((z[place[e["id"]]] - z[place[i]]) ** 2).sum() for e in entries], want[i], atol=1e-9)


def test_points_are_copied_no_more_often_when_there_are_more(spark, monkeypatch):
    from gatewatch.operators import neighbours

    sizes = {}

    def counted(df, name, *folders, plain=neighbours.stage):
        out = plain(df, name, *folders)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(neighbours, "stage", counted)
    copies = []
    for n in (5_000, 50_000):
        df = spark.range(n).select("id", *[F.rand(i).alias(f"c{i}") for i in range(3)])
        assert nearest(df, "id", ["c0", "c1", "c2"], 5, share_points=2_000, block_points=2_000).where(F.size("neighbours") == 5).count() == n
        copies.append(sizes["knn-asked"] / n)
    assert copies[1] < 1.3 * copies[0], copies


def sample_frame(spark, n=300, attacks=5, legacy=False, seed=0):
    rng = random.Random(seed)
    columns = LEGACY_FEATURE_COLUMNS if legacy else FEATURE_COLUMNS
    rows = [(i, *[rng.random() if c == "failure_rate_1h" else float(rng.randrange(-1 if c.startswith("seconds") else 0, 2 if c.startswith("is_") or c.endswith("success") else 6)) for c in columns],
             int(i < attacks)) for i in range(n)]
    return spark.createDataFrame(rows, "seq bigint, " + ", ".join(f"{c} double" for c in columns) + ", label int")


@pytest.mark.parametrize("legacy", [False, True])
def test_synthetic_rows_lie_between_their_parents(spark, legacy):
    spec = R.LEGACY_SPEC if legacy else R.CURRENT_SPEC
    df = sample_frame(spark, legacy=legacy)
    made = R.synthetic_rows(df, "seq", spec, multiplier=20, k=10, keep_parents=True).collect()
    rows = {r["seq"]: r for r in df.filter("label = 1").collect()}
    assert len(made) == 95 and {r["base_id"] for r in made} <= set(rows) and len({r["neighbour_id"] for r in made}) == 5
    for r in made:
        assert r["base_id"] != r["neighbour_id"] and 0 <= r["weight"] < 1
        for c in spec:
            a, b = rows[r["base_id"]][c.name], rows[r["neighbour_id"]][c.name]
            value = a + r["weight"] * (b - a)
            assert abs(r[c.name] - value) <= (0.5 if c.integer else 1e-12)
            assert min(a, b) <= r[c.name] <= max(a, b)
    again = R.synthetic_rows(df.repartition(5), "seq", spec, multiplier=20, k=10, keep_parents=True).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))


def test_oversampling_report_and_edges(spark):
    df = sample_frame(spark)
    row = R.smote_report(df, R.smote(df, "seq", k=10), k=10).first()
    assert (row["benign_original"], row["attack_original"], row["synthetic_attack"], row["attack_after"], row["k_neighbors"]) == (295, 5, 95, 100, 4)
    assert row["all_original_train_rows_preserved"]
    assert R.synthetic_rows(df, "seq", multiplier=1) is None and R.smote(df, multiplier=1).count() == 300
    with pytest.raises(ValueError, match="at least 2"):
        R.synthetic_rows(df.filter("label = 0 or seq = 0"), "seq")
    with pytest.raises(ValueError, match="multiplier"):
        R.synthetic_rows(df, "seq", multiplier=0)


def test_rows_without_an_id_are_numbered_by_content(spark):
    df = sample_frame(spark, 60, 12).drop("seq")
    df = df.unionAll(df)
    numbered = R.numbered_by_content(df, FEATURE_COLUMNS).orderBy("id").collect()
    assert [r["id"] for r in numbered] == list(range(120))
    assert [tuple(r)[1:] for r in numbered] == sorted(tuple(r)[1:] for r in numbered)
    first, second = (sorted(map(tuple, R.smote(d, multiplier=3).filter("is_synthetic = 1").collect())) for d in (df, df.repartition(7)))
    assert first == second and len(first) == 48


def test_row_index_is_dense(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "key")
    assert sorted(r[0] for r in R.row_index(df, "key", buckets=16).select("idx").collect()) == list(range(df.count()))


@pytest.fixture(scope="module")
def learnable(spark, tmp_path_factory):
    df = sample_frame(spark, 1500, 0, seed=4)
    hit = (F.col(FEATURE_COLUMNS[2]) + F.col(FEATURE_COLUMNS[4]) > 8).cast("int")
    path = str(tmp_path_factory.mktemp("learn") / "t")
    df.withColumn("label", hit).repartition(2, "seq").write.parquet(path)
    df = spark.read.parquet(path).drop("seq")
    return df


def test_baseline_bundle(spark, learnable, tmp_path):
    bundle = train_baseline(learnable, maxIter=5)
    row = evaluate_bundle(bundle, learnable).first()
    assert row["threshold"] == 0.5 and row["roc_auc"] > 0.9 and row["model"] == "boosted_baseline"
    save_bundle(bundle, str(tmp_path / "b"))
    kept = load_bundle(spark, str(tmp_path / "b"))
    first, second = (score_batch(b.model, learnable).select("probability").collect() for b in (bundle, kept))
    assert first == second and kept.threshold == 0.5 and kept.features == FEATURE_COLUMNS
    assert score_batch(bundle.model, learnable).drop("probability").schema == learnable.schema
    gains = feature_importance(spark, bundle).collect()
    assert len(gains) == 16 and {gains[0]["feature"], gains[1]["feature"]} == {FEATURE_COLUMNS[2], FEATURE_COLUMNS[4]}


def test_a_fit_of_few_files_is_dealt_out_to_all_cores(spark, learnable, monkeypatch):
    whole = learnable.coalesce(1)
    monkeypatch.setattr(model, "TASK_ROWS", 300)
    spread = model.model_matrix(whole)
    assert spread.rdd.getNumPartitions() == 5 and spread.count() == whole.count()
    spread.unpersist()
    monkeypatch.setattr(model, "TASK_ROWS", 2000)  # too few rows for a second task
    kept = model.model_matrix(whole)
    assert kept.rdd.getNumPartitions() == 1 and kept.storageLevel.useDisk
    kept.unpersist()


def test_weighted_stops_early_and_repeats(spark, learnable):
    a = train_weighted(learnable, learnable, patience=3, block=4, maxIter=12)
    b = train_weighted(learnable, learnable, patience=3, block=4, maxIter=12)
    assert a.info == b.info and a.threshold == b.threshold
    assert len(a.model.stages[-1].trees) == a.info["best_iteration"] + 1 <= 12
    assert a.info["validation_recall"] >= 0.8 and a.info["recall_target_met"]
    assert abs(a.info["scale_pos_weight"] ** 2 - a.info["raw_scale_pos_weight"]) < 1e-9
    row = evaluate_bundle(a, learnable).first()
    assert row["pr_auc"] > 0.8 and row["train_source"] == "original"


def test_tree_prefixes_score_like_shorter_fits(spark, learnable):
    matrix = model_matrix(learnable)
    long = train_baseline(learnable, maxIter=6).model.stages[-1]
    got, rows = prefix_scores(long, matrix.withColumn("margin", F.lit(0.0)), 1, 4)
    more, rows = prefix_scores(long, rows, 5, 6)
    got.update(more)
    rows.unpersist()
    for n in (2, 6):
        short = train_baseline(learnable, maxIter=n)
        want = average_precision(score_batch(short.model, learnable)).first()[0]
        assert abs(got[n] - want) < 1e-9
    matrix.unpersist()


def test_training_needs_positives(spark, learnable):
    with pytest.raises(ValueError, match="positive"):
        train_weighted(learnable.filter("label = 0"), learnable)
    assert evaluate_model(learnable.withColumn("probability", F.lit(0.5)), 0.5).first()["roc_auc"] == 0.5


def test_closest_takes_differences_of_near_rows_only(monkeypatch):
    """The same places and distances, ties included, as by all differences; these are not taken."""
    import numpy as np

    from gatewatch.operators import neighbours as N

    r = np.random.default_rng(3)
    for a, b in ((r.normal(size=(50, 64)), r.normal(size=(700, 64))), (np.rint(r.normal(size=(50, 3)) * 9), np.rint(r.normal(size=(700, 3)) * 9)),
                 (1e6 + r.normal(size=(50, 16)), 1e6 + r.normal(size=(700, 16)))):
        whole = N._distances(a, b)
        best = np.argsort(whole, axis=1, kind="stable")[:, :6]
        with monkeypatch.context() as m:
            m.setattr(N, "_distances", None)
            places, distances = N._closest(a, b, 6)
        assert (places == best).all() and (distances == np.take_along_axis(whole, best, 1)).all()
    same, few = np.ones((400, 4)), np.arange(8.0).reshape(2, 4)
    assert (N._closest(same, same, 3)[0] == [0, 1, 2]).all() and N._closest(same, few, 3)[0].shape == (400, 2)
    gap = np.array([[np.nan, 0.0], [1.0, 1.0]])
    assert (N._closest(gap, np.arange(20.0).reshape(10, 2), 2)[0] == [[0, 1], [0, 1]]).all()


def test_points_that_ask_for_all_cells_are_not_copied(spark, monkeypatch):
    """In many columns no cell can be ruled out: blocks are then taken past each other, with the same neighbours, ties included, and
    no stored copies of points.
    """
    from gatewatch.operators import neighbours

    sizes = {}

    def counted(df, name, *folders, plain=neighbours.stage):
        out = plain(df, name, *folders)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(neighbours, "stage", counted)
    rng = np.random.default_rng(5)
    points = np.rint(rng.normal(0, 1, (600, 24)) * 1.2)
    points[50:90] = points[0]
    df = spark.createDataFrame([(7 * i, *map(float, p)) for i, p in enumerate(points)], "id bigint, " + ", ".join(f"c{j} double" for j in range(24)))
    find = lambda f=nearest, **kw: f(df, "id", [f"c{j}" for j in range(24)], 5, scale=False, block_points=40, **kw)
    got = {r["id"]: r["neighbours"] for r in find().collect()}
    assert "knn-asked" not in sizes and sizes["knn-best"] <= 6 * len(points) * neighbours.PASSES
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for i, entries in got.items():
        order = np.lexsort((np.arange(600), d[i // 7]))[:5]
        assert [e["id"] for e in entries] == (7 * order).tolist() and [e["distance2"] for e in entries] == d[i // 7][order].tolist()
        assert [e["values"] for e in entries] == points[order].tolist()
    short = find(neighbours.knn_minority).collect()
    assert sorted(map(tuple, short)) == sorted((i, n, e["id"]) for i, es in got.items() for n, e in enumerate(es, 1))
    monkeypatch.setattr(neighbours, "_too_many", lambda *a: False)
    assert {r["id"]: r["neighbours"] for r in find().collect()} == got and "knn-asked" in sizes


def test_best_of_blocks_equals_one_search():
    """Blocks taken one after the other, with copies, ties, a gap and fewer points than needed."""
    from gatewatch.operators import neighbours as N

    r = np.random.default_rng(8)
    for z in (np.rint(r.normal(size=(900, 3)) * 4), r.normal(size=(900, 20)), np.vstack([r.normal(size=(60, 4)), np.full((1, 4), np.nan)]), np.ones((3, 2))):
        ids, best = r.permutation(len(z)) * 3, N._Best(z, 6)
        for at in np.array_split(r.permutation(len(z)), 5):
            at = at[np.argsort(ids[at])]  # as in a block
            if len(at):
                best.take(np.arange(len(z)), ids[at], z[at])
        d = N._distances(z, z)
        for i in range(len(z)):
            order = np.lexsort((ids, d[i]))[:6]
            assert best.other[i][: len(order)].tolist() == ids[order].tolist()
            np.testing.assert_array_equal(best.distance[i][: len(order)], d[i][order])
            assert (best.other[i][len(order):] == N.LAST_ID).all()


def test_first_trees_are_the_model_of_a_shorter_fit(spark, learnable, tmp_path, monkeypatch):
    """The weighted model is cut from its last fit: scores, importances and what is saved are those of a shorter fit."""
    long, short = (train_baseline(learnable, maxIter=n) for n in (6, 2))
    cut = model.Bundle(model.PipelineModel([long.model.stages[0], first_trees(long.model.stages[-1], 2)]), 0.5, long.info)
    assert first_trees(long.model.stages[-1], 6) is long.model.stages[-1] and len(long.model.stages[-1].trees) == 6
    assert cut.model.stages[-1].getMaxIter() == 2 and cut.model.stages[-1].treeWeights == short.model.stages[-1].treeWeights
    save_bundle(cut, str(tmp_path / "cut"))
    kept = load_bundle(spark, str(tmp_path / "cut"))
    assert kept.model.stages[-1].getMaxIter() == 2 and kept.model.stages[-1].toDebugString.split("\n", 1)[1] == short.model.stages[-1].toDebugString.split("\n", 1)[1]
    want, *got = ([r[0] for r in score_batch(b.model, learnable).select("probability").collect()] for b in (short, cut, kept))
    assert got == [want, want] and feature_importance(spark, cut).collect() == feature_importance(spark, short).collect()
    fits, plain = [], model.GBTClassifier.fit
    monkeypatch.setattr(model.GBTClassifier, "fit", lambda self, df: fits.append(self.getMaxIter()) or plain(self, df))
    bundle = train_weighted(learnable, learnable, patience=2, block=2, maxIter=8)
    assert fits == sorted(set(fits)) and len(bundle.model.stages[-1].trees) == bundle.info["best_iteration"] + 1
