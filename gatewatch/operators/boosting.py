"""Boosted trees with leaf penalties: second-order histogram boosting as Spark jobs.

The matrix is binned once and stored as 16 bytes a row with a row number and the label. From there its rows are kept by the block, as
numpy columns with the margin so far, in the executors' memory or on their disks; what is lost is made again from the stored rows. For
every level of a tree one job sums gradient and hessian by node, column and bin: inside a task with numpy, across tasks as whole numbers, so
that no order of adding changes a split. The driver sees at most ``2 ** depth * columns * bins`` sums from each of ``DIRECT`` tasks and picks
the best split of each node. A tree is fitted once; the next one goes on from the margin. Every ``block`` trees the margins are worked out
anew, the trees are scored on the validation day in one job, and fitting stops after ``patience`` trees without a better average precision.

Leaves take an L1 and an L2 penalty, a child needs ``min_child_weight`` of hessian, each tree sees a share of the rows (by a hash of
row number and tree) and of the columns (drawn from the seed).
"""

from __future__ import annotations

import json
import pickle
import random
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.functions.scalar import coerce_label
from gatewatch.operators.evaluate import DEFAULT_BINS, DEFAULT_RECALL, average_precision_of_sums, class_weight, evaluate_model, select_threshold
from gatewatch.operators.neighbours import stage
from gatewatch.operators.quality import require_min_positives, require_no_nan
from gatewatch.schemas import FEATURE_COLUMNS
from gatewatch.sources.tables import scan_model_matrix

# Settings of the weighted model.
SETTINGS = {"n_estimators": 500, "max_depth": 4, "learning_rate": 0.03, "subsample": 0.7, "colsample_bytree": 0.7,
            "min_child_weight": 5.0, "reg_alpha": 1.0, "reg_lambda": 2.0, "max_bin": 256, "seed": 42}
PATIENCE = 40
UNITS = 1 << 20  # sums are rounded to this part of one in each task
MATRIX = "row bigint, bins binary, label tinyint"
DIRECT = 64  # the sums of more tasks than these are added up on the executors first
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # row numbers, bins by column, labels, margins


@dataclass
class Tree:
    """Nodes as in a heap: the children of ``i`` are ``2 i + 1`` and ``2 i + 2``; ``column`` is -1 at leaves. Rows whose bin is at most ``bin``
    go left.
    """

    column: list[int]
    bin: list[int]
    leaf: list[float]
    gain: list[float]

    def nodes(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node each row ends in, or has come to after ``levels``. ``bins`` is read by column."""
        depth = (len(self.column) + 1).bit_length() - 2
        levels = depth if levels is None else min(levels, depth)
        # All rows go down ``levels`` steps, past a leaf to the left; the heap is small, so a step is a few passes over short numbers.
        at = np.zeros(len(bins), np.min_scalar_type(2 ** (levels + 1)))
        for level in range(levels):
            right = np.zeros(len(bins), bool)
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                if self.column[i] >= 0:
                    right |= (at == i) & (bins[:, self.column[i]] > self.bin[i])
            at = at * at.dtype.type(2) + at.dtype.type(1) + right
        ends = []
        for i in range(2 ** (levels + 1) - 1):
            parent = (i - 1) // 2
            ends.append(i if i == 0 or (ends[parent] == parent and self.column[parent] >= 0) else ends[parent])
        return np.array(ends)[at]


@dataclass
class BoostedModel:
    features: list[str]
    edges: list[list[float]]
    trees: list[Tree]
    threshold: float = 0.5
    info: dict = field(default_factory=dict)


def _margins(bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out, bins = np.zeros(len(bins)), np.asfortranarray(bins)
    for tree in trees:
        out += np.array(tree.leaf)[tree.nodes(bins)]
    return out


def _binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The number of edges below each value."""
    return np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, values.T)], axis=1).astype(np.uint8)


def bin_edges(df: DataFrame, features: list[str], max_bin: int) -> list[list[float]]:
    """At most ``max_bin - 1`` inner borders a column, at its quantiles."""
    steps = [i / max_bin for i in range(1, max_bin)]
    return [sorted(set(e)) for e in df.approxQuantile(features, steps, 0.25 / max_bin)]


def binned_matrix(df: DataFrame, features: list[str], edges: list[list[float]]) -> RDD[Block]:
    """The rows in blocks, with margins of 0. A row's number is a hash of its features and place, so that repeated rows are drawn apart."""
    plain = df.select(F.xxhash64(F.monotonically_increasing_id(), *features).alias("row"), F.col("label").cast("tinyint").alias("label"), *[F.col(c).cast("double").alias(c) for c in features])
    width = len(features)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _binned(np.stack([b.column(i + 2).to_numpy(zero_copy_only=False) for i in range(width)], axis=1), edges)
            ends = np.arange(len(bins) + 1, dtype=np.int32) * np.int32(width)
            packed = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bins))])
            yield pa.RecordBatch.from_arrays([b.column(0), packed, b.column(1)], names=["row", "bins", "label"])

    return _blocks(stage(plain.mapInArrow(encode, MATRIX), "binned"), width)


def _blocks(stored: DataFrame, width: int) -> RDD[Block]:
    """A block for each batch of stored rows, dealt out to all cores where the files are fewer."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(0).to_numpy(zero_copy_only=False), np.asfortranarray(_bins_of(b, width)), b.column(2).to_numpy(zero_copy_only=False), np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

    blocks = stored.mapInArrow(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0]))
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return _kept(blocks.repartition(cores) if blocks.getNumPartitions() < cores else blocks)


def _kept(blocks: RDD[Block]) -> RDD[Block]:
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    blocks.count()
    return blocks


def _bins_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The bins of a batch as a view of its buffer: all values are ``width`` bytes and none is null."""
    column = batch.column(1)
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(data, np.uint8, len(column) * width, first).reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def advanced(matrix: RDD[Block], trees: list[Tree], width: int) -> RDD[Block]:
    """The matrix with the trees added to its margins."""
    return _kept(matrix.map(lambda b: (*b[:3], b[3] + _margins(b[1], trees))))


def _drawn(rows: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether a tree sees each row: by its number's hash, the same on every attempt."""
    with np.errstate(over="ignore"):
        x = rows.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (tree + 1 + 1000003 * seed)) & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return x < np.uint64(min(2**64 - 1, int(share * 2**64)))


def level_sums(matrix: RDD[Block], recent: list[Tree], tree: Tree, number: int, level: int, columns: list[int], weight: float, width: int, settings: dict) -> np.ndarray:
    """Gradient and hessian by node of this level, column and bin, as whole numbers of ``1 / UNITS``."""
    first, many = 2**level - 1, 2**level
    share, seed = settings["subsample"], settings["seed"]

    def sums(blocks: Iterator[Block]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        total = np.zeros((2, many, len(columns), 256))
        for rows, bins, label, margin in blocks:
            chosen = np.flatnonzero(_drawn(rows, number, seed, share))
            bins, label = np.stack([bins[:, c].take(chosen) for c in range(width)], axis=1, out=np.empty((len(chosen), width), np.uint8, "F")), label[chosen]
            p = 1 / (1 + np.exp(-(margin[chosen] + _margins(bins, recent))))
            w = np.where(label == 1, weight, 1.0)
            node = tree.nodes(bins, level) - first
            here = node >= 0  # other rows ended in a leaf above
            g, h, node = w * (p - label), w * p * (1 - p), node * 256
            if not here.all():
                g, h, node, bins = g[here], h[here], node[here], np.asfortranarray(bins[here])
            for j, c in enumerate(columns):
                key = node + bins[:, c]
                for k, value in enumerate((g, h)):
                    total[k, :, j] += np.bincount(key, value, many * 256).reshape(many, 256)
        total = total.reshape(2, -1)
        at = np.flatnonzero(total[1])
        yield at, np.rint(total[:, at] * UNITS).astype(np.int64)

    def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((2, many * len(columns) * 256), np.int64)
        for at, values in parts:
            out[:, at] += values
        return out

    def both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        out = added([a, b])
        at = np.union1d(a[0], b[0])
        return at, out[:, at]

    found = matrix.mapPartitions(sums)
    parts = found.collect() if found.getNumPartitions() <= DIRECT else [found.treeReduce(both)]
    return added(parts).reshape(2, many, len(columns), 256)


def _weighed(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_splits(sums: np.ndarray, settings: dict) -> dict[int, tuple]:
    """Per node: gain, place of the column, bin, and gradient and hessian of both sides. Ties go to the first column and lowest bin."""
    alpha, lam, least = settings["reg_alpha"], settings["reg_lambda"], settings["min_child_weight"]
    dense = sums / UNITS
    score = lambda g, h: _weighed(g, alpha) ** 2 / (h + lam)
    left_g, left_h = np.cumsum(dense[0], axis=2), np.cumsum(dense[1], axis=2)
    all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = np.where((left_h >= least) & (right_h >= least), (score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)) / 2, 0)
    out = {}
    for node in range(len(gain)):
        j, b = np.unravel_index(int(gain[node].argmax()), gain[node].shape)
        if gain[node, j, b] > 1e-9:
            out[node] = (float(gain[node, j, b]), int(j), int(b), float(left_g[node, j, b]), float(left_h[node, j, b]), float(right_g[node, j, b]), float(right_h[node, j, b]))
    return out


def fit_tree(matrix: RDD[Block], recent: list[Tree], number: int, weight: float, width: int, settings: dict) -> Tree:
    depth, rate = settings["max_depth"], settings["learning_rate"]
    size = 2 ** (depth + 1) - 1
    tree = Tree([-1] * size, [0] * size, [0.0] * size, [0.0] * size)
    value = lambda g, h: float(-rate * _weighed(np.float64(g), settings["reg_alpha"]) / (h + settings["reg_lambda"]))
    columns = sorted(random.Random(settings["seed"] * 100_003 + number).sample(range(width), max(1, int(settings["colsample_bytree"] * width))))
    for level in range(depth):
        first, many = 2**level - 1, 2**level
        if level and not any(tree.column[(first + n - 1) // 2] >= 0 for n in range(many)):
            break
        sums = level_sums(matrix, recent, tree, number, level, columns, weight, width, settings)
        if level == 0 and sums[1].any():
            tree.leaf[0] = value(*(sums[:, 0, 0].sum(axis=1) / UNITS))
        for node, (gain, j, b, lg, lh, rg, rh) in best_splits(sums, settings).items():
            i = first + node
            tree.column[i], tree.bin[i], tree.gain[i] = columns[j], b, gain
            tree.leaf[2 * i + 1], tree.leaf[2 * i + 2] = value(lg, lh), value(rg, rh)
    return tree


def prefix_precision(matrix: RDD[Block], trees: list[Tree], first: int, width: int) -> dict[int, float]:
    """Average precision after each further tree, by the number of trees, in one job. Each block sends a row per distinct score."""

    def scores(block: Block) -> list[bytes]:
        _, bins, label, margin = block
        out = []
        for n, tree in enumerate(trees, first):
            margin = margin + _margins(bins, [tree])
            score, at = np.unique(margin, return_inverse=True)
            every, hits = np.bincount(at, minlength=len(score)), np.bincount(at, label == 1, len(score)).astype(np.int64)
            sums = pa.RecordBatch.from_arrays([pa.array(np.full(len(score), n, np.int32)), pa.array(score), pa.array(hits), pa.array(every - hits)], names=names)
            out.append(pickle.dumps(sums, 5))
        return out

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from (pickle.loads(x.as_py()) for x in b.column(0))

    names = ["trees", "score", "positives", "negatives"]
    packed = SparkSession.active().createDataFrame(matrix.flatMap(scores).map(lambda x: (x,)), "sums binary")
    sums = packed.mapInArrow(unpacked, "trees int, score double, positives bigint, negatives bigint")
    found = {r["trees"]: r["pr_auc"] or 0.0 for r in average_precision_of_sums(sums, "trees").collect()}
    return {n: found.get(n, 0.0) for n in range(first, first + len(trees))}


def train_boosted(train: DataFrame, valid: DataFrame, train_source: str = "original", patience: int = PATIENCE, block: int = 10,
                  bins: int = DEFAULT_BINS, min_recall_target: float = DEFAULT_RECALL, features: list[str] | None = None, **settings) -> BoostedModel:
    """The weighted model: positives weigh the root of negatives per positive; the number of trees is the one with the best average
    precision on ``valid``, the threshold the most precise one there that reaches the recall target.

    Raises without a positive row or with a missing feature. Equal inputs, in equal partitions, give the same model.
    """
    settings, features = {**SETTINGS, **settings}, features or FEATURE_COLUMNS
    require_min_positives(train, 1)
    weights = class_weight(train.withColumn("label", coerce_label("label"))).first()
    plain = [scan_model_matrix(d).withColumn("label", coerce_label("label")) for d in (train, valid)]
    for d in plain:
        require_no_nan(d, features)
    edges, width = bin_edges(plain[0], features, settings["max_bin"]), len(features)
    matrix, held = (binned_matrix(d, features, edges) for d in plain)
    trees: list[Tree] = []
    best, best_score, done = 0, float("-inf"), False
    while not done and len(trees) < settings["n_estimators"]:
        recent: list[Tree] = []
        for number in range(len(trees), min(len(trees) + block, settings["n_estimators"])):
            recent.append(fit_tree(matrix, recent, number, weights["scale_pos_weight"], width, settings))
        for n, value in prefix_precision(held, recent, len(trees) + 1, width).items():
            if value > best_score:
                best, best_score = n, value
            done = done or n - best >= patience
        trees += recent
        if not done:
            before = matrix, held
            matrix, held = (advanced(m, recent, width) for m in before)
            for m in before:
                m.unpersist()
    for m in (matrix, held):
        m.unpersist()
    model = BoostedModel(list(features), edges, trees[:best])
    chosen = select_threshold(score_boosted(model, valid).select(coerce_label("label").alias("label"), "probability"), bins, min_recall_target).first().asDict()
    model.threshold = chosen["threshold"]
    model.info = {
        "model": "boosted_weighted" if train_source == "original" else "boosted_smote",
        "validation_precision": chosen["precision"], "validation_recall": chosen["recall"], "validation_f1": chosen["f1"],
        "validation_false_positive": chosen["false_positive"], "min_recall_target": min_recall_target,
        "recall_target_met": chosen["recall_target_met"], "threshold_strategy": chosen["threshold_strategy"],
        "raw_scale_pos_weight": weights["raw_scale_pos_weight"], "scale_pos_weight": weights["scale_pos_weight"],
        "train_source": train_source, "normal_train_rows": weights["normal_rows"], "anomaly_train_rows": weights["anomaly_rows"],
        "best_iteration": best - 1, "fitted_trees": len(trees), "validation_pr_auc": best_score,
    }
    return model


def score_boosted(model: BoostedModel, df: DataFrame) -> DataFrame:
    """Append ``probability``; the model sees features rounded to float, as in training."""
    edges, trees = model.edges, model.trees

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        values = np.stack([c.to_numpy(np.float32).astype(np.float64) for c in columns], axis=1)
        return pd.Series(1 / (1 + np.exp(-_margins(_binned(values, edges), trees))))

    return df.withColumn("probability", probability(*model.features))


def evaluate_boosted(model: BoostedModel, test: DataFrame) -> DataFrame:
    """One row: test figures, then what training recorded."""
    row = evaluate_model(score_boosted(model, test).select("label", "probability"), model.threshold, model.info["model"])
    return row.withColumns({k: F.lit(v) for k, v in model.info.items() if k != "model"})


def boosted_importance(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """Feature and importance, largest first: the mean gain of its splits, as a share of the sum over all features."""
    gains, counts = np.zeros(len(model.features)), np.zeros(len(model.features))
    for tree in model.trees:
        for c, g in zip(tree.column, tree.gain):
            if c >= 0:
                gains[c] += g
                counts[c] += 1
    mean = gains / np.maximum(counts, 1)
    pairs = [(n, float(v)) for n, v in zip(model.features, mean / mean.sum() if mean.sum() else mean)]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def save_boosted(model: BoostedModel, path: str) -> None:
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_boosted(spark: SparkSession, path: str) -> BoostedModel:
    kept = json.loads(spark.read.text(path).first()["value"])
    return BoostedModel(kept["features"], kept["edges"], [Tree(**t) for t in kept["trees"]], kept["threshold"], kept["info"])
