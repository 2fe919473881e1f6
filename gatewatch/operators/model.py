"""Boosted-tree training and scoring on Spark ML.

Figures differ from those of other boosting libraries: there are no L1 and L2 penalties on leaves, columns are sampled per
node, ``minInstancesPerNode`` counts rows, and importance is total gain, normalised. A fit repeats for the same seed and
the same partitioning of its input.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from gatewatch.functions.scalar import coerce_label
from gatewatch.operators.evaluate import (
    DEFAULT_BINS,
    DEFAULT_RECALL,
    average_precision,
    class_weight,
    evaluate_model,
    select_threshold,
)
from gatewatch.operators.quality import require_min_positives, require_no_nan
from gatewatch.schemas import FEATURE_COLUMNS
from gatewatch.session import ensure_checkpoint_dir
from gatewatch.sources.tables import scan_model_matrix

# Settings of the two models.
BASELINE = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "maxBins": 256, "seed": 42}
WEIGHTED = {"maxIter": 500, "maxDepth": 4, "stepSize": 0.03, "maxBins": 256, "seed": 42, "subsamplingRate": 0.7,
            "featureSubsetStrategy": "0.7", "minInstancesPerNode": 5}
PATIENCE = 40
BASELINE_THRESHOLD = 0.5
TASK_ROWS = 20_000  # a fit passes over its rows some hundred times: below this a further task costs more than it saves


@dataclass
class Bundle:
    """A fitted model with what is needed to score and report."""

    model: PipelineModel
    threshold: float
    info: dict

    @property
    def features(self) -> list[str]:
        return self.model.stages[0].getInputCols()


def model_matrix(df: DataFrame) -> DataFrame:
    """Feature vector and label, kept on the executors' disks while a fit reads them repeatedly, and dealt out to all cores where
    the files behind ``df`` are fewer and the rows enough.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    matrix = scan_model_matrix(df).withColumn("label", coerce_label("label").cast("double"))
    require_no_nan(matrix, FEATURE_COLUMNS)
    kept = _assembler().transform(matrix).select("features", "label").persist(StorageLevel.DISK_ONLY)
    sizes = kept.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("rows"), F.count("*").alias("parts")).first()
    wanted = min(spark.sparkContext.defaultParallelism, (sizes["rows"] or 0) // TASK_ROWS)
    if sizes["parts"] >= wanted:
        return kept
    spread = kept.repartition(wanted).persist(StorageLevel.DISK_ONLY)
    try:
        spread.count()
    finally:
        kept.unpersist()
    return spread


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=FEATURE_COLUMNS, outputCol="features")


def _probability(column: str = "probability"):
    return vector_to_array(F.col(column))[1]


def score_batch(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Append ``probability`` of the positive class. The model sees features rounded to float, as in training; the columns
    themselves come back as they were.
    """
    names = model.stages[0].getInputCols()
    scored = model.transform(df.withColumn("_exact", F.struct(*names)).withColumns({n: F.col(n).cast("float") for n in names}))
    back = {n: F.col("_exact")[n] for n in names}
    return scored.withColumn("probability", _probability()).withColumns(back).select(*df.columns, "probability")


def train_baseline(train: DataFrame, **settings) -> Bundle:
    """Unweighted model with a fixed threshold of one half."""
    matrix = model_matrix(train)
    try:
        fitted = GBTClassifier(**{**BASELINE, **settings}).fit(matrix)
    finally:
        matrix.unpersist()
    return Bundle(PipelineModel([_assembler(), fitted]), BASELINE_THRESHOLD, {"model": "boosted_baseline"})


def prefix_scores(fitted, rows: DataFrame, first: int, last: int) -> tuple[dict[int, float], DataFrame]:
    """Average precision of the first ``n`` trees, for ``n`` in ``first..last``, in one job.

    ``rows`` has ``features``, ``label`` and ``margin``, the weighted sum of the trees before ``first``. Also returns the same
    rows with the margin after ``last`` trees, so that no tree is evaluated twice.
    """
    trees, weights = fitted.trees, fitted.treeWeights
    scored, margin, steps = rows, F.col("margin"), []
    for n in range(first, last + 1):
        scored = trees[n - 1].setFeaturesCol("features").setPredictionCol(f"_t{n}").transform(scored)
        margin = margin + F.col(f"_t{n}") * float(weights[n - 1])
        steps.append(F.struct(F.lit(n).alias("trees"), margin.alias("score")))
    kept = scored.select("features", "label", margin.alias("margin"), F.array(*steps).alias("_steps")).persist(StorageLevel.DISK_ONLY)
    long = kept.select("label", F.inline("_steps"))
    found = average_precision(long, by="trees", label="label", probability="score").collect()
    return {row["trees"]: row["pr_auc"] or 0.0 for row in found}, kept


def first_trees(fitted: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The model that a fit of ``n`` trees gives, taken from a longer fit."""
    if n == len(fitted.treeWeights):
        return fitted
    gateway, java = SparkSession.active().sparkContext._gateway, fitted._java_obj
    jvm = gateway.jvm.org.apache.spark.ml
    trees, weights = gateway.new_array(jvm.regression.DecisionTreeRegressionModel, n), gateway.new_array(gateway.jvm.double, n)
    for i, tree in enumerate(java.trees()[:n]):
        trees[i], weights[i] = tree, float(fitted.treeWeights[i])
    short = GBTClassificationModel(jvm.classification.GBTClassificationModel(java.uid(), trees, weights, fitted.numFeatures, fitted.numClasses))
    return fitted._copyValues(short, {fitted.maxIter: n})


def train_weighted(train: DataFrame, valid: DataFrame, train_source: str = "original", patience: int = PATIENCE,
                   bins: int = DEFAULT_BINS, min_recall_target: float = DEFAULT_RECALL, block: int = 10, **settings) -> Bundle:
    """Weighted model; the number of trees is the one after which ``patience`` more bring no better average precision on
    ``valid``; the threshold is chosen on ``valid`` too.

    Trees are fitted in growing rounds, so a model that peaks early does not pay for all ``maxIter`` trees. Boosting adds
    trees one after the other from fixed seeds, so the first n trees of a longer fit are the n trees of a shorter one: the
    model is cut from the last fit and not fitted once more.
    """
    if train_source not in ("original", "smote"):
        raise ValueError("train_source must be 'original' or 'smote'")
    settings = {**WEIGHTED, **settings}
    most = settings.pop("maxIter")
    require_min_positives(train, 1)
    weights = class_weight(train.withColumn("label", coerce_label("label"))).first()
    weight = F.when(F.col("label") == 1, F.lit(weights["scale_pos_weight"])).otherwise(F.lit(1.0))
    matrix, held = model_matrix(train), model_matrix(valid)
    try:
        weighted = matrix.withColumn("weight", weight)
        best, best_score, seen, size = 0, float("-inf"), 0, min(most, patience + block)
        rows = held.withColumn("margin", F.lit(0.0))
        while True:
            fitted = GBTClassifier(maxIter=size, weightCol="weight", **settings).fit(weighted)
            stop = False
            while seen < len(fitted.trees) and not stop:
                upto = min(seen + block, len(fitted.trees))
                found, after = prefix_scores(fitted, rows, seen + 1, upto)
                rows.unpersist()
                rows = after
                for n, value in sorted(found.items()):
                    if value > best_score:
                        best, best_score = n, value
                    stop = stop or n - best >= patience
                seen = upto
            if stop or size >= most:
                break
            size = min(most, size * 2)
        fitted = first_trees(fitted, best)
        model = PipelineModel([_assembler(), fitted])
        scores = fitted.transform(held).select("label", _probability().alias("probability"))
        chosen = select_threshold(scores, bins, min_recall_target).first().asDict()
    finally:
        for frame in (matrix, held, rows):
            frame.unpersist()
    info = {
        "model": "boosted_weighted" if train_source == "original" else "boosted_smote",
        "validation_precision": chosen["precision"], "validation_recall": chosen["recall"], "validation_f1": chosen["f1"],
        "validation_false_positive": chosen["false_positive"], "min_recall_target": min_recall_target,
        "recall_target_met": chosen["recall_target_met"], "threshold_strategy": chosen["threshold_strategy"],
        "raw_scale_pos_weight": weights["raw_scale_pos_weight"], "scale_pos_weight": weights["scale_pos_weight"],
        "train_source": train_source, "normal_train_rows": weights["normal_rows"], "anomaly_train_rows": weights["anomaly_rows"],
        "best_iteration": best - 1,
    }
    return Bundle(model, chosen["threshold"], info)


def evaluate_bundle(bundle: Bundle, test: DataFrame) -> DataFrame:
    """One row: test figures, then what training recorded."""
    row = evaluate_model(score_batch(bundle.model, test).select("label", "probability"), bundle.threshold, bundle.info["model"])
    return row.withColumns({k: F.lit(v) for k, v in bundle.info.items() if k != "model"})


def feature_importance(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """Feature and importance, largest first: one row per model column."""
    gains = bundle.model.stages[-1].featureImportances
    pairs = [(name, float(gains[i])) for i, name in enumerate(bundle.features)]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def save_bundle(bundle: Bundle, path: str) -> None:
    spark = SparkSession.active()
    bundle.model.write().overwrite().save(f"{path}/model")
    text = json.dumps({"threshold": bundle.threshold, "features": bundle.features, "info": bundle.info})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    kept = json.loads(spark.read.text(f"{path}/bundle").first()["value"])
    model = PipelineModel.load(f"{path}/model")
    if model.stages[0].getInputCols() != kept["features"]:
        raise ValueError("the model's columns are not those the bundle records")
    return Bundle(model, kept["threshold"], kept["info"])
