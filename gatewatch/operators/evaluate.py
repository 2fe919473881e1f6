"""Threshold choice and quality figures for rare positives, from scores and labels.

All of it works on sums per score bin or per distinct score, so raw rows cross the network once, already combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.functions.scalar import apply_threshold, clean_scores
from gatewatch.schemas import SECONDS_PER_DAY

DEFAULT_BINS = 10_000
DEFAULT_RECALL = 0.8
TIE = 1e-12
RANGES = 4096
GROUP_RANGES = 256  # per value of ``by``: several values share the tasks


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n_rows"))


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Negatives per positive, and the square root of it, which training uses as the positive weight."""
    sums = df.agg(F.sum((F.col(label) == 0).cast("bigint")).alias("normal_rows"), F.sum((F.col(label) == 1).cast("bigint")).alias("anomaly_rows"))
    ratio = F.when(F.col("anomaly_rows") > 0, F.col("normal_rows") / F.col("anomaly_rows"))
    return sums.withColumns({"raw_scale_pos_weight": ratio, "scale_pos_weight": F.sqrt(ratio)})


def score_histogram(df: DataFrame, bins: int = DEFAULT_BINS, label: str = "label", probability: str = "probability") -> DataFrame:
    """Positive and negative rows per score bin ``0..bins``; only bins that occur."""
    if bins < 2:
        raise ValueError("bins must be at least two")
    known = F.when(F.col(label).isin(0, 1), F.col(label).cast("bigint")).otherwise(
        F.raise_error(F.lit("labels must be 0 or 1")).cast("bigint"))
    bin_ = F.least(F.floor(clean_scores(probability) * bins), F.lit(bins)).cast("int")
    return (df.select(bin_.alias("bin"), known.alias("_y")).groupBy("bin")
            .agg(F.sum("_y").alias("positives"), F.sum(1 - F.col("_y")).alias("negatives")))


def threshold_curve(df: DataFrame, bins: int = DEFAULT_BINS, label: str = "label", probability: str = "probability") -> DataFrame:
    """For every bin as threshold: TP, FP, FN, precision, recall and F1. The ordered pass sees ``bins + 1`` rows."""
    found = score_histogram(df, bins, label, probability)
    grid = df.sparkSession.range(bins + 1).select(F.col("id").cast("int").alias("bin"))
    every = grid.join(found, "bin", "left").na.fill(0, ["positives", "negatives"])
    down = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = every.select(
        "bin", F.sum("positives").over(down).alias("true_positive"), F.sum("negatives").over(down).alias("false_positive"),
        F.sum("positives").over(Window.partitionBy()).alias("_all"))
    tp, fp = F.col("true_positive"), F.col("false_positive")
    rates = sums.withColumns({
        "false_negative": F.col("_all") - tp, "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, F.col("_all"))})
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", _ratio(2 * p * r, p + r)).drop("_all")


def select_threshold(df: DataFrame, bins: int = DEFAULT_BINS, min_recall_target: float = DEFAULT_RECALL,
                     label: str = "label", probability: str = "probability") -> DataFrame:
    """The bin with the best precision among those that reach the recall target; ties by F1, then the highest bin.

    One row. Running the result raises when there is no positive label. Bin 0 has recall 1, so the target is always met.
    """
    if not 0.0 < min_recall_target <= 1.0:
        raise ValueError("min_recall_target must be in (0, 1]")
    curve = threshold_curve(df, bins, label, probability)
    everything = Window.partitionBy()
    nothing = F.raise_error(F.lit("at least one positive label is needed")).cast("boolean")
    reaches = F.when(F.col("_all") > 0, F.col("recall") >= min_recall_target).otherwise(nothing)
    able = curve.withColumn("_all", F.max("true_positive").over(everything)).filter(reaches)
    for measure in ("precision", "f1"):
        able = able.withColumn("_best", F.max(measure).over(everything)).filter(F.col("_best") - F.col(measure) <= TIE)
    return able.orderBy(F.col("bin").desc()).limit(1).select(
        (F.col("bin") / bins).alias("threshold"), "precision", "recall", "f1", "true_positive", "false_positive",
        "false_negative", F.lit(float(min_recall_target)).alias("min_recall_target"), F.lit(True).alias("recall_target_met"),
        F.lit("max_precision_at_min_recall").alias("threshold_strategy"))


def _matrix(label: Column, prediction: Column, weight: Column) -> list[Column]:
    def cell(y: int, p: int, name: str) -> Column:
        return F.coalesce(F.sum(F.when((label == y) & (prediction == p), weight)), F.lit(0)).cast("bigint").alias(name)

    return [cell(0, 0, "true_negative"), cell(0, 1, "false_positive"), cell(1, 0, "false_negative"), cell(1, 1, "true_positive")]


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive"))
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {"accuracy": _ratio(tp + tn, tn + fp + fn + tp), "precision": p, "recall": r, "f1": _ratio(2 * tp, 2 * tp + fp + fn)}


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(*_matrix(F.col(label), F.col(prediction), F.lit(1)))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return confusion_matrix(df, label, prediction).select("*", *[c.alias(n) for n, c in _rates().items()])


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows normal, anomaly, accuracy, macro avg and weighted avg: precision, recall, F1 and support."""
    tn, fp, fn, tp = (F.col(c) for c in ("true_negative", "false_positive", "false_negative", "true_positive"))

    def line(name, p, r, f, n):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), n.cast("bigint").alias("support"))

    normal = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fn + fp))
    anomaly = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fn + fp))
    n0, n1 = tn + fp, fn + tp
    accuracy = _ratio(tp + tn, n0 + n1)
    macro = [(a + b) / 2 for a, b in zip(normal, anomaly)]
    weighted = [_ratio(a * n0 + b * n1, n0 + n1) for a, b in zip(normal, anomaly)]
    lines = F.array(line("normal", *normal, n0), line("anomaly", *anomaly, n1), line("accuracy", accuracy, accuracy, accuracy, n0 + n1),
                    line("macro avg", *macro, n0 + n1), line("weighted avg", *weighted, n0 + n1))
    return confusion_matrix(df, label, prediction).select(F.inline(lines))


def ranking_points(df: DataFrame, label: str = "label", probability: str = "probability", ranges: int | None = None,
                   by: str | None = None) -> DataFrame:
    """Per distinct score: its positives and negatives, and how many of both score at least as high.

    Distinct scores are cut at quantiles into ``ranges`` ranges (rounded up to a power of two) of about equal size; a running sum is
    taken inside each range in parallel, and the totals of the higher ranges (at most ``ranges`` rows) are added. With
    ``by``, all of this per value of a column with few values, such as the number of a model.
    """
    group = [by] if by else []
    rows = df.select(*group, F.col(probability).cast("double").alias("score"), F.col(label).cast("bigint").alias("y"))
    return _ranked(rows.groupBy(*group, "score").agg(F.sum("y").alias("positives"), F.sum(1 - F.col("y")).alias("negatives")), ranges, by)


def _ranked(sums: DataFrame, ranges: int | None, by: str | None) -> DataFrame:
    """``ranking_points`` from one row of ``positives`` and ``negatives`` per distinct score."""
    ranges = ranges or (GROUP_RANGES if by else RANGES)
    steps = max(1, (ranges - 1).bit_length())
    ranges = 1 << steps
    group = [by] if by else []
    # The cuts come from the distinct scores too, with their sums: both branches start from the same exchange, so rows are read once.
    quantiles = F.percentile_approx(F.when(F.col("positives") + F.col("negatives") > 0, F.col("score")), [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts")
    if by:
        placed = sums.join(F.broadcast(sums.groupBy(by).agg(quantiles)), by)
    else:
        placed = sums.withColumn("_cuts", sums.select(quantiles).scalar())
    # How many cuts lie below the score, by halving: the cuts are sorted and one fewer than a power of two.
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    place = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.col("_cuts")[at + half - 1] < F.col("score"), at + half).otherwise(at))
    placed = placed.withColumn("_range", place).drop("_cuts")
    above = Window.partitionBy(*group).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "_range").agg(F.sum("positives").alias("_p"), F.sum("negatives").alias("_n"))
    totals = totals.select(*group, "_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_p", "_n")])
    down = Window.partitionBy(*group, "_range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    # Every range has a total; a left join keeps its place from being worked out on raw rows as an inferred filter.
    return placed.join(F.broadcast(totals), [*group, "_range"], "left").select(
        *group, "score", "positives", "negatives",
        (F.col("_p_above") + F.sum("positives").over(down)).alias("cum_positives"),
        (F.col("_n_above") + F.sum("negatives").over(down)).alias("cum_negatives"))


def _ranking_sums() -> list[Column]:
    p, n, cp, cn = (F.col(c).cast("double") for c in ("positives", "negatives", "cum_positives", "cum_negatives"))
    return [F.sum(p).alias("_P"), F.sum(n).alias("_N"),
            F.sum(n * (cp - p / 2)).alias("_wins"), F.sum(F.when(p > 0, p * cp / (cp + cn)).otherwise(0.0)).alias("_steps")]


def _ranking_figures() -> dict[str, Column]:
    both = (F.col("_P") > 0) & (F.col("_N") > 0)
    return {"roc_auc": F.when(both, F.col("_wins") / (F.col("_P") * F.col("_N"))), "pr_auc": F.when(both, F.col("_steps") / F.col("_P"))}


def roc_auc(df: DataFrame, **kw) -> DataFrame:
    """Area under the ROC curve, equal scores counting half; null when only one class occurs."""
    return ranking_points(df, **kw).agg(*_ranking_sums()).select(_ranking_figures()["roc_auc"].alias("roc_auc"))


def average_precision(df: DataFrame, by: str | None = None, **kw) -> DataFrame:
    """Step sum of precision over the recall gained at each distinct score; null when only one class occurs."""
    group = [by] if by else []
    sums = ranking_points(df, by=by, **kw).groupBy(*group).agg(*_ranking_sums())
    return sums.select(*group, _ranking_figures()["pr_auc"].alias("pr_auc"))


def average_precision_of_sums(sums: DataFrame, by: str, ranges: int | None = None) -> DataFrame:
    """``average_precision`` by group of rows that were counted in parts: ``positives`` and ``negatives`` of a ``score``, which may come often."""
    whole = sums.groupBy(by, "score").agg(F.sum("positives").alias("positives"), F.sum("negatives").alias("negatives"))
    return _ranked(whole, ranges, by).groupBy(by).agg(*_ranking_sums()).select(by, _ranking_figures()["pr_auc"].alias("pr_auc"))


def evaluate_model(df: DataFrame, threshold: float | Column, name: str = "model", label: str = "label",
                   probability: str = "probability") -> DataFrame:
    """One row with the confusion counts, rates and ranking figures, all from one pass over distinct scores."""
    points = ranking_points(df, label, probability)
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    # A distinct score is one prediction, so its positives and negatives go to one row of the matrix each.
    sides = points.withColumn("_alert", apply_threshold("score", limit))
    alert = F.col("_alert") == 1

    def total(column: str, hit: Column, alias: str) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col(column))), F.lit(0)).cast("bigint").alias(alias)

    sums = sides.agg(
        total("negatives", ~alert, "true_negative"), total("negatives", alert, "false_positive"),
        total("positives", ~alert, "false_negative"), total("positives", alert, "true_positive"), *_ranking_sums())
    rates = {n: c.alias(n) for n, c in _rates().items()}
    figures = {n: c.alias(n) for n, c in _ranking_figures().items()}
    return sums.select(
        F.lit(name).alias("model"), rates["accuracy"], rates["precision"], rates["recall"], rates["f1"],
        "true_negative", "false_positive", "false_negative", "true_positive", figures["roc_auc"], figures["pr_auc"],
        limit.alias("threshold"))


def alert_volume(df: DataFrame, ts: str = "timestamp", label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Alerts and false positives per day."""
    alert = F.col(prediction) == 1
    return (df.groupBy(F.floor(F.col(ts) / SECONDS_PER_DAY).alias("day"))
            .agg(F.count("*").alias("events"), F.sum(alert.cast("bigint")).alias("alerts"),
                 F.sum((alert & (F.col(label) == 0)).cast("bigint")).alias("false_positives")))
