"""Parquet tables between the stages, JSON reports, metric files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.operators.quality import require_columns
from gatewatch.operators.split import DAY_BITS
from gatewatch.schemas import FEATURE_COLUMNS, OUTPUT_COLUMNS, PARSED_COLUMNS, SECONDS_PER_DAY, SPLIT_NAMES
from gatewatch.sources.publish import publish, read_published


def write_parsed(df: DataFrame, path: str) -> None:
    """Parsed events by day. Rows arrive in file order, so each task touches one or two days: no shuffle."""
    day = F.floor(F.col("timestamp") / SECONDS_PER_DAY).alias("day")
    df.select(*PARSED_COLUMNS, "seq", day).write.mode("overwrite").partitionBy("day").parquet(path)


def load_parsed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Only what feature building reads; the scan skips all other columns."""
    df = load_parsed(spark, path)
    require_columns(df, [*PARSED_COLUMNS, "seq"])
    return df.select(*PARSED_COLUMNS, "seq")


def _day() -> Column:
    return F.floor(F.col("timestamp") / SECONDS_PER_DAY)


def _label_figures() -> dict[str, Column]:
    return {
        "rows": F.count(F.lit(1)),
        "positives": F.count_if(F.col("label") == 1),
        "bad_labels": F.count_if(F.coalesce(~F.col("label").isin(0, 1), F.lit(True))),
    }


def feature_figures() -> dict[str, Column]:
    """What is taken from a feature table while it is written: rows, labels, missing values, the days and which of them have rows."""
    missing = {f"missing_{c}": F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))) for c in FEATURE_COLUMNS}
    return _label_figures() | missing | {
        "untimed": F.count_if(F.col("timestamp").isNull()), "first_day": F.min(_day()), "last_day": F.max(_day()),
        "days": F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(_day(), F.lit(DAY_BITS)).cast("int"))),
    }


def feature_problems(figures: dict) -> list[str]:
    problems = [f"{figures['bad_labels']} labels are not 0 or 1"] if figures["bad_labels"] else []
    return problems + [f"{c} has {figures[f'missing_{c}']} missing values" for c in FEATURE_COLUMNS if figures[f"missing_{c}"]]


def write_features(df: DataFrame, path: str) -> dict:
    """The eighteen columns in their fixed order, by day, published once no label is bad and no feature is missing. One sort key per
    day keeps files few. Returns the figures, which are stored with the table.
    """
    ordered = df.select(*OUTPUT_COLUMNS, _day().alias("day")).repartitionByRange("day", "timestamp")
    return publish(ordered, path, feature_figures(), feature_problems, ["day"])


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return read_published(spark, path).select(*OUTPUT_COLUMNS)


def split_figures() -> dict[str, Column]:
    named = F.coalesce(F.col("split").isin(SPLIT_NAMES), F.lit(False))
    parts = {f"{name}_rows": F.count_if(F.col("split") == name) for name in SPLIT_NAMES}
    return _label_figures() | parts | {"part_rows": F.count_if(named), "part_positives": F.count_if(named & (F.col("label") == 1))}


def write_splits(df: DataFrame, path: str, whole: DataFrame | dict | None = None) -> dict:
    """Table with a ``split`` column, one folder per split, published once it has all rows in three splits that all have rows, and
    no bad label. ``whole`` is the table that was split, or the figures stored with it: rows and positives must be the same.
    All figures of ``df`` come from the pass that writes it; with stored figures nothing else is read.
    """
    if isinstance(whole, DataFrame):
        whole = {k: v or 0 for k, v in whole.agg(*[c.alias(n) for n, c in _label_figures().items()]).first().asDict().items()}

    def problems(found: dict) -> list[str]:
        wanted = whole or found
        out = [f"the split {name} has no rows" for name in SPLIT_NAMES if not found[f"{name}_rows"]]
        if (found["part_rows"], found["part_positives"]) != (wanted["rows"], wanted["positives"]):
            out.append(f"rows or positive labels were lost or added: {found['part_rows']} of {wanted['rows']} rows, {found['part_positives']} of {wanted['positives']} positives")
        return out + ([f"{found['bad_labels']} labels are not 0 or 1"] if found["bad_labels"] else [])

    return publish(df, path, split_figures(), problems, ["split"])


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return read_published(spark, path).filter(F.col("split") == split).drop("split")


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One flat row; the matrix and the text report are left out."""
    metrics.drop("confusion_matrix", "classification_report").coalesce(1).write.mode("overwrite").csv(path, header=True)


def scan_model_matrix(df: DataFrame) -> DataFrame:
    """The sixteen features as float and the label as byte; raises if one is absent."""
    require_columns(df, [*FEATURE_COLUMNS, "label"])
    return df.select(*[F.col(c).cast("float").alias(c) for c in FEATURE_COLUMNS], F.col("label").cast("tinyint").alias("label"))
