"""Chronological three-day split and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.functions.scalar import with_relative_day
from gatewatch.operators.quality import require_columns
from gatewatch.schemas import FEATURE_SCHEMA_VERSION, OUTPUT_COLUMNS, SECONDS_PER_DAY, SPLIT_NAMES


DAY_BITS = 62  # stored figures tell by a bit for each day, in turn, whether it has rows


def _named(day: Column) -> Column:
    return F.when(day == 0, SPLIT_NAMES[0]).when(day == 1, SPLIT_NAMES[1]).when(day == 2, SPLIT_NAMES[2])


def assign_split(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Append ``split``: train, valid or test for relative day 0, 1 or 2; null for any other day."""
    return with_relative_day(df, ts, "_day").withColumn("split", _named(F.col("_day"))).drop("_day")


def chronological_split(features: DataFrame, figures: dict | None = None) -> DataFrame:
    """Check the feature table, then assign the splits. Raises unless it spans exactly three non-empty days.

    With the ``figures`` that were stored when the table was written no row is read for it. Without them, one row of sums over two
    columns tells the first and last day and the bad labels: give it a stored table then, not an unfinished plan. Time order is a
    property of the rows' ``seq``: check it where that is known, with ``require_sorted``.
    """
    require_columns(features, OUTPUT_COLUMNS, exact=True)
    day = F.floor(F.col("timestamp") / SECONDS_PER_DAY)
    if figures is None:
        bad = F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1))
        found = features.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("rows"),
                             F.count_if(day.isNull()).alias("untimed"), bad.alias("bad_labels")).first().asDict()
    else:
        found = figures
    if not found["rows"]:
        raise ValueError("the feature table has no rows")
    if found["bad_labels"]:
        raise ValueError("labels must be 0 or 1")
    if found["untimed"]:
        raise ValueError(f"{found['untimed']} rows have no time and belong to no split")
    first, last = found["first_day"], found["last_day"]
    if last - first != len(SPLIT_NAMES) - 1 or _no_rows(features, day, first + 1, found.get("days")):
        raise ValueError(f"expected exactly three consecutive days; found days {first} to {last}")
    return features.withColumn("split", _named(day - F.lit(first)))


def _no_rows(features: DataFrame, day: Column, which: int, days: int | None) -> bool:
    return features.filter(day == which).isEmpty() if days is None else not days >> which % DAY_BITS & 1


def split_stats(split: DataFrame) -> DataFrame:
    """Rows, benign and anomalous rows and the time range of each split."""
    return split.groupBy("split").agg(
        F.count("*").alias("n_rows"),
        F.sum((F.col("label") == 0).cast("bigint")).alias("benign"),
        F.sum((F.col("label") == 1).cast("bigint")).alias("anomaly"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"))


def split_report(split: DataFrame) -> DataFrame:
    """One row: totals and the statistics of every split as a map. ``valid`` says whether all rows lie in one of three splits
    that each have rows, and all labels are 0 or 1; rows outside the splits are in no total.
    """
    stats = split_stats(split)
    inside = F.col("split").isNotNull()
    whole = (F.count("split") == len(SPLIT_NAMES)) & (F.count_if(~inside) == 0) & (F.sum("n_rows") == F.sum(F.col("benign") + F.col("anomaly")))
    entry = F.struct(F.col("split"), F.struct("n_rows", "benign", "anomaly", "min_timestamp", "max_timestamp"))
    return stats.agg(
        F.coalesce(whole, F.lit(False)).alias("valid"),
        F.lit(FEATURE_SCHEMA_VERSION).alias("feature_schema_version"),
        F.sum(F.when(inside, F.col("n_rows"))).alias("total_rows"),
        F.sum(F.when(inside, F.col("anomaly"))).alias("total_anomaly"),
        F.floor(F.min(F.when(inside, F.col("min_timestamp"))) / SECONDS_PER_DAY).alias("first_day_index"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(inside, entry)))).alias("splits"))
