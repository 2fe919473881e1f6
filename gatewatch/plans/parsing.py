"""Raw files to parsed log, features and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.functions.scalar import clean_time, map_event_id, normalize_text
from gatewatch.operators.labels import label_join
from gatewatch.operators.quality import require_sorted

TEXT_COLUMNS = ["src_user", "dst_user", "src_computer", "dst_computer", "logon_type", "result"]


def clean_log(raw: DataFrame) -> DataFrame:
    """Typed time (rows without one are dropped), cleaned texts, and the event number."""
    return (raw.withColumns({"time": clean_time("time"), **{c: normalize_text(c) for c in TEXT_COLUMNS}})
            .filter(F.col("time").isNotNull())
            .withColumn("event_id", map_event_id("result")))


def clean_labels(raw: DataFrame) -> DataFrame:
    texts = ["src_user", "src_computer", "dst_computer"]
    return (raw.withColumns({"time": clean_time("time"), **{c: normalize_text(c) for c in texts}})
            .filter(F.col("time").isNotNull()).dropDuplicates())


def to_canonical(df: DataFrame, *extra: str) -> DataFrame:
    """The eight parsed columns under their canonical names, and any ``extra`` columns."""
    return df.select(
        F.col("time").alias("timestamp"), F.col("src_user").alias("src_username"), F.col("dst_user").alias("username"),
        F.col("src_computer").alias("src_host"), F.col("dst_computer").alias("destination_host"), "logon_type", "event_id",
        "label", *extra)


def parse(raw_log: DataFrame, raw_labels: DataFrame, check_order: bool = True) -> DataFrame:
    """Raw tables to the parsed log; keeps the ``seq`` that the scan attached. Raises if the log is not in time order, which one
    pass over its times finds out; ``check_order=False`` leaves that to the caller.
    """
    log = clean_log(raw_log)
    if check_order:
        require_sorted(log, "time")
    return to_canonical(label_join(log, clean_labels(raw_labels)), "seq")
