"""Known-attack labels: typed distinct keys, the null-safe label join, and record de-duplication."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.schemas import LABEL_KEYS


def dedup_labels(labels: DataFrame) -> DataFrame:
    return labels.select(*LABEL_KEYS).dropDuplicates()


def label_join(log: DataFrame, labels: DataFrame, keys: Sequence[str] = tuple(LABEL_KEYS)) -> DataFrame:
    """Append ``label``: 1 where all keys equal a known attack (null equals null), else 0. Row count is kept.

    No broadcast hint: Spark broadcasts the label side when its size is under the threshold, and otherwise joins by
    sorted partitions, which adaptive execution splits when one key is heavy.
    """
    known = dedup_labels(labels).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(1).alias("_hit"))
    same = reduce(lambda a, b: a & b, [log[k].eqNullSafe(known[f"_k_{k}"]) for k in keys])
    joined = log.join(known, same, "left")
    return joined.select(*log.columns, F.coalesce("_hit", F.lit(0)).cast("tinyint").alias("label"))


def dedup_records(df: DataFrame, keys: str | Sequence[str] = "record_id", order: Sequence[str] = ("timestamp", "seq")) -> DataFrame:
    """Keep the first row per record; rows that lack one of the ``keys`` are all kept. Record numbers are those of one machine:
    name its column too where events come from several.

    ``row_number() = 1`` is cut down inside each input partition before the exchange, so a repeated id sends one row
    per task. Rows without an id skip the exchange.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    first = Window.partitionBy(*keys).orderBy(*order)
    kept = df.filter(whole).withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return kept.unionByName(df.filter(~whole))
