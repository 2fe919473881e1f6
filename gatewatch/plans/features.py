"""The sixteen-feature table: three exchanges on the usual path, plus a second path for oversized keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.functions.scalar import (
    coerce_label,
    day_of_week,
    hour_of_day,
    is_business_hours,
    is_network_logon,
    is_success,
    valid_key,
)
from gatewatch.operators.neighbours import stage
from gatewatch.operators.windows import (
    CELL_ROWS,
    Count,
    Distinct,
    Family,
    flags_and_recencies,
    rolling,
    rolling_in_buckets,
    with_family,
)
from gatewatch.schemas import (
    FAILURE_EVENT_ID,
    FIVE_MINUTES,
    LEGACY_FEATURE_COLUMNS,
    ONE_HOUR,
    OUTPUT_COLUMNS,
    PARSED_COLUMNS,
)

MAX_GROUP_ROWS = 5_000_000

FAMILIES = (
    Family(
        key="src_username",
        rolling=(
            Count("auth_attempts_5m_per_src_user", FIVE_MINUTES),
            Count("successful_auths_5m_per_src_user", FIVE_MINUTES, "current_event_is_success"),
            Distinct("unique_src_computers_1h_per_src_user", "src_host", ONE_HOUR),
            Distinct("unique_dst_computers_5m_per_src_user", "destination_host", FIVE_MINUTES),
            Distinct("unique_dst_computers_1h_per_src_user", "destination_host", ONE_HOUR),
        ),
        pair_counts=(("prior_auth_count_1h_src_user_dst_computer", "destination_host", ONE_HOUR),),
        first_seen=(
            ("is_first_seen_src_user_src_computer", "src_host"),
            ("is_first_seen_src_user_dst_computer", "destination_host"),
        ),
        recency=(
            ("seconds_since_last_auth_by_src_user", None),
            ("seconds_since_last_src_user_dst_computer", "destination_host"),
        ),
    ),
    Family(
        key="src_host",
        rolling=(Distinct("unique_dst_users_1h_per_src_computer", "username", ONE_HOUR),),
        first_seen=(("is_first_seen_src_computer_dst_computer", "destination_host"),),
    ),
    Family(
        key="destination_host",
        rolling=(Distinct("unique_src_users_1h_per_dst_computer", "src_username", ONE_HOUR),),
    ),
)


def hot_keys(df: DataFrame, keys: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS) -> dict[str, DataFrame]:
    """Keys with more rows than one task should sort, per key column.

    A key is hot above ``max_group_rows`` rows, whatever the size of the table, so that no task ever sorts more. A column
    has at most ``rows / max_group_rows`` hot keys: two thousand in ten billion rows.
    """
    total = df.count()
    if total <= max_group_rows:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("column"), F.col(k).cast("string").alias("key")) for k in keys]))
    found = (df.select(pairs.alias("p")).select("p.*").filter(F.col("key").isNotNull())
             .groupBy("column", "key").count().filter(F.col("count") > max_group_rows).collect())
    out = {}
    for k in keys:
        values = [(row["key"],) for row in found if row["column"] == k]
        if values:
            out[k] = df.sparkSession.createDataFrame(values, f"`{k}` string")
    return out


def with_context(df: DataFrame) -> DataFrame:
    """The three features of the event itself, and a clean label."""
    return df.select(
        "*",
        is_success("event_id").alias("current_event_is_success"),
        hour_of_day("timestamp").alias("hour_of_day"),
        is_network_logon("logon_type").alias("is_network_logon"),
    ).withColumn("label", coerce_label("label"))


def family_by_cells(rows: DataFrame, family: Family, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Append the features of ``family`` by the operators that hold for keys of any size. ``rows`` is a stored table: each
    operator reads its sums from it, by the columns it needs, and appends to the same rows.
    """
    key, out = family.key, rows
    if family.rolling:
        out = rolling(out, [key], family.rolling, cell_rows=cell_rows, source=rows)
    for name, other, window in family.pair_counts:
        valid = valid_key(key, other).cast("int")
        out = rolling(out.withColumn("_valid", valid), [key, other], [Count(name, window, "_valid")], cell_rows=cell_rows,
                      source=rows.withColumn("_valid", valid)).drop("_valid")
    return flags_and_recencies(out, key, family.first_seen, family.recency, source=rows)


def add_families(events: DataFrame, families: Sequence[Family], max_group_rows: int = MAX_GROUP_ROWS,
                 cell_rows: int = CELL_ROWS, hot: dict[str, DataFrame] | None = None) -> DataFrame:
    """Append all features of ``families``; one exchange per family.

    Where keys exceed ``max_group_rows``, the rows are written apart, those of such keys in a folder of their own; either
    part gets its features in its own way and their union goes on to the next family. No other row is read or joined again.
    """
    if hot is None:
        hot = hot_keys(events, [f.key for f in families], max_group_rows)
    out = events
    for family in families:
        key = family.key
        if key not in hot:
            out = with_family(out, family)
            continue
        marked = out.join(F.broadcast(hot[key].withColumn("_hot", F.lit(True))), key, "left").select(*out.columns, F.col("_hot").isNotNull().alias("_hot"))
        parts = stage(marked, f"by-{key}", "_hot")
        cold, oversized = (parts.filter(F.col("_hot") == which).select(*out.columns) for which in (False, True))
        out = with_family(cold, family).unionByName(family_by_cells(oversized, family, cell_rows))
    return out


def only(name: str, families: Sequence[Family] = FAMILIES) -> Family:
    """The family of the feature ``name``, cut down to it."""
    family = next(f for f in families if name in f.names())
    return Family(family.key, tuple(r for r in family.rolling if r.name == name),
                  *(tuple(p for p in part if p[0] == name) for part in (family.pair_counts, family.first_seen, family.recency)))


def build_features(df: DataFrame, max_group_rows: int = MAX_GROUP_ROWS, cell_rows: int = CELL_ROWS,
                   keep: Sequence[str] = (), hot: dict[str, DataFrame] | None = None) -> DataFrame:
    """Parsed events (``PARSED_COLUMNS`` plus a unique bigint ``seq``) to the feature table and the columns in ``keep``."""
    events = with_context(df.select(*dict.fromkeys([*PARSED_COLUMNS, "seq", *keep])))
    return add_families(events, FAMILIES, max_group_rows, cell_rows, hot).select(*OUTPUT_COLUMNS, *keep)


BUCKET_SECONDS = 2 * ONE_HOUR


def crowded_buckets(df: DataFrame, keys: Sequence[str], bucket: int, max_group_rows: int = MAX_GROUP_ROWS) -> dict[str, DataFrame]:
    """Keys that have more rows in one bucket than a task should sort, per key column: at most ``rows / max_group_rows``."""
    out = {}
    for k in keys:
        place = F.floor(F.col("timestamp") / bucket)
        crowded = df.where(F.col(k).isNotNull()).groupBy(k, place.alias("_bucket")).count().where(F.col("count") > max_group_rows)
        found = crowded.select(k).distinct().collect()
        if found:
            out[k] = df.sparkSession.createDataFrame([(r[0],) for r in found], f"`{k}` string")
    return out


def build_features_in_buckets(df: DataFrame, bucket: int = BUCKET_SECONDS, max_group_rows: int = MAX_GROUP_ROWS,
                              cell_rows: int = CELL_ROWS, keep: Sequence[str] = ()) -> DataFrame:
    """The same table as :func:`build_features`, with every rolling feature taken inside time buckets with a halo.

    The label-joined rows are written once and read from there. No window over rows is partitioned by a key alone; a key with
    too many rows in one bucket takes the path by cells, which holds for any. First-seen flags and recencies look at one row per
    key and second.
    """
    events = stage(with_context(df.select(*dict.fromkeys([*PARSED_COLUMNS, "seq", *keep]))), "events")
    crowded = crowded_buckets(events, [f.key for f in FAMILIES], bucket, max_group_rows)
    out = events
    for family in FAMILIES:
        bounded = Family(family.key, family.rolling, family.pair_counts)
        if family.key not in crowded:
            out = rolling_in_buckets(out, bounded, bucket)
        else:
            marked = out.join(F.broadcast(crowded[family.key].withColumn("_hot", F.lit(True))), family.key, "left")
            parts = stage(marked.select(*out.columns, F.col("_hot").isNotNull().alias("_hot")), f"bucket-{family.key}", "_hot")
            few, many = (parts.where(F.col("_hot") == which).select(*out.columns) for which in (False, True))
            out = rolling_in_buckets(few, bounded, bucket).unionByName(family_by_cells(many, bounded, cell_rows))
        out = flags_and_recencies(out, family.key, family.first_seen, family.recency, source=events)
    return out.select(*OUTPUT_COLUMNS, *keep)


LEGACY_FAMILIES = (
    Family(
        key="src_username",
        rolling=(
            Count("failed_logins_5m_user", FIVE_MINUTES, "_failed"),
            Distinct("unique_src_ip_1h", "src_host", ONE_HOUR),
            Count("_failed_1h", ONE_HOUR, "_failed"),
            Count("_all_1h", ONE_HOUR),
        ),
    ),
    Family(
        key="src_host",
        rolling=(
            Count("failed_logins_5m_ip", FIVE_MINUTES, "_failed"),
            Distinct("unique_users_1h_per_ip", "src_username", ONE_HOUR),
        ),
    ),
)


def build_legacy_features(df: DataFrame, max_group_rows: int = MAX_GROUP_ROWS, cell_rows: int = CELL_ROWS,
                          keep: Sequence[str] = ()) -> DataFrame:
    """The older nine features: failures per user and source, their rate, variety, and the calendar."""
    events = df.select(*dict.fromkeys([*PARSED_COLUMNS, "seq", *keep])).withColumns({
        "_failed": (F.col("event_id") == FAILURE_EVENT_ID).cast("int"),
        "hour_of_day": hour_of_day("timestamp"),
        "day_of_week": day_of_week("timestamp"),
        "is_business_hours": is_business_hours("timestamp"),
        "is_network_logon": is_network_logon("logon_type"),
        "label": coerce_label("label"),
    })
    out = add_families(events, LEGACY_FAMILIES, max_group_rows, cell_rows)
    rate = F.when(F.col("_all_1h") > 0, F.col("_failed_1h") / F.col("_all_1h")).otherwise(0.0)
    return out.withColumn("failure_rate_1h", rate).select("timestamp", *LEGACY_FEATURE_COLUMNS, "label", *keep)
