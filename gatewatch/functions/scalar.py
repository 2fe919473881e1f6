"""Row-level expressions: cleaning, coding, time, keys, alerts. All stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.schemas import (
    MARKER_TEXTS,
    NETWORK_LOGONS,
    NULL_TEXTS,
    RESULT_EVENT_IDS,
    SECONDS_PER_DAY,
    SUCCESS_EVENT_ID,
)

# Every character that counts as white space; none lies beyond U+3000.
_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends (``trim`` removes spaces only)."""
    return F.btrim(_col(c), F.lit(_SPACE))


def normalize_text(c: Column | str) -> Column:
    """Strip, then turn the texts that mean "missing" into null."""
    stripped = strip(c)
    return F.when(~stripped.isin(NULL_TEXTS), stripped)


def decimal_text(c: Column | str) -> Column:
    """The stripped text of a decimal number, else null: ``10d`` or ``0x1p3``, which a cast would take, are no numbers."""
    text = strip(_col(c).cast("string"))
    return F.when(text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), text)


def clean_time(c: Column | str) -> Column:
    """Text to whole seconds; a fraction is cut off; anything non-numeric becomes null."""
    text = decimal_text(c)
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def map_event_id(c: Column | str) -> Column:
    """``Success`` and ``Fail`` to their event numbers, everything else (and null) to 0."""
    value = _col(c)
    coded = reduce(lambda acc, kv: acc.when(value == kv[0], kv[1]), RESULT_EVENT_IDS.items(), F)
    return coded.otherwise(0).cast("smallint")


def hour_of_day(ts: Column | str) -> Column:
    """Hour 0-23 of an epoch second, floored also before 1970."""
    return F.floor(F.pmod(_col(ts), F.lit(SECONDS_PER_DAY)) / 3600).cast("int")


def day_of_week(ts: Column | str) -> Column:
    """Day 0-6, counted from the first day of the log's own clock."""
    return F.pmod(F.floor(_col(ts) / SECONDS_PER_DAY), F.lit(7)).cast("int")


def is_business_hours(ts: Column | str) -> Column:
    """1 for hours 8 to 17 of days 0 to 4."""
    return (hour_of_day(ts).between(8, 17) & day_of_week(ts).between(0, 4)).cast("int")


def is_network_logon(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string").isin(NETWORK_LOGONS), F.lit(False)).cast("int")


def is_success(c: Column | str) -> Column:
    """1 where the event number equals the success code, also when given as text; else 0."""
    return F.coalesce(decimal_text(c).try_cast("double") == SUCCESS_EVENT_ID, F.lit(False)).cast("int")


def valid_key_sql(*names: str) -> str:
    """SQL text: every named column is present and is not a marker such as ``?`` or ``-``."""
    space = "".join(f"\\u{ord(c):04x}" for c in _SPACE)
    markers = ", ".join(f"'{m}'" for m in MARKER_TEXTS)
    parts = [f"coalesce(btrim(`{n}`, '{space}') not in ({markers}), false)" for n in names]
    return "(" + " and ".join(parts) + ")"


def valid_key(*names: str) -> Column:
    """True where every named column is present and is not a marker such as ``?`` or ``-``."""
    return F.expr(valid_key_sql(*names))


def coerce_label(c: Column | str) -> Column:
    """Null or unreadable labels count as 0."""
    return F.coalesce(decimal_text(c).try_cast("double").try_cast("tinyint"), F.lit(0).cast("tinyint"))


def apply_threshold(probability: Column | str, threshold: float | Column) -> Column:
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (_col(probability) >= limit).cast("tinyint")


def parse_event_time(c: Column | str) -> Column:
    """ISO UTC text, cut at the fraction, to epoch seconds; missing or bad text gives null.

    Unreadable times are not replaced by the wall clock: callers quarantine them, so a rerun gives
    the same rows.
    """
    whole = F.regexp_replace(F.split(_col(c), r"\.")[0], "Z$", "")
    stamp = F.try_to_timestamp(F.concat(whole, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    return F.unix_seconds(stamp)


def clean_scores(c: Column | str) -> Column:
    """NaN and null to 0, then clip to [0, 1] (which also settles both infinities)."""
    score = _col(c).cast("double")
    known = F.when(score.isNull() | F.isnan(score), F.lit(0.0)).otherwise(score)
    return F.greatest(F.least(known, F.lit(1.0)), F.lit(0.0))


def round_clip(c: Column | str, lower: float | None = None, upper: float | None = None, integer: bool = True) -> Column:
    """Round half to even (integer columns), then clip to the bounds given."""
    value = _col(c).cast("double")
    if integer:
        value = F.rint(value)
    if lower is not None:
        value = F.greatest(value, F.lit(float(lower)))
    if upper is not None:
        value = F.least(value, F.lit(float(upper)))
    return value.cast("bigint") if integer else value


def alert_line(score: Column, threshold: float, record_id: Column, ts: Column, event_id: Column,
               src_user: Column, src_host: Column, dst_user: Column, dst_host: Column) -> Column:
    """One readable line per scored event."""
    verdict = F.when(score >= F.lit(threshold), F.lit("ANOMALY")).otherwise(F.lit("NORMAL"))
    text = [F.coalesce(c.cast("string"), F.lit("None")) for c in (record_id, event_id, src_user, src_host, dst_user, dst_host)]
    when = F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss")
    return F.format_string(
        "[%-7s] rec_id=%s | time=%s | id=%s | score=%.5f (threshold=%.5f) | %s@%s -> %s@%s",
        verdict, text[0], when, text[1], score, F.lit(threshold), *text[2:])


def with_relative_day(df: DataFrame, ts: str = "timestamp", out: str = "relative_day") -> DataFrame:
    """Days since the first day of the table. The first day is a scalar subquery, not a join."""
    day = F.floor(F.col(ts) / SECONDS_PER_DAY)
    first = df.select(F.min(day)).scalar()
    return df.withColumn(out, (day - first).cast("int"))
