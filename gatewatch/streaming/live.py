"""Live sign-in events: filter, de-duplicate, features equal to the batch job's, scores and alerts.

State between micro-batches is kept in tables, one set of files per batch number, so a repeated batch rewrites its own files
and reads only those of earlier batches:

* ``history``: the rows themselves, by hour. A batch reads back the hours that its windows reach into.
* ``last``: per user, pair and host pair seen in the batch, its last row. Every ``SNAPSHOT_EVERY`` batches they are merged
  into a snapshot, stored by chain and bucket of the chain's leading key. A batch reads the buckets of its own keys and a
  bounded number of small tables.
* ``current``: the rows that the features of a batch are worked out from, its own and older ones, until the next batch.

What no later batch can read is removed: hours before the windows of the newest row, and what the snapshot in use has replaced.

With an allowed ``lateness``, rows less than so many seconds behind the newest one seen wait in ``pending`` for those that may
still come before them, so batches may overlap in time by as much. Rows not after the last row worked on, in
``(timestamp, seq)`` order, are late: their features would depend on what was already given out. They go to the ``late`` output
with rows that have no readable time. Rows without a record number have no order inside a second but their hash: allow at
least a second for them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gatewatch.functions.scalar import alert_line, valid_key
from gatewatch.operators.model import Bundle, score_batch
from gatewatch.plans.features import MAX_GROUP_ROWS, build_features
from gatewatch.schemas import ONE_HOUR, PARSED_COLUMNS
from gatewatch.sources.event_xml import keep_sign_ins, parse_event_xml

SNAPSHOT_EVERY = 50
SNAPSHOT_BUCKETS = 512  # per chain; the state must be started anew if it is changed
COLUMNS = [*PARSED_COLUMNS, "seq"]
# What is remembered: the user alone, the three pairs that have flags or recencies, and the newest row of all.
CHAINS = (
    ("user", ["src_username"]),
    ("user_source", ["src_username", "src_host"]),
    ("user_target", ["src_username", "destination_host"]),
    ("source_target", ["src_host", "destination_host"]),
)
LAST_SCHEMA = "chain string, src_username string, src_host string, destination_host string, at struct<timestamp:bigint,seq:bigint>"
KEYS = ["chain", "src_username", "src_host", "destination_host"]
HISTORY_PATH = re.compile(r"hour=(-?\d+)")


def stream_filter(events: DataFrame) -> DataFrame:
    """Sign-in successes and failures only."""
    return keep_sign_ins(events)


def stream_dedup(events: DataFrame, event_time: str = "event_time", keep_for: str = "1 hour", keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Drop rows that repeat ``keys`` and arrive within ``keep_for``; rows that lack one of them all pass. Record numbers are
    those of one machine: name its column too where events come from several.
    """
    timed = events.withWatermark(event_time, keep_for)
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    return timed.filter(whole).dropDuplicatesWithinWatermark(list(keys)).unionByName(timed.filter(~whole))


def stream_parse(xml: DataFrame) -> DataFrame:
    """XML rows to parsed events without duplicates. Rows without a readable time keep a null ``timestamp``."""
    events = parse_event_xml(xml.withColumn("_hash", F.xxhash64("xml")))
    # A record number grows with arrival, so it orders the rows of one second.
    numbered = events.withColumn("seq", F.coalesce("record_id", "_hash")).withColumn("label", F.lit(0).cast("tinyint")).drop("_hash")
    timed = numbered.filter(F.col("timestamp").isNotNull()).withColumn("event_time", F.timestamp_seconds("timestamp"))
    untimed = numbered.filter(F.col("timestamp").isNull()).withColumn("event_time", F.lit(None).cast("timestamp"))
    return stream_dedup(timed).unionByName(untimed)


def _read(spark: SparkSession, schema: str, paths: list[str], base: str | None = None) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for path in paths:
        reader = spark.read.schema(schema)
        try:
            found = reader.option("basePath", base).parquet(path) if base else reader.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = out.unionByName(found)
    return out


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def _last_rows(rows: DataFrame) -> DataFrame:
    """Newest ``(timestamp, seq)`` per chain key of ``rows``, and of all rows under the chain ``all``."""
    at = F.struct("timestamp", "seq")
    parts = [rows.agg(F.max(at).alias("at")).filter(F.col("at").isNotNull()).withColumn("chain", F.lit("all"))]
    for chain, keys in CHAINS:
        parts.append(rows.filter(valid_key(*keys)).groupBy(*keys).agg(F.max(at).alias("at")).withColumn("chain", F.lit(chain)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[F.col(c).cast("string").alias(c) if c in KEYS else F.col(c) for c in [*KEYS, "at"]])


def _bucket() -> Column:
    """Bucket of a ``last`` row by the leading key of its chain."""
    leading = F.coalesce(*[F.when(F.col("chain") == chain, F.col(keys[0])) for chain, keys in CHAINS])
    return F.pmod(F.xxhash64(leading), F.lit(SNAPSHOT_BUCKETS)).cast("int")


def _snapshot_before(batch_id: int) -> int:
    """Number of the snapshot that a batch reads; 0 if there is none yet."""
    return (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY if batch_id > 0 else 0


def _remembered(spark: SparkSession, state_dir: str, batch_id: int, only: Column | None = None) -> DataFrame:
    """``last`` rows of batches before ``batch_id``: one snapshot and the batches since. ``only`` is a condition on ``chain`` and
    ``bucket``; folders of the snapshot that it rules out are not read.
    """
    snapshot = _snapshot_before(batch_id)
    rows = _read(spark, f"{LAST_SCHEMA}, bucket int", [f"{state_dir}/snapshot/{snapshot}"] if snapshot else [])
    rows = rows.unionByName(_read(spark, LAST_SCHEMA, [f"{state_dir}/last/{b}" for b in range(snapshot + 1 if snapshot else 0, batch_id)])
                            .withColumn("bucket", _bucket()))
    return (rows if only is None else rows.filter(only)).drop("bucket")


def _buckets_of(keys: DataFrame) -> Column:
    """The chains and buckets of ``keys`` as a condition; at most ``SNAPSHOT_BUCKETS`` numbers a chain come to the driver."""
    found: dict[str, list[int]] = {}
    for row in keys.filter("chain <> 'all'").select("chain", _bucket().alias("bucket")).distinct().collect():
        found.setdefault(row["chain"], []).append(row["bucket"])
    return reduce(or_, [(F.col("chain") == c) & F.col("bucket").isin(sorted(b)) for c, b in sorted(found.items())], F.lit(False))


def _forget(spark: SparkSession, state_dir: str, batch_id: int, newest: int) -> None:
    """Remove state that neither ``batch_id``, also when it is repeated, nor a later batch reads: rows of hours before the windows
    that end at the second ``newest``, and ``last``, ``pending`` and ``current`` tables and snapshots older than those in use.
    """
    hadoop, snapshot = spark._jvm.org.apache.hadoop.fs.Path, _snapshot_before(batch_id)
    files = hadoop(state_dir).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(folder: str, name: re.Pattern) -> dict[int, str]:
        place = hadoop(f"{state_dir}/{folder}")
        names = [status.getPath().getName() for status in files.listStatus(place)] if files.exists(place) else []
        return {int(found[1]): f"{state_dir}/{folder}/{n}" for n in names if (found := name.fullmatch(n))}

    plain = re.compile(r"(\d+)")
    limits = [("history", HISTORY_PATH, (newest - ONE_HOUR) // ONE_HOUR), ("pending", plain, batch_id - 1), ("snapshot", plain, snapshot),
              ("last", plain, snapshot + 1 if snapshot else 0), ("current", plain, batch_id)]
    for folder, name, limit in limits:
        for number, path in numbers(folder, name).items():
            if number < limit:
                files.delete(hadoop(path), True)


def _merge(last: DataFrame) -> DataFrame:
    return last.groupBy(*KEYS).agg(F.max("at").alias("at"))


def advance(batch: DataFrame, batch_id: int, state_dir: str, max_group_rows: int = MAX_GROUP_ROWS,
            keep: Sequence[str] = (), lateness: int = 0) -> tuple[DataFrame, DataFrame]:
    """Features of one micro-batch (with ``seq`` and the parsed columns in ``keep``) and its late rows; writes the state
    for the next one. An empty batch with a ``lateness`` of 0 releases all rows that still wait.

    Nothing but the newest row, the newest and the batch's first time and its hours comes to the driver.
    """
    spark = batch.sparkSession
    rows = batch.select(*COLUMNS)
    if batch_id > 0:
        waiting = _read(spark, _ddl(rows), [f"{state_dir}/pending/{batch_id - 1}"])
        rows = rows.unionByName(waiting)
    if lateness:
        seen = rows.agg(F.max("timestamp")).first()[0]
        waits = F.coalesce(F.col("timestamp") > F.lit(seen) - lateness, F.lit(False))
        rows.filter(waits).write.mode("overwrite").parquet(f"{state_dir}/pending/{batch_id}")
        rows = rows.filter(~waits)
    newest = _remembered(spark, state_dir, batch_id, F.col("chain") == "all").agg(F.max("at").alias("at")).first()["at"]
    if newest is not None:
        _forget(spark, state_dir, batch_id, newest["timestamp"])
    late = F.col("timestamp").isNull()
    if newest is not None:
        same_second = (F.col("timestamp") == newest["timestamp"]) & (F.col("seq") <= newest["seq"])
        late = late | (F.col("timestamp") < newest["timestamp"]) | same_second
    on_time, too_late = rows.filter(~late), rows.filter(late)
    span = on_time.agg(F.min("timestamp").alias("first")).first()
    first = span["first"]

    _last_rows(on_time).write.mode("overwrite").parquet(f"{state_dir}/last/{batch_id}")
    current = on_time.withColumn("_own", F.lit(True))
    if first is not None:
        hours = range((first - ONE_HOUR) // ONE_HOUR, first // ONE_HOUR + 1)
        if newest is not None:
            hours = [h for h in hours if h <= newest["timestamp"] // ONE_HOUR]
        history = _read(spark, f"{_ddl(rows)}, hour bigint, batch bigint",
                        [f"{state_dir}/history/hour={h}" for h in hours] if newest is not None else [], f"{state_dir}/history")
        history = history.filter((F.col("batch") < batch_id) & (F.col("timestamp") >= first - ONE_HOUR)).select(*COLUMNS)
        # Older last rows stand in for all history before the windows: too old to be counted, but still "seen before".
        wanted = _read(spark, LAST_SCHEMA, [f"{state_dir}/last/{batch_id}"]).select(*KEYS)
        known = _remembered(spark, state_dir, batch_id, _buckets_of(wanted))
        same = [known[k].eqNullSafe(wanted[k]) for k in KEYS]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        older = _merge(known.join(wanted, condition, "left_semi")).filter(
            (F.col("chain") != "all") & (F.col("at.timestamp") < first - ONE_HOUR))
        stand_ins = older.select("at.timestamp", "src_username", "src_host", "destination_host", "at.seq")
        past = history.unionByName(stand_ins, allowMissingColumns=True).withColumn("_own", F.lit(False))
        current = past.unionByName(current).select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in COLUMNS], "_own")
    # Keys are counted before the features are planned: both read the rows from here, not history and last rows once more.
    current.write.mode("overwrite").parquet(f"{state_dir}/current/{batch_id}")
    current = _read(spark, _ddl(current), [f"{state_dir}/current/{batch_id}"])
    features = build_features(current, max_group_rows, keep=["seq", *keep, "_own"]).filter("_own").drop("_own")

    hour = F.floor(F.col("timestamp") / ONE_HOUR).alias("hour")
    (on_time.select(*COLUMNS, hour, F.lit(batch_id).cast("bigint").alias("batch"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(f"{state_dir}/history"))
    if batch_id > 0 and batch_id % SNAPSHOT_EVERY == 0:
        everything = _remembered(spark, state_dir, batch_id).unionByName(_read(spark, LAST_SCHEMA, [f"{state_dir}/last/{batch_id}"]))
        merged = _merge(everything).withColumn("bucket", _bucket()).hint("rebalance", "chain", "bucket")
        merged.write.mode("overwrite").partitionBy("chain", "bucket").parquet(f"{state_dir}/snapshot/{batch_id}")
    return features, too_late


def with_alerts(scored: DataFrame, threshold: float, record_id: str = "seq") -> DataFrame:
    """Append ``verdict`` and the readable line to scored events that carry the event columns."""
    verdict = F.when(F.col("probability") >= threshold, "ANOMALY").otherwise("NORMAL")
    line = alert_line(F.col("probability"), threshold, F.col(record_id), F.col("timestamp"), F.col("event_id"),
                      F.col("src_username"), F.col("src_host"), F.col("username"), F.col("destination_host"))
    return scored.withColumns({"verdict": verdict, "alert": line})


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run ``handle`` on every micro-batch; each batch is kept while its several jobs read it."""
    def each(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            handle(kept, batch_id)
        finally:
            kept.unpersist()

    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_features(stream: DataFrame, out_dir: str, max_group_rows: int = MAX_GROUP_ROWS, lateness: int = 0, **trigger) -> StreamingQuery:
    """Parsed events in, ``out_dir/features/batch=*`` and ``out_dir/late/batch=*`` out; ``lateness`` as for :func:`advance`."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        features, late = advance(batch, batch_id, f"{out_dir}/state", max_group_rows, lateness=lateness)
        features.write.mode("overwrite").parquet(f"{out_dir}/features/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{out_dir}/late/batch={batch_id}")

    return start(stream, handle, f"{out_dir}/checkpoint", **trigger)


def stream_score(stream: DataFrame, bundle: Bundle, out_dir: str, max_group_rows: int = MAX_GROUP_ROWS, lateness: int = 0,
                 **trigger) -> StreamingQuery:
    """As :func:`stream_features`, then probability, verdict and alert line per event, to ``out_dir/scored/batch=*``."""
    event_columns = ["src_username", "username", "src_host", "destination_host", "event_id"]

    def handle(batch: DataFrame, batch_id: int) -> None:
        features, late = advance(batch, batch_id, f"{out_dir}/state", max_group_rows, event_columns, lateness)
        with_alerts(score_batch(bundle.model, features), bundle.threshold).write.mode("overwrite").parquet(f"{out_dir}/scored/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{out_dir}/late/batch={batch_id}")

    return start(stream, handle, f"{out_dir}/checkpoint", **trigger)


def scored_to(bundle: Bundle, out_dir: str) -> Callable[[DataFrame, int], None]:
    """A handler that scores a batch of features into ``out_dir/scored/batch=*``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        scored = score_batch(bundle.model, batch)
        verdict = F.when(F.col("probability") >= bundle.threshold, "ANOMALY").otherwise("NORMAL")
        scored.withColumn("verdict", verdict).write.mode("overwrite").parquet(f"{out_dir}/scored/batch={batch_id}")

    return handle


def replay_scored(spark: SparkSession, features_path: str, schema, bundle: Bundle, out_dir: str, files_per_batch: int = 1,
                  **trigger) -> StreamingQuery:
    """Replay a prepared feature table file by file, by file date, through scoring, to ``out_dir/scored/batch=*``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(features_path)
    return start(stream, scored_to(bundle, out_dir), f"{out_dir}/checkpoint", **trigger)
