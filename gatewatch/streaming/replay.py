"""A stored table replayed in time order, or in the order of any whole-number column such as record numbers.

A Python streaming source hands out the next range of numbers, one row a batch. Its offset is the number reached, kept in the query's
checkpoint: a restarted query repeats the range that was not finished and goes on from there, also where the table has grown
since. The rows of a range are read by Spark, with the range as a filter that reaches the scan, and as one on the day where
the table is stored by day. Dates, sizes and order of the files play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from gatewatch.operators.model import Bundle
from gatewatch.schemas import ONE_HOUR, SECONDS_PER_DAY
from gatewatch.streaming.live import scored_to


class _Ranges(SimpleDataSourceStreamReader):
    def __init__(self, first: int, end: int, step: int):
        self.first, self.end, self.step = first, end, step

    def initialOffset(self) -> dict:
        return {"at": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"at": max(start["at"], min(start["at"] + self.step, self.end))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(start["at"], end["at"])] if end["at"] > start["at"] else [])


class NumberRanges(DataSource):
    """``first`` and ``end`` (not included) of consecutive ranges of ``step`` numbers; the options have the same names."""

    @classmethod
    def name(cls) -> str:
        return "number_ranges"

    def schema(self) -> str:
        return "first bigint, end bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        first, end, step = (int(self.options[k]) for k in ("first", "end", "step"))
        if step < 1:
            raise ValueError("step must be at least 1")
        return _Ranges(first, end, step)


def number_range(table: DataFrame, by: str = "timestamp") -> tuple[int, int]:
    """Smallest number and the one after the largest; (0, 0) for an empty table. Raises if a row has none: it would be in no range."""
    found = table.agg(F.min(by).alias("first"), F.max(by).alias("last"), F.count_if(F.col(by).isNull()).alias("without")).first()
    if found["without"]:
        raise ValueError(f"{found['without']} rows have no {by}")
    return (0, 0) if found["first"] is None else (int(found["first"]), int(found["last"]) + 1)


def replay(table: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, by: str = "timestamp", step: int = ONE_HOUR,
           bounds: tuple[int, int] | None = None, day: str = "day", **trigger) -> StreamingQuery:
    """Run ``handle`` on the rows of one range of ``by`` after the other, each ``step`` wide, with the batch number.

    ``bounds`` are the first number and the one after the last; without them one pass over the column finds them. All rows of a number
    come in one batch; a range without rows is a batch too. ``handle`` may see a batch again after a failure, with the same number
    and rows. Call it again, with the same checkpoint, when the table has grown: it goes on after the last number. Rows
    added later with numbers already replayed are not seen. A table stored by ``day`` of its seconds is read by day.
    A ``processingTime`` paces the batches; use :func:`finish` to run to the end.
    """
    spark = table.sparkSession
    first, end = bounds or number_range(table, by)
    spark.dataSource.register(NumberRanges)
    ranges = spark.readStream.format("number_ranges").options(first=first, end=end, step=step).load()

    def each(batch: DataFrame, batch_id: int) -> None:
        span = batch.agg(F.min("first").alias("first"), F.max("end").alias("end")).first()
        if span["first"] is None:
            return
        rows = table.filter((F.col(by) >= span["first"]) & (F.col(by) < span["end"]))
        if by == "timestamp" and day in table.columns:
            rows = rows.filter(F.col(day).between(span["first"] // SECONDS_PER_DAY, (span["end"] - 1) // SECONDS_PER_DAY))
        handle(rows, batch_id)

    return ranges.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def finish(query: StreamingQuery) -> None:
    """Wait until the last range has been replayed, then stop; raises what a batch raised."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def replay_scored_in_time_order(features: DataFrame, bundle: Bundle, out_dir: str, step: int = ONE_HOUR, **kw) -> StreamingQuery:
    """Replay a prepared feature table through scoring in time order, to ``out_dir/scored/batch=*``; ``kw`` as for :func:`replay`."""
    return replay(features, scored_to(bundle, out_dir), f"{out_dir}/checkpoint", step=step, **kw)
