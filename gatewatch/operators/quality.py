"""Checks. Each ``check_*`` returns its findings as rows; each ``require_*`` raises on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.functions.scalar import with_relative_day
from gatewatch.schemas import SPLIT_NAMES

CHUNK_ROWS = 1_000_000
SPLIT_BITS = 33  # row numbers of a scan start anew, in these low bits, at every input split


def check_sorted(df: DataFrame, ts: str = "timestamp", seq: str = "seq", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows whose time is before that of the row preceding them in ``seq`` order, with that earlier time.

    Rows are compared inside chunks of ``seq``, which have at most ``chunk_rows`` rows each. The first row of a chunk is
    compared with the last one of the chunk before; that pass sees one row per chunk.
    """
    rows = df.select(seq, ts, F.expr(f"`{seq}` div {int(chunk_rows)}").alias("_chunk"))
    ends = rows.groupBy("_chunk").agg(F.max_by(ts, seq).alias("_last"))
    ends = ends.select("_chunk", F.lag("_last").over(Window.orderBy("_chunk")).alias("_carry"))
    inside = Window.partitionBy("_chunk").orderBy(seq)
    before = F.coalesce(F.lag(ts).over(inside), F.col("_carry"))
    return (rows.join(ends, "_chunk", "left").withColumn("previous", before)
            .filter(F.col(ts) < F.col("previous")).select(seq, ts, "previous"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and run of growing numbers inside one input split: the split, first and last number and time, and whether the
    time steps back in between. Stretches that follow each other in one task are joined up.
    """
    def row(run: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("split", "first_seq", "last_seq", "first_ts", "last_ts", "back"), run, strict=True))],
                                          pa.schema([(n, pa.int64()) for n in ("split", "first_seq", "last_seq", "first_ts", "last_ts")] + [("back", pa.bool_())]))

    run = None
    for batch in batches:
        seq, ts = (np.asarray(batch.column(i)) for i in (0, 1))
        split = seq >> SPLIT_BITS
        cuts = np.flatnonzero((np.diff(split) != 0) | (np.diff(seq) < 0)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(seq)], strict=True):
            if i == j:
                continue
            found = [int(split[i]), int(seq[i]), int(seq[j - 1]), int(ts[i]), int(ts[j - 1]), bool((np.diff(ts[i:j]) < 0).any())]
            if run and run[0] == found[0] and run[2] <= found[1]:
                run = [run[0], run[1], found[2], run[3], found[4], run[5] or found[5] or run[4] > found[3]]
            else:
                if run:
                    yield row(run)
                run = found
    if run:
        yield row(run)


def in_file_order(df: DataFrame, ts: str = "timestamp", seq: str = "seq") -> bool:
    """Whether rows that come straight from a scan, numbered by it, have growing times. One pass over two columns without a
    shuffle of rows: each task reports one row per input split. False also where rows were dealt anew since the scan, which says
    nothing about their order: see ``check_sorted``. Rows without a time are left out.
    """
    rows = df.select(F.col(seq).cast("bigint"), F.col(ts).cast("bigint")).where(F.col(seq).isNotNull() & F.col(ts).isNotNull())
    fields = "split bigint, first_seq bigint, last_seq bigint, first_ts bigint, last_ts bigint, back boolean"
    splits = rows.mapInArrow(_stretches, fields).groupBy("split").agg(
        F.count("*").alias("n"), F.max("back").alias("back"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    stepped = F.coalesce(F.col("first_ts") < F.lag("last_ts").over(Window.orderBy("split")), F.lit(False))
    return splits.select(((F.col("n") > 1) | F.col("back") | stepped).alias("bad")).where("bad").isEmpty()


def require_sorted(df: DataFrame, ts: str = "timestamp", seq: str = "seq", **kw) -> DataFrame:
    bad = [] if in_file_order(df, ts, seq) else check_sorted(df, ts, seq, **kw).limit(1).collect()
    if bad:
        raise ValueError(f"rows must be in time order; first found out of order: {bad[0].asDict()}")
    return df


def column_problems(df: DataFrame, expected: Sequence[str], exact: bool = False) -> list[str]:
    """Missing columns; with ``exact`` also unexpected ones and a different order."""
    problems = [f"missing column {c}" for c in expected if c not in df.columns]
    if exact:
        problems += [f"unexpected column {c}" for c in df.columns if c not in expected]
        if not problems and list(df.columns) != list(expected):
            problems.append("column order differs")
    return problems


def require_columns(df: DataFrame, expected: Sequence[str], exact: bool = False) -> DataFrame:
    problems = column_problems(df, expected, exact)
    if problems:
        raise ValueError("; ".join(problems))
    return df


def check_binary_label(df: DataFrame, label: str = "label") -> DataFrame:
    """Label values other than 0 and 1 (null included) with their row counts."""
    value = F.col(label)
    return (df.filter(value.isNull() | ~value.isin(0, 1)).groupBy(value.alias("value")).agg(F.count("*").alias("n_rows")))


def check_no_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that hold a null or NaN, with how many; one pass for all of them."""
    counts = df.agg(*[F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("bigint")).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "n_bad").filter(F.col("n_bad") > 0)


def require_no_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    bad = [row["column_name"] for row in check_no_nan(df, columns).collect()]
    if bad:
        raise ValueError(f"columns contain NaN or null: {bad}")
    return df


def check_three_days(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row per relative day found or expected, with its rows and a verdict: ok, empty or out of range."""
    found = with_relative_day(df.select(ts), ts).groupBy("relative_day").agg(F.count("*").alias("n_rows"))
    wanted = df.sparkSession.range(len(SPLIT_NAMES)).select(F.col("id").cast("int").alias("relative_day"))
    out = found.join(wanted.withColumn("_wanted", F.lit(True)), "relative_day", "full")
    verdict = (F.when(F.col("_wanted").isNull(), "out of range").when(F.col("n_rows").isNull(), "empty").otherwise("ok"))
    return out.select("relative_day", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), verdict.alias("verdict"))


def check_conservation(whole: DataFrame, parts: DataFrame, label: str = "label") -> DataFrame:
    """Rows and positive labels of both tables side by side, and whether they agree."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).alias("p")).withColumn("side", F.lit(name))

    both = side(whole, "whole").unionByName(side(parts, "parts"))
    pick = lambda column, name: F.max(F.when(F.col("side") == name, F.col(column)))
    sums = both.agg(pick("n", "whole").alias("whole_rows"), pick("n", "parts").alias("part_rows"),
                    pick("p", "whole").alias("whole_positives"), pick("p", "parts").alias("part_positives"))
    same = (F.col("whole_rows") == F.col("part_rows")) & (F.col("whole_positives") == F.col("part_positives"))
    return sums.withColumn("conserved", same)


def require_conservation(whole: DataFrame, parts: DataFrame, label: str = "label") -> DataFrame:
    found = check_conservation(whole, parts, label).first()
    if not found["conserved"]:
        raise ValueError(f"rows or positive labels were lost or added: {found.asDict()}")
    return parts


def check_min_positives(df: DataFrame, least: int, label: str = "label") -> DataFrame:
    """The number of positive rows and whether it reaches ``least``."""
    return (df.agg(F.coalesce(F.sum((F.col(label) == 1).cast("bigint")), F.lit(0)).alias("positives"))
            .withColumn("enough", F.col("positives") >= least))


def require_min_positives(df: DataFrame, least: int, label: str = "label") -> int:
    found = check_min_positives(df, least, label).first()
    if not found["enough"]:
        raise ValueError(f"at least {least} positive rows are needed; found {found['positives']}")
    return found["positives"]
