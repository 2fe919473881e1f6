"""Headerless sign-in CSV files, attack-label CSV files and rendered event XML."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewatch.schemas import AUTH_SCHEMA, LABEL_SCHEMA

MAX_BROADCAST_FILES = 500_000
COMPRESSED = r"\.(gz|zst|lz4|snappy|deflate)$"
SPREAD_ROWS = 1_000_000
_UNIT = 1 << 20
_ROW_BITS = 33


def _csv(spark: SparkSession, schema, path, encoding: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", False).option("quote", '"').option("escape", '"')
            .option("encoding", encoding).csv(path))


def _bytes(setting: str) -> int:
    """``134217728``, ``134217728b``, ``128m`` or ``128MB`` as a number of bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def with_file_order(spark: SparkSession, df: DataFrame, path) -> DataFrame:
    """Append ``seq``, a unique bigint that grows in file order (files by path, then position).

    No shuffle (unless there are too many files to broadcast their places) and no second pass over the data: a row's place is
    the size of the files before its own, counted in MiB, plus the MiB its split starts at, plus the running number inside
    the input partition. Splits are never smaller than one MiB (the open cost alone is larger), so no two rows share a
    number. Only file names and sizes are listed.
    """
    if min(_bytes(spark.conf.get(f"spark.sql.files.{name}")) for name in ("openCostInBytes", "maxPartitionBytes")) < _UNIT:
        raise ValueError("input splits must be at least 1 MiB: raise spark.sql.files.openCostInBytes / maxPartitionBytes")
    files = (spark.read.format("binaryFile").load(path)
             .select(F.col("_metadata.file_path").alias("_file"), F.ceil(F.greatest(F.col("_metadata.file_size"), F.lit(1)) / _UNIT).alias("_units")))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), row.alias("_row"))
    found = files.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("_file").rlike(COMPRESSED)), F.lit(False)).alias("compressed")).first()
    base = F.lit(0).cast("bigint")
    if found["n"] > 1:
        before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        places = files.select("_file", F.coalesce(F.sum("_units").over(before), F.lit(0)).alias("_base"))
        placed, base = placed.join(F.broadcast(places) if found["n"] <= MAX_BROADCAST_FILES else places, "_file"), F.col("_base")
    seq = F.shiftleft(base + F.floor(F.col("_start") / _UNIT), _ROW_BITS) + F.col("_row")
    out = placed.select(*df.columns, seq.alias("seq"))
    # A compressed file is one split: deal its rows out in runs, so that one task reads it but many go on with it.
    return out.repartition(F.expr(f"seq div {SPREAD_ROWS}")) if found["compressed"] else out


def scan_auth_log(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """Nine text columns and ``seq``. A compressed file is read by one task, which passes its rows on in runs of a million."""
    return with_file_order(spark, _csv(spark, AUTH_SCHEMA, path, encoding), path)


def scan_attack_labels(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """Four text columns; a missing or empty file means that nothing is known, not an error."""
    try:
        return _csv(spark, LABEL_SCHEMA, path, encoding)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LABEL_SCHEMA)


def scan_event_xml(spark: SparkSession, path, end: str | None = None) -> DataFrame:
    """Rendered events as column ``xml``: one per line or, where ``end`` names the closing tag (``</Event>``), documents of any
    number of lines, each cut after that tag. Text before a document's root, such as a wrapper's tag, is left out.
    """
    if end is None:
        return spark.read.text(path).select(F.col("value").alias("xml"))
    tag = re.escape(end.strip("</>"))
    parts = spark.read.option("lineSep", end).text(path).filter(F.col("value").rlike(rf"<{tag}[\s>/]"))
    return parts.select(F.concat(F.regexp_replace("value", rf"(?s)^.*?(?=<{tag}[\s>/])", ""), F.lit(end)).alias("xml"))
