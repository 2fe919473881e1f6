"""Rendered sign-in event XML to live events, for batch and streaming tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.functions.scalar import parse_event_time
from gatewatch.schemas import EVENT_XML_NAMESPACE, EVENT_XML_SCHEMA, FAILURE_EVENT_ID, SUCCESS_EVENT_ID


def _data(name: str) -> Column:
    """Text of the last ``Data`` element of that name; ``-`` if absent or empty."""
    named = F.filter(F.col("EventData.Data"), lambda d: d["_Name"] == name)
    text = F.try_element_at(named, F.lit(-1))["_VALUE"]
    return F.when(text.isNotNull() & (text != ""), text).otherwise("-")


def keep_sign_ins(df: DataFrame, event_id: str = "event_id") -> DataFrame:
    return df.filter(F.col(event_id).isin(SUCCESS_EVENT_ID, FAILURE_EVENT_ID))


def _unprefixed(xml: Column) -> Column:
    """A document whose root carries a name-space prefix, with that prefix taken off its tags; any other one as it is."""
    prefix = F.regexp_extract(xml, r"^\s*(?:<\?xml[^>]*>\s*)?<([\w.-]+):Event[\s>/]", 1)
    tags = F.regexp_replace(xml, F.concat(F.lit(r"(</?)\Q"), prefix, F.lit(r"\E:")), F.lit("$1"))
    # Most documents have no prefix: a plain search spares them the three patterns.
    with_prefix = F.when(prefix != "", F.regexp_replace(tags, F.concat(F.lit(r"xmlns:\Q"), prefix, F.lit(r"\E\s*=")), F.lit("xmlns="))).otherwise(xml)
    return F.when(xml.contains(":Event"), with_prefix).otherwise(xml)


def _documents(df: DataFrame, xml: str, others: list[str]) -> DataFrame:
    """``others``, the live event of each document and ``_reason``: why it cannot be read, or null."""
    options = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE"}
    # As a generator the document is parsed once per row; as a plain column every filter below would parse it again.
    parsed = df.select(*others, F.inline(F.array(F.from_xml(_unprefixed(F.col(xml)), EVENT_XML_SCHEMA, options))))
    system = F.col("System")
    workstation = _data("WorkstationName")
    record = system["EventRecordID"]
    event_id = F.trim(system["EventID"]).try_cast("bigint")
    reason = (F.when(F.col("_xmlns").isNull() & system.isNull(), "not readable")
              .when(~F.col("_xmlns").eqNullSafe(F.lit(EVENT_XML_NAMESPACE)), "other name space")
              .when(event_id.isNull(), "event number")
              .when(record.isNotNull() & F.trim(record).try_cast("bigint").isNull(), "record number"))
    return parsed.select(
        *others,
        F.trim(record).try_cast("bigint").alias("record_id"),
        parse_event_time(system["TimeCreated"]["_SystemTime"]).alias("timestamp"),
        event_id.alias("event_id"),
        _data("SubjectUserName").alias("src_username"),
        _data("TargetUserName").alias("username"),
        F.when(workstation == "-", _data("IpAddress")).otherwise(workstation).alias("src_host"),
        F.when(system["Computer"].isNull(), "-").when(system["Computer"] != "", system["Computer"]).alias("destination_host"),
        _data("LogonType").alias("logon_type"),
        reason.alias("_reason"))


def parse_event_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Live events plus all other columns of ``df``. Other event numbers and documents that ``rejected_event_xml`` returns are
    left out. An unreadable time gives a null ``timestamp``, for the caller to set apart.
    """
    text = F.col(xml)
    # A document with neither number in its text, nor an escape that could spell one, need not be parsed.
    hopeful = text.contains(str(SUCCESS_EVENT_ID)) | text.contains(str(FAILURE_EVENT_ID)) | text.contains("&#")
    events = _documents(df.filter(hopeful), xml, [c for c in df.columns if c != xml])
    return keep_sign_ins(events.filter(F.col("_reason").isNull()).drop("_reason"))


def rejected_event_xml(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows of ``df`` whose document cannot be read as an event, with a ``reason``: null or malformed text, another name space, an
    event or record number that is no whole number.
    """
    found = _documents(df, xml, df.columns)
    return found.filter(F.col("_reason").isNotNull()).select(*df.columns, F.col("_reason").alias("reason"))
