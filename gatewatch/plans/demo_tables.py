"""Sign-in tables derived from the generated ``events`` and ``embeddings`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.functions.scalar import map_event_id
from gatewatch.operators.labels import label_join
from gatewatch.plans.parsing import to_canonical
from gatewatch.schemas import EVENT_XML_NAMESPACE


def auth_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq``, the nine raw columns (time as bigint) and ``value``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts")
    seconds = F.unix_date(F.to_date(ts)) * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)
    k = F.get_json_object("props", "$.k").cast("bigint")
    b = e.select(F.col("event_id").alias("seq"), (F.floor((seconds - 1704067200) / 300) * 30).alias("time"),
                 F.col("user_id").alias("u"), F.col("event_type").alias("y"), k.alias("k"), "value")

    def name(prefix, number):
        return F.concat(F.lit(prefix), number.cast("string"))

    u, kk, y, seq = F.col("u"), F.col("k"), F.col("y"), F.col("seq")
    return b.select(
        "seq", "time",
        F.when(seq % 101 == 0, F.lit(None)).when(seq % 97 == 0, "?").otherwise(name("U", u % 20)).alias("src_user"),
        name("U", (u + kk) % 30).alias("dst_user"),
        F.when(seq % 89 == 0, "-").otherwise(name("C", (u * 31 + kk) % 40)).alias("src_computer"),
        name("D", kk % 25).alias("dst_computer"),
        F.lit("NTLM").alias("auth_type"),
        F.when(y == "purchase", "Network").when(y == "view", "3").when(y == "error", "8")
        .when(y == "click", "Interactive").otherwise("Batch").alias("logon_type"),
        F.lit("LogOn").alias("auth_orientation"),
        F.when(y == "error", "Fail").when(y == "signup", "Other").otherwise("Success").alias("result"),
        "value")


def attack_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known attacks, each listed twice; some have a null user."""
    hits = auth_log(spark, sf_dir).filter((F.col("result") == "Fail") & (F.col("value") > 80))
    hits = hits.select("time", "src_user", "src_computer", "dst_computer")
    return hits.unionAll(hits)


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as untidy text: padded fields, texts that mean "missing", unreadable and fractional times."""
    log = auth_log(spark, sf_dir)
    seq, time = F.col("seq"), F.col("time").cast("string")
    return log.select(
        "seq",
        F.when(seq % 53 == 0, "abc").when(seq % 59 == 0, F.concat(time, F.lit(".7"))).otherwise(F.concat(F.lit(" "), time, F.lit(" "))).alias("time"),
        F.when(seq % 61 == 0, " NA ").otherwise(F.concat(F.lit("  "), F.col("src_user"), F.lit("\t"))).alias("src_user"),
        F.concat("dst_user", F.lit(" ")).alias("dst_user"),
        F.when(seq % 67 == 0, "null").otherwise(F.concat(F.lit(" "), F.col("src_computer"))).alias("src_computer"),
        F.concat(F.lit("\t"), F.col("dst_computer")).alias("dst_computer"),
        "auth_type",
        F.concat(F.lit(" "), F.col("logon_type")).alias("logon_type"),
        "auth_orientation",
        F.concat("result", F.lit(" ")).alias("result"))


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical eight columns plus ``seq``."""
    log = auth_log(spark, sf_dir).withColumn("event_id", map_event_id("result"))
    return to_canonical(label_join(log, attack_labels(spark, sf_dir)), "seq")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq``, ``timestamp``, a deterministic score and a binary label for the evaluation operators."""
    log = auth_log(spark, sf_dir)
    return log.select("seq", F.col("time").alias("timestamp"), F.least(F.col("value") / 100.0, F.lit(1.0)).alias("probability"),
                      (F.col("seq") % 37 == 0).cast("int").alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as ``id`` and 64 numeric columns ``f0..f63``."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])


def event_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as rendered event XML: ``seq, xml``. Record numbers repeat or are absent for some, times lack a fraction or
    are unreadable for some, and rows with another result get an event number that the parser drops."""
    log = auth_log(spark, sf_dir).withColumn("event_id", map_event_id("result"))
    seq, k = F.col("seq"), F.col("time") + 1704067200
    stamp = F.date_format(F.timestamp_seconds(k), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(seq % 71 == 0, "-").when(seq % 7 == 0, F.concat(stamp, F.lit("Z"))).otherwise(F.concat(stamp, F.lit(".1234567Z")))
    record = F.when(seq % 10 == 0, "").otherwise(F.format_string("<EventRecordID>%d</EventRecordID>", F.floor(seq / 3)))

    def data(name, value):
        return F.concat(F.lit(f'<Data Name="{name}">'), F.coalesce(value, F.lit("")), F.lit("</Data>"))

    return log.select("seq", F.concat(
        F.lit(f'<Event xmlns="{EVENT_XML_NAMESPACE}"><System><EventID>'), F.col("event_id").cast("string"), F.lit("</EventID>"), record,
        F.lit('<TimeCreated SystemTime="'), stamp, F.lit('"/><Computer>'), F.col("dst_computer"), F.lit("</Computer></System><EventData>"),
        data("SubjectUserName", F.col("src_user")), data("TargetUserName", F.col("dst_user")), data("LogonType", F.col("logon_type")),
        data("WorkstationName", F.col("src_computer")), F.lit('<Data Name="IpAddress">10.0.0.1</Data></EventData></Event>')).alias("xml"))
