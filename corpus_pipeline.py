"""From raw documents to token ids: quality rules, quality classifier, near-duplicate removal, source mixing, SentencePiece.

Each stage takes the documents that its predecessor left and returns documents; the last one returns their token ids. Rows
without an id pass through like any other; a stage that joins its decisions back does so on the id and a checksum of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm.mixing import mix_sources
from gatewatch.llm.near_dups import near_duplicates
from gatewatch.llm.pieces import encode_pieces
from gatewatch.llm.quality_classifier import score_quality
from gatewatch.llm.quality_rules import quality_rules
from gatewatch.llm.queries import MIX_SHARE, MIX_WEIGHTS, PIECE_MODEL, QUALITY_CUT, quality_model, trusted_ids
from gatewatch.llm.staging import small, staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _marked(docs: DataFrame) -> DataFrame:
    """The documents with a checksum of their text, which tells apart rows of one id."""
    return docs.withColumn("_print", F.xxhash64(F.coalesce("text", F.lit(""))))


def _joined(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with decisions by id and checksum; rows without an id find theirs too."""
    rows = _marked(docs)
    marks = marks.withColumnRenamed("doc_id", "_id").withColumnRenamed("_print", "_mark")
    return rows.join(small(marks), rows["doc_id"].eqNullSafe(marks["_id"]) & (rows["_print"] == marks["_mark"]), how)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. An empty table, or one of rejected documents only, leaves no rows."""
    verdicts = quality_rules(_marked(docs).select("doc_id", "text", "_print"), trusted_ids(spark, sf_dir), with_text=False)
    kept = staged(verdicts.where("kept").select("doc_id", "_print").distinct(), "rules-kept")
    return _joined(docs, kept, "left_semi").select(docs.columns)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score reaches the cut. The model learns from the labelled rows of the whole table, so that it
    has seen what the rules already rejected; without any, all score 0.5 and stay.
    """
    model = quality_model(spark, table(spark, sf_dir, "documents"), sf_dir)
    return score_quality(docs, model, score_col="_score").where(F.col("_score") >= QUALITY_CUT).select(docs.columns)


def _one_row_each(docs: DataFrame) -> DataFrame:
    """One row of each id: of several the one with the smallest checksum over all columns, so that reruns agree."""
    marked = docs.withColumn("_mark", F.xxhash64(F.to_json(F.struct(*docs.columns))))
    least = marked.groupBy("doc_id").agg(F.min("_mark").alias("_mark"))
    return marked.join(least, ["doc_id", "_mark"], "left_semi").select(docs.columns).dropDuplicates(["doc_id"])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, and one row of it. Rows without an id stay."""
    found = staged(near_duplicates(docs), "near-dups")
    known = docs.where("doc_id is not null")
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    rest = known.join(small(kept), "doc_id", "left_semi").select(docs.columns)
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        rest = _one_row_each(rest)
    return rest.unionAll(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as often, whole, as the words taken from it come nearest to (0, 1 or 2 times)."""
    mixed = mix_sources(_marked(docs), MIX_WEIGHTS, MIX_SHARE, id_cols=("doc_id", "_print"))
    times = F.round(F.sum("taken") / F.when(F.sum("size") > 0, F.sum("size"))).cast("int")
    copies = staged(mixed.groupBy("doc_id", "_print").agg(times.alias("_times")).where("_times > 0"), "copies")
    rows = _joined(docs, copies, "inner")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[rows[c] for c in docs.columns])


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document's whole text."""
    return encode_pieces(docs.select("doc_id", "source", "text"), PIECE_MODEL, drop=("text",))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("near duplicates", near_dup_stage),
    ("source mixing", mixing_stage),
    ("sentence pieces", pieces_stage),
]

# Learned scores, sketches and a tokenizer have no SQL form; tests hold the rules and near-duplicate stages against brute-force
# versions, whole rows, and check what the other stages return against what they were given.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
