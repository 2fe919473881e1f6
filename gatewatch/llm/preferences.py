"""Preference formatting: the shared opening of two conversations once, and what follows in each, with training spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _opening(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_opening(t["role"]), F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))), "")


def _spans(turns: Column, trained: str) -> Column:
    """Start and end (in characters of the rendered text) of what the trained role says, end marks included."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def add(a: Column, t: Column) -> Column:
        begin = a["at"] + F.length(_opening(t["role"]))
        end = begin + F.length(F.coalesce(t["text"], F.lit(""))) + F.length(F.lit("<|end|>\n"))
        own = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(F.coalesce(t["role"] == trained, F.lit(False)), F.concat(a["spans"], F.array(own))).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, add)["spans"]


def format_preferences(chosen: DataFrame, rejected: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per pair id in either table of turns(pair_id, turn, role, text).

    ``prompt`` is the longest opening of turns whose roles and texts agree (nulls agree with nulls), rendered once; ``chosen``
    and ``rejected`` are the turns after it, with ``*_spans``: the character ranges to train on, those of the role ``trained``.
    Everything else is masked.

    Turns stand in order of turn, role and text; rows without a turn number come first; repeated rows are turns of their own.
    A null role is rendered as unknown, a null text as empty. A pair with only one side has no opening in common, an empty
    prompt and an empty other side. Rows without a pair id are left out; empty tables give no rows; other columns are
    ignored. All turns of one pair meet in one row, as the result asks: a row is as large as its two conversations.
    """
    side = lambda df, name: df.select("pair_id", F.lit(name).alias("side"), F.struct(F.col("turn"), F.col("role"), F.col("text")).alias("t"))
    both = side(chosen, "c").unionAll(side(rejected, "r")).where("pair_id is not null")
    rows = both.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("side") == "c", F.col("t")))).alias("c"), F.sort_array(F.collect_list(F.when(F.col("side") == "r", F.col("t")))).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    same = lambda i: F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) & F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"])
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("n_prompt_turns", F.coalesce(F.array_min(F.filter(places, lambda i: ~same(i))), shorter))
    after = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    rows = rows.select("pair_id", "n_prompt_turns", F.slice("c", 1, F.col("n_prompt_turns")).alias("p"), after("c").alias("c"), after("r").alias("r"))
    return rows.select("pair_id", "n_prompt_turns", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"),
                       _spans(F.col("c"), trained).alias("chosen_spans"), _spans(F.col("r"), trained).alias("rejected_spans"))
