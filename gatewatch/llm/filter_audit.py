"""How filters interact: what each order of applying them removes at each step.

Documents are summed up to *cells*: the set of filters a document fails, as a mask, with its part, its quality and its toxicity.
There are at most 128 cells a part. Each cell is then folded across all orders of the filters by higher-order functions:
``transform`` goes over the orders, ``aggregate`` over the steps of one, carrying whether the cell is still there. That gives a
struct per order and step, weighted with the cell's documents; the structs of a part's cells are summed place by place.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.llm.quality_rules import let, words_of
from gatewatch.llm.staging import small

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column) -> Column:
    """The mask of the four filters that look at one text alone: too short, too repetitive, too many capitals, marks of markup."""
    whole = F.coalesce(text, F.lit(""))
    flags = [
        lambda words: F.size(words) < 200,
        lambda words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        lambda words: 100 * F.regexp_count(whole, F.lit("[A-Z]")) > 2 * F.char_length(whole),
        lambda words: whole.rlike("[#$%&*|]"),
    ]
    return let(words_of(text), lambda words: sum((F.when(f(words), 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0)))


def cells_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic, n: one row per combination that occurs.

    Equal texts share the first four flags, so they are summed up by text before the fifth is settled: all documents of a text
    fail it but those with its smallest id and those without an id. No text meets its copies in one place.
    """
    # Renamed first: inside a lambda a name would mean the alias beside it rather than the column.
    plain = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("whole"))
    rows = plain.select("id", "part", F.sha2("whole", 256).alias("digest"), text_failures(F.col("whole")).cast("long").alias("mask"))
    ids = rows.groupBy("digest", "part", "id").agg(F.count("*").alias("n"), F.first("mask").alias("mask"))
    marks = labels.where(f"`{id_col}` is not null").groupBy(F.col(id_col).alias("label_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    known = ids.join(small(marks), F.col("id") == F.col("label_id"), "left").drop("label_id").fillna(0, ["good", "toxic"])
    # Per text, part and labels: all documents, those without an id, and those with the smallest id among them.
    groups = known.groupBy("digest", "part", "good", "toxic").agg(
        F.max("mask").alias("mask"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("bare"),
        F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_least"))
    first = F.min("least").over(Window.partitionBy("digest"))
    passing = F.col("bare") + F.when(F.col("least") == first, F.col("n_least")).otherwise(0)
    split = groups.withColumn("_passing", passing).select(
        "part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask").alias("mask"), F.col("_passing").alias("n")),
                                                  F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("_passing")).alias("n")))))
    return split.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _folded(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """An array of structs, one per order and step, with the cell's documents as weights."""
    zero = F.lit(0).cast("long")
    step_type = "array<struct<filter_order:string,step:int,letter:string," + ",".join(f"{f}:bigint" for f in FIGURES) + ">>"

    def of_order(order: Column) -> Column:
        start = F.struct(F.lit(True).alias("there"), F.array().cast(step_type).alias("steps"))

        def step(state: Column, i: Column) -> Column:
            letter = F.substring(order, i, F.lit(1))
            bit = F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("long")
            fails = mask.bitwiseAND(bit) != 0
            there = state["there"]
            weigh = lambda yes, by=n: F.when(yes, by).otherwise(zero)
            figures = (weigh(there & ~fails), weigh(there & fails), weigh(~there & fails), weigh(mask == bit), weigh(there & fails & (good == 1)), weigh(there & fails & (toxic == 1)))
            made = F.struct(order.alias("filter_order"), i.alias("step"), letter.alias("letter"), *[x.alias(f) for x, f in zip(figures, FIGURES)])
            return F.struct((there & ~fails).alias("there"), F.concat(state["steps"], F.array(made)).alias("steps"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(len(FILTERS))), start, step, lambda s: s["steps"])

    return F.flatten(F.transform(F.lit(ORDERS), of_order))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order of the five filters and step: documents ``kept`` after it, ``removed`` by it, ``redundant`` (failing its
    filter, removed before), ``unique_fails`` (failing it alone), ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``: what its
    filter removes, summed over all orders.

    The filters: A under 200 words, B fewer than half of the words distinct, C over 2% capitals A-Z, D any of ``#$%&*|``, E the text
    of a smaller id. A null text counts as empty, a null part as the empty string. Documents without an id never fail E and have no
    labels; several rows of the smallest id all pass it. Repeated labels count once: good or toxic if any row says so. Repeated rows
    count as often as they occur; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    cells = cells_of(docs, labels, id_col, text_col, part_col)
    folded = cells.select("part", F.inline(_folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic"))))
    sums = folded.groupBy("part", "filter_order", "step", "letter").agg(*[F.sum(f).alias(f) for f in FIGURES])
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return sums.withColumn("shapley", shapley).select("part", "filter_order", "step", *FIGURES, "shapley")
