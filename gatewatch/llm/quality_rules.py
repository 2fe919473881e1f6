"""Quality rules: plain counts per text, and how much likelier its words are under trusted text than under the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.staging import small, staged

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UNITS = 1 << 32  # log ratios are added up as whole numbers of this part of one, so that no order of adding changes a verdict


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the list holds twice or more, first ones included."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, i: (F.try_element_at(s, i + 2)["h"] == x["h"]) | ((i > 0) & (F.try_element_at(s, F.greatest(i, F.lit(1)))["h"] == x["h"]))),
            lambda x: x["i"])))
        gaps = let(twice, lambda p: F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.array(F.array_max(p) + 3)), lambda a, b: F.least(F.lit(3), b - a)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))

    some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) < 4, 0).otherwise(some).cast("long")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def base_counts(text: str = "text", words: str = "_words") -> dict[str, Column]:
    whole = F.coalesce(F.col(text), F.lit(""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.octet_length(whole) - F.octet_length(F.translate(whole, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": repeated_lines(F.col(text)),
        "n_repeat_words": repeated_words(F.col(words)),
    }


def _ngrams(docs: DataFrame, buckets: int, outer: bool = False) -> DataFrame:
    """One row per word and per pair of neighbours, as its bucket."""
    at = F.sequence(F.lit(0), 2 * F.size("_words") - 2)
    steps = F.when(F.size("_words") > 0, at).otherwise(F.array().cast("array<int>"))
    rows = docs.select("*", (F.explode_outer if outer else F.explode)(steps).alias("_i"))
    one = F.expr("_words[cast(_i / 2 as int)]")
    two = F.expr("_words[cast(_i / 2 as int) + 1]")
    key = F.when(F.col("_i") % 2 == 0, F.xxhash64(one)).otherwise(F.xxhash64(one, two))
    return rows.withColumn("_bucket", F.when(F.col("_i").isNotNull(), F.pmod(key, F.lit(buckets)).cast("int"))).drop("_words", "_i")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per hash bucket of words and word pairs, log of its share in trusted texts over its share in all texts, in ``UNITS``: at most
    ``buckets`` rows.

    The corpus counts are brought to the trusted texts' total and both get the same additive smoothing, so that buckets
    with few words say little.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct().withColumn("_trusted", F.lit(1))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(small(ids), "_id", "left")
    counts = _ngrams(rows.select("_trusted", words_of(F.col("_text")).alias("_words")), buckets).groupBy("_bucket").agg(
        F.count("_trusted").alias("good"), F.count("*").alias("all"))
    counts = staged(counts, "ratio-counts")
    whole = counts.agg(F.sum("good").alias("good"), F.sum("all").alias("all")).first()
    scale = (whole["good"] or 0) / (whole["all"] or 1)
    ratio = F.log(F.col("good") + smoothing) - F.log(F.col("all") * scale + smoothing)
    return counts.select("_bucket", F.round(ratio * UNITS).cast("long").alias("_ratio"))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = -0.15, buckets: int = 1 << 16, with_text: bool = True,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with their counts, ``base_failed``, ``log_ratio`` and ``kept``.

    ``log_ratio`` is the mean, over the text's words and pairs of neighbouring words, of the log of how much larger their
    hash bucket's share is in the texts whose ids ``trusted`` lists than in all texts. A text passes if it fails no base rule
    (fewer than 50 words; over half of the words in repeated windows of three) and the mean is at least ``threshold``.

    A null text has no words; without words the mean is null and the text is rejected. Null ids are never trusted. Repeated
    rows count and are returned as often as they occur. An empty ``trusted`` makes all ratios 0, so that the base rules alone
    decide; an empty table gives no rows. Columns of ``docs`` named like a result are replaced; all others are returned, the text only ``with_text``.
    """
    ratios = log_ratios(docs, trusted, buckets, id_col=id_col, text_col=text_col)
    if trusted.isEmpty():
        ratios = ratios.withColumn("_ratio", F.lit(0).cast("long"))
    counts = base_counts("_text")
    carried = [c for c in docs.columns if c not in {*counts, "base_failed", "log_ratio", "kept"} and (with_text or c != text_col)]
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)],
                       F.col(text_col).alias("_text"), words_of(F.col(text_col)).alias("_words"))
    rows = rows.select("_row", *[f"_c{i}" for i in range(len(carried))], *[c.alias(n) for n, c in counts.items()], "_words")
    scored = _ngrams(rows, buckets, outer=True).join(F.broadcast(ratios), "_bucket", "left")
    # Plain numbers are summed up by hash; only texts and lists among the carried columns would need a sort.
    out = scored.groupBy("_row").agg(*[F.first(f"_c{i}").alias(c) for i, c in enumerate(carried)], *[F.first(n).alias(n) for n in counts], (F.sum("_ratio") / F.nullif(F.count("_ratio"), F.lit(0)) / UNITS).alias("log_ratio"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (out.drop("_row").withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.coalesce(F.col("log_ratio"), F.lit(0.0)) >= threshold)))
