"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gatewatch.llm.quality_rules import words_of
from gatewatch.llm.staging import numbered, small, staged

SHARD_DOCS = 2_000


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources(source, source_size) with ``target``: weights repeat along the code points of the names, null last; together
    the targets are ``share`` times all sizes; what a source cannot take beyond ``most`` times its size goes to the others by
    weight. Each round of that is one sum over the sources.
    """
    ranked = numbered(sources, F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])[((F.col("rank") - 1) % len(weights)).cast("int")]
    rows = staged(ranked.withColumn("weight", weight).withColumn("most", most * F.col("source_size")).drop("rank"), "targets")
    whole = rows.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    total, level, capped = share * (whole["n"] or 0), 0.0, -1
    free = {"n": 0, "most": 0.0, "w": whole["w"] or 0.0}
    while free["n"] > capped and free["w"]:
        capped, level = free["n"], (total - free["most"]) / free["w"]
        full = F.col("most") <= F.col("weight") * level
        free = rows.agg(F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("most"),
                        F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w")).first()
    return rows.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).drop("weight", "most")


def sainte_lague(parties: DataFrame, group: list[str], order: list[Column], votes: str, seats: Column) -> DataFrame:
    """``parties`` with ``quota``: the seats of each group go one by one to the highest votes / (2 * seats so far + 1).

    A first share by the even divisor is off by a bounded number of seats; only the quotients within that bound of it are
    ranked. There are a few of them per party, whatever the number of seats. Equal quotients go in the given order.
    """
    sums = parties.groupBy(*group).agg(F.sum(votes).alias("_v"), F.count("*").alias("_n"))
    if group:
        rows = parties.join(small(sums), [parties[g].eqNullSafe(sums[g]) for g in group]).drop(*[sums[g] for g in group])
    else:
        whole = sums.first()
        rows = parties.withColumn("_v", F.lit(whole["_v"])).withColumn("_n", F.lit(whole["_n"]))
    rows = rows.withColumn("_seats", seats.cast("long"))
    even = F.when(F.col("_v") > 0, F.floor(F.col(votes) * F.col("_seats") / F.col("_v") + 0.5)).otherwise(0)
    width = F.ceil((even + 1) * F.col("_n") / (2 * F.greatest(F.col("_seats"), F.lit(1)))) + 2
    rows = staged(rows.withColumn("_low", F.greatest(F.lit(0).cast("long"), even - width)).withColumn("_high", F.when(F.col(votes) > 0, even + width).otherwise(F.col("_low"))), "parties")
    tries = rows.where("_high > _low").withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.col("_high")))).withColumn("_q", F.col(votes) / (2 * F.col("_k") - 1))
    ranked = numbered(tries, *[F.col(g).asc_nulls_last() for g in group], F.col("_q").desc(), *order, name="_rank")
    left = rows.groupBy(*group).agg((F.max("_seats") - F.sum("_low")).alias("_left"))
    if group:
        first = ranked.groupBy(*group).agg(F.min("_rank").alias("_first"))
        limits = left.join(first, [left[g].eqNullSafe(first[g]) for g in group]).select(*[left[g] for g in group], "_left", "_first")
        won = ranked.join(small(limits), [ranked[g].eqNullSafe(limits[g]) for g in group]).drop(*[limits[g] for g in group]).where("_rank - _first < _left")
    else:
        won = ranked.where(F.col("_rank") <= F.lit(left.first()["_left"]))
    keys = [c for c in parties.columns if c not in (votes,)]
    more = won.groupBy(*keys).agg(F.count("*").alias("_won"))
    out = rows.join(more, [rows[c].eqNullSafe(more[c]) for c in keys], "left").drop(*[more[c] for c in keys])
    return out.select(*parties.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block_words: int = 8, seed: int = 3,
                id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document a mixture takes whose sources stand in given weights.

    Sources are dealt into shards, documents within a shard stand in a seeded order, and their words are cut into equal
    blocks of about ``block_words``. Blocks are apportioned to sources by target and within a source to its shards by size,
    both by highest quotients. A shard gives whole passes over its blocks and then a run of blocks from a seeded place, so
    that at most two documents of a shard are taken in part per pass. Small blocks keep small sources near their targets;
    their number costs nothing, as blocks are never rows.

    Sizes are words (white-space runs apart); a null, empty or blank text has size 0 and is taken 0. A null source is a source
    of its own, last in order. Repeated rows are documents of their own, each with its place; null ids are ordinary ids. An
    empty table gives no rows. ``id_cols`` name what is returned along; other columns are ignored.

    Returns ``id_cols``, size, source_size, target, taken.
    """
    ids = [F.col(c).alias(f"_id{i}") for i, c in enumerate(id_cols)]
    names = [f"_id{i}" for i in range(len(id_cols))]
    rows = docs.select(*ids, F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"))
    # Equal rows stand side by side, as one entry with a number of copies.
    rows = staged(rows.groupBy(*names, "source", "size").agg(F.count("*").alias("copies")), "sizes")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("docs"))
    sources = staged(targets(sources, weights, share, most), "sources")
    shards = F.ceil(F.col("docs") / SHARD_DOCS)
    mark = F.xxhash64(F.lit(seed), *names, "size")
    placed = rows.join(small(sources), rows["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("shard", F.pmod(mark, shards)).withColumn("_mark", mark)
    stream = Window.partitionBy("source", "shard").orderBy("_mark", *names, "size")
    words = F.col("size") * F.col("copies")
    placed = staged(placed.withColumn("start", F.sum(words).over(stream) - words).drop("_mark", "docs"), "placed")
    blocks = F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.round(F.col("shard_size") / block_words))).otherwise(0).cast("long")
    cut = placed.groupBy("source", "shard").agg(F.sum(words).alias("shard_size")).withColumn("blocks", blocks)
    cut = staged(cut, "shards")
    wanted = cut.groupBy("source").agg(F.sum("blocks").alias("_blocks"))
    wanted = sources.join(wanted, sources["source"].eqNullSafe(wanted["source"])).select(
        sources["source"], F.when(F.col("source_size") > 0, F.col("target") * F.col("_blocks") / F.col("source_size")).otherwise(0.0).alias("votes"))
    given = sainte_lague(wanted, [], [F.col("source").asc_nulls_last()], "votes", F.round(F.col("_v")))
    given = given.select("source", F.col("quota").alias("seats"))
    parts = cut.join(small(given), cut["source"].eqNullSafe(given["source"])).drop(given["source"])
    quotas = sainte_lague(parts.select("source", "shard", "seats", "shard_size", "blocks", F.col("blocks").alias("votes")), ["source", "seats"], [F.col("shard")], "votes", F.col("seats"))
    quotas = quotas.withColumn("quota", F.least(F.col("quota"), most * F.col("blocks")))
    passes = F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(0)
    run = F.when(F.col("blocks") > 0, F.expr("quota % blocks")).otherwise(0)
    begin = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard", "blocks"), F.col("blocks"))).otherwise(0)
    edge = lambda j: F.when(F.col("blocks") > 0, F.floor(j * F.col("shard_size") / F.col("blocks"))).otherwise(0).cast("long")
    runs = quotas.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), passes.alias("passes"), edge(begin).alias("from"), edge(begin + run).alias("to"), "shard_size")
    taken = placed.join(small(runs), F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    taken = taken.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("at", F.col("start") + F.col("copy") * F.col("size"))
    inside = lambda a, b: F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), b) - F.greatest(F.col("at"), a))
    own = F.col("passes") * F.col("size") + inside(F.col("from"), F.col("to")) + inside(F.col("from") - F.col("shard_size"), F.col("to") - F.col("shard_size"))
    return taken.select(*[F.col(n).alias(c) for n, c in zip(names, id_cols)], "size", F.col("source_size").cast("long").alias("source_size"), "target", own.cast("long").alias("taken"))
