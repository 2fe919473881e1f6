"""Near-duplicate texts: chosen-path set similarity join (Christiani, Pagh and Sivertsen) on word shingles.

A text's set is branched down independent trees: at each level of a tree the level's own hash function chooses the set's
smallest token, and texts that chose the same tokens so far share a node. Nodes with few texts are compared exhaustively on
sketches; larger ones branch on. What meets there is only a candidate: candidate clusters are then compared on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.graph import components
from gatewatch.llm.staging import small, staged
from gatewatch.llm.words import WordHashes, groups_of, joined_up, lower_words, mix

LEVELS = 6
NODE_LIMIT = 64  # a node of at most this many texts is compared exhaustively
CHUNK = 192  # full sets compared in one go
BLOCK = 2048  # long sketches compared in one go
EDGE = 96  # and of these, those whose full sets are compared together
MARKS = 1024  # bytes of a long sketch


def shingles(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct runs of ``width`` words as sorted 64-bit hashes; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint64)
    own = hashes.of(words)
    if len(own) < width:
        width = len(own)
    runs = own[: len(own) - width + 1] + np.uint64(width)
    for k in range(1, width):
        runs = mix(runs, own[k : len(own) - width + 1 + k])
    return np.unique(runs)


def _factors(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Per hash function the token it chooses from the set, by its smallest value."""
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(least, (found[i : i + 2048, None] * factors).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sets(batches: Iterator[pa.RecordBatch], width: int, factors: np.ndarray) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, digests, sketches = [], [], []
        for text in batch.column(1):
            found = shingles(lower_words(text.as_py()), width, hashes)
            sizes.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            sketches.append(_sketch(found, factors).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
                                         names=["id", "n_shingles", "digest", "sketch"])


def _stars(ids: np.ndarray, linked: np.ndarray) -> tuple[list[int], list[int]]:
    """The links of each connected part with its first member; far fewer than all pairs."""
    label = joined_up(linked)
    other = np.flatnonzero(label != np.arange(len(label)))
    return ids[other].tolist(), ids[label[other]].tolist()


def _links(found: Iterator[tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in found:
        a += x
        b += y
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _compare_sketches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    def each():
        for rows in groups_of(batches, "node"):
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint32).reshape(rows.num_rows, -1)
            yield _stars(rows["id"].to_numpy(), (sketch[:, None] == sketch[None]).mean(2) >= least)

    yield from _links(each())


def _alike(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs have 100 * intersection >= percent * union, by exact counts."""
    sizes = np.array([len(s) for s in sets])
    known, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    use = times[at] > 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[use], shared[at[use]]
    common = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 8192
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, (k, k + step))
        block = np.zeros((len(sets), step), np.float32)
        block[row[i:j], column[i:j] - k] = 1
        common += block @ block.T
    return 100 * common >= percent * (sizes[:, None] + sizes[None] - common)


def _compare_sets(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def each():
        for rows in groups_of(batches, "part"):
            sets = [shingles(lower_words(t.as_py()), width, hashes) for t in rows["text"]]
            yield _stars(rows["id"].to_numpy(), _alike(sets, percent))

    yield from _links(each())


def _long_sketches(batches: Iterator[pa.RecordBatch], width: int, factors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per text one byte for each hash function: the last bits of the token it chooses."""
    hashes = WordHashes()
    for batch in batches:
        sets = [shingles(lower_words(t.as_py()), width, hashes) for t in batch.column(1)]
        marks = [_sketch(found, factors).astype(np.uint8).tobytes() if len(found) else None for found in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["id", "marks"])


def _promising(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Texts whose full sets have to be compared, by squares of at most ``EDGE`` asking and ``EDGE`` other texts: those that have a
    partner of another component in the square with as many equal bytes.
    """
    for rows in groups_of(batches, "part"):
        marks = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        ids, component, part = rows["id"].to_numpy(), rows["component"].to_numpy(), rows["part"][0].as_py()
        asks = rows["asks"].to_numpy()
        own, other, square = np.flatnonzero(asks), np.flatnonzero(~asks), 0
        for i in range(0, len(own), EDGE):
            a = own[i : i + EDGE]
            for j in range(0, len(other), EDGE):
                b, square = other[j : j + EDGE], square + 1
                apart = component[a][:, None] != component[b][None]
                near = apart & ((marks[a][:, None] == marks[b][None]).sum(2) >= least * marks.shape[1]) if apart.any() else apart
                if near.any():
                    met = np.unique(np.concatenate([ids[a[near.any(1)]], ids[b[near.any(0)]]]))
                    key = int.from_bytes(xxhash.xxh3_64_digest(f"{part},{square}"), "big", signed=True)
                    yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array([key] * len(met), pa.int64())], names=["id", "part"])


def _candidates(sets: DataFrame, trees: int, least: float) -> DataFrame:
    """Links between texts that reach a small node together and have like sketches, or share a node that cannot be split."""
    path = lambda level: F.xxhash64(F.col("tree"), F.substring("path", 1, 4 * (level + 1)))
    rows = sets.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sketch")
    rows = rows.select("id", "tree", F.expr(f"substring(sketch, tree * {4 * LEVELS} + 1, {4 * LEVELS})").alias("path"))
    few, links = None, []
    for level in range(LEVELS):
        rows = rows.withColumn("node", path(level))
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")
        met = staged(rows.join(sizes, "node"), f"level-{level}")
        done = met.where(F.col("n") <= NODE_LIMIT).select("node", "id")
        few = done if few is None else few.unionAll(done)
        rows = met.where(F.col("n") > NODE_LIMIT)
        if level == LEVELS - 1:
            links.append(rows.select(F.col("id").alias("a"), F.col("least").alias("b")))
        elif rows.isEmpty():
            break
        rows = rows.select("id", "tree", "path")
    few = few.join(sets.select("id", "sketch"), "id").repartition("node").sortWithinPartitions("node")
    found = few.mapInArrow(lambda it: _compare_sketches(it, least), "a long, b long")
    for more in links:
        found = found.unionAll(more)
    return staged(found.where("a <> b").distinct(), "candidates")


def _confirmed(docs: DataFrame, clusters: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """Links on full sets within candidate clusters(id, cluster), complete for connectivity.

    A cluster is dealt into chunks, each compared exhaustively together with two texts that all chunks get. Texts that are
    then not connected with the cluster's largest part are compared with all texts of other components by sketches of
    ``MARKS`` bytes, five standard deviations below the threshold, and by full sets where these are near.
    """
    mark = F.xxhash64(F.lit("chunk"), F.col("id"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.struct(mark, "id"))["id"].alias("p1"), F.max(F.struct(mark, "id"))["id"].alias("p2"))
    placed = staged(clusters.join(sizes, "cluster").withColumn("chunks", F.ceil(F.col("n") / CHUNK)).withColumn("chunk", F.pmod(mark, F.col("chunks"))), "clusters")
    everywhere = (F.col("chunks") > 1) & ((F.col("id") == F.col("p1")) | (F.col("id") == F.col("p2")))
    spread = placed.select("id", "cluster", F.explode(F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))).alias("chunk"))

    def compared(places: DataFrame) -> DataFrame:
        rows = docs.join(small(places), "id").repartition("part").sortWithinPartitions("part").select("part", "id", "text")
        return rows.mapInArrow(lambda it: _compare_sets(it, width, percent), "a long, b long").where("a <> b").distinct()

    links = staged(compared(spread.select("id", F.xxhash64("cluster", "chunk").alias("part"))), "links")
    several = placed.where("chunks > 1")
    if several.isEmpty():
        return links
    parts = several.join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = staged(parts.select("id", "cluster", "n", "component"), "parts")
    counts = parts.groupBy("cluster", "component").agg(F.count("*").alias("m"))
    main = counts.groupBy("cluster").agg(F.max(F.struct("m", "component"))["component"].alias("main"))
    blocks = F.ceil(F.count_if(F.col("component") != F.col("main")) / BLOCK)
    asked = parts.join(main, "cluster").groupBy("cluster", "main").agg(blocks.alias("blocks"), F.ceil(F.max("n") / BLOCK).alias("cells")).where("blocks > 0")
    touched = staged(parts.join(asked, "cluster"), "touched")
    if touched.isEmpty():
        return links
    factors = _factors(MARKS, seed)
    marks = docs.join(small(touched.select("id").distinct()), "id", "left_semi").select("id", "text")
    marks = staged(marks.mapInArrow(lambda it: _long_sketches(it, width, factors), "id long, marks binary").where("marks is not null"), "marks")
    at = percent / 100
    least = at - 5 * math.sqrt(at * (1 - at) / MARKS)
    spot = lambda name, n: F.pmod(F.xxhash64(F.lit(name), F.col("id")), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = touched.where("component <> main").select("id", "cluster", "component", F.lit(True).alias("asks"), spot("block", "blocks").alias("block"), every("cells").alias("cell"))
    others = touched.select("id", "cluster", "component", F.lit(False).alias("asks"), every("blocks").alias("block"), spot("cell", "cells").alias("cell"))
    both = asking.unionByName(others).select("id", "component", "asks", F.xxhash64("cluster", "block", "cell").alias("part"))
    rows = both.join(marks, "id").repartition("part").sortWithinPartitions("part")
    near = staged(rows.mapInArrow(lambda it: _promising(it, least), "id long, part long"), "promising")
    return links if near.isEmpty() else links.unionAll(compared(near))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, recall: float = 0.999, seed: int = 11,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups texts whose sets of ``width``-word shingles are linked: 100 * intersection >= ``percent`` * union.

    Words are lower-cased (A-Z) runs without white space; a text with fewer than ``width`` words is one shingle, one without
    words is linked with nothing. Equal sets are one text throughout, so copies cost nothing. The number of trees is what the
    target recall asks of a pair at the threshold that has to descend every level; links are confirmed on full sets.

    Returns one row per row of ``docs``: the id, n_shingles, component_id (the smallest id reachable by links, itself
    included), kept (whether that is its own id). Rows without an id are linked with nothing and kept, with a null
    component_id. Rows that share an id are one document, whose links are those of all its texts. An empty table gives no
    rows. Other columns are ignored.
    """
    at = percent / 100
    trees = max(1, math.ceil(math.log(1 - recall) / math.log(1 - at ** LEVELS)))
    factors = _factors(trees * LEVELS, seed)
    least = at - 4 * math.sqrt(at * (1 - at) / len(factors))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = staged(texts.mapInArrow(lambda it: _sets(it, width, factors), "id long, n_shingles long, digest binary, sketch binary"), "sets")
    known = rows.where("digest is not null and id is not null")
    classes = staged(known.groupBy("digest").agg(F.min("id").alias("class"), F.first("sketch").alias("sketch"), F.count("*").alias("n")), "classes")
    links = _candidates(classes.select(F.col("class").alias("id"), "sketch"), trees, least)
    clusters = components(links).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    found = _confirmed(texts, clusters, width, percent, seed + 1)
    # Ids are the nodes: copies hang on their class, and an id with several texts joins their classes.
    copies = known.join(classes.where("n > 1").select("digest", "class"), "digest").select(F.col("id").alias("a"), F.col("class").alias("b"))
    twice = known.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select("id")
    odd = known.join(twice, "id").join(classes.select("digest", "class"), "digest").select(F.col("id").alias("a"), F.col("class").alias("b"))
    tops = components(found.unionAll(odd))
    own = staged(copies.where("a <> b").distinct(), "copies")
    node = rows.select("id", "n_shingles").join(own.groupBy("a").agg(F.min("b").alias("class")), F.col("id") == F.col("a"), "left").withColumn("class", F.coalesce("class", "id")).drop("a")
    out = node.join(tops, node["class"] == tops["node"], "left").withColumn("component_id", F.coalesce("component", "class"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
