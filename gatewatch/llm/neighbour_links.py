"""Links between embeddings by NN-descent (Dong, Moses and Li, 2011).

Every vector keeps a short list of its nearest known neighbours. Lists start from random-hyperplane buckets and are refined
by comparing the neighbours of each vector with each other; a list that is full of links is enlarged. Vectors whose lists
stay full of links, which may hide links to other pockets, are compared exactly across pockets by leaders and a radius
bound. Buckets are as fine as the size of their own label asks for, and there are as many of them as it takes for two vectors
at the threshold to meet with the chance asked for. A bounded sample of vectors, one half of it outside large pockets, is
compared with all others to measure the share of links found per vector; missing ones are added, and the search goes on with
new buckets until recall is reached, or else fails. Links are finally counted exactly, in double precision, block by block
within each connected pocket.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.llm.graph import components
from gatewatch.llm.staging import small, staged
from gatewatch.llm.words import groups_of, joined_up

SLACK = 1e-4  # single-precision similarities may be off by less
BUCKET = 48
PART = 64  # neighbours of one vector compared in one go
BLOCK = 512  # vectors per side in the exact count
AUDIT = 1024  # vectors compared with all others to measure recall, from large pockets and from the rest each
AUDITS = 8  # as many samples of the rest, as long as fewer than LINKED vectors in them have links
LINKED = 64
EXTRA = 16  # hyperplanes more for a bucket that holds many vectors
TRIALS = 4  # buckets per vector in one go

log = logging.getLogger(__name__)

_SIMS = "a long, b long, sim float"


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes; null for a vector that is null, zero or has a component that is null or not finite."""
    for batch in batches:
        units = []
        for x in batch.column(2):
            v = np.array(x.as_py() or [], dtype=np.float64)  # a null component becomes nan
            norm = float(np.sqrt((v / scale) @ (v / scale)) * scale) if len(v) and np.isfinite(v).all() and (scale := np.abs(v).max()) else 0.0
            units.append((v / norm).tobytes() if norm else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], names=["id", "label", "unit"])


def _matrix(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _signs(batches: Iterator[pa.RecordBatch], bits: int, trials: list[int]) -> Iterator[pa.RecordBatch]:
    """Per trial the side of each of ``bits`` random hyperplanes that a vector lies on, as one number."""
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        data = batch.column(1).to_pylist()
        bytes_each = np.array([len(d) for d in data])
        codes = np.zeros((len(data), len(trials)), np.int64)
        for size in np.unique(bytes_each):
            rows = np.flatnonzero(bytes_each == size)
            vectors = np.frombuffer(b"".join(data[i] for i in rows), np.float32).reshape(len(rows), -1)
            for k, t in enumerate(trials):
                if (size, t) not in planes:
                    planes[size, t] = np.random.default_rng(t).normal(size=(vectors.shape[1], bits)).astype(np.float32)
                codes[rows, k] = ((vectors @ planes[size, t]) > 0) @ (1 << np.arange(bits))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["node", "codes"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each group, for every vector those of the others that come nearer than its list's last entry, best ones first."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def made():
        a, b, s = (np.concatenate(c) for c in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float32())], names=["a", "b", "sim"])

    for rows in groups_of(batches, "g"):
        nodes, worst, most = rows["node"].to_numpy(), rows["worst"].to_numpy(), rows["most"].to_numpy()
        vectors = _matrix(rows["vector"], np.float32)
        sims = vectors @ vectors.T
        sims[nodes[:, None] == nodes[None]] = -2
        order = np.argsort(-sims, axis=1)
        ranked = np.take_along_axis(sims, order, 1)
        i, j = np.nonzero((ranked > worst[:, None]) & (np.arange(len(nodes)) < most[:, None]))
        out.append((nodes[i], nodes[order[i, j]], ranked[i, j]))
        size += len(i)
        if size > 100_000:
            yield made()
            out, size = [], 0
    if out:
        yield made()


def _compared(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs worth keeping within the groups(g, node, worst, most)."""
    rows = groups.join(vectors.select("node", "vector"), "node").select("g", "node", "worst", "most", "vector")
    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_near, _SIMS)


def _buckets(vectors: DataFrame, trials: list[int]) -> DataFrame:
    """node, label, size, trial, code, depth, parts: as many hyperplanes as a label's own size asks for, and more for a bucket
    with many vectors; what stays together even then is cut into parts at random.
    """
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / BUCKET))).cast("int").alias("bits")
    labels = staged(vectors.groupBy("label", "size").agg(bits), "label-bits")
    most = min(62, (labels.agg(F.max("bits")).first()[0] or 0) + EXTRA)
    codes = vectors.select("node", "vector").mapInArrow(lambda it: _signs(it, most, trials), "node long, codes array<long>")
    rows = codes.join(vectors.select("node", "label", "size"), "node").join(small(labels), ["label", "size"])
    rows = rows.select("node", "label", "size", "bits", F.posexplode("codes").alias("trial", "sides"))
    first = lambda n: F.expr(f"sides & (shiftleft(1L, {n}) - 1L)")
    rows = staged(rows.withColumn("code", first("bits")), "buckets")
    keys = ["label", "size", "trial", "code"]
    extra = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 2 * BUCKET).select(*keys, F.ceil(F.log2(F.col("n") / BUCKET)).cast("int").alias("extra"))
    rows = rows.join(small(extra), keys, "left").withColumn("depth", F.least(F.lit(most), F.col("bits") + F.coalesce("extra", F.lit(0)))).withColumn("code", first("depth"))
    rows = rows.select("node", *keys, "depth")
    keys.append("depth")
    parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / (2 * BUCKET)).alias("parts")).where("parts > 1")
    return rows.join(small(parts), keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))


def _started(vectors: DataFrame, trials: list[int], length: int, buckets: DataFrame | None = None) -> DataFrame:
    """Neighbours inside random-hyperplane buckets."""
    rows = _buckets(vectors, trials) if buckets is None else buckets
    part = F.pmod(F.xxhash64("node", "trial"), "parts")
    groups = rows.select(F.xxhash64("label", "size", "trial", "code", "depth", part).alias("g"), "node", F.lit(-1.5).cast("float").alias("worst"), F.lit(length).alias("most"))
    return _compared(groups, vectors)


def _same_side(least: float) -> float:
    """The chance that a random hyperplane leaves two vectors at the threshold on one side."""
    return 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi


def _unmet(chances: DataFrame, full: DataFrame) -> float:
    """The largest label mean of the chance that a vector met none of its links at the threshold in any bucket.

    Vectors with lists full of links are left out: what they miss is found by comparing pockets.
    """
    rows = chances.join(full, "node", "left_anti").groupBy("node").agg(F.first("label").alias("label"), F.exp(F.sum("unmet")).alias("unmet"))
    return rows.groupBy("label").agg(F.avg("unmet").alias("unmet")).agg(F.max("unmet")).first()[0] or 0.0


def _trimmed(pairs: DataFrame, lengths: DataFrame, length: int) -> DataFrame:
    """The best entries of every list: ``length``, or what ``lengths`` gives an enlarged one."""
    once = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    rows = once.join(small(lengths), once["a"] == lengths["node"], "left").withColumn("most", F.coalesce("most", F.lit(length))).drop("node")
    return rows.withColumn("place", F.row_number().over(best)).where("place <= most").drop("place")


def _refined(lists: DataFrame, vectors: DataFrame, turn: int) -> DataFrame:
    """One round: neighbours and reverse neighbours of each vector are compared with each other."""
    ends = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count("*").alias("n"), F.max("most").alias("most"))
    limits = ends.select(F.col("a").alias("node"), F.when(F.col("n") >= F.col("most"), F.col("low")).otherwise(-1.5).cast("float").alias("worst"), "most")
    both = lists.select("a", "b").unionAll(lists.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    sizes = both.groupBy("a").agg(F.ceil(F.count("*") / PART).alias("parts")).where("parts > 1")
    both = both.join(small(sizes), "a", "left")
    part = F.pmod(F.xxhash64("b", F.lit(turn)), F.coalesce("parts", F.lit(1)))
    groups = both.select(F.xxhash64("a", part).alias("g"), F.col("b").alias("node")).join(limits, "node", "left")
    groups = groups.select("g", "node", F.coalesce("worst", F.lit(-1.5).cast("float")).alias("worst"), F.coalesce("most", F.lit(1)).alias("most"))
    return _compared(groups, vectors)


def _audit(batches: Iterator[pa.RecordBatch], nodes: np.ndarray, labels: np.ndarray, units: list[np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        own, own_labels, data = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()), batch.column(2).to_pylist()
        width = np.array([len(d) for d in data])
        for size in np.unique(width):
            rows, asked = np.flatnonzero(width == size), np.array([i for i, u in enumerate(units) if u.nbytes == size], np.int64)
            if not len(asked):
                continue
            sims = np.stack([units[i] for i in asked]) @ np.frombuffer(b"".join(data[i] for i in rows)).reshape(len(rows), -1).T
            i, j = np.nonzero((sims >= least) & (labels[asked][:, None] == own_labels[rows][None]) & (nodes[asked][:, None] != own[rows][None]))
            a += nodes[asked[i]].tolist()
            b += own[rows[j]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _asked(classes: DataFrame, pockets: DataFrame, least: float, longest: int, search: int) -> DataFrame:
    """a, b, large, found: all true links of a sample of vectors from pockets of more than ``longest``, and of another from the rest.

    A link is found when both ends are in one pocket, within which all pairs are compared. The rest is asked for further
    samples until enough vectors in them have links. Every search draws its own samples.
    """
    large = pockets.join(pockets.groupBy("pocket").agg(F.count("*").alias("n")).where(F.col("n") > longest), "pocket").select("node", F.lit(True).alias("large"))
    rows = classes.select("node", "label", "unit").join(large, "node", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    every = {r["large"]: max(1, r["n"] // AUDIT) for r in rows.groupBy("large").agg(F.count("*").alias("n")).collect()}
    draw = F.xxhash64("node", F.lit(f"audit{search}"))
    one, two = pockets.select(F.col("node").alias("a"), F.col("pocket").alias("p")), pockets.select(F.col("node").alias("b"), F.col("pocket").alias("q"))
    seen = None
    for turn in range(min(AUDITS, every.get(False, 1))):
        picked = ~F.col("large") & (F.pmod(draw, F.lit(every.get(False, 1))) == turn)
        if not turn:
            picked = picked | F.col("large") & (F.pmod(draw, F.lit(every.get(True, 1))) == 0)
        sample = rows.where(picked).limit(4 * AUDIT).collect()
        asked = (np.array([r["node"] for r in sample], np.int64), np.array([r["label"] for r in sample]), [np.frombuffer(bytes(r["unit"])) for r in sample])
        truth = classes.select("node", "label", "unit").mapInArrow(lambda it, asked=asked: _audit(it, *asked, least), "a long, b long")
        now = truth.join(one, "a", "left").join(two, "b", "left").select("a", "b", F.coalesce(F.col("p") == F.col("q"), F.lit(False)).alias("found"))
        now = staged(now.join(large.withColumnRenamed("node", "a"), "a", "left").withColumn("large", F.coalesce("large", F.lit(False))), "audit")
        seen = now if seen is None else seen.unionAll(now)
        if seen.where("not large").select("a").distinct().count() >= LINKED:
            break
    return seen


def _recall(seen: DataFrame) -> float:
    """The mean share of links found per vector that has links, in large pockets or in the rest, whichever is lower."""
    shares = seen.groupBy("large", "a").agg(F.avg(F.col("found").cast("int")).alias("share")).groupBy("large").agg(F.avg("share").alias("share"), F.count("*").alias("n")).collect()
    for r in shares:
        log.info("recall %.5f of %d vectors with links %s large pockets", r["share"], r["n"], "in" if r["large"] else "outside")
    return min((r["share"] for r in shares), default=1.0)


def _count(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Per block of a pocket: every vector's exact number of links in it, and the links that connect its parts."""
    for rows in groups_of(batches, "g"):
        nodes, own, copies, across = (rows[c].to_numpy() for c in ("node", "own", "copies", "across"))
        units = _matrix(rows["unit"], np.float64)
        linked = units @ units.T >= least
        np.fill_diagonal(linked, False)
        label = joined_up(linked)
        # Inside one chunk all pairs count, between two chunks only pairs across.
        if across[0]:
            linked &= own[:, None] != own[None]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array((linked @ copies).astype(np.int64)), pa.array(nodes[label], pa.int64())], names=["node", "links", "other"])


def _counted(vectors: DataFrame, pockets: DataFrame, least: float) -> DataFrame:
    """node, links, other: exact counts within pockets(node, pocket), which are cut into chunks and compared two by two."""
    sizes = pockets.groupBy("pocket").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    rows = pockets.join(sizes, "pocket").withColumn("own", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("node", "own", (F.col("own") != F.col("with")).alias("across"), F.xxhash64("pocket", F.least("own", "with"), F.greatest("own", "with")).alias("g"))
    rows = rows.join(vectors.select("node", "copies", "unit"), "node").repartition("g").sortWithinPartitions("g")
    return staged(rows.mapInArrow(lambda it: _count(it, least), "node long, links long, other long"), "counted")


def _leaders(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Every vector's leader, one of its own group that it is linked with, and the largest angle of that leader's followers."""
    for rows in groups_of(batches, "g"):
        units, nodes = _matrix(rows["unit"], np.float64), rows["node"].to_numpy()
        lead, radius = np.full(len(nodes), -1), np.zeros(len(nodes))
        for i in range(len(nodes)):
            if lead[i] < 0:
                sims = units @ units[i]
                near = (lead < 0) & (sims >= least)
                near[i] = True
                lead[near], radius[near] = i, np.arccos(np.clip(sims[near].min(), -1, 1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[lead], pa.int64()), pa.array(radius)], names=["node", "leader", "radius"])


def _facing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of leaders of different pockets whose followers may be linked; of linked leaders one pair for two pockets."""
    for rows in groups_of(batches, "g"):
        nodes, own, pocket, across, radius = (rows[c].to_numpy() for c in ("leader", "own", "pocket", "across", "radius"))
        units = _matrix(rows["unit"], np.float64)
        sims = units @ units.T
        reach = np.minimum(np.arccos(least) + radius[:, None] + radius[None] + 1e-6, np.pi)
        # Inside one chunk all pairs count, between two chunks only pairs across.
        able = (sims >= np.cos(reach)) & (pocket[:, None] < pocket[None]) & (~across[0] | (own[:, None] != own[None]))
        i, j = np.nonzero(able)
        sure = sims[i, j] >= least
        _, pair = np.unique(np.stack([pocket[i], pocket[j]], 1), axis=0, return_inverse=True)
        pair = pair.reshape(-1)
        settled = np.zeros(pair.max(initial=-1) + 1, bool)
        settled[pair[sure]] = True
        at = np.flatnonzero(sure)
        at = np.concatenate([at[np.unique(pair[at], return_index=True)[1]], np.flatnonzero(~settled[pair])]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i[at]], pa.int64()), pa.array(nodes[j[at]], pa.int64()), pa.array(sure[at])], names=["a", "b", "sure"])


def _crossing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """One link between the two sides of each group, where there is any."""
    for rows in groups_of(batches, "g"):
        nodes, first, units = rows["node"].to_numpy(), rows["first"].to_numpy(), _matrix(rows["unit"], np.float64)
        i, j = np.nonzero(units[first] @ units[~first].T >= least)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[first][i[:1]], pa.int64()), pa.array(nodes[~first][j[:1]], pa.int64())], names=["a", "b"])


def _bridged(classes: DataFrame, pockets: DataFrame, full: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """Pockets(node, pocket) united wherever two vectors of ``full``, whose lists hold nothing but links, are linked across them.

    A list with room left holds a vector's nearest known neighbours, so only a link between two full lists can stay unseen.
    """
    many = pockets.join(full, "node").join(classes.select("node", "label", "size", "unit"), "node")
    chunks = many.groupBy("pocket").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    rows = many.join(chunks, "pocket").withColumn("g", F.xxhash64("pocket", F.pmod(F.xxhash64("node", F.lit("leader")), F.col("chunks"))))
    led = rows.select("g", "node", "unit").repartition("g").sortWithinPartitions("g").mapInArrow(lambda it: _leaders(it, least), "node long, leader long, radius double")
    led = staged(led, "leaders")
    heads = led.where("node = leader").select("leader", "node", "radius").join(many, "node").drop("node")
    chunks = heads.groupBy("label", "size").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"), F.countDistinct("pocket").alias("pockets")).where("pockets > 1").drop("pockets")
    if chunks.isEmpty():
        return pockets
    rows = heads.join(chunks, ["label", "size"]).withColumn("own", F.pmod(F.xxhash64("leader", F.lit("chunk")), F.col("chunks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("leader", "own", "pocket", "radius", "unit", (F.col("own") != F.col("with")).alias("across"), F.xxhash64("label", "size", F.least("own", "with"), F.greatest("own", "with")).alias("g"))
    pairs = staged(rows.repartition("g").sortWithinPartitions("g").mapInArrow(lambda it: _facing(it, least), "a long, b long, sure boolean"), "facing").distinct()
    if pairs.isEmpty():
        return pockets
    links = links.select("a", "b").unionAll(pairs.where("sure").select("a", "b"))
    united = staged(components(links).withColumnRenamed("component", "pocket"), "pockets")
    one, two = united.select(F.col("node").alias("a"), F.col("pocket").alias("p")), united.select(F.col("node").alias("b"), F.col("pocket").alias("q"))
    open_ = staged(pairs.where("not sure").join(one, "a").join(two, "b").where("p <> q").select("a", "b", F.xxhash64("a", "b").alias("g")), "undecided")
    if open_.isEmpty():
        return united
    sides = open_.select("g", F.col("a").alias("leader"), F.lit(True).alias("first")).unionAll(open_.select("g", F.col("b").alias("leader"), F.lit(False).alias("first")))
    rows = sides.join(led.select("leader", "node"), "leader").join(classes.select("node", "unit"), "node").select("g", "node", "first", "unit")
    found = staged(rows.repartition("g").sortWithinPartitions("g").mapInArrow(lambda it: _crossing(it, least), "a long, b long"), "crossing")
    return united if found.isEmpty() else staged(components(links.unionAll(found)).withColumnRenamed("component", "pocket"), "pockets")


def link_neighbours(rows: DataFrame, least: float = 0.98, length: int = 8, longest: int = 64, recall: float = 0.995, rounds: int = 3, searches: int = 32,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of one label whose cosine is at least ``least`` (in double precision), and their connected groups.

    A vector that is null, empty, zero or has null or non-finite components, and one without a label, is linked with nothing.
    Vectors of different length are never compared. Equal vectors are searched for once and count as linked. Repeated rows,
    also of one id, count as vectors of their own. A null id keeps its links, but is never a group's smallest id; a group of
    null ids has a null component_id, and such rows count as kept. An empty table gives no rows.

    A search ends the work when new samples of vectors, in large pockets and outside, show a mean recall per vector of at
    least ``recall``, and in every label two vectors at the threshold have met in a bucket with that chance. Where that is
    not so after all ``searches``, a RuntimeError gives the figures instead of rows.

    Returns one row per row: the id, n_links (other rows linked directly), component_id, kept.
    """
    units = staged(rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).mapInArrow(
        _unit, f"id long, label {rows.schema[label_col].dataType.simpleString()}, unit binary"), "units")
    node = F.xxhash64("label", F.md5("unit"))
    nodes = units.where("unit is not null and label is not null").withColumn("node", node)
    classes = nodes.groupBy("node").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = staged(classes.withColumn("size", F.length("unit")), "classes")
    vectors = staged(classes.select("node", "label", "size", "unit").mapInArrow(_single, f"node long, label {classes.schema['label'].dataType.simpleString()}, size int, vector binary"), "vectors")
    bound, side = least - SLACK, _same_side(least)
    largest = vectors.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 1
    met = side ** max(0, math.ceil(math.log2(largest / BUCKET)))
    wanted = 1 if met >= 1 else max(1, math.ceil(math.log(max(1e-9, 1 - recall)) / math.log(1 - met)))
    lists, lengths, missed = None, classes.select("node", F.lit(0).alias("most")).limit(0), None
    trials, chances = 0, None
    for search in range(searches):
        until = trials + (max(TRIALS, wanted) if not search else TRIALS)
        while trials < until:
            now = list(range(trials, min(until, trials + TRIALS)))
            trials = now[-1] + 1
            buckets = staged(_buckets(vectors, now), "buckets")
            unmet = F.log(F.greatest(F.lit(1e-12), 1 - F.pow(F.lit(side), "depth") / F.col("parts")))
            unmet = staged(buckets.groupBy("node").agg(F.first("label").alias("label"), F.sum(unmet).alias("unmet")), "chances")
            chances = unmet if chances is None else chances.unionAll(unmet)
            started = _started(vectors, now, length, buckets)
            if lists is not None:
                started = started.unionAll(lists.select("a", "b", "sim"))
            lists = staged(_trimmed(started, lengths, length), "lists")
        links = -1
        for turn in range(rounds):
            full = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count("*").alias("n"), F.max("most").alias("most"))
            more = full.where((F.col("low") >= bound) & (F.col("n") >= F.col("most")) & (F.col("most") < longest))
            more = more.select(F.col("a").alias("node"), (2 * F.col("most")).alias("most"))
            lengths = staged(lengths.unionAll(more).groupBy("node").agg(F.max("most").alias("most")), "lengths")
            pairs = _refined(lists, vectors, rounds * search + turn).unionAll(lists.select("a", "b", "sim"))
            lists = staged(_trimmed(pairs, lengths, length), "lists")
            before, links = links, lists.where(F.col("sim") >= bound).count()
            if links <= before * 1.001:
                break
        links = lists.where(F.col("sim") >= bound).select("a", "b")
        links = links if missed is None else links.unionAll(missed)
        pockets = staged(components(links).withColumnRenamed("component", "pocket"), "pockets")
        full = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count("*").alias("n"), F.max("most").alias("most")).where((F.col("low") >= bound) & (F.col("n") >= F.col("most")))
        full = staged(full.select(F.col("a").alias("node")), "full")
        pockets = pockets if full.isEmpty() else _bridged(classes, pockets, full, links, least)
        seen = _asked(classes, pockets, least, longest, search)
        reached, unmet = _recall(seen), _unmet(chances, full)
        # Links that the sample misses join their pockets, but count for nothing in the next search's new sample.
        new = seen.where("not found").select("a", "b")
        missed = new if missed is None else missed.unionAll(new)
        if reached >= recall and unmet <= 1 - recall:
            break
    else:
        raise RuntimeError(f"recall {reached:.4f} after {searches} searches, {recall} asked for; pairs at the threshold met with chance {1 - unmet:.4f}")
    if not new.isEmpty():
        pockets = staged(components(pockets.select(F.col("node").alias("a"), F.col("pocket").alias("b")).unionAll(new)).withColumnRenamed("component", "pocket"), "pockets")
    counted = _counted(classes, pockets, least)
    groups = components(counted.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "copies", "least").join(links, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(small(smallest), "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    known = staged(known, "known")
    out = units.withColumn("node", F.when(F.col("unit").isNotNull() & F.col("label").isNotNull(), node)).select("id", "node").join(small(known), "node", "left")
    own = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.frombuffer(u.as_py()).astype(np.float32).tobytes() for u in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(vectors, pa.binary())], names=["node", "label", "size", "vector"])
