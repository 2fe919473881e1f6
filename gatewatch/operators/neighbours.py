"""Exact nearest neighbours within one set of rows, without pairing every row with every other.

Rows with equal values form one *point*, so a large group of copies costs as much as a single row. Points are assigned to
the nearest of a few pivots (Voronoi cells). From the distances between pivots and their closest points follows, for each
point, a radius that surely holds enough neighbours; the triangle inequality then rules out every cell that lies farther
away. What is left is a join of points with the blocks of candidate cells; each task holds one block and one share of
the points that ask for its cell, and emits only its best ``k + 1`` points per point. The result equals the all-pairs search,
ties included. The number of pivots grows with the points, so that a cell stays about half a block, and a cell's points are
copied only as often as the number of points that ask for it demands.

Where most points ask for most cells, as in many columns, such copies would fill the disks. There the points lie in blocks, and each task
takes some blocks past others, one pair in memory at a time: nothing is stored but the points and the best ones found by each task.

(Lu, Shen, Chen, Ooi: "Efficient processing of k nearest neighbor joins using MapReduce", VLDB 2012.)
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.session import scratch_dir

MANY_PIVOTS, MAX_PIVOTS = 128, 8192  # the driver and every task hold them: some megabytes at most
BLOCK_POINTS = 4096
SHARE_POINTS = 50_000
MANY_COPIES = 64  # a point that asks for more cells than this, or for half of them, is not copied for each
PASSES = 4  # parts of the blocks that all others are taken past; each gives every point its best ones
NO_ID, LAST_ID = -(2**63), 2**63 - 1
_SLACK = 1e-9


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation per column, ``mean_c`` and ``std_c``; a deviation of 0 counts as 1."""
    figures = df.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"std_{c}") for c in columns])
    return figures.withColumns({f"std_{c}": F.when(F.col(f"std_{c}") == 0, 1.0).otherwise(F.col(f"std_{c}")) for c in columns})


def scale_z(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its distance from the mean in population deviations. The moments are a scalar subquery."""
    row = column_moments(df, columns).select(F.struct("*")).scalar()
    scaled = df.withColumn("_m", row)
    return scaled.withColumns({c: (F.col(c) - F.col(f"_m.mean_{c}")) / F.col(f"_m.std_{c}") for c in columns}).drop("_m")


def stage(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write to the shared scratch folder and read back: later jobs start from files, not from the whole lineage. The columns
    in ``folders`` become folder names, by which later reads skip files.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, by plain differences."""
    out = np.empty((len(a), len(b)))
    step = max(1, int(4e6 // max(1, b.size)))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.einsum("ijk,ijk->ij", diff, diff)
    return out


def _closest(a: np.ndarray, b: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``b`` of the ``need`` nearest rows of each row of ``a`` and their squared distances, ties by place.

    A product of matrices tells all that can be among them, within its rounding; those alone get their distance by plain differences.
    """
    if len(b) > need:
        sizes = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        with np.errstate(over="ignore", invalid="ignore"):
            near = a @ b.T
            near *= -2
            near += sizes[1]
            near += sizes[0][:, None]
        limit = np.partition(near, need - 1, axis=1)[:, need - 1]
        slack = 16 * (a.shape[1] + 8) * np.finfo(float).eps * (sizes[0] + sizes[1].max())
        # An overflow or a missing value leaves its mark in the sizes; then, and where too many rows are as near, all differences are taken.
        if np.isfinite(sizes[0].sum() + sizes[1].sum()) and np.isfinite(limit).all():
            q, c = np.nonzero(near <= (limit + slack)[:, None])
            if len(q) <= 8 * need * len(a):
                diff = a[q] - b[c]
                d = np.einsum("ijk,ijk->ij", diff[None], diff[None])[0]
                order = np.lexsort((c, d, q))
                first = np.concatenate([[0], np.cumsum(np.bincount(q, minlength=len(a)))[:-1]])
                order = order[np.arange(len(q)) - first[q] < need]
                return c[order].reshape(len(a), need), d[order].reshape(len(a), need)
    d = _distances(a, b)
    best = np.argsort(d, axis=1, kind="stable")[:, :need]
    return best, np.take_along_axis(d, best, 1)


class _Best:
    """The ``need`` nearest points found so far of each row of a block: by distance, then id."""

    def __init__(self, z: np.ndarray, need: int):
        self.z, self.need = z, need
        self.other, self.distance = np.full((len(z), need), LAST_ID), np.full((len(z), need), np.nan)

    def take(self, rows: np.ndarray, others: np.ndarray, b: np.ndarray) -> None:
        """Take the points ``b`` into account for the given rows."""
        sizes = np.einsum("ij,ij->i", b, b)
        for start in range(0, len(rows), 512):
            at = rows[start:start + 512]
            q, c, d = self._nearer(at, b, sizes)
            # Only rows with something new are put in order again; theirs are at least ``need`` entries each.
            new, q = np.unique(q, return_inverse=True)
            of = at[new]
            q = np.concatenate([np.repeat(np.arange(len(new)), self.need), q])
            d, o = np.concatenate([self.distance[of].ravel(), d]), np.concatenate([self.other[of].ravel(), others[c]])
            order = np.lexsort((o, d, q))
            first = np.concatenate([[0], np.cumsum(np.bincount(q, minlength=len(new)))])[:-1]
            order = order[np.arange(len(q)) - first[q[order]] < self.need]
            self.distance[of], self.other[of] = d[order].reshape(-1, self.need), o[order].reshape(-1, self.need)

    def _nearer(self, at: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in ``b`` and distance of all that may be among the nearest: a product of matrices tells them, as in ``_closest``."""
        a, limit = self.z[at], self.distance[at, -1]
        if np.isfinite(limit).all():
            own = np.einsum("ij,ij->i", a, a)
            slack = 16 * (a.shape[1] + 8) * np.finfo(float).eps * (own + sizes.max())
            with np.errstate(over="ignore", invalid="ignore"):
                near = a @ b.T
                near *= -2
                near += sizes
            if np.isfinite(own.sum() + sizes.sum()):
                q, c = np.nonzero(near <= (limit + slack - own)[:, None])
                if len(q) <= 8 * self.need * len(a):
                    diff = a[q] - b[c]
                    return q, c, np.einsum("ijk,ijk->ij", diff[None], diff[None])[0]
        best, d = _closest(a, b, self.need)
        return np.repeat(np.arange(len(a)), best.shape[1]), best.ravel(), d.ravel()


def _in_blocks(placed: DataFrame, block_points: int, parts: int) -> RDD[tuple]:
    """``number, cell, ids, z`` of at most ``block_points`` points of a cell, kept in the executors' memory or on their disks."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def blocks() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            held, cell, n = [], None, 0
            for pdf in batches:
                for number, part in pdf.groupby("cell", sort=True):
                    for start in range(0, len(part), block_points):
                        piece = part.iloc[start:start + block_points]
                        if held and (number != cell or n + len(piece) > block_points):
                            yield packed(held, cell)
                            held, n = [], 0
                        held, cell, n = [*held, piece], number, n + len(piece)
            if held:
                yield packed(held, cell)

        for number, (cell, ids, z) in enumerate(blocks()):
            yield pd.DataFrame({"block": [pickle.dumps(((TaskContext.get().partitionId(), number), cell, ids, z), 5)]})

    def packed(held: list[pd.DataFrame], cell: int) -> tuple[int, np.ndarray, np.ndarray]:
        whole = pd.concat(held)
        return int(cell), whole["cid"].fillna(NO_ID).to_numpy(np.int64), np.stack(whole["z"].to_numpy())

    ordered = placed.select("cid", "z", "cell").repartitionByRange(parts, "cell", "cid").sortWithinPartitions("cell", "cid")
    return ordered.mapInPandas(pack, "block binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _too_many(copies: int, n_points: int, n_cells: int) -> bool:
    return copies > n_points * max(8, min(MANY_COPIES, n_cells / 2))


def _pick_pivots(points: DataFrame, n_points: int) -> np.ndarray:
    """The points with the smallest hashes: bounded, repeatable and spread like the data. Few points get the root of their number,
    many two for each block.
    """
    wanted = max(1, min(MANY_PIVOTS, int(np.sqrt(n_points))), min(MAX_PIVOTS, 2 * n_points // BLOCK_POINTS))
    rows = points.orderBy(F.xxhash64("cid"), "cid").limit(wanted).select("z").collect()
    return np.array([r["z"] for r in rows], dtype=float)


def _with_cell(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 1024):
                part = pdf.iloc[start:start + 1024].copy()
                d = _distances(np.stack(part["z"].to_numpy()), pivots)
                part["cell"] = d.argmin(axis=1).astype("int32")
                part["pd"] = np.sqrt(d.min(axis=1))
                yield part

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInPandas(assign, f"{fields}, cell int, pd double")


def nearest(df: DataFrame, row_id: str, columns: Sequence[str], k: int, scale: bool = True,
            max_pivots: int | None = None, block_points: int = BLOCK_POINTS, share_points: int = SHARE_POINTS, carry: bool = True) -> DataFrame:
    """``row_id, neighbours``: the ``min(k, n - 1)`` nearest other rows of each row, as an array of
    ``(distance2, id, values)`` ordered by distance, then id; without ``carry``, of ``(distance2, id)``. ``row_id`` is a unique bigint.
    """
    if k <= 0:
        raise ValueError("k must be greater than zero")
    spark = df.sparkSession
    columns = list(columns)
    raw = F.array(*[(F.col(c).cast("double") + F.lit(0.0)) for c in columns])
    rows = stage(df.select(F.col(row_id).cast("bigint").alias("id"), raw.alias("values")), "knn-rows")
    mean, std = [0.0] * len(columns), [1.0] * len(columns)
    if scale:
        # One row per column comes back.
        for m in rows.select(F.posexplode("values")).groupBy("pos").agg(F.avg("col").alias("mean"), F.stddev_pop("col").alias("std")).collect():
            mean[m["pos"]], std[m["pos"]] = m["mean"], m["std"] or 1.0

    # Distinct points; each keeps the k+1 smallest ids, as no more of them can be anyone's neighbours.
    smallest = Window.partitionBy("values").orderBy("id")
    members = (rows.withColumn("_rn", F.row_number().over(smallest)).filter(F.col("_rn") <= k + 1)
               .groupBy("values").agg(F.sort_array(F.collect_list("id")).alias("ids")))

    def scaled(values: Column) -> Column:
        centred = F.zip_with(values, F.lit(mean), lambda v, m: v - m)
        return F.zip_with(centred, F.lit(std), lambda v, s: v / s)

    points = stage(members.select(F.col("ids")[0].alias("cid"), "ids", "values", scaled(F.col("values")).alias("z")), "knn-points")
    n_points = points.count()
    if n_points == 0:
        return rows.select(F.col("id").alias(row_id)).withColumn(
            "neighbours", F.lit(None).cast(f"array<struct<distance2:double,id:bigint{',values:array<double>' if carry else ''}>>"))
    pivots = _pick_pivots(points.select("cid", "z"), n_points)[: max_pivots or MAX_PIVOTS]
    placed = stage(_with_cell(points.select("cid", F.size("ids").alias("m"), "z"), pivots), "knn-cells")

    # Per cell: its extent and the pivot distances of the k+1 rows closest to the pivot. At most MAX_PIVOTS * (k+1) numbers.
    near = Window.partitionBy("cell").orderBy("pd", "cid")
    closest = placed.withColumn("_rn", F.row_number().over(near)).filter(F.col("_rn") <= k + 1)
    close = closest.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("pd", "m"))).alias("close"))
    extent = placed.groupBy("cell").agg(F.min("pd").alias("lo"), F.max("pd").alias("hi"), F.count("*").alias("n"))
    cells = extent.join(close, "cell").orderBy("cell").collect()
    numbers = np.array([c["cell"] for c in cells])
    lo, hi, size = (np.array([c[name] for c in cells], dtype=float) for name in ("lo", "hi", "n"))
    n_blocks = np.maximum(1, np.ceil(size / block_points)).astype(int)
    reach, reach_cell = [], []
    for i, c in enumerate(cells):
        spread = [p["pd"] for p in c["close"] for _ in range(min(p["m"], k + 1))][: k + 1]
        reach += spread
        reach_cell += [i] * len(spread)
    reach, reach_cell, centres = np.array(reach), np.array(reach_cell), pivots[numbers]
    need = k + 1
    rows_at_once = max(1, int(2e7 // max(1, len(reach), centres.size)))

    def asks(z: np.ndarray) -> np.ndarray:
        """Which cells each point has to look into."""
        d = np.sqrt(_distances(z, centres))
        bound = d[:, reach_cell] + reach
        radius = np.full(len(z), np.inf)
        if bound.shape[1] >= need:
            radius = np.partition(bound, need - 1, axis=1)[:, need - 1]
        gap = np.maximum(np.maximum(d - hi, lo - d), 0.0)
        return gap <= (radius * (1 + _SLACK) + _SLACK)[:, None]

    def parts_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        for pdf in batches:
            for start in range(0, len(pdf), rows_at_once):
                part = pdf.iloc[start:start + rows_at_once]
                yield part, asks(np.stack(part["z"].to_numpy()))

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [sum(int(wanted.sum()) for _, wanted in parts_of(batches))]})

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, wanted in parts_of(batches):
            q, c = np.nonzero(wanted)
            yield pd.DataFrame({"cid": part["cid"].to_numpy()[q], "z": part["z"].to_numpy()[q], "cell": numbers[c].astype("int32")})

    def past(pairs: Iterator[tuple[tuple, tuple]]) -> Iterator[bytes]:
        """The best of the blocks that a task takes each of its own past."""
        found: dict[tuple, tuple[np.ndarray, _Best, np.ndarray]] = {}
        for (number, _, ids, z), (_, cell, others, b) in pairs:
            if number not in found:
                wanted = np.concatenate([asks(z[i:i + rows_at_once]) for i in range(0, len(z), rows_at_once)])
                found[number] = ids, _Best(z, need), np.packbits(wanted, axis=1)
            _, best, wanted = found[number]
            place = int(np.searchsorted(numbers, cell))
            rows = np.flatnonzero(wanted[:, place // 8] & (128 >> place % 8))
            if len(rows):
                best.take(rows, others, b)
        for ids, best, _ in found.values():
            at = best.other != LAST_ID
            table = pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(ids, need)[at.ravel()], best.other[at], best.distance[at])], names=["cid", "other", "distance2"])
            yield pickle.dumps(table, 5)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (pickle.loads(x.as_py()) for x in batch.column(0))

    def by_pairs() -> DataFrame:
        """All blocks taken past all others; stored, as the blocks are let go afterwards."""
        cores = spark.sparkContext.defaultParallelism
        blocks = _in_blocks(placed, max(1, min(block_points, 4_000_000 // (8 * len(columns)))), max(2 * cores, -(-n_points // share_points)))
        others = blocks.coalesce(min(PASSES, blocks.getNumPartitions()))
        found = spark.createDataFrame(blocks.cartesian(others).mapPartitions(past).map(lambda x: (x,)), "best binary")
        try:
            kept = stage(found.mapInArrow(unpacked, "cid bigint, other bigint, distance2 double"), "knn-best")
        finally:
            blocks.unpersist()
        return kept.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("cid", "other")})

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": [], "other": [], "distance2": []}).astype({"cid": "int64", "other": "int64"})
        right = right.sort_values("cid")
        b, others = np.stack(right["z"].to_numpy()), right["cid"].to_numpy()
        found = []
        for start in range(0, len(left), 512):
            part = left.iloc[start:start + 512]
            best, d = _closest(np.stack(part["z"].to_numpy()), b, need)
            found.append(pd.DataFrame({"cid": np.repeat(part["cid"].to_numpy(), best.shape[1]), "other": others[best].ravel(),
                                       "distance2": d.ravel()}))
        return pd.concat(found)

    def by_cells() -> DataFrame:
        asked = stage(placed.select("cid", "z").mapInPandas(route, "cid bigint, z array<double>, cell int"), "knn-asked")
        # One short row per cell, at most MAX_PIVOTS: blocks by its own points, shares by the points that ask for it.
        blocks_of = spark.createDataFrame([(int(c), int(b)) for c, b in zip(numbers, n_blocks)], "cell int, blocks int")
        plan = asked.groupBy("cell").agg(F.ceil(F.count("*") / share_points).cast("int").alias("shares")).join(F.broadcast(blocks_of), "cell")
        plan = F.broadcast(stage(plan, "knn-plan"))

        def dealt(salt: int, count: str) -> Column:
            return F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(count)).cast("int")

        def each(count: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

        asked = asked.join(plan, "cell").select("cid", "z", "cell", dealt(0, "shares").alias("share"), each("blocks").alias("block"))
        held = placed.join(plan, "cell").select("cid", "z", "cell", dealt(1, "blocks").alias("block"), each("shares").alias("share"))
        keys = ["cell", "block", "share"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(compare, "cid bigint, other bigint, distance2 double")

    copied = placed.select("z").mapInPandas(copies, "n bigint").agg(F.sum("n")).first()[0]
    partial = by_pairs() if _too_many(copied, n_points, len(cells)) else by_cells()
    best = Window.partitionBy("cid").orderBy("distance2", "other")
    top = partial.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= need).drop("_rn")
    # From points back to rows: every point stands for its smallest ids.
    others = points.select(F.col("cid").alias("other"), "ids", *([F.col("values").alias("other_values")] if carry else []))
    entries = top.join(others, "other").select("cid", "distance2", F.explode("ids").alias("id"), *(["other_values"] if carry else []))
    ranked = Window.partitionBy("cid").orderBy("distance2", "id")
    entries = entries.withColumn("_rn", F.row_number().over(ranked)).filter(F.col("_rn") <= need)
    lists = entries.groupBy("cid").agg(
        F.sort_array(F.collect_list(F.struct("distance2", "id", *([F.col("other_values").alias("values")] if carry else [])))).alias("_near"))
    by_values = lists.join(points.select("cid", "values"), "cid").select("values", "_near")
    own = F.slice(F.filter("_near", lambda e: e["id"] != F.col("id")), 1, k)
    return rows.join(by_values, "values").select(F.col("id").alias(row_id), own.alias("neighbours"))


def knn_minority(df: DataFrame, row_id: str, columns: Sequence[str], k: int, **kw) -> DataFrame:
    """``row_id, neighbour_rank, neighbour_id`` in z-scaled space."""
    near = nearest(df, row_id, columns, k, carry=False, **kw)
    return near.select(row_id, F.posexplode("neighbours").alias("_pos", "_entry")).select(
        row_id, (F.col("_pos") + 1).alias("neighbour_rank"), F.col("_entry.id").alias("neighbour_id"))
