"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.staging import staged

N_STATISTICS = 17
SCORE_BINS = 4000  # calibration steps between raw scores of -0.5 and 1.5
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
            "symbol": b"#*$%&|<>", "stop": b".,;:?", "shout": b"!", "line": b"\n"}
_MEMBER = np.stack([np.isin(np.arange(256), list(chars)) for chars in _CLASSES.values()] + [np.arange(256) >= 128], 1).astype(np.float64)


def statistics(text: str | None) -> list[float]:
    """Shares of characters, words and lines of a whole text; all zero without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, chars = len(words), sum(map(len, words))
    upper, lower, digit, symbol, stop, shout, line, wide = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _MEMBER).tolist()
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [np.log1p(n), chars / n, upper / chars, lower / chars, digit / chars, symbol / chars, symbol / n, stop / n, shout / n, wide / chars, line / n,
            len(set(words)) / n, sum(map(eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)),
            float((lengths <= 3).mean()), float(np.log1p(lengths.std()))]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "x"])


@dataclass
class QualityModel:
    """What a fit leaves: a few hundred numbers of fixed size. ``steps`` maps raw scores to calibrated ones."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.concatenate([waves, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.steps), 0, 1) if len(x) else np.zeros(0)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATISTICS)


def _normal(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    """One partition's sums: a row of the normal equations each."""
    size = len(model.phases) + 1
    sums = np.zeros((size, size + 1))
    for batch in batches:
        a = model.expand(_matrix(batch.column(0)))
        sums += a.T @ np.concatenate([a, batch.column(1).to_numpy()[:, None]], 1)
    yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([r.tobytes() for r in sums], pa.binary())], names=["i", "part"])


def _total(rows):
    parts = rows["part"].to_pylist()
    return pa.table({"i": rows["i"][:1], "part": pa.array([sum(np.frombuffer(p) for p in parts).tobytes()], pa.binary())})


def _binned(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = model.raw(_matrix(batch.column(0)))
        place = np.clip(np.floor((raw + 0.5) / 2 * SCORE_BINS), 0, SCORE_BINS - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["place", "y"])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rising fit of weighted means in order of ``x``; the places and heights of its steps."""
    steps: list[list[float]] = []
    for a, b, w in zip(x, y, n):
        steps.append([a * w, b * w, w])
        while len(steps) > 1 and steps[-2][1] / steps[-2][2] >= steps[-1][1] / steps[-1][2]:
            last = steps.pop()
            steps[-1] = [p + q for p, q in zip(steps[-1], last)]
    return np.array([s[0] / s[2] for s in steps]), np.array([s[1] / s[2] for s in steps])


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, calibrate: Column, waves: int = 256, width: float = 4.0, ridge: float = 1e-3,
                seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learns from the labelled rows where ``learn`` holds: the ridge weights from those outside ``calibrate``, the calibration
    from those inside. An id with several labels counts with their mean; null ids and null labels teach nothing.

    Without any labelled row every score is 0.5. The driver receives ``waves + 1`` rows of sums and at most 4000 score bins.
    """
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("y")).where("id is not null")
    texts = docs.where(F.coalesce(learn, F.lit(False))).select(F.struct(F.col(id_col).alias("id"), F.coalesce(calibrate, F.lit(False)).alias("late")).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    stats = texts.mapInArrow(_features, f"id struct<id:{id_type},late:boolean>, x array<double>").select("id.*", "x")
    rows = staged(stats.join(marks, "id").select("x", "y", "late"), "quality-train")
    first = rows.where("not late")
    moments = first.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(N_STATISTICS)],
                        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(N_STATISTICS)]).first()
    draw = np.random.default_rng(seed)
    model = QualityModel(np.zeros(N_STATISTICS), np.ones(N_STATISTICS), draw.normal(0, 1 / width, (N_STATISTICS, waves)),
                         draw.uniform(0, 2 * np.pi, waves), np.zeros(waves + 1), (np.array([0.0]), np.array([0.5])))
    if not moments["n"]:
        return model
    model.mean = np.array([moments[f"m{i}"] for i in range(N_STATISTICS)])
    model.scale = np.array([moments[f"s{i}"] or 1.0 for i in range(N_STATISTICS)])
    sums = first.select("x", "y").mapInArrow(lambda it: _normal(it, model), "i int, part binary").groupBy("i").applyInArrow(_total, "i int, part binary")
    whole = np.stack([np.frombuffer(r["part"]) for r in sorted(sums.collect(), key=lambda r: r["i"])])
    penalty = ridge * moments["n"] * np.eye(waves + 1)
    penalty[-1, -1] = 0
    fitted = QualityModel(model.mean, model.scale, model.frequencies, model.phases, np.linalg.solve(whole[:, :-1] + penalty + 1e-9 * np.eye(waves + 1), whole[:, -1]), model.steps)
    late = rows.where("late") if not rows.where("late").isEmpty() else rows
    bins = late.select("x", "y").mapInArrow(lambda it: _binned(it, fitted), "place int, y double").groupBy("place").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    steps = sorted(bins.collect(), key=lambda r: r["place"])
    x, y, n = (np.array([r[c] for r in steps], np.float64) for c in ("place", "y", "n"))
    fitted.steps = isotonic((x + 0.5) / SCORE_BINS * 2 - 0.5, y, n)
    return fitted


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the calibrated score (0 to 1) of every whole text; a column of that name is replaced.

    A null, empty or blank text has all statistics 0 and gets the score the model gives them. Repeated rows stay; equal texts
    have equal scores. No rows are shuffled. ``drop`` names columns that the result leaves out.
    """
    kept = [c for c in docs.columns if c != score_col]
    at, keep = kept.index(text_col), [i for i, c in enumerate(kept) if c not in drop]
    schema = T.StructType([*(docs.schema[kept[i]] for i in keep), T.StructField(score_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(text.as_py()) for text in batch.column(at)]).reshape(-1, N_STATISTICS)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(model.score(x), pa.float64())], names=schema.names)

    return docs.select(*kept).mapInArrow(score, schema)
