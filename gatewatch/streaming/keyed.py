"""Live features and de-duplication by Spark's own keyed state.

One stateful operator per feature family keeps, for every key, in the state store:

* ``recent``: the rows of the key's last windows, as the columns that the windows read; older ones are removed with every batch;
* ``seen``: per paired value, and for the key alone, the time of its last row: one entry each, read and written by entry;
* ``newest``: time and number of the key's newest row.

A row's features depend on earlier rows of its own keys alone, so only the order inside a key matters: rows may arrive in any
order between keys. A row that arrives behind its key's newest one is late: it is returned with ``late`` set and without
features, and changes no state. Rows without a key need no state and pass beside the operator. The state is the store's: it
is kept with the checkpoint and found again after a restart or the loss of an executor.

Rows of a key that are read together travel as one row of lists, and a key's rows of a batch are worked through as whole columns:
Python handles lists and keys one by one, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from itertools import batched
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from gatewatch.functions.scalar import valid_key
from gatewatch.operators.windows import Count, Distinct, Family
from gatewatch.plans.features import FAMILIES, with_context
from gatewatch.schemas import MISSING_TIME_DELTA, OUTPUT_COLUMNS, PARSED_COLUMNS

PACKED_BATCHES = 16  # Arrow batches whose rows are packed together
OUT_ROWS = 50_000  # rows handed back at once
NO_SEQ = -2**63  # in place of a null, so that lists of numbers stay whole numbers

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside use the store that these operators need; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Chains:
    """Rows in their order, chained by the values of one column where ``live``; -1 is the place of a row that is not there."""

    def __init__(self, values: np.ndarray, live: np.ndarray):
        self.size, self.codes = len(values), np.where(live, pd.factorize(values)[0], -1)
        self.order = np.argsort(self.codes, kind="stable")
        self.order = self.order[np.count_nonzero(self.codes < 0):]
        linked = self.codes[self.order][1:] == self.codes[self.order][:-1]
        self.before, self.after = np.full(self.size, -1), np.full(self.size, -1)
        self.before[self.order[1:][linked]] = self.order[:-1][linked]
        self.after[self.order[:-1][linked]] = self.order[1:][linked]

    def distinct(self, times: np.ndarray, window: int, first: np.ndarray) -> np.ndarray:
        """Per row, the values among the rows from ``first`` to the one before it: those that became active before this row, less
        those that ended before ``first``.
        """
        live = self.codes >= 0
        starts = live & ((self.before < 0) | (times - times[self.before] > window))
        ends = live & ((self.after < 0) | (times[self.after] - times > window))
        return _sums(starts)[:-1] - _sums(ends)[first]

    def earlier(self, first: np.ndarray) -> np.ndarray:
        """Per row, the rows with its value from ``first`` to the one before it; 0 for rows outside the chains."""
        out, step = np.zeros(self.size, dtype=np.int64), self.size + 1
        places = self.codes[self.order] * step + self.order
        out[self.order] = np.arange(len(places)) - np.searchsorted(places, self.codes[self.order] * step + first[self.order])
        return out


def _sums(amounts: np.ndarray) -> np.ndarray:
    """Sums of the amounts before each place, and of all at the end."""
    return np.concatenate([[0], np.cumsum(amounts, dtype=np.int64)])


def _others(family: Family) -> list[str]:
    named = [f.value for f in family.rolling if isinstance(f, Distinct)] + [o for _, o, _ in family.pair_counts]
    return list(dict.fromkeys([*named, *(o for _, o in (*family.first_seen, *family.recency) if o)]))


class FamilyState(StatefulProcessor):
    """All features of one family for one key. An input row holds rows of the key as lists: ``timestamp``, ``seq``, the paired values as
    ``v0``, ``v1``, ..., whether each pair is valid as ``ok0``, ..., whether the key is as ``ok``, and counted flags as ``w0``, ...
    """

    def __init__(self, family: Family):
        self.family, self.others = family, _others(family)
        self.flags = list(dict.fromkeys(f.when for f in family.rolling if isinstance(f, Count) and f.when))
        self.longest = max([0, *(f.window for f in family.rolling), *(p[2] for p in family.pair_counts)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = [*(f"v{i}" for i in range(len(self.others))), *(f"ok{i}" for i in range(len(self.others))), *(f"w{i}" for i in range(len(self.flags)))]
        types = ["string"] * len(self.others) + ["boolean"] * len(self.others) + ["bigint"] * len(self.flags)
        self.recent = handle.getListState("recent", ", ".join(["timestamp bigint", *(f"{c} {t}" for c, t in zip(self.kept, types))]))
        self.seen = handle.getMapState("seen", "slot int, value string", "timestamp bigint")
        self.newest = handle.getValueState("newest", "timestamp bigint, seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows), ignore_index=True)
        arrived = {c: np.concatenate(parts[c].tolist()) for c in ("timestamp", "seq", "ok", *self.kept)}
        if arrived["timestamp"].dtype != np.int64:
            raise ValueError("a row has no time")
        order = np.lexsort((arrived["seq"], arrived["timestamp"]))
        arrived = {c: v[order] for c, v in arrived.items()}
        newest = tuple(self.newest.get()) if self.newest.exists() else None
        t, seq = arrived["timestamp"], arrived["seq"]
        late = np.zeros(len(t), dtype=bool)
        late[1:] = (t[1:] == t[:-1]) & (seq[1:] == seq[:-1])
        if newest:
            newest = newest[0], NO_SEQ if newest[1] is None else newest[1]
            late |= (t < newest[0]) | ((t == newest[0]) & (seq <= newest[1]))
        taken = {c: v[~late] for c, v in arrived.items()}
        made = self._features(taken, newest is not None) if len(taken["seq"]) else {}
        whole = {}
        for name in self.family.names():
            values = np.zeros(len(t), dtype=np.int64)
            values[~late] = made.get(name, 0)
            whole[name] = pd.arrays.IntegerArray(values, late.copy())
        out = pd.DataFrame({"seq": seq, "late": late, **whole})
        for i in range(0, len(out), OUT_ROWS):
            yield out[i:i + OUT_ROWS]

    def _features(self, taken: dict[str, np.ndarray], known: bool) -> dict[str, np.ndarray]:
        """All features of rows in their order, none older than the key's newest one (``known``); puts them into the state."""
        family, place = self.family, {o: i for i, o in enumerate(self.others)}
        kinds = {c: np.int64 if c[0] == "w" else bool if c[0] == "o" else object for c in self.kept}
        history = [tuple(r) for r in self.recent.get()] if known else []
        past = dict(zip(["timestamp", *self.kept], zip(*history))) if history else {}
        rows = {"timestamp": np.concatenate([np.array(past.get("timestamp", ()), dtype=np.int64), taken["timestamp"]])}
        for c, kind in kinds.items():
            held = np.empty(len(history), dtype=kind)
            held[:] = [v if kind is object else kind(v or 0) for v in past.get(c, ())]
            rows[c] = np.concatenate([held, taken[c].astype(kind)])
        t, n = rows["timestamp"], len(history)
        first = {w: np.searchsorted(t, t - w) for w in {f.window for f in family.rolling} | {p[2] for p in family.pair_counts}}
        made: dict[str, np.ndarray] = {}

        chains = {o: _Chains(rows[f"v{place[o]}"], ~pd.isna(rows[f"v{place[o]}"])) for o in dict.fromkeys(f.value for f in family.rolling if isinstance(f, Distinct))}
        for f in family.rolling:
            if isinstance(f, Distinct):
                made[f.name] = chains[f.value].distinct(t, f.window, first[f.window])
            elif f.when:
                sums = _sums(rows[f"w{self.flags.index(f.when)}"])
                made[f.name] = sums[:-1] - sums[first[f.window]]
            else:
                made[f.name] = np.arange(len(t)) - first[f.window]
        for name, other, window in family.pair_counts:
            made[name] = _Chains(rows[f"v{place[other]}"], rows[f"ok{place[other]}"]).earlier(first[window])
        made = {name: values[n:] for name, values in made.items()}

        asked = dict.fromkeys(o for _, o in (*family.first_seen, *family.recency))
        before = {o: self._times_before(place[o] if o else -1, taken[f"v{place[o]}"] if o else np.full(len(taken["ok"]), "", dtype=object),
                                        taken[f"ok{place[o]}" if o else "ok"].astype(bool), taken["timestamp"]) for o in asked}
        for name, o in family.first_seen:
            made[name] = (taken[f"ok{place[o]}"].astype(bool) & ~before[o][1]).astype(np.int64)
        for name, o in family.recency:
            made[name] = np.where(before[o][1], taken["timestamp"] - before[o][0], MISSING_TIME_DELTA)

        self.newest.update((int(t[-1]), None if taken["seq"][-1] == NO_SEQ else int(taken["seq"][-1])))
        start = int(np.searchsorted(t, t[-1] - self.longest))
        self.recent.put(list(zip(*(rows[c][start:].tolist() for c in ("timestamp", *self.kept)))))
        return made

    def _times_before(self, slot: int, values: np.ndarray, ok: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row, the time of the row before it with its value, and whether there is one; the state then holds the times of the last rows."""
        chains, times, found = _Chains(values, ok), np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=bool)
        inside = chains.before >= 0
        times[inside], found[inside] = t[chains.before[inside]], True
        for i in np.flatnonzero((chains.codes >= 0) & ~inside):
            seen = self.seen.getValue((slot, values[i]))
            if seen is not None:
                times[i], found[i] = seen[0], True
        for i in np.flatnonzero((chains.codes >= 0) & (chains.after < 0)):
            self.seen.updateValue((slot, values[i]), (int(t[i]),))
        return times, found

    def close(self) -> None:
        pass


def key_lists(rows: DataFrame) -> DataFrame:
    """One row for the rows with the same ``k`` that a task reads together: ``k``, and all other columns as lists. No row is lost."""
    listed = [c for c in rows.columns if c != "k"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(batches, PACKED_BATCHES):
            groups = pa.Table.from_batches(some).group_by("k", use_threads=False).aggregate([(c, "list") for c in listed])
            yield from groups.rename_columns([c.removesuffix("_list") for c in groups.column_names]).select(["k", *listed]).to_batches()

    kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    return rows.mapInArrow(packed, ", ".join([f"k {kinds['k']}", *(f"{c} array<{kinds[c]}>" for c in listed)]))


def family_stream(events: DataFrame, family: Family) -> DataFrame:
    """seq, late and the features of ``family`` for every row of a stream of events with context columns."""
    others = _others(family)
    flags = list(dict.fromkeys(f.when for f in family.rolling if isinstance(f, Count) and f.when))
    keyed = events.where(F.col(family.key).isNotNull()).select(
        F.col(family.key).alias("k"), "timestamp", F.coalesce("seq", F.lit(NO_SEQ)).alias("seq"), valid_key(family.key).alias("ok"), *[F.col(o).alias(f"v{i}") for i, o in enumerate(others)],
        *[valid_key(family.key, o).alias(f"ok{i}") for i, o in enumerate(others)], *[F.coalesce(F.col(w).cast("bigint"), F.lit(0)).alias(f"w{i}") for i, w in enumerate(flags)])
    schema = ", ".join(["seq bigint", "late boolean", *(f"`{c}` bigint" for c in family.names())])
    found = key_lists(keyed).groupBy("k").transformWithStateInPandas(FamilyState(family), schema, "Append", "None")
    found = found.withColumn("seq", F.nullif("seq", F.lit(NO_SEQ)))
    neutral = {name: MISSING_TIME_DELTA for name, _ in family.recency}
    bare = events.where(F.col(family.key).isNull()).select("seq", F.lit(False).alias("late"), *[F.lit(neutral.get(c, 0)).cast("bigint").alias(c) for c in family.names()])
    whole = {name for name, _ in family.recency}
    return found.unionByName(bare).select("seq", "late", *[F.col(c) if c in whole else F.col(c).cast("int").alias(c) for c in family.names()])


def start_families(events: DataFrame, out: str, families: Sequence[Family] = FAMILIES) -> list[StreamingQuery]:
    """One query per family over a stream of parsed events with a unique ``seq``, each with its checkpoint and table under ``out``, and
    one that keeps the events. All files that are there are worked through in batches; the queries may then be started again.
    """
    context = with_context(events.select(*PARSED_COLUMNS, "seq"))
    parts = {"events": context} | {f.key: family_stream(context, f) for f in families}
    with state_store(events.sparkSession):
        return [rows.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/checkpoints/{name}")
                .trigger(availableNow=True).start() for name, rows in parts.items()]


def read_families(spark: SparkSession, out: str, families: Sequence[Family] = FAMILIES) -> DataFrame:
    """The feature table with ``seq`` and ``late`` (behind the newest row of one of its keys) from what the queries wrote."""
    rows, late = spark.read.parquet(f"{out}/events"), []
    for family in families:
        part = spark.read.parquet(f"{out}/{family.key}")
        late.append(F.col(f"_late_{family.key}"))
        rows = rows.join(part.withColumnRenamed("late", f"_late_{family.key}"), "seq")
    return rows.select(*OUTPUT_COLUMNS, "seq", F.greatest(*late).alias("late"))


RECORD_BUCKETS = 2048  # groups of record keys; the state must be started anew if it is changed


class RecordState(StatefulProcessor):
    """For all record keys of one bucket: the time of the row of each that was kept last, one entry a key, of which a batch reads and
    writes those it meets. Input rows hold ``key``, ``at``, ``tie`` and the columns ``names``.
    """

    def __init__(self, names: Sequence[str], keep_for: int):
        self.names, self.keep_for = list(names), keep_for

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "key string", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows)).sort_values(["at", "tie"], kind="stable")
        before: dict[str, int | None] = {}
        for k in parts["key"].unique().tolist():
            found = self.kept.getValue((k,))
            before[k] = None if found is None else found[0]
        now, status = dict(before), []
        for k, t in zip(parts["key"].tolist(), parts["at"].tolist()):
            at = now[k]
            if at is None or t > at + self.keep_for:
                status.append("kept")
                now[k] = t
            else:
                status.append("late" if t < at - self.keep_for else "repeated")
        for k, t in now.items():
            if t != before[k]:
                self.kept.updateValue((k,), (t,))
        yield parts[self.names].assign(status=status)

    def close(self) -> None:
        pass


def _key_text(events: DataFrame, column: str) -> Column:
    """A text that is equal where the grouping would hold the values for equal."""
    kind, c = events.schema[column].dataType.typeName(), F.col(column)
    if kind in ("float", "double"):
        c = c + F.lit(0.0)
    elif kind == "timestamp":
        c = F.unix_micros(c)
    elif kind == "binary":
        c = F.hex(c)
    elif kind in ("array", "struct"):
        c = F.to_json(F.struct(c))
    return c.cast("string")


def dedup_marked(events: DataFrame, event_time: str = "event_time", keep_for: int = 3600, keys: Sequence[str] = ("record_id",)) -> DataFrame:
    """Every row of the stream with a ``status``: ``kept``; ``repeated``, within ``keep_for`` seconds of the row of its key that was kept
    last; or ``late``, longer than that before it, so that it may be a reused number and not a copy. Nothing vanishes.

    Rows without a key or a time are kept. Rows of a key that arrive together count in order of time, ties by their hash. A
    column named ``status`` is replaced; all others come back, whatever their names.
    """
    columns = [c for c in events.columns if c != "status"]
    plain = [f"c{i}" for i in range(len(columns))]
    whole = reduce(and_, [F.col(c).isNotNull() for c in (*keys, event_time)])
    types = [events.schema[c].dataType.simpleString() for c in columns]
    # As text, a long beside a null keeps all its digits in pandas.
    passed = ["string" if t == "bigint" else t for t in types]
    key = F.to_json(F.array(*[_key_text(events, k) for k in keys]))
    timed = events.where(whole).select(*[F.col(c).cast(t).alias(p) for c, t, p in zip(columns, passed, plain)], key.alias("key"),
                                       F.unix_timestamp(event_time).alias("at"), F.xxhash64(*columns).alias("tie"))
    schema = ", ".join([*(f"{p} {t}" for p, t in zip(plain, passed)), "status string"])
    bucket = F.pmod(F.xxhash64("key"), F.lit(RECORD_BUCKETS))
    marked = timed.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(RecordState(plain, keep_for), schema, "Append", "None")
    named = marked.select(*[F.col(p).cast(t).alias(c) for c, t, p in zip(columns, types, plain)], "status")
    return named.unionByName(events.where(~whole).select(*columns, F.lit("kept").alias("status")))
