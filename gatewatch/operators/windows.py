"""Exact trailing-window counts and distinct counts, first-seen flags and recency.

A row at time ``t`` sees the rows before it, in ``(ts, seq)`` order, whose time lies in ``[t - W, t]``. The row
itself is not counted; earlier rows of the same second are. A null key gives 0.

Both are differences of two running sums: what became active before this row, minus what had expired by its second.
For a count, each row becomes active once and expires W seconds later. For a distinct count, a value becomes active at
a row with no earlier row of it within W seconds, and expires W seconds after a row with no later one. Running sums
need one ordered pass, whatever the number of rows inside a window.

There are three physical forms:

* :func:`rolling` and :func:`previous_time` hold for any key distribution. Rows are first summed per key and *cell*
  (one second, or ``cell_rows`` sequence numbers of it). The ordered pass over a key sees cells, so its length is
  bounded by the time span, not by the rows. Rows themselves are spread by key and cell.
* :func:`with_family` computes all features of one key from a single exchange on it. It is for keys known to be small
  enough for a task; :mod:`gatewatch.plans.features` sends only the others to the first form.
* :func:`rolling_in_buckets` cuts time into buckets and copies the rows of the last window before a bucket into it, as a halo.
  A task sees one key's rows of one bucket and its halo, however long the log is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatewatch.functions.scalar import valid_key, valid_key_sql
from gatewatch.schemas import MISSING_TIME_DELTA

CELL_ROWS = 1_000_000
SALTS = 4096


@dataclass(frozen=True)
class Count:
    """Prior rows of the group within ``window`` seconds for which the column ``when`` is 1 (all, if None)."""

    name: str
    window: int
    when: str | None = None


@dataclass(frozen=True)
class Distinct:
    """Different non-null ``value`` texts among the prior rows of the group within ``window`` seconds."""

    name: str
    value: str
    window: int


@dataclass(frozen=True)
class Family:
    """All stateful features whose state is kept per ``key``, alone or paired with a second column."""

    key: str
    rolling: tuple[Count | Distinct, ...] = ()
    pair_counts: tuple[tuple[str, str, int], ...] = ()
    first_seen: tuple[tuple[str, str], ...] = ()
    recency: tuple[tuple[str, str | None], ...] = field(default=())

    def names(self) -> list[str]:
        return [f.name for f in self.rolling] + [p[0] for p in (*self.pair_counts, *self.first_seen, *self.recency)]


def _names(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def _active_minus_expired(by: str, ts: str, order: Sequence[str], on: str, off: str, window: int) -> str:
    """SQL text of the difference of the two running sums."""
    before = f"sum({on}) over (partition by {by} order by {_names(order)} rows between unbounded preceding and 1 preceding)"
    expired = f"sum({off}) over (partition by {by} order by `{ts}` range between unbounded preceding and {window + 1} preceding)"
    return f"coalesce({before}, 0) - coalesce({expired}, 0)"


def _starts(ts: str, previous: str, window: int) -> str:
    return f"cast({previous} is null or `{ts}` - {previous} > {window} as int)"


def _ends(ts: str, following: str, window: int) -> str:
    return f"cast({following} is null or {following} - `{ts}` > {window} as int)"


def rolling(df: DataFrame, keys: Sequence[str], features: Sequence[Count | Distinct], ts: str = "timestamp",
            seq: str = "seq", cell_rows: int = CELL_ROWS, source: DataFrame | None = None) -> DataFrame:
    """Append every feature in ``features`` over ``keys``; safe for keys of any size. ``seq`` is a unique bigint.

    ``source`` is a stored table of the same rows, if there is one: the sums are then read from it, and ``df`` once.
    """
    keys, columns = list(keys), df.columns
    by = _names(keys)
    sub = f"`{seq}` div {int(cell_rows)} as _sub"
    names = [f.name for f in features]
    known = (df if source is None else source).filter(" and ".join(f"`{k}` is not null" for k in keys))
    flags = {f.name: f"coalesce(cast(`{f.when}` as bigint), 0L)" if f.when else "1L" for f in features if isinstance(f, Count)}

    # One row per cell: how many rows of it each count takes in. Summed on the map side before the exchange.
    amounts = (known.selectExpr(*[f"`{c}`" for c in (*keys, ts)], sub, *[f"{flags.get(n, '0L')} as `_on_{n}`" for n in names])
               .groupBy(*keys, ts, "_sub").agg(*[F.sum(f"_on_{n}").alias(f"_on_{n}") for n in names])
               .selectExpr("*", *[f"`_on_{n}` as `_off_{n}`" for n in names]))

    # One row per key, value and second in which the value starts or stops being active.
    marks = []
    for value in dict.fromkeys(f.value for f in features if isinstance(f, Distinct)):
        own = {f.name: f.window for f in features if isinstance(f, Distinct) and f.value == value}
        chain = f"over (partition by {by}, `{value}` order by `{ts}`)"
        firsts = (known.filter(F.col(value).isNotNull()).groupBy(*dict.fromkeys([*keys, value, ts])).agg(F.min(seq).alias(seq))
                  .selectExpr("*", f"lag(`{ts}`) {chain} as _p", f"lead(`{ts}`) {chain} as _n"))
        ons = [f"cast({_starts(ts, '_p', own[n]) if n in own else 0} as bigint) as `_on_{n}`" for n in names]
        offs = [f"cast({_ends(ts, '_n', own[n]) if n in own else 0} as bigint) as `_off_{n}`" for n in names]
        marks.append(firsts.selectExpr(*[f"`{c}`" for c in (*keys, ts, seq)], sub, *ons, *offs))

    cells = amounts
    for mark in marks:
        cells = cells.unionByName(mark.drop(seq))
    cells = cells.groupBy(*keys, ts, "_sub").agg(
        *[F.sum(f"_{side}_{n}").alias(f"_{side}_{n}") for side in ("on", "off") for n in names])

    # State of each key when a cell begins: an ordered pass over its cells only.
    opening = [_active_minus_expired(by, ts, [ts, "_sub"], f"`_on_{f.name}`", f"`_off_{f.name}`", f.window) for f in features]
    state = cells.selectExpr(*[f"`{c}`" for c in (*keys, ts)], "_sub", "0 as _kind",
                             *[f"{sql} as `_add_{n}`" for sql, n in zip(opening, names)])
    live = " and ".join(f"`{k}` is not null" for k in keys)
    stream = df.selectExpr("*", sub, "1 as _kind", *[f"if({live}, {flags.get(n, '0L')}, 0L) as `_add_{n}`" for n in names])
    stream = stream.unionByName(state, allowMissingColumns=True)
    for mark in marks:
        entries = mark.selectExpr(*[f"`{c}`" for c in (*keys, ts, seq)], "_sub", "2 as _kind", *[f"`_on_{n}` as `_add_{n}`" for n in names])
        stream = stream.unionByName(entries, allowMissingColumns=True)

    # Within a cell: its opening state, then each row, then the values that this row made active.
    inside = (f"over (partition by {by}, `{ts}`, _sub order by _kind != 0, `{seq}`, _kind "
              "rows between unbounded preceding and 1 preceding)")
    out = stream.selectExpr("*", *[f"cast(coalesce(sum(`_add_{n}`) {inside}, 0) as int) as `{n}`" for n in names])
    return out.filter("_kind = 1").select(*columns, *names)


def rolling_count(df: DataFrame, keys: Sequence[str], window: int, name: str, when: str | None = None, **kw) -> DataFrame:
    return rolling(df, keys, [Count(name, window, when)], **kw)


def rolling_distinct(df: DataFrame, keys: Sequence[str], value: str, window: int, name: str, **kw) -> DataFrame:
    return rolling(df, keys, [Distinct(name, value, window)], **kw)


def previous_time(df: DataFrame, keys: Sequence[str], name: str, ts: str = "timestamp", seq: str = "seq",
                  source: DataFrame | None = None) -> DataFrame:
    """Append the time of the previous row with the same (valid) keys, or null. Safe for keys of any size; ``source`` as in
    :func:`rolling`.
    """
    keys = list(keys)
    seconds = ((df if source is None else source).filter(valid_key(*keys)).groupBy(*keys, ts).agg(F.min(seq).alias("_first"))
               .withColumn("_prev", F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))))
    out = df.join(seconds, [*keys, ts], "left")
    return out.select(*df.columns, F.when(F.col(seq) > F.col("_first"), F.col(ts)).otherwise(F.col("_prev")).alias(name))


def first_seen(df: DataFrame, keys: Sequence[str], name: str, **kw) -> DataFrame:
    """1 on the first row ever with these keys, all of them valid; else 0."""
    out = previous_time(df, keys, "_seen", **kw)
    return out.withColumn(name, (valid_key(*keys) & F.col("_seen").isNull()).cast("int")).drop("_seen")


def seconds_since_last(df: DataFrame, keys: Sequence[str], name: str, ts: str = "timestamp", **kw) -> DataFrame:
    """Seconds since the previous row with the same valid keys, however long ago; -1 if there is none."""
    out = previous_time(df, keys, "_seen", ts=ts, **kw)
    return out.withColumn(name, F.coalesce(F.col(ts) - F.col("_seen"), F.lit(MISSING_TIME_DELTA)).cast("bigint")).drop("_seen")


def flags_and_recencies(df: DataFrame, key: str, flags: Sequence[tuple[str, str]], recencies: Sequence[tuple[str, str | None]],
                        ts: str = "timestamp", **kw) -> DataFrame:
    """Append :func:`first_seen` flags and :func:`seconds_since_last` of one key, by the names and second columns given; what both
    ask of a pair is looked up once.
    """
    columns, before = df.columns, {}
    for other in dict.fromkeys(o for _, o in (*flags, *recencies)):
        before[other] = f"_before{len(before)}"
        df = previous_time(df, [key, other] if other else [key], before[other], ts=ts, **kw)
    made = {name: (valid_key(key, o) & F.col(before[o]).isNull()).cast("int") for name, o in flags}
    made |= {name: F.coalesce(F.col(ts) - F.col(before[o]), F.lit(MISSING_TIME_DELTA)).cast("bigint") for name, o in recencies}
    return df.select(*columns, *[c.alias(name) for name, c in made.items()])


def with_family(df: DataFrame, family: Family, ts: str = "timestamp", seq: str = "seq", within: str | None = None) -> DataFrame:
    """Append all features of ``family`` with one exchange on its key, or on its key and the column ``within``: then every row
    sees only rows with its own value there.

    Rows with a null key get the neutral value. They are spread over many partitions, so they cost no task more than its
    share.
    """
    more = [within] if within else []
    key, columns = family.key, df.columns
    live = f"`{key}` is not null"
    df = df.selectExpr(*[f"`{c}`" for c in columns], f"{live} as _live",
                       f"if({live}, 0, cast(pmod(xxhash64(`{seq}`), {SALTS}) + 1 as int)) as _salt").repartition(key, "_salt", *more)

    by = _names([key, "_salt", *more])
    others = dict.fromkeys(f.value for f in family.rolling if isinstance(f, Distinct))
    others.update(dict.fromkeys(o for _, o, _ in family.pair_counts))
    others.update(dict.fromkeys(o for _, o in (*family.first_seen, *family.recency) if o))
    # Everything that needs one sort order is computed together: first pair by pair, at last the key alone.
    place = {other: i for i, other in enumerate(others)}
    for other, i in place.items():
        pair = f"{by}, `{other}`"
        chain = f"over (partition by {pair} order by `{ts}`, `{seq}`)"
        valid = valid_key_sql(key, other)
        counted = f"cast(_live and {valid} as int)"
        counts = [f"cast({_active_minus_expired(pair, ts, [ts, seq], counted, counted, window)} as int) as `{name}`"
                  for name, o, window in family.pair_counts if o == other]
        df = df.selectExpr("*", f"lag(`{ts}`) {chain} as _prev{i}", f"lead(`{ts}`) {chain} as _next{i}", *counts)

    added = []
    for name, other in family.first_seen:
        added.append(f"cast(_live and {valid_key_sql(key, other)} and _prev{place[other]} is null as int) as `{name}`")
    for name, other in family.recency:
        if other:
            known, before = valid_key_sql(key, other), f"_prev{place[other]}"
        else:
            known, before = valid_key_sql(key), f"lag(`{ts}`) over (partition by {by} order by `{ts}`, `{seq}`)"
        added.append(f"coalesce(if(_live and {known}, `{ts}` - {before}, null), {MISSING_TIME_DELTA}) as `{name}`")
    for f in family.rolling:
        if isinstance(f, Count):
            on = off = f"if(_live, {f'coalesce(cast(`{f.when}` as int), 0)' if f.when else '1'}, 0)"
        else:
            i, present = place[f.value], f"cast(_live and `{f.value}` is not null as int)"
            on, off = f"{present} * {_starts(ts, f'_prev{i}', f.window)}", f"{present} * {_ends(ts, f'_next{i}', f.window)}"
        added.append(f"cast({_active_minus_expired(by, ts, [ts, seq], on, off, f.window)} as int) as `{f.name}`")
    return df.selectExpr(*[f"`{c}`" for c in columns], *[f"`{p[0]}`" for p in family.pair_counts], *added)


def rolling_in_buckets(df: DataFrame, family: Family, bucket: int, ts: str = "timestamp", seq: str = "seq") -> DataFrame:
    """Append the rolling features and pair counts of ``family`` (not its flags and recencies, whose history has no end).

    A row goes to the bucket of its time, ``floor(ts / bucket)``, and as a halo to every later one up to that of ``ts + W``, ``W``
    being the longest window. Whatever a row can see is then in its bucket, and both running sums may start there. With buckets of two
    windows, half of the rows have one copy; copies carry only the columns that the windows read. Rows without a key or a time
    are not copied; without a time they see nothing.
    """
    bounded = Family(family.key, family.rolling, family.pair_counts)
    if not bounded.names():
        return df
    columns = df.columns
    longest = max([f.window for f in family.rolling] + [p[2] for p in family.pair_counts])
    read = {family.key, ts, seq, *(f.value for f in family.rolling if isinstance(f, Distinct)), *(p[1] for p in family.pair_counts),
            *(f.when for f in family.rolling if isinstance(f, Count) and f.when)}
    own, last = (f"floor((`{ts}` + {w}) / {int(bucket)})" for w in (0, longest))
    copied = df.selectExpr("*", f"explode_outer(sequence({own}, if(`{family.key}` is null, {own}, {last}))) as _bucket")
    marked = copied.selectExpr("*", f"coalesce(_bucket != {own}, false) as _halo")
    lean = marked.selectExpr(*[f"`{c}`" if c in read else f"if(_halo, null, `{c}`) as `{c}`" for c in columns], "_bucket", "_halo")
    return with_family(lean, bounded, ts, seq, within="_bucket").where("not _halo").select(*columns, *bounded.names())
