"""Periodic runs of words: seeds on diagonals, extended once per stretch.

A run is a stretch with smallest period q, of at least ``min_length`` words and two periods, that no neighbouring word extends.
Words q apart agree on all of it but its last q words, at least ``max(min_length - q, q)`` in a row: that is the guaranteed
overlap. It is never under ``min_length / 2``, and it grows with q. So lags are treated in classes, each twice as long as the last:

* Seeds are grams of half the overlap that the class guarantees, so every stretch holds one that starts at a multiple of its
  length. Grams of a class are numbered from pairs of the grams of the class before (no hash), by text, and only those that
  occur again in their own text are kept: for ordinary prose hardly any after the first classes.
* Seeds at such places are paired with the occurrences of the same gram in the same text at a lag of the class. There are at
  most two pairs a word and class, however often a gram occurs.
* A table holds how far each lag is covered. A pair that starts where its lag's cover ends moves the cover on; only the two
  ends of a covered stretch are extended, by less than a gram, in steps of the smaller grams.

The work on a text of n words is of the order n log(n) also where all its words are the same. Texts are worked through many at
a time, in blocks of bounded bytes; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20
PAIRS_AT_ONCE = 1 << 20


class _Numbers(dict):
    """Words to numbers, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


class _Grams:
    """The places of the grams of one length that occur again in their own text, in order, and the number of each gram."""

    def __init__(self, size: int, places: np.ndarray, keys: np.ndarray):
        _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts > 1
        held = again[which]
        self.size, self.places, self.ids = size, places[held], (np.cumsum(again) - 1)[which[held]]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers of the grams at ``places``; -1 for those that occur once."""
        if not len(self.places):
            return np.full(len(places), -1)
        i = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return np.where(self.places[i] == places, self.ids[i], -1)

    def followed_by(self, other: _Grams) -> _Grams:
        ids = other.at(self.places + self.size)
        known = ids >= 0
        top = int(other.ids.max()) + 1 if len(other.ids) else 1
        return _Grams(self.size + other.size, self.places[known], self.ids[known] * top + ids[known])


def _pairs(grams: _Grams, low: int, high: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Places at multiples of the gram's length and the lags, ``low`` to ``high``, at which the gram occurs again; a bounded
    number at once. With each portion, the place at which the next one starts.
    """
    order = np.lexsort((grams.places, grams.ids))
    keys = grams.ids[order] * (end + 1) + grams.places[order]
    seeds = grams.places % grams.size == 0
    places, base = grams.places[seeds], grams.ids[seeds] * (end + 1)
    first = np.searchsorted(keys, base + np.minimum(places + low, end))
    counts = np.searchsorted(keys, base + np.minimum(places + high, end), side="right") - first
    sums, i = np.cumsum(counts), 0
    while i < len(places):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
        n = counts[i:j]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left = np.repeat(places[i:j], n)
        yield left, grams.places[order][np.repeat(first[i:j], n) + inside] - left, int(places[j]) if j < len(places) else -1
        i = j


def _covered(grams: _Grams, low: int, high: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lag, first place and end of the stretches that neighbouring seeds of one lag cover, each once."""
    table = tuple(np.zeros(0, np.int64) for _ in range(3))
    for left, lag, following in _pairs(grams, low, high, end):
        lags, starts, ends = (np.concatenate(x) for x in zip(table, (lag, left, left + grams.size)))
        order = np.lexsort((starts, lags))
        lags, starts, ends = lags[order], starts[order], ends[order]
        new = np.ones(len(lags), bool)
        new[1:] = (lags[1:] != lags[:-1]) | (starts[1:] != ends[:-1])
        heads = np.flatnonzero(new)
        lags, starts, ends = lags[heads], starts[heads], ends[np.append(heads[1:], len(ends)) - 1] if len(heads) else ends
        open_ = ends == following  # the next portion may go on from here
        table = lags[open_], starts[open_], ends[open_]
        yield lags[~open_], starts[~open_], ends[~open_]
    yield table


def _extended(ladder: list[_Grams], words: np.ndarray, steps: list[int], lags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both ends moved outwards as far as words a lag apart agree: by less than the seed, in ever smaller grams."""
    starts, ends, last = starts.copy(), ends.copy(), len(words) - 1
    for k in steps:
        if k < 0:
            ahead = np.flatnonzero(ends + lags <= last)
            ends[ahead] += words[ends[ahead]] == words[ends[ahead] + lags[ahead]]
            back = np.flatnonzero(starts > 0)
            starts[back] -= words[starts[back] - 1] == words[starts[back] - 1 + lags[back]]
        else:
            size, one = ladder[k].size, ladder[k].at(ends)
            ends += size * ((one >= 0) & (one == ladder[k].at(ends + lags)))
            one = ladder[k].at(starts - size)
            starts -= size * ((one >= 0) & (one == ladder[k].at(starts - size + lags)))
    return starts, ends


def runs_of(words: np.ndarray, texts: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, by start and period, in ``words``: the numbered words of many texts, each
    text ended by a number that occurs nowhere else. ``texts`` tells each word's text.
    """
    least = max(1, (min_length + 1) // 2)
    size = max(1, (least + 1) // 2)
    top = int(words.max()) + 1 if len(words) else 1
    single = _Grams(1, np.arange(len(words)), texts * top + words)
    grams = single
    for _ in range(size - 1):
        grams = grams.followed_by(single)
    ladder, steps, low, found = [], [-1] * (size - 1), 1, []
    while len(grams.places):
        for lags, starts, ends in _covered(grams, low, 4 * grams.size - 1, len(words)):
            starts, ends = _extended(ladder, words, steps, lags, starts, ends)
            length = ends + lags - starts
            enough = length >= np.maximum(min_length, 2 * lags)
            found.append((starts[enough], length[enough], lags[enough]))
        low = 4 * grams.size
        steps = [len(ladder), *steps]
        ladder.append(grams)
        grams = grams.followed_by(grams)
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    starts, length, lags = (np.concatenate(x) for x in zip(*found))
    # The same stretch is found again at the multiples of its period, and only there.
    order = np.lexsort((lags, length, starts))
    starts, length, lags = starts[order], length[order], lags[order]
    own = np.ones(len(starts), bool)
    own[1:] = (starts[1:] != starts[:-1]) | (length[1:] != length[:-1])
    starts, length, lags = starts[own], length[own], lags[own]
    order = np.lexsort((lags, starts))
    return starts[order], length[order], lags[order]


def _block(texts: list[bytes | None], min_length: int) -> tuple[list[int], pa.Array, list[bytes]]:
    """Number of words, runs and collapsed text of each text."""
    split = [t.split() if t else [] for t in texts]
    numbers, sizes = _Numbers(), np.array([len(s) for s in split], np.int64)
    firsts = np.cumsum(sizes + 1) - sizes - 1
    words = np.full(int((sizes + 1).sum()), -1, np.int64)
    for first, found in zip(firsts.tolist(), split):
        words[first : first + len(found)] = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
    words[firsts + sizes] = len(numbers) + np.arange(len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    starts, length, period = runs_of(words, owner, min_length)
    of = owner[starts]
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts + period, 1)
    np.add.at(change, starts + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    touched = set(of.tolist())
    collapsed = [b" ".join(compress(s, kept[f : f + n].tolist()) if i in touched else s) for i, (s, f, n) in enumerate(zip(split, firsts.tolist(), sizes.tolist()))]
    places = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts - firsts[of], length, period)], ["start", "length", "period"])
    offsets = np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))).astype(np.int32)
    return sizes.tolist(), pa.ListArray.from_arrays(pa.array(offsets), places), collapsed


def periodic_runs(docs: DataFrame, text_col: str = "text", min_length: int = 12, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_words``, all ``runs`` of each whole text (start, length and smallest period in words, by start and then
    period) and the ``collapsed`` text: its words joined by single spaces, without those that any run contains after its first
    period.

    Words are runs of characters other than 0x20 and 0x09 to 0x0D, compared as they are. A null, empty or blank text has no words, no
    runs and an empty collapsed text. Runs may overlap; equal stretches are one run. Repeated rows are returned as often as they
    occur, an empty table gives no rows. Columns named like a result are replaced; others are kept unless ``drop`` names them.
    Each row is worked on by itself, nothing is shuffled.
    """
    made = [T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))),
            T.StructField("collapsed", T.StringType())]
    names = {f.name for f in made}
    kept = [c for c in docs.columns if c not in names and c != text_col and c not in drop]
    if text_col not in names and text_col not in drop:
        kept.append(text_col)
    schema = T.StructType([*(docs.schema[c] for c in kept), *made])
    rows = docs.select(*[docs[c] for c in kept], docs[text_col].alias("_text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(len(kept)).cast(pa.binary())
            sums, i = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while i < whole.num_rows:
                j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + BLOCK_BYTES, side="right")))
                n_words, runs, collapsed = _block(texts.slice(i, j - i).to_pylist(), min_length)
                part = whole.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(n_words, pa.int64()), runs,
                                                  pa.array(collapsed, pa.binary()).cast(pa.string())], names=schema.names)
                i = j

    return rows.mapInArrow(find, schema)
