"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The normaliser, the pieces and the byte fallback are compiled into one machine over characters. Composed with an input it is
a lattice: states are places in the normalised text together with the last piece, arcs are pieces (or the bytes of a
character that no piece covers). In the tropical semiring a path costs the sum of its arcs. A model of merges rules out two
pieces side by side that its merges would have cut otherwise; such an arc costs infinity, any other nothing, and the
cheapest path is then the one segmentation that the merges yield. A unigram model's arcs cost minus the piece's score.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
CACHED_BYTES = 16 << 20  # of either generation of remembered units, in each Python worker
BLOCK_BYTES = 1 << 20  # texts encoded at once
CACHED_PAIRS = 100_000  # of pieces, which are short
KEPT_IDS = 64  # units with more are not remembered, so that any text fits

# Fixed values of the public model format: field numbers, piece types, model types.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
MODEL_TYPE = 3
CHARS_MAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protobuf message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        elif kind == 2:
            size, i = number(i)
            value, i = data[i : i + size], i + size
        else:
            size = 4 if kind == 5 else 8
            value, i = struct.unpack("<f" if kind == 5 else "<d", data[i : i + size])[0], i + size
        yield key >> 3, value


class Memory:
    """Ids of units by the hash that Python gives a string in this process, in flat arrays: some 26 bytes a unit."""

    def __init__(self) -> None:
        self.keys, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.sizes, self.ids = np.zeros(0, np.int16), np.zeros(0, np.int32)

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.starts, self.sizes, self.ids))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Units with new keys, in ascending order."""
        at = np.searchsorted(self.keys, keys)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.keys, self.starts = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts)
        self.sizes, self.ids = np.insert(self.sizes, at, sizes), np.append(self.ids, ids)


def _slices(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat``, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class PieceTransducer:
    """The compiled machine of one model file. ``encode`` and ``decode`` are exact inverses on texts without U+2581."""

    def __init__(self, model: bytes):
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes_out: list[bytes] = []
        self.byte_ids = [0] * 256
        self.unknown = 0
        kind, normal = UNIGRAM, {DUMMY_PREFIX: 1, REMOVE_EXTRA: 1, ESCAPE: 1, CHARS_MAP: b""}
        for field, value in _fields(model):
            if field == PIECES:
                self._add(dict(_fields(value)))
            elif field == TRAINER:
                kind = dict(_fields(value)).get(MODEL_TYPE, UNIGRAM)
            elif field == NORMALIZER:
                normal |= dict(_fields(value))
        if kind not in (UNIGRAM, BPE) or normal[CHARS_MAP] or not normal[ESCAPE]:
            raise ValueError("only unigram and BPE models with an identity character map are supported")
        self.merges, self.prefix, self.squeeze = kind == BPE, bool(normal[DUMMY_PREFIX]), bool(normal[REMOVE_EXTRA])
        self.characters = {p for p in self.ids if len(p) == 1}
        self.arcs = ahocorasick.Automaton()
        for text in self.ids:
            self.arcs.add_word(text, text)
        self.arcs.make_automaton()
        self.has_bytes = any(self.byte_ids)
        # A character that is inside no longer piece, or a space that only ever opens one, cuts a text into units that cannot affect each other.
        inner = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in inner)
        cut = f"[{re.escape(self.alone)}]|" if self.alone else ""
        words = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.units = None if words else re.compile(f"{cut}{SPACE}*[^{SPACE}{re.escape(self.alone)}]+|{SPACE}+")
        self.newer, self.older = Memory(), Memory()
        self.grown: dict[str, tuple | None] = {}
        self.beside: dict[tuple[str, str], bool] = {}

    def _add(self, piece: dict) -> None:
        text, kind, at = piece[PIECE].decode(), piece.get(TYPE, NORMAL), len(self.bytes_out)
        out = text.replace(SPACE, " ").encode()
        if kind == BYTE:
            self.byte_ids[int(text[3:5], 16)] = at
            out = bytes([int(text[3:5], 16)])
        elif kind == UNKNOWN:
            self.unknown, out = at, " ⁇ ".encode()
        elif kind == CONTROL:
            out = b""
        elif kind in (NORMAL, USER_DEFINED):
            self.ids[text], self.scores[text] = at, piece.get(SCORE, 0.0)
        self.bytes_out.append(out)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging the best-scored neighbours, leftmost first, ends with."""
        parts, none = list(text), -np.inf
        score = lambda i: self.scores.get(parts[i] + parts[i + 1], none)
        pairs = list(map(score, range(len(parts) - 1)))
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(i)
            if i:
                pairs[i - 1] = score(i - 1)
        return parts

    def growth(self, piece: str) -> tuple[tuple, tuple, bool] | None:
        """How merging builds a piece: its last parts from the last character up to all of it, its first parts likewise, each with
        the score of the merge that made it, and whether merges came in order of their scores. None if merging does not end with it.
        """
        if piece in self.grown:
            return self.grown[piece]
        parts, scores, none = list(piece), [], -np.inf
        last, first = [(parts[-1], np.inf)], [(parts[0], np.inf)]
        score = lambda i: self.scores.get(parts[i] + parts[i + 1], none)
        while len(parts) > 1 and (best := max(range(len(parts) - 1), key=score)) is not None and score(best) > none:
            scores.append(score(best))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if best == len(parts) - 1:
                last.append((parts[-1], scores[-1]))
            if best == 0:
                first.append((parts[0], scores[-1]))
        ordered = all(a >= b for a, b in zip(scores, scores[1:]))
        found = self.grown[piece] = (tuple(last), tuple(first), ordered) if len(parts) == 1 else None
        return found

    def hold(self, left: str, right: str) -> bool:
        """As :meth:`holds`, and remembered."""
        if len(self.beside) >= CACHED_PAIRS:
            self.beside.clear()
        fits = self.beside[left, right] = self.holds(left, right)
        return fits

    def holds(self, left: str, right: str) -> bool:
        """Whether two pieces can stand side by side: at no time does a merge across their border come before the next ones inside.

        Merges come by score, the leftmost first among equals, so it is enough to follow the two parts at the border as they grow.
        """
        one, two = self.growth(left), self.growth(right)
        if one is None or two is None:
            return False
        if not (one[2] and two[2]):
            return self.merged(left + right) == [left, right]
        lasts, firsts, scores = one[0], two[1], self.scores
        i = j = 0
        while True:
            next_left = lasts[i + 1][1] if i + 1 < len(lasts) else -np.inf
            next_right = firsts[j + 1][1] if j + 1 < len(firsts) else -np.inf
            across = scores.get(lasts[i][0] + firsts[j][0])
            if across is not None and across > next_left and across >= next_right:
                return False
            if next_left == next_right == -np.inf:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def shortest(self, unit: str) -> list[str]:
        """Arcs of the cheapest path through the lattice of a unit all of whose characters are pieces. The automaton names the
        arcs that end at each place, longest first.

        With merges, arcs cost nothing or are ruled out by the piece that follows, and one path is left: it is sought from the
        end, longest arcs first, and no arc is gone through twice. Otherwise the least sum of costs is taken place by place.
        """
        if not self.merges:
            last, costs = [""] * (len(unit) + 1), [0.0] + [np.inf] * len(unit)
            for end, piece in self.arcs.iter(unit):
                cost = costs[end + 1 - len(piece)] - self.scores[piece]
                if cost < costs[end + 1]:
                    last[end + 1], costs[end + 1] = piece, cost
            path, j = [], len(unit)
            while j:
                path.append(last[j])
                j -= len(path[-1])
            return path[::-1]
        ends: list[list[str]] = [[] for _ in range(len(unit) + 1)]
        for end, piece in self.arcs.iter(unit):
            ends[end + 1].append(piece)
        beside, tried = self.beside, set()
        front = [(p, len(unit), None) for p in reversed(ends[-1])]
        while True:
            piece, end, after = front.pop()
            if (piece, end) in tried:
                continue
            if after:
                fits = beside.get((piece, after[0]))
                if not (fits if fits is not None else self.hold(piece, after[0])):
                    continue
            tried.add((piece, end))
            after, start = (piece, after), end - len(piece)
            if not start:
                break
            front += [(p, start, after) for p in reversed(ends[start])]
        path = []
        while after:
            path.append(after[0])
            after = after[1]
        return path

    def _unit(self, unit: str) -> list[int]:
        if self.characters.issuperset(unit):
            out = [self.ids[p] for p in self.shortest(unit)]
        else:
            out = []
            for covered, group in groupby(unit, self.characters.__contains__):
                part = "".join(group)
                if covered:
                    out += [self.ids[p] for p in self.shortest(part)]
                else:
                    out += [self.byte_ids[b] for b in part.encode("utf-8", "replace")] if self.has_bytes else [self.unknown]
        return out

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and their number for each text.

        Units are remembered in two generations: when the newer is full, it takes the place of the older, so that units in use
        since then stay.
        """
        units, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            whole = self.normalise(text or "")
            found = self.units.findall(whole) if self.units else [whole] if whole else []
            counts[i] = len(found)
            units += found
        keys, first, which = np.unique(np.fromiter(map(hash, units), np.int64, len(units)), return_index=True, return_inverse=True)
        old, new = self.older.find(keys), self.newer.find(keys)
        missing = np.flatnonzero((old < 0) & (new < 0))
        made = [self._unit(units[i]) for i in first[missing].tolist()]
        # One flat array of this block's own units, in the order of their keys.
        sizes = np.zeros(len(keys), np.int64)
        sizes[missing] = [len(x) for x in made]
        for memory, at in ((self.older, old), (self.newer, new)):
            sizes[at >= 0] = memory.sizes[at[at >= 0]]
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        place = lambda rows: _slices(np.arange(len(flat)), starts[rows], sizes[rows])
        flat[place(missing)] = np.fromiter((i for x in made for i in x), np.int32, int(sizes[missing].sum()))
        for memory, at in ((self.older, old), (self.newer, new)):
            rows = np.flatnonzero(at >= 0)
            flat[place(rows)] = _slices(memory.ids, memory.starts[at[rows]].astype(np.int64), sizes[rows])
        fresh = np.flatnonzero((new < 0) & (sizes <= KEPT_IDS))
        self.newer.add(keys[fresh], sizes[fresh], flat[place(fresh)])
        if self.newer.bytes > CACHED_BYTES:
            self.older, self.newer = self.newer, Memory()
        lengths = sizes[which]
        ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        return _slices(flat, starts[which], lengths), np.diff(ends)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.bytes_out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


@lru_cache(1)
def compiled(model: bytes) -> PieceTransducer:
    """One machine per Python worker, with what it has seen so far."""
    return PieceTransducer(model)


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the ids of every whole text, their number ``n_ids``, the number of them that are byte fallbacks
    ``n_bytes``, and ``round_trip``: whether decoding the ids gives the text again.

    A null or empty text has no ids and a true ``round_trip``. A text with U+2581, which the format reads as a space, does not
    come back. Columns named like a result are replaced; others are kept unless ``drop`` names them. Every row is one
    document; nothing is shuffled. The model file is read once by the driver and goes to the tasks with the function.
    """
    with open(model_path, "rb") as file:
        model = file.read()
    kept = [c for c in docs.columns if c not in (ids_col, "n_ids", "n_bytes", "round_trip")]
    at, keep = kept.index(text_col), [i for i, c in enumerate(kept) if c not in drop]
    made = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.IntegerType()), T.StructField("n_bytes", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([*(docs.schema[kept[i]] for i in keep), *made])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        is_byte = np.zeros(len(machine.bytes_out), bool)
        is_byte[machine.byte_ids] = machine.has_bytes
        for whole in batches:
            sums, i = np.cumsum(pc.fill_null(pc.binary_length(whole.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while i < whole.num_rows:
                j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + BLOCK_BYTES, side="right")))
                batch, i = whole.slice(i, j - i), j
                texts = batch.column(at).to_pylist()
                flat, sizes = machine.encode_all(texts)
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                back = [machine.decode(flat[a:b]) == (t or "") for a, b, t in zip(offsets, offsets[1:], texts)]
                n_bytes = np.diff(np.append(0, np.cumsum(is_byte[flat]))[offsets])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32())),
                                                  pa.array(sizes, pa.int32()), pa.array(n_bytes, pa.int32()), pa.array(back, pa.bool_())], names=schema.names)

    return docs.select(*kept).mapInArrow(encode, schema)


def decode_pieces(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of its id lists; null lists and null ids in them count as empty."""
    with open(model_path, "rb") as file:
        model = file.read()
    kept = [c for c in docs.columns if c != text_col]
    at, schema = kept.index(ids_col), T.StructType([*(docs.schema[c] for c in kept), T.StructField(text_col, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            texts = [machine.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return docs.select(*kept).mapInArrow(decode, schema)
