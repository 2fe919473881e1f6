"""Words and hashes inside Python tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CACHED_WORDS = 300_000
CACHED_BYTES = 64  # longer words are rare and could be of any size: their hashes are not remembered


def lower_words(text: str | None) -> list[bytes]:
    """The runs of bytes outside 0x20 and 0x09 to 0x0D, with A-Z lowered; none for a null text."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, the same in every process; the memory of them is bounded."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """One 64-bit hash of two, by multiply and xor-shift; the order counts."""
    with np.errstate(over="ignore"):
        x = (a ^ np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x = (x + b) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(31))


def planes(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes as the largest needs, lowest bytes first, then the next: small numbers compress well."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + np.ascontiguousarray(values.astype(f"u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T).reshape(-1).view(f"u{width}")


def rows_of(batches):
    """The rows of Arrow batches as dicts, one at a time, so that one large row is held at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
        pa.default_memory_pool().release_unused()


def groups_of(batches, key: str):
    """Tables of consecutive rows with an equal integer ``key``, whatever batches they came in."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        keys = now[key].to_numpy()
        starts = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1)
        now = now.combine_chunks()
        for i, j in zip(starts, starts[1:]):
            yield now.slice(i, j - i)
        rest = now.slice(starts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def joined_up(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric yes/no matrix, the first row it is connected with, itself included."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            label[i], front = i, [i]
            while front:
                new = np.flatnonzero(linked[front].any(0) & (label < 0))
                label[new], front = i, new.tolist()
    return label
