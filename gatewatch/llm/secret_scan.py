"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests cannot tell from random ones.

A candidate is a string of at least ``SHORTEST`` characters of a transfer alphabet that holds a letter and a digit. Its encoding
is the smallest alphabet with all its characters. Under the null hypothesis that they were drawn evenly from it, three tests give
a two-sided p-value each: chi-squared of the character counts (a string may also be *too* even), the number of runs in the lower
and upper half of the alphabet, and the serial correlation of neighbouring characters' places. Fisher's method combines them.

For random strings the combined p-values are even between 0 and 1, for others they crowd near 0; how far they reach up depends
on the length. So the share of random strings is estimated per encoding and length class, from the distinct strings of the
whole table, as the least density that the upper four fifths show; a class accepts strings from the lowest p-value on
at which the estimated share of others among the accepted ones is at most ``rate``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.llm.staging import staged
from gatewatch.llm.words import LOWER, rows_of

# The patterns, and the least lengths of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex", "random")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

DIGITS, UPPER, SMALL = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Smallest first; each in the order of its standard, so that neighbouring places mean neighbouring values.
ALPHABETS = (DIGITS + SMALL[:6], DIGITS + UPPER[:6], UPPER + "234567", SMALL + "234567", DIGITS + UPPER, DIGITS + SMALL, UPPER + SMALL + DIGITS,
             UPPER + SMALL + DIGITS + "+/", UPPER + SMALL + DIGITS + "-_")
SHORTEST = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
LENGTH_CLASSES = 24  # two per doubling, the last one open
BINS = 20
PRIOR = 20.0  # strings that every class is taken to have shown before, half of them random

_SETS = tuple(frozenset(a) for a in ALPHABETS)
_PLACES = tuple(np.array([a.find(chr(c)) for c in range(128)], np.int64) for a in ALPHABETS)


def encoding_of(body: str) -> int | None:
    """The first of the alphabets that has all characters; none without a letter or without a digit."""
    used = set(body)
    if used.isdisjoint(DIGITS) or used.issubset(DIGITS + "+/-_"):
        return None
    return next((i for i, a in enumerate(_SETS) if used <= a), None)


def randomness(body: str, encoding: int) -> tuple[float, float, float]:
    """Two-sided p-values of evenness, of runs about the alphabet's middle, and of serial correlation."""
    size, n = len(ALPHABETS[encoding]), len(body)
    codes = _PLACES[encoding][np.frombuffer(body.encode("ascii"), np.uint8)]
    tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
    # Mean and variance of the statistic for n draws are size - 1 and 2 (size - 1) (n - 1) / n; a scaled chi-squared has the same.
    counts = np.bincount(codes, minlength=size)
    freedom = (size - 1) * n / (n - 1)
    ratio = (float((counts * counts).sum()) * size / n - n) * n / (n - 1) / freedom
    spread = 2 / (9 * freedom)
    even = tail((ratio ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    upper = codes >= size // 2
    changes = int((upper[1:] != upper[:-1]).sum())
    runs = tail((changes - (n - 1) / 2) / (math.sqrt(n - 1) / 2))
    off = codes - (size - 1) / 2
    serial = tail(float((off[1:] * off[:-1]).sum()) / ((size * size - 1) / 12 * math.sqrt(n - 1)))
    return even, runs, serial


def combined(values: tuple[float, ...]) -> float:
    """Fisher's combination of independent p-values."""
    x = -sum(math.log(max(v, 1e-300)) for v in values)
    return math.exp(-x) * sum(x**i / math.factorial(i) for i in range(len(values)))


def stratum_of(encoding: int, length: int) -> int:
    return encoding * LENGTH_CLASSES + min(LENGTH_CLASSES - 1, int(2 * math.log2(length)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and end of all pattern matches, in code points, by start and then kind."""
    found = []
    low = text.encode("utf-8", "replace").translate(LOWER)
    if any(w in low for w in ASSIGN_WORDS):
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LENGTH]
    found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Candidate strings with their class, the bin of their combined p-value, a hash, and whether a span of a pattern meets them."""
    out, ends = [], sorted((s, e) for _, s, e in spans)
    starts = np.array([s for s, _ in ends], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in ends], np.int64)) if ends else starts
    for m in CANDIDATE.finditer(text):
        body = m.group().rstrip("=")
        encoding = encoding_of(body)
        if encoding is None:
            continue
        before = int(np.searchsorted(starts, m.end()))  # spans that start before the candidate's end
        bin_ = min(BINS - 1, int(combined(randomness(body, encoding)) * BINS))
        out.append({"start": m.start(), "end": m.end(), "stratum": stratum_of(encoding, len(body)), "bin": bin_,
                    "token": xxhash.xxh3_64_intdigest(body.encode()) - (1 << 63), "met": before > 0 and int(reach[before - 1]) > m.start()})
    return out


def lowest_bins(counts: np.ndarray, rate: float) -> np.ndarray:
    """Per class, from a row of counts by bin of the p-value, the bin from which on strings are accepted; ``BINS`` for none.

    The density of random strings is the least of the four means over bins 4 to 19, each raised by one and a half standard
    errors, so that chance alone does not push it down. The first bin is never accepted.
    """
    seen = counts + PRIOR / 2 / BINS
    seen[:, 0] += PRIOR / 2
    blocks = seen[:, 4:].reshape(len(seen), 4, -1)
    density = ((blocks.sum(2) + 1.5 * np.sqrt(blocks.sum(2))) / blocks.shape[2]).min(1)
    accepted = np.cumsum(seen[:, ::-1], axis=1)[:, ::-1]
    random_ones = density[:, None] * (BINS - np.arange(BINS))
    fine = 1 - random_ones / accepted <= rate
    fine[:, 0] = False
    return np.where(fine.any(1), fine.argmax(1), BINS)


def scan_secrets(docs: DataFrame, text_col: str = "text", rate: float = 0.1, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``spans``, an array of kind, start and end (code points, end exclusive) by start and then kind.

    Kinds are ``assign`` (a value given to a password, secret, token or key), ``access`` (access keys), ``hex`` and, where no
    span of those meets it, ``random`` (strings that pass the battery). A null text counts as empty and has no spans. Random
    strings are judged by class from the distinct candidates of the whole table, so a row's repetition changes nothing; a class
    that the table hardly shows is judged by the prior. Repeated rows are returned as often as they occur; an empty table
    gives no rows. A column named ``spans`` is replaced; others are kept unless ``drop`` names them.

    Texts are read once; their spans and candidates are staged. Only the counts by class and bin, a fixed number, meet on the driver.
    """
    kept = [c for c in docs.columns if c != "spans" and c != text_col and c not in drop]
    if text_col != "spans" and text_col not in drop:
        kept.append(text_col)
    carried = [f"_c{i}" for i in range(len(kept))]
    span = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    guess = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("stratum", T.IntegerType()),
                          T.StructField("bin", T.IntegerType()), T.StructField("token", T.LongType()), T.StructField("met", T.BooleanType())])
    schema = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for n, c in zip(carried, kept)),
                           T.StructField("_spans", T.ArrayType(span)), T.StructField("_guesses", T.ArrayType(guess))])
    rows = docs.select(*[docs[c].alias(n) for n, c in zip(carried, kept)], docs[text_col].alias("_text"))
    arrow = [pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32()), ("token", pa.int64()), ("met", pa.bool_())]))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, guesses = [], []
            for row in rows_of([batch.select(["_text"])]):
                text = row["_text"] or ""
                found = base_spans(text)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
                guesses.append(candidates(text, found))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(spans, arrow[0]), pa.array(guesses, arrow[1])], names=schema.names)

    found = staged(rows.mapInArrow(scan, schema), "secret-spans")
    strings = found.select(F.explode("_guesses").alias("g")).select("g.stratum", "g.bin", "g.token").distinct()
    counts = np.zeros((len(ALPHABETS) * LENGTH_CLASSES, BINS))
    for r in strings.groupBy("stratum", "bin").count().collect():  # at most one row a class and bin
        counts[r["stratum"], r["bin"]] = r["count"]
    lowest = F.lit([int(b) for b in lowest_bins(counts, rate)])
    passed = F.filter("_guesses", lambda g: ~g["met"] & (g["bin"] >= lowest[g["stratum"]]))
    random_ones = F.transform(passed, lambda g: F.struct(F.lit(KINDS.index("random")).alias("kind"), g["start"].alias("start"), g["end"].alias("end")))
    order = F.transform(F.concat("_spans", random_ones), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    named: Column = F.transform(F.sort_array(order), lambda s: F.struct(F.lit(list(KINDS))[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(*[F.col(n).alias(c) for n, c in zip(carried, kept)], named.alias("spans"))
