"""Deleted interpolation: n-gram shares mixed by context frequency, with weights fitted on deleted counts.

Documents are packed into blocks of under a million tokens. One order after the other, a block sends each of its distinct
n-grams once, as one packed row per range of hashes that it has n-grams in; a range adds up what all blocks sent and answers
each block. A frequent n-gram is therefore as many numbers as there are blocks, and no row per token is ever shuffled. An
n-gram that holds a shorter one found once in all texts occurs once itself: its block knows its count and sends nothing.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewatch.llm.staging import bucketed, discard, shuffles_removed, staged
from gatewatch.llm.words import WordHashes, lower_words, mix, planes, rows_of, unplanes

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
OTHER, LEARN, DELETED = 0, 1, 2
CONTEXT_BUCKETS = 40  # by powers of two of the context's count

_BLOCKS = "block long, docs array<long>, lengths array<int>, roles array<int>, vocab binary, words binary, learn_tokens long, tokens long"
_GRAMS = "bucket long, block long, low long, hashes binary, total binary, deleted binary, other binary"
_SUMS = "order int, block long, low long, total binary, deleted binary, alone binary, distinct long"
_COUNTS = "docs array<long>, lengths array<int>, roles array<int>, counts array<binary>, deleted array<binary>"
_HELD = "mixed binary"
_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _pack(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    hashes, part, made = WordHashes(), TaskContext.get().partitionId(), 0
    docs, lengths, roles, found, size = [], [], [], [], 0
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("roles", pa.list_(pa.int32())),
                        ("vocab", pa.binary()), ("words", pa.binary()), ("learn_tokens", pa.int64()), ("tokens", pa.int64())])

    def block():
        vocab, words = np.unique(np.concatenate(found), return_inverse=True)
        row = [(part << 24) + made, docs, lengths, roles, vocab.tobytes(), planes(words), sum(n for n, r in zip(lengths, roles) if r), size]
        return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, schema)], schema=schema)

    for batch in batches:
        for doc, text, role in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            tokens = np.append(hashes.of(lower_words(text.as_py())), END)
            docs.append(doc)
            lengths.append(len(tokens))
            roles.append(role)
            found.append(tokens)
            size += len(tokens)
            if size >= block_tokens:
                yield block()
                made += 1
                docs, lengths, roles, found, size = [], [], [], [], 0
    if found:
        yield block()


def _grams(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order, the hash of the n-gram that ends at each token; what lies before a document is START."""
    first = np.cumsum(lengths) - lengths
    out, opening = [mix(tokens, tokens, 1)], START
    for k in range(2, order + 1):
        before = np.empty_like(tokens)
        before[1:] = out[-1][:-1]
        before[first] = opening
        out.append(mix(before, tokens, k))
        opening = mix(np.array([opening], np.uint64), np.array([START], np.uint64), k)[0]
    return out


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's token hashes, the lengths of its documents, and each token's role."""
    lengths = np.array(row["lengths"], np.int64)
    return np.frombuffer(row["vocab"], np.uint64)[unplanes(row["words"])], lengths, np.repeat(np.array(row["roles"]), lengths)


def _answered(grams: np.ndarray, asked: np.ndarray, role: np.ndarray, answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token's n-gram its count in learned texts, in deleted ones, and whether it occurs once in all texts."""
    total, deleted, alone = (role != OTHER).astype(np.uint64), (role == DELETED).astype(np.uint64), np.ones(len(grams), bool)
    if asked.any():
        own = sorted(answers, key=lambda r: r["low"] % 2**64)
        at = np.unique(grams[asked], return_inverse=True)[1]
        totals = [unplanes(r["total"]) for r in own]
        total[asked] = np.concatenate(totals)[at]
        deleted[asked] = np.concatenate([unplanes(r["deleted"]) for r in own])[at]
        alone[asked] = np.concatenate([np.unpackbits(np.frombuffer(r["alone"], np.uint8), count=len(t)) for r, t in zip(own, totals)])[at].astype(bool)
    return total, deleted, alone


def _asked(alone: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Tokens whose n-gram holds no shorter one, at its end or start, that occurs once in all texts."""
    first = np.cumsum(lengths) - lengths
    before = np.append(False, alone[:-1])
    before[first] = False  # what lies before a document is no n-gram of a token
    return ~(alone | before)


def _walk(row: dict, answers: list[dict], orders: int):
    """Order by order up to ``orders``: n-grams, which of them are asked for, their counts. The last one's are not looked up
    where there are no answers to it yet.
    """
    tokens, lengths, role = _tokens(row)
    alone = np.zeros(len(tokens), bool)
    for k, grams in enumerate(_grams(tokens, lengths, orders), 1):
        # Words and pairs are all asked for; so a block's first two orders need no answers before they are sent.
        asked = _asked(alone, lengths) if k > 2 else np.ones(len(tokens), bool)
        own = [r for r in answers if r["order"] == k]
        if own or not asked.any():
            total, deleted, alone = _answered(grams, asked, role, own)
        else:
            total = deleted = None
        yield k, grams, asked, role, total, deleted


def _sent(row: dict, answers: list[dict], order: int, buckets: int) -> pa.Table:
    """A block's distinct n-grams of one order with their counts, a row per range of hashes that has any of them."""
    for k, grams, asked, role, _, _ in _walk(row, answers, order):
        if k == order:
            break
    known, at = np.unique(grams[asked], return_inverse=True)
    role = role[asked]
    total, deleted, other = (np.bincount(at[role == r], minlength=len(known)).astype(np.uint32) for r in (LEARN, DELETED, OTHER))
    total, other = total + deleted, np.minimum(other, 2)
    ranges = (known >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    starts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(known) else np.array([], np.int64)
    ends = np.append(starts[1:], len(known)).astype(np.int64)
    cut = lambda values: pa.array([planes(values[i:j]) for i, j in zip(starts, ends)], pa.binary())
    steps = np.diff(known, prepend=known[:1])
    steps[starts] = 0
    return pa.table({"bucket": pa.array(ranges[starts].astype(np.int64)), "block": pa.array([row["block"]] * len(starts), pa.int64()),
                     "low": pa.array(known[starts].view(np.int64)), "hashes": cut(steps), "total": cut(total), "deleted": cut(deleted), "other": cut(other)})


def _send(batches: Iterator[pa.RecordBatch], order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        yield from _sent(row, [], order, buckets).to_batches()


def _send_more(left: pa.Table, right: pa.Table, order: int, buckets: int) -> pa.Table:
    answers = right.to_pylist()
    return pa.concat_tables([_sent(row, answers, order, buckets) for row in left.to_pylist()] or [_sent_none()])


def _sent_none() -> pa.Table:
    return pa.table({c: pa.array([], pa.int64() if c in ("bucket", "block", "low") else pa.binary()) for c in ("bucket", "block", "low", "hashes", "total", "deleted", "other")})


def _add(rows: pa.Table, order: int) -> pa.Table:
    """All blocks' counts of one range of hashes, added up and given back to each block."""
    hashes = [np.cumsum(np.concatenate([np.array([low], np.int64).view(np.uint64), unplanes(h)[1:]]), dtype=np.uint64)
              for low, h in zip(rows["low"].to_pylist(), rows["hashes"].to_pylist())]
    known, at = np.unique(np.concatenate(hashes), return_inverse=True)
    totals, deleted, other = (np.bincount(at, np.concatenate([unplanes(x) for x in rows[c].to_pylist()]), len(known)).astype(np.uint64) for c in ("total", "deleted", "other"))
    alone = totals + other == 1
    ends = np.cumsum([len(h) for h in hashes])
    parts = [at[e - len(h):e] for h, e in zip(hashes, ends)]
    return pa.table({
        "order": pa.array([order] * len(parts), pa.int32()), "block": rows["block"], "low": rows["low"],
        "total": pa.array([planes(totals[p]) for p in parts], pa.binary()),
        "deleted": pa.array([planes(deleted[p]) for p in parts], pa.binary()),
        "alone": pa.array([np.packbits(alone[p]).tobytes() for p in parts], pa.binary()),
        "distinct": pa.array([int((totals > 0).sum())] + [0] * (len(parts) - 1), pa.int64())})


def _receive(left: pa.Table, right: pa.Table, order: int) -> pa.Table:
    """The counts of the n-grams at every token of one block."""
    out = {"docs": [], "lengths": [], "roles": [], "counts": [], "deleted": []}
    answers = right.to_pylist()
    for row in left.to_pylist():
        counts, gone = [], []
        for _, _, _, role, total, deleted in _walk(row, answers, order):
            counts.append(planes(total))
            gone.append(planes(deleted[role == DELETED]))
        for c, v in (("docs", row["docs"]), ("lengths", row["lengths"]), ("roles", row["roles"]), ("counts", counts), ("deleted", gone)):
            out[c].append(v)
    return pa.table({"docs": pa.array(out["docs"], pa.list_(pa.int64())), "lengths": pa.array(out["lengths"], pa.list_(pa.int32())),
                     "roles": pa.array(out["roles"], pa.list_(pa.int32())), "counts": pa.array(out["counts"], pa.list_(pa.binary())),
                     "deleted": pa.array(out["deleted"], pa.list_(pa.binary()))})


def _shares(counts: list[np.ndarray], first: np.ndarray, tokens: float, docs: float, vocabulary: float) -> tuple[np.ndarray, np.ndarray]:
    """The context's bucket at each token, and the estimates of every order from uniform upwards, as columns."""
    out = [np.full(len(counts[0]), 1 / (vocabulary + 1)), counts[0] / tokens if tokens else np.zeros(len(counts[0]))]
    context = np.full(len(counts[0]), tokens)
    for lower, own in zip(counts, counts[1:]):
        context = np.empty(len(lower))
        context[1:] = lower[:-1]
        context[first] = docs
        out.append(np.divide(own, context, out=np.zeros(len(own)), where=context > 0))
    bucket = np.zeros(len(context), np.uint8)
    bucket[context > 0] = np.minimum(np.log2(context[context > 0]).astype(np.int64) + 1, CONTEXT_BUCKETS - 1)
    return bucket, np.stack(out, 1)


def _held(batches: Iterator[pa.RecordBatch], tokens: float, docs: float, vocabulary: float) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        lengths, roles = np.array(row["lengths"], np.int64), np.array(row["roles"])
        held = np.repeat(roles, lengths) == DELETED
        if not held.any():
            continue
        own = lengths[roles == DELETED]
        left = [np.maximum(unplanes(c)[held].astype(np.float64) - unplanes(d), 0) for c, d in zip(row["counts"], row["deleted"])]
        bucket, shares = _shares(left, np.cumsum(own) - own, tokens, docs, vocabulary)
        packed = np.concatenate([bucket[:, None].astype(np.float32), shares.astype(np.float32)], 1)
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(packed.T).tobytes()], pa.binary())], names=["mixed"])


def _expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums, fit = np.zeros(weights.shape), 0.0
    for batch in batches:
        for data in (x.as_py() for x in batch.column(0)):
            packed = np.frombuffer(data, np.float32).reshape(weights.shape[1] + 1, -1).astype(np.float64)
            bucket = packed[0].astype(np.int64)
            share = weights[bucket].T * packed[1:]
            whole = share.sum(0)
            fit += float(np.log(whole).sum())
            for j in range(weights.shape[1]):
                sums[:, j] += np.bincount(bucket, share[j] / whole, len(weights))
    yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64())), pa.array([fit])], names=["sums", "fit"])


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, tokens: float, docs: float, vocabulary: float) -> Iterator[pa.RecordBatch]:
    for row in rows_of(batches):
        lengths = np.array(row["lengths"], np.int64)
        counts = [unplanes(c).astype(np.float64) for c in row["counts"]]
        first = np.cumsum(lengths) - lengths
        bucket, shares = _shares(counts, first, tokens, docs, vocabulary)
        score = np.log10((weights[bucket] * shares).sum(1))
        base = np.log10((counts[0] + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        add = lambda x: np.add.reduceat(x, first)
        yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(lengths), pa.array(add((counts[0] > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(score))],
                                         names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _fit(held: DataFrame, order: int, rounds: int, tolerance: float) -> np.ndarray:
    """Mixture weights per context bucket by expectation-maximisation; one distributed pass a round returns bucket sums only."""
    weights = np.full((CONTEXT_BUCKETS, order + 1), 1 / (order + 1))
    last = -math.inf
    for _ in range(rounds):
        now = weights
        steps = held.mapInArrow(lambda it, w=now: _expect(it, w), "sums array<double>, fit double")
        parts = steps.select(F.posexplode("sums").alias("i", "v"), "fit").groupBy("i").agg(F.sum("v").alias("v"), F.sum("fit").alias("fit")).collect()
        if not parts:
            break
        sums, fit = np.zeros(weights.size), parts[0]["fit"]
        for p in parts:
            sums[p["i"]] = p["v"]
        sums = sums.reshape(weights.shape)
        pooled = sums.sum(0) + 1e-9
        # Every bucket leans a little on the mixture of all of them, so that rare buckets keep some uniform share.
        sums += pooled / pooled.sum() + 1e-6
        weights = sums / sums.sum(1, keepdims=True)
        if abs(fit - last) <= tolerance * abs(fit):
            break
        last = fit
    return weights


def _together(sums: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [s.drop("distinct") for s in sums])


def _sums(blocks: DataFrame, sums: list[DataFrame], order: int, buckets: int) -> DataFrame:
    """The counts of one order, given back to the blocks, from the sums of the shorter ones."""
    if order <= 2:
        sent = blocks.mapInArrow(lambda it: _send(it, order, buckets), _GRAMS)
    else:
        known = blocks.groupBy("block").cogroup(_together(sums[1:]).groupBy("block"))
        sent = known.applyInArrow(lambda a, b: _send_more(a, b, order, buckets), _GRAMS)
    return staged(sent.groupBy("bucket").applyInArrow(lambda rows: _add(rows, order), _SUMS), f"lm-sums-{order}")


def deleted_interpolation(docs: DataFrame, learn, deleted, order: int = 2, rounds: int = 20, tolerance: float = 1e-4,
                          block_tokens: int = 1 << 19, bucket_grams: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text with an interpolated n-gram model learned from the rows where ``learn`` holds.

    Tokens are lower-cased words and one end per text. The probability of a token mixes the uniform share 1 / (V + 1), its
    share of all learned tokens, and its share after one, two, ... ``order - 1`` preceding tokens. The weights depend on the
    power of two of the longest context's count; they are fitted on the learned rows where ``deleted`` holds, whose own
    counts are taken off the totals for that purpose. The final scores use the counts of all learned rows.

    A null or empty text is one end token. A null id or a null condition counts as false; repeated rows count and are
    returned as often as they occur; an empty table gives no rows; with nothing to learn from all tokens get the uniform
    share. Columns other than the id and the text are ignored. Words are told apart by 64-bit hashes.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    role = F.when(F.coalesce(learn, F.lit(False)), F.when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(LEARN)).otherwise(OTHER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), role.alias("role"))
    spark = docs.sparkSession
    with shuffles_removed(spark):
        blocks = bucketed(rows.mapInArrow(lambda it: _pack(it, block_tokens), _BLOCKS), "lm_blocks", "block")
        size = blocks.agg(F.sum("tokens").alias("all"), F.sum("learn_tokens").alias("learn"),
                          F.sum(F.expr("size(filter(roles, r -> r > 0))")).alias("docs"), F.sum(F.expr("size(filter(roles, r -> r = 2))")).alias("gone"),
                          F.sum(F.expr("aggregate(arrays_zip(roles, lengths), 0L, (a, x) -> a + if(x.roles = 2, x.lengths, 0))")).alias("gone_tokens")).first()
        buckets = max(1, -(-(size["all"] or 0) // bucket_grams))
        grams, sums = blocks.select("block", "lengths", "roles", "vocab", "words"), []
        for k in range(1, order + 1):
            sums.append(_sums(grams, sums, k, buckets))
        vocabulary = sums[0].agg(F.sum("distinct")).first()[0] or 0
        joined = blocks.groupBy("block").cogroup(_together(sums).groupBy("block"))
        counts = staged(joined.applyInArrow(lambda a, b: _receive(a, b, order), _COUNTS), "lm-counts")
    discard(blocks, *sums)
    tokens, n_docs = float(size["learn"] or 0), float(size["docs"] or 0)
    kept_tokens, kept_docs = tokens - (size["gone_tokens"] or 0), n_docs - (size["gone"] or 0)
    held = staged(counts.mapInArrow(lambda it: _held(it, kept_tokens, kept_docs, vocabulary), _HELD), "lm-held")
    weights = _fit(held, order, rounds, tolerance) if tokens else np.tile(np.eye(order + 1)[0], (CONTEXT_BUCKETS, 1))
    scores = counts.select("docs", "lengths", "counts").mapInArrow(lambda it: _score(it, weights, tokens, n_docs, vocabulary), _SCORES)
    return scores.withColumn("train_tokens", F.lit(int(tokens)).cast("long"))
