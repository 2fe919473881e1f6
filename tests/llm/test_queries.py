"""Registered queries against their SQL, and the pipeline's stages against brute-force versions."""

import math
import re
from collections import Counter

import pytest
import xxhash
from compare import connect, difference
from pyspark.sql import functions as F

from gatewatch.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) is None


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_rules(rows, trusted):
    """The rows that the first stage must keep, from its definition; the hash is Spark's, seeded with 42 and chained over pairs."""
    def buckets(words):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
        return [h % 65536 for h in hashes] + [xxhash.xxh64_intdigest(b.encode(), h) % 65536 for h, b in zip(hashes, words[1:])]

    found = [buckets(words_of(r.text)) for r in rows]
    every = Counter(b for bs in found for b in bs)
    good = Counter(b for r, bs in zip(rows, found) if r.doc_id in trusted for b in bs)
    scale = sum(good.values()) / sum(every.values())
    ratio = {b: math.log(good[b] + 4) - math.log(n * scale + 4) for b, n in every.items()}
    kept = []
    for r, bs in zip(rows, found):
        words = words_of(r.text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(windows)
        repeated = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and sum(ratio[b] for b in bs) / len(bs) >= -0.15:
            kept.append(r)
    return kept


def brute_first_copies(rows):
    """Smallest id of each group of texts linked by five-word shingles at 0.8."""
    sets = {}
    for r in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words_of(r.text)]
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, set()).update([frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))] if words else [])
    ids, root = sorted(sets), {}
    find = lambda i: i if root.get(i, i) == i else find(root[i])
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if any(100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {find(i) for i in ids}


def test_rules_and_near_duplicates_of_the_pipeline_equal_brute_force(spark, sf_dir):
    """Whole results: a stage that lost one clean document, or kept one copy too many, would fail."""
    import corpus_pipeline as C

    docs = C.staged(C.table(spark, sf_dir, "documents"), "in")
    rows = docs.collect()
    trusted = {r.doc_id for r in C.trusted_ids(spark, sf_dir).collect()}
    kept = C.staged(C.STAGES[0][1](spark, docs, sf_dir), "rules")
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, brute_rules(rows, trusted)))
    single = C.STAGES[2][1](spark, docs, sf_dir).collect()
    assert sorted(r.doc_id for r in single) == sorted(brute_first_copies(rows)) and len(single) < len(rows)
    assert {(r.doc_id, r.text) for r in single} <= {(r.doc_id, r.text) for r in rows}


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    docs = C.table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "w " * 80, "en", "src0", 160), (900_000, "", "en", None, 0)], docs.schema)
    rows, ids = C.staged(docs.unionAll(odd).unionAll(docs.limit(3)), "in"), []
    for name, stage in C.STAGES[:-1]:
        out = C.staged(stage(spark, rows, sf_dir), name.replace(" ", "-"))
        assert out.columns == docs.columns
        texts = {r.doc_id: r.text for r in rows.collect()}
        assert all(texts[r.doc_id] == r.text for r in out.collect() if r.doc_id is not None)
        rows = out
        ids.append([r.doc_id for r in out.collect()])
    rules = {r.doc_id for r in C.quality_rules(docs, C.trusted_ids(spark, sf_dir)).where("kept").collect()}
    assert set(ids[0]) <= rules | {None} and len(ids[0]) > 50
    assert len(ids[2]) == len(set(ids[2])) and set(ids[2]) <= set(ids[1])
    assert set(ids[3]) <= set(ids[2]) and max(map(ids[3].count, ids[3])) <= 2
    last = C.STAGES[-1][1](spark, rows, sf_dir)
    assert last.where(~F.col("round_trip")).count() == 0 and last.count() == len(ids[3])
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
