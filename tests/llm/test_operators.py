"""Operators against brute force, on small tables with nulls, blanks, long texts, ties, copies and clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make_texts(n=60, seed=5):
    draw = random.Random(seed)
    vocab = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 7))) for _ in range(300)]
    texts = {}
    for i in range(n):
        words = [draw.choice(vocab) for _ in range(draw.randint(1, 120))]
        texts[i] = draw.choice([" ", "\n", "\t ", " "]).join(words)
    for i in range(0, 20, 2):
        words = texts[i].split()
        if len(words) > 30:
            words[draw.randrange(len(words))] = "changed"
        texts[100 + i] = " ".join(words).upper() if i % 4 else " ".join(words)
        texts[200 + i] = texts[i]
    texts |= {300: None, 301: "", 302: " \n\t", 303: "One", 304: "two Words", 305: "same " * 40000, 306: "Same " * 40000}
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id, text, source and columns named like what operators make."""
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, 1, "x", 0.5) for i, t in make_texts().items()] + [(None, "no id here at all " * 20, "s1", 1, "y", 0.1), (5, make_texts()[5], "s2", 1, "z", 0.2)]
    schema = "doc_id long, text string, source string, node int, kept string, score double"
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_language_model(docs, empty):
    from gatewatch.llm.lm import deleted_interpolation

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    run = lambda df: deleted_interpolation(df, fold % 5 != 1, F.floor(fold / 5) % 3 == 0, block_tokens=500, bucket_grams=300)
    got = run(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokens = [(d, [w for w in (t or "").translate(LOWER).split()] + ["<end>"]) for d, t in rows]
    learns = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 != 1
    counts = Counter(w for d, ws in tokens if learns(d) for w in ws)
    total, vocab = sum(counts.values()), len(counts)
    want = sorted((d if d is not None else -1, len(ws), sum(counts[w] > 0 for w in ws), sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (vocab + 1))) for w in ws)) for d, ws in tokens)
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.base_score) for r in got)
    assert len(have) == len(want) and {r.train_tokens for r in got} == {total}
    for h, w in zip(have, want):
        assert h[:3] == w[:3] and math.isclose(h[3], w[3], rel_tol=1e-9)
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    # Two documents of one word each outweigh all others here; without them the mixture beats the smoothed shares.
    held = [r for r in run(docs.where("doc_id < 305")).collect() if not learns(r.doc_id)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert run(empty).count() == 0
    assert {r.score for r in deleted_interpolation(docs.where("doc_id = 303"), F.lit(False), F.lit(False)).collect()} == {0.0}


def brute_scores(rows, learns, deletes, order, rounds=20, tolerance=1e-4):
    """Counts by plain dictionaries, expectation-maximisation token by token; rows of (id, text)."""
    from gatewatch.llm.lm import CONTEXT_BUCKETS

    texts = [(d, ["<s>"] * (order - 1) + WORDS.findall((t or "").translate(LOWER)) + ["</s>"]) for d, t in rows]

    def counted(chosen):
        out = Counter()
        for d, ws in texts:
            if chosen(d):
                for i in range(order - 1, len(ws)):
                    for k in range(1, order + 1):
                        out[tuple(ws[i - k + 1 : i + 1])] += 1
                for k in range(1, order):
                    out["start", k] += 1
        return out

    full = counted(learns)
    left = full - counted(lambda d: learns(d) and deletes(d))
    vocabulary = sum(1 for g in full if len(g) == 1)

    def shares(counts, ws, i):
        tokens = sum(n for g, n in counts.items() if len(g) == 1)
        context = tokens
        out = [1 / (vocabulary + 1), counts[(ws[i],)] / tokens if tokens else 0.0]
        for k in range(2, order + 1):
            before = tuple(ws[i - k + 1 : i])
            context = counts["start", 1] if before[-1] == "<s>" else counts[before]
            out.append(counts[tuple(ws[i - k + 1 : i + 1])] / context if context else 0.0)
        return (min(int(math.log2(context)) + 1, CONTEXT_BUCKETS - 1) if context else 0), np.array(out)

    held = [shares(left, ws, i) for d, ws in texts if learns(d) and deletes(d) for i in range(order - 1, len(ws))]
    weights, last = np.full((CONTEXT_BUCKETS, order + 1), 1 / (order + 1)), -math.inf
    for _ in range(rounds):
        sums, fit = np.zeros(weights.shape), 0.0
        for b, s in held:
            part = weights[b] * s
            sums[b] += part / part.sum()
            fit += math.log(part.sum())
        pooled = sums.sum(0) + 1e-9
        sums += pooled / pooled.sum() + 1e-6
        weights = sums / sums.sum(1, keepdims=True)
        if abs(fit - last) <= tolerance * abs(fit):
            break
        last = fit
    out = []
    for d, ws in texts:
        found = [shares(full, ws, i) for i in range(order - 1, len(ws))]
        out.append((d, sum(math.log10(float(weights[b] @ s)) for b, s in found)))
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_scores_equal_brute_force(spark, order):
    from gatewatch.llm.lm import deleted_interpolation

    draw = np.random.default_rng(order)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(draw.choice(words, int(draw.integers(0, 60)), p=np.arange(40, 0, -1) / 820))) for i in range(60)]
    rows += [(60, None), (61, "only here"), (62, "only here too"), (63, rows[5][1]), (64, rows[5][1].upper()), (65, "once")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = deleted_interpolation(df, F.col("doc_id") % 5 != 1, F.col("doc_id") % 3 == 0, order=order, block_tokens=300, bucket_grams=200).collect()
    want = brute_scores(rows, lambda d: d % 5 != 1, lambda d: d % 3 == 0, order)
    have = sorted((r.doc_id, r.score) for r in got)
    assert [d for d, _ in have] == [d for d, _ in want]
    for (_, x), (_, y) in zip(have, want):
        assert math.isclose(x, y, rel_tol=1e-4, abs_tol=1e-4)


def test_language_model_sends_ranges_that_occur_and_no_known_single(spark):
    from gatewatch.llm import lm
    from gatewatch.llm.words import planes, unplanes

    draw = np.random.default_rng(4)
    vocab = np.unique(draw.integers(1, 2**63, 500).astype(np.uint64))
    row = {"block": 1, "lengths": [3000], "roles": [lm.LEARN], "vocab": vocab.tobytes(), "words": planes(draw.integers(0, len(vocab), 3000).astype(np.uint64))}
    pairs = lm._sent(row, [], 2, 1 << 40)
    distinct = sum(len(unplanes(h)) for h in pairs["hashes"].to_pylist())
    assert pairs.num_rows <= distinct <= 3000  # however many ranges there are
    few = lm._sent(row, [], 2, 3)
    assert few.num_rows == 3 and sum(len(unplanes(h)) for h in few["hashes"].to_pylist()) == distinct
    answers = [a for b in range(3) for a in lm._add(few.slice(b, 1), 2).to_pylist()]
    triples = lm._sent(row, answers, 3, 3)
    single = Counter(lm._grams(*lm._tokens(row)[:2], 2)[1].tolist())
    grams = lm._grams(*lm._tokens(row)[:2], 3)
    sent = {g for i, g in enumerate(grams[2].tolist()) if single[grams[1][i].item()] > 1 and (i == 0 or single[grams[1][i - 1].item()] > 1)}
    assert sum(len(unplanes(h)) for h in triples["hashes"].to_pylist()) == len(sent) < len(set(grams[2].tolist()))


def test_registered_scores_use_word_triples(spark, sf_dir):
    from gatewatch.llm.lm import deleted_interpolation
    from gatewatch.llm.queries import QUERIES, fold

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    have = {r.doc_id: r.score for r in QUERIES["op1_lm_scoring"](spark, sf_dir).collect()}
    want, pairs = ({r.doc_id: r.score for r in deleted_interpolation(docs, fold() % 5 != 1, F.floor(fold() / 5) % 10 == 0, order=k).collect()} for k in (3, 2))
    assert have.keys() == want.keys() and all(math.isclose(have[d], want[d], rel_tol=1e-9) for d in want)
    held = [d for d in want if zlib.crc32(str(d).encode()) % 5 == 1]
    assert held and sum(have[d] for d in held) > sum(pairs[d] for d in held)


def test_language_model_is_a_distribution(spark):
    """After every context the probabilities of all known words, the end and one unknown word sum to one."""
    from gatewatch.llm.lm import CONTEXT_BUCKETS, _shares

    draw = np.random.default_rng(1)
    weights = draw.dirichlet([1, 1, 1], CONTEXT_BUCKETS)
    follow = Counter({"a": 3, "b": 1})
    ones = Counter({"a": 6, "b": 2, "end": 2})
    total = 0.0
    for w in ("a", "b", "end", "unknown"):
        bucket, shares = _shares([np.array([6.0, ones[w]]), np.array([1.0, follow[w]])], np.array([0]), 10.0, 2.0, 3.0)
        context = 6.0
        assert bucket[1] == int(math.log2(context)) + 1 and math.isclose(shares[1, 2], follow[w] / context)
        total += float(weights[bucket[1]][:2] @ shares[1][:2]) + weights[bucket[1]][2] * follow[w] / sum(follow.values())
    assert math.isclose(total, 1)


def shingle_sets(rows, width):
    out = {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        out.setdefault(d, []).append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("chunk", [192, 4])
def test_near_duplicates(docs, empty, chunk, monkeypatch):
    from gatewatch.llm import near_dups

    monkeypatch.setattr(near_dups, "CHUNK", chunk)
    monkeypatch.setattr(near_dups, "NODE_LIMIT", 64 if chunk > 4 else 3)
    got = near_dups.near_duplicates(docs, width=3, percent=85).collect()
    sets = shingle_sets([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 3)
    flat = {d: s[0] for d, s in sets.items()}
    pairs = [(a, b) for a in flat for b in flat if a < b and flat[a] and 100 * len(flat[a] & flat[b]) >= 85 * len(flat[a] | flat[b])]
    want = brute_components(flat, pairs)
    assert pairs and len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(flat[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    if chunk == 192:
        assert near_dups.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_reach_the_recall_of_a_pair_that_descends_every_level(docs, percent, monkeypatch):
    from gatewatch.llm import near_dups

    used, own = [], near_dups._candidates
    monkeypatch.setattr(near_dups, "_candidates", lambda sets, trees, least: used.append(trees) or own(sets, trees, least))
    near_dups.near_duplicates(docs.limit(3), percent=percent, recall=0.999)
    assert (1 - (percent / 100) ** near_dups.LEVELS) ** used[0] <= 0.001


def test_rows_of_one_id_join_their_classes(spark):
    from gatewatch.llm.near_dups import near_duplicates

    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "ab"}
    df = spark.createDataFrame([(7, text["a"]), (7, text["b"]), (3, text["a"]), (9, text["b"])], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(7, 3), (3, 3), (9, 3)}


@pytest.mark.parametrize("block", [512, 8])
def test_neighbour_links(spark, block, monkeypatch):
    from gatewatch.llm import neighbour_links

    monkeypatch.setattr(neighbour_links, "BLOCK", block)
    draw = np.random.default_rng(3)
    rows, centres = [], draw.normal(size=(12, 16))
    for i in range(240):
        v = centres[i % 12] + draw.normal(size=16) * (0.02 if i % 3 else 1)
        rows.append((i, [float(x) for x in v], i % 2 if i % 20 else None, "clash"))
    rows += [(900, rows[1][1], 1, "c"), (901, rows[1][1], 1, "c"), (902, None, 1, "c"), (903, [0.0] * 16, 1, "c"), (904, [float("nan")] * 16, 1, "c"),
             (905, [None] + [1.0] * 15, 1, "c"), (906, [], 1, "c"), (907, [1.0, 2.0], 1, "c"), (908, [2.0, 4.0], 1, "c"), (None, rows[1][1], 1, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component string")
    got = neighbour_links.link_neighbours(df).collect()
    good = {}
    for k, (i, v, l, _) in enumerate(rows):
        if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v)
            good[k] = (i, u / np.linalg.norm(u), l)
    links = [(a, b) for a in good for b in good if a < b and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    degree, part = Counter(x for p in links for x in p), brute_components(good, links)
    least = defaultdict(lambda: None)
    for k, p in part.items():
        ids = [x for x in (least[p], good[k][0]) if x is not None]
        least[p] = min(ids, default=None)
    want = Counter((r[0], degree[k], least[part[k]] if k in part else r[0]) for k, r in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id or r.component_id is None) for r in got if r.vec_id is not None)
    if block == 512:
        assert neighbour_links.link_neighbours(df.limit(0)).count() == 0


@pytest.mark.parametrize("angles", [(0.0, 0.195), (0.0, 0.206, 0.412)])
def test_dense_groups_linked_only_across_full_lists(spark, angles):
    """Each list is full of its own group's vectors; the links to the next group show only in an exact comparison of groups."""
    from gatewatch.llm.neighbour_links import link_neighbours

    draw, units = np.random.default_rng(6), []
    for angle in angles:
        for _ in range(90):
            v = np.r_[math.cos(angle), math.sin(angle), np.zeros(14)] + draw.normal(size=16) * 0.004
            units.append(v / np.linalg.norm(v))
    units = np.stack(units)
    linked = units @ units.T >= 0.98
    np.fill_diagonal(linked, False)
    group = np.arange(len(units)) // 90
    assert linked[group[:, None] == group].sum() == len(angles) * 90 * 89 and linked[group[:, None] != group].any()
    got = link_neighbours(spark.createDataFrame([(i, u.tolist(), 1) for i, u in enumerate(units)], "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(linked.sum(1).tolist()))
    assert {r.component_id for r in got} == {0}


def test_small_label_beside_a_hot_one_is_searched_whole(spark):
    """A label of few vectors needs no hyperplanes: a single trial brings all of its pairs at the threshold together."""
    from gatewatch.llm import neighbour_links as N

    draw = np.random.default_rng(9)
    rows = [(i, 0, draw.normal(size=24)) for i in range(4000)]
    for i in range(20):
        u, v = draw.normal(size=(2, 24))
        u /= np.linalg.norm(u)
        v -= (v @ u) * u
        rows += [(5000 + 2 * i, 1, u), (5001 + 2 * i, 1, 0.9801 * u + math.sqrt(1 - 0.9801**2) * v / np.linalg.norm(v))]
    rows = [(n, l, 24 * 8, (v / np.linalg.norm(v)).astype(np.float32).tobytes()) for n, l, v in rows]
    vectors = spark.createDataFrame(rows, "node long, label int, size int, vector binary")
    found = {(r.a, r.b) for r in N._started(vectors, [0], 8).collect()}
    assert all((5000 + 2 * i, 5001 + 2 * i) in found and (5001 + 2 * i, 5000 + 2 * i) in found for i in range(20))


def test_links_of_large_pockets_do_not_hide_missed_pairs(spark):
    """Recall is a mean per vector, of large pockets and of the rest apart: all links of 200 vectors found, all of ten pairs missed."""
    from gatewatch.llm import neighbour_links as N

    draw = np.random.default_rng(2)
    units = [np.r_[1.0, 0.001 * i, np.zeros(14)] for i in range(200)]
    for i in range(10):
        v = draw.normal(size=16)
        units += [v, v + 1e-3 * draw.normal(size=16)]
    units = [u / np.linalg.norm(u) for u in units]
    classes = spark.createDataFrame([(i, 1, u.tobytes()) for i, u in enumerate(units)], "node long, label int, unit binary")
    pockets = spark.createDataFrame([(i, 0) for i in range(200)], "node long, pocket long")
    seen = N._asked(classes, pockets, 0.98, 64, 0)
    assert N._recall(seen) == 0 and N._recall(seen.where("large")) == 1
    assert seen.where("not found").count() == 20


def test_missed_recall_is_raised(spark, monkeypatch):
    """Vectors that no bucket and no list ever brings together fail the search instead of being returned apart."""
    from gatewatch.llm import neighbour_links as N

    near = N._near
    monkeypatch.setattr(N, "_near", lambda batches: (b.slice(0, 0) for b in near(batches)))
    df = spark.createDataFrame([(i, [1.0, 1e-3 * i], 1) for i in range(8)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="recall 0.0000 after 1 searches"):
        N.link_neighbours(df, searches=1)


def test_search_finds_a_sample_of_true_neighbours(spark):
    """The lists alone, before the exact count: recall against brute force."""
    from gatewatch.llm import neighbour_links as N

    draw = np.random.default_rng(8)
    centres = draw.normal(size=(60, 24))
    rows = [(i, 0, 24 * 8, (u := (lambda x: x / np.linalg.norm(x))(centres[i % 60] + draw.normal(size=24) * 0.05)).tobytes(), u.astype(np.float32).tobytes()) for i in range(600)]
    vectors = spark.createDataFrame(rows, "node long, label int, size int, unit binary, vector binary")
    lists = N._trimmed(N._started(vectors, [0, 1, 2, 3], 8), vectors.select("node", F.lit(0).alias("most")).limit(0), 8).collect()
    found = {(r.a, r.b) for r in lists}
    units = np.stack([np.frombuffer(r[3]) for r in rows])
    best = np.argsort(-(units @ units.T - 2 * np.eye(600)), axis=1)[:, :5]
    assert np.mean([(a, int(b)) in found for a in range(600) for b in best[a]]) >= 0.9


def test_sainte_lague(spark):
    from gatewatch.llm.mixing import sainte_lague

    draw = random.Random(2)
    parties = [(g, f"p{i}", float(draw.choice([0, 1, 5, 5, 40, 300])), s) for g, s in (("a", 17), ("b", 0), (None, 101)) for i in range(9)]
    df = spark.createDataFrame(parties, "g string, party string, votes double, seats int")
    got = {(r.g, r.party): r.quota for r in sainte_lague(df, ["g", "seats"], [F.col("party")], "votes", F.col("seats")).collect()}
    for g, seats in (("a", 17), ("b", 0), (None, 101)):
        own, won = [(p, v) for h, p, v, _ in parties if h == g], Counter()
        for _ in range(seats):
            p = min(own, key=lambda x: (-x[1] / (2 * won[x[0]] + 1), x[0]))[0]
            won[p] += 1
        assert {p: got[g, p] for p, _ in own} == {p: won[p] for p, _ in own}


def test_mixing(docs, empty):
    from gatewatch.llm.mixing import mix_sources

    got = mix_sources(docs, (5, 2, 1), 1.5).collect()
    rows = [(r.doc_id, r.source, len(WORDS.findall(r.text or ""))) for r in docs.collect()]
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s))
    weight, target, rest, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names), 1.5 * sum(size.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in rest)
        full = [s for s in rest if weight[s] * level >= 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            rest.discard(s)
    target |= {s: weight[s] * level for s in rest}
    source = {d: s for d, s, _ in rows if d != 5}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, n) for d, _, n in rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = next(x for x in names if size[x] == r.source_size)
        assert r.doc_id == 5 or source[r.doc_id] == s
        assert math.isclose(r.target, target[s])
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 32
    again = mix_sources(docs.repartition(5), (5, 2, 1), 1.5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_sources(empty).count() == 0


def test_quality_rules(spark, docs, empty):
    from gatewatch.llm.quality_rules import quality_rules

    more = [(1000 + i, t, "s", 0, "k", 0.0) for i, t in enumerate(["a b c a b c a b c", "x # $ %\nx # $ %\n\n\n y\n y", "q " * 60, " ".join(f"w{i}" for i in range(70)) + " w1 w2 w3", "é |é| <b>&amp;</b>"])]
    df = docs.unionAll(spark.createDataFrame(more, docs.schema))
    got = quality_rules(df, docs.where("doc_id < 40").select("doc_id"))
    assert set(docs.columns) <= set(got.columns)
    want = Counter()
    for d, t in ((r.doc_id, r.text or "") for r in df.collect()):
        w = WORDS.findall(t)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        times, inside, seen, dup = Counter(windows), set(), set(), 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                inside |= {i, i + 1, i + 2}
        for line in t.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        want[d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), failed] += 1
    rows = got.collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(not (r.kept and r.base_failed) for r in rows)
    none = quality_rules(df, docs.limit(0).select("doc_id")).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality_rules(empty, docs.select("doc_id")).count() == 0


def test_quality_verdicts_equal_brute_force(spark, sf_dir):
    """Log ratios and verdicts of the registered query, from plain dictionaries of hashed words and word pairs."""
    import xxhash

    from gatewatch.llm.queries import QUERIES

    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").collect()}

    def grams(text):
        words = [w.encode() for w in WORDS.findall(text)]
        one = [xxhash.xxh64_intdigest(w, 42) for w in words]
        return [h % 65536 for h in one] + [xxhash.xxh64_intdigest(w, h) % 65536 for w, h in zip(words[1:], one)]

    own = [(d, grams(t)) for d, t in docs]
    whole, trusted = Counter(g for _, x in own for g in x), Counter(g for d, x in own if d in good for g in x)
    scale = sum(trusted.values()) / sum(whole.values())
    ratio = {g: math.log(trusted[g] + 4) - math.log(n * scale + 4) for g, n in whole.items()}
    want = {d: sum(ratio[g] for g in x) / len(x) if x else None for d, x in own}
    got = {r.doc_id: r for r in QUERIES["op10_quality_rules"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and len(docs) == len(got)
    for d, r in got.items():
        assert (r.log_ratio is None) == (want[d] is None)
        if want[d] is not None:
            assert math.isclose(r.log_ratio, want[d], abs_tol=1e-4)
            if abs(want[d] + 0.15) > 1e-4:
                assert r.kept == (not r.base_failed and want[d] >= -0.15)
    assert {r.kept for r in got.values()} == {True, False}


def test_quality_classifier(spark, empty, sf_dir):
    from gatewatch.llm.quality_classifier import fit_quality, isotonic, score_quality
    from gatewatch.llm.queries import fold

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(1).alias("score"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = fit_quality(docs, labels, fold() % 5 != 0, F.floor(fold() / 5) % 4 == 0)
    scored = score_quality(docs, model).join(labels, "doc_id").where(fold() % 5 == 0).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.3) == (r.quality == 1) for r in scored]) >= 0.95
    assert all(0 <= r.score <= 1 for r in scored)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "  \n"), (2, "word " * 300_000)], "doc_id long, text string")
    out = score_quality(odd, model).collect()
    assert len(out) == 4 and len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert score_quality(empty, model).count() == 0
    blank = fit_quality(docs, labels.limit(0), fold() % 5 != 0, fold() % 4 == 0)
    assert {r.score for r in score_quality(odd, blank).collect()} == {0.5}
    x, y = isotonic(np.arange(6.0), np.array([0, 1, 0.5, 0.2, 0.9, 0.8]), np.ones(6))
    assert (np.diff(y) > 0).all() and math.isclose(y[1], (1 + 0.5 + 0.2) / 3)


def test_pieces(spark, docs, empty):
    import sentencepiece

    from gatewatch.llm.pieces import decode_pieces, encode_pieces
    from gatewatch.llm.queries import PIECE_MODEL

    own = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    draw = random.Random(4)
    texts = [None, "", " ", "   ", "a\n\nb  c\t\td", "你好 world ﬁ①  éa", "x" * 70, " " * 40 + "z" + " " * 17, "a\x00b <s> </s> <0x41>", "word " * 50_000, "a▁b"]
    texts += ["".join(draw.choice("ab  \n.,éthe你①ing") for _ in range(draw.randint(1, 60))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_ids string")
    for r in encode_pieces(df, PIECE_MODEL).collect():
        assert r.ids == (own.encode(r.text) if r.text else []) and r.n_ids == len(r.ids)
        assert r.round_trip == ("▁" not in (r.text or ""))
    back = decode_pieces(encode_pieces(df, PIECE_MODEL), PIECE_MODEL).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)
    assert encode_pieces(docs, PIECE_MODEL).count() == docs.count() and encode_pieces(empty, PIECE_MODEL).count() == 0


def test_piece_paths_of_a_score_model_are_cheapest():
    """Without merges the path of least cost wins, against all segmentations."""
    from gatewatch.llm.pieces import PieceTransducer
    from gatewatch.llm.queries import PIECE_MODEL

    machine = PieceTransducer(open(PIECE_MODEL, "rb").read())
    machine.merges = False

    def cheapest(s):
        best = [0.0] + [math.inf] * len(s)
        for j in range(1, len(s) + 1):
            best[j] = min((best[i] - machine.scores[s[i:j]] for i in range(j) if s[i:j] in machine.scores), default=math.inf)
        return best[-1]

    for word in ("▁there", "▁information", "▁aaa", "▁anthropology"):
        path = machine.shortest(word)
        assert "".join(path) == word and math.isclose(-sum(machine.scores[p] for p in path), cheapest(word))


def test_licences_of_long_texts_of_cue_words(spark):
    """A notice is found wherever it lies, also across the ends of the pieces that a text is looked through in."""
    from gatewatch.llm.licences import PIECE, scan_licences

    draw = random.Random(3)
    some = lambda n: " ".join(draw.choice(["license", "warranty", "copyright", f"w{draw.randrange(10**5)}"]) for _ in range(n))
    notice = "licensed\nunder the\nApache License,\nVersion 2.0."
    rows = [(at, f"d{at}/x.py", f"{some(at)} {notice} {some(2 * PIECE)}") for at in (0, 1, PIECE - 6, PIECE - 3, PIECE - 1, PIECE, 2 * PIECE - 2, 5 * PIECE + 1)]
    rows.append((-1, "e/x.py", some(3 * PIECE)))
    rows.append((-2, "f/x.py", some(30_000) + " " + notice))
    got = {r.file_id: r.own_licence for r in scan_licences(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert got.pop(-1) is None and set(got.values()) == {"Apache-2.0"} and len(got) == len(rows) - 1


def test_licences(spark, empty):
    from gatewatch.llm.licences import scan_licences

    rows = [(1, "/a/LICENSE", "Released under the MIT License."), (2, "a//b/x.py", "code"), (3, "a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
            (4, "a/b/c/COPYING", "long prose\nThis work is licensed under the GNU General Public License, version 3.\n" + "more " * 20000), (5, "a/b/c/d/z.py", None), (6, "q/z.py", ""),
            (7, None, "Licensed under CC BY-NC 4.0."), (8, None, None), (None, "a/n.py", "Released under the MIT License."), (2, "a//b/x.py", "code"), (9, "top.txt", "a license of no known kind")]
    df = spark.createDataFrame(rows, "file_id long, path string, text string").withColumn("cosine", F.lit("clash"))
    got = Counter((r.file_id, r.own_licence, r.from_dir, r.licence) for r in scan_licences(df).collect())
    assert got == Counter([(1, "MIT", None, "MIT"), (2, None, "a", "MIT"), (2, None, "a", "MIT"), (3, "Apache-2.0", None, "Apache-2.0"), (4, "GPL-3.0", None, "GPL-3.0"),
                           (5, None, "a/b/c", "GPL-3.0"), (6, None, None, None), (7, "CC-BY-NC-4.0", None, "CC-BY-NC-4.0"), (8, None, None, None), (None, None, "a", "MIT"), (9, None, None, None)])
    assert scan_licences(df.limit(0)).count() == 0


MIT_TEXT = """Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_real_headers_and_licence_files(spark):
    from gatewatch.llm.licences import scan_licences

    gpl = """ *  This program is free software: you can redistribute it and/or modify
 *  it under the terms of the GNU General Public License as published by
 *  the Free Software Foundation, either version 3 of the License, or
 *  (at your option) any later version."""
    texts = [("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
             ("MIT License", "MIT"), ("Copyright 2020 A Person. Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
             ("This file is part of the project and is Released under the MIT License.", "MIT"), ("released under\n# the MIT\n# License", "MIT"), ("GNU GENERAL PUBLIC LICENSE", "GPL"),
             ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy\n" + "more " * 5000, "GPL-3.0"),
             (gpl, "GPL-3.0"), (MIT_TEXT, "MIT"), (BSD_TEXT.format(""), "BSD-2-Clause"), (BSD_TEXT.format(BSD_THIRD), "BSD-3-Clause"),
             ("Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n" + "text " * 3000, "MPL-2.0"),
             ("                                 Apache License\n                           Version 2.0, January 2004\n" + "text " * 2000, "Apache-2.0"),
             ("SPDX-License-Identifier: Unheard-Of-1.0", None), ("we hereby redistribute our warranty cards", None)]
    rows = [(i, f"d{i}/LICENSE" if i % 2 else f"d{i}/x.c", t) for i, (t, _) in enumerate(texts)]
    got = {r.file_id: r.own_licence for r in scan_licences(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert {t: got[i] for i, (t, _) in enumerate(texts)} == dict(texts)


def test_licence_cosines(spark):
    from gatewatch.llm.licences import TEMPLATES, matched

    texts = ["Licensed under the Apache License, Version 2.0.", "licensed under the MIT License", "GNU Lesser General Public License 2.1 applies", "something else entirely"]
    terms = lambda t: [x.rstrip(".") for x in re.split(r"[^a-z0-9.+-]+", t.lower()) if x.rstrip(".")]
    frequency = Counter(x for _, t in TEMPLATES for x in set(terms(t)))
    idf = lambda x: math.log((1 + len(TEMPLATES)) / (1 + frequency[x])) + 1

    def vector(t):
        v = {x: n * idf(x) for x, n in Counter(terms(t)).items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {x: w / norm for x, w in v.items()}

    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "file long, part int, segment string")
    got = {r.file: (r.licence, r.cosine) for r in matched(df, TEMPLATES, 0.1, spark).collect()}
    for i, t in enumerate(texts):
        v = vector(t)
        best = min((-round(sum(w * v.get(x, 0) for x, w in vector(s).items()), 6), n) for n, s in TEMPLATES)
        assert got.get(i, (best[1], 0)) == (best[1], pytest.approx(-best[0], abs=2e-6)) if -best[0] >= 0.1 else i not in got


def test_warc(spark, tmp_path):
    from gatewatch.llm.warc import assemble, parse_records, read_warc, write_warc

    same = "<p>" + "same " * 50 + "</p>"
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5
    rows = [(5, "http://a/x?q#f", same), (2, "http://b/", same), (9, None, same), (1, "http://c", "tiny"), (3, "http://c", "tiny"), (4, "http://d\r\nX: y", tricky),
            (6, "http://e", None), (7, "http://e", "é" * 60_000), (None, "http://f", same), (8, "http://g", tricky), (8, "http://g", tricky), (2, "http://b/", same)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    write_warc(df, str(tmp_path / "w"))
    records = read_warc(spark, str(tmp_path / "w")).cache()
    kinds = Counter(r.record_type for r in records.collect())
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds["revisit"] == 10
    out = assemble(records).collect()
    by = {r.metadata.fields.get("id"): r for r in out}
    assert {k: (r.capture.record_type, r.metadata.fields["copies"], r.refers_to.fields["id"] if r.refers_to else None) for k, r in by.items()} == {
        "5": ("revisit", "1", "2"), "2": ("response", "2", None), "9": ("revisit", "1", "2"), "1": ("response", "1", None), "3": ("response", "1", None), "4": ("response", "1", None),
        "6": ("response", "1", None), "7": ("response", "1", None), None: ("revisit", "1", "2"), "8": ("revisit", "2", "4")}
    assert bytes(by["4"].capture.payload).decode() == tricky and by["5"].capture.payload_bytes == len(same) and by["4"].capture.target_uri == "http://d%0D%0AX: y"
    assert all(r.request is not None for r in out) and by["7"].capture.payload_bytes == 120_000
    assert list(parse_records(b"WARC/1.1\r\nbroken", True)) == []
    write_warc(df.limit(0), str(tmp_path / "none"))
    assert assemble(read_warc(spark, str(tmp_path / "none"))).count() == 0


def test_damaged_and_plain_archives(spark, tmp_path):
    import gzip

    from gatewatch.llm.warc import parse_records, read_warc

    def record(number, payload, length=None):
        http = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        stated = str(len(http)) if length is None else length
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{number}>\r\nContent-Length: {stated}\r\n\r\n".encode() + http + b"\r\n\r\n"

    draw = random.Random(3)
    payloads = [b"", b"x" * 100, draw.randbytes(3_000_000), b"WARC/1.1\r\n\r\nWARC/1.1\r\n\r\n" * 3, b"z" * 5_000_000, "é".encode() * 70]
    parts = [record(i, p) for i, p in enumerate(payloads)]
    whole, want = b"".join(parts), [(f"<{i}>", p) for i, p in enumerate(payloads)]
    got = lambda data: [(r[0], r[-1]) for r in parse_records(data, True)]
    assert got(whole) == got(gzip.compress(whole)) == got(b"".join(map(gzip.compress, parts))) == want
    for cut in (1, 40, 150, len(parts[0]) + 5, len(parts[0]) + len(parts[1]) - 60, len(whole) - 5, len(whole) - 1):
        ends = np.cumsum([len(p) for p in parts]) - 4
        assert got(whole[:cut]) == want[: int((ends <= cut).sum())]
    damaged = gzip.compress(whole)
    assert got(damaged[:-9]) in (want, want[:5]) and got(damaged[: len(damaged) // 2]) == want[:2]
    for bad in (record(9, b"q" * 50, "many"), record(9, b"q" * 50, "-3"), b"noise\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n"):
        assert got(parts[1] + bad + parts[3] + parts[5]) == [want[1], want[3], want[5]]
    assert got(parts[1] + record(9, b"q", "9" * 30)) == [want[1]] and got(b"") == got(b"\r\n" * 9) == []
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(damaged)
    (tmp_path / "c.txt").write_bytes(whole)
    assert sorted((r.record_id, r.payload_bytes) for r in read_warc(spark, str(tmp_path)).collect()) == sorted(2 * [(i, len(p)) for i, p in want])


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    import gzip

    from gatewatch.llm import warc

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1 << 20)
    pages = spark.range(60).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(concat('page ', id, ' '), 22000) as html").coalesce(2)
    warc.write_warc(pages, str(tmp_path / "w"))
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").rglob("*.gz")]
    assert len(sizes) >= 10 and max(sizes) < (1 << 20) + 300_000
    records = warc.read_warc(spark, str(tmp_path / "w"), with_payload=False)
    assert records.groupBy("record_type").count().collect() and records.where("record_type = 'response'").count() == 60


def test_preferences(spark):
    from gatewatch.llm.preferences import format_preferences

    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "é"), (2, 0, "user", "a"), (3, 0, None, "x"), (None, 0, "user", "lost"), (4, 0, "user", "t"), (4, 0, "user", "t")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 3, "assistant", "no"), (2, 0, "user", "a"), (3, 0, None, "x"), (3, 1, "assistant", "z"), (4, 0, "user", "t"), (5, 0, "assistant", "only")]
    schema = "pair_id long, turn int, role string, text string"
    frames = [spark.createDataFrame(r, schema).withColumn("prompt", F.lit("clash")) for r in (chosen, rejected)]
    got = {r.pair_id: r for r in format_preferences(*frames).collect()}
    one = got[1]
    assert (one.n_prompt_turns, one.prompt) == (3, "<|user|>\nhi<|end|>\n<|assistant|>\nyes<|end|>\n<|user|>\n<|end|>\n")
    assert [one.chosen[s.start : s.end] for s in one.chosen_spans] == ["é<|end|>\n"] and [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["no<|end|>\n"]
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_spans) == (1, "", "", [])
    assert (got[3].prompt, got[3].rejected) == ("<|unknown|>\nx<|end|>\n", "<|assistant|>\nz<|end|>\n")
    assert (got[4].n_prompt_turns, got[4].chosen) == (1, "<|user|>\nt<|end|>\n")
    assert (got[5].n_prompt_turns, got[5].chosen) == (0, "") and set(got) == {1, 2, 3, 4, 5}
    assert format_preferences(*[f.limit(0) for f in frames]).count() == 0


def test_components_of_long_paths_and_hubs(spark):
    from gatewatch.llm.graph import components

    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (None, 3), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], T.StructType.fromDDL("a long, b long"))).count() == 0


def test_memories_of_words_and_units_are_bounded(monkeypatch):
    from gatewatch.llm import pieces
    from gatewatch.llm.queries import PIECE_MODEL
    from gatewatch.llm.words import CACHED_BYTES, WordHashes

    hashes = WordHashes()
    short, long = b"x" * CACHED_BYTES, b"x" * (CACHED_BYTES + 1)
    assert hashes.of([short, long, long]).tolist() == WordHashes().of([short, long, long]).tolist() and list(hashes) == [short]
    with open(PIECE_MODEL, "rb") as file:
        machine = pieces.PieceTransducer(file.read())
    text = "ab " + "xyz" * 400 + " ab"
    ids = machine.encode(text)
    assert machine.decode(ids) == text and machine.encode(text).tolist() == ids.tolist()
    assert len(machine.newer.keys) == 1 and machine.newer.sizes.max() <= pieces.KEPT_IDS
    monkeypatch.setattr(pieces, "CACHED_BYTES", 4000)
    draw = random.Random(2)
    texts = [" ".join(f"w{draw.randrange(3000)}é" for _ in range(60)) for _ in range(60)]
    one_by_one = [machine.encode(t).tolist() for t in texts]
    assert max(machine.older.bytes, machine.newer.bytes) < 4000 + 60 * 60
    flat, sizes = machine.encode_all([*texts, None, "", texts[0]])
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [*one_by_one, [], [], one_by_one[0]]


def test_pieces_side_by_side_follow_the_merges():
    """The walk along the border agrees with merging the joined text, for random pairs of pieces."""
    from gatewatch.llm.pieces import PieceTransducer
    from gatewatch.llm.queries import PIECE_MODEL

    with open(PIECE_MODEL, "rb") as file:
        machine = PieceTransducer(file.read())
    draw, found = random.Random(7), Counter()
    pieces = sorted(machine.ids)
    short = [p for p in pieces if len(p) < 3]
    for _ in range(4000):
        left, right = draw.choice(pieces), draw.choice(short if draw.random() < 0.5 else pieces)
        found[machine.holds(left, right)] += 1
        assert machine.holds(left, right) == (machine.merged(left + right) == [left, right])
    assert min(found[True], found[False]) > 20
