"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import HARD, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from thermolith.llm import exact_dedup, near_dedup
from thermolith.llm.components import components


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@given(st.lists(st.tuples(st.sampled_from("idg"), st.integers(0, 60)), max_size=300))
@settings(max_examples=60, deadline=None)
def test_cuckoo_index_behaves_as_a_dictionary(steps):
    index, plain = exact_dedup.CuckooIndex(1), {}
    for n, (what, i) in enumerate(steps):
        key = hashlib.sha256(bytes([i])).digest()
        if what == "i":
            index.insert(key, n)
            plain[key] = n
        elif what == "d":
            assert index.delete(key) == (plain.pop(key, None) is not None)
        assert index.get(key) == plain.get(key)
    assert dict(index.items()) == plain and len(index) == len(plain)


def test_cuckoo_fingerprints_that_collide_and_growth():
    index = exact_dedup.CuckooIndex(1)
    keys = [b"\x01\x02" + bytes(8) + i.to_bytes(4, "big") + bytes(18) for i in range(8)]  # one fingerprint, one bucket pair
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert [index.get(k) for k in keys] == list(range(8))
    many = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for k in many:
        index.insert(k, 1)
    assert len(index) == 5008 and all(index.get(k) for k in many)


def test_marks_equal_brute_force(hard, nothing):
    rows = exact_dedup.mark_duplicates(hard).collect()
    groups = {}
    for i, t, _ in HARD:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i or 0))
    want = Counter()
    for i, t, _ in HARD:
        g = groups[normal(t)]
        named = [x for x in g if not x[1]]
        keep = min(named)[2] if named else None
        want[(i, keep, len(g), i == keep, hashlib.sha256(normal(t).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert exact_dedup.mark_duplicates(nothing).count() == 0


def test_drop_keeps_one_row_of_each(hard, nothing):
    kept = exact_dedup.drop_duplicates(hard)
    assert kept.columns == hard.columns
    rows = kept.collect()
    assert sorted(normal(r["text"]) for r in rows) == sorted({normal(t) for _, t, _ in HARD})
    assert 8 not in {r["doc_id"] for r in rows} or 10 not in {r["doc_id"] for r in rows}
    assert exact_dedup.drop_duplicates(nothing).count() == 0


def test_replayed_deletions(spark):
    log = [(1, "insert", 1, "a b"), (2, "insert", 2, "ab"), (3, "delete", 1, "a b"), (4, "delete", 9, "zz"), (5, "insert", 3, "c"), (6, "delete", 3, "c"), (7, "insert", 3, "c c"), (8, "insert", None, None)]
    alive = exact_dedup.live(spark.createDataFrame(log, "seq bigint, action string, doc_id bigint, text string"))
    assert Counter(r["doc_id"] for r in alive.collect()) == Counter([2, 3, None])
    found = {bytes(r["key"]): (r["n"], r["keep_id"]) for r in exact_dedup.classes(alive).collect()}
    assert found[hashlib.sha256(b"ab").digest()] == (1, 2) and len(found) == 3


def grams(text, n=5):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(pairs, threshold=0.8):
    """Class (smallest id) and links of each row."""
    sets = [grams(t) for _, t, _ in pairs]
    root, links = list(range(len(pairs))), [0] * len(pairs)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = {}
    for i in range(len(pairs)):
        members.setdefault(find(i), []).append(pairs[i][0])
    smallest = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return Counter((pairs[i][0], smallest[find(i)], links[i]) for i in range(len(pairs)))


def edited(text, seed, times):
    r, w = np.random.default_rng(seed), text.split()
    for _ in range(times):
        w[r.integers(len(w))] = f"new{r.integers(1000)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(documents, hard, nothing):
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(hard).collect()) == brute(HARD)
    assert near_dedup.near_duplicates(nothing).count() == 0
    pairs = [(g * 100 + i, edited(sentence(1000 + g, 60 + 40 * g), g * 100 + i, i % 5), "a") for g in range(8) for i in range(12)]
    found = near_dedup.near_duplicates(documents(pairs)).collect()
    assert Counter(tuple(r) for r in found) == brute(pairs)


def test_groups_larger_than_a_block(documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near_dedup, "PAIRS_EACH", 100)
    base = sentence(77, 120)
    pairs = [(i, edited(base, i, 1), "a") for i in range(90)] + [(1000 + i, base, "a") for i in range(20)] + [(2000, sentence(78, 120), "a")]
    found = near_dedup.near_duplicates(documents(pairs)).collect()
    assert Counter(tuple(r) for r in found) == brute(pairs)


def test_one_of_each_stays(documents, hard, nothing):
    kept = near_dedup.keep_one_of_each(hard)
    assert kept.columns == hard.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    # rows without words stay; the 7s differ in text; of the class of 8, 9, 10 and the rows without id, 8 stays
    assert ids == Counter([1, 2, 3, 4, 5, 6, 7, 7, 8, 11, 1 << 60, -5])
    assert near_dedup.keep_one_of_each(nothing).count() == 0
    plain = [(i, sentence(i, 50), "a") for i in range(30)]
    assert near_dedup.keep_one_of_each(documents(plain)).count() == 30


def test_pruning_keeps_what_reaches_the_threshold():
    least = near_dedup.least_matches(0.8, 1e-5)
    assert list(least) == list(range(16, 129, 16)) and all(0 < m < n for n, m in least.items())
    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, 128, dtype=np.uint8)
    rows = np.tile(base, (400, 1))
    changed = rng.random(rows.shape) < 0.1  # two rows agree in about 81 of 100 values
    rows[changed] = rng.integers(0, 256, changed.sum(), dtype=np.uint8)
    pairs = np.triu_indices(400, 1)
    assert len(near_dedup.surviving(rows, *pairs, least)[0]) > 0.999 * 400 * 399 / 2
    both = np.concatenate([rows, rng.integers(0, 256, (400, 128), dtype=np.uint8)])
    assert not len(near_dedup.surviving(both, np.repeat(np.arange(400), 400), np.tile(np.arange(400, 800), 400), least)[0])


def test_pruning_chooses_what_is_verified(documents):
    """A chain of texts that drift: neighbours are alike, most pairs aren't, and only pairs that pruning leaves are verified."""
    words, pairs = sentence(5, 300).split(), []
    for i in range(400):
        words[i * 7 % 300] = f"drift{i}"
        pairs.append((i, " ".join(words), "a"))
    sets = [near_dedup.shingles(t) for _, t, _ in pairs]
    values = np.array([near_dedup.minhash(x, *near_dedup._permutations()) for x in sets])
    marks, least = values.astype(np.uint8), near_dedup.least_matches(near_dedup.THRESHOLD, near_dedup.TOLERANCE)
    first, second = near_dedup.surviving(marks, *np.triu_indices(400, 1), least)
    exact = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(first, second, strict=True)]
    links = sum(c >= 0.8 * (len(sets[i]) + len(sets[j]) - c) for i, j, c in zip(first, second, exact, strict=True))
    assert links <= len(first) < 0.15 * 400 * 399 / 2
    found = near_dedup.near_duplicates(documents(pairs)).collect()
    assert Counter(tuple(r) for r in found) == brute(pairs)
    strict = near_dedup.near_duplicates(documents(pairs), tolerance=0.999).collect()  # what pruning drops is never linked
    assert sum(r["n_links"] for r in strict) < links < sum(r["n_links"] for r in found)


@pytest.mark.parametrize("dense", [2, 10_000])
def test_both_ways_of_counting_common_grams(monkeypatch, dense):
    monkeypatch.setattr(near_dedup, "DENSE", dense)
    monkeypatch.setattr(near_dedup, "PAIRS_EACH", 50)
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(80)]
    task = np.repeat([0, 1, 4, 5], 20)
    first, second = (np.concatenate(x) for x in zip(*((np.array(np.triu_indices(20, 1)) + 20 * k) for k in range(4)), strict=True))
    got = set(zip(*near_dedup.verified(sets, task, first, second, 0.4), strict=True))
    want = {(i, j) for i, j in zip(first, second, strict=True) if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.4 * (len(sets[i]) + len(sets[j]) - c)}
    assert got == want and want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (5, 5), (7, 8)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_links_that_come_out_differently_each_time(spark):
    def stars(batches):
        import random

        import pandas as pd

        for batch in batches:
            nodes = batch["id"].tolist()
            for k in range(0, len(nodes), 10):
                own = nodes[k : k + 10]
                centre = random.SystemRandom().choice(own)
                yield pd.DataFrame({"u": [centre] * len(own), "v": own})

    links = spark.range(0, 200, 1, 4).mapInPandas(stars, "u long, v long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {i: i // 10 * 10 for i in range(200)}


def test_longest_row_of_a_repeated_id_stays(documents):
    pairs = [(i, "a b" + " " * (k * 7 % 10), "s") for i in (5, None) for k in range(10)] + [(6, "xy", "s")]
    pairs = [(i, t if i is not None else t + "z", s) for i, t, s in pairs]
    kept = exact_dedup.drop_duplicates(documents(pairs).repartition(3)).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in kept) == [(0, 13), (5, 12), (6, 2)]
