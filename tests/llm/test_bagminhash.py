"""Signatures against the weighted Jaccard similarity, and groups against all pairs."""

import random
from collections import Counter

import numpy as np

from mediaseries.llm import bagminhash as module
from mediaseries.llm.bagminhash import bagminhash, near_duplicates
from mediaseries.llm.components import components
from mediaseries.llm.words import mix, split_words

SCHEMA = "doc_id long, text string, extra int"


def runs(text):
    words = split_words(text)
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    common = sum((a & b).values())
    return common / max(1, sum((a | b).values()))


def plain_groups(rows):
    """class of each id by comparing all pairs."""
    parent = {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    held = [(i, runs(t)) for i, t in rows]
    for k, (i, a) in enumerate(held):
        for j, b in held[:k]:
            if a and b and similarity(a, b) >= 0.8 and top(i) != top(j):
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    return {i: top(i) for i, _ in rows}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    for shared, only, weight in ((40, 10, 1), (10, 30, 5), (3, 2, 40), (1, 1, 1)):
        elements = mix(np.arange(shared + 2 * only, dtype=np.uint64) + np.uint64(rng.integers(1 << 40)))
        first, second = np.arange(shared + only), np.r_[np.arange(shared), np.arange(shared + only, shared + 2 * only)]
        a, b = rng.integers(1, weight + 1, len(elements)), rng.integers(1, weight + 1, len(elements))
        low = high = 0
        for k in range(len(elements)):
            x, y = (a[k] if k in first else 0), (b[k] if k in second else 0)
            low, high = low + min(x, y), high + max(x, y)
        text = np.r_[np.zeros(len(first), int), np.ones(len(second), int)]
        found = bagminhash(text, elements[np.r_[first, second]], np.r_[a[first], b[second]], 2, 4096)
        assert abs((found[0] == found[1]).mean() - low / high) < 5 * (0.25 / 4096) ** 0.5


def test_signature_does_not_depend_on_neighbours():
    elements = mix(np.arange(50, dtype=np.uint64))
    weights = np.arange(50) % 4 + 1
    alone = bagminhash(np.zeros(50, int), elements, weights, 1, 64)
    among = bagminhash(np.r_[np.zeros(1, int), np.full(50, 1)], np.r_[elements[:1], elements], np.r_[1, weights], 3, 64)
    assert (among[1] == alone[0]).all() and (among[2] == 0).all()


def documents(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(text)))
    repeated = " ".join(["a b c d e f"] * 30)
    rows += [(1001, repeated), (1002, repeated + " a b c d"), (1003, "a b c d e f g"), (1004, ""), (1005, None), (1006, "!!"), (1007, "Only, Three words")]
    rows += [(1008, "only three words")]
    rng.shuffle(rows)
    return rows


def test_groups_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 4)
    rows = documents(5)
    want = plain_groups(rows)
    got = near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows], SCHEMA)).collect()
    assert {r["id"]: r["class_id"] for r in got} == want and len(got) == len(rows)
    assert {r["id"]: r["n_words"] for r in got} == {i: len(split_words(t)) for i, t in rows}


def test_odd_rows(spark):
    rows = [(5, "one two three four five six", 1), (5, "one two three four five six", 2), (9, "one two three four five six", None), (None, "seven eight", 1), (None, "seven eight", 2), (None, None, 3)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["class_id"] for r in got if r["id"] >= 0) == [5, 5, 5]
    assert len([r for r in got if r["id"] < 0]) == 3 and len({r["class_id"] for r in got if r["id"] < 0}) == 2
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (20, 20), (None, 3), (4, 1), (100, 99)] + [(k, k + 1) for k in range(200, 240)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 99: 99, 100: 99} | {k: 200 for k in range(200, 241)}


def test_few_components_lose_no_pair(spark):
    """Pairs of 0.77 amid texts of 0.62, by signatures too short to rule a pair out."""
    rng = random.Random(8)
    words = lambda n: ["w%d" % rng.randrange(10**9) for _ in range(n)]
    core, rows = words(150), []
    for k in range(40):
        shared = words(20)
        rows += [(2 * k + side, " ".join(core + shared + words(25)), 1) for side in (0, 1)]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), similar=0.7, bands=6, rows=1).collect()
    assert {r["id"]: r["class_id"] for r in got} == {i: i - i % 2 for i, _, _ in rows}
