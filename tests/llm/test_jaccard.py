from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lateflow.llm import jaccard
from lateflow.llm.components import components


def shingle_sets(texts, n):
    out = []
    for t in texts:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    return out


def brute(ids, texts, n, part, whole):
    sets = shingle_sets(texts, n)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and whole * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, d in enumerate(ids))


def corpus(seed, size=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 6, 9, 14, 30, 60, 150, 400]))] for _ in range(25)]
    texts = []
    for _ in range(size):
        words = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
            at = r.randrange(len(words) + 1)
            words[at : at + r.choice([0, 1])] = [r.choice(vocabulary)] * r.choice([0, 1])
        texts.append(r.choice([" ", "\n", "  "]).join(words) if words else "")
    return texts + [None, "", " \n ", "É É É É É", "é é é é é", "A b C d", "a B c D"]


@pytest.mark.parametrize("part,whole", [(85, 100), (4, 5)])
def test_linked_sets_share_a_signature(part, whole):
    r = np.random.default_rng(1)
    bands, n = jaccard.Bands(part, whole), 0
    for _ in range(3000):
        size = int(r.choice([1, 2, 6, 7, 8, 12, 13, 20, 26, 40, 80, 200, 700]))
        a = np.unique(r.integers(0, 2**64, size, np.uint64))
        drop, add = r.integers(0, max(1, size // 6) + 1, 2)
        b = np.unique(np.concatenate([a[drop:] if r.random() < 0.5 else r.permutation(a)[drop:], r.integers(0, 2**64, add, np.uint64)]))
        if len(a) and len(b) and jaccard.linked(a, b, part, whole):
            n += 1
            assert set(bands.signatures(a).tolist()) & set(bands.signatures(b).tolist()), (len(a), len(b))
    assert n > 300


@pytest.mark.parametrize("seed,n,part,whole", [(1, 4, 85, 100), (2, 5, 4, 5), (3, 3, 7, 10)])
def test_components_equal_brute_force(spark, seed, n, part, whole):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(10_000), len(texts))
    docs = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts)], "doc_id long, text string, node int").repartition(5)
    got = sorted(tuple(r) for r in jaccard.jaccard_components(docs, n, part, whole).collect())
    assert got == brute(ids, texts, n, part, whole)


@pytest.mark.parametrize("limit", [8_192, 5])
def test_rounds_of_resolve(spark, monkeypatch, limit):
    """Sets around one centre that link with it but not with each other, and a null id; once as a cluster beyond the limit."""
    monkeypatch.setattr(jaccard.resolve, "__defaults__", (limit, 8))
    monkeypatch.setattr(jaccard.compare_blocks, "__defaults__", (7,))
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)]
    for k in range(40):
        words = list(base)
        for at in r.sample(range(0, 120, 4), 2):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    ids = list(range(len(texts)))
    docs = spark.createDataFrame([*zip(ids, texts), (None, "alone in the world")], "doc_id long, text string")
    got = sorted(tuple(x) for x in jaccard.jaccard_components(docs, 4, 80, 100).collect() if x[0] is not None)
    assert got == brute(ids, texts, 4, 80, 100)
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_linked_pairs_equal_single_comparisons():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 60), np.uint64)) for _ in range(40)]
    for columns in (7, 8192):
        got = jaccard.linked_pairs(sets[:25], sets[20:], 1, 2, columns)
        assert got == [[i, j] for i, a in enumerate(sets[:25]) for j, b in enumerate(sets[20:]) if jaccard.linked(a, b, 1, 2)]


def test_connected_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_words_are_hashed_at_once():
    """Equal words hash alike wherever they stand and whatever the block, others apart; a text's sets follow."""
    from lateflow.llm.common import WordHasher

    r = random.Random(9)
    words = [b"", *(bytes(r.choice(b"ab\x00\x85\xff") for _ in range(r.choice([1, 2, 3, 9, 70]))) for _ in range(3000)), b"w" * 70_000]
    whole, short = WordHasher(), WordHasher(block=16)
    for some in ([], words, words[::-1]):
        text = b"".join(w + bytes([r.choice(b"\t\n\x0b\x0c\r ")]) for w in some)
        got = whole.words(text).tolist()
        assert got == short.words(text).tolist()
        assert len(got) == len(text.split()) and len(set(zip(text.split(), got))) == len(set(got)) == len(set(text.split()))
    shingler = jaccard.Shingler(3)
    a, b = (shingler.hashes(t) for t in (b"A b  c\nd e", b"x b c d e"))
    assert len(a) == len(b) == 3 and len(np.intersect1d(a, b)) == 2 and (np.sort(a) == a).all()
    assert len(shingler.hashes(b"one two")) == 1 and not len(shingler.hashes(b" \n"))
