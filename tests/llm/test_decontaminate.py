from __future__ import annotations

import random

import numpy as np

from lateflow.llm import decontaminate as d


def naive(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = d.MATCH if a[i - 1] == b[j - 1] else d.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + d.GAP, h[i][j - 1] + d.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_scores_equal_the_table():
    r = random.Random(1)
    items, stretches = [], []
    for _ in range(150):
        a = [r.randrange(1, 6) for _ in range(r.randrange(1, 14))]
        b = [r.randrange(0, 6) for _ in range(r.randrange(1, 25))]
        if r.random() < 0.5:
            at = r.randrange(len(b) + 1)
            b[at:at] = [x for x in a if r.random() < 0.8]
        items.append(np.array(a, np.int32))
        stretches.append(np.array(b or [0], np.int32))
    scores, first, last = d.align(items, stretches)
    for a, b, s, p, q in zip(items, stretches, scores, first, last):
        assert s == naive(a.tolist(), b.tolist())
        assert s == 0 or (0 <= p < q <= len(b) and naive(a.tolist(), b[p:q].tolist()) == s)


def test_leaks_are_found_and_clean_documents_left(spark):
    r = random.Random(2)
    common = [f"c{i}" for i in range(20)]
    rare = [f"r{i}" for i in range(4000)]
    prose = lambda n: [r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(n)]
    items = [(i, prose(30)) for i in range(12)] + [(12, []), (13, None), (14, items0 := ["c1", "c2", "c3", "c4", "c5", "c6"])]
    del items0
    rows, want = [], set()
    for k in range(150):
        words = prose(r.randrange(0, 200))
        if k % 3 == 0:
            i, own = items[k % 12]
            leak = list(own)
            if k % 2:
                for at in sorted(r.sample(range(30), 5), reverse=True):
                    leak[at : at + 1] = r.choice([[], ["new"], [leak[at], "more"]])
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," if k % 5 == 0 else w for w in leak]
            want.add((k, i))
        rows.append((k, " ".join(words), 1.0))
    rows += [(500, None, 1.0), (501, "", 1.0), (None, " ".join(items[0][1]), 1.0), (0, rows[0][1], 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    bench = spark.createDataFrame([(i, None if w is None else " ".join(w)) for i, w in items], "item_id long, text string")
    for block in (20_000, 5):
        out = d.find_contamination(docs, bench, block_items=block).collect()
        got = {(x["doc_id"], x["item_id"]) for x in out if x["item_id"] != 14}
        assert got == want | {(None, 0)}
        assert sum(x["doc_id"] == 0 and x["item_id"] == 0 for x in out) == 2  # the repeated row
        assert all(x["score"] >= 0.5 and x["start_word"] < x["end_word"] for x in out)
    assert d.find_contamination(docs.limit(0), bench).count() == 0
    assert d.find_contamination(docs, bench.limit(0)).count() == 0


def test_frequent_leaks_keep_their_seeds(spark):
    """A passage that half of all documents hold is still found in each."""
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(40)) + (" " + passage if i % 2 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert {x["doc_id"] for x in d.find_contamination(docs, bench).collect()} == {i for i in range(400) if i % 2}


def test_words_of_punctuation_alone(spark):
    """Spaced maths and code match their exact copies in full, and copies whose signs are set otherwise."""
    r = random.Random(4)
    prose = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    items = ["if ( a == b ) { return c ; } else { return d ; }", "x = y + z - u * v / t", "( ( ( ( ( p ) ) ) ) ) + ( ( ( q ) ) ) = ( ( ( s ) ) )", "= = ="]
    rows = [(i, f"{prose(20)} - {prose(20)} {items[i % 3]} {prose(30)}") for i in range(6)]
    rows += [(6, f"{prose(40)} if (a == b) {{ return c; }} else {{ return d; }} {prose(9)}")] + [(i, prose(60) + " = = = +") for i in range(7, 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = {(x["doc_id"], x["item_id"]): x for x in d.find_contamination(docs, bench).collect()}
    assert set(out) == {(i, i % 3) for i in range(6)} | {(6, 0)}
    assert all(x["score"] == 1 for x in out.values())
    for (doc, item), x in out.items():  # the places count all words, those of punctuation alone too
        inner = rows[doc][1].split()[x["start_word"] : x["end_word"]]
        cores = lambda words: [w for y in words if (w := y.strip("(){};=+-*/"))]
        assert cores(inner) == cores(items[item].split()) and inner[0] and inner[-1]
