"""Toxicity and quality: exact inference, held-out accuracy, and odd rows."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lateflow.llm import quality, toxicity


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    chain = toxicity.Chain()
    chain.move = r.standard_normal((2, 2))
    lengths = np.array([4, 0, 1, 6, 2])
    e = r.standard_normal(int(lengths.sum())) * 2
    got, begin = chain.marginals(e, lengths), 0
    for n in lengths:
        own, total, by = e[begin : begin + n], 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(own[t] * y[t] for t in range(n)) + sum(chain.move[a, b] for a, b in zip(y, y[1:])))
            total += w
            by += w * np.array(y)
        assert np.allclose(got[begin : begin + n], by / total)
        begin += n


def test_training_raises_the_likelihood_of_labels():
    r = random.Random(2)
    lines = [[r.choice([b"bad", b"fine", b"good", b"ugly"]) for _ in range(r.randrange(2, 9))] for _ in range(200)]
    labels = [[int(w in (b"bad", b"ugly")) for w in line] for line in lines]
    chain = toxicity.Chain()
    chain.train([[toxicity.features(w) for w in line] for line in lines], labels)
    lengths = np.array([len(x) for x in lines])
    e = np.array([chain.emit[toxicity.features(w)].sum() for line in lines for w in line])
    p = chain.marginals(e, lengths)
    assert np.array_equal(p > 0.5, np.array(sum(labels, [])) == 1)


def corpus(seed, n=900):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("th", "er", "an", "ou") for b in ("in", "on", "re", "ed") for c in ("", "s", "ly", "ha", "st")]
    bad = ["idiotic", "wretchly", "wretchen", "wretchum", "wretchor", "scummy"]
    rows, labels = [], []
    for i in range(n):
        toxic, good = int(r.random() < 0.15), int(r.random() < 0.7)
        text = [r.choice(words) for _ in range(r.randrange(3, 80))]
        for _ in range(toxic * r.randrange(1, 4)):
            text.insert(r.randrange(len(text) + 1), r.choice(bad) + r.choice(["", ",", "."]))
        if not good:
            text = r.choice([lambda x: [w.upper() + "!!" for w in x], lambda x: [w + "###" for w in x], lambda x: x[:2] * 20])(text)
        rows.append((i, " ".join(text), "en"))
        labels.append((i, good, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus(3)
    docs = spark.createDataFrame([*rows, (9001, None, "en"), (9002, "", "en"), (None, "an idiotic wretchzz", "en"), (1, rows[1][1], "en")], "doc_id long, text string, n_toxic string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks.where("doc_id % 5 <> 0"))
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == len(rows) + 4 and all(0 <= x["score"] <= 1 for x in out)
    truth = {i: t for i, _, t in labels}
    held = [x for x in out if x["doc_id"] is not None and x["doc_id"] < 9000 and x["doc_id"] % 5 == 0]
    assert sum((x["score"] >= 0.5) == truth[x["doc_id"]] for x in held) >= 0.97 * len(held)
    text = {i: (t or "").encode() for i, t, _ in rows}
    spans = [(x["doc_id"], text[x["doc_id"]][s["start"] : s["end"]].lower()) for x in held for s in x["spans"]]
    assert sum(s.startswith((b"idiot", b"wretch", b"scum")) for _, s in spans) >= 0.9 * len(spans) > 0
    unseen = next(x for x in out if x["doc_id"] is None)
    assert unseen["score"] >= 0.5 and unseen["n_toxic"] >= 1  # a new form of a known stem
    assert all(x["score"] < 0.5 for x in out if x["doc_id"] in (9001, 9002))
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for marks, score in (([], 0.0), ([(1, 0)], 0.0), ([(1, 1)], 1.0)):
        model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert [r["score"] for r in toxicity.score_toxicity(docs, model).collect()] == [score, score]


def test_quality_on_held_out_rows(spark):
    rows, labels = corpus(4)
    docs = spark.createDataFrame([*rows, (9001, None, "en"), (9002, "", "en"), (None, "a b", "en"), (1, rows[1][1], "en")], "doc_id long, text string, score string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, marks.where("doc_id % 3 <> 1"))
    assert 0 < len(model.rules) < 60 and all(str(r) for r in model.rules)
    scored = quality.score_quality(docs, model)
    assert "Python" not in scored._jdf.queryExecution().executedPlan().toString()
    out = scored.collect()
    assert len(out) == len(rows) + 4 and all(0 <= x["score"] <= 1 for x in out)
    truth = {i: q for i, q, _ in labels}
    held = [x for x in out if x["doc_id"] is not None and x["doc_id"] < 9000 and x["doc_id"] % 3 == 1]
    assert sum((x["score"] >= 0.5) == truth[x["doc_id"]] for x in held) >= 0.95 * len(held)
    assert quality.score_quality(docs.limit(0), model).count() == 0
    nothing = quality.train(docs, marks.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, nothing).collect()} == {0.5}


def test_compiled_rules_equal_the_model(spark):
    r = np.random.default_rng(5)
    x = r.random((400, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)).astype(int)
    model = quality.fit(x, y, ["a", "b", "c"])
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    got = np.array([v[0] for v in df.select(model.score({c: F.col(c) for c in "abc"})).collect()])
    want = np.full(len(x), model.base)
    for rule in model.rules:
        holds = np.ones(len(x), bool)
        for name, above, at in rule.terms:
            v = x[:, "abc".index(name)]
            holds &= (v > at) if above else (v <= at)
        want += rule.weight * holds
    assert np.allclose(got, 1 / (1 + np.exp(-want)))
    assert ((got >= 0.5) == y).mean() > 0.95
