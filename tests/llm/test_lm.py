from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lateflow.llm import common, gru, lm


def small_lanes(r, vocabulary=9, bounds=(0, 2, 5), tails=3):
    lengths = np.array([4, 7, 1, 5, 3])
    n = int(lengths.sum())
    words = r.integers(-1, 5, n).astype(np.int32)
    classes = np.where(words < 0, 2 + r.integers(0, tails, n), np.where(words < 2, 0, 1)).astype(np.int32)
    return gru.Lanes(r.integers(0, vocabulary, n).astype(np.int32), classes, words, lengths, vocabulary - 1, 3), lengths


def test_gradient_by_differences():
    r = np.random.default_rng(1)
    lanes, _ = small_lanes(r)
    model = gru.Gru(9, [0, 2, 5], 3, embed=4, hidden=5, dtype=np.float64)
    for k in model.p:
        model.p[k] = r.standard_normal(model.p[k].shape) * 0.5
    h = np.zeros((lanes.shape[1], 5))
    _, _, grads, _ = model.gradient(lanes, 0, lanes.shape[0], h)
    for k, v in model.p.items():
        for at in r.integers(0, v.size, 6):
            old = v.flat[at]
            scores = []
            for step in (1e-5, -1e-5):
                v.flat[at] = old + step
                scores.append(model.gradient(lanes, 0, lanes.shape[0], h)[0])
            v.flat[at] = old
            assert abs((scores[0] - scores[1]) / 2e-5 - grads[k].flat[at]) < 1e-5, k


def test_lanes_and_windows_do_not_matter():
    r = np.random.default_rng(2)
    lanes, lengths = small_lanes(r)
    model = gru.Gru(9, [0, 2, 5], 3, embed=4, hidden=5, dtype=np.float64)
    model.p["wc"] = r.standard_normal(model.p["wc"].shape)
    want = model.score(lanes, window=100)
    assert np.allclose(want, model.score(lanes, window=2))
    begin = 0
    for n in lengths:  # each text alone
        part = slice(begin, begin + n)
        grid = lanes.cell[part]
        alone = gru.Lanes(lanes.inputs.ravel()[grid], lanes.classes.ravel()[grid], lanes.words.ravel()[grid], np.array([n]), 8, 1)
        assert np.allclose(model.score(alone), want[part])
        begin += n


def test_probabilities_sum_to_one():
    words, counts = [lm.END, b"a", b"b.", b"c", b"d.", b"ee"], [5, 40, 30, 9, 3, 1]
    by_byte = {}
    for w, c in zip(words, counts):
        s, t = by_byte.get(w[-1], (0, 0))
        by_byte[w[-1]] = (s + c, t + 1)
    v = lm.Vocabulary(words, counts, by_byte, sum(counts), len(words), shortlist=3, classes=2, tails=3)
    model = v.model()
    model.p["wc"] += np.random.default_rng(1).standard_normal(model.p["wc"].shape).astype(np.float32)
    state = np.random.default_rng(2).standard_normal((1, model.hidden)).astype(np.float32)
    total = 0.0
    for w in words:
        head = np.array([v.words[w]])
        classes, listed, _ = v.targets(head, np.array([w[-1]], np.uint8))
        p = math.exp(model.outputs(state, classes, listed)[0][0])
        total += p if listed[0] >= 0 else p * (v.count[head[0]] + 0.5) / v.z[v.tail_of[w[-1]]]
    for t in range(v.tails):  # a word never seen, in each tail class
        total += math.exp(model.outputs(state, np.array([len(v.bounds) - 1 + t]), np.array([-1]))[0][0]) * 0.5 / v.z[t]
    assert abs(total - 1) < 1e-5


def test_scores(spark):
    r = random.Random(3)
    kinds = [[f"{p}{i}{e}" for i in range(30)] for p, e in (("Den", "ung"), ("el", "ción"), ("the", "###"))]
    rows = [(i, " ".join(r.choice(kinds[i % 3]) for _ in range(r.randrange(3, 60))), 1) for i in range(400)]
    rows += [(400, None, 1), (401, "", 1), (402, "never\x0bSeen  WORDS\n", 1), (403, "x " * 3000, 1), (None, "the1###", 1), (402, "never seen", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    held = F.pmod("doc_id", F.lit(5)) == 1
    out = lm.score_documents(docs, held, head_words=60, shortlist=20, classes=4, tails=5, learn_one_in=2, group_rows=50).collect()
    assert len(out) == len(rows)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [lm.END]
    c = Counter(w for i, t, _ in rows if i is None or i % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(tokens(t)), sum(w in c for w in tokens(t)), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["n_tokens"], x["n_known"], round(x["base_score"], 6)) for x in out) == want
    assert {x["train_tokens"] for x in out} == {n}
    assert {x["doc_id"] for x in out if x["held_out"]} == {i for i, _, _ in rows if i is not None and i % 5 == 1}
    ours = [x for x in out if x["held_out"]]
    assert sum(x["score"] for x in ours) > sum(x["base_score"] for x in ours)
    assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in out)
    assert lm.score_documents(docs.limit(0), held).count() == 0


def test_every_training_document_is_learned_from(spark, monkeypatch):
    rows = [(i % 150, " ".join(f"w{(i * k) % 40}" for k in range(8))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen, train = [], lm.train

    def spy(texts, *rest):
        seen.append(texts.count())
        return train(texts, *rest)

    monkeypatch.setattr(lm, "train", spy)
    assert lm.score_documents(docs, F.col("doc_id") % 5 == 1).count() == 300
    assert seen == [sum(i % 5 != 1 for i, _ in rows)]


def test_words_beyond_the_head_keep_their_last_bytes():
    vocabulary = lm.Vocabulary([b"a.", lm.END, b"bc"], [7, 3, 2], {ord("."): (7, 1), ord("\n"): (3, 1), ord("c"): (4, 2)}, 14, 4, 2, 2, 2)
    head, last, rare = vocabulary.encode("A. é xyz\x0bBC a.".encode())
    tokens = [b"a.", "é".encode(), b"xyz", b"bc", b"a.", lm.END]
    assert head.tolist() == [vocabulary.words.get(w, -1) for w in tokens] and rare == tokens[1:3]
    assert last.tolist() == [w[-1] for w in tokens] == vocabulary.last[head].tolist()[:1] + [w[-1] for w in tokens[1:]]
    assert vocabulary.encode(b"")[0].tolist() == [0] and vocabulary.encode(b"")[2] == []


def test_columns_of_texts_are_encoded_at_once(monkeypatch):
    vocabulary = lm.Vocabulary([b"a", lm.END, b"bc", b"d"], [7, 3, 2, 1], {ord("a"): (7, 1), ord("\n"): (3, 1), ord("c"): (2, 1), ord("d"): (1, 1)}, 13, 4, 2, 2, 2)
    raw = [b"A  bC\tx", None, b"", b" \n", b"\x0bd\x1ca\x85 \xff\xc3 \x00\r\n", b"D\x0cz"]
    tokens = [[*(t or b"").lower().split(), lm.END] for t in raw]
    head, last, lengths, rare = vocabulary.encode_column(pa.array([b"cut off", *raw], pa.binary())[1:])
    assert head.tolist() == [vocabulary.words.get(w, -1) for t in tokens for w in t]
    assert last.tolist() == [w[-1] for t in tokens for w in t] and lengths.tolist() == [len(t) for t in tokens]
    assert rare.to_pylist() == [[w for w in t if w not in vocabulary.words] for t in tokens]
    of_lesson = vocabulary.encode_column(pa.array(raw, pa.binary()), lesson=True)  # only the shortlist's words are told apart
    for ours, theirs in zip(vocabulary.targets(*of_lesson[:2]), vocabulary.targets(head, last)):
        assert ours.tolist() == theirs.tolist()
    none = lm.Vocabulary([], [], {}, 0, 0, 2, 2, 2).encode_column(pa.array([b"x", None], pa.binary()))
    assert none[0].tolist() == [-1, -1, -1] and none[3].to_pylist() == [[b"x", lm.END], [lm.END]]
    monkeypatch.setattr(lm, "SLICE", 10)
    for sizes in ([4] * 10, [100, None, 1], [None, None], [], [3, 50, 3, 12], [0, 0, 30]):
        texts = [None if n is None else b"x" * n for n in sizes]
        parts = list(lm.slices([pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], ["t"])], 0))
        assert [t for p in parts for t in p.column(0).to_pylist()] == texts and all(p.num_rows for p in parts)


def test_outputs_of_any_size():
    r = np.random.default_rng(4)
    model = gru.Gru(9, [0, 2, 5, 6], 3, embed=4, hidden=5, dtype=np.float64)
    n = 700  # more than a block
    words = r.integers(-1, 6, n)
    classes = np.where(words < 0, 3 + r.integers(0, 3, n), np.searchsorted([2, 5], words, side="right"))
    states = np.append(r.uniform(-1, 1, (n, 5)), np.ones((n, 1)), 1)
    for size in (1, 40, 4_000):  # of logits: too far apart for one common greatest, then
        for k in ("wc", "wo"):
            model.p[k] = r.standard_normal(model.p[k].shape) * size
        want = np.zeros(n)
        for i, (c, w) in enumerate(zip(classes, words)):
            of_class = [(model.p["wo"][a:b], w - a) for a, b in ((0, 2), (2, 5), (5, 6)) if a <= w < b]
            for weights, at in [(model.p["wc"], c), *of_class]:
                x = weights @ states[i]
                want[i] += x[at] - x.max() - np.log(np.exp(x - x.max()).sum())
        got, _ = model.outputs(states[:, :5].copy(), classes, words)
        assert np.allclose(got, want) and np.isfinite(got).all()


def test_a_worker_keeps_one_vocabulary(monkeypatch):
    import sys

    monkeypatch.delitem(sys.modules, "lateflow_worker_state", raising=False)
    made = []
    for tag in ("x", "x", "y", "y", "x"):
        assert common.latest("vocabulary", tag, lambda: made.append(tag) or tag) == tag  # noqa: B023
    assert made == ["x", "y", "x"]
    common.release_worker()
