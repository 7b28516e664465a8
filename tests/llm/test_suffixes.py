from __future__ import annotations

import hashlib
import random

import pytest

from lateflow.llm import suffixes


def brute(texts, width):
    where = {}
    for i, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            where.setdefault(t[s : s + width], []).append((i, s))
    gone = [bytearray(len(t)) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + width] = b"\1" * width
    out = []
    for t, g in zip(texts, gone):
        rest = bytes(b for b, x in zip(t, g) if not x)
        out.append((len(t), sum(g), len([1 for x, y in zip(b"\0" + g, g) if y and not x]), hashlib.sha256(rest).hexdigest()))
    return out


def brute_first(texts, width):
    """As ``brute``, but only windows that have started before, in text order, go; of equal texts all but the first."""
    seen, gone, whole = set(), [], {}
    for i, t in enumerate(texts):
        own = bytearray(len(t))
        if t in whole and len(t) >= width:
            own = bytearray(b"\1" * len(t))
        else:
            whole[t] = i
            for s in range(len(t) - width + 1):
                w = t[s : s + width]
                if w in seen:
                    own[s : s + width] = b"\1" * width
                seen.add(w)
        gone.append(own)
    return [(len(t), sum(g), hashlib.sha256(bytes(b for b, x in zip(t, g) if not x)).hexdigest()) for t, g in zip(texts, gone)]


def corpus(seed, width):
    r = random.Random(seed)
    noise = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    passages = [noise(r.randrange(width // 2, width * 4)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = noise(r.randrange(0, width * 2))
        for _ in range(r.choice([0, 0, 1, 2])):
            p = r.choice(passages)
            t += p[r.randrange(10) * r.choice([0, 1]) : len(p) - r.randrange(10) * r.choice([0, 1])] + noise(r.randrange(width))
        texts.append(t)
    near = bytearray(noise(width * 5))
    for _ in range(8):
        copy = bytearray(near)
        copy[r.randrange(len(copy))] = ord("Z")
        texts.append(bytes(copy))
    return texts + [texts[3], texts[3], b"", b"a" * width * 3, b"b" * (width + 1), b"ab" * width, noise(width - 1)] + [noise(3) + passages[0] + noise(3) for _ in range(40)]


def test_deep_shallow_order():
    r = random.Random(2)
    for alphabet in (b"ab", b"a", bytes(range(256))):
        for _ in range(60):
            stem = bytes(r.choice(alphabet) for _ in range(200))
            strings = [stem[: r.randrange(200)] + bytes(r.choice(alphabet) for _ in range(r.randrange(40))) for _ in range(r.randrange(1, 40))]
            strings += strings[:3]
            order, lcp = suffixes.deep_shallow(strings, r.choice([0, 8, 64]))
            assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
            for k, (i, j) in enumerate(zip(order, order[1:])):
                a, b = strings[i], strings[j]
                assert lcp[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_every_window_has_one_anchor():
    texts = [t for t in corpus(5, 60)]
    text, h, pos, lo, hi = suffixes.find_anchors(texts, 60, 8)
    starts = {}
    for i, g, p, a, b in zip(text.tolist(), h.tolist(), pos.tolist(), lo.tolist(), hi.tolist()):
        for s in range(p - b, p - a + 1):
            assert (i, s) not in starts and s <= p <= s + 52
            starts[i, s] = (g, p - s)
    assert set(starts) == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 59)}
    by = {}
    for (i, s), key in starts.items():
        assert by.setdefault(texts[i][s : s + 60], key) == key


@pytest.mark.parametrize("seed,width,hot", [(1, 60, 20_000), (2, 40, 20_000), (3, 50, 5)])
def test_against_brute_force(spark, seed, width, hot):
    texts = corpus(seed, width)
    want = brute(texts, width)
    docs = spark.createDataFrame([(i, t.decode(), "x") for i, t in enumerate(texts)] + [(len(texts), None, "y")], "doc_id long, text string, key string").repartition(4)
    got = {r[0]: tuple(r[1:5]) for r in suffixes.remove_repeats(docs, width, gram=8, hot_rows=hot).collect()}
    assert got.pop(len(texts)) == (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert [got[i] for i in range(len(texts))] == want


def test_large_groups(monkeypatch, spark):
    monkeypatch.setattr(suffixes, "SMALL", 1)
    r = random.Random(7)
    group = []
    for _ in range(30):
        lo, hi = sorted(r.sample(range(0, 12), 2))
        context = bytes(r.choice(b"ab") for _ in range(hi)) + b"XXXX" + bytes(r.choice(b"ab") for _ in range(16 - lo - 4))
        group.append((context, lo, hi))
    group = list(dict.fromkeys(group))
    large = suffixes.shared_starts(group, 16)
    monkeypatch.setattr(suffixes, "SMALL", 1000)
    assert large == suffixes.shared_starts(group, 16)


def test_kept_text_drops_split_characters(spark):
    passage = "é" * 30
    docs = spark.createDataFrame([(1, "aé" + passage), (2, "b" + passage), (3, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_text"] for r in suffixes.remove_repeats(docs, 21, gram=8, kept_text=True).collect()}
    assert got[3] == "short" and set(got[1]) <= {"a", "é"} and got[2] == "b"
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def brute_words(texts, width, words):
    """Kept texts by ``width`` bytes or ``words`` words; the space between two words that go as words goes too."""
    import re

    where, places_of = {}, []
    gone, out_words = [bytearray(len(t)) for t in texts], [set() for _ in texts]
    for i, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            where.setdefault(t[s : s + width], []).append((i, s, s + width, None))
        own = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\f]+", t)]
        for k in range(len(own) - words + 1):
            run = own[k : k + words]
            where.setdefault(tuple(t[a:b] for a, b in run), []).append((i, run[0][0], run[-1][1], k))
        places_of.append(own)
    for places in where.values():
        if len(places) > 1:
            for i, a, b, k in places:
                gone[i][a:b] = b"\1" * (b - a)
                out_words[i] |= set(range(k, k + words)) if k is not None else set()
    for g, own, went in zip(gone, places_of, out_words):
        for k in went:
            if k + 1 in went:
                a, b = own[k][1], own[k + 1][0]
                g[a:b] = b"\1" * (b - a)
    return [bytes(b for b, x in zip(t, g) if not x).decode() for t, g in zip(texts, gone)]


@pytest.mark.parametrize("hot_rows", [20_000, 2])
def test_runs_of_words(spark, hot_rows):
    """Runs of words of every length around the limit, at ends, between other spaces, and beside byte strings."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.choice([1, 1, 2, 5])))
    prose = lambda n: [word() for _ in range(n)]
    shared = [prose(n) for n in (10, 11, 12, 13, 20, 40)] + [["y"] * 12, [w for _ in range(3) for w in "p q r s".split()]]
    texts = []
    for _ in range(90):
        w = prose(r.randrange(25))
        for _ in range(r.choice([0, 1, 2])):
            at = r.choice([0, len(w), r.randrange(len(w) + 1)])
            w[at:at] = r.choice(shared)
        texts.append(r.choice([" ", " ", "\n", " \t"]).join(w))
    texts += [" ".join(shared[5]), " ".join(shared[5]), "", "x" * 90 + " tail", "z " + "x" * 90, " ".join(shared[0]), " ".join(shared[0])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = {x["doc_id"]: x["kept_text"] for x in suffixes.remove_repeats(docs, width=80, words=12, kept_text=True, gram=16, hot_rows=hot_rows).collect()}
    want = brute_words([t.encode() for t in texts], 80, 12)
    assert [out[i] for i in range(len(texts))] == want
    assert want[-2] == texts[-2] and not want[90] and any(0 < len(w) < len(t) for w, t in zip(want, texts))


@pytest.mark.parametrize("seed,hot_rows", [(1, 20_000), (2, 20_000), (3, 3)])
def test_first_places_stay(spark, seed, hot_rows):
    """With ``keep_first`` a string goes where it has started before: every string of the input is still somewhere in the output."""
    width = 40
    texts = corpus(seed, width)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    out = suffixes.remove_repeats(docs, width=width, gram=8, hot_rows=hot_rows, keep_first=True, kept_text=True).collect()
    got = [(x["n_bytes"], x["n_removed"], x["kept_sha256"]) for x in sorted(out, key=lambda x: x["doc_id"])]
    assert got == brute_first(texts, width)
