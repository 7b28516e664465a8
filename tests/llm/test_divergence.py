from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateflow.llm import divergence as d


def brute(rows: list[tuple], min_docs: int, top: int) -> list[tuple]:
    """``rows``: text, lang, source."""
    per, docs, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        per[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= min_docs)
        own = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        of = {s: shares(per[lang, s]) for s in own}
        q = shares(sum((per[lang, s] for s in own), Counter()))
        for s in own:
            pairs = sorted((-sum(abs(of[s][t] - of[x][t]) for t in kept), x.encode(), x) for x in own if x != s)
            over = sorted((q[t] - of[s][t], t.encode(), t) for t in kept if per[lang, s][t] and of[s][t] > q[t])[:top]
            out += [(lang, s, "pair", x, -v, k + 1) for k, (v, _, x) in enumerate(pairs)]
            out += [(lang, s, "term", x, -v, k + 1) for k, (v, _, x) in enumerate(over)]
    return sorted(out)


def rows_of(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    stems = ["a", "ab", "abc", "abcd", "abcde", "abcdefghij" * 3, "Été", "ÉTÉ", "über", "ü", "x1y", "the"]
    word = lambda: r.choice(stems) + r.choice(["", "", "s", "S", "ing", "é", f"t{r.choice('xyz')}"])
    out = [(r.choice([" ", "-", "9"]).join(word() for _ in range(r.randrange(0, 40))), r.choice(["en", "en", "de", ""]), r.choice(["s1", "s2", "s3", "É", None])) for _ in range(n)]
    return out + [(None, "en", "only null"), ("", "xx", "no terms"), (None, None, None), ("zz zz", "rare", "a"), ("qq", "rare", "b"), ("the " * 400_000 + "end", "de", "long")]


@pytest.mark.parametrize("n,min_docs,options", [(300, 5, {}), (300, 9, {"chunk_bytes": 300, "filter_bits": 128, "block_rows": 20, "tile_sources": 2}), (60, 30, {"chunk_bytes": 50})])
def test_equals_brute_force(spark, n, min_docs, options):
    """With tiny chunks, a filter that lets nearly all through, blocks and tiles the rows are the same."""
    rows = rows_of(n + min_docs, n)
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "text string, lang string, source string, item string").repartition(4)
    out = d.audit(docs, min_docs=min_docs, top=7, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == brute(rows, min_docs, 7)


def test_refinement_discards_prefixes(spark):
    """Prefixes count each document once, rare ones are not extended, and rare terms with a frequent prefix go at a later level."""
    texts = [f"common abcab abcac rare{i:c}" if i >= 97 else "common" for i in range(90, 110)]
    docs = spark.createDataFrame([(t, "en", "s") for t in texts], "text string, lang string, source string")
    chunks = docs.coalesce(1).mapInArrow(d._pack(1 << 20), d.CHUNK)
    found = {bytes(x["prefix"]): x["docs"] for x in d.iceberg_terms(chunks, min_docs=13).collect()}
    assert found == {b"common": 20, b"abcab": 13, b"abcac": 13}
    one = {bytes(x["prefix"]): x["docs"] for x in chunks.mapInArrow(d._level(0, 2, None), "lang string, whole boolean, prefix binary, docs long").collect()}
    assert one == {b"co": 20, b"ab": 13, b"ra": 13}  # two terms of one document count once


def test_filter_never_misses(spark):
    keys = [("en", f"t{i}".encode()) for i in range(500)] + [("", b"abcdefghi"), ("", b"x" * 70), ("É", "ü".encode())]
    kept = d.Filter.of(spark.createDataFrame(keys, "lang string, prefix binary").repartition(3), 1 << 16)
    langs = ["", "de", "en", "É"]
    look = lambda keys: kept.holds(d.hashes(langs, np.array([langs.index(k) for k, _ in keys]), *d.padded([p for _, p in keys])))
    assert look(keys).all()
    assert look([("en", f"n{i}".encode()) for i in range(1000)]).sum() < 30 and look([("de", f"t{i}".encode()) for i in range(500)]).sum() < 20


def test_large_counts_are_exact(spark):
    big = 3 * 10**13
    row = spark.createDataFrame([(big, 7 * big, 1000)], "c long, n long, v long").select(d.share(F.col("c"), F.col("n"), F.col("v"))).first()
    assert row[0] == 1 + 10**9 * (big + 5) // (7 * big + 5000)


def test_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert d.audit(docs).count() == 0
    assert d.audit(spark.createDataFrame([(None, "en", "a"), ("x", "en", "b")], docs.schema)).count() == 2
