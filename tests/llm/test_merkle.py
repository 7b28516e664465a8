from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest

from lateflow.llm import merkle, queries


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def walk(tree: list[list[str]], j: int) -> list[tuple[list[str], list[str]]]:
    """Per level the siblings left and right of the node on the way up."""
    out = []
    for row in tree[:-1]:
        a = j - j % 8
        out.append((row[a:j], row[j + 1 : a + 8]))
        j //= 8
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    """``rows``: doc_id, text, lang, source, n_chars."""
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda x: x[:3])
        trees[name] = levels([x[2] for x in by[name]])
    whole, out = levels([trees[n][-1][0] for n in names]), []
    for k, name in enumerate(names):
        for j, (_, _, own, r) in enumerate(by[name]):
            path = walk(trees[name], j) + walk(whole, k)
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in path:
                node = h(*left, node, *right)
            siblings = [s for left, right in path for s in (*left, *right)]
            root = whole[-1][0]
            out.append((r[0], own, trees[name][-1][0], root, h(*siblings), node, node == root))
    return out


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op12_merkle(spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(x) for x in out.collect()]


same = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) if not isinstance(x, bool) else (True, x) for x in r))


def test_positions():
    """Closed-form places equal those that the builder fills, for all sizes of a subtree."""
    for n in [*range(1, 80), 511, 512]:
        for top in {merkle.height(n), merkle.HEIGHT}:
            leaves = [sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
            builder = merkle.Builder(top)
            for x in leaves:
                builder.append(x)
            log, level = builder.close(), leaves
            for at in range(top + 1):
                for j, node in enumerate(level):
                    p = merkle.position(at, j, n, top)
                    assert log[32 * p : 32 * p + 32] == node
                level = [merkle.digest(level[i : i + 8]) for i in range(0, len(level), 8)]
            assert len(log) == 32 * (merkle.position(top, 0, n, top) + 1)
            path = merkle.steps(log, n - 1, n, top)
            assert merkle.fold(leaves[-1], path) == log[-32:] and (top == 0 or merkle.fold(leaves[0], path) != log[-32:] or n == 1)


def test_equals_brute_force(spark, tmp_path):
    r = random.Random(1)
    word = lambda: r.choice(["Ab", "cd", "É", "xyz", "Q"])
    sizes = {"en": 1300, "de": 513, "fr": 512, "es": 9, "it": 8, "": 3, None: 2, "pt": 1, "É": 65, "nl": 64}
    rows, i = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((i := i + r.randrange(1, 4), " ".join(word() for _ in range(r.randrange(0, 6))), lang, r.choice(["a", "", None]), r.choice([None, 5])))
    rows += [(7, "x" * 300_000 + "Y", "en", "a", 1), (7, "x", "en", "a", 1), (None, "N", "en", "a", 1), (None, None, "fr", None, None)]
    rows += [(3, "same Row", "en", "a", 1)] * 40 + [(6, None, "en", "a", 1)]
    assert same(run(spark, rows, tmp_path)) == same(brute(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_small(spark, tmp_path, n):
    rows = [(i, f"Text {i}", "en", "s", 1) for i in range(n)]
    got = run(spark, rows, tmp_path)
    assert same(got) == same(brute(rows))
    if n == 1:  # no siblings: the leaf is the root
        assert got[0][1] == got[0][3] and got[0][4] == sha256(b"").hexdigest()


def test_logs_and_more_blocks_than_one_tier(spark, monkeypatch):
    """Several tiers, with smaller runs; every log ends in its root, which the next tier lists as a leaf."""
    monkeypatch.setattr(merkle, "RUN", 2)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    docs = spark.range(150).selectExpr("id doc_id", "cast(id % 2 as string) lang", "'s' source", "1 n_chars", "concat('T', id) text")
    built = merkle.manifest(docs)
    assert len(built.groups) == 3
    logs = {(x["part"], x["tier"], x["tree"], x["block"]): x for x in built.logs().collect()}
    for (part, tier, tree, block), x in logs.items():
        parent = logs.get((part, tier + 1, tree, block // 8))
        if parent:
            p = merkle.position(0, block % 8, parent["leaves"], merkle.height(10**6 if len([1 for k in logs if k[:3] == (part, tier + 1, tree)]) > 1 else parent["leaves"]))
            assert parent["log"][32 * p : 32 * p + 32] == x["log"][-32:]
    assert all(x["verified"] and x["folded_root"] == x["root"] for x in built.proofs().collect())
    odd = merkle.manifest(docs, altered={"text": merkle.lower_ascii(merkle.F.col("text"))}, where=merkle.F.col("doc_id") == 77)
    assert [x["doc_id"] for x in odd.proofs().collect() if not x["verified"]] == [77]
