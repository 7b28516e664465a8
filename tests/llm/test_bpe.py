from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lateflow.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABETS = [
    "abcdefgh", "abc ABC", "a b\n\t  ", "0123456789", "a1 ' '' s t re ll ve", "éàü ñß 漢字。、", "=-+#*! ", " \n", "  x", "ab<|endoftext|>",
    "   a\x1c\x85b", "éä", "😀👍🏽 a", "don't we'll I'm they've ", "Don't. WE'LL!! É'S, ÀÉÎ## İSTANBUL. ΣΑΣ. ß? ²½ª.", "a.b'c.,d'", "<|STARTOFTEXT|> <|startoftext|>.",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def some_texts(seed: int, n: int):
    r = random.Random(seed)
    for _ in range(n):
        kind = r.random()
        size = r.choice([1, 3, 10, 50, 300])
        if kind < 0.7:
            alphabet = r.choice(ALPHABETS)
            words = r.choice([list(alphabet), alphabet.split(" "), [alphabet, "the", " of", "\n\n"]])
            yield "".join(r.choice(words) for _ in range(size))
        elif kind < 0.85:
            yield r.choice("ab 0\n=é漢") * size * 3
        else:
            yield " ".join(r.choice(["<|endoftext|>", "the", "\n ", "  ", "worthless!!", "x<|endoftext|>y"]) for _ in range(size))


@pytest.mark.parametrize("leaf", [1, 2, 5, 17, 64, 4096])
def test_tree_equals_library(library, leaf):
    encoder = bpe.ByteLevelBPE(PATH)
    for text in some_texts(leaf, 400):
        want = library.encode(text, add_special_tokens=False).ids
        got = encoder.encode_whole(text, leaf)
        assert list(memoryview(got).cast("I")) == want, (leaf, text)
        assert encoder.decode(__import__("numpy").frombuffer(got, "<u4")) == library.decode(want, skip_special_tokens=False)


def test_long_runs(library):
    encoder = bpe.ByteLevelBPE(PATH)
    r = random.Random(5)
    for text in ["a" * 5000, "ab" * 3000, "".join(r.choice("abcdefghijklmnop") for _ in range(6000)), " " * 4001 + "x", "9" * 3000, "=" * 3000, "漢字" * 900]:
        assert list(memoryview(encoder.encode_whole(text, 100)).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_word_pieces():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), bpe.PieceEncoder(path, bpe.split_words, bound=300)
    for text in some_texts(3, 1500):
        assert list(memoryview(encoder.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids, text


def test_spark_rows(spark, library):
    long = "Some words, and then 'ems' " * 300 + "z" * 3000
    rows = [(1, long, "a"), (1, long, "a"), (2, None, "b"), (3, "", "c"), (None, "hello  world", None), (5, "the <|endoftext|> end\n\n x", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    out = bpe.encode_decode(docs, PATH, leaf_chars=200).collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"], r["decoded"]): r for r in out}
    for i, text, _ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        r = by[(i, text or "")]
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


class Counted:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.given = tokenizer, []

    def encode_batch_fast(self, part, **options):
        self.given += part
        return self.tokenizer.encode_batch_fast(part, **options)


def test_new_words_are_encoded_in_runs(library):
    encoder = bpe.ByteLevelBPE(PATH)
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    words = [f" wörd{i}x's" for i in range(1000)]
    assert [list(memoryview(x).cast("I")) for x in encoder.lookup(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert len(counted.given) == 20  # before: 1000


def test_recent_words_outlast_the_cache(library):
    encoder = bpe.ByteLevelBPE(PATH)
    encoder.bound, encoder.tokenizer = 200, Counted(encoder.tokenizer)
    for i in range(0, 3000, 30):
        words = [" the", " of", *(f" w{k}" for k in range(i, i + 30))]
        assert [list(memoryview(x).cast("I")) for x in encoder.lookup(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]
        assert len(encoder.cache) + len(encoder.older) <= 200
    assert sum(" the of" in x for x in encoder.tokenizer.given) == 1  # before: at each clearing


@pytest.mark.parametrize("bound", [50, 400_000])
def test_columns_equal_library(library, bound):
    encoder = bpe.ByteLevelBPE(PATH)
    encoder.bound = bound
    for many in ([], [""], ["", " ", "a\0 b", "\0", "x  y", "é "], *(list(some_texts(seed, 60)) for seed in range(20))):
        ids, starts = encoder.encode_texts(many)
        want = [library.encode(t, add_special_tokens=False).ids for t in many]
        assert [ids[p:q].tolist() for p, q in zip(starts, starts[1:])] == want
        out = bpe._outputs(encoder, ids, starts, ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
        back = [library.decode(w, skip_special_tokens=False) for w in want]
        assert [x.to_pylist() for x in out[:3]] == [list(map(len, want)), want, back]
        assert out[3].to_pylist() == [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in want]
        assert out[4].to_pylist() == [hashlib.sha256(t.encode()).hexdigest() for t in back]
