from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lateflow.llm import tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark, tmp_path):
    r = random.Random(1)
    words = "the quick brown fox's jumps, over <|endoftext|> lazy dog ÉÀ 漢字 12 !!".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 300))), 0) for i in r.sample(range(10_000), 700)]
    rows += [(20_000, None, 0), (20_001, "", 0), (None, "no id", 0), (20_002, "twice", 0), (20_002, "twice", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(6)
    manifest = tokenfiles.write_token_files(docs, PATH, end_id=1, folder=f"{tmp_path}/files", sample_rows=200)
    out = tokenfiles.read_token_files(manifest).collect()
    library, at = Tokenizer.from_file(PATH), 0
    want = []
    for i, t, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(map(tuple, out), key=lambda x: x[1]) == want
    # one document alone, through the offsets
    some = manifest.orderBy("start").collect()
    reader = tokenfiles.FileReader(some[0]["file"])
    assert len(reader) == some[0]["n_docs"] and np.frombuffer(reader.packed(2), "<u4").tolist() == want[2][4]
    assert sum(m["n_tokens"] for m in some) == at and list(tmp_path.glob("files/*.dict"))
    for d in tmp_path.glob("files/*.dict"):
        d.write_bytes(b"other")
    with pytest.raises(ValueError, match="hash"):
        tokenfiles.FileReader(some[0]["file"])


def test_empty_and_tiny(spark, tmp_path):
    docs = spark.createDataFrame([(3, "one"), (1, None)], "doc_id long, text string")
    out = tokenfiles.read_token_files(tokenfiles.write_token_files(docs, PATH, folder=f"{tmp_path}/a")).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in out)[0] == (1, 0, 1) and len(out) == 2
    assert tokenfiles.read_token_files(tokenfiles.write_token_files(docs.limit(0), PATH, folder=f"{tmp_path}/b")).count() == 0


def test_column_is_encoded_by_its_distinct_words(monkeypatch):
    texts = ["The cat, the CAT!! it's é É, İstanbul ǅ ½ a1b2", None, "", " \n ", "a\tb  c\r\nd", "<|endoftext|> x <|startoftext|>y", "日本語 🎉🎉 ok,x " + "x" * 300]
    library, column = Tokenizer.from_file(PATH), pa.array(texts * 3)
    encoder = tokenfiles.WordEncoder(PATH)
    assert encoder.marked
    for at, n in ((0, 21), (1, 3), (5, 2), (3, 0)):
        want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in (texts * 3)[at : at + n]]
        assert encoder.encode_column(column.slice(at, n)) == want
    asked, encoder = [], tokenfiles.WordEncoder(PATH)
    monkeypatch.setattr(encoder, "encode_new", lambda part: asked.extend(part) or tokenfiles.WordEncoder.encode_new(encoder, part))
    encoder.encode_column(pa.array(["one two, one", "two, three"] * 50))
    assert sorted(asked) == ["one", "three", "two,"]  # whatever their number of places
    encoder.last[:] = False  # marks that do not add up
    assert encoder.encode_new(["plain", "words,"]) == [np.array(library.encode(w).ids, "<u4").tobytes() for w in ("plain", "words,")]
    bad = pa.array([b"ok \xff word", b"fine"], pa.binary()).view(pa.string())
    assert encoder.encode_column(bad) == [encoder.encode("ok � word"), encoder.encode("fine")]
