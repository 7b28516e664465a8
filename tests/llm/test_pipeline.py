"""The pipeline against brute force, on documents with planted cases."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_jaccard import brute as near_copies
from test_suffixes import brute_first as repeats


def planted(seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in ("th", "er", "an", "ou", "be") for b in ("in", "on", "re", "ed", "al") for c in ("", "s", "ly", "ha", "st", "um")]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    bench = [prose(30) for _ in range(6)]
    passage = prose(150)
    rows, labels, kind = [], [], {}
    for i in range(420):
        k = ["clean", "clean", "toxic", "copy", "near", "passage", "leak"][i % 7]
        text = prose(r.randrange(20, 120))
        if k == "toxic":
            for _ in range(3):
                text.insert(r.randrange(len(text)), r.choice(["idiotic", "scummy", "moronic"]))
        elif k in ("copy", "near"):
            text = rows[i - 3 - i % 7 + 1][1].split(" ") if i >= 7 else text
            if k == "near" and len(text) > 60:
                text[len(text) // 2] = "changed"
        elif k == "passage":
            at = r.randrange(len(text))
            text[at:at] = passage
        elif k == "leak":
            at = r.randrange(len(text))
            text[at:at] = r.choice(bench)
        kind[i] = k
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, 1, int(k == "toxic")))
    rows += [(900, "", "en", "s", 0), (901, None, "en", "s", 0), (902, "x", "en", "s", 1)]
    return rows, labels, [(i, " ".join(b)) for i, b in enumerate(bench)], kind


def test_stages_and_run(spark, tmp_path):
    rows, labels, bench, kind = planted()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sf_dir = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)

    text = {i: t or "" for i, t, *_ in rows}
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept == {i for i in text if kind.get(i) != "toxic"}

    single = corpus_pipeline.drop_near_copies(spark, clean, sf_dir)
    ids = sorted(kept)
    kept = {d for d, _, c in near_copies(ids, [text[i] for i in ids], 5, 4, 5) if c == d}
    assert {r["doc_id"] for r in single.collect()} == kept and single.columns == list(corpus_pipeline.COLUMNS)

    whole = corpus_pipeline.cut_repeats(spark, single, sf_dir)
    ids = sorted(kept)
    left = {r["doc_id"]: r["text"] for r in whole.collect()}
    found = dict(zip(ids, repeats([text[i].encode() for i in ids], 400)))
    assert set(left) == {i for i in ids if not found[i][1] or found[i][1] < found[i][0]}
    assert all(len(left[i].encode()) == found[i][0] - found[i][1] for i in left)
    assert any(found[i][1] for i in ids) and whole.columns == list(corpus_pipeline.COLUMNS)

    safe = corpus_pipeline.drop_contaminated(spark, whole, sf_dir)
    kept = {r["doc_id"] for r in safe.collect()}
    assert kept == {i for i in left if not any(b in left[i] for _, b in bench)}

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(out) == kept
    assert all(out[i] == library.encode(left[i], add_special_tokens=False).ids for i in kept)
    assert np.all([kind.get(i, "clean") not in ("toxic", "leak") for i in kept])


def test_passages_of_over_fifty_words_are_cut(spark):
    """Repeated passages of 51 to 65 words, all below 400 bytes, go but at their first place; one of 50 words stays."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 8)))
    prose = lambda n: [word() for _ in range(n)]
    passages = [" ".join(prose(n)) for n in (*range(51, 66), 50)]
    assert all(len(p) < 400 for p in passages)
    rows = [(i, " ".join([*prose(40), f"u{i}", passages[i % 16], f"v{i}", *prose(40)]), "en", "s", 0) for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = {x["doc_id"]: x["text"] for x in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert left == {i: t if i % 16 == 15 or i < 16 else t.replace(passages[i % 16], "") for i, t, *_ in rows}


def test_rows_are_judged_by_id_and_text(spark, tmp_path):
    """A row of the same id with another text is left alone, near copies that share an id are one group, rows without an id are judged too,
    and of a quoted document the words stay where they stood first."""
    r = random.Random(8)
    prose = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    a, clean, item, quoted = prose(60), prose(60), prose(30), prose(60)
    near = a[:30] + ["changed"] + a[31:]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, words: (i, " ".join(words), "en", "s", 0)
    rows = [row(1, a), row(2, a), row(2, clean), row(1, near), row(None, a), row(None, prose(40)), row(7, prose(10) + item), row(7, prose(50))]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    single = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    texts = [(x["doc_id"], x["text"]) for x in single]
    assert sorted(i or 0 for i, _ in texts) == [0, 1, 2, 7, 7] and (2, " ".join(clean)) in texts
    assert len([t for _, t in texts if t in (" ".join(a), " ".join(near))]) == 1
    safe = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(x["text"] for x in safe) == sorted(t for _, t, *_ in rows if " ".join(item) not in t)
    both = spark.createDataFrame([row(5, prose(20) + quoted + prose(20)), row(3, quoted), row(9, quoted + quoted)], schema)
    left = {x["doc_id"]: x["text"].split() for x in corpus_pipeline.cut_repeats(spark, both, "").collect()}
    assert left[3] == quoted and len(left[5]) == 40 and 9 not in left


def test_repeated_rows_and_no_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, None, "en", "s", 1), (None, "q r s t u v", "en", "s", 1)]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in out) == [(0, True), (1, True), (2, False)]
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
