"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The words of the test items are counted over all documents (one pass; what
   comes back is bounded by the items' vocabulary).
2. From each place of an item, the shortest n-gram is its seed that is rare:
   one that independent words would bring up less than ``chance`` times in the
   whole corpus. The measure is the words' frequencies, not the n-gram's own
   count, so a passage leaked into very many documents keeps its seeds.
3. One more pass over whole documents looks the seeds up. Each hit names an item
   and a diagonal; the stretch of the document around it is aligned with the
   item by Smith-Waterman over words (linear gaps), many stretches at a time.
   The score is the alignment's over that of the item with itself.

Words of ASCII punctuation alone count on neither side, so spaced maths or code matches however its
signs are set; ``start_word`` and ``end_word`` are places among all words of the document.

Items are taken in blocks of ``block_items``, which bounds what a task holds;
all documents are held against every block. No text, and no document, is
shuffled.

Defined cases: null and empty texts match nothing; items without words are
never matched; repeated items are reported each; repeated rows and ids each
give their rows; an empty table on either side gives no rows; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateflow.llm.common import load, raw_bytes, share

_EDGES = b""".,;:!?"'()[]{}<>$%&*#|-_+=~`/\\"""
_MIX = np.uint64(0x9E3779B97F4A7C15)
MATCH, MISMATCH, GAP = 2, -1, -1


class Numbering(dict):
    """Numbers of the items' words by raw word; others are 0, and words of punctuation alone -1. Filled as words are met, within a bound."""

    def __init__(self, vocabulary: dict[bytes, int], bound: int = 400_000):
        super().__init__()
        self.vocabulary, self.bound = vocabulary, bound

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_EDGES)
        n = self.vocabulary.get(core, 0) if core else -1
        if len(self) >= self.bound:
            self.clear()
        if len(word) < 64:
            self[word] = n
        return n

    def numbers(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's words without those of punctuation alone, and their places among all words."""
        words = text.lower().split()
        all_ = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        places = np.flatnonzero(all_ >= 0)
        return all_[places], places


def _words(text: bytes) -> list[bytes]:
    return [w for x in text.lower().split() if (w := x.strip(_EDGES))]


def _grams(numbers: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that begins at each place."""
    out = np.zeros(max(0, len(numbers) - n + 1), np.uint64)
    x = numbers.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ x[i : i + len(out)]) * _MIX
            out ^= out >> np.uint64(29)
    return out


class Items:
    """Numbered words of a block of items, and their seeds once counts are known."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        split = [(i, _words(t)) for i, t in rows]
        split = [(i, w) for i, w in split if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.ids = [i for i, _ in split]
        self.words = [np.array([self.vocabulary[w] for w in ws], np.int32) for _, ws in split]

    def seed(self, counts: np.ndarray, total: int, chance: float, longest: int) -> None:
        """``counts`` by number of word (index 0: all others); builds a sorted table of seeds for each length."""
        log_p = np.log((counts + 0.5) / (total + 1.0))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        limit = np.log(chance) - np.log(total + 1.0)
        for k, w in enumerate(self.words):
            run, open_ = np.zeros(len(w)), np.ones(len(w), bool)
            for n in range(1, min(longest, len(w)) + 1):
                m = len(w) - n + 1
                run[:m] += log_p[w[n - 1 :]]
                if n < 2:
                    continue
                take = open_[:m] & ((run[:m] <= limit) | (n == min(longest, len(w))))
                at = np.flatnonzero(take)
                open_[at] = False
                if len(at):
                    found.setdefault(n, []).append((_grams(w, n)[at], np.full(len(at), k), at))
            if len(w) == 1:
                found.setdefault(1, []).append((_grams(w, 1), np.array([k]), np.array([0])))
        for n, parts in found.items():
            key, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            self.seeds[n] = (key[order], item[order], at[order])

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, diagonal) of each seed met in a document."""
        items, diagonals = [], []
        known = numbers > 0
        for n, (key, item, at) in self.seeds.items():
            m = len(numbers) - n + 1
            if m <= 0:
                continue
            whole = known[:m].copy()
            for i in range(1, n):
                whole &= known[i : i + m]
            place = np.flatnonzero(whole)
            if not len(place):
                continue
            # grams only of the places whose words all occur in items
            gram = np.zeros(len(place), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(n):
                    gram = (gram ^ numbers[place + i].astype(np.uint64)) * _MIX
                    gram ^= gram >> np.uint64(29)
            lo, hi = np.searchsorted(key, gram, "left"), np.searchsorted(key, gram, "right")
            some = hi > lo
            place, lo, hi = place[some], lo[some], hi[some]
            while len(place):
                items.append(item[lo])
                diagonals.append(place - at[lo])
                lo = lo + 1
                place, lo, hi = place[lo < hi], lo[lo < hi], hi[lo < hi]
        if not items:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(items), np.concatenate(diagonals)


def align(items: list[np.ndarray], stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each item with its stretch: best scores, and first and last word (exclusive) of the alignment in the stretch."""
    n, rows, width = len(items), max(map(len, items)), max(map(len, stretches))
    a, b = np.full((n, rows), -1, np.int32), np.full((n, width), -2, np.int32)
    for i, (x, y) in enumerate(zip(items, stretches)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    place = np.arange(width)
    score, origin = np.zeros((n, width), np.int32), np.broadcast_to(place, (n, width)).copy()
    best, first, last = np.zeros(n, np.int32), np.zeros(n, int), np.zeros(n, int)
    lift = -GAP * place
    each = np.arange(n)
    for r in range(rows):
        step = np.where(a[:, r : r + 1] == b, MATCH, MISMATCH)
        before = np.concatenate([np.zeros((n, 1), np.int32), score[:, :-1]], 1)
        came = np.concatenate([np.zeros((n, 1), int), origin[:, :-1]], 1)
        diagonal, down = before + step, score + GAP
        began = np.where(before > 0, came, place)
        now = np.maximum(np.maximum(diagonal, down), 0)
        source = np.where(now == diagonal, began, np.where(now == down, origin, place))
        # gaps along the stretch: a running maximum of the scores, less what the gap costs
        raised = now + lift
        top = np.maximum.accumulate(raised, 1)
        leader = np.maximum.accumulate(np.where(raised == top, place, 0), 1)
        score, origin = np.maximum(top - lift, 0), np.take_along_axis(source, leader, 1)
        at = score.argmax(1)
        better = score[each, at] > best
        best[better], first[better], last[better] = score[each, at][better], origin[each, at][better], at[better] + 1
    return best, first, last


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    chance: float = 0.5,
    longest: int = 6,
    block_items: int = 20_000,
) -> DataFrame:
    """``(id, item, score, start_word, end_word)``: best alignment of every document and item at ``threshold`` or more."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    items = items.select(F.col(item_col).cast("long").alias("_item"), F.col(item_text_col).cast("binary").alias("_text"))
    n_blocks = max(1, -(-items.count() // block_items))
    schema = f"`{id_col}` long, `{item_col}` long, score double, start_word long, end_word long"
    found = None
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        held = Items([(r[0], bytes(r[1] or b"")) for r in own.collect()])
        counts, total = _count(docs, held.vocabulary)
        held.seed(counts, total, chance, longest)
        part = docs.mapInArrow(_search(share(spark, held), threshold, [id_col, item_col]), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _count(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """How often each word of the items occurs in all documents, and the number of all words."""
    shared = share(docs.sparkSession, vocabulary)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbering = Numbering(load(shared))
        counts = np.zeros(len(numbering.vocabulary) + 1, np.int64)
        for batch in batches:
            for text in raw_bytes(batch.column(0)):
                counts += np.bincount(numbering.numbers(text)[0], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], ["word", "n"])

    rows = docs.select("_text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    for word, n in rows:
        out[word] = n
    return out, int(out.sum())


def _search(shared, threshold: float, names: list[str]):
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = load(shared)
        numbering = Numbering(held.vocabulary)
        waiting: list[tuple] = []

        def flush() -> pa.RecordBatch:
            best: dict[tuple, tuple] = {}
            for at in range(0, len(waiting), 256):
                part = waiting[at : at + 256]
                scores, first, last = align([held.words[w[2]] for w in part], [w[4] for w in part])
                for w, s, p, q in zip(part, scores, first, last):
                    share = float(s) / (MATCH * len(held.words[w[2]]))
                    key = (w[0], w[2])
                    if share >= threshold and (key not in best or best[key][2] < share):
                        best[key] = (w[1], held.ids[w[2]], share, int(w[3][p]), int(w[3][q - 1]) + 1)
            waiting.clear()
            columns = list(zip(*best.values())) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*names, "score", "start_word", "end_word"])

        row = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                row += 1
                numbers, places = numbering.numbers(text)
                items, diagonals = held.hits(numbers)
                if len(items):
                    length = np.array([len(held.words[k]) for k in items])
                    slack = 8 + length // 4
                    for k, near in np.unique(np.stack([items, diagonals // slack], 1), axis=0).tolist():
                        own = (items == k) & (diagonals // slack == near)
                        n, room = len(held.words[k]), 8 + len(held.words[k]) // 4
                        begin = max(0, int(diagonals[own].min()) - room)
                        end = int(diagonals[own].max()) + n + room
                        waiting.append((row, doc_id, k, places[begin:end], numbers[begin:end]))
            # documents are whole in ``waiting``, so each pair is reported once
            if len(waiting) >= 4096:
                yield flush()
        yield flush()

    return search
