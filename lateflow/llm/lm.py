"""Language-model scoring of whole documents.

1. Words of all training documents are counted: each task counts its own, Spark
   sums. The result stays distributed; only the ``head`` (at most
   ``head_words`` words, by a threshold on counts) is broadcast.
2. The recurrent model (see ``gru``) learns from every training document, once: each of ``rounds`` rounds
   takes its own part of them, by a hash of id and text. Groups of documents are trained on side by side from the
   same parameters and their results averaged after each round; parameters are summed
   in the tasks, level by level.
3. One pass scores every document. Rare words, beyond the head, have their
   counts joined in afterwards, summed per document.

Words of the tail classes (by their last byte) have the class's
probability times (c + 0.5) / Z, where Z sums c + 0.5 over the class and adds 0.5 for
words never seen. So the probabilities of all known words, and of an unseen
one in each tail class, sum to 1, as in the unigram ``base``.

Defined cases: null and empty texts are the end token alone; rows with a null id
are not held out and train like others; without training rows the base has
N = V = 0 and the model is untrained; repeated rows and ids each give a row;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateflow.llm.common import cut, latest, load, share
from lateflow.llm.gru import Gru, Lanes

END = b"\n"  # stands for the end token; no word can hold it
SLICE = 12_000_000  # bytes of text cut into words at once


def slices(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows, each batch in the fewest parts that have about ``SLICE`` bytes in a column, or less (a row is not cut)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        parts = max(1, -(-int(ends[-1]) // SLICE)) if len(ends) else 0
        cuts = np.searchsorted(ends, ends[-1:] / max(parts, 1) * np.arange(1, parts)) + 1
        bounds = sorted({0, len(ends), *cuts.tolist()})
        for begin, end in zip(bounds, bounds[1:]):
            yield batch.slice(begin, end - begin)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts (null: none), A-Z lower-cased, parted by exactly the six ASCII spaces; and each text's number of them."""
    plain = pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())  # bytes: these functions know only ASCII
    parts = pc.ascii_split_whitespace(pc.ascii_lower(plain))
    words, bounds = parts.flatten().view(pa.binary()), parts.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    some = pc.greater(pc.binary_length(words), 0)
    lengths = np.diff(np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))[bounds])
    return (words if lengths.sum() == len(words) else words.filter(some)), lengths


class Vocabulary:
    """The head's counts, the shortlist's classes, and the tail classes with their totals."""

    def __init__(self, words: list[bytes], counts: list[int], by_byte: dict[int, tuple[int, int]], total: int, types: int, shortlist: int, classes: int, tails: int):
        order = sorted(range(len(words)), key=lambda i: (words[i] != END, -counts[i], words[i]))
        self.words = {words[i]: k for k, i in enumerate(order)}
        self.column = pa.array([*self.words, END], pa.binary())
        self.count = np.array([counts[i] for i in order], np.int64)
        self.last = np.array([words[i][-1] for i in order] + [0], np.uint8)  # last bytes; the last of all: beyond the head
        self.total, self.types = total, types
        self.listed = n = min(shortlist, len(order))
        # shortlist classes of about equal sums of the roots of their words' counts
        share_ = np.cumsum(np.sqrt(self.count[:n] + 0.5))
        cut_at = np.searchsorted(share_, np.arange(1, classes) / classes * (share_[-1] if n else 0))
        self.bounds = sorted({0, *(int(c) for c in cut_at if 0 < c < n), n})
        self.class_of = np.zeros(n, np.int32)
        for c, (a, b) in enumerate(zip(self.bounds, self.bounds[1:])):
            self.class_of[a:b] = c
        # tail classes: the last bytes with most of the tail's mass, and one for all others
        mass = {b: [s, t] for b, (s, t) in by_byte.items()}
        for i in order[:n]:
            last = mass[words[i][-1]]
            last[0] -= counts[i]
            last[1] -= 1
        top = sorted((b for b in mass if b != END[0]), key=lambda b: (-mass[b][0], b))[: tails - 1]
        self.tail_of = np.full(256, tails - 1, np.int32)
        self.tail_of[top] = np.arange(len(top))
        z = np.full(tails, 0.5)
        for b, (s, t) in mass.items():
            z[self.tail_of[b]] += s + 0.5 * t
        self.log_z, self.z, self.tails = np.log10(z), z, tails

    @property
    def inputs(self) -> int:
        return self.listed + self.tails + 1  # and one where a text begins

    def model(self) -> Gru:
        """The untrained model: its biases are the counts, so it starts as the unigram."""
        gru = Gru(self.inputs, self.bounds, self.tails)
        c = self.count[: self.listed] + 0.5
        by_class = np.add.reduceat(c, self.bounds[:-1]) if self.listed else np.zeros(0)
        gru.p["wc"][:, -1] = np.log(np.concatenate([by_class, self.z]))
        gru.p["wo"][:, -1] = np.log(c)
        return gru

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Head numbers of a text's tokens (-1 beyond the head), their last bytes, and the tokens beyond the head."""
        head, last, _, rare = self.encode_column(pa.array([text], pa.binary()))
        return head, last, rare[0].as_py()

    def encode_column(self, texts: pa.Array, lesson: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array | None]:
        """Of all texts' tokens, one text after another, head numbers and last bytes; each text's number of tokens; and a list of those beyond the head for each.
        For a ``lesson``, which tells only the shortlist's words apart, all others are beyond the head and not listed."""
        words, lengths = split(texts)
        lengths, known = lengths + 1, self.listed if lesson else len(self.words)
        ends = np.cumsum(lengths) - 1
        place = np.empty(int(lengths.sum()), np.int64)  # of tokens among the head's words, the end and the texts' words
        word = np.ones(len(place), bool)
        word[ends] = False
        place[ends], place[word] = known, known + 1 + np.arange(len(words))
        every = pa.concat_arrays([self.column[:known], self.column[-1:], words])
        # distinct words are numbered in order: the head's by their head numbers
        head = every.dictionary_encode().indices.to_numpy()[place].astype(np.int32)
        head[head >= known] = -1
        bounds = np.frombuffer(every.buffers()[1], np.int32)[every.offset : every.offset + len(every) + 1]
        last = np.frombuffer(every.buffers()[2], np.uint8)[bounds[1:] - 1][place]
        if lesson:
            return head, last, lengths, None
        rare = np.flatnonzero(head < 0)
        bounds = np.searchsorted(rare, np.append(0, ends + 1))
        return head, last, lengths, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), every.take(pa.array(place[rare])))

    def targets(self, head: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, shortlist word or -1, number as an input) of tokens by head number and last byte."""
        words = np.where(head < self.listed, head, -1)
        tail, listed = self.tail_of[last], words >= 0
        classes = np.append(self.class_of, 0).astype(np.int32)[words]
        return np.where(listed, classes, tail + np.int32(len(self.bounds) - 1)), words.astype(np.int32), np.where(listed, words, tail + np.int32(self.listed)).astype(np.int32)

    def lanes(self, head: np.ndarray, last: np.ndarray, lengths: np.ndarray, most: int) -> Lanes:
        """Grid of texts, by their tokens' head numbers and last bytes."""
        classes, words, inputs = self.targets(head, last)
        before = np.empty_like(inputs)
        before[1:] = inputs[:-1]
        before[np.cumsum(lengths) - lengths] = self.inputs - 1
        return Lanes(before, classes, words, lengths, self.inputs - 1, most)


def count_words(texts: DataFrame) -> DataFrame:
    """``(word, n)`` over a column of texts, the end token included."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            found = split(part.column(0))[0].value_counts()
            words, counts = found.field(0), found.field(1).cast(pa.int64())
            ends = pa.array([END], pa.binary()), pa.array([part.num_rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, ends[0]]), pa.concat_arrays([counts, ends[1]])], ["word", "n"])

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_vocabulary(counts: DataFrame, head_words: int, shortlist: int, classes: int, tails: int) -> Vocabulary:
    least, held = 1 << 62, 0
    # counts by powers of 2 ** (1 / 16), from the top, as long as the head stays within its bound
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), reverse=True):
        held += r["k"]
        if held > head_words:
            break
        least = r["n"]
    head = counts.where(F.col("n") >= least).toArrow()
    bytes_ = counts.groupBy(F.substring("word", -1, 1).alias("b")).agg(F.sum("n").alias("s"), F.count("*").alias("t")).collect()
    by_byte = {bytes(r["b"])[0]: (r["s"], r["t"]) for r in bytes_}
    total, types = sum(s for s, _ in by_byte.values()), sum(t for _, t in by_byte.values())
    return Vocabulary(head.column("word").to_pylist(), head.column("n").to_pylist(), by_byte, total, types, shortlist, classes, tails)


def train(texts: DataFrame, vocabulary: Vocabulary, groups: int, rounds: int, lanes: int) -> Gru:
    """Average of the models that groups of the texts (column ``_text``, dealt by ``_deal``) give; each round takes its own part of the texts."""
    spark, model = texts.sparkSession, vocabulary.model()
    words, tag = share(spark, vocabulary), uuid.uuid4().hex
    for turn in range(rounds):
        shared = share(spark, model)
        rate = 0.006 / (turn + 1)

        def learn(batches: Iterable[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            own, gru, held = latest("vocabulary", tag, lambda: load(words)), load(shared), []
            done = size = 0

            def lesson() -> None:
                head, last, lengths = (np.concatenate(x) for x in zip(*held))
                # long texts go on as further sequences, so that lanes fill evenly
                pieces = -(-lengths // 2_048)
                cut_ = np.full(pieces.sum(), 2_048)
                cut_[np.cumsum(pieces) - 1] = lengths - 2_048 * (pieces - 1)
                gru.train(own.lanes(head, last, cut_, lanes), rate=rate)
                held.clear()

            for part in slices(batches, 0):
                head, last, lengths, _ = own.encode_column(part.column(0), lesson=True)
                ends = np.append(0, np.cumsum(lengths))
                at = 0
                while at < len(lengths):
                    end = min(len(lengths), int(np.searchsorted(ends, ends[at] + 400_000 - size)))  # a bounded share of a group at once
                    held.append((head[ends[at] : ends[end]], last[ends[at] : ends[end]], lengths[at:end]))
                    size += int(ends[end] - ends[at])
                    if size >= 400_000:
                        lesson()
                        done, size = done + size, 0
                    at = end
            if held:
                lesson()
                done += size
            if done:
                total = gru.flat().astype(np.float64) * done
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([done], pa.int64())], ["total", "tokens"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, tokens = None, 0
            for batch in batches:
                for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    x = np.frombuffer(t, np.float64)
                    total, tokens = (x.copy() if total is None else total + x), tokens + n
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["total", "tokens"])

        part = texts.where(F.pmod(F.shiftright("_deal", 32), F.lit(rounds)) == turn)
        sums = part.repartition(groups, "_deal").select("_text").mapInArrow(learn, "total binary, tokens long")
        left = groups
        while left > 1:
            left = -(-left // 16)
            sums = sums.repartition(left).mapInArrow(add, "total binary, tokens long")
        for total, tokens in sums.collect():  # one row
            model.set(np.frombuffer(total, np.float64) / tokens)
    return model


def score_documents(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    head_words: int = 200_000,
    shortlist: int = 2_000,
    classes: int = 48,
    tails: int = 48,
    learn_one_in: int = 1,
    group_rows: int = 800,
    rounds: int = 2,
    lanes: int = 256,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row; ``held_out`` says which rows not to learn from."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    training = docs.where(~F.col("_held"))
    counts = cut(count_words(training.select("_text")))
    vocabulary = build_vocabulary(counts, head_words, shortlist, classes, tails)
    spread = F.xxhash64("_id", "_text", F.lit(29))
    lesson = training if learn_one_in == 1 else training.where(F.pmod(spread, F.lit(learn_one_in)) == 0)
    lesson = lesson.withColumn("_deal", spread)
    groups = max(1, -(-lesson.count() // (rounds * group_rows)))
    model = train(lesson, vocabulary, groups, rounds, lanes)
    words, shared, tag = share(spark, vocabulary), share(spark, model), uuid.uuid4().hex
    kind = docs.schema["_id"].dataType.simpleString()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gru = latest("vocabulary", tag, lambda: load(words)), load(shared)
        log_count = np.log10(np.append(own.count, 0) + 0.5)  # the last: beyond the head

        for part in slices(batches, 1):
            head, last, lengths, rare = own.encode_column(part.column(1))
            begin = np.cumsum(lengths) - lengths
            beyond, listed = head < 0, (head >= 0) & (head < own.listed)
            base = np.where(beyond, 0, log_count[head])
            log_p = gru.score(own.lanes(head, last, lengths, lanes)) / math.log(10)
            log_p += np.where(listed, 0, base - own.log_z[own.tail_of[last]])
            sums = [np.add.reduceat(v, begin) for v in (log_p, base, (~beyond).astype(np.int64))]
            columns = [part.column(0), part.column(2), pa.array(lengths, pa.int64()), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0]), rare]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "held_out", "n_tokens", "known", "base", "score", "rare"])

    scored = docs.select("_id", "_text", "_held").mapInArrow(score, f"_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>")
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()))
    rare = scored.select("_row", F.explode("rare").alias("word")).join(counts, "word", "left")
    found = rare.groupBy("_row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"), F.count("n").alias("seen"))
    logs = F.coalesce("logs", F.lit(0.0))
    floor = math.log10(vocabulary.total + 0.5 * (vocabulary.types + 1))
    return scored.join(found, "_row", "left").select(
        F.col("_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("seen", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
