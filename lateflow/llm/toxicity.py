"""Toxicity by a linear-chain conditional random field over the words of a text.

Two states: plain and toxic. The labels are of whole documents, so tokens are
labelled first: a greedy weighted cover picks word forms (whole words and
prefixes) that occur in toxic documents and hardly in clean ones, until the
toxic documents are explained several times over; a word of a toxic document
is labelled toxic if one of its forms was picked. The chain is then trained on
lines with labelled words and on plain lines, by full-batch Adagrad over the exact
gradient (forward-backward). Scoring runs forward-backward over each whole
document, without windows: marginals of the toxic state give the offending
spans, and a logistic function of their sum, their maximum and the length,
fitted on the same rows, gives the document's score.

The fit reads at most ``fit_rows`` labelled rows of each class, those with the
smallest hashes, with texts of up to ``fit_bytes``: a bounded sample, for any input.
Scoring covers every row and whole texts.

Defined cases: null and empty texts have no words and get the score of an
empty chain; with no labels of one class, every score is the share of toxic rows
among the labels (0 without labels); repeated rows and ids each give a row;
rows with a null id are never learned from and are not held out; further
columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateflow.llm.common import hash_sample, load, raw_bytes, share

BITS = 16
FEATURES = 7
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_EDGES = b""".,;:!?"'()[]{}$%&*#|-_"""


def forms(word: bytes) -> list[str]:
    """The word without punctuation at its edges, and its prefixes of four and five letters."""
    core = word.strip(_EDGES).decode("utf-8", "replace")
    return [f"w={core}", *(f"{n}={core[:n]}" for n in (4, 5) if len(core) > n)] if core else []


def features(word: bytes) -> list[int]:
    """Hashed features of a lower-cased word; always ``FEATURES`` of them."""
    core = word.strip(_EDGES).decode("utf-8", "replace")
    parts = ["bias", f"w={core}", f"3={core[:3]}", f"4={core[:4]}", f"5={core[:5]}", f"s={core[-3:]}", f"edge={word[-1:]!r}" if word[-1:] in _EDGES else "edge"]
    return [zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts]


def pick_forms(toxic: list[bytes], clean: list[bytes], ratio: float = 20.0) -> set[str]:
    """Forms far likelier in toxic texts, by a cover in which each use halves a text's weight.

    Only forms of two toxic texts or more are held, so that memory follows those and not the clean texts' words.
    """
    times = Counter(f for t in toxic for f in {f for w in set(t.lower().split()) for f in forms(w)})
    number = {f: i for i, (f, n) in enumerate(times.items()) if n >= 2}
    del times
    size = max(number.values(), default=0) + 1

    def numbers(text: bytes) -> np.ndarray:
        return np.array(sorted({i for w in set(text.lower().split()) for f in forms(w) if (i := number.get(f)) is not None}), np.int32)

    each = [numbers(t) for t in toxic]
    n_toxic, n_clean = np.zeros(size), np.zeros(size)
    for own in each:
        n_toxic[own] += 1
    for t in clean:
        n_clean[numbers(t)] += 1
    good = (n_toxic >= 2) & ((n_toxic / (len(toxic) + 1)) / ((n_clean + 0.5) / (len(clean) + 1)) >= ratio)
    where = defaultdict(list)
    for i, own in enumerate(each):
        for f in own[good[own]].tolist():
            where[f].append(i)
    weight, picked, least = np.ones(len(toxic)), set(), max(1.2, 0.002 * len(toxic))
    heap = [(-float(len(docs)), f) for f, docs in where.items()]  # weights only fall, so old sums are upper bounds
    heapq.heapify(heap)
    while heap and -heap[0][0] >= least:
        bound, f = heap[0]
        now = float(weight[where[f]].sum())
        if now < -bound:
            heapq.heapreplace(heap, (-now, f))
            continue
        heapq.heappop(heap)
        picked.add(f)
        weight[where[f]] /= 2
    return {f for f, i in number.items() if i in picked}


class Chain:
    """Weights of the field: ``emit`` (hashed features of the toxic state) and ``move`` (2 x 2 transitions)."""

    def __init__(self):
        self.emit, self.move = np.zeros(1 << BITS), np.zeros((2, 2))

    def _step(self, f: np.ndarray, back: bool = False) -> np.ndarray:
        """What the log-odds of one token pass on to its neighbour."""
        m = self.move.T if back else self.move
        return np.logaddexp(m[0, 1], m[1, 1] + f) - np.logaddexp(m[0, 0], m[1, 0] + f)

    def train(self, lines: list[list[list[int]]], labels: list[list[int]], rounds: int = 60, rate: float = 0.5, l2: float = 1e-4) -> None:
        n, longest = len(lines), max(map(len, lines))
        x = np.zeros((n, longest, FEATURES), np.int32)
        y, mask = np.zeros((n, longest)), np.zeros((n, longest), bool)
        for i, (line, label) in enumerate(zip(lines, labels)):
            x[i, : len(line)], y[i, : len(line)], mask[i, : len(line)] = line, label, True
        pairs = mask[:, 1:]
        seen = np.array([[((y[:, :-1] == s) & (y[:, 1:] == t) & pairs).sum() for t in (0, 1)] for s in (0, 1)], float)
        squares, move_squares, tokens = np.full(1 << BITS, 1e-8), np.full((2, 2), 1e-8), mask.sum()
        for _ in range(rounds):
            e = self.emit[x].sum(2)
            forward, backward = e.copy(), np.zeros_like(e)
            for t in range(1, longest):
                forward[:, t] += self._step(forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                backward[:, t] = np.where(mask[:, t + 1], self._step(e[:, t + 1] + backward[:, t + 1], back=True), 0)
            p = 1 / (1 + np.exp(-(forward + backward)))
            gradient = np.bincount(x[mask].ravel(), np.repeat((y - p)[mask], FEATURES), 1 << BITS) / tokens - l2 * self.emit
            a, b = forward[:, :-1][pairs], (e + backward)[:, 1:][pairs]
            joint = np.stack([np.full_like(a, self.move[0, 0]), self.move[0, 1] + b, self.move[1, 0] + a, self.move[1, 1] + a + b])
            joint = np.exp(joint - joint.max(0))
            moved = (seen - (joint / joint.sum(0)).sum(1).reshape(2, 2)) / tokens - l2 * self.move
            squares += gradient**2
            move_squares += moved**2
            self.emit += rate * gradient / np.sqrt(squares)
            self.move += rate * moved / np.sqrt(move_squares)

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of the toxic state for every token of documents that lie one after the other."""
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        start = (np.cumsum(lengths) - lengths)[order]
        forward, backward = emissions.copy(), np.zeros_like(emissions)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")  # documents longer than t
        for t in range(1, longest):
            at = start[: active[t]] + t
            forward[at] += self._step(forward[at - 1])
        last = start + size - 1
        for t in range(1, longest):
            at = last[: active[t]] - t
            backward[at] = self._step(emissions[at + 1] + backward[at + 1], back=True)
        return 1 / (1 + np.exp(-np.clip(forward + backward, -50, 50)))


def _summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: 1, log of the expected toxic words, log-odds of the largest marginal, log of the length."""
    begin = np.cumsum(lengths) - lengths
    some = lengths > 0
    total, top = np.zeros(len(lengths)), np.full(len(lengths), 1e-9)
    if some.any():
        total[some] = np.add.reduceat(p, begin[some])
        top[some] = np.maximum.reduceat(p, begin[some])
    top = np.clip(top, 1e-9, 1 - 1e-9)
    return np.stack([np.ones(len(lengths)), np.log(total + 1e-6), np.log(top / (1 - top)), np.log1p(lengths)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Ridge logistic regression by Newton steps, classes weighted alike."""
    w, each = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (each * (y - p)) - ridge * w * 0.1
        w += np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + ridge * 0.1 * np.eye(x.shape[1]), gradient)
    return w


class ToxicityModel:
    """A trained chain and the logistic function over its marginals; ``prior`` alone where nothing could be learned."""

    def __init__(self, prior: float, chain: Chain | None = None, weights: np.ndarray | None = None):
        self.prior, self.chain, self.weights = prior, chain, weights

    def emissions(self, words: list[bytes], cache: dict[bytes, float]) -> list[float]:
        out = []
        for w in words:
            e = cache.get(w)
            if e is None:
                if len(cache) > 400_000:
                    cache.clear()
                e = float(self.chain.emit[features(w)].sum())
                if len(w) < 64:
                    cache[w] = e
            out.append(e)
        return out

    def score(self, many: list[bytes], cache: dict[bytes, float]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of texts (UTF-8 bytes) and the marginals of their words."""
        words = [t.lower().split() for t in many]
        lengths = np.array([len(w) for w in words], np.int64)
        emissions = np.fromiter((e for w in words for e in self.emissions(w, cache)), float, int(lengths.sum()))
        p = self.chain.marginals(emissions, lengths)
        score = 1 / (1 + np.exp(-np.clip(_summary(p, lengths) @ self.weights, -40, 40)))
        return score, np.split(p, np.cumsum(lengths)[:-1]) if len(many) else []


def fit(toxic: list[bytes], clean: list[bytes], line_words: int = 64, plain_lines: int = 4_000, toxic_lines: int = 4_000, share: float = 0.1) -> ToxicityModel:
    """Train on distinct labelled texts; ``share`` is the share of toxic texts to expect."""
    toxic, clean = sorted(set(toxic)), sorted(set(clean))
    if not toxic or not clean:
        return ToxicityModel(len(toxic) / max(1, len(toxic) + len(clean)))
    picked = pick_forms(toxic, clean)

    def lines(want: bool) -> Iterator[tuple[int, list[bytes], list[int]]]:
        """Stretches of lines with labelled words, or those without, and a hash that orders them."""
        for texts, bad in ((toxic, True), (clean, False)):
            for text in texts if bad or not want else ():
                for line in text.lower().split(b"\n"):
                    words = line.split()
                    for at in range(0, len(words), line_words):
                        part = words[at : at + line_words]
                        label = [int(bad and any(f in picked for f in forms(w))) for w in part] if bad else [0] * len(part)
                        if any(label) == want:
                            yield zlib.crc32(b" ".join(part)), part, label

    rows = heapq.nsmallest(toxic_lines, lines(True)) + heapq.nsmallest(plain_lines, lines(False))
    cached: dict[bytes, list[int]] = {}
    chain = Chain()
    chain.emit[features(b"x")[0]] = -2.0  # most words are plain
    chain.train([[cached.get(w) or cached.setdefault(w, features(w)) for w in part] for _, part, _ in rows], [label for _, _, label in rows])
    model = ToxicityModel(0.5, chain, np.zeros(4))
    cache: dict[bytes, float] = {}
    x = []
    both = [*toxic, *clean]
    for at in range(0, len(both), 500):
        words = [t.lower().split() for t in both[at : at + 500]]
        lengths = np.array([len(w) for w in words], np.int64)
        emissions = np.fromiter((e for w in words for e in model.emissions(w, cache)), float, int(lengths.sum()))
        x.append(_summary(chain.marginals(emissions, lengths), lengths))
    model.weights = _logistic(np.concatenate(x), np.repeat([1, 0], [len(toxic), len(clean)]))
    model.weights[0] += np.log(share / (1 - share))  # the rows above count both classes alike
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int, text_bytes: int) -> DataFrame:
    """``(text, y)`` of at most ``rows`` labelled rows of each class, those with the smallest hashes."""
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").distinct()
    some = [hash_sample(labels.where(F.col("_y") == y), rows, "_id") for y in (0, 1)]
    ids = some[0].unionByName(some[1])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.octet_length("_text") <= text_bytes).join(F.broadcast(ids), "_id").select("_text", "_y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", fit_rows: int = 3_000, fit_bytes: int = 8_192) -> ToxicityModel:
    rows = labelled_sample(docs, labels, label, id_col, text_col, fit_rows, fit_bytes).select(F.col("_text").cast("binary"), "_y").collect()
    return fit([bytes(r[0]) for r in rows if r[1] == 1], [bytes(r[0]) for r in rows if r[1] == 0])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), spans: bool = True) -> DataFrame:
    """``(id, *keep, score, n_toxic, spans)`` for every row; spans are byte offsets of offending words, joined where they touch."""
    shared = share(docs.sparkSession, model)
    chosen = docs.select(F.col(id_col), *keep, F.col(text_col).cast("binary").alias("_text"))
    names = [id_col, *keep, "score", "n_toxic", *["spans"] * spans]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def offending(text: bytes, p: np.ndarray) -> list[dict[str, int]]:
        out: list[dict[str, int]] = []
        last = -2
        for i, m in enumerate(_WORD.finditer(text)):
            if p[i] >= 0.5:
                if i == last + 1:
                    out[-1]["end"] = m.end()
                else:
                    out.append({"start": m.start(), "end": m.end()})
                last = i
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(shared)
        cache: dict[bytes, float] = {}
        for batch in batches:
            text_at = batch.num_columns - 1
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                many = raw_bytes(part.column(text_at))
                if own.chain is None:
                    score, p = np.full(len(many), own.prior), [np.zeros(len(t.split())) for t in many]
                else:
                    score, p = own.score(many, cache)
                count = [int((x >= 0.5).sum()) for x in p]
                columns = [*part.columns[:text_at], pa.array(score, pa.float64()), pa.array(count, pa.int64())]
                if spans:
                    columns.append(pa.array([offending(t, x) if n else [] for t, x, n in zip(many, p, count)], span))
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{fields}, score double, n_toxic long" + ", spans array<struct<start: long, end: long>>" * spans)
