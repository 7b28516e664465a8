"""Quality by a sparse rule ensemble over text statistics.

Statistics of each text are Spark column expressions. On a bounded labelled
sample, boosted trees of small depth are grown over them; every path from a
root to a node becomes a conjunctive rule; a logistic model with a lasso
penalty keeps few of the rules. The kept rules and their weights are compiled
back to one Spark column expression, so scoring is a projection without any
shuffle or Python.

The fit reads the statistics of at most ``fit_rows`` labelled rows of each
class, those with the smallest hashes. Scoring covers all rows and whole texts.

Defined cases: a null text has the statistics of the empty text; with no labels
of one class every score is the share of label 1 (0.5 without labels);
repeated rows and ids each give a row; rows with a null id are not learned from;
further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateflow.llm.common import hash_sample

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#$%&*|<>{}[]\\^~=+_@/"


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; every one is a double and never null."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t) + 1

    def without(letters: str) -> Column:
        return chars - 1 - F.length(F.translate(t, letters, ""))

    def of(letter: str) -> Column:
        return chars - 1 - F.length(F.replace(t, F.lit(letter), F.lit("")))

    words = F.split(t, " ")
    count = F.size(words)
    return {
        "log_chars": F.log(chars.cast("double")),
        "word_chars": chars / count,
        "upper": without(UPPER) / chars,
        "digits": without("0123456789") / chars,
        "symbols": without(SYMBOLS) / chars,
        "stops": without(".,;:?") / chars,
        "bangs": of("!") / chars,
        "bars": of("|") / chars,
        "lines": of("\n") / chars,
        "wide": (F.octet_length(t) - chars + 1) / chars,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "repeats": F.regexp_count(t, F.lit(r"(?:^|\s)(\S+) \1(?=\s|$)")) / count,
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(statistic, above, threshold)`` and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, at in self.terms:
            out = out & ((stats[name] > at) if above else (stats[name] <= at))
        return out

    def __str__(self) -> str:
        return f"{self.weight:+.3f} if " + " and ".join(f"{n} {'>' if a else '<='} {t:.4g}" for n, a, t in self.terms)


@dataclass(frozen=True)
class RuleEnsemble:
    base: float
    rules: tuple[Rule, ...]

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(float(self.base))
        for r in self.rules:
            total = total + F.when(r.column(stats), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, residual: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: list, step: np.ndarray, least: int) -> None:
    """Grow one node; ``paths`` gets the condition of every node below the root, ``step`` each row's leaf value."""
    best = (1e-6, -1, 0)
    g, h = residual[rows].sum(), hessian[rows].sum() + 1e-3
    if depth:
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = binned[rows, j]
            n = np.bincount(b, minlength=len(cut) + 1).cumsum()[:-1]
            gl = np.bincount(b, residual[rows], len(cut) + 1).cumsum()[:-1]
            hl = np.bincount(b, hessian[rows], len(cut) + 1).cumsum()[:-1] + 1e-3
            gain = gl**2 / hl + (g - gl) ** 2 / (h - hl + 2e-3) - g**2 / h
            gain[(n < least) | (len(rows) - n < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    if best[1] < 0:
        step[rows] = g / h
        return
    _, j, k = best
    for above in (False, True):
        side = rows[(binned[rows, j] > k) == above]
        longer = (*path, (j, above, float(cuts[j][k])))
        paths.append(longer)
        _grow(x, cuts, binned, residual, hessian, side, depth - 1, longer, paths, step, least)


def _merged(path: tuple) -> tuple:
    """One lower and one upper bound for each statistic of a path."""
    low: dict[int, float] = {}
    high: dict[int, float] = {}
    for j, above, at in path:
        if above:
            low[j] = max(low.get(j, -math.inf), at)
        else:
            high[j] = min(high.get(j, math.inf), at)
    return tuple(sorted([(j, True, v) for j, v in low.items()] + [(j, False, v) for j, v in high.items()]))


def _holds(x: np.ndarray, path: tuple) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, at in path:
        out &= (x[:, j] > at) if above else (x[:, j] <= at)
    return out


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, bins: int = 64, rate: float = 0.3, penalty: float = 2e-3, rounds: int = 600) -> RuleEnsemble:
    """Boosted trees, their paths as rules, and lasso logistic weights by proximal gradient steps."""
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        values = np.unique(x[:, j])
        nearest = values[np.minimum(np.searchsorted(values, q, side="right"), len(values) - 1)]
        cuts.append(np.unique((q + nearest) / 2))  # between two values, so that rounding decides nothing
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    total, paths = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        step = np.zeros(len(y))
        _grow(x, cuts, binned, each * (y - p), each * p * (1 - p), np.arange(len(y)), depth, (), paths, step, max(5, len(y) // 500))
        total += rate * np.clip(step, -4, 4)
    unique = {}
    for path in map(_merged, paths):
        holds = _holds(x, path)
        key = holds.tobytes()
        if holds.any() and not holds.all() and (key not in unique or len(path) < len(unique[key])):
            unique[key] = path  # rules that hold for the same rows count once, the shortest stays
    rules = list(unique.values())
    r = np.stack([_holds(x, path) for path in rules], 1).astype(float)
    w, base, look, at, t = np.zeros(len(rules)), 0.0, np.zeros(len(rules)), 0.0, 1.0
    size = 1.0 / (0.25 * np.linalg.norm(np.hstack([r, np.ones((len(r), 1))]) * np.sqrt(each / len(y))[:, None], 2) ** 2)
    for _ in range(rounds):  # FISTA
        p = 1 / (1 + np.exp(-np.clip(r @ look + at, -30, 30)))
        gradient = each * (p - y) / len(y)
        moved = look - size * (r.T @ gradient)
        new = np.sign(moved) * np.maximum(np.abs(moved) - size * penalty, 0)
        new_base = at - size * gradient.sum()
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, at = new + (t - 1) / later * (new - w), new_base + (t - 1) / later * (new_base - base)
        w, base, t = new, new_base, later
    kept = [Rule(tuple((names[j], above, v) for j, above, v in path), float(v)) for path, v in zip(rules, w) if v]
    return RuleEnsemble(float(base), tuple(kept))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", fit_rows: int = 4_000) -> RuleEnsemble:
    """Fit on the statistics of a bounded sample of labelled rows."""
    labels = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").distinct()
    some = [hash_sample(labels.where(F.col("_y") == y), fit_rows, "_id") for y in (0, 1)]
    stats = statistics(F.col("_text"))
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .join(F.broadcast(some[0].unionByName(some[1])), "_id")  # bounded by fit_rows
        .select("_y", *(c.alias(n) for n, c in stats.items()))
        .collect()
    )
    table = np.array([list(r) for r in rows], float).reshape(len(rows), len(stats) + 1)
    return fit(table[:, 1:], table[:, 0].astype(int), list(stats))


def score_quality(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, score)`` for every row."""
    stats = statistics(F.col("_text"))
    measured = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text")).select(id_col, *keep, *(c.alias(f"_{n}") for n, c in stats.items()))
    return measured.select(id_col, *keep, model.score({n: F.col(f"_{n}") for n in stats}).alias("score"))
