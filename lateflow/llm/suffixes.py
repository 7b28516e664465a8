"""Removal of byte strings that occur more than once, by sorted suffixes.

A byte goes when it lies in a string of ``width`` bytes that starts at two
places or more, of one document or of several. All is judged on the input.

1. Every window of ``width`` bytes has an anchor: its leftmost byte ``gram``
   with the smallest hash. Equal windows have equal anchors at equal offsets,
   so only windows whose anchor's gram occurs twice can repeat. Each anchor
   stands for a run of window starts; there are about two for every ``width``
   bytes.
2. For anchors whose gram recurs, the bytes that their windows span (the
   context) are gathered by gram. Equal contexts count once.
3. Within a gram, the suffixes that begin at the anchors are sorted by the
   deep-shallow method: multikey quicksort over 8-byte characters to a shallow
   depth, then blind tries for what still agrees. In large groups the reversed
   prefixes are sorted likewise. From the common prefixes of neighbours follow
   the window starts that two contexts share.

A gram that occurs at more than ``hot_rows`` places is not gathered: its windows
are compared one by one through their digests (128 bits), which are dealt out by digest.
Texts that occur whole more than once are known to repeat throughout and are
read once.

With ``words``, a run of that many words or more that occurs at two places goes as well, however few its
bytes (words are parted by ASCII whitespace and compare by 64-bit hashes). For this every text is followed by
its words' hashes, 8 bytes each, in which windows of ``words`` words are found by the same steps; what
repeats there is mapped back to the bytes from the first word's start to the last one's end (runs that adjoin are one).

With ``keep_first`` a string stays at its first place, by (id, position), and goes at all others: a window is cut if an equal one starts
earlier. Of repeated texts the row with the least id stays (null ids come last; rows equal in id and text stay together). A string that overlaps itself
(a run of one letter) is cut from its second start on.

Defined cases: null texts are empty; texts shorter than ``width`` (and than ``words``) lose nothing; repeated rows and
ids each give a row (repeated texts of ``width`` bytes or ``words`` words or more lose all); an
empty table gives no rows; further columns are not read. In a kept text, a
character that a cut has split is dropped whole.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateflow.llm.common import WordHasher, cut, discard, raw_bytes, release_worker, store

WORD = 8
WORD_GRAM = 8
SHALLOW = 64
SMALL = 24
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0xD6E8FEB86659FD93


def word_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed intervals of bytes of the whole words that closed intervals in the words' hashes cover."""
    places = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", text)]
    whole = [(-(-p // WORD), (q + 1) // WORD) for p, q in spans]
    return [(places[a][0], places[b - 1][1] - 1) for a, b in whole if a < b]


def find_anchors(many: list[bytes], width: int, gram: int, unit: int = 1) -> tuple[np.ndarray, ...]:
    """(text, hash, position, least and greatest distance back to a window start) of every anchor, in units of 1 or 8 bytes; ``gram`` is a power of two."""
    lengths = np.array([len(t) // unit for t in many], np.int64)
    offset = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(many), np.uint8 if unit == 1 else np.uint64)
    windows = len(data) - width + 1
    has = np.flatnonzero(lengths >= width)
    if windows < 1 or not len(has):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h, size, factor = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    while size < gram:  # a polynomial hash of 2 n bytes from two of n
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor & (1 << 64) - 1
    h = (h ^ (h >> np.uint64(29))) * _M1
    h = (h ^ (h >> np.uint64(32))) * _M2
    h ^= h >> np.uint64(31)

    # leftmost minimum of every run of ``span`` grams, from minima of blocks of ``span``, forward and backward
    span = width - gram + 1
    n = -(-len(h) // span) * span
    block = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    block[: len(h)] = h
    block, index = block.reshape(-1, span), np.arange(n, dtype=np.int64).reshape(-1, span)
    ahead = np.minimum.accumulate(block, 1)
    fresh = np.ones(block.shape, bool)
    fresh[:, 1:] = block[:, 1:] < ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(fresh, index, 0), 1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1]
    behind_at = np.minimum.accumulate(np.where(block == behind, index, n)[:, ::-1], 1)[:, ::-1].ravel()
    ahead, behind = ahead.ravel(), np.ascontiguousarray(behind).ravel()

    edge = np.zeros(windows + 1, np.int8)
    edge[offset[has]] += 1
    edge[offset[has] + lengths[has] - width + 1] -= 1
    start = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    last = start + span - 1
    anchor = np.where(behind[start] <= ahead[last], behind_at[start], ahead_at[last])
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    final = np.append(first[1:], len(anchor)) - 1
    at = anchor[first]
    text = np.searchsorted(offset, at, side="right") - 1
    text = has[np.searchsorted(has, text, side="right") - 1]  # empty texts share their offset with the next
    return text, h[at].view(np.int64), at - offset[text], at - start[final], at - start[first]


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def blind_trie(strings: list[bytes], ids: list[int], depth: int) -> list[int]:
    """Order of strings that agree up to ``depth``.

    Inner nodes hold a depth and children by the byte there (-1: the string
    ends); bytes between nodes are not kept. A string goes down blindly to some
    leaf, is compared with that leaf once, and is hung in where they part.
    """
    root: list = [None, [ids[0]]]  # leaf: [None, ids]; inner: [depth, children]
    for i in ids[1:]:
        x, node = strings[i], root
        while node[0] is not None:
            c = x[node[0]] if node[0] < len(x) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        n = common(x, other)
        if n == len(x) == len(other):
            node[1].append(i)
            continue
        here, there = (x[n] if n < len(x) else -1), (other[n] if n < len(other) else -1)
        node = root
        while node[0] is not None and node[0] < n:
            node = node[1][x[node[0]] if node[0] < len(x) else -1]
        if node[0] == n:
            node[1][here] = [None, [i]]
        else:
            node[:] = [n, {there: node[:], here: [None, [i]]}]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Lexicographic order of strings, and the common prefix of each with the next in it."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) < 2:
            order += ids
        elif depth >= shallow:
            order += blind_trie(strings, ids, depth)
        else:
            pivot = strings[ids[len(ids) // 2]][depth : depth + 8]
            less, same, more = [], [], []
            for i in ids:
                c = strings[i][depth : depth + 8]
                (same if c == pivot else less if c < pivot else more).append(i)
            stack.append((more, depth))
            if len(pivot) < 8:  # ended here: all equal
                stack += [([i], depth) for i in reversed(same)]
            else:
                stack.append((same, depth + 8))
            stack.append((less, depth))
    return order, [common(strings[i], strings[j]) for i, j in zip(order, order[1:])]


def shared_starts(group: list[tuple[bytes, int, int]], width: int, rank: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each of a gram's distinct contexts ``(bytes, lo, hi)`` the distances back from the anchor at which its window occurs in another;
    with ``rank`` in another of lower rank."""
    after, before = [c[hi:] for c, _, hi in group], [c[:hi][::-1] for c, _, hi in group]
    order, lcp = deep_shallow(after)
    n = len(group)
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    if n <= SMALL:
        for at, i in enumerate(order):
            _, lo, hi = group[i]
            for step in (-1, 1):
                j, right = at, width
                while 0 <= j + step < n:
                    right = min(right, lcp[j if step > 0 else j - 1])
                    j += step
                    if width - right > hi:
                        break
                    if rank and rank[order[j]] > rank[i]:
                        continue
                    p, q = max(lo, width - right), min(hi, common(before[i], before[order[j]]))
                    if p <= q:
                        out[i].append((p, q))
                        if p == lo and q == hi:
                            break
        return [merged(x) for x in out]
    back, back_lcp = deep_shallow(before)
    rank_after, rank_before = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_after[order], rank_before[back] = np.arange(n), np.arange(n)
    a, b = np.array(lcp), np.array(back_lcp)
    lo, hi = np.array([g[1] for g in group]), np.array([g[2] for g in group])
    ranks = np.array(rank) if rank else None
    points = np.unique(np.concatenate([lo, hi + 1, b + 1, width - a]))
    points = points[(points >= lo.min()) & (points <= hi.max())]
    for p, q in zip(points.tolist(), [*(points[1:] - 1).tolist(), int(hi.max())]):
        # classes of contexts that agree on ``p`` bytes before the anchor and on the rest of the window after it
        x = np.concatenate([[0], np.cumsum(a < width - p)])[rank_after]
        y = np.concatenate([[0], np.cumsum(b < p)])[rank_before]
        live = np.flatnonzero((lo <= p) & (p <= hi))
        classes, which, count = np.unique(x[live] * n + y[live], return_inverse=True, return_counts=True)
        again = count[which] > 1
        if rank:
            least = np.full(len(classes), n)
            np.minimum.at(least, which, ranks[live])
            again = ranks[live] > least[which]
        for i in live[again].tolist():
            out[i].append((p, q))
    return [merged(x) for x in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed integer intervals."""
    out: list[tuple[int, int]] = []
    for p, q in sorted(spans):
        if out and p <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], q))
        else:
            out.append((p, q))
    return out


def joined_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(key, begin, end)`` with the overlapping ones of each text joined."""
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for key, begin, end in spans:
        by[key].append((begin, end - 1))
    return [(key, p, q + 1) for key, own in by.items() for p, q in merged(own)]


class _Contexts:
    """Contexts of a task, each distinct one once; flushed as packed rows by bucket of the gram.

    A place is ``(first id of its text, key, position)``; with ``keep_first`` the least place of a context goes on as its place, else none does where there are several."""

    def __init__(self, buckets: int, keep_first: bool):
        self.buckets, self.keep_first, self.held, self.size = buckets, keep_first, defaultdict(list), 0

    def add(self, gram: int, width: int, context: bytes, lo: int, hi: int, ref: tuple[int, int, int]) -> None:
        places = self.held[gram, width, context, lo, hi]
        if not places:
            self.size += len(context) + 200
        if ref not in places:  # few, or known to repeat anyway
            places.append(ref)

    def flush(self) -> pa.RecordBatch:
        found, by = [], defaultdict(list)
        for (gram, width, context, lo, hi), places in self.held.items():
            one = min(places) if self.keep_first or len(places) == 1 else None
            if len(places) > 1:
                far, near = max(hi, 0), max(lo, 0)
                found += [(key, pos - far, pos - near + width) for r in places if r != one for _, key, pos in (r,)]
            by[gram % self.buckets].append((gram, width, context, lo, hi, one))
        spans = joined_spans(found)
        self.held.clear()
        self.size = 0
        squeeze = zstandard.ZstdCompressor(level=1)
        packed = [squeeze.compress(pickle.dumps(rows)) for rows in by.values()]
        columns = [
            pa.array([*by, *(s[0] % self.buckets for s in spans)], pa.int32()),
            pa.array([*packed, *[None] * len(spans)], pa.binary()),
            *(pa.array([*[None] * len(packed), *(s[c] for s in spans)], pa.int64()) for c in range(3)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "packed", "key", "begin", "end"])


def repeated_spans(kept: DataFrame, width: int, buckets: int, words: int | None = None, keep_first: bool = False) -> DataFrame:
    """``(key, begin, end)`` of repeated strings in the texts of ``kept (key, packed, anchors, first)``; those of words lie beyond the text's end.
    With ``keep_first`` without the place of each string that is least by (first, position)."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        expand, contexts, hashes = zstandard.ZstdDecompressor(), _Contexts(buckets, keep_first), WordHasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for key, packed, anchors, first in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    text = expand.decompress(packed)
                    size = len(text)
                    if words:
                        text += b"\0" + hashes.words(text).tobytes()  # a byte between, so that spans on both sides are not joined
                    for a in anchors:
                        pos, lo, hi = a["pos"], a["lo"], a["hi"]
                        own, step = (width, 1) if pos < size else (words * WORD, WORD)
                        if not a["hot"]:
                            contexts.add(a["gram"], own, text[pos - hi : pos - lo + own], lo, hi, (first, key, pos))
                            continue
                        for s in range(pos - hi, pos - lo + 1, step):
                            digest = hashlib.blake2b(text[s : s + own], digest_size=16).digest()
                            contexts.add(int.from_bytes(digest[:8], "little", signed=True), own, digest, -1, -1, (first, key, s))
                if contexts.size > 10_000_000:
                    yield contexts.flush()
        yield contexts.flush()

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        expand = zstandard.ZstdDecompressor()

        def finish(parts: list[bytes]) -> list[tuple[int, int, int]]:
            groups: dict[int, dict] = defaultdict(lambda: defaultdict(set))
            for packed in parts:
                for gram, own, context, lo, hi, ref in pickle.loads(expand.decompress(packed)):
                    groups[gram, own][context, lo, hi].add(ref)  # None: repeats where it came from
            out = []
            for (_, width), group in groups.items():
                for (_, lo, hi), refs in group.items():
                    if len(refs) > 1:
                        least = min(refs) if keep_first else None
                        out += [(r[1], r[2] - max(hi, 0), r[2] - max(lo, 0) + width) for r in refs if r and r != least]
                distinct = [c for c in group if c[2] >= 0]
                if len(distinct) > 1:
                    rank = None
                    if keep_first:
                        place = [min(group[c]) for c in distinct]
                        rank = [0] * len(place)
                        for k, i in enumerate(sorted(range(len(place)), key=place.__getitem__)):
                            rank[i] = k
                    for c, found in zip(distinct, shared_starts(distinct, width, rank)):
                        refs = group[c]
                        if keep_first or len(refs) == 1 and None not in refs:
                            _, key, pos = min(refs)
                            out += [(key, pos - q, pos - p + width) for p, q in found]
            return joined_spans(out)

        def rows(spans: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s[c] for s in spans], pa.int64()) for c in range(3)], ["key", "begin", "end"])

        current, parts = None, []
        for batch in batches:
            known = []
            for bucket, packed, key, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != current:
                    if parts:
                        yield rows(finish(parts))
                    current, parts = bucket, []
                if packed is None:
                    known.append((key, begin, end))
                else:
                    parts.append(packed)
            yield rows(known)
        if parts:
            yield rows(finish(parts))

    gathered = kept.mapInArrow(gather, "bucket int, packed binary, key long, begin long, end long")
    return gathered.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare, "key long, begin long, end long")


def remove_repeats(
    docs: DataFrame,
    width: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    kept_text: bool = False,
    gram: int = 32,
    hot_rows: int = 20_000,
    words: int | None = None,
    keep_first: bool = False,
) -> DataFrame:
    """``(id, *keep, n_bytes, n_removed, n_spans, kept_sha256)`` for every row, and with ``kept_text`` the text that is left."""
    docs = docs.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_k_{c}") for c in keep), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("_text")).withColumn("key", F.xxhash64("_text"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 1 << max(6, math.ceil(math.log2(2 * tasks)))  # a task sends a row for each at most
    long_ = F.octet_length("_text") >= width
    if words:
        own_words = F.size(F.filter(F.split(F.col("_text").cast("string"), r"[ \t\n\r\x0B\f]+"), lambda w: w != ""))
        long_ = F.when(long_ | (F.octet_length("_text") < 2 * words - 1), long_).otherwise(own_words >= words)
    wide = docs.where(long_).select("key", "_text")
    place = F.coalesce(F.col("_id").cast("long"), F.lit((1 << 63) - 1)) if keep_first else F.lit(0).cast("long")
    firsts = cut(docs.groupBy("key").agg(F.min(place).alias("first"))) if keep_first else None

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        seen: set[int] = set()
        held: list[tuple[int, bytes]] = []
        size, hashes = 0, WordHasher()

        def rows() -> pa.RecordBatch:
            text, h, pos, lo, hi = find_anchors([t for _, t in held], width, gram)
            if words:
                begin = np.array([len(t) for _, t in held], np.int64)
                w_text, w_h, *w_at = find_anchors([hashes.words(t).tobytes() for _, t in held], words, WORD_GRAM, WORD)
                w_pos, w_lo, w_hi = (x * WORD for x in w_at)
                pairs = ((text, w_text), (h, ~w_h), (pos, begin[w_text] + 1 + w_pos), (lo, w_lo), (hi, w_hi))
                text, h, pos, lo, hi = (np.concatenate(x) for x in pairs)
            keys = np.array([k for k, _ in held], np.int64)
            held.clear()
            columns = [pa.array(h, pa.int64()), pa.array(keys[text], pa.int64()), pa.array(pos, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["gram", "key", "pos", "lo", "hi"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                if key in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                held.append((key, text))
                size += len(text)
                if size >= 1_000_000:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            key, packed = [], []
            for own, text in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                if own not in seen:
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(own)
                    key.append(own)
                    packed.append(squeeze.compress(text))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(packed, pa.binary())], ["key", "packed"])

    anchors = store(wide.mapInArrow(mark, "gram long, key long, pos int, lo int, hi int"))
    counts = anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", (F.col("n") > hot_rows).alias("hot"))
    wanted = anchors.join(counts, "gram").groupBy("key").agg(F.collect_set(F.struct("gram", "pos", "lo", "hi", "hot")).alias("anchors"))
    kept = wide.mapInArrow(pack, "key long, packed binary").join(wanted, "key").dropDuplicates(["key"])
    kept = kept.join(firsts, "key") if keep_first else kept.withColumn("first", place)
    kept = cut(kept.select("key", "packed", "anchors", "first"))
    discard(anchors)
    spans = repeated_spans(kept, width, buckets, words, keep_first).groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for key, packed, found in zip(*(c.to_pylist() for c in batch.columns)):
                text, parts, last, removed = expand.decompress(packed), [], 0, 0
                own = [(s["begin"], s["end"] - 1) for s in found]
                beyond = merged([(p - len(text) - 1, q - len(text) - 1) for p, q in own if p > len(text)])
                runs = merged([x for x in own if x[0] < len(text)] + (word_spans(text, beyond) if beyond else []))
                for p, q in runs:
                    parts.append(text[last:p])
                    last, removed = q + 1, removed + q + 1 - p
                rest = b"".join([*parts, text[last:]])
                out.append((key, removed, len(runs), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if kept_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "removed", "spans", "sha", "rest"])

    cleaned = kept.select("key", "packed").join(spans, "key").mapInArrow(clean, "key long, removed long, spans long, sha string, rest string")
    copies = wide.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = docs.select("_id", *(f"_k_{c}" for c in keep), "key", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("own_sha"), place.alias("place"), *([F.col("_text")] if kept_text else []))
    joined = rows.join(copies, "key", "left").join(cleaned, "key", "left")
    whole = F.col("copies").isNotNull()
    if keep_first:
        joined = joined.join(firsts, "key")
        whole = whole & (F.col("place") > F.col("first"))
    columns = [
        F.col("_id").alias(id_col),
        *(F.col(f"_k_{c}").alias(c) for c in keep),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "own_sha")).alias("kept_sha256"),
    ]
    if kept_text:
        columns.append(F.when(whole, F.lit("")).otherwise(F.coalesce("rest", F.col("_text").cast("string"))).alias("kept_text"))
    return joined.select(*columns)
