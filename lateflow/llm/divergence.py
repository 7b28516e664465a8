"""Source divergence audit: which terms each source of a language over-uses, and how far sources lie apart.

Terms are runs of letters (ASCII letters, lower-cased, and all bytes from 0x80 up). A language keeps the terms
that occur in at least ``min_docs`` of its documents.

Iceberg prefix refinement finds them. Documents are read once and packed into chunks: the chunk's distinct terms,
sorted, and per document the numbers of its distinct terms with their uses. Levels then take byte prefixes of
growing length (three, then doubled each time). At each level a chunk counts, per language, the documents that hold each
prefix, only for prefixes that extend a survivor of the level before; counts are added up over chunks, and
prefixes in fewer than ``min_docs`` documents are discarded. A term that ends within the level's length is
complete, and kept if it survives. Refinement ends when no incomplete prefix survives. The long tail of rare
terms therefore ends at short prefixes and is never shuffled as terms.

Survivors go to the chunks as a bitmap of fixed size (``filter_bits``), made by the tasks that hold them. A false hit makes a chunk
count a few prefixes in vain, whose exact counts then discard them, so results are exact at any size; there is no cap
on survivors.

Shares are integers per billion with add-five smoothing. The distance of two sources is summed over blocks of terms
as matrices of sources by terms; blocks hold about ``block_rows`` counts, and sources are cut into tiles, so a language that holds a
third of all rows is spread over many tasks. One row per pair of sources of a language is returned: square in the sources, never in
documents or terms.

Defined cases: null text, language and source count as empty strings; a document without terms still makes
its group occur; with no kept terms all distances are 0; repeated rows count each; ties rank by item, bytewise; very long texts are
cut between terms while being counted; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lateflow.llm.common import cut, discard, raw_bytes, release_worker, store

UNIT = 1_000_000_000
SMOOTH = 5
#: Letters lower-cased, bytes from 0x80 up as they are, anything else a blank.
TERM_BYTES = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
PIECE = 1 << 20
CHUNK = "langs array<string>, sources array<string>, doc_group binary, doc_sizes binary, term binary, uses binary, terms array<binary>"


def terms_of(text: bytes) -> tuple[Iterable[bytes], Iterable[int], int]:
    """Terms of a text, their uses and their number: each use by itself, or for a long text each distinct term once."""
    letters = text.translate(TERM_BYTES)
    if len(letters) <= PIECE:
        found = letters.split()
        return found, repeat(1, len(found)), len(found)
    out, at = Counter(), 0
    while at < len(letters):
        end = letters.find(b" ", at + PIECE)
        end = len(letters) if end < 0 else end
        out.update(letters[at:end].split())
        at = end
    return out, out.values(), len(out)


class _Chunk:
    """Documents packed as arrays."""

    def __init__(self):
        self.groups, self.numbers = {}, defaultdict(count().__next__)
        self.doc_group, self.sizes, self.term, self.uses, self.bytes = array("i"), array("i"), array("i"), array("i"), 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        found, uses, n = terms_of(text)
        self.doc_group.append(self.groups.setdefault((lang, source), len(self.groups)))
        self.sizes.append(n)
        self.term.extend(map(self.numbers.__getitem__, found))
        self.uses.extend(uses)
        self.bytes += len(text)

    def pack(self) -> pa.RecordBatch:
        terms = sorted(self.numbers)
        place = np.empty(len(terms), np.int64)
        place[np.fromiter(map(self.numbers.__getitem__, terms), np.int64, len(terms))] = np.arange(len(terms))
        doc = np.repeat(np.arange(len(self.sizes)), np.frombuffer(self.sizes, np.int32))
        key = doc * max(1, len(terms)) + place[np.frombuffer(self.term, np.int32)] if self.term else np.zeros(0, np.int64)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        uses = np.add.reduceat(np.frombuffer(self.uses, np.int32)[order], first) if len(key) else key
        sizes = np.bincount(key[first] // max(1, len(terms)), minlength=len(self.sizes))
        arrays = [np.array(self.doc_group, np.int32), sizes.astype(np.int32), (key[first] % max(1, len(terms))).astype(np.int32), uses.astype(np.int32)]
        columns = [[[g[0] for g in self.groups]], [[g[1] for g in self.groups]], *([a.tobytes()] for a in arrays), [terms]]
        kinds = [pa.list_(pa.string())] * 2 + [pa.binary()] * 4 + [pa.list_(pa.binary())]
        names = ["langs", "sources", "doc_group", "doc_sizes", "term", "uses", "terms"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _pack(chunk_bytes: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        chunk = _Chunk()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, sources = (part.column(c).to_pylist() for c in ("lang", "source"))
                for lang, source, text in zip(langs, sources, raw_bytes(part.column("text"))):
                    chunk.add(lang, source, text)
                    if chunk.bytes >= chunk_bytes or len(chunk.sizes) >= 50_000:
                        yield chunk.pack()
                        chunk = _Chunk()
        if chunk.sizes:
            yield chunk.pack()

    return run


class _Read:
    """A packed chunk with its languages numbered."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        value = lambda name: batch.column(name)[i]
        packed = lambda name, kind: np.frombuffer(value(name).as_buffer(), kind)
        self.group_langs, self.group_sources = value("langs").as_py(), value("sources").as_py()
        self.langs = sorted(set(self.group_langs))
        number = {x: k for k, x in enumerate(self.langs)}
        of_group = np.array([number[x] for x in self.group_langs], np.int64)
        sizes, self.term, self.uses = packed("doc_sizes", np.int32), packed("term", np.int32), packed("uses", np.int32)
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.group = packed("doc_group", np.int32)[self.doc]
        self.lang = of_group[self.group]
        self.terms = value("terms").values.to_numpy(zero_copy_only=False).tolist()
        self.sizes = np.fromiter(map(len, self.terms), np.int64, len(self.terms))


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Read]:
    for batch in batches:
        for i in range(batch.num_rows):
            if (chunk := _Read(batch, i)).terms:
                yield chunk


class _Sums:
    """Counts by group and byte string, added up over the chunks of a task and handed on within a bound."""

    def __init__(self, names: list[str], kinds: list[pa.DataType], most: int = 150_000):
        self.names, self.kinds, self.most = names, kinds, most
        self.by, self.size = defaultdict(dict), 0

    def add(self, group: tuple, values: list[bytes], counts: list[int]) -> None:
        own = self.by[group]
        before = len(own)
        for v, n in zip(values, counts):
            own[v] = own.get(v, 0) + n
        self.size += len(own) - before

    def rows(self) -> pa.RecordBatch:
        sizes = [len(own) for own in self.by.values()]
        groups = [pa.array(np.repeat(np.array([g[i] for g in self.by], object), sizes), k) for i, k in enumerate(self.kinds)]
        values = pa.array([v for own in self.by.values() for v in own], pa.binary())
        counts = pa.array([n for own in self.by.values() for n in own.values()], pa.int64())
        self.by, self.size = defaultdict(dict), 0
        return pa.RecordBatch.from_arrays([*groups, values, counts], self.names)


def _tally(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (all below ``size``) in order, and how often each occurs."""
    if size > 4 * len(key) + 1_000_000:
        return np.unique(key, return_counts=True)
    times = np.bincount(key, minlength=size)
    at = np.flatnonzero(times)
    return at, times[at]


def hashes(langs: list[str], lang: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of (language, byte string) keys. Strings are padded to the next power of two, size by size."""
    seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
    h = seeds[lang] if len(langs) else np.zeros(0, np.uint64)
    width, done = 8, 0
    while done < len(values):
        own = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 8 else -1)))
        words = values[own].astype(f"S{width}").view(np.uint64).reshape(len(own), width // 8)
        x = h[own]
        for column in range(width // 8):
            x = (x ^ words[:, column]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
        h[own] = x
        width, done = 2 * width, done + len(own)
    return h


def padded(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as an array (of fixed width while they are short) and their sizes."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return np.array(values, f"S{max(1, sizes.max(initial=0))}" if sizes.max(initial=0) <= 64 else object), sizes


class Filter:
    """A bitmap of fixed size of (language, prefix) keys: never misses one, and may let others through."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(64 * len(self.words) - 1)
        hit = np.ones(len(h), bool)
        for at in (h & mask, (h >> np.uint64(32)) & mask):
            hit &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) == 1
        return hit

    @classmethod
    def of(cls, rows: DataFrame, bits: int) -> Filter:
        """From rows with ``lang`` and ``prefix``; what is collected is one number for each 64 bits at most."""

        def own(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros(bits // 64, np.uint64)
            for batch in batches:
                langs = batch.column(0).dictionary_encode()
                h = hashes(langs.dictionary.to_pylist(), langs.indices.to_numpy(), *padded(batch.column(1).to_pylist()))
                for at in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
                    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            some = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some].view(np.int64), pa.int64())], ["word", "bits"])

        sums = rows.select("lang", "prefix").mapInArrow(own, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        words = np.zeros(bits // 64, np.uint64)
        words[sums["word"].to_numpy(np.int64)] = sums["bits"].to_numpy(np.int64).view(np.uint64)
        return cls(words)


class _Items:
    """Prefixes of some of a chunk's terms: ``of_term`` numbers the items, ``values`` are their bytes, ``whole`` those that are whole terms.

    All ``terms`` are longer than half of ``length``, so padding at most doubles them."""

    def __init__(self, chunk: _Read, terms: np.ndarray, length: int):
        short = length <= 64
        cuts = [chunk.terms[t][:length] for t in terms.tolist()]
        self.values = np.array(cuts, f"S{length}" if short else object)
        self.sizes = np.minimum(chunk.sizes[terms], length)
        self.whole = chunk.sizes[terms] <= length
        new = np.ones(len(cuts), bool)
        new[1:] = (self.values[1:] != self.values[:-1]) | (self.whole[1:] != self.whole[:-1])
        self.of_term = np.zeros(len(chunk.terms), np.int64)
        self.of_term[terms] = np.cumsum(new) - 1
        self.values, self.sizes, self.whole = self.values[new], self.sizes[new], self.whole[new]

    def __len__(self):
        return len(self.values)


def _terms_of(chunk: _Read, rows: np.ndarray) -> np.ndarray:
    return _tally(chunk.term[rows], len(chunk.terms))[0]


def _held(chunk: _Read, kept: Filter, items: _Items, rows: np.ndarray) -> np.ndarray:
    """Of the chunk's entries ``rows`` those whose (language, item) the filter holds; each such key is looked up once."""
    n = max(1, len(items))
    key = chunk.lang[rows] * n + items.of_term[chunk.term[rows]]
    seen, _ = _tally(key, len(chunk.langs) * n)
    hit = seen[kept.holds(hashes(chunk.langs, seen // n, items.values[seen % n], items.sizes[seen % n]))]
    if len(chunk.langs) * n <= 4 * len(key) + 1_000_000:
        table = np.zeros(len(chunk.langs) * n, bool)
        table[hit] = True
        return rows[table[key]]
    return rows[np.isin(key, hit)]


def _level(before: int, length: int, kept: Filter | None) -> Callable:
    """Documents for each prefix of ``length`` bytes that extends a survivor of length ``before``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        sums = _Sums(["lang", "whole", "prefix", "docs"], [pa.string(), pa.bool_()])
        for chunk in _chunks(batches):
            rows = np.flatnonzero((chunk.sizes > before)[chunk.term])
            if kept is not None:
                rows = _held(chunk, kept, _Items(chunk, _terms_of(chunk, rows), before), rows)
            items = _Items(chunk, _terms_of(chunk, rows), length)
            doc, own, n = chunk.doc[rows], items.of_term[chunk.term[rows]], max(1, len(items))
            # a document's terms are sorted, so its uses of one prefix lie side by side
            new = np.ones(len(rows), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
            key, docs = _tally(chunk.lang[rows][new] * n + own[new], len(chunk.langs) * n)
            for k, lang in enumerate(chunk.langs):
                of_lang = slice(*np.searchsorted(key, [k * n, (k + 1) * n]))
                at, times = key[of_lang] - k * n, docs[of_lang]
                for whole in (False, True):
                    some = items.whole[at] == whole
                    sums.add((lang, whole), items.values[at[some]].tolist(), times[some].tolist())
            if sums.size > sums.most:
                yield sums.rows()
        yield sums.rows()

    return run


def _uses(kept: Filter) -> Callable:
    """Uses of each kept term by language and source."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_worker()
        sums = _Sums(["lang", "source", "prefix", "uses"], [pa.string(), pa.string()], 400_000)
        for chunk in _chunks(batches):
            n = len(chunk.terms)
            values, sizes = padded(chunk.terms)
            key = chunk.lang * n + chunk.term
            seen, _ = _tally(key, len(chunk.langs) * n)
            held = seen[kept.holds(hashes(chunk.langs, seen // n, values[seen % n], sizes[seen % n]))]
            rows = np.flatnonzero(np.isin(key, held, kind="table") if len(chunk.langs) * n < 50_000_000 else np.isin(key, held))
            entry = chunk.group[rows].astype(np.int64) * n + chunk.term[rows]
            key, _ = _tally(entry, len(chunk.group_langs) * n)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, np.searchsorted(key, entry), chunk.uses[rows])
            for k, group in enumerate(zip(chunk.group_langs, chunk.group_sources)):
                own = slice(*np.searchsorted(key, [k * n, (k + 1) * n]))
                sums.add(group, [chunk.terms[t] for t in (key[own] - k * n).tolist()], total[own].tolist())
            if sums.size > sums.most:
                yield sums.rows()
        yield sums.rows()

    return run


def iceberg_terms(chunks: DataFrame, min_docs: int, first: int = 3, filter_bits: int = 1 << 23) -> DataFrame:
    """``(lang, prefix, docs)`` of the complete terms in at least ``min_docs`` documents of a language, by prefix refinement."""
    before, length, kept, found = 0, first, None, None
    while True:
        counted = chunks.mapInArrow(_level(before, length, kept), "lang string, whole boolean, prefix binary, docs bigint")
        survivors = cut(counted.groupBy("lang", "prefix", "whole").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs))
        whole = survivors.where("whole").select("lang", "prefix", "docs")
        found = whole if found is None else found.unionByName(whole)
        alive = survivors.where("not whole")
        if alive.isEmpty():
            return found
        kept, before, length = Filter.of(alive, filter_bits), length, 2 * length


def share(uses: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (uses + 5) / (total + 5 terms)) in exact arithmetic; 0 without terms."""
    wide = lambda c: c.cast("decimal(38,0)")
    top = (wide(uses + SMOOTH) * F.lit(UNIT)).cast("decimal(38,0)")
    return F.when(terms > 0, F.call_function("div", top, wide(total + terms * SMOOTH)) + 1).otherwise(0).cast("bigint")


def _distances(tiles: int) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        base = rows[rows["prefix"].isna()].sort_values("source")
        names, rest = base["source"].tolist(), rows[rows["prefix"].notna()]
        place = {s: i for i, s in enumerate(names)}
        term, _ = pd.factorize(rest["prefix"])
        shares = np.repeat(base["p"].to_numpy(np.int64)[:, None], int(term.max(initial=-1)) + 1, 1)
        shares[rest["source"].map(place).to_numpy(np.int64), term] = rest["p"].to_numpy(np.int64)
        own = [i for i, t in enumerate(base["tile_of"]) if t == rows["tile"].iloc[0]]
        value = [np.abs(shares - shares[i]).sum(1) for i in own]
        out = [(names[i], names[j], int(v[j])) for i, v in zip(own, value) for j in range(len(names)) if i != j]
        frame = pd.DataFrame(out, columns=["source", "item", "value"]).astype({"value": "int64"})
        frame.insert(0, "lang", rows["lang"].iloc[0])
        return frame

    return run


def audit(
    docs: DataFrame,
    min_docs: int = 30,
    top: int = 50,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    chunk_bytes: int = 4 << 20,
    filter_bits: int = 1 << 23,
    block_rows: int = 50_000,
    tile_sources: int = 256,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other source of the language by distance, part ``term`` the ``top``
    terms whose share in the source exceeds their share in the language by most."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    read = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).alias("text"))
    chunks = store(read.mapInArrow(_pack(chunk_bytes), CHUNK))
    groups = cut(chunks.select(F.explode(F.arrays_zip("langs", "sources")).alias("g")).select("g.langs", "g.sources").distinct().toDF("lang", "source"))
    kept = cut(iceberg_terms(chunks, min_docs, filter_bits=filter_bits))
    counted = chunks.mapInArrow(_uses(Filter.of(kept, filter_bits)), "lang string, source string, prefix binary, uses bigint")
    uses = cut(counted.groupBy("lang", "source", "prefix").agg(F.sum("uses").alias("uses")).join(kept.select("lang", "prefix"), ["lang", "prefix"], "left_semi"))
    discard(chunks)

    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = uses.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    per_lang = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    known = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").join(per_lang, "lang", "left")
    known = cut(known.select("lang", "source", zero("total"), zero("terms"), zero("lang_total")))
    shares = uses.join(known, ["lang", "source"]).withColumn("p", share(F.col("uses"), F.col("total"), F.col("terms")))

    in_lang = F.sum("uses").over(Window.partitionBy("lang", "prefix"))  # at most a row for each source
    over = shares.withColumn("q", share(in_lang, F.col("lang_total"), F.col("terms"))).where("p > q")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    term_part = over.select("lang", "source", F.col("prefix").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term_part = term_part.withColumn("rank", rank).where(F.col("rank") <= top)

    # blocks and tiles follow the counts and the sources of the largest language
    most = uses.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    wide = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks, tiles = -(-most // block_rows) or 1, -(-wide // tile_sources) or 1
    tile = lambda: F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    base = known.select(
        "lang",
        "source",
        F.lit(None).cast("binary").alias("prefix"),
        share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms")).alias("p"),
        F.pmod(F.xxhash64("source"), F.lit(tiles)).cast("int").alias("tile_of"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )
    cells = shares.select("lang", "source", "prefix", "p", F.lit(None).cast("int").alias("tile_of"), F.pmod(F.xxhash64("prefix"), F.lit(blocks)).cast("int").alias("block"))
    parts = base.unionByName(cells).select("*", tile()).groupBy("lang", "block", "tile").applyInPandas(_distances(tiles), "lang string, source string, item string, value bigint")
    pair_part = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", rank)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("bigint").alias("value"), "rank")
    return out(pair_part, "pair").unionByName(out(term_part, "term"))
