"""Cached piece encoders and BPE by tree concatenation.

A text without safe places to split is cut into leaves at arbitrary places and
the leaves are encoded apart, by different tasks. Neighbouring leaves are then
joined two and two, up a tree: a window of tokens on both sides of the join is
encoded again and grows until both sides agree exactly. They agree where the
new tokens repeat the old ones on either side and each repeated stretch holds
a *lock*: a place between two characters where the pre-tokenizer splits in any
context. Inside one unbroken run (no lock at all), tokens that repeat on both
sides suffice: a token sequence is the BPE encoding when every two neighbours
are each other's encoding, and the pairs at both seams were already encoded so.

Within a leaf, text is cut only before a single space, which always starts a
new pre-token, and the pieces are encoded by the tokenizers library once per
worker and kept in a bounded cache. Arrow cuts and numbers the pieces of many texts at once; new ones are
encoded in runs, whose ids fall apart at the pieces' bytes; ids are spelled and decoded a column at a time.

Defined cases: null is the empty text, with no ids; bytes that are no UTF-8 are
read as U+FFFD; repeated rows and ids each give a row; an empty table gives no
rows; further columns are not read. Special tokens in a text become their ids,
as in the library.
"""

from __future__ import annotations

import array
import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateflow.llm.common import texts, worker_state

CACHED_PIECES = 400_000  # entries a worker keeps, unless told otherwise; about 80 MB
LONG_PIECE = 64  # characters; longer pieces seldom recur and are not kept

_RUN = 50  # new pieces encoded together

_AFTER_SPACE = re.compile(r" \s")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")
# Always a boundary of the byte-level pre-tokenizer, whatever stands around.
_LOCK = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])|(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])")


def split_on_spaces(text: str) -> list[str]:
    """Pieces that the byte-level pre-tokenizer always keeps apart."""
    if _AFTER_SPACE.search(text) or text[-1:] == " ":
        return _BEFORE_SPACE.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def split_words(text: str) -> list[str]:
    """Pieces between spaces and line ends, for vocabularies that drop white space."""
    return text.replace("\n", " ").split(" ")


class PieceEncoder:
    """A tokenizer file with a bounded cache from pieces to packed ids (unsigned, 32 bits, little-endian)."""

    def __init__(self, path: str, split=split_on_spaces, bound: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer, self.split, self.bound, self.cache = Tokenizer.from_file(path), split, bound, {"": b""}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            added = json.load(f)["added_tokens"]
        self.special = {x["content"]: x["id"] for x in added}
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if added else None

    def pieces(self, text: str) -> list[str]:
        if self.at_special and any(s in text for s in self.special):
            return [p for part in self.at_special.split(text) if part for p in ([part] if part in self.special else self.split(part))]
        return self.split(text)

    def encode_new(self, part: list[str]) -> list[bytes]:
        """Packed ids of pieces that the cache does not hold."""
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def encode_pieces(self, many: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of pieces."""
        passing = self._fill(set().union(*many))
        out = [b"".join(map(self.cache.__getitem__, pieces)) for pieces in many]
        for piece in passing:
            del self.cache[piece]
        return out

    def lookup(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each of many different pieces."""
        passing = self._fill(pieces)
        out = list(map(self.cache.__getitem__, pieces))
        for piece in passing:
            del self.cache[piece]
        return out

    def _fill(self, wanted: Iterable[str]) -> list[str]:
        """Bring different pieces into the cache; returns those that are not to stay there."""
        cache, new = self.cache, self._missing(wanted)
        passing = []
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for piece, packed in zip(part, self.encode_new(part)):
                cache[piece] = packed
                if len(piece) > LONG_PIECE:
                    passing.append(piece)
        return passing

    def _missing(self, wanted: Iterable[str]) -> list[str]:
        """Pieces that the cache, with room made for them, does not hold."""
        new = [p for p in wanted if p not in self.cache]
        if len(self.cache) + len(new) > self.bound:
            self.cache.clear()
            new = list(wanted)
        return new

    def encode(self, text: str) -> bytes:
        return self.encode_pieces([self.pieces(text)])[0]


class ByteLevelBPE(PieceEncoder):
    """Adds the bytes of every id: decoding, and the joins of the tree."""

    def __init__(self, path: str):
        super().__init__(path)
        self.older: dict[str, bytes] = {}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in byte_of for c in token)
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.decoded_of = pa.array(self.bytes_of, pa.large_binary())
        self.spelled_of = pa.array([b"%d," % i for i in range(len(self.bytes_of))], pa.large_binary())

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def _missing(self, wanted: Iterable[str]) -> list[str]:
        """As the cache fills by half, what it holds grows old: pieces wanted again are taken over, the others go the next time."""
        new = [p for p in wanted if p not in self.cache]
        if len(self.cache) + len(new) > self.bound // 2:
            self.older, self.cache = dict(self.cache), self.cache
            self.cache.clear()
            new = list(wanted)
        older = self.older
        self.cache.update([(p, older[p]) for p in new if p in older])
        return [p for p in new if p not in older]

    def encode_new(self, part: list[str]) -> list[bytes]:
        """Pieces of a space and a word stay apart in a run too; a run whose tokens do not end where each piece does is encoded piece by piece."""
        out: list = [None] * len(part)
        alike = [i for i, p in enumerate(part) if len(p) > 1 and p[0] == " " and not p[1].isspace() and not p[-1].isspace()]
        runs = [alike[at : at + _RUN] for at in range(0, len(alike), _RUN)]
        apart = [[part[i] for i in run] for run in runs]
        for run, pieces, e in zip(runs, apart, self.tokenizer.encode_batch_fast(["".join(x) for x in apart], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.append(0, np.cumsum(self.length_of[ids]))
            bounds = np.cumsum([0, *map(len, map(str.encode, pieces))])
            at = np.searchsorted(ends, bounds)
            if ends[-1] == bounds[-1] and (ends[at] == bounds).all():
                packed, at = ids.tobytes(), (at * 4).tolist()
                for i, p, q in zip(run, at, at[1:]):
                    out[i] = packed[p:q]
        rest = [i for i, p in enumerate(out) if p is None]
        for i, p in zip(rest, super().encode_new([part[i] for i in rest])):
            out[i] = p
        return out

    def encode_texts(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the last one's end)."""
        plain = [not (t.endswith(" ") or "\0" in t or any(s in t for s in self.special) or _AFTER_SPACE.search(t)) for t in many]
        order = np.argsort(~np.array(plain, bool), kind="stable")
        column = pa.array([t for t, p in zip(many, plain) if p], pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(column, " ", "\0 "), "\0")
        others = [self.pieces(t) for t, p in zip(many, plain) if not p]
        words = pa.concat_arrays([cut.flatten(), pa.array([p for x in others for p in x], pa.large_string())]).dictionary_encode()
        packed = self.lookup(words.dictionary.to_pylist())
        ids, sizes = np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        counts = np.concatenate([np.diff(cut.offsets.to_numpy()), np.fromiter(map(len, others), np.int64, len(others))])
        back = np.argsort(order, kind="stable")
        index = words.indices.to_numpy()[ranges((np.cumsum(counts) - counts)[back], counts[back])]
        ends = np.append(0, np.cumsum(sizes[index]))
        return ids[ranges((np.cumsum(sizes) - sizes)[index], sizes[index])], ends[np.append(0, np.cumsum(counts[back]))]

    def join(self, left: tuple[str, bytes], right: tuple[str, bytes], window: int = 8) -> tuple[str, bytes]:
        """Encoding of two neighbouring texts from the encodings of each."""
        text = left[0] + right[0]
        a, b = np.frombuffer(left[1], "<u4"), np.frombuffer(right[1], "<u4")
        if not len(a) or not len(b):
            return text, left[1] + right[1]
        a_bytes, b_bytes = left[0].encode(), right[0].encode()
        while window < max(len(a), len(b)):
            i, j = min(window, len(a)), min(window, len(b))
            x = a_bytes[len(a_bytes) - int(self.length_of[a[-i:]].sum()) :]
            y = b_bytes[: int(self.length_of[b[:j]].sum())]
            window *= 2
            if x[0] & 0xC0 == 0x80 or (len(y) < len(b_bytes) and b_bytes[len(y)] & 0xC0 == 0x80):
                continue  # the window would begin or end inside a character
            middle = np.frombuffer(self.encode((x + y).decode()), "<u4")
            n = min(i, len(middle))
            same = int(np.argmin(np.append(middle[:n] == a[-i:][:n], False)))
            m = min(j, len(middle))
            alike = int(np.argmin(np.append(middle[::-1][:m] == b[:j][::-1][:m], False)))
            if (i == len(a) or self._holds(x, middle[:same], 0)) and (j == len(b) or self._holds(y, middle[len(middle) - alike :], len(y))):
                return text, a[: len(a) - i].tobytes() + middle.tobytes() + b[j:].tobytes()
        return text, self.encode(text)

    def _holds(self, part: bytes, agreed: np.ndarray, end: int) -> bool:
        """Whether the agreed tokens at the outer end of a window fix all beyond them."""
        n = int(self.length_of[agreed].sum())
        stretch = (part[:n] if not end else part[len(part) - n :]).decode("utf-8", "ignore")
        if not len(agreed):
            return False
        if any(0 < m.start() < len(stretch) for m in _LOCK.finditer(stretch)):
            return True
        whole = part.decode("utf-8", "ignore")
        return len(agreed) >= 4 and not any(0 < m.start() < len(whole) for m in _LOCK.finditer(whole)) and bool(regex.fullmatch(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+| +", whole))

    def tree(self, parts: list[tuple[str, bytes]]) -> bytes:
        """Join neighbouring leaves two and two until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0][1] if parts else b""

    def leaves(self, text: str, size: int) -> list[tuple[int, str]]:
        """(number of the unsplit stretch, leaf); special tokens stand between stretches."""
        stretches = self.at_special.split(text) if self.at_special else [text]
        out = []
        for k, s in enumerate(stretches):
            n = 1
            while len(s) > size * n:
                n *= 2  # halves of halves
            cuts = [len(s) * i // n for i in range(n + 1)]
            out += [(k, s[p:q]) for p, q in zip(cuts, cuts[1:]) if q > p]
        return out

    def concatenate(self, leaves: list[tuple[int, str, bytes]]) -> bytes:
        """Ids of a whole text from its encoded leaves, in order."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for k, s, ids in leaves:
            by.setdefault(k, []).append((s, ids))
        return b"".join(self.tree(by[k]) for k in sorted(by))

    def encode_whole(self, text: str, size: int) -> bytes:
        """The whole tree in one place (for tests, and for callers outside Spark)."""
        return self.concatenate([(k, s, self.encode(s)) for k, s in self.leaves(text, size)])


def byte_level(path: str) -> ByteLevelBPE:
    return worker_state(("byte_level", path), lambda: ByteLevelBPE(path))


_DIGESTS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_REAL = {"ids": pa.list_(pa.int32()), "decoded": pa.string()}


def _stretches(values: pa.Array, starts: np.ndarray) -> Iterator[memoryview]:
    """The bytes of neighbouring values, from each start to the next one."""
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset) if len(values) else np.zeros(1, np.int64)
    data = memoryview(values.buffers()[2]) if len(values) and values.buffers()[2] else memoryview(b"")
    at = offsets[starts].tolist()
    return (data[p:q] for p, q in zip(at, at[1:]))


def _outputs(bpe: ByteLevelBPE, ids: np.ndarray, starts: np.ndarray, outputs: tuple[str, ...]) -> list[pa.Array]:
    """Columns of the texts whose ids begin at ``starts`` (and end at the last of them)."""

    def decoded() -> Iterator[str]:
        return (str(x, "utf-8", "replace") for x in _stretches(bpe.decoded_of.take(pa.array(ids)), starts))

    column = {
        "n_tokens": lambda: np.diff(starts),
        "ids": lambda: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view(np.int32))),
        "decoded": lambda: list(decoded()),
        "ids_sha256": lambda: [hashlib.sha256(x[:-1]).hexdigest() for x in _stretches(bpe.spelled_of.take(pa.array(ids)), starts)],
        "decoded_sha256": lambda: [hashlib.sha256(x.encode()).hexdigest() for x in decoded()],
    }
    made = [column[c]() for c in outputs]
    return [x.cast(_REAL["ids"]) if isinstance(x, pa.Array) else pa.array(x, (_DIGESTS | _REAL)[c]) for x, c in zip(made, outputs)]


def encode_decode(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf_chars: int = 16_384,
    outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"),
) -> DataFrame:
    """Encode and decode every text; ``outputs`` names the columns wanted beside the id.

    Texts of up to ``leaf_chars`` are one leaf and are encoded where they are
    read. The leaves of longer texts (each distinct text once) are dealt out
    over the tasks, encoded, and concatenated per text.
    """
    types = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    made = ", ".join(f"{c} {types[c]}" for c in outputs)
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    is_long = F.coalesce(F.length("_text") > leaf_chars, F.lit(False))
    kind = docs.schema["_id"].dataType.simpleString()

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_level(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), *_outputs(bpe, *bpe.encode_texts(texts(part.column(1))), outputs)], ["_id", *outputs])

    def cut_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_level(path)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                found = bpe.leaves(text, leaf_chars)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array([k for k, _ in found], pa.int32()), pa.array([s for _, s in found], pa.string())], ["_key", "_leaf", "_stretch", "_part"])

    def encode_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_level(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, starts = bpe.encode_texts(texts(part.column(3)))
                packed = [ids[p:q].tobytes() for p, q in zip(starts, starts[1:])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary())], ["_key", "_leaf", "_stretch", "_part", "_ids"])

    def join_leaves(table: pa.Table) -> pa.Table:
        bpe = byte_level(path)
        table = table.sort_by("_leaf")
        columns = [table.column(c).to_pylist() for c in ("_stretch", "_part", "_ids")]
        whole = np.frombuffer(bpe.concatenate(list(zip(*columns))), "<u4")
        return pa.Table.from_arrays([table.column("_key").slice(0, 1).combine_chunks(), *_outputs(bpe, whole, np.array([0, len(whole)]), outputs)], ["_key", *outputs])

    near = docs.where(~is_long).mapInArrow(short, f"_id {kind}, {made}")
    far = docs.where(is_long).withColumn("_key", F.sha2(F.col("_text").cast("binary"), 256))
    leaves = far.groupBy("_key").agg(F.first("_text").alias("_text")).mapInArrow(cut_leaves, "_key string, _leaf int, _stretch int, _part string")
    encoded = leaves.repartition("_key", "_leaf").mapInArrow(encode_leaves, "_key string, _leaf int, _stretch int, _part string, _ids binary")
    whole = encoded.groupBy("_key").applyInArrow(join_leaves, f"_key string, {made}")
    joined = far.select("_id", "_key").join(whole, "_key").select("_id", *outputs)
    return near.unionByName(joined).withColumnRenamed("_id", id_col)
