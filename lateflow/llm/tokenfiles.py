"""Token-id files: every document compressed by itself with a shared zstandard dictionary.

A file holds the documents of one range of ids, in ascending id order::

    magic "LFTOK001" | sha-256 of the dictionary (32 bytes; zeros: none) | frames | index | length of the index (8 bytes)

Each frame is the document's ids, unsigned 32-bit little-endian, as one
zstandard frame. The index is a zstandard frame too: number of documents, then
ids (int64), a byte for null ids, frame offsets (uint64, one more than
documents) and token counts (uint32). With the offsets one document is read and decompressed
without the others. The dictionary lies beside the files under its hash and is
trained on a bounded sample of serialized arrays (``sample_rows`` rows with the
smallest hashes among texts of up to ``sample_bytes``); all other work covers
every row.

Files are written by tasks under names of their own attempt; the manifest names
the files of the attempts that counted, so a lost executor leaves at most files
that nothing refers to.

Defined cases: null and empty texts hold only the end id; null ids sort first;
repeated ids and rows keep a place each; an empty table gives no files and no
rows; further columns are not read.
"""

from __future__ import annotations

import array
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lateflow.llm.bpe import PieceEncoder, split_words
from lateflow.llm.common import cut, hash_sample, shared_dir, texts, worker_state

MAGIC = b"LFTOK001"


# Letters whose small forms are single letters and that compose with nothing, then marks: one pre-token, or two.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([!-&(-/:-@\[-`{-~]*)")
_RUN = 50  # plain words encoded as one text


class WordEncoder(PieceEncoder):
    """Encodes a column at once: Arrow cuts its texts into words and numbers the distinct ones, so each is looked up once a column.

    New plain words are encoded in runs, with spaces between. Where the vocabulary marks the last token of a
    pre-token, the marks tell which ids belong to which word; a run whose marks do not add up is encoded word by word."""

    def __init__(self, path: str):
        super().__init__(path, split_words, bound=1_000_000)  # about 200 MB
        with open(path) as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        probes = ["a", "Bé", "a,", "Bé,%!"]
        self.marked = [int(self.last[np.frombuffer(x, "<u4")].sum()) for x in super().encode_new(probes)] == [1, 1, 2, 2]

    def encode_new(self, part: list[str]) -> list[bytes]:
        found = [_PLAIN.fullmatch(w) if self.marked else None for w in part]
        out: list = [None] * len(part)
        plain = [i for i, m in enumerate(found) if m]
        runs = [plain[at : at + _RUN] for at in range(0, len(plain), _RUN)]
        together = [" ".join([part[i] for i in run]) for run in runs]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(together, add_special_tokens=False)):
            packed = array.array("I", e.ids).tobytes()
            final = np.flatnonzero(self.last[np.frombuffer(packed, "<u4")])
            marks = np.cumsum([2 if found[i][1] else 1 for i in run])
            if len(final) == marks[-1] and (final[-1] + 1) * 4 == len(packed):
                ends = ((final[marks - 1] + 1) * 4).tolist()
                for i, p, q in zip(run, [0, *ends], ends):
                    out[i] = packed[p:q]
        rest = [i for i, p in enumerate(out) if p is None]
        for i, p in zip(rest, super().encode_new([part[i] for i in rest])):
            out[i] = p
        return out

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        column = pc.fill_null(column, "")
        if any(pc.any(pc.match_substring(column, s)).as_py() for s in self.special):
            return self.encode_pieces([self.pieces(t) for t in texts(column)])
        pieces = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        words = pieces.flatten().dictionary_encode()
        try:
            distinct = words.dictionary.to_pylist()
        except UnicodeDecodeError:
            return self.encode_pieces([self.pieces(t) for t in texts(column)])
        packed = self.lookup(distinct)
        ids, sizes = np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        index = words.indices.to_numpy()
        size = sizes[index]
        ends = np.cumsum(size)
        place = np.repeat((np.cumsum(sizes) - sizes)[index] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        bounds = (np.append(0, ends)[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()] * 4).tolist()
        data = ids[place].tobytes()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]


def _encoder(path: str) -> WordEncoder:
    return worker_state(("words", path), lambda: WordEncoder(path))


def _open(uri: str):
    """File system and path of a place in the shared folder."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _dictionary(data: bytes) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    return (hashlib.sha256(data).digest(), zstandard.ZstdCompressionDict(data)) if data else (bytes(32), None)


def train_dictionary(arrays: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; empty where the sample is too small to train one."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, arrays)) // 8)), arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


class FileWriter:
    def __init__(self, out, dictionary: bytes, level: int = 3):
        digest, shared = _dictionary(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=level)
        self.out, self.ids, self.nulls, self.offsets, self.counts = out, [], [], [len(MAGIC) + 32], []
        out.write(MAGIC + digest)

    def add(self, doc_id: int | None, packed: bytes) -> None:
        frame = self.compressor.compress(packed)
        self.out.write(frame)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.counts.append(len(packed) // 4)

    def close(self) -> None:
        parts = (np.array(self.ids, "<i8"), np.array(self.nulls, "u1"), np.array(self.offsets, "<u8"), np.array(self.counts, "<u4"))
        index = zstandard.ZstdCompressor().compress(struct.pack("<Q", len(self.ids)) + b"".join(p.tobytes() for p in parts))
        self.out.write(index + struct.pack("<Q", len(index)))
        self.out.close()


class FileReader:
    def __init__(self, uri: str):
        system, path = _open(uri)
        self.file = system.open_input_file(path)
        end = self.file.size()
        self.file.seek(end - 8)
        (n,) = struct.unpack("<Q", self.file.read(8))
        self.file.seek(end - 8 - n)
        index = zstandard.ZstdDecompressor().decompress(self.file.read(n))
        (n,) = struct.unpack_from("<Q", index)
        at, self.columns = 8, []
        for kind, count in (("<i8", n), ("u1", n), ("<u8", n + 1), ("<u4", n)):
            self.columns.append(np.frombuffer(index, kind, count, at))
            at += np.dtype(kind).itemsize * count
        self.ids, self.nulls, self.offsets, self.counts = self.columns
        self.file.seek(0)
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is no token file")
        digest, data = self.file.read(32), b""
        if digest != bytes(32):
            folder = path.rpartition("/")[0]
            with system.open_input_file(f"{folder}/{digest.hex()}.dict") as f:
                data = f.read()
            if hashlib.sha256(data).digest() != digest:
                raise ValueError(f"the dictionary of {uri} has another hash than the file names")
        shared = _dictionary(data)[1]
        self.decompressor = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def packed(self, i: int) -> bytes:
        """The ids of document ``i`` alone."""
        start, end = int(self.offsets[i]), int(self.offsets[i + 1])
        self.file.seek(start)
        return self.decompressor.decompress(self.file.read(end - start))


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    dictionary_bytes: int = 65_536,
    sample_rows: int = 1_000,
    sample_bytes: int = 16_384,
) -> DataFrame:
    """Write the files; returns the manifest ``(file, n_docs, n_tokens, n_bytes, start)``, a row for each file in id order."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))

    sample = hash_sample(docs.where(F.octet_length("_text") <= sample_bytes), sample_rows, "_id").select("_text")
    encoder = PieceEncoder(tokenizer, split_words)
    tail = np.array([end_id], "<u4").tobytes()
    arrays = encoder.encode_pieces([encoder.pieces(r["_text"]) for r in sample.collect()])
    dictionary = train_dictionary([a + tail for a in arrays], dictionary_bytes)
    encoder.cache.clear()
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    if dictionary:
        with system.open_output_stream(f"{path}/{hashlib.sha256(dictionary).hexdigest()}.dict") as f:
            f.write(dictionary)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, n_tokens, uri = _encoder(tokenizer), None, 0, ""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if out is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.tok"
                    place, name = _open(uri)
                    place.create_dir(name.rpartition("/")[0], recursive=True)
                    out, first = FileWriter(place.open_output_stream(name), dictionary), part.column(0)[0].as_py()
                packed = encode.encode_column(part.column(1))
                for doc_id, p in zip(part.column(0).to_pylist(), packed):
                    out.add(doc_id, p + tail)
                    n_tokens += len(p) // 4 + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": uri, "first_id": first, "partition": None, "n_docs": len(out.ids), "n_tokens": n_tokens, "n_bytes": out.offsets[-1]}], _MANIFEST)

    ordered = docs.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.xxhash64("_text"))
    files = ordered.mapInArrow(write, "file string, first_id long, partition int, n_docs long, n_tokens long, n_bytes long")
    files = cut(files.withColumn("partition", F.spark_partition_id()))
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("partition")


_MANIFEST = pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("partition", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def read_token_files(manifest: DataFrame, tasks: int | None = None, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """Per document ``(id, start, n_tokens, ids_crc32)`` and, if wanted, ``ids``, from the files."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["file", "start"]).to_pylist():
                reader = FileReader(row["file"])
                starts = row["start"] + np.concatenate([[0], np.cumsum(reader.counts, dtype=np.int64)])
                for at in range(0, len(reader), 512):
                    own = range(at, min(at + 512, len(reader)))
                    packed = [reader.packed(i) for i in own]
                    columns = [
                        pa.array(reader.ids[own.start : own.stop], mask=reader.nulls[own.start : own.stop].astype(bool)),
                        pa.array(starts[own.start : own.stop]),
                        pa.array([len(p) // 4 for p in packed], pa.int64()),
                        pa.array([zlib.crc32(p) for p in packed], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in packed], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    spread = manifest.select("file", "start")
    spread = spread.repartition(tasks, "file") if tasks else spread.repartition("file")
    return spread.mapInArrow(read, schema)
