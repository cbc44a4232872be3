"""Token ids in files of fixed-width bit packing, in ascending key order.

A file holds, little-endian throughout:

    magic ``FWP1``, bits u32, ids per block u32, flags u32 (0), n_docs u64, n_ids u64
    keys i64[n_docs], key_present u8[n_docs] padded to 8 bytes
    doc_starts u64[n_docs + 1]       ids before each document in this file
    block_offsets u64[n_blocks + 1]  bytes before each block in the payload
    payload                          blocks, each padded to whole bytes

An id takes ``bits`` bits, the least that hold the vocabulary, lowest bit first.
Any document is read by unpacking only the blocks that it touches.

Null texts are empty documents (their end id alone). Null keys sort first. Rows of
equal key are ordered by a hash of the text, so that reruns agree; equal rows are
interchangeable. An empty table makes no file and no row.
"""

import itertools
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from glyphgrid.llm.bpe import byte_alphabet
from glyphgrid.llm.common import scratch_path

MAGIC = b"FWP1"
BLOCK_IDS = 65_536
FILE_IDS = 2_000_000
CACHE_PIECES = 400_000
#: Fixed value: the pre-tokenizer's pattern, as it stands for lower-case letters below U+0180, which NFC leaves alone.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿĀ-ſ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿĀ-ſ0-9²³¹¼½¾]+")
MARKS = frozenset(".,;:!?")
PLAIN = re.compile("[!-~¡-¬®-įı-ſ]*")
CHUNK_BYTES = 3_000_000


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id (under 2 ** 32) in so many bits, lowest first."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return octets[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits % 8 == 0:
        octets = np.zeros((n, 4), np.uint8)
        octets[:, : bits // 8] = raw[: n * bits // 8].reshape(n, bits // 8)
    else:
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = np.unpackbits(raw, bitorder="little", count=n * bits).reshape(n, bits)
        octets = np.packbits(wide, axis=1, bitorder="little")
    return octets.view("<u4").ravel()


def file_bytes(keys: list, docs: list[np.ndarray], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    ids = np.concatenate([*docs, np.empty(0, "<u4")])
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u8")
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    present = np.array([k is not None for k in keys], np.uint8).tobytes()
    return b"".join([
        MAGIC, np.array([bits, block_ids, 0], "<u4").tobytes(), np.array([len(docs), len(ids)], "<u8").tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(), present + b"\0" * (-len(present) % 8), starts.tobytes(), offsets.tobytes(), *blocks,
    ])


class PackedFile:
    """Random access to the documents of one file's bytes."""

    def __init__(self, data):
        self._data = memoryview(data)
        if bytes(self._data[:4]) != MAGIC:
            raise ValueError("not a packed id file")
        self.bits, self.block_ids, _ = map(int, np.frombuffer(data, "<u4", 3, 4))
        self.n_docs, self.n_ids = map(int, np.frombuffer(data, "<u8", 2, 16))
        at = 32
        keys = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        present = np.frombuffer(data, np.uint8, self.n_docs, at)
        at += self.n_docs + -self.n_docs % 8
        self.keys = [int(k) if p else None for k, p in zip(keys, present)]
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.block_offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
        self._payload = at + 8 * (n_blocks + 1)

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids from low to high; only their blocks are unpacked."""
        if low >= high:
            return np.empty(0, "<u4")
        first, last = low // self.block_ids, (high - 1) // self.block_ids
        parts = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            parts.append(unpack(self._data[self._payload + self.block_offsets[b] : self._payload + self.block_offsets[b + 1]], self.bits, n))
        return np.concatenate(parts)[low - first * self.block_ids : high - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self):
        """All documents in order; a window of blocks is unpacked at a time."""
        held, low = np.empty(0, "<u4"), 0
        for i in range(self.n_docs):
            a, b = int(self.starts[i]), int(self.starts[i + 1])
            if b > low + len(held):
                top = min(self.n_ids, -(-b // self.block_ids) * self.block_ids)
                held, low = self.ids(a, top), a
            yield self.keys[i], a, held[a - low : b - low]


class _Pieces(dict):
    """The ids of the pieces that the pre-tokenizer cuts words into, in two generations."""

    def __init__(self, tokenize, most: int):
        super().__init__()
        self._tokenize, self._most, self._old = tokenize, most, {}
        self._stand_ins = {b: c for b, c in byte_alphabet().items()}

    def __missing__(self, piece: str) -> bytes:
        got = self._old.get(piece)
        if got is None:
            symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._stand_ins)
            got = array("I", [t.id for t in self._tokenize(symbols)]).tobytes()
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[piece] = got
        return got


class WordEncoder:
    """The library's ids of whole texts, through a bounded cache of pieces.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in order, and each distinct word of a batch is looked at once. Words of printable characters below U+0180 are
    lower-cased, as the normalizer does, cut by the pre-tokenizer's pattern, and handed to the library's model; others,
    and those that hold an added token, to its encoder, all of a batch at once.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._pieces = _Pieces(self._library.model.tokenize, cache_pieces)
        self.vocab_size = self._library.get_vocab_size(with_added_tokens=True)
        added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(map(re.escape, added)) or "(?!)").search

    def _ids(self, words: set) -> dict[str, bytes]:
        """The ids of each word as little-endian u32."""
        out, others, ids = {}, [], self._pieces.__getitem__
        for w in words:
            # One run of letters, or one and a mark, are the pieces themselves; the pattern cuts the rest.
            if w.isascii():
                if w.isalpha():
                    out[w] = ids(w.lower())
                elif w[-1:] in MARKS and w[:-1].isalpha():
                    out[w] = ids(w[:-1].lower()) + ids(w[-1])
                elif w.isprintable() and not self._added(w):
                    out[w] = b"".join(map(ids, PIECE.findall(w.lower())))
                else:
                    others.append(w)
            elif PLAIN.fullmatch(w) and not self._added(w):
                out[w] = ids(w.lower()) if w.isalpha() else b"".join(map(ids, PIECE.findall(w.lower())))
            else:
                others.append(w)
        for w, e in zip(others, self._library.encode_batch_fast(others, add_special_tokens=False)):
            out[w] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian u32."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        get = self._ids(set(itertools.chain.from_iterable(split))).__getitem__
        return [b"".join(map(get, s)) for s in split]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_packed(docs: DataFrame, vocab_path: str, folder: str, end_id: int = 1, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode the texts, write the files, and return the manifest that names the files that count.

    Each task writes under names of its own attempt and renames when whole; the manifest is
    committed by Spark, so that files of lost or repeated attempts are never read.
    """
    spark = docs.sparkSession

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        encoder = _encoder(vocab_path)
        bits = bits_for(max(encoder.vocab_size, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        keys, held, n, number = [], [], 0, 0

        def flush():
            name = f"ids-{part:06d}-{number:05d}-{attempt}.bin"
            with store.open_output_stream(f"{base}/_{name}") as f:
                f.write(file_bytes(keys, held, bits, block_ids))
            store.move(f"{base}/_{name}", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([n], pa.int64())], names=["file", "part", "number", "n_docs", "n_ids"])

        for batch in batches:
            # Texts are encoded some megabytes at a time, or one by one if they are longer.
            part_of = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part_of)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                chunk = batch.slice(at, to - at)
                for k, data in zip(chunk.column(0).to_pylist(), encoder.encode([t or "" for t in chunk.column(1).to_pylist()])):
                    keys.append(k)
                    held.append(np.frombuffer(data + end, "<u4"))
                    n += len(held[-1])
                    if n >= file_ids:
                        yield flush()
                        keys, held, n, number = [], [], 0, number + 1
        if keys:
            yield flush()

    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).withColumn("tie", F.xxhash64("t"))
    ordered = ordered.repartitionByRange("k", "tie").sortWithinPartitions("k", "tie")
    manifest = f"{folder}/_manifest"
    ordered.select("k", "t").mapInArrow(run, "file string, part long, number long, n_docs long, n_ids long").write.parquet(manifest)
    return spark.read.schema("file string, part long, number long, n_docs long, n_ids long").parquet(manifest)


def read_digests(spark, folder: str, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """From the files: key, start (ids of all documents before), n_tokens and the crc32 of the ids as u32."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows = [(k, a, len(ids), zlib.crc32(ids.tobytes())) for k, a, ids in PackedFile(data.as_buffer()).documents()]
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["file", key, "own_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, f"file string, `{key}` long, own_start long, n_tokens long, ids_crc32 long")
    # One row for each file of some megabytes: the only rows that meet in a single task.
    before = manifest.select("file", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "file").select(key, (F.col("before") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def packed_digests(docs: DataFrame, vocab_path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "packed")
    manifest = write_packed(docs, vocab_path, folder, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_digests(spark, folder, manifest)
