"""BPE encoding and decoding of a ``tokenizers`` vocabulary, in plain Python.

A piece is encoded by a priority queue of merge ranks over a doubly linked list
of symbols: the queue gives the merge of lowest rank (leftmost at ties), an entry
whose pair has changed since it was queued is stale and skipped, and a merge
relinks its neighbours and queues the two new pairs. Decoding concatenates the
byte strings of the vocabulary.

Nulls encode as the empty text. Rows are independent, so copies, ties and extra
columns need no care. The cache of encoded pieces is bounded and only saves time.
"""

import hashlib
import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

CACHE_PIECES = 500_000
#: Fixed value: how the byte-level pre-tokenizer splits a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in for each byte: itself if visible in Latin-1, else the next free one from 256 up."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(spare)) for b in range(256)}


class ByteBpe:
    """Encodes and decodes as the library does, special strings in a text included."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        to_char = byte_alphabet()
        to_byte = {c: b for b, c in to_char.items()}
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.vocab_bytes = [b""] * size
        for token, i in vocab.items():
            self.vocab_bytes[i] = b"".join(bytes([to_byte[c]]) if c in to_byte else c.encode() for c in token)
        for token, i in added.items():
            self.vocab_bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self._first = [vocab.get(to_char[b], -1) for b in range(256)]
        none: dict[int, int] = {}
        self._rows = [none] * size  # by left symbol: right symbol to the rank of their merge
        self._merged = []  # by rank: the merged symbol
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if self._rows[vocab[left]] is none:
                self._rows[vocab[left]] = {}
            self._rows[vocab[left]][vocab[right]] = rank
            self._merged.append(vocab[left + right])
        self._added = added
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(added, key=len, reverse=True))) if added else None
        self._pieces = regex.compile(PIECES)
        self._cache: dict[str, tuple] = {}
        self._cache_pieces = cache_pieces

    def encode_piece(self, piece: str) -> tuple:
        rows, merged = self._rows, self._merged
        symbols = [s for s in map(self._first.__getitem__, piece.encode()) if s >= 0]
        n = len(symbols)
        if n < 2:
            return tuple(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queued = [-1] * n  # the rank that counts for the pair starting here
        heap = []  # entries are rank * n + position: lowest rank first, leftmost at ties
        left = symbols[0]
        for i in range(n - 1):
            right = symbols[i + 1]
            rank = rows[left].get(right, -1)
            if rank >= 0:
                queued[i] = rank
                heap.append(rank * n + i)
            left = right
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry % n
            rank = entry // n
            if queued[i] != rank:
                continue  # stale: the pair has been merged or changed
            j = after[i]
            k = after[i] = after[j]
            new = symbols[i] = merged[rank]
            symbols[j] = queued[j] = queued[i] = -1
            if k < n:
                before[k] = i
                rank = rows[new].get(symbols[k], -1)
                if rank >= 0:
                    queued[i] = rank
                    heappush(heap, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = queued[h] = rows[symbols[h]].get(new, -1)
                if rank >= 0:
                    heappush(heap, rank * n + h)
        return tuple([s for s in symbols if s >= 0])

    def _encode_plain(self, text: str, ids: list) -> None:
        cache, extend = self._cache, ids.extend
        for piece in self._pieces.findall(text):
            got = cache.get(piece)
            if got is None:
                got = self.encode_piece(piece)
                if len(cache) >= self._cache_pieces:
                    cache.clear()
                if len(piece) <= 64:
                    cache[piece] = got
            extend(got)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        at = 0
        if self._special is not None:
            for m in self._special.finditer(text):
                self._encode_plain(text[at : m.start()], ids)
                ids.append(self._added[m[0]])
                at = m.end()
        self._encode_plain(text[at:] if at else text, ids)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.vocab_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def _codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_documents(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string) of each row."""

    def run(batches):
        codec = _codec(vocab_path)
        for batch in batches:
            ids = [codec.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())], names=[key, "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, vocab_path: str, keep: tuple = (), text: str = "text", round_trip: str = "") -> DataFrame:
    """The kept columns, n_tokens, ids_sha256 and decoded_sha256 of each row; only digests leave the Python worker.

    round_trip: name of a further column that gets the decoded text.
    """
    fields = [docs.schema[c] for c in keep]

    def run(batches):
        codec = _codec(vocab_path)
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_text, texts = [], [], [], []
            for value in batch.column(len(keep)):
                ids = codec.encode(value.as_py() or "")
                decoded = codec.decode(ids)
                counts.append(len(ids))
                of_ids.append(sha(",".join(map(codec.decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(sha(decoded.encode()).hexdigest())
                if round_trip:
                    texts.append(decoded)
            out = [*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * bool(round_trip), names=names + [round_trip] * bool(round_trip))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + [f"`{round_trip}` string"] * bool(round_trip))
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
