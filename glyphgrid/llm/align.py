"""Alignment of two tokenizers: byte groups in which tokens of A and of B begin and end together.

A is a byte-level BPE of the ``tokenizers`` library over space + text, B a byte-fallback BPE of
``sentencepiece`` over the text (it adds the space). Their special strings are plain text.

Documents are taken some megabytes of an Arrow batch at a time. Neither vocabulary has a token that goes
over a space after a visible character, so a batch is cut there into words, and each distinct word is
tokenized once. All token bytes stand one behind the other; the ends of A's and of B's tokens are counted
once over all bytes, and a group ends where both counts are set. Segmented prefix sums over words, and
over the words of each document, give the documents' results. Links are products of counts inside a
group; they are never spelled out as pairs of occurrences for large groups.

How many documents hold a pair of ids linked is summed over the batches of all documents, and comes back
to each batch as one row for each of its distinct pairs, not one for each document's.

Null and empty texts, and texts that B's normalizer changes, have no tokens: zeros and an empty ``groups``.
Very long texts are batches of their own; a long word without a cut is tokenized by the library, whose merges
are queued. Rows that repeat count as documents of their own, null keys too; other columns aren't read, so
their names can't clash. An empty table gives an empty result.
"""

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from glyphgrid.llm.bpe import PIECES, byte_alphabet
from glyphgrid.llm.common import chunks, drop, written

#: Bytes of text that are aligned at once; a longer text is alone.
CHUNK_BYTES = 4 << 20
#: Words of more characters, and those outside ASCII, are encoded by the library itself.
LONG = 500
#: Groups of more links than this are counted by their distinct ids.
WIDE = 4096

#: A space after a visible character begins a word, but not at the end of the text.
CUTS = re.compile(r" (?<=\S )(?!\Z)")


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(a_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_byte = {c: b for b, c in byte_alphabet().items()}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [b""] * size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        self.fast = self._by_ranks(model)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        ids = range(self.pieces.get_piece_size())
        self.b_bytes = [bytes([int(self.pieces.id_to_piece(i)[3:5], 16)]) if self.pieces.is_byte(i) else self.pieces.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.shift = na
        #: Each id in decimal, then what stands behind it: a comma, the bar between A and B, or the end of the group.
        self.said = [f"{i}{mark}" for mark in ",|;" for i in chain(range(na), range(nb))]

    def _by_ranks(self, model):
        """The same encoding by ranks, where the ids of merged symbols are in the order of merges."""
        import tiktoken

        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(vocab.get(left + right) != 256 + k for k, (left, right) in enumerate(merges)):
            return None
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(merges) else None

    def encode_a(self, words: list) -> tuple:
        """The ids of " " + word for each word, one behind the other, and how many each has."""
        n_bytes = np.array([1 + (len(w) if w.isascii() else len(w.encode())) for w in words], np.int64)
        plain = np.array([self.fast is not None and w.isascii() and len(w) <= LONG and w[-1:] > " " for w in words], bool)
        joined = np.array([w[-1:].isspace() for w in words], bool)  # the space behind would be read with them
        order, found = [], []
        for chosen, encode in ((plain, lambda t: self.fast.encode_ordinary(t)), (~plain & ~joined, lambda t: self.library.encode(t, add_special_tokens=False).ids)):
            if chosen.any():
                at = np.flatnonzero(chosen)
                ids = np.array(encode(" " + " ".join([words[i] for i in at])), np.int64)
                ends = np.cumsum(self.a_lengths[ids])
                found.append((at, ids, np.diff(np.searchsorted(ends, np.cumsum(n_bytes[at]), "right"), prepend=0)))
        for i in np.flatnonzero(~plain & joined):
            ids = np.array(self.library.encode(" " + words[i], add_special_tokens=False).ids, np.int64)
            found.append((np.array([i]), ids, np.array([len(ids)])))
        counts = np.zeros(len(words), np.int64)
        for at, _, n in found:
            counts[at] = n
        out = np.empty(counts.sum(), np.int64)
        starts = np.cumsum(counts) - counts
        for at, ids, n in found:
            out[spread(starts[at], n)] = ids
        return out, counts, n_bytes

    def encode_b(self, words: list) -> tuple:
        ids = self.pieces.encode(words, out_type=int, num_threads=1)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, counts.sum()), counts


@lru_cache(maxsize=2)
def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum between each two offsets, from one prefix sum."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


class Aligned:
    """The words of some documents, their tokens and groups.

    docs: the number of words of each text; seq: the words' numbers in the order of the texts. Of each distinct word: n_a,
    n_b, n_groups, n_links and good (its bytes are those of the text).
    """

    def __init__(self, texts: list, t: Tokenizers):
        index: dict = {}
        put, seq, counts = index.setdefault, [], []
        for text in texts:
            words = CUTS.split(text) if text else ()
            seq += [put(w, len(index)) for w in words]
            counts.append(len(words))
        self.seq = np.array(seq, np.int32)
        self.offsets = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int64)
        words = list(index)
        a, self.n_a, n_bytes = t.encode_a(words)
        b, self.n_b = t.encode_b(words)
        self.good = self._same_bytes(words, t, a, b, n_bytes)
        bad = ~self.good
        if bad.any():
            a, b = a[np.repeat(self.good, self.n_a)], b[np.repeat(self.good, self.n_b)]
            n_bytes, self.n_a, self.n_b = (np.where(bad, 0, x) for x in (n_bytes, self.n_a, self.n_b))
        self.a, self.b = a, b
        # Ends over all bytes, each counted once; a cut is where both occur.
        ends_a, ends_b, size = np.cumsum(t.a_lengths[a]), np.cumsum(t.b_lengths[b]), int(n_bytes.sum())
        cut = (np.bincount(ends_a, minlength=size + 1) > 0) & (np.bincount(ends_b, minlength=size + 1) > 0)
        before = np.cumsum(cut) - cut  # groups that end before this byte
        self.group_a, self.group_b = before[ends_a], before[ends_b]
        n = int(cut.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        word_ends = np.concatenate([[0], np.cumsum(n_bytes)])
        self.group_offsets = np.concatenate([[0], np.cumsum(cut)])[word_ends + 1]
        self.n_groups = np.diff(self.group_offsets)
        self.n_links = segment_sums(self.in_a * self.in_b, self.group_offsets)

    def _same_bytes(self, words, t, a, b, n_bytes) -> np.ndarray:
        whole = "".join([f" {w}" for w in words]).encode()
        good = np.ones(len(words), bool)
        for ids, counts, lengths, of in ((a, self.n_a, t.a_lengths, t.a_bytes), (b, self.n_b, t.b_lengths, t.b_bytes)):
            offsets = np.concatenate([[0], np.cumsum(counts)])
            right = segment_sums(lengths[ids], offsets) == n_bytes
            joined = b"".join(map(of.__getitem__, ids.tolist()))
            if right.all() and joined == whole:
                continue
            starts = np.concatenate([[0], np.cumsum(segment_sums(lengths[ids], offsets))])
            good &= right & np.array([joined[starts[i] : starts[i + 1]] == f" {w}".encode() for i, w in enumerate(words)], bool)
        return good

    def links(self) -> tuple:
        """(word, a id, b id, how often) of each distinct pair that is linked in a group."""
        wide = self.in_a * self.in_b > WIDE
        word_of = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        starts_a, starts_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        keep = ~wide[self.group_a]
        times = self.in_b[self.group_a[keep]]  # each of A's tokens with all of B's
        word, a_of = np.repeat(word_of[self.group_a[keep]], times), np.repeat(self.a[keep], times)
        b_of = self.b[spread(starts_b[self.group_a[keep]], times)]
        parts = [(word, a_of, b_of, np.ones(len(word), np.int64))]
        for g in np.flatnonzero(wide):
            (ua, ca), (ub, cb) = (np.unique(ids[s[g] : s[g] + n[g]], return_counts=True) for ids, s, n in ((self.a, starts_a, self.in_a), (self.b, starts_b, self.in_b)))
            parts.append((np.full(len(ua) * len(ub), word_of[g]), np.repeat(ua, len(ub)), np.tile(ub, len(ua)), np.outer(ca, cb).ravel()))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def spelled(self, t: Tokenizers) -> list:
        """Each word's groups as ``a1,a2|b1;a3|b2,b3;``."""
        key = np.concatenate([2 * self.group_a, 2 * self.group_b + 1])
        order = np.argsort(key, kind="stable")
        key, code = key[order], np.concatenate([self.a, self.b + t.shift])[order]
        after = np.concatenate([key[1:], [-1]])[: len(key)]
        mark = np.where(after == key, 0, np.where(after >> 1 == key >> 1, 1, 2))
        texts = list(map(t.said.__getitem__, (mark * (len(t.said) // 3) + code).tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(texts[i:j]) for i, j in zip([0, *ends], ends)]

    def of_documents(self, values: np.ndarray) -> np.ndarray:
        """The words' values summed for each document."""
        return segment_sums(values[self.seq], self.offsets)


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _first_pass(a_path: str, b_path: str, spelled: bool):
    """For each slice of a batch one row: what is known of its documents, its words' links, and its distinct pairs."""

    def run(batches):
        t, part, number = _tokenizers(a_path, b_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in chunks(batch, 1, CHUNK_BYTES):
                x = Aligned(rows.column(1).to_pylist(), t)
                good = (x.of_documents((~x.good).astype(np.int64)) == 0) & (np.diff(x.offsets) > 0)
                if not good.all():  # their words count for nothing
                    x.seq = x.seq[np.repeat(good, np.diff(x.offsets))]
                    x.offsets = np.concatenate([[0], np.cumsum(np.where(good, np.diff(x.offsets), 0))])
                words = x.spelled(t)
                groups, seq = [], x.seq.tolist()
                for i, j in zip(x.offsets[:-1].tolist(), x.offsets[1:].tolist()):
                    text = "".join(map(words.__getitem__, seq[i:j]))[:-1]
                    groups.append(text if spelled else hashlib.sha256(text.encode()).hexdigest() if text else "")
                word, a, b, times = x.links()
                pairs, place = np.unique(a << 32 | b, return_inverse=True)
                # A document holds a pair once, however many of its words do.
                n_words, n_docs = len(x.n_a), len(x.offsets) - 1
                held = np.unique(np.repeat(np.arange(n_docs), np.diff(x.offsets)) * max(n_words, 1) + x.seq)
                doc, of = held // max(n_words, 1), held % max(n_words, 1)
                order = np.argsort(word, kind="stable")
                link_offsets = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n_words))])
                n = np.diff(link_offsets)[of]
                linked = place[order][spread(link_offsets[of], n)]
                in_docs = np.bincount(np.unique(np.repeat(doc, n) * max(len(pairs), 1) + linked) % max(len(pairs), 1), minlength=len(pairs))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([part << 32 | number], pa.int64()),
                    "docs": pa.array([[{"key": k, "n_a": p, "n_b": q, "n_groups": r, "n_links": s, "groups": g} for k, p, q, r, s, g in zip(rows.column(0).to_pylist(), *[x.of_documents(v).tolist() for v in (x.n_a, x.n_b, x.n_groups, x.n_links)], groups)]],
                                     pa.list_(pa.struct([("key", rows.column(0).type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())]))),
                    "sizes": pa.array([[n_words, len(word), len(x.seq), n_docs]], pa.list_(pa.int64())),
                    "words": pa.array([[_packed(v) for v in (link_offsets, place[order].astype(np.int32), times[order], x.offsets, x.seq)]], pa.list_(pa.binary())),
                    "pairs": pa.array([pairs.tolist()], pa.list_(pa.int64())), "in_docs": pa.array([in_docs.tolist()], pa.list_(pa.int64())),
                })
                number += 1

    return run


def _second_pass(slices: pa.Table, pairs: pa.Table) -> pa.Table:
    """A slice's documents with what the counts of its pairs sum to."""
    n = pairs.num_rows
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    place = pairs.column("place").to_numpy()
    count[place], best[place] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy(zero_copy_only=False)
    docs = slices.column("docs").combine_chunks().flatten()
    n_words, n_links, n_seq, n_docs = slices.column("sizes")[0].as_py()
    packed = slices.column("words")[0].as_py()
    link_offsets, of_link, times, offsets, seq = (_unpacked(d, k, m) for d, k, m in zip(packed, (np.int64, np.int32, np.int64, np.int64, np.int32), (n_words + 1, n_links, n_links, n_docs + 1, n_seq)))
    sums = [segment_sums(segment_sums(times * v[of_link], link_offsets)[seq], offsets) if n_links else np.zeros(n_docs, np.int64) for v in (best, count)]
    return pa.table([*docs.flatten(), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64())], names=["key", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])


def slices(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", spelled: bool = False) -> DataFrame:
    """One row for each slice of some megabytes of text; see ``_first_pass``."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"chunk long, docs array<struct<key: {kind}, n_a: long, n_b: long, n_groups: long, n_links: long, groups: string>>, sizes array<long>, words array<binary>, pairs array<long>, in_docs array<long>"
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(_first_pass(a_path, b_path, spelled), schema)


def pair_counts(of_slices: DataFrame) -> DataFrame:
    """(a, b, n, best): how many documents hold the ids linked, and whether that is the most of any b of this a."""
    rows = of_slices.select(F.explode(F.arrays_zip("pairs", "in_docs")).alias("p"))
    counts = rows.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.in_docs").alias("n"))
    counts = counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n")
    # An a has no more rows than B has ids.
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", spelled: bool = False) -> DataFrame:
    """Of each row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, and its groups as text (spelled) or as that text's sha256."""
    known, path = written(slices(docs, a_path, b_path, key, text, spelled), "slices")
    counts, counts_path = written(pair_counts(known), "pairs")
    held = known.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    counted = counts.select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("pair"), "n", "best")
    found = held.join(counted, "pair").select("chunk", "place", "n", F.col("best").cast("long").alias("best"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    again = docs.sparkSession.read.schema(known.schema).parquet(path)
    out = again.select("chunk", "docs", "sizes", "words").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_second_pass, schema)
    out, _ = written(out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups" if spelled else "groups_sha256")), "aligned")
    drop(docs.sparkSession, path, counts_path)
    return out
