import hashlib
import random
from collections import Counter, defaultdict

import pytest

from glyphgrid.llm import align
from glyphgrid.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
PARTS = ["a", "the", " ", "  ", "\n", "\t", "   ", "'s", "'", "é", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "漢字", "😀", "\x00", "\x85", " ", "\r\n", "12", "aaaa", "▁", "ing", ",", "ᴬ", "ﬁ", "é"]


def plain(texts):
    """Token by token, byte by byte."""
    a, b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = {c: n for n, c in align.byte_alphabet().items()}
    names = {i: s for s, i in a.get_vocab().items()}
    out, held = [], Counter()
    for text in texts:
        whole, groups = (" " + text).encode() if text else b"", []
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ba = [bytes(alphabet[c] for c in names[i]) for i in ia]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ba) == whole == b"".join(bb):
            p = q = ea = eb = 0
            while p < len(ia) or q < len(ib):
                group = ([], [])
                while True:
                    if ea <= eb:
                        ea += len(ba[p])
                        group[0].append(ia[p])
                        p += 1
                    else:
                        eb += len(bb[q])
                        group[1].append(ib[q])
                        q += 1
                    if ea == eb:
                        break
                groups.append(group)
        out.append(groups)
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    rows = []
    for groups in out:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        rows.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[k] == most[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return rows


def awkward(n, seed):
    rng = random.Random(seed)
    texts = [None, "", " ", "▁", "a ▁ b", "word " * 3000, "x" * 3000, "é" * 2000, "the the the", "the the the"]
    return texts + ["".join(rng.choice(PARTS + [chr(rng.randrange(32, 0xD000))]) for _ in range(rng.randrange(60))) for _ in range(n)]


def check(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, key string, n_a int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in align.align(docs, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts)


def test_awkward_texts_equal_the_plain_alignment(spark):
    check(spark, awkward(500, 5))


def test_small_slices_and_wide_groups(spark, monkeypatch):
    t = align.Tokenizers(A, B)
    texts = [x or "" for x in awkward(300, 6)]
    for wide in (1, 4096):
        monkeypatch.setattr(align, "WIDE", wide)
        x = align.Aligned(texts, t)
        word, a, b, times = x.links()
        found = Counter()
        for row in zip(word.tolist(), a.tolist(), b.tolist(), times.tolist()):
            found[row[:3]] += row[3]
        if wide == 1:
            first = found
    assert first == found and sum(found.values()) == x.n_links.sum()


def test_without_ranks_the_library_encodes_all():
    t = align.Tokenizers(A, B)
    words = [w for x in awkward(200, 7) for w in align.CUTS.split(x or "")]
    fast = t.encode_a(words)
    t.fast = None
    slow = t.encode_a(words)
    assert all((x == y).all() for x, y in zip(fast, slow))


def test_documents_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in align.align(docs, A, B).collect()}
    assert [got[r.doc_id] for r in rows] == plain([r.text for r in rows])


def test_spelled_groups_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([("k", "ab cd"), (None, None), ("k", "ab cd")], "doc_id string, text string")
    rows = align.align(docs, A, B, spelled=True).collect()
    assert len(rows) == 3 and {r.n_a for r in rows if r.doc_id is None} == {0}
    one = next(r for r in rows if r.doc_id == "k")
    assert len(one.groups.split(";")) == one.n_groups and one.count_sum == 2 * one.n_links
    assert align.align(docs.limit(0), A, B).count() == 0
