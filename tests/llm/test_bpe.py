import hashlib
import random

import pytest

from glyphgrid.llm import bpe
from glyphgrid.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_file("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "\n", "\t", "   ", "'s", "'", "é", "<|endoftext|>", "<|endof", "漢", "😀", "\x00", "\x85", " ", "\r\n", "12", "aaaa", "é"]


def test_equals_the_library_on_awkward_texts():
    codec, library = bpe.ByteBpe(PATH, cache_pieces=50), tokenizers.Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = ["", " ", "<|endoftext|>", "word " * 3000, "x" * 5000] + ["".join(rng.choice(PARTS + [chr(rng.randrange(32, 0xD000))]) for _ in range(rng.randrange(40))) for _ in range(800)]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == expected
        assert codec.decode(expected) == library.decode(expected, skip_special_tokens=False) == text


def test_documents(spark):
    rows = [(1, "a b", "x"), (2, None, "y"), (None, "", None), (1, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.digests(docs, PATH, keep=("doc_id",)).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 2]
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.ids_sha256 for r in got if r.n_tokens == 0} == {empty}
    assert bpe.encode_documents(docs, PATH).filter("doc_id = 1").first().decoded == "a b"
    assert bpe.digests(docs.limit(0), PATH, keep=("doc_id",)).count() == 0
