import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.llm import packed
from glyphgrid.llm.common import scratch_path
from glyphgrid.llm.queries import tokenizer_file

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_file("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003).astype("<u4")
    data = packed.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8)
    assert (packed.unpack(data, bits, 1003) == ids).all()


def test_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2**13, n).astype("<u4") for n in (1, 40, 7, 300, 2)]
    f = packed.PackedFile(packed.file_bytes([5, None, 7, -1, 9], docs, 13, block_ids=16))
    assert f.keys == [5, None, 7, -1, 9]
    for i, d in enumerate(docs):
        assert (f.document(i) == d).all()
    assert [(a, list(x)) for _, a, x in f.documents()] == [(int(s), list(d)) for s, d in zip(f.starts, docs)]


def test_words_encode_as_the_library():
    encoder, library = packed.WordEncoder(PATH, cache_pieces=20), tokenizers.Tokenizer.from_file(PATH)
    texts = ["", "  ", "The the THE's don't,x é É \n\n1234 ß İ <|endoftext|>x y", "a b é ́ 漢字", "word, " * 50]
    for text, got in zip(texts, encoder.encode(texts)):
        assert list(np.frombuffer(got, "<u4")) == library.encode(text, add_special_tokens=False).ids


def test_files_in_order(spark):
    rows = [(9, "nine words here"), (1, None), (4, "four"), (4, "four"), (None, "no key"), (-3, "x y z " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    library = tokenizers.Tokenizer.from_file(PATH)
    folder = scratch_path(spark, "t")
    manifest = packed.write_packed(docs, PATH, folder, file_ids=8, block_ids=16)
    assert manifest.count() > 1
    got = packed.read_digests(spark, folder, manifest).orderBy("start").collect()
    expected, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == expected
    assert packed.packed_digests(docs.filter(F.lit(False)), PATH).count() == 0
