"""The symbol counts against a plain count over whole texts."""

from collections import Counter

from glyphgrid.plans import registry


def test_whole_texts(spark, tmp_path):
    texts = [None, "", "a", "a" * 256 + "é\n😀 z", "bc" * 5000 + "中", "x\n" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["o8_8_symbols"](spark, str(tmp_path)).collect()
    assert {r.sym: r.cnt for r in got} == Counter("".join(t or "" for t in texts)) and len(got) == len({r.sym for r in got})
