import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    whole = docs.count()
    seen = [whole]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, D)
        if k < 4:
            assert after.columns == docs.columns
        after = after.cache()
        seen.append(after.count())
        docs = after
    assert 0 < seen[3] <= seen[2] == seen[1] < seen[0]
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_mixed_words_come_near_the_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 301), "en", "ab"[i % 3 > 0], 0) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.mixed(spark, docs, D).collect()
    goals = {r._source: r.target for r in corpus_pipeline.mixing.mix(docs, keep=(docs.source.alias("_source"),)).collect()}
    for source, goal in goals.items():
        assert abs(sum(len(r.text.split()) for r in rows if r.source == source) - goal) <= 96
    assert all(r.n_chars == len(r.text) for r in rows)


def test_one_row_of_each_group(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(80))
    a, b, c = text("a"), text("b"), text("c")
    rows = [(4, a), (4, a), (2, b), (4, b), (1, c), (2, c), (None, c), (7, ""), (7, ""), (8, None)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").coalesce(1)
    got = corpus_pipeline.near_copies(spark, docs, D)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(4, a), (2, b), (None, c), (7, ""), (7, ""), (8, None)], key=str)


def test_stages_take_odd_tables(spark):
    """Nulls in every column, equal rows, names that stages use themselves, long texts, and no rows at all."""
    words = lambda k, n=70: " ".join(f"{k}{i * 7 % 31}x{i}" for i in range(n))
    texts = [words("a"), words("a"), words("b"), None, "", " \n ", words("c", 30000), words("b") + " tail", words("d")]
    names = ["size", "target", "row", "id", "_text", "_cell", "_word", "gone", "node", "n", "nid", "_n_lines", "taken"]
    rows = [(None if i == 8 else i // 2, t, None if i == 3 else "en", None if i == 4 else f"s{i % 2}", None if i == 5 else len(t or ""), *[i] * len(names)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame(rows + rows[:2] + rows[3:5], schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, D)
            got = out.collect()
            if k < 4:
                assert out.columns == docs.columns, name
                assert [f.dataType for f in out.schema.fields] == [f.dataType for f in docs.schema.fields]
            assert bool(got) == bool(part.count()), name
            if name in ("line dedup", "byte pairs"):
                assert len(got) == part.count()
            for r in got if k < 4 else []:
                i = r["size"]
                assert all(r[n] == i for n in names) and r.lang == rows[i][2] and r.source == rows[i][3]
