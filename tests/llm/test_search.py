import math
import random
import re
from collections import Counter

import duckdb

from glyphgrid.llm import oracle, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    of = [(key, terms(t)) for key, t in docs]
    total, with_terms = sum(len(t) for _, t in of), sum(1 for _, t in of if t)
    df = Counter(x for _, t in of for x in set(t))
    rows = []
    for item, text in items:
        found = []
        for at, (key, t) in enumerate(of):
            tf, m = Counter(t), 50 + (50 * len(t) * with_terms) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * with_terms + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in set(terms(text)) if tf[x])
            if score > 0:
                found.append((-score, key is not None, key or 0, at, key))
        rows += [(item, r + 1, f[4], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(rows, key=str)


def awkward():
    rng = random.Random(4)
    words = ["a", "the", "B1", "É", "é", "ſ", "K", "漢字", "x_y", "don't", "ÀB", "zz", "q\x00q", "7", "\x85", "end."]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(120)]
    docs += [(5, "a the zz"), (5, "a the zz"), (None, "zz zz"), (200, None), (201, ""), (202, " .,"), (203, "the " * 20000 + "zz")]
    items = [(0, "the zz"), (1, None), (2, ""), (3, "nowhere"), (4, "É b1 x 漢字 7 the The"), (5, " ".join(words)), (None, "a q")]
    return docs, items


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_the_plain_search(spark, monkeypatch):
    docs, items = awkward()
    d = spark.createDataFrame([(k, t, i, "x") for i, (k, t) in enumerate(docs)], "doc_id long, text string, item_id int, term string").repartition(7)
    q = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(search, "BLOCK_BYTES", 300)
    for limits in ({}, {"sent_bytes": 0}):
        got = search.search(d, q, k=10, **limits)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert rows(got) == plain(docs, items, 10)


def test_empty_tables(spark):
    docs, items = awkward()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert search.search(d.limit(0), q).count() == 0 == search.search(d, q.limit(0)).count()
    assert search.search(d.filter("doc_id in (200, 201)"), q).count() == 0


def test_the_index_alone(spark):
    d = spark.createDataFrame([("k", "a b a"), (None, "b")], "doc_id string, text string")
    rows = {r.term: r for r in search.postings(d.coalesce(1)).collect()}
    assert rows["a"].tfs == [2] and rows["b"].keys == ["k", None] and rows[""].tfs == [2] and rows[""].sizes == [4]


def test_sql_states_the_query(spark):
    from glyphgrid.llm.queries import op13_search

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    columns = ["item_id", "rank", "doc_id", "score"]
    expected = sorted((tuple(map(int, r)) for r in con.execute(oracle.OP13).df()[columns].itertuples(index=False)), key=str)
    assert rows(op13_search(spark, folder).select(*columns)) == expected
