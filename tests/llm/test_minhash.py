import hashlib
import random

from pyspark.sql import functions as F

from glyphgrid.llm import minhash


def test_likeness_is_near_jaccard(spark):
    rng = random.Random(8)
    rows, truth = [], []
    for i in range(60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 200, 600]))]
        b = list(a)
        for _ in range(rng.choice([0, 1, 3, 10])):
            b[rng.randrange(len(b))] = "z" + str(rng.randrange(99))
        x, y = ({tuple(s[k : k + 5]) for k in range(len(s) - 4)} for s in (a, b))
        truth.append(len(x & y) / len(x | y))
        rows.append((i, " ".join(a), "\n".join(b)))
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("s")).orderBy("i").collect()
    errors = [abs(r.s - t) for r, t in zip(got, truth)]
    assert max(errors) < 0.17 and sum(errors) / len(errors) < 0.04


def test_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "RUN", 3)
    texts = {1: "abcdefgh é x y", 2: None, 3: "", 4: "one two three four five six", 8: "q" * 9, 20: "one two three four five six", 21: "w 😀 " * 3000}
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, run string")
    got = {r.doc_id: r for r in minhash.edited_pairs(docs).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for n, i in enumerate(ids):
        text, follow = texts[i] or "", texts[ids[(n + 1) % len(ids)]] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + follow[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[4].fingerprint == got[20].fingerprint != "" and got[2].fingerprint == "" and got[2].near_next == 1
    assert minhash.edited_pairs(docs.limit(0)).count() == 0
    assert minhash.edited_pairs(docs.filter("doc_id = 4")).first().near_next == 1
    assert minhash.edited_pairs(docs.unionByName(docs)).count() == 2 * len(ids)


def test_plain_fingerprint(spark):
    """Bin by bin: the least hash, or that of the donor that a hash puts first."""
    texts = ["a b c d e f g", "one two", " ".join(f"w{i}" for i in range(300)), "", " \n", "x " * 5000, "ä ö ü ß é\tè\nà"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    hashes = {r.i: r.h for r in df.select("i", minhash.shingle_hashes(F.col("t")).alias("h")).collect()}
    pair = {(r.a, r.b): r.h for r in spark.range(128).selectExpr("cast(id as int) AS a").crossJoin(spark.range(128).selectExpr("cast(id as int) AS b")).select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    for r in df.select("i", minhash.fingerprint(F.col("t")).alias("f")).collect():
        least: dict = {}
        for h in hashes[r.i]:
            b = (h & (2**64 - 1)) >> 57
            least[b] = min(least.get(b, h), h)
        expected = "".join(f"{(least[j] if j in least else least[min(least, key=lambda b: (pair[j, b], least[b]))]) & 255:02x}" for j in range(128)) if least else ""
        assert r.f == expected


def test_ties_and_sparse_keys(spark):
    """Both uses of the next row take the same one, wherever rows lie and however far apart keys are."""
    rows = [(5, f"text {k} " + "w " * k) for k in range(6)] + [(None, "null one"), (None, "null two"), (-(2**62), "far"), (2**62, "far up"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    prints = {r.text: r.f for r in docs.select("text", minhash.fingerprint(F.col("text")).alias("f")).collect()}
    expected = set()
    for k, r in enumerate(order):
        follow = order[(k + 1) % len(order)].text
        cut = len(r.text) // 4
        expected.add((r.doc_id, hashlib.sha256((r.text[: len(r.text) - cut] + follow[:cut]).encode()).hexdigest(), prints[r.text], prints[r.text] == prints[follow]))
    for part in (docs, docs.repartition(4)):
        got = {(r.doc_id, r.edited_sha256, r.fingerprint, r.near_next == 1) for r in minhash.edited_pairs(part).collect()}
        assert got == expected


def test_far_and_equal_keys_dont_fill_a_run(spark):
    """One far outlier, a key that many rows share, and null keys: no run is large, and neighbours stay neighbours."""
    from pyspark.sql import functions as F

    ids = F.when(F.col("id") < 9000, F.col("id")).when(F.col("id") < 18000, 77).when(F.col("id") < 18500, F.lit(None)).when(F.col("id") == 19999, 2**62).otherwise(F.col("id") * 1_000_003)
    rows = spark.range(20000).select(ids.cast("long").alias("id"), F.xxhash64("id").alias("order"), F.col("id").cast("string").alias("body"))
    runs = minhash.in_runs(rows).groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("id", "order")).alias("low"), F.max(F.struct("id", "order")).alias("high")).collect()
    assert max(r.n for r in runs) <= minhash.MOST and sum(r.n for r in runs) == 20000
    key = lambda s: (s.id is not None, s.id or 0, s.order)
    runs.sort(key=lambda r: key(r.low))
    assert all(key(p.high) < key(q.low) for p, q in zip(runs, runs[1:]))
    got = {r.body: r.follow for r in minhash.with_next(rows).collect()}
    order = [r.body for r in sorted(rows.collect(), key=lambda r: (r.id is not None, r.id or 0, r.order))]
    assert got == dict(zip(order, order[1:] + order[:1]))
