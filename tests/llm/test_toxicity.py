import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from glyphgrid.llm import toxicity

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_features(text):
    words = WORD.findall(text.translate(FOLD))
    return {(k, *p) for k, gap in enumerate(toxicity.GAPS) for p in ([(w,) for w in words] if gap is None else zip(words, words[gap + 1 :]))}


def arrays(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def test_features_are_those_of_the_words(monkeypatch):
    rng = random.Random(2)
    parts = ["a", "Bc", "the", " ", "  ", "\n", "é", "漢字", "-", "x1", "w" * 70000]
    texts = ["", "a", "a", " ", "trash", "trash"] + ["".join(rng.choice(parts[:-1]) for _ in range(rng.randrange(40))) for _ in range(200)] + ["a " + parts[-1] + " b", "b"]
    hashes: dict = {}
    for block in (1 << 20, 7):
        monkeypatch.setattr(toxicity, "BLOCK_BYTES", block)
        found = [set() for _ in texts]
        for kind, (of, h) in enumerate(toxicity.features(*arrays(texts))):
            for i, x in zip(of.tolist(), h.tolist()):
                found[i].add((kind, x))
        for text, own in zip(texts, found):
            assert len(own) == len(plain_features(text))
            for name in plain_features(text) if len(plain_features(text)) == 1 else ():
                assert hashes.setdefault(name, own) == own
    assert len({tuple(x) for x in hashes.values()}) == len(hashes)


def plain_ftrl(rows, alpha, beta, l1, l2, epochs):
    """Coordinate by coordinate."""
    z, n, weight = {}, {}, lambda k, l: 0.0 if abs(z.get(k, 0)) <= l else -(z[k] - math.copysign(l, z[k])) / ((beta + math.sqrt(n[k])) / alpha + (l2 if k != "bias" else 0))
    for _ in range(epochs):
        for features, y in rows:
            w = {k: weight(k, l1) for k in features} | {"bias": weight("bias", 0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k, v in w.items():
                sigma = (math.sqrt(n.get(k, 0) + g * g) - math.sqrt(n.get(k, 0))) / alpha
                z[k], n[k] = z.get(k, 0) + g - sigma * v, n.get(k, 0) + g * g
    return {k: weight(k, l1) for k in z if k != "bias" and weight(k, l1)}, weight("bias", 0)


def test_ftrl_equals_the_plain_rule():
    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(60), rng.randrange(0, 15))), rng.randrange(2)) for _ in range(80)]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f, _ in rows])])
    flat = np.array([k for f, _ in rows for k in f], np.int32)
    for l1 in (0.5, 3.0):
        h, w, bias = toxicity.ftrl(offsets, flat, np.array([y for _, y in rows], float), None, 0.7, 1.0, l1, 1.5, 3)
        expected, b = plain_ftrl(rows, 0.7, 1.0, l1, 1.5, 3)
        assert abs(bias - b) < 1e-9 and h.tolist() == sorted(expected)
        assert np.allclose(w, [expected[k] for k in h.tolist()])


def test_scores_are_sums_of_weights():
    texts = ["idiot idiot no", "", "no", "Idiot, no"]
    (of, h), *_ = toxicity.features(*arrays(["idiot"]))
    model = (h, np.array([2.0]), -3.0)
    assert toxicity.logits(*arrays(texts), model).tolist() == [-1.0, -3.0, -3.0, -1.0]


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in out if r.toxic == y] for y in (0, 1))
    assert sum(b > g for b in bad for g in good) > 0.97 * len(bad) * len(good)
    hits = sum(r.predicted for r in out if r.toxic)
    assert hits > 0.8 * len(bad) and sum(r.predicted for r in out) < 1.05 * hits


def test_odd_tables(spark):
    rows = [(i, ("you idiot " if i % 2 else "you dear ") + f"w{i}", 1) for i in range(120)] + [(None, None, 2), (None, "idiot", 3), (5, "other text", 4), (5, "other text", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, None), (None, 1), (999, 1), (4, 1)], "doc_id long, toxic int")
    first, again = (sorted(map(tuple, toxicity.toxicity(docs, labels).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == len(rows)
    assert {r[3] for r in first if r[0] is not None and r[0] % 2 and r[0] != 5} == {1}
    assert {r[3] for r in first if r[0] is not None and r[0] % 2 == 0 and r[0] != 4} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    bounded = toxicity.sample(docs, labels, ~toxicity.held_out(F.col("doc_id")), "doc_id", "text", "toxic", 20, 60).collect()
    assert len(bounded) <= 20 and sum(len(r.features) for r in bounded) <= 60
