import random
import re

from glyphgrid.llm import jaccard


def brute(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(len(words) - 3, 1))} if words else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(rng.choice([1, 3, 4, 5, 20, 60, 150]))] for _ in range(40)]
    rows = []
    for i in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = "x" + str(rng.randrange(30))
        rows.append((i, (" " if i % 3 else "\n").join(words).upper() if i % 7 == 0 else " ".join(words)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "w " * 20000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, node string")
    expected = brute(rows)
    for chunk in (4096, 3):
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()} == expected
    assert jaccard.link(docs.limit(0)).count() == 0
    twice = docs.filter("doc_id < 3")
    assert jaccard.link(twice.unionByName(twice)).count() == 6


def test_rows_of_one_key_link_by_their_texts(spark):
    """All rows have one key, or none: sets are found by the text, and everything that links is one component."""
    import time

    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(60)) for _ in range(700)]
    texts = base + [t + " more" for t in base]
    took = {}
    for name, key in (("own", lambda i: i), ("one", lambda i: 7), ("none", lambda i: None)):
        docs = spark.createDataFrame([(key(i), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
        began = time.time()
        rows = jaccard.link(docs).collect()
        took[name] = time.time() - began
        assert len(rows) == len(texts) and {r.n_shingles for r in rows} <= {57, 58}
        if name == "own":
            assert all(r.component_id == r.doc_id % 700 for r in rows)
        else:
            assert {r.component_id for r in rows} == {key(0)}
    assert max(took["one"], took["none"]) < 3 * took["own"] + 5
