import random
import time

import numpy as np

from glyphgrid.llm import lines


def brute(texts, least):
    """Deleted line numbers: lines in maximal equal runs of enough words with any one earlier first holder."""
    docs = [[(i, x.strip(), len(x.split())) for i, x in enumerate((t or "").split("\n")) if x.split()] for t in texts]

    def runs(doc):
        for i in range(len(doc)):
            for j in range(i + 1, len(doc) + 1):
                if sum(w for _, _, w in doc[i:j]) >= least:
                    yield i, j, tuple(x for _, x, _ in doc[i:j])
                    break

    first, out = {}, []
    for n, doc in enumerate(docs):
        gone = set()
        for i, j, run in runs(doc):
            if first.setdefault(run, n) != n:
                gone.update(range(i, j))
        out.append({doc[k][0] for k in gone})
    return out


def test_documents(spark):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(99)) for _ in range(rng.randint(6, 14)))
    passages = [[line() for _ in range(rng.randint(3, 7))] for _ in range(6)]
    texts = [None, "", "\n\n"]
    for _ in range(80):
        parts = [[line()] for _ in range(rng.randint(1, 6))] + [rng.choice(passages) for _ in range(rng.choice([0, 1, 2]))] + [["short notice here"]]
        rng.shuffle(parts)
        texts.append("\n".join(x for p in parts for x in p))
    texts += [texts[5], "same words " * 20000, "same words " * 20000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, early string")
    got = {r.doc_id: r for r in lines.dedup(docs).collect()}
    expected = brute(texts, lines.BLOCK_WORDS)
    for i, text in enumerate(texts):
        assert got[i].early == "x"
        if text is None:
            assert got[i].text is None
            continue
        wanted = expected[i]
        kept = [x for n, x in enumerate(text.split("\n")) if n not in wanted]
        # An aligned block may reach over a shared line beside it that no seed covers.
        assert set(got[i].text.split("\n")) <= set(kept) | {""} and got[i]._n_deleted - len(wanted) in (0, 1, 2), i
    assert got[len(texts) - 1].text == "" and got[len(texts) - 2].text != ""
    assert lines.digests(docs.limit(0)).count() == 0
    assert sorted(r._n_deleted for r in lines.dedup(docs.filter("doc_id = 85").unionByName(docs.filter("doc_id = 85"))).collect())[0] == 0


def test_order_of_passages_does_not_matter():
    a, b, x = [np.arange(k, k + 30, dtype=np.uint64) for k in (0, 100, 200)]
    early = lines.Early(np.concatenate([a, x, b]), 30)
    assert lines.common_blocks(early, np.concatenate([b, x[:1], a]), 30) == [0, 30, 31, 61]


def test_repetitive_texts_take_linear_time():
    """100,000 equal lines in both documents, and blocks in reverse order."""
    rng = np.random.default_rng(0)
    line = rng.integers(1, 2**62, 8).astype(np.uint64)
    for early, late in ((np.tile(line, 100_000), np.tile(line, 100_000)), (np.arange(3 * 10**5, dtype=np.uint64), np.arange(3 * 10**5, dtype=np.uint64).reshape(-1, 30)[::-1].ravel())):
        began = time.process_time()
        assert lines.common_blocks(lines.Early(early, 30), late, 30) == [0, len(late)]
        assert time.process_time() - began < 5


def test_equals_brute_force(spark):
    """A word goes if a window of 30 words around it stands in an earlier document; frequent passages and ties included."""
    rng = random.Random(9)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]
    passages = [words(rng.choice([20, 29, 30, 31, 45, 90])) for _ in range(9)]
    often = words(70)
    texts = []
    for i in range(70):
        parts = [words(rng.randint(1, 25)) for _ in range(3)] + [rng.choice(passages) for _ in range(rng.choice([0, 1, 2]))]
        if i % 3 == 0:
            at = rng.randint(0, 35)
            parts.append(often[at : at + rng.choice([32, 40, 70])])
        rng.shuffle(parts)
        texts.append([w for p in parts for w in p])
    rows = [(None if i < 2 else i // 2, " ".join(t)) for i, t in enumerate(texts)] + [(40, " ".join(texts[7])), (41, " ".join(texts[0][:29]))]
    rows = [(i, k, t) for i, (k, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "gone int, doc_id long, text string")
    order = {r.gone: (r.doc_id is not None, r.doc_id or 0, r.h) for r in docs.selectExpr("gone", "doc_id", "xxhash64(text) AS h").collect()}
    seen: set = set()
    expected = {}
    for i, _, text in sorted(rows, key=lambda r: order[r[0]]):
        w = text.split()
        own = [tuple(w[k : k + 30]) for k in range(len(w) - 29)]
        dead = {k + j for k, x in enumerate(own) if x in seen for j in range(30)}
        expected[i] = " ".join(x for k, x in enumerate(w) if k not in dead)
        seen.update(own)
    for part in (docs, docs.repartition(3)):
        got = {r.gone: r.text for r in lines.dedup(part).collect()}
        assert got == expected


def test_blocks_within_lines(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n))
    exact, passage, split, short = words(30), words(53), words(54), words(29)
    halves = split.split(" ", 22)
    halves = " ".join(halves[:22]), halves[22]
    first = [words(20) + " " + exact + " " + words(9), words(4) + " " + passage, words(8) + " " + split + " " + words(5), short + " " + words(7)]
    texts = ["\n".join(first)]
    kept = [words(6) for _ in range(9)]
    texts += [f"{kept[0]} {exact} {kept[1]}\nx y"]
    texts += [f"{kept[2]}\t{passage}\n{kept[3]}\n{passage}  {kept[4]} "]
    texts += [f"{kept[5]} {halves[0]}\n{halves[1]} {kept[6]}"]
    texts += [f"{kept[7]} {short} {kept[8]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r._n_lines, r._n_deleted) for r in lines.dedup(docs).collect()}
    assert got[0] == (texts[0], 4, 0)
    assert got[1] == (f"{kept[0]} {kept[1]}\nx y", 2, 0)
    assert got[2] == (f"{kept[2]}\n{kept[3]}\n{kept[4]} ", 3, 0)
    assert got[3] == (f"{kept[5]}\n{kept[6]}", 2, 0)
    assert got[4] == (texts[4], 1, 0)


def test_first_holder_of_a_longer_block(spark):
    """The first document shares less than a block with the others, in the middle of the block that they share."""
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(0, " ".join(["a", *w[6:34], "b"])), (1, " ".join(["c", *w, "d"])), (2, " ".join(["e", *w, "f"]))], "doc_id long, text string")
    assert [r.text for r in lines.dedup(docs).orderBy("doc_id").collect()][2] == "e f"
