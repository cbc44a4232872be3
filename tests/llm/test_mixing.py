from collections import defaultdict

import pytest

from glyphgrid.llm import mixing


def sainte_lague(targets, n):
    seats = [0] * len(targets)
    for _ in range(n):
        best = max(range(len(targets)), key=lambda i: (targets[i] / (2 * seats[i] + 1), -i))
        seats[best] += 1
    return seats


def fill(sizes, weights, share=1.5, most=2):
    left, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = left / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [[1000, 400, 900, 5000, 10, 700], [50, 50, 50], [0, 10, 3000], [77]])
def test_targets_and_quotas(spark, sizes):
    sources = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    goals = mixing.targets(sources)
    expected = fill(sizes, weights)
    got = {r.place - 1: r.target for r in goals.collect()}
    assert [got[i] for i in range(len(sizes))] == pytest.approx(expected)
    seats = defaultdict(list)
    for r in mixing.quotas(goals, 8, 4).orderBy("shard").collect():
        seats[r.place - 1].append(r.seats)
    n = round(sum(expected) / 8)
    for m in range(4):
        so_far = [sum(seats[i][: m + 1]) for i in range(len(sizes))]
        assert so_far == sainte_lague([got[i] for i in range(len(sizes))], int(n * (m + 1) / 4 + 0.5))


def test_mix(spark):
    rows = [(i, "w " * (i % 90), ["b", "a", None, "c"][min(i % 7, 3)], "x") for i in range(600)] + [(None, None, "a", "x"), (3, "w", "a", "x"), (3, "w", "a", "x"), (900, "w\t\nv " * 9000, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs.repartition(4)).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len((t or "").split()) for _, t, _, _ in rows)
    taken = defaultdict(int)
    for r in sorted(got, key=key):
        assert 0 <= r.taken <= 2 * r.size
        taken[(r.source_size, r.target)] += r.taken
    for (size, target), t in taken.items():
        assert target <= 2 * size and abs(t - target) <= 3 * mixing.BLOCK_WORDS
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.mix(docs.selectExpr("doc_id", "'' as text", "source", "size as extra")).collect()
    assert len(nothing) == len(rows) and {r.taken for r in nothing} == {0}


def test_texts_taken(spark):
    """The words that are emitted are those that the mix takes, for each document, so that a source comes near its target."""
    rng = [(7919 * i) % 401 for i in range(300)]
    rows = [(i, " ".join(f"d{i}w{k}" + "\t\n"[k % 2 : k % 9] for k in range(rng[i])), ["a", "b", "c", None][min(i % 5, 3)], i) for i in range(300)] + [(900, None, "a", 0), (901, " \n", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    takes = {r.doc_id: r for r in mixing.mix(docs).collect()}
    texts = {i: (t or "").split() for i, t, _, _ in rows}
    out = mixing.texts_taken(docs).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "size"} and {r.size for r in out} <= {r[3] for r in rows}
    emitted, by_source = defaultdict(int), defaultdict(int)
    for r in out:
        words = r.text.split()
        emitted[r.doc_id] += len(words)
        by_source[r.source] += len(words)
        places = iter(texts[r.doc_id])
        assert words and all(w in places for w in words)
    assert {i: r.taken for i, r in takes.items() if r.taken} == dict(emitted)
    source = {i: s for i, _, s, _ in rows}
    goals = {source[i]: r.target for i, r in takes.items()}
    assert all(abs(by_source[s] - goals[s]) <= 3 * mixing.BLOCK_WORDS for s in goals)


def test_placements_fill_the_quotas_of_the_shards(spark):
    """Each shard takes as many blocks of a source as its quota has seats, and all of them together what the mix takes."""
    rng = __import__("random").Random(5)
    rows = [(i, "w " * rng.choice([0, 3, 40, 500]), rng.choice(["a", "b", "c", None])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.placements(docs).collect()
    words = defaultdict(int)
    for r in got:
        words[r.doc_id] += r.words
    size = {i: len(t.split()) for i, t, _ in rows}
    assert all(0 <= r.shard < mixing.SHARDS and r.words > 0 and 0 <= r.first and r.first + r.words <= size[r.doc_id] for r in got)
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} == {i: words[i] for i, _, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = spark.createDataFrame([(s, n) for s, n in {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}.items()], "source string, source_size long")
    quota = {(r.source, r.shard): r.seats for r in mixing.quotas(mixing.targets(sizes)).collect()}
    taken = defaultdict(int)
    for r in got:
        taken[source[r.doc_id], r.shard] += r.words
    for (s, shard), seats in quota.items():
        # The last block of a source may be short, and one block's length lies between two rows.
        assert abs(taken[s, shard] - seats * mixing.BLOCK_WORDS) <= 2 * mixing.BLOCK_WORDS, (s, shard)
