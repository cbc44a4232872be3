"""Greedy merging against a plain search over all pairs, and the array costs against those of columns."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from glyphgrid.operators import merging


def plain_cost(counts, n_tiles):
    if not counts.sum():
        return 0.0
    total = 0.0
    for kind in counts:
        used, size = [int(c) for c in kind if c], len(kind)
        total += math.log2(3)
        if len(used) == 1:
            total += math.log2(size)
        elif used:
            bits = max(used).bit_length()
            total += math.log2(max(min(n_tiles, size) - 1, 1)) + min(len(used) * (bits + math.log2(size)), size * bits) - sum(c * math.log2(c / sum(used)) for c in used)
    return total


def plain_greedy(counts, n_tiles):
    live, into = {i: c.copy() for i, c in enumerate(counts)}, list(range(len(counts)))
    while True:
        gains = [(round(plain_cost(live[i] + live[j], n_tiles) - plain_cost(live[i], n_tiles) - plain_cost(live[j], n_tiles), 9), i, j) for i in live for j in live if i < j]
        gain, i, j = min(gains, default=(0, 0, 0))
        if gain >= 0:
            return into
        live[i] += live.pop(j)
        into = [i if k == j else k for k in into]


def random_counts(rng, n, kinds=3, size=8):
    base = [[[rng.randrange(9) if rng.random() < p else 0 for _ in range(size)] for _ in range(kinds)] for p in (0.1, 0.4, 0.9)]
    return np.array([[[c + rng.randrange(2) if c else 0 for c in k] for k in rng.choice(base)] for _ in range(n)], np.int64)


def test_greedy_equals_a_plain_search():
    rng = random.Random(5)
    merges = 0
    for n in (1, 2, 3, 8, 15, 15, 15):
        counts = random_counts(rng, n)
        counts[0] = 0
        into, steps = merging.greedy(counts, n)
        assert into == plain_greedy(counts, n)
        merges += len(steps)
    assert merges > 10


def test_costs_by_population_case(spark):
    rng = random.Random(6)
    counts = np.concatenate([random_counts(rng, 30), np.zeros((1, 3, 8), np.int64)])
    counts[0, 0], counts[1, 1] = 0, [0, 0, 5, 0, 0, 0, 0, 0]
    rows = spark.createDataFrame([(i, c.ravel().tolist(), 12) for i, c in enumerate(counts)], "tile long, counts array<long>, n_tiles long")
    got = [r.cost for r in rows.select("tile", merging.histogram_cost(F.col("counts"), 8, 3, F.col("n_tiles")).alias("cost")).orderBy("tile").collect()]
    expected = [plain_cost(c, 12) for c in counts]
    assert np.allclose(got, expected) and np.allclose(merging.costs(counts, 12), expected) and got[-1] == 0


def test_images_with_many_tiles_are_binned_first(spark):
    rng = random.Random(7)
    rows = [(image, t, c.ravel().tolist(), n) for image, n in ((1, 3), (2, 90)) for t, c in enumerate(random_counts(rng, n))]
    table = spark.createDataFrame(rows, "image_id long, tile long, counts array<long>, n_tiles long")
    bins = merging.merge_bins(merging.entropy_bins(table, 8, 3, 4, 1), 24).collect()
    assert all(sum(1 for r in bins if r.image_id == i) <= 4 for i in (1, 2))
    assert sorted(t for r in bins if r.image_id == 2 for t in r.tiles) == list(range(90))
    labels = {(r.image_id, r.tile): r.label for r in merging.histogram_image(table, 8, 3).collect()}
    assert len(labels) == 93 and labels[2, 0] == 0
    seen = []
    for t in range(90):  # labels count up in the order of tiles
        if labels[2, t] not in seen:
            seen.append(labels[2, t])
    assert seen == list(range(len(seen)))


def test_greedy_queries_equal_the_plain_search(spark):
    from glyphgrid.plans import clusters

    folder = "/root/testdata/sf0.001"
    rows = clusters.tile_histograms(spark, folder).filter("image_id < 48").orderBy("tile").collect()
    got = {(r.image_id, r.tile): r.cluster for r in clusters.QUERIES["o8_28_greedy_clusters"].frame(spark, folder).filter("image_id < 48").collect()}
    for image in {r.image_id for r in rows}:
        own = [r for r in rows if r.image_id == image]
        into = plain_greedy(np.array([np.reshape(r.counts, (4, 16)) for r in own]), own[0].n_tiles)
        assert [got[image, r.tile] for r in own] == [own[k].tile for k in into]


def test_costs_of_a_batch_equal_those_of_columns(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(1, 40)), [int(v) for v in rng.integers(0, 5, 32) * rng.integers(0, 2, 32) * (i % 9 > 0)]) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, n_tiles long, counts array<long>")
    got = merging.with_costs(df, 8, 4, twice=merging.merged(F.col("counts"), F.col("counts")), once=F.col("counts")).collect()
    by = {r.i: (r.twice, r.once) for r in got}
    cost = lambda c: merging.histogram_cost(c, 8, 4, F.col("n_tiles"))
    for r in df.select("i", cost(merging.merged(F.col("counts"), F.col("counts"))).alias("twice"), cost(F.col("counts")).alias("once")).collect():
        assert np.allclose(by[r.i], (r.twice, r.once), atol=1e-9)
