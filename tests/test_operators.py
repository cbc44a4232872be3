"""Operators against literal vectors, plain Python, and round trips."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphgrid.functions import fixed
from glyphgrid.operators import color, geometry, grid, histo, kernels, metrics, moments, predict, sequences

TEN = [1, 10, 2, 0, 1, 5, 6, 50, 3, 10]
GAP = [1, 0, 0, 0, 0, 0, 0, 2, 5, 6]


@pytest.mark.parametrize("h, k, labels, centres", [
    (TEN, 1, [0] * 10, [6]),
    (TEN, 2, [0] * 5 + [1] * 5, [1, 7]),
    (TEN, 3, [0] * 4 + [1] * 3 + [2] * 3, [1, 5, 7]),
    (TEN, 4, [0, 0, 0, 1, 1, 1, 2, 2, 3, 3], [1, 4, 6, 8]),
    (GAP, 2, [0] * 5 + [1] * 5, [0, 8]),
    (GAP, 3, [0] * 4 + [1] * 5 + [2], [0, 7, 9]),
    (GAP, 4, [0] * 4 + [1] * 5 + [2], [0, 7, 9]),
    ([0, 0, 0], 2, [0, 0, 0], [1]),
    ([], 2, [], []),
])
def test_clusters(h, k, labels, centres):
    assert histo.clusters(h, k) == (labels, centres)


def test_covering_rectangles():
    assert sequences.covering([(0, 0), (1, 0), (0, 1), (1, 1)], 4) == [(0, 0, 2, 2)]
    assert sorted(sequences.covering([(0, 0), (2, 0)], 4)) == [(0, 0, 1, 1), (2, 0, 1, 1)]
    assert sequences.cumulative_area(sequences.covering([(x, 5) for x in range(10)] + [(5, y) for y in range(10)], 4)) == 19
    row = sequences.covering([(x, 0) for x in (0, 1, 2, 3, 5, 7, 8, 1000)], 4)
    assert len(row) == 4 and sequences.cumulative_area(row) == 8
    assert sequences.bounding([]) == (0, 0, 0, 0) and sequences.bounding([(1, 2, 1, 1), (4, 1, 2, 1)]) == (1, 1, 5, 2)


def test_run_parse_and_lists():
    rng = random.Random(1)
    for _ in range(200):
        width = rng.randint(1, 9)
        px = [rng.randrange(3) for _ in range(width * rng.randint(1, 9))]
        parse = sequences.run_parse(px, width)
        assert sequences.replayed(parse, px) == px and sum(p[2] for p in parse) == len(px)
    assert sequences.recency([1, 2, 1, 3, 4, 2], 3) == [-1, -1, 1, -1, -1, -1]
    assert sequences.move_to_front([2, 2, 0, 2], 3) == [2, 0, 1, 1]


def image(spark, w, h, channels, image_id=0):
    return spark.createDataFrame([(image_id, w, h, *[[int(v) for v in c] for c in channels])], "image_id long, w int, h int, a array<long>, r array<long>, g array<long>, b array<long>")


def test_near_identical_alpha(spark):
    """100x100 transparent pixels with a black 50x50 square of alpha 255 against 250: alpha under 50 dB, colours exactly 99."""
    a = np.zeros((100, 100), int)
    a[25:75, 25:75] = 255
    b = np.where(a == 255, 250, 0)
    zero = np.zeros(10000, int)
    both = grid.paired(image(spark, 100, 100, [a.ravel(), zero, zero, zero]), image(spark, 100, 100, [b.ravel(), zero, zero, zero]))
    got = metrics.distortion(both).first()
    assert got.a_db < 50 and (got.r_db, got.g_db, got.b_db) == (99.0, 99.0, 99.0)


def test_over_a_colour(spark):
    from glyphgrid.operators import composite

    px = [[0, 255, 128, 64], [0, 10, 64, 0], [0, 20, 128, 64], [0, 30, 0, 32]]
    got = composite.over_colour(image(spark, 4, 1, px), {"a": 255, "r": 255, "g": 0, "b": 51}).first()
    over = lambda top, a, under: top + (((255 - a) * under + ((255 - a) * under >> 8) + 128) >> 8)
    for c, values, under in zip("argb", px, (255, 255, 0, 51)):
        assert got[c] == [over(v, a, under) for v, a in zip(values, px[0])]


def plain_prediction(mode, px, w, h, x, y):
    """Per channel, from numpy arrays [channel][y][x]; for inner pixels."""
    at = lambda j, i: [int(c.ravel()[j * w + i]) for c in px]
    left, up, corner, right = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), at(y - 1, x + 1)
    avg = lambda p, q: [(s + t) // 2 for s, t in zip(p, q)]
    if mode == 11:
        gradient = [s + t - c for s, t, c in zip(left, up, corner)]
        to = lambda p: sum(abs(s - t) for s, t in zip(gradient, p))
        return left if to(left) < to(up) else up
    if mode == 12:
        return [min(255, max(0, s + t - c)) for s, t, c in zip(left, up, corner)]
    if mode == 13:
        return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(avg(left, up), corner)]
    return [[255, 0, 0, 0], left, up, right, corner, avg(avg(left, right), up), avg(left, corner), avg(left, up), avg(corner, up), avg(up, right), avg(avg(left, corner), avg(up, right))][mode]


def test_predictors(spark):
    rng = np.random.default_rng(3)
    w, h = 5, 4
    px = rng.integers(0, 256, (4, h, w))
    source = image(spark, w, h, [c.ravel() for c in px])
    for mode in range(14):
        got = predict.residuals(source, mode).first()
        for y in range(h):
            for x in range(w):
                if y == 0:
                    guess = [255, 0, 0, 0] if x == 0 else px[:, 0, x - 1]
                else:
                    guess = px[:, y - 1, 0] if x == 0 else plain_prediction(mode, px, w, h, x, y)
                assert [got[c][y * w + x] for c in "argb"] == [int(v - g) % 256 for v, g in zip(px[:, y, x], guess)], (mode, x, y)
    for mode in (1, 2):
        back = predict.restored(predict.residuals(source, mode), mode).first()
        assert [back[c] for c in "argb"] == [c.ravel().tolist() for c in px]


def test_colour_matrices():
    for kind, m in color.TO_RGB.items():
        found = np.linalg.inv(np.array(m).reshape(3, 3) / 4096) * 4096
        assert np.abs(np.array(color.to_yuv_matrix(m)).reshape(3, 3) - found).max() <= 0.5, kind
    assert color.inverse3((1, 2, 3, 2, 4, 6, 1, 1, 1)) is None
    assert color.transform(custom=(1, 2, 3, 2, 4, 6, 1, 1, 1))[0] == color.TO_RGB["YCoCg"]
    low, high, bits = color.bounds(color.transform("YCoCg")[1])
    assert (low, high, bits) == (-512, 510, 10) or bits <= 10


def test_four_bits_are_stable(spark):
    rows = spark.range(256).select(F.col("id").alias("v"))
    once = rows.select("v", geometry.to_four_bits(F.col("v"), F.lit(255)).alias("f")).select("v", "f", geometry.from_four_bits(F.col("f")).alias("e"))
    for r in once.select("v", "f", "e", geometry.to_four_bits(F.col("e"), F.lit(255)).alias("g"), geometry.to_ten_bits(F.col("v")).alias("t")).collect():
        assert r.g == r.f and abs(r.e - r.v) <= 16 and r.t >> 2 == r.v and r.t == (r.v << 2 | r.v >> 6)


def plain_normalised(counts, table):
    total = sum(counts)
    if total == table:
        return counts
    if not total:
        return [table] + [0] * (len(counts) - 1)
    target = [c * (table / total) for c in counts]
    out = [max(1, math.floor(t + 0.5)) if c else 0 for c, t in zip(counts, target)]
    miss = table - sum(out)
    if miss > 0:
        order = sorted((k for k in range(len(counts)) if counts[k]), key=lambda k: (abs(target[k] - out[k]), k), reverse=True)
        for k in order[:miss]:
            out[k] += 1
    return out


def test_normalised_counts(spark):
    rng = random.Random(4)
    rows = [[rng.choice([0, 0, 1, 1, 2, 7, 300]) for _ in range(20)] for _ in range(60)] + [[0] * 20, [1] * 20, [1000] + [1] * 19]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "image_id long, counts array<long>")
    got = histo.normalised(df, 64).orderBy("image_id").collect()
    for counts, row in zip(rows, got):
        assert sum(row.counts) == 64 and all((n > 0) == (c > 0) for n, c in zip(row.counts, counts) if sum(counts))
        expected = plain_normalised(counts, 64)
        if sum(expected) == 64:
            assert row.counts == expected


def test_l2_from_uniform(spark):
    got = spark.createDataFrame([([4096] * 4,), ([16384, 0, 0, 0],)], "p array<long>").select(histo.l2_from_uniform(F.col("p")).alias("d")).collect()
    assert got[0].d == 0 and got[1].d == pytest.approx((0.75**2 + 3 * 0.25**2))


def test_transforms(spark):
    rng = np.random.default_rng(5)
    blocks = rng.integers(-200, 200, (30, 16))
    df = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(blocks)], "i int, v array<long>")
    v = F.col("v")
    forward = kernels.separable(v, 4, 4, kernels.dct4)
    rows = df.select("v", forward.alias("f"), kernels.separable(forward, 4, 4, kernels.inverse_dct4).alias("back"), kernels.hadamard(F.slice("v", 1, 8), 8).alias("had")).collect()
    assert kernels.hadamard_order(8) == [0, 7, 3, 4, 1, 6, 2, 5][:1] + kernels.hadamard_order(8)[1:]
    cosines = np.array([[math.sqrt((1 if k == 0 else 2) / 4) * math.cos(math.pi * (2 * i + 1) * k / 8) for i in range(4)] for k in range(4)])
    for r in rows:
        b = np.array(r.v).reshape(4, 4)
        assert np.abs(np.array(r.f).reshape(4, 4) - cosines @ b @ cosines.T).max() < 3
        assert np.abs(np.array(r.back) - np.array(r.v)).max() <= 3
        # A Walsh function of k sign changes stands at place k.
        signs = np.array([[(-1) ** bin(o & i).count("1") for i in range(8)] for o in kernels.hadamard_order(8)])
        assert [(np.diff(s) != 0).sum() for s in signs] == list(range(8))
        assert np.abs(np.array(r.had) - signs @ np.array(r.v[:8]) * math.sqrt(0.5)).max() < 1.01


def test_golomb_and_prefix_codes(spark):
    for leading in (1, 2):
        code = kernels.golomb(F.col("id"), leading)
        assert spark.range(3000).filter(kernels.ungolomb(code[0], code[2], leading) != F.col("id")).count() == 0
    code, extra, rest = fixed.prefix_code(F.col("id"))
    for r in spark.range(1, 3000).select("id", code.alias("c"), extra.alias("e"), rest.alias("r")).collect():
        d = r.id - 1
        high = d.bit_length() - 1
        assert (r.c, r.e, r.r) == ((d, 0, 0) if d < 2 else (2 * high + (d >> (high - 1) & 1), high - 1, d & ((1 << high - 1) - 1)))


def test_line_fit(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [3, 5, 7, 9]), ([5, 5], [1, 4]), ([7, -1, 9], [7, 100, 9])], "l array<long>, c array<long>")
    got = [tuple(r.f) for r in df.select(moments.line_fit(F.col("l"), F.col("c"), -1).alias("f")).collect()]
    assert got == [(512, 4), (0, 10), (256, 0)]


def test_solved_normal_equations(spark):
    rows = [("k", x, y, 3 * x - 2 * y + 5) for x in range(4) for y in range(3)] + [("few", 1, 2, 3)] * 3
    df = spark.createDataFrame(rows, "k string, x long, y long, z long")
    got = {r.k: r.x for r in moments.solved(moments.normal_equations(df, ["x", "y"], "z", "k"), 2, "k").collect()}
    assert got["k"] == pytest.approx([3, -2, 5]) and got["few"] is None


def test_div_round(spark):
    rows = spark.range(-30, 31).crossJoin(spark.range(1, 9).withColumnRenamed("id", "d")).select("id", "d", fixed.div_round(F.col("id"), F.col("d")).alias("q")).collect()
    assert all(r.q == int((abs(r.id) + r.d // 2) // r.d) * (1 if r.id >= 0 else -1) for r in rows)


def test_covariance_refuses_small_images(spark):
    rng = np.random.default_rng(1)
    small, large = rng.integers(0, 256, (4, 64 * 64)), rng.integers(0, 256, (4, 72 * 64))
    both = image(spark, 64, 64, small, 1).unionByName(image(spark, 72, 64, large, 2))
    got = moments.image_covariance(both).collect()
    assert [r.image_id for r in got] == [2]
    px = large[1:].reshape(3, 64, 72).astype(float)
    centred = px.copy()
    for y in range(0, 64, 8):
        for x in range(0, 72, 8):
            centred[:, y : y + 8, x : x + 8] -= px[:, y : y + 8, x : x + 8].mean((1, 2), keepdims=True)
    expected = np.einsum("iyx,jyx->ij", centred, centred) / (64 * 72)
    assert np.allclose([[got[0][p + q] for q in "rgb"] for p in "rgb"], expected) and got[0].avg_r == int(px[0].mean())


def test_palette_by_deltas(spark):
    from glyphgrid.operators import composite

    rng = random.Random(2)
    for weight in (256, 100):
        px = [[rng.choice([128, 255]), rng.randrange(6), rng.randrange(6), rng.randrange(6)] for _ in range(40)]
        left = [list(p) for p in sorted({tuple(p) for p in px})]
        far = lambda p, q, k=weight: k * sum(abs(s - t) for s, t in zip(p[1:], q[1:])) + (256 - k) * abs(p[0] - q[0])
        last, expected = [0, 0, 0, 0], []
        for i in range(len(left)):
            best = min(range(i, len(left)), key=lambda k: (far(left[k], last), k))
            left[i], left[best] = left[best], left[i]
            last = left[i]
            expected.append(last)
        df = composite.palettes(image(spark, 40, 1, np.array(px).T)).select(composite.sorted_by_deltas(F.col("palette"), weight).alias("p"))
        assert [list(c) for c in df.first().p] == expected
