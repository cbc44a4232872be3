"""Rasters and tiles of one size are worked on together, and give what each gives alone."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from glyphgrid.operators import deblock, directional, geometry, metrics, predict, stencils


@pytest.fixture
def small_batches(spark):
    """The pieces of a tile lie in two batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rasters(spark, planes: dict, n: int = 12, sides=((9, 21), (24, 16), (3, 5), (1, 17), (16, 1))):
    """(the planes by id, a DataFrame of them): random values below those given, the last image without an id."""
    rng, arrays = np.random.default_rng(4), {}
    for k in [*range(n - 1), None]:
        arrays[k] = {c: rng.integers(0, top, sides[(k or 0) % len(sides)]) for c, top in planes.items()}
    rows = [(k, p[next(iter(planes))].shape[1], p[next(iter(planes))].shape[0], *[v.ravel().tolist() for v in p.values()]) for k, p in arrays.items()]
    return arrays, spark.createDataFrame(rows, "image_id long, w int, h int, " + ", ".join(f"{c} array<long>" for c in planes)).coalesce(2)


def assembled(tiles, arrays: dict, *planes: str) -> dict:
    out = {k: {c: np.full(next(iter(p.values())).shape, -1) for c in planes} for k, p in arrays.items()}
    for r in tiles.collect():
        for c in planes:
            out[r.image_id][c][r.y : r.y + r.h, r.x : r.x + r.w] = np.reshape(r[c], (r.h, r.w))
    return out


def test_a_body_gets_many_tiles_at_once(spark):
    df = spark.createDataFrame([(k, 20, 3, [k] * 60) for k in range(50)], "image_id long, w int, h int, v array<long>").coalesce(1)
    got = stencils.on_tiles(stencils.cut(df, ("v",), 16).coalesce(1), ("v",), {"v": "array<long>", "n": "long"}, lambda p, at: {"v": np.full_like(p["v"], len(p["v"])), "n": np.ones_like(p["v"])}, 2, 16).collect()
    assert len(got) == 100 and sum(r.n for r in got) == 3000
    assert max(r.v[0] for r in got) > 1


def plain_filtered(p: dict, size: int, damping: int) -> np.ndarray:
    """Pixel after pixel."""
    v, out = p["v"], p["v"].copy()
    best, _ = directional.directions(v, size)
    for by, bx in np.ndindex(*best.shape):
        for y, x in np.ndindex(size, size):
            y, x, seen, total = y + by * size, x + bx * size, [v[y + by * size, x + bx * size]], 0
            for turn, kind in ((0, "along"), (-2, "beside"), (2, "beside")):
                strength = int(p[kind][y, x])
                for k, (dy, dx) in enumerate(directional.STEPS[(best[by, bx] + turn) % 8]):
                    for j, i in ((y + dy, x + dx), (y - dy, x - dx)):
                        if strength and 0 <= j < v.shape[0] and 0 <= i < v.shape[1]:
                            far = int(v[j, i] - v[y, x])
                            held = min(max(strength - (abs(far) >> max(0, damping - strength.bit_length() + 1)), 0), abs(far))
                            weight = directional.ALONG[strength & 1][k] if kind == "along" else directional.BESIDE[k]
                            total += held * weight * (1 if far > 0 else -1)
                            seen.append(v[j, i])
            moved = v[y, x] + ((8 + total - (total < 0)) >> 4)
            out[y, x] = min(max(moved, min(seen)), max(seen)) if p["along"][y, x] and p["beside"][y, x] else moved
    return out


@pytest.mark.parametrize("size", [4, 8])
def test_enhanced_tiles_are_those_of_the_image(spark, small_batches, size):
    arrays, df = rasters(spark, {"v": 256, "along": 5, "beside": 3})
    whole = {r.image_id: np.array(r.v) for r in directional.enhance(df, size).collect()}
    got = assembled(directional.enhance_tiles(stencils.cut(df, directional.PLANES, 8), size, side=8), arrays, "v")
    for k, p in arrays.items():
        expected = plain_filtered(p, size, 5)
        assert (got[k]["v"] == expected).all() and (whole[k] == expected.ravel()).all()


def test_deblocked_tiles_are_those_of_the_image(spark, small_batches):
    arrays, df = rasters(spark, {"v": 12, "bits": 1, "density": 1})
    got = assembled(deblock.deblock_tiles(stencils.cut(df, deblock.PLANES, 8), 8, 6, 8), arrays, "v")
    for k, p in arrays.items():
        assert (got[k]["v"] == deblock.deblocked(p, (0, 0, *p["v"].shape), 8, 6)["v"]).all()


@pytest.mark.parametrize("kind", ["lsim", "ssim"])
def test_sums_of_tiles_come_from_python_as_numbers(spark, small_batches, kind):
    arrays, df = rasters(spark, {"r": 256, "r2": 256})
    sums = metrics.tile_sums(stencils.cut(df, ("r", "r2"), 8), kind, ("r",), 8)
    assert "aggregate(" not in sums._jdf.queryExecution().optimizedPlan().toString()
    got = {r.image_id: (r.n, r.t_r) for r in sums.collect()}
    for k, p in arrays.items():
        h, w = p["r"].shape
        if kind == "lsim":
            expected = sum(min((int(p["r"][j, i]) - int(p["r2"][y, x])) ** 2 for j in range(max(0, y - 2), min(h, y + 3)) for i in range(max(0, x - 2), min(w, x + 3))) for y in range(h) for x in range(w))
        else:
            expected = metrics.index_of(metrics.moments_of(p["r"], p["r2"])).sum()
        assert got[k] == (h * w, pytest.approx(expected))


def plain_near_lossless(planes: dict, quality: int) -> dict:
    """Pixel after pixel."""
    h, w = planes["r"].shape
    for bits in range(min(4, 100 - quality), 0, -1):
        out = {c: v.copy() for c, v in planes.items()}
        for y, x in np.ndindex(h, w):
            near = [(y, x - 1), (y, x + 1), (max(0, y - 1), x), (min(h - 1, y + 1), x)]
            if 0 < x < w - 1 and any(abs(int(v[y, x]) - int(v[j])) >= max(1, (2**bits - 1) // 2) for j in near for v in planes.values()):
                for c, v in planes.items():
                    biased = int(v[y, x]) + ((2**bits - 1) >> 1) + (int(v[y, x]) >> bits) % 2
                    out[c][y, x] = 255 if biased > 255 else biased - biased % 2**bits
        planes = out
    return planes


def test_near_lossless_of_stacks(spark, small_batches):
    # A stack before there were stacks: an axis in front failed.
    flat = np.random.default_rng(1).integers(0, 4, (3, 6, 9))
    got = predict._smoothed(dict.fromkeys("argb", flat), 97)
    assert all((got[c][k] == plain_near_lossless(dict.fromkeys("argb", flat[k]), 97)[c]).all() for c in "argb" for k in range(3))
    arrays, df = rasters(spark, {"a": 6, "r": 256, "g": 12, "b": 3})
    whole = {r.image_id: r for r in predict.near_lossless(df, 96).collect()}
    tiled = assembled(predict.near_lossless_tiles(stencils.cut(df, tuple("argb"), 8), 96, 8), arrays, *"argb")
    for k, p in arrays.items():
        expected = plain_near_lossless(p, 96)
        assert all((tiled[k][c] == expected[c]).all() and whole[k][c] == expected[c].ravel().tolist() for c in "argb")


def plain_doubled(v: list, w: int, h: int, w2: int, h2: int) -> list:
    """Pixel after pixel; None where a value that it needs is None."""
    taps = (geometry.UP_FULL, geometry.UP_HALF)
    out = []
    for y in range(h2):
        for x in range(w2):
            near = [(v[min(max(y // 2 + j, 0), h - 1) * w + min(max(x // 2 + i, 0), w - 1)], t * s) for j, s in taps[y % 2].items() for i, t in taps[x % 2].items()]
            out.append(None if any(n is None for n, _ in near) else (sum(n * t for n, t in near) + 128) >> 8)
    return out


def test_doubled_planes_of_stacks(spark, small_batches):
    arrays, df = rasters(spark, {"r": 256, "g": 5})
    rows = [(r.image_id, r.w, r.h, r.r if r.image_id != 3 else [None, *r.r[1:]], r.g) for r in df.collect()] + [(99, None, 2, [1, 2], [3, 4]), (98, 1, 2, None, [3, 4])]
    df = spark.createDataFrame(rows, df.schema).coalesce(1)
    made = geometry.plane_double(df, 2 * F.col("w") - 1, 2 * F.col("h"), ("r", "g"))
    assert "transform(" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {r.image_id: r for r in made.collect()}
    assert len(got) == len(rows) and got[99].r is None and got[98].r is None
    for k, w, h, *planes in rows[:-2]:
        for c, v in zip("rg", planes):
            assert (got[k].w, got[k].h) == (2 * w - 1, 2 * h) and got[k][c] == plain_doubled(v, w, h, 2 * w - 1, 2 * h)


def test_halved_planes_of_stacks(spark, small_batches):
    arrays, df = rasters(spark, {"r": 256})
    got = {r.image_id: r for r in geometry.plane_half(df).collect()}
    for k, p in arrays.items():
        h, w = p["r"].shape
        at = lambda y, x: int(p["r"][min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
        expected = [(sum(at(2 * y + j, 2 * x + i) * s * t for j, s in geometry.DOWN_SHARP.items() for i, t in geometry.DOWN_SHARP.items()) + 128) >> 8 for y in range((h + 1) // 2) for x in range((w + 1) // 2)]
        assert got[k].r == expected
