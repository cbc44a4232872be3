"""Axes against numpy's eigenvectors, and fitted matrices by what they do to the pixels."""

import numpy as np
from pyspark.sql import functions as F

from glyphgrid.operators import fit
from glyphgrid.plans import fits


def test_axes_are_eigenvectors():
    rng = np.random.default_rng(3)
    trusted = 0
    for _ in range(200):
        turn = np.linalg.qr(np.array([[0.5, 0.6, 0.3], [0.6, -0.1, -0.9], [0.4, -0.8, 0.5]]).T + rng.normal(0, 0.05, (3, 3)))[0]
        lengths = np.array([rng.uniform(2600, 9000), rng.uniform(100, 900), rng.uniform(1, 30)])
        cov = turn @ np.diag(lengths) @ turn.T
        axes, found, good = fit.axes_of(cov)
        if good:
            trusted += 1
            values, vectors = np.linalg.eigh(cov)
            assert np.allclose(found, values[::-1], rtol=0.02)
            assert np.allclose(np.abs((axes * vectors[:, ::-1]).sum(0)), 1, atol=0.01)
    assert trusted > 50


def test_cases_without_three_axes():
    one = np.array([0.4, 0.8, 0.3])
    axes, lengths, _ = fit.axes_of(3000 * np.outer(one, one))
    assert lengths[1] < fit.STOP and abs(axes[:, 0] @ axes[:, 1]) < 1e-6 and axes[0, 2] >= 0
    assert not fit.axes_of(np.zeros((3, 3)))[2]
    assert not fit.axes_of(np.diag([1.0, 1.0, 9000.0]))[2]  # far from brightness


def test_fitted_matrices_fill_the_range(spark):
    """Random colours along known axes; small images are refused."""
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(np.array([[0.4, 0.8, 0.3], [0.7, -0.1, -0.7], [0.4, -0.8, 0.5]]).T)[0]
    turn = turn * np.sign(turn[0])
    rows, big = [], {}
    for image, height in ((0, 72), (1, 64), (2, 100)):
        steps = rng.normal(0, 1, (height, 64, 3)) * [60, 18, 4]
        px = np.clip(np.round(128 + steps @ turn.T), 0, 255).astype(int)
        big[image] = px.reshape(-1, 3)
        rows += [(image, y, *[px[y, :, c].tolist() for c in range(3)]) for y in range(height)]
    table = spark.createDataFrame(rows, "image_id long, y int, r array<long>, g array<long>, b array<long>").repartition(5)
    got = {r.image_id: r for r in fit.fitted(table).collect()}
    assert set(got) == {0, 2} and all(r.fits for r in got.values())
    for image, r in got.items():
        to_rgb = np.array([r[f"m{k}"] for k in range(9)], float).reshape(3, 3) / fit.POINT
        spread = np.abs((big[image] - [r.avg_r, 128, 128]) @ np.linalg.inv(to_rgb).T).max()
        assert abs(spread - fit.TOP) < 2
        unit = to_rgb / np.linalg.norm(to_rgb, axis=0)
        assert abs(abs(unit[:, 0] @ turn[:, 0]) - 1) < 0.02


def test_queries_agree_with_numpy(spark):
    folder = "/root/testdata/sf0.001"
    axes = fits.QUERIES["o5_15_axes"].frame(spark, folder).orderBy("image_id").collect()
    rows = fits.pixel_rows(spark, folder).orderBy("image_id", "y").collect()
    for a in axes:
        px = np.array([[r.r, r.g, r.b] for r in rows if r.image_id == a.image_id], float).transpose(0, 2, 1)
        cov = np.zeros((3, 3))
        for y in range(0, len(px), 8):
            for x in range(0, 64, 8):
                block = px[y : y + 8, x : x + 8].reshape(-1, 3)
                cov += (block - block.mean(0)).T @ (block - block.mean(0))
        expected, lengths, good = fit.axes_of(cov / (len(px) * 64))
        assert good == a.good and np.allclose([a.l0, a.l1, a.l2], lengths, atol=1e-4)
        assert np.allclose([a[f"m{k}"] for k in range(9)], expected.ravel(), atol=1e-5)
    assert len(axes) == 6 and fits.QUERIES["o5_17_fitted"].frame(spark, folder).filter(F.col("image_id") == 6).count() == 0
