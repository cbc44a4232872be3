"""A colour space fitted to an image: covariance within blocks, its axes by power iteration, and a matrix that fills the range.

Images come as rows of pixels (image_id, y, r, g, b as arrays), so a large one is many rows. Both passes over the pixels are
sums and maxima by groupBy; between them stands one row for each image, whose 3x3 matrices numpy works on, many images at once.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.functions.fixed import idiv

#: Pixels below which no fit is tried, the block's side, the range of the fitted planes, the fixed point of matrices and its bounds.
LEAST_PIXELS, BLOCK, TOP, POINT, LEAST_ENTRY, MOST_ENTRY = 64 * 64, 8, 512.0, 4096.0, 10.0, float((1 << 14) - 1)
#: Where the three axes start, the axis that the first must be near, and what stands in where there is none.
SEEDS, LUMA, GREY_AXIS = ((0.5, 0.0, 0.5), (0.5, 0.5, -0.5), (0.5, -0.5, 0.5)), (0.299, 0.587, 0.114), (0.0, 1.0, -1.0)
STOP, ROUNDS, FAR_FROM_LUMA = 0.001, 20, 0.4
PAIRS = [p + q for p in "rgb" for q in "rgb"]
ENTRIES = [f"m{k}" for k in range(9)]


def covariance(rows: DataFrame) -> DataFrame:
    """image_id, n, avg_r (the mean red, truncated) and the nine products within blocks, a pixel's share; of images of enough pixels alone."""
    pixels = rows.select("image_id", idiv(F.col("y"), BLOCK).alias("by"), F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "p")).select("image_id", "by", idiv(F.col("x"), BLOCK).alias("bx"), *[F.col(f"p.{c}").cast("long").alias(c) for c in "rgb"])
    blocks = pixels.groupBy("image_id", "by", "bx").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "rgb"], *[F.sum(F.col(k[0]) * F.col(k[1])).alias(k) for k in PAIRS])
    within = blocks.select("image_id", "n", F.col("r").alias("sum_r"), *[(F.col(k).cast("double") - F.col(k[0]).cast("double") * F.col(k[1]) / F.col("n")).alias(k) for k in PAIRS])
    whole = within.groupBy("image_id").agg(F.sum("n").alias("n"), F.floor(F.sum("sum_r") / F.sum("n")).cast("long").alias("avg_r"), *[(F.sum(k) / F.sum("n")).alias(k) for k in PAIRS])
    return whole.filter(F.col("n") > LEAST_PIXELS)


def inverse(m: list) -> list:
    """The nine entries of a 3x3 matrix's inverse by cofactors; null where it is singular."""
    minor = lambda i, j: m[3 * ((i + 1) % 3) + (j + 1) % 3] * m[3 * ((i + 2) % 3) + (j + 2) % 3] - m[3 * ((i + 1) % 3) + (j + 2) % 3] * m[3 * ((i + 2) % 3) + (j + 1) % 3]
    det = m[0] * minor(0, 0) + m[1] * minor(0, 1) + m[2] * minor(0, 2)
    return [F.when(det != 0, minor(i, j) / det) for j in range(3) for i in range(3)]


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


def axes_of(cov: np.ndarray) -> tuple:
    """(the axes as columns, their lengths, whether they can be trusted), by power iteration and deflation."""
    cov, axes, lengths, found = cov.copy(), np.array(SEEDS), np.ones(3), True
    for k in range(3):
        length, settled = 0.0, False
        for _ in range(ROUNDS):
            new = cov @ axes[k]
            squared = float(new @ new)
            length = squared
            if squared < STOP:
                settled = True
                break
            length = np.sqrt(squared)
            new = new / (length if new[0] >= 0 else -length)
            moved = float(np.abs(axes[k] - new).sum())
            axes[k] = new
            if moved < STOP:
                settled = True
                break
        if k == 0 and (not settled or length < STOP or np.linalg.norm(axes[0] - LUMA) > FAR_FROM_LUMA):
            found = False  # not a brightness: blocks could not be told apart by it
            break
        if length < STOP:
            axes[k] = _unit(np.cross(GREY_AXIS, axes[0])) if k == 1 else _unit(np.cross(axes[0], axes[1]))
            if k == 2 and axes[2][0] < 0:
                axes[2] = -axes[2]
        lengths[k] = length
        cov -= np.outer(cov @ axes[k], axes[k])
    a, b, c = lengths
    good = found and ((a >= 2500 and b >= 20 and c >= 1) or (a <= 5000 and b >= 300 * (1 - a / 5000))) and b < 1000
    return axes.T, lengths, bool(good)


def axes(covariances: DataFrame) -> DataFrame:
    """image_id, avg_r, good, the lengths l0 to l2 and the axes m0 to m8 as a matrix from the fitted space to colours, rows first."""

    def run(batches):
        for batch in batches:
            cov = np.stack([batch.column(2 + k).to_numpy() for k in range(9)], -1).reshape(-1, 3, 3) if batch.num_rows else np.empty((0, 3, 3))
            got = [axes_of(c) for c in cov]
            columns = [*batch.columns[:2], pa.array([g[2] for g in got], pa.bool_())]
            columns += [pa.array([float(g[1][k]) for g in got], pa.float64()) for k in range(3)] + [pa.array([float(g[0].ravel()[k]) for g in got], pa.float64()) for k in range(9)]
            yield pa.RecordBatch.from_arrays(columns, names=["image_id", "avg_r", "good", "l0", "l1", "l2", *ENTRIES])

    kind = covariances.schema["image_id"].dataType.simpleString()
    return covariances.select("image_id", "avg_r", *PAIRS).mapInArrow(run, f"image_id {kind}, avg_r long, good boolean, l0 double, l1 double, l2 double, " + ", ".join(f"{m} double" for m in ENTRIES))


def reach(rows: DataFrame, matrices: DataFrame) -> DataFrame:
    """image_id and most: how far any pixel lies along an axis, 1 at least. matrices: image_id, avg_r, and i0 to i8 from colours to the space."""
    both = rows.join(matrices.select("image_id", "avg_r", *[f"i{k}" for k in range(9)]), "image_id")
    along = lambda p, k: F.abs(F.col(f"i{3 * k}") * (p["r"] - F.col("avg_r")) + F.col(f"i{3 * k + 1}") * (p["g"] - 128) + F.col(f"i{3 * k + 2}") * (p["b"] - 128))
    most = F.aggregate(F.arrays_zip("r", "g", "b"), F.lit(1.0), lambda s, p: F.greatest(s, along(p, 0), along(p, 1), along(p, 2)))
    return both.select("image_id", most.alias("most")).groupBy("image_id").agg(F.max("most").alias("most"))


def fitted(rows: DataFrame) -> DataFrame:
    """image_id, fits, avg_r and the matrix m0 to m8 to colours in fixed point; nulls where no fit holds. Small images have no row."""
    found = axes(covariance(rows))
    inverted = found.select("*", *[v.alias(f"i{k}") for k, v in enumerate(inverse([F.col(m) for m in ENTRIES]))])
    scaled = inverted.join(reach(rows, inverted.filter("good and i0 is not null")), "image_id", "left")
    entries = [F.col(m) * F.col("most") / TOP * POINT for m in ENTRIES]
    largest = F.greatest(*[F.abs(e) for e in entries])
    fits = F.coalesce(F.col("good") & F.col("i0").isNotNull() & (largest >= LEAST_ENTRY) & (largest <= MOST_ENTRY), F.lit(False))
    return scaled.select("image_id", fits.alias("fits"), "avg_r", *[F.when(fits, (F.signum(e) * F.floor(F.abs(e) + 0.5))).cast("long").alias(m) for e, m in zip(entries, ENTRIES)])
