"""Sums over cells and blocks, integral images, deviations, line fits, normal equations and averages."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.functions.fixed import clamp_signed, div_round, idiv
from glyphgrid.operators import grid


def cell(channel: Column, w, h, cx, cy, size: int) -> tuple:
    """(sum, sum of squares) of a square cell; what lies beyond the border repeats it."""
    values = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: grid.at_clamped(channel, w, h, cx * size + i % size, cy * size + idiv(i, size)))
    return grid.summed(values), grid.summed(F.transform(values, lambda v: v * v))


def mixed_luma(images: DataFrame, mix: float) -> DataFrame:
    """With ``v``: luma weighted with the sum of both chromas, truncated toward zero, from YUV planes, in single precision."""
    one = F.lit(1.0).cast("float") - F.lit(mix).cast("float")
    share = F.lit(mix).cast("float")
    of = lambda x, y: grid.value("yy", x, y) if mix == 0 else (grid.value("yy", x, y).cast("float") * one + (grid.value("uu", x, y) + grid.value("vv", x, y)).cast("float") * share).cast("long")
    return grid.held(images, v=grid.pixels(F.col("w"), F.col("h"), of))


def integral(images: DataFrame, channel: str, size: int = 1) -> DataFrame:
    """image_id, cw, ch, and i1 and i2: sums and sums of squares of all cells above and to the left, of (cw + 1) x (ch + 1) places."""

    def run(frames):
        for f in frames:
            out = []
            for i, w, h, values in zip(f["image_id"], f["w"], f["h"], f["v"]):
                cw, ch = -(-w // size), -(-h // size)
                px = np.pad(np.asarray(values, np.int64).reshape(h, w), ((0, ch * size - h), (0, cw * size - w)), "edge")
                sums = []
                for p in (px, px * px):
                    cells = p.reshape(ch, size, cw, size).sum((1, 3))
                    sums.append(np.pad(cells.cumsum(0).cumsum(1), ((1, 0), (1, 0))).ravel())
                out.append((i, cw, ch, *sums))
            yield pd.DataFrame(out, columns=["image_id", "cw", "ch", "i1", "i2"])

    return images.select("image_id", "w", "h", F.col(channel).alias("v")).mapInPandas(run, "image_id long, cw int, ch int, i1 array<long>, i2 array<long>")


def deviation(x0, y0, x1, y1, size: int = 1) -> Column:
    """Of the block of cells from (x0, y0) to before (x1, y1), from an integral image's four corners, in single precision; 0 at least."""
    stride = F.col("cw") + 1
    corner = lambda name: grid.at(F.col(name), stride, x1, y1) - grid.at(F.col(name), stride, x0, y1) - grid.at(F.col(name), stride, x1, y0) + grid.at(F.col(name), stride, x0, y0)
    norm = (F.lit(1.0).cast("float") / ((x1 - x0) * (y1 - y0) * (size * size)).cast("float")).cast("float")
    mean, square = (norm * corner("i1").cast("float")).cast("float"), (norm * corner("i2").cast("float")).cast("float")
    return F.sqrt(F.greatest((square - (mean * mean).cast("float")).cast("float"), F.lit(0.0).cast("float")).cast("double"))


def line_fit(luma: Column, chroma: Column, missing: int | None = None) -> Column:
    """(a, b) of chroma ~ a * luma + b, with 8 and 2 fractional bits; slope 0 and the mean where it is degenerate."""
    both = F.arrays_zip(luma.alias("l"), chroma.alias("c"))
    both = F.filter(both, lambda p: p["l"] != missing) if missing is not None else both
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("n", "l", "c", "lc", "ll")])
    add = lambda s, p: F.struct((s["n"] + 1).alias("n"), (s["l"] + p["l"]).alias("l"), (s["c"] + p["c"]).alias("c"), (s["lc"] + p["l"] * p["c"]).alias("lc"), (s["ll"] + p["l"] * p["l"]).alias("ll"))

    def fit(s):
        num, den = s["lc"] * s["n"] - s["l"] * s["c"], s["ll"] * s["n"] - s["l"] * s["l"]
        flat = (num == 0) | (den == 0)
        n, d = F.when(s["n"] > 0, s["n"]).otherwise(1), F.when(flat, F.lit(1)).otherwise(den)
        a = F.when(flat, 0).otherwise(clamp_signed(div_round(num * 256, d), 16))
        b = F.when(flat, div_round(s["c"] * 4, n)).otherwise(clamp_signed(div_round((den * s["c"] - num * s["l"]) * 4, n * d), 16))
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(both, zero, add, fit)


def predicted_chroma(luma: Column, a: Column, b: Column, low: int, high: int) -> Column:
    """Chroma from luma by a fitted line."""
    from glyphgrid.functions.fixed import clamp, right_shift_round

    return F.transform(luma, lambda v: clamp(right_shift_round(v * a + b * 64, 8), low, high))


def normal_equations(rows: DataFrame, context: list, target: str, *keys: str) -> DataFrame:
    """The sums of products of a least-squares problem with intercept: xx_i_j, xy_i and n of each key; the last term is 1."""
    terms = [F.col(c).cast("double") for c in context] + [F.lit(1.0)]
    sums = [F.sum(p * q).alias(f"xx_{i}_{j}") for i, p in enumerate(terms) for j, q in enumerate(terms) if i <= j]
    return rows.groupBy(*keys).agg(*sums, *[F.sum(p * F.col(target)).alias(f"xy_{i}") for i, p in enumerate(terms)], F.count("*").alias("n"))


def solved(sums: DataFrame, terms: int, *keys: str) -> DataFrame:
    """The coefficients of each key's normal equations; null where there are 2 * terms samples or fewer, or no one solution."""

    def run(frames):
        for f in frames:
            out = []
            for _, r in f.iterrows():
                size = terms + 1
                m = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
                ok = r["n"] > 2 * terms and abs(np.linalg.det(m)) > 1e-10
                out.append(np.linalg.solve(m, np.array([r[f"xy_{i}"] for i in range(size)])).tolist() if ok else None)
            yield pd.DataFrame({**{k: f[k] for k in keys}, "x": out})

    kinds = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, f"{kinds}, x array<double>")


def block_range(images: DataFrame, channel: str, size: int) -> DataFrame:
    """image_id, by, bx, lo, hi of each block, those cut by the border included."""
    rows = grid.exploded(images, channel)
    return rows.groupBy("image_id", idiv(F.col("y"), size).alias("by"), idiv(F.col("x"), size).alias("bx")).agg(F.min(channel).alias("lo"), F.max(channel).alias("hi"))


def average_colour(images: DataFrame, x: Column, y: Column, radius: Column) -> DataFrame:
    """Rounded means of the channels in the window around a place, clipped at the borders."""
    w, h = F.col("w"), F.col("h")
    rows = F.sequence(F.greatest(y - radius, F.lit(0)).cast("int"), F.least(y + radius, h - 1).cast("int"))
    columns = F.sequence(F.greatest(x - radius, F.lit(0)).cast("int"), F.least(x + radius, w - 1).cast("int"))
    inside = lambda c: F.flatten(F.transform(rows, lambda j: F.transform(columns, lambda i: grid.value(c, i, j))))
    return images.select("image_id", *[div_round(grid.summed(inside(c)), F.size(inside(c))).alias(c) for c in grid.CHANNELS])


def average_plane(channel: str) -> Column:
    return div_round(grid.summed(F.col(channel)), F.size(channel))


def edges(images: DataFrame, gw: Column, gh: Column) -> DataFrame:
    """The absolute Laplacian of grey levels, summed into a coarser grid of gw x gh cells, 32767 at most; the border has none."""
    w, h = F.col("w"), F.col("h")
    level = lambda x, y: F.floor(F.lit(0.2126) * grid.value("r", x, y) + F.lit(0.7152) * grid.value("g", x, y) + F.lit(0.0722) * grid.value("b", x, y) + 0.5)
    grey = grid.held(images, gw=gw.cast("int"), gh=gh.cast("int"), v=grid.pixels(w, h, level))
    v = lambda x, y: grid.value("v", x, y)
    inner = lambda x, y: F.when((x > 0) & (y > 0) & (x < w - 1) & (y < h - 1), F.abs(v(x + 1, y) + v(x - 1, y) + v(x, y + 1) + v(x, y - 1) - 4 * v(x, y))).otherwise(0)
    cells = grid.pixels(w, h, lambda x, y: F.struct(inner(x, y).alias("d"), (idiv(y * F.col("gh"), h) * F.col("gw") + idiv(x * F.col("gw"), w)).alias("k")))
    rows = grid.held(grey, cells=cells)
    total = grid.each(F.col("gw") * F.col("gh"), lambda k: F.least(F.lit(32767), F.aggregate(F.filter("cells", lambda c: c["k"] == k), F.lit(0).cast("long"), lambda s, c: s + c["d"])))
    return rows.select("image_id", F.col("gw").alias("w"), F.col("gh").alias("h"), total.alias("edge"))


def window_difference(pairs: DataFrame, gx, gy, gw: int, gh: int, radius: int) -> DataFrame:
    """The mean over a window around a grid point, borders repeated, of the sum of four absolute differences."""
    w, h = F.col("w"), F.col("h")
    cx, cy = div_round(gx * (w - 1), gw - 1), div_round(gy * (h - 1), gh - 1)
    steps = range(-radius, radius + 1)
    far = [F.abs(grid.at_clamped(F.col(c), w, h, cx + i, cy + j) - grid.at_clamped(F.col(f"{c}2"), w, h, cx + i, cy + j)) for c in grid.CHANNELS for j in steps for i in steps]
    return pairs.select("image_id", (sum(far, F.lit(0)) / F.lit(float(len(steps) ** 2))).alias("diff"))


def image_covariance(images: DataFrame, size: int = 8, least: int = 64 * 64) -> DataFrame:
    """Within-block covariance of the colours over whole images of more than least pixels; red's mean, truncated, beside 128 and 128."""
    rows = grid.exploded(images.filter(F.col("w") * F.col("h") > least), "r", "g", "b")
    blocks = rows.groupBy("image_id", idiv(F.col("y"), size).alias("by"), idiv(F.col("x"), size).alias("bx")).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in "rgb"], *[F.sum((F.col(p) * F.col(q)).cast("double")).alias(p + q) for p in "rgb" for q in "rgb"])
    centred = blocks.select("image_id", "n", "r", *[(F.col(p + q) - F.col(p) * F.col(q) / F.col("n")).alias(p + q) for p in "rgb" for q in "rgb"])
    return centred.groupBy("image_id").agg(*[(F.sum(p + q) / F.sum("n")).alias(p + q) for p in "rgb" for q in "rgb"], F.floor(F.sum("r") / F.sum("n")).alias("avg_r"))
