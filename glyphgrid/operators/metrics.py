"""Distortion of an image against its partner: squared errors, PSNR, SSIM, and local minima."""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.operators import grid, stencils
from glyphgrid.operators.composite import over_colour

NONE_DB, LEAST_DB = 99.0, 98.9
#: Fixed value: used in place of 10 / ln 10.
TEN_OVER_LN_TEN = 4.3429448
#: The tent of the SSIM window, by distance from its centre.
TENT = (4, 3, 2, 1)
WHITE = dict.fromkeys(grid.CHANNELS, 255)


def psnr(sse: Column, size: Column, most: float = 255.0) -> Column:
    """Equal is 99, anything else 98.9 at most."""
    share = sse.cast("double") / (size.cast("double") * (most * most))
    return F.when(sse == 0, F.lit(NONE_DB)).when(share <= 0, F.lit(LEAST_DB)).otherwise(F.least(F.lit(-TEN_OVER_LN_TEN) * F.ln(share), F.lit(LEAST_DB)))


def log_ssim(total: Column, size: Column) -> Column:
    rest = F.lit(1.0) - total / size.cast("double")
    return F.when(total >= size, F.lit(NONE_DB)).when(rest <= 0, F.lit(LEAST_DB)).otherwise(F.least(F.lit(-10.0) * F.log10(rest), F.lit(LEAST_DB)))


def sse(c: str) -> Column:
    """Of a whole channel against the partner's."""
    return grid.summed(F.zip_with(c, f"{c}2", lambda p, q: (p - q) * (p - q)))


def transparent(c: str = "a") -> Column:
    return F.exists(c, lambda v: v != 255)


def distortion(pairs: DataFrame, metric: str = "psnr", alpha_counts: bool = True) -> DataFrame:
    """image_id, a_db, r_db, g_db, b_db and all_db. Alpha counts in all if the image has transparency and it is asked for."""
    size = F.col("w") * F.col("h")
    counts = transparent() if alpha_counts else F.lit(False)
    if metric == "psnr":
        each, of = sse, psnr
        # Sums of channels pass through single precision on the way to the overall value.
        exact = lambda c: F.col(f"t_{c}").cast("float").cast("double")
    else:
        each = None
        of = log_ssim if metric == "ssim" else psnr
        exact = lambda c: F.col(f"t_{c}")
    known = pairs.select("*", size.alias("n"), counts.alias("counts"))
    totals = known.select("image_id", "n", "counts", *[each(c).alias(f"t_{c}") for c in grid.CHANNELS]) if each else sums(known, metric, keep=("image_id", "n", "counts"))
    whole = exact("r") + exact("g") + exact("b") + F.when(F.col("counts"), exact("a")).otherwise(0.0)
    return totals.select("image_id", *[of(F.col(f"t_{c}"), F.col("n")).alias(f"{c}_db") for c in grid.CHANNELS], of(whole, F.col("n") * F.when(F.col("counts"), 4).otherwise(3)).alias("all_db"))


def distortion_on_black_or_white(pairs: DataFrame, metric: str = "psnr") -> DataFrame:
    """The worse of both backgrounds by the overall value; alpha's own value is that on black. The partner's transparency asks for white."""
    black = distortion(pairs, metric, False)
    names = [f"{c}_db" for c in ("r", "g", "b", "all")]
    own = over_colour(pairs.select("image_id", "w", "h", *grid.CHANNELS), WHITE)
    other = over_colour(pairs.select("image_id", "w", "h", *[F.col(f"{c}2").alias(c) for c in grid.CHANNELS]), WHITE)
    white = distortion(grid.paired(own, other), metric, False).select("image_id", *[F.col(n).alias(f"{n}_w") for n in names])
    asked = pairs.select("image_id", transparent("a2").alias("asked"))
    both = black.join(white, "image_id").join(asked, "image_id")
    worse = F.col("asked") & (F.col("all_db_w") < F.col("all_db"))
    return both.select("image_id", "a_db", *[F.when(worse, F.col(f"{n}_w")).otherwise(F.col(n)).alias(n) for n in names])


MOMENTS = ("weights", "xm", "ym", "xxm", "xym", "yym")


def moments_of(p: np.ndarray, q: np.ndarray) -> dict:
    """Sums over the window around each pixel under its tent, clipped at the borders: of the weights, both values, their squares and product."""
    return {n: stencils.windowed(v, TENT) for n, v in zip(MOMENTS, (np.ones_like(p), p, q, p * p, p * q, q * q))}


def index_of(m: dict, bits: int = 8, luminance: bool = True) -> np.ndarray:
    """SSIM from moments in integers: 1 where it is dark, covariance 0 at least, both terms shifted by 8 bits."""
    n = m["weights"]
    scale = n * n * (1 << 2 * (bits - 8))
    xx, yy, xy = m["xm"] * m["xm"], m["ym"] * m["ym"], m["xm"] * m["ym"]
    top = (2 * np.maximum(m["xym"] * n - xy, 0) + 60 * scale >> 8).astype(np.float64)
    low = ((m["xxm"] * n - xx) + (m["yym"] * n - yy) + 60 * scale >> 8).astype(np.float64)
    ratio = top / low
    if luminance:
        ratio = np.maximum((2 * xy + 20 * scale) * top, 0) / ((xx + yy + 20 * scale) * low)
    return np.where(xx + yy >= 64 * scale, ratio, 1.0)


def least_error(p: np.ndarray, q: np.ndarray, radius: int = 2) -> np.ndarray:
    """The least squared difference of the partner's pixel to a pixel of the image within the radius."""
    h, w = p.shape[-2:]
    wide, least = stencils.widened(p, radius), None
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            far = np.square(wide[..., dy : dy + h, dx : dx + w] - q)
            least = far if least is None else np.minimum(least, far, out=least)
    return least


def _of(kind: str, luminance: bool = True):
    return (lambda p, q: index_of(moments_of(p, q), luminance=luminance)) if kind == "ssim" else least_error


def _both(channels) -> tuple:
    return (*channels, *[f"{c}2" for c in channels])


def ssim_moments(pairs: DataFrame, c: str) -> DataFrame:
    """image_id, w, h and the six sums, each an array."""
    return stencils.on_rasters(pairs, _both([c]), dict.fromkeys(MOMENTS, "array<long>"), lambda p: moments_of(p[c], p[f"{c}2"]))


def maps(pairs: DataFrame, kind: str, channels: tuple = grid.CHANNELS, luminance: bool = True, keep: tuple = ("image_id", "w", "h")) -> DataFrame:
    """The kept columns and for each channel the index (ssim) or the least squared difference (lsim) of each pixel."""
    f = _of(kind, luminance)
    return stencils.on_rasters(pairs, _both(channels), dict.fromkeys(channels, "array<double>" if kind == "ssim" else "array<long>"), lambda p: {c: f(p[c], p[f"{c}2"]) for c in channels}, keep)


def sums(pairs: DataFrame, kind: str, channels: tuple = grid.CHANNELS, keep: tuple = ("image_id", "w", "h")) -> DataFrame:
    """The kept columns and for each channel c the sum t_c of its map."""
    f = _of(kind)
    return stencils.on_rasters(pairs, _both(channels), {f"t_{c}": "double" if kind == "ssim" else "long" for c in channels}, lambda p: {f"t_{c}": f(p[c], p[f"{c}2"]).sum() for c in channels}, keep)


def tile_sums(tiles: DataFrame, kind: str, channels: tuple = grid.CHANNELS, size: int = stencils.TILE) -> DataFrame:
    """image_id, n and t_c of images in tiles, planes and partners' planes side by side: sums of the tiles, then of the image."""
    f = _of(kind)
    parts = stencils.on_tiles(tiles, _both(channels), {f"t_{c}": "double" if kind == "ssim" else "long" for c in channels}, lambda p, _: {f"t_{c}": f(p[c], p[f"{c}2"]) for c in channels}, 3, size)
    return parts.groupBy("image_id").agg(F.sum(F.col("w") * F.col("h")).alias("n"), *[F.sum(f"t_{c}").alias(f"t_{c}") for c in channels])


#: How visible the coefficients of a cosine transform are, rows first, in brightness and in one colour plane.
VISIBLE = {
    "y": (
        0.707107, 1.000000, 0.910460, 0.647842, 0.437644, 0.296179, 0.203577, 0.142570, 1.000000, 0.848508, 0.894231, 0.736766, 0.537328, 0.379415, 0.267584, 0.190557,
        0.910460, 0.894231, 0.586549, 0.476847, 0.382396, 0.292942, 0.219082, 0.162654, 0.647842, 0.736766, 0.476847, 0.337452, 0.264452, 0.210943, 0.166115, 0.129150,
        0.437644, 0.537328, 0.382396, 0.264452, 0.196055, 0.154089, 0.123575, 0.099098, 0.296179, 0.379415, 0.292942, 0.210943, 0.154089, 0.118036, 0.093888, 0.076012,
        0.203577, 0.267584, 0.219082, 0.166115, 0.123575, 0.093888, 0.073737, 0.059452, 0.142570, 0.190557, 0.162654, 0.129150, 0.099098, 0.076012, 0.059452, 0.047632,
    ),
    "u": (
        0.776648, 1.000000, 0.480685, 0.467268, 0.426770, 0.364938, 0.303670, 0.249968, 1.000000, 0.644234, 0.493198, 0.561579, 0.540895, 0.477208, 0.404920, 0.337658,
        0.480685, 0.493198, 0.397731, 0.417047, 0.419163, 0.390151, 0.345352, 0.297155, 0.467268, 0.561579, 0.417047, 0.350023, 0.325845, 0.305370, 0.278533, 0.247362,
        0.426770, 0.540895, 0.419163, 0.325845, 0.274940, 0.246065, 0.223518, 0.201486, 0.364938, 0.477208, 0.390151, 0.305370, 0.246065, 0.209154, 0.184641, 0.165418,
        0.303670, 0.404920, 0.345352, 0.278533, 0.223518, 0.184641, 0.158178, 0.139126, 0.249968, 0.337658, 0.297155, 0.247362, 0.201486, 0.165418, 0.139126, 0.120098,
    ),
}
HVS_STEP = 7


def hvs_windows(v: np.ndarray) -> tuple:
    """(coefficients times 256, contrast mask) of each 8x8 window, one every HVS_STEP pixels; those that don't fit are left out."""
    if min(v.shape) < 8:
        return np.empty((0, 8, 8)), np.empty(0)
    blocks = np.lib.stride_tricks.sliding_window_view(v, (8, 8))[::HVS_STEP, ::HVS_STEP].reshape(-1, 8, 8).astype(np.float64)
    whole = blocks.var((1, 2)) * 64
    parts = blocks.reshape(-1, 2, 4, 2, 4).swapaxes(2, 3).reshape(-1, 4, 16).var(-1).sum(-1) * 16
    cosines = np.cos(np.pi * np.outer(np.arange(8), 2 * np.arange(8) + 1) / 16)
    found = np.rint(256 * np.einsum("vj,nji,ui->nvu", cosines, blocks, cosines))
    with np.errstate(divide="ignore", invalid="ignore"):
        return found, np.where(whole > 0, parts * 0.25 / whole, 0.0)


def hvs(p: np.ndarray, q: np.ndarray, visible: str = "y") -> float:
    """The mean squared difference of coefficients as it is seen: by their visibility, less what the window's own contrast masks.

    Energies are summed in whole numbers. Planes without a window differ by 0.
    """
    weight = np.array(VISIBLE[visible]).reshape(8, 8)
    (a, ra), (b, rb) = hvs_windows(p), hvs_windows(q)
    if not len(a):
        return 0.0
    inner = np.ones((8, 8))
    inner[0, 0] = 0
    masks = [np.sqrt(np.floor(c * c * weight * inner).sum((1, 2)) * r) / 8192 for c, r in ((a, ra), (b, rb))]
    far = np.abs(a - b)
    seen = np.maximum(far * weight - np.maximum(*masks)[:, None, None], 0)
    seen[:, 0, 0] = far[:, 0, 0]
    return float((seen * seen).mean())


def hvs_distortion(pairs: DataFrame, planes: dict, keep: tuple = ("image_id", "w", "h")) -> DataFrame:
    """The kept columns, and for each plane its difference as it is seen, and that in dB. planes: names to the table of visibility."""
    rows = stencils.on_rasters(pairs, _both(planes), {f"t_{c}": "double" for c in planes}, lambda p: {f"t_{c}": hvs(p[c], p[f"{c}2"], table) for c, table in planes.items()}, keep)
    return rows.select("*", *[psnr(F.col(f"t_{c}"), F.col("w") * F.col("h")).alias(f"{c}_db") for c in planes])


def at_pixel(pairs: DataFrame, x: Column, y: Column) -> DataFrame:
    """image_id, psnr, ssim and lsim of one pixel over its four channels, from the window around it.

    By local minima the last channel alone counts, as a quirk that is kept.
    """
    left, top = F.greatest(x - 3, F.lit(0)), F.greatest(y - 3, F.lit(0))
    around = _around(pairs, x, y, left, top)

    def body(p):
        at = int(p["py"][0, 0]), int(p["px"][0, 0])
        far = [int(p[c][at] - p[f"{c}2"][at]) for c in grid.CHANNELS]
        return {"sse": sum(v * v for v in far), "ssim": sum(index_of(moments_of(p[c], p[f"{c}2"]))[at] for c in grid.CHANNELS), "least": least_error(p["b"], p["b2"])[at]}

    got = stencils.on_rasters(around, (*_both(grid.CHANNELS), "px", "py"), {"sse": "long", "ssim": "double", "least": "long"}, body, ("image_id",))
    four = F.lit(4)
    return got.select("image_id", psnr(F.col("sse"), four).alias("psnr"), log_ssim(F.col("ssim"), four).alias("ssim"), psnr(F.col("least"), four).alias("lsim"))


def _around(pairs: DataFrame, x: Column, y: Column, left: Column, top: Column) -> DataFrame:
    """Both images' windows of three pixels around a place, and planes px and py that hold the place in the window."""
    w, h = (F.least(x + 4, F.col("w")) - left).cast("int"), (F.least(y + 4, F.col("h")) - top).cast("int")
    planes = [stencils.part(c, "w", top, left, h, w).alias(c) for c in _both(grid.CHANNELS)]
    return pairs.select("image_id", *planes, F.array_repeat((x - left).cast("long"), w * h).alias("px"), F.array_repeat((y - top).cast("long"), w * h).alias("py"), w.alias("w"), h.alias("h"))


def block_sse(pairs: DataFrame, size: int, channels: tuple = grid.CHANNELS) -> DataFrame:
    """image_id, by, bx, sse over the channels, of each block, those cut by the border included."""
    from glyphgrid.functions.fixed import idiv

    rows = grid.exploded(pairs, *channels, *[f"{c}2" for c in channels])
    far = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in channels), F.lit(0))
    return rows.groupBy("image_id", idiv(F.col("y"), size).alias("by"), idiv(F.col("x"), size).alias("bx")).agg(F.sum(far).alias("sse"))


def plane_report(pairs: DataFrame, channels: tuple) -> DataFrame:
    """PSNR and SSIM sums of planes, each on its own."""
    size = F.col("w") * F.col("h")
    known = pairs.select("*", *[sse(c).alias(f"sse_{c}") for c in channels])
    both = sums(known, "ssim", channels, ("image_id", "w", "h", *[f"sse_{c}" for c in channels]))
    return both.select("image_id", *[psnr(F.col(f"sse_{c}"), size).alias(f"{c}_db") for c in channels], *[log_ssim(F.col(f"t_{c}"), size).alias(f"{c}_ssim") for c in channels])


def report(pairs: DataFrame, metric: str = "psnr", sizes: Column | None = None, gray: bool = False, halved: bool = False, window: tuple | None = None) -> DataFrame:
    """One row an image: size in bytes, overall and channel distortion, bits for each pixel; cropped, halved or made grey before.

    window: x, y, w and h, numbers or columns of the image's own width and height.
    """
    from glyphgrid.operators import geometry

    def ready(images):
        if window is not None:
            images = geometry.crop(images, *[v if isinstance(v, Column) else F.lit(v) for v in window])
        if halved:
            images = geometry.half(images)
        return geometry.luma(images) if gray else images

    first = ready(pairs.select("image_id", "w", "h", *grid.CHANNELS))
    second = ready(pairs.select("image_id", "w", "h", *[F.col(f"{c}2").alias(c) for c in grid.CHANNELS]))
    both = grid.paired(first, second)
    out = distortion(both, metric)
    if sizes is None:
        return out
    bits = both.select("image_id", sizes.alias("size"), (F.lit(8.0) * sizes / (F.col("w") * F.col("h"))).alias("bpp"))
    return out.join(bits, "image_id")
