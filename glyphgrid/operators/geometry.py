"""Rectangles, orientations, windows, resampling, and layouts of samples."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.functions.fixed import clamp, div_by_255, idiv, right_shift_round, unmultiply
from glyphgrid.operators import grid, stencils

#: Where alpha, red, green and blue stand in a pixel of each layout (-1: no alpha), and
#: whether colours are premultiplied. A layout with an X has an alpha byte that isn't read.
LAYOUTS = {
    "Argb": (0, 1, 2, 3, True), "ARGB": (0, 1, 2, 3, False), "XRGB": (-1, 1, 2, 3, True),
    "rgbA": (3, 0, 1, 2, True), "RGBA": (3, 0, 1, 2, False), "RGBX": (-1, 0, 1, 2, True),
    "bgrA": (3, 2, 1, 0, True), "BGRA": (3, 2, 1, 0, False), "BGRX": (-1, 2, 1, 0, True),
    "RGB": (-1, 0, 1, 2, False), "BGR": (-1, 2, 1, 0, False),
}
#: Taps by offset from the centre.
DOWN_SHARP = {-1: -2, 0: 10, 1: 10, 2: -2}
UP_FULL, UP_HALF = {-2: 1, -1: 3, 0: 11, 1: 1}, {-1: 1, 0: 11, 1: 3, 2: 1}
#: File formats by extension.
EXTENSIONS = {"png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "tif": "TIFF", "tiff": "TIFF", "gif": "GIF", "webp": "WEBP", "bmp": "BMP", "pgm": "PGM", "ppm": "PPM", "pam": "PAM", "y4m": "Y4M_420"}


def area(w, h) -> Column:
    return w.cast("long") * h


def holds_point(x, y, w, h, px, py) -> Column:
    return (px >= x) & (px < x + w) & (py >= y) & (py < y + h)


def holds(x, y, w, h, x2, y2, w2, h2) -> Column:
    """Whether the first rectangle holds the second; one without area counts as its corner."""
    corner = holds_point(x, y, w, h, x2, y2)
    return F.when(w2 * h2 == 0, corner).otherwise(corner & holds_point(x, y, w, h, x2 + w2 - 1, y2 + h2 - 1))


def meets(x, y, w, h, x2, y2, w2, h2) -> Column:
    """Two-sided: a rectangle without area meets one that starts where it does."""
    side = lambda a, n, b, m: ((a >= b) & (a < b + m)) | ((b >= a) & (b < a + n))
    return side(x, w, x2, w2) & side(y, h, y2, h2)


def clipped(x, y, w, h, x2, y2, w2, h2) -> tuple:
    left, top = F.greatest(x, x2), F.greatest(y, y2)
    return left, top, F.greatest(F.lit(0), F.least(x + w, x2 + w2) - left), F.greatest(F.lit(0), F.least(y + h, y2 + h2) - top)


def merged(x, y, w, h, x2, y2, w2, h2) -> tuple:
    left, top = F.least(x, x2), F.least(y, y2)
    return left, top, F.greatest(x + w, x2 + w2) - left, F.greatest(y + h, y2 + h2) - top


def rotated_size(o, w, h) -> tuple:
    """o: quarter turns clockwise."""
    turned = o % 2 == 1
    return F.when(turned, h).otherwise(w), F.when(turned, w).otherwise(h)


def rotated_point(o, w, h, x, y) -> tuple:
    return F.when(o == 1, h - y - 1).when(o == 2, w - x - 1).when(o == 3, y).otherwise(x), F.when(o == 1, x).when(o == 2, h - y - 1).when(o == 3, w - x - 1).otherwise(y)


def rotated_rect(o, w, h, x, y, rw, rh) -> tuple:
    """The corner turns, and then the left or upper edge is where the far one came to lie."""
    px, py = rotated_point(o, w, h, x, y)
    nw, nh = rotated_size(o, rw, rh)
    back = lambda n: F.greatest(n - 1, F.lit(0))
    return px - F.when(o.isin(1, 2), back(nw)).otherwise(0), py - F.when(o.isin(2, 3), back(nh)).otherwise(0), nw, nh


def rotate(images: DataFrame, o: Column) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    nw, nh = rotated_size(o, w, h)
    # The pixel that comes to lie at (x, y) is found by the opposite turn.
    back = (4 - o) % 4
    return grid.regridded(images, nw, nh, lambda c, x, y: grid.value(c, *rotated_point(back, nw, nh, x, y)))


def crop(images: DataFrame, x, y, w, h) -> DataFrame:
    """A window, which must lie inside."""
    return grid.regridded(images, w, h, lambda c, i, j: grid.value(c, x + i, y + j))


def rotate_window(images: DataFrame, o: Column, x, y, w, h) -> DataFrame:
    return rotate(crop(images, x, y, w, h), o)


def fill(images: DataFrame, x, y, w, h, colour: dict) -> DataFrame:
    return grid.mapped(images, lambda c, i, j: F.when(holds_point(x, y, w, h, i, j), F.lit(colour[c])).otherwise(grid.value(c, i, j)))


def border(images: DataFrame, x, y, w, h, colour: dict) -> DataFrame:
    """The outermost pixels of a window."""

    def of(c, i, j):
        edge = (i == x) | (i == x + w - 1) | (j == y) | (j == y + h - 1)
        return F.when(holds_point(x, y, w, h, i, j) & edge, F.lit(colour[c])).otherwise(grid.value(c, i, j))

    return grid.mapped(images, of)


def fill_outside(images: DataFrame, x, y, w, h, colour: dict) -> DataFrame:
    """The background colour on the canvas around a frame's window."""
    return grid.mapped(images, lambda c, i, j: F.when(holds_point(x, y, w, h, i, j), grid.value(c, i, j)).otherwise(F.lit(colour[c])))


def rescale(images: DataFrame, w: Column, h: Column) -> DataFrame:
    """Point sampling."""
    return grid.regridded(images, w, h, lambda c, x, y: grid.value(c, idiv(x * F.col("w"), w), idiv(y * F.col("h"), h)))


def half(images: DataFrame) -> DataFrame:
    """Box averages. An odd last row stands for the one that is missing; of an odd last column the upper pixel is copied."""
    w, h = F.col("w"), F.col("h")

    def of(c, x, y):
        top, low = 2 * y, F.least(2 * y + 1, h - 1)
        four = grid.value(c, 2 * x, top) + grid.value(c, 2 * x + 1, top) + grid.value(c, 2 * x, low) + grid.value(c, 2 * x + 1, low)
        return F.when(2 * x + 1 < w, F.shiftright(four + 2, 2)).otherwise(grid.value(c, 2 * x, top))

    return grid.regridded(images, idiv(w + 1, 2), idiv(h + 1, 2), of)


def sample(channel: Column, w, h, x, y, across: dict, down: dict) -> Column:
    """The sum of taps around a place, borders repeated, shifted by 8 bits with rounding."""
    rows = [sum((grid.at_clamped(channel, w, h, x + i, y + j) * t for i, t in across.items()), F.lit(0)) * s for j, s in down.items()]
    return right_shift_round(sum(rows, F.lit(0)), 8)


def _taken(v: np.ndarray, places: np.ndarray, taps: tuple) -> np.ndarray:
    """Sums of taps around places of the last axis, borders repeated; the places take turns with the taps. NaN stays NaN."""
    of, total = np.arange(len(places)) % len(taps), 0
    for pairs in zip(*[t.items() for t in taps]):
        by, weights = (np.array(k)[of] for k in zip(*pairs))
        total = total + v[..., np.clip(places + by, 0, max(0, v.shape[-1] - 1))] * weights
    return total


def _resampled(images: DataFrame, w2: Column, h2: Column, step: Callable, taps: tuple, channels: tuple) -> DataFrame:
    """Taps in both directions on stacks of planes, shifted by 8 bits with rounding; step: from places to those in the image."""

    def body(p, w2, h2):
        x, y = step(np.arange(w2)), step(np.arange(h2))
        return {c: (_taken(_taken(v, x, taps).swapaxes(-1, -2), y, taps).swapaxes(-1, -2) + 128) // 256 for c, v in p.items()}

    rows = images.select("image_id", "w", "h", w2.cast("int").alias("w2"), h2.cast("int").alias("h2"), *channels)
    made = stencils.on_stacks(rows, channels, dict.fromkeys(channels, "array<long>"), body, ("image_id", "w2", "h2"), ("w2", "h2"))
    return made.select("image_id", F.col("w2").alias("w"), F.col("h2").alias("h"), *channels)


def plane_half(images: DataFrame, channels: tuple = ("r",), taps: dict = DOWN_SHARP) -> DataFrame:
    return _resampled(images, idiv(F.col("w") + 1, 2), idiv(F.col("h") + 1, 2), lambda at: 2 * at, (taps,), channels)


def plane_double(images: DataFrame, w2: Column, h2: Column, channels: tuple = ("r",)) -> DataFrame:
    """Even places lean back with the first taps, odd ones forward with the second, in each direction."""
    return _resampled(images, w2, h2, lambda at: at // 2, (UP_FULL, UP_HALF), channels)


def padded(images: DataFrame, multiple: int, channels: tuple = grid.CHANNELS) -> DataFrame:
    """The last column and row repeated until both sides are multiples."""
    w, h = F.col("w"), F.col("h")
    up = lambda n: idiv(n + multiple - 1, multiple) * multiple
    return grid.regridded(images, up(w), up(h), lambda c, x, y: grid.at_clamped(F.col(c), w, h, x, y), channels)


def imported(images: DataFrame, layout: Column) -> DataFrame:
    """Images of samples s0 to s3 as they lie in memory, of the layout that is named, to premultiplied channels."""
    whole = {}
    for k, c in enumerate(grid.CHANNELS):
        def of(x, y, k=k):
            out = None
            for name, (*places, premultiplied) in LAYOUTS.items():
                alpha = grid.value(f"s{places[0]}", x, y) if places[0] >= 0 else F.lit(255)
                v = alpha if k == 0 else grid.value(f"s{places[k]}", x, y)
                if k and not premultiplied and places[0] >= 0:
                    v = F.when(alpha < 255, div_by_255(v * alpha)).otherwise(v)
                out = F.when(layout == name, v) if out is None else out.when(layout == name, v)
            return out.cast("long")
        whole[c] = grid.pixels(F.col("w"), F.col("h"), of)
    return grid.held(images, **whole).select("image_id", "w", "h", *grid.CHANNELS)


def row_of(images: DataFrame, y: Column) -> DataFrame:
    """One row of each image, as an image of height 1."""
    return crop(images, F.lit(0), y, F.col("w"), F.lit(1))


def converted(images: DataFrame, layout: Column) -> DataFrame:
    """Premultiplied channels to samples s0 to s3 as they lie in memory; a layout of three has no s3."""
    a = F.col("a")
    out = []
    for place in range(4):
        def of(x, y, place=place):
            got = F.when(F.lit(False), F.lit(0))
            for name, (*places, premultiplied) in LAYOUTS.items():
                if place not in places:
                    v = F.lit(255) if name.endswith("X") and place == 3 or name == "XRGB" and place == 0 else F.lit(None)
                elif place == places[0]:
                    v = grid.value("a", x, y)
                else:
                    c = grid.CHANNELS[places.index(place)]
                    v = grid.value(c, x, y)
                    if not premultiplied:
                        v = unmultiply(v, grid.at(a, F.col("w"), x, y))
                got = got.when(layout == name, v)
            return got.cast("long")
        out.append(grid.pixels(F.col("w"), F.col("h"), of))
    return grid.held(images, **{f"s{k}": v for k, v in enumerate(out)}).select("image_id", "w", "h", "s0", "s1", "s2", "s3")


def luma(images: DataFrame) -> DataFrame:
    """BT.709 in double precision, half up, in all three colours; alpha stays."""
    def of(c, x, y):
        if c == "a":
            return grid.value(c, x, y)
        r, g, b = (grid.value(k, x, y) for k in "rgb")
        return F.floor(F.lit(0.2126) * r + F.lit(0.7152) * g + F.lit(0.0722) * b + 0.5)
    return grid.mapped(images, of)


def difference(pairs: DataFrame, scaled: bool = False) -> DataFrame:
    """Absolute differences of paired images; scaled: each channel's largest becomes 255."""
    out = grid.mapped(pairs, lambda c, x, y: F.abs(grid.value(c, x, y) - grid.value(f"{c}2", x, y)))
    if not scaled:
        return out
    most = out.select("*", *[F.array_max(c).alias(f"max_{c}") for c in grid.CHANNELS])
    factor = lambda c: F.when(F.col(f"max_{c}") > 0, idiv(F.lit(255 << 16), F.greatest(F.col(f"max_{c}"), F.lit(1)))).otherwise(F.lit(0))
    return grid.mapped(most, lambda c, x, y: F.shiftright(grid.value(c, x, y) * factor(c) + 32768, 16))


def format_of(path: Column) -> Column:
    """The file format that a path's extension names, whatever its case; UNSUPPORTED if none does."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ending), F.lit("UNSUPPORTED"))


def to_ten_bits(c: Column) -> Column:
    """Eight bits to ten, the leading bits repeated below."""
    return F.shiftleft(c, 2).bitwiseOR(F.shiftright(c, 6))


def to_four_bits(c: Column, a: Column) -> Column:
    """A premultiplied byte to four bits without alpha; 15 where alpha is 0."""
    return F.when(a == 0, F.lit(15)).otherwise(F.shiftright(clamp(idiv(c * 255, F.greatest(a, F.lit(1))), 0, 255), 4))


def from_four_bits(c: Column) -> Column:
    return F.shiftleft(c, 4).bitwiseOR(c)
