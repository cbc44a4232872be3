"""Colour-space matrices in fixed point, green and cross-colour transforms, and the covariance of colours."""

from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.functions.fixed import clamp, let, multiply3, right_shift_round, unmultiply
from glyphgrid.operators import grid

SHIFT, MOST = 12, (1 << 15) - 1
#: The matrices from YUV to RGB, rows first, times 2 ** 12.
TO_RGB = {
    "YCoCg": (1024, 1024, -1024, 1024, 0, 1024, 1024, -1024, -1024),
    "YCbCr": (1188, 0, 1638, 1188, -399, -829, 1188, 2058, 0),
    "YIQ": (2048, 1958, 1273, 2048, -558, -1325, 2048, -2260, 3483),
}
AVERAGE = (128, 128, 128)
YUV = ("yy", "uu", "vv")


def inverse3(m) -> tuple | None:
    """The inverse of a 3x3 matrix by cofactors; None where it is singular."""
    cofactor = lambda i, j: m[3 * ((i + 1) % 3) + (j + 1) % 3] * m[3 * ((i + 2) % 3) + (j + 2) % 3] - m[3 * ((i + 1) % 3) + (j + 2) % 3] * m[3 * ((i + 2) % 3) + (j + 1) % 3]
    det = sum(m[j] * cofactor(0, j) for j in range(3))
    if det == 0:
        return None
    return tuple(cofactor(i, j) / det for j in range(3) for i in range(3))


def to_yuv_matrix(to_rgb: tuple) -> tuple | None:
    """The rounded inverse in the same fixed point; None where an entry is out of range or there is none."""
    if any(abs(v) > MOST for v in to_rgb):
        return None
    found = inverse3([v / (1 << SHIFT) for v in to_rgb])
    scaled = found and [v * (1 << SHIFT) for v in found]
    if not scaled or any(abs(v) > MOST for v in scaled):
        return None
    return tuple(int(v + 0.5) if v >= 0 else -int(0.5 - v) for v in scaled)


def bounds(to_yuv: tuple, average: tuple = AVERAGE, top: int = 255) -> tuple:
    """(least, largest value, bits with sign) that any channel of YUV may take."""
    ends = []
    for pick in (min, max):
        sums = [sum(pick(to_yuv[3 * i + j] * -average[j], to_yuv[3 * i + j] * (top - average[j])) for j in range(3)) for i in range(3)]
        ends.append(pick((s + (1 << SHIFT - 1)) >> SHIFT for s in sums))
    size = max(abs(ends[0]), ends[1])
    return ends[0], ends[1], (size - 1).bit_length() + 1


def transform(kind: str = "YCbCr", custom: tuple | None = None) -> tuple:
    """(to RGB, to YUV) of a kind; a custom matrix that has no inverse in range falls back to YCoCg."""
    matrix = custom if custom and to_yuv_matrix(custom) else TO_RGB["YCoCg" if custom else kind]
    return matrix, to_yuv_matrix(matrix)


def rgb_to_yuv(r, g, b, kind: str = "YCbCr", average: tuple = AVERAGE) -> tuple:
    _, matrix = transform(kind)
    low, high, _ = bounds(matrix, average)
    sums = multiply3(r - average[0], g - average[1], b - average[2], matrix)
    return tuple(clamp(right_shift_round(s, SHIFT), low, high) for s in sums)


def yuv_to_rgb(y, u, v, kind: str = "YCbCr", average: tuple = AVERAGE, top=255) -> tuple:
    sums = multiply3(y, u, v, TO_RGB[kind])
    return tuple(clamp(right_shift_round(s, SHIFT) + average[i], 0, top) for i, s in enumerate(sums))


def _field(name: str) -> Column:
    return F.transform("_t", lambda t: t[name])


def _three(images: DataFrame, names: tuple, body, *keep: str) -> DataFrame:
    """Arrays of a triple of columns that body(x, y) gives."""
    triple = grid.pixels(F.col("w"), F.col("h"), lambda x, y: F.struct(*[v.cast("long").alias(n) for n, v in zip(names, body(x, y))]))
    return grid.held(images, _t=triple).select("image_id", "w", "h", *keep, *[_field(n).alias(n) for n in names])


def planes(images: DataFrame, kind: str = "YCbCr", pad: int = 1) -> DataFrame:
    """RGB images to YUV planes, the last column and row repeated up to multiples of pad."""
    from glyphgrid.operators.geometry import padded

    images = padded(images, pad) if pad > 1 else images
    return _three(images, YUV, lambda x, y: rgb_to_yuv(*[grid.value(c, x, y) for c in "rgb"], kind), "a")


def from_planes(images: DataFrame, kind: str = "YCbCr", alpha: str = "none") -> DataFrame:
    """YUV planes to RGB. alpha: none (opaque), premultiplied (colours at most alpha), straight (those, unmultiplied)."""

    def of(x, y):
        yuv = [grid.value(c, x, y) for c in YUV]
        if alpha == "none":
            return F.lit(255), *yuv_to_rgb(*yuv, kind)
        a = clamp(grid.value("a", x, y), 0, 255)
        rgb = [F.when(a > 0, v).otherwise(0) for v in yuv_to_rgb(*yuv, kind, top=a)]
        return a, *([unmultiply(v, a) for v in rgb] if alpha == "straight" else rgb)

    return _three(images, ("a", "r", "g", "b"), of)


def to_custom(images: DataFrame, matrix: tuple, offset: tuple) -> DataFrame:
    """YUV planes to those of a custom space: offset, matrix, rounding shift, no clamp."""
    return _three(images, YUV, lambda x, y: [right_shift_round(s, SHIFT) for s in multiply3(*[grid.value(c, x, y) + o for c, o in zip(YUV, offset)], matrix)])


def subtract_green(images: DataFrame, bits: int = 8, sign: int = -1) -> DataFrame:
    """Red and blue less green, modulo 2 ** bits; sign 1 undoes it."""
    mask = (1 << bits) - 1
    return grid.mapped(images, lambda c, x, y: (grid.value(c, x, y) + sign * grid.value("g", x, y)).bitwiseAND(F.lit(mask)) if c in "rb" else grid.value(c, x, y))


def _delta(factor, c: Column, bits: int = 8) -> Column:
    signed = F.when(c >= 1 << bits - 1, c - (1 << bits)).otherwise(c)
    return F.shiftright(factor * signed, 5)


def cross_colour(images: DataFrame, factors, bits: int = 8) -> DataFrame:
    """factors(x, y): green to red, green to blue, red to blue of the tile there. Modulo 2 ** bits."""
    mask = F.lit((1 << bits) - 1)

    def of(c, x, y):
        r, g, v = grid.value("r", x, y), grid.value("g", x, y), grid.value(c, x, y)
        g_r, g_b, r_b = factors(x, y)
        if c == "r":
            return (r - _delta(g_r, g, bits)).bitwiseAND(mask)
        return (v - _delta(g_b, g, bits) - _delta(r_b, r, bits)).bitwiseAND(mask) if c == "b" else v

    return grid.mapped(images, of)


def undo_cross_colour(images: DataFrame, factors, bits: int = 8) -> DataFrame:
    mask = F.lit((1 << bits) - 1)

    def of(c, x, y):
        g, v = grid.value("g", x, y), grid.value(c, x, y)
        g_r, g_b, r_b = factors(x, y)
        red = (grid.value("r", x, y) + _delta(g_r, g, bits)).bitwiseAND(mask)
        if c == "r":
            return red
        return let(red, lambda r: (v + _delta(g_b, g, bits) + _delta(r_b, r, bits)).bitwiseAND(mask)) if c == "b" else v

    return grid.mapped(images, of)


def round_trip_error(images: DataFrame, kind: str = "YCoCg") -> DataFrame:
    """The sum of absolute errors of a pixel after going to YUV and back."""
    back = from_planes(planes(images, kind), kind).select("image_id", *[F.col(c).alias(f"{c}2") for c in "rgb"])
    both = images.join(back, "image_id")
    error = grid.pixels(F.col("w"), F.col("h"), lambda x, y: sum((F.abs(grid.value(c, x, y) - grid.value(f"{c}2", x, y)) for c in "rgb"), F.lit(0)))
    return both.select("image_id", "w", "h", error.alias("error"))


def block_covariance(images: DataFrame, size: int = 4) -> DataFrame:
    """For each whole block: the means and the nine centred products of the colours, summed and divided by the block's pixels."""
    from glyphgrid.functions.fixed import idiv

    across, n = idiv(F.col("w"), size), float(size * size)
    blocks = images.withColumn("k", F.explode(grid.each(across * idiv(F.col("h"), size), lambda i: i))).withColumn("bx", (F.col("k") % across).cast("int")).withColumn("by", idiv(F.col("k"), across).cast("int"))
    inside = lambda c: F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: grid.value(c, F.col("bx") * size + i % size, F.col("by") * size + idiv(i, size)))
    blocks = grid.held(blocks, **{c: inside(c) for c in "rgb"}).select("image_id", "by", "bx", "r", "g", "b")
    mean = {c: grid.summed(F.col(c)) / F.lit(n) for c in "rgb"}
    products = {f"{p}{q}": grid.summed(F.zip_with(p, q, lambda x, y: x * y)) / F.lit(n) - mean[p] * mean[q] for p in "rgb" for q in "rgb"}
    return blocks.select("image_id", "by", "bx", *[mean[c].alias(f"mean_{c}") for c in "rgb"], *[v.alias(k) for k, v in products.items()])
