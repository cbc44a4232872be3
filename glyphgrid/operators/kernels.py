"""Kernels on blocks held as arrays: predictions from a context, residuals, transforms and quantisation.

A context runs from the block's lower left corner up its left side (h values), over the upper left corner, along the
top (w values), then the upper right corner and down the right side (h values).
"""

from pyspark.sql import Column, functions as F

from glyphgrid.functions.fixed import clamp, div_round, idiv, let, quantise, right_shift_round
from glyphgrid.operators import grid

#: Smooth weights by block side.
SMOOTH = {
    4: (255, 149, 85, 64),
    8: (255, 197, 146, 105, 73, 50, 37, 32),
    16: (255, 225, 196, 170, 145, 123, 102, 84, 68, 54, 43, 33, 26, 20, 17, 16),
    32: (255, 240, 225, 210, 196, 182, 169, 157, 145, 133, 122, 111, 101, 92, 83, 74, 66, 59, 52, 45, 39, 34, 29, 25, 21, 17, 14, 12, 10, 9, 8, 8),
}
#: Cosines of the 4-point transform, times 2 ** 10 and half a root of two (forward) or one (inverse).
FORWARD_COS, INVERSE_COS, COS_BITS = (277, 669), (554, 1337), 10
#: Fixed value: coefficients of a 4x4 block in the order in which they are written.
ZIGZAG_4X4 = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)


def _block(w: int, h: int, body) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: body(i % w, idiv(i, w).cast("int")).cast("long"))


def _same(w: int, h: int, value: Column) -> Column:
    return F.array_repeat(value.cast("long"), w * h)


def predict_dc(context: Column, w: int, h: int, sides: str = "both") -> Column:
    """The rounded mean of the left side, the corner and the top; or of one side alone."""
    start, n = {"both": (1, h + 1 + w), "left": (1, h), "top": (h + 2, w)}[sides]
    return _same(w, h, div_round(grid.summed(F.slice(context, start, n)), n))


def predict_smooth(context: Column, w: int, h: int, kind: str = "both") -> Column:
    """Weighted between left and right, between top and the lower left corner, or both."""
    across, down = (F.array(*[F.lit(v) for v in SMOOTH[n]]) for n in (w, h))

    def of(x, y):
        left, right = F.get(context, h - 1 - y), F.get(context, h + 1 + w + 1 + y)
        above, below = F.get(context, h + 1 + x), F.get(context, F.lit(0))
        wx, wy = F.get(across, x), F.get(down, y)
        sides, ends = left * wx + right * (256 - wx), above * wy + below * (256 - wy)
        return {"both": right_shift_round(sides + ends, 9), "across": right_shift_round(sides, 8), "down": right_shift_round(ends, 8)}[kind]

    return _block(w, h, of)


def predict_gradient(context: Column, w: int, h: int, low: int, high: int) -> Column:
    """Top plus left less the corner, clamped."""
    return _block(w, h, lambda x, y: clamp(F.get(context, h + 1 + x) + F.get(context, h - 1 - y) - F.get(context, F.lit(h)), low, high))


def predict_paeth(context: Column, w: int, h: int) -> Column:
    """Of left, top and corner that which is nearest to top + left - corner, in this order among equals."""

    def of(x, y):
        left, top, corner = F.get(context, h - 1 - y), F.get(context, h + 1 + x), F.get(context, F.lit(h))
        to_left, to_top, to_corner = F.abs(top - corner), F.abs(left - corner), F.abs(top + left - 2 * corner)
        return F.when((to_left <= to_top) & (to_left <= to_corner), left).when(to_top <= to_corner, top).otherwise(corner)

    return _block(w, h, of)


def predict_zero(w: int, h: int) -> Column:
    return _same(w, h, F.lit(0))


def with_residual(prediction: Column, residual: Column, low: int, high: int) -> Column:
    return F.zip_with(prediction, residual, lambda p, r: clamp(p + r, low, high))


def residual(block: Column, prediction: Column) -> Column:
    return F.zip_with(block, prediction, lambda v, p: v - p)


def quantised(residuals: Column, inverse: Column, bias: Column, bits: int = 16) -> Column:
    both = F.arrays_zip(residuals.alias("v"), inverse.alias("q"), bias.alias("b"))
    return F.transform(both, lambda p: quantise(p["v"], p["q"], p["b"], bits))


def dequantised(coefficients: Column, steps: Column, size: int) -> Column:
    """The products, and zeros up to size."""
    found = F.zip_with(coefficients, steps, lambda c, s: c * s)
    return F.concat(found, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(found)))


def transposed(block: Column, w: int, h: int) -> Column:
    return _block(h, w, lambda x, y: F.get(block, x * w + y))


def identity(values: Column, factor: int = 1, inverse: bool = False) -> Column:
    """Times a factor, or divided by it toward zero."""
    return F.transform(values, lambda v: idiv(v, factor) if inverse else v * factor)


def hadamard_order(size: int) -> list:
    """Sequency order: where the Walsh function of each number of sign changes stands, by reversed bits of its Gray code."""
    bits = size.bit_length() - 1
    return [int(format(k ^ (k >> 1), f"0{bits}b")[::-1], 2) if bits else 0 for k in range(size)]


def hadamard(values: Column, size: int, divider: int = 1) -> Column:
    """The Walsh-Hadamard transform in sequency order, times half a root of two over the divider in single precision, truncated."""
    import struct

    norm = struct.unpack("f", struct.pack("f", 0.70710678118))[0] / divider
    norm = struct.unpack("f", struct.pack("f", norm))[0]
    sign = lambda k, i: 1 - 2 * (bin(k & i).count("1") % 2)
    out = []
    for k in hadamard_order(size):
        total = sum((F.get(values, F.lit(i)) * sign(k, i) for i in range(size)), F.lit(0))
        scaled = (total.cast("float") * F.lit(norm).cast("float")).cast("float")
        out.append(scaled.cast("long"))
    return F.array(*out)


def dct4(v: Column) -> Column:
    """The forward 4-point cosine transform in integers."""
    a, b, c, d = (F.get(v, F.lit(i)) for i in range(4))
    outer, inner, low, high = a + d, b + c, b - c, a - d
    p, q = FORWARD_COS
    return F.array(right_shift_round(outer + inner, 1), right_shift_round(low * p + high * q, COS_BITS), right_shift_round(outer - inner, 1), right_shift_round(high * p - low * q, COS_BITS))


def inverse_dct4(v: Column) -> Column:
    a, b, c, d = (F.get(v, F.lit(i)) for i in range(4))
    p, q = INVERSE_COS
    even, odd = a + c, a - c
    low, high = right_shift_round(b * p - d * q, COS_BITS), right_shift_round(b * q + d * p, COS_BITS)
    return F.array(*[F.shiftright(s, 1) for s in (even + high, odd + low, odd - low, even - high)])


def separable(block: Column, w: int, h: int, along) -> Column:
    """A 1-D transform on each row, then on each column."""
    rows = let(block, lambda b: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda j: let(F.slice(b, j * w + 1, F.lit(w)), along))))
    turned = let(rows, lambda r: transposed(r, w, h))
    done = let(turned, lambda t: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda i: let(F.slice(t, i * h + 1, F.lit(h)), along))))
    return let(done, lambda d: transposed(d, h, w))


def halved(coefficients: Column, w: int, h: int) -> Column:
    """The lower half of the frequencies in each direction, each halved; negative ones are first raised by 1."""
    return _block(w // 2, h // 2, lambda x, y: let(F.get(coefficients, y * w + x), lambda v: F.shiftright(v + F.when(v < 0, 1).otherwise(0), 1)))


def dct_coefficient(block: Column, u: Column, v: Column, size: int = 8) -> Column:
    """One coefficient of an 8x8 cosine transform, times 256, rounded."""
    import math

    norm = lambda k: math.sqrt((1 if k == 0 else 2) / size)
    table = [[norm(k) * math.cos(math.pi * (2 * i + 1) * k / (2 * size)) for i in range(size)] for k in range(size)]
    cosines = F.array(*[F.array(*[F.lit(c) for c in row]) for row in table])
    total = F.aggregate(F.transform(block, lambda b, i: b * F.get(F.get(cosines, u), i % size) * F.get(F.get(cosines, v), idiv(i, size).cast("int"))), F.lit(0.0), lambda s, t: s + t)
    return F.rint(total * 256.0).cast("long")


def bounding_box(coefficients: Column, w: int) -> Column:
    """(largest x, largest y) of the coefficients that aren't 0; 0 where all are."""
    places = F.filter(F.transform(coefficients, lambda c, i: F.when(c != 0, i)), lambda i: i.isNotNull())
    return F.struct(F.coalesce(F.array_max(F.transform(places, lambda i: i % w)), F.lit(0)).cast("long").alias("max_x"), F.coalesce(F.array_max(F.transform(places, lambda i: idiv(i, w))), F.lit(0)).cast("long").alias("max_y"))


def zigzag(block: Column, order: tuple = ZIGZAG_4X4) -> Column:
    return F.array(*[F.get(block, F.lit(i)) for i in order])


def golomb(value: Column, leading: int = 1) -> tuple:
    """(prefix, extra bits, their value): the prefix names the place of the highest bit, and with leading 2 also the bit after it."""
    shift = lambda n, bits: F.call_function("shiftright", n, bits)
    high = F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))).cast("int")
    small = value < (1 if leading == 1 else 4)
    extra = F.when(small, F.lit(0)).otherwise(high - (leading - 1))
    prefix = high + 1 if leading == 1 else 2 * high + shift(value, F.greatest(high - 1, F.lit(0))) % 2
    return F.when(small, value).otherwise(prefix).cast("long"), extra.cast("long"), (value % F.call_function("shiftleft", F.lit(1).cast("long"), extra)).cast("long")


def ungolomb(prefix: Column, rest: Column, leading: int = 1) -> Column:
    one = F.lit(1).cast("long")
    if leading == 1:
        return F.when(prefix < 2, prefix).otherwise(F.call_function("shiftleft", one, (F.greatest(prefix, one) - 1).cast("int")) + rest)
    return F.when(prefix < 4, prefix).otherwise(F.call_function("shiftleft", (2 + prefix % 2).cast("long"), F.greatest(F.shiftright(prefix - 2, 1), F.lit(0)).cast("int")) + rest)
