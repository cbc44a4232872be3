"""Fixed-point arithmetic on integer columns. Shifts of negative numbers are arithmetic, as Spark's are."""

from pyspark.sql import Column, functions as F


def col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def idiv(a, b) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", col(a).cast("long"), col(b).cast("long"))


def right_shift_round(value: Column, bits: int) -> Column:
    """Half up; a shift of no bits changes nothing."""
    return F.shiftright(value + (1 << bits >> 1), bits) if bits else value


def change_precision(value: Column, start: int, end: int) -> Column:
    return F.shiftleft(value, end - start) if start <= end else right_shift_round(value, start - end)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, col(low)), col(high))


def clamp_signed(value: Column, bits: int) -> Column:
    return clamp(value, -(1 << bits - 1), (1 << bits - 1) - 1)


def div_round(a, b) -> Column:
    """The quotient rounded half away from zero."""
    a, b = col(a).cast("long"), col(b).cast("long")
    half = idiv(F.abs(b), F.lit(2))
    return F.when((a < 0) == (b < 0), idiv(F.abs(a) + half, F.abs(b))).otherwise(-idiv(F.abs(a) + half, F.abs(b)))


def div_by_255(value: Column) -> Column:
    """v / 255, rounded, for products of two bytes."""
    return F.shiftright(value + F.shiftright(value, 8) + 128, 8)


def unmultiply(value: Column, alpha: Column) -> Column:
    """A premultiplied byte by the rounded reciprocal of its alpha, 255 at most; 0 where alpha is 0."""
    mult = idiv(F.lit(255 * 65536 - 1) + alpha, F.greatest(alpha, F.lit(1)))
    return F.when(alpha == 0, F.lit(0)).otherwise(F.least(F.lit(255), F.shiftright(value * mult + 32768, 16)))


def multiply3(v0, v1, v2, matrix: tuple) -> tuple:
    """The three sums of a 3x3 matrix, rows first, times a vector."""
    return tuple(v0 * matrix[k] + v1 * matrix[k + 1] + v2 * matrix[k + 2] for k in (0, 3, 6))


def quantise(value: Column, inverse: Column, bias: Column, bits: int = 16) -> Column:
    size = F.shiftright(F.abs(value) * inverse + bias, bits)
    return F.when(value < 0, -size).otherwise(size)


def prefix_code(distance: Column) -> tuple:
    """(code, extra bits, their value) of a distance from 1 up: twice the place of the highest bit, plus the bit after it."""
    less = (distance - 1).cast("long")
    high = F.floor(F.log2(F.greatest(less, F.lit(1)).cast("double"))).cast("int")
    small = less < 2
    extra = F.when(small, F.lit(0)).otherwise(high - 1)
    second = F.expr("0L") + F.call_function("shiftright", less, F.greatest(high - 1, F.lit(0))) % 2
    code = F.when(small, less).otherwise(2 * high + second)
    return code.cast("long"), extra.cast("long"), F.when(small, F.lit(0)).otherwise(less % F.call_function("shiftleft", F.lit(1).cast("long"), extra.cast("int"))).cast("long")


def partition_score(quality, ref_disto, ref_rate, disto, rate) -> Column:
    """Of distortion and rate against a reference's: 0 if either is worse, 1/3 where both are the same, towards 1 as they go to 0."""
    part = lambda v, ref: F.when(ref > 0, v / ref).when(v > 0, F.lit(None).cast("double")).otherwise(1.0)
    delta = clamp(col(quality) / 95.0, 0.01, 0.99)
    score = 1.0 / (1.0 + delta * part(disto, ref_disto) + (1.0 - delta) * part(rate, ref_rate))
    return F.when((disto > ref_disto) | (rate > ref_rate), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def status_text(code: Column) -> Column:
    """What a status code means."""
    #: Fixed values, in the order of the codes.
    texts = (
        "OK. no error.", "mismatch between user and system library version", "memory error allocating objects", "a parameter value is invalid",
        "a pointer parameter is NULL", "picture has invalid width/height", "abort request by user", "unsupported feature",
        "bitstream has syntactic error", "premature end-of-file during decoding", "error while reading bytes", "neural decode failure",
        "memory error while flushing bits", "encoding configuration is invalid", "error while flushing bytes", "file is bigger than 4G",
        "encoder called with improper colorspace", "neural encode failure", "last",
    )
    return F.coalesce(F.get(F.array(*[F.lit(t) for t in texts]), code), F.lit("undefined status"))
