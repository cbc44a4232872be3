"""Histograms as arrays of counts: costs in bits, distances, normalisation, quantisation and clustering."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.functions.fixed import div_round, let
from glyphgrid.operators import grid

#: Entries of a distribution's table, and of the symbols that a rescued count can name.
TABLE = 1 << 14


def counts_of(values: Column, size: int) -> Column:
    """How often each of 0 .. size - 1 occurs in an array. Values outside aren't counted: bring them into the range before."""
    empty = F.array_repeat(F.lit(0).cast("long"), size)
    return let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(v, lambda n: n == k)).cast("long"))) if size <= 64 else F.aggregate(
        values, empty, lambda t, v: F.transform(t, lambda n, i: n + (i == v).cast("long"))
    )


def buckets(values: Column, most: int) -> Column:
    """Equal-width buckets of an array: (least, largest, bucket of each value). As many as the range has values, or most."""
    low, high = F.array_min(values), F.array_max(values)
    span = F.greatest(high - low, F.lit(1).cast("long"))
    return F.struct(low.alias("low"), high.alias("high"), F.transform(values, lambda v: div_round((v - low) * (F.least(span, F.lit(most)) - 1), span)).alias("bucket"))


def total(counts: Column) -> Column:
    return grid.summed(counts)


def _log2(n: Column) -> Column:
    return F.log2(F.greatest(n, F.lit(1)).cast("double"))


def symbol_costs(counts: Column) -> Column:
    """log2(total) - log2(count) of each symbol; 0 where it doesn't occur."""
    return let(_log2(total(counts)), lambda whole: F.transform(counts, lambda c: F.when(c > 0, whole - _log2(c)).otherwise(0.0)))


def cost(counts: Column) -> Column:
    """Bits of coding all symbols by their own shares."""
    return grid.summed(F.zip_with(counts, symbol_costs(counts), lambda c, b: c * b), "double")


def bounded_cost(counts: Column, symbol, bound) -> Column:
    """Of one symbol, where no symbol over the bound can occur."""
    within = grid.summed(F.slice(counts, F.lit(1), bound + 1))
    c = F.get(counts, symbol)
    return F.when((total(counts) == 0) | (c == 0), 0.0).otherwise(_log2(within) - _log2(c))


def cross_cost(counts: Column, shares: Column) -> Column:
    """Bits of coding counts under another distribution. Symbols that it lacks are left out; 0 at least."""
    both = F.filter(F.zip_with(counts, shares, lambda c, q: F.struct(c.alias("c"), q.alias("q"))), lambda p: p["q"] > 0)
    bits = F.aggregate(both, F.lit(0.0), lambda s, p: s - p["c"] * _log2(p["q"]))
    held, whole = F.aggregate(both, F.lit(0).cast("long"), lambda s, p: s + p["c"]), F.aggregate(both, F.lit(0).cast("long"), lambda s, p: s + p["q"])
    return F.greatest(F.lit(0.0), bits + held * _log2(whole))


def l1_distance(p: Column, q: Column, table: int = TABLE) -> Column:
    """Between two distributions of the same table size: the mean absolute difference as a share of the table."""
    return let(q, lambda q: grid.summed(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / (F.size(q) * F.lit(float(table))))


def l2_from_uniform(p: Column, table: int = TABLE) -> Column:
    """The squared distance of a distribution from the uniform one over its alphabet, in squared table sizes.

    Sums are in single precision, and lose their fraction with each symbol.
    """
    mean = lambda p: (F.lit(float(table)).cast("float") / F.size(p).cast("float")).cast("float")
    square = lambda v, mean: ((v.cast("float") - mean).cast("float") * (v.cast("float") - mean).cast("float")).cast("float")
    add = lambda mean: lambda s, v: F.floor((s.cast("float") + square(v, mean)).cast("float")).cast("long")
    return let(p, lambda p: let(mean(p), lambda m: F.aggregate(p, F.lit(0).cast("long"), add(m)))) / F.lit(float(table) * table)


def cumulated(counts: Column, table: int = TABLE) -> Column:
    """A distribution over a table: the share of each symbol between its rounded-down cumulated counts, so that all add up."""
    upto = F.aggregate(counts, F.array(F.lit(0).cast("long")), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + c)))
    bounds = let(upto, lambda u: let(F.element_at(u, -1), lambda whole: F.transform(u, lambda c: F.call_function("div", c * table, whole))))
    return let(bounds, lambda b: F.transform(counts, lambda c, i: F.get(b, i + 1) - F.get(b, i)))


def _by_numpy(histograms: DataFrame, column: str, out: dict, body) -> DataFrame:
    """image_id and what body makes of each row's counts."""
    from glyphgrid.operators import stencils

    rows = histograms.select("image_id", F.col(column).alias("counts"), F.size(column).alias("w"), F.lit(1).alias("h"))
    return stencils.on_rasters(rows, ("counts",), out, lambda p: body(p["counts"][0]), ("image_id",))


def offsets(histograms: DataFrame, column: str = "counts") -> DataFrame:
    """image_id, start (the sum before each count) and freq."""
    return _by_numpy(histograms, column, {"start": "array<long>", "freq": "array<long>"}, lambda c: {"start": np.cumsum(c) - c, "freq": c})


def spread(histograms: DataFrame, column: str = "counts") -> DataFrame:
    """image_id and, for each slot of a table in which each symbol stands count times, the symbol, its offset and its count."""

    def body(c):
        sym = np.repeat(np.arange(len(c)), c)
        return {"sym": sym, "offset": (np.cumsum(c) - c)[sym], "freq": c[sym]}

    return _by_numpy(histograms, column, dict.fromkeys(("sym", "offset", "freq"), "array<long>"), body)


def scaled(counts: Column, most, expand: bool = False) -> Column:
    """Counts so that the largest is most: rounded, 1 at least where there was one. Smaller ones stay unless expand."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    top = F.array_max(counts)
    stays = (top == 0) | (top == most) | (F.lit(not expand) & (top <= most))
    return F.when(stays, counts).otherwise(F.transform(counts, lambda c: F.when(c > 0, F.greatest(F.lit(1).cast("long"), F.floor(c * (F.lit(1.0) * most / top) + 0.5).cast("long"))).otherwise(F.lit(0).cast("long"))))


def powers_of_two(counts: Column, max_bits: int) -> Column:
    """Counts to the nearest power of two in the logarithm, after scaling the largest to 2 ** (max_bits - 1) at most."""
    top = F.array_max(counts)
    share = F.lit(1.0) * F.least(F.lit(1 << max_bits - 1), top) / top
    return F.transform(counts, lambda c: F.when(c > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.log2(F.greatest(c * share, F.lit(1.0))) + 0.5).cast("int"))).otherwise(0))


def rescued(counts, table: int) -> list:
    """Counts that add up to the table: rounded shares in single precision, 1 at least where there was one; what is
    missing goes one by one to those with the largest rounding errors, what is too much comes off the largest in turn,
    while they are over 1. Among equals the later symbol comes first."""
    counts = np.asarray(counts, np.int64)
    whole = int(counts.sum())
    if whole == table or not len(counts):
        return counts.tolist()
    if not whole:
        return [table] + [0] * (len(counts) - 1)
    target = np.float32(table) / np.float32(whole) * counts.astype(np.float32)
    out = np.where(counts > 0, np.maximum(1, np.floor(target.astype(float) + 0.5)), 0).astype(np.int64)
    miss = table - int(out.sum())
    if miss > 0:
        order = sorted(np.flatnonzero(counts).tolist(), key=lambda k: (abs(float(target[k]) - out[k]), k), reverse=True)
        out[order[:miss]] += 1
        out[order[0]] += max(0, miss - len(order))
    elif miss < 0:
        if np.count_nonzero(counts) > table:
            raise ValueError("more symbols than places")
        order = sorted(np.flatnonzero(out > 1).tolist(), key=lambda k: (out[k], k), reverse=True)[: -miss]
        while miss:
            for k in order:
                if miss and out[k] > 1:
                    out[k] -= 1
                    miss += 1
    return out.tolist()


def normalised(histograms: DataFrame, table: int, column: str = "counts") -> DataFrame:
    """image_id and ``column``, rescued."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"image_id": f["image_id"], column: [rescued(c, table) for c in f[column]]})

    return histograms.select("image_id", column).mapInPandas(run, f"image_id long, {column} array<long>")


def _slog2(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(0.0)


def combined_entropy(p: Column, q: Column) -> Column:
    """Of p, and of p + q, together."""
    both = F.zip_with(p, q, lambda a, b: F.struct(a.alias("p"), b.alias("q")))
    parts = F.aggregate(both, F.lit(0.0), lambda s, v: s - _slog2(v["p"]) - _slog2(v["p"] + v["q"]))
    return parts + _slog2(total(p)) + _slog2(total(p) + total(q))


def extra_cost(counts: Column) -> Column:
    """Extra bits of prefix codes: the loop starts at 2, and the bits of code i count the uses of code i + 2."""
    return grid.summed(F.transform(counts, lambda c, k: F.when((k >= 4) & (k < F.size(counts)), F.shiftright(k - 2, 1) * c).otherwise(0)))


def added(p: Column, q: Column) -> tuple:
    """(sum, how many of it aren't 0)"""
    both = F.zip_with(p, q, lambda a, b: a + b)
    return both, F.size(F.filter(both, lambda v: v != 0))


def clusters(histogram: list, most: int) -> tuple[list, list]:
    """(label of each value, centres) of a histogram by k-means in one dimension, in integers.

    Centres start at the mean of parts of about equal mass. Three passes at most assign each value to the
    nearest centre, the lower of two; all but the last move the centres to the truncated means and drop
    those without mass.
    """
    h = np.asarray(histogram, np.int64)
    mass = int(h.sum())
    k = min(most, len(h), mass) if len(h) and most else 0
    if not len(h) or not most:
        return [], []
    if not k:
        return [0] * len(h), [len(h) // 2]
    centres, sums, weighted = [], np.cumsum(h), np.cumsum(h * np.arange(len(h)))
    from_sum = from_weighted = 0
    for i in range(len(h)):
        if len(centres) >= k:
            break
        if sums[i] > from_sum and sums[i] * k > mass * len(centres):
            mean = int((weighted[i] - from_weighted) // (sums[i] - from_sum))
            if not centres or centres[-1] != mean:
                centres.append(mean)
            from_sum, from_weighted = sums[i], weighted[i]
    places = np.arange(len(h))
    for last in (False, False, True):
        labels = np.abs(np.array(centres)[:, None] - places).argmin(0)
        if last:
            break
        found = [(int((h * places)[labels == c].sum()), int(h[labels == c].sum())) for c in range(len(centres))]
        moved = [a // b for a, b in found if b]
        if moved == centres[: len(moved)]:
            centres = moved
            break
        centres = moved
    return labels.tolist(), centres


def clustered(histograms: DataFrame, most: int) -> DataFrame:
    """image_id and counts to image_id, labels and centres."""

    def run(frames):
        for f in frames:
            got = [clusters(c, most) for c in f["counts"]]
            yield pd.DataFrame({"image_id": f["image_id"], "labels": [g[0] for g in got], "centres": [g[1] for g in got]})

    return histograms.select("image_id", "counts").mapInPandas(run, "image_id long, labels array<long>, centres array<long>")


def tallied(rows: DataFrame, *keys: str) -> DataFrame:
    """The number of rows and the sum of ``bits`` of each key, most frequent first in ``place``."""
    from pyspark.sql import Window

    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("bits").alias("bits"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), *keys)) - 1)
