"""Rasters as arrays: one row an image, (image_id, w, h) and an array of w * h integers for each channel, row by row.

Neighbours are array positions, so the operators on one image need no shuffle, and those on two images
join whole rasters, not pixels.
"""

from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.functions.fixed import clamp, col, idiv

CHANNELS = ("a", "r", "g", "b")


def each(n: Column, body) -> Column:
    """The array of body(i) for i from 0 to n - 1; empty where n is 0."""
    n = n.cast("int")
    return F.slice(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), body), F.lit(1), n)


def pixels(w: Column, h: Column, body) -> Column:
    """The array of body(x, y) over a grid, row by row."""
    return each(w * h, lambda i: body((i % w).cast("int"), idiv(i, w).cast("int")))


def at(channel: Column, w: Column, x, y) -> Column:
    """The value at a place inside the raster; null outside the array."""
    return F.get(channel, (col(y) * w + col(x)).cast("int"))


def at_clamped(channel: Column, w: Column, h: Column, x, y) -> Column:
    return at(channel, w, clamp(col(x), 0, w - 1), clamp(col(y), 0, h - 1))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are computed once for a row, whatever reads them later.

    Spark merges one projection into the next, and an array would be computed again for each element that
    a function of arrays looks up in it. A generator of one row stands between them; it moves no data.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))).alias("_held")).select(*kept, "_held.*")


def mapped(df: DataFrame, body, channels: tuple = CHANNELS) -> DataFrame:
    """Each channel replaced by body(name, x, y), on the same grid."""
    w, h = F.col("w"), F.col("h")
    return held(df, **{c: pixels(w, h, lambda x, y, c=c: body(c, x, y).cast("long")) for c in channels}).select("image_id", "w", "h", *channels)


def regridded(df: DataFrame, w: Column, h: Column, body, channels: tuple = CHANNELS) -> DataFrame:
    """Each channel replaced by body(name, x, y) on a grid of another size."""
    # The sizes come last, as the bodies read the old ones.
    new = {c: pixels(w, h, lambda x, y, c=c: body(c, x, y).cast("long")) for c in channels}
    return held(df, **new, w=w.cast("int"), h=h.cast("int")).select("image_id", "w", "h", *channels)


def value(df_or_name: str, x, y) -> Column:
    """The value of a channel of this row's image."""
    return at(F.col(df_or_name), F.col("w"), x, y)


def exploded(df: DataFrame, *channels: str) -> DataFrame:
    """A row for each pixel: image_id, y, x and the channels."""
    names = channels or CHANNELS
    rows = df.select("image_id", "w", F.posexplode(F.arrays_zip(*[F.col(c) for c in names])).alias("i", "p"))
    return rows.select("image_id", idiv(F.col("i"), F.col("w")).alias("y"), (F.col("i") % F.col("w")).cast("long").alias("x"), *[F.col("p")[c].alias(c) for c in names])


def paired(images: DataFrame, others: DataFrame, channels: tuple = CHANNELS) -> DataFrame:
    """Images with their partner's channels as a2, r2 and so on, where ids and sizes agree."""
    second = others.select("image_id", F.col("w").alias("w2"), F.col("h").alias("h2"), *[F.col(c).alias(f"{c}2") for c in channels])
    return images.join(second, "image_id").filter("w = w2 and h = h2").drop("w2", "h2")


def summed(array: Column, kind: str = "bigint") -> Column:
    return F.aggregate(array, F.lit(0).cast(kind), lambda s, v: s + v.cast(kind))
