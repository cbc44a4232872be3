"""Compositing, palettes and nearest-neighbour assignment."""

from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.functions.fixed import div_by_255, let
from glyphgrid.operators import grid
from glyphgrid.operators.geometry import holds_point


def _over(v: Column, alpha: Column, below) -> Column:
    return v + div_by_255((255 - alpha) * below)


def over_colour(images: DataFrame, colour: dict) -> DataFrame:
    """Premultiplied images over one premultiplied colour, alpha included."""
    return grid.mapped(images, lambda c, x, y: _over(grid.value(c, x, y), grid.value("a", x, y), F.lit(colour[c])))


def over(pairs: DataFrame, window: tuple | None = None) -> DataFrame:
    """Each image over its partner; outside the window the partner stays."""

    def of(c, x, y):
        below = grid.value(f"{c}2", x, y)
        on_top = _over(grid.value(c, x, y), grid.value("a", x, y), below)
        return on_top if window is None else F.when(holds_point(*map(F.lit, window), x, y), on_top).otherwise(below)

    return grid.mapped(pairs, of)


def under(pairs: DataFrame, window: tuple | None = None) -> DataFrame:
    """The partner over each image, in the window; outside it the image stays."""

    def of(c, x, y):
        own = grid.value(c, x, y)
        on_top = _over(grid.value(f"{c}2", x, y), grid.value("a2", x, y), own)
        return on_top if window is None else F.when(holds_point(*map(F.lit, window), x, y), on_top).otherwise(own)

    return grid.mapped(pairs, of)


def over_planes(pairs: DataFrame, kind: str = "YCbCr") -> DataFrame:
    """As over, on YUV planes: what shows of the partner is its distance from black, as black is not 0 there."""
    from glyphgrid.operators.color import YUV, rgb_to_yuv

    black = dict(zip(YUV, rgb_to_yuv(F.lit(0), F.lit(0), F.lit(0), kind)))
    return grid.mapped(pairs, lambda c, x, y: _over(grid.value(c, x, y), grid.value("a", x, y), grid.value(f"{c}2", x, y) - black.get(c, F.lit(0))), ("a", *YUV))


def colours(images: DataFrame) -> DataFrame:
    """With the array of each pixel's (a, r, g, b) as ``px``."""
    return grid.held(images, px=F.transform(F.arrays_zip(*grid.CHANNELS), lambda p: F.struct(*[p[c].alias(c) for c in grid.CHANNELS])))


def palettes(images: DataFrame, most: int = 256) -> DataFrame:
    """With ``palette``: the distinct colours in ascending order, or null: too many for min(most, pixels), or one alone."""
    found = grid.held(colours(images), palette=F.sort_array(F.array_distinct("px")))
    limit = F.when(F.col("w") * F.col("h") < 2, 2).otherwise(F.least(F.lit(most), F.col("w") * F.col("h")))
    n = F.size("palette")
    return found.withColumn("n_colors", F.when(n > limit, 0).otherwise(n)).withColumn("palette", F.when((n > 1) & (n <= limit), F.col("palette")))


def indexed(images: DataFrame, most: int = 256) -> DataFrame:
    """With ``idx``: each pixel's place in its image's palette. Images without a palette are left out."""
    found = palettes(images, most).filter("palette is not null")
    return grid.held(found, idx=F.transform("px", lambda p: F.array_position("palette", p) - 1))


def unindexed(images: DataFrame) -> DataFrame:
    """The channels from ``idx`` and ``palette``."""
    pick = lambda c: F.transform("idx", lambda i: F.get("palette", i.cast("int"))[c])
    return images.select("image_id", "w", "h", *[pick(c).alias(c) for c in grid.CHANNELS])


def nearest_colour(px: Column, palette: Column, channels: tuple = grid.CHANNELS) -> Column:
    """(squared distance, place) of the palette colour nearest to px, the first of equal ones."""
    far = lambda q: sum(((px[c] - q[c]) * (px[c] - q[c]) for c in channels), F.lit(0))
    return F.array_min(F.transform(palette, lambda q, i: F.struct(far(q).alias("d"), i.alias("i"))))


def palette_usage(images: DataFrame, palette: Column) -> DataFrame:
    """image_id, idx, n: how many pixels are nearest to each colour of a palette, those with none included."""
    near = F.transform("px", lambda p: nearest_colour(p, palette)["i"])
    rows = grid.held(grid.held(colours(images), near=near), k=F.size(palette)).select("image_id", "near", "k")
    return rows.select("image_id", F.posexplode(grid.each(F.col("k"), lambda i: F.size(F.filter("near", lambda v: v == i)))).alias("idx", "n"))


def sorted_by_deltas(palette: Column, weight: int = 256) -> Column:
    """The colours so that each is the nearest, of those left, to the one before; the first is nearest to 0.

    Distances are of red, green and blue, weighted, and of alpha with the rest of 256. Of equal ones that comes
    first which stands first; a colour that is passed over takes the place of the one that was taken.
    """
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in grid.CHANNELS])

    def far(p, q):
        return sum((F.abs(p[c] - q[c]) for c in "rgb"), F.lit(0)) * weight + F.abs(p["a"] - q["a"]) * (256 - weight)

    def step(state, i):
        left, last = state["left"], state["last"]
        nearest = F.array_min(F.transform(left, lambda q, k: F.struct(far(q, last).alias("d"), k.alias("k"))))["k"]

        def take(best):
            taken = F.get(left, best)
            rest = F.transform(F.slice(left, F.lit(2), F.greatest(F.size(left) - 1, F.lit(0))), lambda q, k: F.when(k + 1 == best, F.get(left, F.lit(0))).otherwise(q))
            return F.struct(rest.alias("left"), taken.alias("last"), F.concat(state["out"], F.array(taken)).alias("out"))

        # Searched once for a step, not again for each colour that is left.
        return let(nearest, take)

    start = F.struct(palette.alias("left"), zero.alias("last"), F.slice(palette, 1, 0).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(palette)), start, step, lambda s: s["out"])


def first_places(images: DataFrame) -> DataFrame:
    """With ``idx``: the number of each pixel's colour, in the order in which the colours first occur."""
    found = grid.held(colours(images), seen=F.array_distinct("px"))
    return grid.held(found, idx=F.transform("px", lambda p: F.array_position("seen", p) - 1))


def clusters_of_pixels(labels: DataFrame, w, h, bits: int) -> DataFrame:
    """labels (image_id, w, h, v) of tiles of 2 ** bits pixels to the label of each pixel of an image of w x h."""
    return grid.regridded(labels, w, h, lambda c, x, y: grid.value(c, F.shiftright(x, bits), F.shiftright(y, bits)), ("v",))
