"""Pixel predictors and their residuals, near-lossless smoothing, and other scans of neighbours."""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from glyphgrid.functions.fixed import clamp, idiv
from glyphgrid.operators import grid, stencils


def _average(p, q) -> Column:
    return F.shiftright(p + q, 1)


def predicted(mode: int, c: str, x, y, top: int = 255) -> Column:
    """What a mode predicts for a channel, away from the first row and column.

    Right of the last column the upper row goes on with the first pixel of this row, as rows lie one after the other.
    """
    v = lambda k, dx, dy: grid.value(k, x + dx, y + dy)
    left, up, corner, right = v(c, -1, 0), v(c, 0, -1), v(c, -1, -1), v(c, 1, -1)
    if mode == 11:
        # The sums over all channels decide: which of the two is nearer to the gradient left + up - corner.
        gain = sum((F.abs(v(k, -1, 0) - v(k, -1, -1)) - F.abs(v(k, 0, -1) - v(k, -1, -1)) for k in grid.CHANNELS), F.lit(0))
        return F.when(gain <= 0, up).otherwise(left)
    average = _average(left, up)
    return {
        0: F.lit(top if c == "a" else 0), 1: left, 2: up, 3: right, 4: corner,
        5: _average(_average(left, right), up), 6: _average(left, corner), 7: average, 8: _average(corner, up), 9: _average(up, right),
        10: _average(_average(left, corner), _average(up, right)), 12: clamp(left + up - corner, 0, top),
        13: clamp(average + idiv(average - corner, 2), 0, top),
    }[mode]


def residuals(images: DataFrame, mode, bits: int = 8) -> DataFrame:
    """Pixels less their prediction, modulo 2 ** bits. The first pixel is predicted opaque black, the first row from the
    left, the first column from above. mode: a number, or a function of (x, y) that gives a column of numbers."""
    top = (1 << bits) - 1

    def of(c, x, y):
        if callable(mode):
            m = mode(x, y)
            inner = F.when(F.lit(False), F.lit(0))
            for k in range(14):
                inner = inner.when(m == k, predicted(k, c, x, y, top))
        else:
            inner = predicted(mode, c, x, y, top)
        first = predicted(0, c, x, y, top)
        guess = F.when((x == 0) & (y == 0), first).when(y == 0, grid.value(c, x - 1, y)).when(x == 0, grid.value(c, x, y - 1)).otherwise(inner)
        return (grid.value(c, x, y) - guess).bitwiseAND(F.lit(top))

    return grid.mapped(images, of)


#: Bits that a mode is given before for each neighbour that has it, and the weights of small residuals.
BIAS, SMALL, DECAY, SHARE = 15.0, 0.94, 0.6, 0.1
MODES = 14


def all_residuals(planes: dict) -> np.ndarray:
    """The residuals of all modes at once: (mode, h, w, channel), as in ``residuals``."""
    v = np.stack([planes[c] for c in grid.CHANNELS], -1)
    h, w, _ = v.shape
    flat = np.concatenate([v.reshape(-1, 4), v[-1:, -1]])
    at = np.arange(h * w).reshape(h, w)
    look = lambda back: flat[np.maximum(at - back, 0)]
    left, up, corner, right = look(1), look(w), look(w + 1), look(w - 1)
    top, average = np.array([255, 0, 0, 0]), (left + up) >> 1
    nearer = (np.abs(left - corner).sum(-1) - np.abs(up - corner).sum(-1))[..., None]
    half = np.trunc((average - corner) / 2).astype(np.int64)
    guesses = [
        np.broadcast_to(top, v.shape), left, up, right, corner, (((left + right) >> 1) + up) >> 1, (left + corner) >> 1, average, (corner + up) >> 1, (up + right) >> 1,
        (((left + corner) >> 1) + ((up + right) >> 1)) >> 1, np.where(nearer <= 0, up, left), np.clip(left + up - corner, 0, 255), np.clip(average + half, 0, 255),
    ]
    out = []
    for guess in guesses:
        guess = guess.copy()
        guess[:, 0], guess[0] = up[:, 0], left[0]
        guess[0, 0] = top
        out.append((v - guess) & 255)
    return np.stack(out)


def _xlogx(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n * np.log2(np.maximum(n, 1)), 0.0)


def _alike(own: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Bits of histograms (..., channel, 256) on their own and together with what is known, less what favours small residuals."""
    both = own + known
    entropy = _xlogx(own.sum(-1)) - _xlogx(own).sum(-1) + _xlogx(both.sum(-1)) - _xlogx(both).sum(-1)
    near = SMALL * DECAY ** np.arange(15)
    small = own[..., 0] + (near * (own[..., 1:16] + own[..., :-16:-1])).sum(-1)
    return (entropy - SHARE * small).sum(-1)


def tile_histograms(residuals: np.ndarray, size: int) -> np.ndarray:
    """(tile row, tile column, mode, channel, 256)."""
    modes, h, w, _ = residuals.shape
    th, tw = -(-h // size), -(-w // size)
    tile = (np.arange(h)[:, None] // size) * tw + np.arange(w) // size
    place = ((tile[None, :, :, None] * modes + np.arange(modes)[:, None, None, None]) * 4 + np.arange(4)) * 256 + residuals
    return np.bincount(place.ravel(), minlength=th * tw * modes * 4 * 256).reshape(th, tw, modes, 4, 256)


def chosen_modes(histograms: np.ndarray) -> np.ndarray:
    """The mode of each tile, row by row: the fewest bits with the histograms of the tiles before, less the bias for each of the left and the upper
    tile that has it; the first of equal ones."""
    th, tw = histograms.shape[:2]
    modes, known = np.zeros((th, tw), np.int64), np.zeros((4, 256), np.int64)
    for y in range(th):
        for x in range(tw):
            bits = _alike(histograms[y, x], known)
            if x:
                bits[modes[y, x - 1]] -= BIAS
            if y:
                bits[modes[y - 1, x]] -= BIAS
            modes[y, x] = int(np.argmin(np.round(bits, 6)))
            known = known + histograms[y, x, modes[y, x]]
    return modes


def best_modes(images: DataFrame, size: int) -> DataFrame:
    """image_id, across (tiles in a row) and modes, row by row. An image's tiles depend on those before, so an image is one row and task."""

    def body(p):
        modes = chosen_modes(tile_histograms(all_residuals(p), size))
        return {"across": modes.shape[1], "modes": modes}

    return stencils.on_rasters(images, grid.CHANNELS, {"across": "long", "modes": "array<long>"}, body, ("image_id",))


def best_modes_alone(images: DataFrame, size: int) -> DataFrame:
    """The same of each tile on its own, whatever its neighbours are; bits: those of the mode that is taken."""

    def body(p):
        bits = np.round(_alike(tile_histograms(all_residuals(p), size), np.zeros((4, 256), np.int64)), 6)
        return {"across": bits.shape[1], "modes": bits.argmin(-1), "bits": bits.min(-1)}

    return stencils.on_rasters(images, grid.CHANNELS, {"across": "long", "modes": "array<long>", "bits": "array<double>"}, body, ("image_id",))


def predicted_image(images: DataFrame, size: int) -> DataFrame:
    """image_id, w, h and the residuals under each tile's best mode."""

    def body(p):
        found = all_residuals(p)
        modes = chosen_modes(tile_histograms(found, size))
        h, w = found.shape[1:3]
        of = np.repeat(np.repeat(modes, size, 0), size, 1)[:h, :w]
        kept = np.take_along_axis(found, of[None, ..., None], 0)[0]
        return {c: kept[..., k] for k, c in enumerate(grid.CHANNELS)}

    return stencils.on_rasters(images, grid.CHANNELS, dict.fromkeys(grid.CHANNELS, "array<long>"), body)


def restored(images: DataFrame, mode: int, bits: int = 8) -> DataFrame:
    """The inverse of residuals, pixel after pixel, for the modes 0 to 2 whose prediction is one neighbour."""
    if mode not in (0, 1, 2):
        raise ValueError("modes 0, 1 and 2 can be undone by prefix sums")
    mask = F.lit((1 << bits) - 1)
    w = F.col("w")

    def of(c, x, y):
        first_column = grid.summed(F.transform(F.sequence(F.lit(0), y), lambda j: grid.value(c, F.lit(0), j)))
        first_row = grid.summed(F.transform(F.sequence(F.lit(0), x), lambda i: grid.value(c, i, F.lit(0))))
        start = F.lit((1 << bits) - 1 if c == "a" else 0)
        along = F.slice(F.col(c), y * w + 2, x) if mode == 1 else None
        if mode == 1:
            total = F.when(x == 0, first_column).otherwise(first_column + grid.summed(along))
        elif mode == 2:
            total = first_row + grid.summed(F.transform(F.sequence(F.lit(1), F.greatest(y, F.lit(1))), lambda j: F.when(j <= y, grid.value(c, x, j)).otherwise(0)))
        else:
            total = F.when(y == 0, first_row).when(x == 0, first_column).otherwise(grid.value(c, x, y))
        return (total + start).bitwiseAND(mask)

    return grid.mapped(images, of)


def _smoothed(planes: dict, quality: int, place: tuple | None = None) -> dict:
    for bits in range(min(4, max(1, 100 - quality)), 0, -1):
        limit, mask = max(1, ((1 << bits) - 1) // 2), (1 << bits) - 1
        across, down = (np.maximum.reduce([np.abs(np.diff(v, axis=k)) for v in planes.values()]) >= limit for k in (-1, -2))
        far = np.zeros(next(iter(planes.values())).shape, bool)
        for both, step in (((far[..., 1:], far[..., :-1]), across), ((far[..., 1:, :], far[..., :-1, :]), down)):
            for side in both:
                side |= step
        x = np.arange(far.shape[-1]) + (place[1] if place else 0)
        far &= (x > 0) & (x < (place[3] if place else far.shape[-1]) - 1)
        biased = {c: v + (mask >> 1) + (v >> bits) % 2 for c, v in planes.items()}
        planes = {c: np.where(far, np.where(biased[c] > 255, 255, biased[c] - biased[c] % (mask + 1)), v) for c, v in planes.items()}
    return planes


def near_lossless(images: DataFrame, quality: int) -> DataFrame:
    """Values far from a neighbour lose low bits, one pass for each of 1 to 4 bits, the highest first.

    The first and last columns stay; the first and last rows are their own outer neighbours.
    """
    return stencils.on_stacks(images, grid.CHANNELS, dict.fromkeys(grid.CHANNELS, "array<long>"), lambda p: _smoothed(p, quality))


def near_lossless_tiles(tiles: DataFrame, quality: int, size: int = stencils.TILE) -> DataFrame:
    """The same of tiles: each pass reaches one pixel further."""
    return stencils.on_tiles(tiles, grid.CHANNELS, dict.fromkeys(grid.CHANNELS, "array<long>"), lambda p, at: _smoothed(p, quality, at), 4, size)


def spread(images: DataFrame, channel: str = "r", radius: int = 2) -> DataFrame:
    """Largest less least value in the window around each pixel, clipped at the borders."""
    return stencils.on_rasters(images, (channel,), {"spread": "array<long>"}, lambda p: {"spread": np.subtract(*stencils.extremes(p[channel], radius)[::-1])})


def changed(pairs: DataFrame, quality: float) -> DataFrame:
    """image_id, y, x of the pixels that differ from the partner's by more than the quality allows, alpha included."""
    limit = int(((1 - quality * 0.01) * 15.0) ** 2 + 0.5)
    far = grid.pixels(F.col("w"), F.col("h"), lambda x, y: sum(((grid.value(c, x, y) - grid.value(f"{c}2", x, y)) * (grid.value(c, x, y) - grid.value(f"{c}2", x, y)) for c in grid.CHANNELS), F.lit(0)))
    return grid.exploded(pairs.select("image_id", "w", "h", far.alias("far")), "far").filter(F.col("far") > limit).select("image_id", "y", "x")


def _blurred(planes: dict, radius: int, threshold: int) -> dict:
    ones = (1,) * (radius + 1)
    out = {}
    for c, v in planes.items():
        n = stencils.windowed(np.ones_like(v), ones)
        mean = (stencils.windowed(v, ones) + n // 2) // n
        out[c] = np.where(np.abs(mean - v) < threshold, mean, v)
    return out


def blurred(images: DataFrame, radius: int, threshold: int) -> DataFrame:
    """Each channel of a pixel becomes the rounded mean of its window, clipped at the borders, where it differs from it by less than the threshold."""
    return stencils.on_rasters(images, grid.CHANNELS, dict.fromkeys(grid.CHANNELS, "array<long>"), lambda p: _blurred(p, radius, threshold))


def blurred_tiles(tiles: DataFrame, radius: int, threshold: int, size: int = stencils.TILE) -> DataFrame:
    return stencils.on_tiles(tiles, grid.CHANNELS, dict.fromkeys(grid.CHANNELS, "array<long>"), lambda p, _: _blurred(p, radius, threshold), radius, size)


#: Fixed value: the multiplier of the colour hash.
HASH = 0x1E35A7BD


def hash_cached(pixels: DataFrame, bits: int) -> DataFrame:
    """pixels (image_id, y, x, a, r, g, b) with ``slot``, the hash of the colour, and ``hit``: whether the slot's last colour is this one.

    All slots start as 255 in each channel. An image's pixels of one slot stand in one task.
    """
    from pyspark.sql import Window

    word = F.shiftleft(F.col("a").cast("long"), 24) + F.shiftleft(F.col("r").cast("long"), 16) + F.shiftleft(F.col("g").cast("long"), 8) + F.col("b")
    rows = pixels.withColumn("_word", word).withColumn("slot", F.shiftright((F.col("_word") * HASH).bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits))
    last = F.lag("_word", 1, 0xFFFFFFFF).over(Window.partitionBy("image_id", "slot").orderBy("y", "x"))
    return rows.withColumn("hit", last == F.col("_word")).drop("_word")
