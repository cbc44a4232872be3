"""The direction of each block, and smoothing along it: pixels move towards those ahead and behind on the block's line, and less towards those on
the lines two directions beside, the less the further their values are."""

import numpy as np
from pyspark.sql import DataFrame

from glyphgrid.operators import stencils

#: Of each direction the places (y, x) one and two steps ahead.
STEPS = (((-1, 1), (-2, 2)), ((0, 1), (-1, 2)), ((0, 1), (0, 2)), ((0, 1), (1, 2)), ((1, 1), (2, 2)), ((1, 0), (2, 1)), ((1, 0), (2, 0)), ((1, 0), (2, -1)))
#: Weights by step on the block's line, for even and odd strengths, and beside it, of 16.
ALONG, BESIDE = ((4, 2), (3, 3)), (2, 1)
DIRECTIONS, REACH = 8, 2


def lines(size: int) -> np.ndarray:
    """(direction, y, x): which of the lines of that direction a pixel of a block lies on, from 0."""
    y, x = np.mgrid[:size, :size]
    found = np.stack([y + x, y + x // 2, y, y - x // 2, y - x, x - y // 2, x, x + y // 2])
    return found - found.min((1, 2), keepdims=True)


def _blocks(v: np.ndarray, size: int) -> np.ndarray:
    """(block row, block column, y, x) of the whole blocks, after the axes of a stack."""
    h, w = v.shape[-2] // size, v.shape[-1] // size
    return v[..., : h * size, : w * size].reshape(*v.shape[:-2], h, size, w, size).swapaxes(-3, -2)


def directions(v: np.ndarray, size: int) -> tuple:
    """(direction, certainty) of each whole block of 8-bit values.

    Of 8 by 8: where the squared sums of lines are largest. Of 4 by 4: where pixels differ least from their line's mean, at ten bits. The certainty is
    what the direction at a right angle is worse by. Of equal directions the first.
    """
    blocks, of = _blocks(v, size), lines(size)
    counts = np.stack([np.bincount(d.ravel(), minlength=2 * size - 1) for d in of])
    hot = np.stack([(of == k) for k in range(2 * size - 1)], 1).astype(np.int64)  # direction, line, y, x
    if size == 8:
        sums = np.einsum("...yx,dlyx->...dl", blocks, hot)
        scores = (sums * sums * (840 // np.maximum(counts, 1))).sum(-1)
        best = scores.argmax(-1)
        across = np.take_along_axis(scores, (best[..., None] + 4) % 8, -1)[..., 0]
        return best, (scores.max(-1) - across) >> 10
    wide = blocks << 2
    sums, n = np.einsum("...yx,dlyx->...dl", wide, hot), np.maximum(counts, 1)
    means = (sums + n // 2) // n
    far = wide[..., None, :, :] - np.einsum("...dl,dlyx->...dyx", means, hot)
    scores = (far * far).sum((-1, -2))
    best = scores.argmin(-1)
    across = np.take_along_axis(scores, (best[..., None] + 4) % 8, -1)[..., 0]
    return best, (across - scores.min(-1)) >> 10


def held_back(far: np.ndarray, strength: np.ndarray, damping: int) -> np.ndarray:
    """How much of a difference counts: all of a small one, less and then nothing of a large one."""
    size = np.abs(far)
    shift = np.maximum(0, damping - np.floor(np.log2(np.maximum(strength, 1))).astype(np.int64))
    return np.sign(far) * np.clip(strength - (size >> shift), 0, size)


def filtered(planes: dict, size: int, damping: int) -> np.ndarray:
    """planes: v and the strengths along and beside, alike in a block. Places outside the image don't count; blocks that aren't whole stay."""
    v = planes["v"]
    best, _ = directions(v, size)
    h, w = best.shape[-2] * size, best.shape[-1] * size
    of, whole = np.zeros(v.shape, np.int64), np.zeros(v.shape, bool)
    of[..., :h, :w], whole[..., :h, :w] = np.repeat(np.repeat(best, size, -2), size, -1), True
    wide, known = stencils.widened(v, REACH, mode="constant"), stencils.widened(whole | True, REACH, mode="constant")
    place = np.arange(wide.size).reshape(wide.shape)[..., REACH:-REACH, REACH:-REACH]
    ahead = np.array(STEPS) @ (wide.shape[-1], 1)
    total, low, high = np.zeros_like(v), v.copy(), v.copy()
    for turn, strength, weights in ((0, planes["along"], None), (-2, planes["beside"], BESIDE), (2, planes["beside"], BESIDE)):
        for k in range(REACH):
            steps = np.roll(ahead[:, k], -turn)[of]
            weight = np.array(ALONG)[:, k][strength & 1] if weights is None else weights[k]
            for sign in (-1, 1):
                at = place + sign * steps
                other, seen = wide.ravel()[at], known.ravel()[at] & whole & (strength > 0)
                total += np.where(seen, held_back(other - v, strength, damping) * weight, 0)
                low, high = np.where(seen, np.minimum(low, other), low), np.where(seen, np.maximum(high, other), high)
    moved = v + ((8 + total - (total < 0)) >> 4)
    both = (planes["along"] > 0) & (planes["beside"] > 0)
    return np.where(both, np.clip(moved, low, high), moved)


PLANES = ("v", "along", "beside")


def block_directions(rasters: DataFrame, size: int) -> DataFrame:
    """image_id, across (blocks in a row), direction and certainty of the whole blocks, row by row."""

    def body(p):
        best, sure = directions(p["v"], size)
        return {"across": best.shape[1], "direction": best, "certainty": sure}

    return stencils.on_rasters(rasters, ("v",), {"across": "long", "direction": "array<long>", "certainty": "array<long>"}, body, ("image_id",))


def enhance(rasters: DataFrame, size: int = 8, damping: int = 5) -> DataFrame:
    return stencils.on_stacks(rasters, PLANES, {"v": "array<long>"}, lambda p: {"v": filtered(p, size, damping)})


def enhance_tiles(tiles: DataFrame, size: int = 8, damping: int = 5, side: int = stencils.TILE) -> DataFrame:
    """The same of tiles, whose side is a multiple of the block's; a block's side as halo keeps blocks whole."""
    if side % size:
        raise ValueError("tiles are cut between blocks")
    return stencils.on_tiles(tiles, PLANES, {"v": "array<long>"}, lambda p, at: {"v": filtered(p, size, damping)}, size, side)
