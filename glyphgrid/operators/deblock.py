"""Smoothing across the edges of blocks: lines over an edge that are flat enough and don't jump too far, first over upright
edges, then over level ones. Blocks are squares of one size; each has its bits for a pixel and its share of non-zero residuals.

On tiles the same comes out as on whole rasters: an edge reads and writes half a block on either side, at most eight pixels, so a
halo of a block's side (eight at least) holds all that a tile's pixels depend on, edges between tiles included.
"""

import numpy as np
from pyspark.sql import DataFrame

from glyphgrid.operators import stencils

MOST_STRENGTH, MOST_SHARPNESS, MOST_HALF, QUALITIES = 63, 7, 8, 14
#: How much of the jump a pixel takes, by the length of the flat line and the distance from the edge, of 256.
WEIGHTS = ((), (160,), (180, 70), (190, 89, 22), (200, 113, 50, 13), (200, 128, 72, 32, 8), (200, 139, 89, 50, 22, 6), (200, 147, 102, 65, 37, 16, 4), (200, 153, 113, 78, 50, 28, 13, 3))
#: The largest jump that is smoothed, by sharpness, for values of ten bits with their sign.
JUMPS = (220, 212, 204, 168, 108, 72, 40, 20)
#: The largest change of slope in a flat line, by sharpness and distance from the edge; the first isn't used.
SLOPES = (
    (127, 82, 15, 7, 4, 3, 2, 2), (127, 80, 10, 6, 4, 3, 2, 2), (127, 78, 7, 5, 4, 3, 2, 2), (127, 66, 6, 4, 4, 3, 2, 1),
    (127, 54, 6, 4, 3, 2, 1, 1), (127, 40, 6, 4, 3, 2, 1, 1), (127, 37, 4, 3, 2, 2, 1, 1), (127, 25, 3, 2, 2, 1, 1, 1),
)


def strength(quality: int, bits_per_pixel: np.ndarray) -> np.ndarray:
    """The lesser of two: full below middle quality, none at the top; full at no bits, none at 255."""
    of_quality = min((2 * (QUALITIES - quality) * MOST_STRENGTH + QUALITIES // 2) // QUALITIES, MOST_STRENGTH)
    return np.minimum(of_quality, (255 - bits_per_pixel) * MOST_STRENGTH // 255)


def sharpness(quality: int, density: np.ndarray) -> np.ndarray:
    """The larger of two: by quality, and by residuals from 25 to 75 of 255."""
    return np.maximum((quality * MOST_SHARPNESS + QUALITIES // 2) // QUALITIES, np.minimum(np.maximum(density - 25, 0) * MOST_SHARPNESS // 50, MOST_SHARPNESS))


def flat_length(p: np.ndarray, q: np.ndarray, sharp: np.ndarray) -> np.ndarray:
    """How far a line is flat on both sides: p and q are (..., half), from the edge outwards."""
    half = p.shape[-1]
    jump = (q[..., 0] - p[..., 0])[..., None]
    slopes = np.abs(np.diff(np.concatenate([-jump, np.diff(p)], -1))), np.abs(np.diff(np.concatenate([jump, np.diff(q)], -1)))
    ends = (np.maximum(*slopes) > np.array(SLOPES)[sharp][..., 1:half]) if half > 1 else np.zeros((*p.shape[:-1], 0), bool)
    return np.where(ends.any(-1), ends.argmax(-1) + 1, half) if half > 1 else np.ones(p.shape[:-1], np.int64)


def smoothed(p: np.ndarray, q: np.ndarray, flat: np.ndarray, strong: np.ndarray, limit: np.ndarray, least: int, most: int) -> tuple:
    """The lines after smoothing; one that jumps beyond the limit, or by one at most, stays."""
    toward = lambda v: v[..., 0] + (np.where(flat > 1, (v[..., 0] - v[..., min(1, v.shape[-1] - 1)]) >> 1, 0))
    delta = toward(q) - toward(p)
    table = np.array([(*row, *(0,) * (MOST_HALF - len(row))) for row in WEIGHTS])
    moved = (delta * strong)[..., None] * table[flat][..., : p.shape[-1]] + (1 << 14) >> 15
    moved = np.where(((np.abs(delta) <= limit) & (np.abs(delta) > 1) & (strong > 0))[..., None], moved, 0)
    return np.where(moved, np.clip(p + moved, least, most), p), np.where(moved, np.clip(q - moved, least, most), q)


def over_upright_edges(v: np.ndarray, bits: np.ndarray, density: np.ndarray, at: int, width: int, block: int, quality: int, n_bits: int, least: int, most: int) -> np.ndarray:
    """at: where the array begins in its image, whose width counts for the last block."""
    out = v.copy()
    edges = np.arange(-(-max(at, 1) // block) * block, min(at + v.shape[1], width), block)
    halves = np.minimum(np.minimum(block // 2, MOST_HALF), width - edges)
    for half in np.unique(halves):
        x = edges[halves == half] - at
        x = x[(x >= half) & (x + half <= v.shape[1])]
        if not len(x):
            continue
        d = np.arange(half)
        p, q = v[:, (x - 1)[:, None] - d], v[:, x[:, None] + d]
        strong = strength(quality, np.minimum(bits[:, x - 1], bits[:, x]))
        sharp = sharpness(quality, np.maximum(density[:, x - 1], density[:, x]))
        jumps = np.array(JUMPS)[sharp]
        limit = jumps << n_bits - 10 if n_bits > 10 else (jumps + (1 << 10 - n_bits >> 1)) >> 10 - n_bits
        out[:, (x - 1)[:, None] - d], out[:, x[:, None] + d] = smoothed(p, q, flat_length(p, q, sharp), strong, limit, least, most)
    return out


def deblocked(planes: dict, place: tuple, block: int, quality: int, n_bits: int = 9, least: int = 0, most: int = 255) -> dict:
    """planes, or stacks of them: v, bits and density, the last two alike in all pixels of a block."""
    y, x, h, w = place
    # A line over an edge knows no other, so the lines of a stack are rows of one array.
    across = lambda planes, at, width: over_upright_edges(*[v.reshape(-1, v.shape[-1]) for v in planes], at, width, block, quality, n_bits, least, most).reshape(planes[0].shape)
    v = across((planes["v"], planes["bits"], planes["density"]), x, w)
    return {"v": across([u.swapaxes(-1, -2) for u in (v, planes["bits"], planes["density"])], y, h).swapaxes(-1, -2)}


PLANES = ("v", "bits", "density")


def deblock(rasters: DataFrame, block: int, quality: int, **values) -> DataFrame:
    """image_id, w, h and v, of rasters of one row each."""
    return stencils.on_rasters(rasters, PLANES, {"v": "array<long>"}, lambda p: deblocked(p, (0, 0, *p["v"].shape), block, quality, **values))


def deblock_tiles(tiles: DataFrame, block: int, quality: int, size: int = stencils.TILE, **values) -> DataFrame:
    """The same of tiles, over the edges between them too; their side is a multiple of the block's."""
    if size % block:
        raise ValueError("tiles are cut between blocks")
    return stencils.on_tiles(tiles, PLANES, {"v": "array<long>"}, lambda p, at: deblocked(p, at, block, quality, **values), max(block, MOST_HALF), size)
