"""The best multipliers of each tile for taking green out of red, and green and red out of blue: a search from coarse to fine by the bits of the
histograms, the tiles before and the left and the upper tile's choice included.

Tiles depend on those before, so an image is one row and task; the histograms of a step are counted at once for all that it tries.
"""

import numpy as np
from pyspark.sql import DataFrame

from glyphgrid.operators import stencils

#: Bounds of the multipliers, bits given before for each likeness, the weights of small values and their decay.
MOST_RED, MOST_BLUE, MOST_RED_TO_BLUE, BIAS, ZERO_WEIGHT, NEAR_WEIGHT, DECAY, SHARE = 128, 128, 63, 3.0, 3.0, 2.4, 0.6, 0.1
#: The steps of the search for blue, and where each looks.
BLUE_STEPS, AROUND, RED_ROUNDS = (16, 16, 8, 4, 2, 2, 2), ((0, -1), (0, 1), (-1, 0), (1, 0), (-1, -1), (-1, 1), (1, -1), (1, 1)), 6
SIZE = 2048


def index(v: np.ndarray) -> np.ndarray:
    """Signed values to places: 0, -1, 1, -2, 2 and so on."""
    return np.where(v >= 0, 2 * v, -2 * v - 1)


def bits(values: np.ndarray, known: np.ndarray) -> float:
    """Of signed values, alone and with those known, less what favours small ones."""
    own = np.bincount(index(values.ravel()), minlength=SIZE)
    both = own + known
    log = lambda n: float((n[n > 0] * np.log2(n[n > 0])).sum())
    whole = lambda n: float(n.sum() * np.log2(n.sum())) if n.sum() else 0.0
    near = NEAR_WEIGHT * DECAY ** np.arange(15)
    small = ZERO_WEIGHT * own[0] + float((near * (own[1:16] + own[255:240:-1])).sum())
    return whole(own) - log(own) + whole(both) - log(both) - SHARE * small


#: What each place adds to what favours small values.
_FAVOUR = np.zeros(SIZE)
_FAVOUR[0], _FAVOUR[1:16], _FAVOUR[255:240:-1] = ZERO_WEIGHT, NEAR_WEIGHT * DECAY ** np.arange(15), NEAR_WEIGHT * DECAY ** np.arange(15)


def _logs(n) -> np.ndarray:
    return n * np.log2(np.maximum(n, 1))


def many_bits(tries: np.ndarray, known: np.ndarray, logs: float) -> np.ndarray:
    """The bits of each row of values; logs: the sum of _logs(known). Only places that occur are looked at."""
    m, n = tries.shape
    cells, c = np.unique(index(tries) + SIZE * np.arange(m)[:, None], return_counts=True)
    row, place = cells // SIZE, cells % SIZE
    before = known[place]
    per = _logs(c) + _logs(before + c) - _logs(before) + SHARE * c * _FAVOUR[place]
    return _logs(n) + _logs(n + known.sum()) - logs - np.bincount(row, per, m)


class _Costs:
    """Of tries, each counted once, and together with those that are likely to follow."""

    def __init__(self, less, likeness, known):
        self._less, self._likeness, self._known, self._logs, self._seen = less, likeness, known, float(_logs(known).sum()), {}

    def __call__(self, k, ahead) -> float:
        if k not in self._seen:
            new = [q for q in dict.fromkeys((k, *ahead)) if q not in self._seen]
            found = many_bits(np.stack([self._less(q).ravel() for q in new]), self._known, self._logs)
            self._seen.update((q, round(float(v) - self._likeness(q), 6)) for q, v in zip(new, found))
        return self._seen[k]


def red_less(red, green, factor: int):
    return red - (factor * green >> 5)


def blue_less(blue, green, red, by_green: int, by_red: int):
    return blue - (by_green * green >> 5) - (by_red * red >> 5)


def _likeness(value: int, *others: int) -> float:
    return BIAS * sum(value == o for o in others)


def best_red(red, green, known, left, up) -> int:
    cost = _Costs(lambda k: red_less(red, green, k), lambda k: _likeness(k, left[0], up[0], 0), known)
    near = lambda best, step: [max(-MOST_RED, min(MOST_RED, best + d)) for s in range(step, RED_ROUNDS) for d in (-(32 >> s), 32 >> s)]
    best, least = 0, cost(0, near(0, 0))
    for step in range(RED_ROUNDS):
        for offset in (-(32 >> step), 32 >> step):
            k = max(-MOST_RED, min(MOST_RED, best + offset))
            if (got := cost(k, near(best, step))) < least:
                best, least = k, got
    return best


def best_blue(blue, green, red, known, left, up) -> tuple:
    cost = _Costs(lambda k: blue_less(blue, green, red, *k), lambda k: _likeness(k[0], left[1], up[1], 0) + _likeness(k[1], left[2], up[2], 0), known)
    to = lambda best, dg, dr, step: (max(-MOST_BLUE, min(MOST_BLUE, best[0] + dg * step)), max(-MOST_RED_TO_BLUE, min(MOST_RED_TO_BLUE, best[1] + dr * step)))
    near = lambda best, steps: [to(best, dg, dr, s) for s in steps for dg, dr in AROUND]
    best, least = (0, 0), cost((0, 0), near((0, 0), sorted(set(BLUE_STEPS))))
    for step in BLUE_STEPS:
        for dg, dr in AROUND:
            k = to(best, dg, dr, step)
            if (got := cost(k, near(best, (step,)))) < least:
                best, least = k, got
        if step == 2 and best == (0, 0):
            break
    return best


def chosen(planes: dict, size: int) -> tuple:
    """(multipliers of the tiles (row, column, 3): green to red, green to blue, red to blue; red and blue less them, signed).

    A pixel that repeats the two before it, or whose three last are those of the row above, adds nothing to what is known.
    """
    a, red, green, blue = (planes[c].astype(np.int64) for c in "argb")
    h, w = red.shape
    red_out, blue_out = red.copy(), blue.copy()
    th, tw = -(-h // size), -(-w // size)
    found = np.zeros((th, tw, 3), np.int64)
    known = [np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)]
    flat = lambda: np.stack([a.ravel(), red_out.ravel(), green.ravel(), blue_out.ravel()], -1)
    none, left = (0, 0, 0), (0, 0, 0)
    for ty in range(th):
        for tx in range(tw):
            up = tuple(found[ty - 1, tx]) if ty else none
            at = np.s_[ty * size : (ty + 1) * size, tx * size : (tx + 1) * size]
            to_red = best_red(red[at], green[at], known[0], left, up)
            to_blue = best_blue(blue[at], green[at], red[at], known[1], left, up)
            left = (to_red, *to_blue)
            found[ty, tx] = left
            red_out[at] = red_less(red[at], green[at], to_red)
            blue_out[at] = blue_less(blue[at], green[at], red[at], *to_blue)
            px = flat()
            ys, xs = np.mgrid[at[0].start : min(at[0].stop, h), at[1].start : min(at[1].stop, w)]
            i = (ys * w + xs).ravel()
            same = lambda d, e: (px[np.maximum(i - d, 0)] == px[np.maximum(i - e, 0)]).all(-1)  # noqa: E731, B023
            repeats = (i >= 2) & same(0, 1) & same(0, 2) | (i >= w + 2) & same(0, w) & same(1, w + 1) & same(2, w + 2)
            for k, v in enumerate((red_out, blue_out)):
                known[k] += np.bincount(index(v.ravel()[i[~repeats]]), minlength=SIZE)
    return found, red_out, blue_out


def best_multipliers(images: DataFrame, size: int) -> DataFrame:
    """image_id, across (tiles in a row) and the three multipliers of each tile, row by row."""
    names = ("green_to_red", "green_to_blue", "red_to_blue")

    def body(p):
        found, _, _ = chosen(p, size)
        return {"across": found.shape[1]} | {n: found[..., k] for k, n in enumerate(names)}

    return stencils.on_rasters(images, tuple("argb"), {"across": "long"} | dict.fromkeys(names, "array<long>"), body, ("image_id",))


def transformed(images: DataFrame, size: int) -> DataFrame:
    """image_id, w, h and the channels under each tile's best multipliers, modulo 256."""

    def body(p):
        _, red, blue = chosen(p, size)
        return {"a": p["a"], "r": red & 255, "g": p["g"], "b": blue & 255}

    return stencils.on_rasters(images, tuple("argb"), dict.fromkeys("argb", "array<long>"), body)
