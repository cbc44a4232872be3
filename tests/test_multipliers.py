"""Planted multipliers are found, choices are no worse than any next to them, and the transform can be undone."""

import math
from collections import Counter

import numpy as np

from glyphgrid.operators import grid, multipliers
from glyphgrid.plans.fixtures import images


def plain_bits(values, known):
    place = lambda v: 2 * v if v >= 0 else -2 * v - 1
    own = Counter(place(int(v)) for v in values)
    both = own + known
    entropy = lambda c: sum(c.values()) * math.log2(sum(c.values())) - sum(n * math.log2(n) for n in c.values()) if c else 0.0
    small = 3 * own[0] + sum(2.4 * 0.6 ** (i - 1) * (own[i] + own[256 - i]) for i in range(1, 16))
    return entropy(own) + entropy(both) - 0.1 * small


def test_bits_equal_the_plain_ones():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v, k = rng.integers(-300, 300, 40), rng.integers(-20, 20, 30)
        known = np.bincount(multipliers.index(k), minlength=multipliers.SIZE)
        assert abs(multipliers.bits(v, known) - plain_bits(v, Counter(multipliers.index(k).tolist()))) < 1e-9


def test_planted_multipliers_are_found():
    rng = np.random.default_rng(2)
    for planted in (-40, 0, 24, 57):
        green = rng.integers(0, 256, (16, 16))
        red = (planted * green >> 5) + 7
        none = (0, 0, 0)
        assert multipliers.best_red(red, green, np.zeros(multipliers.SIZE, int), none, none) == planted
    red, green = rng.integers(0, 256, (2, 16, 16))
    blue = (16 * green >> 5) + 3
    assert multipliers.best_blue(blue, green, red, np.zeros(multipliers.SIZE, int), none, none) == (16, 0)


def test_likeness_to_neighbours_decides_among_equals():
    flat = np.full((4, 4), 9)
    zero = np.zeros((4, 4), int)
    known = np.zeros(multipliers.SIZE, int)
    assert multipliers.best_red(flat, zero, known, (0, 0, 0), (0, 0, 0)) == 0
    assert multipliers.best_red(flat, zero, known, (32, 0, 0), (32, 0, 0)) == 32  # green is 0, so all cost the same but for the likeness


def test_transform_is_undone_and_steps_are_no_worse(spark):
    size = 4
    rasters = images(spark, "/root/testdata/sf0.001").filter("image_id in (0, 3, 4, 11)")
    before = {r.image_id: r for r in rasters.collect()}
    after = {r.image_id: r for r in multipliers.transformed(rasters, size).collect()}
    for r in multipliers.best_multipliers(rasters, size).collect():
        w, h = before[r.image_id].w, before[r.image_id].h
        was, now = ({c: np.array(x[r.image_id][c]).reshape(h, w) for c in grid.CHANNELS} for x in (before, after))
        of = np.stack([np.repeat(np.repeat(np.array(r[n]).reshape(-1, r.across), size, 0), size, 1)[:h, :w] for n in ("green_to_red", "green_to_blue", "red_to_blue")])
        red = (now["r"] + (of[0] * now["g"] >> 5)) & 255
        assert (red == was["r"]).all()
        assert ((now["b"] + (of[1] * now["g"] >> 5) + (of[2] * red >> 5)) & 255 == was["b"]).all()
        first = np.s_[:size, :size]
        none, known = (0, 0, 0), np.zeros(multipliers.SIZE, int)
        cost = lambda k: multipliers.bits(multipliers.red_less(was["r"][first], was["g"][first], k), known) - multipliers._likeness(k, 0, 0, 0)  # noqa: E731, B023
        taken = r.green_to_red[0]
        assert cost(taken) <= min(cost(max(-128, min(128, taken + d))) for d in (-1, 1)) + 1e-6 and none == (0, 0, 0)


def test_many_tries_at_once_cost_the_same():
    rng = np.random.default_rng(8)
    for n in (1, 30, 64):
        tries, known = rng.integers(-300, 300, (9, n)) // (1 + n % 7), rng.integers(0, 9, multipliers.SIZE) * rng.integers(0, 2, multipliers.SIZE)
        got = multipliers.many_bits(tries, known, float(multipliers._logs(known).sum()))
        assert np.allclose(got, [multipliers.bits(t, known) for t in tries], atol=1e-7)
