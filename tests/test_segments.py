"""Hole filling on planted labels and against another way of saying it; segments by their centres."""

import random

import numpy as np

from glyphgrid.operators import segments
from glyphgrid.plans import filters


def plain(label, flat):
    h, w = len(label), len(label[0])
    board = {}
    for y in range(h):
        for x in range(w):
            board[y, x] = (board.get((y, x - 1)) if x else board.get((y - 1, x), 0)) if flat[y][x] else label[y][x]
    for _ in range(5):
        before = dict(board)
        for y in range(h):
            for x in range(w):
                near = [board[p] for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if p in board]
                ones, zeros = sum(near), len(near) - sum(near)
                if not board[y, x] and ((len(near) >= 3 and zeros <= 1) or zeros == 0):
                    board[y, x] = 1
                elif board[y, x] and ((len(near) >= 3 and ones <= 1) or ones == 0):
                    board[y, x] = 0
        if board == before:
            break
    return [[int(board[y, x]) for x in range(w)] for y in range(h)]


def test_planted_holes_go():
    label = np.ones((6, 7), int)
    label[2, 3] = label[4, 5] = 0
    assert segments.filled(label, np.zeros((6, 7), bool)).all()
    label = np.zeros((5, 5), int)
    label[1:4, 1:4] = 1
    assert (segments.filled(label, np.zeros((5, 5), bool)) == label).all()  # a square stays


def test_random_labels():
    rng = random.Random(6)
    for _ in range(300):
        h, w = rng.randint(1, 9), rng.randint(1, 9)
        label = [[rng.randrange(2) for _ in range(w)] for _ in range(h)]
        flat = [[int(rng.random() < 0.2) for _ in range(w)] for _ in range(h)]
        assert segments.filled(np.array(label), np.array(flat) > 0).tolist() == plain(label, flat)


def test_labels_of_the_tables(spark):
    folder = "/root/testdata/sf0.001"
    before = {r.image_id: r for r in filters.block_labels(spark, folder).collect()}
    after = {r.image_id: r for r in segments.with_filled_holes(filters.block_labels(spark, folder)).collect()}
    assert set(before) == set(after)
    for k, r in before.items():
        grid = lambda v: np.array(v).reshape(r.h, r.w).tolist()  # noqa: E731, B023
        assert grid(after[k].label) == plain(grid(r.label), grid(r.flat))


def test_segments_go_up_with_the_risk(spark):
    rows = filters.QUERIES["o9_12_segments"].frame(spark, "/root/testdata/sf0.001").collect()
    assert len({r.segment for r in rows}) > 1
    of: dict = {}
    for r in rows:
        assert of.setdefault((r.image_id, r.score), r.segment) == r.segment
    for (image, score), segment in of.items():
        assert all(other >= segment for (i, s), other in of.items() if i == image and s > score)
