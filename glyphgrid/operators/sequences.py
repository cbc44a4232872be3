"""Order-dependent parses: references to earlier pixels, colour caches, move-to-front lists and groups of rectangles.

Each works on one image or stream, so rows are independent and go through pandas batch by batch.
"""

import pandas as pd
from pyspark.sql import DataFrame

#: Shortest and longest copy; the hash multiplier of colour caches.
SHORTEST, LONGEST = 4, 1 << 14


def _run(a: list, i: int, j: int, most: int) -> int:
    n = 0
    while n < most and a[i + n] == a[j + n]:
        n += 1
    return n


def run_parse(px: list, width: int, shortest: int = SHORTEST, longest: int = LONGEST) -> list:
    """(kind, place, length, distance) of copies from the pixel before or the row above, the longer one, else literals."""
    out, i, n = [("literal", 0, 1, 0)] if px else [], 1, len(px)
    while i < n:
        most = min(n - i, longest)
        before = _run(px, i, i - 1, most)
        above = _run(px, i, i - width, most) if i >= width else 0
        if before >= above and before >= shortest:
            out.append(("copy", i, before, 1))
        elif above >= shortest:
            out.append(("copy", i, above, width))
        else:
            out.append(("literal", i, 1, 0))
        i += out[-1][2]
    return out


def replayed(parse: list, px: list) -> list:
    """The pixels from a parse; literals are read from px."""
    out: list = []
    for kind, place, length, distance in parse:
        for k in range(length):
            out.append(px[place] if kind == "literal" else out[place + k - distance])
    return out


def recency(px: list, size: int) -> list:
    """Place of each colour in a bounded list of the latest distinct ones, or -1; it moves to the front, and the last is lost."""
    held, out = [], []
    for c in px:
        at = held.index(c) if c in held else -1
        out.append(at)
        if at >= 0:
            held.pop(at)
        held.insert(0, c)
        del held[size:]
    return out


def move_to_front(symbols: list, size: int) -> list:
    """Place of each symbol in a list of all that starts in order."""
    held, out = list(range(size)), []
    for s in symbols:
        at = held.index(s)
        out.append(at)
        held.insert(0, held.pop(at))
    return out


def _united(p: tuple, q: tuple) -> tuple:
    x, y = min(p[0], q[0]), min(p[1], q[1])
    return x, y, max(p[0] + p[2], q[0] + q[2]) - x, max(p[1] + p[3], q[1] + q[3]) - y


def _growth(p: tuple, q: tuple) -> int:
    u = _united(p, q)
    return max(0, u[2] * u[3] - p[2] * p[3] - q[2] * q[3])


def covering(points: list, most: int) -> list:
    """At most so many rectangles that cover the points, which come one after the other.

    A point outside all is a new one. Two are merged where that adds no area, the last ones first and on from the
    result; where there are too many, the pair that adds least, the first among equals.
    """
    held: list = []

    def merge(i: int, j: int) -> int:
        i, j = min(i, j), max(i, j)
        held[i] = _united(held[i], held[j])
        last = held.pop()
        if j < len(held):
            held[j] = last
        return i

    def settle(i: int) -> None:
        while True:
            other = next((k for k in range(len(held) - 1, -1, -1) if k != i and _growth(held[k], held[i]) == 0), None)
            if other is None:
                return
            i = merge(other, i)

    for x, y in points:
        if any(r[0] <= x < r[0] + r[2] and r[1] <= y < r[1] + r[3] for r in held):
            continue
        held.append((x, y, 1, 1))
        settle(len(held) - 1)
        if len(held) > most:
            _, i, j = min((_growth(held[i], held[j]), i, j) for i in range(len(held)) for j in range(i + 1, len(held)))
            settle(merge(i, j))
    return held


def bounding(rectangles: list) -> tuple:
    """The rectangle around all; without any, all zeros."""
    out = rectangles[0] if rectangles else (0, 0, 0, 0)
    for r in rectangles[1:]:
        out = _united(out, r)
    return out


def cumulative_area(rectangles: list) -> int:
    """What overlaps counts twice."""
    return sum(w * h for _, _, w, h in rectangles)


def covered(points: DataFrame, most: int) -> DataFrame:
    """points (image_id, y, x) to rows (image_id, k, x, y, w, h): the group of each image's points in raster order."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"])
        found = covering(list(zip(f["x"].tolist(), f["y"].tolist())), most)
        return pd.DataFrame([(f["image_id"].iloc[0], k, *r) for k, r in enumerate(found)], columns=["image_id", "k", "x", "y", "w", "h"])

    return points.groupBy("image_id").applyInPandas(fit, "image_id long, k long, x long, y long, w long, h long")


def parsed(images: DataFrame, channel: str) -> DataFrame:
    """image_id, k, kind, place, length, distance: the parse of one channel of each image."""

    def run(frames):
        for f in frames:
            rows = [(i, k, *p) for i, w, v in zip(f["image_id"], f["w"], f["v"]) for k, p in enumerate(run_parse(list(v), w))]
            yield pd.DataFrame(rows, columns=["image_id", "k", "kind", "place", "length", "distance"])

    return images.selectExpr("image_id", "w", f"{channel} AS v").mapInPandas(run, "image_id long, k long, kind string, place long, length long, distance long")


def listed(images: DataFrame, channel: str, size: int, whole: bool = False) -> DataFrame:
    """image_id and ``places``: those of recency, or of move_to_front if whole."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"image_id": f["image_id"], "places": [(move_to_front if whole else recency)(list(v), size) for v in f["v"]]})

    return images.selectExpr("image_id", f"{channel} AS v").mapInPandas(run, "image_id long, places array<long>")
