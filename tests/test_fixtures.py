"""Images are made of vectors by many tasks, whatever the file's row groups, and windows of planes are cut out right."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import functions as F

from glyphgrid.operators import stencils
from glyphgrid.plans import fixtures


def written(path, ids: list, vectors: list) -> str:
    """One file of one row group."""
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * len(ids), pa.int32())})
    pq.write_table(table, path / "embeddings.parquet", row_group_size=len(ids))
    return str(path)


def test_images_of_one_row_group_are_made_by_many_tasks(spark, tmp_path):
    n = 600
    at = written(tmp_path, list(range(n)), list(np.random.default_rng(3).uniform(-1, 1, (n, 64)).astype(np.float32)))
    for make in (fixtures.raw_images, fixtures.images):
        shares = [r["count"] for r in make(spark, at).select("image_id", F.size("b"), F.spark_partition_id().alias("task")).groupBy("task").count().collect()]
        assert sum(shares) == n and max(shares) < n / 2


def plain_images(k: int, vector: list | None) -> tuple:
    """(w, h, colours, premultiplied colours) pixel after pixel; None where a value is None."""
    w, h = fixtures.WIDTHS[k % 8], fixtures.HEIGHTS[k % 8]
    raw, out = {c: [] for c in "argb"}, {c: [] for c in "argb"}
    for i in range(w * h):
        x = vector[i % 64] if vector is not None and i % 64 < len(vector) else None
        v = None if x is None else math.floor((x + 1) * 128)
        of = {"a": 255 if k % 2 == 0 else None if v is None else 3 * v % 256, "r": v, "g": None if v is None else (7 * v + 13 * (i % w)) % 256, "b": None if v is None else (11 * v + 29 * (i // w)) % 256}
        for c, u in of.items():
            raw[c].append(u)
            product = None if u is None or of["a"] is None else u * of["a"]
            out[c].append(u if c == "a" or product is None or of["a"] == 255 else (product + product // 256 + 128) // 256)
    return w, h, raw, out


def test_images_are_those_of_plain_python(spark, tmp_path):
    rng = np.random.default_rng(8)
    vectors = {k: [float(np.float32(v)) for v in rng.uniform(-1, 1, 64)] for k in range(16)}
    vectors |= {16: None, 17: None, 18: [], 19: [0.5] * 10, 20: [None, 0.25] * 32, 21: [None, 0.25] * 32, 23: [-1.0, 0.75] * 40}
    at = written(tmp_path, [*vectors, None], [*vectors.values(), [0.5] * 64])
    for make, which in ((fixtures.raw_images, 2), (fixtures.images, 3)):
        got = {r.image_id: r for r in make(spark, at).collect()}
        assert len(got) == len(vectors) + 1 and got[None].w is None and got[None].r is None
        for k, v in vectors.items():
            expected = plain_images(k, v)
            assert (got[k].w, got[k].h) == expected[:2] and all(got[k][c] == expected[which][c] for c in "argb")


def test_windows_of_whole_rows_and_others(spark):
    planes = {(h, w): np.arange(h * w).reshape(h, w) for h, w in ((1, 6), (6, 1), (3, 4), (1, 1))}
    rows = [(ih, iw, y, x, h, w, p.ravel().tolist()) for (ih, iw), p in planes.items() for y in range(ih) for x in range(iw) for h in range(1, ih - y + 1) for w in range(1, iw - x + 1)]
    df = spark.createDataFrame(rows, "ih int, iw int, y int, x int, h int, w int, v array<long>")
    got = df.select("*", stencils.part("v", "iw", *[F.col(c) for c in "yxhw"]).alias("cut")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.cut == planes[r.ih, r.iw][r.y : r.y + r.h, r.x : r.x + r.w].ravel().tolist()
