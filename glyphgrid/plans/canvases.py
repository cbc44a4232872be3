"""Queries on canvases of animations that arrive in chunks, with DuckDB SQL that knows no chunks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphgrid.functions.fixed import idiv
from glyphgrid.operators import grid, predict, sequences
from glyphgrid.plans.fixtures import frames, images, pairs
from glyphgrid.plans.query import Query
from glyphgrid.streaming import animation, canvas

QUERIES: dict = {}
#: Frames of the fixture lie at 0 to 12 by 0 to 6 and have up to 5 by 6 pixels.
WIDTH, HEIGHT, CHUNK = 17, 12, 100


def query(name: str, build, sql: str, needs: str, ints: str = "", **kinds) -> None:
    QUERIES[name] = Query(build, sql, tuple(needs.split()), ints, **kinds)


def painted(s, d):
    """Streams of the frames with opaque pixels."""
    v = lambda i: (F.col("frame_idx") * 31 + (i % F.col("w")) * 7 + idiv(i, F.col("w")) * 13) % 256
    # A fixed table of the 256 pixels: it is a literal, and no pixel's text is built for each frame.
    texts = F.array(*[F.lit(f"FF{k:02X}{3 * k % 256:02X}{5 * k % 256:02X}") for k in range(256)])
    pixel = lambda i: F.get(texts, v(i).cast("int"))
    rows = frames(s, d).withColumn("pixels", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), (F.col("w") * F.col("h") - 1).cast("int")), pixel), "")))
    return canvas.painted_streams(rows.withColumn("blends", F.lit(False)), WIDTH, HEIGHT)


def weighed(canvases):
    """Canvases as sums of their values, each times its place from 1."""

    def run(batches):
        for batch in batches:
            sums = []
            for data in batch.column(4).to_pylist():
                v = np.frombuffer(data, np.uint8).reshape(-1, 4).astype(np.int64)
                sums.append((v * np.arange(1, len(v) + 1)[:, None]).sum(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array([int(x[k]) for x in sums], pa.int64()) for k in range(4)]], names=["anim_id", "final_idx", "frame_idx", "duration_ms", *grid.CHANNELS])

    return canvases.select("anim_id", "final_idx", "frame_idx", "duration_ms", "canvas").mapInArrow(run, "anim_id long, final_idx long, frame_idx long, duration_ms long, a long, r long, g long, b long")


_F = "f AS (SELECT * EXCLUDE (duration_ms), greatest(duration_ms, CASE WHEN frame_idx = max(frame_idx) OVER (PARTITION BY anim_id) THEN 1 ELSE 0 END) AS duration_ms FROM frames)"
_ALL = WIDTH * HEIGHT * (WIDTH * HEIGHT + 1) // 2 * 255
_CANVAS = (
    f"WITH {_F}, fin AS (SELECT *, sum(CASE WHEN duration_ms > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY anim_id ORDER BY frame_idx) - 1 AS final_idx, max(CASE WHEN disposes THEN frame_idx END) OVER (PARTITION BY anim_id ORDER BY frame_idx) AS since FROM f), "
    f"px AS (SELECT anim_id, frame_idx, (y + i // w) * {WIDTH} + x + i % w + 1 AS place, (frame_idx * 31 + i % w * 7 + i // w * 13) % 256 AS v FROM (SELECT *, unnest(range(0, w * h)) AS i FROM f)), "
    "top AS (SELECT g.anim_id, g.final_idx, g.frame_idx, g.duration_ms, p.place, arg_max(p.v, p.frame_idx) AS v FROM fin g JOIN px p ON p.anim_id = g.anim_id AND p.frame_idx BETWEEN g.since AND g.frame_idx WHERE g.duration_ms > 0 GROUP BY ALL) "
    f"SELECT anim_id, final_idx, frame_idx, duration_ms, {_ALL} AS a, {_ALL} + sum(place * (v - 255)) AS r, {_ALL} + sum(place * (v * 3 % 256 - 255)) AS g, {_ALL} + sum(place * (v * 5 % 256 - 255)) AS b FROM top GROUP BY ALL"
)
_COLUMNS = "anim_id final_idx frame_idx duration_ms a r g b"
query("o15_18_canvases", lambda s, d: weighed(canvas.canvases(animation.chunks(painted(s, d), CHUNK))), _CANVAS, "frames", _COLUMNS)
query("o15_18_canvases_of_single_bytes", lambda s, d: weighed(canvas.canvases(animation.chunks(painted(s, d), 1))), _CANVAS, "frames", _COLUMNS)
query(
    "o15_14_decoded_areas",
    lambda s, d: canvas.areas(animation.chunks(painted(s, d), CHUNK)),
    f"WITH {_F}, o AS (SELECT *, 12 + sum(25 + 4 * w * h) OVER (PARTITION BY anim_id ORDER BY frame_idx) AS fin, 12 + sum(25 + 4 * w * h) OVER (PARTITION BY anim_id ORDER BY frame_idx) - 4 * w * h AS body FROM f), "
    f"t AS (SELECT anim_id, max(fin) AS total, count(*) AS n FROM o GROUP BY anim_id), c AS (SELECT anim_id, total, n, seq, least(total, (seq + 1) * {CHUNK}) AS got FROM (SELECT *, unnest(range(0, ((total + {CHUNK - 1}) // {CHUNK})::BIGINT)) AS seq FROM t)), "
    "k AS (SELECT c.anim_id, c.seq, c.got, c.n, count(o.frame_idx) AS whole FROM c LEFT JOIN o ON o.anim_id = c.anim_id AND o.fin <= c.got GROUP BY ALL), "
    "r AS (SELECT k.anim_id, k.seq, k.whole, k.n, CASE WHEN k.got >= o.body THEN (k.got - o.body) // (4 * o.w) END AS rows, o.duration_ms, o.y FROM k LEFT JOIN o ON o.anim_id = k.anim_id AND o.frame_idx = k.whole) "
    f"SELECT anim_id, seq, CASE WHEN whole = n THEN n - 1 ELSE whole END AS frame_idx, coalesce(rows, 0) // {canvas.STRIP} AS strips, coalesce(rows, 0) % {canvas.STRIP} AS begun_rows, CASE WHEN whole = n THEN {HEIGHT} WHEN rows IS NULL OR duration_ms = 0 THEN 0 ELSE y + rows END AS area_rows FROM r",
    "frames",
    "anim_id seq frame_idx strips begun_rows area_rows",
)


def _deltas(s, d):
    """Frames that differ from the one before in a few places: its values there are within the limit elsewhere."""
    rects = sequences.covered(predict.changed(pairs(s, d), 20.0), 3)
    sets = rects.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y", "w", "h"))), lambda r: F.struct(*[r[c].cast("long").alias(c) for c in "xywh"])).alias("rects"))
    sizes = pairs(s, d).select("image_id", "w", "h")
    rows = sizes.join(sets, "image_id", "left").withColumn("rects", F.coalesce("rects", F.array().cast("array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>")))
    return canvas.smallest_deltas(rows).select("image_id", F.size("rects").alias("n"), "as_is", "bounding", F.col("full").alias("whole"), "n_bytes", "kept")


query("o15_21_smallest_delta", _deltas, "", "", "image_id n as_is bounding whole n_bytes", strings="kept")
