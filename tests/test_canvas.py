"""Canvases from chunks against painting whole frames: any cut, in a batch, as a stream, and as one that is stopped and started again."""

import random
import time

import numpy as np
import pytest

from glyphgrid.streaming import animation, canvas

W, H = 9, 7


def some_frames(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y = rng.randrange(W), rng.randrange(H)
        w, h = rng.randint(0 if k % 5 == 3 else 1, W - x), rng.randint(1, H - y)
        a = rng.choice([0, 100, 255])
        pixels = np.array([[a, *(rng.randrange(a + 1) for _ in range(3))] for _ in range(w * h)], np.uint8).reshape(h, w, 4)
        out.append((rng.choice([0, 4, 9]) if k < n - 1 else 5, k == 0 or rng.random() < 0.25, rng.random() < 0.5, x, y, w, h, pixels))
    return out


def content(frames):
    rows = [animation.HEAD.pack(animation.MAGIC, W, H)]
    for k, (duration, disposes, blends, x, y, w, h, p) in enumerate(frames):
        rows += [animation.FRAME.pack(disposes + 2 * (k == len(frames) - 1) + 4 * blends, duration, x, y, w, h, p.size), p.tobytes()]
    return b"".join(rows)


def painted(frames):
    """Pixel by pixel."""
    board, out, final = {}, [], 0
    for k, (duration, disposes, blends, x, y, w, h, p) in enumerate(frames):
        if disposes:
            board = {(j, i): (255,) * 4 for j in range(H) for i in range(W)}
        for j in range(h):
            for i in range(w):
                new = tuple(int(v) for v in p[j, i])
                if blends:
                    under = [(255 - new[0]) * v for v in board[y + j, x + i]]
                    new = tuple(min(255, v + ((u + u // 256 + 128) // 256)) for v, u in zip(new, under))
                board[y + j, x + i] = new
        if duration:
            out.append((final, k, duration, bytes(v for j in range(H) for i in range(W) for v in board[j, i])))
            final += 1
    return out


@pytest.mark.parametrize("size", [1, 7, 512])
def test_any_cut_gives_the_same_and_areas_only_grow(size):
    for seed in range(6):
        frames = some_frames(10, seed)
        data, c, got, area = content(frames), canvas.Canvas(), [], (0, 0)
        for i in range(0, len(data), size):
            c = canvas.Canvas.unpacked(*c.packed())  # as between micro-batches
            got += [(*f, c.pixels.tobytes()) for f in c.feed(data[i : i + size])]
            frame, strips, begun, rows = c.area
            assert c.stage == canvas.DONE or (frame, strips * canvas.STRIP + begun) >= area and rows <= H
            area = frame, strips * canvas.STRIP + begun
        assert got == painted(frames) and c.stage == canvas.DONE


def test_broken_streams():
    data = content(some_frames(3, 1))
    for bad in (b"XXXX" + bytes(20), animation.HEAD.pack(animation.MAGIC, 1 << 20, 1 << 20), data[:12] + b"\x00" + data[13:], data[:12] + animation.FRAME.pack(1, 1, 0, 0, W, H, 3) + bytes(3)):
        c = canvas.Canvas()
        assert not list(c.feed(bad)) and c.stage == canvas.FAILED
        assert not list(c.feed(data))


def pieces_of(wanted, size):
    return [(k, i // size, bytearray(data[i : i + size])) for k, frames in wanted.items() for data in [content(frames)] for i in range(0, len(data), size)]


SCHEMA = "anim_id long, seq long, bytes binary"


def test_stream_that_is_stopped_and_started_again(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    wanted = {k: some_frames(8, 20 + k) for k in range(3)}
    expected = sorted((k, *row[:3], W, H, row[3]) for k, frames in wanted.items() for row in painted(frames))
    batch = spark.createDataFrame(pieces_of(wanted, 50), SCHEMA)
    assert sorted((*r[:6], bytes(r[6])) for r in canvas.canvases(batch).collect()) == expected
    pieces = pieces_of(wanted, 50)
    rng = random.Random(4)
    pieces += rng.sample(pieces, 6)
    rng.shuffle(pieces)
    cut = len(pieces) // 2

    def write(n, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run():
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = canvas.canvases_as_they_come(source, None).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(180)

    write(0, pieces[:cut])
    run()
    write(1, pieces[cut:])
    run()
    write(2, pieces[:5])  # of streams that have ended: passed over
    run()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((*r[:6], bytes(r[6])) for r in got) == expected


def test_idle_streams_are_given_up(spark, tmp_path):
    """The second half comes after the state has gone, so its frames never come out; a stream that is whole at once does."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    pieces = pieces_of({1: some_frames(6, 31)}, 60)
    for n, rows in enumerate((pieces[: len(pieces) // 2], pieces_of({2: some_frames(6, 32)}, 60))):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = canvas.canvases_as_they_come(source, 1500).writeStream.format("memory").queryName("given_up").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(processingTime="1 second").start()
    first, second = pieces[: len(pieces) // 2], pieces[len(pieces) // 2 :]

    def wait(n_rows):
        deadline = time.time() + 60
        while time.time() < deadline and sum(p["numInputRows"] for p in query.recentProgress) < n_rows:
            time.sleep(0.5)

    try:
        n = len(first) + len(pieces_of({2: some_frames(6, 32)}, 60))
        wait(n)
        time.sleep(6)
        spark.createDataFrame(second, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/9")
        wait(n + len(second))
    finally:
        query.stop()
    rows = spark.table("given_up").collect()
    whole = len(painted(some_frames(6, 31)))
    assert sum(r.anim_id == 2 for r in rows) == len(painted(some_frames(6, 32))) and sum(r.anim_id == 1 for r in rows) < whole


def test_smallest_deltas(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        rects = [(x, y, rng.randint(1, 20 - x), rng.randint(1, 20 - y)) for x, y in ((rng.randrange(20), rng.randrange(20)) for _ in range(rng.randrange(4)))]
        rows.append((k, 20, 20, rects if k else [(0, 0, 20, 20)]))
    table = spark.createDataFrame(rows, "k long, w long, h long, rects array<struct<x: long, y: long, w: long, h: long>>")
    got = {r.k: (r.kept, r.n_bytes) for r in canvas.smallest_deltas(table).collect()}
    for k, w, h, rects in rows:
        rects = rects or [(0, 0, 1, 1)]
        size = lambda n, area: n * canvas.FRAME_BYTES + 4 * area
        kept = ("as_is", size(len(rects), sum(r[2] * r[3] for r in rects)))
        if rects == [(0, 0, w, h)]:
            kept = ("full", size(1, w * h))
        else:
            box = (max(r[0] + r[2] for r in rects) - min(r[0] for r in rects)) * (max(r[1] + r[3] for r in rects) - min(r[1] for r in rects))
            if len(rects) > 1 and size(1, box) < kept[1]:
                kept = ("bounding", size(1, box))
            if size(1, w * h) < kept[1]:
                kept = ("full", size(1, w * h))
        assert got[k] == kept
    assert {v[0] for v in got.values()} == {"as_is", "bounding", "full"}
