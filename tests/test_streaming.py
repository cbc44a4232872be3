"""Frames from chunks: the same for every way of cutting, in a batch and as a stream."""

import random

import pytest

from glyphgrid.streaming import animation


def some_frames(n, seed):
    rng = random.Random(seed)
    return [(rng.randint(0, 9) if k < n - 1 else 5, k == 0 or rng.random() < 0.2, rng.randint(0, 3), 0, 1 + rng.randint(0, 4), 2, bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 30, 700])))) for k in range(n)]


@pytest.mark.parametrize("size", [1, 7, 512, 10**6])
def test_any_cut_gives_the_same(size):
    frames = some_frames(12, 1)
    data = animation.encoded(frames, 8, 2)
    reader, got = animation.Reader(), []
    for i in range(0, len(data), size):
        # The state goes through its parts, as between micro-batches.
        reader = animation.Reader(reader.stage, reader.frame_idx, reader.width, reader.height, reader.held)
        got += reader.feed(data[i : i + size])
    assert [(f[1], f[2], f[3], f[4], f[5], f[6], f[7]) for f in got] == [(d, k, x, y, w, h, len(p)) for d, k, x, y, w, h, p in frames]
    assert reader.stage == animation.DONE and not reader.held and not list(reader.feed(b"more"))


def test_broken_streams():
    frames = some_frames(3, 2)
    for data in (b"XXXX" + bytes(20), animation.encoded(frames, 2, 1), animation.encoded([(5, False, 0, 0, 1, 1, b"")], 8, 2), animation.encoded([(0, True, 0, 0, 1, 1, b"")], 8, 2)):
        reader = animation.Reader()
        assert not list(reader.feed(data)) and reader.stage == animation.FAILED
    whole = animation.encoded(frames, 8, 2)
    reader = animation.Reader()
    assert len(list(reader.feed(whole[:-1]))) < 3 and reader.stage != animation.DONE


def test_source():
    s = animation.Source(b"ab")
    assert s.try_read(1) == b"a" and s.try_read(2) is None
    s.append(b"c")
    assert s.try_read(2) == b"bc"
    s.take_back()
    assert s.try_read(3) == b"abc"
    s.commit()
    assert s.held == b""


def test_stream_of_files(spark, tmp_path):
    """Chunks in files, out of order and some of them twice."""
    wanted = {k: some_frames(6, k) for k in range(4)}
    pieces = []
    for k, frames in wanted.items():
        data = animation.encoded(frames, 8, 2)
        pieces += [(k, i // 100, data[i : i + 100]) for i in range(0, len(data), 100)]
    batch = spark.createDataFrame([(k, s, bytearray(b)) for k, s, b in pieces], "anim_id long, seq long, bytes binary")
    expected = sorted(map(tuple, animation.read_frames(batch).collect()))
    assert len(expected) == 24
    rng = random.Random(3)
    pieces += rng.sample(pieces, 5)
    rng.shuffle(pieces)
    half = len(pieces) // 2
    for n, part in enumerate((pieces[:half], pieces[half:])):
        spark.createDataFrame([(k, s, bytearray(b)) for k, s, b in part], "anim_id long, seq long, bytes binary").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema("anim_id long, seq long, bytes binary").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = animation.read_frames_as_they_come(source).writeStream.format("memory").queryName("frames_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("frames_out").collect())) == expected
