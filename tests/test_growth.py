"""Work that grew much faster than its input: these end in seconds, and took minutes when they did it again for each element."""

import random
import time

from pyspark.sql import functions as F

from glyphgrid.operators import composite, histo
from glyphgrid.streaming import animation


def within(seconds: float, build):
    """Its rows, in so many seconds; the first run warms up."""
    begun = time.monotonic()
    got = build().collect()
    assert time.monotonic() - begun < seconds
    return got


def plain_cumulated(counts: list, table: int = histo.TABLE) -> list:
    whole, upto, bounds = sum(counts), 0, [0]
    for c in counts:
        upto += c
        bounds.append(upto * table // whole)
    return [b - a for a, b in zip(bounds, bounds[1:])]


def test_cumulated_histograms_of_many_symbols(spark):
    rng = random.Random(2)
    rows = [([rng.choice([0, 1, 5, 300]) for _ in range(192)], [rng.choice([0, 1, 2]) for _ in range(192)]) for _ in range(20)]
    df = spark.createDataFrame(rows, "c array<long>, d array<long>").coalesce(1)
    got = within(20, lambda: df.select("c", "d", histo.cumulated(F.col("c")).alias("p"), histo.l1_distance(histo.cumulated(F.col("c")), histo.cumulated(F.col("d"))).alias("l1")))
    for r in got:
        p, q = plain_cumulated(r.c), plain_cumulated(r.d)
        assert r.p == p and abs(r.l1 - sum(abs(a - b) for a, b in zip(p, q)) / (192 * histo.TABLE)) < 1e-12


def plain_by_deltas(left: list, weight: int) -> list:
    left, last, out = list(left), (0, 0, 0, 0), []
    while left:
        far = [sum(abs(p - q) for p, q in zip(c[1:], last[1:])) * weight + abs(c[0] - last[0]) * (256 - weight) for c in left]
        k = far.index(min(far))
        last, left[k] = left[k], left[0]
        left = left[1:]
        out.append(last)
    return out


def test_large_palettes_by_deltas(spark):
    rng = random.Random(1)
    rows = [(sorted({tuple(rng.randrange(256) for _ in range(4)) for _ in range(200)}),) for _ in range(8)]
    df = spark.createDataFrame(rows, "p array<struct<a:long,r:long,g:long,b:long>>").coalesce(1)
    got = within(8, lambda: df.select("p", composite.sorted_by_deltas(F.col("p"), 192).alias("out")))
    for r in got:
        assert [tuple(c) for c in r.out] == plain_by_deltas([tuple(c) for c in r.p], 192)


def test_single_bytes_are_joined_before_they_are_shuffled(spark):
    content = bytes(random.Random(3).randrange(256) for _ in range(5000))
    single = spark.createDataFrame([(k, content) for k in (5, 6)], "anim_id long, content binary").coalesce(1)
    got = animation.joined(animation.chunks(single, 1)).orderBy("anim_id", "seq").collect()
    assert len(got) <= 4
    assert [b"".join(bytes(r.bytes) for r in got if r.anim_id == k) for k in (5, 6)] == [content] * 2
    gaps = spark.createDataFrame([(1, k, b"x") for k in (4, 5, 7, 6, 0)], "anim_id long, seq long, bytes binary").coalesce(1)
    assert [(r.seq, bytes(r.bytes)) for r in animation.joined(gaps).collect()] == [(4, b"xx"), (7, b"x"), (6, b"x"), (0, b"x")]


def test_a_long_rest_is_not_copied_for_each_step():
    source, begun = animation.Source(bytes(1 << 24)), time.monotonic()
    for _ in range(4000):
        assert source.try_read(16)
        source.commit()
    assert time.monotonic() - begun < 2 and len(source.held) == (1 << 24) - 64000
