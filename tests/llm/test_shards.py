import zlib

from glyphgrid.llm import shards


def jump(key, n):
    """The function as published."""
    key %= 2**64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_equals_the_published_function(spark):
    keys = [*range(300), -1, -7, 2**63 - 1, -(2**63), 10**12, None, 5, 5]
    texts = [None, "", "é", "same"]
    rows = [(k, texts[i % 4], "z") for i, k in enumerate(keys)]
    got = shards.shard_by_key(spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5), 16).collect()
    assert len(got) == len(rows)
    for r in got:
        key = -1 if r.doc_id is None else r.doc_id
        assert (r.shard, r.grown_shard) == (jump(key, 16), jump(key, 17)) and r.law == "key"
        assert r.grown_shard in (r.shard, 16)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert shards.shard_by_key(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_shard(spark):
    got = shards.shard_by_key(spark.range(50).selectExpr("id as doc_id", "'t' as text"), 1).collect()
    assert {r.shard for r in got} == {0} and {r.grown_shard for r in got} == {0, 1}
