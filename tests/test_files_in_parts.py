"""Batches of files, in parts."""

import pytest

from glyphgrid.sources import files


@pytest.mark.parametrize("kind", ["PAM", "PNG"])
def test_a_large_batch_goes_on_in_parts(spark, monkeypatch, kind):
    """What a Python worker holds besides its batch is some pixels, not all rows of it in lists."""
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    runs, real = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: runs.append(run) or real(self, run, schema))
    df = spark.createDataFrame([(1, 8, 8, *[[255] * 64] * 4)], "image_id long, w int, h int, a array<long>, r array<long>, g array<long>, b array<long>")
    files.decoded(files.encoded(df, kind), ("image_id",))
    planes = [[[(7 * i + k * j) % 256 if k else 255 for j in range(64)] for i in range(3000)] for k in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([8] * 3000, pa.int32()), pa.array([8] * 3000, pa.int32()), *[pa.array(p, pa.list_(pa.int64())) for p in planes]], names=["image_id", "w", "h", *"argb"])
    made = list(runs[0](iter([batch])))
    assert [m.num_rows for m in made] == [1024, 1024, 952]
    whole = pa.Table.from_batches(made).combine_chunks()
    sent = pa.RecordBatch.from_arrays([whole["image_id"].combine_chunks(), pa.array([kind] * 2999 + ["GIF"]), whole["content"].combine_chunks()], names=["image_id", "_format", "_content"])
    got = list(runs[1](iter([sent])))
    assert [g.num_rows for g in got] == [1024, 1024, 952]
    table = pa.Table.from_batches(got)
    assert table["image_id"].to_pylist() == list(range(3000)) and table["error"].to_pylist() == [None] * 2999 + ["unsupported feature"]
    assert all(table[c].to_pylist() == [*p[:2999], None] for c, p in zip("argb", planes))
