"""Files that grow: each byte once, whenever a query is stopped and started again, and another way to fetch them."""

import os
import time

import pytest

from glyphgrid.sources import growing


def test_ranges_cover_what_is_new():
    found = [(r.name, r.at, r.size) for r in growing.ranges({"a": 3, "b": 5}, {"a": 10, "b": 5, "c": 2}, 4)]
    assert found == [("a", 3, 4), ("a", 7, 3), ("c", 0, 2)]
    assert growing.ranges({}, {}, 4) == []


def pasted(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.file, r.at)):
        assert r.at == len(out.get(r.file, b""))  # no gap and no overlap
        out[r.file] = out.get(r.file, b"") + bytes(r.bytes)
    return out


def append(folder, name, data):
    with open(f"{folder}/{name}", "ab") as f:
        f.write(data)


def test_query_that_is_stopped_and_started_again(spark, tmp_path):
    spark.dataSource.register(growing.GrowingFiles)
    folder = str(tmp_path / "in")
    os.mkdir(folder)
    wanted = {"a": b"", "b": b""}

    def grow(name, data):
        append(folder, name, data)
        wanted[name] += data

    def run():
        source = spark.readStream.format("growing_files").option("path", f"file://{folder}").option("rangeBytes", "7").load()
        query = source.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
        try:
            total, deadline = sum(map(len, wanted.values())), time.time() + 60
            while time.time() < deadline:
                time.sleep(0.5)
                found = spark.read.schema("file string, at long, bytes binary").parquet(f"{tmp_path}/out").collect() if os.path.exists(f"{tmp_path}/out") else []
                if query.exception() or sum(len(r.bytes) for r in found) >= total:
                    break
        finally:
            query.stop()

    grow("a", bytes(range(20)))
    run()
    grow("a", b"more")
    grow("b", b"another one" * 5)
    run()
    grow("b", b"!")
    run()
    assert pasted(spark.read.parquet(f"{tmp_path}/out").collect()) == wanted
    batch = spark.read.format("growing_files").option("path", f"file://{folder}").load()
    assert pasted(batch.collect()) == wanted


class InMemory(growing.Fetch):
    def sizes(self):
        return {"x": 5}

    def read(self, name, at, size):
        return b"hello"[at : at + size]


class OwnFetch(growing.GrowingFiles):
    @classmethod
    def name(cls):
        return "own_fetch"

    def fetch(self):
        return InMemory("")


def test_another_fetch(spark):
    spark.dataSource.register(OwnFetch)
    assert pasted(spark.read.format("own_fetch").option("rangeBytes", 2).load().collect()) == {"x": b"hello"}


def test_files_that_shrink_fail(tmp_path):
    append(tmp_path, "a", b"12")
    with pytest.raises(OSError):
        list(growing.rows_of(growing.Fetch(f"file://{tmp_path}"), growing.Range("a", 0, 3)))
