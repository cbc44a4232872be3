"""Files that grow, as a streaming source: byte ranges of what has been appended, each read once.

``spark.dataSource.register(GrowingFiles)`` names the source ``growing_files``; its options are ``path``, a folder with files that are only ever
appended to, and ``rangeBytes``, the most bytes of one row. Rows are (file, at, bytes), of one file without gaps or overlaps. An offset is how long each file was,
so a query that is stopped and started again goes on where its checkpoint says; ranges aren't read before Spark plans them, and
what is committed isn't held anywhere. As a batch it gives what is there now.

Where the bytes come from is a ``Fetch``: sizes and ranges. The one here reads any file system that Arrow knows by its URI; another, as of an object
store, is a subclass of the source with its own ``fetch``.
"""

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 1 << 20


class Fetch:
    """Sizes of the files of a folder, and ranges of their bytes."""

    def __init__(self, uri: str):
        self._uri = uri

    def _system(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self._uri)

    def sizes(self) -> dict:
        from pyarrow import fs

        system, folder = self._system()
        found = system.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.type == fs.FileType.File and f.size}

    def read(self, name: str, at: int, size: int) -> bytes:
        system, folder = self._system()
        with system.open_input_file(f"{folder}/{name}") as f:
            return f.read_at(size, at)


class Range(InputPartition):
    def __init__(self, name: str, at: int, size: int):
        self.name, self.at, self.size = name, at, size


def ranges(start: dict, end: dict, size: int) -> list:
    """Of each file what lies between two offsets, in parts of at most so many bytes."""
    return [Range(name, at, min(size, to - at)) for name, to in sorted(end.items()) for at in range(start.get(name, 0), to, size)]


def rows_of(fetch: Fetch, part: Range) -> Iterator[tuple]:
    data = fetch.read(part.name, part.at, part.size)
    if len(data) < part.size:
        raise OSError(f"{part.name} has become shorter than it was")
    yield part.name, part.at, data


class _Batch(DataSourceReader):
    def __init__(self, fetch: Fetch, size: int):
        self._fetch, self._size = fetch, size

    def partitions(self) -> list:
        return ranges({}, self._fetch.sizes(), self._size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows_of(self._fetch, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, size: int):
        self._fetch, self._size = fetch, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._fetch.sizes()

    def partitions(self, start: dict, end: dict) -> list:
        return ranges(start, end, self._size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return rows_of(self._fetch, partition)

    def commit(self, end: dict) -> None:
        """Nothing is held."""


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "file string, at long, bytes binary"

    def fetch(self) -> Fetch:
        return Fetch(self.options["path"])

    def _size(self) -> int:
        return int(self.options.get("rangeBytes", RANGE_BYTES))

    def reader(self, schema) -> _Batch:
        return _Batch(self.fetch(), self._size())

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.fetch(), self._size())
