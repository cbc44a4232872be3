"""PNM and BMP files to rasters and back, formats by their first bytes, and sinks.

Files are read with Spark's binaryFile source, so any store that Spark reads will do; each file is
one row, decoded where it lies. Pixels are premultiplied, as everywhere else.
"""

import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphgrid.operators.frames import MOST_AREA, MOST_SIDE

RASTER = "w int, h int, a array<long>, r array<long>, g array<long>, b array<long>, error string"
#: Pixels of the files that are written or read before their rows go on, whatever a batch has.
AT_ONCE = 1 << 16
#: Formats by their first bytes, as hexadecimal patterns.
MAGIC = (
    ("PNG", "^89504E47"), ("JPEG", "^FFD8FF"), ("TIFF", "^(49492A00|4D4D002A)"), ("GIF", "^47494638(3761|3961)"),
    ("WEBP", "^52494646.{8}57454250"), ("BMP", "^424D"), ("PGM", "^5035"), ("PPM", "^5036"), ("PAM", "^5037"),
)
LEAST_BYTES = 12


def sniffed(content: Column) -> Column:
    """The format that the first bytes of a file show; UNSUPPORTED if there are fewer than 12 or none fits.

    Y4M files name their chroma in the first 64 bytes; without a name a file of fewer bytes passes for 4:2:0.
    """
    start = F.hex(F.substring(content, 1, LEAST_BYTES))
    header = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    video = F.when(header.contains(" C420"), "Y4M_420").when(header.contains(" C444"), "Y4M_444").when(~header.contains(" C") & (F.octet_length(content) < 64), "Y4M_420")
    out = F.when(F.octet_length(content) < LEAST_BYTES, "UNSUPPORTED")
    for name, pattern in MAGIC:
        out = out.when(start.rlike(pattern), name)
    return F.coalesce(out.when(start.startswith("59555634"), video), F.lit("UNSUPPORTED"))


def _premultiplied(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    v = a * c
    return np.where(a < 255, (v + (v >> 8) + 128) >> 8, c)


def _straight(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    mult = ((255 << 16) + a - 1) // np.maximum(a, 1)
    return np.where(a == 0, 0, np.minimum((c * mult + 32768) >> 16, 255))


def _checked(w: int, h: int) -> None:
    if not (1 <= w <= MOST_SIDE and 1 <= h <= MOST_SIDE and w * h <= MOST_AREA):
        raise ValueError("bad dimension")


_HEAD = re.compile(rb"P([567])[ \t\r\n]+")
_FIELD = re.compile(rb"(?:#[^\n]*\n|[ \t\r\n])*(\d+)")
#: Samples of a pixel by tuple type.
TUPLES = {"RGB_ALPHA": 4, "RGB": 3, "GRAYSCALE_ALPHA": 2, "GRAYSCALE": 1}


def read_pnm(data: bytes) -> tuple:
    """(w, h, a, r, g, b) of a binary PGM, PPM or PAM file of up to 255 levels."""
    m = _HEAD.match(data)
    if not m:
        raise ValueError("not a PNM file")
    kind, at = m[1], m.end()
    if kind == b"7":
        end = data.find(b"ENDHDR\n", at)
        if end < 0:
            raise ValueError("not enough data")
        fields, expected = {}, None
        for line in data[at:end].decode("ascii", "replace").splitlines():
            name, _, value = line.partition(" ")
            if not line or line.startswith("#"):
                continue
            if name == "TUPLTYPE" and value in TUPLES:
                expected = TUPLES[value]
            elif name in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL") and value.isdigit() and name not in fields:
                fields[name] = int(value)
            else:
                raise ValueError("bad header")
        if len(fields) < 4 or (expected and expected != fields["DEPTH"]):
            raise ValueError("bad header")
        w, h, depth, top = (fields[k] for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
        at = end + 7
    else:
        numbers = []
        for _ in range(3):
            m = _FIELD.match(data, at)
            if not m:
                raise ValueError("bad header")
            numbers.append(int(m[1]))
            at = m.end()
        (w, h, top), depth = numbers, 1 if kind == b"5" else 3
        at += 1
    _checked(w, h)
    if not 0 < top <= 255 or depth not in (1, 2, 3, 4):
        raise ValueError("unsupported feature")
    if len(data) < at + w * h * depth:
        raise ValueError("not enough data")
    px = np.frombuffer(data, np.uint8, w * h * depth, at).reshape(w * h, depth).astype(np.int64)
    if top < 255:
        px = (np.minimum(px, top) * 255 + top // 2) // top
    a = px[:, -1] if depth in (2, 4) else np.full(w * h, 255, np.int64)
    colours = [px[:, k if depth > 2 else 0] for k in range(3)]
    return w, h, a, *[_premultiplied(a, c) for c in colours]


def read_bmp(data: bytes) -> tuple:
    """(w, h, a, r, g, b) of an uncompressed BMP file of 24 or 32 bits a pixel, the last row first."""
    if len(data) < 54:
        raise ValueError("not enough data")
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    size, zero, offset = struct.unpack_from("<IH2xI", data, 2)
    w, h, n_planes, bits, packing = struct.unpack_from("<IIHHI", data, 18)
    colours, important = struct.unpack_from("<II", data, 46)
    if len(data) < size or zero:
        raise ValueError("bad header")
    _checked(w, h)
    if bits not in (24, 32) or n_planes != 1 or packing or colours or important:
        raise ValueError("unsupported feature")
    depth = bits // 8
    stride = (w * depth + 3) // 4 * 4
    if len(data) < offset + h * stride:
        raise ValueError("not enough data")
    px = np.frombuffer(data, np.uint8, h * stride, offset).reshape(h, stride)[::-1, : w * depth].reshape(w * h, depth).astype(np.int64)
    a = px[:, 3] if depth == 4 else np.full(w * h, 255, np.int64)
    return w, h, a, *[_premultiplied(a, px[:, k]) for k in (2, 1, 0)]


READERS = {"PGM": read_pnm, "PPM": read_pnm, "PAM": read_pnm, "BMP": read_bmp}


def decoded(files: DataFrame, keep: tuple = ("path",), content: str = "content") -> DataFrame:
    """The kept columns and the raster of each file, or the error that says why there is none."""
    from pyspark.sql.types import StructType

    rows = files.select(*keep, sniffed(F.col(content)).alias("_format"), F.col(content).alias("_content"))

    planes = pa.list_(pa.int64())
    kinds = {"w": pa.int32(), "h": pa.int32(), "a": planes, "r": planes, "g": planes, "b": planes, "error": pa.string()}

    def run(batches):
        for batch in batches:
            kept, (formats, contents) = batch.select(range(len(keep))), batch.columns[len(keep) :]
            out, begun, size = [], 0, 0
            for i in range(batch.num_rows):
                try:
                    kind = formats[i].as_py()
                    if kind not in READERS:
                        raise ValueError("unsupported feature")
                    out.append((*READERS[kind](contents[i].as_py()), None))
                    size += out[-1][0] * out[-1][1]
                except ValueError as error:
                    out.append((None,) * 6 + (str(error),))
                if size >= AT_ONCE or i + 1 == batch.num_rows:
                    made = [pa.array(v, k) for v, k in zip(zip(*out), kinds.values())]
                    yield pa.RecordBatch.from_arrays([*kept.slice(begun, len(out)).columns, *made], names=[*keep, *kinds])
                    out, begun, size = [], i + 1, 0

    given = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{given}, {RASTER}")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length, and the raster of each file below a path."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), ("path", "length"))


def write_pnm(w: int, h: int, a, r, g, b, alpha: bool) -> bytes:
    """PPM, or PAM with alpha; colours are unmultiplied."""
    a = np.asarray(a, np.int64)
    parts = [_straight(a, np.asarray(c, np.int64)) for c in (r, g, b)] + ([a] if alpha else [])
    head = f"P7\nWIDTH {w}\nHEIGHT {h}\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" if alpha else f"P6\n{w} {h}\n255\n"
    return head.encode() + np.stack(parts, 1).astype(np.uint8).tobytes()


def write_bmp(w: int, h: int, a, r, g, b) -> bytes:
    """32 bits a pixel if any alpha isn't 255, else 24; the last row first."""
    a = np.asarray(a, np.int64)
    depth = 4 if (a != 255).any() else 3
    parts = [_straight(a, np.asarray(c, np.int64)) for c in (b, g, r)] + ([a] if depth == 4 else [])
    rows = np.stack(parts, 1).astype(np.uint8).reshape(h, w * depth)[::-1]
    rows = np.pad(rows, ((0, 0), (0, -(w * depth) % 4)))
    return struct.pack("<2sIIIIIIHHIIIIII", b"BM", rows.size + 54, 0, 54, 40, w, h, 1, depth * 8, 0, 0, 2400, 2400, 0, 0) + rows.tobytes()


def write_png(w: int, h: int, a, r, g, b) -> bytes:
    """8 bits a sample, unfiltered rows, alpha only where it isn't 255."""
    a = np.asarray(a, np.int64)
    parts = [_straight(a, np.asarray(c, np.int64)) for c in (r, g, b)] + ([a] if (a != 255).any() else [])
    rows = np.pad(np.stack(parts, 1).astype(np.uint8).reshape(h, w * len(parts)), ((0, 0), (1, 0)))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if len(parts) == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple:
    """(w, h, a, r, g, b) of a PNG file of 8 bits a sample without interlacing, all five row filters."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, head, packed, palette, clear = 8, None, [], None, b""
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not packed:
        raise ValueError("not enough data")
    w, h, bits, kind, _, _, interlaced = head
    _checked(w, h)
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if bits != 8 or interlaced or depth is None or (kind == 3 and palette is None):
        raise ValueError("unsupported feature")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as error:
        raise ValueError("bitstream error") from error
    if len(raw) < h * (w * depth + 1):
        raise ValueError("not enough data")
    rows = np.frombuffer(raw, np.uint8, h * (w * depth + 1)).reshape(h, -1)
    out, above = np.zeros((h, w * depth), np.uint8), np.zeros(w * depth, np.uint8)
    for y in range(h):
        line, how = rows[y, 1:].copy(), rows[y, 0]
        if how == 1:
            line = np.cumsum(line.reshape(w, depth), 0, dtype=np.uint8).ravel()
        elif how == 2:
            line += above
        elif how in (3, 4):
            for x in range(w * depth):
                left, corner = (int(line[x - depth]), int(above[x - depth])) if x >= depth else (0, 0)
                up = int(above[x])
                if how == 3:
                    guess = (left + up) // 2
                else:
                    far = [(abs(up - corner), 0, left), (abs(left - corner), 1, up), (abs(left + up - 2 * corner), 2, corner)]
                    guess = min(far)[2]
                line[x] = (int(line[x]) + guess) & 255
        elif how:
            raise ValueError("bitstream error")
        out[y] = above = line
    px = out.reshape(w * h, depth).astype(np.int64)
    if kind == 3:
        opacity = np.concatenate([np.frombuffer(clear, np.uint8), np.full(max(0, len(palette) - len(clear)), 255, np.uint8)]).astype(np.int64)
        a, colours = opacity[px[:, 0]], [palette[px[:, 0], k] for k in range(3)]
    else:
        a = px[:, -1] if kind in (4, 6) else np.full(w * h, 255, np.int64)
        colours = [px[:, k if depth > 2 else 0] for k in range(3)]
    return w, h, a, *[_premultiplied(a, c) for c in colours]


READERS["PNG"] = read_png


def encoded(images: DataFrame, kind: str, keep: tuple = ("image_id",)) -> DataFrame:
    """The kept columns, the file's ``content``, and its ``size``: PPM, PAM, BMP or PNG."""
    write = {"PPM": lambda *p: write_pnm(*p, False), "PAM": lambda *p: write_pnm(*p, True), "BMP": write_bmp, "PNG": write_png}[kind]

    def run(batches):
        for batch in batches:
            kept, (w, h, *planes) = batch.select(range(len(keep))), batch.columns[len(keep) :]
            made, begun, size = [], 0, 0
            for i in range(batch.num_rows):
                made.append(write(w[i].as_py(), h[i].as_py(), *[p[i].values.to_numpy(zero_copy_only=False) for p in planes]))
                size += w[i].as_py() * h[i].as_py()
                if size >= AT_ONCE or i + 1 == batch.num_rows:
                    sizes = pa.array([len(m) for m in made], pa.int64())
                    yield pa.RecordBatch.from_arrays([*kept.slice(begun, len(made)).columns, pa.array(made, pa.binary()), sizes], names=[*keep, "content", "size"])
                    made, begun, size = [], i + 1, 0

    kinds = ", ".join(f"`{c}` {images.schema[c].dataType.simpleString()}" for c in keep)
    return images.select(*keep, "w", "h", "a", "r", "g", "b").mapInArrow(run, f"{kinds}, content binary, size long")


def written_size(images: DataFrame, kind: str) -> DataFrame:
    """The size of each file alone; no bytes are kept."""
    return encoded(images, kind).drop("content")


def save_images(images: DataFrame, folder: str, kind: str, name: str = "image_id") -> DataFrame:
    """Write a file for each image below a folder that all executors share, and give name, path and size of each.

    A file is written under a name of its task attempt and renamed when whole, so a lost task leaves no half file.
    """
    files = encoded(images, kind, (name,))

    def run(frames):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for f in frames:
            paths = []
            for n, content in zip(f[name], f["content"]):
                paths.append(f"{base}/{n}.{kind.lower()}")
                with store.open_output_stream(f"{paths[-1]}.{attempt}") as out:
                    out.write(content)
                store.move(f"{paths[-1]}.{attempt}", paths[-1])
            yield pd.DataFrame({name: f[name], "path": paths, "size": f["size"]})

    return files.mapInPandas(run, f"`{name}` {images.schema[name].dataType.simpleString()}, path string, size long")
