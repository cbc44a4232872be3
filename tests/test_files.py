"""Image files: round trips, headers with odds and ends, and files that are broken."""

import struct
import zlib

import numpy as np

from glyphgrid.sources import files


def parts(w, h, alpha, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, w * h) if alpha else np.full(w * h, 255)
    return w, h, a, *[np.minimum(rng.integers(0, 256, w * h), a) for _ in range(3)]


def test_round_trips():
    for w, h in ((1, 1), (3, 2), (1, 48), (64, 1), (17, 9)):
        opaque = parts(w, h, False, w)
        for data, read in ((files.write_pnm(*opaque, False), files.read_pnm), (files.write_pnm(*opaque, True), files.read_pnm), (files.write_bmp(*opaque), files.read_bmp), (files.write_png(*opaque), files.read_png)):
            got = read(data)
            assert got[:2] == (w, h) and all((p == q).all() for p, q in zip(got[2:], opaque[2:]))
        # Through straight colours and back a premultiplied byte may move by one.
        clear = parts(w, h, True, h)
        for data, read in ((files.write_pnm(*clear, True), files.read_pnm), (files.write_bmp(*clear), files.read_bmp), (files.write_png(*clear), files.read_png)):
            got = read(data)
            assert (got[2] == clear[2]).all() and all(np.abs(p - q).max() <= 1 for p, q in zip(got[3:], clear[3:]))


def test_pnm_headers():
    assert files.read_pnm(b"P5\n# note\n2 # more\n 1\n15\n\x00\x0f")[3].tolist() == [0, 255]
    assert files.read_pnm(b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 2\nMAXVAL 255\nTUPLTYPE GRAYSCALE_ALPHA\nENDHDR\n\xff\x80")[2:4] == (np.array([128]), np.array([128]))


def png(kind, w, h, raw, more=b"", bits=8):
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0)) + more + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_filters():
    rng = np.random.default_rng(0)
    px = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    rows, above = [], np.zeros(12, int)
    for y, how in enumerate((0, 1, 2, 3, 4)):
        line = px[y].ravel().astype(int)
        left, corner = np.concatenate([[0] * 3, line[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        paeth = [min(((abs(u - c), 0, p), (abs(p - c), 1, u), (abs(p + u - 2 * c), 2, c)))[2] for p, u, c in zip(left, above, corner)]
        guess = [np.zeros(12, int), left, above, (left + above) // 2, np.array(paeth)][how]
        rows.append(bytes([how]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    got = files.read_png(png(2, 4, 5, b"".join(rows)))
    assert all((got[3 + k] == px[:, :, k].ravel()).all() for k in range(3))


def test_broken_files(spark):
    good = files.write_bmp(*parts(3, 2, False, 1))
    cases = {
        "short": b"BM", "none": b"", "null": None, "cut": good[:60] + b"", "size": good[:18] + struct.pack("<I", 0) + good[22:], "png": png(2, 1, 1, b"\0\0\0\0", bits=16),
        "pnm": b"P6\n0 1\n255\n" + bytes(9), "text": b"hello world, hello", "deflate": b"\x89PNG\r\n\x1a\n" + bytes(30), "good": good,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "path string, content binary")
    got = {r.path: r for r in files.decoded(df).collect()}
    assert got["good"].error is None and got["good"].w == 3 and len(got["good"].r) == 6
    assert all(got[k].error and got[k].r is None for k in cases if k != "good")


def test_files_of_a_folder(spark, tmp_path):
    rows = [(k, *parts(k + 1, 3, k % 2, k)) for k in range(6)]
    df = spark.createDataFrame([(k, w, h, *[c.tolist() for c in cs]) for k, w, h, *cs in rows], "image_id long, w int, h int, a array<long>, r array<long>, g array<long>, b array<long>")
    for kind in ("PNG", "BMP"):
        saved = files.save_images(df, f"file://{tmp_path}/{kind}", kind).collect()
        assert sorted(r.image_id for r in saved) == list(range(6))
        got = files.read_images(spark, f"file://{tmp_path}/{kind}").collect()
        assert len(got) == 6 and all(r.error is None for r in got)
        assert {r.path.rsplit("/", 1)[-1]: r.length for r in got} == {f"{r.image_id}.{kind.lower()}": r.size for r in saved}
