"""Decoding, the size guard, thumbnails, and tables of older versions."""

import struct
import zlib

import numpy as np
import pytest

from photonlake import schemas
from photonlake.functions import raster
from photonlake.sources import pixels


def filtered_png(img, kind):
    """A PNG whose lines all use one filter, by the plain definition."""
    h, w, c = img.shape
    flat = img.reshape(h, w * c).astype(int)
    lines = []
    for y in range(h):
        row = bytearray([kind])
        for x in range(w * c):
            a = flat[y, x - c] if x >= c else 0
            b = flat[y - 1, x] if y else 0
            d = flat[y - 1, x - c] if y and x >= c else 0
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            row.append((flat[y, x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        lines.append(bytes(row))
    chunk = lambda n, body: struct.pack(">I", len(body)) + n + body + struct.pack(">I", zlib.crc32(n + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters_are_undone(kind):
    img = np.random.default_rng(kind).integers(0, 256, (9, 7, 3 + kind % 2)).astype(np.uint8)
    assert (pixels.decode(filtered_png(img, kind)) == img[:, :, :3]).all()
    assert (pixels.decode(pixels.encode_png(img[:, :, :3])) == img[:, :, :3]).all()


def test_bmp_rows_run_upwards():
    img = np.random.default_rng(1).integers(0, 256, (4, 5, 3)).astype(np.uint8)
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" for r in img[::-1])
    data = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(rows), 0, 54, 40, 5, 4, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (pixels.decode(data) == img).all()


def test_sizes_are_checked_before_pixels_are_unpacked(spark, tmp_path):
    bomb = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 60_000, 60_000, 8, 2, 0, 0, 0) + bytes(100)
    with pytest.raises(ValueError):
        pixels.decode(bomb)
    img = np.random.default_rng(2).integers(0, 256, (300, 200, 3)).astype(np.uint8)
    files = spark.createDataFrame([(1, pixels.encode_png(img)), (2, bomb), (3, b"no picture"), (4, None), (5, pixels.encode_png(img)[:-40])], "id long, content binary")
    got = {r.id: r for r in pixels.read_pixels(files, 100).collect()}
    assert (got[1].width, got[1].height, got[1].error) == (67, 100, None) and all(got[i].error and got[i].pixels is None for i in (2, 3, 4, 5))
    measured = raster.measure(pixels.read_pixels(files, 200).filter("error is null")).collect()
    assert len(measured) == 1
    written = {r.id: r for r in pixels.write_thumbnails(files, str(tmp_path), 50).collect()}
    assert pixels.decode(open(written[1].path, "rb").read()).shape == (50, 33, 3) and written[2].path is None
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1.png"]


def test_old_tables_get_todays_columns(spark):
    photos = spark.createDataFrame([(1, "/a", [0.5, 1.0]), (2, "/b", None)], "id int, path string, clip array<float>")
    known = spark.createDataFrame([(1, [9.0]), (7, [7.0])], "photo_id long, clip array<float>")
    out = schemas.migrate({"photos": photos, "photo_clip": known, "stars": spark.createDataFrame([(1, 2, 3)], "user_id long, photo_id long, at long")})
    for name, t in out.items():
        assert t.schema.simpleString() == schemas.empty_table(spark, name).schema.simpleString()
    row = out["photos"].orderBy("id").first()
    assert (row.id, row.path, row.seq, row.blockiness, row.stacked, row.overall) == (1, "/a", 0, 1.0, False, None)
    assert {(r.photo_id, tuple(r.clip)) for r in out["photo_clip"].collect()} == {(1, (0.5, 1.0)), (7, (7.0,))}
