"""Pixels of image files: PNG and BMP in numpy, other formats where an imaging library is installed.

Sizes are checked from the header before anything is unpacked. Rasters leave as packed RGB bytes, which ``raster.measure``
reads; thumbnails are PNG files that appear whole or not at all.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.functions.raster import fit_within, orient
from photonlake.sources.images import MAX_PIXELS, image_format, image_metadata

class ImageError(ValueError):
    """A file that is no picture, is damaged, or is too large."""


def check_size(width: int, height: int, limit: int = MAX_PIXELS) -> None:
    if width <= 0 or height <= 0:
        raise ImageError(f"no such size: {width} x {height}")
    if width * height > limit:
        raise ImageError(f"{width} x {height} pixels are more than {limit}")


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Scan lines of a PNG with their filters undone."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), dtype=np.uint8)  # a zero line above, zero pixels to the left
    for y in range(height):
        kind, line, up = lines[y, 0], lines[y, 1:], out[y]
        row = out[y + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 2:
            row[step:] = line + up[step:]
        elif kind == 1:
            for c in range(step):
                row[step + c :: step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind in (3, 4):
            left = [0] * step
            above, values = up.tolist(), line.tolist()
            for x, v in enumerate(values):
                a, b = left[-step], above[step + x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[x]
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                left.append((v + guess) & 255)
            row[step:] = left[step:]
        else:
            raise ImageError("unknown line filter")
    return out[1:, step:]


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG without interlacing, 8 or 16 bits a channel (or 1 to 8 with a palette or grey)."""
    try:
        width, height, depth, colour, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    except struct.error as e:
        raise ImageError("a short header") from e
    check_size(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or interlaced or depth not in (1, 2, 4, 8, 16):
        raise ImageError("an unsupported kind of PNG")
    at, packed, palette = 8, [], None
    while at + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IDAT":
            packed.append(body)
        elif name == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif name == b"IEND":
            break
        at += 12 + size
    stride = (width * channels * depth + 7) // 8
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(packed), height * (stride + 1))
    except zlib.error as e:
        raise ImageError("damaged pixels") from e
    if len(raw) != height * (stride + 1):
        raise ImageError("missing pixels")
    lines = _unfilter(raw, height, stride, max(1, channels * depth // 8))
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(height, width, depth)
        lines = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
        if colour == 0:
            lines = (lines.astype(int) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    img = lines.reshape(height, width, channels)
    if colour == 3:
        if palette is None or img.max(initial=0) >= len(palette):
            raise ImageError("a palette is missing")
        return palette[img[:, :, 0]]
    return img[:, :, :3] if colour in (2, 6) else np.repeat(img[:, :, :1], 3, axis=2)


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width, 3) of an uncompressed 24- or 32-bit BMP."""
    try:
        start, header, width, height, _, depth, packing = struct.unpack_from("<I I i i H H I", data, 10)
    except struct.error as e:
        raise ImageError("a short header") from e
    check_size(width, abs(height))
    if header < 40 or depth not in (24, 32) or packing not in (0, 3):
        raise ImageError("an unsupported kind of BMP")
    stride = (width * depth // 8 + 3) // 4 * 4
    if len(data) < start + stride * abs(height):
        raise ImageError("missing pixels")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    img = rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    return img[::-1] if height > 0 else img


def decode(data: bytes, long_edge: int = 0) -> np.ndarray:
    """Upright RGB pixels of a file, no longer than ``long_edge`` (0: as they are)."""
    kind = image_format(data)
    about = image_metadata(data)
    if about.get("width") and about.get("height"):
        check_size(about["width"], about["height"])
    if kind == "png":
        img = decode_png(data)
    elif kind == "bmp":
        img = decode_bmp(data)
    else:
        try:
            import io

            from PIL import Image
        except ImportError as e:
            raise ImageError(f"no decoder for {kind or 'this file'}") from e
        img = orient(np.asarray(Image.open(io.BytesIO(data)).convert("RGB")), int(about.get("orientation") or 1))
    return fit_within(img, long_edge) if long_edge and max(img.shape[:2]) > long_edge else img


def encode_png(img: np.ndarray) -> bytes:
    height, width, _ = img.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), img.astype(np.uint8).reshape(height, -1)], axis=1)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def read_pixels(files: DataFrame, long_edge: int = 2048) -> DataFrame:
    """(id, width, height, pixels, error) of (id, content); a file that cannot be decoded has an error and no pixels."""

    def run(batches):
        for batch in batches:
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    img = decode(content or b"", long_edge)
                    row = (i, img.shape[1], img.shape[0], np.ascontiguousarray(img).tobytes(), None)
                except (ImageError, ValueError, IndexError, struct.error) as e:
                    row = (i, None, None, None, str(e) or type(e).__name__)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["id", "width", "height", "pixels", "error"])

    return files.select(F.col("id").cast("long"), "content").mapInArrow(run, "id long, width int, height int, pixels binary, error string")


def write_whole(path: str, data: bytes) -> None:
    """A file that appears whole: written beside its place, then renamed."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def write_thumbnails(files: DataFrame, folder: str, long_edge: int = 480) -> DataFrame:
    """Write folder/<id>.png for (id, content); returns (id, path, error). The folder must be one that all executors share."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = os.path.join(folder, f"{i}.png")
                try:
                    write_whole(path, encode_png(decode(content or b"", long_edge)))
                    rows.append((i, path, None))
                except (ImageError, ValueError, IndexError, struct.error) as e:
                    rows.append((i, None, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["id", "path", "error"])

    return files.select(F.col("id").cast("long"), "content").mapInArrow(run, "id long, path string, error string")
