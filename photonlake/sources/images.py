"""Image bytes to metadata: format by content, pixel size, EXIF, and the largest JPEG inside a raw file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: TIFF value types: bytes a value, struct letter.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
#: Tags that are read, by directory.
_NAMES = {
    0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x0132: "modified", 0x013B: "artist", 0x829A: "exposure_time", 0x829D: "fnumber", 0x8827: "iso", 0x9003: "taken", 0x9011: "offset", 0x9209: "flash",
    0x920A: "focal_length", 0xA405: "focal35", 0xA432: "lens_spec", 0xA433: "lens_make", 0xA434: "lens_model", 0x0100: "width", 0x0101: "height", 0x0201: "jpeg_at", 0x0202: "jpeg_size",
}
_GPS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon"}
MAX_PIXELS = 300_000_000


def image_format(data: bytes) -> str:
    """Format by content; empty when unknown."""
    if data[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "png"
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[:2] == b"BM":
        return "bmp"
    if data[:15] == b"FUJIFILMCCD-RAW":
        return "raf"
    if data[4:8] == b"ftyp":
        brand = data[8:12]
        return "cr3" if brand == b"crx " else "avif" if brand in (b"avif", b"avis") else "heif"
    if data[:4] in (b"II*\0", b"MM\0*", b"IIRO", b"IIU\0"):
        return "tiff"
    return ""


class Tiff:
    """Directories of a TIFF structure; damaged ones end early, loops are cut."""

    def __init__(self, data: bytes):
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"
        self.seen: set[int] = set()

    def read(self, at: int, form: str):
        form = self.order + form
        return struct.unpack_from(form, self.data, at) if 0 <= at and at + struct.calcsize(form) <= len(self.data) else None

    def entries(self, at: int) -> tuple[dict[int, list], int]:
        count = self.read(at, "H")
        out: dict[int, list] = {}
        if count is None or at in self.seen:
            return out, 0
        self.seen.add(at)
        for k in range(min(count[0], 1000)):
            head = self.read(at + 2 + 12 * k, "HHI")
            if head is None:
                return out, 0
            tag, kind, n = head
            size, letter = _TYPES.get(kind, (0, ""))
            total = size * n
            if not size or total > 1 << 20:
                continue
            place = at + 2 + 12 * k + 8
            if total > 4:
                place = (self.read(place, "I") or (len(self.data),))[0]
            if place + total > len(self.data):
                continue
            if letter == "s":
                out[tag] = [self.data[place : place + n].split(b"\0")[0].decode("utf-8", "replace").strip()]
            elif len(letter) == 2:
                flat = struct.unpack_from(f"{self.order}{2 * n}{letter[0]}", self.data, place)
                out[tag] = [a / b if b else 0.0 for a, b in zip(flat[::2], flat[1::2], strict=True)]
            else:
                out[tag] = list(struct.unpack_from(f"{self.order}{n}{letter}", self.data, place))
        following = self.read(at + 2 + 12 * count[0], "I")
        return out, following[0] if following else 0


def tiff_metadata(data: bytes) -> tuple[dict, list[tuple[int, int]]]:
    """Named values of all directories (the first that has one wins) and the places of embedded JPEGs."""
    t, found, jpegs = Tiff(data), {}, []
    first = t.read(4, "I")
    todo = [(first[0], "main")] if first else []
    while todo:
        at, kind = todo.pop(0)
        values, following = t.entries(at)
        for tag, v in values.items():
            name = _GPS.get(tag) if kind == "gps" else _NAMES.get(tag)
            if name and v and name not in found and name not in ("jpeg_at", "jpeg_size"):
                found[name] = v if name in ("lat", "lon", "lens_spec") else v[0]
        if 0x0201 in values and 0x0202 in values:
            jpegs.append((values[0x0201][0], values[0x0202][0]))
        if values.get(0x0103, [0])[0] in (6, 7) and len(values.get(0x0111, [])) == 1 and 0x0117 in values:
            jpegs.append((values[0x0111][0], values[0x0117][0]))
        todo += [(values[0x8769][0], "exif")] if 0x8769 in values else []
        todo += [(values[0x8825][0], "gps")] if 0x8825 in values else []
        todo += [(p, "sub") for p in values.get(0x014A, [])]
        if following and kind == "main":
            todo.append((following, "main"))
    return found, jpegs


def jpeg_segments(data: bytes, at: int = 0) -> Iterator[tuple[int, int, int]]:
    """(marker, first byte, size) up to the scan."""
    pos = at + 2
    while pos + 4 <= len(data):
        if data[pos] != 0xFF:
            return
        mark = data[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        if mark in (0x01, *range(0xD0, 0xD9)):
            pos += 2
            continue
        size = struct.unpack_from(">H", data, pos + 2)[0]
        yield mark, pos + 4, size - 2
        if mark == 0xDA or size < 2:
            return
        pos += 2 + size


def jpeg_size(data: bytes, at: int = 0) -> tuple[int, int] | None:
    for mark, pos, size in jpeg_segments(data, at):
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and size >= 5 and pos + 5 <= len(data):
            h, w = struct.unpack_from(">HH", data, pos + 1)
            return (w, h) if w and h else None
    return None


def embedded_jpegs(data: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, size, width, height) of the JPEGs inside a file, largest first: those that directories name, else
    those that a scan for start markers finds. Sizes are cut to the file."""
    found = {}
    places = tiff_metadata(data)[1] if image_format(data) == "tiff" else []
    if image_format(data) == "raf" and len(data) > 92:
        places.append(struct.unpack_from(">II", data, 84))
    for at, size in places:
        if 0 < at < len(data) and data[at : at + 3] == b"\xff\xd8\xff" and (dims := jpeg_size(data, at)):
            found[at] = (at, min(size, len(data) - at), *dims)
    if not found:
        at = data.find(b"\xff\xd8\xff", 1)
        while at >= 0:
            if dims := jpeg_size(data, at):
                end = data.find(b"\xff\xd9", at)
                found[at] = (at, (end + 2 if end >= 0 else len(data)) - at, *dims)
            at = data.find(b"\xff\xd8\xff", at + 3)
    return sorted(found.values(), key=lambda x: (-x[2] * x[3], x[0]))


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end) of ISO base media boxes; a uuid box's name is its id."""
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if size == 1 and start + 8 <= end:
            size, start = struct.unpack_from(">Q", data, start)[0], start + 8
        stop = end if size == 0 else at + size
        if stop > end or stop < start:
            return
        if name == b"uuid" and start + 16 <= stop:
            name, start = data[start : start + 16], start + 16
        yield name, start, stop
        at = stop


CR3_UUID = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")


def container_tiffs(data: bytes) -> list[bytes]:
    """TIFF blocks of a container: the four metadata boxes of a CR3, or a HEIF's EXIF item."""
    out = []
    for name, a, b in boxes(data, 0, len(data)):
        if name == b"moov":
            for inner, c, e in boxes(data, a, b):
                if inner == CR3_UUID:
                    out += [data[p:q] for n, p, q in boxes(data, c, e) if n in (b"CMT1", b"CMT2", b"CMT3", b"CMT4")]
    if not out:
        at = data.find(b"Exif\0\0")
        if at >= 0 and data[at + 6 : at + 8] in (b"II", b"MM"):
            out.append(data[at + 6 :])
    return out


def heif_size(data: bytes) -> tuple[int, int, int] | None:
    """(width, height, quarter turns) of the largest image that a HEIF's properties name."""
    best, turns = None, 0
    stack = [(0, len(data))]
    while stack:
        a, b = stack.pop()
        for name, p, q in boxes(data, a, b):
            if name == b"meta":
                stack.append((p + 4, q))
            elif name in (b"iprp", b"ipco"):
                stack.append((p, q))
            elif name == b"ispe" and q - p >= 12:
                w, h = struct.unpack_from(">II", data, p + 4)
                best = max(best or (0, 0), (w, h), key=lambda s: s[0] * s[1])
            elif name == b"irot" and q > p:
                turns = data[p] & 3
    return (*best, turns) if best else None


def degrees(parts, ref: str, limit: float) -> float | None:
    if not parts or len(parts) < 3:
        return None
    v = parts[0] + parts[1] / 60 + parts[2] / 3600
    v = -v if (ref or "").upper() in ("S", "W") else v
    return v if abs(v) <= limit else None


def image_metadata(data: bytes) -> dict:
    """Format, upright pixel size and camera data of one file; absent values are None."""
    kind, meta, size = image_format(data), {}, None
    if kind == "jpeg":
        size = jpeg_size(data)
        for mark, pos, n in jpeg_segments(data):
            if mark == 0xE1 and data[pos : pos + 6] == b"Exif\0\0" and not meta:
                meta = tiff_metadata(data[pos + 6 : pos + n])[0]
    elif kind == "png" and len(data) >= 24:
        size = struct.unpack_from(">II", data, 16)
    elif kind == "gif" and len(data) >= 10:
        size = struct.unpack_from("<HH", data, 6)
    elif kind == "bmp" and len(data) >= 26:
        w, h = struct.unpack_from("<ii", data, 18)
        size = (w, abs(h))
    elif kind == "webp" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            size = (1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
        elif data[12:16] == b"VP8L":
            bits = struct.unpack_from("<I", data, 21)[0]
            size = (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
        else:
            w, h = struct.unpack_from("<HH", data, 26)
            size = (w & 0x3FFF, h & 0x3FFF)
    elif kind in ("tiff", "raf"):
        meta = tiff_metadata(data)[0] if kind == "tiff" else {}
        inner = embedded_jpegs(data)
        size = inner[0][2:] if inner else (meta.get("width"), meta.get("height"))
    elif kind in ("heif", "avif", "cr3"):
        for block in container_tiffs(data):
            meta = tiff_metadata(block)[0] | meta
        dims = heif_size(data) if kind != "cr3" else None
        if dims:
            size = (dims[1], dims[0]) if dims[2] % 2 else dims[:2]
    w, h = (size or (None, None))[:2]
    if w and h and w * h > MAX_PIXELS:
        raise ValueError(f"{w} x {h} pixels are too many")
    if kind == "jpeg" and meta.get("orientation") in (5, 6, 7, 8):
        w, h = h, w
    text = lambda k: str(meta[k]) if k in meta else None
    number = lambda k: float(meta[k]) if isinstance(meta.get(k), (int, float)) else None
    return {
        "format": kind, "width": w, "height": h, "camera_make": text("make"), "camera_model": text("model"), "lens": text("lens_model"), "artist": text("artist"), "taken": text("taken"),
        "exposure_time": number("exposure_time"), "fnumber": number("fnumber"), "iso": number("iso"), "focal_length": number("focal_length"), "focal35": number("focal35"), "flash": bool(int(meta["flash"]) & 1) if "flash" in meta else None,
        "gps_lat": degrees(meta.get("lat"), meta.get("lat_ref"), 90), "gps_lon": degrees(meta.get("lon"), meta.get("lon_ref"), 180),
    }


#: Columns of the metadata table.
METADATA = [("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32())]
METADATA += [(n, pa.string()) for n in ("camera_make", "camera_model", "lens", "artist", "taken")]
METADATA += [(n, pa.float64()) for n in ("exposure_time", "fnumber", "iso", "focal_length", "focal35")]
METADATA += [("flash", pa.bool_()), ("gps_lat", pa.float64()), ("gps_lon", pa.float64()), ("error", pa.string())]


def read_metadata(files: DataFrame) -> DataFrame:
    """Metadata of (path, content), one row a file; a file that fails carries its error and stops nothing."""
    schema = pa.schema(METADATA)
    sql = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean"}

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    row = image_metadata(content or b"")
                    row["error"] = None if row["format"] else "unknown format"
                except (ValueError, struct.error) as e:
                    row = {"error": str(e)}
                rows.append({"path": path, **row})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, ", ".join(f"{n} {sql[t]}" for n, t in METADATA))
