"""Media columns: payloads stored losslessly as 8-bit sound samples, and signature sniffing of media bytes.

``store`` writes a text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as the samples of a
mono 8-bit PCM WAVE file; ``read_payload`` walks the chunks of stored bytes and returns the samples.

``sniff`` scans bytes with one Aho-Corasick automaton over all signatures; every place where magic bytes stand
goes to the validator of its format, which confirms structure and returns the exact length. A confirmed
format at byte 0 corrects the declared type; confirmed ones further in are carved out as embedded media.

Nulls and odd input: a null text is empty and gives 64 zero bytes; equal texts give equal values; rows with
equal or null doc_id are separate; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import bisect
import re
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAD, SAMPLE_RATE = 64, 8000
#: Magic bytes of each format, with their place in the file.
SIGNATURES = [
    (b"RIFF", 0, "riff"),
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"fLaC", 0, "flac"),
    (b"OggS", 0, "ogg"),
    (b"BM", 0, "bmp"),
    (b"ftyp", 4, "isobmff"),
    (b"\x1f\x8b\x08", 0, "gzip"),
]


def pad_payload(data: bytes) -> bytes:
    return data + bytes((-len(data)) % PAD if data else PAD)


def to_wave(payload: bytes) -> bytes:
    """Mono 8-bit PCM: one unsigned sample per byte."""
    form = struct.pack("<HHIIHH", 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def riff_chunks(data: bytes, at: int, end: int):
    """(id, first byte, size) of the chunks between at and end; stops at the first that overruns."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            return
        yield data[at : at + 4], at + 8, size
        at += 8 + size + size % 2


def read_payload(media: bytes) -> bytes:
    """The samples of a stored WAVE file."""
    for name, at, size in riff_chunks(media, 12, len(media)):
        if name == b"data":
            return media[at : at + size]
    raise ValueError("no data chunk")


def _riff(d: bytes, at: int):
    if at + 12 > len(d):
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    kind = {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}.get(d[at + 8 : at + 12])
    if kind is None or end > len(d) or end < at + 20:
        return None
    names = [n for n, _, _ in riff_chunks(d, at + 12, end)]
    if kind == "wav" and (b"fmt " not in names or b"data" not in names):
        return None
    return (kind, end - at) if names else None


def _png(d: bytes, at: int):
    pos, first = at + 8, True
    while pos + 12 <= len(d):
        size = struct.unpack_from(">I", d, pos)[0]
        name = d[pos + 4 : pos + 8]
        if pos + 12 + size > len(d) or first and (name != b"IHDR" or size != 13):
            return None
        if zlib.crc32(d[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", d, pos + 8 + size)[0]:
            return None
        pos, first = pos + 12 + size, False
        if name == b"IEND":
            return "png", pos - at
    return None


def _jpeg(d: bytes, at: int):
    pos, seen_scan = at + 2, False
    while pos + 4 <= len(d):
        if d[pos] != 0xFF:
            return None
        mark = d[pos + 1]
        if mark == 0xD9:
            return ("jpeg", pos + 2 - at) if seen_scan else None
        if mark == 0xFF:
            pos += 1
            continue
        size = struct.unpack_from(">H", d, pos + 2)[0]
        if size < 2 or pos + 2 + size > len(d):
            return None
        pos += 2 + size
        if mark == 0xDA:
            seen_scan = True
            while True:  # entropy-coded bytes: stuffed zeros and restart marks belong to them
                pos = d.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(d):
                    return None
                if d[pos + 1] == 0 or 0xD0 <= d[pos + 1] <= 0xD7:
                    pos += 2
                    continue
                break
    if pos + 2 <= len(d) and d[pos : pos + 2] == b"\xff\xd9" and seen_scan:
        return "jpeg", pos + 2 - at
    return None


def _gif(d: bytes, at: int):
    if at + 13 > len(d):
        return None
    flags = d[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(pos: int) -> int:
        while pos < len(d) and d[pos]:
            pos += 1 + d[pos]
        return pos + 1

    while pos < len(d):
        if d[pos] == 0x3B:
            return "gif", pos + 1 - at
        if d[pos] == 0x21:
            pos = blocks(pos + 2)
        elif d[pos] == 0x2C and pos + 10 <= len(d):
            local = d[pos + 9]
            pos = blocks(pos + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


class Places:
    """Where a mark stands in a text: listed once, then looked up, however many hits ask."""

    def __init__(self, data: bytes):
        self.data, self.lists = data, {}

    def of(self, mark: bytes) -> list[int]:
        if mark not in self.lists:
            self.lists[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self.lists[mark]

    def between(self, mark: bytes, low: int, high: int) -> list[int]:
        every = self.of(mark)
        return every[bisect.bisect_left(every, low) : bisect.bisect_left(every, high)]

    def archives(self) -> dict[int, int]:
        """Start -> end record, of the zips whose directory lies where the record says; the outermost of a start."""
        if "zip" not in self.lists:
            found = {}
            for end in self.of(b"PK\x05\x06"):
                if end + 22 <= len(self.data):
                    size, start = struct.unpack_from("<II", self.data, end + 12)
                    found[end - size - start] = end
            self.lists["zip"] = found
        return self.lists["zip"]


@lru_cache(maxsize=4)
def places(data: bytes) -> Places:
    return Places(data)


def _pdf(d: bytes, at: int):
    """Up to the last end mark before the next file whose cross-reference offset leads to one, or to the first mark."""
    if not d[at + 5 : at + 8].strip(b"0123456789") == b".":
        return None
    where = places(d)
    after = where.of(b"%PDF-")
    k = bisect.bisect_right(after, at)
    ends = where.between(b"%%EOF", at, after[k] if k < len(after) else len(d))
    if not ends or not where.between(b"obj", at, ends[-1])[:1]:
        return None
    for end in reversed(ends):
        told = re.search(rb"startxref\s+(\d{1,12})\s*$", d[max(at, end - 64) : end])
        if told and re.match(rb"\s*(?:xref\b|\d+\s+\d+\s+obj\b)", d[at + int(told[1]) : at + int(told[1]) + 40]):
            return "pdf", end + 5 - at
    first = ends[0]
    return ("pdf", first + 5 - at) if where.between(b"obj", at, first)[:1] else None


def _zip(d: bytes, at: int):
    end = places(d).archives().get(at)
    if end is None:
        return None
    size, start, note = struct.unpack_from("<IIH", d, end + 12)
    if d[at + start : at + start + 4] != b"PK\x01\x02":
        return None
    return ("zip", end + 22 + note - at) if end + 22 + note <= len(d) else None


def _flac(d: bytes, at: int):
    pos = at + 4
    if pos + 4 > len(d) or d[pos] & 0x7F or int.from_bytes(d[pos + 1 : pos + 4], "big") != 34:
        return None
    while pos + 4 <= len(d):
        last, size = d[pos] & 0x80, int.from_bytes(d[pos + 1 : pos + 4], "big")
        pos += 4 + size
        if pos > len(d):
            return None
        if last:  # frames have no total length: what follows a first frame's sync belongs to the stream
            return ("flac", len(d) - at) if d[pos : pos + 1] == b"\xff" and d[pos + 1] & 0xFC == 0xF8 else None
    return None


def _ogg(d: bytes, at: int):
    pos, pages = at, 0
    while d[pos : pos + 4] == b"OggS" and pos + 27 <= len(d):
        n = d[pos + 26]
        if d[pos + 4] or pos + 27 + n > len(d):
            break
        stop = pos + 27 + n + sum(d[pos + 27 : pos + 27 + n])
        if stop > len(d):
            break
        pos, pages = stop, pages + 1
    return ("ogg", pos - at) if pages else None


def _bmp(d: bytes, at: int):
    if at + 26 > len(d):
        return None
    size, zero, start, header = struct.unpack_from("<IIII", d, at + 2)
    if zero or header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= start <= size or at + size > len(d):
        return None
    return "bmp", size


def _isobmff(d: bytes, at: int):
    pos, boxes, kind = at, 0, "mp4"
    while pos + 8 <= len(d):
        size, name = struct.unpack_from(">I", d, pos)[0], d[pos + 4 : pos + 8]
        if size == 1 and pos + 16 <= len(d):
            size = struct.unpack_from(">Q", d, pos + 8)[0]
        if size < 8 or pos + size > len(d) or not name.isalnum():
            break
        if boxes == 0:
            if name != b"ftyp" or size % 4:
                return None
            brand = d[pos + 8 : pos + 12]
            kind = "heif" if brand in (b"heic", b"heix", b"mif1") else "avif" if brand == b"avif" else "mov" if brand == b"qt  " else "mp4"
        pos, boxes = pos + size, boxes + 1
    return (kind, pos - at) if boxes > 1 else None


def _gzip(d: bytes, at: int):
    if d[at + 3 : at + 4] > b"\x1f":  # reserved flags
        return None
    unpack = zlib.decompressobj(31)
    try:
        pos = at
        while pos < len(d) and not unpack.eof:
            unpack.decompress(d[pos : pos + 65536], 1 << 20)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            pos += 65536
    except zlib.error:
        return None
    return ("gzip", min(pos, len(d)) - at - len(unpack.unused_data)) if unpack.eof else None


VALIDATORS = {"riff": _riff, "png": _png, "jpeg": _jpeg, "gif": _gif, "pdf": _pdf, "zip": _zip, "flac": _flac, "ogg": _ogg, "bmp": _bmp, "isobmff": _isobmff, "gzip": _gzip}


@lru_cache(maxsize=1)
def automaton():
    """Over Latin-1 letters, so that one letter is one byte."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for magic, lead, name in SIGNATURES:
        out.add_word(magic.decode("latin-1"), (len(magic), lead, name))
    out.make_automaton()
    return out


def sniff(data: bytes, declared: str | None = None) -> dict:
    """type (confirmed at byte 0, else the declared one), corrected (whether it differs), length, and embedded
    media as (type, offset, length), outermost only and in order. Media inside a container that holds raw samples
    is looked for in its body."""
    found, kind, length, clear = [], declared, len(data), 0
    hits = sorted((end + 1 - size - lead, name) for end, (size, lead, name) in automaton().iter(data.decode("latin-1")))
    for at, name in hits:
        if at < clear and at > 0 or at < 0:
            continue
        confirmed = VALIDATORS[name](data, at)
        if confirmed is None:
            continue
        if at == 0:
            kind, length = confirmed
            # Sound samples may carry other media; the parts of other containers are not files of their own.
            clear = 0 if kind == "wav" else length
        else:
            found.append((confirmed[0], at, confirmed[1]))
            clear = at + confirmed[1]
    return {"type": kind, "corrected": kind != declared, "length": length, "embedded": found}


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored file (media)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([to_wave(pad_payload(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame, declared: str = "audio/unknown") -> DataFrame:
    """Read stored files back: payload and media digests, and what sniffing finds. A null file gives nulls."""
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature embedded".split()
    part_type = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), part_type]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc, n, media in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if media is None:
                        rows.append((doc, n, *[None] * 7))
                        continue
                    payload, seen = read_payload(media), sniff(media, declared)
                    inner = [{"type": k, "offset": o, "length": m} for k, o, m in seen["embedded"]]
                    feature = f"{seen['type']}:{seen['length']}:{SAMPLE_RATE}:" + ",".join(f"{x['type']}@{x['offset']}+{x['length']}" for x in inner)
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature, inner))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, embedded array<struct<type:string,offset:bigint,length:bigint>>")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_media(store_media(docs)).drop("embedded")
