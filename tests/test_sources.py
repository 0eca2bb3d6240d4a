"""Sources, sinks and streams."""

import os
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F


from photonlake.sources import config, files, images, sinks
from photonlake.streaming import sessions


def tiff(order="<", entries=(), gps=()):
    """A TIFF with an EXIF and a GPS directory; values are (tag, type, values)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8))

    def directory(items):
        start = len(out)
        out.extend(struct.pack(order + "H", len(items)) + bytes(12 * len(items)) + struct.pack(order + "I", 0))
        for k, (tag, kind, value) in enumerate(items):
            data = value if isinstance(value, bytes) else b"".join(struct.pack(order + {3: "H", 4: "I", 5: "II"}[kind], *(v if isinstance(v, tuple) else (v,))) for v in value)
            n = len(value) if isinstance(value, (bytes, list)) else 1
            at = start + 2 + 12 * k
            if len(data) > 4:
                place = struct.pack(order + "I", len(out))
                out.extend(data)
            else:
                place = data.ljust(4, b"\0")
            out[at : at + 12] = struct.pack(order + "HHI", tag, kind, n) + place
        return start

    main = [*entries, (0x8769, 4, [0]), (0x8825, 4, [0])]
    directory(main)
    exif = directory([(0x829A, 5, [(1, 250)]), (0x9003, 2, b"2020:01:02 03:04:05\0"), (0xA434, 2, b"Lens X\0")])
    where = directory(list(gps))
    for k, target in ((len(entries), exif), (len(entries) + 1, where)):
        at = 8 + 2 + 12 * k + 8
        out[at : at + 4] = struct.pack(order + "I", target)
    return bytes(out)


GPS = [(1, 2, b"S\0"), (2, 5, [(48, 1), (30, 1), (0, 1)]), (3, 2, b"E\0"), (4, 5, [(11, 1), (0, 1), (36, 1)])]


def jpeg(w, h, exif=b""):
    app = b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif if exif else b""
    return b"\xff\xd8" + app + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\1\x11\0" + b"\xff\xda\0\x08\1\1\0\0\x3f\0" + b"\x12\x34" + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    block = tiff(order, [(0x010F, 2, b"Canon\0"), (0x0110, 2, b"EOS 5\0"), (0x0112, 3, [6])], GPS)
    m = images.image_metadata(jpeg(40, 30, block))
    assert (m["format"], m["width"], m["height"], m["camera_make"], m["camera_model"], m["lens"], m["exposure_time"]) == ("jpeg", 30, 40, "Canon", "EOS 5", "Lens X", 1 / 250)
    assert m["gps_lat"] == -48.5 and abs(m["gps_lon"] - 11.01) < 1e-9 and m["taken"] == "2020:01:02 03:04:05"


def test_sizes_and_embedded():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 9) + bytes(5)
    assert [images.image_metadata(d)[k] for d in (png, b"GIF89a" + struct.pack("<HH", 3, 4), b"BM" + bytes(16) + struct.pack("<ii", 5, -6)) for k in ("width", "height")] == [7, 9, 3, 4, 5, 6]
    small, big = jpeg(10, 10), jpeg(100, 50)
    raw = b"junkjunk" + small + b"pad" + big
    assert [x[2:] for x in images.embedded_jpegs(raw)] == [(100, 50), (10, 10)]
    assert raw[images.embedded_jpegs(raw)[0][0] :] == big
    assert images.image_format(b"nothing") == "" and images.jpeg_size(b"\xff\xd8\xff\xe0\0\x10cut") is None
    box = lambda n, d: struct.pack(">I4s", 8 + len(d), n) + d
    heif = box(b"ftyp", b"heic" + bytes(8)) + box(b"meta", bytes(4) + box(b"iprp", box(b"ipco", box(b"ispe", bytes(4) + struct.pack(">II", 64, 48)) + box(b"irot", b"\1"))))
    m = images.image_metadata(heif)
    assert (m["format"], m["width"], m["height"]) == ("heif", 48, 64)


def test_damaged_files_stop_nothing(spark):
    good = jpeg(8, 6)
    rows = [("/a", bytearray(good)), ("/b", bytearray(b"??")), ("/c", bytearray(b"II*\0\xff\xff\xff\xff")), ("/d", bytearray(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 70000, 70000)))]
    got = {r.path: r for r in images.read_metadata(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["/a"].width == 8 and got["/b"].error == "unknown format" and got["/c"].format == "tiff" and "too many" in got["/d"].error


def test_listing_and_skips(spark, tmp_path):
    for name, data in (("a.jpg", b"x" * 10), ("b.txt", b"x"), ("sub/c.CR2", b"y" * 20), (".hid/d.jpg", b"z"), ("e.png", b"")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = files.listing(spark, str(tmp_path), min_size=1, content=True)
    rows = {os.path.basename(r.path): r for r in found.collect()}
    assert sorted(rows) == ["a.jpg", "c.CR2"]
    import hashlib

    size = (10).to_bytes(8, "little")
    fp = found.select("path", files.fingerprint(F.col("size"), F.col("content")).alias("f"), files.legacy_fingerprint(F.col("size"), F.col("content")).alias("g")).filter(F.endswith("path", F.lit("a.jpg"))).first()
    assert fp.f == hashlib.sha256(size + b"x" * 10).hexdigest()[:32] and fp.g == hashlib.sha1(size + b"x" * 20).hexdigest()[:24]
    known = found.filter(F.endswith("path", F.lit("a.jpg"))).select("path", "size", "mtime", F.lit(2).alias("version"))
    assert files.files_to_read(found, known, version=2).count() == 1 and files.files_to_read(found, known, version=3).count() == 2
    errors = files.record_errors(spark.createDataFrame([], "path string, size long, mtime long, error string, at long"), found.withColumn("error", F.lit("bad")), 5)
    assert files.files_to_read(found, known, errors).count() == 0 and files.files_to_read(found, known.limit(0), errors, retry=True).count() == 2


def test_config():
    assert config.parse_categories("# c\n\n dog : a dog | a puppy |\ncat: a cat") == [("dog", "a dog"), ("dog", "a puppy"), ("cat", "a cat")]
    with pytest.raises(ValueError, match="line 2"):
        config.parse_categories("dog: a dog\ncat a cat")
    s = config.Settings.read({"burst_gap": "5", "stack_hamming": "99", "scene_gap": "x", "stacking": "off"})
    assert (s.burst_gap, s.stack_hamming, s.scene_gap, s.stacking) == (5, 10, 10, False)


def test_screenshots(tmp_path):
    db = sqlite3.connect(tmp_path / "p.sqlite")
    db.execute("CREATE TABLE ZASSET (ZDIRECTORY, ZFILENAME, ZISDETECTEDSCREENSHOT, ZTRASHEDSTATE)")
    db.executemany("INSERT INTO ZASSET VALUES (?, ?, ?, ?)", [("A", "1.png", 1, 0), ("B", "2.png", 0, 0), ("C", "3.png", 1, 1)])
    db.commit()
    assert config.library_screenshots(str(tmp_path / "p.sqlite")) == ["A/1.png"]
    sqlite3.connect(tmp_path / "q.sqlite").execute("CREATE TABLE other (x)")
    assert config.library_screenshots(str(tmp_path / "q.sqlite")) == []


def test_sinks(spark, tmp_path):
    for n in ("x.jpg", "y.jpg"):
        (tmp_path / n).write_text(n)
    hits = spark.createDataFrame([(1, str(tmp_path / "x.jpg"), 71.26, 0), (2, str(tmp_path / "y.jpg"), 90.0, 86400)], "id long, path string, overall double, taken_at long")
    sinks.write_listing(hits, str(tmp_path / "csv"), "csv")
    assert sorted(r.overall for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv")).collect()) == [71.3, 90.0]
    with pytest.raises(ValueError):
        sinks.write_listing(hits, str(tmp_path / "z"), "xml")
    out = tmp_path / "export"
    assert sinks.export_files(hits, [F.col("overall").desc()], str(out), 5) == 2 and sorted(os.listdir(out)) == ["0001_y.jpg", "0002_x.jpg"]
    assert sinks.export_files(hits, [F.col("overall").desc()], str(out), 5, link=True) == 0


def test_stream_bursts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "value")
    src = str(tmp_path / "in")
    for part in range(3):
        events.orderBy("ts").filter(F.floor(F.col("event_id") / 334) == part).coalesce(1).write.mode("append").parquet(src)
    # A last event far ahead moves the watermark past every session.
    events.limit(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit("2025-01-01").cast("timestamp")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), "value").coalesce(1).write.mode("append").parquet(src)
    stream = sessions.stream_bursts(sessions.event_stream(spark, src, events.schema, 10), "user_id", "ts", "4 hours", "30 days")
    got = {(r.user_id, r.burst_id, r.size) for r in sessions.run_available(stream, str(tmp_path / "cp"), str(tmp_path / "out")).collect()}
    assert got == {(r.user_id, r.burst_id, r.size) for r in sessions.batch_bursts(events, "user_id", "ts", "4 hours").collect()}


def test_refresh_index_keeps_the_latest(spark, tmp_path):
    src, at = str(tmp_path / "in"), lambda n: str(tmp_path / f"v{n}")
    schema = "id long, seq long, v string"
    for rows in ([(1, 1, "a"), (2, 2, "b"), (1, 3, "c")], [(2, 4, "d"), (3, 5, "e")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    sessions.refresh_index(stream, at, ["id"], "seq", str(tmp_path / "cp"))
    assert {tuple(r) for r in spark.read.parquet(at(1)).collect()} == {(1, 3, "c"), (2, 4, "d"), (3, 5, "e")}
