"""Column functions on edge cases."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.functions import paths, scores, text, times, vectors


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_paths(spark):
    cases = {
        "/a/b/c.jpg": ("/a/b/c.jpg", "/a/b", "c.jpg"), "/a": ("/a", "/", "a"), "/": ("/", "", "/"), "/a/b/": ("/a/b", "/a/b", "/a/b/"), "C:\\x\\y": ("C:\\x\\y", "C:\\x", "y"),
        "C:": ("C:", "", "C:"), "C:/x": ("C:/x", "C:", "x"), "/a\\b/c": ("/a\\b/c", "/a\\b", "c"), "": ("", "", ""), "///": ("/", "//", "///"),
    }
    got = values(spark, [(p,) for p in cases], "p string", "p", paths.trim_dir(F.col("p")), paths.parent_dir(F.col("p")), paths.folder_name(F.col("p")))
    assert {g[0]: g[1:] for g in got} == cases


def test_in_dir_and_children(spark):
    rows = [("/a/b", "/a", True), ("/a", "/a", True), ("/ab", "/a", False), ("/a\\b", "/a", False), ("C:\\a\\b", "C:\\a", True), ("C:\\a/b", "C:\\a\\", True), ("/x", "/", True), ("C:", "/", False)]
    got = values(spark, rows, "p string, d string, w boolean", paths.in_dir(F.col("p"), F.col("d")), "w")
    assert all(a == b for a, b in got)
    kids = values(spark, [("/a/b/c",), ("/a/c",), ("/x/y/z",)], "p string", paths.child_of(F.col("p"), "/a"))
    assert kids == [("b",), (None,), (None,)]


def test_libraries_and_caches(spark):
    rows = [
        ("/p/L.photoslibrary/originals/1/x.jpg", False), ("/p/L.photoslibrary/resources/x.jpg", True), ("/p/L.PhotosLibrary/MASTERS/x.jpg", False), ("/p/a.aplibrary/Previews/x.jpg", True),
        ("/p/CaptureOne/x.jpg", True), ("/p/c.cocatalog/Originals/x.jpg", False), ("C:\\q\\c.cocatalog\\Cache\\x.jpg", True), ("/plain/x.jpg", False),
    ]
    got = values(spark, rows, "p string, w boolean", paths.in_app_cache(F.col("p")), "w", paths.library_parts(F.col("p")), paths.is_library_original(paths.library_parts(F.col("p"))["rest"]))
    assert all(g[0] == g[1] for g in got)
    assert tuple(got[0][2]) == ("/p/L.photoslibrary", "originals/1/x.jpg") and got[0][3] and got[2][3] and not got[1][3] and tuple(got[7][2]) == ("", "")
    uuid = "0a1b2c3d-0000-1111-2222-333344445555"
    assert values(spark, [(f"/x/{uuid}_1.jpg",), ("/x/y.jpg",)], "p string", paths.original_uuid(F.col("p"))) == [(uuid.upper(),), ("",)]


def test_exclusions(spark):
    rows = [("/a/.hidden/x.jpg", True), ("/a/.x.jpg", False), ("/a/._x.jpg", True), ("/a/@eaDir/x.jpg", True), ("/a/b.lrdata/x.jpg", True), ("/a/$RECYCLE.BIN/x.jpg", True), ("/a/tmp1/x.jpg", True), ("/a/keep/x.jpg", False), ("/secret/x.jpg", True)]
    got = values(spark, rows, "p string, w boolean", paths.excluded(F.col("p"), ["tmp?", "/secret"]), "w", "p")
    assert [g for g in got if g[0] != g[1]] == []


def test_times(spark):
    rows = [("2020:01:02 03:04:05", None, 1577934245), ("2020-01-02 03:04:05.678", "+01:30", 1577934245 - 5400), ("0000:00:00 00:00:00", None, 0), ("nonsense", None, 0), (None, None, 0)]
    got = values(spark, rows, "t string, o string, w long", times.exif_time(F.col("t"), F.col("o")), "w")
    assert all(a == b for a, b in got)
    assert times.year_start(1970) == 0 and times.year_start(1968) < 0
    at = [0, -1, int(dt.datetime(2024, 2, 29, 12, tzinfo=dt.timezone.utc).timestamp())]
    assert values(spark, [(a,) for a in at], "a long", times.taken_year(F.col("a")), times.taken_label(F.col("a")), times.month_label(F.col("a"))) == [(None, "----------", ""), (1969, "----------", "December 1969"), (2024, "2024-02-29", "February 2024")]


def test_gps_and_lenses(spark):
    got = values(spark, [(48.0, 30.0, 0.0, "S"), (91.0, 0.0, 0.0, "N")], "d double, m double, s double, r string", times.gps_degrees(*[F.col(c) for c in "dmsr"], 90))
    assert got == [(-48.5,), (None,)]
    assert values(spark, [("Canon", "EF 50"), ("canon", "Canon EF"), (None, "X")], "a string, b string", times.lens_name(F.col("a"), F.col("b"))) == [("Canon EF 50",), ("Canon EF",), ("X",)]
    assert values(spark, [(24.0, 70.0, 2.8, 4.0), (50.0, 50.0, 1.8, 1.8)], "a double, b double, c double, d double", times.lens_range(*[F.col(c) for c in "abcd"])) == [("24-70mm f/2.8-4",), ("50mm f/1.8",)]
    assert values(spark, [(0.004,), (2.0,), (0.0,)], "e double", times.shutter_label(F.col("e"))) == [("1/250 s",), ("2 s",), ("",)]


def test_text(spark):
    assert text.like_pattern("50%_\\") == "%50\\%\\_\\\\%"
    assert values(spark, [("Ann  Lee's Model!",), ("--x.y--",), ("A" * 50,)], "s string", text.model_slug(F.col("s"))) == [("ann-lee-s-model",), ("x.y",), ("a" * 40,)]
    assert values(spark, [("ÄB",)], "s string", text.ascii_lower(F.col("s")), text.contains_literal(F.col("s"), "b")) == [("Äb", True)]
    assert text.unicode_spellings("é") == ["é", "e\u0301"] and text.unicode_spellings("a") == ["a"]
    assert values(spark, [("ﬁne &amp;amp;  Café \n ＡＢ",), ("Caf\u00c3\u00a9",), (None,)], "s string", text.clean_text(F.col("s"))) == [("fine & café ab",), ("café",), (None,)]
    assert values(spark, [("Ｓtraße",), (None,)], "s string", text.name_key(F.col("s"))) == [("strasse",), (None,)]
    assert values(spark, [("Canon", "EOS"), (None, "EOS"), ("", "")], "a string, b string", text.camera_label(F.col("a"), F.col("b"))) == [("Canon EOS",), ("EOS",), ("",)]


def test_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = lambda x: F.lit(float(x))
    assert one(scores.overall(lit(80), F.lit(None).cast("double"))) == 80 and one(scores.overall(lit(80), lit(5.5))) == 65.0 and one(scores.overall(lit(80), lit(99))) == 90.0
    assert one(scores.exposure_score(lit(0.5), lit(0), lit(0), lit(0.8))) == 1 and abs(one(scores.exposure_score(lit(0.2), lit(0.02), lit(0), lit(0.4))) - (1 - 0.04 - 0.2 - 0.08)) < 1e-12
    assert one(scores.color_score(lit(50), F.lit(True))) == 1 and one(scores.color_score(lit(12), F.lit(False))) == 0
    assert [one(scores.cast_label(lit(a), lit(b), lit(s))) for a, b, s in [(1, 0, 2), (0, 1, 5), (1, 0, 5), (0, -1, 5), (-1, 0, 5)]] == ["neutral", "warm/yellow", "magenta", "cool/blue", "green"]
    assert abs(one(scores.technical(lit(70), lit(0.5), lit(0.5), lit(2.0))) - 70 * 0.95 * 0.95 * 0.8) < 1e-9
    assert one(scores.badges(lit(0.1), lit(0.9), lit(0.05), F.lit(False), lit(2))) == ["soft", "cast", "jpeg"]
    assert 0 < one(scores.face_focus_score(lit(70))) < 1 and one(scores.face_focus_score(lit(5))) == 0


def test_rating_model(spark):
    m = scores.RatingModel(["a", "b"], ["a"], [0.0, 1.0], [1.0, 2.0], [[0, 0], [1, 0], [0, 2]], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0], [0.0, 0.1, 0.05], 0.3)
    got = spark.createDataFrame([(math.e - 1, 5.0)], "a double, b double").select(m.column().alias("v")).first().v
    assert abs(got - 100 * (0.3 + 0.1 + 0.05 * 4)) < 1e-9


def test_vectors(spark):
    rows = [([1.0, -2.0, 0.5],), ([0.0, 0.0, 0.0],)]
    got = values(spark, rows, "v array<float>", vectors.quantise(F.col("v")), vectors.norm(F.col("v")))
    assert [list(g[0].q) for g in got] == [[64, -127, 32], [0, 0, 0]] and got[1][0].scale == 0
    exact = spark.createDataFrame(rows, "v array<float>").select(vectors.dot_quantised(vectors.quantise(F.col("v")), vectors.quantise(F.col("v")))).first()[0]
    assert abs(exact - 5.25) < 0.05
    half = spark.createDataFrame([([1.0, -0.333, 65504.0],)], "v array<float>").select(vectors.decode_half(vectors.encode_half(F.col("v"))).alias("v")).first().v
    assert np.allclose(half, [1.0, -0.333, 65504.0], rtol=1e-3)
    tie = np.float32(1 + 2**-11)
    assert np.frombuffer(vectors.encode_half_array(np.array([tie, -tie])), "<f2").tolist() == [1 + 2**-10, -(1 + 2**-10)]
    h = spark.createDataFrame([([float(i) for i in range(64)],)], "v array<float>").select(vectors.median_hash(F.col("v")).alias("h")).first().h
    assert h == 2**32 - 1


@pytest.mark.parametrize(("v", "digits", "want"), [(0.125, 2, 0.13), (-0.125, 2, -0.13), (1.25, 1, 1.3)])
def test_round_half_away(spark, v, digits, want):
    assert spark.range(1).select(scores.round_to(F.lit(v), digits)).first()[0] == want
