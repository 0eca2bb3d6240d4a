"""Operators without a SQL form against plain models, and edge cases as small tables."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from photonlake import schemas
from photonlake.operators import accounts, folders, grouping, maintenance, matching, people, scoring, sessions, training, vector_search
from photonlake.operators.filters import Filter, Related, apply_filter, visible_frames
from photonlake.operators.ordering import group_order, page, photo_order, split_page

DEFAULTS = {"camera_make": "", "camera_model": "", "lens": "", "path": "", "taken_at": 0, "phash": 0, "technical": 0.0, "overall": 0.0, "focus_score": 0.0, "sharpness": 0.0, "colorfulness": 0.0, "face_count": 0, "monochrome": False, "noise": 0.0, "blockiness": 1.0, "exposure_score": 0.0, "cast_strength": 0.0, "source": 0, "stacked": False, "stack_top": 0, "seq": 0, "apple_shot": False}


def photos(spark, rows):
    names = [f.name for f in schemas.empty_table(spark, "photos").schema]
    full = [DEFAULTS | {"id": i + 1} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schemas.PHOTOS)


def ids(df):
    return [r.id for r in df.collect()]


# filters


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        ({"path_contains": "IMG_1"}, [1]), ({"path_contains": "50%"}, [3]), ({"path_contains": "b\\C"}, [5]), ({"lens": "l_ii"}, [6]), ({"camera": "non eos"}, [1]),
        ({"max_cast": 3.0}, [1, 2, 3, 4, 5, 6, 8]), ({"min_aesthetic": 5.0}, [8]), ({"mono": "only"}, [8]), ({"faces": "group"}, [7]), ({"source": "photos"}, [1, 2, 3, 4, 5, 6, 7]),
        ({"time_to": 100}, [1, 2, 3, 4, 5, 6, 8]), ({"year": 1969}, [8]), ({"year_from": 2001, "year_to": 1999}, [7]),
    ],
)
def test_filter_terms(spark, f, expected):
    p = photos(spark, [
        {"path": "/IMG_1", "camera_make": "Canon", "camera_model": "EOS"}, {"path": "/IMGX1"}, {"path": "/50%"}, {"path": "/500"}, {"path": "/b\\c"}, {"lens": "EF 70-200 L_II"},
        {"taken_at": 978307200, "face_count": 3, "cast_strength": 9.0}, {"taken_at": -5, "cast_strength": 9.0, "monochrome": True, "aesthetic": 6.0, "source": 3},
    ])
    assert sorted(ids(apply_filter(p, Filter(**f)))) == expected


def test_filter_memberships_and_tests(spark):
    p = photos(spark, [{}, {}, {}])
    side = Related(tags=spark.createDataFrame([(1, "Dog"), (2, "dog")], "photo_id long, tag string"), stars=spark.createDataFrame([(7, 3)], "user_id long, photo_id long"), faces=spark.createDataFrame([(2, 9), (2, 9)], "photo_id long, person_id long"))
    assert ids(apply_filter(p, Filter(tag="dog"), side)) == [2]
    assert ids(apply_filter(p, Filter(starred=True, starred_by=7), side)) == [3]
    assert ids(apply_filter(p, Filter(person_id=9), side)) == [2]
    assert not Filter(sort="worst", limit=3).restricts() and Filter(source="photos").restricts() and not Filter(source="photos", dirs=("/a",)).narrows()
    with pytest.raises(ValueError):
        Filter(min_overall=math.nan)


def test_ascii_case_only(spark):
    p = photos(spark, [{"path": "/Ä.jpg"}, {"path": "/ä.jpg"}])
    assert ids(apply_filter(p, Filter(path_contains="ä.JPG"))) == [2]


@pytest.mark.parametrize(("f", "expected"), [({}, [2, 5, 6]), ({"min_overall": 75.0}, [2, 5]), ({"dirs": ("/x",)}, [1, 3])])
def test_hidden_frames_show_when_their_top_fails(spark, f, expected):
    rows = [{"overall": 70.0, "path": "/x/1"}, {"overall": 90.0, "path": "/y/2"}, {"overall": 60.0, "path": "/x/3"}, {"overall": 80.0, "path": "/y/4"}]
    rows = [r | {"stack_top": 2, "stacked": i != 1} for i, r in enumerate(rows)] + [{"overall": 95.0, "path": "/y/5"}, {"overall": 50.0, "path": "/y/6"}]
    assert sorted(ids(visible_frames(apply_filter(photos(spark, rows), Filter(**f))))) == expected


def test_orders_and_pages(spark):
    p = photos(spark, [{"taken_at": t, "overall": o, "aesthetic": a} for t, o, a in [(5, 1.0, None), (-5, 2.0, 3.0), (0, 2.0, 4.0), (9, None, 1.0)]])
    assert ids(page(p, photo_order("oldest"), 10)) == [1, 4, 2, 3]
    assert ids(page(p, photo_order("aesthetic"), 10)) == [3, 2, 4, 1]
    assert ids(page(p, photo_order("nonsense"), 10)) == [2, 3, 1, 4]
    rows, more = split_page(page(p, photo_order("overall"), 2, 1).collect(), 2)
    assert [r.id for r in rows] == [3, 1] and more
    g = spark.createDataFrame([(1, 5, 0), (2, 5, 7), (3, 5, 7)], "id long, end_at long, oldest_at long")
    assert ids(g.orderBy(*group_order("oldest"))) == [3, 2, 1]


# sessions and groups


def naive_groups(rows, gap, scene_gap, bits, limit):
    """Plain reading of the rules: cameras, scenes, bursts, chunks, stacks and duplicate sets."""
    out = {r["id"]: {"burst_id": 0, "stack_top": 0, "stack_size": 0, "stacked": False, "dup_id": 0} for r in rows}
    cameras = {}
    for r in rows:
        if r["taken_at"]:
            cameras.setdefault((r["camera_make"], r["camera_model"]), []).append(r)
    for frames in cameras.values():
        frames.sort(key=lambda r: (r["taken_at"], r["id"]))
        scene = []
        for k, r in enumerate(frames):
            if k and r["taken_at"] - frames[k - 1]["taken_at"] > max(gap, scene_gap):
                naive_scene(scene, gap, bits, limit, out)
                scene = []
            scene.append(r)
        naive_scene(scene, gap, bits, limit, out)
    hashes = {}
    for r in rows:
        if r["phash"]:
            hashes.setdefault(r["phash"], []).append(r["id"])
    for group in hashes.values():
        if len(group) > 1:
            for i in group:
                out[i]["dup_id"] = min(group)
    return out


def naive_scene(frames, gap, bits, limit, out):
    runs = []
    for k, r in enumerate(frames):
        if not k or r["taken_at"] - frames[k - 1]["taken_at"] > gap:
            runs.append([])
        runs[-1].append(r)
    chunk = []
    for run in [*runs, None]:
        if run is None or len(run) > limit or len(chunk) + len(run) > limit:
            naive_stack(chunk, bits, out)
            chunk = []
        if run is None:
            return
        if len(run) > 1:
            for r in run:
                out[r["id"]]["burst_id"] = min(x["id"] for x in run)
        if len(run) <= limit:
            chunk += run


def naive_stack(frames, bits, out):
    order = sorted(frames, key=lambda r: (-r["overall"], r["id"]))
    taken = set()
    for i, top in enumerate(order):
        if top["id"] in taken or not top["phash"]:
            continue
        near = [r for r in order[i:] if r["id"] not in taken and r["phash"] and ((r["phash"] ^ top["phash"]) & (2**64 - 1)).bit_count() <= bits]
        if len(near) > 1:
            for r in near:
                taken.add(r["id"])
                out[r["id"]] |= {"stack_top": top["id"], "stack_size": len(near), "stacked": r is not top}


@pytest.mark.parametrize(("gap", "bits", "scene", "limit"), [(3, 6, 0, 1000), (1, 2, 0, 1000), (20, 10, 0, 1000), (3, 10, 600, 5), (3, 6, 60, 8)])
def test_regroup_equals_plain_model(spark, gap, bits, scene, limit):
    rng = random.Random(2)
    rows, at, h = [], 1000, rng.getrandbits(63)
    for i in range(400):
        at += rng.randint(0, 2) if rng.random() > 1 / 6 else rng.randint(4, 103)
        if rng.random() < 0.25:
            h = rng.getrandbits(63)
        frame = h
        for _ in range(rng.randint(0, 9)):
            frame ^= 1 << rng.randrange(63)
        rows.append({"id": i + 1, "taken_at": 0 if rng.random() < 0.05 else at, "camera_make": "", "camera_model": rng.choice(["A", "B", "", "C"]), "phash": 0 if rng.random() < 0.05 else frame, "overall": float(rng.randrange(20))})
    rows += [{"id": 500 + i, "taken_at": 5000, "camera_make": "", "camera_model": "CAM", "phash": h ^ i, "overall": float(i % 5)} for i in range(12)]
    rows += [rows[i] | {"id": 600 + i} for i in range(20)]
    columns, groups = grouping.regroup(photos(spark, rows), gap, bits, scene, limit)
    got = {r.id: r.asDict() for r in columns.collect()}
    want = naive_groups(rows, gap, scene, bits, limit)
    assert {i: {k: v for k, v in r.items() if k != "id"} for i, r in got.items()} == want
    by = {(r.kind, r.id): r.members for r in groups.collect()}
    for kind, name in ((1, "burst_id"), (2, "dup_id")):
        sets = {}
        for i, r in want.items():
            if r[name]:
                sets.setdefault(r[name], []).append(i)
        assert {k[1]: v for k, v in by.items() if k[0] == kind} == {k: sorted(v) for k, v in sets.items()}


def test_stack_does_not_chain(spark):
    rows = [(1, 5.0, 1), (2, 9.0, 3), (3, 1.0, 2), (4, 4.0, 0b1111), (5, 8.0, 0), (6, 7.0, 1 << 40), (7, 7.0, 1 << 40)]
    f = spark.createDataFrame([("k", *r) for r in rows], "k string, id long, overall double, phash long")
    got = {r.id: (r.stack_top, r.stack_size, r.stacked) for r in grouping.stack_frames(f, ["k"], 1).collect()}
    assert got == {1: (2, 3, True), 2: (2, 3, False), 3: (2, 3, True), 6: (6, 2, False), 7: (6, 2, True)}


def test_chunks_of_a_long_scene(spark):
    rows = [("c", 0, run, 100 * run + k) for run, n in enumerate([2, 3, 2, 1, 7, 2, 2, 1]) for k in range(n)]
    f = spark.createDataFrame(rows, "k string, scene long, run long, id long")
    got = {r.run: r.chunk for r in sessions.pack_chunks(f, ["k"], 5).collect()}
    assert got[0] == got[1] and got[2] == got[3] != got[0] and got[4] == -1 and got[5] == got[6] == got[7] not in (got[2], -1)


# folders


def naive_folders(rows):
    out = {}
    for r in rows:
        unix = r["path"].startswith("/")
        parts = r["path"].replace("\\", "/").split("/") if not unix else r["path"].split("/")
        ups, n = [], 0
        for part in parts[:-1]:
            n += len(part)
            ups.append(r["path"][:n] or "/")
            n += 1
        for u in ups:
            f = out.setdefault(u, {"total": 0, "cover": None, "newest_at": 0, "scored": 0, "sum": 0.0, "memes": 0})
            f["total"] += 1
            key = ((r["overall"] or 0.0) - (1000 if r["source"] == 3 else 0), -r["id"])
            f["cover"] = max(f["cover"] or (-math.inf, 0), key)
            if r["taken_at"] and (not f["newest_at"] or r["taken_at"] > f["newest_at"]):
                f["newest_at"] = r["taken_at"]
            f["scored"] += r["overall"] is not None
            f["sum"] += r["overall"] or 0.0
            f["memes"] += r["source"] == 3
    return out


def test_rollup_equals_plain_model(spark):
    rng = random.Random(3)
    names = ["a b", "a-b", "a0", "a.b", "a\\b", "Ä", "x"]
    rows = []
    for i in range(200):
        parts = [rng.choice(names) for _ in range(rng.randint(1, 4))]
        path = "/" + "/".join(parts) + f"/{i}.jpg" if rng.random() > 0.2 else "C:\\" + "\\".join(p.replace("\\", "") for p in parts) + f"\\{i}.jpg"
        rows.append({"id": i, "path": path, "taken_at": rng.choice([0, 5, -7, 100 + i]), "overall": rng.choice([None, 1.0, 50.0, 50.0, 90.0]), "source": rng.randrange(4)})
    got = {r.path: r for r in folders.rollup(photos(spark, rows)).collect()}
    want = naive_folders(rows)
    assert got.keys() == want.keys()
    for p, f in want.items():
        r = got[p]
        assert (r.total, r.cover_overall, r.cover_id, r.newest_at, r.scored, round(r.score_sum, 6), r.memes) == (f["total"], f["cover"][0], -f["cover"][1], f["newest_at"], f["scored"], round(f["sum"], 6), f["memes"])


def test_subtree_boundaries_and_roots(spark):
    p = photos(spark, [{"path": x} for x in ["/a/b/1", "/a/b2/1", "/a/b.jpg", "/a/b 1/x", "/a/b\\c", "/a/b", "C:\\a\\1", "C:/a/2", "C:\\ab\\3"]])
    got = lambda *d: sorted(ids(apply_filter(p, Filter(dirs=d))))
    assert got("/a/b") == [1] and got("/") == [1, 2, 3, 4, 5, 6] and got("C:\\a") == [7]
    r = folders.deepest_root(p.select("path"), spark.createDataFrame([("/a",), ("/a/b",), ("/",)], "path string"))
    assert {x.path: x.root for x in r.collect()}["/a/b/1"] == "/a/b" and {x.path: x.root for x in r.collect()}["/a/b2/1"] == "/a"


# vectors, people


def test_knn_is_exact_and_filters_first(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    s = v @ v[17]
    best = sorted(range(300), key=lambda i: (-s[i], i))
    assert ids(vector_search.knn(df, v[17], 9)) == best[:9]
    odd = df.filter("id % 2 = 1").select("id")
    assert ids(vector_search.knn_filtered(df, odd, v[17], 5)) == [i for i in best if i % 2][:5]
    many = vector_search.knn_many(df, spark.createDataFrame([(0, v[17].tolist()), (1, v[3].tolist())], "id long, embedding array<double>"), 4, block=1).filter("query = 0").orderBy("rank")
    assert ids(many) == best[:4]
    plan = vector_search.knn(df, v[17], 9)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_farthest_points_and_leaders():
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [-1, 0], [0.6, 0.8]])
    assert people.farthest_points(v, 3) == [0, 3, 2] and people.farthest_points(v, 9) == [0, 1, 2, 3, 4]
    assert people.leader_clusters(v, 0.5).tolist() == [0, 0, 1, 2, 1]


def test_labels_need_threshold_and_margin_and_spare_hands(spark):
    rows = [(1, 1, [1.0, 0.0, 0.0], 7, "manual"), (2, 1, [0.0, 1.0, 0.0], 8, "manual"), (3, 2, [0.9, 0.1, 0.42], None, None), (4, 2, [0.7, 0.69, 0.1], None, None), (5, 3, [0.0, 0.0, 1.0], 9, "auto"), (6, 3, [0.1, 0.95, 0.0], 7, "auto")]
    f = spark.createDataFrame([(*r, None) for r in rows], "id long, photo_id long, embedding array<double>, person_id long, person_source string, person_sim double")
    labels = people.propagate_labels(f, people.exemplars(f))
    assert {(r.id, r.person_id) for r in labels.collect()} == {(3, 7), (6, 8)}
    after = {r.id: (r.person_id, r.person_source) for r in people.apply_labels(f, labels).collect()}
    assert after == {1: (7, "manual"), 2: (8, "manual"), 3: (7, "auto"), 4: (None, None), 5: (None, None), 6: (8, "auto")}
    only = people.propagate_labels(f, people.exemplars(f), only=8)
    assert [r.id for r in only.collect()] == [6]
    with pytest.raises(ValueError):
        people.propagate_labels(f, people.exemplars(f), math.nan)


def test_label_tables(spark):
    p = spark.createDataFrame([(1, "Ann", 0), (2, "Bob", 0)], "id long, name string, created_at long")
    f = spark.createDataFrame([(1, 1, 1, "manual", None), (2, 1, 2, "manual", None)], "id long, photo_id long, person_id long, person_source string, person_sim double")
    assert people.ensure_person(p, " ANN ", 5).count() == 2 and people.ensure_person(p, "Cy", 5).filter("id = 3").count() == 1
    p2, f2 = people.rename_person(p, f, 2, "ann")
    assert ids(p2) == [1] and {r.person_id for r in f2.collect()} == {1}
    with pytest.raises(ValueError):
        people.assign(f, spark.createDataFrame([(99,)], "id long"), 1)
    assert people.delete_person(p, f, 1)[1].filter("person_id is null").count() == 1


# training


@pytest.mark.parametrize("n", [5, 200])
def test_ridge_gradient_vanishes(n):
    rng = np.random.default_rng(1)
    x, w0 = rng.normal(size=(n, 8)), rng.normal(size=8)
    y, c = x @ rng.normal(size=8) + 0.01 * rng.normal(size=n), rng.uniform(0.5, 1, n)
    w, b = training.fit_ridge(x, y, c, w0, 0.3, 0.7)
    rest = c * (x @ w + b - y)
    assert abs(x.T @ rest + 0.7 * (w - w0)).max() < 1e-8 and abs(rest.sum() * training.BIAS_FREEDOM**2 + 0.7 * (b - 0.3)) < 1e-6
    assert np.allclose(training.fit_ridge(x, y, c, w0, 0.3, 1e12)[0], w0, atol=1e-6)
    with pytest.raises(ValueError):
        training.fit_ridge(x, y, c * 0, w0, 0.3, 1.0)


def test_normal_equations_add_up(spark):
    rng = np.random.default_rng(2)
    x, y, c = rng.normal(size=(60, 3)), rng.normal(size=60), rng.uniform(0.1, 1, 60)
    df = spark.createDataFrame([(a.tolist(), float(b), float(d)) for a, b, d in zip(x, y, c, strict=True)], "x array<double>, y double, c double").repartition(5)
    a, r = training.normal_equations(df)[None]
    z = np.hstack([x, np.full((60, 1), training.BIAS_FREEDOM)])
    assert np.allclose(a, (z * c[:, None]).T @ z) and np.allclose(r, z.T @ (c * y))
    w0 = rng.normal(size=3)
    w, b = training.fit_ridge(x, y, c, w0, 0.3, 0.7)
    assert np.allclose(training.solve_toward(a, r, w0, 0.3, 0.7), [*w, b])


def test_select_pull_equals_small_cross_validation(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 4))
    pdf = pd.DataFrame({"x": list(x), "y": x @ [1, -1, 0.5, 0] + rng.normal(size=150) * 2, "c": rng.choice([0.5, 1.0], 150), "rated": True, "fold": np.arange(150) % 5})
    df = spark.createDataFrame([(r.x.tolist(), r.y, r.c, r.fold) for r in pdf.itertuples()], "x array<double>, y double, c double, fold int").repartition(4)
    got = {r.pull: r for r in training.select_pull(df, np.zeros(4), 0.0).collect()}
    small = training.train(spark, pdf, np.zeros(4), 0.0)
    assert [p for p, r in got.items() if r.chosen] == [small.pull]
    assert abs(math.sqrt(got[small.pull].mse) - small.rmse) < 1e-9


def test_training_accepts_taste_and_rejects_noise(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 8))
    base = pd.DataFrame({"x": list(x), "c": 1.0, "rated": True, "fold": np.arange(240) % 5})
    taste = training.train(spark, base.assign(y=5 + x @ rng.normal(size=8)), np.zeros(8), 5.0)
    noise = training.train(spark, base.assign(y=5 + rng.normal(size=240)), np.zeros(8), 5.0)
    assert taste.better and taste.rho > 0.9 and not noise.better
    with pytest.raises(ValueError):
        training.train(spark, base.head(5).assign(y=1.0), np.zeros(8), 5.0)


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 300).astype(float), "b": rng.integers(0, 20, 300).astype(float)})
    want = pdf.a.rank().corr(pdf.b.rank())
    assert abs(training.spearman_column(spark.createDataFrame(pdf), "a", "b").first().rho - want) < 1e-9
    assert abs(training.spearman(pdf.a.to_numpy(), pdf.b.to_numpy()) - want) < 1e-9


# matching and upkeep


def test_twins_are_certain_or_none(spark):
    h = 0b1111000011110000
    orig = [(1, 100, "C", h), (2, 100, "C", h ^ 1), (3, 500, "C", 77 << 20), (4, 900, "D", 1 << 30), (5, 901, "D", 1 << 30), (6, 1500, "C", 5 << 40), (7, 1500, "C", 6 << 40)]
    copies = [(11, 100, "C", h), (12, 501, "C", (77 << 20) ^ 3), (13, 900, "D", 1 << 30), (14, 0, "C", 3), (15, 1500, "C", 7 << 40), (16, 800, "D", 1 << 30), (17, 501, "", (77 << 20) ^ 3)]
    build = lambda rows: spark.createDataFrame([(i, t, "m", c, p) for i, t, c, p in rows], "id long, taken_at long, camera_make string, camera_model string, phash long")
    got = {r.id: r.twin for r in matching.twins(build(copies), build(orig)).collect()}
    assert got == {11: 1, 12: 3}


def test_twin_within_second_breaks_a_tie(spark):
    build = lambda rows: spark.createDataFrame([(i, t, "m", "D", 9) for i, t in rows], "id long, taken_at long, camera_make string, camera_model string, phash long")
    assert [(r.id, r.twin) for r in matching.twins(build([(10, 900)]), build([(4, 901), (5, 990)])).collect()] == [(10, 4)]


def test_boxes(spark):
    b = np.array([[0, 0, 9, 9], [1, 1, 10, 10], [20, 20, 30, 30], [0, 0, 9, 9]], float)
    assert matching.keep_boxes(b, np.array([0.5, 0.9, 0.1, 0.4]), 0.4).tolist() == [1, 2]
    f = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0, 5, "manual"), (2, 1, 0.0, 0.0, 0.9, 1.0, 6, "manual"), (3, 2, 0.0, 0.0, 1.0, 0.95, None, None), (4, 2, 0.0, 0.0, 0.9, 0.9, None, "auto"), (5, 2, 0.0, 0.0, 1.0, 1.0, 9, "manual")], "id long, photo_id long, x1 double, y1 double, x2 double, y2 double, person_id long, person_source string")
    moved = matching.move_labels(spark.createDataFrame([(1, 2)], "copy long, original long"), f)
    assert {(r.face_id, r.person_id) for r in moved.collect()} == {(3, 5), (4, 6)}


def test_file_kinds(spark):
    known = spark.createDataFrame([("f1", 10, "/old/1", False), ("f2", 20, "/old/2", True)], "fingerprint string, size long, path string, exists boolean")
    found = spark.createDataFrame([("/n/1", 10, "f1"), ("/n/2", 20, "f2"), ("/n/3", 5, "f3")], "path string, size long, fingerprint string")
    assert {r.path: r.kind for r in matching.classify_files(found, known).collect()} == {"/n/1": "moved", "/n/2": "copied", "/n/3": "new"}


def test_prune_holds_offline_folders_and_spares_personal_copies(spark):
    p = spark.createDataFrame([(1, "/d/1"), (2, "/d/2"), (3, "/e/1"), (4, "/L.photoslibrary/resources/4"), (5, "/L.photoslibrary/resources/5")], "id long, path string")
    there = spark.createDataFrame([("/d/1",), ("/L.photoslibrary/resources/5",)], "path string")
    mine = spark.createDataFrame([(4,)], "id long")
    fates = lambda **k: {r.id: r.fate for r in maintenance.prune(p, there, mine, **k).collect()}
    assert fates() == {2: "gone", 3: "held", 4: "spared"} and fates(force=True)[3] == "gone"
    with pytest.raises(RuntimeError):
        maintenance.prune_allowed(True, 2)


def test_save_keeps_ids_and_scores(spark):
    old = photos(spark, [{"path": "/a", "fingerprint": "x", "aesthetic": 6.0, "overall": 70.0}, {"path": "/b", "fingerprint": "y", "aesthetic": 3.0, "apple_shot": True}])
    new = photos(spark, [{"path": "/a", "fingerprint": "x", "aesthetic": None}, {"path": "/b", "fingerprint": "z", "aesthetic": None, "source": 1}, {"path": "/c", "fingerprint": "q"}])
    got = {r.path: r for r in maintenance.save_photos(old, new, 100).collect()}
    assert (got["/a"].id, got["/a"].aesthetic, got["/a"].overall) == (1, 6.0, 70.0)
    assert (got["/b"].id, got["/b"].aesthetic, got["/b"].source) == (2, None, 3)
    assert got["/c"].id == 3 and sorted(r.seq for r in got.values()) == [100, 101, 102]


def test_diff_is_empty_after_a_write(spark):
    a = spark.createDataFrame([(1, 2.0, None), (2, None, "x")], "id long, v double, s string")
    assert maintenance.diff_rows(a, a, ["id"]).count() == 0
    b = spark.createDataFrame([(1, 2.0, "n"), (3, 1.0, None)], "id long, v double, s string")
    assert {(r.id, r.change) for r in maintenance.diff_rows(a, b, ["id"]).collect()} == {(1, "update"), (2, "delete"), (3, "insert")}


def test_feedback_stars_and_orphans(spark):
    p = photos(spark, [{}, {"stack_top": 9, "stacked": True, "stack_size": 2}])
    fb = schemas.empty_table(spark, "aesthetic_feedback")
    row = {"id": 1, "photo_id": 1, "rater": "a", "rating": 7.0, "verdict": None, "shown": 5.0, "models": None, "created_at": 0}
    assert maintenance.add_feedback(fb, p, row).count() == 1 and maintenance.add_feedback(fb, p, row | {"photo_id": 99}).count() == 0
    with pytest.raises(ValueError):
        maintenance.add_feedback(fb, p, row | {"rating": 11.0})
    s = maintenance.star(schemas.empty_table(spark, "stars"), p, 1, 1, 5)
    assert maintenance.star(s, p, 1, 1, 6).count() == 1 and maintenance.star(s, p, 1, 42, 6).count() == 1 and maintenance.unstar(s, 1, 1).count() == 0
    assert {r.id: r.stacked for r in maintenance.unhide_orphans(p).collect()} == {1: False, 2: False}


def test_models(spark):
    m = scoring.parse_model('{"name": "n", "w": [1, 2], "b": 0.5}')
    assert m["id"] == scoring.model_id([1.0, 2.0], 0.5)
    for bad in ('{"w": []}', '{"w": [1, NaN]}', '{"w": [1]}'):
        with pytest.raises(ValueError):
            scoring.parse_model(bad, 2)
    models = spark.createDataFrame([("ab1", 1.0, True), ("ac2", 1.0, False)], "id string, weight double, active boolean")
    assert [r.id for r in scoring.find_model(models, "ab").collect()] == ["ab1"] and scoring.find_model(models, "a").count() == 0
    assert {r.id: (r.weight, r.active) for r in scoring.activate(models, {"ac2": 0.4}).collect()} == {"ab1": (1.0, False), "ac2": (0.4, True)}


def test_accounts(spark):
    u = spark.createDataFrame([(1, "admin", None), (2, "viewer", None)], "id long, role string, disabled_at long")
    with pytest.raises(ValueError):
        accounts.set_role(u, 1, "viewer")
    inv = spark.createDataFrame([("a", 50, None), ("b", 5, None), ("c", 50, 3)], "token_hash string, expires_at long, used_at long")
    assert [r.token_hash for r in accounts.usable_invites(inv, 10).collect()] == ["a"]
    tries = spark.createDataFrame([("x", t) for t in (0, 10, 899, 900, 2000)], "k string, at long")
    assert [r.failures for r in accounts.recent_failures(tries, ["k"]).orderBy("at").collect()] == [1, 2, 3, 3, 1]


def test_first_per_stack(spark):
    hits = spark.createDataFrame([(3, 0, 1), (9, 9, 2), (1, 9, 3), (5, 0, 4), (2, 9, 5), (6, 9, 6)], "id long, stack_top long, rank int")
    assert sorted(ids(grouping.first_per_stack(hits))) == [3, 5, 9]
