"""People, clean-ups, invites and upkeep beyond what the queries show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonlake.operators import accounts, cleanup, matching, ordering, people, vector_search
from photonlake.sources.files import same_content
from photonlake.streaming.sessions import Upkeep


def faces_of(rng, persons, n, width=8):
    v = rng.normal(size=(persons * n, width))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(i, i, x.tolist(), i % persons + 1, "manual" if i % 4 else None) for i, x in enumerate(v)]


SCHEMA = "id long, photo_id long, embedding array<double>, person_id long, person_source string"


def test_exemplars_of_crowded_persons_come_in_rounds(spark, monkeypatch):
    df = spark.createDataFrame(faces_of(np.random.default_rng(1), 3, 40), SCHEMA)
    want = sorted((r.person_id, r.id) for r in people.exemplars(df, 6).collect())
    monkeypatch.setattr(people, "PERSON_FACES", 10)
    assert sorted((r.person_id, r.id) for r in people.exemplars(df, 6).collect()) == want and len(want) == 18


def test_labels_do_not_depend_on_the_blocks(spark):
    df = spark.createDataFrame(faces_of(np.random.default_rng(2), 5, 30), SCHEMA)
    chosen = people.exemplars(df, 4)
    one, many = (sorted(people.propagate_labels(df, chosen, 0.3, 0.01, block_bytes=b).collect()) for b in (1 << 20, 300))
    assert one == many and len(one) > 10
    only = people.propagate_labels(df, chosen, 0.3, 0.01, only=2, block_bytes=300).collect()
    assert sorted(only) == [r for r in one if r.person_id == 2]


def test_queries_go_out_in_blocks(spark):
    df = spark.createDataFrame(faces_of(np.random.default_rng(3), 4, 50), SCHEMA).select("id", "embedding")
    q = df.filter("id % 20 = 0")
    one, many = (sorted(tuple(r) for r in vector_search.knn_many(df, q, 3, block=b).collect()) for b in (100, 3))
    assert one == many and len(one) == 30


@pytest.mark.parametrize("bits", [0, 3, 10])
def test_near_hashes_are_all_pairs(spark, bits):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, 40)
    data = []
    for i in range(160):
        h = int(base[i % 40])
        for b in rng.choice(64, int(rng.integers(0, 9)), replace=False):
            h ^= 1 << int(b)
        data.append((i, int(np.array(h & (2**64 - 1), dtype=np.uint64).view(np.int64)), i % 3))
    df = spark.createDataFrame(data, "id long, phash long, label long")
    got = {(r.a, r.b, r.bits) for r in matching.near_hashes(df, ["label"], bits).collect()}
    want = {(a, b, ((x ^ y) & (2**64 - 1)).bit_count()) for a, x, k in data for b, y, e in data if a < b and k == e}
    assert got == {p for p in want if p[2] <= bits}


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).withColumn("v", (F.col("id") * 37) % 101)
    got = sorted((r.n, r.v, r.id) for r in ordering.ordered_number(df, [F.col("v").desc(), F.col("id")], "n").collect())
    assert [r[0] for r in got] == list(range(1, 1001)) and [r[1:] for r in got] == sorted(((r[1], r[2]) for r in got), key=lambda x: (-x[0], x[1]))


FACE = "id long, photo_id long, x1 double, y1 double, x2 double, y2 double, person_id long, person_source string"


def test_cache_copies_with_names_that_find_no_face_stay(spark):
    path = "/p/L.photoslibrary/resources/"
    photos = [(1, "/ok/a.jpg", 77, 10, "M", "X"), (2, path + "a.jpg", 77, 10, "M", "X"), (3, path + "b.jpg", 78, 0, "", ""), (4, "/p/CaptureOne/c.jpg", 79, 0, "", ""), (5, "/ok/d.jpg", 80, 20, "M", "X"), (6, "/p/CaptureOne/d.jpg", 81, 21, "M", "X"), (7, "/ok/e.jpg", 90, 5, "", ""), (8, "/p/CaptureOne/e.jpg", 90, 5, "", "")]
    photos = spark.createDataFrame(photos, "id long, path string, phash long, taken_at long, camera_make string, camera_model string")
    faces = [(10, 2, 0.1, 0.1, 0.3, 0.3, 5, "manual"), (11, 1, 0.1, 0.1, 0.3, 0.3, None, None), (12, 6, 0.1, 0.1, 0.3, 0.3, 6, "manual"), (13, 5, 0.7, 0.7, 0.9, 0.9, None, None)]
    feedback = spark.createDataFrame([(1, 8), (2, 1)], "id long, photo_id long")
    out = cleanup.clean_app_caches(photos, spark.createDataFrame(faces, FACE), feedback)
    # 2 goes to 1 with its name; 3 may be the only copy; 4 goes; 6 has a name that finds no face on 5; 8 goes to 7 with its judgement.
    assert sorted(r.id for r in out.photos.collect()) == [1, 3, 5, 6, 7]
    assert {(r.id, r.person_id, r.person_source) for r in out.faces.collect()} == {(11, 5, "manual"), (12, 6, "manual"), (13, None, None)}
    assert sorted((r.id, r.photo_id) for r in out.feedback.collect()) == [(1, 7), (2, 1)]
    assert tuple(out.report.select("removed", "labels_moved", "feedback_moved", "kept").first()) == (3, 1, 1, 2)


def test_library_copies_of_one_original_share_its_faces(spark):
    uuid = "0A1B2C3D-0A1B-0A1B-0A1B-0A1B2C3D4E5F"
    lib = "/p/L.photoslibrary/"
    photos = spark.createDataFrame([(1, f"{lib}originals/0/{uuid}.jpg"), (2, f"{lib}resources/{uuid}_1.jpg"), (3, f"{lib}resources/{uuid}_2.jpg"), (4, f"/q/M.photoslibrary/resources/{uuid}_2.jpg")], "id long, path string")
    box = (0.1, 0.1, 0.5, 0.5)
    faces = spark.createDataFrame([(10, 1, *box, None, None), (11, 1, *box, None, None), (12, 2, *box, 5, "manual"), (13, 3, *box, 6, "manual")], FACE)
    out = cleanup.clean_libraries(photos, faces, spark.createDataFrame([], "id long, photo_id long"))
    assert sorted(r.id for r in out.photos.collect()) == [1, 4]
    assert {(r.id, r.person_id) for r in out.faces.collect()} == {(11, 5), (10, 6)}
    assert tuple(out.report.select("removed", "labels_moved", "feedback_moved", "kept").first()) == (2, 2, 0, 1)


def test_invites_are_accepted_once(spark):
    users = spark.createDataFrame([(1, "Ann", "admin", "x", 0, None), (2, "Bob", "viewer", "y", 0, 9)], "id long, name string, role string, pw_hash string, created_at long, disabled_at long")
    invites = spark.createDataFrame([], "token_hash string, name string, role string, user_id long, created_by string, created_at long, expires_at long, used_at long")
    invites = accounts.create_invite(invites, users, "t1", 100, 50, name=" New  One ", role="editor")
    invites = accounts.create_invite(invites, users, "t2", 100, 50, user=1)
    for bad in ({"name": "ann"}, {"name": "x", "role": "boss"}, {"user": 2}, {"name": " "}):
        with pytest.raises(ValueError):
            accounts.create_invite(invites, users, "t3", 100, 50, **bad)
    sessions = spark.createDataFrame([("s1", 1), ("s2", 2)], "token_hash string, user_id long")
    accepted = spark.createDataFrame([("t1", "p1"), ("t2", "p2"), ("t9", "p9")], "token_hash string, pw_hash string")
    after, made, left = accounts.accept_invites(invites, users, sessions, accepted, 120)
    assert {(r.name, r.role, r.pw_hash) for r in made.collect()} == {("Ann", "admin", "p2"), ("Bob", "viewer", "y"), ("New One", "editor", "p1")}
    assert [r.token_hash for r in left.collect()] == ["s2"] and {r.used_at for r in after.collect()} == {120}
    again = accounts.accept_invites(after, made, left, accepted, 121)
    assert again[1].count() == 3 and accounts.pending_invites(after, 121).count() == 0
    assert accounts.accept_invites(invites, users, sessions, accepted, 999)[1].count() == 2
    assert accounts.revoke_invites(after, accepted).count() == 2 and accounts.revoke_invites(invites, accepted).count() == 0


def test_equal_files_are_found_by_their_bytes(spark):
    a = spark.createDataFrame([("a", 3, b"xyz"), ("b", 3, b"xyw"), ("c", 0, b"")], "path string, size long, content binary")
    b = spark.createDataFrame([("d", 3, b"xyz"), ("e", 0, b""), ("f", 2, b"xy")], "path string, size long, content binary")
    assert sorted(tuple(r) for r in same_content(a, b).collect()) == [("a", "d"), ("c", "e")]


def test_regrouping_waits_its_time():
    now, ran, state = [0.0], [], {"stale": True, "rules": False}
    up = Upkeep(lambda batch, epoch: None, lambda: ran.append(now[0]), lambda: state["stale"], lambda: state["rules"], 1800, lambda: now[0])
    up.apply(None, 0)
    now[0] = 100
    up.apply(None, 1)
    assert ran == [0.0]
    state["rules"] = True
    up.apply(None, 2)
    state["rules"] = False
    now[0] = 2000
    up.apply(None, 3)
    state["stale"] = False
    now[0] = 9000
    assert not up.regroup(now=True) and ran == [0.0, 100, 2000]


def test_upkeep_runs_on_a_stream(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "in"))
    seen = []
    up = Upkeep(lambda batch, epoch: seen.append(batch.count()), lambda: seen.append("rebuilt"), lambda: True, lambda: False)
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    up.start(stream, str(tmp_path / "check"), available_now=True).awaitTermination()
    assert seen == [20, "rebuilt"]
