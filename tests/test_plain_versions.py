"""Queries that SQL does not express, each whole against a plain version in Python on the same tables."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from photonlake.plans import catalogue
from photonlake.plans.groups import BURST_GAP, SCENE_GAP

DATA = "/root/testdata/sf0.001"


def table(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pandas()


def hashes():
    """id -> (label, hash, vector): one bit a component, first component first, set above the median."""
    out = {}
    for r in table("embeddings").itertuples():
        v = np.asarray(r.embedding, dtype=np.float64)
        out[r.vec_id] = (r.label, int("".join("1" if x > np.median(v) else "0" for x in v), 2), v)
    return out


def event_frames():
    """Events as (camera, at, id, value) in time order per camera."""
    e = table("events")
    at = e.ts.astype("datetime64[us]").astype("int64") // 1_000_000
    return sorted(zip(e.user_id.tolist(), at.tolist(), e.event_id.tolist(), e.value.tolist(), strict=True))


def sessions():
    """id -> (camera, scene, run), numbered per camera."""
    out, last = {}, None
    for camera, at, i, _ in event_frames():
        if last is None or last[0] != camera:
            scene = run = 0
        else:
            scene += at - last[1] > max(SCENE_GAP, BURST_GAP)
            run += at - last[1] > BURST_GAP
        out[i] = (camera, scene, run)
        last = (camera, at)
    return out


def chunks(limit):
    """id -> chunk: consecutive runs of a scene up to the limit together; a longer run has none."""
    scenes = {}
    for i, (camera, scene, run) in sessions().items():
        scenes.setdefault((camera, scene), {}).setdefault(run, []).append(i)
    out = {}
    for runs in scenes.values():
        if sum(map(len, runs.values())) <= limit:
            out |= {i: 0 for ids in runs.values() for i in ids}
            continue
        chunk = filled = 0
        for run in sorted(runs):
            n = len(runs[run])
            if n > limit:
                out |= dict.fromkeys(runs[run], -1)
                chunk, filled = chunk + (filled > 0), 0
                continue
            if filled + n > limit:
                chunk, filled = chunk + 1, 0
            out |= dict.fromkeys(runs[run], chunk)
            filled += n
    return out


def stacks(frames, bits):
    """frames (id, overall, hash) of one chunk -> id -> (top, size, stacked)."""
    out, order = {}, sorted(frames, key=lambda f: (-f[1], f[0]))
    for k, (top, _, h) in enumerate(order):
        if top in out or not h:
            continue
        near = [i for i, _, g in order[k:] if i not in out and g and (g ^ h).bit_count() <= bits]
        if len(near) > 1:
            out |= {i: (top, len(near), i != top) for i in near}
    return out


def scene_chunks():
    packed = chunks(8)
    return [(i, f"u{camera}", scene, run, packed[i]) for i, (camera, scene, run) in sessions().items()], ["id", "camera_model", "scene", "run", "chunk"]


def greedy_stacking():
    groups = {}
    for i, (label, h, _) in hashes().items():
        groups.setdefault((label, i // 1000), []).append((i, i * 7 % 20, h))
    return [(label, i, *x) for (label, _), frames in groups.items() for i, x in stacks(frames, 22).items()], ["label", "id", "stack_top", "stack_size", "stacked"]


def regroup():
    of, packed, known = sessions(), chunks(1000), hashes()
    runs, groups, same = {}, {}, {}
    for camera, _, i, value in event_frames():
        runs.setdefault((camera, of[i][2]), []).append(i)
        h = known[i][1] if i in known else 0
        if h:
            same.setdefault(h, []).append(i)
        if packed[i] >= 0:
            groups.setdefault((*of[i][:2], packed[i]), []).append((i, value, h))
    bursts = {i: min(ids) for ids in runs.values() if len(ids) > 1 for i in ids}
    sets = {i: min(ids) for ids in same.values() if len(ids) > 1 for i in ids}
    stacked = {i: x for frames in groups.values() for i, x in stacks(frames, 24).items()}
    return [(i, bursts.get(i, 0), *stacked.get(i, (0, 0, False)), sets.get(i, 0)) for i in of], ["id", "burst_id", "stack_top", "stack_size", "stacked", "dup_id"]


def leader_clustering():
    faces = [(i, 40 + i % 120, 0.6 + i % 40 / 100, v) for i, (_, _, v) in hashes().items() if i % 5 and 40 + i % 120 >= 60 and 0.6 + i % 40 / 100 >= 0.7 and abs(i % 13 / 10 - 0.6) < 0.6]
    leaders, members = [], []
    for i, *_, v in sorted(faces, key=lambda f: (-(f[1] * f[2]), f[0])):
        sims = [float(x @ v) for x in leaders]
        if sims and max(sims) > 0.25:
            members[int(np.argmax(sims))].append(i)
        else:
            leaders.append(v)
            members.append([i])
    out = [(c, len(ids), len({i // 2 for i in ids}), ",".join(map(str, ids[:12]))) for c, ids in enumerate(members) if len({i // 2 for i in ids}) >= 2]
    return sorted(out, key=lambda r: (-r[2], r[0]))[:100], ["cluster", "size", "photos", "faces"]


def samples():
    e = table("embeddings")
    x = np.stack(e.embedding).astype(np.float64)
    return x, 5 + 3 * x[:, 0] - 2 * x[:, 5] + 0.05 * e.label.to_numpy()


def ridge(x, y, pull):
    """Least squares with one more row for every weight that pulls it to 0, and the bias, a tenth as strongly, to 5."""
    n, d = x.shape
    pulls = np.diag(np.sqrt(pull) * np.append(np.ones(d), 0.1))
    rows = np.vstack([np.hstack([x, np.ones((n, 1))]), pulls])
    return np.linalg.lstsq(rows, np.concatenate([y, np.zeros(d), [0.1 * np.sqrt(pull) * 5]]), rcond=None)[0]


def ridge_fit():
    return [(i, float(w)) for i, w in enumerate(ridge(*samples(), 0.1))], ["i", "w"]


def cv_select(spark):
    from pyspark.sql import functions as F

    from photonlake.operators.training import fold_of

    fold = dict(spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", fold_of(F.col("vec_id"), 5, 1).alias("f")).collect())
    f = np.array([fold[i] for i in table("embeddings").vec_id])
    x, y = samples()
    rows = []
    for pull in (0.03, 0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0, 1000.0):
        errors = np.zeros(len(y))
        for k in np.unique(f):
            w = ridge(x[f != k], y[f != k], pull)
            errors[f == k] = (x[f == k] @ w[:-1] + w[-1] - y[f == k]) ** 2
        rows.append((pull, float(errors.mean())))
    return rows, ["pull", "mse"]


def box_suppression():
    li, least, out = table("lineitem"), {}, []
    for r in li.itertuples():
        key, x = (r.l_orderkey, r.l_linenumber), (r.l_quantity, r.l_partkey, r.l_discount, r.l_tax, r.l_suppkey)
        least[key] = min(least.get(key, x), x)
    photos = {}
    for (photo, n), (q, p, discount, tax, _) in sorted(least.items()):
        x, y = q / 100, (p % 50) / 100.0
        photos.setdefault(photo, []).append((photo * 10 + n, tax, [c * 1000 for c in (x, y, x + 0.3, y + 0.2 + discount)]))
    for photo, boxes in photos.items():
        kept = []
        for i, _, b in sorted(boxes, key=lambda r: -r[1]):
            def share(a, b=b):
                w, h = min(a[2], b[2]) - max(a[0], b[0]) + 1, min(a[3], b[3]) - max(a[1], b[1]) + 1
                both = w * h if w > 0 and h > 0 else 0
                area = lambda c: (c[2] - c[0] + 1) * (c[3] - c[1] + 1)
                return both / (area(a) + area(b) - both)

            if all(share(a) <= 0.4 for _, a in kept):
                kept.append((i, b))
        out += [(photo, i) for i, _ in kept]
    return out, ["photo_id", "id"]


PLAIN = {f.__name__: f for f in (scene_chunks, greedy_stacking, regroup, leader_clustering, ridge_fit, cv_select, box_suppression)}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_query_equals_its_plain_version(spark, name):
    want, columns = PLAIN[name](spark) if name == "cv_select" else PLAIN[name]()
    got = [tuple(r) for r in catalogue.QUERIES[name](spark, DATA).select(*columns).collect()]
    assert len(want) > 1
    if name in ("ridge_fit", "cv_select"):
        assert np.allclose(np.array(sorted(got), dtype=float), np.array(sorted(want), dtype=float), rtol=1e-6, atol=1e-9)
    else:
        assert sorted(got) == sorted(want)
