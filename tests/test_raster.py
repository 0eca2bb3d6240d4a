"""Measurements move the right way under applied defects, and match plain loops."""

import numpy as np

from photonlake.functions import raster


def scene(seed=0, n=192):
    rng = np.random.default_rng(seed)
    coarse = rng.integers(60, 200, (n // 8, n // 8, 1)).repeat(8, 0).repeat(8, 1) * np.ones((1, 1, 3))
    return np.clip(coarse + rng.normal(0, 1, (n, n, 3)), 0, 255).astype(np.uint8)


def blur(img, times):
    v = img.astype(float)
    for _ in range(times):
        v[1:-1] = (v[:-2] + 2 * v[1:-1] + v[2:]) / 4
        v[:, 1:-1] = (v[:, :-2] + 2 * v[:, 1:-1] + v[:, 2:]) / 4
    return v.astype(np.uint8)


def test_blur_noise_light_and_cast_show():
    img = scene()
    base = raster.metrics(img)
    soft = raster.metrics(blur(img, 8))
    assert soft["focus_ratio"] < base["focus_ratio"] and soft["sharpness"] < base["sharpness"]
    rng = np.random.default_rng(1)
    loud = raster.metrics(np.clip(img + rng.normal(0, 12, img.shape), 0, 255).astype(np.uint8))
    assert loud["noise"] > 4 > base["noise"]
    bright = raster.metrics(np.clip(img.astype(int) + 120, 0, 255).astype(np.uint8))
    assert bright["highlights"] > base["highlights"] and bright["brightness"] > base["brightness"]
    warm = raster.metrics(np.clip(img * np.array([1.0, 0.9, 0.6]), 0, 255).astype(np.uint8))
    assert warm["cast_strength"] > 5 > base["cast_strength"] and warm["cast_b"] > 10 and base["monochrome"] and not warm["monochrome"]


def test_blocks_show_on_the_grid():
    rng = np.random.default_rng(2)
    smooth = np.cumsum(rng.normal(0, 1, 64))[:, None] + np.cumsum(rng.normal(0, 1, 64))[None, :] + 100
    flat = smooth.reshape(8, 8, 8, 8).mean(axis=(1, 3)).repeat(8, 0).repeat(8, 1)
    assert raster.blockiness(flat + 0.2 * smooth) > 2 > raster.blockiness(smooth) and raster.blockiness(smooth[:16]) == 1


def test_exposure_equals_a_plain_loop():
    g = raster.gray(scene(3))
    hist = [0] * 256
    for v in g.ravel():
        hist[min(int(v + 0.5), 255)] += 1

    def percentile(p):
        c = 0
        for i, k in enumerate(hist):
            c += k
            if c > int(p * g.size):
                return i
        return 255

    m = raster.exposure(g)
    assert m["dynamic_range"] == (percentile(0.995) - percentile(0.005)) / 255 and m["shadows"] == sum(hist[:6]) / g.size


def test_noise_equals_a_plain_loop():
    g = raster.gray(scene(4, 80))
    found = []
    for by in range(1, g.shape[0] - 17, 16):
        for bx in range(1, g.shape[1] - 17, 16):
            if by + 16 >= g.shape[0] - 1 or bx + 16 >= g.shape[1] - 1:
                continue
            total = sum(abs(float(g[y - 1, x - 1] - 2 * g[y - 1, x] + g[y - 1, x + 1] - 2 * g[y, x - 1] + 4 * g[y, x] - 2 * g[y, x + 1] + g[y + 1, x - 1] - 2 * g[y + 1, x] + g[y + 1, x + 1])) for y in range(by, by + 16) for x in range(bx, bx + 16))
            found.append(np.sqrt(np.pi / 2) * total / (6 * 256))
    assert abs(raster.noise_sigma(g) - 1.1 * sorted(found)[len(found) // 10]) < 1e-4


def test_hash_survives_scaling_and_orientation_turns_back():
    img = scene(5)
    a, b = raster.perceptual_hash(img), raster.perceptual_hash(raster.resize(img, 100, 100))
    assert (a ^ b).bit_count() <= 6 and (a ^ raster.perceptual_hash(scene(6))).bit_count() > 15
    marked = np.zeros((2, 3, 3), np.uint8)
    marked[0, 0] = 255
    corners = {1: (0, 0), 2: (0, 2), 3: (1, 2), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (2, 1), 8: (2, 0)}
    for k, at in corners.items():
        assert tuple(np.argwhere(raster.orient(marked, k)[..., 0])[0]) == at, k
    assert raster.crop(img, 0.5, 0.5, 0.75, 1.0).shape == (96, 48, 3)


def test_resize_keeps_flat_and_averages():
    flat = np.full((40, 30, 3), 77, np.uint8)
    assert (raster.resize(flat, 11, 90) == 77).all() and (raster.resize(flat, 50, 7, cubic=True) == 77).all()
    ramp = np.tile(np.arange(0, 250, 2, dtype=np.uint8)[None, :, None], (4, 1, 3))
    assert abs(raster.resize(ramp, 25, 4).astype(int)[0, :, 0] - np.arange(25) * 10 - 4).max() <= 2


def test_measure_table(spark):
    img = scene(7, 64)
    rows = [(1, 64, 64, bytearray(img.tobytes())), (2, 5, 5, bytearray(b"xx")), (3, None, None, None)]
    got = {r.id: r for r in raster.measure(spark.createDataFrame(rows, "id long, width int, height int, pixels binary")).collect()}
    assert got[1].error is None and got[1].sharpness > 0 and got[2].error and got[3].error


def test_faces_line_up_and_inputs_have_their_shape():
    angle, scale, shift = 0.4, 1.7, np.array([30.0, 12.0])
    turn = scale * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    src = raster.FACE_POINTS @ turn.T + shift
    m = raster.similarity_transform(src, raster.FACE_POINTS)
    assert np.allclose(src @ m[:, :2].T + m[:, 2], raster.FACE_POINTS)
    img = scene(8)
    same = raster.align_face(img, raster.FACE_POINTS)
    assert (same == img[:112, :112]).all()
    x = raster.model_input(img[:, :100], [0.5] * 3, [0.5] * 3)
    assert x.shape == (3, 224, 224) and -1 <= x.min() <= x.max() <= 1
