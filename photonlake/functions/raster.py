"""Pixel measurements in numpy: sharpness, focus, noise, exposure, colour, blockiness, perceptual hash, resampling.

Rasters are (height, width, 3) uint8 arrays; ``measure`` is the per-row stage over a table of raw rasters."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Long edges at which photos are measured, rated, and searched for the light's colour.
ANALYSIS_SIZE, RATING_SIZE, EDGE_SIZE = 1600, 512, 800


# resampling and orientation


def _weights(n_in: int, n_out: int, cubic: bool) -> np.ndarray:
    """(n_out, n_in) weights of an antialiased triangle or cubic filter, as the common imaging libraries compute them."""
    scale = n_in / n_out
    stretch = max(scale, 1.0)
    reach = (2.0 if cubic else 1.0) * stretch
    out = np.zeros((n_out, n_in))
    for i in range(n_out):
        center = (i + 0.5) * scale
        low, high = max(0, int(center - reach + 0.5)), min(n_in, int(center + reach + 0.5))
        t = np.abs((np.arange(low, high) + 0.5 - center) / stretch)
        if cubic:
            w = np.where(t < 1, ((1.5 * t - 2.5) * t) * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0))
        else:
            w = np.clip(1 - t, 0, None)
        out[i, low:high] = w / w.sum()
    return out


def resize(img: np.ndarray, width: int, height: int, cubic: bool = False) -> np.ndarray:
    """Columns first, then rows, rounded to bytes after each."""
    byte = lambda x: np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)
    if width != img.shape[1]:
        img = byte(np.einsum("oi,hic->hoc", _weights(img.shape[1], width, cubic), img.astype(float)))
    if height != img.shape[0]:
        img = byte(np.einsum("oi,iwc->owc", _weights(img.shape[0], height, cubic), img.astype(float)))
    return img


def fit_within(img: np.ndarray, long_edge: int) -> np.ndarray:
    h, w = img.shape[:2]
    if max(h, w) <= long_edge:
        return img
    return resize(img, long_edge, max(1, int(h * long_edge / w + 0.5))) if w >= h else resize(img, max(1, int(w * long_edge / h + 0.5)), long_edge)


def orient(img: np.ndarray, orientation: int) -> np.ndarray:
    """Upright pixels for an EXIF orientation of 1 to 8."""
    turn = {1: lambda x: x, 2: np.fliplr, 3: lambda x: x[::-1, ::-1], 4: np.flipud, 5: lambda x: x.swapaxes(0, 1), 6: lambda x: np.rot90(x, -1), 7: lambda x: x[::-1, ::-1].swapaxes(0, 1), 8: np.rot90}
    return np.ascontiguousarray(turn.get(orientation, turn[1])(img))


def crop(img: np.ndarray, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
    """The part between fractions of width and height, at least one pixel."""
    h, w = img.shape[:2]
    a, b = min(max(int(x1 * w), 0), w - 1), min(max(int(y1 * h), 0), h - 1)
    return img[b : max(b + 1, min(h, int(np.ceil(y2 * h)))), a : max(a + 1, min(w, int(np.ceil(x2 * w))))]


def gray(img: np.ndarray) -> np.ndarray:
    return (0.299 * img[..., 0] + 0.587 * img[..., 1] + 0.114 * img[..., 2]).astype(np.float32)


# kernels


def laplacian(g: np.ndarray) -> np.ndarray:
    """Four-neighbour response; the border is 0."""
    out = np.zeros_like(g)
    if min(g.shape) > 2:
        out[1:-1, 1:-1] = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
    return out


def tiles(a: np.ndarray, size: int, margin: int) -> np.ndarray:
    """(n, size * size) whole tiles inside the margin, rows of tiles first."""
    h, w = ((d - 2 * margin) // size for d in a.shape)
    if h <= 0 or w <= 0:
        return np.zeros((0, size * size))
    part = a[margin : margin + h * size, margin : margin + w * size].astype(float)
    return part.reshape(h, size, w, size).swapaxes(1, 2).reshape(h * w, size * size)


def _tile_size(g: np.ndarray) -> int:
    return max(16, max(g.shape) // 16)


def _top_tenth(v: np.ndarray) -> float:
    return float(np.sort(v)[-max(1, len(v) // 10) :].mean())


def sharpness(g: np.ndarray, noise: float) -> tuple[float, float]:
    """Variance of the Laplacian without the noise's share: of the whole frame, and of the sharpest tenth of tiles."""
    lap, share = laplacian(g), 20 * noise * noise
    inner = lap[1:-1, 1:-1].astype(float)
    if not inner.size:
        return 0.0, 0.0
    whole = max(0.0, float(inner.var()) - share)
    each = np.clip(tiles(lap, _tile_size(g), 1).var(axis=1) - share, 0, None)
    return whole, _top_tenth(each) if len(each) else whole


def _binomial(g: np.ndarray) -> np.ndarray:
    rows = g.copy()
    rows[:, 1:-1] = (g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]) / 4
    out = rows.copy()
    out[1:-1] = (rows[:-2] + 2 * rows[1:-1] + rows[2:]) / 4
    return out


@lru_cache(maxsize=1)
def _noise_gains() -> tuple[float, float]:
    """What the binomial filter, and the Laplacian after it, leave of white noise's variance."""
    smooth = np.outer([1, 2, 1], [1, 2, 1]) / 16
    both = np.zeros((5, 5))
    for (y, x), v in np.ndenumerate(np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])):
        both[y : y + 3, x : x + 3] += v * smooth
    return float((smooth**2).sum()), float((both**2).sum())


def focus_ratio(g: np.ndarray, noise: float) -> float:
    """Laplacian energy over intensity variance per textured tile, mean of the best tenth."""
    f, (keep, keep_lap) = _binomial(g), _noise_gains()
    size = _tile_size(g)
    lap = tiles(laplacian(f), size, 2).var(axis=1) - keep_lap * noise * noise
    var = tiles(f, size, 2).var(axis=1) - keep * noise * noise
    rich = var >= 9
    return _top_tenth(np.clip(lap[rich], 0, None) / (var[rich] + 25)) if rich.any() else 0.0


def noise_sigma(g: np.ndarray, size: int = 16, bias: float = 1.1) -> float:
    """Noise in 8-bit levels from the flattest tenth of blocks that are not clipped."""
    h, w = g.shape
    if min(h, w) < 2 * size:
        return 0.0
    k = np.zeros_like(g)
    k[1:-1, 1:-1] = g[:-2, :-2] - 2 * g[:-2, 1:-1] + g[:-2, 2:] - 2 * g[1:-1, :-2] + 4 * g[1:-1, 1:-1] - 2 * g[1:-1, 2:] + g[2:, :-2] - 2 * g[2:, 1:-1] + g[2:, 2:]
    # Blocks start at 1 and end before the last row and column.
    down, across = (h - 3) // size, (w - 3) // size
    cut = lambda a: a[1 : 1 + down * size, 1 : 1 + across * size]
    block = lambda a: tiles(np.abs(cut(a)), size, 0)
    level = block(g).mean(axis=1)
    sigma = np.sqrt(np.pi / 2) * block(k).sum(axis=1) / (6 * size * size)
    sigma = np.sort(sigma[(level >= 8) & (level <= 247)])
    return bias * float(sigma[len(sigma) // 10]) if len(sigma) else 0.0


def exposure(g: np.ndarray) -> dict:
    hist = np.bincount(np.minimum((g + 0.5).astype(int), 255).ravel(), minlength=256)
    total, n = np.cumsum(hist), g.size
    at = lambda p: int(np.searchsorted(total, int(p * n), side="right"))
    low, high = min(at(0.005), 255), min(at(0.995), 255)
    v = g.astype(float)
    return {"brightness": v.mean() / 255, "contrast": v.std() / 255, "highlights": hist[250:].sum() / n, "shadows": hist[:6].sum() / n, "dynamic_range": (high - low) / 255}


def linear(v: np.ndarray) -> np.ndarray:
    c = np.asarray(v, float) / 255
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


#: Linear sRGB to XYZ and the D65 white point.
_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
_WHITE = np.array([0.95047, 1.0, 1.08883])


def lab(rgb: np.ndarray) -> np.ndarray:
    t = linear(rgb) @ _XYZ.T / _WHITE
    f = np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def illuminant(img: np.ndarray) -> tuple[float, float, float]:
    """(degrees from neutral, a, b) of the light's colour by the edges of each channel, sixth-power mean."""
    img = fit_within(img, EDGE_SIZE)
    if min(img.shape[:2]) < 3:
        return 0.0, 0.0, 0.0
    v = linear(img)
    dx, dy = v[1:-1, 2:] - v[1:-1, :-2], v[2:, 1:-1] - v[:-2, 1:-1]
    inner = img[1:-1, 1:-1]
    e = (np.where((inner < 250) & (inner > 3), (dx * dx + dy * dy) ** 3, 0).sum(axis=(0, 1))) ** (1 / 6)
    n = float(np.linalg.norm(e))
    if n == 0:
        return 0.0, 0.0, 0.0
    angle = float(np.degrees(np.arccos(min(1.0, e.sum() / (n * np.sqrt(3))))))
    c = 0.2 * e / e.max()
    shown = np.floor(np.clip(np.where(c <= 0.0031308, 12.92 * c, 1.055 * c ** (1 / 2.4) - 0.055), 0, 1) * 255 + 0.5)
    _, a, b = lab(shown)
    return angle, float(a), float(b)


def colour(img: np.ndarray) -> dict:
    p = img[::2, ::2].astype(float)
    r, g, b = p[..., 0], p[..., 1], p[..., 2]
    rg, yb = r - g, 0.5 * (r + g) - b
    top, low = p.max(axis=2), p.min(axis=2)
    c = lab(p)
    chroma, light = np.hypot(c[..., 1], c[..., 2]), c[..., 0]
    neutral = (light > 20) & (light < 95) & (chroma < 18)
    cast = c[neutral][:, 1:].mean(axis=0) if neutral.mean() > 0.02 else 0.5 * c[..., 1:].mean(axis=(0, 1))
    strength, a, b_ = illuminant(img)
    return {
        "colorfulness": float(np.hypot(rg.std(), yb.std()) + 0.3 * np.hypot(rg.mean(), yb.mean())),
        "saturation": float(np.where(top > 0, (top - low) / np.where(top > 0, top, 1), 0).mean()),
        "monochrome": bool(((chroma > 8) & (light > 5)).mean() < 0.005),
        "lab_cast": float(np.hypot(*cast)), "cast_strength": strength, "cast_a": a, "cast_b": b_,
    }


def region_sharpness(img: np.ndarray) -> float:
    """Laplacian variance of a normalised crop without its outer eighth."""
    lap = laplacian(gray(img)).astype(float)
    h, w = lap.shape
    part = lap[h // 8 : h - h // 8, w // 8 : w - w // 8]
    return float(part.var()) if part.size else 0.0


def blockiness(y: np.ndarray) -> float:
    """Steps across the 8-pixel grid over other steps, at native size; about 1 without compression."""
    h, w = y.shape
    if min(h, w) < 32:
        return 1.0
    v = y.astype(float)
    across = np.abs(np.diff(v[::2], axis=1))
    edge = np.arange(1, w) % 8 == 0
    rows = np.arange(1, h)
    down = np.abs(np.diff(v[:, ::2], axis=0))
    on, mid = down[rows % 8 == 0], down[rows % 8 == 4]
    n_in = across[:, ~edge].size + mid.size
    inside = across[:, ~edge].sum() + mid.sum()
    n_on = across[:, edge].size + on.size
    return float((across[:, edge].sum() + on.sum()) / n_on / (inside / n_in)) if n_on and n_in and inside else 1.0


def perceptual_hash(img: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of a 32 x 32 grey image exceed their median."""
    small = resize(img, 32, 32).astype(float)
    g = 0.299 * small[..., 0] + 0.587 * small[..., 1] + 0.114 * small[..., 2]
    basis = np.cos(np.pi / 32 * np.outer(np.arange(8), np.arange(32) + 0.5))
    c = (basis @ g @ basis.T).ravel()
    bits = c > np.median(c)
    return int("".join("1" if b else "0" for b in bits), 2)


def metrics(img: np.ndarray) -> dict:
    """All measurements of one photo."""
    size = fit_within(img, ANALYSIS_SIZE)
    g = gray(size)
    noise = noise_sigma(g)
    whole, best = sharpness(g, noise)
    h = perceptual_hash(img)
    return {"noise": noise, "sharpness_global": whole, "sharpness": best, "focus_ratio": focus_ratio(g, noise), **exposure(g), **colour(size), "blockiness": blockiness(gray(img)), "phash": h - (1 << 64) if h >> 63 else h}


_COLUMNS = [(n, pa.float64()) for n in ("noise", "sharpness_global", "sharpness", "focus_ratio", "brightness", "contrast", "highlights", "shadows", "dynamic_range", "colorfulness", "saturation", "lab_cast", "cast_strength", "cast_a", "cast_b", "blockiness")]
_COLUMNS += [("monochrome", pa.bool_()), ("phash", pa.int64()), ("error", pa.string())]


def measure(rasters: DataFrame) -> DataFrame:
    """(id, width, height, pixels) of packed RGB bytes -> one row of measurements each; a bad raster has an error."""
    schema = pa.schema([("id", pa.int64()), *_COLUMNS])
    sql = {pa.float64(): "double", pa.bool_(): "boolean", pa.int64(): "long", pa.string(): "string"}

    def run(batches):
        for batch in batches:
            rows = []
            for i, w, h, pixels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not pixels or not w or not h or len(pixels) != w * h * 3:
                    rows.append({"id": i, "error": "not a raster of its size"})
                    continue
                rows.append({"id": i, **metrics(np.frombuffer(pixels, np.uint8).reshape(h, w, 3))})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return rasters.select("id", "width", "height", "pixels").mapInArrow(run, ", ".join(f"{n} {sql[t]}" for n, t in [("id", pa.int64()), *_COLUMNS]))


# inputs of image models


#: Where eyes, nose and mouth corners lie in a 112-pixel face crop.
FACE_POINTS = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])


def similarity_transform(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """2 x 3 matrix of the scaled rotation and shift that takes src to dst with least squared error, without mirroring."""
    s, d = src.mean(axis=0), dst.mean(axis=0)
    # As complex numbers the best factor is one quotient.
    p, q = (src - s) @ [1, 1j], (dst - d) @ [1, 1j]
    spread = float((abs(p) ** 2).sum())
    if spread == 0:
        return np.array([[1.0, 0, 0], [0, 1.0, 0]])
    f = (np.conj(p) * q).sum() / spread
    turn = np.array([[f.real, -f.imag], [f.imag, f.real]])
    return np.column_stack([turn, d - turn @ s])


def align_face(img: np.ndarray, points: np.ndarray, size: int = 112) -> np.ndarray:
    """The face turned and scaled to the standard places, bilinear, black outside."""
    m = similarity_transform(np.asarray(points, float), FACE_POINTS * (size / 112))
    inverse = np.linalg.inv(m[:, :2])
    v, u = np.mgrid[0:size, 0:size]
    xy = (np.stack([u, v], axis=-1) - m[:, 2]) @ inverse.T
    low = np.floor(xy).astype(int)
    part = xy - low
    out = np.zeros((size, size, 3))
    for j in (0, 1):
        for i in (0, 1):
            x, y = low[..., 0] + i, low[..., 1] + j
            w = (part[..., 0] if i else 1 - part[..., 0]) * (part[..., 1] if j else 1 - part[..., 1])
            inside = (x >= 0) & (y >= 0) & (x < img.shape[1]) & (y < img.shape[0])
            out += np.where(inside, w, 0)[..., None] * img[np.clip(y, 0, img.shape[0] - 1), np.clip(x, 0, img.shape[1] - 1)]
    return np.minimum(out + 0.5, 255).astype(np.uint8)


def model_input(img: np.ndarray, mean, std, size: int = 224) -> np.ndarray:
    """(3, size, size) floats: short side to ``size`` by the cubic filter, centre cut, normalised per channel."""
    h, w = img.shape[:2]
    wide, high = (size, int(size * h / w)) if w <= h else (int(size * w / h), size)
    r = resize(img, max(wide, size), max(high, size), cubic=True)
    top, left = int(round((r.shape[0] - size) / 2)), int(round((r.shape[1] - size) / 2))
    x = r[top : top + size, left : left + size].astype(np.float32) / 255
    return ((x - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)).transpose(2, 0, 1)
