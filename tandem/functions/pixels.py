"""Pixel kernels in numpy, and the column wrappers that run them over Arrow batches.

Images are float arrays (height, width, 3) in [0, 1].  Decoding is a plug-in: binary PPM is built in,
other formats go through Pillow where that is installed."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Decoder = Callable[[bytes], "np.ndarray | None"]


def decode(content: bytes) -> np.ndarray | None:
    """RGB in [0, 1], or None for what cannot be read."""
    if content[:2] == b"P6":
        try:
            fields, at = [], 2
            while len(fields) < 3:
                while content[at : at + 1].isspace():
                    at += 1
                if content[at : at + 1] == b"#":
                    at = content.index(b"\n", at)
                    continue
                end = at
                while not content[end : end + 1].isspace():
                    end += 1
                fields.append(int(content[at:end]))
                at = end
            w, h, top = fields
            return np.frombuffer(content, np.uint8, w * h * 3, at + 1).reshape(h, w, 3) / float(top)
        except (ValueError, IndexError):
            return None
    try:
        from PIL import Image

        with Image.open(io.BytesIO(content)) as im:
            return np.asarray(im.convert("RGB"), np.float64) / 255.0
    except Exception:
        return None


def resize(rgb: np.ndarray, height: int, width: int) -> np.ndarray:
    """Box means over even cells (nearest pixels where it grows)."""
    ys, xs = (np.linspace(0, n, m + 1) for n, m in ((rgb.shape[0], height), (rgb.shape[1], width)))
    pick = lambda e: [slice(int(a), max(int(a) + 1, int(np.ceil(b)))) for a, b in zip(e[:-1], e[1:])]
    return np.stack([np.stack([rgb[y, x].mean((0, 1)) for x in pick(xs)]) for y in pick(ys)])


def bounded(rgb: np.ndarray, most: int) -> np.ndarray:
    scale = most / max(rgb.shape[:2])
    return rgb if scale >= 1 else resize(rgb, max(1, round(rgb.shape[0] * scale)), max(1, round(rgb.shape[1] * scale)))


def hsl(rgb: np.ndarray) -> np.ndarray:
    px = rgb.reshape(-1, 3)
    hi, lo = px.max(1), px.min(1)
    d, light = hi - lo, (hi + lo) / 2
    safe = np.where(d > 1e-6, d, 1.0)
    sat = np.where(light < 0.5, d / np.where(hi + lo > 0, hi + lo, 1), d / np.where(2 - hi - lo > 0, 2 - hi - lo, 1))
    r, g, b = px.T
    hue = np.where(hi == r, np.fmod((g - b) / safe, 6) / 6, np.where(hi == g, ((b - r) / safe + 2) / 6, ((r - g) / safe + 4) / 6))
    hue = np.where(hue < 0, hue + 1, hue)
    flat = d <= 1e-6
    return np.stack([np.where(flat, 0, hue), np.where(flat, 0, sat), light], 1)


def lab(rgb: np.ndarray) -> np.ndarray:
    px = rgb.reshape(-1, 3)
    lin = np.where(px <= 0.04045, px / 12.92, ((px + 0.055) / 1.055) ** 2.4)
    # sRGB to XYZ under D65.
    xyz = lin @ np.array([[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]).T / np.array([0.95047, 1.0, 1.08883])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], 1)


def hsl_histogram(rgb: np.ndarray) -> np.ndarray:
    """18 x 8 x 8 shares."""
    v = hsl(rgb)
    bins = [np.minimum((v[:, i] * n).astype(int), n - 1) for i, n in enumerate((18, 8, 8))]
    return np.bincount(bins[0] * 64 + bins[1] * 8 + bins[2], minlength=1152) / len(v)


def palette(rgb: np.ndarray, k: int = 6, rounds: int = 20) -> np.ndarray:
    """k-means colours in LAB from evenly strided starts; an empty cluster keeps its colour."""
    px = lab(rgb)
    start = px[:: max(1, len(px) // k)][:k]
    cent = np.concatenate([start, np.repeat(px[:1], k - len(start), 0)])
    for _ in range(rounds):
        near = ((px[:, None] - cent[None]) ** 2).sum(2).argmin(1)
        count = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, px[:, c], k) for c in range(3)], 1)
        cent = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], cent)
    return cent.ravel()


def accent(rgb: np.ndarray) -> tuple[float, float] | None:
    """(hue, saturation) of the most prominent saturated hue that covers 5 to 40 % of the image."""
    v = hsl(rgb)
    on = v[:, 1] >= 0.25
    bins = np.minimum((v[on, 0] * 24).astype(int), 23)
    count, sat = np.bincount(bins, minlength=24), np.bincount(bins, v[on, 1], 24)
    share = count / len(v)
    mean = sat / np.maximum(count, 1)
    score = np.where((share >= 0.05) & (share <= 0.40), share * mean, 0.0)
    best = int(score.argmax())
    return ((best + 0.5) * 15.0, float(mean[best])) if score[best] > 0 else None


def grey(rgb: np.ndarray, size: int = 128) -> np.ndarray:
    return resize(rgb, size, size) @ np.array([0.299, 0.587, 0.114])


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(magnitude, angle); 0 on the border."""
    mag, ang = np.zeros_like(g), np.zeros_like(g)
    tl, tc, tr, ml, mr, bl, bc, br = (g[y : y + g.shape[0] - 2, x : x + g.shape[1] - 2] for y, x in ((0, 0), (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2)))
    gx, gy = (tr + 2 * mr + br) - (tl + 2 * ml + bl), (bl + 2 * bc + br) - (tl + 2 * tc + tr)
    mag[1:-1, 1:-1], ang[1:-1, 1:-1] = np.sqrt(gx * gx + gy * gy), np.arctan2(gy, gx)
    return mag, ang


def edge_histogram(mag: np.ndarray, ang: np.ndarray) -> np.ndarray:
    on = mag > 0.15
    bins = np.minimum(((ang[on] + np.pi) / (2 * np.pi) * 32).astype(int), 31)
    h = np.bincount(bins, mag[on], 32)
    return h / h.sum() if h.sum() > 0 else h


def composition_grid(g: np.ndarray, mag: np.ndarray) -> np.ndarray:
    """16 mean brightnesses, then 16 mean edge strengths."""
    h, w = g.shape[0] // 4, g.shape[1] // 4
    cells = lambda m: m[: 4 * h, : 4 * w].reshape(4, h, 4, w).mean((1, 3)).ravel()
    return np.concatenate([cells(g), cells(mag)])


def dhash(rgb: np.ndarray) -> str:
    """16 hex digits: is each of 9 x 8 grey pixels darker than its right neighbour, most significant first."""
    g = resize(rgb, 8, 9) @ np.array([0.299, 0.587, 0.114])
    return np.packbits(g[:, :-1] < g[:, 1:]).tobytes().hex()


def is_grey(rgb: np.ndarray) -> bool:
    small = np.round(resize(rgb, 32, 32) * 255)
    return bool((small.max(2) - small.min(2)).max() <= 15)


def centroid(humans: list[tuple[float, float, float, float, float]], objects: list[tuple[float, float, float, float, float]]) -> tuple[float, float] | None:
    """Subject centre, y downwards, from boxes (x, y, width, height, confidence): humans by area, else objects by confidence."""
    sure = [b for b in humans if b[4] >= 0.3]
    boxes, weights = (sure, [b[2] * b[3] for b in sure]) if sure else (objects, [b[4] for b in objects])
    if not boxes or sum(weights) <= 0:
        return None
    total = sum(weights)
    return sum((b[0] + b[2] / 2) * w for b, w in zip(boxes, weights)) / total, 1 - sum((b[1] + b[3] / 2) * w for b, w in zip(boxes, weights)) / total


def dominance(heat: np.ndarray) -> float | None:
    """How concentrated a saliency map is: 1 for a point, 0 for an even spread."""
    m = np.maximum(heat, 0).astype(float)
    if m.sum() <= 0:
        return None
    h, w = m.shape
    ys, xs = np.mgrid[0:h, 0:w]
    cx, cy = (m * xs).sum() / m.sum(), (m * ys).sum() / m.sum()
    var = (m * (((xs - cx) / w) ** 2 + ((ys - cy) / h) ** 2)).sum() / m.sum()
    return max(0.0, 1 - min(1.0, var * 6))


def gaze(left_eye: list[float], left_pupil: float, right_eye: list[float], right_pupil: float) -> float | None:
    """Mean pupil place over both eyes in [-1, 1]; None for eyes narrower than 0.05."""
    off = []
    for eye, pupil in ((left_eye, left_pupil), (right_eye, right_pupil)):
        if not eye or max(eye) - min(eye) <= 0.05:
            return None
        off.append((pupil - min(eye)) / (max(eye) - min(eye)))
    return sum(off) - 1


def mock_embedding(width: int, height: int) -> np.ndarray:
    """A unit vector that depends on the size only, for tests of everything downstream of the model."""
    seed, out = (width * 31 + height) % 2**64, np.empty(512, np.uint32)
    for i in range(512):
        # Multiplier and increment of the generator.
        seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
        out[i] = (seed >> 32) & 0x7FFFFF | 0x3F800000
    v = out.view(np.float32).astype(np.float64) * 2 - 3
    return v / np.sqrt((v * v).sum())


def to_blob(v: np.ndarray) -> bytes:
    return np.asarray(v, "<f4").tobytes()


def from_blob(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<f4")


def image_features(content: bytes, decoder: Decoder = decode) -> dict | None:
    rgb = decoder(content)
    if rgb is None:
        return None
    small, g = bounded(rgb, 256), grey(rgb)
    mag, ang = sobel(g)
    hue = accent(small)
    return {
        "width": rgb.shape[1], "height": rgb.shape[0], "dhash": dhash(rgb), "colorprofile": "bw" if is_grey(rgb) else "color",
        "accenthue": hue[0] if hue else None, "accentsaturation": hue[1] if hue else None,
        "hsl": hsl_histogram(small).tolist(), "palette": palette(small).tolist(), "edge": edge_histogram(mag, ang).tolist(), "grid": composition_grid(g, mag).tolist(),
    }


FEATURES = "width int, height int, dhash string, colorprofile string, accenthue double, accentsaturation double, hsl array<double>, palette array<double>, edge array<double>, grid array<double>"


def extract(df: DataFrame, key: str = "path", content: str = "content", decoder: Decoder = decode) -> DataFrame:
    """(key, features...) of a table of image files; unreadable and null contents give a row of nulls."""
    names = [f.split(" ")[0] for f in FEATURES.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(image_features(bytes(c), decoder) if c is not None else None) or dict.fromkeys(names) for c in pdf[content]]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return df.select(key, content).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {FEATURES}")


def blob_to_vector(blob: Column) -> Column:
    """Little-endian 32-bit floats to an array; null stays null."""

    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else from_blob(x))

    return F.pandas_udf(run, "array<float>")(blob)


def vector_to_blob(vector: Column) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else to_blob(x))

    return F.pandas_udf(run, "binary")(vector)
