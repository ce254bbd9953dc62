"""Image kernels in NumPy and the column functions around them.

Pictures are BGR or gray uint8 arrays. Only the kernels touch pixels. Vectors and shifts are made where the files are read,
by ranges of frames (see ``sources.measure``); whole pictures move only where they are stitched or compared at a change of
state. A kernel that fails gives an error beside its result, so that a bad frame stops its own recording and no other.
"""

import importlib.util
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of blue, green and red in a gray level.
_LUMA = (0.114, 0.587, 0.299)
_PNG = b"\x89PNG\r\n\x1a\n"


def decode(row) -> np.ndarray | None:
    """BGR array of an ``image`` struct with one, three or four channels; None if there is no picture."""
    if row is None or row["height"] is None or row["height"] <= 0:
        return None
    a = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(a, 3, axis=2) if a.shape[2] == 1 else a[:, :, :3]


def to_gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr.astype(np.float64) @ _LUMA).astype(np.uint8) if bgr.ndim == 3 else bgr


def area_resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each target pixel is the mean of the source area it covers, parts of pixels by their share."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        size = a.shape[0]
        sums = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0, dtype=np.float64)])
        edges = np.arange(n + 1) * (size / n)
        low = np.minimum(edges.astype(int), size - 1)
        at = sums[low] + (edges - low)[:, None] * a[low]
        return (at[1:] - at[:-1]) * (n / size)

    return along(along(gray.astype(np.float64), height).T, width).T


def hue_saturation(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight-bit hue in [0, 180) and saturation in [0, 256)."""
    b, g, r = (bgr[:, :, k].astype(np.float64) for k in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    spread = np.where(top > low, top - low, 1.0)
    hue = np.where(top == r, (g - b) / spread, np.where(top == g, 2 + (b - r) / spread, 4 + (r - g) / spread)) * 30
    hue = np.where(top > low, hue, 0.0)
    return np.rint(hue + 180 * (hue < 0)).astype(int) % 180, np.rint(255 * (top - low) / np.maximum(top, 1)).astype(int)


def color_bin(hue: np.ndarray, saturation: np.ndarray) -> np.ndarray:
    """Which of 8 by 8 bins a colour is in, hue by hue."""
    return hue * 8 // 180 * 8 + saturation // 32


def color_bin_column(hue: Column, saturation: Column) -> Column:
    """:func:`color_bin` of two columns of integers."""
    whole = lambda x, by: F.floor(x / by)
    return (whole(hue * 8, 180) * 8 + whole(saturation, 32)).cast("int")


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 1e-8 else v


class DefaultEmbedder:
    """Structure (a 32 by 32 gray thumbnail without its mean) and, at half weight, colour (8 by 8 hue and saturation bins)."""

    name = "default"

    def __init__(self, thumb: int = 32, color_weight: float = 0.5):
        self.thumb, self.color_weight = thumb, color_weight

    def embed_path(self, path: str) -> np.ndarray:
        return self.embed(read_png(path))

    def embed(self, bgr: np.ndarray) -> np.ndarray:
        small = np.rint(area_resize(to_gray(bgr), self.thumb, self.thumb)).ravel()
        h, s = hue_saturation(bgr)
        bins = np.bincount(color_bin(h, s).ravel(), minlength=64).astype(float)
        return _unit(np.concatenate([_unit(small - small.mean()), _unit(bins) * self.color_weight]))


class ClipEmbedder:
    """A plug-in that needs open_clip and torch, without which it can't be made; the model is loaded on first use."""

    name = "clip"

    def __init__(self, model: str = "ViT-B-32", weights: str = "laion2b_s34b_b79k"):
        missing = [m for m in ("open_clip", "torch") if importlib.util.find_spec(m) is None]
        if missing:
            raise RuntimeError(f"the clip embedder needs packages that aren't installed: {', '.join(missing)}")
        self.model, self.weights, self._loaded = model, weights, None

    def embed_path(self, path: str) -> np.ndarray:
        return self.embed(read_png(path))

    def embed(self, bgr: np.ndarray) -> np.ndarray:
        if self._loaded is None:
            import open_clip
            import torch

            device = "cuda" if torch.cuda.is_available() else "cpu"
            net, _, prepare = open_clip.create_model_and_transforms(self.model, pretrained=self.weights)
            self._loaded = torch, net.to(device).eval(), prepare, device
        torch, net, prepare, device = self._loaded
        from PIL import Image

        with torch.no_grad():
            v = net.encode_image(prepare(Image.fromarray(bgr[:, :, ::-1])).unsqueeze(0).to(device))
        return _unit(v[0].cpu().numpy().astype(float))


_EMBEDDERS: dict[str, Callable] = {"default": DefaultEmbedder, "clip": ClipEmbedder}


def register_embedder(name: str, factory: Callable) -> None:
    _EMBEDDERS[name] = factory


def _factory(name: str) -> Callable:
    if name not in _EMBEDDERS:
        raise ValueError(f"unknown embedder {name!r}; known: {', '.join(sorted(_EMBEDDERS))}")
    return _EMBEDDERS[name]


def get_embedder(name: str):
    return _factory(name)()


def match_template(picture: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Normalised correlation of ``part`` with every place of ``picture``; 1 everywhere for a part without contrast."""
    p, t = picture.astype(np.float64), part.astype(np.float64)
    h, w = t.shape
    t = t - t.mean()
    shape = [1 << (n - 1).bit_length() for n in (p.shape[0] + h, p.shape[1] + w)]
    cross = np.fft.irfft2(np.fft.rfft2(p - p.mean(), shape) * np.conj(np.fft.rfft2(t, shape)), shape)[: p.shape[0] - h + 1, : p.shape[1] - w + 1]

    def box(a: np.ndarray) -> np.ndarray:
        s = np.pad(np.cumsum(np.cumsum(a, 0), 1), ((1, 0), (1, 0)))
        return s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]

    spread = np.maximum(box(p * p) - box(p) ** 2 / (h * w), 0)
    scale = np.sqrt(spread * (t * t).sum())
    if (t * t).sum() < 1e-8:
        return np.ones_like(cross)
    return np.where(scale > 1e-6, cross / np.where(scale > 1e-6, scale, 1), 0.0)


def estimate_shift(before: np.ndarray, after: np.ndarray, max_dim: int = 720) -> tuple[float, float, float]:
    """(dx, dy, response) of gray ``after`` against ``before``; dy > 0 where content moved up, as when scrolling down.

    A band from the middle of ``after`` is sought in ``before``, both scaled so that no side is over ``max_dim``. Pictures
    of different or no size, and too small for the band, give zeros.
    """
    if before.shape != after.shape or before.size == 0:
        return 0.0, 0.0, 0.0
    (small, scale), (other, _) = search_size(before, max_dim), search_size(after, max_dim)
    return shift_between(small, other, scale)


def search_size(gray: np.ndarray, max_dim: int = 720) -> tuple[np.ndarray, float]:
    """``gray`` scaled down so that no side is over ``max_dim``, and the scale."""
    scale = min(1.0, max_dim / max(gray.shape))
    if scale < 1.0:
        height, width = (max(1, int(n * scale)) for n in gray.shape)
        gray = np.rint(area_resize(gray, width, height)).astype(np.uint8)
    return gray, scale


def shift_between(before: np.ndarray, after: np.ndarray, scale: float) -> tuple[float, float, float]:
    """The shift of pictures in search size, in pixels of the full size."""
    if before.shape != after.shape:
        return 0.0, 0.0, 0.0
    h, w = after.shape
    top, left, tall, wide = int(h * 0.40), int(w * 0.15), max(40, int(h * 0.18)), int(w * 0.70)
    band = after[top : top + tall, left : left + wide]
    if band.size == 0 or band.shape[0] >= h or band.shape[1] >= w:
        return 0.0, 0.0, 0.0
    found = match_template(before, band)
    y, x = np.unravel_index(int(found.argmax()), found.shape)
    return float((x - left) / scale), float((y - top) / scale), float(found[y, x])


def stitch(frames: list[np.ndarray | None], rows: list[int]) -> np.ndarray | None:
    """One tall picture of frames in the order of a plan (see ``pairs.stitch_plan``): the bottom ``rows`` of each.

    None for fewer than two frames, one that can't be read, or frames of different widths.
    """
    if len(frames) < 2 or any(f is None for f in frames) or len({f.shape[1] for f in frames}) > 1:
        return None
    return np.concatenate([f[f.shape[0] - n :] for f, n in zip(frames, rows, strict=True) if n], axis=0)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation clipped to [0, 1]; 1 where either has no contrast."""
    if np.array_equal(a, b):
        return 1.0
    a, b = a.ravel() - a.mean(), b.ravel() - b.mean()
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return 1.0 if scale < 1e-8 else float(np.clip(a @ b / scale, 0.0, 1.0))


def bilinear_resize(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    def along(a: np.ndarray, n: int) -> np.ndarray:
        at = np.clip((np.arange(n) + 0.5) * a.shape[0] / n - 0.5, 0, a.shape[0] - 1)
        low = np.floor(at).astype(int)
        part = (at - low)[:, None]
        return a[low] * (1 - part) + a[np.minimum(low + 1, a.shape[0] - 1)] * part

    return along(along(gray.astype(np.float64), height).T, width).T


def boundary_metrics(before: np.ndarray, after: np.ndarray, band: float = 0.12) -> tuple[float, float, float, float]:
    """(border similarity, brightness drop, top similarity, middle similarity) of two BGR frames."""
    a, b = to_gray(before).astype(np.float64), to_gray(after).astype(np.float64)
    if a.shape != b.shape:
        a = bilinear_resize(a, b.shape[1], b.shape[0])
    h, w = b.shape
    edge = np.ones((h, w), bool)
    edge[int(h * band) : h - int(h * band), int(w * band) : w - int(w * band)] = False
    middle = slice(int(h * 0.25), int(h * 0.9))
    return similarity(a[edge], b[edge]), float(a.mean() - b.mean()), similarity(a[: int(h * 0.18)], b[: int(h * 0.18)]), similarity(a[middle], b[middle])


def png_bytes(bgr: np.ndarray) -> bytes:
    """An eight-bit RGB PNG without row filters."""
    h, w = bgr.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(bgr[:, :, ::-1]).reshape(h, w * 3)], axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def _unfiltered(lines: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Rows of pixels out of rows that are told by what lies to their left and above, by their kinds.

    A pixel needs its left, upper and upper left neighbour. Along a diagonal none needs another, so a diagonal of all rows is
    worked out at once; rows that need no left neighbour, or no upper one, go at once themselves.
    """
    h, w, c = lines.shape
    if kinds.max(initial=0) < 3:
        out = np.zeros((h + 1, w, c), np.uint8)
        for y in range(h):
            row = np.cumsum(lines[y], axis=0, dtype=np.uint8) if kinds[y] == 1 else lines[y]
            out[y + 1] = row + out[y] if kinds[y] == 2 else row
        return out[1:]
    slant = np.zeros((w + h + 2, h + 1, c), np.int16)  # pixel (y, x) at place x + y + 2 of row y + 1
    raw = np.zeros((w + h, h, c), np.int16)
    at = np.arange(h)
    for x in range(w):
        raw[x + at, at] = lines[:, x]
    kind = kinds[:, None]
    for t in range(w + h - 1):
        left, up, corner = slant[t + 1, 1:], slant[t + 1, :-1], slant[t, :-1]
        a, b = np.abs(up - corner), np.abs(left - corner)
        far = np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= far), left, np.where(b <= far, up, corner))
        guess = np.choose(kind, (np.int16(0), left, up, (left + up) >> 1, nearest))
        rows = slice(max(0, t - w + 1), min(h, t + 1))
        slant[t + 2, 1:][rows] = (raw[t, rows] + guess[rows]) & 255
    out = np.empty((h, w, c), np.uint8)
    for x in range(w):
        out[:, x] = slant[x + at + 2, at + 1]
    return out


def decode_png(data: bytes) -> np.ndarray:
    """BGR array of an eight-bit PNG that is neither interlaced nor indexed."""
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += n + 12
    channels = {0: 1, 2: 3, 4: 2, 6: 4}
    if data[:8] != _PNG or head is None or head[2] != 8 or head[3] not in channels or head[6]:
        raise ValueError("not a plain eight-bit PNG")
    w, h, c = head[0], head[1], channels[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, w * c + 1)
    picture = _unfiltered(lines[:, 1:].reshape(h, w, c), lines[:, 0].astype(np.int64))
    return np.repeat(picture[:, :, :1], 3, axis=2) if c < 3 else np.ascontiguousarray(picture[:, :, 2::-1])


def read_png(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        return decode_png(f.read())


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def boundary_column(before: Column, after: Column, read: Callable[[str], bytes]) -> Column:
    """struct(border, drop, top, middle) of the pictures that ``read`` finds at two columns of paths; all null where one can't
    be read or compared."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            try:
                rows.append(boundary_metrics(decode_png(read(x)), decode_png(read(y))))
            except Exception:  # an unknown transition, as for frames that can't be read
                rows.append((None,) * 4)
        return pd.DataFrame(rows, columns=["border", "drop", "top", "middle"]).astype("Float64")

    return F.pandas_udf(run, "border double, drop double, top double, middle double")(before, after)
