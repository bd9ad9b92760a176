"""Page images: numpy operators, run in Arrow UDFs over binary columns.

A grey image is a 2-d uint8 array, a coloured one has red, green and blue along a
third axis; in tables an image is (width, height, pixels) with the pixels row by
row, so that the number of pixels tells which it is.  Every function here works on one image in memory, so a
batch holds a few pages whatever the corpus holds.
"""

from __future__ import annotations

import base64
import io
import math
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Gray = np.ndarray
Image = np.ndarray


def to_gray(image: Image) -> Gray:
    """Luma of a coloured image, by the usual 16-bit weights; a grey one as it is."""
    if image.ndim == 2:
        return image
    return ((image[..., :3].astype(np.uint32) @ np.array([19595, 38470, 7471], np.uint32) + 0x8000) >> 16).astype(np.uint8)


def by_channel(of: Callable[[Gray], Gray]) -> Callable[[Image], Image]:
    """A grey operator on each colour of an image."""
    return lambda image: of(image) if image.ndim == 2 else np.stack([of(image[..., k]) for k in range(image.shape[2])], axis=-1)


def from_row(pixels: bytes, width: int, height: int) -> Image:
    flat = np.frombuffer(pixels, np.uint8)
    shape = (int(height), int(width))
    return flat.reshape(shape) if flat.size == shape[0] * shape[1] else flat.reshape(*shape, -1)


def otsu(gray: Gray) -> int:
    """The grey value that parts dark from light best; the first of equals; 127 if nothing does."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    spread = np.where((below > 0) & (above > 0), spread, 0.0)
    best = int(np.argmax(spread))
    return best if spread[best] > 0 else 127


def binarize(gray: Gray, at: int = 0) -> Gray:
    """White from ``at`` upwards, black below; 0 finds the threshold."""
    return np.where(gray >= (at if at > 0 else otsu(gray)), 255, 0).astype(np.uint8)


def contrast(gray: Gray, factor: float = 1.4) -> Gray:
    """Away from the mean grey by a factor."""
    if factor <= 0 or abs(factor - 1) < 1e-3:
        return gray
    mean = float(int(to_gray(gray).mean() + 0.5))
    return np.clip(mean + (gray.astype(np.float64) - mean) * factor, 0, 255).astype(np.uint8)


def denoise(gray: Gray, size: int = 3) -> Gray:
    """The median of each square of ``size`` pixels; edges repeat their pixels."""
    if size <= 1:
        return gray
    half = size // 2
    padded = np.pad(gray, half, mode="edge")
    squares = np.lib.stride_tricks.sliding_window_view(padded, (size, size))
    return np.median(squares[: gray.shape[0], : gray.shape[1]], axis=(2, 3)).astype(np.uint8)


def resize(gray: Gray, width: int, height: int) -> Gray:
    """Bilinear, with a window as wide as the reduction."""

    def weights(n: int, m: int) -> np.ndarray:
        scale = n / m
        reach = max(scale, 1.0)
        centre = (np.arange(m) + 0.5) * scale - 0.5
        w = np.maximum(0, 1 - np.abs(np.arange(n)[None, :] - centre[:, None]) / reach)
        return w / w.sum(axis=1, keepdims=True)

    h, w = gray.shape
    return np.clip(weights(h, height) @ gray.astype(np.float64) @ weights(w, width).T + 0.5, 0, 255).astype(np.uint8)


def shrink(gray: Gray, longest: int) -> tuple[Gray, float]:
    """The image within ``longest`` pixels a side, and its scale."""
    h, w = gray.shape[:2]
    scale = min(longest / max(h, w), 1.0)
    return (by_channel(lambda g: resize(g, max(1, int(w * scale)), max(1, int(h * scale))))(gray), scale) if scale < 1 else (gray, 1.0)


def rotate(gray: Gray, degrees: float, fill: int = 255) -> Gray:
    """Counter-clockwise about the middle, on a sheet that holds all of it."""
    a = math.radians(degrees)
    c, s = math.cos(a), math.sin(a)
    h, w = gray.shape[:2]
    nw, nh = int(math.ceil(abs(w * c) + abs(h * s) - 1e-9)), int(math.ceil(abs(w * s) + abs(h * c) - 1e-9))
    y, x = np.mgrid[0:nh, 0:nw]
    dx, dy = x + 0.5 - nw / 2, y + 0.5 - nh / 2
    sx, sy = np.floor(c * dx - s * dy + w / 2).astype(int), np.floor(s * dx + c * dy + h / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full((nh, nw, *gray.shape[2:]), fill, np.uint8)
    out[inside] = gray[sy[inside], sx[inside]]
    return out


def skew_angle(gray: Gray, most: float = 2.0, step: float = 0.5) -> float:
    """The rotation at which dark pixels gather most in rows; the first of equals."""
    if most <= 0 or step <= 0:
        return 0.0
    black = binarize(shrink(gray, 600)[0])
    best, angle = (-1.0, 0.0), -most
    while angle <= most + 1e-6:
        spread = float(((rotate(black, angle) < 128).sum(axis=1)).var())
        if spread > best[0]:
            best = (spread, angle)
        angle += step
    return best[1]


def deskew(gray: Gray, most: float = 2.0, step: float = 0.5) -> Gray:
    angle = skew_angle(to_gray(gray), most, step)
    return gray if abs(angle) < 1e-3 else rotate(gray, angle)


def preprocess(gray: Image, enabled: bool = True, straighten: bool = True, most: float = 2.0, step: float = 0.5, median: bool = True, size: int = 3, factor: float = 1.4, black_white: bool = True, at: int = 0) -> Image:
    """Straightened, denoised, sharpened and binarized, each if wanted, in this order."""
    if not enabled:
        return gray
    if straighten:
        gray = deskew(gray, most, step)
    if median:
        gray = by_channel(lambda g: denoise(g, size))(gray)
    gray = contrast(gray, factor)
    return binarize(to_gray(gray), at) if black_white else gray


def limited_side(width: int, height: int, max_side: int, max_pixels: int, min_side: int = 600) -> int:
    if max_pixels <= 0 or max_side <= 0 or width * height <= max_pixels:
        return max_side
    return max(min_side, int(max_side * math.sqrt(max_pixels / max(width * height, 1))))


def split_blocks(gray: Gray, gap: float = 0.02, least: float = 0.08, ink: float = 0.01, white: int = 245, most: int = 6) -> list[tuple[int, int]]:
    """(top, bottom) of the page's blocks between empty bands; the whole page if there is one, or too many."""
    whole = [(0, gray.shape[0])]
    small, scale = shrink(to_gray(gray), 800)
    h, w = small.shape
    empty = (small < white).sum(axis=1) <= max(1, int(w * ink))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], empty.astype(np.int8), [0]])))
    bands = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= max(1, int(h * gap))]
    tops, bottoms = [0, *(b for _, b in bands)], [*(a for a, _ in bands), h]
    blocks = [(a, b) for a, b in zip(tops, bottoms, strict=True) if b - a >= max(1, int(h * least))]
    if not 1 < len(blocks) <= most:
        return whole
    return [(int(a / scale), int(b / scale)) for a, b in blocks]


def split_columns(gray: Gray, at: float, overlap: float = 0.02) -> list[Gray]:
    """The left and right part of a page, both with some of the other."""
    w = gray.shape[1]
    cut, more = int(w * at), int(w * overlap)
    return [gray[:, : min(w, cut + more)], gray[:, max(0, cut - more) :]]


def png(gray: Image) -> bytes:
    """An 8-bit PNG, grey or coloured."""
    h, w = gray.shape[:2]
    kind_of_pixel = 0 if gray.ndim == 2 else 2
    rows = b"".join(b"\0" + r.tobytes() for r in np.ascontiguousarray(gray))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind_of_pixel, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


#: Of JPEG files: a fixed value.
JPEG_QUALITY = 90


def jpeg(image: Image) -> bytes:
    """A coloured JPEG, by the imaging library where that is installed."""
    from PIL import Image as Pictures

    out = io.BytesIO()
    Pictures.fromarray(image).convert("RGB").save(out, "JPEG", quality=JPEG_QUALITY, optimize=True)
    return out.getvalue()


ENCODERS: dict[str, tuple[str, Callable[[Image], bytes]]] = {"PNG": ("png", png), "JPG": ("jpeg", jpeg), "JPEG": ("jpeg", jpeg)}


def data_url(gray: Image, max_side: int = 2000, form: str = "PNG") -> str:
    """The image, no larger than ``max_side``, as a data URL."""
    if max_side > 0:
        gray = shrink(gray, max_side)[0]
    kind, encode = ENCODERS[form.upper()]
    return f"data:image/{kind};base64," + base64.b64encode(encode(gray)).decode()


@dataclass(frozen=True)
class Look:
    """How a page's image becomes the images that are sent off."""

    dpi: int = 300
    dpi_high: int = 450
    max_side: int = 2000
    form: str = "PNG"
    preparation: tuple[tuple[str, object], ...] = ()  # arguments of ``preprocess``
    overlap: float = 0.02
    blocks: bool = False
    block_limits: tuple[tuple[str, object], ...] = ()  # arguments of ``split_blocks``
    max_pixels: int = 0
    min_side: int = 600
    skip_large: bool = False

    def parts(self, image: Image, split: float | None = None) -> list[Image]:
        """A page's parts in reading order: columns, else blocks if wanted, else the page."""
        if split:
            return split_columns(image, split, self.overlap)
        if self.blocks:
            return [image[a:b] for a, b in split_blocks(image, **dict(self.block_limits))]
        return [image]

    def url(self, part: Image) -> str:
        """One part, prepared and within limits; too large a part is an error if ``skip_large`` says so."""
        part = preprocess(part, **dict(self.preparation))
        h, w = part.shape[:2]
        if self.skip_large and 0 < self.max_pixels < w * h:
            raise RuntimeError(f"a part of the page has {w * h} pixels, more than {self.max_pixels}")
        return data_url(part, limited_side(w, h, self.max_side, self.max_pixels, self.min_side), self.form)

    def urls(self, image: Image, split: float | None = None) -> list[str]:
        return [self.url(x) for x in self.parts(image, split)]


def map_images(images: DataFrame, of: Callable[[Gray], object], column: str, kind: str) -> DataFrame:
    """``images`` (width, height, pixels and other columns) with ``column`` from each image; null pixels give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            shapes = zip(batch["width"], batch["height"], batch["pixels"], strict=True)
            yield batch.assign(**{column: [None if p is None else of(from_row(p, w, h)) for w, h, p in shapes]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema)
    return images.mapInPandas(run, f"{schema}, `{column}` {kind}")
