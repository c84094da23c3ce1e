"""Image arrays: luma, Otsu, crop, resize, stain statistics. The formulas are those of the column expressions."""

from __future__ import annotations

import numpy as np

from tessella.functions import colour


def gray(pixels: np.ndarray) -> np.ndarray:
    if pixels.ndim == 2:
        return pixels
    r, g, b = (pixels[..., i].astype(np.int64) for i in range(3))
    return ((2126 * r + 7152 * g + 722 * b) // 10000).astype(np.uint8)


def otsu(counts: np.ndarray) -> int:
    """The smallest intensity of the greatest variance between classes of a histogram; 0 without one."""
    i, n = np.arange(len(counts)), counts.astype(np.int64)
    wb, sb = np.cumsum(n), np.cumsum(i * n)
    wf, sf = wb[-1] - wb, sb[-1] - sb
    both = (wb > 0) & (wf > 0)
    v = np.where(both, wb * wf * (sb / np.maximum(wb, 1) - sf / np.maximum(wf, 1)) ** 2, 0.0)
    return int(v.argmax()) if v.max() > 0 else 0


def tissue(pixels: np.ndarray, threshold: int) -> np.float32:
    g = gray(pixels)
    return np.float32(np.float32((g <= threshold).sum()) / np.float32(g.size)) if g.size else np.float32(0)


def resize(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, the triangle widened when shrinking."""
    out = pixels.reshape(*pixels.shape[:2], -1).astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        old = out.shape[axis]
        scale = old / size
        support = max(scale, 1.0)
        centre = (np.arange(size) + 0.5) * scale
        weight = np.maximum(1 - np.abs(np.arange(old)[None, :] + 0.5 - centre[:, None]) / support, 0)
        weight /= weight.sum(1, keepdims=True)
        out = np.moveaxis(np.tensordot(weight, out, (1, axis)), 0, axis)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8).reshape((height, width) if pixels.ndim == 2 else (height, width, -1))


def lab(pixels: np.ndarray) -> np.ndarray:
    c = pixels.astype(np.float64) / 255
    lin = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = lin @ np.array(colour.TO_XYZ).T / np.array(colour.WHITE)
    f = np.where(t > colour.DELTA**3, np.cbrt(t), t / (3 * colour.DELTA**2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(x: np.ndarray) -> np.ndarray:
    fy = (x[..., 0] + 16) / 116
    f = np.stack([fy + x[..., 1] / 500, fy, fy - x[..., 2] / 200], -1)
    xyz = np.where(f > colour.DELTA, f**3, (f - 4 / 29) * 3 * colour.DELTA**2) * np.array(colour.WHITE)
    c = np.clip(xyz @ np.array(colour.FROM_XYZ).T, 0, 1)
    c = np.where(c <= 0.0031308, c * 12.92, c ** (1 / 2.4) * 1.055 - 0.055)
    return np.floor(np.clip(c, 0, 1) * 255 + 0.5).astype(np.uint8)


def normalize(pixels: np.ndarray, target: tuple[float, ...]) -> np.ndarray:
    """Means and deviations of Lab moved to the target's (three means, three deviations); a flat channel only moves."""
    x = lab(pixels if pixels.ndim == 3 else np.repeat(pixels[..., None], 3, 2))
    mean, std = x.mean((0, 1)), x.std((0, 1))
    return from_lab((x - mean) * np.where(std <= 1e-6, 1.0, np.array(target[3:]) / np.maximum(std, 1e-12)) + np.array(target[:3]))


def stain_stats(pixels: np.ndarray) -> tuple[float, ...]:
    """An image's means and deviations of Lab: what normalize takes as its target."""
    x = lab(pixels if pixels.ndim == 3 else np.repeat(pixels[..., None], 3, 2))
    return tuple(float(v) for v in (*x.mean((0, 1)), *x.std((0, 1))))


def thumbnail(pixels: np.ndarray, most: int) -> np.ndarray:
    """At most `most` pixels on the longer side, the aspect ratio kept; smaller images stay as they are."""
    h, w = pixels.shape[:2]
    longer = max(h, w)
    return pixels if longer <= most else resize(pixels, max(1, round(w * most / longer)), max(1, round(h * most / longer)))
