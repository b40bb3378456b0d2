"""Phase correlation and warping."""

from __future__ import annotations

import numpy as np


def phase_shift(reference: np.ndarray, moving: np.ndarray, upsampling: int = 1, normalization: str | None = None) -> np.ndarray:
    """Shift, per axis, that brings moving onto reference, to 1 / upsampling of a pixel."""
    a, b = np.fft.fftn(reference), np.fft.fftn(moving)
    product = a * b.conj()
    if normalization == "phase":
        product /= np.maximum(np.abs(product), 100 * np.finfo(float).eps)
    elif normalization is not None:
        raise ValueError(f"normalization {normalization!r} is neither None nor 'phase'")
    corr = np.fft.ifftn(product)
    peak = np.unravel_index(np.argmax(np.abs(corr)), corr.shape)
    shift = np.array([p - n if p > n // 2 else p for p, n in zip(peak, corr.shape, strict=True)], float)
    if upsampling > 1:  # a finer grid around the peak, by matrix products with the transform
        shift = np.round(shift * upsampling) / upsampling
        size = int(np.ceil(upsampling * 1.5))
        middle = size // 2
        offset = middle - shift * upsampling
        part = product.conj()
        for n, o in zip(product.shape[::-1], offset[::-1], strict=True):
            kernel = (np.arange(size) - o)[:, None] * np.fft.fftfreq(n, upsampling)
            part = np.tensordot(np.exp(-2j * np.pi * kernel), part, axes=(1, -1))
        fine = np.abs(part.conj())
        at = np.array(np.unravel_index(np.argmax(fine), fine.shape), float)
        shift = shift + (at - middle) / upsampling
    shift[np.array(reference.shape) == 1] = 0
    return shift


def similarity(shift_x: float = 0, shift_y: float = 0, scale: float = 1, rotation: float = 0) -> list[float]:
    """Row-major 3 x 3 matrix from input (x, y) to output."""
    c, s = scale * np.cos(rotation), scale * np.sin(rotation)
    return [float(v) for v in (c, -s, shift_x, s, c, shift_y, 0, 0, 1)]


def warp(a: np.ndarray, matrix: list[float], order: int = 1) -> np.ndarray:
    """out(x, y) = a(matrix @ (x, y, 1)), bilinear; 0 outside."""
    m = np.asarray(matrix, float).reshape(3, 3)
    y, x = np.mgrid[: a.shape[0], : a.shape[1]].astype(float)
    w = m[2, 0] * x + m[2, 1] * y + m[2, 2]
    sx, sy = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / w, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / w
    if order == 0:
        sx, sy = np.round(sx), np.round(sy)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    wide = np.pad(np.asarray(a, float), 1)
    get = lambda yy, xx: np.where((yy >= -1) & (yy <= a.shape[0]) & (xx >= -1) & (xx <= a.shape[1]), wide[np.clip(yy + 1, 0, a.shape[0] + 1), np.clip(xx + 1, 0, a.shape[1] + 1)], 0)
    return (1 - fy) * ((1 - fx) * get(y0, x0) + fx * get(y0, x0 + 1)) + fy * ((1 - fx) * get(y0 + 1, x0) + fx * get(y0 + 1, x0 + 1))
