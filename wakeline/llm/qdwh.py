"""Eigenvectors of a symmetric matrix by spectral divide and conquer.

The polar factor U of A - s I is its matrix sign, so (U + I) / 2 projects on the eigenvectors
above the shift s. Bases of the projector's range and of what is left turn A into two blocks,
which are split in turn until blocks have one row, or are a multiple of the identity. The
polar factor comes from dynamically weighted Halley iterations (QDWH), which need QR
factorizations and products only and converge in about six steps whatever the condition.

For matrices that fit one machine: a covariance of d dimensions, d squared numbers.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = float(np.finfo(np.float64).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, symmetric itself."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1.0 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = _EPS
    low = min(max(low, _EPS), 1.0)
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = math.sqrt(1 + d)
        p = root + 0.5 * math.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis, _ = np.linalg.qr(np.vstack((math.sqrt(r) * x, np.eye(n))))
        new = q / r * x + (p - q / r) / math.sqrt(r) * (basis[:n] @ basis[n:].T)
        new = (new + new.T) / 2
        low = min(low * (p + q * square) / (1 + r * square), 1.0)
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= 10 * _EPS * math.sqrt(n) or (1 - low < 10 * _EPS and moved <= 1e-6):
            break
    # One Newton-Schulz step takes what the last iteration left to rounding.
    return (3 * x - x @ x @ x) / 2


def _basis(projector: np.ndarray, k: int) -> np.ndarray:
    """Orthonormal columns, the first ``k`` of them spanning the projector's range."""
    n = len(projector)
    start = np.random.default_rng(n).standard_normal((n, n))
    above, _ = np.linalg.qr(projector @ start[:, :k])
    above, _ = np.linalg.qr(projector @ above)
    below = start[:, k:] - projector @ start[:, k:]
    whole, _ = np.linalg.qr(np.hstack((above, below)))
    return whole


def _shifts(a: np.ndarray) -> list[float]:
    """Places to split at, best first; the mean lies between the eigenvalues of any block."""
    n = len(a)
    mean = float(np.trace(a)) / n
    spread = float(np.linalg.norm(a - mean * np.eye(n))) / math.sqrt(n)
    middle = float(np.median(np.diag(a)))
    return [mean, middle, *(mean + spread * f for f in (0.137, -0.137, 0.391, -0.391, 0.713, -0.713, 0.05, -0.05, 0.011, -0.011))]


def split(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis and how many of its columns belong to the upper part of ``a``."""
    n = len(a)
    size = float(np.linalg.norm(a))
    best = None
    for shift in _shifts(a):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = _basis(projector, k)
        left = float(np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]))
        if best is None or left < best[0]:
            best = (left, basis, k)
        if left <= 8 * _EPS * n * size:
            break
    return best and best[1:]


def _close(a: np.ndarray, scale: float) -> bool:
    """Nothing to tell apart: a multiple of the identity, to rounding."""
    n = len(a)
    return float(np.linalg.norm(a - np.trace(a) / n * np.eye(n))) <= 4 * _EPS * n * scale


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    The largest entry of each vector is positive.
    """
    v = (v + v.T) / 2
    n = len(v)
    scale = float(np.linalg.norm(v))
    vectors = []
    stack = [np.eye(n)]
    while stack:
        basis = stack.pop()
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        found = None if len(block) == 1 or not scale or _close(block, scale) else split(block)
        if found is None:
            vectors.append(basis)
        else:
            turned, k = found
            stack += [basis @ turned[:, k:], basis @ turned[:, :k]]
    q = np.hstack(vectors) if vectors else np.zeros((0, 0))
    q, r = np.linalg.qr(q)
    q = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")
    values, q = values[order], q[:, order]
    top = np.argmax(np.abs(q), axis=0) if n else np.zeros(0, int)
    return values, q * np.where(q[top, np.arange(n)] < 0, -1.0, 1.0)
