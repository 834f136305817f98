"""Singular values and right singular vectors of a small dense matrix.

Householder reflections make the matrix bidiagonal, the differential qd algorithm with shifts finds the
squares of its singular values to high relative accuracy, and twisted factorisations give their vectors.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)
#: Off-diagonal squares below this share of what stands beside them count as none.
_NEGLIGIBLE = (100 * _EPS) ** 2
#: The vectors of eigenvalues closer than this, relative to their size, are made orthogonal together;
#: closer than the second, they can't be told apart by their eigenvalues and are found together.
_CLOSE, _EQUAL = 1e-2, 1e-10


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The diagonal and the one above it of U^T matrix V for a square matrix, and V."""
    a = np.array(matrix, float)
    size = len(a)
    right = np.eye(size)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """The unit vector v for which x - 2 v (v.x) has only its first entry."""
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        v = x / norm
        v[0] += np.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(size):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < size - 2:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One step of dqds; the last number is how many places went well, all of them if the shift was low
    enough."""
    new_q, new_e, d = [], [], q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return new_q, new_e, k
        top = d + e[k]
        new_q.append(top)
        if top == 0:
            new_e.append(0.0)
            d = q[k + 1] - shift
        else:
            ratio = q[k + 1] / top
            new_e.append(e[k] * ratio)
            d = d * ratio - shift
    new_q.append(d)
    return new_q, new_e, len(q) - (d < 0)


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, falling, of B^T B, with q and e the squares of B's diagonal and the one above it."""
    found: list[float] = []
    waiting = [(list(map(float, q)), list(map(float, e)), 0.0)]
    while waiting:
        q, e, moved = waiting.pop()
        tries = 0
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= _NEGLIGIBLE * (moved + min(q[k], q[k + 1]))), None)
            if cut is not None:
                waiting.append((q[: cut + 1], e[:cut], moved))
                q, e, tries = q[cut + 1 :], e[cut + 1 :], 0
                continue
            if 1.5 * q[0] < q[-1]:
                # The small ones are found at the end.
                q, e = q[::-1], e[::-1]
            # The smaller eigenvalue of the last two rows, by a formula without cancellation.
            a, b = q[-2] + e[-1], q[-1]
            root = ((a - b) / 2) ** 2 + e[-1] * b
            shift = q[-2] * b / ((a + b) / 2 + root**0.5) if a + b > 0 else 0.0
            if tries > 60:
                shift = 0.0
            for _ in range(6):
                new_q, new_e, well = _transform(q, e, shift)
                if well == len(q):
                    break
                # Only the last place below zero tells how much too far the shift went.
                late = well == len(q) - 1 and shift + new_q[-1] > 0
                shift = (shift + new_q[-1]) * (1 - 4 * _EPS) if late else shift / 4
            else:
                shift = 0.0
                new_q, new_e, _ = _transform(q, e, shift)
            q, e, moved, tries = new_q, new_e, moved + shift, tries + 1
        found.append(q[0] + moved)
    return np.sort(np.maximum(found, 0.0))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """The unit vector of an eigenvalue of L D L^T, from the factorisations from above and from below
    joined where the remainder is smallest."""
    size, tiny = len(d), _EPS**4 * float(np.max(d))
    s, p = np.empty(size), np.empty(size)
    down, up = np.empty(size - 1), np.empty(size - 1)
    s[0], p[-1] = -value, d[-1] - value
    for k in range(size - 1):
        pivot = s[k] + d[k] or tiny
        down[k] = d[k] * low[k] / pivot
        s[k + 1] = down[k] * low[k] * s[k] - value
    for k in range(size - 2, -1, -1):
        pivot = d[k] * low[k] ** 2 + p[k + 1] or tiny
        up[k] = low[k] * d[k] / pivot
        p[k] = p[k + 1] * d[k] / pivot - value
    rest = np.abs(s + p + value)
    at = int(np.argmin(np.where(np.isfinite(rest), rest, np.inf)))
    z = np.zeros(size)
    z[at] = 1
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at, size - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def _apart(tridiagonal: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Independent vectors of eigenvalues that are equal but for rounding, by inverse iteration."""
    size, count = len(tridiagonal), len(values)
    basis = np.linalg.qr(np.random.default_rng(size).standard_normal((size, count)))[0]
    width = max(values[0] - values[-1], 64 * _EPS * abs(values[0]))
    shifted = tridiagonal - (values[-1] - width) * np.eye(size)
    for _ in range(4):
        basis = np.linalg.qr(np.linalg.solve(shifted, basis))[0]
    return basis


def _turned(bidiagonal: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Orthonormal vectors in the space of the given ones for which B^T B is diagonal, falling."""
    basis = np.linalg.qr(vectors)[0]
    return basis @ np.linalg.svd(bidiagonal @ basis)[2].T


def _runs(values: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """Where runs of values begin and end whose neighbours are closer than `gap`, relatively."""
    cuts = (np.flatnonzero(values[:-1] - values[1:] > gap * values[:-1]) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(values)]))


def right_singular(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The squares of a square matrix's singular values, falling, and their right vectors as columns."""
    size = len(matrix)
    scale = float(np.max(np.abs(matrix))) if size else 0.0
    if scale == 0:
        return np.zeros(size), np.eye(size)
    main, above, right = bidiagonalise(matrix / scale)
    norm = max(float(np.max(np.abs(main))), float(np.max(np.abs(above))) if size > 1 else 0.0)
    # Rounding alone moves entries by as much.
    main = np.where(np.abs(main) < _EPS * norm, _EPS * norm, main)
    above = np.where(np.abs(above) < _EPS * norm / 16, 0.0, above)
    values, vectors = [], np.zeros((size, size))
    borders = [0, *(np.flatnonzero(above == 0) + 1).tolist(), size]
    for low, high in zip(borders, borders[1:]):
        d, e = main[low:high], above[low : high - 1]
        own = dqds(d**2, e**2)
        found = np.stack([_twisted(d**2, e / d[:-1], x) for x in own], axis=1)
        b_matrix = np.diag(d) + np.diag(e, 1)
        for first, last in _runs(own, _EQUAL):
            if last - first > 1:
                found[:, first:last] = _apart(b_matrix.T @ b_matrix, own[first:last])
        for first, last in _runs(own, _CLOSE):
            if last - first > 1:
                found[:, first:last] = _turned(b_matrix, found[:, first:last])
        vectors[low:high, low:high] = found
        values.extend(own)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order] * scale**2, (right @ vectors)[:, order]
