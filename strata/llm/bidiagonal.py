"""Singular values and right singular vectors of a small square matrix: Householder bidiagonalisation, dqds for the
values, twisted factorisations for the vectors. Used by :mod:`.whitening` on the triangular factor of all rows,
whose size is the number of dimensions; no row of data comes here."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, right) with r = left B right^T, B upper bidiagonal with diagonal a and superdiagonal b."""
    m = np.array(r, float)
    d = m.shape[1]
    right = np.eye(d)

    def reflector(x):
        """Unit v with (I - 2 v v^T) x a multiple of the first axis (None if x is one already)."""
        if not np.any(x[1:]):
            return None
        v = x / np.abs(x).max()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(m[k:, k].copy())
        if v is not None:
            m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
        if k < d - 2:
            v = reflector(m[k, k + 1:].copy())
            if v is not None:
                m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ v, v)
                right[:, k + 1:] -= 2 * np.outer(right[:, k + 1:] @ v, v)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), right


def _transform(q: list[float], e: list[float], shift: float):
    """One dqds step: (q, e) of the shifted matrix and the least d, which is negative if the shift is too large."""
    n = len(q)
    qs, es = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for k in range(n - 1):
        if d < 0:
            return qs, es, d
        qs[k] = d + e[k]
        ratio = q[k + 1] / qs[k] if qs[k] > 0 else 0.0
        es[k] = e[k] * ratio
        d = d * ratio - shift if qs[k] > 0 else q[k + 1] - shift
        least = min(least, d)
    qs[n - 1] = d
    return qs, es, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, largest first, by differential qd steps with shifts.
    A shift that would make a d negative is cut and the step repeated, so all stays positive and the small
    values keep their digits."""
    found = []
    blocks = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while blocks:
        q, e, total = blocks.pop()
        steps = 0
        while q:
            n = len(q)
            if n == 1:
                found.append(q.pop() + total)
                break
            if n > 2 and steps % 8 == 0 and 1.5 * q[0] < q[-1]:  # graded the wrong way round: the same matrix from its other end
                q.reverse()
                e.reverse()
            if e[-1] <= EPS * EPS * (total + q[-1]) or e[-1] <= TINY:
                found.append(q.pop() + total)
                e.pop()
                continue
            cut = next((k for k in range(n - 2, 0, -1) if e[k - 1] <= EPS * EPS * (total + q[k]) or e[k - 1] <= TINY), None)
            if cut is not None:  # two matrices without a link
                blocks.append((q[:cut], e[:cut - 1], total))
                q, e = q[cut:], e[cut:]
                continue
            # smaller eigenvalue of the last two rows, a little reduced
            s, p = q[-2] + e[-1] + q[-1], q[-2] * q[-1]
            shift = 0.0 if steps % 16 == 15 else 0.98 * (2 * p / (s + np.sqrt(max(s * s - 4 * p, 0.0)))) if s > 0 else 0.0
            while True:
                qs, es, least = _transform(q, e, shift)
                if least >= 0 or shift == 0:
                    break
                shift = shift / 4 if shift > EPS * (total + q[-1]) else 0.0
            q, e, total, steps = [max(x, 0.0) for x in qs], es, total + shift, steps + 1
    return np.sort(np.array(found))[::-1]


def _twisted(dd: np.ndarray, ll: np.ndarray, value: float) -> np.ndarray:
    """Unit vector z with (L D L^T - value) z small: the stationary factorisation from the top and the
    progressive one from the bottom, joined at the row with the least residual."""
    n = len(dd)
    top, up, s = np.empty(n), np.empty(max(n - 1, 0)), -value
    tops = np.empty(n)
    safe = EPS * max(np.abs(dd).max(), abs(value), TINY)
    for k in range(n):
        tops[k] = s
        if k < n - 1:
            pivot = dd[k] + s
            pivot = pivot if abs(pivot) > safe * EPS else np.copysign(safe * EPS, pivot or 1.0)
            top[k], up[k] = pivot, dd[k] * ll[k] / pivot
            s = up[k] * ll[k] * s - value
    down, p = np.empty(max(n - 1, 0)), dd[n - 1] - value
    bottoms = np.empty(n)
    bottoms[n - 1] = p
    for k in range(n - 2, -1, -1):
        pivot = dd[k] * ll[k] ** 2 + p
        pivot = pivot if abs(pivot) > safe * EPS else np.copysign(safe * EPS, pivot or 1.0)
        ratio = dd[k] / pivot
        down[k] = ll[k] * ratio
        p = p * ratio - value
        bottoms[k] = p
    gamma = tops + bottoms + value
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -up[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -down[k] * z[k]
    return z / np.linalg.norm(z)


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal eigenvectors (columns) of B^T B for its eigenvalues ``values`` (largest first). Close
    eigenvalues form groups; inside a group each vector is made orthogonal to those before it, and where nothing
    is left of it, it is found by inverse iteration from a fixed start instead."""
    n = len(a)
    t_diag, t_off = a ** 2, a[:-1] * b
    t_diag = t_diag.copy()
    t_diag[1:] += b ** 2
    scale = max(np.abs(t_diag).max() + 2 * (np.abs(t_off).max() if n > 1 else 0.0), TINY)
    tri = np.diag(t_diag) + np.diag(t_off, 1) + np.diag(t_off, -1)
    # L D L^T with zero pivots replaced by a value far below the rounding of B^T B
    dd = np.where(a ** 2 > scale * EPS ** 2, a ** 2, scale * EPS ** 2)
    ll = t_off / dd[:-1]
    z = np.zeros((n, len(values)))
    start = 0
    rng = np.random.default_rng(13)
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * max(abs(values[j - 1]), scale * 1e-3):
            start = j
        before = z[:, start:j]
        v = _twisted(dd, ll, value)
        for _ in range(2):
            v = v - before @ (before.T @ v)
        size = np.linalg.norm(v)
        if size < 0.5 or np.linalg.norm(tri @ v - value * v) > 1e3 * EPS * scale * size:
            v = v / size if size > 1e-3 else rng.standard_normal(n)
            shifted = tri - (value + EPS * scale) * np.eye(n)
            for _ in range(4):
                for _ in range(2):
                    v = v - before @ (before.T @ v)
                v = np.linalg.solve(shifted, v / np.linalg.norm(v))
                v = v / np.linalg.norm(v)
            for _ in range(2):
                v = v - before @ (before.T @ v)
        z[:, j] = v / np.linalg.norm(v)
    return z


def singular(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of a square matrix, the ``k`` largest."""
    scale = np.abs(r).max() if r.size else 0.0
    if not scale:
        return np.zeros(0), np.zeros((r.shape[1], 0))
    a, b, right = bidiagonalise(r / scale)
    values = dqds(a, b)[:k]
    return values * scale ** 2, right @ right_vectors(a, b, values)
