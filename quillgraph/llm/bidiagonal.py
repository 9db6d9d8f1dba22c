"""Singular values and right singular vectors of a small matrix: Householder bidiagonals, dqds, twisted factorisations.

A matrix of a few hundred columns is all that reaches this module: the triangular factor
that rows of any number leave behind. The dqds steps keep every singular value to high
relative accuracy; a twisted factorisation of B'B - v gives the vector of a value v from
the place where the factorisations from both ends meet with the smallest residual.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V of r = U B V' for a square r, by Householder reflections."""
    m, d = r.copy(), r.shape[1]
    v = np.eye(d)

    def reflector(x):
        u, size = x.copy(), np.sqrt(x @ x)
        if size == 0 or not x[1:].any():
            return None
        u[0] += np.copysign(size, x[0])
        return u / np.sqrt(u @ u)

    for k in range(d):
        u = reflector(m[k:, k])
        if u is not None:
            m[k:, k:] -= 2 * np.outer(u, u @ m[k:, k:])
        if k < d - 2:
            u = reflector(m[k, k + 1 :])
            if u is not None:
                m[k:, k + 1 :] -= 2 * np.outer(m[k:, k + 1 :] @ u, u)
                v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _blocks(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of a bidiagonal between superdiagonal entries that are zero to working accuracy."""
    cut = np.flatnonzero(np.abs(b) <= EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:]))) + 1
    edges = [0, *cut.tolist(), len(a)]
    return list(zip(edges, edges[1:]))


def _dqds_step(q: np.ndarray, e: np.ndarray, s: float):
    """One step of the differential quotient-difference transform with shift s; None if the shift was too large."""
    n = len(q)
    nq, ne = np.empty(n), np.empty(n - 1)
    d = q[0] - s
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        x = d + e[i]
        if x == 0:
            return None
        t = q[i + 1] / x
        nq[i], ne[i] = x, e[i] * t
        d = d * t - s
        least = min(least, d)
    if d < 0:
        return None
    nq[-1] = d
    return nq, ne, least, d


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of an upper bidiagonal's singular values, falling, by dqds with deflation from the bottom."""
    found = []
    stack = [(np.square(a), np.square(b), 0.0)]
    while stack:
        q, e, shift = stack.pop()
        failed, bound = 0, None
        while len(q):
            n = len(q)
            if n == 1:
                found.append(shift + q[0])
                break
            small = np.flatnonzero(e <= EPS * EPS * (np.minimum(q[:-1], q[1:]) + shift))
            if len(small):
                cut = int(small[-1]) + 1
                stack.append((q[:cut], e[: cut - 1], shift))
                q, e, bound = q[cut:], e[cut:], None
                continue
            if q[-1] + e[-1] * 0 <= 0 and e[-1] <= EPS * EPS * (q[-2] + shift):
                found.append(shift)
                q, e, bound = q[:-1], e[:-1], None
                continue
            # the smallest of the last two, held below the least pivot of the step before
            half, prod = (q[-2] + q[-1] + e[-1]) / 2, q[-2] * q[-1]
            low = prod / (half + np.sqrt(max(half * half - prod, 0.0))) if half > 0 else 0.0
            s = 0.0 if bound is None else max(0.0, min(low, bound) * (1 - 1e-3 * 4.0**failed)) if failed < 4 else 0.0
            step = _dqds_step(q, e, s)
            if step is None:
                if s == 0.0:  # a pivot of zero: the matrix is singular, and its last value is the shift itself
                    nudge = q.copy()
                    nudge[nudge == 0] = np.finfo(float).tiny
                    step = _dqds_step(nudge, e, 0.0)
                if step is None:
                    failed += 1
                    continue
            q, e, bound, _ = step
            shift += s
            failed = 0
    return np.sort(np.array(found))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """Unit vector z with (B'B - value) z near zero, from the twist with the smallest residual."""
    n = len(a)
    if n == 1:
        return np.ones(1)
    dd, ll = a * a, b / a[:-1]  # B'B = L D L'
    tiny = np.finfo(float).tiny * 1e10
    s, lp = np.empty(n), np.empty(n - 1)
    x = -value
    for i in range(n - 1):
        s[i] = x
        dp = dd[i] + x
        dp = dp if dp != 0 else tiny
        lp[i] = dd[i] * ll[i] / dp
        x = lp[i] * ll[i] * x - value
    s[-1] = x
    p, um = np.empty(n), np.empty(n - 1)
    p[-1] = dd[-1] - value
    for i in range(n - 2, -1, -1):
        dm = dd[i] * ll[i] ** 2 + p[i + 1]
        dm = dm if dm != 0 else tiny
        t = dd[i] / dm
        um[i] = ll[i] * t
        p[i] = p[i + 1] * t - value
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -lp[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -um[i] * z[i]
    size = np.sqrt(z @ z)
    return z / size if np.isfinite(size) and size > 0 else np.eye(n)[r]


def right_vectors(a: np.ndarray, b: np.ndarray, most: int, close: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest squared singular values of a bidiagonal, falling, and its right singular vectors as columns.

    Vectors of values that lie within `close` of each other, relatively, are made orthogonal within
    their block and turned to the values that the matrix has on them.
    """
    values, where, vectors = [], [], []
    for first, last in _blocks(a, b):
        aa, bb = a[first:last], b[first : last - 1]
        if (aa == 0).any():  # a zero on the diagonal: lift it to where no digit of the others feels it
            aa = np.where(aa == 0, EPS * EPS * max(np.abs(a).max(), np.finfo(float).tiny), aa)
        found = squared_singular_values(aa, bb)
        z = np.column_stack([_twisted(aa, bb, v) for v in found])
        at = 0
        full = np.diag(aa) + np.diag(bb, 1)
        while at < len(found):
            to = at + 1
            while to < len(found) and found[to - 1] - found[to] <= close * found[to - 1]:
                to += 1
            if to - at > 1:
                basis = np.linalg.qr(z[:, at:to])[0]
                for _ in range(2):  # once more against what rounding left in them
                    turned, size, back = np.linalg.svd(full @ basis, full_matrices=False)
                    basis = np.linalg.qr(basis @ back.T)[0]
                z[:, at:to] = basis
            at = to
        for k, v in enumerate(found):
            values.append(v), where.append((first, last)), vectors.append(z[:, k])
    order = sorted(range(len(values)), key=lambda i: -values[i])[:most]
    out = np.zeros((len(a), len(order)))
    for j, i in enumerate(order):
        out[where[i][0] : where[i][1], j] = vectors[i]
    return np.array([values[i] for i in order]), out
