"""Singular values and right singular vectors of a small triangular matrix.

Householder reflections reduce it to an upper bidiagonal B, dqds finds the squares of B's
singular values, and one twisted factorisation of B'B - value gives each vector.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
TINY = 1e-290
#: Values closer than this share of themselves are one cluster; the vectors of others are
#: orthogonal by their gaps.
CLUSTER = 1e-3


def _reflector(x: np.ndarray) -> np.ndarray:
    """Unit w with (I - 2ww')x along the first axis (zeros where x already lies there)."""
    w = x.copy()
    w[0] += math.copysign(np.linalg.norm(x), x[0])
    length = np.linalg.norm(w)
    return w / length if length > 0 else w


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V'."""
    a, n = np.array(r, float), len(r)
    v = np.eye(n)
    for k in range(n):
        w = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < n - 2:
            w = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return a.diagonal().copy(), a.diagonal(1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int, float]:
    """One dqds transform; also where it failed first (len(q): nowhere) and the last d."""
    n = len(q)
    new_q, new_e, d = [], [], q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return new_q, new_e, i, d
        top = d + e[i]
        ratio = q[i + 1] / top if top > 0 else 0.0
        new_q.append(top)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    new_q.append(d)
    return new_q, new_e, n - 1 if d < 0 else n, d


def _low_pair(q: list[float], e: list[float]) -> float:
    """Smaller eigenvalue of the last two rows and columns of B'B."""
    a, c, b2 = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    high = (a + c + math.hypot(a - c, 2 * math.sqrt(b2))) / 2
    return (a * c - b2) / high if high > 0 else 0.0


def dqds(diagonal, above) -> list[float]:
    """Squares of the singular values of an upper bidiagonal matrix, in falling order."""
    found: list[float] = []
    todo = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    rounds = 0
    while todo:
        q, e, base = todo.pop()
        if not q:
            continue
        if len(q) == 1:
            found.append(q[0] + base)
            continue
        cut = next((i for i in range(len(e) - 1, -1, -1)
                    if e[i] <= EPS ** 2 * (base + min(q[i], q[i + 1])) or e[i] < TINY), None)
        if cut is not None:
            todo += [(q[:cut + 1], e[:cut], base), (q[cut + 1:], e[cut + 1:], base)]
            continue
        if q[0] < q[-1]:
            q, e = q[::-1], e[::-1]
        shift = max(0.0, _low_pair(q, e)) if rounds % 3 else 0.0
        for attempt in range(5):
            new_q, new_e, at, d = _step(q, e, shift)
            if at == len(q):
                break
            # a failure in the last place alone gives a close bound from below
            shift = max(0.0, (shift + d) * (1 - 4 * EPS)) if at == len(q) - 1 and attempt < 2 else shift / 4 if attempt < 3 else 0.0
        rounds += 1
        if rounds > 400 * len(diagonal) + 400:
            raise ArithmeticError("dqds did not converge")
        todo.append((new_q, new_e, base + shift))
    return sorted(found, reverse=True)


class _Factors:
    """The symmetric tridiagonal matrix L D L' with L's subdiagonal ``low``."""

    def __init__(self, d: np.ndarray, low: np.ndarray):
        self.d, self.low = d, low
        self.least = EPS ** 2 * float(np.abs(d).max())

    def _pivot(self, x: float) -> float:
        return x if abs(x) > self.least else math.copysign(self.least, x)

    def below(self, x: float) -> int:
        """How many eigenvalues lie below x."""
        count, s, last = 0, -x, len(self.d) - 1
        for i, d in enumerate(self.d):
            top = self._pivot(d + s)
            count += top < 0
            if i < last:
                s = d * self.low[i] ** 2 / top * s - x
        return count

    def value(self, rank: int, near: float, width: float) -> float:
        """The eigenvalue with ``rank`` others below it, found by bisection around ``near``."""
        low, high = near - width, near + width
        while self.below(low) > rank:
            low -= (width := 2 * width)
        while self.below(high) <= rank:
            high += (width := 2 * width)
        for _ in range(200):
            middle = (low + high) / 2
            if high - low <= 2 * EPS * max(abs(low), abs(high)) or not low < middle < high:
                break
            low, high = (middle, high) if self.below(middle) <= rank else (low, middle)
        return (low + high) / 2

    def shifted(self, x: float) -> _Factors:
        """Factors of the matrix less x."""
        n = len(self.d)
        d, low, s = np.empty(n), np.empty(n - 1), -x
        for i in range(n):
            d[i] = self._pivot(self.d[i] + s)
            if i < n - 1:
                low[i] = self.d[i] * self.low[i] / d[i]
                s = low[i] * self.low[i] * s - x
        return _Factors(d, low)

    def vector(self, value: float) -> np.ndarray:
        """Unit eigenvector, from the factorisation of the matrix less its value that is
        twisted where the middle pivot is smallest."""
        n = len(self.d)
        up, down, s, p = np.zeros(n), np.zeros(n), np.empty(n), np.empty(n)
        s[0], p[n - 1] = -value, self.d[n - 1] - value
        for i in range(n - 1):
            up[i] = self.d[i] * self.low[i] / self._pivot(self.d[i] + s[i])
            s[i + 1] = up[i] * self.low[i] * s[i] - value
        for i in range(n - 2, -1, -1):
            ratio = self.d[i] / self._pivot(self.d[i] * self.low[i] ** 2 + p[i + 1])
            down[i] = self.low[i] * ratio
            p[i] = p[i + 1] * ratio - value
        k = int(np.argmin(np.abs(s + p + value)))
        z = np.zeros(n)
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -up[i] * z[i + 1]
        for i in range(k + 1, n):
            z[i] = -down[i - 1] * z[i - 1]
        z /= np.abs(z).max()
        return z / np.linalg.norm(z)


def _fill(factors: _Factors, values: list[float], rank: int, out: np.ndarray, depth: int = 0) -> None:
    """Columns of ``out``: vectors of the falling ``values``, the last of which has ``rank``
    eigenvalues below it.  Those of a cluster come from factors shifted to the cluster's
    end, where its values lie far apart for their size."""
    start, n = 0, len(values)
    for j in range(n):
        if j + 1 < n and values[j] - values[j + 1] <= CLUSTER * max(abs(values[j]), abs(values[j + 1])) and depth < 12:
            continue
        if start == j:
            out[:, j] = factors.vector(values[j])
        else:
            # of the cluster's two ends, the one whose factors grow less
            ends = (values[j] - 8 * EPS * abs(values[j]), values[start] + 8 * EPS * abs(values[start]))
            shift, inner = min(((x, factors.shifted(x)) for x in ends), key=lambda f: np.abs(f[1].d).max())
            lowest = rank + n - 1 - j
            own = [inner.value(lowest + j - i, values[i] - shift, 8 * EPS * abs(values[j])) for i in range(start, j + 1)]
            _fill(inner, own, lowest, out[:, start:j + 1], depth + 1)
        start = j + 1


def _vectors(diagonal: np.ndarray, above: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit right singular vectors (columns) of an unreduced bidiagonal, by falling value."""
    out = np.empty((len(values), len(values)))
    _fill(_Factors(diagonal ** 2, above / diagonal[:-1]), values, 0, out)
    return out


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a square matrix in falling order, and its right singular
    vectors as columns."""
    n = len(r)
    scale = float(np.abs(r).max()) if n else 0.0
    if scale == 0:
        return np.zeros(n), np.eye(n)
    diagonal, above, v = bidiagonalise(np.asarray(r, float) / scale)
    norm = max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))
    # what lies under the rounding of the reduction itself: a zero pivot becomes the least
    # one that counts, a zero above splits the matrix
    small = np.abs(diagonal) < 4 * EPS * norm
    diagonal[small] = 4 * EPS * norm
    split = np.abs(above) <= 4 * EPS * norm
    bounds = [0, *(np.flatnonzero(split) + 1), n]
    values, vectors = np.empty(n), np.zeros((n, n))
    for a, b in zip(bounds, bounds[1:]):
        own = dqds(diagonal[a:b], above[a:b - 1])
        values[a:b] = own
        vectors[a:b, a:b] = _vectors(diagonal[a:b], above[a:b - 1], own)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale ** 2, v @ vectors[:, order]
