"""Empirical mode decomposition kernel (NumPy), for many signals of one length at once.

Extrema, natural cubic-spline envelopes and sifting work on [signals, points]
arrays; the only loops are over the steps of the cyclic reduction (all signals
side by side) and over sifting rounds.
"""

from __future__ import annotations

import numpy as np

MAX_SIFT = 50  # the SD rule ends sifting long before
SD_STOP = 0.2
HEAP_BYTES = 31 << 20  # glibc learns thresholds from arrays of up to 32 MB


def keep_heap() -> None:
    """Makes and drops one large array, untouched.  From then on glibc keeps freed memory of up to about that size for
    the next arrays; else each of sifting's many short-lived arrays starts on new pages, which costs more than its sums."""
    np.empty(HEAP_BYTES, np.uint8)


def turning_points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the maxima and minima of each row; a plateau counts once, at its end."""
    maxima, minima = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    if x.shape[1] < 3:
        return maxima, minima
    left, right = x[:, :-1], x[:, 1:]
    up = right > left
    flat = right == left
    if flat.any():  # flat steps keep the direction before them; the end of a flat beginning counts too
        last = np.maximum.accumulate(np.where(flat, -1, np.arange(up.shape[1])), axis=1)
        up = np.take_along_axis(up, np.maximum(last, 0), axis=1)
        new = (last[:, :-1] < 0) & (last[:, 1:] >= 0)
        known = last[:, :-1] >= 0
        maxima[:, 1:-1] = ~up[:, 1:] & (up[:, :-1] & known | new)
        minima[:, 1:-1] = up[:, 1:] & (~up[:, :-1] & known | new)
    else:
        np.greater(up[:, :-1], up[:, 1:], out=maxima[:, 1:-1])
        np.less(up[:, :-1], up[:, 1:], out=minima[:, 1:-1])
    return maxima, minima


def n_extrema(x: np.ndarray) -> int:
    """Number of extrema of one signal."""
    maxima, minima = turning_points(np.atleast_2d(x))
    return int(maxima.sum() + minima.sum())


def solve_dominant(low: np.ndarray, diagonal: np.ndarray, high: np.ndarray, right: np.ndarray, far: int = 1) -> np.ndarray:
    """System whose unknowns are coupled to those ``far`` places before and after (1: tridiagonal) and whose
    diagonal is at least twice these couplings' sum, by parallel cyclic reduction: every step couples unknowns
    twice as far apart and squares the couplings, which vanish after a few steps."""
    n = len(right)
    r, a, c = right / diagonal, low / -diagonal, high / -diagonal
    u, v, d, next_a, next_c = (np.empty(n) for _ in range(5))
    most = 1.0
    while far < n:
        np.multiply(a[far:], r[:-far], out=u[far:])
        np.multiply(c[:-far], r[far:], out=v[far:])
        r[far:] += u[far:]
        r[:-far] += v[far:]
        if most < 1e-9:  # the divisors are 1, the next couplings below 1e-18
            break
        np.multiply(a[far:], c[:-far], out=u[far:])
        d[:far] = 1.0
        np.subtract(1.0, u[far:], out=d[far:])
        d[:-far] -= u[far:]
        r /= d
        next_a[:far] = next_c[n - far:] = 0.0
        np.multiply(a[far:], a[:-far], out=next_a[far:])
        np.multiply(c[:-far], c[far:], out=next_c[:-far])
        a, next_a = np.divide(next_a, d, out=next_a), a
        c, next_c = np.divide(next_c, d, out=next_c), c
        far *= 2
        most = max(a.max(), c.max())
        if most < 1e-18:
            break
    return r


def envelopes(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Natural cubic spline of each row through its marked points (at least one);
    both end points take the value of the nearest mark.

    The tridiagonal systems of all rows are one flat system; the cubic of each
    interval is laid out over its points by its run length."""
    m, n = x.shape
    rows = np.arange(m)
    first, last = marks.argmax(1), n - 1 - marks[:, ::-1].argmax(1)
    knots = marks.copy()
    knots[:, 0] = knots[:, -1] = True
    at = np.flatnonzero(knots)  # row * n + position
    yk = x.ravel()[at]
    count = knots.sum(1)
    stop = np.cumsum(count)
    start = stop - count
    yk[start], yk[stop - 1] = x[rows, first], x[rows, last]
    # interval k of a row runs from its knot k to knot k + 1; the last knot begins none
    h = np.empty(len(at))
    h[:-1] = np.diff(at)
    h[stop - 1] = 1.0
    slope = np.zeros(len(at))
    slope[:-1] = np.diff(yk) / h[:-1]
    bend = np.zeros(len(at))  # second derivatives; zero at both ends
    is_inner = np.ones(len(at), bool)
    is_inner[start] = is_inner[stop - 1] = False
    k = np.flatnonzero(is_inner)
    if len(k):
        # rows follow each other as one system: an end has no coupling to its neighbour
        low, high = h[k - 1] * is_inner[k - 1], h[k] * is_inner[k + 1]
        bend[k] = solve_dominant(low, 2 * (h[k - 1] + h[k]), high, 6 * (slope[k] - slope[k - 1]))
    # y + t (b + t (c + t d)) with t from the interval's own beginning
    following = np.append(bend[1:], 0.0)
    c, d = bend / 2, (following - bend) / (6 * h)
    b = slope - h * (2 * bend + following) / 6
    length = h.astype(np.int64)
    length[stop - 1] = 1  # the end point itself: t = 0 gives its value
    out = np.repeat(d, length)
    t = np.arange(m * n, dtype=float)
    t -= np.repeat(at.astype(float), length)
    for part in (c, b, yk):
        out *= t
        out += np.repeat(part, length)
    return out.reshape(m, n)


def mean_envelope(x: np.ndarray, found: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean of the upper and lower ``envelopes`` of each row, to the last bit; ``found``: the flat places of all its
    extrema, ``count`` of them a row, four at least.

    Maxima and minima take turns, so both splines are one system in which knots are coupled to the second next, and a
    point lies in the pieces of the last two knots.  A row begins with one more knot for each spline."""
    m, n = x.shape
    stop = np.cumsum(count + 2)
    start, k = stop - count - 2, stop[-1]
    first, last = np.concatenate([start, start + 1]), np.concatenate([stop - 2, stop - 1])
    place = np.arange(len(found)) + np.repeat(np.arange(2, 2 * m + 1, 2), count)
    at, y = np.empty(k + 2), np.empty(k + 2)
    at[place], y[place] = found, x.ravel()[found]
    at[first], y[first] = np.tile(np.arange(m) * float(n), 2), y[first + 2]
    at[k:], y[k:] = m * n, 0.0
    h = at[2:] - at[:-2]
    h[last] -= 1.0  # up to the end point, which takes the value of the last knot
    slope = (y[2:] - y[:-2]) / h
    slope[last] = 0.0
    low, diagonal, high, right = np.empty(k), np.empty(k), h.copy(), np.empty(k)
    low[2:] = h[:-2]
    np.add(h[2:], h[:-2], out=diagonal[2:])
    diagonal *= 2.0
    np.subtract(slope[2:], slope[:-2], out=right[2:])
    right *= 6.0
    low[first], diagonal[first], high[first], right[first] = 0.0, 1.0, 0.0, 0.0
    low[first + 2] = high[last] = 0.0
    bend = solve_dominant(low, diagonal, high, right, 2)  # second derivatives; zero at both ends
    following = np.empty(k)
    following[:-2] = bend[2:]
    following[last] = 0.0
    # y + t (b + t (c + t d)) with t from the knot
    d = following - bend
    d /= 6 * h
    following += 2 * bend
    following *= h
    following /= 6
    b, c = np.subtract(slope, following, out=following), np.multiply(bend, 0.5, out=bend)
    if 8 * k > m * n:  # short pieces: by the number of each point's piece
        piece = np.zeros(m * n, np.intp)
        piece[found] = 1
        piece[::n] = 2
        piece[0] = 0
        np.cumsum(piece, out=piece)

        def spread(v):
            return v[piece]
    else:
        size = np.diff(at[1:k + 1]).astype(np.intp)

        def spread(v):
            return np.repeat(v, size)
    place = np.arange(m * n, dtype=float)
    both = []
    for of in (slice(1, k), slice(0, k - 1)):  # pieces of the last knot and of the one before
        t = np.subtract(place, spread(at[of]))
        out = spread(d[of])
        for part in (c, b, y):
            out *= t
            out += spread(part[of])
        both.append(out)
        out[n - 1::n] = y[stop - 1 if of.start else stop - 2]
    mean = both[0]
    mean += both[1]
    mean *= 0.5
    return mean.reshape(m, n)


def first_modes(x: np.ndarray, max_sift: int = MAX_SIFT) -> np.ndarray:
    """First intrinsic mode of every row by sifting (Cauchy-type SD stop)."""
    h = np.array(x, dtype=float)
    now, going, n = h, np.arange(len(h)), h.shape[1]
    for _ in range(max_sift):
        maxima, minima = turning_points(now)
        maxima |= minima
        count = np.diff(np.searchsorted(found := np.flatnonzero(maxima), np.arange(len(now) + 1) * n))
        enough = count >= 4  # two maxima and two minima, as they take turns
        if not enough.all():
            now, going, count = now[enough], going[enough], count[enough]
            found = np.flatnonzero(maxima[enough])
        if not len(going):
            break
        mean = mean_envelope(now, found, count)
        change = np.einsum("ij,ij->i", mean, mean) / np.maximum(np.einsum("ij,ij->i", now, now), 1e-300)
        now = np.subtract(now, mean, out=mean)
        h[going] = now
        on = change >= SD_STOP
        now, going = now[on], going[on]
    return h


def emd_all(x: np.ndarray, max_modes: int | None = None) -> list[np.ndarray]:
    """Plain EMD of every row: one [rows, points] array per mode; a row whose
    residue has fewer than 3 extrema is done, its later modes are zero."""
    modes, rest = [], np.array(x, dtype=float)
    alive = np.ones(len(rest), bool)
    while max_modes is None or len(modes) < max_modes:
        maxima, minima = turning_points(rest)
        alive &= maxima.sum(1) + minima.sum(1) >= 3
        if not alive.any():
            break
        mode = np.zeros_like(rest)
        mode[alive] = first_modes(rest[alive])
        alive &= np.abs(mode).max(1) > 0
        modes.append(mode)
        rest = rest - mode
    return modes
