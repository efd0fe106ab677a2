"""Limited-memory BFGS over a function whose value and gradient come from a
pass over distributed rows: the steps, line search and end of Spark ML's
optimizer (Breeze), so that models come out as its own. Only weights and
gradients, a few thousand numbers, are here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Fn = Callable[[np.ndarray], tuple[float, np.ndarray]]


class SearchFailed(Exception):
    """No step along the direction lessens the value enough."""


def _direction(grad: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the approximate inverse Hessian (newest step first) times ``grad``."""
    scale = 1.0
    if history:
        step, change = history[0]
        if not step @ change >= 0:
            raise SearchFailed("the history has no curvature")
        scale = (step @ change) / (change @ change)
    d, taken = grad.copy(), []
    for step, change in history:
        rho = step @ change
        a = (step @ d) / rho
        if np.isnan(a):
            raise SearchFailed("the history isn't finite")
        d -= a * change
        taken.append((a, rho))
    d *= scale
    for (step, change), (a, rho) in zip(reversed(history), reversed(taken)):
        d += (a - (change @ d) / rho) * step
    return -d


def _between(left: tuple, right: tuple) -> float:
    """Minimum of the cubic through two points (t, value, slope), not too near to either."""
    (lt, lv, ls), (rt, rv, rs) = left, right
    d1 = ls + rs - 3 * (lv - rv) / (lt - rt)
    d2 = np.sqrt(d1 * d1 - ls * rs)
    t = rt - (rt - lt) * (rs + d2 - d1) / (rs - ls + 2 * d2)
    low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return low if t < low else high if t > high else t


def _step(phi: Callable[[float], tuple], start: tuple, t: float, tries: int = 10, c1: float = 1e-4, c2: float = 0.9) -> float:
    """A step length that meets the strong Wolfe conditions."""
    _, value, slope = start
    if slope > 0:
        raise SearchFailed("the direction leads upwards")

    def zoom(low: tuple, high: tuple) -> float:
        for _ in range(tries):
            c = phi(_between(high, low) if low[0] > high[0] else _between(low, high))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= c2 * abs(slope):
                return c[0]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed("no step in the bracket")

    low = start
    for i in range(tries):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return c[0]
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    raise SearchFailed("no bracket")


def _backtrack(phi: Callable[[float], tuple], start: tuple, t: float, shrink: float, grow: float = 2.1, tries: int = 20, c1: float = 1e-4,
               c2: float = 0.9) -> float:
    """A step length that meets the strong Wolfe conditions, found by shrinking
    and growing it only. As Breeze judges the first length by the value at the
    start, it is shrunk unseen (but for rounding)."""
    _, value, slope = start
    c = (t, value, -np.inf if value > value + c1 * t * slope else phi(t)[2])
    for i in range(tries + 1):
        factor = shrink if c[1] > value + c1 * c[0] * slope else grow if c[2] < c2 * slope else shrink if c[2] > -c2 * slope else 1.0
        if factor == 1.0:
            return c[0]
        t *= factor
        if i == tries or t < 1e-10 or t > 1e10:
            break
        c = phi(t)
    raise SearchFailed("no step by shrinking and growing")


def lbfgs(f: Fn, x: np.ndarray, max_iter: int, tol: float = 1e-6, memory: int = 10, values: int = 20, orthants: bool = False) -> np.ndarray:
    """Weights after ``max_iter`` steps, or when the value has changed by less
    than ``tol`` of the first over ``values`` steps, or the gradient has
    vanished, or two searches in turn have failed. With ``orthants`` as OWL-QN
    without an L1 term, which Spark ML's linear SVM uses: a step ends where a
    weight would change its sign, and its length is only shrunk or grown."""
    with np.errstate(all="ignore"):
        v, g = f(x)
        first, seen, history, step, failed = v, [np.inf], [], 0, False
        while step < max_iter:
            if len(seen) >= 2 and abs(v - max(seen)) <= tol * abs(first) or np.linalg.norm(g) <= max(tol * abs(v), 1e-8):
                break
            last, side = {}, np.sign(np.where(x != 0, x, -g))

            def phi(t: float) -> tuple:
                at = x + d * t
                if orthants:
                    at *= np.sign(at) == side
                last["x"], (last["v"], last["g"]) = at, f(at)
                return t, last["v"], last["g"] @ d

            try:
                d = _direction(g, history)
                if orthants:
                    d = np.where(d * g < 0, d, 0.0)
                    _backtrack(phi, (0.0, v, g @ d), 0.5 / np.linalg.norm(g) if step == 0 else 1.0, 0.1 if step == 0 else 0.5)
                elif _step(phi, (0.0, v, g @ d), 1.0 / np.linalg.norm(d) if step == 0 else 1.0) * np.linalg.norm(g) < 1e-10:
                    raise SearchFailed("the step is too small")
            except SearchFailed:
                if failed:
                    break
                failed, history = True, []
                continue
            # a search that ends on an earlier point than its last one doesn't occur: the point it returns was looked at last
            history = [(last["x"] - x, last["g"] - g), *history][:memory]
            x, v, g = last["x"], last["v"], last["g"]
            seen, step, failed = [*seen, v][-values:], step + 1, False
    return x
