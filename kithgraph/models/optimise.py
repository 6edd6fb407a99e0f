"""Driver-side optimisers over a flat vector. f(x) gives (loss, gradient); each call is one distributed aggregate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import count

import numpy as np

Function = Callable[[np.ndarray], tuple[float, np.ndarray]]


def line_search(f: Function, x: np.ndarray, loss: float, g: np.ndarray, way: np.ndarray, step: float = 1.0):
    """Armijo backtracking, then growth while the slope is still steep (weak Wolfe). None where no step lessens the loss."""
    slope, low, high = float(g @ way), 0.0, np.inf
    for _ in range(30):
        new, new_g = f(x + step * way)
        if not np.isfinite(new) or new > loss + 1e-4 * step * slope:
            high = step
        elif float(new_g @ way) < 0.9 * slope:
            low = step
            if np.isinf(high):
                step *= 2
                continue
        else:
            return step, new, new_g
        step = (low + high) / 2
    new, new_g = f(x + low * way)
    return (low, new, new_g) if low and new < loss else None


@dataclass(frozen=True)
class Point:
    """A step with the value and the slope there."""

    at: float
    value: float
    slope: float


def _cubic(a: Point, b: Point) -> float:
    """The minimiser of the cubic through both values and slopes (at infinity: none between)."""
    theta = 3 * (a.value - b.value) / (b.at - a.at) + a.slope + b.slope
    square = theta * theta - a.slope * b.slope
    if square < 0:
        return np.inf
    gamma = np.copysign(np.sqrt(square), b.at - a.at)
    below = b.slope - a.slope + 2 * gamma
    return b.at - (b.at - a.at) * (b.slope + gamma - theta) / below if below else np.inf


def _quadratic(a: Point, b: Point) -> float:
    """By both values and the slope of a."""
    return a.at + (b.at - a.at) * a.slope / (2 * ((a.value - b.value) / (b.at - a.at) + a.slope))


def _secant(a: Point, b: Point) -> float:
    """By both slopes."""
    return b.at + (a.at - b.at) * b.slope / (b.slope - a.slope)


def more_thuente(phi: Callable[[float], tuple[float, float]], value: float, slope: float, step: float = 1.0, decrease: float = 1e-4, curvature: float = 0.9, longest: float = 1e10, narrow: float = 1e-12, most: int = 40) -> float | None:
    """A step with sufficient decrease and a slope of at most `curvature` times the first (both strong Wolfe conditions).

    phi(step) gives value and slope; value and slope are those at 0. An interval that holds such a step is narrowed by trial
    steps from cubic, quadratic and secant models; until a step with sufficient decrease and a slope above 0 is seen, the
    models are of the function less its line of sufficient decrease. Returns None where no step is less than the start.
    """
    line = decrease * slope
    best = Point(0.0, value, slope)
    other: Point | None = None
    first, width, before, low, high = True, longest, 2 * longest, 0.0, 5 * step
    for _ in range(most):
        got = phi(step)
        now = Point(step, *got) if np.isfinite(got[0]) and np.isfinite(got[1]) else Point(step, np.inf, 0.0)
        if now.value <= value + step * line and abs(now.slope) <= -curvature * slope:
            return step
        if not np.isfinite(now.value):  # outside of the function's domain: halve towards the best
            other, high = now, step
            step = (best.at + step) / 2
            continue
        if first and now.value <= value + step * line and now.slope >= 0:
            first = False
        # the models' values: less the line in the first stage
        less = line if first and now.value <= best.value and now.value > value + step * line else 0.0
        shift = lambda p: p and Point(p.at, p.value - less * p.at, p.slope - less)  # noqa: E731, B023
        x, y, t = shift(best), shift(other), shift(now)
        bracketed = other is not None
        if t.value > x.value:
            c, q = _cubic(x, t), _quadratic(x, t)
            trial = c if abs(c - x.at) < abs(q - x.at) else q if not np.isfinite(c) else (c + q) / 2
            other, bracketed = now, True
        elif t.slope * x.slope < 0:
            c, q = _cubic(x, t), _secant(x, t)
            trial = c if np.isfinite(c) and abs(c - t.at) >= abs(q - t.at) else q
            best, other, bracketed = now, best, True
        elif abs(t.slope) < abs(x.slope):
            c, q = _cubic(x, t), _secant(x, t)
            # the cubic counts where it falls beyond the trial step
            if not np.isfinite(c) or (c - t.at) * (t.at - x.at) <= 0:
                c = high if t.at > x.at else low
            if bracketed:
                trial = c if abs(c - t.at) < abs(q - t.at) else q
                edge = t.at + 0.66 * (y.at - t.at)
                trial = min(edge, trial) if t.at > x.at else max(edge, trial)
            else:
                trial = min(max(c if abs(c - t.at) > abs(q - t.at) else q, low), high)
            best = now
        else:
            trial = _cubic(y, t) if bracketed and np.isfinite(y.value) else high if t.at > x.at else low
            best = now
        if bracketed:
            low, high = sorted((best.at, other.at))
            if abs(other.at - best.at) >= 0.66 * before:
                trial = (best.at + other.at) / 2
            before, width = width, abs(other.at - best.at)
            if not low < trial < high:
                trial = (low + high) / 2
            if high - low <= narrow * high:
                break
        else:
            low, high = now.at + 1.1 * (now.at - (0.0 if best.at == now.at and now.at == step else best.at)), now.at + 4 * now.at
            trial = min(max(trial, low), high)
        step = min(trial, longest)
    return best.at if best.value < value else None


def strong_search(f: Function, x: np.ndarray, loss: float, g: np.ndarray, way: np.ndarray, step: float = 1.0):
    """line_search by more_thuente."""
    seen: dict[float, tuple[float, np.ndarray]] = {}

    def phi(a: float) -> tuple[float, float]:
        seen[a] = f(x + a * way)
        return seen[a][0], float(seen[a][1] @ way)

    at = more_thuente(phi, loss, float(g @ way), step)
    return None if at is None else (at, *seen[at])


def lbfgs(f: Function, x: np.ndarray, memory: int = 5, tolerance: float = 1e-2, steps: int | None = 200, search: str = "weak") -> tuple[np.ndarray, list[float]]:
    """The minimiser and the losses, one a step. Stops when the gradient or the change of the loss is below the tolerance, and after `steps` unless that is None.

    search: 'weak' (bisection, weak Wolfe) or 'strong' (more_thuente).
    """
    loss, g = f(x)
    trace, pairs = [loss], []
    for _ in count() if steps is None else range(steps):
        if np.linalg.norm(g) < tolerance:
            break
        way, used = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ way) / (y @ s)
            way -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            way += (a - (y @ way) / (y @ s)) * s
        way = -way
        if g @ way >= 0:
            way, pairs = -g, []
        found = (line_search if search == "weak" else strong_search)(f, x, loss, g, way, 1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12)))
        if found is None:
            break
        step, new, new_g = found
        s, y = step * way, new_g - g
        if y @ s > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        change = loss - new
        if change > 0:
            x, g, loss = x + s, new_g, new
            trace.append(loss)
        if change < tolerance:
            break
    return x, trace


def momentum(f: Function, x: np.ndarray, step: float = 1e-4, keep: float = 0.8, steps: int = 100, tolerance: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """Gradient descent whose step grows by 1.25 when the loss falls and halves (the move taken back) when it rises."""
    loss, g = f(x)
    trace, move = [loss], np.zeros_like(x)
    for _ in range(steps):
        move = keep * move - step * g
        new, new_g = f(x + move)
        if new < loss:
            x, g, step, change = x + move, new_g, step * 1.25, loss - new
            loss = new
            trace.append(loss)
            if change < tolerance:
                break
        else:
            step, move = step / 2, np.zeros_like(x)
            if step < 1e-14:
                break
    return x, trace
