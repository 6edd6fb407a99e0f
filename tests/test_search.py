"""The line search on the test functions published with the method, from steps far too short and far too long."""

import numpy as np
import pytest

from kithgraph.models.optimise import lbfgs, more_thuente


def first(a, beta=2.0):
    return -a / (a * a + beta), (a * a - beta) / (a * a + beta) ** 2


def second(a, beta=0.004):
    return (a + beta) ** 5 - 2 * (a + beta) ** 4, 5 * (a + beta) ** 4 - 8 * (a + beta) ** 3


def third(a, beta=0.01, waves=39):
    p, d = (1 - a, -1.0) if a <= 1 - beta else (a - 1, 1.0) if a >= 1 + beta else ((a - 1) ** 2 / (2 * beta) + beta / 2, (a - 1) / beta)
    w = waves * np.pi / 2
    return p + 2 * (1 - beta) / (waves * np.pi) * np.sin(w * a), d + (1 - beta) * np.cos(w * a)


def yanai(b1, b2):
    g = lambda b: np.sqrt(1 + b * b) - b

    def f(a):
        x, y = np.sqrt((1 - a) ** 2 + b2 * b2), np.sqrt(a * a + b1 * b1)
        return g(b1) * x + g(b2) * y, g(b1) * (a - 1) / x + g(b2) * a / y

    return f


CASES = [(first, 1e-3, 1e-1), (second, 1e-1, 1e-1), (third, 1e-1, 1e-1), (yanai(0.001, 0.001), 1e-3, 1e-3), (yanai(0.01, 0.001), 1e-3, 1e-3), (yanai(0.001, 0.01), 1e-3, 1e-3)]


@pytest.mark.parametrize("start", [1e-3, 1e-1, 1e1, 1e3])
@pytest.mark.parametrize("case", range(6))
def test_published(case, start):
    f, mu, eta = CASES[case]
    calls = []

    def phi(a):
        calls.append(a)
        return f(a)

    v, d = f(0.0)
    a = more_thuente(phi, v, d, start, mu, eta)
    w, e = f(a)
    assert w <= v + mu * a * d and abs(e) <= eta * abs(d) and len(calls) <= 40, (case, start, a, len(calls))


def test_no_descent():
    assert more_thuente(lambda a: (a, 1.0), 0.0, -1.0, most=30) is None


def test_outside_domain():
    a = more_thuente(lambda a: (-np.log(1 - a) - 3 * a, 1 / (1 - a) - 3) if a < 1 else (np.nan, np.nan), 0.0, -2.0, 5.0, 1e-4, 0.1)
    assert abs(a - 2 / 3) < 0.1


@pytest.mark.parametrize("search", ["weak", "strong"])
def test_rosenbrock(search):
    def f(x):
        return float((100 * (x[1:] - x[:-1] ** 2) ** 2 + (1 - x[:-1]) ** 2).sum()), np.array([-400 * x[0] * (x[1] - x[0] ** 2) - 2 * (1 - x[0]), 200 * (x[1] - x[0] ** 2)])

    x, trace = lbfgs(f, np.array([-1.2, 1.0]), tolerance=1e-12, search=search)
    assert np.allclose(x, 1, atol=1e-4) and all(b < a for a, b in zip(trace, trace[1:], strict=False))
