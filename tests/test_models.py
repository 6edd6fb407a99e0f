import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.models import classifiers, factors, ratings, registry
from kithgraph.models.optimise import lbfgs, momentum


def test_optimisers():
    f = lambda x: (float(x[0] ** 4 - 3 * x[0] ** 3 + 2), np.array([4 * x[0] ** 3 - 9 * x[0] ** 2]))
    x, trace = lbfgs(f, np.array([6.0]), tolerance=1e-9)
    assert x[0] == pytest.approx(2.25, abs=1e-3) and all(a > b for a, b in zip(trace, trace[1:], strict=False))
    x, trace = momentum(f, np.array([6.0]), step=1e-3, steps=500, tolerance=1e-12)
    assert x[0] == pytest.approx(2.25, abs=1e-2)


def test_gram():
    s = np.random.default_rng(0).normal(size=(6, 3))
    naive = 0.5 * sum((s[i] @ s[j]) ** 2 for i in range(6) for j in range(i + 1, 6))
    loss, g = factors.Social.gram(s)
    assert loss == pytest.approx(naive)
    e = np.zeros_like(s)
    e[2, 1] = 1e-6
    assert (factors.Social.gram(s + e)[0] - loss) / 1e-6 == pytest.approx(g[2, 1], rel=1e-3)


@pytest.mark.parametrize("kind", ["Squared", "Logistic", "Hybrid", "LogisticHybrid", "Social", "Spectral", "Copreference", "SpectralCopreference"])
def test_gradients(kind):
    rng = np.random.default_rng(1)
    s, t, w = rng.normal(size=(4, 2)), rng.normal(size=(3, 2)), rng.normal(size=5)
    u, v, i = rng.integers(0, 4, 6), rng.integers(0, 4, 6), rng.integers(0, 3, 6)
    x = rng.random(6)
    at = np.array([np.array([0, 3]), np.array([1]), np.array([2, 4]), np.array([0]), np.array([1]), np.array([2])], dtype=object)
    value = np.array([np.ones(len(a)) for a in at], dtype=object)
    columns = {"Squared": [u, i, x], "Logistic": [u, i, x], "Hybrid": [u, i, x, at, value], "LogisticHybrid": [u, i, x, at, value], "Social": [u, v, x], "Spectral": [u, v, x]}.get(kind, [i, u, v, x])
    term = object.__new__(getattr(factors, kind))
    _, *grads = term.block(columns, s, t, w)
    for k, (p, g) in enumerate(zip((s, t, w), grads, strict=True)):
        for place in np.ndindex(p.shape):
            def at_shift(h, k=k, p=p, place=place):
                q = [s.copy(), t.copy(), w.copy()]
                q[k][place] += h
                return term.block(columns, *q)[0]

            assert (at_shift(1e-5) - at_shift(-1e-5)) / 2e-5 == pytest.approx(g[place], rel=1e-4, abs=1e-6)


def small(spark):
    u, i, r = ratings.synthetic(30, 12, rank=3, per_user=8)
    samples = spark.createDataFrame([(int(a), int(b), float(c > 3)) for a, b, c in zip(u, i, r, strict=True)], "user_id long, item_id long, label double")
    users = spark.createDataFrame([(k, [1.0, k % 2.0]) for k in range(30)], "user_id long, x array<double>")
    items = spark.createDataFrame([(k, [1.0, k % 3.0]) for k in range(12)], "item_id long, y array<double>")
    return samples, users, items


@pytest.mark.parametrize("kind", ["feature", "social", "spectral", "copreference"])
def test_matrix_models(spark, kind):
    samples, users, items = small(spark)
    ties = spark.createDataFrame([(a, a + 1, 1.0) for a in range(29)], "a long, b long, tie double")
    m = registry.make(registry.Config(kind=kind, ridge=0.5, k=2), users=users, items=items, ties=ties, steps=6).fit(samples)
    assert len(m.model.trace) > 2 and all(a > b for a, b in zip(m.model.trace, m.model.trace[1:], strict=False))
    assert m.top_k(samples.select("user_id", "item_id"), 3).groupBy("user_id").count().agg(F.max("count")).first()[0] <= 3


def test_unknown_model():
    with pytest.raises(ValueError):
        registry.make(registry.Config(kind="nothing"))


def test_descend(spark):
    samples, _, _ = small(spark)
    s, t = factors.descend(samples, k=2, steps=2)
    assert s.count() == 30 and t.count() == 12


def test_classifiers(spark):
    rows = [(float(a), float(b), int(a + b > 1), int(a > 0.5)) for a, b in np.random.default_rng(0).random((200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, label int, n_friends int").cache()
    for c in (classifiers.LogisticModel(["a", "b"]), classifiers.LinearMachine(["a", "b"], c=1.0), classifiers.SquaredHinge(["a", "b"], c=1.0), classifiers.Averaged([classifiers.LogisticModel(["a", "b"]), classifiers.Constant()])):
        right = c.fit(df).score(df).agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]
        assert right > 0.9, c.name


def test_rating_models(spark):
    u, i, r = ratings.synthetic(60, 20, rank=3, per_user=15)
    s, t, mean, trace = ratings.mini_batches(u, i, r, rank=3, rate=5.0, epochs=20)
    assert trace[-1] < trace[0]
    ms, mt, mean = ratings.gaussian_messages(u, i, r, k=3)
    assert np.sqrt(np.mean(((ms[u] * mt[i]).sum(axis=1) + mean - r) ** 2)) < r.std()
