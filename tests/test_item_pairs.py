import numpy as np
import pytest

from kithgraph.models import factors, registry


@pytest.mark.parametrize("kind", ["Copreference", "SpectralCopreference"])
def test_item_sums_equal_pairs(kind):
    """Three labels and a user's repeated samples of an item: the same loss and gradients as a row for each pair."""
    rng = np.random.default_rng(3)
    i, u, label = rng.integers(0, 4, 40), rng.integers(0, 9, 40), rng.integers(0, 3, 40).astype(float)
    s, t, w = rng.normal(size=(9, 3)), rng.normal(size=(5, 3)), np.zeros(0)
    a, b = np.array([(a, b) for a in range(40) for b in range(40) if i[a] == i[b] and u[a] < u[b]]).T
    pairs = object.__new__(getattr(factors, kind)).block([i[a], u[a], u[b], (label[a] == label[b]).astype(float)], s, t, w)
    sums = object.__new__(getattr(factors, f"Item{kind}")).block([i, u, label], s, t, w)
    for x, y in zip(pairs, sums, strict=True):
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("kind", ["copreference", "spectral_copreference"])
def test_popular_item_makes_no_pairs(spark, kind):
    """2,000 users of one item are 1,999,000 pairs; the fit's rows are the item's samples."""
    samples = spark.range(2000).selectExpr("id as user_id", "0L as item_id", "cast(id % 2 as double) as label")
    users = spark.range(2000).selectExpr("id as user_id", "array(1.0d) as x")
    items = spark.range(1).selectExpr("id as item_id", "array(1.0d) as y")
    seen = []
    total = factors.total

    def counted(term, shape, p):
        seen.append(term.rows.count())
        return total(term, shape, p)

    factors.total = counted
    try:
        trace = registry.Matrix(users, items, kind, k=2, ridge=1.0, social=1e-5, steps=1).fit(samples).model.trace
    finally:
        factors.total = total
    assert max(seen) == 2000 and np.isfinite(trace).all()
