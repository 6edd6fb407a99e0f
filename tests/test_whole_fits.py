"""Fits that run until they have converged, and ties by circle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.models import factors
from kithgraph.plans import catalogue
from kithgraph.sources.tables import Relations

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["hybrid", "logistic_hybrid"])
def test_hybrids_converge(spark, kind):
    """They stopped after six steps, far above the minimum."""
    losses = [r.loss for r in catalogue.queries()[f"{kind}_mf_fit"](spark, DATA).orderBy("step").collect()]
    assert len(losses) > 12 and losses[-1] < 0.95 * losses[6] and losses[-2] - losses[-1] < 1e-2


@pytest.mark.parametrize("kind", ["social", "spectral"])
def test_circles_are_ties(spark, kind):
    """The sums over circles give the loss and gradient of the listed ties, which each evaluation read."""
    rng = np.random.default_rng(1)
    circle = np.array([0, 1, 0, -1, 1, 0, 2])
    x = rng.normal(size=(7, 3))
    pairs = [(a, b) for a in range(7) for b in range(a + 1, 7) if circle[a] == circle[b] >= 0]
    u, v = np.array(pairs).T
    term = object.__new__(factors.Social if kind == "social" else factors.Spectral)
    loss, ds, _, _ = term.block([u, v, np.ones(len(u))], x, np.zeros((1, 3)), np.zeros(0))
    got, gs = factors.Circles(circle, spectral=kind == "spectral").ties(x)
    assert got == pytest.approx(loss) and np.allclose(gs, ds)


def test_fits_list_no_friends(spark, monkeypatch):
    """The pairs of all friends were listed once a fit and read in every evaluation."""
    monkeypatch.setattr(Relations, "friends", property(lambda self: pytest.fail("friends are listed")))
    assert catalogue.queries()["social_mf_fit"](spark, DATA).count() > 6


def test_samples_are_packed_once(spark):
    """An evaluation planned and converted the samples anew."""
    term = factors.Squared(spark.range(50).select((F.col("id") % 5).cast("int").alias("u"), (F.col("id") % 4).cast("int").alias("i"), F.lit(1.0).alias("label")))
    shape = factors.Shape(np.arange(5), np.arange(4), np.zeros((5, 0)), np.zeros((4, 0)), 2)
    p = np.random.default_rng(0).normal(size=18)
    first = factors.total(term, shape, p)
    held = term.packed()
    again = factors.total(term, shape, p)
    assert term.packed() is held and first[0] == pytest.approx(again[0]) and np.allclose(first[1], again[1])
