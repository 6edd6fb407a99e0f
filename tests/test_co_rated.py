"""Pairs of items: added up item by item, with no exchange of a row for each pair."""

import itertools
from collections import defaultdict

from kithgraph.models import ratings
from kithgraph.operators import co_rated, recommend
from kithgraph.plans import catalogue

DATA = "/root/testdata/sf0.001"
ROWS = [(u, i, float((u * 7 + i * 3) % 5 + 1)) for u in range(30) for i in range(12) if (u * i) % 4 != 1]


def brute(same):
    out, by = defaultdict(list), defaultdict(dict)
    for u, i, r in ROWS:
        by[u][i] = r
    for held in by.values():
        for i, j in itertools.product(held, held):
            if i < j or (same and i == j):
                out[i, j].append((held[i], held[j]))
    return out


def test_sums(spark):
    """As over all pairs."""
    df = spark.createDataFrame(ROWS, "user_id long, item_id long, rating double")
    for same, least in ((False, 2), (True, 1), (False, 25)):
        want = {k: (len(v), sum(x for x, _ in v), sum(y for _, y in v), sum(x * x for x, _ in v), sum(y * y for _, y in v), sum(x * y for x, y in v)) for k, v in brute(same).items() if len(v) >= least}
        assert {(r.i, r.j): tuple(r)[2:] for r in co_rated.sums(df, least, same).collect()} == want
    assert co_rated.sums(df.limit(0)).collect() == []


def test_no_exchange_by_pair(spark):
    """A row for each user and pair of items went through an exchange by (i, j)."""
    for name in ("item_similarity_cosine", "item_similarity_correlation", "item_similarity_shrunk", "item_similarity_bellkor", "item_products", "item_knn_scores"):
        plan = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and not any("Aggregate [i#" in line and ", j#" in line.split("]")[0] for line in plan.splitlines()), name


def test_wanted_products(spark):
    """Those of the pairs asked, as item_products() has them."""
    df = spark.createDataFrame(ROWS, "user_id long, item_id long, rating double")
    wanted = spark.createDataFrame([(0, 0), (0, 3), (0, 3), (2, 11), (5, 99)], "i long, j long")
    got = {tuple(r) for r in ratings.wanted_products(df, wanted).collect()}
    assert got == {tuple(r) for r in ratings.item_products(df).collect() if (r.i, r.j) in {(0, 0), (0, 3), (2, 11)}}


def test_rated_neighbours(spark):
    """The user's rated items that are similar to the item asked, for pairs that are rated and for others."""
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 4, 5.0), (2, 2, 1.0)], "user_id long, item_id long, rating double")
    similar = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25), (3, 4, 0.0), (1, 4, -1.0)], "i long, j long, s double")
    asked = spark.createDataFrame([(1, 3), (1, 1), (2, 3), (2, 1), (3, 1)], "user_id long, item_id long")
    got = sorted(tuple(r) for r in recommend.rated_neighbours(asked, df, similar, "s").select("user_id", "item_id", "other", "s", "rating").collect())
    assert got == [(1, 1, 2, 0.5, 3.0), (1, 3, 2, 0.25, 3.0), (2, 1, 2, 0.5, 1.0), (2, 3, 2, 0.25, 1.0)]
