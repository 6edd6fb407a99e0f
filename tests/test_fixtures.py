"""Small inputs with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from kithgraph.functions import scalars as fn
from kithgraph.operators import exposure, graph, metrics, recommend, sampling


def edges(spark, rows):
    return spark.createDataFrame(rows, "ego long, alter long")


def test_directions(spark):
    c = spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "actor long, target long")
    assert {tuple(r) for r in graph.edges(c, graph.INCOMING).collect()} == {(2, 1), (4, 3), (3, 1)}
    assert {tuple(r) for r in graph.edges(c, graph.OUTGOING).collect()} == {(1, 2), (3, 4), (1, 3)}
    assert graph.edges(c, graph.BIDIR).count() == 6
    with pytest.raises(ValueError):
        graph.edges(c, "SIDEWAYS")


def test_set_algebra(spark):
    a, b = edges(spark, [(1, 2), (1, 3), (4, 5)]), edges(spark, [(1, 3)])
    got = lambda d: {tuple(r) for r in d.collect()}
    assert got(graph.union(a, b)) == {(1, 2), (1, 3), (4, 5)}
    assert got(graph.minus(a, b)) == {(1, 2), (4, 5)}
    assert got(graph.intersect(a, b)) == {(1, 3)}
    assert got(graph.intersect(a, b, keep_missing_egos=True)) == {(1, 3), (4, 5)}


def test_exposure(spark):
    e = edges(spark, [(1, 2), (1, 3), (1, 4), (2, 1), (2, 3), (5, 2)])
    likes = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 10), (3, 11), (3, 13), (4, 11)], "user_id long, item_id long")
    p = {(r.k, r.ego): r.p for r in exposure.per_ego(e, likes, 3).collect()}
    assert p[1, 1] == pytest.approx(1 / 2) and p[1, 2] == pytest.approx(1 / 3) and p[1, 5] == 0
    assert p[2, 1] == 1 and p[2, 2] == 0.5 and (2, 5) not in p and not any(k == 3 for k, _ in p)
    ungated = {r.k: r.mean for r in exposure.curve(e, likes, 3, gate=0).collect()}
    assert ungated[1] == pytest.approx(5 / 18) and ungated[2] == 0.75
    assert all(r.mean is None for r in exposure.curve(e, likes, 3).collect())


def test_std_error(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.4,)], "x double")
    assert df.agg(metrics.std_error95(F.col("x"))).first()[0] == pytest.approx(0.379489, abs=1e-6)
    assert df.limit(1).agg(metrics.std_error95(F.col("x"))).first()[0] is None


def test_metrics(spark):
    df = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.4, 0), (1, 12, 0.2, 1), (2, 10, 0.8, 0), (2, 11, 0.7, 1), (2, 12, -0.1, 0)], "user_id long, item_id long, score double, label int")
    r = metrics.rates(metrics.confusion(df, 0.5)).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 2, 1)
    assert [r.accuracy, r.precision, r.recall, r.f1] == pytest.approx([2 / 3] * 4) and r.ci == pytest.approx(0.384900, abs=1e-6)
    b = metrics.best_threshold(df).first()
    assert b.f1 == pytest.approx(0.75) and b.threshold == pytest.approx(0.0)
    ap = {x.user_id: x.ap for x in metrics.average_precision(df).collect()}
    assert ap[1] == pytest.approx(0.833333, abs=1e-6) and ap[2] == 0.5
    assert metrics.right_minus_wrong(df, 0.5).first().value == 2


def test_strength(spark):
    friends = edges(spark, [(1, 2), (2, 1)])
    contacts = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 2), (1, 3)], "target long, actor long")
    together = graph.co_pairs(spark.createDataFrame([(7, 2), (7, 3)], "item_id long, user_id long"))
    got = {(r.a, r.b): r for r in graph.strength(friends, contacts, together).collect()}
    assert got[1, 2].strength == 4 and got[1, 3].strength == 2 and got[2, 3].strength == 1
    assert got[1, 2].log == pytest.approx(0.538997, abs=1e-6) and got[2, 3].log1p == pytest.approx(0.356675, abs=1e-6)


def test_neighbours(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.9]), (2, [1.0, 0.0, 0.8]), (3, [0.0, 1.0, 0.9])], "user_id long, v array<double>")
    likes = spark.createDataFrame([(2, 5), (3, 5)], "user_id long, item_id long")
    pair = spark.createDataFrame([(1, 5)], "user_id long, item_id long")
    assert recommend.knn_likers(pair, likes, v, 50).first().score == pytest.approx(1.572387, abs=1e-6)


def test_similarity(spark):
    rows = [(u, i, float(r)) for u, (a, b) in enumerate([(5, 4), (3, 2), (4, 5)]) for i, r in ((1, a), (2, b))]
    r = recommend.item_similarity(spark.createDataFrame(rows, "user_id long, item_id long, rating double")).first()
    assert [r.cosine, r.correlation, r.shrunk, r.bellkor] == pytest.approx([0.969765, 0.654654, 0.059514, 0.75], abs=1e-5)


def test_contiguous_folds(spark):
    f = sampling.contiguous_folds(spark.range(10).withColumnRenamed("id", "k"), 3, "k").orderBy("k").collect()
    assert [r.fold for r in f] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]


def test_naive_bayes(spark):
    long = spark.createDataFrame([(i, i, "f", x, y) for i, (x, y) in enumerate([(1, 1), (1, 1), (1, 0), (0, 0), (0, 0)])], "user_id long, item_id long, feature string, value int, label int")
    p = {(r.value, r.label): r.p for r in recommend.nb_counts(long).collect()}
    assert p[1, 0] == pytest.approx(0.4) and p[1, 1] == pytest.approx(0.75)
    s = {r.user_id: r.score for r in recommend.nb_predict(long, ["user_id", "item_id"]).collect()}
    assert s[0] == pytest.approx(0.584416, abs=1e-6)


def test_entropy(spark):
    df = spark.createDataFrame([("a", 1, 1)] * 989 + [("a", 1, 0)] * 486, "feature string, x int, y int")
    assert metrics.information(df).first().entropy_true == pytest.approx(0.914406, abs=1e-6)


def test_people_and_text(spark):
    r = spark.createDataFrame([("03/14/1987", "03/14", "male", "Great, GREAT link - see it!")], "b string, c string, g string, t string")
    x = r.select(fn.birth_year(F.col("b")).alias("y"), fn.birth_year(F.col("c")).alias("z"), fn.age_bucket(fn.birth_year(F.col("b"))).alias("a"), fn.user_features(F.col("g"), F.col("b")).alias("f"), fn.tokens(F.col("t")).alias("w")).first()
    assert (x.y, x.z, x.a) == (1987, 0, 5) and x.f == pytest.approx([1, 0, 1987 / 2012]) and x.w == ["great", "great", "link", "see", "it"]


def test_connections(spark):
    d = spark.createDataFrame([([29.0, 45.0, 61.0], [54.0, 86.0, 118.0], [1.0, 2.0, 3.0])], "s array<double>, t array<double>, v array<double>")
    s, t, v = F.col("s"), F.col("t"), F.col("v")
    got = d.select(fn.connection(s, t), fn.connection(s, t, True), fn.connection(s, t, item=v), fn.connection(s, t, True, v)).first()
    assert list(got) == [12634, 5555, 30900, 13734]


def test_bucket(spark):
    assert spark.range(1).select(fn.md5_bucket(1, F.lit(42), F.lit(7))).first()[0] == 1188492328
