"""Models in tables against the same objectives on the driver, and recovery of planted weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.models import factors, optimise, registry, tables
from kithgraph.operators import recommend

PAIR = ["user_id", "item_id"]
K = 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    users, items = [int(u) * 7 for u in range(12)], [int(i) * 3 + 1 for i in range(9)]
    samples = [(u, i, float(rng.integers(0, 2))) for u in users for i in items if rng.random() < 0.6]
    ties = [(users[a], users[b], float(rng.integers(1, 4))) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.3]
    design = [(u, i, int(f), float(rng.normal())) for u, i, _ in samples for f in range(5) if rng.random() < 0.5]
    of = lambda ids, d: [(x, rng.normal(size=d).tolist()) for x in ids]
    make = lambda rows, schema: spark.createDataFrame(rows, schema).cache()
    return {"samples": make(samples, "user_id long, item_id long, label double"), "users": make(of(users, 2), "user_id long, x array<double>"), "items": make(of(items, 2), "item_id long, y array<double>"), "ties": make(ties, "a long, b long, tie double"), "design": make(design, "user_id long, item_id long, feature long, value double"), "rows": (samples, design)}


def terms(data, shape, kind, social):
    """The terms of models.factors for a kind."""
    at = factors.indexed(factors.indexed(data["samples"], shape.users, "user_id", "u"), shape.items, "item_id", "i")
    if kind.endswith("hybrid"):
        sparse = data["design"].groupBy(*PAIR).agg(F.collect_list("feature").alias("at"), F.collect_list("value").alias("value"))
        at = at.join(sparse, PAIR, "left").withColumn("at", F.coalesce("at", F.array().cast("array<bigint>"))).withColumn("value", F.coalesce("value", F.array().cast("array<double>")))
        return [(factors.Hybrid if kind == "hybrid" else factors.LogisticHybrid)(at)]
    out = [(factors.Logistic if kind == "logistic" else factors.Squared)(at)]
    if kind in ("social", "spectral"):
        t = factors.indexed(data["ties"].withColumnRenamed("a", "user_id"), shape.users, "user_id", "u").drop("user_id").withColumnRenamed("b", "user_id")
        out.append((factors.Social if kind == "social" else factors.Spectral)(factors.indexed(t, shape.users, "user_id", "v"), social))
    elif "copreference" in kind:
        c = factors.indexed(recommend.copreference(data["samples"]).withColumnRenamed("u1", "user_id"), shape.users, "user_id", "u").drop("user_id").withColumnRenamed("u2", "user_id")
        c = factors.indexed(factors.indexed(c, shape.users, "user_id", "v"), shape.items, "item_id", "i").withColumn("p", F.col("value").cast("double"))
        out.append((factors.Copreference if kind == "copreference" else factors.SpectralCopreference)(c, social))
    return out


def flat(shape, rows):
    """The table's parameters (or gradients) as the driver's vector."""
    held = {(r[0], r[1]): r[2] for r in rows}
    block = lambda kind, ids: [held.get((kind, int(x)), [0.0] * K) for x in ids]
    w = [held.get(("w", f), [0.0])[0] for f in range(shape.weights)]
    maps = [np.array(block(kind, range(shape.x.shape[1]))).T.ravel() for kind in ("U", "V")]
    return np.concatenate([*maps, np.array(block("u", shape.users)).ravel(), np.array(block("i", shape.items)).ravel(), np.array(w)])


@pytest.mark.parametrize("kind", tables.KINDS)
def test_same_objective(spark, data, kind):
    social, ridge = 0.3, 0.7
    problem = tables.Problem(data["samples"], data["users"], data["items"], kind, data["ties"], data["design"], K, ridge, social)
    p = problem.start(3).withColumn("p", F.transform("p", lambda x: x * 4))
    loss, got = problem.evaluate(p)
    shape = factors.shape_of(data["users"], data["items"], K, 5 if problem.hybrid else 0)
    rows = got.select("kind", "id", "p", "g").collect()
    x = flat(shape, [(r.kind, r.id, r.p) for r in rows])
    want, g = 0.5 * ridge * float(x @ x), ridge * x
    for term in terms(data, shape, kind, social):
        one, d = factors.total(term, shape, x)
        want, g = want + one, g + d
        if isinstance(term, factors.Social):
            s, t = shape.traits(x)
            more, ds = factors.Social.gram(s)
            want, g = want + social * more, g + social * shape.back(ds, np.zeros_like(t), np.zeros(shape.weights))
    assert loss == pytest.approx(want, rel=1e-9)
    assert np.abs(flat(shape, [(r.kind, r.id, r.g) for r in rows]) - g).max() < 1e-6


def test_same_steps(spark, data):
    """L-BFGS in tables takes the driver's steps."""
    problem = tables.Problem(data["samples"], data["users"], data["items"], "spectral", data["ties"], None, K, 0.7, 0.3)
    start = problem.start(3)
    made = tables.fit(problem, steps=3, memory=2, tolerance=1e-9, seed=3)
    shape = factors.shape_of(data["users"], data["items"], K)
    held = terms(data, shape, "spectral", 0.3)

    def f(x):
        loss, g = 0.35 * float(x @ x), 0.7 * x
        for term in held:
            one, d = factors.total(term, shape, x)
            loss, g = loss + one, g + d
        return loss, g

    x, trace = optimise.lbfgs(f, flat(shape, [tuple(r) for r in start.collect()]), memory=2, tolerance=1e-9, steps=3, search="strong")
    assert made.trace == pytest.approx(trace, abs=1e-6) and len(trace) == 4
    assert np.abs(flat(shape, [tuple(r) for r in made.p.select("kind", "id", "p").collect()]) - x).max() < 1e-6


def test_planted_weights(spark):
    rng = np.random.default_rng(4)
    w = np.array([1.5, -2.0, 0.5, 3.0])
    pairs = [(u, i) for u in range(30) for i in range(12)]
    f = rng.normal(size=(len(pairs), 4))
    samples = spark.createDataFrame([(u, i, float(x @ w)) for (u, i), x in zip(pairs, f, strict=True)], "user_id long, item_id long, label double")
    design = spark.createDataFrame([(u, i, j, float(x[j])) for (u, i), x in zip(pairs, f, strict=True) for j in range(4)], "user_id long, item_id long, feature long, value double")
    users = spark.createDataFrame([(u, [1.0]) for u in range(30)], "user_id long, x array<double>")
    items = spark.createDataFrame([(i, [1.0]) for i in range(12)], "item_id long, y array<double>")
    model = registry.make(registry.Config(kind="hybrid", k=2, ridge=0.01), users=users, items=items, design=design, steps=8).fit(samples)
    got = {r.feature: r.weight for r in model.weights().collect()}
    assert np.allclose([got[j] for j in range(4)], w, atol=0.1)
    scored = model.score(samples).collect()
    assert all(abs(r.score - r.label) < 0.5 for r in scored) and len(scored) == len(pairs)
    unknown = model.score(spark.createDataFrame([(99, 0), (1, 1)], "user_id long, item_id long"), design).collect()
    assert {r.user_id: r.score is None for r in unknown} == {99: True, 1: False}


def test_no_samples(spark, data):
    problem = tables.Problem(data["samples"].limit(0), data["users"], data["items"], "hybrid", None, data["design"].limit(0), K, 1.0)
    made = tables.fit(problem, steps=3)
    assert made.trace[-1] < 1e-6 and made.weights().count() == 0


def test_design_rows(spark, data):
    flags = spark.createDataFrame([(0, 1, "friend", 1.0), (999, 1, "friend", 1.0), (0, 1, "zero", 0.0)], "user_id long, item_id long, name string, value double")
    rows, names = tables.design_rows(data["samples"], data["users"], data["items"], flags)
    known = {r.feature: r.name for r in names.collect()}
    n = len(data["rows"][0])
    got = [(r.user_id, r.item_id, known[r.feature], r.value) for r in rows.collect()]
    own = [x for x in got if x[2] == "friend"]
    assert len([x for x in got if x[2].startswith("user ")]) == len([x for x in got if x[2].startswith("item ")]) == n
    assert own == ([(0, 1, "friend", 1.0)] if any((u, i) == (0, 1) for u, i, _ in data["rows"][0]) else []) and "zero" not in [x[2] for x in got]


def test_set_features(spark, data):
    """Tags are features of value 1: the loss and every gradient equal those of one-hot arrays and of finite differences."""
    names = ["a", "b", "c, d", "é"]
    tags = lambda i: [n for j, n in enumerate(names) if (i >> j) & 1]
    users = [(r.user_id, tags(n)) for n, r in enumerate(data["users"].orderBy("user_id").collect())]
    items = [(r.item_id, tags(n + 3)) for n, r in enumerate(data["items"].orderBy("item_id").collect())]
    sets = lambda rows, key, x: spark.createDataFrame([(i, None if n == 2 else [*t, *t, None]) for n, (i, t) in enumerate(rows)], f"{key} long, {x} array<string>").withColumn("tag", F.lit("x"))
    flat_x = lambda rows, key, x: spark.createDataFrame([(i, [float(n != 2 and v in t) for v in names]) for n, (i, t) in enumerate(rows)], f"{key} long, {x} array<double>")
    one = tables.Problem(data["samples"], sets(users, "user_id", "x"), sets(items, "item_id", "y"), "feature", k=K, ridge=0.7)
    two = tables.Problem(data["samples"], flat_x(users, "user_id", "x"), flat_x(items, "item_id", "y"), "feature", k=K, ridge=0.7)
    number = {r.n: r.h for r in spark.createDataFrame([(v,) for v in names], "n string").select("n", F.xxhash64("n").alias("h")).collect()}
    place = {number[v]: j for j, v in enumerate(names)}
    p = one.start(3).withColumn("p", F.transform("p", lambda x: x * 4)).cache()
    loss, got = one.evaluate(p)
    key = lambda r: (r.kind, place[r.id] if r.kind in "UV" else r.id)
    first = {key(r): (r.p, r.g) for r in got.collect()}
    other, held = two.evaluate(spark.createDataFrame([(*k, v[0]) for k, v in first.items()], "kind string, id long, p array<double>"))
    assert other == pytest.approx(loss, rel=1e-12)
    for r in held.collect():
        assert r.g == pytest.approx(first[r.kind, r.id][1], abs=1e-9)
    moved = lambda e: one.evaluate(p.withColumn("p", F.when((F.col("kind") == "V") & (F.col("id") == number["a"]), F.transform("p", lambda x, i: x + F.when(i == 1, e).otherwise(0.0))).otherwise(F.col("p"))))[0]
    assert (moved(1e-5) - moved(-1e-5)) / 2e-5 == pytest.approx(first["V", 0][1][1], abs=1e-6)


def test_set_fit(spark):
    """Likes that only tags explain: users of one tag like items of another; unseen pairs are ranked by it."""
    users = spark.createDataFrame([(u, ["even" if u % 2 == 0 else "odd", f"x{u % 3}"]) for u in range(20)], "user_id long, x array<string>")
    items = spark.createDataFrame([(i, ["war"] if i % 2 == 0 else ["drama", "war"]) for i in range(20)], "item_id long, y array<string>")
    items = tables.first_tags(items, "item_id", "y", ["drama", "war"])
    assert {r.item_id: r.y for r in items.collect()} == {i: ["war"] if i % 2 == 0 else ["drama"] for i in range(20)}
    pairs = spark.range(20).select(F.col("id").alias("user_id")).crossJoin(spark.range(20).select(F.col("id").alias("item_id"))).withColumn("label", ((F.col("user_id") + F.col("item_id")) % 2 == 0).cast("double"))
    hidden = F.pmod(F.col("user_id") * 7 + F.col("item_id") * 3, F.lit(5)) == 0
    m = registry.Tables(users, items, "feature", k=2, ridge=0.05, steps=12).fit(pairs.where(~hidden))
    assert m.model.trace[-1] < 0.3 * m.model.trace[0]
    scored = m.score(pairs.where(hidden)).collect()
    assert min(r.score for r in scored if r.label == 1) > max(r.score for r in scored if r.label == 0)


def test_first_tags(spark):
    rows = [(1, ["z", "M", "b", "a"]), (2, None), (3, []), (4, ["q"]), (5, ["b", None, "b"])]
    got = {r.user_id: r.x for r in tables.first_tags(spark.createDataFrame(rows, "user_id long, x array<string>"), "user_id", "x", ["a", "b"], ["M"]).collect()}
    assert got == {1: ["M", "a"], 2: [], 3: [], 4: [], 5: ["b"]}
