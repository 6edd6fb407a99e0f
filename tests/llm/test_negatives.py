"""Hard negatives against all exact scores, on ties, repeats, nulls, non-finite, short and wide vectors and empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kithgraph.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(seed=2, n=900, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (4, d))
    out = []
    for i in range(n):
        k = int(rng.integers(0, 4))
        v = (centres[k] * rng.uniform(0.1, 1.2) + rng.normal(0, 0.15, d)).astype(np.float32).tolist()
        out.append((i, v, k))
    for i in range(100, 160):
        out[i] = (i, out[100][1], i % 4)  # one vector very often
    out[17] = (17, None, 1)
    out[18] = (18, [*out[3][1][:-1], None], 1)
    out[19] = (19, [*out[3][1][:-1], math.nan], 1)
    out[20] = (20, [*out[3][1][:-1], -math.inf], 1)
    out[21] = (21, out[3][1], None)
    out[22] = (None, out[3][1], 2)
    out[23] = (23, [0.9, 0.8], 2)
    out[24] = (24, [], 2)
    out[300] = (300, [], 3)
    out[350] = (350, out[350][1][:5], 9)  # no other row of its label
    return out + [out[30], out[30], out[200], (30, out[31][1], 1), (200, out[31][1], 2)]


def plain(rows, rule=negatives.Rule(), every=100):
    held = set()
    for i, v, k in rows:
        if i is None or k is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(np.float32(x))) for x in v]
        while w and not w[-1]:
            w.pop()
        held.add((i, k, tuple(w)))
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in held:
        if a[0] % every:
            continue
        scored = sorted(((-dot(a, b), b[0], b[1], b) for b in held if b != a), key=lambda x: x[:3])
        for p in [x for x in scored if x[2] == a[1]][: rule.positives]:
            ok = [x for x in scored if x[2] != a[1] and rule.low * -p[0] <= 100 * -x[0] <= rule.high * -p[0]]
            out += [(a[0], p[1], r, x[1], -p[0], -x[0]) for r, x in enumerate(ok[: rule.negatives], 1)]
    return sorted(out)


def told(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("chunk_bytes", [8 << 20, 200])
def test_mine(spark, chunk_bytes):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("i", "k", "v", "score", "id", "anchor", "rows")}).repartition(3)
    assert told(negatives.mine(df, F.col("vec_id") % 50 == 0, chunk_bytes=chunk_bytes)) == plain(rows, every=50)


def test_other_rules(spark):
    rows = vectors(5, 400, 6)
    rule = negatives.Rule(3, 4, -50, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(negatives.mine(df, F.col("vec_id") % 50 == 0, rule)) == plain(rows, rule, 50)


def test_bounds():
    rng = np.random.default_rng(7)
    v = rng.integers(-300, 300, (500, 9))
    v[:, 4] = 7
    b = negatives.Block(*negatives.pack(np.arange(500), np.zeros(500, np.int64), v))
    a = rng.integers(-300, 300, (20, 9))
    low, high = b.bounds(a)
    exact = a @ v.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < (exact.max() - exact.min()) / 3


def test_few_scored(spark):
    """Most rows are turned away by their bounds."""
    rng = np.random.default_rng(8)
    labels = rng.integers(0, 4, 4000)
    v = np.floor(256 * (rng.normal(0, 1, (4, 16))[labels] * 0.5 + rng.normal(0, 0.05, (4000, 16)))).astype(np.int64)
    b = negatives.Block(*negatives.pack(np.arange(4000), labels, v))
    chunk = negatives.Chunk(negatives.Rule(), np.arange(0, 4000, 400), labels[::400], v[::400], [[] for _ in range(10)])
    n = negatives._search_positives(b, chunk, [negatives.Kept(5) for _ in range(10)])
    assert n < 0.6 * 10 * 1000


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(none, F.col("vec_id") % 100 == 0).count() == 0
    some = spark.createDataFrame([(100, [1.0], 1), (7, [3e38], 2)], SCHEMA)
    with pytest.raises(Exception, match="63 bits"):
        negatives.mine(some, F.col("vec_id") % 100 == 0)
