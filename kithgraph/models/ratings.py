"""Rating models that work by partition or in sequence: interpolation weights, mini-batches, Gaussian messages, a generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import co_rated, recommend

PAIR = ["user_id", "item_id"]


def item_products(ratings: DataFrame) -> DataFrame:
    """i <= j, n, mean: how many users rated both items, and the mean product of their ratings."""
    two = co_rated.sums(ratings, same=True, terms=["xy"])
    return two.select("i", "j", "n", (F.col("xy") / F.col("n")).alias("mean"))


def wanted_products(ratings: DataFrame, wanted: DataFrame) -> DataFrame:
    """item_products() of the pairs i <= j in wanted alone: they meet the raters of i and then those who rated j too."""
    r = ratings.select(*PAIR, F.col("rating").cast("double").alias("rating"))
    one = wanted.select("i", "j").distinct().join(r.select("user_id", F.col("item_id").alias("i"), F.col("rating").alias("x")), "i")
    two = one.join(r.select("user_id", F.col("item_id").alias("j"), F.col("rating").alias("y")), ["user_id", "j"])
    return two.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("y")).alias("mean"))


def interpolation_weights(pairs: DataFrame, ratings: DataFrame, similar: DataFrame, column: str, k: int = 30, ridge: float = 0.0) -> DataFrame:
    """pairs with score = sum of w_j r_j over the user's k rated items most similar to the item, with w = A^-1 b.

    A: mean products of the ratings of two neighbours by users who rated both, 0 without one; b: those of the item and a
    neighbour. Both come from one table of the item pairs that neighbours ask for. A singular A is solved by least squares; a ridge may be added. Null
    without a neighbour. Ties of similarity go to the lesser item. A group is one pair's at most k + k (k + 1) / 2 products.
    """
    at = recommend.rated_neighbours(pairs, ratings.select(*PAIR, F.col("rating").cast("double").alias("rating")), similar, column)
    near = at.withColumn("r", F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.desc("s"), "other"))).where(F.col("r") <= k)
    lists = near.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("r", "other", "rating"))).alias("near"))
    # the item is place 0: its products with place r are b, those of two places A
    places = F.concat(F.array(F.struct(F.lit(0).alias("r"), F.col("item_id").alias("other"), F.lit(0.0).alias("rating"))), "near")
    pairs_of = F.flatten(F.transform(places, lambda a: F.transform(F.filter(places, lambda b: (b["r"] >= a["r"]) & (b["r"] > 0)), lambda b: F.struct(a["r"].alias("p"), b["r"].alias("q"), F.least(a["other"], b["other"]).alias("i"), F.greatest(a["other"], b["other"]).alias("j"), b["rating"].alias("rating")))))
    wanted = lists.select(*PAIR, F.explode(pairs_of).alias("w")).select(*PAIR, "w.*")
    wanted = wanted.join(wanted_products(ratings, wanted).select("i", "j", "mean"), ["i", "j"], "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q, m = pdf["p"].to_numpy(), pdf["q"].to_numpy(), pdf["mean"].fillna(0.0).to_numpy()
        n = int(q.max())
        a, b, r = ridge * np.eye(n), np.zeros(n), np.zeros(n)
        own = p == 0
        b[q[own] - 1], r[q[own] - 1] = m[own], pdf["rating"].to_numpy()[own]
        x, y, v = p[~own] - 1, q[~own] - 1, m[~own]
        a[x, y] += v
        a[y[x != y], x[x != y]] += v[x != y]
        w = np.linalg.lstsq(a, b, rcond=None)[0]
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[:1], "item_id": pdf["item_id"].iloc[:1], "score": [float(w @ r)]})

    return pairs.join(wanted.groupBy(*PAIR).applyInPandas(solve, "user_id long, item_id long, score double"), PAIR, "left")


def mini_batches(u: np.ndarray, i: np.ndarray, r: np.ndarray, rank: int = 10, rate: float = 50.0, ridge: float = 0.01, keep: float = 0.8, epochs: int = 50, batches: int = 9, seed: int = 1):
    """PMF by mini-batches with momentum over arrays of places and ratings (driver-sized). Returns s, t, mean, RMSE by epoch."""
    rng = np.random.default_rng(seed)
    s, t, mean = 0.1 * rng.normal(size=(u.max() + 1, rank)), 0.1 * rng.normal(size=(i.max() + 1, rank)), r.mean()
    ms, mt, trace = np.zeros_like(s), np.zeros_like(t), []
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(r)), batches):
            e = (s[u[part]] * t[i[part]]).sum(axis=1) + mean - r[part]
            gs, gt = np.zeros_like(s), np.zeros_like(t)
            np.add.at(gs, u[part], e[:, None] * t[i[part]] + ridge * s[u[part]])
            np.add.at(gt, i[part], e[:, None] * s[u[part]] + ridge * t[i[part]])
            ms, mt = keep * ms + rate * gs / len(part), keep * mt + rate * gt / len(part)
            s, t = s - ms, t - mt
        trace.append(float(np.sqrt(np.mean(((s[u] * t[i]).sum(axis=1) + mean - r) ** 2))))
    return s, t, mean, trace


def gaussian_messages(u: np.ndarray, i: np.ndarray, r: np.ndarray, k: int = 5, noise: float = 0.5, prior: float = 1.0, passes: int = 2, seed: int = 1):
    """Sequential Gaussian updates of independent means and variances of traits, one rating after the other (driver-sized)."""
    rng = np.random.default_rng(seed)
    ms, mt = rng.normal(0, 0.3, (u.max() + 1, k)), rng.normal(0, 0.3, (i.max() + 1, k))
    vs, vt = np.full_like(ms, prior), np.full_like(mt, prior)
    mean = r.mean()
    for _ in range(passes):
        for a, b, x in zip(u, i, r - mean, strict=True):
            for own, var, other, ov in ((ms[a], vs[a], mt[b], vt[b]), (mt[b], vt[b], ms[a], vs[a])):
                total = float((var * other * other + ov * own * own + var * ov).sum()) + noise
                gain = var * other / total
                own += gain * (x - float(own @ other))
                var *= np.maximum(1e-3, 1 - gain * other)
    return ms, mt, mean


def synthetic(users: int, items: int, rank: int = 10, noise: float = 0.25, per_user: int = 30, seed: int = 1):
    """u, i, r of a low-rank rating matrix with noise: a generator for tests."""
    rng = np.random.default_rng(seed)
    s, t = rng.normal(size=(users, rank)) / np.sqrt(rank), rng.normal(size=(items, rank))
    u = np.repeat(np.arange(users), min(per_user, items))
    i = np.concatenate([rng.choice(items, min(per_user, items), replace=False) for _ in range(users)])
    return u, i, 3 + (s[u] * t[i]).sum(axis=1) + rng.normal(0, noise, len(u))
