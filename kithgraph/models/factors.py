"""Matrix factorisation with side features, ties and co-preferences.

A user's traits are s = U x + a_user, an item's t = V y + b_item; the prediction is s . t (hybrid models add w . f). Each
loss term is a table and a function of a block of its rows; one step of the optimiser is one pass that sums losses and
gradients by partition. The parameters are a flat vector on the driver, sent to the tasks each step, so their size is
checked (MOST_PARAMETERS); beyond it `descend` keeps the traits in tables and steps by joins.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .optimise import lbfgs, momentum

#: 8-byte numbers; 256 MB on the driver and in each task.
MOST_PARAMETERS = 32_000_000


@dataclass
class Shape:
    """Where each block lies in the flat vector."""

    users: np.ndarray
    items: np.ndarray
    x: np.ndarray
    y: np.ndarray
    k: int
    weights: int = 0

    def __post_init__(self):
        k, nu, ni = self.k, len(self.users), len(self.items)
        sizes = [k * self.x.shape[1], k * self.y.shape[1], nu * k, ni * k, self.weights]
        self.ends = np.cumsum([0, *sizes])
        if self.ends[-1] > MOST_PARAMETERS:
            raise ValueError(f"{self.ends[-1]} parameters are more than {MOST_PARAMETERS}; use descend(), which keeps traits in tables")

    def split(self, p: np.ndarray):
        k = self.k
        u, v, a, b, w = (p[i:j] for i, j in zip(self.ends, self.ends[1:], strict=False))
        return u.reshape(k, -1), v.reshape(k, -1), a.reshape(-1, k), b.reshape(-1, k), w

    def traits(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, v, a, b, _ = self.split(p)
        return self.x @ u.T + a, self.y @ v.T + b

    def back(self, ds: np.ndarray, dt: np.ndarray, dw: np.ndarray) -> np.ndarray:
        """The gradient by parameters from that by traits."""
        return np.concatenate([(ds.T @ self.x).ravel(), (dt.T @ self.y).ravel(), ds.ravel(), dt.ravel(), dw])


class Term:
    """A loss over the rows of a table: columns are index or value arrays; block() gives (loss, ds, dt, dw)."""

    columns: tuple[str, ...] = ()

    def __init__(self, rows: DataFrame, weight: float = 1.0):
        self.rows, self.weight, self.held = rows.select(*self.columns), weight, None

    def packed(self) -> RDD:
        """The rows as arrays, a few a partition, made once and kept until release(): an evaluation plans and converts nothing."""
        if self.held is None:
            bare = _bare(self)

            def pack(batches):
                for batch in _joined(batches):
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(bare.arrays(batch), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["x"])

            parts = self.rows.repartition(self.rows.sparkSession.sparkContext.defaultParallelism)
            self.held = parts.mapInArrow(pack, "x binary").rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
        return self.held

    def release(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None

    def block(self, c: list[np.ndarray], s: np.ndarray, t: np.ndarray, w: np.ndarray):
        raise NotImplementedError

    def arrays(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """The columns of a batch as block() takes them."""
        cols = [np.array(c.to_pylist(), dtype=object) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        return [np.array([np.asarray(x, float) for x in c] + [None], dtype=object)[:-1] if c.dtype == object else c for c in cols]


def _added(x: np.ndarray, by: np.ndarray, n: int = 0) -> np.ndarray:
    """Rows of x added up by number, in n rows at least."""
    return np.stack([np.bincount(by, weights=x[:, j], minlength=n) for j in range(x.shape[1])], axis=1)


class Squared(Term):
    """Half the squared error of label against s . t."""

    columns = ("u", "i", "label")

    def slope(self, z: np.ndarray, r: np.ndarray) -> tuple[float, np.ndarray]:
        return 0.5 * float(((r - z) ** 2).sum()), z - r

    def block(self, c, s, t, w):
        u, i, r = c
        loss, e = self.slope((s[u] * t[i]).sum(axis=1), r)
        return loss, _added(e[:, None] * t[i], u, len(s)), _added(e[:, None] * s[u], i, len(t)), np.zeros_like(w)


class Logistic(Squared):
    """Half the squared error of label against the logistic function of s . t."""

    def slope(self, z, r):
        p = 1 / (1 + np.exp(-z))
        return 0.5 * float(((r - p) ** 2).sum()), (p - r) * p * (1 - p)


class Hybrid(Term):
    """s . t + w . f for sparse features f: `at` and `value` arrays."""

    columns = ("u", "i", "label", "at", "value")
    logistic = False

    def arrays(self, batch):
        at, value = batch.column(3), batch.column(4)
        n = np.diff(at.offsets.to_numpy())
        return [*[batch.column(j).to_numpy(zero_copy_only=False) for j in range(3)], np.repeat(np.arange(len(n)), n), at.flatten().to_numpy(zero_copy_only=False), value.flatten().to_numpy(zero_copy_only=False)]

    @staticmethod
    def _flat(at: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
        """The row of each sparse feature, its number and its value."""
        n = np.fromiter(map(len, at), np.int64, len(at))
        whole = lambda x: np.concatenate(list(x)) if n.sum() else np.zeros(0)
        return [np.repeat(np.arange(len(at)), n), whole(at).astype(np.int64), whole(value)]

    def block(self, c, s, t, w):
        u, i, r, row, at, value = c if len(c) == 6 else [*c[:3], *self._flat(*c[3:])]
        linear, product = np.bincount(row, weights=w[at] * value, minlength=len(u)), (s[u] * t[i]).sum(axis=1)
        if self.logistic:
            a, b = 1 / (1 + np.exp(-linear)), 1 / (1 + np.exp(-product))
            e = a + b - r
            el, ep = e * a * (1 - a), e * b * (1 - b)
        else:
            e = linear + product - r
            el = ep = e
        dw = np.bincount(at, weights=el[row] * value, minlength=len(w))
        return 0.5 * float((e * e).sum()), _added(ep[:, None] * t[i], u, len(s)), _added(ep[:, None] * s[u], i, len(t)), dw


class LogisticHybrid(Hybrid):
    """logistic(w . f) + logistic(s . t)."""

    logistic = True


class Social(Term):
    """Half the sum over all user pairs of (S - s . s')^2, S being 0 without a tie: the ties' part. gram() adds the rest."""

    columns = ("u", "v", "tie")

    def block(self, c, s, t, w):
        u, v, tie = c
        g = (s[u] * s[v]).sum(axis=1)
        ds = np.zeros_like(s)
        np.add.at(ds, u, -tie[:, None] * s[v])
        np.add.at(ds, v, -tie[:, None] * s[u])
        return float((0.5 * tie * tie - tie * g).sum()), ds, np.zeros_like(t), np.zeros_like(w)

    @staticmethod
    def gram(s: np.ndarray) -> tuple[float, np.ndarray]:
        """Half the sum over pairs of (s . s')^2 = (|G|^2 - sum |s|^4) / 4 with G = sum s s'."""
        g, n2 = s.T @ s, (s * s).sum(axis=1)
        return 0.25 * float((g * g).sum() - (n2 * n2).sum()), s @ g - n2[:, None] * s


class Spectral(Term):
    """Half the sum over ties of S |s - s'|^2."""

    columns = ("u", "v", "tie")

    def block(self, c, s, t, w):
        u, v, tie = c
        d = s[u] - s[v]
        ds = np.zeros_like(s)
        np.add.at(ds, u, tie[:, None] * d)
        np.add.at(ds, v, -tie[:, None] * d)
        return 0.5 * float((tie * (d * d).sum(axis=1)).sum()), ds, np.zeros_like(t), np.zeros_like(w)


class Circles:
    """The ties' part of Social (spectral: all of Spectral) where every two users of a circle have a tie of 1: from sums over circles, so no tie is listed.

    circle: the number of each user's circle in the order of Shape.users, below 0 for none. The traits are on the driver, and so are the sums.
    """

    def __init__(self, circle: np.ndarray, weight: float = 1.0, spectral: bool = False):
        self.circle, self.weight, self.spectral = circle, weight, spectral

    def ties(self, s: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss and its gradient by the users' traits, without the weight."""
        ds, at = np.zeros_like(s), np.flatnonzero(self.circle >= 0)
        own, by = s[at], self.circle[at]
        n, x, square = np.bincount(by), _added(own, by), (own * own).sum()
        if self.spectral:
            ds[at] = n[by][:, None] * own - x[by]
            return 0.5 * float((n[by] * (own * own).sum(axis=1)).sum() - (x * x).sum()), ds
        ds[at] = own - x[by]
        return 0.5 * float((n * (n - 1)).sum()) / 2 - 0.5 * float((x * x).sum() - square), ds


class Copreference(Term):
    """Half the sum over (item, two users) of (p - sum_k s_k s'_k t_k)^2."""

    columns = ("i", "u", "v", "p")

    def block(self, c, s, t, w):
        i, u, v, p = c
        e = (s[u] * s[v] * t[i]).sum(axis=1) - p
        ds, dt = np.zeros_like(s), np.zeros_like(t)
        np.add.at(ds, u, e[:, None] * s[v] * t[i])
        np.add.at(ds, v, e[:, None] * s[u] * t[i])
        np.add.at(dt, i, e[:, None] * s[u] * s[v])
        return 0.5 * float((e * e).sum()), ds, dt, np.zeros_like(w)


class SpectralCopreference(Term):
    """Half the sum over (item, two users) of p * sum_k (s_k - s'_k)^2 t_k^2, whose gradient it uses."""

    columns = ("i", "u", "v", "p")

    def block(self, c, s, t, w):
        i, u, v, p = c
        d, ti = s[u] - s[v], t[i]
        ds, dt = np.zeros_like(s), np.zeros_like(t)
        np.add.at(ds, u, p[:, None] * d * ti * ti)
        np.add.at(ds, v, -p[:, None] * d * ti * ti)
        np.add.at(dt, i, p[:, None] * d * d * ti)
        return 0.5 * float((p * (d * d * ti * ti).sum(axis=1)).sum()), ds, dt, np.zeros_like(w)


class ItemPairs(Term):
    """A term of all pairs of an item's users from sums over its users: linear, not quadratic, in the item's popularity.

    A row is one item with all of its samples (by_item); a user's repeated samples make no pairs with one another.
    """

    columns = ("i", "u", "label")

    def arrays(self, batch):
        u, label = batch.column(1), batch.column(2)
        n = np.diff(u.offsets.to_numpy())
        return [np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n), u.flatten().to_numpy(zero_copy_only=False), label.flatten().to_numpy(zero_copy_only=False)]

    def block(self, c, s, t, w):
        i, u, label = c
        dt = np.zeros_like(t)
        if not len(i):
            return 0.0, np.zeros_like(s), dt, np.zeros_like(w)
        items, item = np.unique(i, return_inverse=True)
        _, kind = _numbered(item, np.unique(label, return_inverse=True)[1])
        loss, up, down = self.sums(item, kind, u, s[u], t[items])
        dt[items] = down
        return loss, _added(up, u, len(s)), dt, np.zeros_like(w)

    def sums(self, item: np.ndarray, kind: np.ndarray, u: np.ndarray, s: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The loss and its gradients by the traits of each sample and of each item. kind: one number an item and label."""
        raise NotImplementedError


def _numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each pair (a, b) of places is there, and its number, row by row."""
    _, number, n = np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True, return_counts=True)
    return n[number], number


class ItemCopreference(ItemPairs):
    """Copreference with p = 1 for equal labels, else 0."""

    def sums(self, item, kind, u, s, t):
        k = s.shape[1]
        own, same = _numbered(item, u)[0][:, None], _numbered(kind, u)[0][:, None]  # a user's samples of the item, and those of one label
        x = _added(s, kind)
        alike = 0.5 * (_added(x[kind] * s, item) - _added(same * s * s, item))  # sums of s s' over pairs of equal labels
        n = np.bincount(kind)
        equal = 0.5 * float((n * n).sum() - same.sum())
        outer = (s[:, :, None] * s[:, None, :]).reshape(-1, k * k)
        a, b = _added(outer, item).reshape(-1, k, k), _added(own * outer * outer, item).reshape(-1, k, k)
        both = np.einsum("ijl,il->ij", 0.5 * (a * a - b), t)
        loss = 0.5 * (equal + float((t * (both - 2 * alike)).sum()))
        ti = t[item]
        up = ti * (np.einsum("rjl,rl->rj", a[item], s * ti) - own * s * (s * s * ti).sum(axis=1)[:, None] - (x[kind] - same * s))
        return loss, up, both - alike


class ItemSpectralCopreference(ItemPairs):
    """SpectralCopreference with p = 1 for equal labels, else 0."""

    def sums(self, item, kind, u, s, t):
        x, n, ti = _added(s, kind)[kind], np.bincount(kind)[kind][:, None], t[item]
        spread = _added(n * s * s - x * s, item)  # sums of (s - s')^2 over pairs of equal labels
        return 0.5 * float((t * t * spread).sum()), ti * ti * (n * s - x), t * spread


def by_item(at: DataFrame) -> DataFrame:
    """Samples (i, u, label) as a row for each item, which holds as many as there are users (see Shape) and repeats."""
    return at.groupBy("i").agg(F.collect_list(F.struct("u", "label")).alias("x")).select("i", F.col("x.u").alias("u"), F.col("x.label").alias("label"))


def _joined(batches, rows: int = 1 << 17):
    """Batches of about `rows` samples, as each costs a vector of all traits."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += max([batch.num_rows, *[len(c.flatten()) for c in batch.columns if pa.types.is_list(c.type)]])
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def total(term: Term, shape: Shape, p: np.ndarray) -> tuple[float, np.ndarray]:
    """One distributed pass: the term's loss and its gradient by the flat parameters."""
    s, t = shape.traits(p)
    held = term.rows.sparkSession.sparkContext.broadcast((s, t, shape.split(p)[4]))

    def run(blobs):
        s, t, w = held.value
        loss, ds, dt, dw = 0.0, np.zeros_like(s), np.zeros_like(t), np.zeros_like(w)
        for blob in blobs:
            one = bare.block(pickle.loads(blob), s, t, w)
            loss += one[0]
            for own, more in zip((ds, dt, dw), one[1:], strict=True):
                own += more
        yield loss, np.concatenate([ds.ravel(), dt.ravel(), dw])

    bare = _bare(term)
    # gradients meet pairwise on the executors, so the driver gets one vector however many partitions there are
    loss, g = term.packed().mapPartitions(run).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    held.unpersist()
    n, m = s.size, t.size
    return term.weight * loss, term.weight * shape.back(g[:n].reshape(s.shape), g[n : n + m].reshape(t.shape), g[n + m :])


def _bare(term: Term) -> Term:
    """The term without its table, which cannot travel to tasks."""
    bare = object.__new__(type(term))
    bare.weight = term.weight
    return bare


@dataclass
class Factors:
    """A fitted model."""

    shape: Shape
    p: np.ndarray
    trace: list[float] = field(default_factory=list)

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:
        """user_id, s and item_id, t."""
        s, t = self.shape.traits(self.p)
        return spark.createDataFrame([(int(i), [float(z) for z in v]) for i, v in zip(self.shape.users, s, strict=True)], "user_id long, s array<double>"), spark.createDataFrame([(int(i), [float(z) for z in v]) for i, v in zip(self.shape.items, t, strict=True)], "item_id long, t array<double>")

    def score(self, pairs: DataFrame) -> DataFrame:
        """pairs with score = s . t; null for unknown ids."""
        s, t = self.tables(pairs.sparkSession)
        return pairs.join(s, "user_id", "left").join(t, "item_id", "left").withColumn("score", F.aggregate(F.zip_with("s", "t", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).drop("s", "t")


def indexed(df: DataFrame, ids: np.ndarray, column: str, to: str) -> DataFrame:
    """df with `to`: the place of column's value among the sorted ids (a bounded list, see Shape); other rows go."""
    table = df.sparkSession.createDataFrame([(int(v), k) for k, v in enumerate(ids)], f"{column} long, {to} int")
    return df.join(table, column)


def shape_of(users: DataFrame, items: DataFrame, k: int = 5, weights: int = 0) -> Shape:
    """users: user_id, x array; items: item_id, y array. Counted before they are collected."""
    if (users.count() + items.count()) * k > MOST_PARAMETERS:
        raise ValueError("too many users and items for the driver; use descend()")
    u, i = users.orderBy("user_id").collect(), items.orderBy("item_id").collect()
    return Shape(np.array([r[0] for r in u]), np.array([r[0] for r in i]), np.array([r[1] for r in u], float), np.array([r[1] for r in i], float), k, weights)


def scales(shape: Shape, users: np.ndarray, items: np.ndarray, squares: np.ndarray, ridge: float, trait: float = 0.3) -> np.ndarray:
    """What one step in each parameter is worth: about one over the root of the loss's curvature there, so that L-BFGS starts from even ground.

    users, items: samples of each; squares: sums of squared values of each sparse feature; trait: a guess of a squared trait.
    The minimum is the same.
    """
    x, y = (np.tile(trait * (n[:, None] * z * z).sum(axis=0), shape.k) for n, z in ((users, shape.x), (items, shape.y)))
    return 1 / np.sqrt(np.concatenate([x, y, np.repeat(trait * users, shape.k), np.repeat(trait * items, shape.k), squares]) + max(ridge, 1e-3))


def fit(shape: Shape, terms: list[Term | Circles], ridge: float = 100.0, seed: int = 1, method: str = "lbfgs", steps: int | None = 60, start: np.ndarray | None = None, scale: np.ndarray | None = None) -> Factors:
    """Minimise the sum of the terms and ridge/2 |parameters|^2. start: a warm start of the same shape. scale: see scales().

    L-BFGS uses no limit of steps where that is None: it goes on until it has converged.
    """
    p0 = start if start is not None else np.random.default_rng(seed).normal(0, 0.1, int(shape.ends[-1]))

    def f(p):
        loss, g = 0.5 * ridge * float(p @ p), ridge * p
        for term in terms:
            if isinstance(term, Circles):
                s, t = shape.traits(p)
                one, ds = term.ties(s)
                loss, g = loss + term.weight * one, g + term.weight * shape.back(ds, np.zeros_like(t), np.zeros(shape.weights))
            else:
                one, d = total(term, shape, p)
                loss, g = loss + one, g + d
            if isinstance(term, Social) or isinstance(term, Circles) and not term.spectral:
                s, t = shape.traits(p)
                more, ds = Social.gram(s)
                loss, g = loss + term.weight * more, g + term.weight * shape.back(ds, np.zeros_like(t), np.zeros(shape.weights))
        return loss, g

    run = lbfgs if method == "lbfgs" else momentum
    if scale is None:
        p, trace = run(f, p0, steps=steps)
    else:
        turned = lambda q: (lambda loss, g: (loss, g * scale))(*f(q * scale))
        q, trace = run(turned, p0 / scale, steps=steps, search="strong")
        p = q * scale
    for term in terms:
        if isinstance(term, Term):
            term.release()
    return Factors(shape, p, trace)


def descend(samples: DataFrame, k: int = 5, ridge: float = 0.1, step: float = 0.05, steps: int = 10, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Traits in tables: user_id, s and item_id, t after gradient steps by joins and aggregates; nothing goes to the driver.

    samples: user_id, item_id, label. Each step's tables are checkpointed, so lineage stays short.
    """
    from ..functions.scalars import dot, md5_bucket

    def first(ids: DataFrame, column: str, name: str) -> DataFrame:
        return ids.select(column).distinct().withColumn(name, F.array(*[(md5_bucket(seed, column, F.lit(j)) / 2**32 - 0.5) * 0.2 for j in range(k)]))

    s, t = first(samples, "user_id", "s"), first(samples, "item_id", "t")
    for _ in range(steps):
        e = samples.join(s, "user_id").join(t, "item_id").withColumn("e", F.col("label") - dot(F.col("s"), F.col("t")))
        move = lambda key, own, other: e.groupBy(key).agg(F.first(own).alias(own), F.count("*").alias("n"), *[F.sum(F.col("e") * F.get(other, F.lit(j))).alias(f"g{j}") for j in range(k)]).select(key, F.array(*[F.get(own, F.lit(j)) + step * (F.col(f"g{j}") / F.col("n") - ridge * F.get(own, F.lit(j))) for j in range(k)]).alias(own))
        s, t = move("user_id", "s", "t").checkpoint(), move("item_id", "t", "s").checkpoint()
    return s, t
