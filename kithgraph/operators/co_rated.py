"""Pairs of items of one user, added up item by item: a user's list is exchanged for each of its items, not a row for each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that a task looks at in one go.
PAIRS = 1 << 20
#: What may be added up over the users of a pair, x being the rating of i and y that of j.
TERMS = {"sx": lambda x, y: x, "sy": lambda x, y: y, "xx": lambda x, y: x * x, "yy": lambda x, y: y * y, "xy": lambda x, y: x * y}


def followers(rows: DataFrame, same: bool, *columns: str) -> DataFrame:
    """user_id, i, the columns of i's row, and the user's rows behind it in order of items (same: with its own): arrays js and js_<column>.

    rows: user_id, item_id and columns, a pair once. Rows that none follows have none.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = F.array_sort(F.collect_list(F.struct("item_id", *columns))).alias("all")
    # few bytes become many rows, so tasks are not merged by bytes
    lists = rows.where("user_id is not null and item_id is not null").repartition(parts, "user_id").groupBy("user_id").agg(held)
    lists = lists.select("user_id", *[F.col(f"all.{c}").alias(f"__{c}") for c in ("item_id", *columns)])
    one = lists.select("*", F.posexplode("__item_id").alias("__at", "i"))
    behind = lambda c: F.slice(f"__{c}", F.col("__at") + (1 if same else 2), F.size("__item_id"))
    kept = one if same else one.where(F.col("__at") + 1 < F.size("__item_id"))
    return kept.select("user_id", "i", *[F.get(f"__{c}", F.col("__at")).alias(c) for c in columns], behind("item_id").alias("js"), *[behind(c).alias(f"js_{c}") for c in columns])


def _added(terms: list[str], least: int):
    """Rows in order of i: i, x, the items and the ratings that follow. The sums of each pair of `least` users or more."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def summed(i, j, v):
            order = np.lexsort((j, i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            return i[first], j[first], np.add.reduceat(v[:, order], first, axis=1)

        def told(i, j, v):
            good = v[0] >= least
            return pa.RecordBatch.from_arrays([pa.array(i[good]), pa.array(j[good]), pa.array(v[0, good].astype(np.int64)), *[pa.array(v[k + 1, good]) for k in range(len(terms))]], ["i", "j", "n", *terms])

        held = None
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(2))).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
                part = batch.slice(a, b - a)
                i, x = (np.repeat(part.column(c).to_numpy(), sizes[a:b]) for c in (0, 1))
                j, y = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
                v = np.vstack([np.ones(len(i)), *[TERMS[t](x, y) for t in terms]])
                if held is not None:
                    i, j, v = np.concatenate([held[0], i]), np.concatenate([held[1], j]), np.hstack([held[2], v])
                i, j, v = summed(i, j, v)
                # the last item may go on: of it only sums are held
                done = int(np.searchsorted(i, i[-1]))
                held = i[done:], j[done:], v[:, done:]
                if done:
                    yield told(i[:done], j[:done], v[:, :done])
        if held is not None:
            yield told(*held)

    return run


def sums(ratings: DataFrame, least: int = 1, same: bool = False, terms: list[str] | None = None) -> DataFrame:
    """i < j (same: i <= j), n and the terms: sums over the users who rated both, of pairs with `least` such users or more.

    ratings: user_id, item_id (whole numbers; a pair once), rating (not null). A task reads its items in order and holds the pairs of one, so its
    memory does not grow with the table; pairs of too few users never leave it.
    """
    terms = list(TERMS) if terms is None else terms
    rows = followers(ratings.select("user_id", F.col("item_id").cast("long").alias("item_id"), F.col("rating").cast("double").alias("rating")), same, "rating")
    dealt = rows.select("i", "rating", "js", "js_rating").repartition(2 * int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions")), "i").sortWithinPartitions("i")
    return dealt.mapInArrow(_added(terms, least), "i long, j long, n long" + "".join(f", {t} double" for t in terms))
