"""Affinity features of labelled (user_id, item_id) pairs. Each function gives long rows or flags; wide() pivots them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written

PAIR = ["user_id", "item_id"]


def by_contact(pairs: DataFrame, edges: DataFrame, likes: DataFrame, *by: str) -> DataFrame:
    """pairs' (user, item) with by: some alter of the user in that class likes the item."""
    reach = edges.select(F.col("ego").alias("user_id"), "alter", *by).join(likes.select(F.col("user_id").alias("alter"), "item_id"), "alter").select(*PAIR, *by).distinct()
    return reach.join(pairs.select(*PAIR).distinct(), PAIR, "left_semi")


#: Groups that are numbered in one task, and groups of a word (bits of a long).
NUMBERED, BITS = 1 << 16, 64


def numbered(groups: DataFrame) -> DataFrame:
    """group_id, word, bit: numbers of the distinct groups, 64 to a word, written once. Null groups go."""
    ids = groups.where("group_id is not null").select("group_id").distinct()
    parts = ids.agg(F.greatest(F.ceil(F.count("*") / NUMBERED), F.lit(1)).alias("parts"))  # one row
    dealt = ids.crossJoin(F.broadcast(parts)).withColumn("part", F.pmod(F.xxhash64("group_id"), F.col("parts")))
    n = dealt.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("group_id")) - 1)
    return written(n.select("group_id", (F.floor(F.col("n") / BITS) * F.col("parts") + F.col("part")).alias("word"), (F.col("n") % BITS).cast("int").alias("bit")))


def packed(members: DataFrame, codes: DataFrame, key: str = "user_id") -> DataFrame:
    """key, word, bits: the groups of each key, 64 in a row. codes: numbered()."""
    return members.join(codes, "group_id").groupBy(key, "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def by_group(pairs: DataFrame, members: DataFrame, likes: DataFrame, counts: bool = False) -> DataFrame:
    """(user, item, group_id): the user and another liker of the item are both in the group; counts adds n_likers.

    Likers are counted for each (item, group) once, so a popular item costs its likers' groups, not its pairs of users. A
    pair's groups are exchanged as bits, a row for 64 of them, and become rows where they are returned.
    """
    members = written(members.select("user_id", "group_id"))
    codes = numbered(members)
    asked = pairs.select(*PAIR, F.lit(1).alias("asked"), F.lit(0).alias("own"))
    rows = asked.unionByName(likes.select(*PAIR, F.lit(0).alias("asked"), F.lit(1).alias("own"))).groupBy(*PAIR).agg(F.max("asked").alias("asked"), F.max("own").alias("own"))
    return by_packed(rows, packed(members, codes), codes, counts)


def rated_by_group(rated: DataFrame, groups: DataFrame, counts: bool = False) -> DataFrame:
    """by_group() where who rated an item of a group is its member, and label 1 is a like: from one table of ratings.

    rated: user_id, item_id, label, a pair once. groups: item_id, group_id.
    """
    rated, codes = written(rated.select(*PAIR, "label")), numbered(groups)
    rows = rated.select(*PAIR, F.lit(1).alias("asked"), F.coalesce((F.col("label") == 1).cast("int"), F.lit(0)).alias("own"))
    return by_packed(rows, packed(rated.select(*PAIR).join(groups, "item_id"), codes), codes, counts)


def by_packed(rows: DataFrame, bits: DataFrame, codes: DataFrame, counts: bool = False) -> DataFrame:
    """by_group() of packed members. rows: user_id, item_id, asked and own (1: likes it), a pair once; bits: packed()."""
    at = rows.join(bits, "user_id")
    held = F.expr("(shiftright(bits, bit) & 1) = 1")
    # likers meet by item before their bits become rows, which are counted where they are
    likers = at.where("own = 1").select("item_id", "word", "bits").repartition("item_id", "word")
    n = likers.join(codes.select("word", "bit"), "word").where(held).groupBy("item_id", "word", "bit").agg(F.count("*").alias("n"))
    out = at.where("asked = 1").select(*PAIR, "own", "word", "bits").join(n, ["item_id", "word"]).where(held & (F.col("n") > F.col("own")))
    out = out.select(*PAIR, "word", "bit", (F.col("n") - F.col("own")).alias("n_likers")).join(codes, ["word", "bit"])
    return out.select(*PAIR, "group_id", "n_likers") if counts else out.select(*PAIR, "group_id")


def wide(pairs: DataFrame, flags: DataFrame, column: str, values: list[str], prefix: str = "") -> DataFrame:
    """pairs with an int 0/1 column for each value of flags' column."""
    return pairs.join(flags.select(*PAIR, column), PAIR, "left").groupBy(*pairs.columns).agg(*[F.max(F.when(F.col(column) == v, 1).otherwise(0)).alias(f"{prefix}{v}") for v in values])


def trait_overlap(pairs: DataFrame, traits: DataFrame, likes: DataFrame) -> DataFrame:
    """(user, item, trait): some other liker has the same value of a trait. traits: user_id, trait, value."""
    likers = likes.join(traits, "user_id").groupBy("item_id", "trait", "value").agg(F.countDistinct("user_id").alias("n"))
    own = likes.select(*PAIR).distinct().withColumn("own", F.lit(1))
    return pairs.select(*PAIR).distinct().join(traits, "user_id").join(likers, ["item_id", "trait", "value"]).join(own, PAIR, "left").where(F.col("n") > F.coalesce("own", F.lit(0))).select(*PAIR, "trait").distinct()


def friend_likes(pairs: DataFrame, friends: DataFrame, likes: DataFrame) -> DataFrame:
    """pairs with n_friends: how many friends like the item (0 kept)."""
    n = pairs.select(*PAIR).distinct().join(likes.select("item_id", F.col("user_id").alias("alter")), "item_id").join(friends.select(F.col("ego").alias("user_id"), "alter"), ["user_id", "alter"], "left_semi").groupBy(*PAIR).agg(F.countDistinct("alter").alias("n"))
    return pairs.join(n, PAIR, "left").withColumn("n_friends", F.coalesce("n", F.lit(0))).drop("n")


def circle_likes(pairs: DataFrame, circles: DataFrame, likes: DataFrame) -> DataFrame:
    """friend_likes() where friends are the users of one circle: an item's likers are counted by circle, less the user himself.

    It costs the likes and the pairs, not the pairs of users. circles: user_id, circle (one a user).
    """
    own = likes.select(*PAIR).distinct().join(circles, "user_id")
    n = own.groupBy("item_id", "circle").agg(F.count("*").alias("n"))
    at = pairs.select(*PAIR).distinct().join(circles, "user_id").join(n, ["item_id", "circle"]).join(likes.select(*PAIR).distinct().withColumn("own", F.lit(1)), PAIR, "left")
    return pairs.join(at.select(*PAIR, (F.col("n") - F.coalesce("own", F.lit(0))).alias("n_friends")), PAIR, "left").withColumn("n_friends", F.coalesce("n_friends", F.lit(0)))


def both_members(pairs: DataFrame, members: DataFrame, a: str = "user_id", b: str = "poster") -> DataFrame:
    """pairs with the groups that hold both a and b: their bits meet, and common ones become rows."""
    members = written(members.select("user_id", "group_id"))
    codes = numbered(members)
    bits = packed(members, codes)
    x = pairs.join(bits.withColumnRenamed("user_id", a), a).join(bits.select(F.col("user_id").alias(b), "word", F.col("bits").alias("other")), [b, "word"])
    x = x.withColumn("bits", F.col("bits").bitwiseAND(F.col("other"))).where("bits <> 0").join(codes, "word").where(F.expr("(shiftright(bits, bit) & 1) = 1"))
    return x.select(*pairs.columns, "group_id")


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two feature tables on (user, item); the right one's label goes."""
    return left.join(right.drop("label"), PAIR)


def drop_no_signal(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without liked rows whose features are all zero."""
    none = F.lit(True)
    for c in columns:
        none = none & (F.coalesce(F.col(c), F.lit(0)) == 0)
    return df.where(~((F.col("label") == 1) & none))


def at_least_flags(df: DataFrame, columns: list[str], least: int) -> DataFrame:
    return df.where(sum((F.coalesce(F.col(c), F.lit(0)).cast("int") for c in columns), F.lit(0)) >= least)


def column_group(df: DataFrame, keep: list[str], prefixes: dict[str, int | None]) -> DataFrame:
    """keep, then for each prefix its first n columns (None: all), in the table's order."""
    out = list(keep)
    for p, n in prefixes.items():
        out += [c for c in df.columns if c.startswith(p)][:n]
    return df.select(*out)


def true_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n_true for each column."""
    return df.select(*[F.col(c).cast("int").alias(c) for c in columns]).unpivot([], columns, "feature", "value").groupBy("feature").agg(F.sum("value").cast("long").alias("n_true"))


def top(df: DataFrame, key: str, n: int, count: Column | None = None) -> DataFrame:
    """The n keys of most rows; ties by key."""
    return df.groupBy(key).agg((F.count("*") if count is None else count).alias("n")).orderBy(F.desc("n"), key).limit(n)


def by_group_pooled(pairs: DataFrame, members: DataFrame, likes: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """(user, item, group_id, n_likers): other likers in the user's group of any item that shares the item's key. pool: item_id, key."""
    pooled = likes.join(pool, "item_id").select("user_id", F.col(key).alias("item_id")).distinct()
    at = pairs.select(*PAIR).distinct().join(pool, "item_id")
    found = by_group(at.select("user_id", F.col(key).alias("item_id")), members, pooled, counts=True)
    return at.join(found.withColumnRenamed("item_id", key), ["user_id", key]).select(*PAIR, "group_id", "n_likers")


def fold_weights(rows: DataFrame, n: int) -> DataFrame:
    """feature, fold, weight: the log odds of label 1 with the feature over those of all rows, learned without the fold. rows: feature, label, fold."""
    whole = rows.groupBy("feature", "fold").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    # each fold's counts are in the pools of all others
    pools = whole.withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k != F.col("fold")))).groupBy("feature", "k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    totals = pools.groupBy("k").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    return pools.join(totals, "k").select("feature", F.col("k").alias("fold"), (F.log((F.col("p") + 1.0) / (F.col("n") + 1.0)) - F.log((F.col("tp") + 1.0) / (F.col("tn") + 1.0))).alias("weight"))


def weight_report(weights: DataFrame, rows: DataFrame, most: int = 10) -> DataFrame:
    """The `most` features of greatest weight of each sign: mean and error over folds, rows that have it, users that have it."""
    mean = weights.groupBy("feature").agg(F.avg("weight").alias("mean"), (F.stddev_pop("weight") / F.sqrt(F.count("*"))).alias("se"))
    seen = rows.groupBy("feature").agg(F.count("*").alias("n_yes"), F.countDistinct("user_id").alias("n_users"))
    signed = mean.join(seen, "feature").withColumn("sign", F.when(F.col("mean") >= 0, 1).otherwise(-1))
    place = F.row_number().over(Window.partitionBy("sign").orderBy(F.desc(F.round(F.abs("mean"), 9)), "feature"))
    return signed.withColumn("place", place).where(F.col("place") <= most).select("feature", "sign", "place", "mean", "se", "n_yes", "n_users")


def size_matrix(rows: DataFrame, by: str, size: str, bounds: list[int]) -> DataFrame:
    """One row for each value of `by`, a count for each bound of the rows whose size is at most that."""
    return rows.groupBy(by).agg(*[F.count(F.when(F.col(size) <= b, 1)).alias(f"upto_{b}") for b in bounds])
