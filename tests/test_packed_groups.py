import re

from kithgraph.operators import features, recommend


def tables(spark):
    """40 users of 150 groups (three words of bits), some shared; a null group, a repeated member, a user of no group."""
    member = [(u, f"g{g}") for u in range(40) for g in range(150) if (u * 7 + g * 3) % 11 < 3] + [(0, None), (1, "g1"), (1, "g1")]
    likes = [(u, i) for u in range(41) for i in range(12) if (u + 2 * i) % 5 == 0]
    pairs = [(u, i) for u in range(41) for i in range(12) if (u + i) % 3 < 2] + [(3, 3), (3, 3)]
    return member, likes, pairs, spark.createDataFrame(member, "user_id long, group_id string"), spark.createDataFrame(likes, "user_id long, item_id long"), spark.createDataFrame(pairs, "user_id long, item_id long")


def exchanged(df) -> list[str]:
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().toString())


def test_by_group_exchanges_bits(spark):
    member, likes, pairs, m, l, p = tables(spark)
    of = {}
    for u, g in member:
        if g:
            of.setdefault(u, set()).add(g)
    fans = {}
    for u, i in likes:
        fans.setdefault(i, set()).add(u)
    want = {}
    for u, i in set(pairs):
        for g in of.get(u, ()):
            if n := sum(g in of.get(v, ()) for v in fans.get(i, set()) - {u}):
                want[u, i, g] = n
    found = features.by_group(p, m, l, counts=True)
    assert not any("group_id" in by and "item_id" in by for by in exchanged(found))
    rows = [tuple(r) for r in found.select("user_id", "item_id", "group_id", "n_likers").collect()]
    assert len(rows) == len(want) and {r[:3]: r[3] for r in rows} == want


def test_both_members_exchanges_bits(spark):
    member, _, pairs, m, _, p = tables(spark)
    held = {x for x in member if x[1]}
    found = features.both_members(p.distinct().withColumnRenamed("item_id", "poster"), m)
    assert not any("group_id" in by and "poster" in by for by in exchanged(found))
    rows = [tuple(r) for r in found.select("user_id", "poster", "group_id").collect()]
    assert sorted(rows) == sorted((u, i, g) for u, i in set(pairs) for v, g in held if v == u and (i, g) in held)


def test_nearest_likers_are_not_sorted_over_rows(spark):
    _, likes, pairs, _, l, p = tables(spark)
    v = spark.range(41).selectExpr("id as user_id", "array(cast(id % 7 as double)) as v")
    found = recommend.knn_likers(p, l, v, 3)
    assert "Window" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        d = sorted(((1 + (r.user_id % 7 - u % 7) ** 2) ** 0.5, u) for u, i in likes if i == r.item_id and u != r.user_id)[:3]
        assert abs(r.score - sum(1 / x for x, _ in d)) < 1e-9
    assert found.count() == len(pairs)
