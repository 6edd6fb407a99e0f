"""Every query against its SQL at the smallest scale, and the files' round trips."""

import glob
import math
import os

import duckdb
import pytest

from kithgraph.plans import catalogue
from kithgraph.sources import files

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(rows):
    one = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    return sorted(repr([one(v) for v in r]) for r in rows)


def test_all_have_sql():
    from kithgraph.plans import fitted

    assert set(QUERIES) == set(ORACLES) | set(fitted.QUERIES) and len(ORACLES) > 120


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({ORACLES[name]}) t").fetchall()
    assert plain(df.select(*columns).collect()) == plain(found)


def test_whole_groups(spark, duck):
    """Every group of a user with ratings, with all its members: more than the three seeds of two_hop_members reach."""
    got = {tuple(r) for r in QUERIES["rater_group_members"](spark, DATA).select("group_id", "user_id").collect()}
    assert got == set(duck.execute("SELECT p_brand, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey").fetchall())


def test_whole_dump(spark, duck):
    got = QUERIES["message_dump_turns"](spark, DATA)
    assert got.count() == sum(duck.execute(f"SELECT COUNT(*) FROM {x}").fetchone()[0] for x in ("conversations", "benchmark")) and got.where("turn > 0").count() > 0


def test_arff(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, "y"), (2, None, "n")], "a int, b double, c string")
    path = str(tmp_path / "x.arff")
    files.write_arff(df, path, "r", {"c": ["n", "y"]})
    assert sorted(map(tuple, files.read_arff(spark, path).collect())) == [(1, 0.5, "y"), (2, None, "n")]
    assert sorted(r.c for r in files.read_arff(spark, path, codes=True).collect()) == [0, 1]
    sparse = tmp_path / "s.arff"
    sparse.write_text("% note\n@RELATION r\n@Attribute a integer\n@attribute b real\n@attribute c {n,y}\n@DATA\n{0 3, 2 y}\n{}\n")
    assert sorted(map(tuple, files.read_arff(spark, str(sparse)).collect())) == [(0, 0.0, "n"), (3, 0.0, "y")]
    bad = tmp_path / "b.arff"
    bad.write_text("@relation r\n@attribute a date\n@data\n1\n")
    with pytest.raises(ValueError):
        files.read_arff(spark, str(bad))


def test_rating_files_and_models(spark, tmp_path):
    p = tmp_path / "r.dat"
    p.write_text("1::2::3.5\n4::5::1\n")
    assert sorted(map(tuple, files.read_ratings(spark, str(p), "::").collect())) == [(1, 2, 3.5), (4, 5, 1.0)]
    u, i = spark.createDataFrame([(1, [0.5])], "user_id long, s array<double>"), spark.createDataFrame([(2, [1.5])], "item_id long, t array<double>")
    m = str(tmp_path / "m")
    for kind in ("a", "b", "a"):
        files.save_model(spark, m, kind, u, i)
    a, b = files.load_model(spark, m, "a")
    assert tuple(a.first()) == (1, [0.5]) and b.count() == 1
    new = files.refreshed(a, spark.createDataFrame([(1,), (9,)], "user_id long"), "user_id", "s", 1)
    assert {r.user_id for r in new.collect()} == {1, 9}


def test_stream(spark, tmp_path):
    from kithgraph.streaming import windows

    src = tmp_path / "in"
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(str(src))
    query = windows.counts(windows.read(spark, str(src), "*.parquet"), "1 day", "1 day").writeStream.outputMode("complete").format("memory").queryName("seen").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen").agg({"n": "sum"}).first()[0] == spark.read.parquet(str(src)).count()


@pytest.mark.parametrize("name", ["spectral_mf_fit", "lr_fit"])
def test_fitted(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_fits_are_finished(spark):
    """More steps than the five the fits once stopped after, and a loss that still fell beyond them."""
    losses = [r.loss for r in QUERIES["feature_mf_fit"](spark, DATA).orderBy("step").collect()]
    assert len(losses) > 6 and losses[-1] < 0.9 * losses[5]
