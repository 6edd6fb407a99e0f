"""Each file source and sink: round trips, quoting, nulls, empty tables and refused rows."""

import pytest
from pyspark.sql import functions as F

from kithgraph.sources import files

ODD = ["a, b", "it's", '"q"', "{x}", "", "?", "%c", "@d", "back\\slash", "\\n", "line\nend\r\n", " pad ", "Grüße", "plain", "'", "\\'", "tab\there", "e" * 70_000, "o'" * 4_000]


def test_arff_quoting(spark, tmp_path):
    rows = [(i, None if i == 3 else i / 7, v, ODD[-1 - i]) for i, v in enumerate(ODD)] + [(99, 1.0, None, None), (None, None, None, None), (0, 0.0, "plain", "plain")]
    df = spark.createDataFrame(rows, "n int, `x y` double, `it's` string, `{c}` string")
    path = str(tmp_path / "x.arff")
    files.write_arff(df, path, "odd relation")
    back = files.read_arff(spark, path)
    assert back.dtypes == df.dtypes
    key = lambda r: repr(r)
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key)
    schema = files.arff_schema(spark, path)
    assert schema[2][2] == sorted(ODD)
    codes = {r["n"]: r["it's"] for r in files.read_arff(spark, path, codes=True).where("n between 1 and 18").collect()}
    assert codes == {i: sorted(ODD).index(v) for i, v in enumerate(ODD) if i}


def test_arff_booleans_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(True, 1), (None, 0)], "b boolean, y int")
    files.write_arff(df, str(tmp_path / "b"), "r", {"y": ["0", "1"]})
    assert {tuple(r) for r in files.read_arff(spark, str(tmp_path / "b")).collect()} == {("true", "1"), (None, "0")}
    files.write_arff(df.limit(0), str(tmp_path / "e"), "r")
    assert files.read_arff(spark, str(tmp_path / "e")).count() == 0


def test_sparse_quoting(spark, tmp_path):
    head = "@relation r\n@attribute a integer\n@attribute c {'n, o', \"y {s}\", z}\n@attribute d real\n@data\n"
    good = tmp_path / "s.arff"
    good.write_text(head + "{0 3, 1 'y {s}', 2 1.5}\n{}\n{ 1 z }\n{2 ?}\n4, 'n, o' ,?\n")
    assert sorted(map(repr, map(tuple, files.read_arff(spark, str(good)).collect()))) == sorted(map(repr, [(3, "y {s}", 1.5), (0, "n, o", 0.0), (0, "z", 0.0), (0, "n, o", None), (4, "n, o", None)]))
    for i, line in enumerate(("{0 3, 7 1}", "{0}", "{x 1}", "1,2", "1,z,2,3")):
        bad = tmp_path / f"bad{i}.arff"
        bad.write_text(head + line + "\n")
        with pytest.raises(Exception, match="row"):
            files.read_arff(spark, str(bad)).collect()


def test_pairs_and_ratings(spark, tmp_path):
    pairs = tmp_path / "p.csv"
    pairs.write_text("1,2,1\n3,4,0\n5,6,\n")
    assert sorted(map(tuple, files.read_pairs_csv(spark, str(pairs)).collect()))[:2] == [(1, 2, 1), (3, 4, 0)]
    assert files.read_pairs_csv(spark, str(pairs)).where("label is null").count() == 1
    triplets = tmp_path / "t.txt"
    triplets.write_text("7   8   4.5\n\n9   1   2\n")
    assert sorted(map(tuple, files.read_ratings(spark, str(triplets), "   ").collect())) == [(7, 8, 4.5), (9, 1, 2.0)]
    tabs = tmp_path / "u.data"
    tabs.write_text("7\t8\t3\t881250949\n")
    assert [tuple(r) for r in files.read_ratings(spark, str(tabs)).collect()] == [(7, 8, 3.0)]


def test_side_files(spark):
    people = spark.createDataFrame([(1, 34, "M", "artist"), (2, 7, "F", None), (3, None, None, "other")], "user_id long, age int, sex string, occupation string")
    got = {r.user_id: r.x for r in files.user_one_hot(people, ["artist", "other"]).collect()}
    at = lambda *on: [1.0 if i in on else 0.0 for i in range(13)]
    assert got == {1: at(3, 10, 11), 2: at(0), 3: at(12)}
    items = spark.createDataFrame([(1, "Drama|War"), (2, ""), (3, None), (4, "War|War|Drama")], "item_id long, genres string")
    assert {r.item_id: r.y for r in files.item_flags(items, ["War", "Drama", "Comedy"]).collect()} == {1: [1.0, 1.0, 0.0], 2: [0.0] * 3, 3: [0.0] * 3, 4: [1.0, 1.0, 0.0]}
    assert {r.item_id: r.genres for r in files.item_sets(items).collect()} == {1: ["Drama", "War"], 2: [], 3: [], 4: ["War", "Drama"]}


def test_dictionary_files(spark, tmp_path):
    counts = spark.createDataFrame([("a", 3), ("b", 9), ("c<>d", 9), ("e", 1)], "word string, n long")
    path = str(tmp_path / "d")
    files.write_dictionary(counts, path)
    assert [tuple(r) for r in files.read_dictionary(spark, path, 3).collect()] == [("b", 9), ("c<>d", 9), ("a", 3)]
    assert files.read_dictionary(spark, path).count() == 4


def test_recommendation_sink(spark, tmp_path):
    f = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)], "user_id long, item_id long, score double")
    o = spark.createDataFrame([(1, 9, 0.1), (2, 9, 0.2)], "user_id long, item_id long, score double")
    path = str(tmp_path / "r")
    files.write_recommendations(f, o, path, "a")
    files.write_recommendations(o, f.limit(0), path, "b")
    got = spark.read.parquet(path)
    assert got.where("type = 'a' and user_id = 1").count() == 3 and got.where("type = 'a' and user_id = 2").count() == 1 and got.where("type = 'b'").count() == 2
    assert sorted(r.place for r in got.where("type = 'a' and user_id = 1").collect()) == [1, 2, 3] and got.select("flag").distinct().first()[0] == 0


def test_database_table(spark):
    url = "jdbc:derby:memory:kithgraph;create=true"
    rows = spark.range(1_000).select(F.col("id").alias("user_id"), (F.col("id") % 7).alias("item_id"))
    rows.write.format("jdbc").option("url", url).option("dbtable", "likes").mode("overwrite").save()
    whole = files.read_jdbc(spark, url, "likes")
    split = files.read_jdbc(spark, url, "likes", "user_id", 0, 1_000, 4)
    assert split.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect())) == sorted(map(tuple, rows.collect()))
    assert files.read_jdbc(spark, url, "likes", "user_id", 0, 1_000, 4, fetchsize=10).where("user_id < 5").count() == 5
