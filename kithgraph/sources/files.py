"""File sources and sinks: attribute-relation files, rating files with side files, models, recommendations, dictionaries."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A cell: in single or double quotes, where a backslash keeps the next character (\n and \r are line ends), or plain.
#: Lines are matched after HIDDEN took the place of escaped backslashes and quotes, so the patterns need no loops of groups.
QUOTED = r"""'[^']*'|"[^"]*\""""
CELL = rf"\s*({QUOTED}|[^,]*?)\s*,"
INDEXED = rf"\s*(\d+)\s+({QUOTED}|[^,]*?)\s*,"
ESCAPED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
ATTRIBUTE = re.compile(rf"^@attribute\s+({ESCAPED}|\S+)\s+(.+)$", re.IGNORECASE)
NOMINAL = rf"\s*({ESCAPED}|[^,]*?)\s*,"
PLAIN = r"[\p{L}\p{N}_.+:/-]+"
#: What stands for an escaped backslash and quotes within a task: noncharacters, which no text may interchange.
HIDDEN = {"\\\\": "﷐", "\\'": "﷑", '\\"': "﷒"}


def _hide(text: Column) -> Column:
    clash = F.raise_error(F.concat(F.lit("a row has a noncharacter: "), text))
    text = F.when(text.rlike("[﷐-﷒]"), clash).otherwise(text)
    for pair, mark in HIDDEN.items():
        text = F.replace(text, F.lit(pair), F.lit(mark))
    return text


def _opened(raw: str) -> str:
    """A cell's value, as `_open` gives it."""
    if len(raw) > 1 and raw[0] in "'\"" and raw[-1] == raw[0]:
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    return raw


def _closed(value: str) -> str:
    """A value as a quoted cell."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r") + "'"


def _open(raw: Column) -> Column:
    """The value of a hidden cell: null for a plain `?` or nothing, else without its quotes and backslashes."""
    inner, plain = F.substring(raw, F.lit(2), F.length(raw) - 2), raw
    for was, now in (("\\n", "\n"), ("\\r", "\r"), ("\\", "")):
        inner = F.replace(inner, F.lit(was), F.lit(now))
    for pair, mark in HIDDEN.items():
        inner, plain = F.replace(inner, F.lit(mark), F.lit(pair[1])), F.replace(plain, F.lit(mark), F.lit(pair))
    return F.when(raw.rlike(f"^(?:{QUOTED})$"), inner).when(raw.isin("?", ""), None).otherwise(plain)


def _close(value: Column) -> Column:
    """A value as a cell: `?` for null, quoted where it holds more than letters, digits and _ . + : / -."""
    text = F.replace(F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(value.isNull(), "?").when(value.rlike(f"^{PLAIN}$") & ~F.contains(value, F.lit("\n")), value).otherwise(F.concat(F.lit("'"), text, F.lit("'")))


def _all(text: Column, pattern: str, *groups: int) -> list[Column]:
    """The groups of all matches in text and a comma, which must leave nothing out."""
    ended = F.concat(text, F.lit(","))
    found = [F.regexp_extract_all(ended, F.lit(pattern), F.lit(i)) for i in (0, *groups)]
    whole = F.aggregate(found[0], F.lit(0), lambda n, x: n + F.length(x)) == F.length(ended)
    return [F.when(whole, x).otherwise(F.raise_error(F.concat(F.lit("not a row: "), text))) for x in found[1:]]


def arff_schema(spark: SparkSession, path: str) -> list[tuple[str, str, list[str]]]:
    """(name, type, nominal values) of each attribute, in order. Names and values may be quoted; an unknown type is an error."""
    header = spark.read.text(path).select(F.trim("value").alias("value"), F.monotonically_increasing_id().alias("k")).where(F.lower("value").startswith("@attribute")).orderBy("k").collect()
    out = []
    for row in header:  # as many rows as there are columns
        m = ATTRIBUTE.match(row.value)
        if not m:
            raise ValueError(f"not an attribute line: {row.value!r}")
        name, kind = _opened(m[1]), m[2].strip()
        if kind.startswith("{"):
            out.append((name, "nominal", [_opened(v) for v in re.findall(NOMINAL, kind[1:].removesuffix("}") + ",")]))
        elif kind.lower() in ("integer", "real", "numeric"):
            out.append((name, kind.lower(), []))
        else:
            raise ValueError(f"unknown attribute type {kind!r} of {name!r}")
    return out


def read_arff(spark: SparkSession, path: str, codes: bool = False) -> DataFrame:
    """The rows of a dense or sparse file. Comments (%) and blank lines go; plain `?` and missing cells are null.

    integer -> int, real and numeric -> double, nominal -> string, or with codes its place in the declaration. A sparse
    row lists `index value` pairs; what it leaves out is 0, or the first nominal value. Cells may be quoted: commas,
    braces and spaces in quotes belong to the value, and a quoted `?` or nothing is that text. A dense row of another
    width, a sparse row that is not all pairs, and an index beyond the attributes fail.
    """
    schema = arff_schema(spark, path)
    n = len(schema)
    row = (F.col("v") != "") & ~F.col("v").startswith("%") & ~F.col("v").startswith("@")
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where(row).select(_hide(F.col("v")).alias("v"))
    sparse = F.col("v").startswith("{")
    inside = F.trim(F.regexp_replace("v", r"^\{|\}\s*$", ""))
    places, values = _all(inside, INDEXED, 1, 2)
    first = F.array(*[_hide(F.lit(_closed(v[0]))) if k == "nominal" else F.lit("0") for _, k, v in schema])
    held = F.when(inside == "", F.create_map().cast("map<int,string>")).otherwise(F.map_from_arrays(F.transform(places, lambda p: p.cast("int")), values))
    beyond = F.exists(F.map_keys(held), lambda i: i >= n)
    from_sparse = F.when(beyond, F.raise_error(F.concat(F.lit(f"a row has an index beyond {n - 1}: "), F.col("v")))).otherwise(F.transform(first, lambda x, i: F.coalesce(F.try_element_at(held, i), x)))
    dense = _all(F.col("v"), CELL, 1)[0]
    checked = F.when(F.size(dense) != n, F.raise_error(F.concat(F.lit(f"a row has not {n} cells: "), F.col("v")))).otherwise(dense)
    # other lines' cells are null: a caller's filter may be checked before the one on lines
    cells = lines.select(F.when(row & sparse, from_sparse).when(row, checked).alias("c"))
    out = []
    for i, (name, kind, values) in enumerate(schema):
        cell = _open(F.get("c", F.lit(i)))
        if kind == "nominal" and codes:
            cell = (F.array_position(F.array(*[F.lit(v) for v in values]), cell) - 1).cast("int")
        elif kind == "integer":
            cell = cell.cast("int")
        elif kind != "nominal":
            cell = cell.cast("double")
        out.append(cell.alias(name))
    return cells.select(*out)


def write_arff(df: DataFrame, path: str, relation: str, nominal: dict[str, list[str]] | None = None) -> None:
    """Header lines, then the rows, as text in one folder; the header is in the first part. Numbers by type, others nominal.

    nominal: the values of columns whose declaration shall not be gathered, numbers too. Names, values and cells are
    quoted where they need it and null is `?`, so read_arff gives the same rows (of integers within 32 bits).
    """
    nominal = nominal or {}
    kinds = {"int": "integer", "bigint": "integer", "smallint": "integer", "double": "real", "float": "real"}
    plain = lambda v: v if re.fullmatch(r"[\w.+:/-]+", v) else _closed(v)
    head = [f"@relation {plain(relation)}"]
    for name, kind in df.dtypes:
        values = nominal.get(name) or ([] if kind in kinds else sorted(r[0] for r in df.select(F.col(f"`{name}`").cast("string")).distinct().limit(1001).collect() if r[0] is not None))
        if len(values) > 1000:
            raise ValueError(f"{name} has over 1000 values; it can't be nominal")
        numeric = not values and kind in kinds
        head.append(f"@attribute {plain(name)} " + (kinds[kind] if numeric else f"{{{','.join(map(plain, values or ['?']))}}}"))
    lines = df.select(F.concat_ws(",", *[_close(F.col(f"`{c}`").cast("string")) for c in df.columns]).alias("value"))
    top = df.sparkSession.createDataFrame([("\n".join([*head, "@data"]),)], "value string").coalesce(1)
    top.unionByName(lines).write.text(path)


def read_pairs_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("user_id long, item_id long, label int").csv(path)


def read_ratings(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """user_id, item_id, rating; the separator may have several characters (`::`, three spaces)."""
    parts = F.split("value", "\\Q" + separator + "\\E")
    return spark.read.text(path).where("trim(value) <> ''").select(*[F.trim(F.get(parts, F.lit(i))).cast(t).alias(n) for i, (n, t) in enumerate((("user_id", "long"), ("item_id", "long"), ("rating", "double")))])


def user_one_hot(people: DataFrame, occupations: list[str]) -> DataFrame:
    """user_id, x: age decades 0-9 (10), sex (1 for M), then the occupations. people: user_id, age, sex, occupation."""
    decade = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.when(F.floor(F.col("age") / 10) == d, 1.0).otherwise(0.0))
    return people.select("user_id", F.concat(decade, F.array(F.when(F.col("sex") == "M", 1.0).otherwise(0.0), *[F.when(F.col("occupation") == o, 1.0).otherwise(0.0) for o in occupations])).alias("x"))


def item_flags(items: DataFrame, genres: list[str]) -> DataFrame:
    """item_id, y: a flag a genre. items: item_id, genres (split at pipes)."""
    held = F.split("genres", "\\|")
    return items.select("item_id", F.array(*[F.coalesce(F.array_contains(held, g), F.lit(False)).cast("double") for g in genres]).alias("y"))


def item_sets(items: DataFrame) -> DataFrame:
    """item_id, genres (distinct, in order); null genres are none."""
    return items.select("item_id", F.array_distinct(F.filter(F.split(F.coalesce("genres", F.lit("")), "\\|"), lambda g: g != "")).alias("genres"))


def save_model(spark: SparkSession, path: str, model_type: str, users: DataFrame, items: DataFrame) -> None:
    """kind, id, vec by model_type; only that type's partition is replaced. users: user_id, s; items: item_id, t."""
    rows = users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("s").alias("vec")).unionByName(items.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("t").alias("vec")))
    rows.withColumn("model_type", F.lit(model_type)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_type").parquet(path)


def load_model(spark: SparkSession, path: str, model_type: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(path).where(F.col("model_type") == model_type)
    return rows.where("kind = 'user'").select(F.col("id").alias("user_id"), F.col("vec").alias("s")), rows.where("kind = 'item'").select(F.col("id").alias("item_id"), F.col("vec").alias("t"))


def refreshed(old: DataFrame, ids: DataFrame, column: str, vec: str, k: int, seed: int = 1, scale: float = 0.1) -> DataFrame:
    """Vectors for exactly these ids: known ones stay, vanished ones go, new ones are drawn (normal, by hash of the id)."""
    from ..functions.scalars import md5_bucket

    unit = lambda j: (md5_bucket(seed, column, F.lit(j)) + 1) / (2.0**32 + 1)
    normal = lambda j: scale * F.sqrt(-2 * F.ln(unit(2 * j))) * F.cos(2 * np.pi * unit(2 * j + 1))
    have = old.join(ids.select(column).distinct(), column, "left_semi")
    new = ids.select(column).distinct().join(old.select(column), column, "left_anti").withColumn(vec, F.array(*[normal(j) for j in range(k)]))
    return have.select(column, vec).unionByName(new)


def write_recommendations(friend: DataFrame, other: DataFrame, path: str, model_type: str, seed: int = 1) -> None:
    """Append both lists interleaved, as many rows a user as the longer list has. friend, other: user_id, item_id, score."""
    from ..operators.recommend import interleaved

    interleaved(friend, other, seed, stop=True).select("user_id", "item_id", "score", F.lit(model_type).alias("type"), F.lit(0).alias("flag"), "place").write.mode("append").parquet(path)


def write_dictionary(counts: DataFrame, path: str) -> None:
    """word<>count lines, most frequent first, then by word. counts: word, n."""
    counts.orderBy(F.desc("n"), "word").select(F.concat_ws("<>", "word", "n").alias("value")).write.text(path)


def read_dictionary(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """word, n; the last <> of a line is the separator. With `most`, the most frequent words, ties by word."""
    line = r"^(.*)<>(\d+)$"
    d = spark.read.text(path).select(F.regexp_extract("value", line, 1).alias("word"), F.regexp_extract("value", line, 2).cast("long").alias("n"))
    return d.orderBy(F.desc("n"), "word").limit(most) if most else d


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A database table, read in ranges of a column where one is given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return r.load()


