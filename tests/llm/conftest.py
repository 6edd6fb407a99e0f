import random

import pytest

SYLLABLES = "an ber cor dil em fos gra hin jol ke lum nor pas qui ros tum vel".split()


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def rows():
    """doc_id, text, lang, source, n_chars with nulls, empties, repeats, copies, near copies, secrets and a very long text."""
    rng = random.Random(5)
    out = []
    for i in range(60):
        out.append((i, " ".join(words(rng, rng.randint(1, 120))).capitalize() + ".", ("en", "xx")[i % 2], f"src{i % 3}", 0))
    base = words(rng, 150)
    for i in range(60, 75):
        near = list(base)
        near[rng.randrange(150)] = f"changed{i}"
        out.append((i, " ".join(near), "en", "src0", 0))
    out += [(i, " ".join(base), None, None, None) for i in range(75, 80)]
    out += [(80, None, "en", "a", 1), (81, "", "en", "a", 0), (82, " \n\t ", None, "a", 3), (83, "12 34 !!", "en", "a", 8), (84, "12 34 !!", "en", "a", 8)]
    out.append((85, " ".join(words(rng, 20_000)), "en", "a", 0))
    out.append((86, 'password="abc123def456" token: short AKIA' + "A1" * 9 + " " + "deadbeef" * 4 + " api_key=xyzabcd passwd=token=qwertyu", "en", "a", 0))
    out.append((87, "É́tude l'été 日本語 🙂 Don't STOP a\x1cb\x85c　d  two  spaces \n\n end ", "fr", "a", 0))
    out.append((88, "x" * 500 + " " + "ab" * 300, "en", "a", 0))
    return out


BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()


@pytest.fixture(scope="session")
def raw():
    rng = random.Random(9)
    out = rows()
    out += [(90, " ".join(words(rng, 20) + BENCH + words(rng, 20)), "en", "b", 0), (91, " ".join(BENCH[:9]), "en", "b", 0), (92, " ".join(BENCH[1:11]).upper(), "en", "b", 0), (93, "short, Item here", "en", "b", 0)]
    return out


@pytest.fixture(scope="session")
def docs(spark, raw):
    """With extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(raw, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("digest", "found", "bucket", "slice", "k1", "score", "train", "h", "shard"):
        d = d.withColumn(c, F.lit("clash"))
    return d.repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(BENCH)), (2, "short item here"), (3, None), (4, ""), (1, " ".join(BENCH)), (None, "never seen at all")], "item_id long, text string")
