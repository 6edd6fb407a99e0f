"""Language detection by letter trigrams: profiles are a table, texts score by a join and an aggregate, failure is a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters that a task looks at in one go.
LETTERS = 1 << 20
#: What is no letter: ASCII other than a-z.
OTHER = r"[\x00-\x60\x7B-\x7F]+"
GRAM, MOST = 3, 300


def cleaned(text: Column) -> Column:
    """Lower-cased, one blank for every stretch that is no letter, a blank at either end; blank for a null."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), OTHER, " ")), F.lit(" "))


def _numbers(texts):
    """Every trigram of the texts as one number, text by text, and how many each text has."""
    import numpy as np

    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(points) < GRAM:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    every = points[: 1 - GRAM]
    for k in range(1, GRAM):
        every = (every << 21) | points[k : len(points) - GRAM + 1 + k]
    counts, ends = np.maximum(sizes - GRAM + 1, 0), np.cumsum(sizes)
    # those that run into the next text go
    inside = np.ones(len(points), bool)
    for k in range(1, GRAM):
        inside[ends[sizes >= k] - k] = False
    return every[inside[: len(every)]], counts


def _word(number: int) -> str:
    return "".join(chr((number >> (21 * k)) & 0x1FFFFF) for k in reversed(range(GRAM)))


def _parts(batch):
    """A batch in parts of about LETTERS letters, one text at least: the part and its texts."""
    texts, start, held = batch.column(batch.num_columns - 1).to_pylist(), 0, 0
    for k, text in enumerate(texts):
        if held and held + len(text) > LETTERS:
            yield batch.slice(start, k - start), texts[start:k]
            start, held = k, 0
        held += len(text)
    if texts:
        yield batch.slice(start), texts[start:]


def _count(batches):
    """lang, text in; lang, gram, n out, added up by part."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part, texts in _parts(batch):
            langs = part.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                found, n = np.unique(_numbers([t for t, of in zip(texts, langs, strict=True) if of == lang])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(map(_word, found.tolist()), pa.string()), pa.array(n)], ["lang", "gram", "n"])


def _share(known_b):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = {}
        for lang, gram, share in known_b.value:
            known.setdefault(lang, []).append((int(_numbers([gram])[0][0]), share))
        tables = []
        for lang, rows in known.items():
            rows.sort()
            tables.append((lang, np.array([r[0] for r in rows]), np.array([r[1] for r in rows])))
        for batch in batches:
            for part, texts in _parts(batch):
                every, counts = _numbers(texts)
                of = np.repeat(np.arange(len(texts)), counts)
                for lang, grams, shares in tables:
                    at = np.minimum(np.searchsorted(grams, every), len(grams) - 1)
                    hit = grams[at] == every
                    n = np.bincount(of[hit], minlength=len(texts))
                    score = np.bincount(of[hit], shares[at[hit]], minlength=len(texts))
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array([lang] * len(some), pa.string()), pa.array(score[some])], ["key", "lang", "score"])

    return run


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST) -> DataFrame:
    """lang, gram, share: each language's `most` most frequent trigrams (ties: the lesser gram) and, of the gram's relative
    frequencies in all profiles, the language's share. At most `most` rows a language. Rows without a language are left out.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), cleaned(F.col(text)).alias("text"))
    counted = rows.mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    # the first of each part of a language, then of those: a language's grams are never sorted in one task
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("n"), "gram"))
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = counted.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts))).withColumn("r", rank("part")).where(F.col("r") <= most).withColumn("r", rank()).where(F.col("r") <= most)
    p = top.join(total, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("p"))
    return p.select("lang", "gram", (F.col("p") / F.sum("p").over(Window.partitionBy("gram"))).alias("share"))


def probabilities(texts: DataFrame, known: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, lang, p: of each text, each language's part of the shares of the trigrams found in any profile; only languages with one.

    The profiles (a few hundred rows a language) go to every task, which adds up a text's shares and sends on a row a language.
    A key is a text: repeated keys are pooled. Texts without a known trigram have no row.
    """
    held = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in known.select("lang", "gram", "share").collect()])
    rows = texts.select(F.col(key).alias("key"), cleaned(F.col(text)).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    hit = rows.mapInArrow(_share(held), f"key {kind}, lang string, score double").groupBy(F.col("key").alias(key), "lang").agg(F.sum("score").alias("score"))
    return hit.select(key, "lang", (F.col("score") / F.sum("score").over(Window.partitionBy(key))).alias("p"))


def detect(texts: DataFrame, known: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, lang, p for every key of texts: the likeliest language (ties after 9 places: the lesser name), null where none is found."""
    best = probabilities(texts, known, key, text).groupBy(key).agg(F.max_by(F.struct("lang", "p"), F.struct(F.round("p", 9), F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))).alias("b"))
    return texts.select(key).distinct().join(best, key, "left").select(key, "b.lang", "b.p")


def english_pairs(rows: DataFrame, known: DataFrame, key: str, one: str, two: str, lang: str = "en") -> DataFrame:
    """Rows of which both texts are found to be in the language. A text that is empty or not detected fails, and so do two empty ones."""
    both = rows.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("text")) for i, c in enumerate((one, two))])).alias("x")).select(F.struct(F.col(key).alias("key"), F.col("x.side").alias("side")).alias("at"), "x.text")
    good = detect(both, known, "at").where(F.col("lang") == lang).groupBy(F.col("at.key").alias(key)).agg(F.count("*").alias("__n")).where("__n = 2").select(key)
    return rows.join(good, key, "left_semi")


def keep(rows: DataFrame, known: DataFrame, key: str, text: str = "text", lang: str = "en") -> DataFrame:
    """Rows found to be in the language, and those of unknown language unless they begin with `http:`."""
    found = detect(rows, known, key, text).select(key, F.col("lang").alias("__lang"))
    return rows.join(found, key).where((F.col("__lang") == lang) | (F.col("__lang").isNull() & ~F.coalesce(F.startswith(F.col(text), F.lit("http:")), F.lit(False)))).drop("__lang")
