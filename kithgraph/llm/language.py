"""Language ID by rank-order profiles.

Words are runs of letters (Unicode's L classes) of the lower-cased text, framed by `_`; their 1- to 3-grams are counted over
the whole text. A text's GRAMS most frequent n-grams, in order, are compared to each language's by the out-of-place
distance: the difference in rank, or GRAMS where the profile lacks the n-gram. Ties in frequency go by a hash of the n-gram,
in texts and profiles alike, ties of languages by name.

An n-gram is a number: its code points in 21 bits each, so all n-grams of a slice of texts are made and counted at once.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

GRAMS, LONGEST = 300, 3
#: About how many labelled texts of a language its profile is counted from (a bounded sample, chosen by hash).
SAMPLE = 3000
FRAME = ord("_")
#: Languages whose sizes are broadcast.
MOST_SENT = 10_000


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def number(gram: str) -> int:
    """The n-gram as a number: its code points in 21 bits each, the first in the lowest."""
    return sum(ord(c) << (21 * i) for i, c in enumerate(gram))


def spelled(gram: int) -> str:
    return "".join(chr(c) for i in range(LONGEST) if (c := gram >> (21 * i) & 0x1FFFFF))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all n-grams, text by text, and where each text's end."""
    code = np.frombuffer(("\0".join(t or "" for t in texts).lower() + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letters()[code]
    framed = np.where(inside, code, FRAME).astype(np.uint64)
    at = np.flatnonzero(inside)
    before = np.where(at > 0, framed[at - 1], np.uint64(FRAME))
    here, after = framed[at], framed[at + 1]  # the last code point is no letter
    pair = here | after << np.uint64(21)
    last = ~inside[at + 1]
    # of each letter: itself, the pair that it ends, the triple around it, and of a word's last letter the pair that it begins
    size = 3 + last
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    begin = ends - size
    out[begin], out[begin + 1], out[begin + 2] = here, before | here << np.uint64(21), before | pair << np.uint64(21)
    out[begin[last] + 3] = pair[last]
    parted = np.flatnonzero(code == 0)
    if len(parted) != len(texts):  # texts that hold \0 themselves
        parted = np.cumsum([len((t or "").lower()) + 1 for t in texts]) - 1
    n = np.searchsorted(at, parted)
    return out, np.concatenate([[0], ends])[n]


def counted(all_grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams and how often each occurs."""
    x = np.sort(all_grams)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(first, append=len(x))


def ranked(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The GRAMS most frequent, in order."""
    if len(n) > GRAMS:
        most = n >= np.partition(n, len(n) - GRAMS)[len(n) - GRAMS]
        found, n = found[most], n[most]
    return found[np.lexsort((common.mixed(found), -n))[:GRAMS]]


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> dict[str, list[str]]:
    """Each language's GRAMS most frequent n-grams in order, from a hash sample of about `sample` of its texts.

    Rows that repeat count each time if they are chosen; null texts and languages teach nothing. Languages are as many as
    the column has values; their sizes are broadcast up to MOST_SENT, else joined.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).bitwiseAND((1 << 20) - 1).alias("__bucket"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("__size"))
    few = sizes.limit(MOST_SENT + 1).collect()
    sent = F.broadcast(rows.sparkSession.createDataFrame(few, sizes.schema)) if len(few) <= MOST_SENT else sizes
    chosen = rows.join(sent, "lang").where(F.col("__bucket") <= (F.least(F.lit(1.0), sample / F.col("__size")) * (1 << 20)).cast("long"))

    def run(batches):
        for batch in common.slices(batches, "text", 1 << 18):
            every, ends = grams(batch.column(0).to_pylist())
            of: dict = {}
            for lang, a, b in zip(batch.column(1).to_pylist(), [0, *ends.tolist()], ends.tolist(), strict=False):
                of.setdefault(lang, []).append(every[a:b])
            for lang, parts in of.items():
                found, n = counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    summed = chosen.select("text", "lang").mapInArrow(common.lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # all n-grams of a rank come back, the few at the last one too many
    top = summed.withColumn("k", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("n")))).where(F.col("k") <= GRAMS)
    out: dict[str, list] = {}
    for r in top.collect():
        out.setdefault(r.lang, []).append((r.gram, r.n))
    tops = {lang: ranked(np.array([g for g, _ in v], np.uint64), np.array([n for _, n in v], np.int64)) for lang, v in sorted(out.items())}
    return {lang: [spelled(g) for g in v.tolist()] for lang, v in tops.items()}


def predict(docs: DataFrame, profile: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns to `keep` for every row; repeated rows each give one, other columns are not read.

    A null text or one without letters, or no profiles: `und`, score 0; an empty table gives none. Languages at equal
    distance: the first by name. score: 1 less the distance over its greatest possible value. Long texts are read whole, in
    slices of documents.
    """
    langs = list(profile)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)])

    def run(batches):
        known = np.unique(np.array([number(g) for v in profile.values() for g in v], np.uint64))
        ranks = np.full((len(langs), len(known) + 1), -1, np.int64)  # the last column: n-grams of no profile
        for a, lang in enumerate(langs):
            ranks[a, np.searchsorted(known, np.array([number(g) for g in profile[lang]], np.uint64))] = np.arange(len(profile[lang]))
        places = np.arange(GRAMS)
        for batch in common.slices(batches, "text", 1 << 18):
            names, scores = [], []
            every, ends = grams(batch.column(1).to_pylist())
            for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                if a == b or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                top = ranked(*counted(every[a:b]))
                k = np.minimum(np.searchsorted(known, top), len(known) - 1)
                r = ranks[:, np.where(known[k] == top, k, len(known))]
                d = np.where(r < 0, GRAMS, np.abs(r - places[: len(top)])).sum(axis=1)
                best = int(d.argmin())
                names.append(langs[best])
                scores.append(1.0 - float(d[best]) / (GRAMS * len(top)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]], ["doc_id", "lang_pred", "score", *batch.schema.names[2:]])

    kept = "".join(f", __keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    found = rows.mapInArrow(common.lean(run), f"doc_id long, lang_pred string, score double{kept}")
    return found.select("doc_id", "lang_pred", "score", *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)])


def learned(docs: DataFrame) -> dict[str, list[str]]:
    return profiles(docs.where(common.remainder("doc_id", 5) != 0))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, learned(docs)).withColumn("held_out", common.remainder("doc_id", 5) == 0)
