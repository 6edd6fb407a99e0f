"""Phrase collocation mining by suffix arrays of word ids.

Texts are cut into pieces and words and gathered into shards, each with word ids of its own. A shard's suffix array is built
by prefix doubling in numpy; runs of suffixes that share n words (LCP intervals) are its n-grams with their counts, which
Spark adds up over all shards by key.

A phrase is frequent only if its parts are. So n-grams are counted first under 64-bit hashes, shortest first, and hashes
that reach the least count set bits of a filter of fixed size; the next pass counts only n-grams whose first and last n - 1
words passed. A filter errs on one side only: it lets a rare n-gram through, never a frequent one out. The last pass counts
what passed under the phrases themselves, so counts are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Text bytes of a shard (or one longer text).
SHARD_BYTES = 24 << 20
#: Bits of the filter of each length, a power of two: 16 MB in each task, whatever the corpus.
FILTER_BITS = 1 << 27
#: Places that are looked up in a filter at once.
STRETCH = 1 << 18
#: Lower-cases A-Z and maps every mark that ends a piece to a new line.
MARKS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Rule:
    """Phrases of 2 to `words` words seen `least` times. A phrase goes if a longer one holds `share` hundredths of its places."""

    words: int = 4
    least: int = 30
    share: int = 80
    top: int = 2000


# --- shards


SHARDS = "lang string, tokens long, words array<binary>, codes binary"


class Shard:
    """Texts of one language as codes: 0 between pieces, else a word's place in `words` plus 1."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = [np.zeros(1, np.int32)]
        self.tokens = self.bytes = 0

    def add(self, texts: list[bytes]) -> None:
        words: list[bytes] = []
        counts: list[int] = []
        for text in texts:
            # split() cuts at blanks and tabs here: the other white space that it knows has become new lines
            for piece in text.translate(MARKS).split(b"\n"):
                if found := piece.split():
                    words += found
                    counts.append(len(found))
            self.bytes += len(text)
        if not words:
            return
        distinct, codes = common.coded(words)
        own = np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in distinct), np.int32, len(distinct))
        out = np.zeros(len(words) + len(counts), np.int32)
        ends = np.cumsum(np.asarray(counts) + 1) - 1
        inside = np.ones(len(out), bool)
        inside[ends] = False
        out[inside] = own[codes]
        self.codes.append(out)
        self.tokens += len(words)

    def row(self, lang: str) -> pa.RecordBatch:
        blob = common.pack_planes(np.concatenate(self.codes))
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([self.tokens], pa.int64()), pa.array([list(self.ids)], pa.list_(pa.binary())), pa.array([blob], pa.binary())], names=["lang", "tokens", "words", "codes"])


def shards_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """The corpus as shards, written to the shared folder. A partition's languages each fill one; all are handed on when they reach SHARD_BYTES."""

    def run(batches):
        held: dict[str, Shard] = {}
        for batch in common.slices(batches, "t", 1 << 20):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts, strict=True):
                by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                held.setdefault(lang, Shard()).add(some)
            if sum(s.bytes for s in held.values()) >= SHARD_BYTES or len(held) > 1000:
                yield from (s.row(lang) for lang, s in held.items())
                held = {}
        yield from (s.row(lang) for lang, s in held.items())

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("l"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return common.kept(rows.mapInArrow(common.lean(run), SHARDS), "shards")


# --- suffix arrays


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of codes in the order of the next `depth` codes (0 beyond the end), by prefix doubling: ranks of 2k codes come from pairs of ranks of k."""
    # the zeros beyond the end are suffixes too, so that ranks there are right
    rank, k = np.concatenate([codes, np.zeros(depth, codes.dtype)]).astype(np.int32), 1
    order = None
    while k < depth or order is None:
        step = min(k, depth - k) if k < depth else 0
        key = rank.astype(np.int64)
        if step:
            key *= int(rank.max(initial=0)) + 1
            key[: len(rank) - step] += rank[step:]
        order = None  # the last one's room is free before the next is made
        order = np.argsort(key)
        key = key[order]
        new = np.zeros(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        del key
        rank[order] = np.cumsum(new, dtype=np.int32)
        k += step or 1
    return order[order < len(codes)]


def lcp(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of the array, how many words (no 0 among them) it shares with the one before, up to depth."""
    out = np.zeros(len(order), np.int8)
    alike = np.zeros(len(order), bool)
    alike[1:] = True
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)])
    for j in range(depth):
        c = padded[order + j]
        alike[1:] &= (c[1:] == c[:-1]) & (c[1:] != 0)
        out += alike
    return out


def intervals(codes: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to depth: a place of each distinct n-gram without a 0, and its count."""
    some = np.flatnonzero(codes)
    if not len(some):
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * depth
    order = suffix_array(codes, depth)
    order = order[codes[order] != 0]
    shared = lcp(codes, order, depth)
    whole = np.ones(len(order), bool)
    padded = np.concatenate([codes, np.zeros(depth, codes.dtype)])
    out = []
    for n in range(1, depth + 1):
        whole &= padded[order + n - 1] != 0
        starts = np.flatnonzero(whole & (shared < n))
        # suffixes of fewer than n words never stand between those that share n
        member = np.cumsum(whole) - 1
        counts = np.diff(np.append(member[starts], int(whole.sum())))
        out.append((order[starts], counts))
    return out


# --- counting


class Filter:
    """A set of hashes as bits; may hold more than was put in, never less."""

    def __init__(self, parts: list[tuple[int, bytes]], bits: int):
        self.bits, self.bytes = bits, np.zeros(bits // 8, np.uint8)
        for at, part in parts:
            b = np.frombuffer(part, np.uint8)[: len(self.bytes) - at]
            self.bytes[at : at + len(b)] = b

    def has(self, h: np.ndarray) -> np.ndarray:
        bit = h.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.bytes[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes by code: 0 for the break."""
    return np.concatenate([np.zeros(1, np.uint64), common.hashes([lang.encode("utf-8", "surrogatepass") + b"\0" + w for w in words])])


def _grams(h: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words at each place of a row of word hashes."""
    with np.errstate(over="ignore"):
        out = np.full(len(places), np.uint64(n))
        for i in range(n):
            out = common.mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(places + i, len(h) - 1)])
    return out


def _masked(codes: np.ndarray, h: np.ndarray, filters: list, upto: int) -> list[np.ndarray]:
    """For n = 1 to upto: whether the n words at each place may be frequent, by the filters of n and of all shorter parts."""
    ok = [codes != 0]
    for n in range(1, upto + 1):
        fine = ok[-1].copy() if n == 1 else ok[-1] & np.append(ok[-1][1:], False)
        # a stretch at a time, as hashes take many times the room of codes
        for a in range(0, len(fine), STRETCH):
            at = a + np.flatnonzero(fine[a : a + STRETCH])
            fine[at] = filters[n - 1].value.has(_grams(h, at, n))
        ok.append(fine)
    return ok[1:]


def _hashed(shards: DataFrame, n: int, filters: list) -> DataFrame:
    """h, c: counts of the n-grams in each shard, by hash, whose parts of n - 1 words passed the filters."""

    def run(batches):
        for batch in batches:
            for lang, _, words, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = common.unpack_planes(blob)[0]
                hashes = _word_hashes(lang, words)
                if n == 1:
                    c = np.bincount(codes, minlength=len(words) + 1)[1:]
                    key = _grams(hashes[1:], np.arange(len(words)), 1)
                else:
                    key, c = _level(codes, hashes, n, filters)
                for i in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(key[i : i + (1 << 16)].view(np.int64)), pa.array(c[i : i + (1 << 16)].astype(np.int64))], names=["h", "c"])

    return shards.mapInArrow(_few(run), "h long, c long")


def _level(codes: np.ndarray, hashes: np.ndarray, n: int, filters: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the n-grams both of whose parts passed."""
    ok = _masked(codes, hashes[codes], filters, n - 1)
    both = ok[-1] & np.append(ok[-1][1:], False)
    kept, where = _kept(codes, ok[0])
    places, counts = intervals(kept, n)[n - 1]
    fine = both[where[places]]
    return _grams(hashes[kept], places[fine], n), counts[fine]


def _kept(codes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes without infrequent words, runs of which become one break, and where they stood."""
    kept = np.where(frequent, codes, 0)
    where = np.flatnonzero((kept != 0) | np.append(True, kept[:-1] != 0))
    return kept[where], where


def _few(run):
    """run for mapInArrow over shards, of which one at a time fits; freed memory goes back after each."""

    def held(batches):
        common.release()
        for batch in batches:
            for i in range(batch.num_rows):
                yield from run([batch.slice(i, 1)])
                common.release()

    return held


def _filter(counts: DataFrame, least: int, bits: int, path: str):
    """The filter of the hashes that reach the least count, in the driver: `bits` bits at most."""
    spark = counts.sparkSession
    frequent = counts.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    marked = frequent.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("part"))
    with common.freeing(spark):
        marked.write.parquet(path)
    parts = [((r.bucket - 1) * 4096, bytes(r.part)) for r in spark.read.schema(marked.schema).parquet(path).collect()]
    common.drop(path, spark)
    return spark.sparkContext.broadcast(Filter(parts, bits))


def counted(docs: DataFrame, rule: Rule = Rule(), text_col: str = "text", lang_col: str = "lang", bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n, f) of every phrase of 1 to rule.words words with f >= rule.least, and (lang, n): all word occurrences.

    A null lang is `und`; a null text is empty. Repeated rows each count. Only the two columns are read. bits: of each filter,
    a power of two from 32,768; fewer bits cost time and shuffle, never results.
    """
    if bits < 1 << 15 or bits & (bits - 1):
        raise ValueError("bits must be a power of two from 32,768")
    spark = docs.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    shards = shards_of(docs, text_col, lang_col)
    try:
        spark.conf.set(rows, "1")
        filters: list = []
        for n in range(1, rule.words):
            filters.append(_filter(_hashed(shards, n, list(filters)), rule.least, bits, common.scratch(spark, "filter")))
        return common.kept(_phrases(shards, rule, filters), "phrases"), shards.groupBy("lang").agg(F.sum("tokens").alias("n"))
    finally:
        spark.conf.set(rows, before)


def _phrases(shards: DataFrame, rule: Rule, filters: list) -> DataFrame:
    """The last pass: phrases that passed, by themselves, from one suffix array a shard, and their sums.

    A shard hands on one row for each bucket of phrases, told apart by hash; a bucket's rows meet in one task, which adds them
    up in columns. There are four buckets for each shuffle partition, so they stay small as both grow with the corpus; no
    phrase makes one large, as it comes once from each shard.
    """
    buckets, least = 4 * common.partitions(shards.sparkSession), rule.least

    def run(batches):
        for batch in batches:
            for lang, _, words, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes, hashes = common.unpack_planes(blob)[0], _word_hashes(lang, words)
                ok = _masked(codes, hashes[codes], filters, rule.words - 1)
                last = ok[-1] & np.append(ok[-1][1:], False)
                kept, where = _kept(codes, ok[0])
                at, spelled, counts = [], [], []
                for n, (places, c) in enumerate(intervals(kept, rule.words), 1):
                    fine = (ok[n - 1] if n < rule.words else last)[where[places]]
                    places = places[fine]
                    at.append((_grams(hashes[kept], places, n) % np.uint64(buckets)).astype(np.int64))
                    counts.append(c[fine])
                    spelled += [b" ".join([words[c - 1] for c in row]) for row in kept[places[:, None] + np.arange(n)].tolist()]
                at, counts = np.concatenate(at), np.concatenate(counts)
                order = np.argsort(at, kind="stable")
                bucket, start = np.unique(at[order], return_index=True)
                offsets = pa.array(np.append(start, len(at)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ([spelled[k] for k in order.tolist()], counts[order].astype(np.int64))] if len(bucket) else [pa.array([], pa.list_(pa.binary())), pa.array([], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array([lang] * len(bucket), pa.string()), *lists], names=["bucket", "lang", "phrases", "counts"])

    def merge(rows: pa.Table) -> pa.Table:
        lists = rows["phrases"].combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(lists))
        langs = rows["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        made = pa.table({"lang": langs, "phrase": lists.flatten(), "f": rows["counts"].combine_chunks().flatten()}).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        made = made.filter(pa.compute.greater_equal(made["f_sum"], least))
        return made.select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])

    made = shards.mapInArrow(_few(run), "bucket int, lang string, phrases array<binary>, counts array<long>")
    summed = made.groupBy("bucket").applyInArrow(merge, "lang string, phrase binary, f long").withColumn("phrase", F.col("phrase").cast("string"))
    return summed.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("n"), "f")


# --- collocations


def mine(docs: DataFrame, rule: Rule = Rule(), text_col: str = "text", lang_col: str = "lang", bits: int = FILTER_BITS) -> DataFrame:
    """Each language's first rule.top phrases: lang, rank, phrase, a, l, r, n, score.

    a: the phrase's count; l and r: the counts of the parts of its lowest-scoring cut (ties: the earliest); score: 2,000,000 a
    by l + r, rounded down; n: the language's words. Order: score and a descending, phrase ascending in bytes. Phrases that
    lie in a longer candidate with at least rule.share hundredths of their count are left out. Fewer are all returned; an
    empty table, or one without frequent phrases, gives no row. Nulls, repeats and other columns: see counted().
    """
    known, totals = counted(docs, rule, text_col, lang_col, bits)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    words = F.split("phrase", " ")
    some = known.where("n > 1").withColumn("w", words)
    join = lambda a, size: F.array_join(F.slice("w", a, size), " ")
    cut = some.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", join(F.lit(1), F.col("k")).alias("head"), join(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    parts = known.select("lang", F.col("phrase").alias("part"), "f")
    cut = cut.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cut = cut.withColumn("l38", wide("l")).withColumn("r38", wide("r")).withColumn("a38", wide("a")).withColumn("score", F.expr("(2000000 * a38) div (l38 + r38)").cast("long"))
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    # every part of two or more words that a longer candidate holds, with the largest count of one that does
    held = some.where("n > 2").select("lang", "f", "w", "n", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size"))
    held = held.select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at")).select("lang", join(F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = lowest.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < rule.share * wide("a")))
    # the first of each part of a language, then the first of those: no task sorts a whole language
    rank = lambda *by: F.row_number().over(Window.partitionBy("lang", *by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    left = left.select("lang", "phrase", "a", "low.l", "low.r", "low.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(common.partitions(docs.sparkSession))))
    top = left.withColumn("rank", rank("part")).where(F.col("rank") <= rule.top).withColumn("rank", rank()).where(F.col("rank") <= rule.top)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(common.table(spark, sf_dir, "documents"))
