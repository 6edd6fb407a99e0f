"""Benchmark decontamination by winnowing.

Both sides are cut into words and their 5-grams hashed; of every 6 consecutive hashes the least (the right-most of equal
ones) is a fingerprint. Two texts that share 10 consecutive words share a whole window of 6 hashes and so a fingerprint:
no such span is missed. A shared fingerprint is extended to the 10-word windows around it, which are compared word by word.
Items of fewer than 10 words are one window each and are looked up by their own length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM, AHEAD, WINDOW = 5, 6, 10
#: Stands between texts; a word hashes to it with probability 2**-64.
BREAK = np.uint64(0x5F3A9C1D77E01B2D)
#: UTF-8 bytes of benchmark text in one broadcast block. Larger benchmarks are searched block by block.
BLOCK_BYTES = 16 << 20


def winnow(grams: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the right-most least hash of each AHEAD consecutive ones; of fewer, none."""
    if len(grams) < AHEAD:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], AHEAD)
    return np.unique(len(grams) - 1 - (np.arange(len(view)) + view.argmin(axis=1)))


class Index:
    """The windows of a block of items. ids: each item's id as a string, None where it has none."""

    def __init__(self, ids: list[str | None], texts: list[str | None]):
        self.ids, held, places = ids, [], {}
        at = 0
        for item, text in enumerate(texts):
            h = common.hashes((text or "").encode("utf-8", "surrogatepass").translate(common.WORDS).split())
            if len(h):
                n = min(WINDOW, len(h))
                places.setdefault(n, []).append((np.arange(at, at + len(h) - n + 1), np.full(len(h) - n + 1, item)))
                held += [h, np.array([BREAK])]
                at += len(h) + 1
        self.words = np.concatenate(held) if held else np.zeros(0, np.uint64)
        self.marks = np.unique(g[winnow(g)]) if len(g := common.ngram_hashes(self.words, GRAM)) else np.zeros(0, np.uint64)
        self.windows = {}
        for n, found in places.items():
            where, item = (np.concatenate(x) for x in zip(*found, strict=True))
            key = common.ngram_hashes(self.words, n)[where]
            order = np.lexsort((item, key))
            key, where, item = key[order], where[order], item[order]
            unique, first, count = np.unique(key, return_index=True, return_counts=True)
            self.windows[n] = (unique, where[first], first, count, item)

    def hits(self, words: np.ndarray):
        """For each window length: places in words where a window begins, with the rows (first, count) of its items."""
        for n, (keys, where, first, count, item) in self.windows.items():
            if len(words) < n:
                continue
            if n == WINDOW:
                grams = common.ngram_hashes(words, GRAM)
                at = winnow(grams)
                at = at[_among(grams[at], self.marks)[0]]
                if not len(at):
                    continue
                at = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                at = at[(at >= 0) & (at <= len(words) - n)]
                with np.errstate(over="ignore"):
                    h = np.zeros(len(at), np.uint64)
                    for i in range(n):
                        h = h * np.uint64(0x9E3779B97F4A7C15) + words[at + i]
                got, k = _among(common.mixed(h), keys)
            else:
                at = np.arange(len(words) - n + 1)
                got, k = _among(common.ngram_hashes(words, n), keys)
            at, k = at[got], k[got]
            same = (words[at[:, None] + np.arange(n)] == self.words[where[k][:, None] + np.arange(n)]).all(axis=1)
            yield n, at[same], first[k[same]], count[k[same]], item


def _among(x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    k = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[k] == x, k


OUT = "doc_id long, n_words long, n_hit long, n_items long, items string, items_sha256 string, hit_words array<long>"


def match(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row of docs: its words, how many lie in a benchmark window, the items found (ids sorted as strings) and the word places hit.

    A null or wordless text has no words and no hits. Items without words never occur; items that repeat count once by id,
    items without an id mark words but are not listed. An empty benchmark hits nothing. Repeated rows each give one. The
    columns to `keep` follow; others are not read.
    The benchmark goes to the executors in blocks of at most BLOCK_BYTES (or one item); each text meets every block in turn.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    blocks = []
    for b in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b).collect()
        blocks.append(spark.sparkContext.broadcast(([r.i for r in part], [r.t for r in part])))

    def run(batches):
        indexes: dict = {}
        for batch in common.slices(batches, "text"):
            words, counts = common.flat_words(batch.column(1), common.WORDS)
            values, codes = common.coded(words)
            # a BREAK after each text keeps windows inside texts
            at = np.cumsum(counts + 1)
            h = np.full(int(at[-1]), BREAK)
            inside = np.ones(len(h), bool)
            inside[at - 1] = False
            if values:
                h[inside] = common.hashes(values)[codes]
            change, found = np.zeros(len(h) + 1, np.int64), {}
            for b, block in enumerate(blocks):
                if b not in indexes:
                    if len(indexes) >= 4:
                        indexes.clear()
                    indexes[b] = Index(*block.value)
                index = indexes[b]
                for n, start, first, count, item in index.hits(h):
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n, -1)
                    doc = np.searchsorted(at, start, side="right")
                    pairs = np.unique(np.stack([np.repeat(doc, count), item[common.ranges(first, count)]]), axis=1)
                    for d, i in pairs.T.tolist():
                        if index.ids[i] is not None:
                            found.setdefault(d, set()).add(index.ids[i])
            hit = np.cumsum(change[:-1]) > 0
            begins = at - counts - 1
            n_hit = np.add.reduceat(hit, begins, dtype=np.int64)
            listed = [",".join(sorted(found.get(d, ()))) for d in range(len(counts))]
            places = [np.flatnonzero(hit[b : b + c]).tolist() if k else [] for b, c, k in zip(begins.tolist(), counts.tolist(), n_hit.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(n_hit, pa.int64()), pa.array([len(found.get(d, ())) for d in range(len(counts))], pa.int64()), pa.array(listed), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]), pa.array(places, pa.list_(pa.int64())), *batch.columns[2:]],
                ["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "hit_words", *batch.schema.names[2:]],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)])
    kept = "".join(f", __keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    found = rows.mapInArrow(common.lean(run), OUT + kept)
    return found.select(*[c.split()[0] for c in OUT.split(", ")], *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)])


def query(spark, sf_dir: str) -> DataFrame:
    found = match(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
