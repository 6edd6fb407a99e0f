"""N-gram Jaccard join by MinHash banding.

1. Each text's set of 5-word shingles is hashed. Texts with equal sets form one class, kept as its least document.
2. Each class gets a MinHash signature. Bands and rows are chosen so that a pair at the threshold shares a band with at
   least the target recall while the rows a band asks for keep unlike pairs apart. Classes are grouped by band hash; within
   a group each class is linked to the least only, and the connected components of these links are the candidate sets.
3. Within a candidate set all pairs are verified on the full shingle sets, in blocks of at most BLOCK classes a side, so a
   set of any size is dealt to many tasks. Pairs are counted where they are found; only counts and a spanning set of
   links leave a task, never the pairs.
4. Components of the verified links are the near-duplicate groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .groups import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
BLOCK = 512


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 512) -> tuple[int, int]:
    """The most rows a band, with the bands they need, such that 1-(1-s^rows)^bands >= recall at the threshold within `most` hashes."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def shingles(texts: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """Each text's set of n-word shingles as sorted hashes; of fewer words, but not none, all words make one shingle."""
    words, counts = common.flat_words(texts, common.WORDS)
    values, codes = common.coded(words)
    h = common.hashes(values)[codes] if values else np.zeros(0, np.uint64)
    out, at = [], 0
    for c in counts.tolist():
        own = h[at : at + c]
        at += c
        out.append(np.unique(common.ngram_hashes(own, min(n, c))) if c else np.zeros(0, np.uint64))
    return out


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.xor = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)
        self.mul = rng.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """One hash for each band of the set s (not empty)."""
        x = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for a in range(0, len(x), 1024):
                y = x[a : a + 1024, None] ^ self.xor
                y *= self.mul
                y ^= y >> np.uint32(15)
                y *= np.uint32(0x2C1B3C6D)
                np.minimum(least, y.min(axis=0), out=least)
            h = np.zeros(self.bands, np.uint64)
            for r in range(self.rows):
                h = common.mixed(h * np.uint64(31) + least[r :: self.rows].astype(np.uint64) + np.uint64(1))
        return h


def linked(sets: list[np.ndarray], left: int, threshold: float):
    """Verify the pairs of two blocks on their full sets. left: how many of `sets` are the first block; 0: all pairs of one block.

    Yields (i, j) index arrays of the pairs at the threshold or above. Shingles that only one set holds leave no
    intersection, so only shared ones become matrix columns; columns come in blocks to bound memory.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(everything, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    new = np.cumsum(count > 1) - 1
    column, owner = new[column[keep]], owner[keep]
    common_n = np.zeros((n, n), np.float32)
    width = int((count > 1).sum())
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for a in range(0, width, 8192):
        lo, hi = np.searchsorted(column, [a, a + 8192])
        m = np.zeros((n, min(8192, width - a)), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        common_n += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common_n
    ok = np.triu(common_n >= threshold * union - 1e-6, 1)
    if left:
        ok[:left, :left] = False
        ok[left:, left:] = False
    return np.nonzero(ok)


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, set_id, group_id, n_links, n_texts, text_hash, group_hash.

    set_id: the least id of the documents with the same shingle set; group_id: the least id of its near-duplicate group;
    n_links: how many other rows are at the threshold or above (equal sets included); n_texts: how many other sets are.
    text_hash (xxhash64 of the text) tells rows apart that share an id: rows of one id with unlike texts are documents of
    their own, equal rows are copies; group_hash is that of the group's least (id, hash). Texts without words (null, empty) have no shingles, link to nothing and are groups of
    their own. Null ids are dropped from links and keep their own row. An empty table gives none; other columns are not read.
    """
    spark = docs.sparkSession
    bands, rows = bands_and_rows(threshold, recall)
    common.shared_dir(spark)

    def digest(batches):
        for batch in common.slices(batches, "text"):
            sets = shingles(batch.column(1))
            keys = [_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], ["doc_id", "text_hash", "k1", "k2"])

    def sign(batches):
        hasher = MinHash(bands, rows)
        for batch in common.slices(batches, "text"):
            sets = shingles(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hasher(s).view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "bands"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    ids = common.kept(texts.mapInArrow(common.lean(digest), "doc_id long, text_hash long, k1 long, k2 long"), "shingle-sets")
    has = F.col("k1").isNotNull() & F.col("doc_id").isNotNull()
    # a class is one text: that of its least (id, hash). Its node is that id, but for a second class of an id its key's hash.
    named = ids.where(has).groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("copies")).select("k1", "k2", "least.*", "copies")
    first = named.groupBy("doc_id").agg(F.min("text_hash").alias("first"))
    node = F.when(F.col("text_hash") == F.col("first"), F.col("doc_id")).otherwise(F.xxhash64(F.lit("class"), "k1", "k2"))
    classes = common.kept(named.join(first, "doc_id").select("k1", "k2", F.col("doc_id").alias("set_id"), "text_hash", node.alias("node"), "copies"), "classes")
    heads = classes.select(F.col("set_id").alias("doc_id"), "text_hash", "node", "copies")

    # one text a class moves on; rows that repeat the least id and its text are merged
    reps = texts.join(heads.select("doc_id", "text_hash", "node"), ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"])
    signed = reps.mapInArrow(common.lean(sign), "node long, bands array<long>")
    stars = common.kept(signed.select("node", F.posexplode("bands").alias("band", "h")), "bands")
    least = stars.groupBy("band", "h").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    candidates = components(stars.join(least, ["band", "h"]).where("node <> b").select(F.col("node").alias("a"), "b"))

    candidates = common.kept(candidates, "candidates")
    per = candidates.groupBy("root").agg(F.count("*").alias("n")).select("root", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = candidates.join(per, "root").join(heads, "node").select("doc_id", "text_hash", "node", "root", "blocks", "copies")

    def sets_of(batches):
        for batch in common.slices(batches, "text"):
            sets = shingles(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "root", "blocks", "copies", "shingles"])

    full = texts.join(members, ["doc_id", "text_hash"]).select("node", "text", "root", "blocks", "copies").dropDuplicates(["node"]).mapInArrow(common.lean(sets_of), "doc_id long, root long, blocks int, copies long, shingles binary")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "copies", "shingles")

    def verify(group: pa.Table) -> pa.Table:
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        group = group.sort_by([("own", "ascending"), ("doc_id", "ascending")])
        doc = group.column("doc_id").to_numpy()
        copies = group.column("copies").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
        left = int((group.column("own").to_numpy() == x).sum()) if x != y else 0
        if x != y and left in (0, len(sets)):
            i = j = np.zeros(0, np.int64)
        else:
            i, j = linked(sets, left, threshold)
        links, others = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        np.add.at(others, i, 1)
        np.add.at(others, j, 1)
        root = np.arange(len(doc))
        while len(i):
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            root = root[root]
            if (before == root).all():
                break
        hit = others > 0
        return pa.table({"doc_id": doc[hit], "link": doc[root[hit]], "links": links[hit], "others": others[hit]})

    verified = common.kept(dealt.groupBy("root", "x", "y").applyInArrow(verify, "doc_id long, link long, links long, others long"), "links")
    groups = components(verified.select(F.col("doc_id").alias("a"), F.col("link").alias("b")))
    counts = verified.groupBy(F.col("doc_id").alias("node")).agg(F.sum("links").alias("links"), F.sum("others").alias("others"))
    found = classes.join(counts, "node", "left").join(groups, "node", "left").select("k1", "k2", "set_id", "text_hash", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("others", F.lit(0)).alias("others"), "copies")
    ids_of = found.groupBy("root").agg(F.min(F.struct("set_id", "text_hash")).alias("g")).select("root", F.col("g.set_id").alias("group_id"), F.col("g.text_hash").alias("group_hash"))
    known = found.drop("text_hash").join(ids_of, "root").drop("root")
    own = lambda c: F.when(has, F.col(c)).otherwise(F.col("doc_id"))
    return ids.join(known, ["k1", "k2"], "left").select("doc_id", own("set_id").alias("set_id"), own("group_id").alias("group_id"), F.when(has, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(has, F.col("others")).otherwise(F.lit(0)).cast("long").alias("n_texts"), "text_hash", F.when(has, F.col("group_hash")).otherwise(F.col("text_hash")).alias("group_hash"))


def _key(s: np.ndarray) -> tuple[int | None, int | None]:
    """128 bits of a set; none for the empty set."""
    import xxhash

    if not len(s):
        return None, None
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def query(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents")).select("doc_id", "set_id", "group_id", "n_links", "n_texts")
