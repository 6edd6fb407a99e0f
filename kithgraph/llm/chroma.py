"""Media columns: chroma audio fingerprints and their alignment.

A recording is a binary column of 8-bit PCM. Frames of FRAME samples every HOP are taken to the energy of the 12 pitch
classes, each frame to unit length. Sixteen filters over an integral image of WIDTH frames compare areas of that image; two
bits each (Gray coded) make one packed 32-bit integer a frame. Two recordings are aligned by the histogram of offsets
between equal integers, every occurrence of each; the bit error of the matching run at each well-voted offset decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A recording of FRAME + (WIDTH - 1) * HOP = 704 bytes fills one integer, each HOP more gives another.
RATE, FRAME, HOP, WIDTH = 8000, 512, 64, 4
#: An aligned pair: a run of at least OVERLAP integers at one offset with at most this bit error, at least VOTES of them equal (or as
#: many as the shorter recording has).
ERROR, OVERLAP, VOTES = 0.3, 12, 3
#: Bytes of query fingerprints in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Equal pairs expanded at once; an integer that makes more of them by itself is counted by correlation.
PAIRS = 1 << 20


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the 16 filters, by rule: every kind at growing sizes."""
    return [(i % 6, (5 * i) % 8, 3 + i % 3 * (4 - (5 * i) % 8 // 4) // 2 + 1, (2, 3, 4)[i // 6]) for i in range(16)]


LIMITS = np.log([0.8, 1.0, 1.25])
GRAY = np.array([0, 1, 3, 2], np.uint32)


def _pitch_classes() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), np.float32)
    use = (hz >= 60) & (hz <= 3600)
    out[np.flatnonzero(use), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return out


PITCH = _pitch_classes()
SHAPE = np.hanning(FRAME).astype(np.float32)


def chroma(pcm: bytes) -> np.ndarray:
    """Frames x 12. A recording shorter than a frame is padded to one; an empty one has none."""
    x = np.frombuffer(pcm, np.uint8)
    if not len(x):
        return np.zeros((0, 12), np.float32)
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)), constant_values=128)
    views = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = []
    for a in range(0, len(views), 2048):
        part = views[a : a + 2048].astype(np.float32) - 128
        part -= part.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(part * SHAPE, axis=1)).astype(np.float32) ** 2
        c = power @ PITCH
        out.append(c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-9))
    return np.concatenate(out)


def fingerprint(pcm: bytes) -> np.ndarray:
    """One uint32 for each WIDTH consecutive frames (fewer frames are padded with silence to one integer)."""
    c = chroma(pcm)
    if not len(c):
        return np.zeros(0, np.uint32)
    if len(c) < WIDTH:
        c = np.pad(c, ((0, WIDTH - len(c)), (0, 0)))
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = c.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    n = len(c) - WIDTH + 1
    at = np.arange(n)

    def area(t: int, y: int, frames: int, classes: int) -> np.ndarray:
        return image[at + t + frames, y + classes] - image[at + t, y + classes] - image[at + t + frames, y] + image[at + t, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        h = min(h, 12 - y)
        whole = area(0, y, w, h)
        if kind == 0:  # the area against the rest of its frames
            a, b = whole * (12 - h) / h, area(0, 0, w, 12) - whole
        elif kind == 1:  # lower against upper pitch classes
            a = area(0, y, w, h // 2) * (h - h // 2) / (h // 2)
            b = whole - area(0, y, w, h // 2)
        elif kind == 2:  # earlier against later
            a = area(0, y, w // 2, h)
            b = whole - a
        elif kind == 3:  # crossed quarters
            a = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            b = whole - a
        elif kind == 4:  # the middle pitch classes
            a = area(0, y + h // 3, w, max(1, h // 3)) * (h / max(1, h // 3) - 1)
            b = whole - area(0, y + h // 3, w, max(1, h // 3))
        else:  # the middle frames
            a = area(w // 4, y, w // 2, h)
            b = whole - a
        v = np.log((1e-3 + np.maximum(a, 0)) / (1e-3 + np.maximum(b, 0)))
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(LIMITS, v)]
    return out


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of unlike bits where a[i] meets b[i + offset], and how many integers meet."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 1.0, 0
    return float(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()) / (32 * (hi - lo)), hi - lo


def matching_run(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int, float] | None:
    """(equal integers, length, bit error) of the run of a against b at an offset, or None.

    The run is the stretch of at least OVERLAP integers that gains most, where each integer gains ERROR less its bit error; what
    differs around a shared passage loses and stays outside. A run with too few equal integers is cut out and both sides are tried.
    """
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    short = min(len(a), len(b))
    least, votes = min(OVERLAP, short), min(VOTES, short)
    if hi - lo < least:
        return None
    wrong = np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).astype(np.int64)
    gain = np.concatenate([[0], np.cumsum(round(320 * ERROR) - 10 * wrong)])
    equal = np.concatenate([[0], np.cumsum(wrong == 0)])
    todo = [(0, hi - lo)]
    while todo:
        i, j = todo.pop()
        if j - i < least or equal[j] - equal[i] < votes:
            continue
        low = np.minimum.accumulate(gain[i : j - least + 1])
        rise = gain[i + least : j + 1] - low
        k = int(rise.argmax())
        if rise[k] < 0:
            continue
        begin, end = i + int(gain[i : i + k + 1].argmin()), i + k + least
        if equal[end] - equal[begin] >= votes:
            return int(equal[end] - equal[begin]), end - begin, float(wrong[begin:end].sum()) / (32 * (end - begin))
        todo += [(i, begin), (end, j)]
    return None


class Queries:
    """A block of query fingerprints, by integer. Every occurrence of an integer votes."""

    def __init__(self, ids: list[int], prints: list[bytes]):
        self.ids, self.prints = ids, [np.frombuffer(p, np.uint32) for p in prints]
        self.sizes = np.array([len(p) for p in self.prints], np.int64)
        value = np.concatenate(self.prints) if self.prints else np.zeros(0, np.uint32)
        order = np.argsort(value, kind="stable")
        self.owner = np.repeat(np.arange(len(self.prints), dtype=np.int32), self.sizes)[order]
        self.place = common.ranges(np.zeros(len(self.prints), np.int64), self.sizes).astype(np.int32)[order]
        self.values, self.first, self.count = np.unique(value[order], return_index=True, return_counts=True)

    def votes(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, offset, equal integers) of each query and offset where p and the query have any."""
        none = np.zeros(0, np.int64)
        if not len(self.values) or not len(p):
            return none, none, none
        k = np.minimum(np.searchsorted(self.values, p), len(self.values) - 1)
        at = np.flatnonzero(self.values[k] == p)
        k = k[at]
        kinds, which, own = np.unique(k, return_inverse=True, return_counts=True)
        heavy = own * self.count[kinds] > PAIRS
        span = 1 << 32
        found, counts = [none], [none]

        def add(key: np.ndarray, n: np.ndarray) -> None:
            found.append(key)
            counts.append(n)

        for v in np.flatnonzero(heavy).tolist():
            rows = slice(self.first[kinds[v]], self.first[kinds[v]] + self.count[kinds[v]])
            owner, place = self.owner[rows], self.place[rows]
            mine = np.zeros(len(p))
            mine[at[which == v]] = 1
            for q, a, n in zip(*np.unique(owner, return_index=True, return_counts=True), strict=True):
                size = int(self.sizes[q])
                other = np.zeros(size)
                other[size - 1 - place[a : a + n]] = 1
                width = 1 << int(len(p) + size - 1).bit_length()
                hist = np.rint(np.fft.irfft(np.fft.rfft(mine, width) * np.fft.rfft(other, width), width)[: len(p) + size - 1]).astype(np.int64)
                o = np.flatnonzero(hist)
                add(int(q) * span + (o - (size - 1)) + (span >> 1), hist[o])
        light = ~heavy[which]
        k, at = k[light], at[light]
        part = np.cumsum(self.count[k]) // PAIRS
        for c in np.unique(part).tolist():
            i, j = np.searchsorted(part, [c, c + 1])
            rows = common.ranges(self.first[k[i:j]], self.count[k[i:j]])
            offset = np.repeat(at[i:j], self.count[k[i:j]]) - self.place[rows]
            add(*np.unique(self.owner[rows].astype(np.int64) * span + offset + (span >> 1), return_counts=True))
        key, back = np.unique(np.concatenate(found), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64)
        return key // span, key % span - (span >> 1), n

    def align(self, p: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(query, offset of p against it, votes, bit error) of each query that is aligned with p.

        Offsets are tried from the most votes on (ties: the nearest to 0) and the first with a matching run is given, with the
        run's equal integers and bit error.
        """
        who, offset, n = self.votes(p)
        use = n >= np.minimum(VOTES, np.minimum(len(p), self.sizes[who]))
        who, offset, n = who[use], offset[use], n[use]
        out, done = [], -1
        for i in np.lexsort((offset, np.abs(offset), -n, who)).tolist():
            q, o = int(who[i]), int(offset[i])
            if q != done and (run := matching_run(self.prints[q], p, o)):
                out.append((q, o, run[0], run[2]))
                done = q
        return out


LINKS = "array<struct<query: bigint, offset: bigint, votes: bigint, bit_error: double>>"


def search(recordings: DataFrame, is_query, id_col: str, pcm_col: str) -> DataFrame:
    """One row for each recording: doc_id, class_id, n_prints, n_queries, best_query, best_offset, votes, bit_error, links.

    Recordings with equal fingerprints are one class (class_id: its least id) and are aligned once; an id may hold several
    recordings, each in a class of its own, and asks with each of them. n_queries counts the
    query classes aligned with the recording, its own copies' query included, itself not; best_query is the one of least
    bit error (ties: least id), null if none. links are all of them: (query, offset, votes, bit_error), the best first. Null and empty recordings have no prints and align with nothing. Queries go
    to the tasks in blocks of at most BLOCK_BYTES; every recording meets every block.
    """
    spark = recordings.sparkSession

    def prints(batches):
        from .jaccard import _key

        for batch in common.slices(batches, "pcm"):
            made = [fingerprint(x or b"") for x in batch.column(1).to_pylist()]
            keys = [_key(p) for p in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(p) for p in made], pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([p.tobytes() for p in made], pa.binary())], ["doc_id", "q", "n_prints", "k1", "k2", "prints"])

    rows = recordings.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pcm_col).cast("binary").alias("pcm"), is_query.alias("q"))
    made = common.kept(rows.mapInArrow(common.lean(prints), "doc_id long, q boolean, n_prints int, k1 long, k2 long, prints binary"), "chroma")
    classes = made.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.min(F.when(F.col("q"), F.col("doc_id"))).alias("query_id"))
    held = common.kept(made.select("doc_id", F.col("k1").alias("p1"), F.col("k2").alias("p2"), "prints").join(classes, (F.col("doc_id") == F.col("class_id")) & (F.col("p1") == F.col("k1")) & (F.col("p2") == F.col("k2"))).select("class_id", "query_id", "k1", "k2", "prints").dropDuplicates(["k1", "k2"]), "chroma-classes")
    asked = held.where("query_id is not null")
    total = asked.agg(F.sum(F.length("prints"))).first()[0] or 0
    n_blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    blocks = []
    for b in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b).orderBy("query_id", "k1", "k2").select("query_id", "prints", "k1", "k2").collect()
        blocks.append(spark.sparkContext.broadcast(([r[0] for r in part], [bytes(r[1]) for r in part], [(r[2], r[3]) for r in part])))

    link = pa.list_(pa.struct([("query", pa.int64()), ("offset", pa.int64()), ("votes", pa.int64()), ("bit_error", pa.float64())]))

    def align(batches):
        made_of: dict = {}
        for batch in common.slices(batches, "prints", BLOCK_BYTES):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            prints = [np.frombuffer(raw, np.uint32) for raw in batch.column(2).to_pylist()]
            found: list[list] = [[] for _ in prints]
            # all recordings of a slice meet one block before the next is made
            for b, block in enumerate(blocks):
                ids, raw, classes_of = block.value
                if b not in made_of:
                    if len(made_of) >= 4:
                        made_of.clear()
                    made_of[b] = Queries(ids, raw)
                for own, p, out in zip(keys, prints, found, strict=True):
                    out += [(e, ids[q], o, n) for q, o, n, e in made_of[b].align(p) if classes_of[q] != own]
            links = [[{"query": q, "offset": o, "votes": n, "bit_error": e} for e, q, o, n in sorted(out)] for out in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(links, link)], ["k1", "k2", "found"])

    found = held.select("k1", "k2", "prints").repartition(common.partitions(spark)).mapInArrow(common.lean(align), f"k1 long, k2 long, found {LINKS}")
    known = held.select("class_id", "query_id", "k1", "k2").join(found, ["k1", "k2"])
    copy = F.col("query_id").isNotNull() & (F.col("query_id") != F.col("doc_id"))
    own = F.struct(F.col("query_id").alias("query"), F.lit(0).cast("long").alias("offset"), F.col("n_prints").cast("long").alias("votes"), F.lit(0.0).alias("bit_error"))
    links = F.coalesce("found", F.array().cast(LINKS))
    rows = made.select("doc_id", "n_prints", "k1", "k2").join(known, ["k1", "k2"], "left").withColumn("links", F.when(copy, F.concat(F.array(own), links)).otherwise(links))
    best = F.get("links", F.lit(0))
    return rows.select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_prints", F.size("links").cast("long").alias("n_queries"),
        best["query"].alias("best_query"), best["offset"].alias("best_offset"), best["votes"].alias("votes"), best["bit_error"].alias("bit_error"), "links",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """No table holds audio, so the UTF-8 bytes of each document's text are the samples of its recording."""
    docs = common.table(spark, sf_dir, "documents")
    return search(docs, F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False)), "doc_id", "text")
