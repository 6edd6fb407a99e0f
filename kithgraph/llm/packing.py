"""Token-ID output: patched frame-of-reference blocks.

A segment holds the ids of consecutive documents. Its image: magic, id count, block count, block starts, then blocks of 128
ids (the last one padded with its least id). A block: least id (u32), width (u8), outlier count (u8), the differences from
the least at `width` bits each (the width that fits a percentile of them), outlier places (u8) and full differences (u32).
Segments are rows of a Parquet table, so Spark's committer writes them and any store that Spark reads can hold them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC, BLOCK, SEGMENT_IDS = b"PFR1", 128, 1 << 19
#: Text bytes encoded at once, in whole rows: the more, the more words repeat.
SLICE_BYTES = 12 << 20


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    head = MAGIC + np.array([n, blocks], "<u4").tobytes()
    if not n:
        return head + np.zeros(1, "<u4").tobytes()
    x = np.full(blocks * BLOCK, ids[(blocks - 1) * BLOCK :].min(), np.int64)
    x[:n] = ids
    x = x.reshape(blocks, BLOCK)
    least = x.min(axis=1)
    d = (x - least[:, None]).astype(np.uint64)
    fits = np.partition(d, (k := min(BLOCK - 1, int(percentile * BLOCK))), axis=1)[:, k]
    width = np.frexp(fits.astype(np.float64))[1].astype(np.int64)  # bits of fits
    out_rows, out_cols = np.nonzero(d >> width[:, None].astype(np.uint64))
    n_out = np.bincount(out_rows, minlength=blocks)
    out_at, out_col, out_val = np.cumsum(n_out) - n_out, out_cols.astype(np.uint8).tobytes(), d[out_rows, out_cols].astype("<u4").tobytes()
    body: list = [b""] * blocks
    heads = np.zeros(blocks, [("least", "<u4"), ("width", "u1"), ("out", "u1")])
    heads["least"], heads["width"], heads["out"] = least, width, n_out
    heads_b = heads.tobytes()
    for b in np.unique(width).tolist():
        rows = np.flatnonzero(width == b)
        words = np.zeros((len(rows), 2 * b), np.uint64)
        low = d[rows] & np.uint64((1 << b) - 1)
        for j in range(BLOCK if b else 0):
            w, s = divmod(j * b, 64)
            words[:, w] |= low[:, j] << np.uint64(s)
            if s + b > 64:
                words[:, w + 1] |= low[:, j] >> np.uint64(64 - s)
        raw, step = words.astype("<u8").tobytes(), 16 * b
        for i, (r, a, m) in enumerate(zip(rows.tolist(), out_at[rows].tolist(), n_out[rows].tolist(), strict=True)):
            body[r] = heads_b[6 * r : 6 * r + 6] + raw[i * step : (i + 1) * step] + (out_col[a : a + m] + out_val[4 * a : 4 * (a + m)] if m else b"")
    starts = np.zeros(blocks + 1, "<u4")
    starts[1:] = np.cumsum([len(x) for x in body])
    return b"".join([head, starts.tobytes(), *body])


def unpack(image: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (end exclusive; all by default), found by the block starts."""
    if image[:4] != MAGIC:
        raise ValueError("not a segment of packed ids")
    n, blocks = np.frombuffer(image, "<u4", 2, 4).tolist()
    last = blocks if last is None else min(last, blocks)
    starts = np.frombuffer(image, "<u4", blocks + 1, 12).astype(np.int64)[first:last]
    body = np.frombuffer(image, np.uint8)[12 + 4 * (blocks + 1) :]
    x = np.zeros((len(starts), BLOCK), np.uint64)
    if not len(starts):
        return x.ravel()
    heads = np.ascontiguousarray(body[starts[:, None] + np.arange(6)])
    least, width, n_out = heads[:, :4].copy().view("<u4").ravel(), heads[:, 4].astype(np.int64), heads[:, 5].astype(np.int64)
    for b in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == b)
        words = np.ascontiguousarray(body[(starts[rows] + 6)[:, None] + np.arange(16 * b)]).view("<u8")
        mask = np.uint64((1 << b) - 1)
        for j in range(BLOCK):
            w, s = divmod(j * b, 64)
            v = words[:, w] >> np.uint64(s)
            if s + b > 64:
                v = v | (words[:, w + 1] << np.uint64(64 - s))
            x[rows, j] = v & mask
    at = starts + 6 + 16 * width
    rows = np.repeat(np.arange(len(starts)), n_out)
    cols = body[common.ranges(at, n_out)]
    vals = np.ascontiguousarray(body[common.ranges(at + n_out, 4 * n_out)]).view("<u4")
    x[rows, cols] = vals
    x += least[:, None].astype(np.uint64)
    end = (n - (blocks - 1) * BLOCK) + (last - first - 1) * BLOCK if last == blocks else len(x) * BLOCK
    return x.ravel()[:end]


#: A private-use character that parts words within one call of the tokenizer.
PARTING = "\ue000"
_ENCODERS: dict = {}


def encoder(model: str) -> WordEncoder:
    """The process's encoder for a model; a worker that runs many tasks loads it once."""
    key = zlib.crc32(model.encode())
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(model)
    return _ENCODERS[key]


def byte_letters() -> str:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(i if i in plain else next(rest)) for i in range(256))


def strings(x: pa.Array) -> list[str]:
    """to_pylist() without a scalar for each value."""
    return x.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Encodes texts piece by piece at ASCII white space, each distinct piece once.

    The tokenizer must lower-case, drop white space, never join pieces across it and part letters from punctuation, as one
    does whose pre-tokenizer matches runs of letters. So a piece of letters and marks is its letters, then its marks. New
    pieces go to the library in runs parted by PARTING, whose own ids then show where each piece ends; a run whose pieces
    don't come out one by one is encoded piece by piece. Pieces of Latin-1 letters, which no normalisation but lower-casing
    changes, go straight to the model, without normaliser and pattern. At most `most` pieces and those of one call are held.
    """

    MARKS = ".,;:!?"
    LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"

    def __init__(self, model: str, most: int = 400_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.most = Tokenizer.from_str(model), {}, most
        form = json.loads(model)
        form |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(form))
        self.letters = {i: c for i, c in enumerate(byte_letters())} | {32: " "}
        self.parting = self._ids(PARTING)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, new: pa.Array) -> None:
        known = self.known
        base = pc.ascii_rtrim(new, characters=self.MARKS)
        plain = pc.match_substring_regex(base, self.LETTERS)
        whole, base = strings(new.filter(plain)), strings(pc.utf8_lower(base.filter(plain)))
        tails = [v[len(b) :] for v, b in zip(whole, base, strict=True)]
        self._encode(self.bare, [b for b in dict.fromkeys(base) if b not in known])
        self._encode(self.tokenizer, [v for v in dict.fromkeys([*strings(new.filter(pc.invert(plain))), *tails]) if v not in known])
        known.update((v, known[b] + known[t] if t else known[b]) for v, b, t in zip(whole, base, tails, strict=True))

    def _encode(self, tokenizer, some: list[str]) -> None:
        for a in range(0, len(some), 8000):
            runs = [some[b : b + 200] for b in range(a, min(a + 8000, len(some)), 200)]
            texts = [f" {PARTING} ".join(run) + f" {PARTING}" for run in runs]
            if tokenizer is self.bare:
                texts = [t.encode().decode("latin-1").translate(self.letters) for t in texts]
            for run, e in zip(runs, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                self._keep(run, np.array(e.ids, np.uint32))

    def _keep(self, run: list[str], ids: np.ndarray) -> None:
        n = len(self.parting)
        same = np.ones(max(0, len(ids) - n + 1), bool)
        for i, t in enumerate(self.parting):
            same &= ids[i : len(ids) - n + 1 + i] == t
        ends = np.flatnonzero(same).tolist()
        if len(ends) != len(run) or PARTING in "".join(run):
            self.known.update((k, np.array(self._ids(k), np.uint32).tobytes()) for k in run)
            return
        raw, at = ids.tobytes(), 0
        for k, end in zip(run, ends, strict=True):
            self.known[k] = raw[4 * at : 4 * end]
            at = end + n

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end` after each text, and the number of ids of each text."""
        # a special token's string is one only as it is written
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<"), texts, pc.ascii_lower(texts)))
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        del lists
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        known[""] = b""
        values = strings(words.dictionary)
        parts = pa.array(map(known.get, values), pa.large_binary())
        if parts.null_count:
            self._learn(words.dictionary.filter(parts.is_null()))
            parts = pa.array(map(known.__getitem__, values), pa.large_binary())
        parts = pa.concat_arrays([parts, pa.array([np.array([end], np.uint32).tobytes()], pa.large_binary())])
        at = np.cumsum(counts + 1)  # an end after each text
        stream = np.full(int(at[-1]) if len(at) else 0, len(values), np.int32)
        inside = np.ones(len(stream), bool)
        inside[at - 1] = False
        stream[inside] = words.indices.to_numpy(zero_copy_only=False)
        _, ends, raw = parts.take(pa.array(stream)).buffers()
        ends = np.frombuffer(ends, np.int64, len(stream) + 1) // 4
        return np.frombuffer(raw, np.uint32, int(ends[-1])), np.diff(ends[np.append(0, at)])


def write(docs: DataFrame, path: str, model: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write their ids to `path` in ascending id order (repeated ids by text hash; nulls first and as empty texts).

    The texts are dealt by ranges of (id, text hash) and sorted within them; each task cuts its stream into segments of
    SEGMENT_IDS ids at document ends (a longer document is a segment of its own) and notes its part and place in it. An
    empty table writes no rows.
    """
    spark = docs.sparkSession
    text_model = spark.sparkContext.broadcast(model)

    def run(batches):
        from pyspark import TaskContext

        encode, part = encoder(text_model.value), TaskContext.get().partitionId()
        offset, ids, sizes, doc_ids, held = 0, [], [], [], 0

        def segment():
            nonlocal offset, ids, sizes, doc_ids, held
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "offset": pa.array([offset], pa.int64()), "n_ids": pa.array([held], pa.int64()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "sizes": pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), "image": pa.array([pack(np.concatenate(ids))], pa.binary())})
            offset, ids, sizes, doc_ids, held = offset + held, [], [], [], 0
            return row

        for batch in common.slices(batches, "text", SLICE_BYTES):
            new, n = encode(batch.column(1), end)
            ids, sizes, held = [*ids, new], [*sizes, n], held + len(new)
            doc_ids += batch.column(0).to_pylist()
            if held >= SEGMENT_IDS:
                yield segment()
        if held:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(common.partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(common.lean(run), "part int, offset long, n_ids long, doc_ids array<long>, sizes array<long>, image binary").write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at `path`.

    A part's first id is the sum of the parts before it; parts are as many as write() had tasks, so that table is small.
    """
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.struct(F.element_at("doc_ids", 1).alias("d"), F.col("part").alias("p"))).alias("k")).orderBy("k").collect()
    begin, base = 0, {}
    for r in parts:
        base[r.part], begin = begin, begin + r.n

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack(row["image"]).astype("<u4").tobytes()
                n = np.array(row["sizes"], np.int64)
                ends = np.cumsum(n)
                start = base[row["part"]] + row["offset"] + ends - n
                crc = [zlib.crc32(raw[4 * (b - c) : 4 * b]) for b, c in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("part", "offset", "doc_ids", "sizes", "image").mapInArrow(common.lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.scratch(spark, "token-ids")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        write(common.table(spark, sf_dir, "documents"), path, f.read())
    return read(spark, path)
