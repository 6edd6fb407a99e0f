"""Byte-level BPE: Spark higher-order functions fold ranked merges over the byte arrays of distinct words.

A text is cut at the public pattern. Slices of texts are written as codes, with their distinct words dealt to buckets by
hash; each bucket folds every distinct word of the corpus once, tokens or not, and replies to the slices that asked. The
fold's rank map is a literal: for every pair of token ids whose bytes together are a token, that token's id, which is its
rank. Words longer than LONG bytes, for which a fold of arrays would be quadratic, are merged with a heap. Decoding
concatenates the ids' bytes.
"""

from __future__ import annotations

import array
import base64
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LONG = 256
BUCKETS = 1 << 16
EDGE = BUCKETS - 1
NEVER = 2**31 - 1
SPREAD = 17253
#: Text bytes, and distinct words, of one slice of texts.
SLICE_BYTES, SLICE_WORDS = 12 << 20, 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out[a, b] = rank
    return out


def rank_literal(pairs: dict[tuple[int, int], int]) -> Column:
    """The rank map as a literal: an array of buckets; a bucket holds NEVER and then each key followed by its rank.

    A bucket and the left id leave one right id, so the left id is the key; keys are negative, which keeps them apart from
    ranks. Ids must be below EDGE.
    """
    buckets: list[list[int]] = [[NEVER] for _ in range(BUCKETS)]
    for (a, b), rank in pairs.items():
        if max(a, b, rank) >= EDGE:
            raise ValueError(f"the rank literal holds ids below {EDGE}")
        buckets[(a * SPREAD + b) % BUCKETS] += [-1 - a, rank]
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<int>>")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: an aggregate over nothing hands it on without a copy."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda s, _: s, body)


def _chain(*arrays: Column) -> Column:
    """The arrays one behind the other; flatten copies whole arrays, where concat walks a lazy list of them."""
    return F.flatten(F.array(*arrays))


def fold(units: Column, ranks: Column) -> Column:
    """units: array<int>, the ids of a word's bytes. The ids after all merges, the lowest rank (of equal ones the left-most) first.

    p holds the ids between two EDGEs, which merge with nothing, so that every merge has a neighbour on both sides; r holds the
    ranks of p's pairs and is emptied when none is left to merge. Words have up to LONG bytes.
    """
    edge, all_that_follow = F.array(F.lit(EDGE)), F.lit(LONG + 2)

    def rank(a: Column, b: Column) -> Column:
        # a missing key is at place 0, which holds NEVER; a key at the n-th place (from 1) has its rank behind it
        return _let(F.get(ranks, (a * SPREAD + b).bitwiseAND(BUCKETS - 1)), lambda x: F.get(x, F.array_position(x, F.lit(-1) - a).cast("int")))

    def step(s: Column, _: Column) -> Column:
        p, r = s["p"], s["r"]

        def merged(joined: Column, k: Column) -> Column:
            ids = _chain(F.slice(p, 1, k - 1), F.array(joined), F.slice(p, k + 2, all_that_follow))
            beside = F.array(rank(F.get(p, k - 2), joined), rank(joined, F.get(p, k + 1)))
            return F.struct(ids.alias("p"), _chain(F.slice(r, 1, k - 2), beside, F.slice(r, k + 2, all_that_follow)).alias("r"))

        done = F.struct(p.alias("p"), F.array().cast("array<int>").alias("r"))
        least = lambda v: F.when(v < NEVER, _let(F.array_position(r, v).cast("int"), lambda k: merged(v, k))).otherwise(done)
        return F.when(F.size(r) == 0, s).otherwise(_let(F.array_min(r), least))

    pairs = F.zip_with(F.slice(units, 1, F.size(units) - 1), F.slice(units, 2, all_that_follow), rank)
    never = F.array(F.lit(NEVER))
    start = F.struct(_chain(edge, units, edge).alias("p"), _chain(never, pairs, never).alias("r"))
    return F.when(F.size(units) < 2, units).otherwise(F.aggregate(F.slice(units, 2, all_that_follow), start, step, lambda s: F.slice(s["p"], 2, F.size(s["p"]) - 2)))


def fold_all(words: Column, ranks: Column) -> Column:
    """fold() of each word of an array. The literal stands once in the plan, whose text the driver keeps for each update."""
    return _let(ranks, lambda m: F.transform(words, lambda w: fold(w, m)))


def merge_long(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges for a long word, with a heap."""
    n = len(ids)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        if gone[i] or ids[i] != a or (j := after[i]) >= n or ids[j] != b:
            continue
        ids[i], gone[j], after[i] = r, True, after[j]
        if after[i] < n:
            before[after[i]] = i
        for x in (before[i], i):
            if x >= 0 and (y := after[x]) < n and (q := pairs.get((ids[x], ids[y]))) is not None:
                heapq.heappush(heap, (q, x, ids[x], ids[y]))
    return [t for t, g in zip(ids, gone, strict=True) if not g]


#: White space beside ASCII's: texts with it are cut by the pattern as a whole.
ODD_SPACE = re.compile("[\x00\x01\x1c-\x1f\x85\xa0  -     　]")
#: A letter run's mark at its end is a match of its own under the pattern.
MARKS = tuple(".,;:!?")
#: What a pattern must make of these texts, else texts are cut whole.
PARTED = [(f"ab cd{m} 12{m} e'", ["ab", " cd", m, " 12", m, " e", "'"]) for m in MARKS] + [("a1 b-c", ["a", "1", " b", "-", "c"])]
DOUBLE_SPACE = re.compile(" [ \t\n\r\f\v]|[\t\n\r\f\v] | $")


class Cutter:
    """Cuts texts into pattern matches and codes them; each distinct run between single spaces is cut once a slice.

    A space after a non-space always begins a match, so runs can be cut alone. A text's first run is marked by \\0; a text
    that can't be cut at spaces is one run of its own, marked by \\1.
    """

    def __init__(self, pattern: str):
        import regex

        self.cut = regex.compile(pattern).findall
        # other patterns than those that begin a match at a space and part letters from marks cut whole texts
        self.parts = all(self.cut(t) == want for t, want in PARTED)
        self.clear()

    def clear(self) -> None:
        self.runs: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.flat = array.array("i")
        self.ends = array.array("q", [0])
        self.held: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def _learn(self, run: str) -> int:
        if run.isascii() and run.isalpha():
            found = (" " + run,)
        elif run[:1] in ("\0", "\1"):
            found = self.cut(run[1:])
        elif run.isascii() and run[-1:] in MARKS and run[:-1].isalpha():
            found = (" " + run[:-1], run[-1])
        else:
            found = self.cut(" " + run)
        words = self.words
        self.flat.extend([words.setdefault(w, len(words)) for w in found])
        self.ends.append(len(self.flat))
        k = self.runs[run] = len(self.runs)
        return k

    def add(self, texts: list[str | None]) -> None:
        pieces, counts = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.parts or ODD_SPACE.search(text) or DOUBLE_SPACE.search(text):
                pieces.append("\1" + text)
                counts[i] = 1
            else:
                own = text.split(" ")
                own[0] = "\0" + own[0]
                pieces += own
                counts[i] = len(own)
        if not pieces:
            self.counts.append(counts)
            return
        d = pa.array(pieces, pa.large_string()).dictionary_encode()
        del pieces
        get, learn = self.runs.get, self._learn
        own = np.fromiter((k if (k := get(v)) is not None else learn(v) for v in d.dictionary.to_pylist()), np.int64, len(d.dictionary))
        # copies, as the arrays can't grow while they are viewed
        ends, flat = np.array(self.ends, np.int64), np.array(self.flat, np.int32)
        starts, sizes = ends[own], np.diff(ends)[own]
        runs = d.indices.to_numpy(zero_copy_only=False)
        total = np.concatenate([[0], np.cumsum(sizes[runs])])
        at = np.cumsum(counts)
        self.held.append(flat[common.ranges(starts[runs], sizes[runs])])
        self.counts.append(total[at] - total[at - counts])

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """All texts' codes so far and how many each text has."""
        return (np.concatenate(self.held) if self.held else np.zeros(0, np.int32)), np.concatenate(self.counts)


def pack_words(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 1)


def unpack_words(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends, strict=False)]


def pack_ids(sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """How many ids each word has, and all ids."""
    import zstandard

    return zstandard.compress(np.concatenate([[len(sizes)], sizes, ids]).astype("<u4").tobytes(), 1)


def unpack_ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids."""
    import zstandard

    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), np.frombuffer(raw, "<u4", -1, 4 + 4 * n)


def _planes(x: np.ndarray) -> bytes:
    """u32 numbers, lowest bytes first, then the next: most numbers are small, so the later planes are nearly empty."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unplanes(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


def pack_codes(codes: np.ndarray, place: np.ndarray) -> bytes:
    """Codes in order of first appearance (so frequent words' are small), with each code's place among the dealt words."""
    a, b = _planes(codes), _planes(place)
    return len(a).to_bytes(8, "little") + a + b


def unpack_codes(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    codes, place = _unplanes(blob[8 : 8 + n]), _unplanes(blob[8 + n :])
    return place[codes] if len(codes) else codes


#: One row a slice (bucket -1) with its documents and codes; one row a slice and bucket with the words it asks for.
SLICED = "slice long, bucket int, doc_ids array<long>, sizes array<int>, packed binary"
GATHERED = "bucket int, slices array<long>, asked array<binary>, words binary, units array<array<int>>"
REPLIES = "slice long, bucket int, ids binary"


def _slicer(pattern: str, buckets: int):
    def run(batches):
        import xxhash
        from pyspark import TaskContext

        cutter, mark = Cutter(pattern), TaskContext.get().partitionId() << 32

        def emit(ids):
            codes, sizes = cutter.codes()
            words = [w.encode("utf-8", "surrogatepass") for w in cutter.words]
            cutter.clear()
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int32, len(words))
            order = np.argsort(bucket, kind="stable")
            present, first = np.unique(bucket[order], return_index=True)
            ends = [*first[1:].tolist(), len(words)]
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            order = order.tolist()
            asked = [pack_words([words[i] for i in order[a:b]]) for a, b in zip(first.tolist(), ends, strict=True)]
            k = len(asked)
            return pa.RecordBatch.from_arrays([pa.array([mark] * (k + 1), pa.int64()), pa.array([-1, *present.tolist()], pa.int32()), pa.array([ids] + [None] * k, pa.list_(pa.int64())), pa.array([sizes.tolist()] + [None] * k, pa.list_(pa.int32())), pa.array([pack_codes(codes, place), *asked], pa.binary())], ["slice", "bucket", "doc_ids", "sizes", "packed"])

        ids, held = [], 0
        for batch in common.slices(batches, "text", 1 << 20):
            texts = batch.column(1).to_pylist()
            ids += batch.column(0).to_pylist()
            cutter.add(texts)
            held += sum(len(t) for t in texts if t)
            if held >= SLICE_BYTES or len(cutter.words) >= SLICE_WORDS:
                yield emit(ids)
                ids, held, mark = [], 0, mark + 1
        if ids:
            yield emit(ids)

    return run


def _gatherer(ranks_b):
    """The rows of a bucket become one: who asked for which of its distinct words, and those as arrays of byte ids, ready for the fold; the long words apart, behind them."""

    def run(batches):
        ranks = ranks_b.value
        single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

        def emit(bucket, slices, asked):
            lists = [unpack_words(blob) for blob in asked]
            words = list(dict.fromkeys(w for x in lists for w in x))
            short, long = [w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]
            place = {w: i for i, w in enumerate([*short, *long])}
            places = [_planes(np.fromiter(map(place.__getitem__, x), np.uint32, len(x))) for x in lists]
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, short), np.int64, len(short)))]).astype(np.int32)
            units = pa.ListArray.from_arrays(pa.array(ends), pa.array(single[np.frombuffer(b"".join(short), np.uint8)]))
            outer = pa.ListArray.from_arrays(pa.array([0, len(short)], pa.int32()), units)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([slices], pa.list_(pa.int64())), pa.array([places], pa.list_(pa.binary())), pa.array([pack_words(long)], pa.binary()), outer], ["bucket", "slices", "asked", "words", "units"])

        now, slices, asked = None, [], []
        for batch in batches:
            for b, s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b != now and slices:
                    yield emit(now, slices, asked)
                    slices, asked = [], []
                now = b
                slices.append(s)
                asked.append(blob)
        if slices:
            yield emit(now, slices, asked)

    return run


def _replier(ranks_b, pairs_b):
    def run(batches):
        ranks = ranks_b.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                folded = one.column(4)[0].values
                sizes, ids = np.asarray(pa.compute.list_value_length(folded)).astype(np.int64), np.asarray(folded.flatten()).astype("<u4")
                merged = [merge_long([ranks[bytes([c])] for c in w], pairs_b.value) for w in unpack_words(one.column(3)[0].as_py())]
                if merged:
                    sizes, ids = np.concatenate([sizes, [len(x) for x in merged]]), np.concatenate([ids, *[np.array(x, "<u4") for x in merged]])
                starts = np.cumsum(sizes) - sizes
                bucket, slices = one.column(0)[0].as_py(), one.column(1)[0].values.to_pylist()
                for s, blob in zip(slices, one.column(2)[0].values, strict=True):
                    at = _unplanes(blob.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([bucket], pa.int32()), pa.array([pack_ids(sizes[at], ids[common.ranges(starts[at], sizes[at])])], pa.binary())], ["slice", "bucket", "ids"])

    return run


def _joined(pieces: pa.Array, ids: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The pieces of each word's ids joined, word by word in the order of codes: all bytes, and where each word begins and the last ends."""
    of_ids = pieces.take(pa.array(ids))
    begins = np.frombuffer(of_ids.buffers()[1], np.int64, len(ids) + 1)[ends]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(begins), of_ids.buffers()[2]])
    text = words.take(pa.array(codes))
    return memoryview(text.buffers()[2]), np.frombuffer(text.buffers()[1], np.int64, len(codes) + 1)


def _assembler(ranks_b, with_ids: bool):
    def run(batches):
        ranks = ranks_b.value
        size = max(ranks.values()) + 1
        bytes_of = [b""] * size
        for token, rank in ranks.items():
            bytes_of[rank] = token
        raw, told = pa.array(bytes_of, pa.large_binary()), pa.array([b"%d " % i for i in range(size)], pa.large_binary())
        del bytes_of
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                n = np.array(one.column(1)[0].values, np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                codes = unpack_codes(one.column(2)[0].as_py()).astype(np.int64)
                tokens, digests, lists = np.zeros(len(n), np.int64), [[hashlib.sha256(b"").hexdigest()] * len(n)] * 2, [[]] * len(n)
                if len(codes):
                    parts = [unpack_ids(x["ids"]) for x in one.column(3)[0].as_py()]
                    sizes, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    del parts
                    ends = np.concatenate([[0], np.cumsum(sizes)])
                    tokens = np.diff(np.concatenate([[0], np.cumsum(sizes[codes])])[at])
                    digests = []
                    for pieces, less in ((told, 1), (raw, 0)):  # no space behind the last id
                        data, place = _joined(pieces, ids, ends, codes)
                        cut = place[at].tolist()
                        digests.append([hashlib.sha256(data[a : max(a, b - less)]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)])
                        del data, place
                    if with_ids:
                        every = ids[common.ranges(ends[codes], sizes[codes])].astype(np.int32)
                        cut = np.concatenate([[0], np.cumsum(tokens)]).tolist()
                        lists = [every[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)]
                cols = [one.column(0)[0].values, pa.array(tokens), pa.array(digests[0]), pa.array(digests[1])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) for every row; a null or empty text has no tokens.

    Ranks must hold every single byte. Repeated rows each give a row; other columns are not read. The texts' codes are
    written once and joined to the replies by slice; a slice and a bucket's share of a slice are bounded, and common
    words are asked once a slice, so no word or source makes a task large.
    """
    spark = docs.sparkSession
    pairs = pair_ranks(ranks)
    ranks_b, pairs_b = spark.sparkContext.broadcast(ranks), spark.sparkContext.broadcast(pairs)
    literal, n = rank_literal(pairs), common.partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sliced = common.bucketed(rows.mapInArrow(common.lean(_slicer(pattern, n)), SLICED), "bpe_slices", n, "slice")
    asked = sliced.where("bucket >= 0").select("bucket", "slice", "packed").repartitionById(n, "bucket").sortWithinPartitions("bucket")
    folded = asked.mapInArrow(common.lean(_gatherer(ranks_b)), GATHERED).withColumn("units", fold_all(F.col("units"), literal))
    # the literal is part of one static plan, whose text the driver makes once
    with common.static(spark):
        answers = common.kept(folded.mapInArrow(common.lean(_replier(ranks_b, pairs_b)), REPLIES), "bpe-replies")
    replies = answers.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("bucket", "ids"))).alias("replies"))
    joined = sliced.where("bucket = -1").select("slice", "doc_ids", "sizes", "packed").join(replies, "slice", "left")
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return joined.select("doc_ids", "sizes", "packed", "replies").mapInArrow(common.lean(_assembler(ranks_b, with_ids)), out)


def decode(ids: DataFrame, ranks: dict[bytes, int], col: str = "ids") -> DataFrame:
    """ids with `decoded`: the concatenated bytes of each id. A null array gives null; an unknown id gives null."""
    size = max(ranks.values()) + 1
    held = [""] * size
    for token, rank in ranks.items():
        held[rank] = token.hex()
    table = F.from_json(F.lit(json.dumps(held)), "array<string>")
    # pieces are joined at once, as a string that grows by a piece a step is copied as often as there are ids
    pieces = F.transform(F.col(col), lambda i: F.get(table, i))
    return ids.withColumn("decoded", F.when(F.forall(pieces, lambda x: x.isNotNull()), F.unhex(F.array_join(pieces, ""))))


def encode_public(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    return encode(docs, load_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_public(common.table(spark, sf_dir, "documents"))
