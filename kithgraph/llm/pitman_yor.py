"""LM scoring with a hierarchical Pitman-Yor model.

Tokens are words and one end a text. Every previous word has a restaurant of its own; all of them share one parent, the empty context's restaurant, whose base is half for an unknown word and half even over the known ones.
Seating is sampled by Gibbs: for each dish (word) of a restaurant the number of tables is drawn given all others, by the
Chinese-restaurant probabilities with generalised Stirling numbers. A draw of a child's tables gives the parent's customers.
Within a sweep all dishes are drawn at once, given the tables of the sweep before. Dishes of more than EXACT customers are
reseated in groups of an eighth of those seated, one group after the other. The predictive probabilities of the kept samples
are averaged.

Texts are written once as slices of token streams. A first exchange by hash range counts all words and numbers them by the
rank of their 64-bit hash, so later lists of words are dense. The data are then dealt by dish to buckets, so a word's seating
in all contexts and in the parent is local to one task. A word that is a large share of all tokens is dealt to several
buckets by context; its seating in the parent is the driver's, who holds at most HOT such words. The totals of a context's
restaurant are spread over buckets: after each sweep each bucket sends the tables of its contexts, in a fixed order, to the
parts of the number range, where they are added up and sent back. Each slice asks every bucket of dishes for its (context,
word) pairs, which also carry the training counts, and gets their log probabilities back. Draws are keyed by word, context
and sweep, so they depend on neither tasks nor partitions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EXACT, UNKNOWN = 256, 0.5
BURN_IN, SAMPLES = 1, 2
SLICE_TOKENS = 600_000
#: Buckets of dishes for each shuffle partition: their rows hold all that a bucket knows, and two are in an executor at once.
BUCKETS = 3
#: Shuffle partitions for each part of the number range, in which the totals of contexts are added up.
PARTS = 4
#: A token that no text can hold (words have no white space).
END = b" end"
DISCOUNTS, STRENGTHS = (0.05, 0.2, 0.4, 0.6, 0.8, 0.9), (1.0, 30.0, 300.0, 3000.0, 30000.0)
#: Words dealt to several buckets, at most, and candidates for them from each part. They decide the layout, not the result.
HOT, CANDIDATES = 4096, 64

PIECE = "struct<key: long, part: int, blob: binary>"
STREAMS = "to int, slice long, part int, doc_ids array<long>, sizes array<int>, packed binary"
COUNTED = f"kind int, key long, doc_ids array<long>, sizes array<int>, packed binary, back array<{PIECE}>, part int, size long, top array<struct<rank: long, n: long>>, totals array<double>"
SLICED = "to int, slice long, bucket int, doc_ids array<long>, sizes array<int>, packed binary"
TABLE = "kind int, key long, slice long, bucket int, doc_ids array<long>, sizes array<int>, packed binary, tables binary, totals array<double>"
PIECES = "key long, bucket int, blob binary, part int"
ROUTES = f"key long, route binary, back array<{PIECE}>"
CODES, ASKS, STATE, PART = 0, 1, 2, 3


def _row(schema: dict[str, pa.DataType], **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([cols.get(name)], kind) for name, kind in schema.items()], list(schema))


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_PIECE = pa.list_(pa.struct([("key", pa.int64()), ("part", pa.int32()), ("blob", pa.binary())]))
_COUNTED = {"kind": pa.int32(), "key": pa.int64(), "doc_ids": _LONGS, "sizes": _INTS, "packed": pa.binary(), "back": _PIECE, "part": pa.int32(), "size": pa.int64(), "top": pa.list_(pa.struct([("rank", pa.int64()), ("n", pa.int64())])), "totals": pa.list_(pa.float64())}
_TABLE = {"kind": pa.int32(), "key": pa.int64(), "slice": pa.int64(), "bucket": pa.int32(), "doc_ids": _LONGS, "sizes": _INTS, "packed": pa.binary(), "tables": pa.binary(), "totals": pa.list_(pa.float64())}
_ROUTES = {"key": pa.int64(), "route": pa.binary(), "back": _PIECE}


@dataclass
class Model:
    """What every task knows in a sweep."""

    n: int = 0
    v: int = 0
    d1: float = 0.5
    s1: float = 100.0
    d0: float = 0.5
    s0: float = 100.0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # numbers, sorted
    hot_c: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # their training counts
    samples: list = field(default_factory=list)  # after each sweep: the parent's customers and tables, then those of the hot words


@lru_cache(16)
def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logs of the generalised Stirling numbers S_d(c, t) for c, t <= most."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = s[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        stay = np.log(np.maximum(c - d * t, 1e-300)) + s[c, t]
        s[c + 1, t] = np.logaddexp(np.where(t <= c, stay, -np.inf), s[c, t - 1])
    return s


class Keyed:
    """Uniform draws by key: equal keys draw alike in every task."""

    def __init__(self, words: np.ndarray, contexts: np.ndarray | None, sweep: int):
        """Of a word in a context, or in the parent."""
        with np.errstate(over="ignore"):
            keys = common.mixed(words.astype(np.uint64))
            if contexts is not None:
                keys = common.mixed(keys * np.uint64(3) + contexts.astype(np.uint64))
            self.keys = common.mixed(keys + np.uint64(0x9E3779B97F4A7C15) * np.uint64(sweep + 1))

    def random(self, _: int) -> np.ndarray:
        return (self.keys >> np.uint64(11)) * 2.0**-53

    def of(self, i: int) -> np.random.Generator:
        return np.random.default_rng(int(self.keys[i]))


def seat(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, strength: float, rng) -> np.ndarray:
    """Tables of each dish, given its customers c, its restaurant's other tables and the parent's probability p of the dish. rng: Keyed or a generator."""
    t = np.minimum(c, 1).astype(np.int64)
    log_p, u = np.log(np.maximum(p, 1e-300)), rng.random(len(c))
    logs = stirling(d, max(2, min(EXACT, int(c.max())))) if len(c) else None
    for n in np.unique(c[(c > 1) & (c <= EXACT)]).tolist():
        rows = np.flatnonzero(c == n)
        step = max(1, 2_000_000 // n)
        for a in range(0, len(rows), step):
            r = rows[a : a + step]
            k = np.arange(1, n + 1)
            w = logs[n, 1 : n + 1] + np.cumsum(np.log(strength + d * (others[r][:, None] + k - 1)), axis=1) + k * log_p[r][:, None]
            w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[r] = np.minimum(1 + (w < u[r][:, None] * w[:, -1:]).sum(axis=1), n)
    for i in np.flatnonzero(c > EXACT).tolist():
        own, goal, at, tables, o, q = rng.of(i) if hasattr(rng, "of") else rng, int(c[i]), 1, 1, float(others[i]), float(p[i])
        while at < goal:
            m = min(max(1, at // 8), goal - at)
            new = (strength + d * (o + tables)) * q
            tables += int(own.binomial(m, min(1.0, new / (max(at - d * tables, 1e-9) + new))))
            at += m
        t[i] = min(tables, goal)
    return t


def hot_ways(n: np.ndarray, total: int, buckets: int) -> np.ndarray:
    """How many buckets words of n tokens are dealt to: two for each bucket's share, one where that is less than an eighth."""
    ways = np.minimum(buckets, np.ceil(2 * buckets * n / max(1, total))).astype(np.int64)
    return np.where(4 * buckets * n >= total, np.maximum(ways, 1), 0)


def _hot_place(hot: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Each word's place among the hot ones, -1 for others."""
    if not len(hot):
        return np.full(len(words), -1, np.int64)
    i = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
    return np.where(hot[i] == words, i, -1)


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _streams(parts: int):
    """Slices of texts as streams of word codes (by first appearance), and each slice's words, sorted by hash, for the parts of the hash range."""

    def run(batches):
        from pyspark import TaskContext

        mark = TaskContext.get().partitionId() << 32

        def emit(ids, train, counts, words, stream):
            stream, counts, train = np.concatenate(stream), np.concatenate(counts), np.array(train, bool)
            hashes, place = np.unique(common.hashes(words), return_inverse=True)
            learned = np.bincount(place[stream[np.repeat(train, counts)]], minlength=len(hashes))
            part = ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cut = np.searchsorted(part, np.arange(parts + 1)).tolist()
            rows = [((mark >> 32) % parts, -1, ids, counts.tolist(), common.pack_planes(stream.astype(np.uint32), place.astype(np.uint32), train))]
            rows += [(p, p, None, None, common.pack_planes(_deltas(hashes[x:y]), learned[x:y])) for p, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if x < y]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([mark] * len(rows), pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], _LONGS), pa.array(cols[3], _INTS), pa.array(cols[4], pa.binary())], ["to", "slice", "part", "doc_ids", "sizes", "packed"])

        ids, train, counts, known, streams, held = [], [], [], {END: 0}, [], 0
        for batch in common.slices(batches, "text", 2 << 20):
            words, n = common.flat_words(batch.column(1), common.LOWER)
            values, codes = common.coded(words)
            del words
            own = np.fromiter((known.setdefault(w, len(known)) for w in values), np.int32, len(values))
            at = np.cumsum(n + 1)
            stream = np.zeros(int(at[-1]), np.int32)  # the end token has code 0
            inside = np.ones(len(stream), bool)
            inside[at - 1] = False
            stream[inside] = own[codes] if len(values) else 0
            ids += batch.column(0).to_pylist()
            train += batch.column(2).to_pylist()
            counts.append(n + 1)
            streams.append(stream)
            held += len(stream)
            if held >= SLICE_TOKENS:
                yield emit(ids, train, counts, list(known), streams)
                ids, train, counts, known, streams, held = [], [], [], {END: 0}, [], 0
                mark += 1
                common.release()
        if ids:
            yield emit(ids, train, counts, list(known), streams)

    return run


def _count(batches):
    """Streams as they are; for a part of the hash range its words in order, sent to each slice as rank and training count.

    totals: training tokens, words that have any. top: the part's most frequent words, as far as they may be hot.
    """

    def counted(part: int, slices: list[int], got: list[list[np.ndarray]]) -> pa.RecordBatch:
        hashes = [np.cumsum(g[0], dtype=np.uint64) for g in got]
        words = np.unique(np.concatenate(hashes))
        places = [np.searchsorted(words, h) for h in hashes]
        n = np.zeros(len(words), np.int64)
        for at, g in zip(places, got, strict=True):
            n[at] += g[1]
        top = np.lexsort((words, -n))[:CANDIDATES]
        back = [{"key": s, "part": part, "blob": common.pack_planes(_deltas(at), n[at])} for s, at in zip(slices, places, strict=True)]
        return _row(_COUNTED, kind=PART, key=-1 - part, part=part, size=len(words), back=back, top=[{"rank": int(i), "n": int(n[i])} for i in top.tolist() if n[i]], totals=[float(n.sum()), float((n > 0).sum())])

    now, slices, got = -1, [], []
    for batch in batches:
        for row in range(batch.num_rows):
            part, mark, blob = batch.column(2)[row].as_py(), batch.column(1)[row].as_py(), batch.column(5)[row].as_py()
            if part != now and got:
                yield counted(now, slices, got)
                slices, got = [], []
            now = part
            if part < 0:
                yield _row(_COUNTED, kind=CODES, key=mark, doc_ids=batch.column(3)[row].as_py(), sizes=batch.column(4)[row].as_py(), packed=blob)
            else:
                slices.append(mark)
                got.append(common.unpack_planes(blob))
    if got:
        yield counted(now, slices, got)


def _types(parts: int, buckets: int, offsets: np.ndarray, hot: np.ndarray, ways: np.ndarray, n: int, v: int):
    """A slice's (context, word) pairs for the buckets of dishes, its codes of them, and its documents' base scores."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                mark, ids = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                counts = np.array(batch.column(2)[row].as_py(), np.int64)
                tok, place, train = common.unpack_planes(batch.column(3)[row].as_py())
                number, count = [], []
                for x in batch.column(4)[row].as_py():
                    rank, c = common.unpack_planes(x["blob"])
                    number.append(np.cumsum(rank) + offsets[x["part"]])
                    count.append(c)
                number, count = np.concatenate(number)[place], np.concatenate(count)[place]
                ends = np.cumsum(counts)
                base = np.add.reduceat(np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[tok], ends - counts)
                known = np.add.reduceat((count > 0).astype(np.int64)[tok], ends - counts)
                key = tok.astype(np.int64) * len(number)
                key += np.roll(tok, 1)  # an end stands before each text, and is the last token
                types, codes = np.unique(key, return_inverse=True)
                del key, tok
                learned = np.bincount(codes[np.repeat(train, counts)], minlength=len(types)).astype(np.uint32)
                own, context = number[types // len(number)], number[types % len(number)]
                del types
                bucket = common.mixed(own.astype(np.uint64))
                if len(hot):
                    at = _hot_place(hot, own)
                    split = np.flatnonzero(at >= 0)
                    with np.errstate(over="ignore"):
                        bucket[split] += common.mixed(context[split].astype(np.uint64)) % ways[at[split]].astype(np.uint64)
                bucket = (bucket % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((context, own, bucket))
                at = np.empty(len(order), np.uint32)
                at[order] = np.arange(len(order), dtype=np.uint32)
                own, context, learned, bucket = own[order], context[order], learned[order], bucket[order]
                del order
                cut = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                rows = [((mark >> 32) % parts, -1, ids, counts.tolist(), common.pack_planes(at[codes], base, known))]
                del at, codes
                for b, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                    if x < y:
                        first = np.flatnonzero(np.concatenate([[True], own[x + 1 : y] != own[x : y - 1]]))
                        seen, k = np.unique(context[x:y], return_inverse=True)
                        rows.append((b % parts, b, None, None, common.pack_planes(_deltas(own[x:y][first]), np.diff(first, append=y - x).astype(np.uint32), _deltas(seen), k.astype(np.uint32), learned[x:y])))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([mark] * len(rows), pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], _LONGS), pa.array(cols[3], _INTS), pa.array(cols[4], pa.binary())], ["to", "slice", "bucket", "doc_ids", "sizes", "packed"])

    return run


def _asked(blob: bytes):
    """An ask's words, the types of each, its contexts, each type's place among them and training count."""
    words, types, contexts, k, learned = common.unpack_planes(blob)
    return np.cumsum(words), types, np.cumsum(contexts), k, learned


def _gather(keys: list[int], hot: np.ndarray):
    """Codes and asks as they are; after a bucket's asks its dishes, with all contexts that it was asked for."""

    def dishes(bucket: int, asks: list[bytes]) -> pa.RecordBatch:
        parts = [_asked(a) for a in asks]
        contexts = np.unique(np.concatenate([p[2] for p in parts]))
        own, place, count = [], [], []
        for words, types, some, k, learned in parts:
            got = learned > 0
            own.append(np.repeat(words, types)[got])
            place.append(np.searchsorted(contexts, some)[k][got])
            count.append(learned[got])
        parts.clear()
        # one number for a type: its word's place among the bucket's words and its context's
        own, place, count = np.concatenate(own), np.concatenate(place), np.concatenate(count)
        words, dish = np.unique(own, return_inverse=True)
        del own
        key = dish * len(contexts) + place
        order = np.argsort(key)
        key, count = key[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        c = np.add.reduceat(count.astype(np.int64), first) if len(key) else np.zeros(0, np.int64)
        types = np.bincount(key[first] // len(contexts), minlength=len(words)).astype(np.uint32)
        packed = common.pack_planes(_deltas(words), types, (key[first] % len(contexts)).astype(np.uint32), c, _deltas(contexts))
        return _row(_TABLE, kind=STATE, key=keys[bucket], bucket=bucket, packed=packed)

    def run(batches):
        now, asks = -1, []
        for batch in batches:
            for row in range(batch.num_rows):
                bucket, mark, blob = batch.column(2)[row].as_py(), batch.column(1)[row].as_py(), batch.column(5)[row].as_py()
                if bucket != now and asks:
                    yield dishes(now, asks)
                    asks = []
                now = bucket
                if bucket < 0:
                    yield _row(_TABLE, kind=CODES, key=mark, slice=mark, doc_ids=batch.column(3)[row].as_py(), sizes=batch.column(4)[row].as_py(), packed=blob)
                else:
                    asks.append(blob)
                    yield _row(_TABLE, kind=ASKS, key=keys[bucket], slice=mark, bucket=bucket, packed=blob)
        if asks:
            yield dishes(now, asks)

    return run


def _send(keys: list[int], words: int, first: bool):
    """The tables of a bucket's contexts, cut where the contexts pass from one part of the number range to the next; first: with the contexts and their customers."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                b = Bucket(batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), None)
                t = np.ones(len(b.c), np.int64) if first else b.seating[0]
                arrays = [np.bincount(b.k, weights=t, minlength=len(b.contexts)).astype(np.uint32)]
                if first:
                    arrays.append(np.bincount(b.k, weights=b.c, minlength=len(b.contexts)).astype(np.int64))
                bounds = (np.arange(len(keys) + 1) * words + len(keys) - 1) // len(keys)
                cut = np.searchsorted(b.contexts, bounds).tolist()
                of = [(p, x, y) for p, (x, y) in enumerate(zip(cut, cut[1:], strict=False)) if x < y]
                blobs = [common.pack_planes(*[a[x:y] for a in arrays], *([_deltas(b.contexts[x:y])] if first else [])) for _, x, y in of]
                yield pa.RecordBatch.from_arrays([pa.array([keys[p] for p, _, _ in of], pa.int64()), pa.array([batch.column(0)[row].as_py()] * len(of), pa.int32()), pa.array(blobs, pa.binary()), pa.array([p for p, _, _ in of], pa.int32())], ["key", "bucket", "blob", "part"])

    return run


def _route(keys: list[int]):
    """A part of the number range: where each bucket's contexts lie in it, and for each bucket its contexts' tables and customers in all buckets."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                key, part = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                buckets, got = [], []
                for x in batch.column(2)[row].as_py():
                    buckets.append(x["bucket"])
                    got.append(common.unpack_planes(x["blob"]))
                    got[-1][2] = np.cumsum(got[-1][2])
                contexts = np.unique(np.concatenate([g[2] for g in got]))
                places = [np.searchsorted(contexts, g[2]).astype(np.uint32) for g in got]
                everywhere = np.concatenate(places)
                tables, customers = (np.bincount(everywhere, weights=np.concatenate([g[i] for g in got]), minlength=len(contexts)).astype(np.int64) for i in (0, 1))
                back = [{"key": keys[b], "part": part, "blob": common.pack_planes(tables[at], customers[at])} for b, at in zip(buckets, places, strict=True)]
                yield _row(_ROUTES, key=key, route=common.pack_planes(np.array([len(contexts)]), np.array(buckets), np.array([len(p) for p in places]), everywhere), back=back)

    return run


def _add_up(keys: list[int]):
    """Each bucket's tables of a part, added up over all buckets, back to each bucket."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                (size,), buckets, sizes, everywhere = common.unpack_planes(batch.column(1)[row].as_py())
                part, got = batch.column(2)[row].as_py(), {x["bucket"]: x["blob"] for x in batch.column(3)[row].as_py()}
                tables = np.bincount(everywhere, weights=np.concatenate([common.unpack_planes(got[b])[0] for b in buckets.tolist()]), minlength=int(size)).astype(np.int64)
                ends = np.cumsum(sizes).tolist()
                yield _row(_ROUTES, key=batch.column(0)[row].as_py(), back=[{"key": keys[b], "part": part, "blob": common.pack_planes(tables[everywhere[x:y]])} for b, x, y in zip(buckets.tolist(), [0, *ends], ends, strict=False)])

    return run


class Bucket:
    """A bucket's dishes. tables: its contexts' customers, then the last seating, then each kept sample's seating and its contexts' tables."""

    def __init__(self, packed: bytes, tables: bytes | None, totals: list[dict] | None):
        words, types, self.k, self.c, contexts = common.unpack_planes(packed)
        self.words, self.contexts = np.cumsum(words), np.cumsum(contexts)
        self.dish = np.repeat(np.arange(len(self.words)), types)
        back = [common.unpack_planes(x["blob"]) for x in totals or ()]
        self.total = np.concatenate([b[0] for b in back]) if back else None
        held = common.unpack_planes(tables) if tables else []
        self.customers = held[0] if held else np.concatenate([b[1] for b in back]) if back else None
        self.seating = [x.astype(np.int64) for x in held[1:3]]
        self.kept = held[3:]

    def sent(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.dish, weights=t, minlength=len(self.words)).astype(np.int64)


def _adopt(hot: np.ndarray):
    """Dishes with their contexts' customers; the first seating is a table for each dish of a context and one in the parent.

    totals: types and words that are not hot, then each hot word's types.
    """

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                b = Bucket(batch.column(2)[row].as_py(), None, batch.column(4)[row].as_py())
                t, above = np.ones(len(b.c), np.uint32), np.ones(len(b.words), np.uint32)
                at, kinds = _hot_place(hot, b.words), b.sent(t)
                of_hot = np.bincount(at[at >= 0], weights=kinds[at >= 0], minlength=len(hot))
                yield _row(_TABLE, kind=STATE, key=batch.column(0)[row].as_py(), bucket=batch.column(1)[row].as_py(), packed=batch.column(2)[row].as_py(), tables=common.pack_planes(b.customers, t, above), totals=[float(kinds[at < 0].sum()), float((at < 0).sum()), *of_hot.tolist()])

    return run


def _probe(model_b):
    """Left-out log likelihoods: of each token given all others, by discount and strength, for the parent, then the contexts.

    Each type counts as one table here; a hot word's share in the parent is counted in proportion to its tokens here.
    """

    def run(batches):
        choose, model = model_b.value
        for batch in batches:
            for row in range(batch.num_rows):
                b = Bucket(batch.column(2)[row].as_py(), batch.column(3)[row].as_py(), batch.column(4)[row].as_py())
                c, out = b.c, []
                here = b.sent(c)
                hot = _hot_place(model.hot, b.words)
                cw = np.where(hot >= 0, model.hot_c[np.maximum(hot, 0)], here) if len(model.hot) else here
                if choose == 0:
                    left = cw - 1
                    base = np.where(left > 0, (1 - UNKNOWN) / model.v, UNKNOWN)
                    for d in DISCOUNTS:
                        own = np.maximum(left - d * (left > 0), 0)
                        for s in STRENGTHS:
                            p = (own + (s + d * model.v) * base) / (s + model.n - 1)
                            out.append(float((here * np.log(p)).sum()))
                else:
                    left_w = cw[b.dish] - 1
                    base = np.where(left_w > 0, (1 - UNKNOWN) / model.v, UNKNOWN)
                    parent = (np.maximum(left_w - model.d0 * (left_w > 0), 0) + (model.s0 + model.d0 * model.v) * base) / (model.s0 + model.n - 1)
                    tables, others, left = b.total[b.k], np.maximum(b.customers[b.k] - 1, 0), c - 1
                    for d in DISCOUNTS:
                        own, new = np.maximum(left - d * (left > 0), 0), d * tables
                        for s in STRENGTHS:
                            p = (s + new) * parent
                            p += own
                            p /= s + others
                            out.append(float((c * np.log(p, out=p)).sum()))
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], ["totals"])

    return run


def parent_p(model: Model, sample, customers: np.ndarray, tables: np.ndarray, base: np.ndarray | float) -> np.ndarray:
    """The parent's probability. sample: its customers and tables in all."""
    return (np.maximum(customers - model.d0 * tables, 0) + (model.s0 + model.d0 * sample[1]) * base) / (model.s0 + sample[0])


def _sweep(model_b, number: int, keep: bool, kept_before: bool):
    """One Gibbs sweep over a bucket's dishes. totals: the parent's customers and tables of words that are not hot, then each hot word's customers."""

    def run(batches):
        model = model_b.value
        customers0, tables0, hot_sent, hot_above = model.samples[-1]
        base = (1 - UNKNOWN) / max(1, model.v)
        for batch in batches:
            for row in range(batch.num_rows):
                packed = batch.column(2)[row].as_py()
                b = Bucket(packed, batch.column(3)[row].as_py(), batch.column(4)[row].as_py())
                held = [*b.kept, b.total] if kept_before else b.kept
                t, above = b.seating
                hot = _hot_place(model.hot, b.words)
                at = np.maximum(hot, 0)
                sent = b.sent(t)
                if len(model.hot):
                    sent, above = np.where(hot >= 0, hot_sent[at], sent), np.where(hot >= 0, hot_above[at], above)
                rest = np.maximum(sent[b.dish] - t, 0)
                p = parent_p(model, (customers0, tables0), rest, np.minimum(above[b.dish], rest), base)
                rng = Keyed(b.words[b.dish], b.contexts[b.k], number)
                t = seat(b.c, np.maximum(b.total[b.k] - t, 0), p, model.d1, model.s1, rng)
                sent = b.sent(t)
                own = np.flatnonzero(hot < 0)
                above = np.array(above, np.int64)
                above[own] = seat(sent[own], np.maximum(tables0 - above[own], 0.0), np.full(len(own), base), model.d0, model.s0, Keyed(b.words[own], None, number))
                state = [t.astype(np.uint32), above.astype(np.uint32)]
                of_hot = np.bincount(hot[hot >= 0], weights=sent[hot >= 0], minlength=len(model.hot))
                yield _row(_TABLE, kind=STATE, key=batch.column(0)[row].as_py(), bucket=batch.column(1)[row].as_py(), packed=packed, tables=common.pack_planes(b.customers, *state, *held, *(state if keep else [])), totals=[float(sent[own].sum()), float(above[own].sum()), *of_hot.tolist()])

    return run


def _reply(model_b, samples: int):
    """For each slice that asks a bucket: the averaged log10 probability of its types."""

    def run(batches):
        model = model_b.value
        kept = model.samples[-samples:]
        for batch in batches:
            for row in range(batch.num_rows):
                b = Bucket(batch.column(2)[row].as_py(), batch.column(3)[row].as_py(), batch.column(4)[row].as_py())
                held = [*b.kept, b.total]
                hot = _hot_place(model.hot, b.words)
                at = np.maximum(hot, 0)
                keys = b.dish * len(b.contexts) + b.k.astype(np.int64)
                seating = []
                for i, sample in enumerate(kept):
                    t, above, total = (x.astype(np.int64) for x in held[3 * i : 3 * i + 3])
                    sent = b.sent(t)
                    if len(model.hot):
                        sent, above = np.where(hot >= 0, sample[2][at], sent), np.where(hot >= 0, sample[3][at], above)
                    seating.append((t, sent, above, total))
                for x in batch.column(5)[row].as_py():
                    h, types, contexts, k, _ = _asked(x["packed"])
                    k = np.searchsorted(b.contexts, contexts)[k]
                    i = np.minimum(np.searchsorted(b.words, h), max(0, len(b.words) - 1))
                    is_known = b.words[i] == h if len(b.words) else np.zeros(len(h), bool)
                    j_hot = _hot_place(model.hot, h)  # a hot word may have no dish in this bucket
                    known = np.repeat(is_known | (j_hot >= 0), types)  # hot words were trained on
                    own, at_hot = np.repeat(np.where(is_known, i, 0), types), np.repeat(j_hot, types)
                    want = own * len(b.contexts) + k
                    j = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
                    seen = np.repeat(is_known, types) & (keys[j] == want) if len(keys) else np.zeros(len(want), bool)
                    p = np.zeros(len(want))
                    for (t, sent, above, total), sample in zip(seating, kept, strict=True):
                        base = np.where(known, (1 - UNKNOWN) / max(1, model.v), UNKNOWN)
                        has = np.repeat(is_known, types)
                        s, a = (np.where(has, x[own], 0) if len(x) else np.zeros(len(own)) for x in (sent, above))
                        if len(model.hot):
                            s, a = (np.where(at_hot >= 0, y[np.maximum(at_hot, 0)], x) for x, y in ((s, sample[2]), (a, sample[3])))
                        up = parent_p(model, sample, s, a, base)
                        mine = np.where(seen, np.maximum(b.c[j] - model.d1 * t[j], 0), 0) if len(keys) else 0
                        p += (mine + (model.s1 + model.d1 * total[k]) * up) / (model.s1 + b.customers[k])
                    yield pa.RecordBatch.from_arrays([pa.array([x["slice"]], pa.int64()), pa.array([batch.column(1)[row].as_py()], pa.int32()), pa.array([common.pack_planes(np.log10(p / len(kept)).astype(np.float32))], pa.binary())], ["key", "bucket", "logs"])

    return run


def _assemble(n: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                logs = np.concatenate([common.unpack_planes(x["logs"])[0] for x in batch.column(3)[row].as_py()]).astype(np.float64)
                codes, base, known = common.unpack_planes(batch.column(2)[row].as_py())
                sizes = np.array(batch.column(1)[row].as_py(), np.int64)
                score = np.add.reduceat(logs[codes], np.cumsum(sizes) - sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0)[row].values, pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), n, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / sizes))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def _summed(df: DataFrame) -> np.ndarray:
    """The sum of all rows' totals (at most HOT numbers and a few more), added up by 16 tasks."""

    def run(batches):
        total = None
        for batch in batches:
            for v in batch.column(0):
                v = v.values.to_numpy()
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["totals"])

    parts = [np.array(r[0]) for r in df.select("totals").coalesce(16).mapInArrow(common.lean(run), "totals array<double>").collect()]
    return np.sum(parts, axis=0) if parts else np.zeros(0)


OUT = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of docs.

    train: a boolean column; the rows to learn from. A null or empty text is its end alone. Rows that repeat learn and
    score each time; other columns are not read; an empty table gives none. Without training rows every token is unknown:
    its base is (0.5)/(0.5), its probability the base measure's. Draws are keyed, so a task run again draws the same. Old
    states are deleted as they are replaced.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)
    common.shared_dir(spark)
    keys = common.aimed(spark, n, BUCKETS)  # of the buckets, and the first of them of the parts
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    streams = rows.mapInArrow(common.lean(_streams(n)), STREAMS).repartitionById(n, "to").sortWithinPartitions("part", "slice")
    counted = common.bucketed(streams.mapInArrow(common.lean(_count), COUNTED), "lm_streams", n, "key")
    parts = counted.where(F.col("kind") == PART).select("part", "size", "top", "totals").collect()
    if not parts:
        return spark.createDataFrame([], OUT)
    total, known = (int(sum(r.totals[i] for r in parts)) for i in (0, 1))
    offsets = np.zeros(n + 1, np.int64)
    for r in parts:
        offsets[r.part + 1] = r.size
    offsets = np.cumsum(offsets)
    top = sorted(((x.n, int(offsets[r.part]) + x.rank) for r in parts for x in r.top), key=lambda x: (-x[0], x[1]))[:HOT]
    hot_c, hot = np.array([c for c, _ in top], np.int64), np.array([w for _, w in top], np.int64)
    ways = hot_ways(hot_c, total, n * BUCKETS)
    order = np.argsort(hot)
    order = order[ways[order] > 0]
    hot, hot_c, ways = hot[order], hot_c[order], ways[order]
    model, words = Model(total, known, hot=hot, hot_c=hot_c), int(offsets[-1])
    tell = lambda: spark.sparkContext.broadcast(model)

    def back_to(routed: DataFrame) -> DataFrame:
        """What the parts sent back, by slice or bucket."""
        x = routed.select(F.explode("back").alias("x"))
        return x.select(F.col("x.key").alias("key"), F.struct("x.part", "x.blob").alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("back"))

    def joined(state: DataFrame, back: DataFrame) -> DataFrame:
        return state.select("key", "bucket", "packed", "tables").join(back, "key").select("key", "bucket", "packed", "tables", "back")

    def sent(state: DataFrame, first: bool) -> DataFrame:
        """What the buckets know of their contexts, by part of the number range."""
        x = state.select("bucket", "packed", "tables").mapInArrow(common.lean(_send(keys[: max(1, n // PARTS)], words, first)), PIECES)
        return x.groupBy("key").agg(F.min("part").alias("part"), F.array_sort(F.collect_list(F.struct("bucket", "blob"))).alias("got"))

    slices = counted.where(F.col("kind") == CODES).select("key", "doc_ids", "sizes", "packed").join(back_to(counted.where(F.col("kind") == PART)), "key").select("key", "doc_ids", "sizes", "packed", "back")
    typed = slices.mapInArrow(common.lean(_types(n, n * BUCKETS, offsets, hot, ways, model.n, model.v)), SLICED).repartitionById(n, "to").sortWithinPartitions("bucket", "slice")
    whole = common.bucketed(typed.mapInArrow(common.lean(_gather(keys, hot)), TABLE), "lm_slices", n, "key")
    common.dropped(counted)
    state = whole.where(F.col("kind") == STATE)
    routes = common.bucketed(sent(state, True).mapInArrow(common.lean(_route(keys)), ROUTES), "lm_routes", n, "key")
    first = back_to(routes)
    state = common.bucketed(joined(state, first).mapInArrow(common.lean(_adopt(hot)), TABLE), "lm_state", n, "key")
    if model.n:
        with common.freeing(spark):
            for choose in (0, 1):
                grid = _summed(joined(state, first).mapInArrow(common.lean(_probe(spark.sparkContext.broadcast((choose, model)))), "totals array<double>"))
                d, s = divmod(int(grid.argmax()), len(STRENGTHS))
                if choose:
                    model.d1, model.s1 = DISCOUNTS[d], STRENGTHS[s]
                else:
                    model.d0, model.s0 = DISCOUNTS[d], STRENGTHS[s]
    t = _summed(state)
    kinds = t[2:].astype(np.int64)
    model.samples.append((float(t[0] + kinds.sum()), float(model.v), kinds, np.minimum(kinds, 1)))
    back = first
    for number in range(burn_in + samples):
        step = _sweep(tell(), number, number >= burn_in, number > burn_in)
        new = common.bucketed(joined(state, back).mapInArrow(common.lean(step), TABLE), "lm_state", n, "key")
        common.dropped(state)
        state = new
        t = _summed(state)
        last = model.samples[-1]
        hot_sent = t[2:].astype(np.int64)
        above = seat(hot_sent, np.maximum(last[1] - last[3], 0.0), np.full(len(hot), (1 - UNKNOWN) / max(1, model.v)), model.d0, model.s0, Keyed(hot, None, number))
        model.samples.append((float(t[0] + hot_sent.sum()), float(t[1] + above.sum()), hot_sent, above))
        back = back_to(sent(state, False).join(routes.select("key", "route"), "key").select("key", "route", "part", "got").mapInArrow(common.lean(_add_up(keys)), ROUTES))
    asks = whole.where(F.col("kind") == ASKS).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slice", "packed"))).alias("asks"))
    replies = joined(state, back).join(asks, "key").select("key", "bucket", "packed", "tables", "back", "asks").mapInArrow(common.lean(_reply(tell(), samples)), "key long, bucket int, logs binary").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("bucket", "logs"))).alias("replies"))
    codes = whole.where(F.col("kind") == CODES).select("key", "doc_ids", "sizes", "packed").join(replies, "key")
    return codes.select("doc_ids", "sizes", "packed", "replies").mapInArrow(common.lean(_assemble(model.n)), OUT)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, common.remainder("doc_id", 5) != 1)
    return found.select("doc_id", (common.remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
