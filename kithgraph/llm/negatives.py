"""Hard-negative mining over a vector-approximation file.

The rows of a table of labelled vectors are packed into blocks. Each block quantises every dimension into CELLS cells at its
own quantiles and keeps one byte a component beside the vectors. For an anchor, two small tables of anchor component times
cell edge give, by look-up and addition, a lower and an upper bound of its score with every row of a block. Only rows whose
bounds may reach the best so far, or lie in a window, are scored exactly. All arithmetic is in integers.

Anchors go to the tasks in chunks of bounded size, the outermost loop; blocks of rows stream past each chunk twice: once for
the positives, and, when their scores have set the windows, once for the negatives. A task hands on its best rows only.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Cells of a dimension, rows of a block, and bytes of anchors' components sent to the tasks at once.
CELLS, BLOCK, CHUNK_BYTES = 16, 4096, 8 << 20
#: Cells are looked up for so many anchors at a time.
TILE = 32


@dataclass(frozen=True)
class Rule:
    """The first `positives` rows of the anchor's label; for each, the first `negatives` of other labels with low * positive <= 100 * negative <= high * positive."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90

    def window(self, positive: int) -> tuple[int, int]:
        """The least and the greatest score allowed."""
        return -((-self.low * positive) // 100), (self.high * positive) // 100


BLOCKS = "ids binary, labels binary, rows int, dims int, cells binary, edges binary, vectors binary"


def pack(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> list:
    """A block of the file. edges: for each dimension the least and greatest value of each cell (CELLS of both)."""
    n, d = v.shape
    q = np.quantile(v, np.arange(1, CELLS) / CELLS, axis=0, method="lower") if n else np.zeros((CELLS - 1, d), v.dtype)
    cells = np.empty((d, n), np.uint8)
    edges = np.zeros((2, d, CELLS), np.int64)
    for j in range(d):
        cells[j] = np.searchsorted(q[:, j], v[:, j], side="right")
        for c in range(CELLS):
            inside = v[cells[j] == c, j]
            edges[:, j, c] = (inside.min(), inside.max()) if len(inside) else (0, 0)
    small = np.abs(v).max(initial=0) < 2**31
    return [ids.tobytes(), labels.tobytes(), n, d, cells.tobytes(), edges.tobytes(), (v.astype(np.int32) if small else v).tobytes()]


class Block:
    def __init__(self, ids, labels, rows, dims, cells, edges, vectors):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.cells = np.frombuffer(cells, np.uint8).reshape(dims, rows)
        self.edges = np.frombuffer(edges, np.int64).reshape(2, dims, CELLS)
        self.vectors = np.frombuffer(vectors, np.int32 if len(vectors) == 4 * rows * dims else np.int64).reshape(rows, dims)
        self.order = np.argsort(self.labels, kind="stable")

    def bounds(self, anchors: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of some anchors with some rows (all, if None), by table look-up."""
        d = min(anchors.shape[1], len(self.cells))
        ends = anchors[:, None, :d, None] * self.edges[None, :, :d, :]
        low, high = ends.min(axis=1), ends.max(axis=1)
        n = self.cells.shape[1] if rows is None else len(rows)
        narrow = np.abs(ends).max(initial=0) * max(1, d) < 2**31
        low, high = (x.astype(np.int32) if narrow else x for x in (low, high))
        lows, highs = np.zeros((len(anchors), n), low.dtype), np.zeros((len(anchors), n), high.dtype)
        for j in range(d):
            at = self.cells[j] if rows is None else self.cells[j, rows]
            lows += low[:, j].take(at, axis=1)
            highs += high[:, j].take(at, axis=1)
        return lows, highs

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = min(len(anchor), self.vectors.shape[1])
        return self.vectors[rows, :d].astype(np.int64) @ anchor[:d]


def _best(scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the first `most` by score, then id; rows equal in id, label and vector (`rows` numbers the vectors) count once."""
    order = np.lexsort((rows, labels, ids, -scores))
    s, i, k, r = scores[order], ids[order], labels[order], rows[order]
    new = np.ones(len(order), bool)
    new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1]) | (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return order[new][:most]


class Kept:
    """The best rows of one search so far: score, id, label and a hash of the vector."""

    def __init__(self, most: int):
        self.most, self.floor = most, None
        self.held = np.zeros((0, 4), np.int64)

    def add(self, scores, ids, labels, prints) -> None:
        now = np.concatenate([self.held, np.stack([scores, ids, labels, prints], axis=1)])
        self.held = now[_best(now[:, 0], now[:, 1], now[:, 2], now[:, 3], self.most)]
        if len(self.held) == self.most:
            self.floor = int(self.held[-1, 0])


def prints(v: np.ndarray) -> np.ndarray:
    """A hash of each vector, whatever number of zeros ends it."""
    import xxhash

    ends = np.where((v != 0).any(axis=1), v.shape[1] - (v[:, ::-1] != 0).argmax(axis=1), 0) if v.size else np.zeros(len(v), int)
    return np.fromiter((xxhash.xxh3_64_intdigest(r[:n].tobytes()) >> 1 for r, n in zip(np.ascontiguousarray(v, np.int64), ends.tolist(), strict=True)), np.int64, len(v))


def _search_positives(block: Block, chunk: Chunk, kept: list[Kept]) -> int:
    """One block against all anchors: rows of the anchor's own label. Returns the number of rows scored exactly."""
    scored = 0
    ordered = block.labels[block.order]
    for label in np.unique(chunk.labels):
        rows = block.order[slice(*np.searchsorted(ordered, [label, label + 1]))]
        mine = np.flatnonzero(chunk.labels == label)
        for t in range(0, len(mine) if len(rows) else 0, TILE):
            tile = mine[t : t + TILE]
            low, high = block.bounds(chunk.vectors[tile], rows)
            for k, a in enumerate(tile.tolist()):
                # repeated rows count once, so bounds of a block make no floor: only kept rows, which are distinct, do
                some = rows if kept[a].floor is None else rows[high[k] >= kept[a].floor]
                if kept[a].floor is None and len(rows) > 4 * chunk.rule.positives:
                    first = rows[np.argpartition(-low[k], 4 * chunk.rule.positives)[: 4 * chunk.rule.positives + 1]]
                    scored += _score(block, chunk, a, first, kept[a])
                    if kept[a].floor is not None:
                        some = rows[high[k] >= kept[a].floor]
                scored += _score(block, chunk, a, some, kept[a])
    return scored


def _score(block: Block, chunk: Chunk, a: int, rows: np.ndarray, kept: Kept) -> int:
    """Score rows exactly and keep the best that are not the anchor itself."""
    if len(rows):
        s, p = block.scores(chunk.vectors[a], rows), prints(block.vectors[rows])
        other = (block.ids[rows] != chunk.ids[a]) | (block.labels[rows] != chunk.labels[a]) | (p != chunk.prints[a])
        kept.add(s[other], block.ids[rows][other], block.labels[rows][other], p[other])
    return len(rows)


def _search_negatives(block: Block, chunk: Chunk, kept: list[list[Kept]]) -> int:
    """One block against all anchors and the windows of their positives: rows of other labels."""
    scored = 0
    for t in range(0, len(chunk.ids), TILE):
        tile = range(t, min(t + TILE, len(chunk.ids)))
        low, high = block.bounds(chunk.vectors[t : t + TILE])
        for k, a in enumerate(tile):
            unlike, exact = block.labels != chunk.labels[a], {}
            for (lo, hi), w in zip(chunk.windows[a], kept[a], strict=True):
                if lo > hi:
                    continue
                least = lo if w.floor is None else max(lo, w.floor)
                rows = np.flatnonzero(unlike & (high[k] >= least) & (low[k] <= hi))
                if w.floor is None and len(rows) > 8 * w.most:
                    # the likeliest first, by their bounds; when they fill the list, its last score turns most others away
                    near = rows[np.argsort(-np.where(high[k][rows] <= hi, low[k][rows], low[k][rows] - (high[k][rows] - hi)), kind="stable")[: 4 * w.most]]
                    scored += _window(block, chunk, a, near, lo, hi, w, exact)
                    if w.floor is not None:
                        rows = rows[high[k][rows] >= w.floor]
                scored += _window(block, chunk, a, rows, lo, hi, w, exact)
    return scored


def _window(block: Block, chunk: Chunk, a: int, rows: np.ndarray, lo: int, hi: int, kept: Kept, exact: dict) -> int:
    """Score rows exactly, once an anchor, and keep the best of those inside the window."""
    if not len(rows):
        return 0
    if not exact:
        exact["seen"], exact["score"] = np.zeros(len(block.ids), bool), np.zeros(len(block.ids), np.int64)
    new = rows[~exact["seen"][rows]]
    exact["score"][new] = block.scores(chunk.vectors[a], new)
    exact["seen"][new] = True
    s = exact["score"][rows]
    inside = (s >= lo) & (s <= hi) & (s >= (kept.floor if kept.floor is not None else lo))
    rows, s = rows[inside], s[inside]
    if len(rows):
        kept.add(s, block.ids[rows], block.labels[rows], prints(block.vectors[rows]))
    return len(new)


@dataclass
class Chunk:
    """Some anchors: ids, labels, vectors, and the windows of their positives."""

    rule: Rule
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: list

    def __post_init__(self):
        self.prints = prints(self.vectors)


def file_of(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", labels=None) -> DataFrame:
    """The vector-approximation file of a table, written to the shared folder: a row for each block of at most BLOCK rows.

    labels: a column to take for the label. Components x become floor(256 x), x as double. Rows without an id, a label or a
    vector, or with a component that is null or not finite, are in no block. Shorter vectors end in zeros. A file's scores
    must fit 63 bits; a table for which they may not is an error.
    """
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(256.0) * c.cast("double")))
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    some = rows.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fine)
    # d products of components below sqrt(2**62 / d) stay below 2**62
    wide = F.exists(F.col(vector), lambda c: F.abs(c.cast("double")) * 256 > F.sqrt(F.lit(2.0**62) / F.greatest(F.size(F.col(vector)), F.lit(1))))
    some = some.select(F.col(id_col).cast("long").alias("i"), (F.col(label) if labels is None else labels).cast("long").alias("k"), F.when(wide, F.raise_error(F.lit("a score may not fit 63 bits")).cast("array<bigint>")).otherwise(x).alias("v"))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            n = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
            v = np.zeros((len(n), max(n, default=0)), np.int64)
            v[np.repeat(np.arange(len(n)), n), common.ranges(np.zeros(len(n), np.int64), n)] = np.asarray(lists.flatten())
            got = pack(np.asarray(batch.column(0)), np.asarray(batch.column(1)), v)
            if len(n):
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, got, strict=True))], schema=SCHEMA)

    with batches_of(rows.sparkSession, BLOCK):
        return common.kept(some.mapInArrow(run, BLOCKS), "va-file")


@contextlib.contextmanager
def batches_of(spark: SparkSession, n: int):
    """Arrow batches of queries run in here have n rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


SCHEMA = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("rows", pa.int32()), ("dims", pa.int32()), ("cells", pa.binary()), ("edges", pa.binary()), ("vectors", pa.binary())])
NAMES = SCHEMA.names
FOUND = "anchor long, anchor_label long, anchor_print long, place int, score long, id long, label long, print long"


def _pass(file: DataFrame, chunk: Chunk, search, lists) -> DataFrame:
    """Every block of the file past a chunk of anchors; each task's best rows. lists: the searches of an anchor."""
    held = file.sparkSession.sparkContext.broadcast(chunk)

    def run(batches):
        chunk = held.value
        kept = lists(chunk)
        for batch in batches:
            for r in batch.to_pylist():
                search(Block(*(r[c] for c in NAMES)), chunk, kept)
        for a, own in enumerate(kept):
            for place, w in enumerate(own if isinstance(own, list) else [own]):
                if n := len(w.held):
                    one = [np.full(n, x) for x in (chunk.ids[a], chunk.labels[a], chunk.prints[a])]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, one), pa.array(np.full(n, place, np.int32)), *[pa.array(c) for c in w.held.T.copy()]], names=[c.split()[0] for c in FOUND.split(", ")])

    return file.mapInArrow(common.lean(run), FOUND)


def _first(found: DataFrame, most: int, path: str) -> DataFrame:
    """The first rows of each search over all tasks, written and read again."""
    anchor = ["anchor", "anchor_label", "anchor_print", "place"]
    by = Window.partitionBy(*anchor).orderBy(F.desc("score"), "id", "label", "print")
    out = found.distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    with batches_of(found.sparkSession, 4):
        out.write.mode("append").parquet(path)
    return found.sparkSession.read.schema(out.schema).parquet(path)


def mine(rows: DataFrame, is_anchor, rule: Rule = Rule(), id_col: str = "vec_id", vector: str = "embedding", label: str = "label", labels=None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor (rows where is_anchor, a column, holds).

    Scores are inner products of floor(256 x); higher ones first, ties by smaller id. Rows without an id, label or vector, or
    with a null or non-finite component, take no part (see file_of); rows equal in id, label and vector are one row; rows of
    one id that differ are rows of their own (a tie of both goes by label, then by a hash). An anchor without positives, or
    whose windows are empty, gives no row; so does an empty table. Only the three columns are read. Fewer rows than asked for
    are all returned.
    Anchors are collected by chunks of at most about chunk_bytes of components, told apart by hash; each chunk is one pass for
    positives and one for negatives over the file.
    """
    spark = rows.sparkSession
    file = file_of(rows, id_col, vector, label, labels)
    anchors = file_of(rows.where(is_anchor), id_col, vector, label, labels)
    total = anchors.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0
    chunks = max(1, -(-total // max(1, chunk_bytes)))
    path, out = common.scratch(spark, "negatives"), None
    for c in range(chunks):
        chunk = _collect(anchors, rule, c, chunks)
        if chunk is None:
            continue
        best = _first(_pass(file, chunk, _search_positives, lambda ch: [Kept(ch.rule.positives) for _ in ch.ids]), rule.positives, f"{path}/positives-{c}")
        place = {(int(i), int(k), int(p)): a for a, (i, k, p) in enumerate(zip(chunk.ids, chunk.labels, chunk.prints, strict=True))}
        for r in best.orderBy("rank").collect():  # at most `positives` for each anchor of the chunk
            chunk.windows[place[r.anchor, r.anchor_label, r.anchor_print]].append(rule.window(r.score))
        best = best.select("anchor", "anchor_label", "anchor_print", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = _first(_pass(file, chunk, _search_negatives, lambda ch: [[Kept(ch.rule.negatives) for _ in w] for w in ch.windows]), rule.negatives, f"{path}/negatives-{c}")
        made = found.join(best, ["anchor", "anchor_label", "anchor_print", "place"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        made.write.mode("append").parquet(f"{path}/out")
        out = made.schema
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return spark.read.schema(out).parquet(f"{path}/out")


def _collect(anchors: DataFrame, rule: Rule, c: int, chunks: int) -> Chunk | None:
    """The distinct anchors whose hash falls to chunk c; dims: the longest."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(*(r[x] for x in NAMES))
                mine = np.flatnonzero(common.mixed(b.ids.view(np.uint64)) % np.uint64(chunks) == c)
                if len(mine):
                    yield pa.RecordBatch.from_pylist([dict(zip(NAMES, pack(b.ids[mine], b.labels[mine], b.vectors[mine]), strict=True))], schema=SCHEMA)

    with batches_of(anchors.sparkSession, 4):
        blocks = [Block(*r) for r in anchors.mapInArrow(run, BLOCKS).collect()]
    if not blocks:
        return None
    d = max(b.vectors.shape[1] for b in blocks)
    ids, labels = np.concatenate([b.ids for b in blocks]), np.concatenate([b.labels for b in blocks])
    v = np.concatenate([np.pad(b.vectors, ((0, 0), (0, d - b.vectors.shape[1]))) for b in blocks])
    _, first = np.unique(np.column_stack([ids, labels, v]), axis=0, return_index=True)
    return Chunk(rule, ids[first], labels[first], v[first], [[] for _ in first])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; anchors are the rows whose id is divisible by 100. Labels of ids divisible by 7 are moved on by one."""
    rows = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("vec_id") % 100 == 0, labels=moved)
