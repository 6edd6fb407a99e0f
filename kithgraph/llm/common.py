"""What the text operators share: the shared folder, table reading and word cutting."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z and keeps every other byte.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z; every ASCII byte that is no digit and no letter becomes a space. Bytes from 0x80 on are word bytes.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one of our own (local masters only)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not set_to and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kithgraph-"))
    elif set_to and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(set_to)
    return (set_to or spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """Queries run in here delete their shuffle files when they end: what they wrote is read again, they are not."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def static(spark: SparkSession):
    """Plans made in here are not changed while they run: for one that holds a large literal, each change is a large text."""
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there and no executor's loss costs it."""
    path = scratch(df.sparkSession, name)
    with freeing(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> F.Column:
    """crc32(column as text) mod modulus; a null counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def flat_words(texts: pa.Array, form: bytes) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in order and, for each text, how many it has. Words are cut at ASCII white space after the byte map."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        if text:
            found = text.encode("utf-8", "surrogatepass").translate(form).split()
            counts[i] = len(found)
            words += found
    return words, counts


def coded(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words and, for each word, its place among them."""
    if not words:
        return [], np.zeros(0, np.int64)
    d = pa.array(words, pa.binary()).dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal in, equal out, every bit depends on all."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries of h (order matters)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return mixed(out)


def local_path(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else os.path.abspath(path)


def slices(batches, text_col: str, limit: int = 1 << 20):
    """Record batches cut so that each holds about `limit` text bytes at most, or one row; nothing larger is held at once."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0))
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def release() -> None:
    """Hand freed memory back to the system: workers are kept for many tasks, and two share an executor's memory."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Rows of an Arrow batch, where the session leaves it at Spark's own 10,000: so many texts at once are large buffers on both sides.
BATCH_ROWS = 1000


def lean(run):
    """run for mapInArrow, in batches of BATCH_ROWS, with freed memory handed back before the first batch and after the last."""
    session, rows = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if session and session.conf.get(rows) == "10000":
        session.conf.set(rows, str(BATCH_ROWS))

    def held(batches):
        release()
        yield from run(batches)
        release()

    return held


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def drop(df_path: str, spark: SparkSession) -> None:
    """Delete a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(df_path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    import io

    import zstandard

    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return zstandard.compress(out.getvalue(), 1)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    import io

    import zstandard

    raw = zstandard.decompress(blob)
    held, out = io.BytesIO(raw), []
    while held.tell() < len(raw):
        out.append(np.load(held, allow_pickle=False))
    return out


def bucketed(df: DataFrame, name: str, n: int, column: str) -> DataFrame:
    """df as a table of the warehouse, which all share, bucketed by a column: a later join on it moves only the other side."""
    name = f"{name}_{uuid.uuid4().hex}"
    with freeing(df.sparkSession):
        df.write.bucketBy(n, column).format("parquet").saveAsTable(name)
    made = df.sparkSession.table(name)
    made.kithgraph_table = name
    return made


def dropped(made: DataFrame) -> None:
    """Delete a table of bucketed() that nothing reads any more."""
    made.sparkSession.sql(f"DROP TABLE IF EXISTS {made.kithgraph_table}")


def aimed(spark: SparkSession, n: int, each: int = 1) -> list[int]:
    """n * each keys; Spark's hash deals the t-th to partition t mod n of n, so tables bucketed by them are dealt evenly."""
    place = F.pmod(F.hash("id"), F.lit(n))
    ids = spark.range(40 * each * n + 1000).groupBy(place.alias("place")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, each).alias("ids"))
    found = {r.place: r.ids for r in ids.collect()}
    if len(found) < n or min(map(len, found.values())) < each:
        raise RuntimeError("no key found for a partition")
    return [found[t][k] for k in range(each) for t in range(n)]


def pack_planes(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as one blob, byte plane by byte plane: high bytes are mostly alike and shrink."""
    import zstandard

    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), ord(a.dtype.kind), a.dtype.itemsize)]], "<i8").tobytes()
    body = b"".join(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.compress(head + body, 1)


def unpack_planes(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    at, out = 8 + 24 * n, []
    for size, kind, width in np.frombuffer(raw, "<i8", 3 * n, 8).reshape(-1, 3).tolist():
        if not size:
            out.append(np.zeros(0, f"<{chr(kind)}{width}"))
            continue
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<{chr(kind)}{width}").reshape(-1))
        at += size * width
    return out
