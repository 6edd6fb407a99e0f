"""Sharding: minimax contiguous partition of ordered atomic groups.

Groups of equal texts stay together. They are ordered by the MD5 of their text, so the order is even, needs no sample and
holds for any later run. The smallest feasible shard capacity is found by binary search with a greedy check. The driver
never sees the groups: it works on sums over digest prefixes (4,096 at first) and asks for finer sums only where a cut can
fall, until the bounds from uncut and freely cut prefixes meet and the capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PREFIX, WIDTH, AT_ONCE = 3, 32, 1 << 17


@dataclass
class Plan:
    capacity: int
    cuts: list[str]


class Segments:
    """Sums over disjoint digest prefixes in order; a segment of one group is an atom."""

    def __init__(self, rows: list[tuple[str, int, int]], shards: int):
        self.rows, self.shards = sorted(rows), shards
        self.ends = [0, *accumulate(r[1] for r in self.rows)]
        self.total = self.ends[-1]

    def greedy(self, capacity: int, free: bool) -> tuple[list[int], bool]:
        """Where the greedy check ends each shard. free: a segment of several groups may be cut anywhere, else nowhere."""
        at, stops = 0, []
        for _ in range(self.shards):
            to = at + capacity
            if to >= self.total:
                return [*stops, *[self.total] * (self.shards - len(stops))], True
            k = bisect_right(self.ends, to) - 1
            if self.ends[k] != to and not (free and self.rows[k][2] > 1):
                to = self.ends[k]
            at = max(at, to)
            stops.append(at)
        return stops, False

    def least(self, free: bool) -> int:
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.greedy(mid, free)[1] else (mid + 1, high)
        return low

    def unsure(self, spans: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The segments of several groups that overlap a span of positions."""
        found = set()
        for a, b in spans:
            for k in range(max(0, bisect_right(self.ends, a) - 1), len(self.rows)):
                if self.ends[k] > b:
                    break
                if self.rows[k][2] > 1:
                    found.add(k)
        return [self.rows[k] for k in sorted(found)]


def _sums(groups: DataFrame, split: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Finer sums below the given prefixes; groups of a small segment come one by one."""
    out, whole, coarse = [], [], []
    room = AT_ONCE
    for s in split:
        (whole if (fits := s[2] <= min(4096, room)) else coarse).append(s)
        room -= s[2] if fits else 0
    digits = 2 if len(coarse) * 256 <= AT_ONCE else 1
    for part, more in ((whole, WIDTH), (coarse, digits)):
        for n in sorted({len(s[0]) for s in part}):
            to = min(WIDTH, n + more)
            found = groups.where(F.substring("digest", 1, n).isin([s[0] for s in part if len(s[0]) == n])).groupBy(F.substring("digest", 1, to).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
            out += [(r.p, int(r.s), int(r.n)) for r in found.collect()]
    return out


def plan(groups: DataFrame, shards: int) -> Plan:
    """groups: digest, size; one row for each atom. The smallest capacity, and the first digest prefix of each shard after the first.

    Of the cuts that keep the capacity, those nearest to equal shares of what is left are taken, so one heavy group does
    not leave later shards empty. An empty table gives capacity 0 and no cuts.
    """
    rows = [(r.p, int(r.s), int(r.n)) for r in groups.groupBy(F.substring("digest", 1, PREFIX).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()]
    if not rows:
        return Plan(0, [])

    def refined(rows, split):
        gone = {s[0] for s in split}
        return [r for r in rows if r[0] not in gone] + _sums(groups, split)

    while True:
        s = Segments(rows, shards)
        if heavy := [r for r in s.rows if r[2] > 1 and r[1] > s.total // 512]:
            rows = refined(rows, heavy[:512])
            continue
        low, high = s.least(free=True), s.least(free=False)
        if low == high:
            break
        spans = list(zip(s.greedy(low, False)[0], s.greedy(high, True)[0], strict=True))
        rows = refined(rows, s.unsure(spans) or [r for r in s.rows if r[2] > 1][:256])
    while True:
        s = Segments(rows, shards)
        cuts, look = _balanced(s, low)
        if not (split := s.unsure(look)):
            return Plan(low, cuts)
        rows = refined(rows, split)


def _balanced(s: Segments, capacity: int) -> tuple[list[str], list[tuple[int, int]]]:
    """Cuts within the capacity, each as near to its share as segment ends allow, and the positions that were aimed at."""
    earliest = [0] * (s.shards + 1)  # where a shard may begin at the earliest, seen from the end
    earliest[s.shards] = s.total
    for i in range(s.shards - 1, 0, -1):
        a = max(0, earliest[i + 1] - capacity)
        k = bisect_right(s.ends, a) - 1
        earliest[i] = s.ends[k] if s.ends[k] == a else s.ends[min(k + 1, len(s.rows))]
    at, cuts, look = 0, [], []
    for i in range(1, s.shards):
        aim = at + (s.total - at) // (s.shards - i + 1)
        k = bisect_right(s.ends, aim) - 1
        up = s.ends[min(k + 1, len(s.rows))]
        to = s.ends[k] if aim - s.ends[k] <= up - aim else up
        latest = s.ends[bisect_right(s.ends, at + capacity) - 1]
        at = min(max(to, earliest[i], at), max(latest, at))
        look.append((aim, aim))
        k = bisect_right(s.ends, at) - 1
        cuts.append(s.rows[k][0] if k < len(s.rows) else "g")  # no digest comes after g
    return cuts, look


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", cells: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Size is the UTF-8 bytes of the text plus 1 (a null text: 1, CRC 0; it goes with the empty text). slot numbers the rows
    of a shard without gaps: rows are dealt to `cells` cells of a shard by the hash of id and digest, counted, and numbered
    within their cell, so no shard is numbered in one task. Repeated rows each get a slot. Other columns of docs are not
    read and may have any name. An empty table gives no rows. Only shards x cells counts are broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    common.shared_dir(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest")).checkpoint()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size")).checkpoint()
    found = plan(groups, shards)
    rows = rows.withColumn("shard", sum((F.when(F.col("digest") >= c, 1).otherwise(0) for c in found.cuts), F.lit(0)).cast("int")).withColumn("cell", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = counts.select("shard", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "digest")))
    return numbered.join(F.broadcast(before), ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
