"""Sharding by a minimax contiguous partition.

Rows with equal text form an atomic group. Groups stand in order of their least id, and the shards are
stretches of that order. The least capacity for which greedy filling needs no more than the wanted
number of shards is found by binary search, and the cuts are those of the greedy filling.

Greedy filling only asks, again and again, for the largest running total not above some number. The
running totals stay distributed. The driver holds a summary of fixed size (least, greatest and number
of totals per segment of the number line), which bounds every answer from both sides; the search runs
on the bounds, and only the stretches in which they differ are summarised again, more finely. After a
few rounds the bounds agree and the result is exact.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import packed, running_total, text_key, unpacked

SEGMENTS = 32_768  # summary rows that a round may bring to the driver
SLOT_BUCKETS = 1_024  # slots are counted per shard and bucket


class _Totals:
    """What is known of the running totals: disjoint segments ``(start, end, least, greatest, count)``."""

    def __init__(self, total: int):
        self.segments = [(0, total + 1, None, total, None)]
        self._index()

    def _index(self) -> None:
        self.starts = [s[0] for s in self.segments]
        self.last, seen = [], 0  # greatest total before each segment
        for s in self.segments:
            self.last.append(seen)
            seen = s[3] if s[4] != 0 else seen

    def floor(self, x: int) -> tuple[int, int, bool]:
        """Bounds of the largest total not above ``x``, and whether they are equal."""
        k = bisect_right(self.starts, x) - 1
        _, _, least, greatest, n = self.segments[k]
        if n == 0:
            return self.last[k], self.last[k], True
        if x >= greatest:
            return greatest, greatest, True
        if n is None:
            return self.last[k], x, False
        if x < least:
            return self.last[k], self.last[k], True
        return (least, least, True) if n <= 2 else (least, min(x, greatest - 1), False)

    def fill(self, capacity: int, shards: int, high: bool) -> list[int]:
        cuts = [0]
        for _ in range(shards):
            x = cuts[-1] + capacity
            cuts.append(self.floor(min(x, self.segments[-1][1] - 1))[high])
        return cuts[1:]

    def refine(self, spans: list[tuple[int, int]], totals: DataFrame) -> None:
        """Summarise the totals within ``spans`` (disjoint, in order) anew, with equal parts in each."""
        parts = max(2, SEGMENTS // len(spans))
        place, edges = None, {}
        for i, (a, b) in enumerate(spans):
            width = -(-(b - a) // parts)
            edges[i] = [(lo, min(b, lo + width)) for lo in range(a, b, width)]
            hit = (F.col("upto") >= a) & (F.col("upto") < b)
            spot = F.lit(i * parts) + F.floor((F.col("upto") - a) / F.lit(width))
            place = F.when(hit, spot) if place is None else place.when(hit, spot)
        rows = (totals.select(place.alias("p"), "upto").filter("p IS NOT NULL").groupBy("p")
                .agg(F.min("upto"), F.max("upto"), F.count(F.lit(1))).collect())  # SEGMENTS rows at most
        found = {r[0]: r[1:] for r in rows}
        fresh = [(lo, hi, *found.get(i * parts + j, (None, None, 0))) for i, e in edges.items() for j, (lo, hi) in enumerate(e)]
        kept = [s for s in self.segments if not any(s[0] < b and s[1] > a for a, b in spans)]
        self.segments = sorted(kept + fresh, key=lambda s: s[0])
        self._index()


def _least(low: int, high: int, good) -> int:
    """Least value above ``low`` and up to ``high`` that is good; ``high`` is."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def minimax_cuts(totals: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """The least capacity, and the running totals at which the shards end. ``totals`` has ``upto``."""
    if total == 0:
        return 0, [0] * shards
    known = _Totals(total)
    known.refine([(0, total + 1)], totals)
    low, high = max(largest, -(-total // shards)) - 1, -(-total // shards) + largest
    while True:
        sure = _least(low, high, lambda c: known.fill(c, shards, False)[-1] >= total)  # fits for certain
        hope = _least(low, sure, lambda c: known.fill(c, shards, True)[-1] >= total)  # nothing smaller can fit
        first, last = known.fill(hope, shards, False), known.fill(sure, shards, True)
        if hope == sure and first == last:
            return sure, first
        low, high, touched = hope - 1, sure, set()
        for a, b in zip([0, *first], [0, *last]):
            i, j = (max(0, bisect_right(known.starts, min(x, total)) - 1) for x in (a + hope, b + sure))
            touched.update(k for k in range(i, j + 1) if known.segments[k][4] > 2)
        spans: list[tuple[int, int]] = []
        for k in sorted(touched):
            a, b = known.segments[k][:2]
            if spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        known.refine(spans, totals)


def _shard_of_groups(rows: DataFrame, shards: int) -> DataFrame:
    """``key, shard`` of every distinct text; ``rows`` has ``key, size, doc_id``."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("first"))
    totals = running_total(groups, [F.col("first").asc_nulls_last(), F.col("key")], "bytes", "upto")
    totals = materialize(totals.select("key", "bytes", "upto"), "shards")
    total, largest = totals.agg(F.max("upto"), F.max("bytes")).first()
    _, cuts = minimax_cuts(totals, total or 0, largest or 0, shards)
    ends = F.array(*[F.lit(c).cast("long") for c in cuts[:-1]])
    return totals.select("key", F.size(F.filter(ends, lambda c: c < F.col("upto"))).alias("shard"))


def _with_slots(rows: DataFrame, by: list) -> DataFrame:
    """A gapless ``slot`` from 0 within each ``shard``; ``by`` orders the rows of a bucket."""
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(SLOT_BUCKETS)))
    sizes = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(*by)
    return (rows.withColumn("_rank", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), ["shard", "_bucket"])  # shards times buckets rows
            .withColumn("slot", F.col("_start") + F.col("_rank")).drop("_bucket", "_start", "_rank"))


def _size():
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def shard_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row, by the law ``bytes``.

    Null texts are one group of rows of size 1, with a null checksum. Null ids stand last. Repeated
    rows are rows of their group. A group larger than its fair share is a shard (nearly) by itself.
    Empty table: no rows.
    """
    rows = docs.select("doc_id", _size().alias("size"), F.crc32("text").alias("text_crc32"), text_key(F.col("text")).alias("key"))
    placed = rows.join(_shard_of_groups(rows, shards), "key")
    slots = _with_slots(placed, ["doc_id", "key"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (columns of those names are replaced)."""
    keyed = docs.select("doc_id", _size().alias("size"), text_key(F.col("text")).alias("key"))
    groups = _shard_of_groups(keyed, shards)
    rows = packed(docs, key=text_key(F.col("text")), doc_id=F.col("doc_id"))
    slots = _with_slots(rows.join(groups, "key"), ["doc_id", "key"])
    return unpacked(slots, [c for c in docs.columns if c not in ("shard", "slot")], F.col("shard"), F.col("slot"))
