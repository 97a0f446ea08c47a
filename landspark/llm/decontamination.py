"""Benchmark decontamination by spaced seeds.

A fixed mask covers a few words and ignores those between them. Benchmark items and documents are hashed
under the masks and joined on the hashes; each hit gives an alignment of a document with an item, which
is then verified word by word. A passage leaks if 13 consecutive words of an item stand in a document
with at most 2 of them replaced (a similarity of 0.8 or more). Two replaced words among 13 always leave
one of the spaced masks whole, so no leak is missed; tests go through all cases. An item of 5 to 12 words
leaks if it stands there whole; shorter ones never do.

Words are compared without ASCII case and punctuation. The benchmark is the query set: it is taken in
blocks of bounded size, each of which is broadcast to one pass over all documents. Documents are never
shuffled, so neither hot sources nor groups of copies matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .common import running_total, word_count

WINDOW, REPLACED, SHORTEST = 13, 2, 5
MASKS = ("11101011", "11001111", "11111")  # spaced ones for whole windows; the last is for short items
BLOCK_WORDS = 250_000  # words of a broadcast block, about 40 MB with its tables
_SLICE = 400_000  # words looked up at once

_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", bytes(range(97, 123)) + b" " * 32)
_BITS = 20


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def _hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each start under a mask, and whether all its words are known (ids above 0)."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out, known, c = np.zeros(n, np.uint64), np.ones(n, bool), 0x9E3779B97F4A7C15
    for j, used in enumerate(mask):
        if used == "1":
            part = ids[j:j + n]
            out += part.astype(np.uint64) * np.uint64(c)
            known &= part > 0
            c = (c * 0xD1342543DE82EF95 + 1) % 2**64 | 1
    return out, known


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - _BITS)).astype(np.int64)


class Block:
    """Hash tables of one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[bytes, int] = {}
        self.items, seqs, at = [], [], 0
        for item_id, text in items:
            words = plain_words(text.encode())
            if len(words) >= SHORTEST:
                seq = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32)
                self.items.append((item_id, at, len(words)))
                seqs += [seq, np.zeros(len(MASKS[0]), np.int32)]  # a gap, so that no mask spans two items
                at += len(seq) + len(MASKS[0])
        self.seq = np.concatenate(seqs) if seqs else np.zeros(0, np.int32)
        self.starts = np.array([s for _, s, _ in self.items], np.int64)
        self.tables = []
        for mask in MASKS:
            h, known = _hashes(self.seq, mask)
            place = np.flatnonzero(known)
            order = np.argsort(h[place], kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[_slot(h[place])] = True
            self.tables.append((mask, h[place][order], place[order], bits))

    def _alignments(self, ids: np.ndarray) -> np.ndarray:
        """Distinct (start of the item's alignment in ``ids``, item) over all hits."""
        found = []
        for mask, keys, places, bits in self.tables:
            h, known = _hashes(ids, mask)
            at = np.flatnonzero(known & bits[_slot(h)])
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if len(at):
                each = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                place = places[each]
                item = np.searchsorted(self.starts, place, "right") - 1
                found.append(np.stack([np.repeat(at, n) - (place - self.starts[item]), item]))
        return np.unique(np.concatenate(found, axis=1), axis=1).T if found else np.zeros((0, 2), np.int64)

    def leaks(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(index of the text, item, first word, end word, equal words) of the longest leak of each item."""
        block: list[int] = []
        bounds: list[tuple[int, int, int]] = []  # index, start and end in block
        for k, text in enumerate(texts):
            if text:
                get, start = self.vocab.get, len(block)
                block.extend([get(w, 0) for w in plain_words(text)])
                bounds.append((k, start, len(block)))
                block.extend([0] * len(MASKS[0]))
            if bounds and (len(block) > _SLICE or k == len(texts) - 1):
                yield from self._verified(np.array(block, np.int32), bounds)
                block, bounds = [], []
        if bounds:
            yield from self._verified(np.array(block, np.int32), bounds)

    def _verified(self, ids: np.ndarray, bounds: list[tuple[int, int, int]]):
        starts = np.array([b[1] for b in bounds])
        best: dict[tuple[int, int], tuple] = {}
        for shift, item in self._alignments(ids):
            item_id, at, n = self.items[item]
            # the alignment may begin before the document does: the hit lies in the document of its first inner word
            lo = max(shift, 0)
            for b in range(max(0, np.searchsorted(starts, lo, "right") - 1), len(bounds)):
                k, a, e = bounds[b]
                if a >= shift + n:
                    break
                i, j = max(a, shift), min(e, shift + n)
                size = min(n, WINDOW)
                if j - i < size:
                    continue
                equal = ids[i:j] == self.seq[at + i - shift:at + j - shift]
                total = np.concatenate([[0], np.cumsum(equal)])
                good = np.flatnonzero(total[size:] - total[:-size] >= size - (REPLACED if n >= WINDOW else 0))
                if len(good):
                    first, end = int(good[0]), int(good[-1]) + size
                    row = (end - first, -(i + first - a), k, item_id, i + first - a, i + end - a, int(total[end] - total[first]))
                    if (k, item_id) not in best or row > best[k, item_id]:
                        best[k, item_id] = row
        for row in best.values():
            yield row[2:]


def _blocks(benchmark: DataFrame, words: int) -> list:
    """Broadcast blocks of about ``words`` words of distinct items."""
    spark = benchmark.sparkSession
    ship_package(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    items = running_total(items.withColumn("n", word_count(F.col("text"))), ["item_id", "text"], "n", "upto")
    items = items.withColumn("block", F.floor((F.col("upto") - F.col("n")) / words))
    numbers = sorted(r[0] for r in items.select("block").distinct().collect())  # one per pass over the documents
    return [spark.sparkContext.broadcast(Block([tuple(r) for r in items.filter(F.col("block") == b).select("item_id", "text").collect()]))
            for b in numbers]


def leak_report(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, first_word, end_word, n_equal``: one row per document row and leaked item.

    ``first_word`` to ``end_word`` (exclusive) is the longest stretch whose first and last 13 words leak.
    Null or short texts leak nothing. Repeated documents are reported each; repeated items once. An empty
    table on either side: no rows.
    """
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word long, end_word long, n_equal long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for held in _blocks(benchmark, block_words):
        def scan(batches, held=held):
            block = held.value
            for batch in batches:
                ids = batch.column(0)
                found = list(block.leaks(batch.column(1).cast(pa.binary()).to_pylist()))
                if found:
                    k, item, first, end, equal = zip(*found)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), *(pa.array(x, pa.int64()) for x in (item, first, end, equal))],
                                                     names=["doc_id", "item_id", "first_word", "end_word", "n_equal"])
        out = out.unionAll(rows.mapInArrow(scan, out.schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no item leaks; no shuffle."""
    schema, text = docs.schema, docs.columns.index("text")
    for held in _blocks(benchmark, block_words):
        def keep(batches, held=held):
            block = held.value
            for batch in batches:
                leaked = {row[0] for row in block.leaks(batch.column(text).cast(pa.binary()).to_pylist())}
                yield batch.filter(pa.array([k not in leaked for k in range(batch.num_rows)], pa.bool_()))
        docs = docs.mapInArrow(keep, schema)
    return docs
