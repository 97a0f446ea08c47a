"""Substring dedup by compaction of a De Bruijn graph.

Windows of 20 words are the edges of the graph. In each text, consecutive edges that share a minimizer
(the least hash among their 8-word parts) form a stretch. All occurrences of an edge lie in stretches of
its minimizer. So if the stretches of a minimizer have the same words everywhere, they are one
nonbranching path, whose edges occur together, and one row stands for all of them. Where they differ the
path branches, and its stretches are taken apart into single edges. Joins on the minimizer, later on the
edge, tell which stretches and edges repeat and which document has them first.

Paths are compared by digests of the words at their coordinates. Before anything is removed, the digest is
taken again from the text at the coordinates, so a span goes only if its words are those of the source.
Repeats within one document are found in its own task.

Exact copies share a digest of the whole text: a copy of an earlier document goes entirely, and a task
sends on only the first of the copies that it reads, so a large group of copies does not swell the joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from ..session import materialize, ship_package
from .common import text_key

WINDOW, PART = 20, 8
FILTER_ROWS = 2_000_000  # ids of a list that may be broadcast to thin out texts before a shuffle (16 MB)
_LAST = 2**63 - 1  # stands for a null id: after all others
_B = 0x9E3779B97F4A7C15
_EMPTY = hashlib.sha256(b"").hexdigest()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxh3_64_intdigest(word)
        return h


def _rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.full(n, _B, np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(n - size + 1, pow(_B, -1, 2**64), np.uint64), dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
    out = (total[size:] - total[:-size]) * back
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xD1342543DE82EF95)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    done, out = 1, h
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def stretches(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each stretch."""
    if len(h) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _least(_rolling(h, PART), WINDOW - PART + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    return least[first], first, np.diff(first, append=len(least))


def repeats(h: np.ndarray) -> np.ndarray:
    """First words of the windows that also start earlier in the same text."""
    w = _rolling(h, WINDOW)
    if not len(w):
        return np.zeros(0, np.int64)
    again = np.ones(len(w), bool)
    again[np.unique(w, return_index=True)[1]] = False
    return np.flatnonzero(again)


def _kept(words: list[bytes], starts: np.ndarray) -> tuple[int, str]:
    """Number of words covered by the windows at ``starts``, and the digest of the others."""
    if not len(starts):
        return 0, hashlib.sha256(b" ".join(words)).hexdigest()
    edge = np.bincount(starts, minlength=len(words) + WINDOW + 1) - np.bincount(starts + WINDOW, minlength=len(words) + WINDOW + 1)
    gone = np.cumsum(edge)[:len(words)] > 0
    return int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest()


def _hashed(words: list[bytes], known: dict) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class _Spans:
    """Digests of stretches of words, taken from the words joined by one space."""

    def __init__(self, words: list[bytes]):
        self.n, self.joined = len(words), b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()

    def of(self, first: int, windows: int) -> bytes:
        return self.joined[self.ends[first - 1] if first else 0:self.ends[first + windows + WINDOW - 2] - 1]

    def stands(self, span: dict) -> bool:
        """Whether the text has the words of the span at its coordinates."""
        end = span["at"] + span["n"] + WINDOW - 1
        return end <= self.n and xxh3_64_intdigest(self.of(span["at"], span["n"])) == span["digest"] % 2**64


_READ = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("minimizer", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()), ("n", pa.int32()),
                   ("key", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_READ_SQL = "kind int, doc long, minimizer long, digest long, at int, n int, key binary, n_words long, n_removed long, kept_sha256 string"


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _read(batches):
    """Kind 0: a document by itself. Kind 1: a stretch."""
    known, seen = _Hashes(), {}
    for batch in batches:
        docs, parts = [], []
        for doc, raw, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            words = (raw.as_py() or b"").split()
            h = _hashed(words, known)
            docs.append((doc, key, len(words), *_kept(words, repeats(h))))
            if len(words) < WINDOW or seen.get(key, _LAST) <= doc and key in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen[key] = doc
            minimizer, first, n = stretches(h)
            spans = _Spans(words)
            digest = [xxh3_64_intdigest(spans.of(a, k)) for a, k in zip(first.tolist(), n.tolist())]
            parts.append((np.full(len(n), doc), minimizer.view(np.int64), _signed(digest), first, n))
        doc, key, n_words, n_removed, kept = zip(*docs) if docs else ((),) * 5
        m = len(docs)
        none = lambda t: pa.nulls(m, t)
        yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array(doc, pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int32()),
                                          pa.array(key, pa.binary()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema=_READ)
        if parts:
            c = [np.concatenate(x) for x in zip(*parts)]
            m = len(c[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m), pa.int32()), pa.array(c[0]), pa.array(c[1]), pa.array(c[2]), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()),
                                              none(pa.binary()), none(pa.int64()), none(pa.int64()), none(pa.string())], schema=_READ)


def _edges(batches):
    """The single windows of the listed stretches, with two digests of their words."""
    for batch in batches:
        out = []
        for doc, raw, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
            text = _Spans(raw.as_py().split())
            for span in spans:
                if text.stands(span):  # else it is of another text with this id
                    for k in range(span["at"], span["at"] + span["n"]):
                        words = text.of(k, 1)
                        out.append((doc, k, xxh3_64_intdigest(words, 1), xxh3_64_intdigest(words)))
        doc, at, high, low = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(_signed(high)), pa.array(_signed(low))], names=["doc", "at", "high", "low"])


def _removed(batches):
    """What is left of the texts without the listed spans and without repeats of their own."""
    known = _Hashes()
    for batch in batches:
        out = []
        for doc, raw, spans, key in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = raw.as_py().split()
            starts = [repeats(_hashed(words, known))]
            text = _Spans(words)
            starts += [np.arange(span["at"], span["at"] + span["n"]) for span in spans if text.stands(span)]  # the digest is the source's
            out.append((doc, key, *_kept(words, np.unique(np.concatenate(starts)))))
        doc, key, n, kept = zip(*out) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(kept, pa.string())], names=["doc", "key", "n", "kept"])


def _with_lists(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """``texts`` with the list of its ``doc``. If the ids of the lists are few enough they first thin out the texts
    in place of shuffling all; the join is the same with or without that."""
    if lists.count() <= FILTER_ROWS:
        texts = texts.join(F.broadcast(lists.select("doc")), "doc", "left_semi")
    return texts.join(lists, "doc")


def substring_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    A word goes if a window that covers it also starts earlier, in the same document or in one of a smaller
    id. Null and empty texts have no words. Rows that share an id are not earlier than one another, so
    repeated rows have equal results; null ids count as one id after all others. Empty table: no rows.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text", text_key(F.col("text")).alias("key"))
    read = materialize(texts.mapInArrow(_read, _READ_SQL), "stretches")
    alone = read.filter("kind = 0").select("doc", "key", "n_words", "n_removed", "kept_sha256")
    parts = read.filter("kind = 1").select("doc", "minimizer", "digest", "at", "n")

    path = parts.groupBy("minimizer").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    path = path.filter("first < last").select("minimizer", "first", (F.col("low") < F.col("high")).alias("branches"))
    met = materialize(parts.join(path, "minimizer").select("doc", "at", "n", "digest", "first", "branches"), "met")

    span = F.struct("at", "n", "digest")
    apart = materialize(met.filter("branches").groupBy("doc").agg(F.collect_list(span).alias("spans")), "branching")
    edges = materialize(_with_lists(texts.select("doc", "text"), apart).mapInArrow(_edges, "doc long, at int, high long, low long"), "edges")
    source = edges.groupBy("high", "low").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("high", "low", "first")
    single = edges.join(source, ["high", "low"]).select("doc", "at", F.lit(1).alias("n"), F.col("low").alias("digest"), "first")

    spans = met.filter("NOT branches").select("doc", "at", "n", "digest", "first").unionAll(single).filter("first < doc")
    lists = materialize(spans.groupBy("doc").agg(F.collect_list(span).alias("spans")), "spans")
    source_of = materialize(alone.groupBy("key").agg(F.min("doc").alias("source")), "sources")
    left = _with_lists(texts, lists).select("doc", "text", "spans", "key").mapInArrow(_removed, "doc long, key binary, n long, kept string")
    left = left.groupBy("doc", "key").agg(F.first("n").alias("n"), F.first("kept").alias("kept"))

    copy = (F.col("source") < F.col("doc")) & (F.col("n_words") >= WINDOW)
    out = alone.join(source_of, "key").join(left, ["doc", "key"], "left")
    return out.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "n_words",
                      F.when(copy, F.col("n_words")).otherwise(F.coalesce("n", "n_removed")).alias("n_removed"),
                      F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept", "kept_sha256")).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {_LAST}) AS doc, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, doc, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
x AS (SELECT r, i FROM (SELECT r, doc, i, min(doc) OVER (PARTITION BY g) AS first, row_number() OVER (PARTITION BY r, g ORDER BY i) AS nth FROM g)
    WHERE first < doc OR nth > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM x),
k AS (SELECT d.r, string_agg(w[p.i], ' ' ORDER BY p.i) FILTER (WHERE c.i IS NULL) AS kept, count(c.i) AS n_removed
    FROM (SELECT r, unnest(range(1, len(w) + 1)) AS i FROM d) p JOIN d USING (r) LEFT JOIN c ON c.r = p.r AND c.i = p.i GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
