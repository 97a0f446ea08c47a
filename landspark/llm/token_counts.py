"""Token counts from flat, unindexed token files by a separator scan.

A flat file is a stream of token identifiers in which each document ends with an end-of-document
identifier; nothing says where documents lie. ``write_flat`` makes such streams, one per input
partition, kept as blocks of fixed length that cut documents anywhere. ``scan`` searches each block for
separators with one vectorised comparison. Documents that cross blocks are stitched by a prefix scan over
the blocks of a stream: the separators before a block number its documents, and the last separator
before it tells how much of its first document lies in earlier blocks. Only one short row per block
takes part in the scan; token identifiers are never shuffled.
"""

from __future__ import annotations

import base64
import importlib.util
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path, ship_package

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
END = 50_256  # the free identifier, end of document
BLOCK = 1 << 16  # identifiers in a block
_LONG = re.compile(r"\S{20000}")  # longer runs are cut: merging takes time by the square of a run


@lru_cache(maxsize=2)
def _encoder(folder: str, ranks: str):
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
    described = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(described)
    with open(described.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=described.PATTERN, mergeable_ranks=table, special_tokens={})


def token_ids(text: str | None, folder: str = TOKENIZERS, ranks: str = RANKS) -> list[int]:
    """Identifiers of a text; runs of 20,000 characters without white space are encoded apart."""
    if not text:
        return []
    encode, out, at = _encoder(folder, ranks).encode_ordinary, [], 0
    for m in _LONG.finditer(text):
        out += encode(text[at:m.end()])
        at = m.end()
    return out + encode(text[at:])


def write_flat(docs: DataFrame, folder: str = TOKENIZERS, ranks: str = RANKS, block: int = BLOCK) -> str:
    """Tokenise ``docs`` into flat streams in the shared scratch folder; the path.

    Rows with ``kind`` 0 are blocks (``stream``, ``at``: number in the stream, ``ids``: little-endian,
    16 bits each), rows with ``kind`` 1 name the documents in the order of the stream.
    """
    ship_package(docs.sparkSession)

    def encode(batches):
        stream, rows, at, held = TaskContext.get().partitionId(), 0, 0, np.zeros(0, "<u2")

        def blocks(parts, last):
            nonlocal at, held
            held = np.concatenate([held, *parts])
            full = len(held) // block if not last else -(-len(held) // block)
            cut = [held[k * block:(k + 1) * block].tobytes() for k in range(full)]
            held, n, first = held[full * block:], len(cut), at
            at += n
            return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([stream] * n, pa.int32()), pa.array(range(first, at), pa.int64()),
                                               pa.nulls(n, pa.int64()), pa.array(cut, pa.binary())], names=names)

        names = ["kind", "stream", "at", "doc_id", "ids"]
        for batch in batches:
            n, parts, size = batch.num_rows, [], 0
            yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int32()), pa.array([stream] * n, pa.int32()), pa.array(range(rows, rows + n), pa.int64()),
                                              batch.column(0), pa.nulls(n, pa.binary())], names=names)
            rows += n
            for text in batch.column(1):
                parts.append(np.array([*token_ids(text.as_py(), folder, ranks), END], "<u2"))
                size += len(parts[-1])
                if size > 32 * block:
                    yield blocks(parts, False)
                    parts, size = [], 0
            yield blocks(parts, False)
        yield blocks([], True)

    path = scratch_path(docs.sparkSession, "flat")
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "kind int, stream int, at long, doc_id long, ids binary")
    flat.write.option("compression", "zstd").parquet(path)
    return path


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """``stream, at, n_tokens`` of every document: ``at`` counts documents in a stream from 0.

    ``blocks``: ``stream``, ``at`` (block number), ``ids``. Separators are not counted. What stands after
    the last separator of a stream, if anything, is a document too.
    """
    def search(batches):
        for batch in batches:
            size, last, gaps = [], [], []
            for raw in batch.column(2):
                ids = np.frombuffer(raw.as_py() or b"", "<u2")
                at = np.flatnonzero(ids == end)
                size.append(len(ids))
                last.append(int(at[-1]) + 1 if len(at) else None)  # what follows the last separator
                gaps.append(np.diff(at, prepend=-1) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(last, pa.int64()),
                                              pa.array(gaps, pa.list_(pa.int64()))], names=["stream", "block", "size", "last", "gaps"])

    found = blocks.select("stream", "at", "ids").mapInArrow(search, "stream int, block long, size long, last long, gaps array<long>")
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    found = found.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    found = (found.withColumn("ended", F.coalesce(F.sum(F.size("gaps")).over(before), F.lit(0)))
             .withColumn("open", F.col("start") - F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(0))))
    whole = found.select("stream", "ended", "open", F.posexplode("gaps").alias("k", "gap")).select(
        "stream", (F.col("ended") + F.col("k")).alias("at"), (F.col("gap") + F.when(F.col("k") == 0, F.col("open")).otherwise(0)).alias("n_tokens"))
    rest = found.groupBy("stream").agg(F.sum(F.size("gaps")).alias("at"), (F.sum("size") - F.coalesce(F.max(F.col("start") + F.col("last")), F.lit(0))).alias("n_tokens"))
    return whole.unionAll(rest.filter("n_tokens > 0"))


def token_counts(docs: DataFrame, folder: str = TOKENIZERS, ranks: str = RANKS, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens`` of every row, through flat files.

    Null and empty texts have 0 tokens. Repeated rows are counted each. Separator text within a document
    is ordinary text. Empty table: no rows.
    """
    flat = docs.sparkSession.read.schema("kind int, stream int, at long, doc_id long, ids binary").parquet(write_flat(docs, folder, ranks, block))
    names = flat.filter("kind = 1").select("stream", "at", "doc_id")
    return names.join(scan(flat.filter("kind = 0")), ["stream", "at"]).select("doc_id", "n_tokens")
