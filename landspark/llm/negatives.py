"""Hard negatives by exact scores from a residue number system.

Components are whole numbers: ``floor(256 * x)``. An inner product of whole numbers is taken modulo several small primes,
each as one float32 matrix product whose sums stay below 2**24 and so are exact; longer vectors are multiplied in parts
of ``p``-dependent length. The signed score comes back by Chinese remaindering with balanced mixed-radix digits. As many
primes are taken as the greatest squared length in the table calls for (a score is no larger, by Cauchy and
Schwarz), and scores that a long cannot hold are refused with an error, not wrapped.

Rows are packed once into blocks of bounded size, sorted by label. Anchors are cut out of the blocks. Each block of
anchors is repeated for every share of row blocks, an equality join brings the two together, and each task multiplies
one pair of blocks at a time. In a first pass only rows of the anchors' labels are multiplied and give the
positives; in a second one the positives' scores set the windows, and each window keeps its best rows of other labels. Either way at most
``POSITIVES`` or ``NEGATIVES`` rows per pair of blocks and window leave a task; ranks then come from one grouped
selection. All anchors meet all rows, in blocks; nothing is sampled.

Rows with a null label, a null vector or a component that is null or not finite take no part. A vector that is shorter
than another counts as filled up with zeros. Rows are told apart by their place, so repeated rows, equal ids and null ids
(after all others in ties; never anchors) are rows of their own; an anchor that stands twice is reported twice and may be its
own twin's positive. Other columns are not read. Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize, ship_package

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
ROWS_PER_BLOCK, CELLS, MULTIPLY = 32768, 4 << 20, 128  # rows and components of a block; anchors in one product
_EXACT, _LAST = 2**24, 2**63 - 1
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983, 977)


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Whole float32 numbers below 2**24, less the nearest multiple of ``p``: at most ``p / 2 + 2`` in size."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def primes_for(bound: int) -> tuple[int, ...]:
    """The fewest primes whose product leaves room between all whole numbers of at most ``bound`` in size."""
    product = 1
    for n, p in enumerate(PRIMES, 1):
        product *= p
        if product > 3 * bound:  # digits a little above half of a prime cannot reach another number
            return PRIMES[:n]
    raise ValueError(f"more than {len(PRIMES)} primes needed for scores up to {bound}")


def residues(m: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """The matrix modulo each prime, between -(p-1)/2 and (p-1)/2."""
    rests = [(np.remainder(m, p), p) for p in primes]
    return [(r - p * (r > p // 2)).astype(np.float32) for r, p in rests]


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products, as longs, of the rows whose residues ``a`` and ``b`` are."""
    width = min(a[0].shape[1], b[0].shape[1])  # beyond it one of the two is zero
    out, weight, digits = np.zeros((len(a[0]), len(b[0])), np.int64), 1, []
    for k, (p, x, y) in enumerate(zip(primes, a, b)):
        step = (_EXACT - 1) // (p // 2) ** 2
        digit = np.zeros(out.shape, np.float32)
        for c in range(0, width, step):
            digit = _centred(digit + _centred(x[:, c:min(c + step, width)] @ y[:, c:min(c + step, width)].T, p), p)
        for q, d in zip(primes[:k], digits):
            digit = _centred((digit - d) * np.float32(pow(q, -1, p) if 2 * pow(q, -1, p) < p else pow(q, -1, p) - p), p)
        digits.append(digit)
        out += digit.astype(np.int64) * np.int64(weight % 2**64 - (2**64 if weight % 2**64 >= 2**63 else 0))  # wraps; the sum does not
        weight *= p
    return out


def _pack(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m).tobytes()


def _packer(width: int, rows_per_block: int):
    """Blocks of rows, sorted by label, then id: ids, which are null, labels, components, greatest squared length."""
    def pack(batches):
        base, n, held, count = TaskContext.get().partitionId() << 33, 0, [], 0

        def block():
            null, ids, labels, vectors = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((ids, null, labels))
            vectors = vectors[order]
            most = np.abs(vectors).max(initial=0)
            kind = next(t for t in (np.int8, np.int16, np.int32, np.float64) if t is np.float64 or most <= np.iinfo(t).max)
            squares = float((vectors * vectors).sum(axis=1).max(initial=0))
            values = [base + n, len(order), _pack(ids[order]), _pack(null[order]), _pack(labels[order]), np.dtype(kind).str, _pack(vectors.astype(kind)), squares]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK.types)], schema=_BLOCK)

        for batch in batches:
            for part in (batch.slice(i, rows_per_block) for i in range(0, batch.num_rows, rows_per_block)):
                lists = part.column(2)
                sizes = np.diff(lists.offsets.to_numpy())
                vectors = np.zeros((part.num_rows, width))
                vectors[np.repeat(np.arange(part.num_rows), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(_LAST).to_numpy(zero_copy_only=False)
                rows = part.column(0).is_null().to_numpy(zero_copy_only=False), ids, part.column(1).to_numpy(zero_copy_only=False), np.floor(SCALE * vectors)
                if held and count + part.num_rows > rows_per_block:
                    yield block()
                    n, held, count = n + 1, [], 0
                held.append(rows)
                count += part.num_rows
        if held:
            yield block()
    return pack


_BLOCK = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("null", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("vectors", pa.binary()), ("squares", pa.float64())])
_BLOCK_DDL = "block long, n int, ids binary, null binary, labels binary, kind string, vectors binary, squares double"


class _Block:
    def __init__(self, n, ids, null, labels, kind, vectors):
        self.ids, self.null, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(null, bool), np.frombuffer(labels, np.int64)
        m = np.frombuffer(vectors, kind)
        self.vectors = m.reshape(n, -1) if n else m.reshape(0, 0)
        self.vectors = self.vectors.astype(np.int64 if m.dtype.kind == "i" else np.float64)


def blocks(rows: DataFrame) -> DataFrame:
    """All rows that take part, packed."""
    spark = rows.sparkSession
    ship_package(spark)
    number, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.when(number % 7 == 0, (label + 1) % 10).otherwise(label)
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = rows.select(number.alias("id"), moved.alias("label"), vector.alias("vector")).filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    n, width = some.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    size = max(1, min(ROWS_PER_BLOCK, CELLS // max(width or 1, 1)))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n / size))  # small input parts are put together, none is moved
    return materialize(some.coalesce(tasks).mapInArrow(_packer(max(width or 1, 1), size), _BLOCK_DDL), "blocks")


_ANCHOR = pa.schema([("anchors", pa.string()), ("rows", pa.list_(pa.int64())), *[(f.name, f.type) for f in _BLOCK][1:-1]])
_ANCHOR_DDL = "anchors string, rows array<long>, n int, ids binary, null binary, labels binary, kind string, vectors binary"


def _anchors(every: int, most: int):
    """Anchors of each block, with the numbers of their rows: block and place in it."""
    def cut(batches):
        for batch in batches:
            for block, n, ids, null, labels, kind, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                b = _Block(n, ids, null, labels, kind, vectors)
                found = np.flatnonzero(~b.null & (b.ids % every == 0))
                for k in range(0, len(found), most):
                    at = found[k:k + most]
                    values = [f"{block}:{k}", at.tolist(), len(at), _pack(b.ids[at]), _pack(b.null[at]), _pack(b.labels[at]), kind, _pack(b.vectors[at].astype(kind))]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ANCHOR.types)], schema=_ANCHOR)
    return cut


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores; of equal ones the earlier, which have the smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.argsort(-score[some], kind="stable")[:k]]


_FOUND = pa.schema([("anchor", pa.string()), ("anchor_id", pa.int64()), ("positive", pa.int32()), ("id", pa.int64()), ("none", pa.bool_()), ("score", pa.int64())])
_FOUND_DDL = "anchor string, anchor_id long, positive int, id long, none boolean, score long"


def _found(columns) -> pa.RecordBatch:
    parts = [np.concatenate(c) if c else np.array([], object) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(parts, _FOUND)], schema=_FOUND)


def _nearest(primes, keep):
    """Best rows of the anchors' own labels, per pair of blocks."""
    def work(batches):
        for batch in batches:
            for block, *row_side, name, at, n, ids, null, labels, kind, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                r, a, out = _Block(*row_side), _Block(n, ids, null, labels, kind, vectors), [[] for _ in _FOUND]
                own = block == int(name.split(":")[0])
                x, y = residues(a.vectors, primes), residues(r.vectors, primes)
                for label in np.unique(a.labels):
                    lo, hi = np.searchsorted(r.labels, [label, label + 1])
                    mine = np.flatnonzero(a.labels == label)
                    for k in range(0, len(mine) if hi > lo else 0, MULTIPLY):
                        some = mine[k:k + MULTIPLY]
                        for i, line in zip(some, scores([m[some] for m in x], [m[lo:hi] for m in y], primes)):
                            places = np.arange(lo, hi)
                            if own:
                                line, places = line[places != at[i]], places[places != at[i]]
                            best = _first(line, keep)
                            at_row = places[best]
                            for c, v in zip(out, ([f"{name}:{i}"] * len(best), [a.ids[i]] * len(best), np.zeros(len(best), np.int32), r.ids[at_row], r.null[at_row], line[best])):
                                c.append(np.asarray(v, object) if c is out[0] else np.asarray(v))
                yield _found(out)
    return work


def _windowed(primes, keep, low, high):
    """Best rows of other labels in the window of each positive, per pair of blocks."""
    def work(batches):
        for batch in batches:
            for _, *row_side, name, at, n, ids, null, labels, kind, vectors, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                r, a, out = _Block(*row_side), _Block(n, ids, null, labels, kind, vectors), [[] for _ in _FOUND]
                by_id = np.lexsort((r.ids, r.null))  # ties go by id, whatever the label
                row_labels, row_ids, row_null = r.labels[by_id], r.ids[by_id], r.null[by_id]
                x, y = residues(a.vectors, primes), residues(r.vectors[by_id], primes)
                windows = {w["i"]: w["scores"] for w in wanted}
                asked = np.array(sorted(windows), int)
                for k in range(0, len(asked), MULTIPLY):
                    some = asked[k:k + MULTIPLY]
                    for i, line in zip(some, scores([m[some] for m in x], y, primes)):
                        sizes = [s for s in windows[i] if s >= 0]  # a window of a negative score is empty
                        if not sizes:
                            continue
                        bottom, top = -(-low * min(sizes) // 100), high * max(sizes) // 100
                        near = np.flatnonzero((row_labels != a.labels[i]) & (line >= bottom) & (line <= top))
                        near = near[np.argsort(-line[near], kind="stable")]
                        falling = -line[near]
                        for place, s in enumerate(windows[i]):
                            if s < 0:
                                continue
                            start, stop = np.searchsorted(falling, -(high * s // 100)), np.searchsorted(falling, low * s // -100, "right")
                            best = near[start:min(stop, start + keep)]
                            for c, v in zip(out, ([f"{name}:{i}"] * len(best), [a.ids[i]] * len(best), np.full(len(best), place, np.int32), row_ids[best], row_null[best], line[best])):
                                c.append(np.asarray(v, object) if c is out[0] else np.asarray(v))
                yield _found(out)
    return work


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` rows of each anchor and window with their ``rank``; Spark cuts the lists before it shuffles them."""
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "none", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of all anchors and their positives."""
    spark = rows.sparkSession
    packed = blocks(rows)
    squares, n = packed.agg(F.max("squares"), F.count(F.lit(1))).first()
    if (squares or 0.0) >= 2**61:
        raise ValueError("components too large: scores would not fit a long")
    primes = primes_for(math.ceil((squares or 0.0) * (1 + 1e-9)) + 1)
    anchors = materialize(packed.drop("squares").mapInArrow(_anchors(every, 1024), _ANCHOR_DDL), "anchors")
    shares = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n))
    side = [F.col(c) for c in ("block", "n", "ids", "null", "labels", "kind", "vectors")]
    dealt = packed.select(F.pmod(F.shiftright("block", 33) + F.col("block").bitwiseAND(F.lit(2**33 - 1)), F.lit(shares)).alias("share"), *[c.alias(f"r_{k}") for k, c in enumerate(side)])
    spread = anchors.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    both = [f"r_{k}" for k in range(len(side))] + ["anchors", "rows", "n", "ids", "null", "labels", "kind", "vectors"]
    near = spread.join(dealt, "share").select(*both).mapInArrow(_nearest(primes, positives), _FOUND_DDL)
    chosen = materialize(_ranked(near, positives).withColumn("positive", F.col("rank") - 1), "positives")
    # windows of one block of anchors, at most 1,024 of ``positives`` numbers each
    per_anchor = chosen.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive", "score"))), lambda x: x["score"]).alias("scores"))
    name = F.substring_index("anchor", ":", 2)
    wanted = per_anchor.groupBy(name.alias("anchors")).agg(F.collect_list(F.struct(F.substring_index("anchor", ":", -1).cast("int").alias("i"), "scores")).alias("wanted"))
    asked = anchors.join(wanted, "anchors").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    met = asked.join(dealt, "share").select(*both, "wanted").mapInArrow(_windowed(primes, negatives, low, high), _FOUND_DDL)
    best = _ranked(met, negatives)
    said = chosen.select("anchor", "positive", F.when(~F.col("none"), F.col("id")).alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(said, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("none"), F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH s AS (SELECT row_number() OVER () AS row, vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) IS NOT FALSE),
t AS (SELECT * FROM s WHERE label IS NOT NULL),
a AS (SELECT * FROM t WHERE id % 100 = 0),
x AS (SELECT a.row AS anchor, a.id AS anchor_id, t.id, t.label = a.label AS same, list_inner_product(a.v, t.v)::BIGINT AS score FROM a JOIN t ON a.row <> t.row),
p AS (SELECT anchor, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k FROM x WHERE same QUALIFY k <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor, k ORDER BY score DESC, id) AS rank FROM p JOIN x USING (anchor)
  WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score QUALIFY rank <= {NEGATIVES})
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n"""
