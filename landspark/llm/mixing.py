"""Mixing sources to target weights by nested hash thresholds.

Every document has a fixed 60-bit hash. A source that needs ``q`` whole repeats and a rest takes all
its documents ``q`` times, and those below a threshold once more. Sums by source and hash bucket
show in which bucket the rest is reached; only that bucket is cut finer, until it holds one hash.
Thresholds are nested: a larger budget keeps every document that a smaller one takes. Nothing is
sorted, and a hot source spreads over its buckets. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .common import packed, unpacked, word_count

HASH_BITS = 60
LEVEL_BITS = 12  # each level parts a bucket into 4,096


def mix_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h`` of every document; a null text has size 0."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                       mix_hash().alias("h"))


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size, target``: sources in code point order, null last, weigh ``weights`` in turn.

    The total size is dealt by weight; a target stops at ``most`` times its source, and the excess goes
    to the others by weight until none is above. With the sources sorted by ``cap / weight`` the capped
    ones come first, so running sums give the level directly. One row per source meets in a task.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everyone, earlier = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
         .withColumn("weight_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))))
    fits = F.col("left") * F.col("w") <= F.col("cap") * F.col("weight_left")  # the level lies below this source's cap
    first = F.min(F.when(fits, F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.coalesce("source", F.lit("")),
                                        F.col("left").alias("l"), F.col("weight_left").alias("wl")))).over(everyone)
    s = s.withColumn("first", first)
    share = F.col("first.l") * F.col("w") / F.col("first.wl")
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), share.cast("double")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``repeats`` (whole takes), and ``below``: documents with ``h < below`` are taken once more.

    The document at the boundary is taken if that brings the source nearer to its target. Rows with
    equal hash (the same id and text) go together.
    """
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("repeats", repeats)
    goals = materialize(goals.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size")), "goals")
    # (lo, hi): the hashes of the boundary bucket, before: what lies below it
    front, shift = goals.select("source", "budget", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("before")), HASH_BITS
    while True:
        up, shift = shift, max(0, shift - LEVEL_BITS)
        low = F.shiftright("h", shift)
        inside = sizes.withColumnRenamed("source", "s").join(
            front.select("source", F.col("bucket").alias("up")), F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("h", up) == F.col("up")))
        sums = inside.groupBy("s", low.alias("bucket")).agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        sums = sums.join(front.select("source", "budget", "before"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # a level's buckets at most
        sums = sums.withColumn("upto", F.col("before") + upto)
        front = materialize(sums.filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")))
                            .select("source", "budget", "bucket", (F.col("upto") - F.col("n")).alias("before"), "n", "lo", "hi"), "front")
        if shift == 0 or front.filter("lo < hi").isEmpty():
            break
    nearer = F.col("before") + F.col("n") - F.col("budget") < F.col("budget") - F.col("before")
    cut = front.select(F.col("source").alias("s"), F.when(nearer, F.col("lo") + 1).otherwise(F.col("lo")).alias("below"))
    out = goals.join(cut, F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
    return materialize(out.select("source", "source_size", "target", "repeats", F.coalesce("below", F.lit(0)).alias("below")), "cuts")


def _with_cuts(df: DataFrame, source: Column, cuts: DataFrame) -> DataFrame:
    """One row per source is read from files: Spark broadcasts it below its size limit, else it shuffles."""
    return df.join(cuts.withColumnRenamed("source", "_source"), source.eqNullSafe(F.col("_source")), "left").drop("_source")


def mix_report(docs: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.

    Null text: size 0. Null source: a source of its own, last in order. Empty table: no rows. Repeated
    rows count as often as they stand there; equal ids with equal texts are taken or left together.
    A source without words takes nothing.
    """
    sizes = materialize(sized(docs), "sizes")
    cuts = thresholds(sizes, targets(sizes, weights, most))
    taken = F.col("size") * (F.col("repeats") + (F.col("h") < F.col("below")).cast("long"))
    return _with_cuts(sizes, F.col("source"), cuts).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, weights: tuple = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    sizes = materialize(sized(docs), "sizes")
    cuts = thresholds(sizes, targets(sizes, weights, most))
    rows = packed(docs, _h=mix_hash(), _s=F.col("source").cast("string"))
    times = (F.col("repeats") + (F.col("_h") < F.col("below")).cast("long")).cast("int")
    out = _with_cuts(rows, F.col("_s"), cuts).filter(times > 0).select("_row", F.explode(F.sequence(F.lit(1), times)))
    return unpacked(out, docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(cast(doc_id AS varchar), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s),
o AS (SELECT *, sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
    sum(w) OVER (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wl FROM w),
lev AS (SELECT l, wl FROM o WHERE l * w <= 3 * n * wl ORDER BY 3 * n / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, n, least((3 * n)::DOUBLE, (lev.l * w)::DOUBLE / lev.wl) AS target FROM w, lev),
b AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n)::BIGINT ELSE 0 END AS q FROM t),
g AS (SELECT source, h, sum(size) AS g FROM d GROUP BY ALL),
c AS (SELECT g.source, h, g, sum(g) OVER (PARTITION BY g.source ORDER BY h) AS upto FROM g),
e AS (SELECT c.source, h, upto <= target - q * n OR (upto - g <= target - q * n AND upto - (target - q * n) < target - q * n - (upto - g)) AS extra
    FROM c JOIN b ON b.source IS NOT DISTINCT FROM c.source)
SELECT d.doc_id, d.size, b.n AS source_size, b.target, (d.size * (q + CASE WHEN extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.h = d.h
"""
