"""Connected components of an edge table, in two phases.

First every task contracts the links it holds, in lots of bounded size: it hooks roots to smaller roots and shortens
paths, all in numpy, and hands on a forest. So repeated and redundant links go before any shuffle. When no more than
``WHOLE`` links are left, one task contracts them to the end; that is a fixed number, not a share of the data.

Otherwise alternating large-star and small-star steps follow (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014), each a grouped minimum, which combines before the shuffle, and a join on the node. The edge table
never grows, and a chain of n nodes needs about log n rounds. Roots of large components are hubs: a node with more than
``HUB`` links. There are at most two links' ends in ``HUB`` of them, so their minima are broadcast and their links stay
where they are; only links of other nodes are dealt by node. Each round ends in files in the shared scratch folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ship_package

MAX_ROUNDS = 100
LOT = 1_000_000    # links contracted at once in a task
WHOLE = 200_000    # links that one task finishes
HUB, HUBS = 10_000, 100_000  # links of a hub, at least; hubs that are broadcast, at most
_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node that is not the least of its component, with that least one."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, top = place[:len(u)], place[len(u):], np.arange(len(nodes))
    while len(a):
        x, y = top[a], top[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = top[top]
            if (higher == top).all():
                break
            top = higher
    below = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[below], nodes[top[below]]


def _contract(lot: int):
    def work(batches):
        def done():
            u, v = forest(*(np.concatenate(c) for c in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_LINKS)
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
            if n >= lot:
                yield done()
                held, n = [], 0
        if n:
            yield done()
    return work


def _contracted(e: DataFrame, lot: int) -> DataFrame:
    return e.mapInArrow(_contract(lot), "u long, v long")


def _with_least(e: DataFrame, low: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``u, v, m``: the links with the least neighbour of ``u``."""
    if hubs is None:
        return e.join(low.select("u", "m"), "u")
    known = e.join(F.broadcast(hubs.withColumnRenamed("m", "_m")), "u", "left")  # at most HUBS rows
    rest = known.filter("_m IS NULL").select("u", "v").join(low.select("u", "m"), "u")
    return known.filter("_m IS NOT NULL").select("u", "v", F.col("_m").alias("m")).unionAll(rest)


def _least(e: DataFrame, links: int) -> tuple[DataFrame, DataFrame | None]:
    """Least neighbour per node, and of the hubs apart."""
    low = materialize(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    hubs = low.filter(F.col("n") > max(HUB, 2 * links // HUBS)).select("u", "m")
    return low, None if hubs.isEmpty() else hubs


def _large_star(e: DataFrame, links: int) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low, hubs = _least(both, links)
    return (_with_least(both, low, hubs).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")))


def _small_star(e: DataFrame, links: int) -> DataFrame:
    low, hubs = _least(e, links)
    moved = (_with_least(e, low, hubs).filter(F.col("v") != F.col("m"))
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame):
    """Row count and an order-free checksum; equal marks mean nothing moved."""
    return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                       F.sum(F.col("v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id`` and ``label`` (least id of the component) of every node that is not itself the label."""
    ship_package(edges.sparkSession)
    e = (edges.filter(F.col(src) != F.col(dst))
         .select(F.greatest(src, dst).cast("long").alias("u"), F.least(src, dst).cast("long").alias("v")))
    e = materialize(_contracted(e, LOT), "edges")
    mark = _mark(e)
    if 0 < mark[0] <= WHOLE:
        e = materialize(_contracted(e.coalesce(1), WHOLE + 1), "edges")
    elif mark[0]:
        for _ in range(MAX_ROUNDS):
            star = materialize(_large_star(e, mark[0]), "edges")
            e = materialize(_small_star(star, mark[0]), "edges")
            before, mark = mark, _mark(e)
            if mark == before:
                break
        else:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
