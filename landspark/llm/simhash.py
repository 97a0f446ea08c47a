"""SimHash near-duplicates through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits agree, in one of their two halves, on all but one
bit at most. So each distinct fingerprint is indexed under the 64 variants of its halves with one bit
left out, and two that are near meet under some variant. Fingerprints that meet are verified by counting
differing bits. A variant met by two gives the pair straight from the grouping, one met by up to 64 by an
equality join. Under a fuller one pairs would grow with its square, so its members meet at midpoints:
each lists its other 33 bits as they are and with every single bit changed, and those that list the same
value lie within two bits of each other; each is linked to the least of them.

Copies share one fingerprint and are one node, however many there are. Connected nodes get the least
document id among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from ..operators.components import connected_components
from ..session import materialize, ship_package

SHINGLE, SEED, NEAR = 3, 42, 2
CROWD = 64  # members of a variant up to which pairs are formed
FILTER_ROWS = 2_000_000  # variants met by several that may be broadcast to pick their members (16 MB)
_LAST = 2**63 - 1  # stands for a null id: after all others
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[k:k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None) -> int:
    """Majority of the hash bits over all shingles; 0 without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(SHINGLE, len(words))
    first = [0, *(ends[:len(words) - size] + 1).tolist()]
    return majority(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, ends[size - 1:].tolist())], np.uint64))


def _fingerprints(batches):
    for batch in batches:
        fp = [fingerprint(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` of every row."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= NEAR


def _variants() -> Column:
    """Half, place of the bit left out and what remains of the half, in one number each."""
    out = []
    for half in (0, 1):
        part = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(F.lit(2**32 - 1))
        out += [part.bitwiseAND(F.lit(2**32 - 1 - (1 << p))) + F.lit((half * 32 + p) << 32) for p in range(32)]
    return F.array(*out)


def links(nodes: DataFrame) -> DataFrame:
    """``src, dst``: links between distinct fingerprints (``fp``) that connect all that are within two bits."""
    spark = nodes.sparkSession
    nodes = nodes.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")  # a few bytes become 64 rows each
    keyed = nodes.select("fp", F.explode(_variants()).alias("key"))
    met = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("src"), F.max("fp").alias("dst"))
                      .filter("n > 1"), "variants")
    two = met.filter("n = 2").select("src", "dst")
    full = met.filter("n > 2").select("key", "n")
    full = F.broadcast(full) if full.count() <= FILTER_ROWS else full  # beyond that both sides are shuffled
    some = materialize(keyed.join(full, "key"), "members")
    few, many = some.filter(F.col("n") <= CROWD).select("key", "fp"), some.filter(F.col("n") > CROWD)
    pairs = few.withColumnRenamed("fp", "src").join(few.withColumnRenamed("fp", "dst"), "key").filter("src < dst").select("src", "dst")
    # the bits that members of a variant need not share: the other half, and the one left out
    half, place = F.shiftright("key", 37), F.shiftright("key", 32).bitwiseAND(F.lit(31)).cast("int")
    other = F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(2**32 - 1))
    own = F.col("fp").bitwiseAND(F.lit(2**32 - 1))
    first, second = F.when(half == 0, own).otherwise(other), F.when(half == 0, other).otherwise(own)
    left_out = F.expr("shiftright(f, p)").bitwiseAND(F.lit(1))
    many = many.select("key", "fp", first.alias("f"), second.alias("o"), place.alias("p"))
    rest = F.col("o") + left_out * F.lit(1 << 32)
    spots = F.array(F.col("rest"), *[F.col("rest").bitwiseXOR(F.lit(1 << b)) for b in range(33)])
    spread = many.select("key", "fp", rest.alias("rest")).select("key", "fp", F.explode(spots).alias("spot"))
    least = spread.groupBy("key", "spot").agg(F.min("fp").alias("src"))
    stars = spread.join(least, ["key", "spot"]).select("src", F.col("fp").alias("dst")).filter("src <> dst")
    found = two.unionAll(pairs).unionAll(stars)
    return found.filter(_near(F.col("src"), F.col("dst"))).distinct()


def components(prints: DataFrame) -> DataFrame:
    """``fp, component_id`` of every distinct fingerprint; ``prints`` has ``doc_id, fp``."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("first")), "nodes")
    labels = connected_components(links(nodes)).withColumnRenamed("id", "fp")
    named = nodes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return materialize(named.join(least, "label").select("fp", "component_id"), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Null and empty texts have fingerprint zero and are linked like any other. A null id counts as one after
    all others; a component of such rows only has a null ``component_id``. Repeated rows are reported
    each. Empty table: no rows.
    """
    prints = fingerprints(docs)
    out = prints.join(components(prints), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.when(F.col("component_id") != _LAST, F.col("component_id")).alias("component_id"))
