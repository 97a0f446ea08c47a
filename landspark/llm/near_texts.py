"""Near copies by the words of the texts: five-word shingles, similarity 0.8 or more, verified on the texts.

Equal texts are one node, however many there are. Candidates come in three steps, each verified, and a later step only
looks at what an earlier one has left in different components:

1. Fingerprints of the five-word shingles that differ in at most two bits, by the deletion variants of
   ``simhash.links``. This joins copies with small changes without forming the pairs inside a group.
2. Texts that agree on all five least hashes of one of 20 bands, which two texts of similarity s do with probability
   ``1 - (1 - s**5)**20`` (0.9996 at 0.8): each member of a band with the least one.
3. The members of bands that still hold several components, by their rarest shingles. A text's shingles are ordered
   from rare to common (among these members). Two near texts, the larger of ``n`` and the smaller of ``m`` shingles, share at
   least ``4/9 (n + m)`` of them, so the first one they share has that many left behind it in both. So it stands in the first
   ninth of the smaller text and the first fifth of the larger one, and how far in tells which sizes may meet. The join is
   on shingle and size class, and sketches of 1024 bits rule out pairs that differ in more than a ninth of both. What a
   passage common to many otherwise different texts brings never meets: there, rarer words come first. First one
   text of each component per shingle and class meets one of the largest component there, which joins most of what belongs
   together. Then keys of one component are left out; of the others, members outside the component that most members belong to meet all members, and those of
   that component never meet each other. Nothing is cut, so of the pairs that share a band none is lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from ..operators.components import connected_components
from ..session import materialize, ship_package
from . import simhash
from .common import packed, text_key, unpacked

SHINGLE, BANDS, DEPTH, SEED = 5, 20, 5, 42
NUMERATOR, DENOMINATOR = 4, 5  # the least similarity, 0.8
LONGS = 16  # 1024 bits of a sketch
LOTS = 64  # copies of a text, at most, against which the pairs of a much-compared one are dealt
FILTER_ROWS = 1_000_000  # rows of a list that may be broadcast to thin out a side before a shuffle (16 MB)
_LAST = 2**63 - 1
_PLACE = ["_none", "_id", "_key", "_tie"]  # tells rows apart, and orders them
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_draw = np.random.default_rng(SEED)
_A = _draw.integers(0, 2**64, (BANDS * DEPTH, 1), np.uint64) | np.uint64(1)
_B = _draw.integers(0, 2**64, (BANDS * DEPTH, 1), np.uint64)
_C = _draw.integers(0, 2**64, (1, DEPTH), np.uint64) | np.uint64(1)
_D = _draw.integers(0, 2**64, BANDS, np.uint64)


def shingles(text: bytes | None) -> set[bytes]:
    """Runs of five words, ASCII case aside; one run of all words if there are fewer, none without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return set()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(SHINGLE, len(words))
    first = [0, *(ends[:len(words) - size] + 1).tolist()]
    return {joined[a:b] for a, b in zip(first, ends[size - 1:].tolist())}


def near(a: set[bytes], b: set[bytes]) -> bool:
    """Whether the shingles are similar enough. Texts without words are copies of each other."""
    both = len(a & b)
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _hashes(found: set[bytes]) -> np.ndarray:
    return np.array([xxh64_intdigest(s, SEED) for s in found], np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """Values under which near copies meet, of the hashes of the shingles."""
    least = np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    for k in range(0, len(h), 2048):
        np.minimum(least, (h[k:k + 2048] * _A + _B).min(axis=1), out=least)
    out = (least.reshape(BANDS, DEPTH) * _C).sum(axis=1, dtype=np.uint64) + _D
    return (out ^ (out >> np.uint64(31))).view(np.int64)


def _banded(batches):
    for batch in batches:
        values, sizes, prints = [], [], []
        for t in batch.column(4).cast(pa.binary()).to_pylist():
            h = _hashes(shingles(t))
            values.append(bands(h).tolist())
            sizes.append(len(h))
            prints.append(simhash.majority(h))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(values, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64())],
                                         names=[*_PLACE, "bands", "size", "fp"])


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes that fall on each of ``64 * LONGS`` bits. Two sets differ in at least as many
    elements as their sketches differ in bits."""
    odd = np.bincount(h & (64 * LONGS - 1), minlength=64 * LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _shingled(batches):
    for batch in batches:
        lists = [_hashes(shingles(t)).view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        sketches = [sketch(h).tolist() for h in lists]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["node", "hashes", "sketch"])


def _verify(batches):
    for batch in batches:
        out, held, seen = [], None, set()
        for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist()):
            if a != held:
                held, seen = a, shingles(x)
            out.append(near(seen, shingles(y)))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["src", "dst"]).filter(pa.array(out, pa.bool_()))


def _placed(docs: DataFrame) -> DataFrame:
    """The rows as ``_row`` with what orders them: id, nulls last, then digest of the text, then hash of the row."""
    number = F.col("doc_id").cast("long")
    # maps have no hash of their own
    held = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return packed(docs, _none=number.isNull(), _id=F.coalesce(number, F.lit(_LAST)), _key=text_key(F.col("text")), _tie=F.xxhash64(*held))


def _thinned(df: DataFrame, by: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose value of ``on`` stands in ``by``, joined with it."""
    return df.join(F.broadcast(by) if by.count() <= FILTER_ROWS else by, on)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``src, dst`` whose ``texts`` are near. Pairs of one ``src`` are dealt over lots."""
    pairs = pairs.withColumn("lot", F.pmod(F.xxhash64("dst"), F.lit(LOTS)))
    heads = pairs.select("src", "lot").distinct().join(texts.select(F.col("node").alias("src"), F.col("text").alias("x")), "src")
    rows = pairs.join(texts.select(F.col("node").alias("dst"), F.col("text").alias("y")), "dst").join(heads, ["src", "lot"])
    return materialize(rows.select("src", "dst", "x", "y").mapInArrow(_verify, "src long, dst long"), "near")


def nodes_of(docs: DataFrame) -> DataFrame:
    """Distinct texts: ``node``, the place of the first row that has it, band values, number of shingles and fingerprint."""
    ship_package(docs.sparkSession)
    rows = _placed(docs).select(*_PLACE, F.coalesce(F.col("_row.text"), F.lit("")).alias("text"))
    rows = rows.mapInArrow(_banded, "_none boolean, _id long, _key binary, _tie long, bands array<long>, size int, fp long")
    nodes = rows.groupBy("_key").agg(F.min(F.struct("_none", "_id", "_tie")).alias("p"), *[F.first(c).alias(c) for c in ("bands", "size", "fp")])
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "p._none", "p._id", "_key", "p._tie", "bands", "size", "fp")
    return materialize(nodes, "nodes")  # numbered once


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Candidate pairs of near fingerprints: nodes of one fingerprint with the least of them, and those of linked ones."""
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    same = nodes.select("fp", "node").join(heads, "fp").filter("node <> head").select(F.col("head").alias("src"), F.col("node").alias("dst"))
    found = materialize(simhash.links(nodes.select("fp").distinct()), "links")
    named = found.join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst")
    return same.unionAll(named.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))


def _similar_size(a: str, b: str):
    return (DENOMINATOR * F.col(a) >= NUMERATOR * F.col(b)) & (DENOMINATOR * F.col(b) >= NUMERATOR * F.col(a))


def _class(n: Column) -> Column:
    """Sizes in steps of a tenth."""
    return F.floor(F.log(n) / F.lit(float(np.log(1.1)))).cast("int")


def _labelled(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _prefixes(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, n, h, left, sketch``: the shingles of the nodes that may be the first one shared with a near text.

    ``left`` counts the shingles of the node from this one on, from rare to common.
    """
    held = texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(_shingled, "node long, hashes array<long>, sketch array<long>")
    held = materialize(held, "shingles").withColumn("n", F.size("hashes"))
    each = held.select("node", "n", F.explode("hashes").alias("h"))
    often = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    shared = each.join(often, "h")  # a shingle of one text alone brings no pair, and comes before all others
    by = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(by) + F.row_number().over(by.orderBy("often", "h")) - 1
    left = shared.withColumn("left", F.col("n") - place).select("node", "n", "h", "left").filter("5 * left >= 4 * n")
    return materialize(left.join(held.select("node", "sketch"), "node"), "prefixes")


def _by_rare_shingles(prefixes: DataFrame, labels: DataFrame, heads: bool = False) -> DataFrame:
    """Candidate pairs of nodes of different labels (``node, label``) that share a shingle rare enough in both; with
    ``heads`` one node of each label per shingle and size class, another one for each shingle, and only pairs with
    the label that most nodes of the shingle have."""
    left = prefixes.join(labels, "node")
    mixed = left.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.count(F.lit(1)).alias("several"), F.max_by("label", "c").alias("most"))
    left = left.join(mixed.filter("several > 1").drop("several"), "h")
    small = left.filter("9 * left >= 8 * n").select("h", _class(F.col("n")).alias("class"), F.col("node").alias("src"), F.col("label").alias("x"), F.col("n").alias("m"),
                                                    F.col("left").alias("a"), (F.col("label") == F.col("most")).alias("p"), F.col("sketch").alias("s"))
    reach = F.least(F.col("n"), F.floor((9 * F.col("left") - 4 * F.col("n")) / 4))
    classes = F.sequence(_class(F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)), _class(reach))
    large = left.select("h", F.explode(classes).alias("class"), F.col("node").alias("dst"), F.col("label").alias("y"), "n", F.col("left").alias("b"),
                        (F.col("label") == F.col("most")).alias("q"), F.col("sketch").alias("t"))
    meet = ((F.col("x") != F.col("y")) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("src") < F.col("dst")))) & _similar_size("m", "n")
            & (9 * F.col("a") >= 4 * (F.col("m") + F.col("n"))) & (9 * F.col("b") >= 4 * (F.col("m") + F.col("n"))))
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.get("s", F.lit(k)).bitwiseXOR(F.get("t", F.lit(k)))) for k in range(LONGS)])
    meet &= 9 * differ <= F.col("m") + F.col("n")  # near texts share 4/9 of both, so they differ in a ninth at most
    sides = (("NOT p", "true"), ("p", "NOT q"))
    if heads:
        one = lambda df, node, label: (df.groupBy("h", "class", label).agg(F.min_by(F.struct(*[c for c in df.columns if c not in ("h", "class", label)]), F.xxhash64(node, "h")).alias("k"))
                                       .select("h", "class", label, "k.*"))
        small, large, sides = one(small, "src", "x"), one(large, "dst", "y"), (("NOT p", "q"), ("p", "NOT q"))
    found = [small.filter(p).join(large.filter(q), ["h", "class"]).filter(meet) for p, q in sides]
    return reduce(DataFrame.unionAll, found).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, label`` of every node that is a near copy of others and not itself the label."""
    spark = docs.sparkSession
    close = materialize(_by_fingerprint(nodes), "close")
    keyed = nodes.select("node", "size", F.explode("bands").alias("band"))
    met = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size")).alias("head")).filter("n > 1").drop("n")
    members = materialize(_thinned(keyed, materialize(met, "bands"), "band"), "members")
    some = close.select(F.col("src").alias("node")).unionAll(close.select("dst")).unionAll(members.select("node")).distinct()
    # texts of the nodes that meet others; the place of a row finds each without gathering its copies
    some = materialize(nodes.select("node", *_PLACE).join(some, "node", "left_semi").withColumn("spot", F.xxhash64(*_PLACE)), "some")
    if some.isEmpty():
        return spark.createDataFrame([], "id long, label long")
    rows = _placed(docs).select(*_PLACE, F.coalesce(F.col("_row.text"), F.lit("")).alias("text")).withColumn("spot", F.xxhash64(*_PLACE))
    rows = _thinned(rows, some.select("spot").distinct(), "spot").drop("spot")
    texts = materialize(rows.join(some, _PLACE).groupBy("node").agg(F.first("text").alias("text")), "texts")

    links = _verified(close, texts)
    labels = connected_components(links)
    # bands of several components: members not in the component of the least one, with it
    named = _labelled(members, labels)
    first = named.filter("node = head.node").select("band", F.col("label").alias("of"))
    pairs = named.join(first, "band").filter((F.col("label") != F.col("of")) & _similar_size("size", "head.size"))
    pairs = materialize(pairs.select(F.col("head.node").alias("src"), F.col("node").alias("dst")).distinct(), "pairs")
    links = links.unionAll(_verified(pairs, texts))
    labels = connected_components(links)
    named = materialize(_labelled(members, labels), "named")
    mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
    rest = materialize(_thinned(named, materialize(mixed, "mixed"), "band").select("node", "label").distinct(), "rest")
    if rest.isEmpty():
        return labels
    prefixes = _prefixes(rest, texts)
    links = links.unionAll(_verified(materialize(_by_rare_shingles(prefixes, rest, heads=True), "pairs"), texts))
    labels = connected_components(links)
    more = materialize(_by_rare_shingles(prefixes, materialize(_labelled(rest.select("node"), labels), "named")), "pairs")
    return labels if more.isEmpty() else connected_components(links.unionAll(_verified(more, texts)))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, with the columns of ``docs``.

    It is the first by id (null ids last), then by digest of the text, then by hash of the row. So rows of
    one id or without id stay if their texts are no near copies. Null, empty and blank texts are copies of
    each other; repeated rows count once. Empty table: no rows.
    """
    nodes = nodes_of(docs)
    labels = components(docs, nodes).withColumnRenamed("id", "node")
    named = nodes.drop("bands").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kept = named.groupBy("label").agg(F.min(F.struct(*_PLACE)).alias("p")).select("p.*")
    rows = _placed(docs).join(kept, _PLACE).groupBy(*_PLACE).agg(F.first("_row").alias("_row"))
    return unpacked(rows, docs.columns)
