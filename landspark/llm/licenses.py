"""License scans: ordered signature rules behind a keyword gate.

A text becomes its words in lower case, each with a blank on either side. The words that some rule needs are looked
up first; only rules whose word is there run, on the whole text. A rule gives its matches from left to right as
places of words. Rules have classes (whole sentences of a licence, tags and addresses, notices, names, mentions) and
an order within them. A detection goes if one of an equal or better class contains it; of equal spans the
earlier rule's stays. So "gnu general public license version 3" is one detection of that version, not three, while a
mention of some words of a name does not hide the name.

Detections are sorted by start, the longer ones, better classes and earlier rules first. Then all that may contain a
detection stand before it, and it goes if the running maximum of their ends, per class, reaches its own end. So the
work grows with the detections of a document, not with their pairs.

``score`` is how sure the surest remaining detection is (``WEIGHT`` of its class), zero without any.

DataFrame functions only. Null texts count as empty. Rows are told apart by a number given to each, so null and
repeated ids and repeated rows are reported as they come; columns of other names are not read. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .license_rules import BASE, PHRASES, WEIGHT, rules

RULES = rules()
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what parts words, before letters become small


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan_words(text: Column) -> Column:
    """The words of a text: letters A to Z made small, digits, and all beyond ASCII."""
    small = F.translate(F.coalesce(text, F.lit("")), _UPPER, _SMALL)
    return F.filter(F.split(small, _GAP), lambda w: w != "")


def _count(piece: Column) -> Column:
    """Words in a piece of a spaced text: every word has two blanks."""
    return F.shiftright(F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit(""))), 1)


def _matches(spaced: Column, rule: Column) -> Column:
    """Matches of one rule: its number, place in the row, words since the match before, words it spans."""
    found = F.regexp_extract_all(spaced, rule["pattern"], F.lit(0))
    between = F.split(spaced, rule["pattern"], -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))
    return F.transform(pairs, lambda p, i: F.struct(rule["rule"].alias("rule"), i.alias("i"), _count(p["gap"]).alias("gap"), _count(p["hit"]).alias("len")))


def _scanned(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_words, found`` of every document, ``found`` the matches of all rules."""
    table = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern")) for k, r in enumerate(RULES)])
    rows = docs.select("doc_id", scan_words(F.col("text")).alias("words"))
    rows = rows.withColumn("keys", F.array_intersect("words", _strings(sorted({r.keyword for r in RULES}))))
    spaced = F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" "))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), "keys", F.when(F.size("keys") > 0, spaced).alias("spaced"))
    some = F.filter(table, lambda r: F.array_contains("keys", r["keyword"]))
    found = F.flatten(F.transform(some, lambda r: _matches(F.col("spaced"), r)))
    found = F.when(F.size("keys") > 0, found).otherwise(F.array().cast("array<struct<rule:int,i:int,gap:int,len:int>>"))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", found.alias("found")), "licences")


def _detections(scanned: DataFrame) -> DataFrame:
    """``row, rule, level, label, start, end, stays`` of every match; ``stays`` is null for those of the base."""
    hits = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    before = Window.partitionBy("row", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    of = lambda values: F.element_at(values, F.col("rule") + 1)
    placed = hits.select("row", "rule", of(_numbers([r.level for r in RULES])).alias("level"), of(_strings([r.label for r in RULES])).alias("label"),
                         (end - F.col("len")).alias("start"), end.alias("end"))
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end"), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reached = [F.max(F.when(F.col("level") <= c, F.col("end"))).over(earlier) for c in range(BASE)]
    hidden = F.coalesce(F.element_at(F.array(*reached), F.col("level") + 1) >= F.col("end"), F.lit(False))
    return placed.withColumn("stays", F.when(F.col("level") < BASE, ~hidden))


def license_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, label, level, start, end`` of what remains, in words from 0, ``end`` exclusive."""
    scanned = _scanned(docs)
    return _detections(scanned).filter("stays").join(scanned.select("row", "doc_id"), "row").select("doc_id", "label", "level", "start", "end")


def license_report(docs: DataFrame) -> DataFrame:
    """Words, places of the base phrases, labels and ``score`` of every document."""
    scanned = _scanned(docs)
    base = F.col("level") == BASE
    sure = F.element_at(F.array(*[F.lit(w) for w in WEIGHT]), F.col("level") + 1)
    per_row = _detections(scanned).groupBy("row").agg(  # sets of labels, as many as there are rules
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base"), F.collect_set(F.when(base | F.col("stays"), F.col("label"))).alias("all"),
        F.max(F.when(base | F.col("stays"), sure)).alias("sure"))
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return scanned.drop("found").join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        listed("base").alias("base_labels"), listed("all").alias("labels"), F.coalesce("sure", F.lit(0.0)).alias("score"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n  ".join(f"({k}, {r.level}, {quote(r.label)}, {quote(r.keyword)}, {quote(r.pattern)})" for k, r in enumerate(RULES))
    sure = "[" + ", ".join(str(w) for w in WEIGHT) + "]"
    count = lambda s: f"(length({s}) - length(replace({s}, ' ', ''))) // 2"
    reached = ", ".join(f"max(CASE WHEN level <= {c} THEN b END) OVER w" for c in range(BASE))
    return f"""
WITH rules(rule, level, label, keyword, pattern) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS n, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}'), '{_GAP}'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT n, list_distinct(words) AS keys, ' ' || array_to_string(words, '  ') || ' ' AS t FROM d),
k AS (SELECT n, t, unnest(keys) AS keyword FROM s),
m AS (SELECT n, rule, level, label, regexp_extract_all(t, pattern) AS hits, string_split_regex(t, pattern) AS gaps FROM k JOIN rules USING (keyword) WHERE regexp_matches(t, pattern)),
u AS (SELECT n, rule, level, label, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM m),
p AS (SELECT n, rule, level, label, {count('hit')} AS l, sum({count('gap')} + {count('hit')}) OVER (PARTITION BY n, rule ORDER BY i) AS b FROM u),
q AS (SELECT n, level, label, b - l AS a, b, [{reached}] AS reached FROM p
  WINDOW w AS (PARTITION BY n ORDER BY b - l, b DESC, level, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level = {BASE} AS base, level = {BASE} OR NOT coalesce(reached[level + 1] >= b, false) AS stays FROM q),
g AS (SELECT n, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stays) AS labels,
  max({sure}[level + 1]) FILTER (stays) AS score FROM f GROUP BY n)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN g USING (n)"""


ORACLE = _sql()
