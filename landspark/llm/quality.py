"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document if a ratio is above a cutoff. The candidate cutoffs are fixed in advance, so
all labelled documents form the holdout. Per stratum (language) and rule, the documents labelled good
that a cutoff would reject are counted, and the cutoff is certified if the exact binomial tail
``P(Bin(n, a) <= k)`` is at most ``d``: then its rate of false rejection is below ``a`` with that
confidence. Two corrections for many tests: the bounds ``alpha`` and ``delta`` are divided by the number
of rules, ``delta`` also by the number of strata; within a rule, cutoffs are tested from lenient to
strict and the first failure ends the sequence, which keeps the level without a further division. So
with probability ``1 - delta`` no stratum loses more than ``alpha`` of its good documents to the rules.

Among certified cutoffs that reject more documents labelled bad than good, the one that rejects most bad
ones is taken, the most lenient one of those. A rule without such a cutoff, or a stratum with too few
labels to certify one, rejects nothing.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import packed, unpacked, words_of

ALPHA, DELTA = 0.05, 0.05
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"



def _per_word(c: str) -> Column:
    return F.col(c) / F.greatest(F.col("n_words"), F.lit(1))


#: per rule the cutoffs from strict to lenient; a document whose value is above the cutoff is rejected
CUTOFFS = {
    "symbols": (0.05, 0.1, 0.2, 0.3, 0.5, 1.0),
    "repeated_lines": (0.1, 0.2, 0.3, 0.4, 0.5),
    "repeated_words": (0.02, 0.05, 0.1, 0.15),
    "long_words": (6.5, 7.0, 8.0, 10.0, 12.0),
    "short_words": (-4.0, -3.5, -3.0, -2.5),
}


def rules() -> dict[str, tuple[Column, tuple]]:
    """The value of each rule, and its cutoffs."""
    values = {"symbols": _per_word("n_symbols"), "repeated_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
              "repeated_words": _per_word("n_repeat_words"), "long_words": _per_word("word_chars"), "short_words": -_per_word("word_chars")}
    return {r: (values[r], some) for r, some in CUTOFFS.items()}


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _covered(starts: Column) -> Column:
    """Words covered by windows at the given ascending starts."""
    step = lambda a, p: F.struct((a.n + F.least(F.lit(WINDOW), p - a.last)).alias("n"), p.alias("last"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda a: a.n)


def with_measures(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the measures of a text beside its columns (all 0 for null).

    Windows are compared by a 64-bit hash of their words within one document.
    """
    df = df.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_w", words_of(F.col("_t")))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    hashed = F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(*[F.get("_w", i + j) for j in range(WINDOW)]))
    df = df.withColumn("_h", F.when(F.size("_w") > WINDOW, hashed))
    df = df.withColumn("_placed", F.when(F.size(F.array_distinct("_h")) < F.size("_h"),
                                         F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    beside = lambda s, i: F.coalesce(F.get("_placed", i).x == s.x, F.lit(False))
    twice = F.sort_array(F.transform(F.filter("_placed", lambda s, i: beside(s, i - 1) | beside(s, i + 1)), lambda s: s.i))
    return (df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_placed").isNull(), 0).otherwise(_covered(twice)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
    }).drop("_t", "_w", "_lines", "_h", "_placed"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series, shifted up by 8 so that it is exact to about 1e-12."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    for i in range(8):
        series = series - F.log(x + float(i))
    return series


def binomial_tail(n: Column, k: Column, a: float) -> Column:
    """``P(Bin(n, a) <= k)`` for ``k <= n * a``; 1 above that, where nothing can be certified.

    Terms are summed from ``k`` down; they fall off like a normal density, so that beyond
    ``12 * sqrt(n) + 60`` of them the rest is below double precision.
    """
    n, k = n.cast("double"), k.cast("double")
    log_term = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(a) + (n - k) * math.log1p(-a)
    many = F.least(k, F.ceil(12 * F.sqrt(n) + 60)).cast("int")
    step = lambda s, j: F.struct((s.term * (k - j) * (1 - a) / ((n - k + j + 1) * a)).alias("term"), (s.total + s.term).alias("total"))
    total = F.aggregate(F.sequence(F.lit(0), many), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")), step, lambda s: s.total)
    return F.when(k <= n * a, F.exp(log_term + F.log(total))).otherwise(F.lit(1.0))


def certify(measures: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum`` and a struct ``cut`` with the certified cutoff of each rule (null: rejects nothing).

    ``measures``: ``doc_id``, ``stratum`` and the measures. A document is good if all its labels say
    ``quality`` 1, bad if one says 0; those that fail the base rules are left out.
    """
    every = rules()
    voted = labels.groupBy("doc_id").agg(F.min("quality").alias("_good")).filter("_good IS NOT NULL")
    held = measures.filter(~base_failed()).join(voted, "doc_id")
    good, bad = F.col("_good") == 1, F.col("_good") == 0
    tally = [F.count_if(good).alias("n")]
    for r, (value, cutoffs) in every.items():
        tally.append(F.array(*[F.struct(F.lit(c).cast("double").alias("cutoff"), F.count_if(good & (value > c)).alias("k"),
                                        F.count_if(bad & (value > c)).alias("caught")) for c in cutoffs]).alias(r))
    counts = materialize(held.groupBy("stratum").agg(*tally), "tally")
    level = F.lit(delta / len(every)) / F.greatest(F.lit(counts.count()), F.lit(1))
    best = []
    for r in every:
        sure = F.filter(F.col(r), lambda s: (F.col("n") > 0) & (binomial_tail(F.col("n"), s.k, alpha / len(every)) <= level) & (s.caught > s.k))
        best.append(F.array_max(F.transform(sure, lambda s: F.struct(s.caught, s.cutoff))).cutoff.alias(r))
    return materialize(counts.select(F.col("stratum").alias("_stratum"), F.struct(*best).alias("cut")), "cutoffs")


def with_verdict(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """``df`` (stratum and measures) with ``base_failed``, ``rejected_by`` (names of rules) and ``kept``.

    The cutoffs, one row per stratum, are read from files: Spark broadcasts them below its size limit,
    else it shuffles and splits hot strata.
    """
    df = df.join(cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    hits = [F.when(value > F.col(f"cut.{r}"), F.lit(r)) for r, (value, _) in rules().items()]
    df = df.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.concat_ws(",", *hits))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")).drop("_stratum", "cut")


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The measures and the verdict on every document.

    Null or empty text: all measures 0, so the base rules fail it. Null language: a stratum of its own.
    Repeated rows are judged one by one. Empty tables: no rows; without labels only the base rules act.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("stratum"), F.col("text").alias("_text"))
    measures = materialize(with_measures(rows, F.col("_text")).select("doc_id", "stratum", *MEASURES), "measures")
    out = with_verdict(measures, certify(measures, labels, alpha, delta))
    return out.select("doc_id", *MEASURES[:5], "base_failed", "kept", "rejected_by", "stratum")


def quality_kept(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that base and certified rules keep, with its columns."""
    rows = packed(docs, doc_id=F.col("doc_id"), stratum=F.col("lang").cast("string"))
    rows = materialize(with_measures(rows, F.col("_row.text")), "measured")
    cuts = certify(rows.select("doc_id", "stratum", *MEASURES), labels, alpha, delta)
    return unpacked(with_verdict(rows, cuts).filter("kept"), docs.columns)


def _oracle() -> str:
    sql = {"symbols": "n_symbols / greatest(n_words, 1)", "repeated_lines": "n_dup_lines / greatest(n_lines, 1)", "repeated_words": "n_repeat_words / greatest(n_words, 1)",
           "long_words": "word_chars / greatest(n_words, 1)", "short_words": "-(word_chars / greatest(n_words, 1))"}
    cutoffs = ", ".join(f"('{r}', {c}::DOUBLE)" for r, some in CUTOFFS.items() for c in some)
    values = " UNION ALL ".join(f"SELECT r, stratum, good, '{r}' AS rule, {v} AS v FROM held" for r, v in sql.items())
    a, hits = ALPHA / len(sql), ", ".join(f"CASE WHEN {v} > {r} THEN '{r}' END" for r, v in sql.items())
    picked = ", ".join(f"max(cutoff) FILTER (WHERE rule = '{r}') AS {r}" for r in sql)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
c AS (SELECT r, sum(least(5, i - coalesce(before, -5))) AS n FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before
    FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1) GROUP BY r),
m AS (SELECT r, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM d LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
held AS (SELECT b.*, good FROM b JOIN (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed AND good IS NOT NULL),
v AS ({values}),
k AS (SELECT stratum, rule, cutoff, count(*) FILTER (WHERE good = 1) AS n, count(*) FILTER (WHERE good = 1 AND v > cutoff) AS k, count(*) FILTER (WHERE good = 0 AND v > cutoff) AS caught
    FROM v JOIN (VALUES {cutoffs}) AS o(rule, cutoff) USING (rule) GROUP BY ALL),
s AS (SELECT *, {DELTA}::DOUBLE / {len(sql)} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM held)) AS level, CASE WHEN k > n * {a} THEN 1 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({a}) + (n - i) * ln(1 - {a})))) END AS tail FROM k),
best AS (SELECT stratum, rule, arg_max(cutoff, caught * 1000.0 + cutoff) AS cutoff FROM s WHERE n > 0 AND tail <= level AND caught > k GROUP BY ALL),
cut AS (SELECT stratum, {picked} FROM best GROUP BY stratum),
j AS (SELECT b.*, concat_ws(',', {hits}) AS rejected_by FROM b LEFT JOIN cut ON cut.stratum IS NOT DISTINCT FROM b.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by, stratum FROM j
"""


ORACLE = _oracle()
