"""Line dedup by site-relative frequency.

A page is parted into lines of visible text. Per host, the pages that contain a line are counted, each
page once, and divided by the pages of the host; lines above a ratio are boilerplate and are dropped
from every page of the host. Counts combine before the shuffle, by host and line, so a hot host spreads
over its lines. A host has at most (mean lines of a page) / ratio such lines. Up to ``FILTER_ROWS`` of them, counted first, are
broadcast, so no page moves. Beyond that they are joined to the pages by host and salt; a host gets one salt per
``SALT_PAGES`` pages, so that no task receives more of it than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

RATIO = 0.3  # a line on more than this share of a host's pages is boilerplate
LEAST_PAGES = 3  # and it has to stand on so many pages at least
FILTER_ROWS = 1_000_000  # lines to drop, at most, that are broadcast (16 MB)
SALT_PAGES = 20_000

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:@]+)"
HIDDEN = r"(?is)<!--.*?-->|<(script|style|title)\b[^>]*>.*?</(script|style|title)>"
BREAK = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
TAG = r"<[^>]*>"
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
_SPACE = "[ \t\x0b\x0c\r ]+"


def host_of(url: Column) -> Column:
    """Lower-case host; null without one."""
    found = F.lower(F.regexp_extract(url, HOST, 2))
    return F.when(found != "", found)


def lines_of(html: Column) -> Column:
    """Visible lines with single spaces; no blank ones. Null: none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    text = F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), TAG, "")
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    lines = F.split(F.regexp_replace(text, _SPACE, " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.btrim(x)), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def site_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, host, n_lines, n_dropped, text`` of every page; ``text`` holds the lines kept.

    Null or hostless addresses belong to no site and keep all lines. Null or empty pages have no lines.
    Repeated rows count as pages of their own. Empty table: no rows.
    """
    own = materialize(pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines")), "lines")
    sited = own.filter("host IS NOT NULL")
    seen = sited.select("host", F.explode(F.array_distinct(F.transform("lines", _key))).alias("key"))
    often = seen.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    totals = sited.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    totals = materialize(totals, "hosts")
    dropped = often.join(totals, "host").filter(F.col("n") > ratio * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("bad"))
    dropped = materialize(dropped, "dropped")
    if (dropped.agg(F.sum(F.size("bad"))).first()[0] or 0) <= FILTER_ROWS:
        rows = own.join(F.broadcast(dropped), "host", "left")
    else:
        # as many rows as pages / SALT_PAGES
        hot = F.broadcast(totals.filter(F.col("pages") > SALT_PAGES).select("host", F.ceil(F.col("pages") / SALT_PAGES).cast("int").alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        dealt = dropped.join(hot, "host", "left").select("host", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "bad")
        own = own.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "lines"), salts).cast("int")).drop("salts")
        rows = own.join(dealt, ["host", "salt"], "left")
    kept = F.when(F.col("bad").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("bad", _key(x))))
    rows = rows.withColumn("kept", kept)
    return rows.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"),
                       (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def _oracle() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(coalesce(html, ''), {q(HIDDEN)}, chr(10), 'g')"
    text = f"regexp_replace(regexp_replace({text}, {q(BREAK)}, chr(10), 'g'), {q(TAG)}, '', 'g')"
    for entity, plain in ENTITIES:
        text = f"replace({text}, {q(entity)}, {q(plain)})"
    text = f"regexp_replace({text}, {q(_SPACE)}, ' ', 'g')"
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, nullif(lower(regexp_extract(url, {q(HOST)}, 2)), '') AS host,
    list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
e AS (SELECT DISTINCT r, host, unnest(lines) AS line FROM p WHERE host IS NOT NULL),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT e.host, list(line) AS bad FROM (SELECT host, line, count(*) AS n FROM e GROUP BY ALL) e JOIN t ON t.host = e.host
    WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages GROUP BY e.host),
k AS (SELECT page_id, p.host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept
    FROM p LEFT JOIN b ON b.host = p.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""


ORACLE = _oracle()
