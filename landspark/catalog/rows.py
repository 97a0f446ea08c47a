"""Row order, keys, upserts and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.text import distinct_join, ordered_join
from ..operators import lookups, rows, summaries
from ..operators.rowid import with_row_id
from ..plans.history import analysed_properties, parcel_history
from ..sinks.tables import upsert
from . import ctes, query


@query("first_cases", ctes("cases") + "SELECT id, min(seq) AS seq FROM cases GROUP BY id")
def first_cases(spark, d):
    return rows.first_per_key(fx.cases(spark, d), ["id"], ["seq"]).select("id", "seq")


@query("occurrences", "SELECT event_id AS k, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS occurrence FROM events")
def occurrences(spark, d):
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("k"), "user_id")
    return rows.occurrence_index(e, {"u": F.col("user_id") % 3}, "k").select("k", "occurrence")


# half of all rows under one key, in the order of instants that are far apart
@query("sparse_occurrences", """
    SELECT event_id AS k, row_number() OVER (PARTITION BY CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END ORDER BY ts, event_id) - 1 AS occurrence
    FROM events""")
def sparse_occurrences(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"))
    key = F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id"))
    return rows.occurrence_index(e, {"u": key}, "at").select(F.col("event_id").alias("k"), "occurrence")


@query("value_changes", """
    SELECT event_id AS k, round(coalesce(value - lag(value) OVER w, 0), 4) AS delta_previous, round(value - first_value(value) OVER w, 4) AS delta_first
    FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 0 ELSE user_id END AS u FROM events) WINDOW w AS (PARTITION BY u ORDER BY ts, event_id)""")
def value_changes(spark, d):
    key = F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("user_id"))
    e = fx.table(spark, d, "events").select("event_id", key.alias("u"), F.struct("ts", "event_id").alias("at"), "value")
    out = rows.history_delta(e, ["u"], "at", "value")
    return out.select(F.col("event_id").alias("k"), F.round("delta_previous", 4).alias("delta_previous"), F.round("delta_first", 4).alias("delta_first"))


@query("version_changes", ctes("versions") + """
    SELECT code, ord, area, coalesce(area - lag(area) OVER w, 0) AS delta_previous, area - first_value(area) OVER w AS delta_first
    FROM versions WINDOW w AS (PARTITION BY code ORDER BY ord)""")
def version_changes(spark, d):
    return rows.history_delta(fx.versions(spark, d), ["code"], "ord", "area").drop("version")


@query("one_parcel_history", ctes("versions", x="SELECT min(code) AS c FROM versions", h="""
    SELECT ord, area FROM versions, x WHERE code = c UNION ALL SELECT 1000, 5000""") + """
    SELECT ord, area, coalesce(area - lag(area) OVER (ORDER BY ord), 0) AS delta_previous,
      area - first_value(area) OVER (ORDER BY ord) AS delta_first FROM h""")
def one_parcel_history(spark, d):
    v = fx.versions(spark, d).select("code", "ord", "area")
    code = v.agg(F.min("code")).first()[0]
    layer = fx.parcels(spark, d).select(F.col("code").alias("parcel"), "geom").withColumn("code", F.lit(code))
    out = parcel_history(v, layer, code, {"ord": 1000, "area": 5000}, "code", "ord", "area")
    return out.select("ord", F.col("area").cast("bigint").alias("area"), F.col("delta_previous").cast("bigint").alias("delta_previous"),
                      F.col("delta_first").cast("bigint").alias("delta_first"))


@query("curated_with_geometry", ctes("parcels") + """
    SELECT p_partkey AS code, p_brand AS brand, cast(x0 AS bigint) AS minx FROM part JOIN parcels ON code = p_partkey""")
def curated_with_geometry(spark, d):
    c = fx.table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("brand"))
    out = analysed_properties(c, fx.parcels(spark, d), "code")
    return out.select("code", "brand", F.col("geom.minx").cast("bigint").alias("minx"))


@query("filled_attributes", ctes("parcels") + """
    SELECT code, coalesce(town, p_brand, 'none') AS town FROM parcels LEFT JOIN part ON p_partkey = code""")
def filled_attributes(spark, d):
    c = fx.table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("town"))
    out = lookups.override_blank(fx.parcels(spark, d), c, "code", ["town"])
    return out.select("code", F.coalesce("town", F.lit("none")).alias("town"))


@query("seats_with_fallback", ctes("gazetteer") + """
    SELECT code, name FROM gazetteer UNION ALL SELECT c, n FROM (SELECT cast(2600000 + s_suppkey*50 AS int) AS c, s_name AS n FROM supplier)
    WHERE c NOT IN (SELECT code FROM gazetteer)""")
def seats_with_fallback(spark, d):
    s = fx.table(spark, d, "supplier").select((F.lit(2600000) + F.col("s_suppkey") * 50).cast("int").alias("code"), F.col("s_name").alias("name"))
    return lookups.with_fallback(fx.gazetteer(spark, d).select("code", "name"), s, "code")


@query("places_by_code", ctes("cases", "gazetteer") + """
    SELECT c.seq, coalesce(g.name, 'none') AS name, coalesce(g.lon, -34.8770) AS lon FROM cases c LEFT JOIN gazetteer g ON g.code = c.muni_code""")
def places_by_code(spark, d):
    out = lookups.join_by_code(fx.cases(spark, d), "muni_code", fx.gazetteer(spark, d))
    return out.select("seq", F.coalesce("place.name", F.lit("none")).alias("name"), F.coalesce("place.lon", F.lit(-34.8770)).alias("lon"))


@query("one_place", ctes("gazetteer") + "SELECT code, name FROM gazetteer WHERE code = (SELECT max(code) FROM gazetteer)")
def one_place(spark, d):
    gaz = fx.gazetteer(spark, d)
    return lookups.lookup_one(gaz, "code", gaz.agg(F.max("code")).first()[0]).select("code", "name")


@query("upserted_parcels", ctes("parcels") + """
    SELECT coalesce(u.code, p.code) AS code, coalesce(u.name, p.name) AS name, coalesce(p.note, 'none') AS note
    FROM (SELECT code, name, concat('kept ', code) AS note FROM parcels) p
    FULL JOIN (SELECT c_custkey*13 AS code, c_name AS name FROM customer) u ON u.code = p.code""")
def upserted_parcels(spark, d):
    target = fx.parcels(spark, d).select("code", "name", F.concat(F.lit("kept "), F.col("code").cast("string")).alias("note"))
    updates = fx.table(spark, d, "customer").select((F.col("c_custkey") * 13).alias("code"), F.col("c_name").alias("name"),
                                                    F.lit("lost").alias("note"))
    return upsert(target, updates, "code", kept=["note"]).select("code", "name", F.coalesce("note", F.lit("none")).alias("note"))


@query("numbered_parcels", ctes("parcels") + "SELECT row_number() OVER (ORDER BY source, x0, code) AS id, code FROM parcels")
def numbered_parcels(spark, d):
    return with_row_id(fx.parcels(spark, d).select("source", "x0", "code"), ["source", "x0", "code"]).select("id", "code")


@query("audited_tables", """
    SELECT t.table_name, t.actual, e.expected, CASE WHEN e.expected IS NULL THEN 'unexpected' WHEN t.actual IS NULL THEN 'missing'
      WHEN t.actual = e.expected THEN 'ok' ELSE 'different' END AS status
    FROM (SELECT 'orders' AS table_name, count(*) AS actual FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL
          SELECT 'nation', count(*) FROM nation) t JOIN (SELECT 'orders' AS table_name, count(*) AS expected FROM orders UNION ALL
          SELECT 'part', count(*) + 1 FROM part UNION ALL SELECT 'nation', count(*) FROM nation) e USING (table_name)""")
def audited_tables(spark, d):
    t = {n: fx.table(spark, d, n) for n in ("orders", "part", "nation")}
    extra = {"orders": 0, "part": 1, "nation": 0}
    want = None
    for n, df in t.items():
        one = df.agg((F.count(F.lit(1)) + extra[n]).alias("expected")).select(F.lit(n).alias("table_name"), "expected")
        want = one if want is None else want.unionByName(one)
    return summaries.audit_counts(t, want)


@query("joined_lists", ctes("parcels") + """
    SELECT source, coalesce(string_agg(DISTINCT town, '; ' ORDER BY town), 'N/A') AS towns, count(*) AS parcels FROM parcels GROUP BY source""")
def joined_lists(spark, d):
    return fx.parcels(spark, d).groupBy("source").agg(distinct_join("town").alias("towns"), F.count(F.lit(1)).alias("parcels"))


# a nation's customers by blocks of a thousand keys, so that lists stay short however many customers there are
@query("ordered_lists", "SELECT c_custkey // 1000 AS block, c_nationkey AS n, string_agg(c_name, ' | ' ORDER BY c_custkey DESC) AS names FROM customer GROUP BY ALL")
def ordered_lists(spark, d):
    c = fx.table(spark, d, "customer")
    return c.groupBy(F.floor(F.col("c_custkey") / 1000).alias("block"), F.col("c_nationkey").alias("n")).agg(
        ordered_join("c_name", -F.col("c_custkey"), " | ").alias("names"))


@query("last_movements", """
    SELECT l_orderkey AS k, max(concat(lpad(cast(l_linenumber AS varchar), 4, '0'), lpad(cast(l_partkey AS varchar), 12, '0'))) AS last, count(*) AS moves
    FROM lineitem GROUP BY l_orderkey""")
def last_movements(spark, d):
    key = F.concat(F.lpad(F.col("l_linenumber").cast("string"), 4, "0"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"))
    m = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(key.alias("nome")))).alias("m"))
    return m.select("k", rows.last_movement("m")["nome"].alias("last"), rows.movement_count("m").cast("bigint").alias("moves"))
