"""Cases beyond the fixtures: odd characters, repeated keys, failed batches, crowded cells, null geometries."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from landspark.functions import geometry as g, text as tx
from landspark.operators import grid, lookups, rows as row_ops
from landspark.operators.cleaning import as_multipolygon
from landspark.operators.cluster import dbscan
from landspark.operators.dissolve import dissolve
from landspark.operators.overlap import overlap_join
from landspark.operators.polygons import st_is_convex
from landspark.plans.evictions import evictions, filter_state_cases
from landspark.sinks.tables import upsert, write_documents
from landspark.sources.files import read_evictions, read_geojson, read_kml
from landspark.streaming import intake


def nfkd(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def test_accents_follow_the_unicode_rule(spark):
    texts = ["ﬁca ½ 𝐀b ①", "São-ção", "한글 가각", "ﷺ ㎏ ＡＢＣ", "ｶﾞ", "", "plain", None, "[]^-\\]½"]
    texts += ["".join(chr(c) for c in range(a, a + 400) if not 0xD800 <= c < 0xE000) for a in [*range(0x80, 0x2400, 400), 0xAC00, 0xFB00, 0xFF00, 0x1D400, 0x2F800]]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", tx.strip_accents("t"), tx.normalize_text("t"), tx.sanitize_name("t"), tx.normalize_upper("t"), tx.safe_filename("t")).collect()
    assert [r[1] for r in rows] == [None if t is None else nfkd(t) for t in texts]
    assert tuple(rows[0])[2:] == ("fica 1⁄2 ab 1", "fica_12_ab_1", "FICA 12 AB 1", "_ca_b_")


def test_long_word_of_a_slug(spark):
    word = "a" + "b" * 1_200_000
    assert spark.createDataFrame([(word,)], "t string").select(F.length(tx.slug_title("t"))).first()[0] == len(word)


def test_upsert_folds_updates(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, note string")
    updates = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (3, "c", 1)], "id int, v string, at int")
    got = upsert(target, updates, "id", order=["at"]).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [(1, "new", "x"), (2, "b", "y"), (3, "c", None)]
    with pytest.raises(ValueError):
        upsert(target, updates, "id")


def test_failed_batch_loses_nothing(spark, tmp_path, monkeypatch):
    gaz = spark.createDataFrame([(2611606, -34.9, -8.05, "Recife")], "code int, lon double, lat double, name string")
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"id": f"c{k}{i}", "numeroProcesso": "1"}) for i in range(4)))
    args = (spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "offsets"), gaz, "TJPE")
    real, calls = intake.normalize_cases, []

    def broken(rows, gazetteer):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(rows, gazetteer)
    monkeypatch.setattr(intake, "normalize_cases", broken)
    with pytest.raises(Exception):
        intake.stream_cases(*args, max_files=1).awaitTermination()
    assert intake.streamed_cases(spark, str(tmp_path / "store")).count() == 4  # the first batch is there
    intake.stream_cases(*args, max_files=1).awaitTermination()
    assert sorted(r.id for r in intake.streamed_cases(spark, str(tmp_path / "store")).collect()) == sorted(f"c{k}{i}" for k in range(3) for i in range(4))


def test_reports_of_several_files(spark, tmp_path):
    """Undecided reports at the same place of two files, one inside the boundary and one outside."""
    def report(n, lon, **meta):
        return {"ID": str(n), "post_title": f"t{n}", "meta": {"localizacao_lat": "-8.5", "localizacao_lng": str(lon)} | meta, "tax": {"municipio": ["x"]}}
    (tmp_path / "a.json").write_text(json.dumps({"conflito": [report(1, -36.5)]}))
    (tmp_path / "b.json").write_text(json.dumps({"conflito": [report(2, 50, acompanhamento_juridico_do_caso=None), report(3, -36.6, acompanhamento_juridico_do_caso=None, agentes_promotores_publicos_ou_privados=["A", "B"])]}))
    rows = read_evictions(spark, str(tmp_path))
    assert [(r.seq, r.ID) for r in rows.orderBy("seq").collect()] == [(0, "1"), (1, "2"), (2, "3")]
    area = spark.range(1).select(g.st_box(F.lit(-38), F.lit(-9), F.lit(-36), F.lit(-8)).alias("geom"))
    assert sorted(r.ID for r in filter_state_cases(rows, area).collect()) == ["1", "3"]
    got = {r.conflito_id: (r.acompanhamento_juridico, r.agente_promotor) for r in evictions(rows, area).collect()}
    assert got == {1: ("", ""), 3: ("Não informado", "A; B")}


def test_geojson_types(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    shapes = [{"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [5, 5]}, {"type": "Polygon", "coordinates": square},
                                                            {"type": "MultiPolygon", "coordinates": [square, square]}]},
              {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [5, 5]}]}, {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}, None]
    (tmp_path / "f.json").write_text("\n".join(json.dumps({"type": "Feature", "properties": {"k": k}, "geometry": s}) for k, s in enumerate(shapes)))
    got = {r.k: r.geom for r in read_geojson(spark, str(tmp_path / "f.json"), "k int", lines=True).collect()}
    assert (got[0].gtype, len(got[0].parts), got[0].maxx) == ("multipolygon", 3, 1.0) and got[1] is None and got[3] is None
    assert (got[2].gtype, len(got[2].parts), got[2].maxy) == ("multipoint", 2, 4.0)


def test_kml_multigeometry_without_polygons(spark, tmp_path):
    point = "<Point><coordinates>{},{}</coordinates></Point>"
    line = "<LineString><coordinates>0,0 1,1</coordinates></LineString>"
    marks = [point.format(1, 2) + point.format(3, 4), line + line + point.format(1, 1)]
    (tmp_path / "f.kml").write_text("<kml><Document>" + "".join(f"<Placemark><name>{k}</name><MultiGeometry>{m}</MultiGeometry></Placemark>" for k, m in enumerate(marks)) + "</Document></kml>")
    got = {r.name: r.geom for r in read_kml(spark, str(tmp_path / "f.kml")).collect()}
    assert (got["0"].gtype, len(got["0"].parts)) == ("multipoint", 2) and (got["1"].gtype, len(got["1"].parts)) == ("multilinestring", 2)


def test_crowded_cell(spark):
    """Hot cells of distinct boxes, and copies on one spot that cutting cannot thin out."""
    rng = random.Random(1)
    boxes = [(k, rng.random() * 10, rng.random() * 10) for k in range(300)] + [(1000 + k, 5.0, 5.0) for k in range(60)]
    df = spark.createDataFrame(boxes, "id long, x double, y double").withColumn("geom", g.st_box("x", "y", F.col("x") + 0.5, F.col("y") + 0.5))
    want = {(a[0], b[0]) for a in boxes for b in boxes if abs(a[1] - b[1]) < 0.5 and abs(a[2] - b[2]) < 0.5}
    for rows in (20_000, 25, 5):  # nothing hot; cut; cut and salted
        got = overlap_join(df, df, 100.0, "id", "id", rectangles=True, hot_rows=rows).select("l_id", "r_id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_cell_threshold_does_not_grow(spark):
    rows = spark.range(100_000).select((F.col("id") % 2).alias("_cx"), F.lit(0).alias("_cy"))
    hot = grid.hot_groups(rows, ["_cx", "_cy"])
    assert sorted(r._split for r in hot.collect()) == [3, 3] and grid.hot_groups(rows.limit(1000), ["_cx", "_cy"]) is None


@pytest.mark.parametrize("n", [10, 400])
def test_dissolve_leaves_no_seams(spark, n):
    """A row of boxes over more cells than are put together at once, beside an island."""
    boxes = spark.range(n).select(F.lit("a").alias("k"), g.st_box(F.col("id"), F.lit(0), F.col("id") + 1, F.lit(1)).alias("geom"))
    boxes = boxes.unionAll(spark.range(1).select(F.lit("a"), g.st_box(F.lit(-9), F.lit(-9), F.lit(-8), F.lit(-8))))
    for rectangles in (True, False):
        out = dissolve(boxes, ["k"], 1.0, rectangles=rectangles).first()
        assert len(out.geom.parts) == 2 and out.area == pytest.approx(n + 1)


def test_clustering_keeps_null_geometries(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, None)], "id long, x double").withColumn("by", F.lit("b"))
    df = df.withColumn("geom", F.when(F.col("x").isNotNull(), g.st_box("x", F.lit(0), F.col("x") + 1, F.lit(1))))
    assert {r.id: r.cluster for r in dbscan(df, ["by"], 0.1).collect()} == {1: 1, 2: 1, 3: None}


def test_convex_rings(spark):
    def ring(*p):
        return g.st_rings(F.array(*[g.vertex(F.lit(float(x)), F.lit(float(y))) for x, y in p]))
    import math
    star = [(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]
    cases = [(ring((0, 0), (2, 0), (1, 2), (0, 0)), True), (ring((0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (0, 0)), True), (ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)), False),
             (ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)), False), (ring(*star, star[0]), False), (ring((0, 0), (0, 2), (2, 2), (2, 0), (0, 0)), True)]
    got = spark.range(1).select(*[st_is_convex(c).alias(f"c{k}") for k, (c, _) in enumerate(cases)]).first()
    assert list(got) == [w for _, w in cases]


@pytest.mark.parametrize("spread", [1, 10**9])
def test_one_key_over_many_partitions(spark, spread):
    """Numbers and changes of a key with half of the rows, whose order values lie close or far apart, and of a null key."""
    rng = random.Random(spread)
    rows = [(0 if i % 2 else rng.choice([None, 1, 2, 3]), i * spread + rng.randrange(spread), rng.choice([None, 1.0, 2.5])) for i in range(2000)]
    want, seen = {}, {}
    for key, order, value in rows:
        past = seen.setdefault(key, [])
        change = None if not past else (None if None in (value, past[-1]) else value - past[-1])
        want[key, order] = (len(past), change or 0.0, None if None in (value, (past or [value])[0]) else value - (past or [value])[0])
        past.append(value)
    df = spark.createDataFrame(rows, "g int, o long, v double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, _ = row_ops._laid_out(df, {"g": F.col("g")}, "o")
        assert placed.filter("g = 0").select("_part").distinct().count() >= 3
        out = row_ops.history_delta(row_ops.occurrence_index(df, {"g": F.col("g")}, "o"), ["g"], "o", "v").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 2000 and {(r.g, r.o): (r.occurrence, r.delta_previous, r.delta_first) for r in out} == want


def test_one_collection_is_read_by_many_tasks(spark, tmp_path):
    """A single document, read whole and in many parts, gives the same features; odd layouts are read or refused."""
    rng = random.Random(4)
    names = ['plain', 'with "Feature\\" inside', "brace } and [", 'ünï, {"type": 1}', "", "a\nb"]
    feats = []
    for i in range(3000):
        ring = [[i, 0], [i + 1.5, 0], [i + 1.5, 2], [i, 2], [i, 0]]
        f = {"type": "Feature", "properties": {"code": i, "name": rng.choice(names), "inner": {"type": "x"}}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        feats.append({"id": rng.choice(['a"b', 7]), **f} if i % 3 == 0 else f)
    text = json.dumps({"type": "FeatureCollection", "crs": {"type": "name"}, "features": feats}, indent=None, ensure_ascii=False)
    folder = tmp_path / "one"
    folder.mkdir()
    (folder / "all.geojson").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        parts = read_geojson(spark, str(folder), "code bigint, name string", split=True)
        assert parts.rdd.getNumPartitions() > 20
        got = sorted((r.code, r.name, r.geom.maxx) for r in parts.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((r.code, r.name, r.geom.maxx) for r in read_geojson(spark, str(folder), "code bigint, name string").collect()) and len(got) == 3000
    (folder / "all.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"geometry": None, "properties": {"code": 1, "name": "x"}, "type": "Feature"}] * 2}))
    with pytest.raises(Exception, match="cannot be read in parts"):
        read_geojson(spark, str(folder), "code bigint, name string", split=True).collect()
    (folder / "all.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    assert read_geojson(spark, str(folder), "code bigint, name string", split=True).collect() == []


def test_documents_are_whole(spark, tmp_path):
    path = str(tmp_path / "docs")
    write_documents(spark.range(95).select(F.col("id").cast("string")), path, '{"all":[', "]}", ",", rows=20)
    docs = [json.loads(r.value)["all"] for r in spark.read.text(path, wholetext=True).collect()]
    assert len(docs) == 5 and all(len(x) <= 40 for x in docs) and sorted(sum(docs, [])) == list(range(95))
    write_documents(spark.range(0).select(F.col("id").cast("string")), path, "{", "}")
    assert spark.read.text(path).collect() == []


def test_small_documents_share_a_task(spark, tmp_path, monkeypatch):
    """Documents of few items do not take a task each, and every file is whole."""
    from landspark.sinks import tables
    path, tasks = str(tmp_path / "docs"), lambda: {p.name.split("-")[1] for p in (tmp_path / "docs").glob("part-*")}
    write_documents(spark.range(95).selectExpr("if(id = 7, null, string(id))"), path, '{"all":[', "]}", ",", rows=20)
    docs = [json.loads(r.value)["all"] for r in spark.read.text(path, wholetext=True).collect()]
    assert len(tasks()) == 1 and sorted(map(len, docs)) == [14, 20, 20, 20, 20] and sorted(sum(docs, [])) == [i for i in range(95) if i != 7]
    monkeypatch.setattr(tables, "DOCUMENT_ROWS", 40)
    write_documents(spark.range(95).select(F.col("id").cast("string")), path, '{"all":[', "]}", ",", rows=20)
    docs = [json.loads(r.value)["all"] for r in spark.read.text(path, wholetext=True).collect()]
    assert len(tasks()) == 3 and all(len(x) <= 20 for x in docs) and sorted(sum(docs, [])) == list(range(95))


@pytest.mark.parametrize("limit", [4_000_000, 0])
@pytest.mark.parametrize("prefer", ["first", "longest"])
def test_contained_names(spark, monkeypatch, limit, prefer):
    """By automaton and by joins, long texts and equal names included, against every name in turn."""
    monkeypatch.setattr(lookups, "AUTOMATON", limit)
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    names = [(say(rng.randint(0, 4)), rng.randrange(40), i) for i in range(60)]
    texts = sorted({say(rng.randint(0, 12)) for _ in range(200)} | {say(5000), "xyz"})
    got = lookups.contained_names(spark.createDataFrame([(t,) for t in texts * 2], "t string"), "t", spark.createDataFrame(names, "n string, o int, i int"),
                                  "n", "o", 2, prefer).collect()
    rank = (lambda n: n[1]) if prefer == "first" else (lambda n: (-len(n[0]), n[1]))
    want = {t: min(map(rank, hit)) for t in texts if t and (hit := [n for n in names if len(n[0]) >= 2 and n[0] in t])}
    assert len(got) == len(want) and {r.t: rank(tuple(r.hit)) for r in got} == want and all(r.hit.n in r.t for r in got)


def test_kml_in_part_files_is_read_whole(spark, tmp_path):
    """Part files of one document are no documents of their own."""
    from landspark.sinks.tables import write_kml
    df = spark.range(4000).select(F.col("id").alias("code"), (F.col("id") % 3).cast("string").alias("layer"), g.st_box("id", F.lit(0), F.col("id") + 2, F.lit(3)).alias("geom"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_kml(df, str(tmp_path / "k"), "Many", order=["code"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "k").glob("part-*"))) > 2
    got = read_kml(spark, str(tmp_path / "k")).select(F.col("data")["code"].alias("code"), g.st_area("geom").alias("a")).collect()
    assert sorted(int(r.code) for r in got) == list(range(4000)) and {r.a for r in got} == {6.0}


def test_kml_tags_with_prefixes_and_attributes(spark, tmp_path):
    (tmp_path / "a.kml").write_text('<?xml version="1.0"?>\n<kml:kml xmlns:kml="http://www.opengis.net/kml/2.2"><kml:Document><Placemark id="1"><name>One</name>'
                                    '<description><![CDATA[<b>x</b>]]></description><Point><coordinates>1,2,0</coordinates></Point></Placemark>\n'
                                    '<kml:Placemark><kml:name>Two &amp; three</kml:name></kml:Placemark><Placemark></Placemark></kml:Document></kml:kml>')
    got = read_kml(spark, str(tmp_path / "a.kml")).collect()
    assert sorted((r.name or "", r.shape or "", r.file) for r in got) == [("", "", "a.kml"), ("One", "point", "a.kml"), ("Two & three", "", "a.kml")]


def test_kml_is_parsed_once_below_filters(spark, tmp_path):
    """A filter on the geometry is not pushed below the parser, which would run again for every use."""
    (tmp_path / "a.kml").write_text("<kml><Placemark><name>a</name><Point><coordinates>1,2</coordinates></Point></Placemark><Placemark><name>b</name></Placemark></kml>")
    rows = as_multipolygon(read_kml(spark, str(tmp_path / "a.kml")).filter(F.col("geom").isNotNull()))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") + plan.count("xmltostructs") == 1 and rows.collect() == []
    assert [r.name for r in read_kml(spark, str(tmp_path / "a.kml")).filter(F.col("geom").isNotNull()).collect()] == ["a"]


def test_landed_reports_are_one_flat_folder_in_order(spark, tmp_path, monkeypatch):
    """A file per document, no folder for each, and the numbers follow the reports."""
    from landspark.catalog import files
    path = str(tmp_path / "reports")
    monkeypatch.setattr(files, "scratch_path", lambda s, label: path)
    got = files.landed_reports(spark, "/root/testdata/sf0.1").selectExpr("count(*)", "count_if(seq = cast(ID AS bigint))").first()
    assert got[0] == got[1] == spark.read.parquet("/root/testdata/sf0.1/events.parquet").count()
    assert not [p for p in (tmp_path / "reports").iterdir() if p.is_dir()]
    assert len(list((tmp_path / "reports").glob("part-*"))) == -(-got[0] // 500)
