"""What a query reads and moves, where that decides how it grows."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from landspark import constants as K
from landspark.functions import geometry as g
from landspark.functions import overlay as ov
from landspark.operators.dissolve import dissolve_pieces
from landspark.operators.lookups import join_by_code
from landspark.operators.polygons import _Flat, _outline, _shared_parts
from landspark.operators.rows import first_per_key, last_per_key
from landspark.plans.cases import enrich_cases
from landspark.streaming import intake


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_is_read_by_column(spark, tmp_path):
    """of the cases of a store only the columns that are used are read and shuffled."""
    rows = [("a", "n1", 0), ("a", "n2", 3), ("b", "n3", 1)]
    for i, name, epoch in rows:
        spark.createDataFrame([(i, name, "x" * 50)], "id string, name string, text string").write.parquet(
            f"{tmp_path}/store/court=TJPE/epoch={epoch}")
    got = intake.streamed_cases(spark, f"{tmp_path}/store")
    assert sorted(map(tuple, got.select("id", "name", "text").collect())) == [("a", "n2", "x" * 50), ("b", "n3", "x" * 50)]
    schema = plan_of(got.select("id", "name")).split("ReadSchema: ")[1].split("\n")[0]
    assert "name" in schema and "text" not in schema


def test_places_are_broadcast_up_to_a_bound(spark):
    """a few codes have most of the cases, so their places do not make them meet in a few tasks."""
    gaz = spark.createDataFrame([(1, "A", 0.5, 1.5), (2, "B", 2.5, 3.5)], "code int, name string, lon double, lat double")
    df = spark.createDataFrame([(k, 1 + k % 3) for k in range(9)], "k int, c int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near, far = join_by_code(df, "c", gaz), join_by_code(df, "c", gaz, most=1)
        assert "BroadcastHashJoin" in plan_of(near) and "BroadcastHashJoin" not in plan_of(far)
        assert sorted(map(json.dumps, (r.asDict(True) for r in near.collect()))) == sorted(map(json.dumps, (r.asDict(True) for r in far.collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_row_takes_used_columns_only(spark, tmp_path):
    """F16: the first row of a key moves only what is used of it."""
    spark.createDataFrame([(1, 2, "b", "wide"), (1, 1, "a", "wide"), (None, 1, "c", "wide"), (None, None, "d", "wide")],
                          "k int, o int, v string, w string").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    first, last = first_per_key(rows, ["k"], ["o"]), last_per_key(rows, ["k"], ["o"])
    assert {r.v for r in first.collect()} == {"a", "d"} and {r.v for r in last.collect()} == {"b", "c"}
    text = plan_of(first.select("k", "v"))
    assert "WindowGroupLimit" in text and "w" not in text.split("ReadSchema: struct<")[1].split(">")[0].replace("string", "").replace("int", "")


def test_cases_are_worked_out_once(spark):
    """F16: of many cases of a town each is worked out once and its seat looked up once for the town."""
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v
    made = [(str(k), ["TJPE", "TRF5", "TJX", None][k % 4], "c", "1ª Vara" if k % 8 == 1 else None, 10, "Town") for k in range(400)]
    cases = spark.createDataFrame(made, "id string, tribunal string, categoria_conflito string, orgao_julgador_nome string, municipio_ibge int, municipio_nome string")
    cases = cases.withColumn("categoria_conflito", F.udf(count, "string")("categoria_conflito"))
    state = spark.createDataFrame([("Seat", 10, 10, True, "Town; B", 2, 1)], "comarca_nome string, comarca_ibge int, municipio_ibge int, eh_sede boolean, "
                                  "municipios_abrangidos string, total_municipios_comarca int, seq int")
    federal = spark.createDataFrame([("Sub", "Seat", 10, 3, "A; B; C"), ("Other", "Far", 20, 1, "D")], "subsecao_nome string, subsecao_sede_nome string, subsecao_ibge int, "
                                    "total_municipios_subsecao int, municipios_abrangidos string")
    got = enrich_cases(cases, state, federal, rooms={1: "Sub"}, default="Other")
    rows = {r.id: (r.comarca_sede_nome, r.total_municipios_abrangidos, r.tem_municipios_filhos, r.tipo_jurisdicao, r.categoria_conflito) for r in got.collect()}
    assert len(rows) == 400 and seen.value == 400
    assert rows["0"] == ("Seat", 2, True, K.STATE_JURISDICTION, "c") and rows["1"] == ("Seat", 3, True, K.FEDERAL_JURISDICTION, "c")
    assert rows["5"] == ("Far", 1, True, K.FEDERAL_JURISDICTION, "c") and rows["2"] == rows["3"] == (None, None, False, None, "c")


def test_outline_is_traced_once_per_order(monkeypatch):
    """pairs along the axes whose coordinates have the same order share one overlay, with the same parts as by row."""
    rng = np.random.default_rng(3)
    box = lambda x, y, w, h: np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]], float)
    frame = lambda x, y, w, h, m: [box(x, y, w, h), box(x + m, y + m, w - 2 * m, h - 2 * m)[::-1]]
    step = [np.array([[0, 0], [9, 0], [9, 4], [5, 4], [5, 8], [0, 8], [0, 0]], float)]
    a = [frame(*rng.integers(0, 60, 2), *rng.integers(5, 40, 2), 2) for _ in range(600)] + [step, [box(0, 0, 1e-9, 1e-9), box(3, 3, 1, 1)]]
    b = [frame(*rng.integers(0, 20, 2), *rng.integers(30, 60, 2), 12) for _ in range(600)] + [[np.array([[1, 1], [8, 2], [3, 9], [1, 1]], float)], [box(-1, -1, 9, 9), box(20, 20, 1, 1)]]

    def flat(polygons):
        return _Flat(pa.array([{"xs": np.vstack(p)[:, 0].tolist(), "ys": np.vstack(p)[:, 1].tolist(), "ring_sizes": [len(r) for r in p], "part_sizes": [len(p)]}
                               for p in polygons], pa.struct([("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64())),
                                                              ("ring_sizes", pa.list_(pa.int32())), ("part_sizes", pa.list_(pa.int32()))])))
    want = [ov.overlay([x, y], 2) for x, y in zip(a, b)]
    calls, real = [], ov.overlay
    monkeypatch.setattr(ov, "overlay", lambda *args: calls.append(1) or real(*args))
    _outline.cache_clear()
    got = _shared_parts(flat(a + a), flat(b + b))
    assert len(calls) <= 606  # at least each second pair is met again
    key = lambda parts: sorted(sorted(tuple(sorted(map(tuple, r[:-1].tolist()))) for r in p) for p in parts)
    for i, parts in enumerate(want + want):
        assert key(got[i]) == key(parts), i
        assert abs(sum(ov.ring_area(r) for p in got[i] for r in p) - sum(ov.ring_area(r) for p in parts for r in p)) < 1e-9


def test_cells_are_dealt_evenly(spark):
    """cells that need no chunks are merged in as many tasks as those that do, however few bytes they have."""
    boxes = [(k, float(k % 9), float(k % 7), k % 9 + 5.0, k % 7 + 5.0, k // 40) for k in range(400)]
    df = spark.createDataFrame(boxes, "k int, a double, b double, c double, d double, grp int").withColumn("geom", g.st_box("a", "b", "c", "d"))
    merged = dissolve_pieces(df, ["grp"], 8.0, rectangles=True)
    merged.collect()
    assert "REPARTITION_BY_NUM" in plan_of(merged)


def test_union_by_order_is_the_union(monkeypatch):
    """unions of few boxes are traced once per order of their coordinates, with the parts of the plain overlay."""
    rng = np.random.default_rng(5)
    ring = lambda x, y, w, h: np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]], float)
    sets = [[[ring(*rng.integers(0, 9, 2), *rng.integers(1, 9, 2))] for _ in range(1 + k % 3)] for k in range(500)]
    sets += [[[ring(0, 0, 4, 4), ring(1, 1, 1, 1)], [ring(3, 3, 1e-9, 5)]], [[np.array([[0, 0], [4, 1], [0, 4], [0, 0]], float)], [ring(1, 1, 2, 2)]]]
    calls, real = [], ov.overlay
    monkeypatch.setattr(ov, "overlay", lambda *args: calls.append(1) or real(*args))
    ov._ranked.cache_clear()
    for s in sets + [[[r * 3 + 1 for r in own] for own in s] for s in sets]:
        for need in (1, 2):
            got, want = ov.overlay_by_order(s, need), real(s, need)
            assert [[r.tolist() for r in p] for p in got] == [[r.tolist() for r in p] for p in want]
    assert len(calls) < 1010
