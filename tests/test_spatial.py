"""Spatial operators against brute force, also where cells are hot and groups are crowded."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landspark.functions import geometry as g, overlay as ov
from landspark.operators import cluster, components as comp, dissolve, grid
from landspark.operators.components import connected_components
from landspark.operators.grid import grid_join
from landspark.operators.overlap import overlap_join, prefixed
from landspark.operators.rowid import with_row_id


def boxes(spark, n, seed, span=60, copies=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = rng.integers(0, span, 2)
        w, h = rng.integers(1, 8, 2)
        rows.append((i, "ab"[i % 2], float(x), float(y), float(x + w), float(y + h)))
    rows += [(n + i, "a", 5.0, 5.0, 9.0, 9.0) for i in range(copies)]
    df = spark.createDataFrame(rows, "id long, grp string, x0 double, y0 double, x1 double, y1 double")
    return rows, df.withColumn("geom", g.st_box("x0", "y0", "x1", "y1"))


def meet(a, b, eps=0.0):
    dx = max(a[2] - b[4], b[2] - a[4], 0)
    dy = max(a[3] - b[5], b[3] - a[5], 0)
    return dx * dx + dy * dy <= eps * eps


@pytest.mark.parametrize("cell,hot", [(4.0, 200_000), (16.0, 200_000), (64.0, 10), (16.0, 3)])
def test_grid_join_finds_each_pair_once(spark, cell, hot):
    a, left = boxes(spark, 80, 1, copies=30)
    b, right = boxes(spark, 60, 2, copies=20)
    got = grid_join(prefixed(left, "l_"), prefixed(right, "r_"), cell, "l_geom", "r_geom", hot_rows=hot).select("l_id", "r_id").collect()
    want = {(p[0], q[0]) for p in a for q in b if meet(p, q)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def components(rows, eps, keep=None):
    label = {r[0]: r[0] for r in rows if keep is None or r[0] in keep}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for p in rows:
        for q in rows:
            if p[0] in label and q[0] in label and p[1] == q[1] and meet(p, q, eps):
                a, b = root(p[0]), root(q[0])
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in label}


@pytest.mark.parametrize("chunk,target,leaf", [(512, 64, 512), (8, 2, 6), (5, 1, 2)])
@pytest.mark.parametrize("min_points", [1, 4])
def test_clusters_match_brute_force(spark, monkeypatch, chunk, target, leaf, min_points):
    monkeypatch.setattr(cluster, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(cluster, "LEAF", leaf)
    monkeypatch.setattr(cluster, "ROUNDS", 4)
    monkeypatch.setattr(cluster, "TARGET_ROWS", target)
    rows, df = boxes(spark, 120, 7, copies=25)
    got = {r.id: r.cluster for r in cluster.dbscan(df, ["grp"], 1.5, min_points, rectangles=True).collect()}
    near = {p[0]: [q for q in rows if p[1] == q[1] and meet(p, q, 1.5)] for p in rows}
    core = {i for i, n in near.items() if len(n) >= min_points}
    want = components(rows, 1.5, core)
    for p in rows:
        if p[0] not in want:
            own = [want[q[0]] for q in near[p[0]] if q[0] in core]
            want[p[0]] = min(own) if own else None
    assert got == want


def test_clusters_of_general_polygons_use_exact_distance(spark):
    tri = lambda x, y: f"POLYGON (({x} {y}, {x + 4} {y}, {x} {y + 4}, {x} {y}))"
    rows = [(0, "a", tri(0, 0)), (1, "a", "POLYGON ((3.5 3.5, 4 3.5, 4 4, 3.5 4, 3.5 3.5))"), (2, "a", tri(-4.5, 0))]
    df = spark.createDataFrame(rows, "id long, grp string, w string").withColumn("geom", g.st_from_text("w"))
    got = {r.id: r.cluster for r in cluster.dbscan(df, ["grp"], 1.0).collect()}
    # the boxes of 0 and 1 overlap, the polygons are further than 1 apart
    assert got == {0: 0, 1: 1, 2: 0}


def test_clusters_of_triangles_and_boxes_in_crowded_regions(spark, monkeypatch):
    """Polygons and rectangles, some regions inside a rectangle and some not, against all pairs of the kernel."""
    monkeypatch.setattr(cluster, "LEAF", 4)
    monkeypatch.setattr(cluster, "CHUNK_ROWS", 3)
    monkeypatch.setattr(cluster, "ROUNDS", 3)
    rng = np.random.default_rng(2)
    rows = []
    for i in range(70):
        x, y = (round(float(v), 1) for v in rng.uniform(0, 40, 2))
        w, h = (round(float(v), 1) for v in rng.choice([0.5, 2, 9], 2))
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)] if i % 2 else [(x, y), (x + w, y), (x, y + h)]
        rows.append((i, "a", f"POLYGON (({', '.join(f'{a:.1f} {b:.1f}' for a, b in ring + ring[:1])}))", np.array(ring + ring[:1])))
    df = spark.createDataFrame([r[:3] for r in rows], "id long, grp string, w string").withColumn("geom", g.st_from_text("w"))
    for eps in (0.0, 0.7):
        label = list(range(70))
        for i in range(70):
            for j in range(i):
                if ov.within_distance([rows[i][3]], [rows[j][3]], eps):
                    low, high = sorted((label[i], label[j]))
                    label = [low if v == high else v for v in label]
        assert 3 < len(set(label)) < 60
        assert {r.id: r.cluster for r in cluster.dbscan(df, ["grp"], eps).collect()} == dict(enumerate(label))


def test_distinct_members_on_one_spot(spark, monkeypatch):
    """20,000 different rectangles over one another: each is listed a few times, not once per 512 others."""
    seen = []
    written = cluster.materialize
    monkeypatch.setattr(cluster, "materialize", lambda df, label: seen.append((label, written(df, label))) or seen[-1][1])
    monkeypatch.setattr(cluster, "connected_components", lambda e, a, b: seen.append(("links", e)) or comp.connected_components(e, a, b))
    df = spark.range(20000).select("id", F.lit("a").alias("grp"), g.st_box(F.rand(1), F.rand(2), F.rand(3) + 2, F.rand(4) + 2).alias("geom"))
    df = written(df, "spot")
    assert cluster.dbscan(df, ["grp"], 0.001, cell=8.0, rectangles=True).filter("cluster = 0").count() == 20000
    regions = [d.count() for label, d in seen if label == "regions"]
    assert "stuck" not in [label for label, d in seen if label == "stuck" and not d.isEmpty()]
    assert 2 <= len(regions) <= 8 and sum(regions) < 4 * 20000, regions


@pytest.mark.parametrize("chunk", [256, 3])
@pytest.mark.parametrize("rectangles", [True, False])
def test_dissolve_area(spark, monkeypatch, chunk, rectangles):
    monkeypatch.setattr(dissolve, "CHUNK_ROWS", chunk)
    rows, df = boxes(spark, 60, 11, span=30, copies=12)
    got = {r.grp: round(r.area) for r in dissolve.dissolve(df, ["grp"], 8.0, rectangles=rectangles)
           .select("grp", g.st_area("geom").alias("area")).collect()}
    for grp in "ab":
        cover = np.zeros((60, 60), bool)
        for _, k, x0, y0, x1, y1 in rows:
            if k == grp:
                cover[int(x0):int(x1), int(y0):int(y1)] = True
        assert got[grp] == cover.sum()


def test_components_of_a_long_chain(spark):
    e = spark.range(400).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = connected_components(e)
    assert out.count() == 400 and out.filter("label <> 0").count() == 0


def links_of(seed, n=3000):
    rng = np.random.default_rng(seed)
    hub = [(0, int(i)) for i in rng.integers(1, n, n // 2)]
    chain = [(n + i, n + i + 1) for i in range(300)]
    return hub + chain + [tuple(map(int, p)) for p in rng.integers(n + 1000, 3 * n, (n // 3, 2))] + [(5, 5), (7, None)]


@pytest.mark.parametrize("whole,hub,lot", [(200_000, 10_000, 1_000_000), (0, 40, 100), (0, 10_000, 7), (0, 3, 1)])
def test_components_of_hubs_chains_and_pairs(spark, monkeypatch, whole, hub, lot):
    """Contraction in one task, by stars with broadcast hubs and by stars alone give what plain union-find gives."""
    for name, value in (("WHOLE", whole), ("HUB", hub), ("LOT", lot)):
        monkeypatch.setattr(comp, name, value)
    links = links_of(hub)
    top = {}

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in links:
        if b is not None:
            low, high = sorted((root(a), root(b)))
            top[high] = low
    want = {i: root(i) for i in top if root(i) != i}
    frame = spark.createDataFrame(links, "src long, dst long").repartition(6)
    got = [tuple(r) for r in connected_components(frame).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_links_of_a_hub_stay_spread(spark, monkeypatch):
    """Most links end in one root, yet no task gets more than twice its share of the rows that are joined."""
    monkeypatch.setattr(comp, "HUB", 100)
    links = spark.range(1, 20001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v")).repartition(8).cache()
    low, hubs = comp._least(links, 20000)
    assert hubs.count() == 1
    joined = comp._with_least(links, low, hubs)
    assert joined.agg(F.max("m")).first()[0] == 1
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 20000 and max(sizes) <= 2 * 20000 / 8


def test_no_geometry_crosses_the_cell_shuffle(spark):
    """The join on cells moves numbers and boxes; each input is read once, where it is written down."""
    _, left = boxes(spark, 50, 1)
    _, right = boxes(spark, 50, 2)
    seen = []
    written = grid.materialize
    try:
        grid.materialize = lambda df, label: seen.append((label, df)) or written(df, label)
        out = grid_join(prefixed(left, "l_"), prefixed(right, "r_"), 4.0, "l_geom", "r_geom")
    finally:
        grid.materialize = written
    assert sorted(label for label, _ in seen) == ["hot", "side", "side"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalRelation" not in plan
    cells = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "_cx" in line]
    assert len(cells) == 2 and not any("parts" in line or "geom" in line for line in cells)
    hot = next(df for label, df in seen if label == "hot")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in hot.splitlines() if "ReadSchema" in line]
    assert scans and not any("parts" in line for line in scans)


def test_overlap_of_stars_is_symmetric_and_cell_free(spark):
    rng = np.random.default_rng(5)

    def star(i):
        a = np.sort(rng.uniform(0, 2 * np.pi, 9))
        r = rng.uniform(1, 4, 9)
        c = rng.uniform(0, 12, 2)
        p = [f"{c[0] + q * np.cos(t):.6f} {c[1] + q * np.sin(t):.6f}" for q, t in zip(r, a)]
        return i, f"POLYGON (({', '.join(p + p[:1])}))"

    make = lambda: spark.createDataFrame([star(i) for i in range(25)], "id long, w string").select(
        "id", g.st_from_text("w").alias("geom"))
    a, b = make().cache(), make().cache()
    area = lambda x, y, cell, l, r: {(q[l], q[r]): round(q.area, 5) for q in overlap_join(x, y, cell, "id", "id").collect()}
    one = area(a, b, 2.0, "l_id", "r_id")
    assert one and one == area(b, a, 7.0, "r_id", "l_id")


def test_row_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = sorted((r.id, r.k) for r in with_row_id(df, ["k"]).collect())
    assert got == [(i + 1, i) for i in range(1000)]


def test_no_cartesian_product_in_overlap_plan(spark):
    _, a = boxes(spark, 10, 1)
    plan = overlap_join(a, a, 8.0, "id", "id", rectangles=True)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_convex_clipping_stays_in_the_jvm(spark):
    """Random convex polygons, either way round, against the kernel; no Python stage in the plan."""
    rng = np.random.default_rng(9)

    def convex(i):
        t = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))[:: rng.choice([1, -1])]
        c, r = rng.uniform(0, 10, 2), rng.uniform(1, 4)
        p = [f"{c[0] + r * np.cos(a):.6f} {c[1] + r * np.sin(a):.6f}" for a in t]
        return i, f"POLYGON (({', '.join(p + p[:1])}))"

    make = lambda: spark.createDataFrame([convex(i) for i in range(40)], "id long, w string").select("id", g.st_from_text("w").alias("geom")).cache()
    a, b = make(), make()
    areas = lambda df: {(r.l_id, r.r_id): r.area for r in df.select("l_id", "r_id", "area").collect() if r.area > 1e-6}
    clipped = overlap_join(a, b, 3.0, "id", "id", convex=True)
    assert "Python" not in clipped._jdf.queryExecution().executedPlan().toString()
    want, got = areas(overlap_join(a, b, 3.0, "id", "id")), areas(clipped)
    assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_boxes_that_continue_one_another_need_no_kernel(spark, monkeypatch):
    """Strips over many cells, with holes in the row and a box within another."""
    dis = dissolve

    def no_kernel(lists):
        return F.when(lists.isNotNull(), F.raise_error(F.lit("kernel"))).cast(dis.PARTS)

    monkeypatch.setattr(dis, "_union_lists", no_kernel)
    k = F.col("id")
    boxes = spark.range(3000).select((k % 2).alias("s"), g.st_box(k * 4, F.lit(0), k * 4 + 10, F.lit(5)).alias("geom"))
    boxes = boxes.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("s"), g.st_box(F.lit(17), F.lit(1), F.lit(18), F.lit(2)).alias("geom")))
    got = {r.s: (r.area, r.n) for r in dis.dissolve(boxes, ["s"], 4.0, rectangles=True).select("s", "area", F.size("geom.parts").alias("n")).collect()}
    assert got == {0: ((2998 * 4 + 10) * 5.0, 1), 1: (2998 * 4 * 5.0 + 50, 1)}


def test_lists_of_positions_are_read_in_one_pass(spark):
    from pyspark.sql import functions as F
    from landspark.functions import geometry as g
    bodies = ["((0 0 7,4 +0 7,4 4e0,0 0),(1 .5,2 1,2 2))", "((0 0,5,1 1))", "((0 0,,1 1))", ""]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(g._read_lists(F.col("t"), 3, lambda t: t)).collect()]
    assert got == [[[["0", "0"], ["4", "+0"], ["4", "4e0"], ["0", "0"]], [["1", ".5"], ["2", "1"], ["2", "2"]]], None, None, None]
    text = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"
    assert df.limit(1).select(g.st_area(g.st_from_text(F.lit(text)))).first()[0] == 15
