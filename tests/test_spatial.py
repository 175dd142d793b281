import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventrates.functions import geometry
from eventrates.operators import spatial

SCHEMA = "YEAR int, GEOID string, rings array<array<struct<x:double,y:double>>>"


def square(x, y, size=1.0):
    x, y, size = float(x), float(y), float(size)
    return [(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]


def polygons(spark, shapes):
    return spark.createDataFrame([(2018, name, rings) for name, rings in shapes.items()], SCHEMA)


def points(spark, data):
    return spark.createDataFrame([(i, 2018, float(x), float(y)) for i, (x, y) in enumerate(data)], "id int, YEAR int, lon double, lat double")


def matched(df):
    return sorted((r["id"], r["GEOID"]) for r in df.collect())


@pytest.mark.parametrize("cell", [None, 0.3, 1.0, 7.0])
@pytest.mark.parametrize("limit", [0, 1 << 28])
def test_shared_edge_vertex_hole_notch(spark, cell, limit):
    shapes = {
        "left": [square(0, 0)],
        "right": [square(1, 0)],
        "holed": [square(3, 0, 3), square(4, 1, 1)],
        "notched": [[(8.0, 0.0), (10.0, 0.0), (10.0, 2.0), (9.0, 1.0), (8.0, 2.0)]],
    }
    data = [(1, 0.5), (0, 0), (4.5, 1.5), (3.5, 1.5), (4, 1.5), (9, 1.5), (9, 0.5), (8.5, 1.5), (50, 50), (1, 1)]
    got = spatial.points_in(points(spark, data), polygons(spark, shapes), "lon", "lat", keys=["YEAR"], cell=cell, broadcast_limit=limit)
    assert matched(got) == [
        (0, "left"), (0, "right"), (1, "left"), (3, "holed"), (4, "holed"), (6, "notched"), (7, "notched"),
        (9, "left"), (9, "right"),
    ]
    semi = spatial.points_in(points(spark, data), polygons(spark, shapes), "lon", "lat", "semi", cell=cell, broadcast_limit=limit)
    assert sorted(r["id"] for r in semi.collect()) == [0, 1, 3, 4, 6, 7, 9]
    assert semi.columns == ["id", "YEAR", "lon", "lat"]


def inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return True
    return odd


corner = st.tuples(st.integers(0, 12), st.integers(0, 12))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(corner, min_size=3, max_size=7, unique=True), st.sampled_from([0.7, 2.0, 5.0]))
def test_grid_agrees_with_ray_casting(spark, ring, cell):
    data = [(x / 2, y / 2) for x in range(0, 26, 3) for y in range(0, 26, 3)]
    ring = [(float(x), float(y)) for x, y in ring]
    got = spatial.points_in(points(spark, data), polygons(spark, {"p": [ring]}), "lon", "lat", "semi", cell=cell)
    assert sorted(r["id"] for r in got.collect()) == [i for i, (x, y) in enumerate(data) if inside(ring, x, y)]


def test_crowded_cell_keeps_every_copy(spark):
    crowd = [(0.25, 0.25)] * 600 + [(random.Random(1).random() * 3, 0.5) for _ in range(300)]
    shapes = polygons(spark, {"a": [square(0, 0)], "b": [square(1, 0)]})
    fast = spatial.points_in(points(spark, crowd), shapes, "lon", "lat", keys=["YEAR"])
    slow = spatial.points_in(points(spark, crowd), shapes, "lon", "lat", keys=["YEAR"], broadcast_limit=0)
    assert matched(fast) == matched(slow)
    copies = points(spark, crowd).drop("id")
    assert spatial.points_in(copies, shapes.drop("YEAR"), "lon", "lat", broadcast_limit=0).where("lat = 0.25").count() == 600


def test_column_clash_is_refused(spark):
    shapes = polygons(spark, {"a": [square(0, 0)]})
    with pytest.raises(ValueError, match="YEAR"):
        spatial.points_in(points(spark, [(0, 0)]), shapes, "lon", "lat")


@pytest.mark.parametrize("cell", [None, 0.4, 3.0])
def test_touching(spark, cell):
    shapes = {
        "crossing": [square(-0.5, 1)],
        "edge": [square(4, 1)],
        "corner": [square(4, 4)],
        "within": [square(1, 1, 0.2)],
        "around": [square(-5, -5, 20)],
        "apart": [square(6, 6)],
        "beside": [square(4.001, 0)],
        "in_hole": [square(2.2, 2.2, 0.1)],
    }
    boundary = spark.createDataFrame([([square(0, 0, 4), square(2, 2, 1)],)], "rings array<array<struct<x:double,y:double>>>")
    got = spatial.polygons_touching(polygons(spark, shapes), boundary, cell=cell)
    assert sorted(r["GEOID"] for r in got.collect()) == ["around", "corner", "crossing", "edge", "within"]
    assert got.columns == ["YEAR", "GEOID", "rings"]


def test_no_pairing_join_in_plans(spark):
    shapes = polygons(spark, {"a": [square(0, 0)]})
    for limit in (0, 1 << 28):
        df = spatial.points_in(points(spark, [(0, 0)]), shapes, "lon", "lat", keys=["YEAR"], broadcast_limit=limit)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_oblique_edge_needs_tolerance(spark):
    ring = [[(0.0, 0.0), (1.0, 0.1), (1.0, 1.0)]]
    df = polygons(spark, {"t": ring}).select(geometry.ring_edges(F.col("rings")).alias("e"), F.lit(0.3).alias("x"), F.lit(0.03).alias("y"))
    strict, loose = (df.select(geometry.on_edge(F.col("e"), F.col("x"), F.col("y"), eps)).first()[0] for eps in (0.0, 1e-12))
    assert loose and strict in (True, False)


def test_gathered_points_keep_multiplicity(spark):
    df = points(spark, [(0, 0), (0, 0), (1, 1)])
    got = spatial.gather_points(df, ["YEAR"], "lon", "lat").orderBy(F.desc("n")).collect()
    assert [(r["points"]["x"], r["n"]) for r in got] == [(0.0, 2), (1.0, 1)]


def segments(ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def side(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def cross(s, t):
    (a, b), (p, q) = s, t
    for i in (0, 1):
        if max(a[i], b[i]) < min(p[i], q[i]) or max(p[i], q[i]) < min(a[i], b[i]):
            return False
    return side(a, b, p) * side(a, b, q) <= 0 and side(p, q, a) * side(p, q, b) <= 0


def meet(r, s):
    return any(cross(a, b) for a in segments(r) for b in segments(s)) or inside(s, *r[0]) or inside(r, *s[0])


triangle = st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=3, unique=True)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(triangle, min_size=1, max_size=8), triangle, st.sampled_from([0.9, 3.0, 8.0]), st.booleans())
def test_touching_agrees_with_all_pairs(spark, shapes, other, cell, shuffled):
    shapes = {str(i): [[(float(x), float(y)) for x, y in t]] for i, t in enumerate(shapes)}
    other = [(float(x), float(y)) for x, y in other]
    boundary = spark.createDataFrame([([other],)], "rings array<array<struct<x:double,y:double>>>")
    limit = 0 if shuffled else 1 << 28
    got = spatial.polygons_touching(polygons(spark, shapes), boundary, cell=cell, broadcast_limit=limit)
    assert sorted(r["GEOID"] for r in got.collect()) == sorted(k for k, v in shapes.items() if meet(v[0], other))


@pytest.mark.parametrize("cell", [None, 0.5, 4.0, 20.0])
def test_slanted_edge_touches_nothing_beside_it(spark, cell):
    triangle = [(10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    boundary = spark.createDataFrame([([triangle],)], "rings array<array<struct<x:double,y:double>>>")
    got = spatial.polygons_touching(polygons(spark, {"far": [square(0, 0)], "on": [square(4.5, 4.5)]}), boundary, cell=cell)
    assert [r["GEOID"] for r in got.collect()] == ["on"]


@pytest.mark.parametrize("limit", [0, 1 << 28])
def test_points_without_finite_coordinates_match_nothing(spark, limit):
    nan, inf = float("nan"), float("inf")
    odd = [(nan, nan), (nan, 0.5), (0.5, inf), (-inf, 0.5), (inf, nan), (0.5, 0.5)]
    shapes = polygons(spark, {"a": [square(-1, -1, 3)]})
    got = spatial.points_in(points(spark, odd), shapes, "lon", "lat", "semi", keys=["YEAR"], broadcast_limit=limit)
    assert [r["id"] for r in got.collect()] == [5]


@pytest.mark.parametrize("limit", [0, 1 << 28])
def test_wide_polygon_among_narrow_ones(spark, limit):
    shapes = {str(i): [square(10 * i, 10 * i)] for i in range(20)} | {"wide": [square(-400, -400, 1000.5)]}
    shapes["slanted"] = [[(0.5, -300.0), (900.0, 500.0), (0.5, 500.0)]]
    shapes["far"] = [square(700, 0)]
    table = polygons(spark, shapes)
    index = spatial.polygon_cells(table, 0.25)
    rows = {r["GEOID"]: (r["n"], r["levels"]) for r in index.groupBy("GEOID").agg(F.count("*").alias("n"), F.count_distinct("__level").alias("levels")).collect()}
    assert max(n for n, _ in rows.values()) <= (spatial.SPAN + 2) ** 2 and {k for _, k in rows.values()} == {1}
    draw = random.Random(2)
    data = [(draw.uniform(-450, 950), draw.uniform(-450, 950)) for _ in range(300)] + [(10 * i + 0.5, 10 * i + 1) for i in range(20)]
    want = sorted((i, k) for i, (x, y) in enumerate(data) for k, rings in shapes.items() if inside(rings[0], x, y))
    got = spatial.points_in(points(spark, data), table, "lon", "lat", keys=["YEAR"], cell=0.25, broadcast_limit=limit)
    assert matched(got) == want
    semi = spatial.points_in(points(spark, data), table, "lon", "lat", "semi", keys=["YEAR"], cell=0.25, broadcast_limit=limit)
    assert sorted(r["id"] for r in semi.collect()) == sorted({i for i, _ in want})


@pytest.mark.parametrize("limit", [0, 1 << 28])
def test_narrow_and_wide_polygons_touch(spark, limit):
    shapes = {
        "in": [square(3, 3)],
        "on": [square(1000, 5)],
        "out": [square(1000.5, 5)],
        "around": [square(-9000, -9000, 20000)],
        "across": [square(999, -2, 300)],
        "in_hole": [square(501, 501, 0.5)],
    }
    boundary = spark.createDataFrame([([square(0, 0, 1000), square(500, 500, 100)],), ([square(3000, 0)],)], "rings array<array<struct<x:double,y:double>>>")
    got = spatial.polygons_touching(polygons(spark, shapes), boundary, cell=0.2, broadcast_limit=limit)
    assert sorted(r["GEOID"] for r in got.collect()) == ["across", "around", "in", "on"]
