import math

import pytest
from pyspark.sql import functions as F

from bocage.functions import geometry as g
from bocage.operators import overlay, spatial_join, tables
from bocage.operators.tiles import polygon_records
from bocage.plans import landscape
from bocage.sources import layers

SHAPES = [
    ("square", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))", 100.0, (5.0, 5.0)),
    ("hole", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))", 96.0, (488 / 96, 488 / 96)),
    ("ell", "POLYGON ((0 0, 4 0, 4 2, 2 2, 2 4, 0 4, 0 0))", 12.0, (5 / 3, 5 / 3)),
    ("open", "POLYGON ((0 0, 10 0, 10 10, 0 10))", 100.0, (5.0, 5.0)),
    ("deep", "SRID=2154;POLYGON Z ((0 0 1, 10 0 1, 10 10 1, 0 10 1, 0 0 1))", 100.0, (5.0, 5.0)),
    ("two", "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((4 0, 6 0, 6 2, 4 2, 4 0)))", 8.0, (3.0, 1.0)),
]


def test_area_centroid_and_rejects(spark):
    rows = [(n, w) for n, w, _, _ in SHAPES] + [("bad", "POLYGON ((0 0, x 0, 1 1, 0 0))"), ("null", None)]
    layer, rejects = layers.parse_layer(spark.createDataFrame(rows, "name string, wkt string"))
    got = {r.name: r for r in layer.select("name", g.area("geometry").alias("a"), g.centroid("geometry").alias("c")).collect()}
    for name, _, area, (x, y) in SHAPES:
        assert got[name].a == pytest.approx(area)
        assert (got[name].c.x, got[name].c.y) == pytest.approx((x, y))
    assert {r.name for r in rejects.collect()} == {"bad", "null"}


def test_multipoint_has_no_holes_and_null_stays_null(spark):
    row = spark.range(1).select(
        g.from_wkt(F.lit("MULTIPOINT((1 2),(3 4))")).alias("p"), g.to_wkt(F.lit(None).cast(g.GEOMETRY_TYPE)).alias("t")
    ).first()
    assert [r.is_hole for r in row.p] == [False, False] and row.t is None


def _layer(spark, rows):
    return layers.parse_layer(spark.createDataFrame(rows, "id int, wkt string"))[0]


def test_overlays_with_discs(spark):
    big = _layer(spark, [(1, "POLYGON ((-5000 -5000, 5000 -5000, 5000 5000, -5000 5000))"), (2, "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))")])
    at = overlay.discs(spark.createDataFrame([(0.0, 0.0)], "x double, y double"), [1000])
    got = {r.id: r.area_m2 for r in overlay.overlay_polygons_discs(big, at, ["id"]).collect()}
    assert got[1] == pytest.approx(landscape.nominal_ratio() * 1e6) and got[2] == pytest.approx(81)
    line = _layer(spark, [(1, "LINESTRING (-2000 0, 2000 0)"), (2, "LINESTRING (3000 0, 3000 9)")])
    assert [(r.id, round(r.length_m, 6)) for r in overlay.overlay_lines_discs(line, at, "id").collect()] == [(1, 2000.0)]
    assert landscape.nominal_ratio() == pytest.approx(100 * math.sin(2 * math.pi / 200))


def test_joins_count_borders(spark):
    polygons = _layer(spark, [(1, SHAPES[1][1]), (2, "POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0))"), (3, "POLYGON ((50 50, 60 50, 60 60, 50 60))")])
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 10.0, 5.0), (3, 3.0, 3.0), (4, 99.0, 9.0), (5, 2.0, 3.0), (6, 0.0, 0.0)], "p int, x double, y double")
    got = {(r.id, r.p) for r in spatial_join.join_points(polygons, points, "id", "p").collect()}
    assert got == {(1, 1), (1, 2), (2, 2), (1, 5), (1, 6), (3, None)}
    pairs = spatial_join.match_polygons(polygons, polygons.withColumnRenamed("id", "other"), "id", "other")
    assert {(r.id, r.other) for r in pairs.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}


def test_closing_pieces_end_with_their_ring(spark):
    square = "((0 0, 1000 0, 1000 1000, 0 1000, 0 0))"
    one = polygon_records(_layer(spark, [(1, f"POLYGON {square}")]), ["id"]).count()
    far = "((500000 0, 501000 0, 501000 1000, 500000 1000, 500000 0))"
    assert polygon_records(_layer(spark, [(1, f"MULTIPOLYGON ({square}, {far})")]), ["id"]).count() <= 2 * one


def test_merge_renames_a_right_column_named_like_a_left_key(spark):
    a = spark.createDataFrame([(1, "u")], "id int, v string")
    b = spark.createDataFrame([(1, 9, "w")], "pid int, id int, v string")
    assert tables.merge(a, b, "id", "pid").collect()[0].asDict() == {"id": 1, "left_v": "u", "right_id": 9, "right_v": "w"}


def test_pivot_keeps_what_is_not_listed(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "z", 3.0), (1, None, 4.0)], "k int, n string, v double")
    got = tables.pivot_sum(rows, ["k"], "n", "v", {"a": "a", "b": "b"}, null_name="none", other_name="other").first()
    assert (got.a, got.b, got.none, got.other) == (2.0, None, 4.0, 3.0)


def test_csv_and_layer_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    layers.write_table(rows, str(tmp_path / "t"), ";")
    assert {tuple(r) for r in layers.read_table(spark, str(tmp_path / "t"), "k string, v string").collect()} == {("a", None), ("b", "x")}
    layer = _layer(spark, [(1, SHAPES[1][1])])
    layers.write_layer(layer, str(tmp_path / "l"))
    back, rejects = layers.read_layer(spark, str(tmp_path / "l"))
    assert rejects.isEmpty() and back.select(g.area("geometry")).first()[0] == 96.0
