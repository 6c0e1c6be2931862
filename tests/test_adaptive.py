"""Crowded cells: the same sums on the adaptive grid, and no cell that stays crowded."""

import math
import random

import pytest
from pyspark.sql import functions as F

from bocage.operators import adaptive, overlay, skew, spatial_join
from bocage.operators.tiles import CELL_M, polygon_records, polygon_tiles, tile_areas
from bocage.sources import layers

PLAIN, TIGHT = 10**9, 40


def _shape(rng, x, y, size):
    kind = rng.randrange(3)
    if kind == 0:
        points = [(0, 0), (1, 0), (1, 1), (0, 1)]
    elif kind == 1:
        points = [(0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)]
    else:
        points = [(0, 0.2), (0.9, 0), (0.3, 1)]
    text = ", ".join(f"{x + a * size} {y + b * size}" for a, b in [*points, points[0]])
    return f"POLYGON (({text}))"


@pytest.fixture(scope="module")
def crowd(spark):
    """Half of all features lie in one cell; some on its borders and on those of its quarters, some are copies."""
    rng = random.Random(12)
    rows = [(i, _shape(rng, rng.uniform(260, 480), rng.uniform(10, 230), rng.choice([2.0, 5.0, 12.0]))) for i in range(120)]
    rows += [(i, _shape(rng, rng.uniform(-900, 1500), rng.uniform(-900, 900), rng.choice([30.0, 400.0]))) for i in range(120, 220)]
    rows += [(220 + i, _shape(rng, 250 + 62.5 * (i % 5), 62.5 * (i // 5), 62.5)) for i in range(20)]
    rows += [(300 + i, rows[i % 3][1]) for i in range(12)]
    layer = layers.parse_layer(spark.createDataFrame(rows, "id int, wkt string"))[0]
    return layer.withColumn("kind", F.col("id") % 3).repartition(3)


def _same(a, b, keys, value):
    left, right = ({tuple(r[k] for k in keys): r[value] for r in df.collect()} for df in (a, b))
    assert left.keys() == right.keys() and len(left) > 5
    assert all(math.isclose(left[k], right[k], rel_tol=1e-9, abs_tol=1e-5) for k in left)


def _targets(spark):
    rng = random.Random(2)
    at = [(i, rng.uniform(200, 520), rng.uniform(-50, 300)) for i in range(25)] + [(25, 375.0, 125.0), (26, 250.0, 0.0)]
    return overlay.discs(spark.createDataFrame(at, "t int, x double, y double"), [40, 260, 700])


def test_overlay_with_discs(spark, crowd):
    both = [overlay.overlay_polygons_discs(crowd, _targets(spark), ["kind"], crowd=n) for n in (PLAIN, TIGHT)]
    _same(*both, ["t", "r", "kind"], "area_m2")


def test_lines_in_discs(spark):
    rng = random.Random(5)
    rows = [(i, 260 + rng.uniform(0, 220), rng.uniform(0, 240)) for i in range(90)]
    wkt = [(i, f"LINESTRING ({x} {y}, {x + rng.uniform(-30, 30)} {y + rng.uniform(-30, 30)}, 375 125)") for i, x, y in rows]
    wkt += [(90, "LINESTRING (0 125, 900 125)"), (91, "LINESTRING (375 -400, 375 400)"), (92, "LINESTRING (250 0, 500 250)")]
    lines = layers.parse_layer(spark.createDataFrame(wkt, "id int, wkt string"))[0]
    both = [overlay.overlay_lines_discs(lines, _targets(spark), "id", crowd=n) for n in (PLAIN, TIGHT)]
    _same(*both, ["t", "r", "id"], "length_m")


def test_overlay_of_two_layers(spark, crowd):
    other = crowd.where("id % 2 = 0").withColumnRenamed("kind", "k")
    both = [overlay.overlay_polygons(crowd, other, ["id"], ["k"], crowd=n) for n in (PLAIN, TIGHT)]
    _same(*both, ["l_id", "r_k"], "area_m2")
    both = [overlay.overlay_polygons(crowd, other, ["id"], crowd=n) for n in (PLAIN, TIGHT)]
    _same(*both, ["id"], "area_m2")


def test_joins(spark, crowd):
    rng = random.Random(7)
    at = [(i, rng.uniform(240, 510), rng.uniform(-10, 260)) for i in range(150)]
    at += [(150 + i, 250 + 31.25 * (i % 9), 31.25 * (i // 9)) for i in range(81)]
    points = spark.createDataFrame(at, "p int, x double, y double")
    plain, tight = ({tuple(r) for r in spatial_join.match_points(crowd, points, "id", "p", crowd=n).collect()} for n in (PLAIN, TIGHT))
    assert plain == tight and len(plain) > 100
    other = crowd.select(F.col("id").alias("o"), "geometry").where("o % 3 <> 1")
    plain, tight = ({tuple(r) for r in spatial_join.match_polygons(crowd, other, "id", "o", crowd=n).collect()} for n in (PLAIN, TIGHT))
    assert plain == tight and len(plain) > 400


def test_splitting_keeps_areas_and_ends_crowding(spark, crowd):
    tiles = polygon_tiles(crowd, ["kind"])
    halves = adaptive.split_records(tiles, ["kind"], CELL_M)
    up = tile_areas(halves, ["kind"], CELL_M / 2).selectExpr("kind", "floor(cx / 2) AS cx", "floor(cy / 2) AS cy", "area_m2")
    key = ["kind", "cx", "cy"]
    total = lambda df: df.groupBy(*key).agg(F.round(F.sum("area_m2"), 6).alias("a")).where("a <> 0")
    assert {tuple(r) for r in total(up).collect()} == {tuple(r) for r in total(tile_areas(tiles, ["kind"])).collect()}
    # a polygon in a quarter leaves nothing in the others
    small = layers.parse_layer(spark.createDataFrame([(1, "POLYGON ((260 150, 300 140, 290 200, 260 150))")], "kind int, wkt string"))[0]
    cells = adaptive.split_records(polygon_tiles(small, ["kind"]), ["kind"], CELL_M).select("cx", "cy").distinct().collect()
    assert [tuple(c) for c in cells] == [(2, 1)]
    # cells are cut until they are not crowded, but for copies of one place
    sizes = []
    split = lambda t, c: adaptive.split_records(t, ["kind"], c)
    for part, _, size, crowded in adaptive.levels(tiles, tiles.select("cx", "cy"), CELL_M, split, split_cells, 40, 6):
        most = part.groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
        sizes.append(size)
        assert crowded or (most or 0) <= 40
    assert len(sizes) > 2 and sizes == [CELL_M / 2**i for i in range(len(sizes))]


def split_cells(cells, _):
    return cells.selectExpr("2 * cx AS cx", "2 * cy AS cy", "explode(array(0, 1, 2, 3)) AS q").selectExpr("cx + q % 2 AS cx", "cy + q div 2 AS cy")


def test_salted_join_meets_every_pair_once(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 90), (2, 3), (3, 50), (5, 1)) for i in range(n)], "k int, a int")
    right = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 2), (3, 1), (4, 9)) for i in range(n)], "k int, b int")
    got = sorted(tuple(r) for r in skew.salted_join(left, right, ["k"], hot_rows=7).collect())
    assert got == sorted(tuple(r) for r in left.join(right, "k").collect())
    copies = spark.createDataFrame([(1, 1)] * 70, "k int, a int")
    joined = skew.salted_join(copies, right, ["k"], hot_rows=7)
    assert joined.count() == 70 * 40


def test_records_of_quarters_as_cut_anew(spark, crowd):
    fine = polygon_records(crowd, ["id"], CELL_M / 2, touching=True)
    halves = adaptive.split_records(polygon_records(crowd, ["id"], CELL_M, touching=True), ["id"], CELL_M, touching=True)
    edges = lambda df: {tuple(r) for r in df.where("xa IS NOT NULL").selectExpr("id", "cx", "cy", "xa", "ya", "xb", "yb").collect()}
    assert edges(fine) <= edges(halves)
