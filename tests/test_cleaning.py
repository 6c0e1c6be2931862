"""Cleaning of layers: what is mended, what is set apart."""

import pytest
from pyspark.sql import functions as F

from bocage.functions import geometry as g
from bocage.operators.cleaning import clean_layer
from bocage.sources import layers

SQUARE = "(0 0, 10 0, 10 10, 0 10, 0 0)"
# name -> WKT, area, number of shells and holes
CLEAN = {
    "square": (f"POLYGON ({SQUARE})", 100, 1, 0),
    "repeated": ("POLYGON ((0 0, 0 0, 10 0, 10 0, 10 10, 0 10, 0 0, 0 0))", 100, 1, 0),
    "spike": ("POLYGON ((0 0, 10 0, 10 5, 20 5, 10 5, 10 10, 0 10, 0 0))", 100, 1, 0),
    "bent spike": ("POLYGON ((0 0, 10 0, 10 5, 20 5, 20 9, 20 5, 10 5, 10 10, 0 10, 0 0))", 100, 1, 0),
    "spike at the start": ("POLYGON ((-5 0, 0 0, 10 0, 10 10, 0 10, 0 0, -5 0))", 100, 1, 0),
    "overshoot": ("POLYGON ((0 0, 12 0, 10 0, 10 10, 0 10, 0 0))", 100, 1, 0),
    "zero ring": (f"POLYGON ({SQUARE}, (2 2, 4 4, 2 2))", 100, 1, 0),
    "line as hole": (f"POLYGON ({SQUARE}, (2 2, 4 2, 6 2, 2 2))", 100, 1, 0),
    "hole": (f"POLYGON ({SQUARE}, (2 2, 4 2, 4 4, 2 4, 2 2))", 96, 1, 1),
    "hole outside": (f"POLYGON ({SQUARE}, (22 2, 24 2, 24 4, 22 4, 22 2))", 104, 2, 0),
    "hole as part": (f"MULTIPOLYGON (({SQUARE}), ((2 2, 4 2, 4 4, 2 4, 2 2)))", 96, 1, 1),
    "island in the hole": (f"POLYGON ({SQUARE}, (1 1, 9 1, 9 9, 1 9, 1 1), (3 3, 5 3, 5 5, 3 5, 3 3), (6 6, 8 6, 8 8, 6 8, 6 6))", 44, 3, 1),
    "hole that touches": (f"POLYGON ({SQUARE}, (0 5, 3 4, 3 6, 0 5))", 97, 1, 1),
    "two parts": (f"MULTIPOLYGON (({SQUARE}), ((20 0, 30 0, 30 10, 20 10, 20 0), (22 2, 23 2, 23 3, 22 3, 22 2)))", 199, 2, 1),
    "parts that touch": (f"MULTIPOLYGON (({SQUARE}), ((10 10, 12 10, 12 12, 10 12, 10 10)))", 104, 2, 0),
    "far away": ("POLYGON ((700000 6600000, 700010 6600000, 700010 6600010, 700000 6600010, 700000 6600000))", 100, 1, 0),
}
APART = {
    "figure eight": ("POLYGON ((0 0, 10 10, 10 0, 0 10, 0 0))", ["crosses itself"]),
    "loop": ("POLYGON ((0 0, 10 0, 10 10, 5 10, 5 -5, 0 10, 0 0))", ["crosses itself"]),
    "eight through a vertex": ("POLYGON ((0 0, 5 5, 10 0, 10 10, 5 5, 0 10, 0 0))", ["touches itself"]),
    "vertex on an edge": ("POLYGON ((0 0, 10 0, 10 10, 5 0, 0 10, 0 0))", ["touches itself"]),
    "rings that cross": (f"POLYGON ({SQUARE}, (5 5, 15 5, 15 8, 5 8, 5 5))", ["rings cross"]),
    "crossing at vertices": (f"POLYGON ({SQUARE}, (5 5, 10 0, 15 5, 10 10, 5 5))", ["rings cross"]),
    "parts with a common border": (f"MULTIPOLYGON (({SQUARE}), ((10 2, 12 2, 12 8, 10 8, 10 2)))", ["rings cross"]),
    "the same ring twice": (f"MULTIPOLYGON (({SQUARE}), ({SQUARE}))", ["rings cross"]),
    "nothing": ("POLYGON ((1 1, 2 2, 1 1))", ["no area"]),
    "a point": ("POLYGON ((1 1, 1 1, 1 1, 1 1))", ["no area"]),
}


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [(n, w[0]) for n, w in (CLEAN | APART).items()] * 2
    layer = layers.parse_layer(spark.createDataFrame(rows, "name string, wkt string"))[0]
    missing = spark.createDataFrame([("missing",)], "name string").withColumn("geometry", F.lit(None).cast(g.GEOMETRY_TYPE))
    return clean_layer(layer.unionByName(missing).repartition(3))


def test_what_can_be_mended_is(cleaned):
    holes = F.size(F.filter("geometry", lambda r: r["is_hole"]))
    found = cleaned[0].select("name", F.round(g.area("geometry"), 6).alias("area"), (F.size("geometry") - holes).alias("shells"), holes.alias("holes")).collect()
    want = sorted((n, float(area), shells, holes) for n, (_, area, shells, holes) in CLEAN.items() for _ in range(2))
    assert sorted(tuple(r) for r in found) == want


def test_what_cannot_is_set_apart(cleaned):
    want = sorted([(n, r) for n, (_, r) in APART.items()] * 2 + [("missing", ["no area"])])
    assert sorted((r.name, r.reasons) for r in cleaned[1].select("name", "reasons").collect()) == want


def test_holes_follow_their_shells(cleaned):
    text = {r.name: r.t for r in cleaned[0].select("name", g.to_wkt("geometry").alias("t")).collect()}
    assert text["hole as part"].startswith("POLYGON ((0.0 0.0") and text["hole as part"].count("(") == 3
    assert text["island in the hole"].startswith("MULTIPOLYGON")
    assert "geometry" in cleaned[1].columns


def test_empty_layer(spark):
    clean, apart = clean_layer(spark.createDataFrame([], f"name string, geometry {g.GEOMETRY_TYPE}"))
    assert clean.collect() == [] and apart.collect() == []
