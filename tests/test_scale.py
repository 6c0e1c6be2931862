"""Nothing that grows with the tables goes whole through the driver; rows of a small file are worked on by all tasks."""

import pytest
from pyspark.sql import functions as F

from bocage.operators import cleaning, overlay, spatial_join, tables
from bocage.plans import landscape, queries
from bocage.sources import layers


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(i, f"POLYGON (({x} {y}, {x + 90} {y}, {x + 90} {y + 90}, {x} {y + 90}, {x} {y}))") for i, (x, y) in enumerate((100 * (k % 6), 100 * (k // 6)) for k in range(36))]
    return layers.parse_layer(spark.createDataFrame(rows, "FID long, wkt string"))[0].withColumn("Code_n1", F.col("FID") % 7)


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(str(i), 37.0 * i % 600, 53.0 * i % 600) for i in range(20)], "id_plot string, x double, y double")


def test_no_side_of_a_spatial_join_is_broadcast(cells, points):
    other = cells.select(F.col("FID").alias("net"), "geometry")
    at = overlay.discs(points, [120, 300])
    for found in (
        spatial_join.match_points(cells, points, "FID", "id_plot"), spatial_join.match_polygons(cells, other, "FID", "net"),
        overlay.overlay_polygons_discs(cells, at, ["Code_n1"]),
        overlay.overlay_polygons(cells, other, ["FID"], ["net"]), landscape.update_land_cover_hits(cells, points),
        landscape.organic_share(points, cells, [120]),
    ):
        plan = _plan(found)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_shuffled_keeps_the_kind_of_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k int, a string")
    right = spark.createDataFrame([(2, "x"), (None, "y"), (3, "z")], "k int, b string")
    for how in ("inner", "left", "full", "left_semi", "left_anti"):
        rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
        assert rows(left.join(tables.shuffled(right), "k", how)) == rows(left.join(right, "k", how))


def test_rows_of_one_file_are_dealt_over_all_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id AS p_partkey", "CAST(1 + id % 50 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(40).selectExpr("IF(id = 7, NULL, id) AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(90).selectExpr("IF(id < 50, 3L, id) AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    d, parts = str(tmp_path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows, n in ((queries._cells(spark, d), 400), (queries._plot_rows(spark, d), 40), (queries.hedges(spark, d), 90)):
        held = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(held) == parts and sum(held) == n and max(held) <= 2 * n / parts
    assert queries.hedges(spark, d).where("id = 3").count() == 50


def test_rings_are_worked_out_once(spark, cells):
    """The way around a ring was written into its own steps dozens of times, each of which was worked out again."""
    plan = cells.select(cleaning.tidy_rings("geometry"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("slice(") <= 50
