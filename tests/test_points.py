"""Points are worked out once, not in the scan of every pass over them."""

from pyspark.sql import functions as F

from bocage.operators import spatial_join
from bocage.sources import layers


def test_points_are_written_before_they_are_matched(spark):
    cells = layers.parse_layer(spark.createDataFrame([(1, "POLYGON ((0 0, 90 0, 90 90, 0 90, 0 0))")], "FID long, wkt string"))[0]
    points = layers.spread(spark.range(4)).select(F.col("id").alias("pt"), (F.cbrt("id") * 40).alias("x"), F.lit(3.0).alias("y"))
    found = spatial_join.match_points(cells, points, "FID", "pt")
    assert "CBRT" not in found._jdf.queryExecution().optimizedPlan().toString().upper()
    assert sorted(r["pt"] for r in found.collect()) == [i for i in range(4) if 40 * i ** (1 / 3) <= 90]
