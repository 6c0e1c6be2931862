"""Layers as tables: WKT text in CSV or Parquet, with what cannot be read set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ";", blank_is_null: bool = True) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    if blank_is_null:
        reader = reader.option("nullValue", "").option("emptyValue", "")
    return reader.schema(schema).csv(path)


def write_table(df: DataFrame, path: str, sep: str = ",", order: list[str] | None = None) -> None:
    """Files with a header each.  With ``order`` (NULL first) rows are dealt by ranges of it and sorted, so that the files, in the
    order of their names, hold the table in order; rows equal in all order columns are in any order."""
    if order:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def spread(rows: DataFrame) -> DataFrame:
    """The same rows dealt evenly over all tasks, whatever they hold.

    A small file is read by few tasks, but each of its rows becomes a feature that is cut into many records.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.monotonically_increasing_id())


def parse_layer(rows: DataFrame, wkt: str = "wkt", srid: int = 2154) -> tuple[DataFrame, DataFrame]:
    """The layer, and the rows whose geometry cannot be read."""
    parsed = rows.withColumn("geometry", g.from_wkt(wkt))
    layer = parsed.where("geometry IS NOT NULL").drop(wkt)
    return g.set_srid(layer, srid), parsed.where("geometry IS NULL").drop("geometry")


def read_layer(spark: SparkSession, path: str, wkt: str = "wkt", srid: int = 2154) -> tuple[DataFrame, DataFrame]:
    return parse_layer(spark.read.parquet(path), wkt, srid)


def write_layer(layer: DataFrame, path: str, kind: str = "polygon", wkt: str = "wkt") -> None:
    layer.withColumn(wkt, g.to_wkt("geometry", kind)).drop("geometry").write.mode("overwrite").parquet(path)


def points_from_columns(rows: DataFrame, x: str, y: str, srid: int = 4326) -> DataFrame:
    points = rows.withColumns({"x": F.col(x).cast("double"), "y": F.col(y).cast("double")})
    return g.set_srid(points, srid)


BOX = ["xmin", "ymin", "xmax", "ymax"]


def _interleaved(x: str, y: str, bits: int = 16) -> str:
    """Place on a Z-shaped curve of two whole numbers below 2**bits."""
    spread = lambda v, by: " + ".join(f"shiftleft(shiftright({v}, {i}) & 1L, {2 * i + by})" for i in range(bits))
    return f"{spread(x, 0)} + {spread(y, 1)}"


def write_indexed_layer(layer: DataFrame, path: str, kind: str = "polygon", row_group_rows: int = 20_000, grid_m: float = 100.0) -> None:
    """A layer whose features lie along a Z-shaped curve of the middles of their boxes, with the boxes as columns.

    Neighbours share row groups, so a window skips most of them by the statistics of the boxes.  Features without
    geometry have no box and no place: they come first.
    """
    points = F.flatten(F.transform("geometry", lambda r: r["pts"]))
    xs, ys = F.transform(points, lambda q: q["x"]), F.transform(points, lambda q: q["y"])
    boxed = layer.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})
    near = lambda a, b: f"CAST(pmod(floor(({a} + {b}) / 2 / {grid_m!r}D) + 32768, 65536) AS BIGINT)"
    placed = boxed.selectExpr("*", f"{near('xmin', 'xmax')} AS _zx", f"{near('ymin', 'ymax')} AS _zy").selectExpr("*", f"{_interleaved('_zx', '_zy')} AS _z")
    parts = int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = placed.repartitionByRange(parts, "_z").sortWithinPartitions("_z").drop("_z", "_zx", "_zy")
    out = sorted_.withColumn("wkt", g.to_wkt("geometry", kind)).drop("geometry").write.mode("overwrite")
    out.option("parquet.block.row.count.limit", row_group_rows).option("maxRecordsPerFile", 50 * row_group_rows).parquet(path)


def read_window(spark: SparkSession, path: str, window: tuple[float, float, float, float], srid: int = 2154) -> tuple[DataFrame, DataFrame]:
    """Features of an indexed layer whose boxes meet the window (x0, y0, x1, y1); the filters reach the scan."""
    x0, y0, x1, y1 = map(float, window)
    rows = spark.read.parquet(path).where(
        (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)
    )
    layer, rejects = parse_layer(rows, srid=srid)
    return layer.drop(*BOX), rejects.drop(*BOX)
