"""Spatial joins: which polygons hold which points, which polygons meet.

Both test contact, so borders count.  A polygon is represented by its boundary records per
grid cell; a point or an edge is compared only with records of its own cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adaptive import join_cells, levels, split_points, split_records
from .shared import written
from .tables import shuffled
from .tiles import CELL_M, cell_of, polygon_records

# A point this close to an edge (relative to the length of the edge) lies on it.
ON_EDGE = 1e-9


def _has_edge(prefix: str = "") -> str:
    return f"{prefix}xa IS NOT NULL"


def match_points(
    polygons: DataFrame, points: DataFrame, polygon_id: str, point_id: str, cell: float = CELL_M, crowd: int | None = None
) -> DataFrame:
    """Pairs (``polygon_id``, ``point_id``) where the polygon holds the point ``x, y``.

    ``sum(w)`` over the records above the point is its winding number in the polygon.
    """
    records = polygon_records(polygons.select(F.col(polygon_id).alias("poly"), "geometry"), ["poly"], cell, touching=True)
    # where a point lies may be dear to work out, and the optimiser would do it in the task that scans the file
    at = written(points.select(F.col(point_id).alias("pt"), "x", "y"), "points")
    held = _holding(written(records, "records"), at, cell, crowd)
    return held.select(F.col("poly").alias(polygon_id), F.col("pt").alias(point_id))


def _holding(records: DataFrame, points: DataFrame, cell: float, crowd: int | None) -> DataFrame:
    """Pairs ``poly, pt`` from written records of polygons and points ``pt, x, y``."""
    split = lambda t, c: split_records(t, ["poly"], c, touching=True)
    sizes = levels(records, cell_of(points, cell), cell, split, split_points, crowd)
    met = reduce(DataFrame.union, [join_cells(a.drop("ys", "ye"), b, crowded) for a, b, _, crowded in sizes])
    # side < 0: the point lies below the edge (edges are stored left to right)
    side = "((xb - xa) * (y - ya) - (yb - ya) * (x - xa))"
    span = "(abs(xb - xa) + abs(yb - ya))"
    hits = met.selectExpr(
        "poly", "pt",
        f"CASE WHEN NOT (xs <= x AND x < xe) THEN 0 WHEN {_has_edge()} THEN if({side} < 0, w, 0)"
        f" ELSE if(closing_top, w, 0) END AS w",
        f"coalesce(abs({side}) <= {ON_EDGE!r}D * {span}"
        f" AND x BETWEEN xa - {ON_EDGE!r}D * {span} AND xb + {ON_EDGE!r}D * {span}"
        f" AND y BETWEEN least(ya, yb) - {ON_EDGE!r}D * {span} AND greatest(ya, yb) + {ON_EDGE!r}D * {span},"
        f" false) AS on_edge",
    ).where("w <> 0 OR on_edge")
    return (
        hits.groupBy("poly", "pt")
        .agg(F.sum("w").alias("w"), F.max("on_edge").alias("on_edge"))
        .where("w > 0 OR on_edge")
        .select("poly", "pt")
    )


def match_polygons(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float = CELL_M, crowd: int | None = None
) -> DataFrame:
    """Pairs (``left_id``, ``right_id``) of polygons that share at least one point.

    Two polygons meet when edges meet, or when one part lies wholly inside the other; the
    latter shows on one vertex per ring.
    """
    a = left.select(F.col(left_id).alias("lid"), "geometry")
    b = right.select(F.col(right_id).alias("rid"), "geometry")

    def records(df, key):
        return written(polygon_records(df.withColumnRenamed(key, "poly"), ["poly"], cell, touching=True), "records")

    def split(t, c):
        return split_records(t, ["poly"], c, touching=True).where(_has_edge())

    def whole_edges(df, key, out):
        return df.select(F.col("poly").alias(key), "cx", "cy", *[F.col(c).alias(c + out) for c in ("xa", "ya", "xb", "yb")])

    left_records, right_records = records(a, "lid"), records(b, "rid")
    sizes = levels(right_records.where(_has_edge()), left_records.where(_has_edge()), cell, split, split, crowd)
    near = reduce(DataFrame.union, [
        join_cells(whole_edges(r, "rid", "2"), whole_edges(l, "lid", ""), crowded).where(
            "xa <= xb2 AND xa2 <= xb AND least(ya, yb) <= greatest(ya2, yb2)"
            " AND least(ya2, yb2) <= greatest(ya, yb)"
        )
        for r, l, _, crowded in sizes
    ])

    def turn(p, q):
        """Sign of the turn from edge ``p`` towards the end ``q`` of the other edge."""
        return f"signum((xb{p} - xa{p}) * (y{q} - ya{p}) - (yb{p} - ya{p}) * (x{q} - xa{p}))"

    meeting = (
        near.where(f"{turn('', 'a2')} * {turn('', 'b2')} <= 0 AND {turn('2', 'a')} * {turn('2', 'b')} <= 0")
        .select("lid", "rid")
    )

    def marks(df, key):
        """One vertex of every ring, numbered by its polygon."""
        return df.select(F.col(key).alias("pt"), F.explode("geometry").alias("ring")).select(
            "pt",
            F.get("ring.pts", F.lit(0))["x"].alias("x"),
            F.get("ring.pts", F.lit(0))["y"].alias("y"),
        )

    held = _holding(left_records, marks(b, "rid"), cell, crowd).selectExpr("poly AS lid", "pt AS rid")
    holds = _holding(right_records, marks(a, "lid"), cell, crowd).selectExpr("pt AS lid", "poly AS rid")
    return (
        meeting.union(held).union(holds).distinct()
        .select(F.col("lid").alias(left_id), F.col("rid").alias(right_id))
    )


def join_points(
    polygons: DataFrame, points: DataFrame, polygon_id: str, point_id: str, cell: float = CELL_M
) -> DataFrame:
    """All polygons with the attributes of every point they hold; NULL for those that hold none."""
    pairs = match_points(polygons, points, polygon_id, point_id, cell)
    return polygons.join(shuffled(pairs.join(shuffled(points.drop("x", "y")), point_id)), polygon_id, "left")


def join_polygons(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, cell: float = CELL_M
) -> DataFrame:
    """All left polygons with the attributes of every right polygon they touch."""
    pairs = match_polygons(left, right, left_id, right_id, cell)
    return left.join(shuffled(pairs.join(shuffled(right.drop("geometry")), right_id)), left_id, "left")
