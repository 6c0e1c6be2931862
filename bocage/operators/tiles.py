"""Cut layers along a square grid, so that every spatial question becomes a join on a cell.

A polygon layer is cut into *boundary records*.  Inside its cell a record is a piece of a
polygon edge, or a horizontal piece on a grid line that closes the part of the polygon
lying in the cell.  A record runs from left to right and has a weight: +1 when the polygon
lies below it, -1 when above.  For one cell

* ``sum(w * integral of y)`` is the area of the polygon in the cell,
* ``sum(w)`` over the records above a point is 1 inside the polygon and 0 outside,

and both sums still hold when the records of many polygons are added up.  Equal records can
therefore be merged before anything is joined: copies collapse, and a border shared by two
polygons of one class cancels.

The closing pieces need no sort along the grid line: an edge that crosses the line at ``x``
adds a piece from ``x`` to the right end of its ring; beyond the ring they cancel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .tables import shuffled

CELL_M = 250.0  # default grid size in metres


def _lit(c: float) -> str:
    return f"{float(c)!r}D"


def cell_of(points: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    c = _lit(cell)
    return points.selectExpr("*", f"floor({x} / {c}) AS cx", f"floor({y} / {c}) AS cy")


def _left_to_right(exploded: DataFrame, keep: list[str]) -> DataFrame:
    """Name edge ends from left to right; vertical ones from bottom to top."""
    first = "(e.x0 < e.x1 OR (e.x0 = e.x1 AND e.y0 <= e.y1))"
    return exploded.selectExpr(
        *keep,
        f"if({first}, e.x0, e.x1) AS xa", f"if({first}, e.y0, e.y1) AS ya",
        f"if({first}, e.x1, e.x0) AS xb", f"if({first}, e.y1, e.y0) AS yb",
        "CASE WHEN e.x0 > e.x1 THEN 1 WHEN e.x0 < e.x1 THEN -1 ELSE 0 END AS w",
        "CASE WHEN e.y0 > e.y1 THEN 1 WHEN e.y0 < e.y1 THEN -1 ELSE 0 END AS down",
    )


# parameter along the edge at which it crosses a vertical / horizontal grid line
def _tx(line: str) -> str:
    return f"try_divide({line} - xa, xb - xa)"


def _ty(line: str) -> str:
    return f"try_divide({line} - ya, yb - ya)"


def _column_part(c: str) -> list[str]:
    """Part ``t0..t1`` of the edge inside grid column ``i``."""
    return [
        f"if(xa >= i * {c}, 0D, {_tx(f'i * {c}')}) AS t0",
        f"if(xb <= (i + 1) * {c}, 1D, {_tx(f'(i + 1) * {c}')}) AS t1",
    ]


def _row_part(c: str) -> list[str]:
    """Part ``u0..u1`` of the column part inside grid row ``j``; ``j0``/``j1`` are the end rows."""
    lo, hi = _ty(f"j * {c}"), _ty(f"(j + 1) * {c}")
    return [
        f"if(j = j0, t0, greatest(t0, least(t1, if(yb >= ya, {lo}, {hi})))) AS u0",
        f"if(j = j1, t1, greatest(t0, least(t1, if(yb >= ya, {hi}, {lo})))) AS u1",
    ]


def polygon_records(
    layer: DataFrame,
    by: list[str],
    cell: float = CELL_M,
    touching: bool = False,
    geometry: str = "geometry",
) -> DataFrame:
    """Boundary records: ``by``, ``cx``, ``cy``, ``xs, ys, xe, ye``, ``w``.

    With ``touching`` the records also carry the whole edge they were cut from
    (``xa, ya, xb, yb``; NULL on closing pieces) and pieces without width are kept, which
    tests of contact need.  One pass over the layer.
    """
    c = _lit(cell)
    exploded = layer.select(
        *by,
        F.explode(g.orient(geometry)).alias("_ring"),
    ).select(
        *by,
        F.floor(F.array_max(F.transform("_ring.pts", lambda p: p["x"])) / F.lit(float(cell))).alias("last_cx"),
        F.explode(g.ring_edges(F.col("_ring.pts"))).alias("e"),
    )
    edges = _left_to_right(exploded, [*by, "last_cx"])
    steps = "array<struct<closing:boolean,i:bigint>>"
    piece_from = "true" if touching else "w <> 0"
    edges = edges.selectExpr(
        "*", f"floor(least(ya, yb) / {c}) AS lo", f"floor(greatest(ya, yb) / {c}) AS hi"
    ).selectExpr(
        "*",
        f"""inline(concat(
            if({piece_from}, transform(sequence(floor(xa / {c}), floor(xb / {c})),
               i -> named_struct('closing', false, 'i', i)), CAST(array() AS {steps})),
            if(lo < hi, transform(sequence(lo + 1, hi),
               i -> named_struct('closing', true, 'i', i)), CAST(array() AS {steps}))))""",
    )
    parts = edges.selectExpr(
        "*", *_column_part(c), f"coalesce({_ty(f'i * {c}')}, 0D) AS tk"
    ).selectExpr(
        "*",
        f"floor((ya + t0 * (yb - ya)) / {c}) AS j0",
        f"floor((ya + t1 * (yb - ya)) / {c}) AS j1",
        "xa + greatest(0D, least(1D, tk)) * (xb - xa) AS xk",
    )
    parts = parts.selectExpr(
        "*",
        f"""explode(if(closing, sequence(floor(xk / {c}), greatest(last_cx, floor(xk / {c}))),
                    sequence(least(j0, j1), greatest(j0, j1)))) AS j""",
    ).selectExpr("*", *_row_part(c))
    # a closing piece is the top of the cell below its line and the bottom of the one above
    parts = parts.selectExpr("*", "explode(if(closing, array(-1, 0), array(0))) AS side")
    records = parts.selectExpr(
        *by,
        "if(closing, j, i) AS cx",
        "if(closing, i + side, j) AS cy",
        f"if(closing, greatest(xk, j * {c}), xa + u0 * (xb - xa)) AS xs",
        f"if(closing, i * {c}, ya + u0 * (yb - ya)) AS ys",
        f"if(closing, (j + 1) * {c}, xa + u1 * (xb - xa)) AS xe",
        f"if(closing, i * {c}, ya + u1 * (yb - ya)) AS ye",
        "CASE WHEN NOT closing THEN w WHEN side = -1 THEN down ELSE -down END AS w",
        *[f"if(closing, NULL, {v}) AS {v}" for v in ("xa", "ya", "xb", "yb")],
        "closing AND side = -1 AS closing_top",
    )
    if touching:
        return records
    return records.drop("xa", "ya", "xb", "yb", "closing_top").where("xs < xe")


def merge_records(records: DataFrame, by: list[str]) -> DataFrame:
    """Add up equal records of one group; what cancels disappears.

    The grouping key holds the coordinates, so a crowded cell is spread over all tasks and
    copies are merged on the map side.
    """
    return (
        records.groupBy(*by, "cx", "cy", "xs", "ys", "xe", "ye")
        .agg(F.sum("w").alias("w"))
        .where("w <> 0")
    )


def polygon_tiles(
    layer: DataFrame,
    by: list[str],
    cell: float = CELL_M,
    cells: DataFrame | None = None,
    geometry: str = "geometry",
) -> DataFrame:
    """Merged boundary records of a polygon layer per group ``by``.

    ``cells``: keep only these grid cells (``cx``, ``cy``).
    """
    records = polygon_records(layer, by, cell, geometry=geometry)
    if cells is not None:
        records = records.join(shuffled(cells), ["cx", "cy"], "left_semi")
    return merge_records(records, by)


def tile_areas(tiles: DataFrame, by: list[str], cell: float = CELL_M) -> DataFrame:
    """Area per group and cell."""
    c = _lit(cell)
    return tiles.groupBy(*by, "cx", "cy").agg(
        F.expr(f"sum(w * (xe - xs) * ((ys + ye) / 2 - cy * {c}))").alias("area_m2")
    )


def line_tiles(
    layer: DataFrame, by: list[str], cell: float = CELL_M, geometry: str = "geometry"
) -> DataFrame:
    """Line layer cut along the grid: ``by``, ``cx``, ``cy``, ``xs, ys, xe, ye``, ``length_m``."""
    c = _lit(cell)
    exploded = layer.select(*by, F.explode(g.edges(geometry)).alias("e"))
    parts = (
        _left_to_right(exploded, by)
        .selectExpr("*", f"explode(sequence(floor(xa / {c}), floor(xb / {c}))) AS i")
        .selectExpr("*", *_column_part(c))
        .selectExpr(
            "*",
            f"floor((ya + t0 * (yb - ya)) / {c}) AS j0",
            f"floor((ya + t1 * (yb - ya)) / {c}) AS j1",
        )
        .selectExpr("*", "explode(sequence(least(j0, j1), greatest(j0, j1))) AS j")
        .selectExpr("*", *_row_part(c))
        .where("u0 < u1")
    )
    return parts.selectExpr(
        *by, "i AS cx", "j AS cy",
        "xa + u0 * (xb - xa) AS xs", "ya + u0 * (yb - ya) AS ys",
        "xa + u1 * (xb - xa) AS xe", "ya + u1 * (yb - ya) AS ye",
        "(u1 - u0) * hypot(xb - xa, yb - ya) AS length_m",
    )
