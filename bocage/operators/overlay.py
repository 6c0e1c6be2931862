"""Overlays: how much of a layer lies inside discs or inside the polygons of another layer."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.disc import with_clamped_integral, with_disc_clip
from .adaptive import dealt, join_cells, levels, split_lines, split_records
from .shared import written
from .tables import shuffled
from .tiles import CELL_M, _lit, line_tiles, polygon_tiles, tile_areas

# Contacts without extent (shared borders) come out as rounding noise and are no overlap.
# Sums below these arguments are taken for such noise; totals are never cut.
MIN_AREA_M2 = 1e-6
MIN_LENGTH_M = 1e-6
ROW_PART = 64  # cells of a grid row whose running sums are one record


def discs(targets: DataFrame, radii, x: str = "x", y: str = "y") -> DataFrame:
    """One row per target and radius, column ``r``."""
    values = F.array(*[F.lit(float(r)) for r in radii])
    return targets.withColumns({"x": F.col(x), "y": F.col(y), "r": F.explode(values)})


def disc_rows(places: DataFrame, cell: float = CELL_M, quadrant_segments: int = 50) -> DataFrame:
    """Grid rows ``cy`` met by every disc (``x, y, r``): its cells ``n0`` to ``n1``, of which ``w0`` to ``w1`` lie inside it.

    ``w0 > w1`` where none does.
    """
    c, apothem = _lit(cell), math.cos(math.pi / (4 * quadrant_segments))
    return places.selectExpr(
        "x", "y", "r", f"explode(sequence(floor((y - r) / {c}), floor((y + r) / {c}))) AS cy"
    ).selectExpr(
        "*", f"r * r - pow(greatest(cy * {c} - y, 0D, y - (cy + 1) * {c}), 2) AS _near",
        f"pow(r * {apothem!r}D, 2) - pow(greatest(abs(cy * {c} - y), abs((cy + 1) * {c} - y)), 2) AS _far",
    ).where("_near >= 0").selectExpr(
        "x", "y", "r", "cy", f"floor((x - sqrt(_near)) / {c}) AS n0", f"floor((x + sqrt(_near)) / {c}) AS n1",
        f"if(_far >= 0, ceil((x - sqrt(greatest(_far, 0D))) / {c}), 1L) AS w0",
        f"if(_far >= 0, floor((x + sqrt(greatest(_far, 0D))) / {c}) - 1, 0L) AS w1",
    )


def rim_cells(rows: DataFrame) -> DataFrame:
    """The cells of ``disc_rows`` that do not lie inside: ``x, y, r, cx, cy``."""
    cells = rows.selectExpr("x", "y", "r", "cy", "w0", "w1", "explode(sequence(n0, n1)) AS cx")
    return cells.where("cx < w0 OR cx > w1").select("x", "y", "r", "cx", "cy")


def split_discs(cells: DataFrame, cell: float, quadrant_segments: int = 50) -> DataFrame:
    """Cells of discs for cells of half the size; ``whole``: inside the disc.  Cells that miss it are left out."""
    c, apothem = _lit(cell / 2), math.cos(math.pi / (4 * quadrant_segments))
    near = "pow(greatest({v} * {c} - {p}, 0D, {p} - ({v} + 1) * {c}), 2)"
    far = "pow(greatest(abs({v} * {c} - {p}), abs(({v} + 1) * {c} - {p})), 2)"
    both = lambda t: t.format(v="cx", p="x", c=c) + " + " + t.format(v="cy", p="y", c=c)
    four = cells.selectExpr("x", "y", "r", "cx AS _cx", "cy AS _cy", "explode(array(0, 1, 2, 3)) AS _q", "whole AS _whole").selectExpr(
        "x", "y", "r", "2 * _cx + _q % 2 AS cx", "2 * _cy + _q div 2 AS cy", "_whole"
    )
    return four.where(f"{both(near)} <= r * r").selectExpr(
        "x", "y", "r", "cx", "cy", f"_whole OR {both(far)} <= pow(r * {apothem!r}D, 2) AS whole"
    )


def _places(targets: DataFrame) -> DataFrame:
    """Targets that share centre and radius are measured once."""
    return targets.select("x", "y", "r").distinct()


def row_sums(areas: DataFrame, by: list[str]) -> DataFrame:
    """``by, cy, part, sums``: areas of cells added up from left to right over ``ROW_PART`` cells of a grid row.

    ``sums[k]`` is the area of the first k cells, so any run of cells is a difference of two.  A row of the table
    has ``ROW_PART + 1`` numbers, however long the grid row.
    """
    cells = areas.selectExpr(*by, "cy", f"floor(cx / {ROW_PART}) AS part", f"pmod(cx, {ROW_PART}) AS i", "area_m2")
    by_cell = cells.groupBy(*by, "cy", "part").agg(F.map_from_entries(F.collect_list(F.struct("i", "area_m2"))).alias("m"))
    return by_cell.selectExpr(
        *by, "cy", "part",
        f"aggregate(sequence(0L, {ROW_PART - 1}L), array(0D), (s, i) -> array_append(s, s[size(s) - 1] + coalesce(m[i], 0D))) AS sums",
    )


def overlay_polygons_discs(
    layer: DataFrame,
    targets: DataFrame,
    by: list[str],
    cell: float = CELL_M,
    quadrant_segments: int = 50,
    near_only: bool = False,
    min_area: float = MIN_AREA_M2,
    crowd: int | None = None,
) -> DataFrame:
    """Area of the polygons of each group ``by`` inside each disc.

    ``targets`` has ``x, y, r`` and any further columns, which are kept.  One row per target
    and group with area > 0, column ``area_m2``.

    The cells of a disc that lie inside it are runs along grid rows, each of which is read as a difference of two
    running sums; only the cells on the rim look at geometry.  The layer is cut once for all radii.
    ``near_only`` first drops everything outside the cells any disc meets; worth it when the discs cover
    little of the layer.
    """
    n = 4 * quadrant_segments
    rows = disc_rows(_places(targets), cell, quadrant_segments)
    wanted = rows.selectExpr("explode(sequence(n0, n1)) AS cx", "cy").distinct() if near_only else None
    tiles = written(polygon_tiles(layer, by, cell, wanted), "tiles")
    runs = rows.where("w0 <= w1").selectExpr(
        "x", "y", "r", "cy", "w0", "w1", f"explode(sequence(floor(w0 / {ROW_PART}), floor(w1 / {ROW_PART}))) AS part"
    )
    areas = [
        runs.join(shuffled(row_sums(tile_areas(tiles, by, cell), by)), ["cy", "part"]).selectExpr(
            "x", "y", "r", *by,
            f"sums[least(w1 - part * {ROW_PART} + 1, {ROW_PART})] - sums[greatest(w0 - part * {ROW_PART}, 0)] AS area_m2",
        )
    ]
    discs_at = dealt(rim_cells(rows)).withColumn("whole", F.lit(False))
    split = lambda t, c: split_records(t, by, c)
    for part, at, size, crowded in levels(tiles, discs_at, cell, split, lambda d, c: split_discs(d, c, quadrant_segments), crowd):
        met = join_cells(part, at.where("NOT whole"), crowded).selectExpr(
            "x", "y", "r", *by, "w", "xs - x AS sx", "ys - y AS sy", "xe - x AS ex", "ye - y AS ey"
        )
        areas.append(with_clamped_integral(met, n).selectExpr("x", "y", "r", *by, "w * under AS area_m2"))
        if size < cell:
            areas.append(tile_areas(part, by, size).join(shuffled(at.where("whole")), ["cx", "cy"]).select("x", "y", "r", *by, "area_m2"))
    sums = (
        reduce(DataFrame.union, areas)
        .groupBy("x", "y", "r", *by)
        .agg(F.sum("area_m2").alias("area_m2"))
        .where(F.col("area_m2") > min_area)
    )
    return targets.join(shuffled(sums), ["x", "y", "r"])


def overlay_lines_discs(
    layer: DataFrame,
    targets: DataFrame,
    line_id: str,
    cell: float = CELL_M,
    quadrant_segments: int = 50,
    min_length: float = MIN_LENGTH_M,
    crowd: int | None = None,
) -> DataFrame:
    """Length of each line inside each disc: target columns, ``line_id``, ``length_m``."""
    rows = disc_rows(_places(targets), cell, quadrant_segments)
    cells = rows.selectExpr("x", "y", "r", "cy", "w0", "w1", "explode(sequence(n0, n1)) AS cx")
    cells = dealt(cells.selectExpr("x", "y", "r", "cx", "cy", "cx BETWEEN w0 AND w1 AS whole"))
    pieces = written(line_tiles(layer, [line_id], cell), "lines")
    split = lambda p, c: split_lines(p, [line_id], c)
    found = []
    for part, at, _, crowded in levels(pieces, cells, cell, split, lambda d, c: split_discs(d, c, quadrant_segments), crowd):
        met = join_cells(part, at, crowded).selectExpr(
            "x", "y", "r", line_id, "whole", "length_m",
            "xs - x AS sx", "ys - y AS sy", "xe - x AS ex", "ye - y AS ey",
        )
        met = with_disc_clip(met, 4 * quadrant_segments)
        found.append(met.selectExpr("x", "y", "r", line_id, "if(whole, length_m, length_m * (t_out - t_in)) AS length_m"))
    lengths = (
        reduce(DataFrame.union, found)
        .groupBy("x", "y", "r", line_id)
        .agg(F.sum("length_m").alias("length_m"))
        .where(F.col("length_m") > min_length)
    )
    return targets.join(shuffled(lengths), ["x", "y", "r"])


def overlay_polygons(
    left: DataFrame,
    right: DataFrame,
    left_by: list[str],
    right_by: list[str] = (),
    cell: float = CELL_M,
    min_area: float = MIN_AREA_M2,
    crowd: int | None = None,
) -> DataFrame:
    """Area shared by polygons of two layers, per group of either side (``area_m2`` > 0).

    Without ``right_by`` the right layer is merged as a whole before the join: its shared
    borders and copies vanish, and parts covered twice still count twice.

    Two records meet only where their x ranges overlap; heights are taken from the bottom
    of the cell, so records on that line drop out.
    """
    left_by, right_by = list(left_by), list(right_by)
    keys = [f"l_{k}" for k in left_by] + [f"r_{k}" for k in right_by]
    a = polygon_tiles(left, left_by, cell).withColumnsRenamed({k: f"l_{k}" for k in left_by})
    b = polygon_tiles(right, right_by, cell).withColumnsRenamed({k: f"r_{k}" for k in right_by})
    split = lambda own: lambda t, c: split_records(t, own, c)
    sizes = levels(
        written(a, "tiles"), written(b, "tiles"), cell, split([f"l_{k}" for k in left_by]), split([f"r_{k}" for k in right_by]), crowd
    )
    pairs = reduce(DataFrame.union, [_shared_areas(x, y, keys, size, crowded) for x, y, size, crowded in sizes])
    out = pairs.groupBy(*keys).agg(F.sum("area_m2").alias("area_m2"))
    out = out.where(F.col("area_m2") > min_area)
    if not right_by:
        out = out.withColumnsRenamed({f"l_{k}": k for k in left_by})
    return out


def _shared_areas(a: DataFrame, b: DataFrame, keys: list[str], cell: float, crowded: bool) -> DataFrame:
    """``keys, area_m2`` of every two records that overlap in their x ranges."""
    c = _lit(cell)
    raised = f"ys > cy * {c} OR ye > cy * {c}"
    other = b.where(raised).withColumnsRenamed({"xs": "xs2", "ys": "ys2", "xe": "xe2", "ye": "ye2", "w": "w2"})
    return (
        join_cells(other, a.where(raised), crowded)
        .where("xs < xe2 AND xs2 < xe")
        .selectExpr(
            *keys, "w * w2 AS w", "greatest(xs, xs2) AS p", "least(xe, xe2) AS q",
            "xs", "xs2", f"ys - cy * {c} AS ya", f"ys2 - cy * {c} AS yb",
            "(ye - ys) / (xe - xs) AS ga", "(ye2 - ys2) / (xe2 - xs2) AS gb",
        )
        .selectExpr(
            *keys, "w", "q - p AS d",
            "ya + ga * (p - xs) AS a0", "ya + ga * (q - xs) AS a1",
            "yb + gb * (p - xs2) AS b0", "yb + gb * (q - xs2) AS b1",
        )
        # integral of the lower of two straight lines, which cross at most once (at height c)
        .selectExpr(
            "*", "abs(a0 - b0) AS d0", "abs(a1 - b1) AS d1",
            "try_divide(a0 * b1 - a1 * b0, (a0 - b0) - (a1 - b1)) AS c",
        )
        .selectExpr(
            *keys,
            """w * d / 2 * CASE
                 WHEN (a0 - b0) * (a1 - b1) >= 0 THEN least(a0, b0) + least(a1, b1)
                 ELSE (d0 * (least(a0, b0) + c) + d1 * (least(a1, b1) + c)) / (d0 + d1)
               END AS area_m2""",
        )
    )
