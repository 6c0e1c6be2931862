"""A grid that adapts: crowded cells are cut into four, on both sides of a join, until they are not.

Every spatial join runs cell by cell.  Where features crowd, a cell of the plain grid would hold any
number of records and land in one task.  So cells are counted on both sides first; those with
more than ``CROWD`` records on either are cut in half both ways, records and all, and counted again.
What is left crowded after ``DEEPEST`` cuts (copies of one place) is salted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .skew import salted_join
from .tables import shuffled
from .tiles import _lit, merge_records

CROWD = 4_000
DEEPEST = 8
_CELL = ["cx", "cy"]


def split_records(records: DataFrame, keep: list[str], cell: float, touching: bool = False) -> DataFrame:
    """Boundary records (see ``tiles``) of cells of size ``cell`` for cells of half the size.

    Inside the lower half a record above it is a piece along the dividing line: from where the record begins to
    the right end of the cell, and from where it ends with the opposite weight.  The upper half gets the same pieces
    with opposite weights, which close it from below (contact, ``touching``, does not need them).  Pieces of
    a polygon that lies above cancel, as they do between cells of the plain grid.
    """
    c = _lit(cell)
    least_x = "xe >= xm" if touching else "xe > xm"
    extra = ["xa", "ya", "xb", "yb", "closing_top"] if touching else []
    columns = records.selectExpr(
        *keep, *_CELL, "xs", "ys", "xe", "ye", "w", *extra, f"(cx + 0.5D) * {c} AS xm", f"(cy + 0.5D) * {c} AS ym",
        f"explode(filter(array(0, 1), k -> if(k = 0, xs < (cx + 0.5D) * {c}, {least_x.replace('xm', f'(cx + 0.5D) * {c}')}))) AS col",
    ).selectExpr(
        *keep, *_CELL, "w", *extra, "xm", "ym", "col", "xs", "ys", "xe", "ye",
        "if(col = 0, xs, greatest(xs, xm)) AS x0", "if(col = 0, least(xe, xm), xe) AS x1", "try_divide(ye - ys, xe - xs) AS g",
        f"if(col = 0, xm, (cx + 1) * {c}) AS right",
    ).selectExpr(
        *keep, *_CELL, "w", *extra, "ym", "col", "x0", "x1", "right",
        "if(x0 = xs, ys, ys + (x0 - xs) * g) AS y0", "if(x1 = xe, ye, ys + (x1 - xs) * g) AS y1",
    ).selectExpr(
        "*", "coalesce(x0 + try_divide(ym - y0, y1 - y0) * (x1 - x0), x0) AS xk"
    ).selectExpr(
        # the part above the dividing line
        "*", "if(y0 >= ym, x0, xk) AS ux0", "if(y1 >= ym, x1, xk) AS ux1", "greatest(y0, y1) >= ym AS above",
    )
    kinds = f"""concat(if(least(y0, y1) < ym, array(0), CAST(array() AS array<int>)), if(above, array(1), CAST(array() AS array<int>)),
        if(above AND w <> 0 AND ux0 < ux1, array({"2, 3" if touching else "2, 3, 4, 5"}), CAST(array() AS array<int>)))"""
    parts = columns.selectExpr("*", f"explode({kinds}) AS part")
    pick = lambda low, up, start, end: f"CASE part WHEN 0 THEN {low} WHEN 1 THEN {up} WHEN 2 THEN {start} WHEN 4 THEN {start} ELSE {end} END"
    out = parts.selectExpr(
        *keep, "2 * cx + col AS cx", "2 * cy + if(part IN (1, 4, 5), 1, 0) AS cy",
        f"{pick('if(y0 < ym, x0, xk)', 'ux0', 'ux0', 'ux1')} AS xs", f"{pick('if(y0 < ym, y0, ym)', 'if(y0 >= ym, y0, ym)', 'ym', 'ym')} AS ys",
        f"{pick('if(y1 < ym, x1, xk)', 'ux1', 'right', 'right')} AS xe", f"{pick('if(y1 < ym, y1, ym)', 'if(y1 >= ym, y1, ym)', 'ym', 'ym')} AS ye",
        "if(part IN (3, 4), -w, w) AS w",
        *([f"if(part < 2, {v}, NULL) AS {v}" for v in extra[:4]] + ["part >= 2 OR closing_top AS closing_top"] if touching else []),
    )
    if not touching:
        return merge_records(out.where("xs < xe"), keep)
    closing = out.where("xa IS NULL")
    merged = merge_records(closing.where("xs < xe"), [*keep, "closing_top", *extra[:4]])
    return out.where("xa IS NOT NULL").unionByName(merged)


def split_lines(pieces: DataFrame, keep: list[str], cell: float) -> DataFrame:
    """Pieces of lines in cells of size ``cell`` for cells of half the size."""
    c = _lit(cell)
    cuts = pieces.selectExpr("*", f"(cx + 0.5D) * {c} AS xm", f"(cy + 0.5D) * {c} AS ym").selectExpr(
        "*", "try_divide(xm - xs, xe - xs) AS tx", "try_divide(ym - ys, ye - ys) AS ty"
    ).selectExpr(
        "*", "array_sort(array_distinct(array(0D, least(1D, greatest(0D, coalesce(tx, 0D))), least(1D, greatest(0D, coalesce(ty, 0D))), 1D))) AS t"
    ).selectExpr("*", "posexplode(slice(t, 1, size(t) - 1)) AS (n, t0)").selectExpr("*", "t[n + 1] AS t1")
    middle = "{v}s + (t0 + t1) / 2 * ({v}e - {v}s)".format
    return cuts.selectExpr(
        *keep, f"2 * cx + if({middle(v='x')} >= xm, 1, 0) AS cx", f"2 * cy + if({middle(v='y')} >= ym, 1, 0) AS cy",
        "xs + t0 * (xe - xs) AS xs", "ys + t0 * (ye - ys) AS ys", "xs + t1 * (xe - xs) AS xe", "ys + t1 * (ye - ys) AS ye",
        "(t1 - t0) * length_m AS length_m",
    )


def split_points(points: DataFrame, cell: float) -> DataFrame:
    c = _lit(cell / 2)
    return points.withColumns({"cx": F.expr(f"floor(x / {c})"), "cy": F.expr(f"floor(y / {c})")})


def levels(
    a: DataFrame, b: DataFrame, cell: float, split_a: Callable, split_b: Callable,
    crowd: int | None = None, deepest: int | None = None,
) -> Iterator[tuple[DataFrame, DataFrame, float, bool]]:
    """``a, b, cell, crowded`` for every size of cells: what is to be joined on ``cx, cy`` at this size.

    ``a`` and ``b`` are read twice, so what is dear should be written.  ``split_a(rows, cell)`` gives rows for cells of half the size.
    ``crowded`` marks the last size, where cells may be crowded still.
    """
    crowd, deepest = crowd or CROWD, DEEPEST if deepest is None else deepest
    for level in range(deepest + 1):
        if level == deepest:
            yield a, b, cell, True
            return
        count = lambda df: df.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n"))
        both = count(a).join(shuffled(count(b).withColumnRenamed("n", "m")), _CELL)
        full = both.where((F.col("n") > crowd) | (F.col("m") > crowd)).select(*_CELL)
        if full.isEmpty():
            yield a, b, cell, False
            return
        full = written(full, "crowded")  # one of CROWD records at most, so it may be broadcast
        yield a.join(full, _CELL, "left_anti"), b.join(full, _CELL, "left_anti"), cell, False
        a = written(split_a(a.join(full, _CELL, "left_semi"), cell), "finer")
        b = written(split_b(b.join(full, _CELL, "left_semi"), cell), "finer")
        cell /= 2


def join_cells(a: DataFrame, b: DataFrame, crowded: bool) -> DataFrame:
    return salted_join(a, b, _CELL) if crowded else a.join(shuffled(b), _CELL)


def dealt(cells: DataFrame) -> DataFrame:
    """Cells of targets spread over all tasks: few of them can mean much work, which their size does not tell."""
    return cells.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_CELL)
