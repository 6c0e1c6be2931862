"""Cleaning of polygon layers: what can be mended ring by ring is, what crosses itself is set apart.

Rings are closed, repeated vertices and spikes removed, rings without area dropped, and shells and holes told apart by how the
rings of a feature lie in each other.  Rings that cross or touch themselves or each other along a line have no
area that formulas agree on; their features go to a quarantine table with the reasons.

Every feature has a grid of its own, as fine as its edges are long on average, so that the pieces of its edges are
about as many as the edges, and edges are only compared within a cell of their feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .shared import written
from .tables import shuffled
from .tiles import _column_part, _left_to_right, _row_part

PLACE = 0.3819660112501051  # where on an edge its test point lies: rarely where something else touches it
SMALL = 1e-9  # of a ring's length: a ring that is no wider has no area

SELF_CROSSING, SELF_TOUCHING, RINGS_CROSS, NO_AREA = "crosses itself", "touches itself", "rings cross", "no area"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once and not wherever it is named."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _same(a: Column, b: Column) -> Column:
    return (a["x"] == b["x"]) & (a["y"] == b["y"])


def _turns_back(a: Column, b: Column, c: Column) -> Column:
    """At b the way goes straight back."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
    return (ux * vy == uy * vx) & (ux * vx + uy * vy < 0)


def _without_repeats(pts: Column) -> Column:
    return F.filter(pts, lambda p, i: (i == 0) | ~_same(p, F.get(pts, i - 1)))


def _closed(pts: Column) -> Column:
    return _once(pts, lambda p: F.when(_same(F.element_at(p, 1), F.element_at(p, -1)), p).otherwise(F.concat(p, F.slice(p, 1, 1))))


def _has_spike(pts: Column) -> Column:
    """Somewhere the ring goes straight back; the closing vertex has the second one after it."""
    n = F.size(pts)
    after = lambda i: F.when(i == n - 1, F.get(pts, F.lit(1))).otherwise(F.get(pts, i + 1))
    return F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(_turns_back(F.get(pts, i - 1), F.get(pts, i), after(i)), F.lit(False)))


def _without_spikes(pts: Column) -> Column:
    """Vertices put on a pile; one where the way goes straight back is taken off it, however long the spike.

    The pile begins at a vertex that is no spike's tip.
    """
    n = F.size(pts) - 1

    def turned(open_: Column) -> Column:
        before = lambda i: F.get(open_, F.when(i == 0, n - 1).otherwise(i - 1))
        after = lambda i: F.get(open_, F.when(i == n - 1, F.lit(0)).otherwise(i + 1))
        firm = F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~_turns_back(before(i), F.get(open_, i), after(i))))
        return _once(F.coalesce(firm, F.lit(0)), lambda start: F.concat(
            F.slice(open_, start + 1, n - start), F.slice(open_, F.lit(1), start), F.slice(open_, start + 1, F.lit(1))
        ))

    def put(pile: Column, p: Column) -> Column:
        last, second = F.element_at(pile, -1), F.element_at(pile, -2)
        tip = (F.size(pile) >= 2) & _turns_back(second, last, p)
        cut = F.when(tip, F.slice(pile, F.lit(1), F.size(pile) - 1)).otherwise(pile)
        return _once(cut, lambda c: F.when(_same(F.element_at(c, -1), p), c).otherwise(F.array_append(c, p)))

    way = _once(F.slice(pts, F.lit(1), n), turned)
    return _once(way, lambda w: F.aggregate(F.slice(w, F.lit(2), n), F.slice(w, F.lit(1), F.lit(1)), put))


def tidy_rings(geometry) -> Column:
    """Rings closed, without missing or repeated vertices, without spikes and without those that have no area; numbered 0, 1, 2 …"""
    known = F.transform(g._col(geometry), lambda r: F.filter(r["pts"], lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    rings = F.transform(F.filter(known, lambda p: F.size(p) > 2), lambda p: _closed(_without_repeats(p)))
    smooth = F.transform(rings, lambda p: F.when(_has_spike(p), _closed(_without_spikes(p))).otherwise(p))

    def has_area(p: Column) -> Column:
        """Not all on one line; the sum of a figure eight may be 0, so it tells nothing."""
        length = F.aggregate(g.ring_edges(p), F.lit(0.0), lambda acc, e: acc + F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]))
        a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        off = lambda q: F.abs((b["x"] - a["x"]) * (q["y"] - a["y"]) - (b["y"] - a["y"]) * (q["x"] - a["x"]))
        long = F.hypot(b["x"] - a["x"], b["y"] - a["y"])
        return (F.size(p) > 3) & F.exists(p, lambda q: off(q) > SMALL * long * length)

    return F.transform(
        F.filter(smooth, has_area), lambda p, i: F.struct(i.cast("int").alias("ring_id"), F.lit(False).alias("is_hole"), p.alias("pts"))
    )


def _edges(tidy: DataFrame) -> DataFrame:
    """``_row, ring, no`` and ends from left to right of every edge, with the size ``c`` of the cells of its feature."""
    length = g.length("geometry")
    sized = tidy.select("_row", "geometry", (length / F.size(g.edges("geometry"))).alias("c"))
    rings = sized.select("_row", "c", F.explode("geometry").alias("_r"))
    return _left_to_right(rings.select("_row", "c", "_r.ring_id", F.posexplode(g.ring_edges(F.col("_r.pts"))).alias("no", "e")), ["_row", "c", "ring_id", "no"])


def _crossings(edges: DataFrame) -> DataFrame:
    """``_row, reason``: pairs of edges of a feature that meet where they must not."""
    parts = (
        edges.selectExpr("*", "explode(sequence(floor(xa / c), floor(xb / c))) AS i")
        .selectExpr("*", *_column_part("c"))
        .selectExpr("*", "floor((ya + t0 * (yb - ya)) / c) AS j0", "floor((ya + t1 * (yb - ya)) / c) AS j1")
        .selectExpr("*", "explode(sequence(least(j0, j1), greatest(j0, j1))) AS j")
        .select("_row", "i", "j", "ring_id", "no", "xa", "ya", "xb", "yb")
    )
    parts = written(parts, "edges")
    other = parts.withColumnsRenamed({c: f"{c}2" for c in ("ring_id", "no", "xa", "ya", "xb", "yb")})
    near = parts.join(shuffled(other), ["_row", "i", "j"]).where(
        "(ring_id < ring_id2 OR ring_id = ring_id2 AND no < no2) AND xa <= xb2 AND xa2 <= xb"
        " AND least(ya, yb) <= greatest(ya2, yb2) AND least(ya2, yb2) <= greatest(ya, yb)"
    )

    def side(p: str, q: str) -> str:
        return f"signum((xb{p} - xa{p}) * (y{q} - ya{p}) - (yb{p} - ya{p}) * (x{q} - xa{p}))"

    met = near.selectExpr(
        "_row", "ring_id = ring_id2 AS own", "abs(no - no2) AS apart", "ring_id", "no", "no2",
        f"{side('', 'a2')} AS a", f"{side('', 'b2')} AS b", f"{side('2', 'a')} AS c", f"{side('2', 'b')} AS d",
        "(xa, ya) = (xa2, ya2) OR (xa, ya) = (xb2, yb2) OR (xb, yb) = (xa2, ya2) OR (xb, yb) = (xb2, yb2) AS ends_meet",
        # length of the common part of two edges on one line
        "least(xb, xb2) - greatest(xa, xa2) + least(greatest(ya, yb), greatest(ya2, yb2)) - greatest(least(ya, yb), least(ya2, yb2)) AS common",
    ).where("a * b <= 0 AND c * d <= 0")
    last = edges.groupBy("_row", "ring_id").agg(F.max("no").alias("last"))
    rule = f"""CASE WHEN a = 0 AND b = 0 AND c = 0 AND d = 0 AND common > 0 THEN if(own, '{SELF_CROSSING}', '{RINGS_CROSS}')
        WHEN a * b < 0 AND c * d < 0 THEN if(own, '{SELF_CROSSING}', '{RINGS_CROSS}')
        WHEN own AND NOT (ends_meet AND (apart = 1 OR apart = last)) THEN '{SELF_TOUCHING}' END"""
    found = met.where("own OR a * b < 0 AND c * d < 0 OR a = 0 AND b = 0 AND common > 0").join(shuffled(last), ["_row", "ring_id"])
    return found.selectExpr("_row", f"{rule} AS reason").where("reason IS NOT NULL").distinct()


def _inside(edges: DataFrame) -> DataFrame:
    """``_row, ring_id, ring_id2, part``: the share of the ring's test points inside the other ring of its feature, if any is.

    A point and an edge meet in the band of their feature that holds the point.
    """
    several = edges.groupBy("_row").agg(F.max("ring_id").alias("m")).where("m > 0").select("_row")
    own = written(edges.join(shuffled(several), "_row", "left_semi"), "rings")
    points = own.selectExpr(
        "_row", "ring_id", "no", f"xa + {PLACE}D * (xb - xa) AS x", f"ya + {PLACE}D * (yb - ya) AS y", "c"
    ).selectExpr("*", "floor(y / c) AS band")
    bands = own.where("ya <> yb").selectExpr(
        "_row", "ring_id AS ring_id2", "xa", "ya", "xb", "yb", "down", "explode(sequence(floor(least(ya, yb) / c), floor(greatest(ya, yb) / c))) AS band"
    )
    hits = points.join(shuffled(bands), ["_row", "band"]).where(
        "ring_id <> ring_id2 AND least(ya, yb) <= y AND y < greatest(ya, yb) AND xa + (y - ya) / (yb - ya) * (xb - xa) > x"
    )
    inside = hits.groupBy("_row", "ring_id", "ring_id2", "no").agg(F.sum("down").alias("turns")).where("turns <> 0")
    counts = inside.groupBy("_row", "ring_id", "ring_id2").agg(F.count(F.lit(1)).alias("k"))
    sizes = own.groupBy("_row", "ring_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(shuffled(sizes), ["_row", "ring_id"]).selectExpr("_row", "ring_id", "ring_id2", "k / n AS part")


def clean_layer(layer: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clean layer, and the quarantined rows as they were with their ``reasons``.

    A ring that lies in an odd number of others is a hole of the innermost of them, any other a shell, whatever it was
    before; holes follow their shells.  Two rings that are equal or run along each other are set apart, as are a ring
    that visits a vertex twice and a feature in which nothing has an area (NULL geometry too).  Rings that touch each
    other in single points are valid.  Rows keep their columns and may be equal.
    """
    held = written(layer.withColumn("_row", F.monotonically_increasing_id()), "layer")
    tidy = written(held.select("_row", tidy_rings("geometry").alias("geometry")), "tidy")
    edges = _edges(tidy.where(F.size("geometry") > 0))
    nested = written(_inside(edges), "nested")
    bad = (
        _crossings(edges)
        .union(nested.where("part < 1").selectExpr("_row", f"'{RINGS_CROSS}' AS reason"))
        .union(tidy.where("geometry IS NULL OR size(geometry) = 0").selectExpr("_row", f"'{NO_AREA}' AS reason"))
    )
    reasons = written(bad.groupBy("_row").agg(F.sort_array(F.collect_set("reason")).alias("reasons")), "quarantine")
    # a ring's depth is the number of rings around it; the innermost of those has one less
    depth = nested.where("part = 1").groupBy("_row", "ring_id").agg(F.count(F.lit(1)).cast("int").alias("depth"), F.collect_set("ring_id2").alias("around"))
    around = depth.select("_row", F.col("ring_id").alias("ring_id2"), F.col("depth").alias("depth2"))
    holes = depth.where("depth % 2 = 1").select("_row", "ring_id", "depth", F.explode("around").alias("ring_id2")).join(
        shuffled(around), ["_row", "ring_id2"], "left"
    ).where("coalesce(depth2, 0) = depth - 1")
    shells = holes.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("ring_id", "ring_id2"))).alias("shell_of"))
    whole = tidy.join(shuffled(reasons), "_row", "left_anti").join(shuffled(shells), "_row", "left")
    marked = F.transform("geometry", lambda r: F.struct(
        F.coalesce(F.col("shell_of")[r["ring_id"]], r["ring_id"]).alias("shell"),
        F.coalesce(F.col("shell_of")[r["ring_id"]].isNotNull(), F.lit(False)).alias("is_hole"),
        r["ring_id"].alias("ring_id"), r["pts"].alias("pts"),
    ))
    ordered = F.transform(F.array_sort(marked), lambda r, i: F.struct(i.cast("int").alias("ring_id"), r["is_hole"].alias("is_hole"), r["pts"].alias("pts")))
    good = whole.select("_row", ordered.alias("geometry"))
    columns = layer.columns
    clean = held.drop("geometry").join(shuffled(good), "_row").select(*columns)
    return clean, held.join(shuffled(reasons), "_row").select(*columns, "reasons")
