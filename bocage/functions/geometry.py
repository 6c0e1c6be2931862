"""Geometry as plain Spark columns.

A geometry is ``array<struct<ring_id int, is_hole boolean, pts array<struct<x,y>>>>``.
Polygons have closed rings, lines have open ones, a point is one ring of one vertex.
Everything here is a row-local expression: no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEOMETRY_TYPE = (
    "array<struct<ring_id:int,is_hole:boolean,pts:array<struct<x:double,y:double>>>>"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- building -------------------------------------------------------------------------


def point_struct(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def ring(points: list[Column], ring_id: int = 0, is_hole: bool = False) -> Column:
    """One ring from a list of ``point_struct`` columns."""
    return F.struct(
        F.lit(ring_id).alias("ring_id"),
        F.lit(is_hole).alias("is_hole"),
        F.array(*points).alias("pts"),
    )


def polygon(corners: list[tuple], holes: list[list[tuple]] = ()) -> Column:
    """Polygon from (x, y) column pairs; rings are closed here."""
    rings = []
    for i, pts in enumerate([corners, *holes]):
        structs = [point_struct(x, y) for x, y in pts]
        rings.append(ring([*structs, structs[0]], i, i > 0))
    return F.array(*rings)


def rectangle(x0, y0, x1, y1) -> Column:
    return polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def line(points: list[tuple]) -> Column:
    return F.array(ring([point_struct(x, y) for x, y in points]))


def disc_polygon(x, y, radius, quadrant_segments: int = 50) -> Column:
    """Disc as an inscribed polygon with ``4 * quadrant_segments`` sides."""
    n = 4 * quadrant_segments
    x, y, radius = _col(x), _col(y), _col(radius)
    step = F.lit(2.0) * F.pi() / F.lit(float(n))
    # the last vertex repeats the first one exactly, hence the modulo
    pts = F.transform(
        F.sequence(F.lit(0), F.lit(n)),
        lambda i: F.struct(
            (x + radius * F.cos((i % n) * step)).alias("x"),
            (y + radius * F.sin((i % n) * step)).alias("y"),
        ),
    )
    return F.array(
        F.struct(F.lit(0).alias("ring_id"), F.lit(False).alias("is_hole"), pts.alias("pts"))
    )


# --- WKT ------------------------------------------------------------------------------


def from_wkt(wkt) -> Column:
    """Parse POINT, LINESTRING, POLYGON and their MULTI forms with built-in functions."""
    text = F.regexp_replace(F.upper(F.trim(_col(wkt))), r"^SRID=\d+;\s*", "")
    body = F.regexp_replace(text, r"^[A-Z ]+", "")
    closed = text.rlike(r"^(MULTI)?POLYGON")
    # bring every kind to the depth of a MULTIPOLYGON: "(((ring),(ring)),((ring)))"
    depth = (
        F.when(text.startswith("MULTIPOLYGON"), body)
        .when(text.startswith("POLYGON"), F.concat(F.lit("("), body, F.lit(")")))
        .when(
            text.startswith("MULTILINESTRING"),
            # every line is a part of its own, so that none is taken for a hole
            F.concat(F.lit("("), F.regexp_replace(body, r"\)\s*,\s*\(", ")),(("), F.lit(")")),
        )
        .when(
            text.startswith("MULTIPOINT"),
            F.concat(
                F.lit("((("),
                F.regexp_replace(F.regexp_replace(body, r"[()]", ""), r"\s*,\s*", ")),(("),
                F.lit(")))"),
            ),
        )
        .otherwise(F.concat(F.lit("(("), body, F.lit("))")))
    )
    parts = F.split(depth, r"\)\s*\)\s*,\s*\(\s*\(")

    def parse_part(part):
        return F.transform(
            F.split(part, r"\)\s*,\s*\("),
            lambda txt, i: F.struct(
                i.cast("int").alias("ring_id"),
                (i > 0).alias("is_hole"),
                F.transform(
                    F.split(F.trim(F.regexp_replace(txt, r"[()]", "")), r"\s*,\s*"),
                    lambda p: F.struct(
                        F.split(p, r"\s+")[0].try_cast("double").alias("x"),
                        F.split(p, r"\s+")[1].try_cast("double").alias("y"),
                    ),
                ).alias("pts"),
            ),
        )

    rings = F.flatten(F.transform(parts, parse_part))
    numbered = F.transform(
        rings,
        lambda r, i: F.struct(
            i.cast("int").alias("ring_id"),
            r["is_hole"].alias("is_hole"),
            # a polygon's ring ends where it began
            F.when(
                closed & (F.element_at(r["pts"], 1) != F.element_at(r["pts"], -1)),
                F.concat(r["pts"], F.slice(r["pts"], 1, 1)),
            ).otherwise(r["pts"]).alias("pts"),
        ),
    )
    known = text.rlike(r"^(MULTI)?(POINT|LINESTRING|POLYGON)\s*(Z|M|ZM)?\s*\(")
    whole = F.forall(
        numbered, lambda r: F.forall(r["pts"], lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    )
    return F.when(known & whole, numbered)


def to_wkt(geometry, kind: str = "polygon") -> Column:
    """WKT text: ``polygon`` gives POLYGON/MULTIPOLYGON, ``line`` LINESTRING/MULTILINESTRING."""
    geometry = _col(geometry)

    def ring_text(r):
        return F.concat(
            F.lit("("),
            F.concat_ws(
                ", ",
                F.transform(
                    r["pts"],
                    lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")),
                ),
            ),
            F.lit(")"),
        )

    if kind == "line":
        texts = F.concat_ws(", ", F.transform(geometry, ring_text))
        return F.when(F.size(geometry) == 1, F.concat(F.lit("LINESTRING "), texts)).otherwise(
            F.concat(F.lit("MULTILINESTRING ("), texts, F.lit(")"))
        )
    # a hole continues the part before it, an outer ring opens a new part
    body = F.concat_ws(
        "",
        F.transform(
            geometry,
            lambda r, i: F.concat(
                F.when(i == 0, F.lit("("))
                .when(r["is_hole"], F.lit(", "))
                .otherwise(F.lit("), (")),
                ring_text(r),
            ),
        ),
    )
    n_outer = F.size(F.filter(geometry, lambda r: ~r["is_hole"]))
    text = F.when(n_outer > 1, F.concat(F.lit("MULTIPOLYGON ("), body, F.lit("))"))).otherwise(
        F.concat(F.lit("POLYGON "), body, F.lit(")"))
    )
    return F.when(geometry.isNotNull(), text)


# --- edges ----------------------------------------------------------------------------


def ring_edges(pts: Column) -> Column:
    """Consecutive vertex pairs of one ring or line."""
    n = F.greatest(F.size(pts) - 1, F.lit(0))
    return F.zip_with(
        F.slice(pts, F.lit(1), n),
        F.slice(pts, F.lit(2), n),
        lambda a, b: F.struct(
            a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")
        ),
    )


def signed_ring_area(pts: Column) -> Column:
    """Shoelace around the first vertex, so that large coordinates do not cost digits."""
    ox, oy = F.get(pts, F.lit(0))["x"], F.get(pts, F.lit(0))["y"]
    return F.aggregate(
        ring_edges(pts),
        F.lit(0.0),
        lambda acc, e: acc
        + ((e["x0"] - ox) * (e["y1"] - oy) - (e["x1"] - ox) * (e["y0"] - oy)) / 2.0,
    )


def orient(geometry) -> Column:
    """Outer rings counter-clockwise, holes clockwise."""
    return F.transform(
        _col(geometry),
        lambda r: F.struct(
            r["ring_id"].alias("ring_id"),
            r["is_hole"].alias("is_hole"),
            F.when((signed_ring_area(r["pts"]) < 0) != r["is_hole"], F.reverse(r["pts"]))
            .otherwise(r["pts"])
            .alias("pts"),
        ),
    )


def edges(geometry) -> Column:
    """All edges of all rings, as they are stored."""
    return F.flatten(F.transform(_col(geometry), lambda r: ring_edges(r["pts"])))


def oriented_edges(geometry) -> Column:
    """Edges such that signed sums subtract holes and add parts."""
    return edges(orient(geometry))


def x_max(geometry) -> Column:
    return F.array_max(
        F.transform(_col(geometry), lambda r: F.array_max(F.transform(r["pts"], lambda p: p["x"])))
    )


# --- measures -------------------------------------------------------------------------


def area(geometry) -> Column:
    """Planar area in square metres: outer rings minus holes, whatever their direction."""
    return F.aggregate(
        _col(geometry),
        F.lit(0.0),
        lambda acc, r: acc
        + F.abs(signed_ring_area(r["pts"])) * F.when(r["is_hole"], -1.0).otherwise(1.0),
    )


def length(geometry) -> Column:
    """Planar length in metres of all parts."""
    return F.aggregate(
        edges(geometry),
        F.lit(0.0),
        lambda acc, e: acc + F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]),
    )


def centroid(geometry) -> Column:
    """struct<x, y>: area-weighted centre; a geometry without area gives its first vertex."""
    geometry = _col(geometry)
    first = F.get(F.get(geometry, F.lit(0))["pts"], F.lit(0))
    ox, oy = first["x"], first["y"]

    def add(acc, e):
        x0, y0, x1, y1 = e["x0"] - ox, e["y0"] - oy, e["x1"] - ox, e["y1"] - oy
        cross = x0 * y1 - x1 * y0
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["mx"] + (x0 + x1) * cross).alias("mx"),
            (acc["my"] + (y0 + y1) * cross).alias("my"),
        )

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        oriented_edges(geometry),
        zero,
        add,
        lambda m: F.struct(
            (ox + F.coalesce(F.try_divide(m["mx"], 3.0 * m["a"]), F.lit(0.0))).alias("x"),
            (oy + F.coalesce(F.try_divide(m["my"], 3.0 * m["a"]), F.lit(0.0))).alias("y"),
        ),
    )


def centroids(layer: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Point layer: attributes kept, geometry replaced by the columns ``x`` and ``y``."""
    keep = [c for c in layer.columns if c not in (geometry, "x", "y")]
    points = layer.select(*keep, centroid(geometry).alias("_c")).select(
        *keep, F.col("_c.x").alias("x"), F.col("_c.y").alias("y")
    )
    srid = srid_of(layer)
    return points if srid is None else set_srid(points, srid)


def drop_geometry(layer: DataFrame, geometry: str = "geometry") -> DataFrame:
    return layer.drop(geometry)


# --- coordinate reference system ------------------------------------------------------


def set_srid(layer: DataFrame, srid: int) -> DataFrame:
    """Label the coordinates; their values are not touched."""
    for name in ("geometry", "x", "y"):
        if name in layer.columns:
            layer = layer.withMetadata(name, {"srid": srid})
    return layer


def srid_of(layer: DataFrame) -> int | None:
    for name in ("geometry", "x"):
        if name in layer.columns:
            return layer.schema[name].metadata.get("srid")
    return None
