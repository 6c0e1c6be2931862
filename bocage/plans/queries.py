"""Registered queries over layers derived from whole tables, with their DuckDB SQL.

The tables carry no geometry: cells, plots, hedges and parcels are placed by their keys, one
per row, at a density that does not depend on the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import spatial_join, tables
from ..sources.layers import spread
from . import landscape as p
from . import orchards

# --- layers ---------------------------------------------------------------------------


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")).selectExpr(
        "p_partkey AS FID", "CAST(p_size AS BIGINT) AS size",
        "100D * (p_partkey % 50) AS x", "100D * floor(p_partkey / 50) AS y",
    )


def _height(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("100 * CAST(floor(max(p_partkey) / 50) + 1 AS BIGINT) AS h")


def land_cover(spark, d) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    square = [(x, y), (x + 100, y), (x + 100, y + 100), (x, y + 100)]
    hole = [(x + 30, y + 30), (x + 60, y + 30), (x + 60, y + 60), (x + 30, y + 60)]
    corner = [(x, y), (x + 100, y), (x + 100, y + 50), (x + 50, y + 50), (x + 50, y + 100), (x, y + 100)]
    shape = F.when(F.col("FID") % 4 == 0, g.polygon(corner)).when(F.col("FID") % 4 == 1, g.polygon(square, [hole]))
    return _cells(spark, d).select(
        "FID", (F.col("FID") % 7).alias("Code_n1"), ((F.col("FID") % 7) * 100 + F.col("size")).alias("Code_n3"),
        shape.otherwise(g.polygon(square)).alias("geometry"),
    )


# Some features of every layer lie far from all others, in a strip of their own: cells without
# nets, parcels or vegetation, while each row of the tables is a feature that is read and cut.
NETS_AWAY, PARCELS_AWAY, VEGETATION_AWAY = 20000.0, 40000.0, 60000.0


def _x(away: str, by: float):
    return F.col("x") - F.when(F.expr(away), by).otherwise(0.0)


def nets(spark, d) -> DataFrame:
    x, y = _x("FID % 3 = 0", NETS_AWAY), F.col("y")
    kinds = F.array(F.lit("monoparcelle"), F.lit("monorang"), F.lit("non_deploye"), F.lit(None), F.lit("monorang"))
    return _cells(spark, d).select(
        "FID", ((F.col("FID") % 7) * 100 + F.col("size")).alias("Code_n3"),
        F.get(F.array(F.lit("oui"), F.lit("non"), F.lit("mixte")), (F.col("size") % 3).cast("int")).alias("filet"),
        F.get(kinds, (F.col("size") % 5).cast("int")).alias("type_filet"),
        g.rectangle(x + 10, y + 10, x + 90, y + 90).alias("geometry"),
    )


def parcels(spark, d) -> DataFrame:
    x, y = _x("FID % 3 = 1", PARCELS_AWAY), F.col("y")
    return _cells(spark, d).select(
        F.col("FID").alias("id"), g.rectangle(x + 35, y + 5, x + 65 + (F.col("size") % 5) * 15, y + 95).alias("geometry")
    )


def organic(spark, d) -> DataFrame:
    return parcels(spark, d).select("geometry")


def _plot_rows(spark, d) -> DataFrame:
    rows = spread(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("k")))
    return rows.crossJoin(F.broadcast(_height(spark, d))).selectExpr(
        "k", "CAST(k AS STRING) AS id_plot", "(k * 1237) % 5000 + 0.25D AS x", "(k * 2111) % h + 0.25D AS y"
    )


def plot_years(spark, d) -> list[DataFrame]:
    """Three years of plots; a plot moves 10 m a year."""
    rows = _plot_rows(spark, d)
    out = []
    for n, keep in enumerate(("k % 3 <> 0", "k % 2 = 0", "true")):
        x, y = F.col("x") + 10.0 * n, F.col("y")
        out.append(rows.where(keep).select("id_plot", g.rectangle(x - 20, y - 20, x + 20, y + 20).alias("geometry")))
    return out


def plots(spark, d) -> DataFrame:
    return p.merge_plot_years(plot_years(spark, d))


def vegetation(spark, d) -> DataFrame:
    x, y = _x("size % 4 <> 0", VEGETATION_AWAY), F.col("y")
    kind = F.get(F.array(*[F.lit(k) for k in p.VEGETATION]), (F.col("FID") * 7 % 9).cast("int"))
    return _cells(spark, d).select(
        kind.alias("NATURE"), g.rectangle(x + 20, y, x + 20 + F.col("size"), y + 40).alias("geometry")
    )


def plot_info(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").selectExpr(
        "CAST(s_suppkey + 3 AS STRING) AS id_plot", "s_name AS nom", "IF(s_nationkey % 2 = 0, 'oui', 'non') AS exclu_oiseaux"
    )


def candidate_layers(spark, d) -> list[DataFrame]:
    """Plots of the year without validation, and those of the year before without exclusion."""
    new = spark.read.parquet(f"{d}/supplier.parquet").selectExpr(
        "CAST(s_suppkey AS STRING) AS id_plot", "'OUI' AS AB", "IF(s_nationkey % 3 = 0, NULL, 'NON') AS filet",
        "IF(s_suppkey % 4 = 0, 'non', NULL) AS exclu",
    )
    old = spark.read.parquet(f"{d}/customer.parquet").selectExpr(
        "concat('c', c_custkey) AS id_plot", "IF(c_nationkey % 2 = 0, 'OUI', 'NON') AS AB", "'NON' AS filet",
        "IF(c_custkey % 5 = 0, NULL, 'arrachee') AS valide_2022",
    )
    return [new, old.withColumn("exclu", F.lit(None).cast("string"))]


def hedges(spark, d) -> DataFrame:
    rows = spread(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id")))
    rows = rows.crossJoin(F.broadcast(_height(spark, d))).selectExpr(
        "id", "(id * 733) % 5000 + 0.5D AS x", "(id * 389) % h + 0.5D AS y",
        "(id % 7 - 3) * 40D AS dx", "(id % 5 - 2) * 40D + 10D AS dy",
    )
    end = (F.col("x") + F.col("dx"), F.col("y") + F.col("dy"))
    return rows.select("id", g.line([(F.col("x"), F.col("y")), end]).alias("geometry"))


# --- queries --------------------------------------------------------------------------


def _rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.withColumns(
        {c: F.round(c, digits) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"}
    )


def _orchards(spark, d) -> DataFrame:
    return p.pome_orchards(land_cover(spark, d))


def _net_orchards(spark, d) -> DataFrame:
    return p.pome_orchards(p.normalise_nets(nets(spark, d)))


def _organic(spark, d) -> DataFrame:
    return p.organic_orchards(_orchards(spark, d), organic(spark, d))


def _tables(spark, d, radii) -> list[DataFrame]:
    at, cover = plots(spark, d), land_cover(spark, d)
    return [
        p.land_cover_composition(at, cover, radii),
        p.net_composition(at, cover, p.normalise_nets(nets(spark, d)), radii),
        p.organic_share(at, _organic(spark, d), radii),
        p.hedge_length(at, hedges(spark, d), radii),
    ]


def _landscape(spark, d, r) -> DataFrame:
    return p.landscape_table(*_tables(spark, d, [r]), r)


def _columns(names: str):
    return lambda df: _rounded(df.select(*names.split()))


def queries() -> dict:
    flags = "FID aire_plot area_AB ratioABtot AB_cartobio"
    found = {
        "polygon_area": lambda s, d: _rounded(land_cover(s, d).select("FID", g.area("geometry").alias("area"))),
        "polygon_centroid": lambda s, d: _rounded(g.centroids(land_cover(s, d)).select("FID", "x", "y")),
        "line_length": lambda s, d: _rounded(hedges(s, d).select("id", g.length("geometry").alias("length"))),
        "disc_polygon": lambda s, d: _rounded(
            _plot_rows(s, d).select("id_plot", g.area(g.disc_polygon("x", "y", F.lit(500.0))).alias("area")), 2
        ),
        "merge_plot_years": lambda s, d: _rounded(plots(s, d).select("id_plot", "x", "y")),
        "normalise_nets": lambda s, d: p.normalise_nets(nets(s, d)).select("FID", "filet", "type_filet"),
        "pome_orchards": lambda s, d: _orchards(s, d).select("FID", "Code_n1", "Code_n3"),
        "organic_orchards": lambda s, d: _columns(flags)(_organic(s, d)),
        "organic_flag_all_orchards": lambda s, d: _columns("FID ratioABtot AB_cartobio")(
            p.organic_flag_all_orchards(_orchards(s, d), _organic(s, d))
        ),
        "organic_without_net": lambda s, d: _columns("FID filet ratioABtot")(
            p.organic_without_net(p.organic_orchards(_net_orchards(s, d), organic(s, d)))
        ),
        "net_composition_500": lambda s, d: _rounded(
            p.net_composition(plots(s, d), land_cover(s, d), p.normalise_nets(nets(s, d)), [500])
        ),
        "organic_share_500": lambda s, d: _rounded(p.organic_share(plots(s, d), _organic(s, d), [500])),
        "hedge_length_500": lambda s, d: _rounded(p.hedge_length(plots(s, d), hedges(s, d), [500])),
        "landscape_table_500": lambda s, d: _rounded(_landscape(s, d, 500)),
        "netted_share_500": lambda s, d: _rounded(
            p.netted_share(plots(s, d), land_cover(s, d), p.normalise_nets(nets(s, d)), [500])
        ),
        "semi_natural_share_500": lambda s, d: _rounded(p.semi_natural_share(plots(s, d), vegetation(s, d), [500])),
        "multi_radius": lambda s, d: _rounded(orchards.landscape_tables(_tables(s, d, [250, 500, 1000]), [250, 500, 1000])),
        "with_plot_info": lambda s, d: p.with_plot_info(
            _rounded(p.land_cover_composition(plots(s, d), land_cover(s, d), [500])).select("id_plot", "urbain", "prairies"),
            plot_info(s, d),
        ),
        "candidates_exclusion": lambda s, d: p.candidates(*candidate_layers(s, d)),
        "histogram_urban": lambda s, d: p.histogram(
            _rounded(p.land_cover_composition(plots(s, d), land_cover(s, d), [500])), "urbain", 5
        ),
        "orchard_crosstab": lambda s, d: _rounded(p.orchard_crosstab(nets(s, d))),
        "update_land_cover_hits": lambda s, d: p.update_land_cover_hits(land_cover(s, d), plots(s, d)),
        "join_points_in_polygons": lambda s, d: spatial_join.join_points(
            land_cover(s, d), plots(s, d), "FID", "id_plot"
        ).select("FID", "Code_n3", "id_plot"),
        "join_polygons_intersecting": lambda s, d: spatial_join.join_polygons(
            nets(s, d), parcels(s, d), "FID", "id"
        ).select("FID", "filet", "id"),
        "count_and_area": lambda s, d: _rounded(tables.count_and_sum(
            land_cover(s, d).withColumn("area", g.area("geometry")), ["Code_n3"], "area", "area"
        )),
        "row_number": lambda s, d: tables.with_row_number(
            land_cover(s, d).select("FID", "Code_n3"), ["Code_n3", "FID"], "no"
        ),
        "layer_totals": lambda s, d: _rounded(tables.count_and_sum(
            hedges(s, d).withColumn("length", g.length("geometry")), [], "length", "length", "n"
        )),
        "layer_profile": lambda s, d: _rounded(p.layer_profile(land_cover(s, d), hedges(s, d))),
        "landscape_correlations": lambda s, d: _rounded(
            p.pearson_test(p.land_cover_composition(plots(s, d), land_cover(s, d), [500]), "urbain", "prairies"), 6
        ),
    }
    for r in (250, 500, 1000):
        found[f"land_cover_composition_{r}"] = lambda s, d, r=r: _rounded(
            p.land_cover_composition(plots(s, d), land_cover(s, d), [r])
        )
    return found


# --- the same in SQL ------------------------------------------------------------------

# Horizontal edges (w = 1: the polygon lies below) are all that areas of these layers need.
_LAYERS = f"""
h AS (SELECT 100 * (CAST(floor(max(p_partkey) / 50) AS BIGINT) + 1) AS h FROM part),
cells AS (SELECT p_partkey AS FID, p_size AS size, 100.0::DOUBLE * (p_partkey % 50) AS x,
  100.0::DOUBLE * (p_partkey // 50) AS y, p_partkey % 7 AS c1, (p_partkey % 7) * 100 + p_size AS c3 FROM part),
rel(shape, a, b, v, w) AS (VALUES (0, 0, 100, 0, -1), (0, 50, 100, 50, 1), (0, 0, 50, 100, 1),
  (1, 0, 100, 0, -1), (1, 0, 100, 100, 1), (1, 30, 60, 30, 1), (1, 30, 60, 60, -1),
  (2, 0, 100, 0, -1), (2, 0, 100, 100, 1)),
edges AS (SELECT FID, c1, c3, size, x + a AS a, x + b AS b, y + v AS v, w FROM cells JOIN rel ON shape = least(FID % 4, 2)),
nets AS (SELECT FID, c3, size, CASE size % 3 WHEN 0 THEN 'oui' WHEN 1 THEN 'non' ELSE 'mixte' END AS filet,
  CASE WHEN size % 3 = 1 THEN 'absent' ELSE CASE size % 5 WHEN 0 THEN 'monoparcelle' WHEN 1 THEN 'monorang'
  WHEN 2 THEN 'non_deploye' WHEN 4 THEN 'monorang' END END AS type_filet,
  x - CASE WHEN FID % 3 = 0 THEN {NETS_AWAY} ELSE 0 END AS nx, x AS cx FROM cells),
rows_ AS (SELECT s_suppkey AS k, CAST(s_suppkey AS VARCHAR) AS id_plot, (s_suppkey * 1237) % 5000 + 0.25::DOUBLE AS x,
  (s_suppkey * 2111) % h + 0.25::DOUBLE AS y FROM supplier, h),
plots AS (SELECT id_plot, x + CASE WHEN k % 3 <> 0 THEN 0 WHEN k % 2 = 0 THEN 10 ELSE 20 END AS x, y FROM rows_),
hedges AS (SELECT c_custkey AS id, (c_custkey * 733) % 5000 + 0.5::DOUBLE AS x, (c_custkey * 389) % h + 0.5::DOUBLE AS y,
  (c_custkey % 7 - 3) * 40.0::DOUBLE AS dx, (c_custkey % 5 - 2) * 40.0::DOUBLE + 10 AS dy FROM customer, h),
areas AS (SELECT FID, CASE FID % 4 WHEN 0 THEN 7500.0 WHEN 1 THEN 9100.0 ELSE 10000.0 END::DOUBLE AS aire FROM cells)
"""


def _clip(name: str, edges: str, by: str, r: int) -> str:
    """Area of horizontal-edge polygons per plot and ``by`` in the 200-gon of radius r."""
    return f"""
{name}_near AS (SELECT id_plot, {by}, greatest(e.a - x, -{r}) AS a, least(e.b - x, {r}) AS b, e.v - y AS v, w
  FROM plots JOIN {edges} e ON e.a < x + {r} AND e.b > x - {r}),
{name}_side AS (SELECT {r} * cos((i + 1) * pi() / 100) AS s0, {r} * cos(i * pi() / 100) AS s1,
  {r} * sin((i + 1) * pi() / 100) AS h0, {r} * sin(i * pi() / 100) AS h1 FROM range(100) t(i)),
{name}_part AS (SELECT id_plot, {by}, w * sign(v) AS w, abs(v) AS c, greatest(a, s0) AS p, least(b, s1) AS q,
  h0 + (greatest(a, s0) - s0) / (s1 - s0) * (h1 - h0) AS hp, h0 + (least(b, s1) - s0) / (s1 - s0) * (h1 - h0) AS hq
  FROM {name}_near JOIN {name}_side ON a < s1 AND b > s0),
{name} AS (SELECT * FROM (SELECT id_plot, {by}, sum(w * (q - p) * CASE
    WHEN hp >= c AND hq >= c THEN c WHEN hp <= c AND hq <= c THEN (hp + hq) / 2
    ELSE (abs(hp - c) * (least(hp, c) + c) + abs(hq - c) * (least(hq, c) + c)) / (abs(hp - c) + abs(hq - c)) / 2 END) AS area
  FROM {name}_part GROUP BY ALL) WHERE area > 1e-6)"""


def _composition(r: int) -> str:
    cells = ", ".join(f"sum(CASE WHEN c1 = {k} THEN area END) AS {v}" for k, v in p.LAND_COVER.items())
    shares = ", ".join(
        f"round(coalesce({v} / tot * 100, 0), 3) AS {v}" for v in p.LAND_COVER.values() if v != "vergers"
    )
    return f"""{_clip("lc", "edges", "c1", r)},
comp AS (SELECT id_plot, {r}.0::DOUBLE AS r, round(tot, 3) AS area_tot_buffer, {shares}
  FROM (SELECT id_plot, sum(area) AS tot, {cells} FROM lc GROUP BY id_plot))"""


_ORGANIC = f"""
org AS (SELECT x + 35 AS x0, y + 5 AS y0, x + 65 + (size % 5) * 15 AS x1, y + 95 AS y1
  FROM (SELECT * REPLACE (x - CASE WHEN FID % 3 = 1 THEN {PARCELS_AWAY} ELSE 0 END AS x) FROM cells)),
cut(shape, a0, b0, a1, b1) AS (VALUES (0, 50, 50, 100, 100), (1, 30, 30, 60, 60)),
base AS (SELECT FID, c3, size, x, y, FID % 4 AS shape FROM cells WHERE CAST(c3 AS VARCHAR) LIKE '13%'),
lap AS (SELECT b.FID, sum(greatest(least(x1, x + 100) - greatest(x0, x), 0) * greatest(least(y1, y + 100) - greatest(y0, y), 0)
   - CASE WHEN a0 IS NULL THEN 0 ELSE greatest(least(x1, x + a1) - greatest(x0, x + a0), 0)
     * greatest(least(y1, y + b1) - greatest(y0, y + b0), 0) END) AS area_AB
  FROM base b LEFT JOIN cut USING (shape), org WHERE x0 < x + 100 AND x1 > x AND y0 < y + 100 AND y1 > y GROUP BY b.FID),
bio AS (SELECT FID, aire AS aire_plot, area_AB, area_AB / aire * 100 AS ratioABtot, 1 AS AB_cartobio
  FROM lap JOIN areas USING (FID) WHERE area_AB / aire * 100 > 50)"""

def _hedges(r: int) -> str:
    return f"""
near_h AS (SELECT id_plot, id, a.x - p.x AS sx, a.y - p.y AS sy, dx, dy FROM plots p JOIN hedges a
  ON a.x < p.x + {r + 200} AND a.x > p.x - {r + 200} AND a.y < p.y + {r + 200} AND a.y > p.y - {r + 200}),
planes AS (SELECT cos((i + 0.5) * pi() / 100) AS nx, sin((i + 0.5) * pi() / 100) AS ny, {r} * cos(pi() / 200) AS d FROM range(200) t(i)),
clipped AS (SELECT id_plot, id, sqrt(dx * dx + dy * dy) AS len,
   greatest(0, max(CASE WHEN nx * dx + ny * dy < 0 THEN (d - nx * sx - ny * sy) / (nx * dx + ny * dy) END)) AS t0,
   least(1, min(CASE WHEN nx * dx + ny * dy > 0 THEN (d - nx * sx - ny * sy) / (nx * dx + ny * dy) END)) AS t1
  FROM near_h, planes GROUP BY id_plot, id, sx, sy, dx, dy),
hedge AS (SELECT id_plot, count(*) AS nb_haies, sum(len * (t1 - t0)) AS length_haies FROM clipped
  WHERE len * (t1 - t0) > 1e-6 GROUP BY id_plot)"""


def _nets(r: int) -> str:
    kinds = [*p.NET_TYPES, "inconnu"]
    disc = f"({p.NOMINAL_DISC} * {r} * {r}) * 100"
    sums = ", ".join(
        f"coalesce(sum(CASE WHEN type_filet {'IS NULL' if k == 'inconnu' else f'= {k!r}'} THEN area END), 0) AS {k}" for k in kinds
    )
    return f"""
held AS (SELECT e.FID, type_filet, a, b, v, w FROM edges e JOIN nets n ON n.FID = e.FID AND nx = cx
  WHERE CAST(n.c3 AS VARCHAR) LIKE '1%' AND e.FID % 4 <> 1),
{_clip("na", "held", "type_filet", r)},
net AS (SELECT id_plot, {r}.0::DOUBLE AS r, round(tot, 3) AS tot_vergers,
  {", ".join(f"round({k} / tot * 100, 3) AS {k}_vergers" for k in p.NET_TYPES)},
  {", ".join(f"round({k} / {disc}, 3) AS {k}" for k in kinds)},
  round({" + ".join(f"{k} / {disc}" for k in kinds)}, 3) AS pourcent_vergers
  FROM (SELECT id_plot, sum(area) AS tot, {sums} FROM na GROUP BY id_plot))"""


def _share(r: int) -> str:
    return f"""
own AS (SELECT e.FID, a, b, v, w, 1 AS one FROM edges e JOIN bio USING (FID)),
{_clip("oa", "own", "one", r)},
share AS (SELECT id_plot, {r}.0::DOUBLE AS r, round(coalesce(area, 0) / ({p.NOMINAL_DISC} * {r} * {r}) * 100, 3) AS percent_verger_bio
  FROM plots LEFT JOIN oa USING (id_plot))"""


def oracle_sql() -> dict[str, str]:
    def sql(select: str, *more: str) -> str:
        return f"WITH {', '.join([_LAYERS, *more])} {select}"

    nets_of_bio = _ORGANIC.replace("base AS (SELECT FID, c3, size, x, y, FID % 4 AS shape FROM cells WHERE", """
base AS (SELECT FID, c3, size, x + 10 AS x, y + 10 AS y, 9 AS shape
  FROM (SELECT cells.* REPLACE (nx AS x) FROM cells JOIN nets USING (FID)) WHERE""").replace(
        "x + 100", "x + 80").replace("y + 100", "y + 80").replace("areas USING (FID)", "(SELECT FID, 6400.0::DOUBLE AS aire FROM cells) USING (FID)")
    kinds = [*p.NET_TYPES, "inconnu"]

    def landscape(r: int) -> str:
        columns = [
            "area_tot_buffer", *[v for v in p.LAND_COVER.values() if v != "vergers"], "tot_vergers",
            *[f"{k}_vergers" for k in p.NET_TYPES], *kinds, "pourcent_vergers", "percent_verger_bio", "nb_haies", "length_haies",
        ]
        return sql(
            f"""SELECT id_plot, {", ".join(f"{c} AS {c}_buffer_{r}" for c in columns)}
            FROM (SELECT * EXCLUDE (r) FROM comp) LEFT JOIN (SELECT * EXCLUDE (r) FROM net) USING (id_plot)
            LEFT JOIN (SELECT id_plot, percent_verger_bio FROM share JOIN net USING (id_plot)) USING (id_plot)
            LEFT JOIN (SELECT id_plot, nb_haies, round(length_haies, 3) AS length_haies FROM hedge JOIN net USING (id_plot)) USING (id_plot)""",
            _composition(r), _nets(r), _ORGANIC, _share(r), _hedges(r),
        )

    nominal = f"({p.NOMINAL_DISC} * 500 * 500) * 100"
    held = """netted AS (SELECT e.FID, a, b, v, w, 1 AS one FROM edges e JOIN nets n ON n.FID = e.FID AND nx = cx
        WHERE CAST(n.c3 AS VARCHAR) LIKE '1%' AND filet IN ('oui', 'mixte'))"""
    natures = ", ".join(f"({i}, '{c}')" for i, c in enumerate(p.VEGETATION.values()))
    green = f"""kinds(k, nature) AS (VALUES {natures}),
        veg AS (SELECT nature, x + 20 - away AS a, x + 20 + size - away AS b, y + up AS v, w
        FROM (SELECT *, CASE WHEN size % 4 = 0 THEN 0 ELSE {VEGETATION_AWAY} END AS away FROM cells) JOIN kinds ON k = FID * 7 % 9,
        (VALUES (0, -1), (40, 1)) t(up, w))"""
    parts = [f"coalesce(sum(CASE WHEN nature = '{c}' THEN area END), 0) / {nominal}" for c in p.SEMI_NATURAL]
    cross = ", ".join(
        f"count(CASE WHEN type_filet {(c := 'IS NULL' if k == 'inconnu' else f'= {k!r}')} THEN 1 END) AS n_{k}, "
        f"6400.0::DOUBLE * count(CASE WHEN type_filet {c} THEN 1 END) AS area_{k}"
        for k in kinds
    )
    found = {
        "polygon_area": sql("SELECT FID, aire AS area FROM areas"),
        "polygon_centroid": sql("""SELECT FID,
            round(x + CASE FID % 4 WHEN 0 THEN 125.0 / 3 WHEN 1 THEN (500000 - 900 * 45) / 9100.0 ELSE 50 END, 3) AS x,
            round(y + CASE FID % 4 WHEN 0 THEN 125.0 / 3 WHEN 1 THEN (500000 - 900 * 45) / 9100.0 ELSE 50 END, 3) AS y FROM cells"""),
        "line_length": sql("SELECT id, round(sqrt(dx * dx + dy * dy), 3) AS length FROM hedges"),
        "disc_polygon": sql("SELECT id_plot, round(100 * sin(pi() / 100) * 250000, 2) AS area FROM rows_"),
        "merge_plot_years": sql("SELECT id_plot, round(x, 3) AS x, round(y, 3) AS y FROM plots"),
        "normalise_nets": sql("SELECT FID, filet, type_filet FROM nets"),
        "pome_orchards": sql("SELECT FID, c1 AS Code_n1, c3 AS Code_n3 FROM cells WHERE CAST(c3 AS VARCHAR) LIKE '13%'"),
        "organic_orchards": sql(
            "SELECT FID, aire_plot, round(area_AB, 3) AS area_AB, round(ratioABtot, 3) AS ratioABtot, AB_cartobio FROM bio", _ORGANIC
        ),
        "organic_flag_all_orchards": sql(
            "SELECT FID, round(coalesce(ratioABtot, 0), 3) AS ratioABtot, coalesce(AB_cartobio, 0) AS AB_cartobio FROM base LEFT JOIN bio USING (FID)",
            _ORGANIC,
        ),
        "organic_without_net": sql(
            "SELECT FID, filet, round(ratioABtot, 3) AS ratioABtot FROM bio JOIN nets USING (FID) WHERE filet = 'non'", nets_of_bio
        ),
        "net_composition_500": sql("SELECT * FROM net", _nets(500)),
        "organic_share_500": sql("SELECT * FROM share", _ORGANIC, _share(500)),
        "hedge_length_500": sql(
            "SELECT id_plot, 500.0::DOUBLE AS r, nb_haies, round(length_haies, 3) AS length_haies FROM plots LEFT JOIN hedge USING (id_plot)",
            _hedges(500),
        ),
        "landscape_table_500": landscape(500),
        "netted_share_500": sql(
            f"""SELECT id_plot, 500.0::DOUBLE AS r, round(vergers, 3) AS vergers, round(f, 3) AS area_filets,
            round(f / {nominal}, 3) AS percent_verger_filet,
            round(CASE WHEN f = 0 AND vergers = 0 THEN 0 WHEN vergers <> 0 THEN f / vergers * 100 END, 3) AS percent_of_orchards_with_nets
            FROM (SELECT id_plot, coalesce(any_value(na.area), 0) AS f, coalesce(sum(CASE WHEN c1 = 1 THEN lc.area END), 0) AS vergers
            FROM lc LEFT JOIN na USING (id_plot) GROUP BY id_plot)""",
            _clip("lc", "edges", "c1", 500), held, _clip("na", "netted", "one", 500),
        ),
        "semi_natural_share_500": sql(
            f"""SELECT id_plot, 500.0::DOUBLE AS r, {", ".join(f"round({x}, 3) AS percent_{c}" for c, x in zip(p.SEMI_NATURAL, parts))},
            round({" + ".join(parts)}, 3) AS "percent_ESN" FROM va GROUP BY id_plot""",
            green, _clip("va", "veg", "nature", 500),
        ),
        "multi_radius": f"""SELECT * FROM ({landscape(250)}) JOIN ({landscape(500)}) USING (id_plot) JOIN ({landscape(1000)}) USING (id_plot)""",
        "with_plot_info": sql(
            """SELECT CAST(s_suppkey + 3 AS VARCHAR) AS id_plot, urbain, prairies, s_name AS nom, 'oui' AS exclu_oiseaux
            FROM supplier LEFT JOIN comp ON id_plot = CAST(s_suppkey + 3 AS VARCHAR) WHERE s_nationkey % 2 = 0""",
            _composition(500),
        ),
        "candidates_exclusion": """SELECT CAST(s_suppkey AS VARCHAR) AS id_plot, 'OUI' AS AB, CASE WHEN s_nationkey % 3 <> 0 THEN 'NON' END AS filet,
            CASE WHEN s_nationkey % 3 = 0 THEN 'oui' WHEN s_suppkey % 4 = 0 THEN 'non' ELSE 'Oiseaux' END AS exclu, 'ok' AS valide_2022 FROM supplier
            UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'OUI' ELSE 'NON' END, 'NON', 'Oiseaux',
            CASE WHEN c_custkey % 5 = 0 THEN 'ok' ELSE 'arrachee' END FROM customer""",
        "histogram_urban": sql(
            "SELECT CAST(ceil((urbain - 2.5) / 5) * 5 AS DOUBLE) AS middle, count(*) AS n FROM comp GROUP BY 1", _composition(500)
        ),
        "orchard_crosstab": sql(f"SELECT c3 AS Code_n3, {cross} FROM nets GROUP BY c3"),
        "update_land_cover_hits": sql("""SELECT FID, id_plot, c1 AS Code_n1, c3 AS Code_n3 FROM plots p JOIN cells c
            ON p.x BETWEEN c.x AND c.x + 100 AND p.y BETWEEN c.y AND c.y + 100 WHERE NOT (FID % 4 = 0 AND p.x > c.x + 50 AND p.y > c.y + 50)
            AND NOT (FID % 4 = 1 AND p.x > c.x + 30 AND p.x < c.x + 60 AND p.y > c.y + 30 AND p.y < c.y + 60)"""),
        "join_points_in_polygons": sql("""SELECT c.FID, c3 AS Code_n3, id_plot FROM cells c LEFT JOIN plots p
            ON p.x BETWEEN c.x AND c.x + 100 AND p.y BETWEEN c.y AND c.y + 100 AND NOT (FID % 4 = 0 AND p.x > c.x + 50 AND p.y > c.y + 50)
            AND NOT (FID % 4 = 1 AND p.x > c.x + 30 AND p.x < c.x + 60 AND p.y > c.y + 30 AND p.y < c.y + 60)"""),
        "join_polygons_intersecting": sql("""SELECT n.FID, filet, o.FID AS id FROM nets n JOIN cells c ON c.FID = n.FID
            LEFT JOIN (SELECT * REPLACE (x - CASE WHEN FID % 3 = 1 THEN 40000 ELSE 0 END AS x) FROM cells) o
            ON o.x + 35 <= nx + 90 AND o.x + 65 + (o.size % 5) * 15 >= nx + 10
            AND o.y + 5 <= c.y + 90 AND o.y + 95 >= c.y + 10"""),
        "count_and_area": sql("SELECT c3 AS Code_n3, count(*) AS poly_n, sum(aire) AS area FROM cells JOIN areas USING (FID) GROUP BY c3"),
        "row_number": sql("SELECT FID, c3 AS Code_n3, row_number() OVER (ORDER BY c3, FID) AS no FROM cells"),
        "layer_totals": sql("SELECT count(*) AS n, round(sum(sqrt(dx * dx + dy * dy)), 3) AS length FROM hedges"),
        "layer_profile": sql("""SELECT 'class ' || c1 AS what, CAST(count(*) AS DOUBLE) AS value FROM cells GROUP BY c1
            UNION ALL SELECT 'hedge km', round(sum(sqrt(dx * dx + dy * dy)) / 1000, 3) FROM hedges"""),
        "landscape_correlations": sql(
            """SELECT n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t, n - 2 AS df,
            round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS ci_high
            FROM (SELECT count(*) AS n, corr(u, v) AS r FROM (SELECT id_plot,
              coalesce(sum(CASE WHEN c1 = 2 THEN area END), 0) / sum(area) * 100 AS u,
              coalesce(sum(CASE WHEN c1 = 5 THEN area END), 0) / sum(area) * 100 AS v FROM lc GROUP BY id_plot))""",
            _clip("lc", "edges", "c1", 500),
        ),
    }
    for r in (250, 500, 1000):
        found[f"land_cover_composition_{r}"] = sql("SELECT * FROM comp", _composition(r))
    return found
