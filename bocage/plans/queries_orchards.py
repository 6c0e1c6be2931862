"""Registered queries over every orchard as a target, candidate points, cleaned layers and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import projection as pr
from ..operators import stats, tables
from ..operators.cleaning import clean_layer
from ..operators.shared import written
from ..sources.layers import spread
from . import landscape as p
from . import orchards as o
from . import queries as q
from . import selection as s_

RADIUS = 500
SHARES = [*o.SHARES.values(), "percent_verger_bio", "percent_verger_filet", "percent_of_orchards_with_nets"]
GREEN = [*[f"percent_{c}" for c in p.SEMI_NATURAL], "percent_ESN"]

# --- layers ---------------------------------------------------------------------------


def faulty_layer(spark, d):
    """Every cell with one of eight shapes: sound, crossing itself, with a spike, an empty ring, a hole outside, a hole
    as a part, repeated vertices, and two parts that cross."""
    x, y = F.col("x"), F.col("y")
    at = lambda *pts: [(x + a, y + b) for a, b in pts]
    square = at((0, 0), (90, 0), (90, 90), (0, 90))

    def parts(*rings):
        return F.array(*[g.ring([g.point_struct(*c) for c in [*r, r[0]]], i) for i, r in enumerate(rings)])

    shapes = [
        g.polygon(square),
        g.polygon(at((0, 0), (90, 90), (90, 0), (0, 90))),
        g.polygon(at((0, 0), (90, 0), (90, 40), (97, 40), (90, 40), (90, 90), (0, 90))),
        g.polygon(square, [at((20, 20), (50, 50), (20, 20))]),
        g.polygon(square, [at((92, 10), (98, 10), (98, 20), (92, 20))]),
        parts(square, at((20, 20), (50, 20), (50, 60), (20, 60))),
        g.polygon(at((0, 0), (0, 0), (90, 0), (90, 90), (90, 90), (0, 90), (0, 90))),
        parts(square, at((50, 50), (99, 50), (99, 99), (50, 99))),
    ]
    shape = F.when(F.lit(False), shapes[0])
    for k, s in enumerate(shapes):
        shape = shape.when(F.col("FID") % 8 == k, s)
    return q._cells(spark, d).select("FID", shape.alias("geometry"))


def cleaned(spark, d):
    clean, apart = clean_layer(faulty_layer(spark, d))
    holes = F.size(F.filter("geometry", lambda r: r["is_hole"]))
    kept = clean.select("FID", F.lit("").alias("reason"), F.size("geometry").alias("n_rings"), holes.alias("n_holes"), g.area("geometry").alias("area"))
    none = F.lit(None)
    out = apart.select("FID", F.array_join("reasons", ", ").alias("reason"), none.cast("int").alias("n_rings"), none.cast("int").alias("n_holes"), none.cast("double").alias("area"))
    return q._rounded(kept.unionByName(out))


def _points(spark, d):
    """Points of candidates all over the layer, one per customer."""
    rows = spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey")).crossJoin(F.broadcast(q._height(spark, d)))
    return rows.selectExpr(
        "concat('c', c_custkey) AS id_plot", "IF(c_nationkey % 3 = 0, NULL, 'NON') AS filet", "IF(c_custkey % 4 = 0, NULL, 'oui') AS exclu",
        "IF(c_custkey % 5 = 0, 'binome_arrachee', 'ok') AS valide_2022", "(c_custkey * 733) % 5000 + 0.5D AS x", "(c_custkey * 389) % h + 0.5D AS y",
    )


def _orchards(spark, d):
    """Orchards by the code of their net-layer feature, with their organic ratio, and those that are organic."""
    own = written(o.pome_orchards_by_net(q.land_cover(spark, d), q.nets(spark, d)), "orchards")
    found = written(p.organic_orchards(own, q.organic(spark, d)), "organic")
    return written(p.organic_flag_all_orchards(own, found), "flagged"), found


def landscape(spark, d):
    every, bio = _orchards(spark, d)
    return o.orchard_landscape_table(every, bio, q.land_cover(spark, d), q.nets(spark, d), q.vegetation(spark, d), RADIUS)


def tagged(spark, d):
    return o.tag_orchards(landscape(spark, d), _points(spark, d))


def _gps(spark, d):
    """A sheet of GPS points in degrees, of which some were not approved."""
    return spark.read.parquet(f"{d}/customer.parquet").selectExpr(
        "c_custkey AS row", "5 + (c_custkey % 1000) / 10000D AS lon", "43.9D + (c_custkey % 777) / 10000D AS lat",
        "IF(c_nationkey % 4 = 0, 'non', 'oui') AS coord_ok",
    )


def _plots_with_info(spark, d):
    """Plots of the year before with the attributes of a sheet that lacks some of them."""
    info = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 7 <> 3").selectExpr(
        "s_suppkey AS id_parcelle", "IF(s_nationkey % 2 = 0, 'OUI', 'NON') AS AB", "IF(s_suppkey % 3 = 0, 'OUI', 'NON') AS filet",
        "IF(s_suppkey % 5 = 0, 'oui', 'non') AS exclu", "IF(s_suppkey % 4 = 0, 'binome_arrachee', 'ok') AS valide_2022",
        "IF(s_nationkey % 5 = 0, 'oui', NULL) AS sebiopag",
    )
    return s_.with_info(q._plot_rows(spark, d).select("id_plot", "x", "y"), info)


def _candidates(spark, d):
    rows = q._plot_rows(spark, d)
    new = rows.selectExpr("concat('n', id_plot) AS id_plot", "x", "y", "IF(k % 2 = 0, 'OUI', NULL) AS AB", "CAST(NULL AS STRING) AS filet")
    potential = _gps(spark, d).where("row % 10 = 0").selectExpr("concat('p', row) AS id_plot", "lon AS x", "lat AS y", "'NON' AS filet")
    return s_.candidates_exclusion(s_.gps_candidates(_gps(spark, d), "lon", "lat", ["row"]), _plots_with_info(spark, d), new, potential)


def _year(spark, d, n):
    at = p.merge_plot_years([q.plot_years(spark, d)[n]])
    tables_ = p.land_cover_composition(at, q.land_cover(spark, d), [250, 500])
    return p.multi_radius([tables.add_suffix(tables_.where(F.col("r") == r).drop("r"), f"_buffer_{r}", ["id_plot"]) for r in (250, 500)])


def _ratio(spark, d):
    return p.organic_share_of_orchards(q._orchards(spark, d), q.organic(spark, d))


def _composition(spark, d):
    return q._rounded(p.land_cover_composition(q.plots(spark, d), q.land_cover(spark, d), [RADIUS]))


def queries() -> dict:
    keep = ["FID_plot", *SHARES, *GREEN]
    return {
        "clean_layer": cleaned,
        "orchard_landscape_table_500": lambda s, d: q._rounded(
            landscape(s, d).select(*keep, "filet", "ratioABtot", g.area("geometry").alias("aire"))
        ),
        "tag_orchards_500": lambda s, d: q._rounded(tagged(s, d).select(
            "FID_plot", "parcelle_suivie", "candidat", "filet", "filet_ok", "exclu_all", "pourcent_verger", "percent_haie", "x", "y"
        )),
        "tag_monitored_plots_500": lambda s, d: q._rounded(
            o.tag_monitored_plots(landscape(s, d), _points(s, d).select("id_plot", "exclu", "x", "y"))
            .select("FID_plot", "id_plot", "parcelles_suivies", "exclu", "pourcent_verger", "percent_ESN", "x", "y")
        ),
        "orchard_correlations": lambda s, d: q._rounded(o.orchard_correlations(tagged(s, d)).drop("p"), 6),
        "selected_plots_landscape_500": lambda s, d: q._rounded(
            o.landscape_of(q.plots(s, d), "id_plot", q.land_cover(s, d), q.nets(s, d), _orchards(s, d)[1], float(RADIUS))
        ),
        "organic_ratio_histogram": lambda s, d: q._rounded(stats.histogram_breaks(_ratio(s, d), "ratioABtot"), 6),
        "urban_histogram": lambda s, d: q._rounded(stats.histogram_breaks(_composition(s, d), "urbain"), 6),
        "urban_histogram_20": lambda s, d: q._rounded(stats.histogram_breaks(_composition(s, d), "urbain", 20), 6),
        "scatter_data": lambda s, d: stats.scatter_data(_composition(s, d), "urbain", "prairies", (5, 20), (0, 15), ("id_plot",)),
        "multi_year": lambda s, d: q._rounded(o.multi_year(_year(s, d, 0), _year(s, d, 1), _year(s, d, 0))),
        "multi_year_plots": lambda s, d: tables.unique_values(
            tables.union_by_name(*[y.select("id_plot") for y in q.plot_years(s, d)], strict=True), "id_plot"
        ),
        "candidates_organic_no_net": lambda s, d: q._rounded(
            s_.candidates_organic_no_net(s_.gps_candidates(_gps(s, d), "lon", "lat", ["row"]), _plots_with_info(s, d))
        ),
        "candidates_exclusion_points": lambda s, d: q._rounded(_candidates(s, d)),
        "sebiopag_plots": lambda s, d: q._rounded(s_.sebiopag_plots(_plots_with_info(s, d)).select("id_plot", "x", "y")),
    }


# --- the same in SQL ------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    def sql(select: str, *more: str, plots: str = "") -> str:
        layers = q._LAYERS.replace("plots AS (", "plots_of_years AS (") + f", plots AS ({plots})" if plots else q._LAYERS
        return f"WITH {', '.join([layers, *more])} {select}"

    nominal = f"({p.NOMINAL_DISC} * {RADIUS} * {RADIUS}) * 100"
    by_net = q._ORGANIC.replace("FROM cells WHERE CAST", "FROM cells WHERE FID % 3 <> 0 AND CAST")
    middle = "CASE FID % 4 WHEN 0 THEN 125.0 / 3 WHEN 1 THEN (500000 - 900 * 45) / 9100.0 ELSE 50 END"
    targets = f"SELECT FID AS id_plot, x + {middle} AS x, y + {middle} AS y FROM cells WHERE FID % 3 <> 0 AND CAST(c3 AS VARCHAR) LIKE '13%'"
    netted = """netted AS (SELECT e.FID, a, b, v, w, 1 AS one FROM edges e JOIN nets n ON n.FID = e.FID AND nx = cx
        WHERE CAST(n.c3 AS VARCHAR) LIKE '1%' AND filet IN ('oui', 'mixte'))"""
    own = "own AS (SELECT e.FID, a, b, v, w, 1 AS one FROM edges e JOIN bio USING (FID))"
    natures = ", ".join(f"({i}, '{c}')" for i, c in enumerate(p.VEGETATION.values()))
    green = f"""kinds(k, nature) AS (VALUES {natures}),
        veg AS (SELECT nature, x + 20 - away AS a, x + 20 + size - away AS b, y + up AS v, w
        FROM (SELECT *, CASE WHEN size % 4 = 0 THEN 0 ELSE {q.VEGETATION_AWAY} END AS away FROM cells) JOIN kinds ON k = FID * 7 % 9,
        (VALUES (0, -1), (40, 1)) t(up, w))"""
    classes = {v: k for k, v in p.LAND_COVER.items()}
    cover = ", ".join(f"coalesce(sum(CASE WHEN c1 = {classes[k]} THEN area END), 0) / sum(area) * 100 AS {v}" for k, v in o.SHARES.items())
    kinds = ", ".join(f"coalesce(sum(CASE WHEN nature = '{c}' THEN area END), 0) / {nominal} AS percent_{c}" for c in p.SEMI_NATURAL)
    common = [
        q._clip("lc", "edges", "c1", RADIUS), netted, q._clip("na", "netted", "one", RADIUS), by_net, own, q._clip("oa", "own", "one", RADIUS),
        f"cover AS (SELECT id_plot, {cover}, coalesce(sum(CASE WHEN c1 = 1 THEN area END), 0) AS vergers FROM lc GROUP BY id_plot)",
        f"""around AS (SELECT c.*, oa.area / {nominal} AS percent_verger_bio, coalesce(na.area, 0) / {nominal} AS percent_verger_filet,
            CASE WHEN coalesce(na.area, 0) = 0 AND vergers = 0 THEN 0 WHEN vergers <> 0 THEN coalesce(na.area, 0) / vergers * 100 END AS percent_of_orchards_with_nets
            FROM cover c LEFT JOIN oa USING (id_plot) LEFT JOIN na USING (id_plot))""",
    ]
    table = [
        *common, green, q._clip("va", "veg", "nature", RADIUS), f"shrubs AS (SELECT id_plot, {kinds} FROM va GROUP BY id_plot)",
        f"""land AS (SELECT a.* EXCLUDE (id_plot, percent_verger_bio), coalesce(percent_verger_bio, 0) AS percent_verger_bio, a.id_plot AS FID_plot, s.* EXCLUDE (id_plot),
            {' + '.join(f'percent_{c}' for c in p.SEMI_NATURAL)} AS "percent_ESN", n.filet, coalesce(ratioABtot, 0) AS ratioABtot, aire, x AS mx, y AS my
            FROM around a LEFT JOIN shrubs s USING (id_plot) JOIN nets n ON n.FID = a.id_plot LEFT JOIN bio ON bio.FID = a.id_plot
            JOIN areas ON areas.FID = a.id_plot JOIN plots ON plots.id_plot = a.id_plot)""",
    ]
    points = """points AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_nationkey % 3 <> 0 THEN 'NON' END AS filet_ok,
        CASE WHEN c_custkey % 4 <> 0 THEN 'oui' END AS exclu, CASE WHEN c_custkey % 5 = 0 THEN 'binome_arrachee' ELSE 'ok' END AS valide,
        (c_custkey * 733) % 5000 + 0.5::DOUBLE AS x, (c_custkey * 389) % h + 0.5::DOUBLE AS y FROM customer, h)"""
    hit = """p.x BETWEEN c.x AND c.x + 100 AND p.y BETWEEN c.y AND c.y + 100 AND NOT (FID % 4 = 0 AND p.x > c.x + 50 AND p.y > c.y + 50)
        AND NOT (FID % 4 = 1 AND p.x > c.x + 30 AND p.x < c.x + 60 AND p.y > c.y + 30 AND p.y < c.y + 60)"""
    tags = f"""tags AS (SELECT land.*, coalesce(id, '0') AS parcelle_suivie, CASE WHEN id IS NULL THEN 0 ELSE 1 END AS candidat, coalesce(filet_ok, '0') AS filet_ok_,
        coalesce(exclu, '0') AS exclu_, coalesce(valide, '0') AS valide_ FROM land JOIN cells c ON c.FID = FID_plot LEFT JOIN points p ON {hit})"""
    filled = "round(coalesce({c}, 0), 3) AS {c}".format
    pairs = []
    subsets = {
        "all": "exclu_ || '_' || valide_ <> 'oui_binome_arrachee' AND filet <> 'oui'",
        "candidates": "exclu_ || '_' || valide_ <> 'oui_binome_arrachee' AND filet <> 'oui' AND candidat = 1",
        "exclu": "candidat = 1 AND filet_ok_ = 'NON' AND exclu_ = 'oui' AND valide_ = 'ok'",
    }
    y = "coalesce(percent_of_orchards_with_nets, 0)"
    for name, keep in subsets.items():
        for x in ("pourcent_verger", "percent_haie", "percent_ESN"):
            v = f'coalesce("{x}", 0)'
            pairs.append(f"""SELECT '{name}' AS subset, '{x}' AS x, 'percent_of_orchards_with_nets' AS y, count(*) AS n,
                CASE WHEN min({v}) < max({v}) AND min({y}) < max({y}) THEN corr({v}, {y}) END AS r FROM tags WHERE {keep}""")
    tested = f"tested AS ({' UNION ALL '.join(pairs)})"
    lam = f"{pr.CONE!r}::DOUBLE * (radians(lon) - {pr.LON_0!r})"
    e = f"{pr.ECC!r}::DOUBLE * sin(radians(lat))"
    rho = f"{pr.SCALE!r}::DOUBLE * exp(-{pr.CONE!r}::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2) * pow((1 - {e}) / (1 + {e}), {pr.ECC / 2!r}::DOUBLE)))"
    sheet = f"""sheet AS (SELECT *, {pr.EASTING_0} + {rho} * sin({lam}) AS x, {pr.NORTHING_0} + {pr.RHO_0!r}::DOUBLE - {rho} * cos({lam}) AS y
        FROM (SELECT c_custkey AS no, 5 + (c_custkey % 1000) / 10000.0::DOUBLE AS lon, 43.9::DOUBLE + (c_custkey % 777) / 10000.0::DOUBLE AS lat,
        c_nationkey % 4 <> 0 AS ok FROM customer)),
      gps AS (SELECT '2022_' || row_number() OVER (ORDER BY no) AS id_plot, x, y FROM sheet WHERE ok)"""
    info = """info AS (SELECT CAST(k AS VARCHAR) AS id_plot, x, y, CASE WHEN s_nationkey % 2 = 0 THEN 'OUI' ELSE 'NON' END AS ab,
        CASE WHEN k % 3 = 0 THEN 'OUI' ELSE 'NON' END AS filet, CASE WHEN k % 5 = 0 THEN 'oui' ELSE 'non' END AS exclu,
        CASE WHEN k % 4 = 0 THEN 'binome_arrachee' ELSE 'ok' END AS valide, s_nationkey % 5 = 0 AS sebio
        FROM rows_ JOIN supplier ON s_suppkey = k WHERE k % 7 <> 3)"""

    def bins(values: str, wanted: str, *more: str) -> str:
        return sql(
            "SELECT round((k - 1) * width, 6) AS lower, round(k * width, 6) AS upper, coalesce(n, 0) AS n FROM bins LEFT JOIN counts USING (k)", *more,
            f"vals AS ({values})",
            f"span AS (SELECT *, CASE WHEN high > low THEN (high - low) / bins ELSE 1 END AS raw FROM (SELECT min(v) AS low, max(v) AS high, count(*) AS n, {wanted} AS bins FROM vals) WHERE n > 0)",
            "based AS (SELECT *, pow(10, floor(log10(raw))) AS base FROM span)",
            "wide AS (SELECT *, base * CASE WHEN raw > base * 7 THEN 10 WHEN raw > base * 2.8 THEN 5 WHEN raw > base * 1.4 THEN 2 ELSE 1 END AS width FROM based)",
            "ends AS (SELECT width, CAST(CASE WHEN high > low THEN floor(low / width + 1e-7) ELSE ceil(low / width) - 1 END AS BIGINT) AS f, CAST(ceil(high / width - 1e-7) AS BIGINT) AS l FROM wide)",
            "bins AS (SELECT width, unnest(range(f + 1, greatest(l, f + 1) + 1)) AS k FROM ends)",
            "counts AS (SELECT greatest(CAST(ceil(v / width - 1e-7) AS BIGINT), f + 1) AS k, count(*) AS n FROM vals, ends GROUP BY 1)",
        )

    def year(n: int) -> str:
        keep = ("k % 3 <> 0", "k % 2 = 0")[n]
        one = [
            sql(
                f"SELECT id_plot, {', '.join(f'{c} AS {c}_buffer_{r}' for c in ['area_tot_buffer', *[v for v in p.LAND_COVER.values() if v != 'vergers']])} FROM comp",
                q._composition(r), plots=f"SELECT id_plot, x + {10 * n} AS x, y FROM rows_ WHERE {keep}",
            )
            for r in (250, 500)
        ]
        return f"SELECT * FROM ({one[0]}) JOIN ({one[1]}) USING (id_plot)"

    urban = "SELECT urbain AS v FROM comp"
    sturges = "CAST(ceil(log2(count(*)) + 1) AS DOUBLE)"
    rings = "CASE FID % 8 WHEN 4 THEN 2 WHEN 5 THEN 2 WHEN 1 THEN NULL WHEN 7 THEN NULL ELSE 1 END"
    return {
        "clean_layer": sql(f"""SELECT FID, CASE FID % 8 WHEN 1 THEN 'crosses itself' WHEN 7 THEN 'rings cross' ELSE '' END AS reason, {rings} AS n_rings,
            CASE FID % 8 WHEN 5 THEN 1 WHEN 1 THEN NULL WHEN 7 THEN NULL ELSE 0 END AS n_holes,
            CASE FID % 8 WHEN 4 THEN 8160.0 WHEN 5 THEN 6900.0 WHEN 1 THEN NULL WHEN 7 THEN NULL ELSE 8100.0 END::DOUBLE AS area FROM cells"""),
        "orchard_landscape_table_500": sql(
            f"""SELECT FID_plot, {', '.join(f'round("{c}", 3) AS "{c}"' for c in [*SHARES, *GREEN])}, filet, round(ratioABtot, 3) AS ratioABtot, aire FROM land""",
            *table, plots=targets,
        ),
        "tag_orchards_500": sql(
            f"""SELECT FID_plot, parcelle_suivie, candidat, filet, filet_ok_ AS filet_ok, exclu_ || '_' || valide_ AS exclu_all, {filled(c='pourcent_verger')},
            {filled(c='percent_haie')}, round(mx, 3) AS x, round(my, 3) AS y FROM tags""",
            *table, points, tags, plots=targets,
        ),
        "tag_monitored_plots_500": sql(
            f"""SELECT FID_plot, parcelle_suivie AS id_plot, 1 AS parcelles_suivies, exclu_ AS exclu, {filled(c='pourcent_verger')},
            round(coalesce("percent_ESN", 0), 3) AS "percent_ESN", round(mx, 3) AS x, round(my, 3) AS y FROM tags WHERE candidat = 1""",
            *table, points, tags, plots=targets,
        ),
        "orchard_correlations": sql(
            f"""SELECT subset, x, y, n, round(r, 6) AS r, round(CASE WHEN n > 2 AND abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END, 6) AS t, n - 2 AS df,
            round(CASE WHEN n > 3 AND abs(r) < 1 THEN tanh(atanh(r) - {stats.Z_95} / sqrt(n - 3)) END, 6) AS ci_low,
            round(CASE WHEN n > 3 AND abs(r) < 1 THEN tanh(atanh(r) + {stats.Z_95} / sqrt(n - 3)) END, 6) AS ci_high FROM tested""",
            *table, points, tags, tested, plots=targets,
        ),
        "selected_plots_landscape_500": sql(f"SELECT id_plot, {', '.join(f'round({c}, 3) AS {c}' for c in SHARES)} FROM around", *common),
        "organic_ratio_histogram": bins("SELECT area_AB / aire * 100 AS v FROM lap JOIN areas USING (FID) WHERE area_AB > 1e-6", sturges, q._ORGANIC),
        "urban_histogram": bins(urban, sturges, q._composition(RADIUS)),
        "urban_histogram_20": bins(urban, "20.0::DOUBLE", q._composition(RADIUS)),
        "scatter_data": sql("SELECT id_plot, urbain AS x, prairies AS y FROM comp WHERE urbain BETWEEN 5 AND 20 AND prairies BETWEEN 0 AND 15", q._composition(RADIUS)),
        "multi_year": f"({year(0)}) UNION ({year(1)})",
        "multi_year_plots": "SELECT CAST(s_suppkey AS VARCHAR) AS id_plot FROM supplier",
        "candidates_organic_no_net": sql(
            """SELECT id_plot, 'OUI' AS "AB", 'NON' AS filet, 'NON' AS paire, round(x, 3) AS x, round(y, 3) AS y FROM gps
            UNION ALL SELECT id_plot, ab, filet, 'OUI', round(x, 3), round(y, 3) FROM info WHERE ab = 'OUI' AND filet = 'NON' AND valide = 'ok'""", sheet, info,
        ),
        "candidates_exclusion_points": sql(
            """SELECT id_plot, 'OUI' AS "AB", 'NON' AS filet, 'Oiseaux' AS exclu, 'ok' AS valide_2022, round(x, 3) AS x, round(y, 3) AS y FROM gps
            UNION ALL SELECT id_plot, ab, filet, exclu, valide, round(x, 3), round(y, 3) FROM info WHERE exclu = 'oui' AND valide = 'ok' OR valide = 'binome_arrachee'
            UNION ALL SELECT 'n' || id_plot, CASE WHEN k % 2 = 0 THEN 'OUI' END, NULL, 'oui', 'ok', round(x, 3), round(y, 3) FROM rows_
            UNION ALL SELECT 'p' || no, NULL, 'NON', 'Oiseaux', 'ok', round(x, 3), round(y, 3) FROM sheet WHERE no % 10 = 0""", sheet, info,
        ),
        "sebiopag_plots": sql("SELECT id_plot, round(x, 3) AS x, round(y, 3) AS y FROM info WHERE sebio", info),
    }
