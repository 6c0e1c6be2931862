"""The analyses: from layers to tables of landscape variables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import tables as t
from ..operators.overlay import discs, overlay_lines_discs, overlay_polygons, overlay_polygons_discs
from ..operators.spatial_join import match_points, match_polygons

# Area of the nominal disc of radius 1, land-cover classes, net types.
NOMINAL_DISC = 3.141016
LAND_COVER = {
    1: "vergers", 2: "urbain", 3: "cult_annuelles", 4: "milieu_nat", 5: "prairies", 6: "vignes", 0: "autres",
}
VEGETATION = {
    "Bois": "bois", "Forêt fermée de feuillus": "foret_fermee_feuillus", "Haie": "haie", "Verger": "verger",
    "Forêt ouverte": "foret_ouverte", "Lande ligneuse": "lande_ligneuse", "Vigne": "vigne",
    "Forêt fermée mixte": "foret_fermee_mixte", "Forêt fermée de conifères": "foret_fermee_coniferes",
}
SEMI_NATURAL = [c for c in VEGETATION.values() if c not in ("bois", "verger", "vigne")]
NET_TYPES = {t: t for t in ("absent", "monoparcelle", "monorang", "non_deploye")}


def merge_plot_years(years: list[DataFrame]) -> DataFrame:
    """One centroid per plot, of the first year that has it."""
    rows = t.in_order(*years, row_order="id_plot")
    return g.centroids(t.first_by_key(rows, "id_plot", ["source_no", "row_no"]).drop("source_no", "row_no"))


def normalise_nets(nets: DataFrame) -> DataFrame:
    return nets.withColumn(
        "type_filet", F.when(F.col("filet") == "non", F.lit("absent")).otherwise(F.col("type_filet"))
    )


def pome_orchards(layer: DataFrame) -> DataFrame:
    """Features whose detailed code starts with 13, once per FID."""
    return t.first_by_key(
        layer.where(F.col("Code_n3").cast("string").startswith("13")), "FID", ["FID", "Code_n3"]
    )


def organic_share_of_orchards(orchards: DataFrame, organic: DataFrame) -> DataFrame:
    """Orchards with the area that organic parcels cover and its percentage."""
    covered = overlay_polygons(orchards.select("FID", "geometry"), organic, ["FID"])
    return (
        orchards.withColumn("aire_plot", g.area("geometry"))
        .join(t.shuffled(covered.withColumnRenamed("area_m2", "area_AB")), "FID", "left")
        .withColumn("ratioABtot", t.share("area_AB", "aire_plot"))
    )


def organic_orchards(orchards: DataFrame, organic: DataFrame, limit: float = 50.0) -> DataFrame:
    return (
        organic_share_of_orchards(orchards, organic)
        .where(F.col("ratioABtot") > limit)
        .withColumn("AB_cartobio", F.lit(1))
    )


def organic_flag_all_orchards(orchards: DataFrame, found: DataFrame) -> DataFrame:
    flags = orchards.join(t.shuffled(found.select("FID", "ratioABtot", "AB_cartobio")), "FID", "left")
    return t.fill_zero(flags, ["ratioABtot", "AB_cartobio"])


def organic_without_net(found: DataFrame) -> DataFrame:
    return found.where("filet = 'non'")


def land_cover_composition(plots: DataFrame, land_cover: DataFrame, radii) -> DataFrame:
    """``id_plot, r``, the covered area and the share of every class but orchards in it."""
    areas = overlay_polygons_discs(land_cover, discs(plots.select("id_plot", "x", "y"), radii), ["Code_n1"])
    wide = t.pivot_sum(areas, ["id_plot", "r"], "Code_n1", "area_m2", LAND_COVER, total="area_tot_buffer")
    shares = {c: t.share(F.coalesce(F.col(c), F.lit(0.0)), F.col("area_tot_buffer")) for c in LAND_COVER.values()}
    return t.fill_zero(wide.withColumns(shares)).drop("vergers")


def _nominal(column: str):
    return F.col(column) / (F.lit(NOMINAL_DISC) * F.col("r") * F.col("r")) * 100.0


def net_composition(plots: DataFrame, land_cover: DataFrame, nets: DataFrame, radii) -> DataFrame:
    """Orchards by net type: shares of the orchard area and of the nominal disc.

    Orchards are land-cover polygons that hold the centroid of a net-layer orchard.
    """
    own = g.centroids(nets.where(F.col("Code_n3").cast("string").startswith("1"))).withColumnRenamed("FID", "net")
    held = match_points(land_cover, own, "FID", "net").join(t.shuffled(own.select("net", "type_filet")), "net")
    orchards = land_cover.select("FID", "geometry").join(t.shuffled(held), "FID")
    areas = overlay_polygons_discs(orchards, discs(plots.select("id_plot", "x", "y"), radii), ["type_filet"])
    wide = t.fill_zero(
        t.pivot_sum(areas, ["id_plot", "r"], "type_filet", "area_m2", NET_TYPES, null_name="inconnu", total="tot_vergers")
    )
    out = {f"{c}_vergers": t.share(F.col(c), F.col("tot_vergers")) for c in NET_TYPES}
    disc = {c: _nominal(c) for c in [*NET_TYPES, "inconnu"]}
    return wide.withColumns(out | disc).withColumn("pourcent_vergers", sum(F.col(c) for c in disc))


def netted_share(plots: DataFrame, land_cover: DataFrame, nets: DataFrame, radii) -> DataFrame:
    """Area under nets per disc, its share of the nominal disc and of the orchard area; 0 where there is none.

    Netted are land-cover polygons that touch a net-layer orchard with a net, once for each.  Discs
    without any land cover have no row.  ``percent_of_orchards_with_nets`` is NULL where there are nets
    but no orchards.
    """
    targets = discs(plots.select("id_plot", "x", "y"), radii)
    own = nets.where(F.col("Code_n3").cast("string").startswith("1") & F.col("filet").isin("oui", "mixte"))
    pairs = match_polygons(land_cover, own.withColumnRenamed("FID", "net"), "FID", "net")
    held = land_cover.select("FID", "geometry").join(t.shuffled(pairs), "FID").withColumn("one", F.lit(1))
    netted = overlay_polygons_discs(held, targets, ["one"]).select("id_plot", "r", F.col("area_m2").alias("area_filets"))
    cover = overlay_polygons_discs(land_cover, targets, ["Code_n1"])
    orchards = t.pivot_sum(cover, ["id_plot", "r"], "Code_n1", "area_m2", {1: "vergers"})
    both = t.fill_zero(orchards.join(t.shuffled(netted), ["id_plot", "r"], "left"), ["vergers", "area_filets"])
    return both.withColumns({
        "percent_verger_filet": _nominal("area_filets"),
        "percent_of_orchards_with_nets": t.share("area_filets", "vergers"),
    })


def semi_natural_share(plots: DataFrame, vegetation: DataFrame, radii) -> DataFrame:
    """Shares of the nominal disc under six kinds of vegetation and their sum, for discs with any vegetation."""
    areas = overlay_polygons_discs(vegetation, discs(plots.select("id_plot", "x", "y"), radii), ["NATURE"])
    wide = t.fill_zero(
        t.pivot_sum(areas, ["id_plot", "r"], "NATURE", "area_m2", VEGETATION), list(VEGETATION.values())
    )
    shares = [_nominal(c).alias(f"percent_{c}") for c in SEMI_NATURAL]
    total = sum(F.col(f"percent_{c}") for c in SEMI_NATURAL)
    return wide.select("id_plot", "r", *shares).withColumn("percent_ESN", total)


def organic_share(plots: DataFrame, organic: DataFrame, radii) -> DataFrame:
    """Share of the nominal disc under organic orchards; 0 where there are none."""
    targets = discs(plots.select("id_plot", "x", "y"), radii)
    areas = overlay_polygons_discs(organic.withColumn("one", F.lit(1)), targets, ["one"])
    own = areas.select("id_plot", "r", _nominal("area_m2").alias("percent_verger_bio"))
    return t.fill_zero(targets.select("id_plot", "r").join(t.shuffled(own), ["id_plot", "r"], "left"), ["percent_verger_bio"])


def hedge_length(plots: DataFrame, hedges: DataFrame, radii) -> DataFrame:
    """Number and length of hedges; NULL where there are none."""
    targets = discs(plots.select("id_plot", "x", "y"), radii)
    lengths = overlay_lines_discs(hedges, targets, "id")
    sums = t.count_and_sum(lengths, ["id_plot", "r"], "length_m", "length_haies", "nb_haies")
    return targets.select("id_plot", "r").join(t.shuffled(sums), ["id_plot", "r"], "left")


def landscape_table(composition, nets, organic, hedges, radius: int) -> DataFrame:
    """The four tables side by side for one radius, columns with the radius at their end."""
    one = [d.where(F.col("r") == float(radius)).drop("r") for d in (composition, nets, organic, hedges)]
    rest = one[1].join(t.shuffled(one[2]), "id_plot", "left").join(t.shuffled(one[3]), "id_plot", "left")
    return t.add_suffix(one[0].join(t.shuffled(rest), "id_plot", "left"), f"_buffer_{radius}", ["id_plot"])


def multi_radius(tables: list[DataFrame]) -> DataFrame:
    """Landscape tables of several radii side by side, for the plots that all of them have."""
    return reduce(lambda a, b: a.join(t.shuffled(b), "id_plot"), tables)


def with_plot_info(table: DataFrame, info: DataFrame) -> DataFrame:
    """Plots with their landscape and attributes, either may be missing; those excluded for birds."""
    return table.join(t.shuffled(info), "id_plot", "full").where("exclu_oiseaux = 'oui'")


def candidates(*layers: DataFrame) -> DataFrame:
    """All candidates of the layers with the defaults for missing values, in this order:
    no exclusion is one of birds, no word on nets is an exclusion, no validation is a valid plot."""
    named = ["id_plot", "AB", "filet", "exclu", "valide_2022"]
    every = t.union_by_name(*layers)
    where = [c for c in ("x", "y") if c in every.columns]
    return every.select(*named, *where).select(
        "id_plot", "AB", "filet", *where,
        F.when(F.col("filet").isNull(), F.lit("oui")).otherwise(F.coalesce("exclu", F.lit("Oiseaux"))).alias("exclu"),
        F.coalesce("valide_2022", F.lit("ok")).alias("valide_2022"),
    )


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """``middle, n``: rows per bin of the width; bins lie around its multiples and hold their upper end."""
    middle = F.ceil((F.col(column) - width / 2) / width) * F.lit(float(width))
    return df.where(F.col(column).isNotNull()).groupBy(middle.cast("double").alias("middle")).agg(F.count(F.lit(1)).alias("n"))


def orchard_crosstab(nets: DataFrame) -> DataFrame:
    """Number and area of features per detailed code and net type."""
    rows = normalise_nets(nets).withColumn("area_m2", g.area("geometry"))
    kinds = [*NET_TYPES, None]
    cells = []
    for kind in kinds:
        name = kind or "inconnu"
        hit = F.col("type_filet").isNull() if kind is None else F.col("type_filet") == kind
        cells += [
            F.count(F.when(hit, 1)).alias(f"n_{name}"),
            F.coalesce(F.sum(F.when(hit, F.col("area_m2"))), F.lit(0.0)).alias(f"area_{name}"),
        ]
    return rows.groupBy("Code_n3").agg(*cells)


def update_land_cover_hits(land_cover: DataFrame, survey: DataFrame) -> DataFrame:
    """Land-cover polygons that hold the centroid of a survey plot."""
    return match_points(land_cover, survey, "FID", "id_plot").join(t.shuffled(land_cover.drop("geometry")), "FID")


def pearson_test(df: DataFrame, x: str, y: str, confidence_z: float = 1.959963984540054) -> DataFrame:
    """One row ``n, r, t, df, ci_low, ci_high`` of the product-moment correlation test."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    one = both.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    z, half = F.atanh("r"), F.lit(confidence_z) / F.sqrt(F.col("n") - 3)
    return one.select(
        "n", "r",
        (F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).alias("t"),
        (F.col("n") - 2).alias("df"),
        F.tanh(z - half).alias("ci_low"), F.tanh(z + half).alias("ci_high"),
    )


def layer_profile(land_cover: DataFrame, hedges: DataFrame) -> DataFrame:
    """``what, value``: features per class, and total length of the hedges in kilometres."""
    classes = t.count_by(land_cover, "Code_n1", "n").select(
        F.concat(F.lit("class "), F.col("Code_n1").cast("string")).alias("what"), F.col("n").cast("double").alias("value")
    )
    total = hedges.agg((F.sum(g.length("geometry")) / 1000.0).alias("value")).select(F.lit("hedge km").alias("what"), "value")
    return classes.union(total)


def nominal_ratio(quadrant_segments: int = 50) -> float:
    """Area of the drawn disc of radius 1."""
    n = 4 * quadrant_segments
    return n / 2 * math.sin(2 * math.pi / n)
